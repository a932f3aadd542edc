"""Main text of web pages by maximum-scoring subsequence.

A page is cut into words and tags. Tags score negative; words score by their surroundings: the
elements that they are in, whether they are a link, and what the class, id and role of these
elements say. How much each of that counts comes from labelled pages: a logistic regression, over
their words, of being part of the article, and for tags the log-odds of being inside it. One linear
scan finds the contiguous run of greatest sum; it is the article, but for blocks in it that score
below zero themselves (an advert, a list of links, comments).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words that sites commonly use in class, id and role.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video noembed noframes xmp head".split())
PLAIN = frozenset("title textarea".split())
BOILERPLATE = frozenset("ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus discussion footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget anuncio anuncios anzeige anzeigen comentario comentarios commentaire commentaires feedback guestbook kommentar kommentare publicidad publicite stories werbung".split())
CONTENT = frozenset("article main post entry story content body text prose".split())
STRUCTURE = frozenset("a area bar block bottom box btn button buttons col column container form group holder icon icons inner item items layer left link links list main message more outer page panel posts primary region right secondary section site slot small title top unit wrap wrapper".split())
LAYOUT = frozenset("has no with without".split())
_ELEMENTS = {"nav": "nav", "footer": "footer", "aside": "aside", "header": "header", "article": "article", "main": "main"} | dict.fromkeys("form menu button select dialog label fieldset search".split(), "form")
_PLACES = {"p": "p", "li": "li", "dd": "li", "dt": "li", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "quote"} | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "title")
# End of the fixed values.

_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Searched in the page itself: lower-casing can change its length.
_ENDS = {n: re.compile(f"</{n}", re.I | re.A) for n in RAW | PLAIN}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Start that end an open paragraph or item of the same kind.
_CLOSES = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol menu dialog fieldset".split())

#: What is said of a word: the elements that it is in, names that mean boilerplate or content as a
#: whole or in part, the kind of its nearest block, and the same for links.
FEATURES = ("nav", "footer", "aside", "header", "form", "article", "main", "boilerplate", "boilerplate in part", "content", "content in part", "p", "li", "cell", "quote", "title", "other", "link p", "link li", "link cell", "link quote", "link title", "link other")
_BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
RAW_TEXT = -1


@lru_cache(20_000)
def _named(names: str) -> int:
    """What class, id and role names say. A name of several words means boilerplate as a whole if
    its other words are of structure or content (``site-footer``, ``post-comments``), else in part
    (``related-work``); ``header`` beside a word of content says nothing, nor do names of layouts
    (``no-sidebar``)."""
    out = 0
    for name in _CAMEL.sub("-", names).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if not words or words[0] in LAYOUT:
            continue
        bad = {w for w in words if w in BOILERPLATE}
        good = {w for w in words if w in CONTENT}
        if good - STRUCTURE and bad == {"header"}:
            continue
        known = all(w in BOILERPLATE or w in CONTENT or w in STRUCTURE or w.isdigit() for w in words)
        if bad:
            out |= _BIT["boilerplate"] if known else _BIT["boilerplate in part"]
        elif good:
            out |= _BIT["content"] if known else _BIT["content in part"]
    return out


@lru_cache(20_000)
def _said(name: str, attributes: str) -> int:
    """The features that an element gives to all that is in it; ``RAW_TEXT`` if that is no text."""
    if name in RAW or name in PLAIN:
        return RAW_TEXT
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return RAW_TEXT
    out = _BIT[_ELEMENTS[name]] if name in _ELEMENTS else 0
    if found.get("role", "").lower() == "main":
        out |= _BIT["main"]
    if name not in ("body", "html"):
        out |= _named(" ".join(found[k] for k in ("class", "id", "role") if k in found))
    return out


class _Tags:
    """The tags of a page, each found in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.unpaired = dict.fromkeys("\"'", len(page))  # from here on no such quote is closed

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``, or -1. A quote that is never closed
        is a character like any other."""
        while m := _STOPS.search(self.page, at):
            at = m.end()
            if (q := m[0]) == ">":
                return m.start()
            if m.start() < self.unpaired[q]:
                close = self.page.find(q, at)
                if close < 0:
                    self.unpaired[q] = m.start()
                else:
                    at = close + 1
        return -1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The next tag or comment from ``at``: where it starts and ends, ``/`` of an end tag, its name
        (empty for comments and declarations) and attributes. A tag that the page's end cuts off takes
        the rest of the page."""
        m = _OPENS.search(self.page, at)
        if m is None:
            return None
        if m[1] or m[2]:
            end = self.page.find("-->" if m[1] else ">", m.end())
            return m.start(), len(self.page) if end < 0 else end + (3 if m[1] else 1), "", "", ""
        end = self._end(m.end())
        if end < 0:
            return m.start(), len(self.page), "", "", ""
        return m.start(), end + 1, m[3], m[4].lower(), self.page[m.end() : end]


class _Open:
    """The open elements, with where those of each name lie, so that none is searched for."""

    def __init__(self):
        #: Name (empty once closed), features of all that is in it, kind of block, whether in a link.
        self.stack: list[tuple[str, int, str, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> tuple[str, int, str, bool] | None:
        return self.stack[-1] if self.stack else None

    def push(self, name: str, below: int, place: str, link: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, below, place, link))

    def _cut(self, size: int) -> None:
        while len(self.stack) > size or self.stack and not self.stack[-1][0]:
            name = self.stack.pop()[0]
            if name:
                self.at[name].pop()
                if name in _SCOPES:
                    self.scopes.pop()

    def pop(self) -> None:
        self._cut(len(self.stack) - 1)

    def close(self, name: str) -> None:
        """An end tag closes the last such element and all in it; not over the border of a scope,
        unless it is one itself."""
        found = self.at.get(name)
        if found and (name in _SCOPES or not self.scopes or self.scopes[-1] < found[-1]):
            self._cut(found[-1])

    def close_paragraph(self) -> None:
        """The open paragraph of this scope ends; what is open in it stays so."""
        found = self.at.get("p")
        if found and (not self.scopes or self.scopes[-1] < found[-1]):
            k = found.pop()
            self.stack[k] = ("", *self.stack[k][1:])
            self._cut(len(self.stack))


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, features) in page order: kind ``tag`` with its name, or ``text`` with its raw
    text and the features of its words, ``RAW_TEXT`` if it isn't text. Linear in the page's length."""
    tags, open_ = _Tags(page), _Open()
    skip = None
    at = 0
    context = _BIT["other"]
    while at < len(page):
        if skip is not None:  # the text of a raw element ends at its end tag alone
            close = _ENDS[skip].search(page, at)
            end = close.start() if close else len(page)
            yield "text", page[at:end], RAW_TEXT
            at, skip = end, None
            if at >= len(page):
                return
        found = tags.find(at)
        stop = found[0] if found else len(page)
        if stop > at:
            yield "text", page[at:stop], context
        if found is None:
            return
        _, at, ends, name, attributes = found
        if not name:
            continue
        if ends:
            open_.close(name)
        else:
            if (top := open_.top()) and name in _CLOSES.get(top[0], ()):
                open_.pop()
            elif name in BLOCKS - {"br"}:
                open_.close_paragraph()
            if name not in VOID and not attributes.rstrip().endswith("/"):
                _, above, place, link = open_.top() or ("", 0, "other", False)
                own = _said(name, attributes)
                if above == RAW_TEXT or own == RAW_TEXT:
                    below = RAW_TEXT
                else:
                    if above & (_BIT["article"] | _BIT["main"] | _BIT["content"]) and name == "header":
                        own &= ~_BIT["header"]  # an article's own header holds its title
                    elif above & (_BIT["article"] | _BIT["main"] | _BIT["content"]) and own & _BIT["boilerplate"] and _only_header(attributes):
                        own &= ~_BIT["boilerplate"]
                    below = above | own
                open_.push(name, below, _PLACES.get(name, "other") if name in BLOCKS else place, link or name == "a")
                if name in RAW | PLAIN and name not in ("svg", "math", "object", "canvas", "audio", "video", "head"):
                    skip = name
        _, below, place, link = open_.top() or ("", 0, "other", False)
        context = below if below == RAW_TEXT else below | _BIT[f"link {place}" if link else place]
        yield "tag", name, context


@lru_cache(20_000)
def _only_header(attributes: str) -> bool:
    """Whether ``header`` is the only boilerplate that the names mean."""
    found = " ".join((v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role"))
    return {w for w in _SPLIT.split(_CAMEL.sub("-", found).lower()) if w in BOILERPLATE} == {"header"}


# Labelled pages. [[ and ]] enclose what readers call the article.
LABELLED = [
    '<html><head><title>A walk</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News of the day</a></li></ul></nav><article>[[<h1>A walk by the sea</h1><p>We set out early, when the tide was low and the sand was firm.</p><p>By noon the <b>wind</b> had turned, and we <a href="/x">rested</a> behind the dunes.</p>]]</article><footer>&copy; The walkers. All rights reserved.</footer></body></html>',
    '<html><body><div id="menu"><a href="/a">Start</a> <a href="/b">Shop</a> <a href="/c">Contact us</a></div><div class="content">[[<h2>How bread rises</h2><p>Yeast eats sugar and gives off gas.</p><p>The gas is held by the dough, which grows.</p><ul><li>Use warm water.</li><li>Wait an hour.</li></ul>]]</div><div class="sidebar"><h3>Popular</h3><a href="/d">Ten cakes</a> <a href="/e">Best ovens of the year</a></div></body></html>',
    '<html><body><header><h1>The Daily</h1><form><input name="q"><button>Search</button></form></header><main>[[<p>The bridge was closed on Monday after an inspection.</p><p>Engineers expect repairs to last until spring, the city said.</p>]]<div class="comments"><p>Anna: I use it every day, what a pity.</p><p>Ben: About time they did this.</p></div></main><footer><p>Imprint and privacy</p></footer></body></html>',
    '<body><div class="cookie-notice"><p>We use cookies to improve your visit. Accept all cookies?</p><button>OK</button></div><section><article>[[<h1>Old maps</h1>Maps of the coast were drawn by hand.<br>Each took a year to finish.<br>]]<div class="ad">Buy new maps today, half price!</div>[[<p>Few of them survive.</p>]]</article></section><aside><p>Subscribe to our letter and win a prize.</p></aside></body>',
    '<body><table><tr><td><a href="/1">One</a><br><a href="/2">Two</a><br><a href="/3">Three</a></td><td>[[<p>The engine has four parts, and each can be replaced by hand.</p><p>Start with the filter, which sits below the cover.</p>]]</td></tr></table><p><a href="/legal">Legal</a> <a href="/help">Help</a></p></body>',
    '<body><div><a href="/">Home</a> &gt; <a href="/g">Garden</a></div><div>[[<h1>Pruning roses</h1><p>Cut above a bud that faces outward, in late winter.</p><p>Remove dead wood first and burn what is ill.</p><blockquote>Be bold, my teacher said.</blockquote>]]</div><div class="related"><a href="/r1">Roses for shade</a><a href="/r2">Feeding roses</a></div></body>',
    '<body><p>[[A note without any frame, of a few words only.]]</p></body>',
    '[[No markup at all, just a text that someone wrote down.]]',
    '<body><div class="content no-sidebar">[[<p>The lake froze early that year.</p><p>Boys skated to school, and the ferry stayed in its shed until March.</p>]]</div><div class="site-footer"><p>Made with care by the lake club.</p></div></body>',
    '<body><article>[[<div class="article-header"><h1>The last tram</h1></div><p>It left the depot at five with nobody aboard.</p><p class="related-work">Others have told the story before; see <a href="/t">the tram book</a>.</p><div class="search-and-replace">The old names were replaced by new ones.</div>]]<div class="share-buttons"><a href="/s">Share</a> <a href="/t">Send</a></div><section class="post-comments"><h3>Comments</h3><p>Carl: my uncle drove that tram.</p><p>Dora: nice pictures!</p></section></article></body>',
    '<body><div class="top-menu"><a href="/">Start</a></div><div class="teaser"><p>Read also: ten walks for the spring.</p></div><div><div>[[<h2>Salt</h2><p>Salt was once worth its weight in silver.</p><p><a href="/m">The mine</a> near the town still <a href="/v">takes visitors</a> in summer.</p><table><tr><th>Year</th><td>Tons</td></tr><tr><th>1900</th><td>80</td></tr></table>]]</div></div><div class="newsletter-box"><p>Get our letter every week, free of charge and easy to leave.</p></div></body>',
    '<body><main>[[<h1>Mending a chair</h1><ol><li>Take the seat off with a flat tool.</li><li>Glue the joints and <a href="/c">clamp them</a> for a day.</li></ol><pre>glue: two parts, water: one part</pre><figure><img src="c.png"><figcaption>The chair after a day.</figcaption></figure>]]<aside><h4>Tools</h4><p>All tools in this text were lent by the shop, which sells them at a fair price to everyone who comes by.</p></aside>[[<p>Now sit down.</p>]]</main><div id="sidebar-left"><h3>New</h3><ul><li><a href="/n1">Tables of oak</a></li><li><a href="/n2">Shelves for books</a></li></ul></div></body>',
    '<body><div id="page"><div id="header"><p>The village paper, since 1911</p></div><div class="post">[[<h1>Fair day</h1><p>The fair opens on Friday at noon.</p><p>Bring boots: the field is wet.</p>]]</div><div id="comments"><p>Will there be music again this year, does anybody know?</p></div><div id="footer"><p>Write to us or call.</p></div></div></body>',
    '<body><form action="/s"><label>Name</label><input><p>Please fill in all the fields before you send this form.</p></form><section>[[<p>Hens lay less in the dark months.</p><p>A lamp in the morning helps.</p><p>Feed them well.</p>]]</section><div class="advert"><p>Hen houses from forty, sent to your door in two days.</p></div><div class="copyright">All rights reserved by the hen club.</div></body>',
    '<body><div class="alert notice"><p>Our shop is closed this week, orders are sent from Monday on.</p></div><div class="entry-content">[[<p>Clay has to rest before it is thrown.</p><blockquote>Haste makes holes.</blockquote><p>Two days will do.</p>]]</div><div class="related-posts"><ul><li><a href="/g">Glazes at home</a></li><li><a href="/k">Kilns and fires</a></li></ul></div></body>',
    '<body><ul class="breadcrumbs"><li><a href="/">Home</a></li><li><a href="/r">Rivers</a></li></ul><div class="text">[[<p>The river turns north at the mill.</p><ul><li>Its upper part is steep.</li><li>Its lower part is slow and wide.</li></ul><p>Otters came back in the nineties.</p>]]</div><div class="pagination"><a href="/1">1</a> <a href="/2">2</a> <a href="/3">next page</a></div><footer><div><p>About us, and what we do with your data.</p></div></footer></body>',
]
# End of the fixed values.


def _words(text: str) -> int:
    return len(text.split())


def _vector(context: int) -> np.ndarray:
    return np.array([1.0, *((context >> i) & 1 for i in range(len(FEATURES)))])


@dataclass
class Scores:
    """What features of words are worth, and tags by name (``*``: any other)."""

    words: np.ndarray
    tags: dict[str, float]
    known: dict[int, float] = field(default_factory=dict)

    def of(self, context: int) -> float:
        """The score of a word, between -3 and 3; nothing for what isn't text."""
        if context == RAW_TEXT:
            return 0.0
        found = self.known.get(context)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[context] = float(np.clip(_vector(context) @ self.words, -3, 3))
        return found


@lru_cache(4)
def weights(labelled: tuple[str, ...] = tuple(LABELLED), penalty: float = 0.3, rounds: int = 25) -> Scores:
    """Learns from labelled pages: for words a logistic regression (Newton's method) of being inside
    the marks, in which a piece of text counts as the root of its number of words; for tags
    log((in + 1) / (out + 1)), held between -1 and -0.05."""
    rows, inside, sizes = [], [], []
    tags_in, tags_out = Counter(), Counter()
    for page in labelled:
        deep = False
        for kind, value, context in tokens(page):
            if kind == "tag":
                (tags_in if deep else tags_out)[value] += 1
                continue
            for part in re.split(r"(\[\[|\]\])", value):
                if part in ("[[", "]]"):
                    deep = part == "[["
                elif context != RAW_TEXT and (n := _words(part)):
                    rows.append(_vector(context))
                    inside.append(float(deep))
                    sizes.append(math.sqrt(n))
    x, y, n = np.array(rows), np.array(inside), np.array(sizes)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (p - y)) + ridge @ w)
    tags = {t: max(-1.0, min(math.log((tags_in[t] + 1) / (tags_out[t] + 1)), -0.05)) for t in {*tags_in, *tags_out}}
    return Scores(w, tags | {"*": -0.3})


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run [a, b) of greatest sum, in one pass; the longest such; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - start > span[1] - span[0]):
            best, span = total, (start, i + 1)
    return span


#: Most that a block of a score below zero takes away, and what tags in such surroundings do. They
#: aren't part of the text, so their length doesn't matter: no advert cuts an article in two.
LEAST_BLOCK, LEAST_TAG = -1.0, -0.05
_LINKS = sum(_BIT[name] for name in FEATURES if name.startswith("link "))
_UNLINKED = {_BIT[f"link {name}"]: _BIT[name] for name in ("p", "li", "cell", "quote", "title", "other")}


def extract(page: str | None, scores: Scores | None = None) -> str:
    """The main text: blocks in page order, joined by a line feed; empty if there is none.

    Character references are decoded, white space within a block becomes one space. Null is as
    empty. Words of a link stay or go with their block; other pieces of a block that score below
    zero are left out.
    """
    if not page:
        return ""
    scores = scores or weights()
    values: list[float] = []
    places: list[tuple[int, list[str]]] = []  # where a block lies in ``values``, and its pieces
    pieces: list[str] = []
    worth, before = 0.0, RAW_TEXT

    def close() -> None:
        nonlocal pieces, worth
        if pieces:
            if worth >= 0:
                places.append((len(values), pieces))
            values.append(max(worth, LEAST_BLOCK))
        pieces, worth = [], 0.0

    for kind, value, context in tokens(page):
        if kind == "text":
            if context == RAW_TEXT:
                continue
            if not (n := _words(value)):
                if pieces:
                    pieces.append(value)
                continue
            plain = context
            if link := context & _LINKS:
                plain = context & ~link | _UNLINKED[link]
            if scores.of(plain) < 0 and context & _BIT["boilerplate"] and pieces:
                continue  # an advert within a line
            pieces.append(value)
            worth += n * scores.of(context)
        else:
            if value in BLOCKS:
                close()
            within = min(scores.of(before), scores.of(context))
            values.append(LEAST_TAG if within < 0 or RAW_TEXT in (before, context) else scores.tags.get(value, scores.tags["*"]))
        before = context
    close()
    a, b = region(values)
    lines = (" ".join(entities.unescape("".join(x)).split()) for at, x in places if a <= at < b)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; null and empty pages have an empty text, null URLs
    stay null. Pages are read whole, however long. Rows are independent, so repeated rows, ties and
    empty tables need no rule; other columns are left out, whatever their names; nothing is shuffled."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
