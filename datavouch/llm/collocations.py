"""Frequent phrases whose parts occur together more than apart, counted over a prefix-free parse.

1. Texts are cut at punctuation into pieces, pieces into chunks: a chunk ends with the first window of
   ``longest - 1`` words whose content is a trigger, and the next one begins with that window. So equal
   passages give equal chunks wherever they are, no chunk that a window closes is a proper prefix of
   another, and every phrase of up to ``longest`` words that starts before the window lies whole in
   its chunk. The dictionary of distinct chunks and how often the parse has each is all that
   is kept of the texts.
2. Phrases are counted inside distinct chunks, each occurrence times the chunk's frequency. Those that
   start in a closing window are left to the next chunk, so an overlap counts once.
3. A longer phrase is as frequent as its rarest pair of words at most. So pairs are counted by hash
   first, and bit sets of fixed size say which hashes are frequent. Only those pairs, and phrases all of
   whose pairs are, are counted by their words; a full bit set, or two pairs of one hash, costs work
   and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datavouch.llm.common import bit_set, encode, in_bit_set, partitions, ragged_offsets, saved

#: Bits of the set of frequent pairs (16 MB), whatever the input.
FILTER_BITS = 1 << 27
#: One window in so many is a trigger.
TRIGGER = 16
#: Bytes that a task parses or counts at once; a longer text is taken alone.
BLOCK = 4 << 20

_END, _SPACE = 10, 32
_BYTES = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_c] = _END
_BYTES[9] = _SPACE
_BYTES = bytes(_BYTES)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = (a * _ODD ^ (b + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _ODD
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a buffer in which bytes of 32 part words and bytes of 10 pieces; it ends with one of these."""

    def __init__(self, buffer: bytes):
        raw = np.frombuffer(buffer, np.uint8)
        inside = (raw != _SPACE) & (raw != _END)
        ends = np.flatnonzero(~inside)
        starts = np.append(0, ends + 1)[:-1]
        line = raw[ends] == _END
        some = ends > starts
        self.starts, self.piece = starts[some], (np.cumsum(line) - line)[some]
        self.n = len(self.starts)
        self.offsets = ragged_offsets(ends[some] - self.starts)
        self.bytes = raw[inside]
        arr = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.bytes)])
        coded = arr.dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))

    def joined(self, first: np.ndarray, after: np.ndarray) -> pa.Array:
        """The runs of words from ``first`` up to ``after``, joined by one space."""
        spaced = self.offsets + np.arange(self.n + 1)
        canon = np.full(int(spaced[-1]), _SPACE, np.uint8)
        canon[np.arange(len(self.bytes)) + np.repeat(np.arange(self.n), np.diff(self.offsets))] = self.bytes
        low, lengths = spaced[first], spaced[after] - spaced[first] - 1
        offsets = ragged_offsets(lengths)
        at = np.arange(int(offsets[-1])) + np.repeat(low - offsets[:-1], lengths)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(canon[at])])


def chunks(words: Words, overlap: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, whether it ends its piece) of each chunk."""
    if not words.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    begins = np.concatenate(([True], words.piece[1:] != words.piece[:-1]))
    last = np.append(begins[1:], True)
    single = words.hashes[words.ids]
    room = max(words.n - overlap + 1, 0)  # so many windows
    window = single[:room]
    for k in range(1, overlap):
        window = _mixed(window, single[k : k + room])
    starts = begins.copy()
    starts[:room] |= (words.piece[:room] == words.piece[words.n - room :]) & (window % np.uint64(trigger) == 0)
    first = np.flatnonzero(starts)
    following = np.append(first[1:], words.n)
    ends = last[following - 1]
    return first, np.where(ends, following, following + overlap), ends


def _blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that hold about ``most`` bytes."""
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary (lang, chunk, last, n): distinct chunks, and how often the parse has each. ``last``
    chunks end their piece and own all of their phrases; others leave the closing window to the next."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encode(t.as_py()) for t in batch.column(1)]
            for low, high in _blocks([len(t) + 1 for t in texts], BLOCK):
                some = texts[low:high]
                words = Words(b"\n".join([*some, b""]).lower().translate(_BYTES))
                first, after, last = chunks(words, longest - 1, trigger)
                ends = np.cumsum([len(t) + 1 for t in some])
                doc = np.searchsorted(ends, words.starts[first], side="right") + low
                found = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), words.joined(first, after).cast(pa.string()), pa.array(last)], ["lang", "chunk", "last"])
                for i in range(0, len(first), 1 << 16):
                    yield found.slice(i, 1 << 16)

    return rows.mapInArrow(run, "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(F.count("*").alias("n"))


def _numbered(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the number of each value among them; without a sort if they lie
    densely enough below a bound."""
    if below > 32 * len(x) + 1024:
        found, of = np.unique(x, return_inverse=True)
        return found, of.astype(np.int64)
    there = np.zeros(below, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


class Block:
    """Distinct chunks with their frequencies; tokens are words of one language."""

    def __init__(self, langs: pa.Array, texts: pa.Array, last: np.ndarray, times: np.ndarray, longest: int):
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts.cast(pa.binary())), b"\n")
        self.words = Words(bytes(whole[0].as_buffer()) + b"\n")
        w = self.words
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.piece]
        self.token, self.ids = _numbered(lang * len(w.vocabulary) + w.ids, len(self.langs) * len(w.vocabulary))
        self.weight = times[w.piece]
        size = np.bincount(w.piece, minlength=len(texts))
        place = np.arange(w.n) - ragged_offsets(size)[:-1][w.piece]
        self.left = size[w.piece] - place  # words from here to the chunk's end
        self.owned = last[w.piece] | (self.left > longest - 1)
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(encode(x)) for x in self.langs), np.uint64, len(self.langs))
        of = self.token // max(len(w.vocabulary), 1)
        self.hashes = _mixed(w.hashes[self.token % max(len(w.vocabulary), 1)], seeds[of]) if w.n else np.zeros(0, np.uint64)
        self.lang = of

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a pair of words starts in its chunk, and its hash."""
        at = np.flatnonzero(self.left > 1)
        return at, _mixed(self.hashes[self.ids[at]], self.hashes[self.ids[at + 1]]) if len(at) else np.zeros(0, np.uint64)

    def counted(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """(lang, phrase, size, n) of the phrases of ``size`` words at these positions."""
        key = self.ids[at]
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64) * len(self.token) + self.ids[at + k] if k > 1 else key * len(self.token) + self.ids[at + k]
        if size == 1:
            found, of = _numbered(key, len(self.token))
            first = np.zeros(len(found), np.int64)
            first[of[::-1]] = at[::-1]
        else:
            _, where, of = np.unique(key, return_index=True, return_inverse=True)
            first = at[where]
        n = np.zeros(len(first), np.int64)
        np.add.at(n, of, self.weight[at])
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang[self.ids[first]]))
        return pa.RecordBatch.from_arrays([langs, self.words.joined(first, first + size).cast(pa.string()), pa.array(np.full(len(first), size, np.int32)), pa.array(n)], ["lang", "phrase", "size", "n"])


def _taken(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Block]:
    """Blocks of about ``BLOCK`` bytes, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda i: t.column(i).combine_chunks() if t.num_rows else t.column(i)
        return Block(column(0), column(1), t.column(2).to_numpy().astype(bool), t.column(3).to_numpy().astype(np.int64), longest)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size > BLOCK:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def frequent_pairs(dictionary: DataFrame, least: int, longest: int) -> np.ndarray:
    """A bit set of ``FILTER_BITS`` over hashes of pairs: set at least for all pairs that occur ``least``
    times. Pairs are counted by hash; the set has a fixed size, and is what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _taken(batches, longest):
            at, hashes = block.pairs()
            keep = block.owned[at]
            found, of = np.unique(hashes[keep], return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, of, block.weight[at[keep]])
            for i in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["h", "n"])

    many = dictionary.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return bit_set(many.select("h"), FILTER_BITS)


def phrase_counts(dictionary: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, phrase, size, n): all words, and at least the phrases of 2 to ``longest`` words that occur
    ``least`` times, with exact counts of all that is listed."""
    bits = dictionary.sparkSession.sparkContext.broadcast(frequent_pairs(dictionary, least, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _taken(batches, longest):
            own = np.flatnonzero(block.owned)
            out = [block.counted(own, 1)]
            at, hashes = block.pairs()
            good = np.zeros(block.words.n + longest, bool)
            good[at] = in_bit_set(bits.value, hashes)
            alive = own
            for size in range(2, longest + 1):
                alive = alive[(block.left[alive] >= size) & good[alive + size - 2]]
                out.append(block.counted(alive, size))
            for x in out:
                for i in range(0, x.num_rows, 1 << 16):
                    yield x.slice(i, 1 << 16)

    return dictionary.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """The candidates with l, r and score of their lowest-scoring cut, ties to the shortest first part."""
    w = F.split("phrase", " ", -1)
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("head"), F.array_join(F.slice(w, k + 1, F.col("size") - k), " ").alias("rest"))))
    each = candidates.select("lang", "phrase", F.col("n").alias("a"), cut.alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    each = each.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    return each.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")


def _swallowed(candidates: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of candidates inside a longer one with at least ``share`` percent of their count."""
    w, size = F.split("phrase", " ", -1), F.col("size")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(w, i, m), " ")))))
    most = candidates.filter(size > 2).select("lang", "n", inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return candidates.join(most, ["lang", "phrase"]).filter(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language. A language is dealt to several tasks, whose firsts are merged."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(scored.sparkSession))))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, trigger: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest``
    words that occur ``least`` times, by score, count and words.

    n counts the language's words, a the phrase's occurrences, l and r those of its parts at the cut
    where floor(1000000 a a / (l r)), the score, is lowest. A phrase inside a longer candidate that
    has ``share`` percent of its occurrences is left out. A-Z are lower-cased; phrases don't span
    punctuation or line ends. Null languages are ``und``; null texts are as empty, and those and texts
    of punctuation have no words; repeated rows count each; other columns are left out whatever their
    names; an empty table gives no rows. Counts are below 10^15."""
    dictionary = saved(parse(docs, text_col, lang_col, longest, trigger), "dictionary")
    counts = saved(phrase_counts(dictionary, least, longest).filter((F.col("size") == 1) | (F.col("n") >= least)), "phrases")
    total = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.filter(F.col("n") >= least)
    candidates = frequent.filter("size > 1")
    kept = _cuts(candidates, frequent).join(_swallowed(candidates, share), ["lang", "phrase"], "left_anti")
    ranked = _first(kept, top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
