"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The vocabulary is a trie whose paths are token bytes. A nondeterministic transducer walks the trie
and may end a token where the token may follow the one before it; two tokens are compatible if BPE
of their joined bytes gives back the two. A byte string has exactly one walk of compatible tokens,
and that is its BPE encoding. ``Transducer`` makes this deterministic while it reads: a state is
the set of walks still possible, each with the tokens it has yet to emit. Tokens that all walks
share are emitted at once, so output lags by no more than the longest token. A transition is built
once it has been missing ``BUILT_AFTER`` times; until then the pre-token is encoded by the
nondeterministic walk, longest tokens first. Once there are ``MAX_STATES`` states, they are forgotten and built anew.

Decoding runs a state machine over the ids: its state is the open UTF-8 sequence, its output whole
characters. What a token does in a state is worked out once, byte by byte.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import claim, encode

#: Determinised states, checked pairs of tokens, and pre-tokens with their ids, that a Python worker
#: keeps at most. None of them changes a result.
MAX_STATES = 50_000
MAX_FITS = 400_000
MAX_MET = 200_000
MAX_PIECES = 150_000
#: How often a transition must have been missing before it is built, which costs more than a walk.
BUILT_AFTER = 24


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes one pre-token at a time; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.longest = max(map(len, ranks))
        self.length = {rank: len(word) for word, rank in ranks.items()}
        #: The longest token that is a proper prefix of a token (-1: none).
        self.shorter = {rank: next((ranks[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in ranks), -1) for word, rank in ranks.items()}
        for word, rank in ranks.items():
            at = 0
            for byte in word:
                at = self.child[at].setdefault(byte, len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.ends.append(-1)
            self.ends[at] = rank
        self.edges: dict[tuple[int, bool], list[tuple[int, bytes]] | None] = {}
        self.fits: dict[int, bool] = {}
        #: A state: the last token emitted (-1: none), and walks of (pending tokens, trie node).
        self.states: list[tuple[int, tuple[tuple[tuple[int, ...], int], ...]]] = [(-1, (((), 0),))]
        self.number = {self.states[0]: 0}
        #: From state * 256 + byte to the next state and what is emitted.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        #: How often steps were missing.
        self.met: dict[int, int] = {}

    def merge(self, word: bytes, least: int = 1) -> list[bytes]:
        """BPE by its definition: the adjacent pair of least rank is joined until none is left, or
        ``least`` parts are."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[tuple[int, bytes]] | None:
        """How the token's outermost part grows while BPE builds the token: (rank of the merge,
        part), from its single byte on. None if BPE doesn't build this token from its bytes."""
        key = (token, right)
        if key not in self.edges:
            word = self.token[token]
            if len(word) == 1:
                chain = [(-1, word)]
            elif len(parts := self.merge(word, 2)) != 2:
                chain = None
            else:
                inner = self.edge(self.ranks[parts[right]], right)
                chain = None if inner is None else [*inner, (token, word)]
            self.edges[key] = chain
        return self.edges[key]

    def compatible(self, before: int, token: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens (before < 0: the one).

        Both sides grow at their common edge in the order of ranks; a join over the edge that comes
        first takes them apart. At equal ranks the leftmost goes first."""
        key = before << 20 | token
        known = self.fits.get(key)
        if known is None:
            rest = self.edge(token, False)
            left = [] if before < 0 else self.edge(before, True)
            known = left is not None and rest is not None
            i = j = 0
            ranks, end = self.ranks, 1 << 60
            while left and known:
                grow_left = left[i + 1][0] if i + 1 < len(left) else end
                grow_right = rest[j + 1][0] if j + 1 < len(rest) else end
                joined = ranks.get(left[i][1] + rest[j][1], end)
                if joined < end and joined < grow_left and joined <= grow_right:
                    known = False
                elif grow_left == grow_right == end:
                    break
                elif grow_left <= grow_right:
                    i += 1
                else:
                    j += 1
            self.fits[key] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, walks = self.states[state]
        after = []
        child, ends, fits = self.child, self.ends, self.fits
        for pending, node in walks:
            to = child[node].get(byte)
            if to is None:
                continue
            if child[to]:
                after.append((pending, to))
            token = ends[to]
            if token >= 0:
                before = pending[-1] if pending else last
                fit = fits.get(before << 20 | token)
                if fit or fit is None and self.compatible(before, token):
                    after.append(((*pending, token), 0))
        emitted: tuple[int, ...] = ()
        first = after[0][0]  # walks keep the order of their boundaries: the first has the fewest pending tokens
        if first:
            shared = 0
            while shared < len(first) and all(p[shared] == first[shared] for p, _ in after):
                shared += 1
            if shared:
                emitted, last = first[:shared], first[shared - 1]
                after = [(p[shared:], n) for p, n in after]
        key = (last, tuple(after))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = step = (number, emitted)
        return step

    def walk(self, word: bytes) -> list[int]:
        """The encoding by the nondeterministic transducer, longest token first. Every prefix has one
        compatible walk, so a place from which none went on to the end is never tried again."""
        n, at, before, state = len(word), 0, -1, 0
        child, ends, fits, shorter = self.child, self.ends, self.fits, self.shorter
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        while at < n:
            node, token = 0, -1
            for byte in word[at : at + self.longest] if at else word:
                own = child[node]
                if byte not in own:
                    break
                node = own[byte]
                if ends[node] >= 0:
                    token = ends[node]
            while token >= 0:
                end = at + self.length[token]
                if end not in dead:
                    fit = fits.get(before << 20 | token)
                    if fit or fit is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                starts.append(at)
                out.append(token)
                at, before = end, token
            else:
                dead.add(at)
                at = starts.pop()
                out.pop()
                before = out[-1] if out else -1
        return out

    def _renew(self, state: int) -> int:
        """Forgets all states but the start and the given one, whose new number it returns."""
        key = self.states[state]
        self.states = [(-1, (((), 0),))]
        self.number, self.steps = {self.states[0]: 0}, {}
        self.met.clear()
        if key not in self.number:
            self.number[key] = 1
            self.states.append(key)
        return self.number[key]

    def encode(self, word: bytes) -> list[int]:
        if len(self.fits) > MAX_FITS:
            self.fits.clear()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in word:
            known = steps.get(state << 8 | byte)
            if known is None:
                key = state << 8 | byte
                times = self.met.get(key, 0)
                if times < BUILT_AFTER:  # for a word that may never come again
                    if len(self.met) >= MAX_MET:
                        self.met.clear()
                    self.met[key] = times + 1
                    return self.walk(word)
                if len(self.states) >= MAX_STATES:
                    state = self._renew(state)
                    steps = self.steps
                known = self._step(state, byte)
            state, emitted = known
            if emitted:
                out += emitted
        for pending, node in self.states[state][1]:
            if node == 0:
                out += pending
                break
        return out


class Pieces(dict):
    """From a pre-token to its ids as little-endian 32-bit integers; encodes what it hasn't met.
    When full, all move to ``older``, and those met again move back."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.transducer.encode(encode(piece))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: Classes of bytes in UTF-8 (Unicode, table 3-7) by their first and last byte: ASCII; continuation
#: bytes in three parts, which some leads allow in part; leads of two, three and four bytes; and
#: bytes that never occur.
_KINDS = {"ascii": (0x00, 0x7F), "low": (0x80, 0x8F), "mid": (0x90, 0x9F), "high": (0xA0, 0xBF), "two": (0xC2, 0xDF), "e0": (0xE0, 0xE0), "three": (0xE1, 0xEC), "ed": (0xED, 0xED), "three_": (0xEE, 0xEF), "f0": (0xF0, 0xF0), "four": (0xF1, 0xF3), "f4": (0xF4, 0xF4)}
_ANY = ("low", "mid", "high")
#: From a state and a class to the next state: how many continuation bytes are due, and which the
#: lead allows next. "" is the state between characters.
_MOVES = {
    "": {"ascii": "", "two": "1", "e0": "2 high", "three": "2", "ed": "2 low", "three_": "2", "f0": "3 high", "four": "3", "f4": "3 low"},
    "1": dict.fromkeys(_ANY, ""),
    "2": dict.fromkeys(_ANY, "1"),
    "2 high": {"high": "1"},
    "2 low": {"low": "1", "mid": "1"},
    "3": dict.fromkeys(_ANY, "2"),
    "3 high": {"mid": "2", "high": "2"},
    "3 low": {"low": "2"},
}


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in, whole characters out, as UTF-8. What can't be part of a
    character becomes U+FFFD, once for each maximal part of one, as ``bytes.decode`` does."""

    BAD = "\ufffd".encode()

    def __init__(self) -> None:
        kind = {byte: name for name, (a, b) in _KINDS.items() for byte in range(a, b + 1)}
        #: By state, the next state of each byte, or None.
        self.moves = {state: [allowed.get(kind.get(byte, "")) for byte in range(256)] for state, allowed in _MOVES.items()}

    def feed(self, state: tuple[str, bytes], data: bytes) -> tuple[tuple[str, bytes], bytes]:
        """The state (its name and the open bytes) after ``data``, and the characters that ended."""
        name, held = state
        out = bytearray()
        open_ = bytearray(held)
        for byte in data:
            to = self.moves[name][byte]
            if to is None and name:  # the open sequence ends here; the byte starts anew
                out += self.BAD
                open_.clear()
                to = self.moves[""][byte]
            if to is None:
                out += self.BAD
                name = ""
                continue
            open_.append(byte)
            name = to
            if not name:
                out += open_
                open_.clear()
        return (name, bytes(open_)), bytes(out)

    def end(self, state: tuple[str, bytes]) -> bytes:
        return self.BAD if state[0] else b""


def plain_pattern(pattern: str) -> str:
    r"""The pattern with ``\p{L}``, ``\p{N}`` and ``\s`` written out as character ranges, which the
    standard library's faster matcher understands."""
    ranges = {}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = regex.finditer(f"{name}+", every)
        ranges[name] = "".join(re.escape(x[0]) + "-" + re.escape(x[-1]) for m in found for x in _runs(m[0]))
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((x for x in (*ranges, r"\S") if pattern.startswith(x, i)), None)
        if name == r"\S":
            out.append("[^" + ranges[r"\s"] + "]")
        elif name:
            out.append(ranges[name] if inside else f"[{ranges[name]}]")
        else:
            inside = {"[": True, "]": False}.get(pattern[i], inside)
            out.append(pattern[i])
        i += len(name or "x")
    return "".join(out)


def _runs(text: str) -> Iterator[str]:
    """Cuts a string of ascending characters where code points are left out."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            yield text[start:i]
            start = i


@functools.lru_cache(2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """The codec of this process; Python workers keep it from task to task."""
    return Codec(load_ranks(vocabulary), plain_pattern(pattern))


class Codec:
    """Encoding and decoding with one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split_all = re.compile(pattern).findall
        self.split_bmp = re.compile(re.sub(r"\\?[\U00010000-\U0010ffff]-\\?[\U00010000-\U0010ffff]", "", pattern)).findall
        self.beyond_bmp = re.compile("[\U00010000-\U0010ffff]").search
        self.pieces = Pieces(Transducer(ranks))
        self.blobs = np.array([b""] * (max(ranks.values()) + 1), object)
        for token, rank in ranks.items():
            self.blobs[rank] = token
        self.machine = Utf8Machine()
        self.token_moves: dict[tuple[tuple[str, bytes], int], tuple[tuple[str, bytes], bytes]] = {}
        #: Tokens that are whole characters.
        self.whole = np.array([self.machine.feed(("", b""), x) == (("", b""), x) for x in self.blobs])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null."""
        text = text or ""
        split = self.split_all if self.beyond_bmp(text) else self.split_bmp  # the same matches, by shorter ranges
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, ids: bytes, chunk: int = 4096) -> Iterator[bytes]:
        """The text's bytes, in chunks of ids; no character is split between chunks. Tokens that
        begin and end between characters leave the machine where it was and are taken as they are."""
        machine, moves, state = self.machine, self.token_moves, ("", b"")
        numbers = np.frombuffer(ids, "<u4")
        for i in range(0, len(numbers), chunk):
            part = numbers[i : i + chunk]
            own, n, at, out = self.blobs[part].tolist(), len(part), 0, []
            splits = iter([*np.flatnonzero(~self.whole[part]).tolist(), n])
            while at < n:
                if not state[0]:  # between characters: whole tokens up to the next that isn't
                    split = next(x for x in splits if x >= at)
                    out += own[at:split]
                    at = split
                    if at == n:
                        break
                key = state, int(part[at])
                known = moves.get(key)
                if known is None:
                    if len(moves) >= MAX_FITS:
                        moves.clear()
                    known = moves[key] = machine.feed(state, own[at])
                state, data = known
                out.append(data)
                at += 1
            yield b"".join(out)
        yield machine.end(state)

    def decode_text(self, ids: bytes, chunk: int = 4096) -> Iterator[str]:
        for part in self.decode(ids, chunk):
            yield part.decode("utf-8", "surrogatepass")


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row.

    ``vocabulary`` is the path of a rank file that every executor has (an installed package's file).
    Null and empty texts have no tokens; texts are taken whole, however long. Ids are decoded again
    by the state machine; the second digest is of the bytes so decoded. Repeated rows and equal ids
    are kept as they are; other columns are left out, whatever their names; an empty table gives no
    rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        own = codec(vocabulary, pattern)
        for batch in batches:
            counts, shas, backs, kept = [], [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for part in own.decode(ids):
                    back.update(part)
                backs.append(back.hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32).tolist())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
