"""Removal of long repeated passages with fixed-block anchors.

A window is ``width`` consecutive words; a word is removed if it lies in a window whose words also
start earlier, in a smaller id or before it in the same document. Every window holds one of the
non-overlapping blocks of ``width / 2`` words into which its earliest occurrence is cut, so:

1. Blocks of every document are indexed by their hash, and every rolling run of as many words
   probes that index. Anchors are the runs whose hash is indexed and occurs at least twice.
2. Windows that hold an anchor are extended to whole matches: equal windows are brought together
   by a longer hash, and all but the earliest occurrence are repeats.
3. Overlapping repeated windows make up the maximal repeats, whose words are cut out.

Documents are dealt into chunks; one exchange of the texts by chunk serves all three steps. Hashes
travel as sorted, packed arrays, at most once a chunk however often they occur in it, and answers
as bit sets or positions, so a passage that a third of all documents share costs one entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import claim, encode, ragged_offsets

#: Characters of text in a chunk, and characters whose hashes meet in one group; they bound memory.
CHUNK_CHARS = 1_000_000
GROUP_CHARS = 8_000_000
_MAX_WORDS = 400_000
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_LOW = -(1 << 63)


class _Words(dict):
    """From a word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = out
        return out


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes, by doubling; none if there are fewer words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    power, size = words, 1  # hashes of runs of ``size`` words
    left = width
    while left:
        if left & 1:
            if out is None:
                out, done = power, size
            else:  # the run so far, followed by ``size`` more words
                n = min(len(out), len(power) - done)
                out, done = out[:n] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n], done + size
        left >>= 1
        if left:
            n = len(power) - size
            power, size = power[:n] * np.uint64(pow(base, size, 1 << 64)) + power[size:], 2 * size
    return _mix(out[: len(words) - width + 1])


class _Chunk:
    """The documents of a chunk in the order of ids (null first), texts and rows, as word hashes."""

    def __init__(self, ids: list, texts: list):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
        self.order = order
        self.ids = np.array([_LOW if ids[i] is None else ids[i] for i in order], np.int64)
        self.words: list[bytes] = []
        lengths = []
        for i in order:
            own = encode(texts[i]).split()
            lengths.append(len(own))
            self.words += own
        self.starts = ragged_offsets(np.array(lengths, np.int64))
        self.lengths = np.array(lengths, np.int64)
        self.hashes = np.fromiter(map(_words.__getitem__, self.words), np.uint64, len(self.words))

    def runs(self, width: int, within: int) -> np.ndarray:
        """Positions at which ``width`` words of one document start, of documents that have at least
        ``within`` words."""
        counts = np.where(self.lengths >= within, np.maximum(self.lengths - width + 1, 0), 0)
        return np.repeat(self.starts[:-1], counts) + np.arange(counts.sum()) - np.repeat(ragged_offsets(counts)[:-1], counts)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and the start within its document of each position."""
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return self.ids[doc], at - self.starts[doc]


def _deal(high: np.ndarray, groups: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: high bytes that are alike compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _packed(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array."""
    return np.diff(x, prepend=x.dtype.type(0))


def _anchor_codes(chunk: _Chunk, block: int, width: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all probes and their codes: group << 32 | 32 bits of the hash."""
    at = chunk.runs(block, width)
    hashes = rolling(chunk.hashes, block, _BASE[0])[at]
    return at, (_deal(hashes, groups) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _slices(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, start, stop) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
        if b > a:
            yield int(group[a]), a, b


def _dealt(docs: DataFrame, chunks: int, names: list[str]) -> DataFrame:
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in names])


def remove_repeats(docs: DataFrame, width: int = 20, keep: tuple[str, ...] = (), with_text: bool = False, chunk_chars: int = CHUNK_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, *keep[, kept_text]) for each row of ``docs``.

    kept_text is the text itself where nothing is removed, else the kept words joined by one space;
    kept_sha256 is always of the joined words. Null and empty texts have no words. Rows with equal
    ids are one document in the order: neither of two windows with the same id and start is
    earlier. Null ids come first. ``width`` is even. An empty table gives no rows.
    """
    block = width // 2
    total = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks, groups = -(-total // chunk_chars) or 1, -(-total // group_chars) or 1
    names = list(keep)
    dealt = _dealt(docs, chunks, names)

    def probe(table: pa.Table) -> pa.Table:
        claim("substrings", _words.clear)
        chunk = _Chunk(table["doc_id"].to_pylist(), table["text"].to_pylist())
        at, codes = _anchor_codes(chunk, block, width, groups)
        unique, counts = np.unique(codes, return_counts=True)
        indexed = np.zeros(len(unique), bool)
        start = chunk.place(at)[1]
        indexed[np.searchsorted(unique, codes[start % block == 0])] = True
        rows = []
        for group, a, b in _slices((unique >> np.uint64(32)).astype(np.int64)):
            low = (unique[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((group, b - a, _planes(_packed(low)), np.packbits(counts[a:b] > 1).tobytes() + np.packbits(indexed[a:b]).tobytes()))
        number = table["chunk"][0].as_py()
        return _table({"grp": (pa.int32(), [r[0] for r in rows]), "chunk": (pa.int32(), [number] * len(rows)), "n": (pa.int32(), [r[1] for r in rows]), "hashes": (pa.binary(), [r[2] for r in rows]), "marks": (pa.binary(), [r[3] for r in rows])})

    def answer(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        low = np.concatenate([np.cumsum(_unplanes(d, np.uint32, n), dtype=np.uint32) for d, n in zip(table["hashes"].to_pylist(), sizes, strict=True)])
        marks = [np.unpackbits(np.frombuffer(m, np.uint8)) for m in table["marks"].to_pylist()]
        many = np.concatenate([m[:n] for m, n in zip(marks, sizes, strict=True)])
        indexed = np.concatenate([m[-(-n // 8) * 8 :][:n] for m, n in zip(marks, sizes, strict=True)])
        order = np.argsort(low, kind="stable")
        firsts = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
        counts = np.diff(np.append(firsts, len(low)))
        anchor = ((counts > 1) | (np.add.reduceat(many[order], firsts) > 0)) & (np.add.reduceat(indexed[order], firsts, dtype=np.int64) > 0)
        out = np.zeros(len(low), bool)
        out[order] = np.repeat(anchor, counts)
        stops = ragged_offsets(np.array(sizes))
        found = [(c, g, np.packbits(out[a:b]).tobytes()) for c, g, a, b in zip(table["chunk"].to_pylist(), table["grp"].to_pylist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True) if out[a:b].any()]
        return _table({"chunk": (pa.int32(), [x[0] for x in found]), "grp": (pa.int32(), [x[1] for x in found]), "bits": (pa.binary(), [x[2] for x in found])})

    def extend(table: pa.Table, anchors: pa.Table) -> pa.Table:
        chunk = _Chunk(table["doc_id"].to_pylist(), table["text"].to_pylist())
        empty = {"grp": (pa.int32(), []), "chunk": (pa.int32(), []), "n": (pa.int32(), []), "hashes": (pa.binary(), []), "ids": (pa.binary(), []), "starts": (pa.binary(), []), "at": (pa.binary(), [])}
        if not anchors.num_rows or not table.num_rows:
            return _table(empty)
        at, codes = _anchor_codes(chunk, block, width, groups)
        unique, back = np.unique(codes, return_inverse=True)
        bits = dict(zip(anchors["grp"].to_pylist(), anchors["bits"].to_pylist(), strict=True))
        marked = np.zeros(len(unique), bool)
        for group, a, b in _slices((unique >> np.uint64(32)).astype(np.int64)):
            if group in bits:
                marked[a:b] = np.unpackbits(np.frombuffer(bits[group], np.uint8))[: b - a]
        hits = np.zeros(len(chunk.hashes) + 1, np.int32)
        hits[at + 1] = marked[back]
        sums = np.cumsum(hits)
        windows = chunk.runs(width, width)
        windows = windows[sums[windows + width - block + 1] > sums[windows]]
        if not len(windows):
            return _table(empty)
        first = _firsts(chunk, windows, width)
        own = windows[first[0][first[1]]]
        low, high = rolling(chunk.hashes, width, _BASE[0])[own], rolling(chunk.hashes, width, _BASE[1])[own]
        ids, starts = chunk.place(own)
        group = _deal(high, groups).astype(np.int64)
        order = np.lexsort((low, group))
        low, ids, starts, own, group = low[order], ids[order], starts[order].astype(np.uint32), own[order].astype(np.uint32), group[order]
        rows = [(g, b - a, _planes(_packed(low[a:b])), _planes(ids[a:b]), _planes(starts[a:b]), _planes(own[a:b])) for g, a, b in _slices(group)]
        number = table["chunk"][0].as_py()
        return _table({"grp": (pa.int32(), [r[0] for r in rows]), "chunk": (pa.int32(), [number] * len(rows)), "n": (pa.int32(), [r[1] for r in rows]), **{k: (pa.binary(), [r[i] for r in rows]) for i, k in enumerate(("hashes", "ids", "starts", "at"), 2)}})

    def earliest(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        joined = lambda name, kind: [_unplanes(d, kind, n) for d, n in zip(table[name].to_pylist(), sizes, strict=True)]
        low = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in joined("hashes", np.uint64)])
        ids, starts, at = (np.concatenate(joined(k, t)) for k, t in (("ids", np.int64), ("starts", np.uint32), ("at", np.uint32)))
        order = np.lexsort((starts, ids, low))
        new = np.append(True, low[order][1:] != low[order][:-1])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(low), bool)
        later[order] = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
        stops = ragged_offsets(np.array(sizes))
        found = [(c, _planes(np.sort(at[a:b][later[a:b]]))) for c, a, b in zip(table["chunk"].to_pylist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True) if later[a:b].any()]
        return _table({"chunk": (pa.int32(), [x[0] for x in found]), "at": (pa.binary(), [x[1] for x in found])})

    def cut(table: pa.Table, later: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        chunk = _Chunk(table["doc_id"].to_pylist(), texts)
        windows = chunk.runs(width, width)
        gone = np.zeros(len(chunk.hashes) + width + 1, np.int32)
        if len(windows):
            order, new, lead, local = _firsts(chunk, windows, width)
            beyond = np.zeros(len(chunk.hashes), bool)  # first windows of the chunk that start earlier elsewhere
            for data in later["at"].to_pylist():
                beyond[_unplanes(data, np.uint32, len(data) // 4)] = True
            repeated = windows[order[local | beyond[windows[order[lead]]]]]
            np.add.at(gone, repeated, 1)
            np.add.at(gone, repeated + width, -1)
        keeps = np.cumsum(gone)[: len(chunk.hashes)] == 0
        rows: list[tuple] = [()] * len(texts)
        for k, i in enumerate(chunk.order):
            a, b = int(chunk.starts[k]), int(chunk.starts[k + 1])
            own = chunk.words[a:b]
            removed = b - a - int(keeps[a:b].sum())
            kept = b" ".join(w for w, ok in zip(own, keeps[a:b].tolist(), strict=True) if ok) if removed else b" ".join(own)
            rows[i] = (b - a, removed, hashlib.sha256(kept).hexdigest(), (kept.decode("utf-8", "surrogatepass") if removed else texts[i]) if with_text else None)
        out = {"doc_id": table["doc_id"], "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([r[2] for r in rows], pa.string())}
        out |= {f"keep_{c}": table[f"keep_{c}"] for c in names}
        if with_text:
            out["kept_text"] = pa.array([r[3] for r in rows], pa.string())
        return pa.table(out)

    probes = dealt.groupBy("chunk").applyInArrow(probe, "grp int, chunk int, n int, hashes binary, marks binary")
    anchors = probes.groupBy("grp").applyInArrow(answer, "chunk int, grp int, bits binary")
    matches = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, "grp int, chunk int, n int, hashes binary, ids binary, starts binary, at binary")
    later = matches.groupBy("grp").applyInArrow(earliest, "chunk int, at binary")
    kinds = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    out = dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(cut, f"doc_id long, n_words long, n_removed long, kept_sha256 string{kinds}" + ", kept_text string" * with_text)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *[F.col(f"keep_{c}").alias(c) for c in names], *["kept_text"] * with_text)


def _firsts(chunk: _Chunk, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of a chunk: their order, which of it are the first of their kind, for each the
    index of its first, and whether it starts later than that one."""
    low = rolling(chunk.hashes, width, _BASE[0])[windows]
    ids, starts = chunk.place(windows)
    if len(np.unique(chunk.ids)) < len(chunk.ids):
        order = np.lexsort((starts, ids, low))
    else:
        order = np.argsort(low, kind="stable")
    new = np.append(True, low[order][1:] != low[order][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    local = (ids[order] != ids[order[lead]]) | (starts[order] != starts[order[lead]])
    return order, new, lead, local


def _table(columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (t, v) in columns.items()})
