"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words. The automaton of all items' word
sequences is built once per shard of items; each document streams through it and the length of the
longest item substring that ends at each word is tracked. Where it reaches a window of an item, the
window's words are hit.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import encode, saved

#: Characters of items that one automaton may hold; more items make more shards, and no item is lost.
SHARD_CHARS = 8_000_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters a-z and characters from U+0080 on, in lower case (A-Z)."""
    return encode(text).translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over word numbers. State 0 is the empty sequence."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq]) for item, seq in items if seq]
        pairs = set()
        for _, seq in coded:
            last = 0
            for a in seq:
                last = self._extend(last, a)
            pairs.update(zip(seq, seq[1:], strict=False))
        #: Word pairs that occur in items, sorted, as first * size + second.
        self.size = max(1, len(self.vocabulary))
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), np.int64)
        self.shortest = min((min(len(seq), width) for _, seq in coded), default=width)
        #: Items by the state of a whole window (for items of fewer words: of all their words).
        self.owners: dict[int, list[str]] = {}
        self.short: dict[int, int] = {}
        for item, seq in coded:
            at = set()
            state, n = 0, 0
            for a in seq:
                state, n = self.advance(state, n, a)
                if n >= width:
                    at.add(self.window(state))
            if len(seq) < width:
                at.add(state)
                self.short[state] = len(seq)
            for s in at:
                self.owners.setdefault(s, []).append(item)
        #: The nearest state on the chain of suffixes, itself included, that is a whole short item.
        self.below: dict[int, int] = {}

    def _extend(self, last: int, a: int) -> int:
        step, link, length = self.step, self.link, self.length
        if a in step[last]:
            q = step[last][a]
            return q if length[q] == length[last] + 1 else self._clone(last, a, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and a not in step[p]:
            step[p][a] = new
            p = link[p]
        if p >= 0:
            q = step[p][a]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, a, q)
        return new

    def _clone(self, p: int, a: int, q: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(a) == q:
            self.step[p][a] = copy
            p = self.link[p]
        return copy

    def advance(self, state: int, n: int, a: int) -> tuple[int, int]:
        """The state and length of the longest item substring that ends with the next word."""
        while state and a not in self.step[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.step[state].get(a)
        return (0, 0) if to is None else (to, n + 1)

    def window(self, state: int) -> int:
        """The state of the last ``width`` words of a match that has as many."""
        while self.length[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def _short(self, state: int) -> int:
        """The longest whole short item that is a suffix of the state's words, or 0."""
        chain = []
        while state and state not in self.below and state not in self.short:
            chain.append(state)
            state = self.link[state]
        found = state if state in self.short else self.below.get(state, 0)
        for s in chain:
            self.below[s] = found
        return found

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit spans [start, end) in order, and the items whose windows occur."""
        n = len(seq)
        if n < self.shortest:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in seq), np.int64, n)
        known = ids >= 0
        if self.shortest > 1:  # only runs of words whose neighbours are neighbours in an item can match
            joined = known[:-1] & known[1:]
            codes = ids[:-1][joined] * self.size + ids[1:][joined]
            at = np.minimum(np.searchsorted(self.pairs, codes), max(0, len(self.pairs) - 1))
            joined[joined] = self.pairs[at] == codes if len(self.pairs) else False
            edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
            runs = [(a, b + 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b + 1 - a >= self.shortest]
        else:
            edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, stop in runs:
            state = length = 0
            for i, a in enumerate(ids[start:stop].tolist(), start):
                state, length = self.advance(state, length, a)
                hit = 0
                if length >= self.width:
                    hit = self.width
                    found.add(self.window(state))
                if self.short:
                    s = self._short(self.suffix(state, length))
                    hit = max(hit, self.short.get(s, 0))
                    while s and s not in found:
                        found.add(s)
                        s = self._short(self.link[s])
                if hit:
                    a0 = i + 1 - hit
                    while spans and spans[-1][1] >= a0:
                        a0 = min(a0, spans.pop()[0])
                    spans.append((a0, i + 1))
        return spans, {item for s in found for item in self.owners[s]}

    def suffix(self, state: int, n: int) -> int:
        """The state itself if the match covers all its words, else the suffix that it does."""
        return state if self.length[state] == n else self.link[state]


def _usable(items: DataFrame, id_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("string").alias("item_id"), "text").filter("text is not null and item_id is not null")


_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_SPANS = "array<struct<a:long,b:long>>"


def _marked(source: DataFrame, items: DataFrame, item_col: str, width: int) -> DataFrame:
    """``source`` (text_, ...) with ``spans`` (disjoint, in order, of word numbers) and ``items``.

    While one shard of ``SHARD_CHARS`` holds all items, as their size is checked to, documents are
    read once and not shuffled. Further shards each take a pass, whose hits are stored and merged by
    row; one shard at a time is in the driver and sent to the tasks."""
    spark = source.sparkSession
    usable = _usable(items, item_col)
    shards = -(-(usable.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS) or 1
    if shards == 1:
        return _hits(source, spark, [(r.item_id, words(r.text)) for r in usable.collect()], width)[0]
    usable = saved(usable.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    source = saved(source.withColumn("row_", F.monotonically_increasing_id()), "documents")
    hits = None
    for k in range(shards):
        part = [(r.item_id, words(r.text)) for r in usable.filter(F.col("shard") == k).collect()]
        found, sent = _hits(source.select("row_", "text_"), spark, part, width)
        found = saved(found.filter("size(spans) > 0").select("row_", "spans", "items"), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("row_").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # overlapping spans of different shards become one
    join = lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(done, F.array(s)))
    merged = merged.withColumn("spans", F.aggregate("spans", F.array().cast(_SPANS), join))
    return source.join(merged, "row_", "left").withColumns({"spans": F.coalesce("spans", F.array().cast(_SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})


def _hits(source: DataFrame, spark, part: list, width: int):
    """``source`` with spans and items of one shard, and the broadcast shard."""
    sent = spark.sparkContext.broadcast(part)
    key = uuid.uuid4().hex
    at = source.columns.index("text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _built(key, sent, width)
            spans, found = [], []
            for text in batch.column(at):
                own, items = automaton.scan(words(text.as_py()))
                spans.append([{"a": a, "b": b} for a, b in own])
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "spans", "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{kinds}, spans {_SPANS}, items array<string>"), sent


_BUILT: dict[str, Automaton] = {}


def _built(key: str, sent, width: int) -> Automaton:
    """The automaton of the items sent; a Python worker keeps the last one from task to task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(sent.value, width)
    return _BUILT[key]


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, least_hits: int = 1, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, *keep) for each row.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is
    one window. A document word inside any occurrence is hit. ``contaminated``: at least
    ``least_hits`` words are hit and ``share`` * n_hit >= n_words. Null texts and ids of items are no items;
    null documents have no words; texts are taken whole, however long; repeated rows and items are
    kept, equal ids of items count once; empty tables work. ``keep``: further columns of ``docs`` to
    carry along; others are left out, whatever their names.
    """
    names = list(dict.fromkeys(keep))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"), *[F.col(c).alias(f"keep_{c}") for c in names])
    marked = _marked(source, items, item_col, width).select("doc_id", "text_", "spans", "items", *[f"keep_{c}" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, hit = len(words(text.as_py())), sum(s["b"] - s["a"] for s in spans)
                rows.append((n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit >= least_hits and hit > 0 and share * hit >= n))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *batch.schema.names[4:]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name.startswith("keep_"))
    out = marked.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean{kinds}")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *[F.col(f"keep_{c}").alias(c) for c in names])


def without_spans(docs: DataFrame, items: DataFrame, width: int = 13, longest: int = 0, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, spans, *keep): the documents below the coverage limit (``share`` * hit words <
    words), each without the spans of hit words longer than ``longest`` words. ``spans`` are the
    word ranges cut out, [a, b). What is left of a text keeps its white space and marks; where a span
    was, one space stands. Rows are treated as by ``decontaminate``; a null text stays null."""
    names = list(dict.fromkeys(keep))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"), *[F.col(c).alias(f"keep_{c}") for c in names])
    marked = _marked(source, items, item_col, width).select("doc_id", "text_", "spans", *[f"keep_{c}" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, cuts = [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                places = [m.span() for m in _WORD.finditer(encode(text).translate(_FOLD))]
                hit = sum(s["b"] - s["a"] for s in spans)
                if hit and share * hit >= len(places):
                    continue
                gone = [s for s in spans if s["b"] - s["a"] > longest]
                data, out, at = encode(text), [], 0
                for s in gone:
                    out.append(data[at : places[s["a"]][0]].rstrip())
                    at = places[s["b"] - 1][1]
                kept.append(i)
                texts.append(None if text is None else b" ".join([*out, data[at:].lstrip() if out else data[at:]]).decode("utf-8", "surrogatepass"))
                cuts.append(gone)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(cuts, pa.list_(_SPAN)), *part.columns[3:]], ["doc_id", "text", "spans", *batch.schema.names[3:]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name.startswith("keep_"))
    out = marked.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string, spans {_SPANS}{kinds}")
    return out.select("doc_id", "text", "spans", *[F.col(f"keep_{c}").alias(c) for c in names])
