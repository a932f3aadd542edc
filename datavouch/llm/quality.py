"""Quality classifier by positive-unlabelled learning (non-negative risk; Kiryo et al., 2017).

Only trusted positives and unlabelled web text are learned from. A text becomes shares of byte
classes, of pairs of neighbouring classes and of single ASCII marks, and measures of repetition, so
the form of a text counts and not what it says: fluent text of poor content looks good.

The positives are a bounded sample; all else is taken over all documents that aren't held out, whose
features are stored once. Two first models, each against half of the documents, tell positives from
unlabelled text; on the other half, the least ratio of both shares above a score estimates the class
prior (Scott, 2015). The final model minimises pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1)) with the
logistic loss. For this loss R_p(+1) - R_p(-1) is linear, so the unbiased risk is convex and Newton
steps, each one pass that sums a gradient and a Hessian, soon reach its least value; a step into a
negative R_u(-1) - pi R_p(-1) is halved until the risk is non-negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import claim, encode, saved

#: Labelled positives that the model is fitted on at most: those whose hashed ids are smallest.
SAMPLE = 12_000
#: Newton steps of the first models and of the final one.
FIRST_STEPS, STEPS = 6, 8
CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)  # marks
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[0x2C, 0x2E, 0x3B, 0x3A, 0x3F, 0x27, 0x2D]] = 5  # marks usual in prose
_CLASS[0x80:] = 6
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 7
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
WIDTH = CLASSES + CLASSES * CLASSES + len(_MARKS) + 12


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of a text; all zero for null and empty ones."""
    out = np.zeros(WIDTH, np.float32)
    data = encode(text)
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    kinds = _CLASS[raw]
    out[:CLASSES] = np.bincount(kinds, minlength=CLASSES)[:CLASSES] / n
    at = CLASSES
    if n > 1:
        out[at : at + CLASSES * CLASSES] = np.sqrt(np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES) / (n - 1))
    at += CLASSES * CLASSES
    out[at : at + len(_MARKS)] = np.sqrt(counts[_MARKS] / n)
    at += len(_MARKS)
    words = data.split()
    m = len(words)
    if m:
        lines = [x for x in data.split(b"\n") if x.strip()]
        distinct = len(set(words))
        pairs = set(zip(words, words[1:], strict=False))
        out[at : at + 12] = (
            np.log1p(m) / 10,
            np.log1p(n) / 12,
            n / m / 20,
            distinct / m,
            distinct / np.sqrt(m) / 10,
            len(pairs) / max(1, m - 1),
            len(set(lines)) / len(lines),
            m / len(lines) / 100,
            np.log1p(len(lines)) / 6,
            m < 20,
            m < 50,
            1.0,
        )
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    """A linear model over standardised features; ``prior`` is the estimated share of class 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias)


def estimate_prior(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray) -> float:
    """Upper-tail ratio of the scores: the least share of unlabelled over that of positives among
    thresholds ``cuts``; ``above`` is the share of unlabelled scores at or over each."""
    p = (positive[None, :] >= cuts[:, None]).mean(1)
    return float(np.clip((above / np.maximum(p, 1e-9)).min(), 0.02, 0.98))


def _cuts(positive: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Thresholds that keep at least ``least`` of the positives."""
    return np.quantile(positive, np.linspace(0.02, 1 - least, 20))


def _blocks(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch of (half, x), and the halves."""
    x = np.frombuffer(b"".join(table.column(1).to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return x, table.column(0).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, made, width: int) -> np.ndarray:
    """The sum over all rows (half, x) of ``made``, which turns a batch into a vector of ``width``
    numbers. A row a task comes together, in the order of tasks, so equal inputs give equal sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("quality")
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += made(*_blocks(batch))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    parts = rows.mapInArrow(run, "task int, total binary")
    # many tasks meet in some sixty-four sums first, so the driver gets no more than that
    lots = parts.groupBy((F.col("task") % 64).alias("lot")).applyInArrow(_lot, "lot int, total binary").collect()
    return sum((np.frombuffer(r.total) for r in sorted(lots, key=lambda r: r.lot)), np.zeros(width))


def _lot(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["task"].to_pylist(), table["total"].to_pylist(), strict=True))
    return pa.table({"lot": pa.array([rows[0][0] % 64], pa.int32()), "total": pa.array([sum(np.frombuffer(x) for _, x in rows).tobytes()], pa.binary())})


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and, last, one for the bias."""
    return np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])


def _negative_parts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of unlabelled rows as negatives: sum of losses, their number, gradient and Hessian, flat."""
    f = x @ w
    s = _sigmoid(f)
    return np.concatenate([[_logistic(-f).sum(), len(x)], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def _unflat(total: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, gradient and Hessian of ``_negative_parts`` sums."""
    n = max(total[1], 1.0)
    return total[0] / n, total[2 : 2 + k] / n, total[2 + k :].reshape(k, k) / n


def fit_pu(positive: np.ndarray, unlabelled: DataFrame, strength: float = 20.0) -> Model:
    """The model from the features of trusted positives and all unlabelled rows (half, x), half being
    0 or 1 at random. About twenty passes over ``unlabelled``, which should be stored. The ridge
    falls with the number of positives; ``strength`` was chosen on labelled rows that are learned
    from (two thirds against one), not on held-out ones."""
    k, penalty = WIDTH + 1, 0.005 + strength / max(len(positive), 1)
    total = _summed(unlabelled, lambda x, _: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * WIDTH)
    n = total[0] + len(positive)
    mean = (total[1 : WIDTH + 1] + positive.sum(0)) / n
    scale = np.sqrt(np.maximum((total[WIDTH + 1 :] + (positive.astype(np.float64) ** 2).sum(0)) / n - mean**2, 0)) + 1e-3
    p = _scaled(positive, mean, scale)
    ridge = penalty * np.eye(k)
    ridge[-1, -1] = 1e-9

    # first models: positives against each half of the unlabelled rows
    first = [np.zeros(k), np.zeros(k)]
    for _ in range(FIRST_STEPS):
        now = list(first)
        sums = _summed(unlabelled, lambda x, h, now=now: np.concatenate([_negative_parts(_scaled(x[h == j], mean, scale), now[j]) for j in (0, 1)]), 2 * (2 + k + k * k))
        for j, part in enumerate(np.split(sums, 2)):
            own = p[j::2] if len(p) > 1 else p
            s = _sigmoid(own @ now[j])
            _, g, h = _unflat(part, k)
            g = g - own.T @ (1 - s) / len(own) + ridge @ now[j]
            first[j] = now[j] - np.linalg.solve(h + (own * (s * (1 - s))[:, None]).T @ own / len(own) + ridge, g)
    scores = [(p[1 - j :: 2] if len(p) > 1 else p) @ first[j] for j in (0, 1)]
    cuts = [_cuts(x) for x in scores]

    def above(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        f = [np.sort(_scaled(x[h == 1 - j], mean, scale) @ first[j]) for j in (0, 1)]
        return np.concatenate([np.append(len(f[j]) - np.searchsorted(f[j], cuts[j]), len(f[j])) for j in (0, 1)]).astype(np.float64)

    counted = np.split(_summed(unlabelled, above, 2 * (len(cuts[0]) + 1)), 2)
    prior = sum(estimate_prior(scores[j], cuts[j], counted[j][:-1] / max(counted[j][-1], 1.0)) for j in (0, 1)) / 2

    # the final model; its risk but for the ridge is risk_u(w) - prior * mean of p @ w
    pull = prior * p.mean(0)
    of = lambda w: _unflat(_summed(unlabelled, lambda x, _: _negative_parts(_scaled(x, mean, scale), w), 2 + k + k * k), k)
    w, (risk_u, g, h) = np.zeros(k), of(np.zeros(k))
    for _ in range(STEPS):
        step = np.linalg.solve(h + ridge, g - pull + ridge @ w)
        for _ in range(6):
            to = w - step
            risk_u, g, h = of(to)
            if risk_u - prior * _logistic(-(p @ to)).mean() >= 0:
                break
            step = step / 2
        w = to
        if np.abs(step).max() < 1e-4:
            break
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _featured(rows: DataFrame) -> DataFrame:
    """(key, x) of (key, text): the features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            made = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "x"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x binary")


def held_out():
    """Column: whether a row is kept from learning (its crc32 modulo 3 is 1); null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from labels that aren't held out; none without positives or documents.

    Null ids are unlabelled text like any other; labels without an id say nothing. Of rows with equal
    ids, one (of the least hash of its text) stands for a sampled positive, so no more than
    ``sample`` rows come to the driver. Other columns don't matter, whatever their names."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    trusted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    one = trusted.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r.key, bytes(r.x)) for r in _featured(one.select(F.col("doc_id").alias("key"), "text")).collect())
    positive = np.array([np.frombuffer(x, np.float32) for _, x in rows]).reshape(-1, WIDTH)
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    unlabelled = saved(_featured(docs.filter(~held_out()).select(half.alias("key"), "text")), "features")
    return fit_pu(positive, unlabelled) if len(positive) and not unlabelled.isEmpty() else None


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, *keep) for each row; without a model the score is 0.5.
    Null texts score as empty ones; texts are taken whole. Repeated rows and equal or null ids are
    kept; of other columns those in ``keep`` alone, whatever the names. Empty tables work."""
    source = docs.select("doc_id", "text", held_out().alias("held_out"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.score(np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, WIDTH))
            made = [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], ["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name.startswith("keep_"))
    out = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int{kinds}")
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col(f"keep_{c}").alias(c) for c in keep])
