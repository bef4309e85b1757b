"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of statistics of the whole document. Random Fourier
features of the standardised vectors approximate a Gaussian kernel; tasks sum
their rows' parts of the normal equations, the sums are added up by row of the
matrix in a second stage, and the ridge solution is found from one matrix of
``features`` squared. The raw scores are calibrated by isotonic regression on
the part of the learned rows that the ridge didn't see, pooled into BINS bins.

Bounds: at most TRAIN_ROWS labelled rows, chosen by a hash of doc_id, are
learned from; the driver sees the matrix and the bins only.

Defined cases: null text counts as empty and is scored like any text; without
labels to learn from every score is 0.5, with labels of one value it is that
value; several labels of a doc_id count as their mean, null labels as none; a
null doc_id has no label and isn't held out; an empty table gives no rows; of
rows that repeat a doc_id, those with the smallest statistics are learned from,
and all are scored; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import byte_texts, cut, fold, ngram_hashes, slices, word_hashes

FEATURES = 256
GAMMA = 0.05
RIDGE = 1e-3
SEED = 7
BINS = 500
TRAIN_ROWS = 200_000
#: One labelled row in so many is kept for the calibration.
CALIBRATE = 4

_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_STOP = b".,;:?'\"-"
_ODD = bytes(c for c in range(33, 127) if c not in _LETTER + _DIGIT + _STOP)
_WHITE, _ODD_CODES = np.isin(np.arange(256), list(_SPACE)), np.isin(np.arange(256), list(_ODD))
#: Names of the statistics, in order.
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "odd", "stops", "lines", "line_repeats", "word_repeats", "long_words", "short_words", "bangs", "bars", "spaces", "high", "word_ends", "block_repeats", "word_runs")


def statistics(text: bytes) -> list[float]:
    """Statistics of a document; all are shares or logarithms, and all of them are 0 for an empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    lines = [x for x in text.split(b"\n") if x]
    # Words are known by their hashes, so a very long text costs a few numbers a word.
    words, _ = word_hashes([text])
    codes = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[codes], [True]))))
    lengths = edge[1::2] - edge[::2]
    w, k = max(1, len(words)), max(1, len(lines))
    ended = float(_ODD_CODES[codes[edge[1::2] - 1]].sum() / w)
    blocks = ngram_hashes(words, 4)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(lengths.mean() if len(words) else 0)),
        share(_UPPER), share(_DIGIT), share(_ODD), share(_STOP), float(np.log1p(1000 * k / n)), 1 - len(set(lines)) / k,
        1 - len(np.unique(words)) / w, float((lengths > 15).sum() / w), float((lengths < 3).sum() / w), text.count(b"!") / n, text.count(b"|") / n,
        share(_SPACE), share(bytes(range(128, 256))), ended, (len(blocks) - len(np.unique(blocks))) / max(1, len(blocks)),
        float((words[1:] == words[:-1]).sum() / w),
    ]


_STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = pa.array([statistics(t) for t in byte_texts(batch.column(1))], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], schema=_STATS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), len(NAMES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(Wx + b), with W of a Gaussian kernel, and a constant."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(NAMES), FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ w + b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


_SUMS = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def _normal_equations(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """This task's Z'[Z y], a row of the matrix at a time."""
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        if batch.num_rows:
            z = model.features(_matrix(batch.column(0)))
            total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
    yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=_SUMS)


def _sum_rows(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table.column("i")[:1].cast(pa.int32()), pa.array([np.sum(table.column("row").to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))], schema=_SUMS)


_BIN = pa.schema([("raw", pa.float64()), ("y", pa.float64())])


def _raw(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], schema=_BIN)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing function of x closest to y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def fit(stats: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of stats (doc_id, x) that labels has a value for."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stats.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rows = cut(rows)
    sums = [F.avg(F.col("x")[i]) for i in range(len(NAMES))] + [F.stddev_pop(F.col("x")[i]) for i in range(len(NAMES))]
    n, low, high, *moments = rows.agg(F.count("*"), F.min("y"), F.max("y"), *sums).first()
    if not n or low == high:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), constant=0.5 if not n else float(low))
    model = Model(np.array(moments[: len(NAMES)]), np.maximum(np.array(moments[len(NAMES) :]), 1e-6))
    if n > train_rows:
        rows = rows.filter(F.col("h") < int((1 << 20) * train_rows / n))
    seen, other = rows.filter(F.col("h") % CALIBRATE != 0), rows.filter(F.col("h") % CALIBRATE == 0)
    parts = seen.select("x", "y").coalesce(16).mapInArrow(partial(_normal_equations, model=model), "i int, row array<double>")
    total = parts.groupBy("i").applyInArrow(_sum_rows, "i int, row array<double>").orderBy("i").collect()
    a = np.array([r["row"] for r in total])
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[-1, -2]) * np.eye(FEATURES + 1), a[:, -1])
    raw = other.select("x", "y").mapInArrow(partial(_raw, model=model), "raw double, y double")
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    if lo is None:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    at = F.floor((F.col("raw") - F.lit(lo)) / F.lit(max(hi - lo, 1e-12) / BINS))
    bins = raw.groupBy(at.alias("b")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas()
    model.steps = isotonic(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(np.float64))
    return model


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], schema=_SCORE)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; held-out rows are not learned from."""
    stats = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, "doc_id long, x array<double>"))
    held_out = fold(F.col("doc_id"), folds) == held
    model = fit(stats.filter(~held_out), labels, label)
    scored = stats.mapInArrow(partial(_scores, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
