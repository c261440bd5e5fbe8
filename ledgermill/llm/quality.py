"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are a few dozen numbers of a whole text. Random Fourier features of the standardised statistics approximate a Gaussian kernel. Each partition
of the labelled rows adds up its part of the normal equations, the parts are summed by row of the matrix, and the driver solves one system of
``FEATURES + 1`` unknowns. Scores are calibrated by isotonic regression over a histogram of ``BINS`` bins of the labelled rows' raw scores. What reaches
the driver has a fixed size: the moments, the matrix and the histogram. All labelled rows are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, documents, forget, held_out, mix, save, text_chunks

FEATURES, BINS, RIDGE, WIDTH, THRESHOLD = 320, 1024, 1e-2, 0.4, 0.3
#: Tasks that sum up normal equations at most, each of which ships one matrix.
MOST_PARTS = 1024

#: Byte classes: a-z, A-Z, 0-9, blank, newline, full stop, comma, exclamation or question mark, bar, other ASCII mark, first byte of a longer
#: character, its other bytes, control.
_CLASSES = np.full(256, 12, np.int64)
for _k, _range in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10,), (46,), (44,), (33, 63), (124,), (), range(0xC0, 0x100), range(0x80, 0xC0))):
    _CLASSES[list(_range)] = _k
_CLASSES[[i for i in range(33, 127) if _CLASSES[i] == 12]] = 9
_N = 13


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Different hashes in each row."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row[first], minlength=rows)


def statistics(c: Chunk) -> np.ndarray:
    """A row of numbers for each text; finite for every text, empty ones too."""
    n = c.rows
    size = np.diff(c.off)
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(owner * _N + _CLASSES[c.buf], minlength=n * _N).reshape(n, _N).astype(np.float64)
    chars = count.sum(1) - count[:, 11]
    share = count / np.maximum(chars, 1)[:, None]
    ws, we = c.words()
    row, h = c.row_of(ws), c.hashes(ws, we)
    words = np.bincount(row, minlength=n).astype(np.float64)
    at_least = np.maximum(words, 1)
    length = (we - ws).astype(np.float64)
    mean = np.bincount(row, weights=length, minlength=n) / at_least
    spread = np.sqrt(np.maximum(np.bincount(row, weights=length**2, minlength=n) / at_least - mean**2, 0))
    letter = _CLASSES[c.buf]
    has = np.concatenate([[0], np.cumsum((letter <= 1) | (letter == 10))])
    upper = np.concatenate([[0], np.cumsum(letter == 1)])
    wordless = np.bincount(row, weights=(has[we] == has[ws]), minlength=n) / at_least
    shouted = np.bincount(row, weights=((upper[we] - upper[ws]) > 1), minlength=n) / at_least
    opened = np.bincount(row, weights=((upper[we] - upper[ws]) == 1), minlength=n) / at_least
    marked = np.bincount(row, weights=(letter[np.maximum(we - 1, 0)] == 9), minlength=n) / at_least
    short = np.bincount(row, weights=(length <= 3), minlength=n) / at_least
    lone = np.bincount(row, weights=(length == 1), minlength=n) / at_least
    kinds = _distinct(row, h, n) / at_least
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) else h
    same = row[:-1] == row[1:] if len(h) else np.zeros(0, bool)
    pairs = _distinct(row[:-1][same], pair[same], n) / np.maximum(words - 1, 1) if len(h) else np.zeros(n)
    again = np.bincount(row[1:][same], weights=(h[1:] == h[:-1])[same], minlength=n) / at_least if len(h) else np.zeros(n)
    ls, le, lrow = c.lines()
    lines = np.bincount(lrow, minlength=n).astype(np.float64)
    other = _distinct(lrow, c.hashes(ls, le), n) / lines
    per_line = words / lines
    columns = [np.log1p(chars), np.log1p(words), np.log1p(lines), mean, spread, wordless, shouted, opened, marked, short, lone, kinds, pairs, again, other, np.log1p(per_line)]
    root = np.sqrt(share[:, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]])
    return np.concatenate([np.stack(columns, 1), root], axis=1)


STATISTICS = 28


@dataclass
class Model:
    """Everything that a score needs. Without labelled rows it is ``constant``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose inner products approximate ``exp(-|a - b|^2 * WIDTH / 2K)`` of standardised statistics, and a constant."""
    rng = np.random.default_rng(9)
    w = rng.normal(size=(STATISTICS, FEATURES)) * np.sqrt(WIDTH / STATISTICS)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def pool_adjacent(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic regression: the increasing means nearest to ``total / weight``."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist(), strict=True):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks]) if blocks else np.zeros(0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of every row."""

    def run(batches):
        for b in batches:
            found = [statistics(c).astype(np.float32) for _, _, c in text_chunks(b.column(1))]
            flat = np.concatenate(found) if found else np.zeros((0, STATISTICS), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * STATISTICS), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """A model from all rows of ``labels`` (``doc_id`` and a label of 0 or 1) that have a label and a document and aren't held out.

    Repeated labels of a document each count. With no such row the model's scores are 1/2, with one kind of label only, that label.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    labels = labels.filter(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows, path = save(stats.join(labels, "doc_id").select("stats", "y"), "labelled")
    each = rows.select("y", F.posexplode("stats").alias("k", "x"))
    moments = each.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n"), F.avg("y").alias("y")).orderBy("k").toPandas()
    if not len(moments):
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), constant=0.5)
    mean, scale = moments["m"].to_numpy(), np.maximum(moments["s"].to_numpy(), 1e-6)
    rate, n = float(moments["y"][0]), int(moments["n"][0])
    if rate in (0.0, 1.0):
        return Model(mean, scale, constant=rate)

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = fourier(_matrix(b.column(0)), mean, scale)
            total += z.T @ np.concatenate([z, b.column(1).to_numpy()[:, None]], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2, dtype=np.int32) * (FEATURES + 2)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), lists], ["k", "part"])

    def summed(k: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": k["k"][:1], "part": [np.sum(k["part"].to_list(), axis=0)]})

    parts = rows.coalesce(MOST_PARTS).mapInArrow(equations, "k int, part array<double>").groupBy("k").applyInPandas(summed, "k int, part array<double>")
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.collect():  # a row for each feature
        system[r["k"]] = r["part"]
    ridge = np.full(FEATURES + 1, RIDGE * max(n, 1) / FEATURES + 1e-2)
    ridge[-1] = 0
    model = Model(mean, scale, np.linalg.solve(system[:, :-1] + np.diag(ridge), system[:, -1]))

    def raw(batches):
        for b in batches:
            at = np.clip(np.floor((model.raw(_matrix(b.column(0))) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            y = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(np.bincount(at, minlength=BINS).astype(np.int64)), pa.array(np.bincount(at, weights=y, minlength=BINS))], ["bin", "n", "y"])

    bins = rows.coalesce(MOST_PARTS).mapInArrow(raw, "bin int, n long, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("n > 0").orderBy("bin").toPandas()
    model.knots = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.values = pool_adjacent(bins["n"].to_numpy(float), bins["y"].to_numpy(float))
    forget(stats.sparkSession, path)
    return model


def scored(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of measured rows."""

    def run(batches):
        for b in batches:
            s = model.scores(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``. No shuffle."""

    def run(batches):
        for b in batches:
            text = b.column(b.schema.names.index(text_col))
            good = [model.scores(statistics(c).astype(np.float32).astype(np.float64)) >= threshold for _, _, c in text_chunks(text)]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents; learnt from all labels of documents that aren't held out. Null texts count as empty ones, which
    have a score like others; null and repeated ids and repeated rows keep a row each; without labels every score is 1/2; an empty table gives no row."""
    stats, _ = save(measured(documents(spark, sf_dir)), "stats")
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
