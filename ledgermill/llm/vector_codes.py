"""Codes of vectors: each of equal parts of an integer vector is named by the nearest entry of that part's codebook.

Vectors are stored once in blocks of rows, by columns: for each dimension a dictionary of the block's different integers, and each row's place in it. An
assignment tabulates, for each dimension, the squared differences of every integer of the dictionary to all entries; a part's distances are then rows of these
tables, gathered by the dictionary codes and added. Dictionaries are a block's own, so no table of all values is ever put together.

Codebooks are the only state between rounds: entries x width integers on the driver. Sums for a new codebook are counted over dictionary codes in each task and
added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers (rows x dimensions) of a block.
BLOCK = 1 << 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v`` of the vectors without null or non-finite components; other columns go."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("v")).filter(F.col("v").isNotNull() & finite)


def most(width: int) -> int:
    """Integers are held within this, so that squared distances over ``width`` dimensions fit into 64 bits."""
    return 1 << ((63 - max(1, width).bit_length()) // 2 - 1)


def integers(rows: list | np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, a row each; missing ones at the end of a row are 0."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    out = np.floor(out * scale)
    return np.clip(out, -most(width), most(width)).astype(np.int64)


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """:func:`integers` of an array column without nulls."""
    off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    if (np.diff(off) == width).all():
        x = np.floor(values[off[0] : off[-1]].reshape(len(column), width) * scale)
        return np.clip(x, -most(width), most(width)).astype(np.int64)
    return integers([values[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], width, scale)


def _blocks(width: int, scale: int):
    """Over ``vec_id, label, v``: a row for each block, ``ids``, ``labels``, and by dimension the ``sizes`` of dictionaries, their ``values`` and all ``codes``."""
    step = max(1, BLOCK // max(1, width))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = _matrix(b.column(2), width, scale)
                parts = [np.unique(x[:, d], return_inverse=True) for d in range(width)]
                codes = np.stack([c for _, c in parts]).astype("<u4") if width else np.zeros(0, "<u4")
                one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
                columns = [one(b.column(0)), one(b.column(1)), one(pa.array([len(v) for v, _ in parts], pa.int32())), one(pa.array(np.concatenate([v for v, _ in parts]) if width else np.zeros(0, np.int64)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([codes.tobytes()], pa.binary())], ["ids", "labels", "sizes", "values", "codes"])

    return run


def encoded(kept: DataFrame, width: int, scale: int = SCALE) -> DataFrame:
    """Blocks of ``vec_id, label, v`` by columns, stored."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])
    return save(kept.mapInArrow(_blocks(width, scale), schema), "vectors")[0]


def _columns(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]]:
    """(ids, labels, dictionary of each dimension, codes by dimension and row) of each block of a batch."""
    for k in range(b.num_rows):
        sizes = b.column(2)[k].values.to_numpy()
        values = np.split(b.column(3)[k].values.to_numpy(), np.cumsum(sizes)[:-1]) if len(sizes) else []
        yield b.column(0)[k].values, b.column(1)[k].values, values, np.frombuffer(b.column(4)[k].as_buffer(), "<u4").reshape(len(sizes), len(b.column(0)[k]))


def nearest(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of one part: its dimensions' dictionaries, its codes, and the codebook (entry, dimension). Ties go to the lower entry."""
    far = np.zeros((codes.shape[1], len(book)), np.int64)
    for v, c, entries in zip(values, codes, book.T, strict=True):
        far += ((v[:, None] - entries[None, :]) ** 2)[c]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(best)), best]


def _sums(books: np.ndarray):
    """Over blocks: for each part, entry and dimension of the part, the number of parts that the task assigned to the entry and their sum."""
    parts, entries, size = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for _, _, values, codes in _columns(b):
                for p in range(parts):
                    at = slice(p * size, (p + 1) * size)
                    best, _ = nearest(values[at], codes[at], books[p])
                    n[p] += np.bincount(best, minlength=entries)
                    for k, (v, c) in enumerate(zip(values[at], codes[at], strict=True)):
                        total[p, :, k] += np.bincount(best * len(v) + c, minlength=entries * len(v)).reshape(entries, len(v)) @ v
        p, e, k = (x.ravel() for x in np.indices(books.shape))
        used = n[p, e] > 0
        arrays = [pa.array(x[used]) for x in (p, e, k, n[p, e], total.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, ["p", "e", "k", "n", "total"])

    return run


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of the parts nearest to it; entries without parts stay."""
    sums = blocks.mapInArrow(_sums(books), "p long, e long, k long, n long, total long").groupBy("p", "e", "k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = books.copy()
    for r in sums.collect():  # at most a row for each integer of the codebooks
        new[r["p"], r["e"], r["k"]] = int(r["total"]) // r["n"]
    return new


def _coded(books: np.ndarray):
    """Over blocks: ``vec_id, label, code, error`` of each vector."""
    parts, _, size = books.shape

    def run(batches):
        for b in batches:
            for ids, labels, values, codes in _columns(b):
                out, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(parts):
                    at = slice(p * size, (p + 1) * size)
                    if size:
                        out[:, p], far = nearest(values[at], codes[at], books[p])
                        error += far
                code = pa.array([x.tobytes().hex() for x in out], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Stored ``vec_id, label, code, error`` of every usable vector, and the codebooks (part, entry, dimension of the part). ``entries`` is at most 256.

    The width is that of the longest vector, rounded up to a multiple of ``parts``; what a shorter one lacks is 0. Integers beyond :func:`most` count as that. With
    fewer vectors than ``entries``, each codebook has as many entries as there are vectors. Equal ids are ordered by their vectors, rows without an id come last.
    """
    kept = usable(vectors, id_col, vector_col, label_col)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    size = -(-longest // parts)
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = integers([r["v"] for r in first], parts * size, scale).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    blocks = encoded(kept, parts * size, scale)
    for _ in range(rounds if size and len(first) else 0):
        books = moved(blocks, books)
    return save(blocks.mapInArrow(_coded(books), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "codes")[0], books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all embeddings with finite components. Null vectors and vectors with null or non-finite
    components give no row; repeated ids and rows keep a row each; a row without an id is coded too, and begins no codebook before rows with one; vectors without
    a label share one sum; an empty table gives no row. Lengths that differ, fewer than 64 vectors and huge components: see :func:`compressed`."""
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    return f"""near{n} AS (SELECT id, label, v.part, arg_min(entry, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + entry)::BIGINT) AS entry,
  min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS far FROM v JOIN book{n} b ON b.part = v.part GROUP BY ALL)"""


def _book(n: int) -> str:
    return f"""each{n} AS (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM near{n} JOIN v USING (id, part)),
mean{n} AS (SELECT part, entry, list(y ORDER BY k) AS c FROM (SELECT part, entry, k, floor(sum(y) / count(*))::BIGINT AS y FROM each{n} GROUP BY ALL) GROUP BY ALL),
book{n + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m USING (part, entry))"""


SQL = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, label, part, list_slice(x, part * (len(x) // {PARTS}) + 1, (part + 1) * (len(x) // {PARTS})) AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS (SELECT part, id AS entry, x AS c FROM v WHERE id < {ENTRIES}),
{_assigned(0)}, {_book(0)}, {_assigned(1)}, {_book(1)}, {_assigned(2)},
codes AS (SELECT id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY id),
all_books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (id), all_books"""
