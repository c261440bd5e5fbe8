"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` bits of each other meet in a variant that lies within half the radius of both. All variants within 2 of 64 bits are
2,081 a fingerprint, some eight times the bytes of an average document here. So the halves of a fingerprint are hashed apart: of two within 4 bits, one
32-bit half is within 2 bits, and its variants within 1 bit, 33 a half, meet. Pairs that collide on a variant are verified on all 64 bits.

Only different fingerprints are hashed. A variant with more than ``RUN`` of them isn't compared pair by pair: its fingerprints emit all 2,081 variants of
their 64 bits, and whatever meets there is within the radius by construction, so each variant links its fingerprints to the least one. Both ways are
complete, and both emit links in proportion to the fingerprints, not to pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, save, text_buffer
from .components import components

RADIUS, RUN, SHINGLE, SEED = 4, 256, 4, 42


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, ASCII letters lower-cased."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long. Null text counts as empty, whose fingerprint is 0."""

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(1))
            found = [fingerprint(buf[off[k] : off[k + 1]].tobytes(), words) for k in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _forest(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (one, other) that join what is within ``radius`` among neighbours of the same key; rows come sorted by key."""
    n = len(key)
    ones, others = [], []
    k, at = 1, np.arange(n)
    while True:
        at = at[at + k < n]
        at = at[key[at] == key[at + k]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + k]).view(np.uint64)) <= radius]
        ones.append(near)
        others.append(near + k)
        k += 1
    if not ones:
        return fp[:0], fp[:0]
    a, b = np.concatenate(ones), np.concatenate(others)
    least = np.arange(n)
    while True:
        old = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == old).all():
            break
    linked = np.flatnonzero(least != np.arange(n))
    return fp[linked], fp[least[linked]]


def _meet(radius: int, most: int):
    """Over rows ``key, fp`` sorted by key: links within each key, or for a key with more than ``most`` rows, its rows alone (``b`` null)."""

    def run(batches):
        key, fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def result(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

        def links(key, fp):
            """All of whole keys."""
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            big = np.repeat(size > most, size)
            a, b = _forest(key[~big], fp[~big], radius)
            if big.any():
                yield result(fp[big], pa.nulls(int(big.sum()), pa.int64()))
            if len(a):
                yield result(a, pa.array(b))

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            if crowded is not None and last:  # the rest of a crowded key ends here
                n = int(np.searchsorted(key, crowded, side="right"))
                if n:
                    yield result(fp[:n], pa.nulls(n, pa.int64()))
                key, fp, last, crowded = key[n:], fp[n:], last - n, None
            if last > 0:
                yield from links(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
            if len(key) > most or (crowded is not None and len(key)):
                crowded = key[-1]
                yield result(fp, pa.nulls(len(fp), pa.int64()))
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from links(key, fp)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, most: int = RUN) -> DataFrame:
    """``a, b``: links that connect all different fingerprints (``fp``, stored and distinct) within ``radius`` bits of each other."""
    half = radius // 2
    masks = lambda bits, r: [sum(1 << i for i in c) for k in range(r + 1) for c in itertools.combinations(range(bits), k)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # the key: which half, and a variant of it
    flips = F.array(*[F.lit(m).cast("long") for m in masks(32, half // 2)])
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("h"))
    variants = halves.select(F.explode(flips).alias("m"), "h", "fp").select(F.col("h").bitwiseXOR(F.col("m")).alias("key"), "fp")
    met = variants.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(radius, most), "a long, b long")
    met, _ = save(met, "met")
    links = met.filter(F.col("b").isNotNull()).distinct()
    crowded = met.filter(F.col("b").isNull()).select("a").distinct()
    balls = F.array(*[F.lit(signed(m)).cast("long") for m in masks(64, half)])
    ball, _ = save(crowded.select(F.col("a"), F.explode(balls).alias("m")).select(F.col("a"), F.col("a").bitwiseXOR(F.col("m")).alias("key")), "ball")
    least = ball.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = ball.join(least, "key").filter("a != b").select("a", "b").distinct()
    return links.union(more).distinct()


def grouped(stored: DataFrame, radius: int = RADIUS, most: int = RUN) -> DataFrame:
    """``fp, component_id`` of every different fingerprint of stored rows ``doc_id, fp``: the least id that it reaches over links, null if no row has one."""
    nodes, _ = save(stored.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius, most))
    with_root = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = with_root.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    return with_root.join(least, F.col("root") == F.col("r")).select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = RUN) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row. Null and empty texts share fingerprint zero; repeated ids are kept; rows with a null id are
    linked too, and name a component only by others' ids."""
    stored, _ = save(fingerprints(docs, id_col, text_col), "fingerprints")
    found = grouped(stored, radius, most).withColumnRenamed("fp", "g")
    name = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return stored.join(found, stored["fp"] == found["g"]).select("doc_id", name.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component of ``found`` (``doc_id, component_id``): that of the least id, and of rows with equal
    ids, one. Rows with a null id can't be named, so they stay."""
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, F.col(id_col) == F.col("__kept"))
    first = F.row_number().over(Window.partitionBy("__kept").orderBy(F.xxhash64(text_col)))
    return named.withColumn("__order", first).filter("__order = 1").select(*docs.columns).union(docs.filter(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of all documents. Null and empty texts have fingerprint zero, which is linked like any other; repeated ids and rows keep a
    row each; a row without an id is linked too, and a component of such rows alone has no id (null); an empty table gives no row."""
    return near_duplicates(documents(spark, sf_dir))
