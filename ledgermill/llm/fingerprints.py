"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text) is hashed to a wide vector and a text's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power
of two. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by one addition or subtraction (:func:`insert`, :func:`delete`).
The vector has two banks:

* 32 lanes modulo 2**32, drawn from SHAKE-128 of the paragraph: two multisets of paragraphs are equal if these sums are;
* 512 lanes modulo 2**32, to which each run of three words (fewer words: all of them) adds 1 or -1 in a lane, both chosen by its hash. Inner products of
  these sums estimate how many runs two texts share (standard error about 0.04), from which :func:`likeness` takes a cosine. Lanes are read with a sign, so
  likeness holds for texts with fewer than 2**31 runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, documents, per_row, text_buffer

EXACT, SKETCH, RUN = 32, 512, 3
#: Bytes of text that a range of ids holds, until there are as many ranges as ``MOST_PARTS``, which bounds what passes through the driver.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two banks, a row for each text."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    c = Chunk(np.frombuffer(b"".join(texts), np.uint8), off)
    start, end, row = c.lines()
    buf = c.buf.tobytes()
    digests = b"".join(hashlib.shake_128(buf[s:e]).digest(4 * EXACT) for s, e in zip(start.tolist(), end.tolist(), strict=True))
    exact = np.frombuffer(digests, "<u4").reshape(-1, EXACT)
    bounds = np.searchsorted(row, np.arange(c.rows + 1))
    exact = per_row(exact.astype(np.uint64), bounds).astype(np.uint32)

    ws, we = c.words()
    line = np.searchsorted(start, ws, side="right") - 1
    h = c.hashes(ws, we)
    n = len(h)
    first = np.concatenate([[True], line[1:] != line[:-1]]) if n else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    place = np.arange(n) - at  # in its line
    last = np.concatenate([line[1:] != line[:-1], [True]]) if n else first
    with np.errstate(over="ignore"):
        run = h.copy()
        for k in range(1, RUN):
            back = np.maximum(np.arange(n) - k, 0)
            run = np.where(place >= k, run * np.uint64(0x9E3779B97F4A7C15) + h[back], run)
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    use = (place >= RUN - 1) | (last & (place < RUN - 1))  # of a short line, its whole
    owner = c.row_of(ws)[use]
    lane = (run[use] >> np.uint64(55)).astype(np.int64)
    sign = 1.0 - 2.0 * ((run[use] >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    sketch = np.bincount(owner * SKETCH + lane, weights=sign, minlength=c.rows * SKETCH).reshape(c.rows, SKETCH)
    return exact, sketch.astype(np.int64).astype(np.uint32)


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    raw = np.concatenate([exact.astype("<u4").view(np.uint8).reshape(len(exact), -1), sketch.astype("<u4").view(np.uint8).reshape(len(sketch), -1)], axis=1)
    return [x.tobytes().hex() for x in raw]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), np.frombuffer(raw[4 * EXACT :], "<u4")


def fingerprint(text: str | None) -> str:
    return encode(*vectors([(text or "").encode()]))[0]


def _paragraph(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    if "\n" in paragraph:
        raise ValueError("one paragraph has no newline")
    exact, sketch = vectors([paragraph.encode()])
    return exact[0], sketch[0]


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after one more paragraph."""
    (a, b), (x, y) = decode(fingerprint), _paragraph(paragraph)
    return encode((a + x)[None], (b + y)[None])[0]


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after a paragraph has gone."""
    (a, b), (x, y) = decode(fingerprint), _paragraph(paragraph)
    return encode((a - x)[None], (b - y)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of the word-run banks, 0 to 1; 1 if all lanes agree, 0 if one text has no words."""
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, cosine)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row; null text counts as empty, null or repeated ids are kept."""

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(1))
            raw = buf.tobytes() if len(off) > 1 else b""
            out = []
            for group in _groups(off):
                out += encode(*vectors([raw[off[k] : off[k + 1]] for k in group]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _groups(off: np.ndarray, limit: int = 1 << 19):
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield range(i, j)
        i = j


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """Deal rows ``doc_id, text`` to ``parts`` ranges in the order of descending ids and, for equal ids, of descending hashes of their texts; null ids come
    last. So an id that very many rows have, or null, takes several ranges. The first row of each range also goes, marked ``head``, to the range before it (of
    the first range, to the last): every document meets the next one. Only range limits, one a range, pass through the driver."""
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    cuts = sorted(int(x) for x in ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    limits = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(ids, keys):
        import pandas as pd

        v, share = ids.to_numpy("int64"), (keys.to_numpy("int64").astype(np.float64) + 2.0**63) / 2.0**64
        low, high = np.searchsorted(limits, v, side="left"), np.searchsorted(limits, v, side="right")
        inside = np.minimum(np.floor(share * (high - low)), np.maximum(high - low - 1, 0)).astype(np.int64)  # an id that is several limits
        return pd.Series((len(limits) - np.where(high > low, low + 1 + inside, low)).astype(np.int32))

    dealt = rows.withColumn("part", part_of(F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")))
    # the highest (id, text) of each part: a row for each of at most ``parts`` ranges
    firsts = dealt.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text"))).alias("top")).orderBy("part").collect()
    if not firsts:
        return dealt.withColumn("head", F.lit(False))
    order = [r["part"] for r in firsts]
    to = {p: order[i - 1] for i, p in enumerate(order)}
    spark = rows.sparkSession
    heads = spark.createDataFrame([(r["part"], r["top"][0], r["top"][1], to[r["part"]]) for r in firsts], "h_part int, h_id long, h_key long, h_to int")
    same = (F.col("part") == F.col("h_part")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("h_id")) & (F.xxhash64("text") == F.col("h_key"))
    both = dealt.join(F.broadcast(heads), same, "left")
    places = F.when(F.col("h_to").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("head")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(False).alias("head")), F.struct(F.col("h_to").alias("part"), F.lit(True).alias("head")))
    )
    return both.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.head")


def edited(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points replaced by the first as many of the next document's, by
    descending id, and after the last the first document's. One shuffle of the texts; next texts never leave their range of ids but for one a range.

    Null text counts as empty. Rows with equal ids follow each other in the order of their texts' hashes; null ids come last. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    dealt = with_next(rows, parts).withColumn("key", F.xxhash64("text"))
    sort = ["part", "head", F.col("doc_id").desc_nulls_last(), F.col("key").desc()]

    def run(batches):
        held: list = []  # (part, head, id, text) rows, at most as many as a step takes and one more

        def step(rows, last):
            """Results for all rows but the last; the last too if its next is known to be the part's head row."""
            texts, edits, out = [r[3] for r in rows], [], []
            for a, b in zip(rows, rows[1:], strict=False):
                if a[1] or a[0] != b[0]:
                    continue
                s, t = a[3].decode(), b[3].decode()
                half = len(s) // 2
                out.append((a, len(s)))
                edits.append((s[: len(s) - half] + t[:half]).encode())
            at = [k for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if not a[1] and a[0] == b[0]]
            if not at:
                return None
            own, new = vectors(texts), vectors(edits)
            pick = lambda v, k: (v[0][k], v[1][k])
            idx = np.array(at)
            here, names = pick(own, idx), encode(*own)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in out], pa.int64()),
                    pa.array([n for _, n in out], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                    pa.array([names[k] for k in at], pa.string()),
                    pa.array(encode(*new), pa.string()),
                    pa.array(likeness(here, new), pa.float64()),
                    pa.array(likeness(here, pick(own, idx + 1)), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for b in batches:
            part, head, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            buf, off = text_buffer(b.column(3))
            for k in range(len(ids)):
                held.append((part[k], head[k], ids[k], buf[off[k] : off[k + 1]].tobytes()))
                size += int(off[k + 1] - off[k])
                if size > 1 << 19 and len(held) > 1:
                    if (got := step(held, False)) is not None:
                        yield got
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1 and (got := step(held, True)) is not None:
            yield got

    spread = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(*sort)
    return spread.select("part", "head", "doc_id", "text").mapInArrow(run, EDITED)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of all documents. A null text is empty; null and repeated ids
    keep a row each and are ordered as :func:`with_next` says; repeated rows follow each other; one row alone is its own next; an empty table gives no row."""
    return edited(documents(spark, sf_dir))
