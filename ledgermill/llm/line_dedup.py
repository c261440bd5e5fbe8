"""Line deduplication by content-defined chunks of lines.

A line goes if, and only if, it is in a run of two lines or more that an earlier place has: an earlier document (by id), or the same one further up, where
the runs don't overlap. Each line that goes is kept, byte for byte, in an earlier place. Two steps find such runs:

1. A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk where it is divisible by ``DIVISOR``. So a boundary depends on the lines just
   before it alone, and an insertion or deletion shifts no chunk but its own. A chunk of two lines or more that occurs again anywhere goes, but in the
   document with the least id. Of long repeated passages this finds all but the ends, with a row a chunk and not one a line.
2. A repeated passage begins and ends inside a chunk. Therefore the chunks that stay, one copy of each, are compared by their smallest parts, every two
   neighbouring lines, and so are lines on either side of a boundary. Of each such pair all but the first occurrence goes.

Digests (128 bits of SHA-256) only bring chunks and pairs together. The bytes of each one that goes are sent once, from the document that keeps it, and a line goes
where its bytes are these; what shares a digest alone stays.

Nulls and edge cases: a null text counts as empty, one line without a character, and stays null where texts are returned; a text that has nothing left is
empty. Rows with a null id keep none back: they lose only to documents with an id. Rows with equal ids are one document as to which keeps, so of repeated
rows none loses to the other. An empty table gives none. Rows are joined to what they lose by a hash of id and text, which is never null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, bit_table, documents, forget, has_bit, mix, save, text_chunks

WINDOW, DIVISOR, LEAST_LINES = 2, 3, 2


def chunk_ends(c: Chunk, window: int = WINDOW, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte without the last newline, row, lines) of every chunk."""
    start, end, row = c.lines()
    n = len(start)
    h = c.hashes(start, end)
    roll = h.copy()
    for k in range(1, window):
        before = np.zeros(n, np.uint64)
        before[k:] = np.where(row[k:] == row[:-k], h[:-k], np.uint64(0)) if n > k else before[k:]
        roll = roll + before * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    last = np.concatenate([row[1:] != row[:-1], [True]]) if n else np.zeros(0, bool)
    ends = np.flatnonzero(last | (mix(roll) % np.uint64(divisor) == 0))
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return start[begins], end[ends], row[begins], ends - begins + 1


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


class Lines:
    """The lines, chunks and pairs of the texts of a :class:`Chunk`."""

    def __init__(self, c: Chunk, window: int = WINDOW, divisor: int = DIVISOR, digest=_digest):
        self.raw, self.digest = c.buf.tobytes(), digest
        start, end, row = c.lines()
        self.bounds = np.searchsorted(row, np.arange(c.rows + 1)).tolist()
        self.start, self.end = start.tolist(), end.tolist()
        first, last, of, lines = chunk_ends(c, window, divisor)
        line = np.cumsum(lines) - lines
        self.chunk_bounds = np.searchsorted(of, np.arange(c.rows + 1)).tolist()
        #: (first line, line after the last, bytes) of each chunk.
        self.chunks = list(zip(line.tolist(), (line + lines).tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))

    def two(self, line: int) -> bytes:
        """A line and the next."""
        return self.raw[self.start[line] : self.end[line + 1]]

    def pair(self, line: int) -> bytes:
        """Digest of a line and the next."""
        return self.digest(self.two(line))

    def named(self, row: int, wanted: set) -> dict[bytes, bytes]:
        """The bytes of each wanted digest that a text has."""
        found = {}
        for _, _, (s, e) in self.chunks[self.chunk_bounds[row] : self.chunk_bounds[row + 1]]:
            found.setdefault(self.digest(self.raw[s:e]), self.raw[s:e])
        for line in range(self.bounds[row], self.bounds[row + 1] - 1):
            found.setdefault(self.pair(line), self.two(line))
        return {d: raw for d, raw in found.items() if d in wanted}

    def parts(self, row: int):
        """(digest, digests of its pairs) of every chunk of two lines or more of a text, and None with the pairs over boundaries."""
        loose, last = [], self.bounds[row + 1] - 1
        for begin, end, (s, e) in self.chunks[self.chunk_bounds[row] : self.chunk_bounds[row + 1]]:
            if end - begin >= LEAST_LINES:
                yield self.digest(self.raw[s:e]), [self.pair(k) for k in range(begin, end - 1)]
            if end - 1 < last:
                loose.append(self.pair(end - 1))
        if loose:
            yield None, loose

    def cleaned(self, row: int, gone: dict[bytes, bytes]) -> tuple[bytes, int, int, int]:
        """(what is left, lines, removed lines, removed runs) of a text that loses what ``gone`` has the bytes of, by digest. Removed lines go with one newline each, so the lines that
        stay are as they were."""
        at, n = self.bounds[row], self.bounds[row + 1] - self.bounds[row]
        lost, first = [False] * n, {}
        if gone:
            for begin, end, (s, e) in self.chunks[self.chunk_bounds[row] : self.chunk_bounds[row + 1]]:
                if end - begin >= LEAST_LINES and gone.get(self.digest(self.raw[s:e])) == self.raw[s:e]:
                    lost[begin - at : end - at] = [True] * (end - begin)
        for j in range(n - 1):
            digest = self.pair(at + j)
            before = first.setdefault(digest, j)
            if (digest in gone and gone[digest] == self.two(at + j)) or (j - before > 1 and self.two(at + before) == self.two(at + j)):
                lost[j] = lost[j + 1] = True
        kept = b"\n".join(self.raw[self.start[at + j] : self.end[at + j]] for j in range(n) if not lost[j])
        return kept, n, sum(lost), sum(x and not y for x, y in zip(lost, [False, *lost], strict=False))


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``key, doc_id, digest, pairs`` of every chunk of two lines or more, once per row, and with a null digest the pairs over boundaries."""

    def run(batches):
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, c in text_chunks(b.column(2)):
                lines, out = Lines(c, **options), []
                for r in range(j - i):
                    found = dict(lines.parts(r))  # each once
                    out += [(keys[i + r], ids[i + r], d, list(set(p))) for d, p in found.items()]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["key", "doc_id", "digest", "pairs"])

    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, digest binary, pairs array<binary>")


def _keepers(held: DataFrame) -> DataFrame:
    """``d, keeper, keeper_key``: of digests that two rows or more of ``held`` hold, the least id and its row."""
    again = held.filter("digest is not null").groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("keeper"), F.min_by("key", "doc_id").alias("keeper_key"), F.count(F.lit(1)).alias("n"))
    return again.filter((F.col("n") > 1) & F.col("keeper").isNotNull()).drop("n")


def _bytes_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``d, raw`` of stored ``keeper_key, digests``: the bytes of each digest, from the row that keeps it."""
    table, bits = bit_table(wanted, "keeper_key")

    def some(batches):
        known = np.unpackbits(table, bitorder="little").view(bool)
        for b in batches:
            yield b.filter(pa.array(has_bit(known, bits, b.column(0).to_numpy())))

    def run(batches):
        for b in batches:
            for i, j, c in text_chunks(b.column(0)):
                lines = Lines(c, **options)
                found = [x for r in range(j - i) for x in lines.named(r, set(b.column(1)[i + r].as_py())).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["d", "raw"])

    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(some, "key long, text string")
    each = rows.join(wanted, F.col("key") == F.col("keeper_key")).select("text", "digests").mapInArrow(run, "d binary, raw binary")
    return each.groupBy("d").agg(F.first("raw").alias("raw"))  # of repeated rows


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``key, gone``: for each row, the chunks and pairs that another document keeps, by digest and bytes."""
    spark = docs.sparkSession
    foreign = F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
    held, path = save(chunks(docs, id_col, text_col, **options), "chunks")
    whole = held.filter("digest is not null").join(_keepers(held), F.col("digest") == F.col("d"), "left").withColumn("goes", foreign).drop("d", "keeper")
    loose = held.filter("digest is null").withColumns({"keeper_key": F.lit(None).cast("long"), "goes": F.lit(False)})  # not through the join, where nulls would meet in one task
    marked, marked_path = save(whole.unionByName(loose), "marked")
    forget(spark, path)
    pairs, pairs_path = save(marked.filter("not goes").select("key", "doc_id", F.explode("pairs").alias("digest")).distinct(), "pairs")
    lost = pairs.join(_keepers(pairs), F.col("digest") == F.col("d")).filter(foreign).select("key", "digest", "keeper_key")
    every = marked.filter("goes").select("key", "digest", "keeper_key").union(lost).groupBy("key", "digest").agg(F.min("keeper_key").alias("keeper_key"))
    every, _ = save(every, "every")
    for p in (marked_path, pairs_path):
        forget(spark, p)
    wanted, _ = save(every.select("keeper_key", "digest").distinct().groupBy("keeper_key").agg(F.collect_list("digest").alias("digests")), "wanted")
    sent = every.join(_bytes_of(docs, wanted, id_col, text_col, **options), F.col("digest") == F.col("d"))
    return sent.groupBy("key").agg(F.collect_list(F.struct("digest", "raw")).alias("gone"))  # of one document, at most its chunks and pairs


def _with_removals(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    lost = gone.select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    return docs.join(lost, _key(id_col, text_col) == F.col("__key"), "left").drop("__key")


def _cleaned(text: pa.Array, gone: list, **options) -> list[tuple[bytes, int, int, int]]:
    out = []
    for i, j, c in text_chunks(text):
        lines = Lines(c, **options)
        out += [lines.cleaned(r, {x["digest"]: x["raw"] for x in gone[i + r] or ()}) for r in range(j - i)]
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without repeated runs of lines in their text."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            text = b.column(at)
            new = [t.decode() if valid else None for valid, (t, *_) in zip(text.is_valid().to_pylist(), _cleaned(text, b.column(len(names)).to_pylist(), **options), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(names))], names)

    return _with_removals(docs, id_col, text_col, removals(docs, id_col, text_col, **options)).mapInArrow(run, docs.schema)


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_lines, n_removed_lines, n_removed_runs, kept_sha256`` of every row."""

    def run(batches):
        for b in batches:
            found = _cleaned(b.column(1), b.column(2).to_pylist(), **options)
            hashes = pa.array([hashlib.sha256(t).hexdigest() for t, *_ in found], pa.string())
            counts = [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, hashes], ["doc_id", "n_lines", "n_removed_lines", "n_removed_runs", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _with_removals(rows, "doc_id", "text", removals(rows, **options)).mapInArrow(run, "doc_id long, n_lines long, n_removed_lines long, n_removed_runs long, kept_sha256 string")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed_lines, n_removed_runs, kept_sha256`` of all documents. A null text is one empty line; null ids lose to documents with an id and
    keep nothing back; rows with equal ids don't lose to each other; ties in age can't occur otherwise; an empty table gives no row."""
    return deduped(documents(spark, sf_dir))
