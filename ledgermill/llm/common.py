"""What the operators of this subpackage share: shared scratch tables and Arrow text buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, shared_folder
from ..storage import store as save

__all__ = [
    "CHUNK_BYTES", "LOWERED", "SPACE", "Chunk", "bit_count", "bit_table", "cut_rows", "documents", "forget", "has_bit", "hashed_id", "held_out", "mix", "per_row", "ragged", "row_chunks", "runs", "save",
    "shared_folder", "starts", "text_buffer", "text_chunks", "text_key", "word_hashes",
]

#: Bytes of text that numpy works on at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 19
#: Which bytes are ASCII white space; each byte with A to Z in lower case.
SPACE = np.array([x == 32 or 9 <= x <= 13 for x in range(256)])
LOWERED = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id) -> "F.Column":
    """True where crc32 of the id, as text, is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bit_count(rows: int, most: int = 27) -> int:
    """Bits of a hash that a table of ``rows`` hashes takes: 16 to 32 ranges for each, until ``most``."""
    return min(most, max(15, (16 * rows).bit_length()))


def bit_table(df: DataFrame, name: str, most: int = 27) -> tuple[np.ndarray, int]:
    """Which ranges of the hashes in column ``name`` of a stored table hold one: little-endian bits, and that there are 2**n of them. ``n`` follows the number
    of rows up to ``most``, so the driver gets at most 2**27 bits, put together by Spark. It only spares a shuffle what can't match; beyond, it spares less."""
    n = bit_count(df.count(), most)
    bit = F.shiftrightunsigned(name, 64 - n)
    parts = df.groupBy(F.shiftright(bit, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    table = np.zeros(1 << n >> 3, np.uint8)
    for r in parts.collect():
        table[r["part"] << 12 : r["part"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)
    return table, n


def has_bit(table: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set in an unpacked :func:`bit_table`."""
    return table[(hashes.view(np.uint64) >> np.uint64(64 - n)).astype(np.int64)]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut_rows(buf: np.ndarray, off: np.ndarray, is_break: np.ndarray, limit: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of pieces of the rows, and the row of each. A row of more than ``limit`` bytes is cut before bytes that ``is_break`` (by value) marks, so memory follows
    ``limit`` and not the longest text; a run without such a byte isn't cut."""
    long = np.flatnonzero(np.diff(off) > limit)
    if not len(long):
        return off, np.arange(len(off) - 1)
    more, rows = [], []
    for r in long.tolist():
        at, end = int(off[r]), int(off[r + 1])
        while end - at > limit:
            back = np.flatnonzero(is_break[buf[at + 1 : at + limit]])
            step = int(back[-1]) + 1 if len(back) else 0
            ahead = at + limit
            while not step and ahead < end:  # a run longer than a piece: to its end
                found = np.flatnonzero(is_break[buf[ahead : ahead + limit]])
                step, ahead = (ahead + int(found[0]) - at, ahead) if len(found) else (0, ahead + limit)
            if not step:
                break
            at += step
            more.append(at)
            rows.append(r)
    where = np.concatenate([off, np.array(more, np.int64)])
    whose = np.concatenate([np.arange(len(off) - 1), np.array(rows, np.int64)])
    order = np.argsort(whose, kind="stable")  # a row's own start comes before its cuts
    return np.append(where[np.concatenate([np.arange(len(off) - 1), np.arange(len(off), len(where))])[order]], off[-1]), whose[order]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, "Chunk"]]:
    """(first row, row after the last, their texts) over a column."""
    buf, off = text_buffer(column)
    for i, j in row_chunks(off, limit):
        yield i, j, Chunk(buf[off[i] : off[j]], off[i : j + 1] - off[i])


_MULT, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + 4096)
        for k, r in (("up", _MULT), ("down", _INV)):
            x = np.full(m, r, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts side by side in one byte array; spans of words and lines and their 64-bit hashes are computed by numpy for all at once."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.rows = buf, off, len(off) - 1
        self._sums: np.ndarray | None = None

    def text(self, row: int) -> bytes:
        return self.buf[self.off[row] : self.off[row + 1]].tobytes()

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """uint64 of each span: a polynomial in its bytes, mixed with its length."""
        up, down = _powers(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def rolling(self, width: int) -> np.ndarray:
        """A hash of every ``width`` bytes next to each other, cheaper than :meth:`hashes`."""
        up, down = _powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        part = self.buf.astype(np.uint64)
        part += np.uint64(1)
        part *= up[:-1]
        np.cumsum(part, out=sums[1:])
        out = sums[width:] - sums[:-width]
        out *= down[: len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def row_of(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, start, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run without ASCII white space; a run ends with its text."""
        return self.runs(~((self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))))

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of bytes of which ``solid`` is true; a run ends with its text."""
        b = self.buf
        edge = np.zeros(len(b) + 1, bool)
        edge[self.off] = True
        before = np.concatenate([[False], solid])
        after = np.concatenate([solid, [False]])
        return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without its newline) and row of each line; a text has one more line than newlines."""
        at = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.off[:-1], at + 1]), kind="stable")
        end = np.sort(np.concatenate([at, self.off[1:]]), kind="stable")
        newlines = np.searchsorted(at, self.off)
        return start, end, np.repeat(np.arange(self.rows), np.diff(newlines) + 1)


def ragged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the spans, and for each the number of its span."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def word_hashes(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, a 64-bit hash of each word, where each row's words begin and end) over a column of texts, some rows at a time.
    With ``lower``, of words in lower case (ASCII letters only)."""
    buf, off = text_buffer(column)
    for i, j in row_chunks(off):
        part, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        if lower:
            part = LOWERED[part]
        cuts, owner = cut_rows(part, own, SPACE)
        found, counts = [], np.zeros(j - i, np.int64)
        for a, b in row_chunks(cuts):
            chunk = Chunk(part[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            start, end = chunk.words()
            counts += np.bincount(owner[a:b][chunk.row_of(start)], minlength=j - i)
            found.append(chunk.hashes(start, end))
        yield i, j, np.concatenate([*found, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts)])


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` words next to each other."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1])])
    return mix((sums[length:] - sums[:-length]) * down[: len(h) - length + 1])


def starts(bounds: np.ndarray, n: int, window: int) -> np.ndarray:
    """At which of ``n`` places next to each other a window lies within one row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row[:n] == row[window - 1 : window - 1 + n]


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits of a text's SHA-256, by which equal texts are known."""
    d = hashlib.sha256(text).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def hashed_id(batches):
    """Over one column of longs: ``h``, their hashes as :func:`bit_table` takes them."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(b.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["h"])
