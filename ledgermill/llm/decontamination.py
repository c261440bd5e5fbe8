"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Texts are lower-cased and cut into words at white space and ASCII punctuation. An item and a place of a document count as a pair if their Smith-Waterman
score over words (match 2, other -1, gap -1) is ``LEAST`` of the item's best possible score or more: what is left where one word in five was replaced, a
similarity of 0.8.

Seeds lose no such pair. A score of ``LEAST`` leaves a certain number of an item's runs of ``GRAM`` words whole, however the edits lie (:func:`intact`), so
that many runs less one can be left out as seeds, whichever they are: a pair still holds a seed. A first pass over all documents counts in how many of them
each run occurs, and the most frequent are left out. An item too short for such a bound has single words as runs. A second pass takes from each document
the places of seeds with the words around them, as far as an alignment can reach, joins them to items by seed, and aligns item and place.

Documents are filtered in their own tasks by a bit table of seed hashes of a bounded size, which also says how far around a seed an alignment can reach, by the
longest item in its range of hashes; the joins that follow go by hash, and Spark chooses how.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Chunk, bit_count, documents, forget, row_chunks, save

GRAM, LEAST = 2, 0.7

_SPACES = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()), b" " * sum(not chr(i).isalnum() for i in range(128)))


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_SPACES)


def _chunks(column: pa.Array, limit: int = 1 << 19):
    """(first row, row after the last, their normalised texts)."""
    texts = [normal(t) for t in column.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in row_chunks(off, limit):
        yield i, j, Chunk(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    start, end = c.words()
    return c.hashes(start, end), c.row_of(start)


def _grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each place, and whether they are of one row."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27)), row[:m] == row[n - 1 :][:m]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words`` (hashes) of every item with a word and an id."""

    def run(batches):
        for b in batches:
            for i, j, c in _chunks(b.column(1)):
                h, row = _words(c)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _lists(h.view(np.int64), np.searchsorted(row, np.arange(c.rows + 1)))], ["item_id", "words"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null")
    return rows.mapInArrow(run, "item_id long, words array<long>").filter(F.size("words") > 0)


def spare(length: int, least: float = LEAST) -> int:
    """The most that an alignment of an item of ``length`` words can lose and still count, so also the most gaps that it can have."""
    return 2 * length - math.ceil(2 * least * length - 1e-9)


def intact(length: int, n: int, least: float = LEAST) -> int:
    """How many of an item's runs of ``n`` words every alignment that counts leaves whole, at least. Of all words matched, each break costs 1 and ``n - 1``
    runs; a word not matched costs 2 or more and breaks ``n`` at most."""
    lost = spare(length, least)
    return length - lost // 2 if n == 1 else length - (n - 1) * (lost + 1)


def item_grams(words: DataFrame, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """``item_id, gram, n, place, seeds, length`` of every run of ``n`` words: ``gram``, or fewer where no such run need be whole. Any ``seeds`` of them find the
    item, which has ``length`` words."""

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), [[], [], [], [], [], []]
            for k, w in zip(ids, b.column(1), strict=True):
                h = w.values.to_numpy().view(np.uint64)
                n = next((n for n in range(gram, 1, -1) if intact(len(h), n, least) > 0), 1)
                g, _ = _grams(h, np.zeros(len(h), np.int64), n)
                enough = len(g) - max(intact(len(h), n, least), 1) + 1
                for column, x in zip(out, ([k] * len(g), g.view(np.int64).tolist(), [n] * len(g), range(len(g)), [enough] * len(g), [len(h)] * len(g)), strict=True):
                    column += x
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["item_id", "gram", "n", "place", "seeds", "length"])

    return words.mapInArrow(run, "item_id long, gram long, n int, place int, seeds int, length int")


class Table:
    """Which ranges of hashes hold a run of a stored table ``gram, n, length``, the lengths of runs, and by range how many bits the longest item's length has.
    Spark puts it together in bitmaps, at most 2**27 bits for each of some twenty numbers of bits."""

    def __init__(self, grams: DataFrame):
        self.bits = bit_count(64 * grams.count(), 25)  # every word of every document is looked up, so few may hit by chance
        bit = F.shiftrightunsigned("gram", 64 - self.bits)
        of = grams.select("n", F.length(F.bin(F.col("length").cast("long"))).alias("reach"), F.shiftright(bit, 15).cast("int").alias("part"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
        self.sizes = sorted(r["n"] for r in of.select("n").distinct().collect())  # GRAM at most
        self.reach = np.zeros(1 << self.bits, np.uint8)
        for r in sorted(of.groupBy("reach", "part").agg(F.bitmap_construct_agg("bit").alias("map")).collect(), key=lambda r: r["reach"]):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["map"], np.uint8), bitorder="little"))
            self.reach[(r["part"] << 15) + at] = r["reach"]

    def of(self, g: np.ndarray) -> np.ndarray:
        """For each hash, the bits of the longest item's length, 0 where no item is."""
        return self.reach[(g >> np.uint64(64 - self.bits)).astype(np.int64)]


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, df``: the number of rows of ``docs`` (``doc_id, text``) with each run of an item; runs in none are not listed."""
    table = Table(grams)

    def run(batches):
        for b in batches:
            for _, _, c in _chunks(b.column(0)):
                h, row = _words(c)
                for n in table.sizes:
                    g, whole = _grams(h, row, n)
                    at = np.flatnonzero(whole & (table.of(g) > 0))
                    pairs = np.unique(np.stack([row[at].astype(np.uint64), g[at]], 1), axis=0)
                    runs, count = np.unique(pairs[:, 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(count)], ["gram", "c"])

    found = docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("df"))
    return found.join(grams.select("gram").distinct(), "gram", "left_semi")


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``item_id, gram, n, place, length`` of the runs that search for their item: as many as it needs, the rarest."""
    with_df = grams.join(counts.withColumnRenamed("gram", "g"), F.col("gram") == F.col("g"), "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "gram", "place"))
    return with_df.withColumn("order", order).filter(F.col("order") <= F.col("seeds")).select("item_id", "gram", "n", "place", "length")


def _places(docs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """``doc_id, part, first, words, grams, places``: stretches of documents around seeds, as far to either side as an alignment of the longest item of their
    ranges of hashes can reach, joined where they meet; ``part`` numbers them over all documents."""
    table = Table(found)

    def run(batches):
        for b in batches if table.sizes else ():
            ids = b.column(0)
            for i, _, c in _chunks(b.column(1)):
                h, row = _words(c)
                hits, grams, far = [], [], []
                for n in table.sizes:
                    g, whole = _grams(h, row, n)
                    bits = table.of(g)
                    hit = np.flatnonzero(whole & (bits > 0))
                    longest = (1 << bits[hit].astype(np.int64)) - 1
                    hits.append(hit)
                    grams.append(g[hit])
                    far.append(np.ceil(longest * (3 - 2 * least)).astype(np.int64) + 2)  # the item and its gaps, see spare()
                at, grams, far = np.concatenate(hits), np.concatenate(grams), np.concatenate(far)
                if not len(at):
                    continue
                bounds = np.searchsorted(row, np.arange(c.rows + 1))
                begin, close = np.maximum(at - far, bounds[row[at]]), np.minimum(at + far, bounds[row[at] + 1])
                order = np.argsort(begin, kind="stable")
                at, grams, begin, close = at[order], grams[order], begin[order], close[order]
                reached = np.maximum.accumulate(close)
                head = np.flatnonzero(np.concatenate([[True], (begin[1:] > reached[:-1]) | (row[at[1:]] != row[at[:-1]])]))
                edge = np.append(head, len(at))
                first, last = begin[head], reached[edge[1:] - 1]
                size = last - first
                where = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                of = row[at[head]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(i + of)),
                        pa.array(first - bounds[of]),
                        _lists(h[where].view(np.int64), np.concatenate([[0], np.cumsum(size)])),
                        _lists(grams.view(np.int64), edge),
                        _lists((at - np.repeat(first, np.diff(edge))).astype(np.int32), edge),
                    ],
                    ["doc_id", "first", "words", "grams", "places"],
                )

    rows = docs.mapInArrow(run, "doc_id long, first long, words array<long>, grams array<long>, places array<int>")
    return rows.withColumn("part", F.monotonically_increasing_id())


def align(item: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of rows of word hashes, ``item`` (pairs x words) against ``places``, padded with 0 and 1: best score and the last word of it."""
    pairs, width = places.shape
    above = np.zeros((pairs, width + 1), np.int32)
    best, last = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    step = np.arange(width + 1, dtype=np.int32)
    for k in range(item.shape[1]):
        score = np.where(places == item[:, k, None], 2, -1).astype(np.int32)
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + step, axis=1) - step  # gaps in the item
        row_best = now.max(1)
        better = row_best > best
        last[better] = now[better].argmax(1) - 1
        best = np.maximum(best, row_best)
        above = now
    return best, last


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, item_id, score, end_word`` of every pair of a document and a test item that it holds, wholly or edited: the best alignment's share of the
    item's best possible score, and the document's word where it ends.

    Null and empty texts hold nothing, items without a word or an id are held by nothing; rows with null or repeated ids are found like others, once for each
    id and item. An empty table on either side gives no pair.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, _ = save(item_words(items), "items")
    grams, _ = save(item_grams(words, gram, least), "grams")
    found, _ = save(seeds(grams, gram_counts(rows, grams)), "seeds")
    stretches, path = save(_places(rows, found, least), "stretches")
    hits = stretches.select("part", F.explode(F.arrays_zip("grams", "places")).alias("s")).select("part", F.col("s.grams").alias("g"), F.col("s.places").alias("p"))
    where = F.col("p") - F.col("place")
    pairs = hits.join(found, F.col("g") == F.col("gram")).groupBy("part", "item_id").agg(F.min(where).alias("low"), F.max(where).alias("high"))
    cut = words.withColumnRenamed("words", "item").withColumnRenamed("item_id", "i")
    met = pairs.join(stretches.select(F.col("part").alias("s"), "doc_id", "first", "words"), F.col("part") == F.col("s")).join(cut, F.col("item_id") == F.col("i"))
    slack = F.ceil(F.size("item") * F.lit(2 - 2 * least)).cast("int") + 1  # not less than spare()
    start = F.greatest(F.col("low") - slack, F.lit(0))
    near = F.slice("words", start + 1, F.greatest(F.col("high") + F.size("item") + slack - start, F.lit(1)))
    rows = met.select("doc_id", "item_id", (F.col("first") + start).alias("from"), "item", near.alias("near"))

    def run(batches):
        for b in batches:
            ids, item_ids, start = b.column(0), b.column(1), b.column(2).to_numpy()
            item, near = ([x.values.to_numpy() for x in b.column(k)] for k in (3, 4))
            order = sorted(range(len(item)), key=lambda k: (len(near[k]), len(item[k])))
            score, last = np.zeros(len(item)), np.zeros(len(item), np.int64)
            at = 0
            while at < len(order):
                some = [order[at]]
                while at + len(some) < len(order) and len(near[order[at + len(some)]]) * (len(some) + 1) <= 1 << 18:
                    some.append(order[at + len(some)])
                at += len(some)
                a = np.zeros((len(some), max(len(item[k]) for k in some)), np.int64)
                w = np.ones((len(some), max(len(near[k]) for k in some)), np.int64)
                for r, k in enumerate(some):
                    a[r, : len(item[k])], w[r, : len(near[k])] = item[k], near[k]
                got, where = align(a, w)
                score[some], last[some] = got / (2 * np.array([len(item[k]) for k in some])), where
            keep = np.flatnonzero(score >= least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), item_ids.take(pa.array(keep)), pa.array(score[keep]), pa.array(start[keep] + last[keep])], ["doc_id", "item_id", "score", "end_word"])

    aligned = rows.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")
    best = aligned.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "end_word")).alias("b"))
    pairs_found, _ = save(best.select("doc_id", "item_id", "score", F.col("b.end_word").alias("end_word")), "contaminated")
    forget(docs.sparkSession, path)
    return pairs_found


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those of contaminated ids. Rows with a null id can't be told apart: if one is contaminated, all go."""
    bad = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, score, end_word`` of every contaminated document and the item that it holds. Null and empty texts hold nothing; rows with null or
    repeated ids count as one document, repeated rows too; of equal scores the earliest end is given; an empty table on either side gives no row."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
