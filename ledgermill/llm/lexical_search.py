"""Ranked lexical search for many items at once: what items share is summed up once for each document.

An item's score of a document is a sum over its terms, so term sets that several items hold need one partial sum, an accumulator. :func:`shared` mines them: the
pair of nodes (terms, or sets found before) that most items hold becomes a node of its own, again and again, which gives a directed graph of additions that all
items share. Documents are counted once: a row for each with the items' terms in it. Over these rows each task fills the accumulators of the terms for a block of
documents, adds along the graph, and keeps each item's best documents, so that only those are shuffled.

Items are taken in blocks of bounded size, each against all documents. What the driver sees is a block's distinct terms and their document counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWERED, Chunk, cut_rows, documents, row_chunks, save, text_buffer

TOP = 10
#: Items of a block at most, and their terms together (unless one item alone has more).
ITEMS, TERMS = 1024, 1 << 18
#: Nodes that a node is paired with, next to it in an item's order of frequency.
REACH = 16
#: Integers of the accumulators of a block of documents.
CELLS = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def terms(text: Column) -> Column:
    """Terms of a text in order, repeats included; of null none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """``(item, its different terms)`` in blocks; items come to the driver a partition at a time."""
    rows = items.select(F.col(id_col).cast("long"), F.array_distinct(terms(F.col(text_col).cast("string"))))
    block, held = [], 0
    for item, own in rows.toLocalIterator():
        if block and (len(block) == ITEMS or held + len(own) > TERMS):
            yield block
            block, held = [], 0
        block.append((item, own))
        held += len(own)
    if block:
        yield block


def shared(sets: list[set[int]], n: int, reach: int = REACH) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Node ``n + k`` is the sum of the two nodes of pair ``k``; nodes below ``n`` are terms. Also the nodes whose sum each set is. A pair becomes a node where two sets
    or more hold both, the most frequent first; pairs are counted among nodes near each other in the order of frequency, until none is shared."""
    own = [set(s) for s in sets]
    holders: dict[int, set[int]] = {}
    for k, s in enumerate(own):
        for t in s:
            holders.setdefault(t, set()).add(k)
    pairs: list[tuple[int, int]] = []
    while True:
        counts: Counter[tuple[int, int]] = Counter()
        for s in own:
            order = sorted((t for t in s if len(holders[t]) > 1), key=lambda t: (-len(holders[t]), t))
            for k, a in enumerate(order):
                counts.update((a, b) for b in order[k + 1 : k + 1 + reach])
        made = len(pairs)
        for (a, b), c in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if c < 2:
                break
            both = holders[a] & holders[b]
            if len(both) > 1:
                node = n + len(pairs)
                pairs.append((a, b))
                for k in both:
                    own[k] = own[k] - {a, b} | {node}
                holders[a] -= both
                holders[b] -= both
                holders[node] = set(both)
        if len(pairs) == made:
            return pairs, [sorted(s) for s in own]


def levels(pairs: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, first of each, second of each) in an order in which sums are there before they are used."""
    depth = [0] * n
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, (a, b) in enumerate(pairs):
        depth.append(1 + max(depth[a], depth[b]))
        found.setdefault(depth[-1], []).append((n + k, a, b))
    return [tuple(np.array(x) for x in zip(*found[d], strict=True)) for d in sorted(found)]


def _counted(vocabulary: np.ndarray):
    """Over ``doc_id, text``: ``doc_id, n``, the numbers of the vocabulary's terms in the text, and how often each is there. ``vocabulary``: sorted hashes."""

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(1))
            cuts, owner = cut_rows(buf, off, _BREAK)
            n, rows, which = np.zeros(b.num_rows, np.int64), [], []
            for i, j in row_chunks(cuts):
                part = LOWERED[buf[cuts[i] : cuts[j]]]
                chunk = Chunk(part, cuts[i : j + 1] - cuts[i])
                start, end = chunk.runs(~_BREAK[part])
                row = owner[i:j][chunk.row_of(start)]
                n += np.bincount(row, minlength=b.num_rows)
                if len(vocabulary):
                    h = chunk.hashes(start, end)
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    met = vocabulary[at] == h
                    rows.append(row[met])
                    which.append(at[met])
            key, tf = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64) * max(1, len(vocabulary)) + np.concatenate([*which, np.zeros(0, np.int64)]).astype(np.int64), return_counts=True)
            bounds = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * max(1, len(vocabulary))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def counted(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>")


def hashes(words: list[str]) -> np.ndarray:
    """The hashes by which :func:`counted` knows terms."""
    buf, off = text_buffer(pa.array(words, pa.string()))
    return Chunk(buf, off - off[0]).hashes(off[:-1] - off[0], off[1:] - off[0])


def length_part(n: np.ndarray, rows: int, total: int) -> np.ndarray:
    """What the length of a document adds below the line: 10 and 90 times its length over the mean one, rounded down."""
    if not total:
        return np.full(len(n), 10, np.int64)
    if 90 * int(n.max(initial=0)) * rows < 1 << 63:
        return 10 + 90 * n * rows // total
    return np.array([10 + 90 * x * rows // total for x in n.tolist()], np.int64)


def _best(item, score, doc, top):
    """The ``top`` first of each item: the highest score, then the least document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item, side="left") < top
    return item[keep], score[keep], doc[keep]


def _ranked(weight: np.ndarray, steps, sums: list[list[int]], nodes: int, rows: int, total: int, top: int):
    """Over counted documents: ``item`` (number in its block), ``doc_id, score`` of each item's best documents of the task."""
    n_terms = len(weight)
    asked = [k for k, s in enumerate(sums) if s]
    flat, starts = np.array([x for k in asked for x in sums[k]], np.int64), np.cumsum([0, *(len(sums[k]) for k in asked)])[:-1]
    step = max(8, min(1024, CELLS // max(1, nodes + len(flat))))
    last = np.int64((1 << 63) - 1)  # a document without an id comes last

    def run(batches):
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(len(sums), np.int64)  # a score below it can't be among the best
        for b in batches:
            ids = b.column(0).fill_null(last).to_numpy()
            n, off = b.column(1).to_numpy(), b.column(2).offsets.to_numpy()
            term, tf = b.column(2).values.to_numpy(), b.column(3).values.to_numpy().astype(np.int64)
            for at in range(0, b.num_rows if asked else 0, step):
                end = min(at + step, b.num_rows)
                mine = slice(off[at], off[end])
                doc = np.repeat(np.arange(end - at), np.diff(off[at : end + 1]))
                m = length_part(n[at:end], rows, total)[doc]
                sums_of = np.zeros((nodes, end - at), np.int64)
                sums_of[term[mine], doc] = weight[term[mine]] * (1_000_000_000 * tf[mine] // (1000 * tf[mine] + 8 * m))
                for node, one, other in steps:
                    sums_of[node] = sums_of[one] + sums_of[other]
                score = np.add.reduceat(sums_of[flat], starts, axis=0)
                i, d = np.nonzero(score >= least[asked][:, None])
                best = tuple(np.concatenate(x) for x in zip(best, (np.array(asked)[i], score[i, d], ids[at:end][d]), strict=True))
                best = _best(*best, top)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(sums)) == top)
                least[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2], mask=best[2] == last), pa.array(best[1])], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, block: list[tuple[int | None, list[str]]], id_col: str, text_col: str, top: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one block of items."""
    spark = docs.sparkSession
    words = sorted({t for _, own in block for t in own})
    h = hashes(words)
    order = np.argsort(h)
    number = {words[k]: p for p, k in enumerate(order.tolist())}
    stored, _ = save(counted(docs, h[order], id_col, text_col), "counted")
    rows, total = stored.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of the block
        df[r["t"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    pairs, sums = shared([{number[t] for t in own} for _, own in block], len(words))
    best = stored.mapInArrow(_ranked(weight, levels(pairs, len(words)), sums, len(words) + len(pairs), rows, total, top), "item long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "k long, item_id long")
    return ranked.join(names, F.col("item") == F.col("k")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents of a score above 0, the highest first, equal ones by ascending id.

    Null and empty texts have no term: such documents count for nothing, such items have no document. Repeated rows of documents rank each; of documents without
    an id all come last among equal scores; repeated rows of items, whatever their ids, are items each.
    """
    out = None
    for block in item_blocks(items, item_col, item_text):
        one = _block(docs, block, id_col, text_col, top)
        out = one if out is None else out.union(one)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, rank, doc_id, score`` of all benchmark items over all documents; edge cases as in :func:`ranked`. Without documents or items no row."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}'))) AS term FROM benchmark),
total AS (SELECT count(*) AS rows, sum(len(t)) AS n FROM d WHERE len(t) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(rows) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
m AS (SELECT row, doc_id, 10 + (90 * len(t) * rows) // total.n AS m FROM d, total WHERE len(t) > 0),
s AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""
