"""Passages that another document has already: confirmed by hashes, located by Aho-Corasick automata over words.

A window is ``WINDOW`` consecutive words. Of the phrases of ``ANCHOR`` words in a window, the one of the least hash is its anchor; windows that are equal have
equal anchors, and neighbouring windows mostly share theirs, so the anchors of all texts are a sixteenth of their words. Texts with an anchor that another text has
are candidates, and of these the windows with such anchors are hashed in 128 bits and grouped, which confirms what recurs and where it is first.

Windows that always follow one another (whatever follows the first is the same everywhere, and both occur equally often) are one passage: whoever has a window
of it has it all. A passage is cut out of the document that has it first and sent to every block of documents that has its first window. There an automaton over
the passages of the block, in shards of a bounded number of words, reads the documents and finds every occurrence by the words themselves.

So equal hashes only nominate, and what crosses the network follows the repeated text: candidates twice, passages once for each block that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bit_table, cut_rows, documents, forget, has_bit, hashed_id, mix, runs, save, starts, text_key, word_hashes

WINDOW, ANCHOR = 50, 20
#: Windows of a passage, words of an automaton, bytes of text that a block of documents has on average, and that are split into words at once.
LONGEST, SHARD_WORDS, BLOCK_BYTES, PIECE = 4096, 200_000, 4 << 20, 1 << 19
#: Where a row without an id stands: behind all others.
LAST = (1 << 63) - 1


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about ``PIECE`` bytes at a time."""
    off, _ = cut_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64), SPACE, PIECE)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield text[a:b].split()


def kept_digest(text: bytes, gone: np.ndarray | None = None) -> str:
    """SHA-256 of the words that stay, joined by one space."""
    h, at, first = hashlib.sha256(), 0, True
    for words in pieces(text):
        stay = words if gone is None else [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
        at += len(words)
        if stay:
            h.update((b"" if first else b" ") + b" ".join(stay))
            first = False
    return h.hexdigest()


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The least phrase hash of the window that begins at each word."""
    least, width, want = runs(h, anchor), 1, window - anchor + 1
    while 2 * width <= want:
        least = np.minimum(least[width:], least[:-width])
        width *= 2
    rest = want - width
    return np.minimum(least[rest:], least[: len(least) - rest]) if rest else least


def _lists(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Values at increasing places, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pa.array(values))


def _measured(batches):
    """Over ``id, text``: the text's key in 128 bits, its number of words, the digest of all of them, and its anchors."""
    for b in batches:
        for i, j, h, bounds in word_hashes(b.column(1)):
            a = anchors(h)
            inside = starts(bounds, len(a), WINDOW)
            new = inside & np.concatenate([[True], (a[1:] != a[:-1]) | ~inside[:-1]])[: len(a)] if len(a) else inside
            at = np.flatnonzero(new)
            texts = [(x or "").encode() for x in b.column(1).slice(i, j - i).to_pylist()]
            keys = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
            columns = [b.column(0).slice(i, j - i), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.diff(bounds)), pa.array([kept_digest(t) for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(a[at].view(np.int64), at, bounds)], ["id", "k1", "k2", "n_words", "kept", "n_bytes", "anchors"])


def _with_key(table: np.ndarray, bits: int):
    """Over ``id, text``: the rows whose id's bit is set, with their text's key."""

    def run(batches):
        known = np.unpackbits(table, bitorder="little").view(bool)
        for b in batches:
            b = b.filter(pa.array(has_bit(known, bits, mix(b.column(0).to_numpy().view(np.uint64)))))
            keys = np.array([text_key((x or "").encode()) for x in b.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), b.column(1)], ["id", "k1", "k2", "text"])

    return run


def candidates(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """``id, k1, k2, text, anchors``: each different text that has an anchor of another one, once, under its least id, and which of its anchors others have."""
    pairs, path = save(measured.select("id", "k1", "k2", F.explode("anchors").alias("h")).groupBy("h", "k1", "k2").agg(F.min("id").alias("id")), "anchors")
    common = pairs.groupBy(F.col("h").alias("common")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("common")
    marks = pairs.join(common, F.col("h") == F.col("common")).groupBy("k1", "k2").agg(F.min("id").alias("id"), F.collect_list("h").alias("anchors"))
    marks, marks_path = save(marks, "marks")
    forget(docs.sparkSession, path)
    ids, ids_path = save(marks.select("id").mapInArrow(hashed_id, "h long"), "ids")
    some = docs.mapInArrow(_with_key(*bit_table(ids, "h")), "id long, k1 long, k2 long, text string")
    one = some.groupBy("id", "k1", "k2").agg(F.first("text").alias("text"))  # of repeated rows
    found, _ = save(one.join(marks, ["id", "k1", "k2"]), "candidates")
    for p in (ids_path, marks_path):
        forget(docs.sparkSession, p)
    return found


def _windows(first: tuple[np.ndarray, int] | None = None):
    """Over candidates: ``w1, w2`` of each window with an anchor that others have, where it begins and the hash of the word after it (0: none). With a bit table:
    ``w1, w2, id, k1`` of those whose bit is set."""

    def run(batches):
        known = None if first is None else np.unpackbits(first[0], bitorder="little").view(bool)
        for b in batches:
            ids, k1, wanted = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4)
            for i, j, h, bounds in word_hashes(b.column(3)):
                a = anchors(h)
                own = wanted.slice(i, j - i)
                inside = starts(bounds, len(a), WINDOW) & np.isin(a, own.flatten().to_numpy().view(np.uint64))
                at = np.flatnonzero(inside)
                row = np.searchsorted(bounds, at, side="right") - 1
                w1 = runs(h, WINDOW)[at].view(np.int64)
                if known is not None:
                    met = has_bit(known, first[1], w1)
                    at, row, w1 = at[met], row[met], w1[met]
                w2 = runs(mix(h ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)[at].view(np.int64)
                columns = [pa.array(w1), pa.array(w2), pa.array(ids[i:j][row]), pa.array(k1[i:j][row])]
                if known is not None:
                    yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "id", "k1"])
                    continue
                after = np.where(at + WINDOW < bounds[row + 1], np.append(h, np.uint64(0))[np.minimum(at + WINDOW, len(h))], np.uint64(0))
                yield pa.RecordBatch.from_arrays([*columns, pa.array((at - bounds[row]).astype(np.int32)), pa.array(after.view(np.int64))], ["w1", "w2", "id", "k1", "pos", "next"])

    return run


def recurring(found: DataFrame) -> DataFrame:
    """``w1, w2, id, k1, pos, n, same``: each window that documents of different ids have, where it is first, how often it occurs, and whether the same follows it
    everywhere."""
    windows = found.mapInArrow(_windows(), "w1 long, w2 long, id long, k1 long, pos int, next long")
    place = F.min(F.struct("id", "k1", "pos")).alias("place")
    grouped = windows.groupBy("w1", "w2").agg(place, F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), (F.min("next") == F.max("next")).alias("same"))
    return grouped.filter("last > place.id").select("w1", "w2", "place.*", "n", "same")


def _chained(batches):
    """Over recurring windows by ``id, k1, pos``: passages, each with its first window's hash, its place and the number of its windows."""
    names = ["id", "k1", "pos", "w1", "w2"]
    held: list | None = None  # the passage that may go on: its row and its number of windows
    before: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        col = {name: b.column(name).to_numpy(zero_copy_only=False) for name in (*names, "n", "same")}
        prior = {name: np.concatenate([[before[k]] if before else x[:1], x[:-1]]) for k, (name, x) in enumerate(col.items())}
        follows = (col["id"] == prior["id"]) & (col["k1"] == prior["k1"]) & (col["pos"] == prior["pos"] + 1) & (col["n"] == prior["n"]) & prior["same"].astype(bool)
        follows[0] &= before is not None
        before = tuple(x[-1] for x in col.values())
        at = np.flatnonzero(~follows)
        size = np.diff(np.append(at, b.num_rows))
        lead = int(at[0]) if len(at) else b.num_rows  # windows that go on with the passage of the last batch
        out = []
        if held is not None:
            held[1] += lead
            if len(at):
                out.append(held)
        out += [[tuple(col[x][k] for x in names), int(s)] for k, s in zip(at.tolist(), size.tolist(), strict=True)]
        if len(at):
            held = out.pop()
        if out:
            yield _passage_rows(out)
    if held is not None:
        yield _passage_rows([held])


def _passage_rows(found: list) -> pa.RecordBatch:
    columns = [pa.array(x) for x in zip(*(row for row, _ in found), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in found], pa.int64())], ["id", "k1", "pos", "w1", "w2", "windows"])


def _cut(batches):
    """Over candidates with ``passages``: ``w1, w2, source, words`` of each."""
    for b in batches:
        for source, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            rows = [(p["w1"], p["w2"], source, b" ".join(words[p["pos"] : p["pos"] + p["windows"] + WINDOW - 1]).decode()) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["w1", "w2", "source", "words"])


class Automata:
    """Passages of words with the ids of their sources, in automata of at most ``shard_words`` words each (but a longer passage alone). Words are numbered by a
    shard's own dictionary, so an occurrence is one of words, not of hashes."""

    def __init__(self, passages: list[tuple[list[bytes], int]], shard_words: int = SHARD_WORDS):
        self.shards: list[tuple[ahocorasick.Automaton, dict[bytes, int]]] = []
        size = shard_words
        for words, source in passages:
            if size + len(words) > shard_words:
                self.shards.append((ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}))
                size = 0
            automaton, numbers = self.shards[-1]
            automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), (len(words), source))
            size += len(words)
        for automaton, _ in self.shards:
            automaton.make_automaton()

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, source) of every occurrence."""
        for automaton, numbers in self.shards:
            at = automaton.iter(())
            for words in pieces(text):
                at.set(tuple(numbers.get(w, 0) for w in words), False)
                for last, (n, source) in at:
                    yield last - n + 1, last + 1, source


def _located(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
    """Of a block's documents and passages: ``id, k1, n_removed, kept`` of the documents that lose words."""
    automata = Automata([(w.encode().split(), s) for w, s in zip(passages["words"].to_pylist(), passages["source"].to_pylist(), strict=True)])
    out = []
    for i, k1, n, text in zip(*(docs[c].to_pylist() for c in ("id", "k1", "n_words", "text")), strict=True) if automata.shards else ():
        text = text.encode()
        edge = np.zeros(n + 1, np.int64)
        for a, b, source in automata.occurrences(text):
            if source < i:
                edge[a] += 1
                edge[b] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        if gone.any():
            out.append((i, k1, int(gone.sum()), kept_digest(text, gone)))
    names, kinds = ("id", "k1", "n_removed", "kept"), (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({name: pa.array([r[k] for r in out], kinds[k]) for k, name in enumerate(names)})


def _counted(batches):
    """``id, k1, text`` and the number of words."""
    for b in batches:
        n = np.concatenate([*(np.diff(bounds) for *_, bounds in word_hashes(b.column(2))), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], ["id", "k1", "text", "n_words"])


def removed(docs: DataFrame, measured: DataFrame, block_bytes: int = BLOCK_BYTES, longest: int = LONGEST) -> DataFrame:
    """``id, k1, n_removed, kept`` of each different text (under its least id) that has a window of a document of a smaller id; ``docs`` as ``id, text``."""
    spark = docs.sparkSession
    found = candidates(docs, measured)
    windows, windows_path = save(recurring(found), "windows")
    lined = windows.select("id", "k1", "pos", "w1", "w2", "n", "same").repartition("id", "k1").sortWithinPartitions("id", "k1", "pos")
    chains = lined.mapInArrow(_chained, "id long, k1 long, pos int, w1 long, w2 long, windows long")
    chains, chains_path = save(chains, "chains")
    forget(spark, windows_path)
    # long passages in parts, which overlap by all but one word of a window; a part is found by its own first window
    parts = chains.filter(F.col("windows") <= longest)
    long = chains.filter(F.col("windows") > longest)
    if not long.isEmpty():
        more = found.join(long.select("id", "k1", "pos", "windows"), ["id", "k1"]).select("id", "k1", "k2", "text", "anchors", "pos", "windows").mapInArrow(_parts(longest), "id long, k1 long, pos int, w1 long, w2 long, windows long")
        parts = parts.union(more)
    passages, passages_path = save(parts, "passages")
    forget(spark, chains_path)
    by_text = passages.groupBy("id", "k1").agg(F.collect_list(F.struct("pos", "windows", "w1", "w2")).alias("passages"))
    cut, _ = save(found.select("id", "k1", "text").join(by_text, ["id", "k1"]).select("id", "text", "passages").mapInArrow(_cut, "w1 long, w2 long, source long, words string"), "cut")
    # which blocks have the first window of a passage
    blocks = max(1, (found.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes)
    block = F.pmod(F.xxhash64("id", "k1"), F.lit(blocks)).alias("block")
    met = found.mapInArrow(_windows(bit_table(passages, "w1")), "w1 long, w2 long, id long, k1 long")
    where = met.groupBy("w1", "w2", block).agg(F.max("id").alias("last"))
    sent = where.join(cut, ["w1", "w2"]).filter("last > source").select("block", "source", "words")
    texts = found.select("id", "k1", "text").mapInArrow(_counted, "id long, k1 long, text string, n_words long").select(block, "id", "k1", "n_words", "text")
    out, _ = save(texts.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_located, "id long, k1 long, n_removed long, kept string"), "removed")
    forget(spark, passages_path)
    return out


def _parts(longest: int):
    """Over candidates with a passage of more than ``longest`` windows (``pos, windows``): its parts."""

    def run(batches):
        for b in batches:
            for k, (_, _, h, _) in enumerate(one for r in range(b.num_rows) for one in word_hashes(b.column(3).slice(r, 1))):
                pos, n = b.column(5)[k].as_py(), b.column(6)[k].as_py()
                at = np.arange(pos, pos + n, longest)
                w1, w2 = (runs(x, WINDOW)[at].view(np.int64) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))))
                same = [pa.array(np.full(len(at), b.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(np.minimum(longest, pos + n - at))], ["id", "k1", "pos", "w1", "w2", "windows"])

    return run


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row: its words, those in a window of ``WINDOW`` words that a document of a smaller id has too, and a
    digest of the others.

    Null and empty texts have no words. Rows of equal ids don't lose to each other, repeated rows keep a row each. Rows without an id lose to all that have one and
    not to each other. Of equal texts all but those of the least id go whole, if they have a window at all.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    measured, _ = save(named.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text").mapInArrow(_measured, "id long, k1 long, k2 long, n_words long, kept string, n_bytes long, anchors array<long>"), "measured")
    gone = removed(rows, measured, block_bytes, longest).withColumnsRenamed({"id": "g_id", "k1": "g_k1", "kept": "g_kept"})
    several = measured.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("most > least").drop("most")
    own = measured.select("id", "k1", "k2", "n_words", "kept")
    all_rows = own.join(several, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").join(gone, (F.col("id") == F.col("g_id")) & (F.col("k1") == F.col("g_k1")), "left")
    copy = (F.col("id") > F.col("least")) & (F.col("n_words") >= WINDOW)
    none = hashlib.sha256(b"").hexdigest()
    n, kept = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))), F.when(copy, none).otherwise(F.coalesce("g_kept", "kept"))
    return all_rows.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", n.alias("n_removed"), kept.alias("kept_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of all documents; edge cases as in :func:`without_passages`. An empty table gives no row."""
    return without_passages(documents(spark, sf_dir))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d)),
gone AS (SELECT DISTINCT row, unnest(range(s, s + {WINDOW})) AS p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (row, p) GROUP BY row),
lost AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (row) LEFT JOIN kept USING (row)"""
