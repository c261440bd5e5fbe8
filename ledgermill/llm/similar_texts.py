"""Texts of a similarity of 0.8 or more in their sets of word shingles: SimHash ball hashing brings candidates, the sets themselves decide.

A fingerprint of 128 bits is the majority of a text's *different* shingles, so a shingle that is there a hundred times counts once. At a similarity of 0.8, some 15 %
of the bits differ, too many for a ball around all of them. So samples of the bits are ball-hashed: every fingerprint emits all variants within half of ``RADIUS`` bits of
its sample, what meets on a variant is compared on all 128 bits, and one link a row keeps together what is near. One sample is worked on after another, and its rows
are forgotten before the next, so disk holds one sample, however many a large table takes.

Links only say which texts to compare; each group of linked texts is then solved exactly:

- Of a small group, all pairs are compared.
- In a large one, every text is first compared with those in the middle of the group (nearest to the majority of all fingerprints), some rounds of them for what
  isn't joined yet. Then what is left apart is looked at again: two sets of this similarity share one of their first fifth of shingles, in any order of all
  shingles, in any order of all shingles, and behind the first that they share both have enough left; in an order by frequency, rarest first, common passages bring
  no pairs, nor do texts with too much of their own. Pairs that share one and aren't joined are compared, whoever they are.

So no pair of a group is missed, and work grows with rows as long as groups hang together or their texts are told apart by rare shingles.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_table, forget, has_bit, hashed_id, mix, runs, save, starts, text_key, word_hashes
from .components import components

SHINGLE, LEAST, RECALL, RADIUS = 5, 0.8, 0.95, 2
#: Fingerprints that meet on one variant and are compared with each other; texts of a group of which all pairs are compared.
CROWD, SMALL = 256, 64
#: Texts in the middle of a large group that all others are compared with, and how often new ones are taken.
LEADERS, ROUNDS = 4, 3
#: Columns of a set's parities, of 64 bits each.
PARITIES = tuple(f"odd{k}" for k in range(8))
#: Bits of the table of shingle frequencies by which shingles are ordered.
ORDER_BITS = 20
#: The only shingle of a text without words: such texts are alike.
NOTHING = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def differing(least: float) -> float:
    """The share of bits in which two texts of similarity ``least`` differ: the angle of their shingle vectors over pi."""
    return math.acos(2 * least / (1 + least)) / math.pi


def most_bits(bits: int, least: float) -> int:
    """Differing bits that two texts of similarity ``least`` stay within, but for one pair in a thousand."""
    p = differing(least)
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def sampling(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a sample, samples) for ``n`` fingerprints. A sample has so many bits that few unlike fingerprints meet on a variant of it, and there are so many samples
    that two texts of similarity ``least`` are within ``RADIUS`` bits in one of them with probability ``recall``; texts that are more alike, more often."""
    bits, p = min(60, max(12, n.bit_length() + 2)), differing(least)
    near = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - near))


def shingle_sets(h: np.ndarray, bounds: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different shingles, increasing in each row; where each row's begin and end) of rows of word hashes. Fewer words are one shingle, none is ``NOTHING``."""
    all_runs = runs(h, words)
    inside = starts(bounds, len(all_runs), words)
    value, owner = [all_runs[inside]], [np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(all_runs)][inside]]
    n = np.diff(bounds)
    for short in range(words):
        row = np.flatnonzero(n == short)
        value.append(runs(h, short)[bounds[row]] if short and len(row) else np.full(len(row), NOTHING))
        owner.append(row)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[: len(value)]
    return value[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def majority(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row, 64 bits that are set in more than half of its hashes."""
    rows = len(bounds) - 1
    ones = np.zeros((rows, 64), np.int64)
    for at in range(0, len(value), 1 << 16):
        part = value[at : at + (1 << 16)]
        begin = np.searchsorted(bounds[1:], at, side="right")
        end = np.searchsorted(bounds[:-1], at + len(part), side="left")
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[begin:end] += np.add.reduceat(bits, np.maximum(bounds[begin:end] - at, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1, bitorder="little").view("<i8")[:, 0] if rows else np.zeros(0, np.int64)


def _prints(words: int):
    """Over ``doc_id, text``: the text's key in 128 bits, and its fingerprint in as many."""

    def run(batches):
        for b in batches:
            for i, j, h, bounds in word_hashes(b.column(1), lower=True):
                value, own = shingle_sets(h, bounds, words)
                keys = np.array([text_key((t or "").encode()) for t in b.column(1).slice(i, j - i).to_pylist()], np.int64).reshape(-1, 2)
                columns = [b.column(0).slice(i, j - i), *(pa.array(x) for x in (keys[:, 0], keys[:, 1], majority(value, own), majority(mix(value ^ _OTHER), own)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "a", "b"])

    return run


def _near(radius: int, crowd: int):
    """Over fingerprints ``key, a, b`` sorted so: links ``u, v`` between the names of those that meet on a key, a row at most once a key. What is within ``radius`` bits,
    directly or by others, is linked; of a key with more than ``crowd`` rows, each row to the first."""

    def name(a, b):
        return mix(mix(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)

    def result(u, v):
        pairs = np.unique(np.stack([u, v], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def whole(key, a, b):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        few, first = np.repeat(size <= crowd, size), np.repeat(start, size)
        node = name(a, b)
        far = np.flatnonzero(~few & (first != np.arange(len(key))))
        if len(far):
            yield result(node[far], node[first[far]])
        ones, others = [], []
        at, k = np.flatnonzero(few), 1
        while len(at):
            at = at[at + k < len(key)]
            at = at[key[at] == key[at + k]]
            met = at[np.bitwise_count((a[at] ^ a[at + k]).view(np.uint64)) + np.bitwise_count((b[at] ^ b[at + k]).view(np.uint64)) <= radius]
            ones.append(met)
            others.append(met + k)
            k += 1
        one, other = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ones, others))
        if not len(one):
            return
        least = np.arange(len(key))
        while True:
            old = least.copy()
            np.minimum.at(least, one, least[other])
            np.minimum.at(least, other, least[one])
            least = least[least]
            if (least == old).all():
                break
        linked = np.flatnonzero(least != np.arange(len(key)))
        yield result(node[linked], node[least[linked]])

    def run(batches):
        held, star = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            if star is not None:
                n = int(np.searchsorted(held[0], star[0], side="right"))
                if n:
                    yield result(name(held[1][:n], held[2][:n]), np.full(n, star[1]))
                held = [h[n:] for h in held]
                if len(held[0]):
                    star = None
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield from whole(*(h[:last] for h in held))
            held = [h[last:] for h in held]
            if len(held[0]) > crowd:
                star = held[0][0], name(held[1][:1], held[2][:1])[0]
                yield from whole(*held)
                held = [h[:0] for h in held]
        yield from whole(*held)

    return run


def fingerprint_name(a: Column, b: Column) -> Column:
    """The name of a fingerprint in links, as tasks make it from its halves."""

    def names(x, y):
        return type(x)(mix(mix(x.to_numpy().view(np.uint64)) + y.to_numpy().view(np.uint64)).view(np.int64))

    return F.pandas_udf(names, "long")(a, b)


def candidate_links(prints: DataFrame, n: int, least: float = LEAST, recall: float = RECALL, crowd: int = CROWD) -> DataFrame:
    """``u, v``: links between names of stored, different ``a, b`` that join whatever meets by ball hashing."""
    spark = prints.sparkSession
    bits, samples = sampling(n, least, recall)
    rng = np.random.default_rng(17)
    flips = F.array(*[F.lit(m).cast("long") for k in range(RADIUS // 2 + 1) for m in (sum(1 << i for i in c) for c in itertools.combinations(range(bits), k))])
    found: list[DataFrame] = []
    for _ in range(samples):
        places = rng.permutation(128)[:bits].tolist()

        def values(batches, places=places):
            for batch in batches:
                half = [batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]
                out = np.zeros(batch.num_rows, np.uint64)
                for k, p in enumerate(places):
                    out |= (half[p >> 6] >> np.uint64(p & 63) & np.uint64(1)) << np.uint64(k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["a", "b", "value"])

        each = prints.select("a", "b").mapInArrow(values, "a long, b long, value long").select(F.explode(flips).alias("m"), "value", "a", "b")
        variants = each.select(F.col("value").bitwiseXOR(F.col("m")).alias("key"), "a", "b")
        links = variants.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(_near(most_bits(128, least), crowd), "u long, v long")
        found.append(save(links, "links")[0])
        spark.sparkContext._jvm.System.gc()  # the shuffle files of a sample go with the plan that made them
    return functools.reduce(DataFrame.union, found)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``wanted`` (stored, with the key of a text) with ``shingles``, the sorted 32-bit hashes of the text's different shingles."""
    keys, path = save(wanted.select("k1").mapInArrow(hashed_id, "h long"), "keys")
    table, bits = bit_table(keys, "h")

    def some(batches):
        known = np.unpackbits(table, bitorder="little").view(bool)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            k = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
            met = has_bit(known, bits, mix(k[:, 0].copy().view(np.uint64)))
            column, k = b.column(0).filter(pa.array(met)), k[met]
            for i, j, h, bounds in word_hashes(column, lower=True):
                value, own = shingle_sets(h, bounds, words)
                small = (value >> np.uint64(32)).astype("<u4")
                sets = [np.unique(small[a:b]).tobytes() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[i:j, 0]), pa.array(k[i:j, 1]), pa.array(sets, pa.binary())], ["k1", "k2", "shingles"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(some, "k1 long, k2 long, shingles binary")
    one = found.groupBy("k1", "k2").agg(F.first("shingles").alias("shingles"))  # of equal texts
    out, _ = save(one.join(wanted, ["k1", "k2"]).drop("k1", "k2"), "sets")
    forget(docs.sparkSession, path)
    return out


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted) have a Jaccard similarity of ``least`` or more."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common) - 1e-9


def _pairs_alike(least: float):
    """Over ``i, j`` and their sets: the pairs that are alike."""

    def run(batches):
        for b in batches:
            keep = pa.array([alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["i", "j"])

    return run


def _small_groups(least: float):
    """Over ``group, node, shingles`` by group: links that join what is alike within a group, by all pairs that aren't joined yet."""

    def solved(nodes, sets):
        root = list(range(len(nodes)))
        ones, others = [], []
        for i in range(len(nodes)):
            for j in range(i):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b and alike(sets[i], sets[j], least):
                    root[max(a, b)] = min(a, b)
                    ones.append(nodes[i])
                    others.append(nodes[j])
        return ones, others

    def run(batches):
        group, nodes, sets = None, [], []
        for b in batches:
            ones, others = [], []
            for g, node, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    for out, more in zip((ones, others), solved(nodes, sets), strict=True):
                        out += more
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(np.frombuffer(s, "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(others, pa.int64())], ["i", "j"])
        ones, others = solved(nodes, sets)
        yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(others, pa.int64())], ["i", "j"])

    return run


def _bit_sums(batches):
    """Over ``group, a, b``: for each group of a batch and each bit of the fingerprints, in how many it is set, and their number."""
    for b in batches:
        group, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
        n, ones = np.bincount(at), np.zeros((len(group), 128), np.int64)
        for k in (1, 2):
            bits = np.unpackbits(b.column(k).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            order = np.argsort(at, kind="stable")
            if len(group):
                ones[:, (k - 1) * 64 : k * 64] = np.add.reduceat(bits[order], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group, 128)), pa.array(np.tile(np.arange(128), len(group))), pa.array(ones.ravel()), pa.array(np.repeat(n, 128).astype(np.int64))], ["group", "place", "ones", "n"])


def _middle(rows: DataFrame, leaders: int) -> DataFrame:
    """``group, leader, l_shingles``: of each group's ``rows``, those nearest to the majority of all its fingerprints."""
    sums = rows.select("group", "a", "b").mapInArrow(_bit_sums, "group long, place long, ones long, n long").groupBy("group", "place").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    half = lambda at: F.sum(F.when((F.col("place") >= at) & (F.col("place") < at + 64) & (2 * F.col("ones") > F.col("n")), bit).otherwise(0))
    centre = sums.groupBy(F.col("group").alias("g")).agg(half(0).alias("ca"), half(64).alias("cb"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("ca"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("cb")))
    order = F.row_number().over(Window.partitionBy("group").orderBy("apart", "node"))
    near = rows.join(centre, F.col("group") == F.col("g")).withColumn("apart", apart).select("group", "node", "apart").withColumn("order", order).filter(F.col("order") <= leaders)
    chosen = near.select(F.col("node").alias("leader"))
    return rows.join(chosen, F.col("node") == F.col("leader")).select(F.col("group").alias("l_group"), "leader", F.col("shingles").alias("l_shingles"))


def _frequencies(sets: DataFrame, bits: int = ORDER_BITS) -> np.ndarray:
    """How many shingles of the sets fall into each of 2**``bits`` ranges of hashes: at most so many rows come to the driver."""

    def run(batches):
        n = np.zeros(1 << bits, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                np.add.at(n, np.frombuffer(s, "<u4") >> np.uint32(32 - bits), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    out = np.zeros(1 << bits, np.int64)
    for r in sets.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set of hashes, for each of 512 classes of them, whether it has an odd number, as 8 integers. Two sets differ in as many elements at least as in bits."""
    out = np.zeros((len(sets), 64 * len(PARITIES)), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount((mix(s.astype(np.uint64)) % np.uint64(len(row))).astype(np.int64), minlength=len(row)) & 1
    return np.packbits(out, axis=1, bitorder="little").view("<i8").reshape(len(sets), len(PARITIES)).astype(np.int64)


def _prefixes(frequency: np.ndarray, least: float):
    """Over ``group, node, root, shingles``: a row for each of the first shingles by frequency, as many as two sets that are alike can't both lack, how many are
    left from it on, and the set's :func:`parities`."""
    shift = np.uint32(33 - len(frequency).bit_length())

    def run(batches):
        for b in batches:
            found = []
            for g, s in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = np.frombuffer(s, "<u4")
                first = s[np.lexsort((s, frequency[s >> shift]))][: len(s) - math.ceil(least * len(s) - 1e-9) + 1]
                found.append(mix(first.astype(np.uint64) ^ mix(np.array([g], np.int64).view(np.uint64))).view(np.int64))
            n = np.array([len(x) for x in found], np.int64)
            sizes = np.repeat(np.array([len(s) // 4 for s in b.column(3).to_pylist()], np.int64), n)
            left = sizes - (np.arange(len(sizes)) - np.repeat(np.cumsum(n) - n, n))
            odd = parities([np.frombuffer(s, "<u4") for s in b.column(3).to_pylist()])
            columns = [np.concatenate([*found, np.zeros(0, np.int64)]), sizes, left, *(np.repeat(x, n) for x in (b.column(1).to_numpy(), b.column(2).to_numpy(), *odd.T))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "size", "left", "node", "root", *PARITIES])

    return run


def _apart(least: float, all_pairs: bool):
    """Over ``key, size, left, node, root`` and parities, sorted so: pairs of a key of different roots that can be alike if the key is the first shingle that they share,
    and by the elements in which they differ at least; each row's last one before it (of which a row's first is taken, so that most are joined before all are looked at),
    or all."""

    def can(size, left, other, other_left):
        """Two sets of these sizes need this many shingles in common."""
        return np.minimum(left, other_left) >= least / (1 + least) * (size + other) - 1e-9

    def near(size, odd, i, j):
        """Those of the pairs ``i, j`` whose parities leave them enough in common."""
        differ = sum((np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in odd), np.zeros(len(i), np.int64))
        keep = (size[i] + size[j] - differ) / 2 >= least / (1 + least) * (size[i] + size[j]) - 1e-9
        return i[keep], j[keep]

    def pairs(size, left, node, root, *odd):
        if all_pairs:
            step = max(1, (1 << 20) // len(node))
            for at in range(0, len(node), step):
                s, f, n, r = (x[at : at + step] for x in (size, left, node, root))
                i, j = np.nonzero((r[:, None] != root[None, :]) & (n[:, None] < node[None, :]) & can(s[:, None], f[:, None], size[None, :], left[None, :]))
                i, j = near(size, odd, i + at, j)
                yield node[i], node[j]
        else:
            start = np.concatenate([[True], root[1:] != root[:-1]])
            last = np.maximum.accumulate(np.where(start, np.arange(len(node)), 0)) - 1
            i = np.flatnonzero(last >= 0)
            i = i[can(size[i], left[i], size[last[i]], left[last[i]])]
            i, j = near(size, odd, i, last[i])
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def whole(key, *columns):
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        for part in zip(*(np.split(c, cut) for c in columns), strict=True):
            if len(part[0]):
                for i, j in pairs(*part):
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["i", "j"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * (5 + len(PARITIES))
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
            yield from whole(*(h[:last] for h in held))
            held = [h[last:] for h in held]
        yield from whole(*held)

    return run


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    side = lambda name: sets.select(F.col("node").alias(f"__{name}"), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("i"), F.col("i") == F.col("__i")).join(side("j"), F.col("j") == F.col("__j"))
    return save(both.select("i", "j", "s_i", "s_j").mapInArrow(_pairs_alike(least), "i long, j long"), "alike")[0]


def _large_groups(sets: DataFrame, least: float) -> DataFrame:
    """Links ``i, j`` that join whatever is alike in groups of any size: stored ``group, node, a, b, shingles``."""
    spark = sets.sparkSession
    good: DataFrame = spark.createDataFrame([], "i long, j long")
    open_, path = save(sets, "open")
    for _ in range(ROUNDS):
        leaders, _ = save(_middle(open_, LEADERS), "leaders")
        met = open_.join(leaders, (F.col("group") == F.col("l_group")) & (F.col("node") != F.col("leader")))
        now, _ = save(met.select(F.col("leader").alias("i"), F.col("node").alias("j"), "l_shingles", "shingles").mapInArrow(_pairs_alike(least), "i long, j long"), "alike")
        good = good.union(now)
        done = now.select(F.col("j").alias("n")).union(leaders.select("leader")).distinct()
        old = path
        open_, path = save(open_.join(done, F.col("node") == F.col("n"), "left_anti"), "open")
        forget(spark, old)
        if open_.isEmpty():
            break
    forget(spark, path)
    frequency = None
    for all_pairs in (False, True):
        roots, _ = save(components(good), "roots")
        named = sets.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("group", "node", F.coalesce("root", "node").alias("root"), "shingles")
        several = named.groupBy(F.col("group").alias("g")).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("g")
        apart, apart_path = save(named.join(several, F.col("group") == F.col("g"), "left_semi"), "apart")
        if apart.isEmpty():
            break
        if frequency is None:
            frequency = _frequencies(apart.select("shingles"))
        lists, lists_path = save(apart.mapInArrow(_prefixes(frequency, least), "key long, size long, left long, node long, root long, " + ", ".join(f"{p} long" for p in PARITIES)), "lists")
        mixed = lists.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("k")
        rows = lists.join(mixed, F.col("key") == F.col("k"), "left_semi").repartition("key").sortWithinPartitions("key", "size", "node")
        near = rows.mapInArrow(_apart(least, all_pairs), "i long, j long")
        pairs, pairs_path = save(near.distinct() if all_pairs else near.groupBy("j").agg(F.min("i").alias("i")).select("i", "j"), "pairs")
        good = good.union(_compared(pairs, sets, least))
        for p in (apart_path, lists_path, pairs_path):
            forget(spark, p)
    return good


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = LEAST, recall: float = RECALL, crowd: int = CROWD, small: int = SMALL) -> DataFrame:
    """``doc_id, component_id`` of every row: the least id that it reaches over links of texts whose sets of shingles have a Jaccard similarity of ``least`` or more (of
    32-bit hashes). Fingerprints bring two such texts into one group with probability ``recall`` or more; in a group nothing is missed, and nothing unlike is linked.

    Null texts and texts without a word are alike; equal texts are one. Repeated ids are kept; rows with a null id are linked too, and name a component only by
    others' ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored, _ = save(rows.mapInArrow(_prints(words), "doc_id long, k1 long, k2 long, a long, b long"), "fingerprints")
    texts = stored.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("a").alias("a"), F.min("b").alias("b"))
    nodes, _ = save(texts.withColumns({"node": F.monotonically_increasing_id(), "name": fingerprint_name(F.col("a"), F.col("b"))}), "nodes")
    prints, prints_path = save(nodes.select("a", "b").distinct(), "prints")
    groups, groups_path = save(components(candidate_links(prints, prints.count(), least, recall, crowd)), "groups")
    forget(spark, prints_path)
    grouped = nodes.join(groups, nodes["name"] == groups["node"], "left").select(nodes["node"], "k1", "k2", "a", "b", F.coalesce("root", "name").alias("group"))
    sizes = grouped.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    wanted, wanted_path = save(grouped.join(sizes, F.col("group") == F.col("g")).drop("g"), "wanted")
    sets = _sets(docs, wanted, id_col, text_col, words)
    for p in (groups_path, wanted_path):
        forget(spark, p)
    few = sets.filter(F.col("members") <= small).select("group", "node", "shingles").repartition("group").sortWithinPartitions("group")
    links, _ = save(few.mapInArrow(_small_groups(least), "i long, j long"), "alike")
    many = sets.filter(F.col("members") > small)
    if not many.isEmpty():
        links = links.union(_large_groups(many.select("group", "node", "a", "b", "shingles"), least))
    roots, _ = save(components(links), "roots")
    with_root = nodes.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root"))
    least_id = with_root.groupBy(F.col("root").alias("c")).agg(F.min("first").alias("component_id"))
    found = with_root.join(least_id, F.col("root") == F.col("c")).select(F.col("k1").alias("x"), F.col("k2").alias("y"), "component_id")
    return stored.join(found, (F.col("k1") == F.col("x")) & (F.col("k2") == F.col("y"))).select("doc_id", "component_id")
