"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Suffix arrays over all text would sort mostly what is unique, so text
is first cut down, without loss, to where repeats can be, and then suffix arrays decide:

1. Every string of ``LENGTH`` bytes has an anchor, the least of its ``GRAM``-byte hashes (leftmost of ties), which equal strings share. Consecutive starts
   with one anchor form a context: the bytes that their strings cover, some 260 for 60 starts. An anchor that occurs once in all documents has no repeat.
2. Contexts are the same if 128 bits of their SHA-256 are, and are worked on once; texts likewise. Of a context in two places or more, two go on.
3. Contexts go, by anchor, to shards of bounded size. Each shard sorts its suffixes by Larsson-Sadakane refinement in numpy; common prefixes of neighbours
   follow from Kasai's rule, and a start is repeated if it shares ``LENGTH`` bytes with a neighbour. Nothing else makes a start repeated, but for step 4.
4. An anchor with more than ``CROWD`` contexts is dealt to several shards. Each cuts its sorted strings at limits that all shards of the anchor share;
   slices between the same limits meet and are merged two by two by binary search, comparing bytes. A string of two shards is repeated.
5. What is found goes back to all places of a context, and each document is cut in its task. A text that occurs twice goes whole if it has ``LENGTH`` bytes.

Texts are cut into blocks that overlap by ``LENGTH - 1`` bytes, each with its own starts, so a task never works on more than a block of a long text.

Nulls and edge cases: a null text is empty; null and repeated ids are kept, a row each; repeated rows are repeats of each other; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, bit_table, documents, forget, has_bit, save, text_chunks

LENGTH, GRAM, CROWD, BLOCK = 200, 80, 1024, 1 << 20
#: Bytes of contexts that a task sorts, block by block, and strings in a row of a slice.
SHARD_BYTES, SLICE = 8 << 20, 4096
#: Bytes of short texts that numpy works on at once, so that its arrays stay in a core's cache.
GROUP = 1 << 18

_MARK = np.uint64(0xFFFFFF)
_APART = bytes.maketrans(b"01234567", bytes(range(0xF5, 0xFD)))


def contexts(c: Chunk, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first start, starts, anchor) of every context; places count from the chunk's first byte."""
    n = len(c.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    h = c.rolling(gram)
    least = h & ~_MARK
    least |= np.arange(len(h), dtype=np.uint64)  # ties go to the left; a chunk is shorter than 2**24
    width, window = 1, length - gram + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    place = (least & _MARK).astype(np.int64)  # of the anchor of the string that starts here
    size = np.diff(c.off)
    whole = np.zeros(len(place), bool)  # starts with a string inside their row
    for i in np.flatnonzero(size >= length).tolist():
        whole[c.off[i] : c.off[i + 1] - length + 1] = True
    edge = np.append(np.flatnonzero(np.diff(place)) + 1, c.off[:-1][size >= length])
    new = np.zeros(len(place), bool)
    new[edge] = True
    first = np.flatnonzero(new & whole)
    ends = np.minimum(np.append(first[1:], len(place)), c.off[c.row_of(first) + 1] - length + 1)
    return c.row_of(first), first, ends - first, h[place[first]].view(np.int64)


def blocks(rows: DataFrame, length: int, block: int) -> DataFrame:
    """``key, at, raw`` of rows ``key, text``: the bytes from each multiple ``at`` of ``block`` on, with those that strings starting there reach into."""
    raw, n = F.col("text").cast("binary"), F.octet_length("text")
    cuts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / block), F.lit(0)).cast("int"))
    parts = rows.filter(n >= length).select("key", n.alias("n"), raw.alias("raw"), F.explode(cuts).alias("k"))
    part = F.when(F.col("n") <= block, F.col("raw")).otherwise(F.substring("raw", F.col("k") * block + 1, F.lit(block + length - 1)))
    return parts.select("key", (F.col("k").cast("long") * block).alias("at"), part.alias("raw"))


def repeated_anchors(parts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """``a``: the anchors of two contexts or more, those of repeated texts too."""

    def run(batches):
        for b in batches:
            for _, _, c in text_chunks(b.column(0), min(block, GROUP)):
                anchor, n = np.unique(contexts(c, length, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    found = parts.select("raw").mapInArrow(run, "anchor long, n long")
    return found.groupBy(F.col("anchor").alias("a")).agg(F.sum("n").alias("c")).filter("c > 1").select("a")


def occurrences(parts: DataFrame, again: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """``anchor, digest, key, lo, starts`` of every context of a repeated anchor."""
    table, bits = bit_table(again, "a")

    def run(batches):
        known = np.unpackbits(table, bitorder="little").view(bool)
        for b in batches:
            keys, base = b.column(0), b.column(1).to_numpy()
            for i, _, c in text_chunks(b.column(2), min(block, GROUP)):
                row, first, starts, anchor = contexts(c, length, gram)
                some = np.flatnonzero(has_bit(known, bits, anchor))
                row, first, starts, anchor = row[some], first[some], starts[some], anchor[some]
                raw = c.buf.tobytes()
                digests = [hashlib.sha256(raw[s:e]).digest()[:16] for s, e in zip(first.tolist(), (first + starts + length - 1).tolist(), strict=True)]
                lo = base[i + row] + first - c.off[row]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digests, pa.binary()), keys.take(pa.array(i + row)), pa.array(lo), pa.array(starts.astype(np.int32))], ["anchor", "digest", "key", "lo", "starts"])

    found = parts.mapInArrow(run, "anchor long, digest binary, key binary, lo long, starts int")
    return found.join(again, F.col("anchor") == F.col("a")).drop("a")


def suffix_array(text: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Suffix order of bytes by Larsson-Sadakane refinement: each round doubles the sorted depth and sorts only groups that aren't single yet. With ``enough``,
    suffixes that share so many bytes may stay in any order."""
    n = len(text)
    symbol = np.cumsum(np.bincount(text, minlength=256) > 0)[text]  # from 1 on
    bits = max(1, int(symbol.max(initial=1)).bit_length())
    depth = 63 // bits
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(n - k, 0)] += symbol[k:]
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n + 1, np.int64)  # from 1 on; 0 is the end
    rank[n] = 0
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n))) + 1
    single = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~single)
    width = n.bit_length()
    while len(open_) and (enough is None or depth < enough):
        suffix = order[open_]
        pair = rank[suffix] << width | rank[np.minimum(suffix + depth, n)]
        if 3 * width < 64:  # the suffix fits below the pair, and plain sorting is faster
            pair = np.sort(pair << width | suffix)
            suffix, pair = pair & ((1 << width) - 1), pair >> width
        else:
            by = np.argsort(pair)
            suffix, pair = suffix[by], pair[by]
        order[open_] = suffix
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        heads = np.flatnonzero(new)
        rank[suffix] = np.repeat(open_[heads], np.diff(np.append(heads, len(open_)))) + 1
        open_ = open_[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, the bytes that its suffix shares with the one before it in ``order``. By Kasai's rule the value falls by one from a place to the
    next where the suffixes before them are neighbours in the text too; only other places are compared, eight bytes at a time."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    if n > 1:
        a, b = before[1:], before[:-1]
        follows[1:] = (a > 0) & (b >= 0) & (a == b + 1)
        follows[1:] &= text[:-1] == text[np.maximum(a - 1, 0)]
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero(~follows & (before >= 0))
    shared = np.zeros(n, np.int64)
    depth = 0
    while len(todo):
        other = before[todo]
        room = n - np.maximum(todo, other) - depth
        x = eight[np.minimum(todo + depth, n)] ^ eight[np.minimum(other + depth, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        same = np.minimum(same, np.maximum(room, 0))
        shared[todo] += same
        todo = todo[same == 8]
        depth += 8
    run = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(shared[run] - (np.arange(n) - run), 0)


class Shard:
    """The suffix array of some byte strings side by side."""

    def __init__(self, bodies: list[bytes], length: int):
        self.length = length
        parts = []
        for k, body in enumerate(bodies):
            parts += [body, b"\xff", (b"%08o" % k).translate(_APART)]  # bytes that are in no UTF-8 text; the number ends all that is shared
        size = np.array([len(b) for b in bodies], np.int64)
        self.begin = np.cumsum(size + 9) - size - 9
        self.starts = np.maximum(size - length + 1, 0)
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.order = suffix_array(self.text, length)
        hit = common_prefixes(self.text, self.order) >= length
        self.twice = hit.copy()  # by place
        self.twice[self.order[:-1]] |= hit[self.order[1:]]

    def repeated(self, k: int) -> np.ndarray:
        """At which starts of string ``k`` one of ``length`` bytes lies that starts anywhere else too."""
        return self.twice[self.begin[k] : self.begin[k] + self.starts[k]]

    def strings(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different strings of ``length`` bytes in byte strings ``first`` to ``last - 1``, in the array's order; of those that occur once there, the number
        of the byte string and the start, of others -1."""
        at = self.order[(self.order >= self.begin[first]) & (self.order < self.begin[last - 1] + self.starts[last - 1])]
        owner = np.searchsorted(self.begin, at, side="right") - 1
        start = at - self.begin[owner]
        whole = start < self.starts[owner]
        at, owner, start = at[whole], owner[whole], start[whole]
        found = fixed(np.lib.stride_tricks.sliding_window_view(self.text, self.length)[at], self.length) if len(at) else np.zeros(0, f"S{self.length}")
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        once = np.diff(np.append(new, len(found))) == 1
        return found[new], np.where(once, owner[new], -1), np.where(once, start[new], -1)


def fixed(raw, length: int) -> np.ndarray:
    """Strings of one length, compared by their bytes."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw).reshape(-1, length).view(f"S{length}").ravel()


def _bytes(strings: np.ndarray) -> bytes:
    return strings.tobytes()


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, at which of its starts a string of ``length`` bytes lies that starts anywhere else in them."""
    shard = Shard(bodies, length)
    return [shard.repeated(k) for k in range(len(bodies))]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SORTED = "kind int, anchor long, salt int, digest binary, first int, last int, strings binary, digests binary, starts binary"
_SORTED = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
RUNS, SLICES, LIMITS = 0, 1, 2


def _sorted(length: int):
    """Over rows ``anchor, salt, salts, digest, body`` sorted by anchor and salt: RUNS of repeated starts (``first`` to ``last - 1``) of each context, and of
    anchors in several shards SLICES of sorted strings with the contexts and starts of those that occur once; of the first shard the LIMITS to cut them at."""
    names = SORTED.replace(",", "").split()[::2]

    def solve(rows):
        shard, out, seen = Shard([r[4] for r in rows], length), [], set()
        for k, (anchor, _, _, digest, _) in enumerate(rows):
            if (anchor, digest) not in seen:
                seen.add((anchor, digest))
                out += [(RUNS, anchor, None, digest, a, b, None, None, None) for a, b in _runs(shard.repeated(k))]
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][:2] == rows[at][:2]:
                end += 1
            anchor, salt, salts = rows[at][:3]
            if salts > 1:
                found, owner, start = shard.strings(at, end)
                digests = np.frombuffer(b"".join(r[3] for r in rows) + bytes(16), np.uint8).reshape(-1, 16)[owner]  # -1: nothing but zeros
                for i in range(0, len(found), SLICE):
                    j = i + SLICE
                    out.append((SLICES, anchor, salt, None, None, None, _bytes(found[i:j]), digests[i:j].tobytes(), start[i:j].astype("<i4").tobytes()))
                if salt == 0:
                    out.append((LIMITS, anchor, None, None, None, None, _bytes(found[len(found) * np.arange(1, salts) // salts]), None, None))
            at = end
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_SORTED)], names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if size > BLOCK and held[-1][:2] != r[:2]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield solve(held)

    return run


def merge(a: tuple, b: tuple) -> tuple[tuple, list]:
    """Merge two slices (different sorted strings, digests, starts) by binary search; also the (digest, start) of strings in both that were not found before.
    Strings in both have start -1 afterwards."""
    place = np.searchsorted(a[0], b[0])
    both = np.zeros(len(b[0]), bool)
    inside = np.flatnonzero(place < len(a[0]))
    both[inside] = a[0][place[inside]] == b[0][inside]
    new, mine = np.flatnonzero(both), place[both]
    found = [(x[1][k].tobytes(), int(x[2][k])) for x, at in ((a, mine), (b, new)) for k in at[x[2][at] >= 0].tolist()]
    own = a[2].copy()
    own[mine] = -1
    rest = np.flatnonzero(~both)
    put = lambda x, y: np.insert(x, place[rest], y[rest], axis=0)
    return (put(a[0], b[0]), put(a[1], b[1]), put(own, b[2])), found


def _across(cut: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, first, last`` of runs of starts whose strings two shards of an anchor hold, from slices cut at shared limits."""

    def run(batches):
        held: list = []

        def solve():
            anchor, todo, found = held[0][0], [], []
            by_salt: dict[int, list] = {}
            for _, _, salt, strings, digests, starts in held:
                by_salt.setdefault(salt, []).append((fixed(strings, length), np.frombuffer(digests, np.uint8).reshape(-1, 16), np.frombuffer(starts, "<i4")))
            for slices in by_salt.values():
                slices.sort(key=lambda s: s[0][0])
                todo.append(tuple(np.concatenate(x) for x in zip(*slices, strict=True)))
            while len(todo) > 1:
                todo.append(None)
                merged = []
                for a, b in zip(todo[:-1:2], todo[1::2], strict=False):
                    if b is not None:
                        a, more = merge(a, b)
                        found += more
                    merged.append(a)
                todo = merged
            found.sort()
            runs: list[list] = []
            for digest, start in found:
                if runs and runs[-1][0] == digest and runs[-1][2] == start:
                    runs[-1][2] += 1
                else:
                    runs.append([digest, start, start + 1])
            columns = [pa.array([anchor] * len(runs), pa.int64()), *(pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32())))]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "first", "last"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and held[-1][:2] != r[:2]:
                    yield solve()
                    held.clear()
                held.append(r)
        if held:
            yield solve()

    dealt = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, "anchor long, digest binary, first int, last int")


def _cut(slices: DataFrame, limits: DataFrame, length: int) -> DataFrame:
    """``anchor, part, salt, strings, digests, starts`` of slices, cut at the limits of their anchor by binary search."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        for b in batches:
            for anchor, salt, strings, digests, starts, limit in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                found = fixed(strings, length)
                edge = [0, *np.searchsorted(found, fixed(limit, length)).tolist(), len(found)]
                out = [(anchor, p, salt, strings[i * length : j * length], digests[16 * i : 16 * j], starts[4 * i : 4 * j]) for p, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["anchor", "part", "salt", "strings", "digests", "starts"])

    met = slices.join(limits.select(F.col("anchor").alias("l"), F.col("strings").alias("limit")), F.col("anchor") == F.col("l"))
    return met.select("anchor", "salt", "strings", "digests", "starts", "limit").mapInArrow(run, "anchor long, part int, salt int, strings binary, digests binary, starts binary")


def _bodies(parts: DataFrame, wanted: DataFrame, length: int, block: int) -> DataFrame:
    """``anchor, salt, salts, digest, body``: the bytes of contexts ``wanted`` (``anchor, salt, salts, digest, key, lo, starts``). Blocks of texts whose key isn't
    in a bit table of the wanted keys aren't shuffled."""
    table, bits = bit_table(wanted.select(F.xxhash64("key").alias("mark")).distinct(), "mark")

    def some(batches):
        known = np.unpackbits(table, bitorder="little").view(bool)
        for b in batches:
            yield b.filter(pa.array(has_bit(known, bits, b.column(0).to_numpy())))

    def cut(batches):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            out = []
            for raw, at, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out += [(w["anchor"], w["salt"], w["salts"], w["digest"], raw[w["lo"] - at : w["lo"] - at + w["starts"] + length - 1]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["anchor", "salt", "salts", "digest", "body"])

    begin = (F.floor(F.col("lo") / block) * block).cast("long")
    per_block = wanted.groupBy(F.col("key").alias("k"), begin.alias("b")).agg(F.collect_list(F.struct("anchor", "salt", "salts", "digest", "lo", "starts")).alias("want"))  # of one block
    near = parts.select(F.xxhash64("key").alias("mark"), "key", "at", "raw").mapInArrow(some, "mark long, key binary, at long, raw binary")
    one = near.groupBy("key", "at").agg(F.first("raw").alias("raw"))  # of equal texts
    met = one.join(per_block, (F.col("key") == F.col("k")) & (F.col("at") == F.col("b")))
    return met.select("raw", "at", "want").mapInArrow(cut, "anchor long, salt int, salts int, digest binary, body binary")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """``key, start, end`` of repeated bytes of rows ``key, text``, equal texts counted as one; spans of a text may overlap."""
    parts = blocks(rows, length, block)
    again, again_path = save(repeated_anchors(parts, length, gram, block), "again")
    # stored, so that the join's own shuffles can be split where an anchor is very frequent
    held, _ = save(occurrences(parts, again, length, gram, block), "contexts")
    place = F.struct("key", "lo", "starts")
    kinds, kinds_path = save(held.groupBy("anchor", "digest").agg(F.min(place).alias("one"), F.max(place).alias("two")), "kinds")
    places = F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))
    many = kinds.groupBy(F.col("anchor").alias("a")).agg(F.sum(F.size(places)).alias("m")).filter("m > 1")
    salts = F.ceil(F.col("m") / crowd).cast("int")
    each = kinds.join(many, F.col("anchor") == F.col("a")).select("anchor", "digest", salts.alias("salts"), F.explode(places).alias("p"))
    wanted, wanted_path = save(each.select("anchor", F.pmod(F.xxhash64("digest"), "salts").cast("int").alias("salt"), "salts", "digest", "p.*"), "wanted")
    size = wanted.agg(F.sum(F.col("starts") + length)).first()[0] or 0
    bodies, bodies_path = save(_bodies(parts, wanted, length, block), "bodies")
    dealt = bodies.repartition(1 + min(size // SHARD_BYTES, 20_000), "anchor", "salt").sortWithinPartitions("anchor", "salt")
    sorted_, _ = save(dealt.mapInArrow(_sorted(length), SORTED), "sorted")
    for path in (again_path, kinds_path, wanted_path, bodies_path):
        forget(rows.sparkSession, path)
    of = lambda kind: sorted_.filter(F.col("kind") == kind)
    across = _across(_cut(of(SLICES), of(LIMITS), length), length)
    found = of(RUNS).select("anchor", "digest", "first", "last").union(across).withColumnsRenamed({"anchor": "a", "digest": "d"})
    met = held.join(found, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d")))
    return met.select("key", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + length - 1).alias("end"))


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, removed runs)."""
    kept, removed, runs, at = [], 0, 0, 0
    for s, e in sorted(spans):
        if s > at or not runs:
            kept.append(text[at:s])
            runs += 1
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, bodies: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row (with ``bodies``, also ``kept``, the remaining bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    spans = repeated_spans(rows.select("key", "text"), length, gram, crowd, block)
    lists = spans.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text
    copied = rows.groupBy(F.col("key").alias("c")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")

    def run(batches):
        for b in batches:
            out = []
            for name, raw, found, copies in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = raw.encode()
                twice = copies and len(raw) >= length
                kept, removed, runs = remove(raw, [(0, len(raw))] if twice else [(s["start"], s["end"]) for s in found or ()])
                out.append((name, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept if bodies else None))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * bodies
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if bodies else "")
    met = rows.join(lists, F.col("key") == F.col("k"), "left").join(copied, F.col("key") == F.col("c"), "left")
    return met.select("doc_id", "text", "spans", "copies").mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of all documents. A null text is empty (0 bytes), null and repeated ids keep a row each, equal
    texts of 200 bytes or more lose every byte, and an empty table gives no row."""
    return deduped(documents(spark, sf_dir))
