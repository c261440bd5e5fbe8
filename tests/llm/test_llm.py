"""The training-data operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm import components, decontamination, fingerprints, language, line_dedup, packing, quality, queries, ranks, sharding, similar_texts, simhash, suffix_dedup, token_counts
from ledgermill.llm.common import Chunk, held_out, save

from ..conftest import DATA

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key long, label int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated ids and rows, and columns named like the operators' own."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "other text"), (None, "one"), (None, None), (4, long), (5, long + "x"), (6, "\n\n \n"), (7, "12 !! 34"), (8, "é" * 3000), (9, "a\nb\n" * 500)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, tmp, frame):
    """A table folder with these documents and the given labels and benchmark."""
    at = tmp.mktemp("tables")
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(at / "documents.parquet"))
    for name in ("labels", "benchmark"):
        (at / f"{name}.parquet").symlink_to(Path(SF, f"{name}.parquet"))
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, tmp_path_factory, name):
    n = queries.QUERIES[name](spark, folder(spark, tmp_path_factory, odd)).count()
    assert n == 0 if name == "op3_decontamination" else n >= odd.count()
    assert queries.QUERIES[name](spark, folder(spark, tmp_path_factory, empty)).count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for frame in (odd, empty):
        stored, _ = save(frame, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, stored, SF)
            assert out.count() <= (100 if name == "packing" else frame.count())
            assert name == "packing" or out.columns == frame.columns
    one = {(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, save(odd, "odd")[0], SF).collect()}
    assert sum(i == 3 for i, _ in one) <= 1 and {i for i, t in one if t in ("", "\n\n \n")} == set()  # one of equal ids; empty texts belong to document 1


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited(docs, parts=5).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        if k % 20 == 0:
            assert got[i]["fingerprint"] == fingerprints.fingerprint(a) and got[i]["edited_fingerprint"] == fingerprints.fingerprint(new)
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))


def test_fingerprint_algebra():
    base = fingerprints.fingerprint("first par\nsecond one here")
    assert base == fingerprints.fingerprint("second one here\nfirst par")
    more = fingerprints.insert(base, "a third")
    assert more == fingerprints.fingerprint("first par\nsecond one here\na third") and fingerprints.delete(more, "a third") == base


def test_forward_backward():
    """Against the sum over all label sequences."""
    rng = np.random.default_rng(1)
    emit, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    start, end = np.array([0, 4, 5]), np.array([4, 5, 9])
    got = language.forward_backward(emit, start, end, moves)
    for s, e in zip(start, end, strict=True):
        total = np.zeros((e - s, 3))
        for path in np.ndindex(*[3] * (e - s)):
            w = np.exp(sum(emit[s + t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, x in enumerate(path):
                total[t, x] += w
        assert np.allclose(got[s:e], total / total.sum(1, keepdims=True))


def test_language(spark, docs):
    field = language.fit(docs)
    got = language.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    one = language.predict(spark.createDataFrame([(1, "123 !!"), (2, None)], "doc_id long, text string"), field).collect()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in one)
    assert language.predict(docs.limit(2), language.train([])).first()["lang_pred"] == "und"


def align_one(item, place):
    row, best = [0] * (len(place) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(place):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment():
    rng = np.random.default_rng(3)
    item, place = rng.integers(5, 9, (40, 7)), rng.integers(5, 9, (40, 15))
    got, _ = decontamination.align(item, place)
    assert got.tolist() == [align_one(a.tolist(), b.tolist()) for a, b in zip(item, place, strict=True)]


def test_decontamination(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(i, r["item_id"]) for r in items.collect() for i, t in texts.items() if r["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert held and held <= got
    words = {i: decontamination.normal(t).split() for i, t in texts.items()}
    for i, k in list(got)[:20]:  # exact scores
        item = decontamination.normal(items.filter(F.col("item_id") == k).first()["text"]).split()
        assert align_one(item, words[i]) >= 0.7 * 2 * len(item)


def test_decontamination_of_edited_copies(spark):
    rng = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = []
    for k, t in items:
        w = t.upper().split()
        for p in rng.sample(range(len(w)), len(w) // 8):
            w[p] = "edited"
        rows.append((k, "before it, " + ", ".join(w) + " and after"))
    got = {r["doc_id"] for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 0.95 * len(items)
    assert decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(None, "x"), (1, None), (2, "!!")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("copies", [1, 2500])
def test_decontamination_finds_every_edited_copy(spark, copies):
    """One word in five replaced, or words inserted up to what a score of 0.7 allows, in one or in thousands of documents, against brute force."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 10, 15, 25, 40, 55])]
    rows = []
    for _, t in items:
        w = t.split()
        tenth = [word() if p % 5 == 2 else x for p, x in enumerate(w)]
        some = rng.sample(range(len(w)), len(w) // 5)
        edits = [w, tenth, [word() if p in some else x for p, x in enumerate(w)]]
        edits += [[y for p, x in enumerate(w) for y in ([word(), x] if p % step == 1 else [x])] for step in (2, 3, 5)]
        edits += [w[len(w) // 5 :] + w[: len(w) // 5], w[: -(-len(w) * 7 // 10)], w[: len(w) // 2] + [word() for _ in range(len(w) * 3 // 5)] + w[len(w) // 2 :]]
        rows += [" ".join([word(), word(), *e, word()]) for e in edits]
    want = {(d, k) for d, r in enumerate(rows) for k, t in items if align_one(t.split(), r.split()) >= 0.7 * 2 * len(t.split()) - 1e-9}
    many = [(c * len(rows) + d, r) for c in range(copies) for d, r in enumerate(rows) if c == 0 or d % 9 < 2]
    table = spark.createDataFrame(many, "doc_id long, text string")
    found = decontamination.contaminated(table, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["d"], r["item_id"]): r["n"] for r in found.groupBy((F.col("doc_id") % len(rows)).alias("d"), "item_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == want
    assert all(n == (copies if d % 9 < 2 else 1) for (d, _), n in got.items())


def reach(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("most", [256, 2])
def test_simhash(spark, docs, texts, most):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, most=most).collect()}
    fp = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    root = reach(set(fp.values()), simhash.RADIUS)
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    for i, f in fp.items():
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == least[root[f]]


@pytest.mark.parametrize("most", [256, 4])
def test_simhash_links_of_a_crowd(spark, most):
    """Many fingerprints around a few centres, some of them two steps away from a centre."""
    rng = random.Random(2)
    values = set()
    for _ in range(3):
        c = rng.getrandbits(64)
        for _ in range(60):
            v = c
            for b in rng.sample(range(64), rng.randrange(5)):
                v ^= 1 << b
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    stored, _ = save(spark.createDataFrame([(k, signed(v)) for k, v in enumerate(sorted(values))], "doc_id long, fp long"), "t")
    got = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.grouped(stored, most=most).collect()}
    root = reach(values, 4)
    groups = collections.defaultdict(set)
    for v in values:
        groups[root[v]].add(got[v])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 7), (None, 3), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: k // 10 * 10 for k in range(40)} | {100: 0}


def repeats(texts, length):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_suffix_dedup(docs, texts, crowd):
    got = {r["doc_id"]: r for r in suffix_dedup.deduped(docs, crowd=crowd).collect()}
    for i, want in zip(texts, repeats([t.encode() for t in texts.values()], 200), strict=True):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_suffix_dedup_of_shared_passages(spark, crowd):
    """Short alphabets, passages in different surroundings, periodic texts."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    passage = word(70)
    rows = [word(rng.randrange(60)) + passage[: rng.randrange(30, 70)] + word(rng.randrange(60)) for _ in range(60)] + ["ab" * 60, "b" + "ab" * 60, "a" * 90, ""]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.deduped(frame, length=40, gram=16, crowd=crowd).collect()}
    for i, want in enumerate(repeats([t.encode() for t in rows], 40)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_suffix_dedup_in_a_long_text(spark):
    """A repeat beyond byte 2**24 of a text."""
    rng = random.Random(6)
    passage = rng.randbytes(2500).hex()
    rows = [(1, rng.randbytes((1 << 23) + 9000).hex() + passage + "end"), (2, "begin " + passage)]
    got = {r["doc_id"]: r for r in suffix_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2)] == [(5000, 1)] * 2


@pytest.mark.parametrize("block", [40, 50, 64, 100])
def test_suffix_dedup_in_blocks(spark, block):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    passage = word(150)
    rows = [word(rng.randrange(200)) + passage[rng.randrange(40) : rng.randrange(60, 150)] + word(rng.randrange(200)) for _ in range(25)] + ["ab" * 150, "é" * 90, "a" * 90 + passage, ""]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.deduped(frame, length=40, gram=16, block=block).collect()}
    for i, want in enumerate(repeats([t.encode() for t in rows], 40)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_slices_merge_by_their_bytes():
    """Strings that agree in all but their last byte stay apart; what two slices hold is named once for each."""
    tuple_of = lambda strings, of: (suffix_dedup.fixed(b"".join(strings), 4), np.frombuffer(bytes([of]) * 16 * len(strings), np.uint8).reshape(-1, 16), np.arange(len(strings), dtype="<i4"))
    a, b = tuple_of([b"aaa\0", b"aaab", b"xyz\0"], 1), tuple_of([b"aaa\1", b"aaab", b"xyz\0", b"zzzz"], 2)
    merged, found = suffix_dedup.merge(a, b)
    assert merged[0].tolist() == sorted(merged[0].tolist()) and len(merged[0]) == 5
    assert sorted(found) == [(bytes([1]) * 16, 1), (bytes([1]) * 16, 2), (bytes([2]) * 16, 1), (bytes([2]) * 16, 2)]
    again, more = suffix_dedup.merge(merged, tuple_of([b"aaab"], 3))
    assert more == [(bytes([3]) * 16, 0)] and len(again[0]) == 5


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(7)
    for size in (1, 2, 50, 400):
        text = rng.integers(97, 99, size).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(size), key=lambda k: raw[k:])
        shared = suffix_dedup.common_prefixes(text, order)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < size and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[b] == n


def without_repeated_runs(rows):
    """Of (id, text) pairs, what is left of each text and how many of its lines went: lines go in runs of two or more that a document with a lesser id has, or
    that the text itself has further up without overlap."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        both = list(zip(lines, lines[1:], strict=False))
        again = {k for k, p in enumerate(both) if p in seen or p in both[: max(0, k - 1)]}
        seen |= set(both)
        kept = [x for k, x in enumerate(lines) if not again & {k - 1, k}]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def test_line_dedup(spark, docs, texts):
    """The query and the texts against brute force over runs of lines."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_line_dedup"](spark, SF).collect()}
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = without_repeated_runs(texts.items())
    for i, (left, gone) in want.items():
        assert got[i]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest() and new[i] == left
        assert (got[i]["n_lines"], got[i]["n_removed_lines"]) == (texts[i].count("\n") + 1, gone)
    assert sum(gone for _, gone in want.values()) > 150


@pytest.mark.parametrize("divisor", [1, 3, 50])
def test_line_dedup_of_mixed_lines(spark, divisor):
    """Few different lines in many orders, whatever the size of chunks."""
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "c d", "é"]) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    rows += [(40 + i, "\n".join(f"long {k}" for k in range(i, i + 30))) for i in range(0, 20, 3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), divisor=divisor).collect()}
    assert got == {i: left for i, (left, _) in without_repeated_runs(rows).items()}


def test_rows_without_an_id_lose_lines(spark):
    """They lose to documents with an id, and keep nothing back; rows with one id don't lose to each other."""
    passage = "\n".join(f"line {k * 7919 % 1000}" for k in range(40))
    other = "\n".join(f"row {k}" for k in range(40))
    rows = [(5, passage), (None, passage), (None, passage + "\nend"), (None, other), (None, other), (7, "x\ny"), (7, "x\ny"), (9, "x\ny")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    lost = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed_lines"]) for r in line_dedup.deduped(table).collect())
    assert lost == [(False, 5, 0), (False, 7, 0), (False, 7, 0), (False, 9, 2), (True, 0, 0), (True, 0, 0), (True, 0, 40), (True, 0, 40)]


def test_line_chunks_resist_shifts():
    """An inserted line changes no chunk but those around it."""
    lines = [f"line {k * 7919 % 1000}" for k in range(300)]
    cut = lambda ls: {(b"\n".join(ls))[s:e] for s, e in zip(*line_dedup.chunk_ends(Chunk(np.frombuffer(b"\n".join(ls), np.uint8), np.array([0, len(b"\n".join(ls))])))[:2], strict=True)}
    a, b = [x.encode() for x in lines], [x.encode() for x in [*lines[:100], "new", *lines[100:]]]
    assert len(cut(a) - cut(b)) <= 2


def test_ranks(spark):
    df, _ = save(spark.range(1000).select((F.col("id") % 3).alias("g"), "id"), "t")
    got = ranks.ranked(df, ["g"], ["id"], 1000).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(len(r["r"]))) for r in got)


def shard_checks(rows, shards):
    counts = collections.Counter(r["shard"] for r in rows)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_sharding(docs, texts):
    rows = sharding.shard_documents(docs, 16).collect()
    shard_checks(rows, 16)
    at = collections.defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["text_crc32"] == zlib.crc32(raw) and r["size"] == len(raw) + 1
        at[raw].add(r["shard"])
    assert sum(len(s) > 1 for s in at.values()) == 0


@pytest.mark.parametrize("group", [lambda k: k % 40, lambda k: 0, lambda k: 0 if k % 3 == 0 else k // 2, lambda k: k])
def test_sharding_of_groups(spark, group):
    n, shards = 400, 8
    stored, _ = save(spark.createDataFrame([(k, group(k)) for k in range(n)], "id long, grp long"), "t")
    rows = sharding.shard(stored.select("id"), stored, shards).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    shard_checks(rows, shards)
    sizes, cut = collections.Counter(group(k) for k in range(n)), collections.defaultdict(set)
    for r in rows:
        cut[group(r["id"])].add(r["shard"])
    largest, k = sizes.most_common(1)[0]
    assert len(cut[largest]) <= -(-k // (n // shards)) + 2  # a large group lies in few shards more than it needs


def test_sharding_of_plain_links(spark):
    """Clusters of a graph with a few links between them: far fewer links are cut than by chance."""
    rng, n, shards = random.Random(9), 240, 4
    links = [(a, b) for a in range(n) for b in rng.sample(range(a // 12 * 12, a // 12 * 12 + 12), 4)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(20)]
    members, _ = save(sharding.members_of_links(spark.createDataFrame(links, "a long, b long")), "t")
    rows = sharding.shard(spark.range(n), members, shards, rounds=14).collect()
    shard_checks(rows, shards)
    at = {r["id"]: r["shard"] for r in rows}
    assert sum(at[a] != at[b] for a, b in links) < 0.5 * len(links) * (1 - 1 / shards)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    stored, _ = save(packing.pieces(docs, path), "t")
    rows = packing.pack(stored).orderBy("sequence_id", "offset").collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(int)
    for r in rows:
        assert r["offset"] == by_sequence[r["sequence_id"]]
        by_sequence[r["sequence_id"]] += r["length"]
        by_doc[r["doc_id"]].append(r)
    assert max(by_sequence.values()) <= 2048 and sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(by_sequence.values()) >= 0.95 * 2048 * (len(by_sequence) - 1)
    tokenizer = Tokenizer.from_file(path)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        cut = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in cut] == list(range(0, len(ids), 2048)) and all(r["doc_tokens"] == len(ids) for r in cut)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in cut)


def test_words_tokenize_alone():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(6)
    letters = "aZé'ßΣİ1²½_-!<|>\x1c\x0b\x85\xa0 ​́ﬁ日\n\t. "
    for t in ["it's<|endoftext|>x", "don't 'S x'll12 3!!", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500))]:
        assert words.of(t.encode().split()) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_patterns():
    rng = random.Random(8)
    for _ in range(50):
        size = rng.choice([8, 64])
        counts = {rng.randrange(1, size + 1): rng.randrange(1, 40) for _ in range(6)}
        found, used = packing.patterns(counts, size), collections.Counter()
        for packs, held in found:
            assert packs > 0 and sum(n * c for n, c in held) <= size
            for n, c in held:
                used[n] += packs * c
        assert used == counts
        # no two packs that could be one: at most one pack is half empty
        assert sum(packs for packs, held in found if 2 * sum(n * c for n, c in held) <= size) <= 1


def test_quality(spark, docs):
    got = queries.QUERIES["op9_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = got.join(labels, "doc_id").toPandas()
    assert both["score"].between(0, 1).all() and ((both["score"] >= 0.3) == (both["predicted"] == 1)).all()
    assert (both["predicted"] == both["quality"]).mean() > 0.93
    stats, _ = save(quality.measured(docs), "t")
    none = quality.fit(stats, labels.filter("false"))
    assert none.constant == 0.5 and quality.fit(stats, labels.filter("quality = 1")).constant == 1.0


def test_pool_adjacent():
    got = quality.pool_adjacent(np.ones(5), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert got.tolist() == [0, 0.5, 0.5, 1, 1]


def test_token_counts(docs, texts):
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = token_counts.Unigram(pieces)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, pieces).collect()}
    counts = {w: model.count_one(w) for t in texts.values() for w in set(t.encode().split())}
    for i, t in texts.items():
        words = t.encode().split()
        assert (got[i]["n_words"], got[i]["n_distinct"], got[i]["n_tokens"]) == (len(words), len(set(words)), sum(counts[w] for w in words))


def test_token_counts_as_a_public_library_counts():
    """The same pieces and scores in the tokenizers library's unigram model."""
    from tokenizers import Tokenizer, models

    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scores = token_counts.zipf_scores(len(pieces)).tolist()
    model, other = token_counts.Unigram(pieces), Tokenizer(models.Unigram([("<unk>", -1e6), *zip([p.decode() for p in pieces], scores, strict=True)], 0, False))
    for word in ["tokenization", "the", "Einverständnis", "señor", "understanding", "thorreou", "a"]:
        assert model.count_one(word.encode()) == len(other.encode("▁" + word).tokens)


def similar_by_sets(texts, least=0.8):
    """The least id that each reaches over pairs of texts of this similarity in their five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def holds(text, item):
    """By alignment of the whole text in plain numpy."""
    words, wanted = decontamination.normal(text).split(), decontamination.normal(item).split()
    if len(set(words) & set(wanted)) < 2:
        return False
    names = {w: n + 2 for n, w in enumerate(dict.fromkeys([*words, *wanted]))}
    score, _ = decontamination.align(np.array([[names[w] for w in wanted]]), np.array([[names[w] for w in words]]))
    return score[0] >= 2 * decontamination.LEAST * len(wanted) - 1e-9


@pytest.mark.parametrize("crowd,small", [(similar_texts.CROWD, similar_texts.SMALL), (4, 3)])
def test_similar_texts(spark, crowd, small):
    """Groups of copies with edits around the limit, one of them large; texts of one repeated word and words of their own; and many texts with a long passage in
    common, two of them alike: against the sets themselves."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for size in (2, 3, 5, 8, 90):
        base = [word() for _ in range(150)]
        for _ in range(size):
            new = list(base)
            for p in rng.sample(range(150), rng.randrange(0, 7)):
                new[p] = word()
            rows.append(" ".join(new))
    rows += [" ".join(word() for _ in range(150)) for _ in range(60)] + ["", " \n", "one two", "One  two", "one two three"]
    rows += [" ".join(["lorem"] * 120 + [word() for _ in range(90)]) for _ in range(2)]
    passage, last = [word() for _ in range(120)], [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(80)] + [" ".join(passage + last), " ".join([*passage, *last[:-1], word()])]
    want = similar_by_sets(dict(enumerate(rows)))
    got = {r["doc_id"]: r["component_id"] for r in similar_texts.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), crowd=crowd, small=small).collect()}
    linked = [i for i, r in want.items() if i != r]
    assert all(got[i] == i for i, r in want.items() if sum(x == r for x in want.values()) == 1)  # nothing alike is left alone
    assert all(want[r] == want[i] for i, r in got.items()) and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)


def test_pipeline(spark, docs, texts):
    """Each stage against what its operator decides by brute force on that stage's input."""
    from tokenizers import Tokenizer

    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out, _ = save(stage(spark, kept, SF), name)
        before, after = {r["doc_id"]: r for r in kept.collect()}, out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            now = {r["doc_id"]: r for r in after}
            assert len(now) == len(after) and set(now) <= set(before)
        if name == "quality":
            stats, _ = save(quality.measured(kept), "t")
            model = quality.fit(stats, spark.read.parquet(f"{SF}/labels.parquet"))
            alone = lambda t: quality.statistics(Chunk(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))).astype(np.float32).astype(float)
            bad = {i for i, r in before.items() if model.scores(alone(r["text"] or ""))[0] < 0.3}
            assert bad and set(before) - set(now) == bad
        elif name == "line_dedup":
            want = without_repeated_runs((i, r["text"]) for i, r in before.items())
            assert set(now) == set(before) and all(r["text"] == want[i][0] and r["n_chars"] == len(r["text"]) for i, r in now.items())
        elif name == "simhash":
            root = similar_by_sets({i: r["text"] for i, r in before.items()})
            want = {i for i, r in root.items() if i == r}
            missed = set(now) - want  # candidates are found with a stated probability
            assert want <= set(now) and len(missed) <= (1 - similar_texts.RECALL) * (len(before) - len(want))
            assert all(now[i]["text"] == before[i]["text"] for i in now)
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            held = {i for i, r in before.items() for k in items if holds(r["text"], k["text"])}
            assert held and set(now) == set(before) - held
        else:
            tokenizer, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.defaultdict(list)
            for r in after:
                got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            for i, r in before.items():
                ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
                assert sorted(got[i]) == [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
            used = collections.Counter()
            for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == used[r["sequence_id"]]
                used[r["sequence_id"]] += r["length"]
            assert set(got) == set(before) and max(used.values()) <= 2048
        kept = out
    assert corpus_pipeline.run(spark, SF).count() == len(after)
