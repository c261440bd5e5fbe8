"""Results on nulls, empty and long texts, ties, repeated rows and odd shapes; and models against direct solutions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgermill.llm import common, decontamination, fingerprints, language, packing, quality, ranks, sharding, similar_texts, simhash, suffix_dedup, token_counts
from ledgermill.llm.common import held_out, save

from ..conftest import DATA

SF = f"{DATA}/sf0.001"
#: Longer than every chunk of text that numpy works on at once (256 KiB to 4 MiB).
LONG = " ".join(f"w{k * 7919 % 100_003} says{k % 50}" + ("\n" if k % 40 == 0 else "") for k in range(330_000))
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "other text"), (None, "one"), (None, None), (4, LONG), (6, "\n\n \n"), (7, "12 !! 34"), (8, "é" * 3000), (9, "a\nb\n" * 500)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """With columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, part int, key long, label int, spans string, gone string, fp long, rank long"
    return save(spark.createDataFrame([(i, t, *[None] * 8) for i, t in ODD], schema), "odd")[0]


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def expected(use):
    """A row (id, *use(text)) for each odd row, null texts as empty ones."""
    return sorted(((i, *use(t or "")) for i, t in ODD), key=repr)


def test_long_is_long():
    assert len(LONG) > 4 << 20


def test_odd_simhash(odd):
    def plain(text):
        w = text.lower().encode().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return (f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}",)

    short = [(i, t) for i, t in ODD if t is not LONG]
    got = simhash.near_duplicates(odd)
    found = rows_of(got.filter("doc_id is null or doc_id != 4"), "doc_id", "fingerprint")
    assert found == sorted(((i, *plain(t or "")) for i, t in short), key=repr)
    assert got.filter("doc_id = 4").first()["fingerprint"] == f"{simhash.fingerprint(LONG.encode()):016x}"
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got.collect()}
    zero = "0" * 16
    assert groups[1, zero] == groups[2, zero] == groups[6, zero] == groups[None, zero] == 1
    assert groups[None, plain("one")[0]] == 3 == groups[3, plain("one")[0]]


def test_odd_suffix_dedup(odd):
    got = rows_of(suffix_dedup.deduped(odd), "doc_id", "n_bytes", "n_removed")
    periodic = {8: (6000, 6000), 9: (2000, 2000)}
    assert [x for x in got if x[0] not in (4, 8, 9)] == [x for x in expected(lambda t: (len(t.encode()), 0)) if x[0] not in (4, 8, 9)]
    assert {x[0]: x[1:] for x in got if x[0] in (8, 9)} == periodic and next(x for x in got if x[0] == 4)[1] == len(LONG)


def test_odd_packing(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    stored, _ = save(packing.pieces(odd, public_tokenizers.path("word_bpe_49k.json")), "t")
    found = packing.pack(stored)
    assert rows_of(found, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)
    used = collections.Counter()
    for r in found.orderBy("sequence_id", "offset").collect():
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_odd_token_counts(odd):
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = token_counts.Unigram(pieces)
    known = {}

    def count(text):
        words = text.encode().split()
        for w in set(words) - set(known):
            known[w] = model.count_one(w)
        return len(words), len(set(words)), sum(known[w] for w in words)

    assert rows_of(token_counts.token_counts(odd, pieces), "doc_id", "n_words", "n_distinct", "n_tokens") == expected(count)


def test_odd_language(odd):
    field = language.train([("the cat and the dog sat on this mat " * 9, "en"), ("el gato y el perro en esta casa grande " * 9, "es")])
    got = language.predict(odd, field)
    und = {repr(r["doc_id"]): (r["lang_pred"], r["score"]) for r in got.filter("doc_id in (2, 6, 7, 1)").collect()}
    assert len(und) == 4 and set(und.values()) == {("und", 0.0)}
    assert got.count() == len(ODD) and got.filter("doc_id = 4").first()["n_words"] == len(LONG.split())
    # a line of 200,000 words, by blocks and as a whole
    line = " ".join(random.Random(1).choices(["the", "gato", "and", "perro", "casa", "dog", "12"], k=20_000)).encode()
    c = common.Chunk(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    start, end, marginal = field.marginals(c)
    emit = language.Words(c.buf, start, end).emissions(field.weights)
    assert np.allclose(marginal, language.forward_backward(emit, np.array([0]), np.array([len(start)]), field.moves, block=10**9))


def test_odd_quality(odd):
    stats = quality.measured(odd)
    alone = lambda t: quality.statistics(common.Chunk(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0].astype(np.float32).tolist()
    got = collections.Counter((r["doc_id"], tuple(r["stats"])) for r in stats.collect())
    assert got == collections.Counter((i, tuple(alone(t or ""))) for i, t in ODD)


def exact_likeness(a, b):
    """Cosine of the counts of runs of three words in lines."""

    def runs(t):
        out = collections.Counter()
        for line in t.split("\n"):
            w = line.split()
            out.update([tuple(w[k : k + 3]) for k in range(len(w) - 2)] or ([tuple(w)] if w else []))
        return out

    x, y = runs(a), runs(b)
    return sum(x[k] * y[k] for k in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x and y else 0.0


def test_likeness_is_a_cosine(docs):
    """Estimates of near_edited and near_next against exact counts: standard error at most 0.06."""
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited(docs, parts=3).collect()}
    errors = []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        a, b = texts[i], texts[j]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        for name, other in (("near_edited", edited), ("near_next", b)):
            errors.append(got[i][name] - (1.0 if other == a else exact_likeness(a, other)))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and max(map(abs, errors)) < 0.3


def test_likeness_of_a_run_70000_times():
    text = "a b c " * 70_000
    same, other = fingerprints.vectors([text.encode(), (text + "d").encode()]), fingerprints.vectors([b"x y z"])
    first, second = tuple(x[:1] for x in same), tuple(x[1:] for x in same)
    assert fingerprints.likeness(first, second)[0] > 0.99 and fingerprints.likeness(first, other)[0] < 0.2


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_edited_texts_of_repeated_and_missing_ids(spark, parts):
    """A hot id, and null ids, take several ranges; each row's next is the next in the order of ids and text hashes."""
    rows = [(7 if k % 3 else None if k % 2 else k, f"text {k} " + "x" * (k % 9)) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(table.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        s, half = a["text"], len(a["text"]) // 2
        want.append((a["doc_id"], len(s), hashlib.sha256((s[: len(s) - half] + b["text"][:half]).encode()).hexdigest()))
    got = fingerprints.edited(table, parts=parts)
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)


def test_language_learns_from_long_texts_alone(spark):
    words = {"en": "the cat and the dog sat on this mat with them", "de": "der Hund und die Katze sitzen auf einer Matte"}
    rows = [(k, lang, " ".join(random.Random(k).choices(w.split(), k=6000))) for k in range(40) for lang, w in words.items()]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert all(len(t) > language.SAMPLE_CHARS for _, _, t in rows)
    field = language.fit(table)
    assert field.labels == ["de", "en"]
    got = language.predict(table, field).join(table.select("doc_id", "lang", F.xxhash64("text").alias("h")).distinct(), "doc_id")
    assert got.count() == 160 and language.predict(table, field).filter("lang_pred = 'und'").count() == 0


def test_language_sample_is_bounded(spark):
    rows = [(k, f"l{k % 100:02d}" if k % 2 else "hot", f"word{k} text") for k in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = {r["lang"]: r["n"] for r in language.sample(table).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labelled = {x for _, x, _ in rows}
    each = language.SAMPLE_TOTAL // len(labelled)
    assert set(counts) == labelled and max(counts.values()) <= each and counts["hot"] == each
    many = spark.createDataFrame([(k, f"l{k}", "word text") for k in range(1000)], "doc_id long, lang string, text string")
    learnt = [r["lang"] for r in language.sample(many).collect()]  # no language is left out, of each a row
    assert len(learnt) == len(set(learnt)) == many.filter(~held_out(F.col("doc_id"))).count()


def test_quality_is_ridge_regression_and_isotonic(spark, docs):
    """Against one solution of the whole system and pooling over the same bins."""
    stats, _ = save(quality.measured(docs), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(stats, labels)
    used = stats.join(labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()), "doc_id").toPandas()
    x, y = np.array(used["stats"].to_list(), float), used["quality"].to_numpy(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = quality.fourier(x, x.mean(0), np.maximum(x.std(0), 1e-6))
    ridge = np.full(z.shape[1], quality.RIDGE * len(x) / quality.FEATURES + 1e-2)
    ridge[-1] = 0
    w = np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(ridge))]), np.append(y, np.zeros(len(ridge))), rcond=None)[0]
    assert np.allclose(z @ w, model.raw(x), atol=1e-6)
    bins = np.clip(np.floor((model.raw(x) + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1).astype(int)
    n, t = np.bincount(bins, minlength=quality.BINS), np.bincount(bins, weights=y, minlength=quality.BINS)
    n, t = n[n > 0], t[n > 0]
    # the greatest of least means, which is what isotonic regression is
    want = [max(min(t[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]
    assert np.allclose(model.values, want)


def test_shards_follow_from_the_rows_alone(docs):
    """Cut into files otherwise, the same shards; the columns of the law; repeated rows too."""
    twice = docs.union(docs.filter("doc_id % 50 = 0"))
    a, b = (rows_of(sharding.shard_documents(x), "doc_id", "size", "text_crc32", "shard", "slot", "law", "grown_shard") for x in (twice.repartition(7, "n_chars"), twice.coalesce(1)))
    assert a == b and {x[5:] for x in a} == {("rows", None)}
    sizes = collections.Counter(x[3] for x in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(x[4] for x in a if x[3] == k) == list(range(n)) for k, n in sizes.items())


def test_ranks_of_one_row_many_times(spark):
    df, _ = save(spark.range(500).select(F.lit(1).alias("g"), F.lit("same").alias("id")), "t")
    assert sorted(r["rank"] for r in ranks.ranked(df, ["g"], ["id"], 500).collect()) == list(range(500))


def test_decontamination_against_alignment_of_all_pairs(spark, docs):
    """Every pair of a document and an item whose best alignment counts, over the whole small tables with edited copies put in."""
    items = {r["item_id"]: decontamination.normal(r["text"]).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (i, w) in enumerate(items.items()):
        every = 5 + k % 2  # one word in five or six replaced
        new = [b"edited" if p % every == 2 else x for p, x in enumerate(w)]
        rows[10_000 + i] = "before " * (k % 7) + b" ".join(new).decode() + " after" * (k % 5)
    words = {i: decontamination.normal(t).split() for i, t in rows.items()}
    numbers = {w: n + 2 for n, w in enumerate(sorted({w for t in [*words.values(), *items.values()] for w in t}))}
    longest = max(map(len, words.values()))
    want = set()
    for k, item in items.items():
        some = list(words)
        for at in range(0, len(some), 50):
            part = some[at : at + 50]
            places = np.ones((len(part), longest), np.int64)
            for r, i in enumerate(part):
                places[r, : len(words[i])] = [numbers[w] for w in words[i]]
            score, _ = decontamination.align(np.tile([numbers[w] for w in item], (len(part), 1)), places)
            want |= {(i, k) for i, s in zip(part, score, strict=True) if s >= 2 * decontamination.LEAST * len(item) - 1e-9}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == want and sum(i >= 10_000 for i, _ in want) > 25


def test_decontamination_of_items_of_very_different_lengths(spark):
    """A long item doesn't widen what is aligned with a short one."""
    word = lambda k: f"w{k}"
    items = [(1, " ".join(map(word, range(3000)))), (2, "w5000 w5001 w5002"), (3, "short item of six words here")]
    docs = [(1, "x " * 50 + "w5000 w5001 w5002" + " y" * 50), (2, " ".join(map(word, range(400, 2700)))), (3, " ".join(map(word, range(1000)))), (4, "a short item of six words here and more")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 2), (2, 1), (4, 3)}


def test_bit_tables(spark):
    rng = np.random.default_rng(5)
    some, other = rng.integers(-(2**63), 2**63, 500), rng.integers(-(2**63), 2**63, 5000)
    frame, _ = save(spark.createDataFrame([(int(x),) for x in some], "h long"), "t")
    table, bits = common.bit_table(frame, "h")
    known = np.unpackbits(table, bitorder="little").view(bool)
    assert common.has_bit(known, bits, some).all() and common.has_bit(known, bits, other).mean() < 0.1


def test_without_a_shared_folder(spark):
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_folder(spark) == conf.rstrip("/")


@pytest.mark.parametrize("size", [5, 64, 65, 900])
def test_links_of_a_key_grow_with_rows_and_not_with_pairs(size):
    """Near copies on one key: at most a link a row, and together they reach every row, in whatever batches they come; what is far stays alone in a key of few rows."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fp = np.unique(np.array([int(x) for x in np.uint64(1) << rng.integers(0, 63, size).astype(np.uint64)], np.int64) * 4096 + np.arange(size) % 4096)
    rows = [(7, f, 0) for f in fp] + [(9, 5, 0), (9, 7, 0), (11, 5, 9), (11, -1, 0)]
    links = []
    cut = sorted({0, len(rows), *rng.integers(0, len(rows), 4).tolist()})
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a:b]], pa.int64()) for c in range(3)], ["key", "a", "b"]) for a, b in zip(cut, cut[1:], strict=False)]
    for out in similar_texts._near(32, 64)(iter(batches)):
        links += zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)
    names = common.mix(common.mix(np.array([r[1] for r in rows], np.int64).view(np.uint64)) + np.array([r[2] for r in rows], np.uint64)).view(np.int64).tolist()
    root = {n: n for n in names}
    for i, j in links:
        a, b = root[i], root[j]
        root = {k: a if r == b else r for k, r in root.items()}
    assert len(links) <= len(rows) and len({root[n] for n in names[: len(fp)]}) == 1
    assert root[names[len(fp)]] == root[names[len(fp) + 1]] and root[names[-1]] != root[names[-2]]


def test_sampling_grows_with_the_fingerprints():
    few, many = similar_texts.sampling(10**4), similar_texts.sampling(10**10)
    assert few[0] < many[0] and few[1] < many[1] and similar_texts.sampling(0)[0] == 12
    assert similar_texts.differing(1.0) == 0 and abs(similar_texts.differing(0.8) - 0.1515) < 1e-3


def test_majorities_and_sets():
    """Against plain loops: rows of no, few, repeated and very many words."""
    rng = random.Random(4)
    texts = ["", " ", "a", "A b", "a b c d", "a b c d e", "x " * 50, " ".join(rng.choices("abcdefghij", k=3000)), " ".join(f"w{k}" for k in range(90_000)), "a b c d e f"]
    import pyarrow as pa

    for i, j, h, bounds in common.word_hashes(pa.array(texts), lower=True):
        value, own = similar_texts.shingle_sets(h, bounds)
        got = similar_texts.majority(value, own)
        for k in range(i, j):
            w = texts[k].lower().split()
            mine = value[own[k - i] : own[k - i + 1]]
            assert len(set(mine.tolist())) == len(mine) == len({tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} if w else {0})
            assert int(got[k - i]) & (1 << 64) - 1 == sum(1 << x for x in range(64) if 2 * sum(int(m) >> x & 1 for m in mine) > len(mine))
