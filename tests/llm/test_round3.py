"""Lexical search, vector codes and repeated passages: against brute force, on odd tables and in small blocks."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from ledgermill.llm import common, language, lexical_search, line_dedup, passages, queries, similar_texts, token_counts, vector_codes

from ..conftest import DATA
from .test_llm import without_repeated_runs

SF = f"{DATA}/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def searched(docs, items, top=10):
    """(item, rank, document, score) by the definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
    split = [(i, term.findall((t or "").translate(lower))) for i, t in docs]
    rows, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = collections.Counter(x for _, t in split for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for k, (i, t) in enumerate(split):
            tf = collections.Counter(t)
            m = 10 + 90 * len(t) * rows // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(term.findall((text or "").translate(lower))) if tf[x])
            scores.append((-s, i is None, i, k))
        scores = sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(item, r + 1, i, -s) for r, (s, _, i, _) in enumerate(scores)]
    return sorted(out, key=repr)


DOCS = [(1, "The cat sat, the CAT ran"), (2, None), (3, ""), (3, "cat cat cat"), (None, "cat dog"), (None, "Éa éa CAT-dog"), (5, "dog_dog dog"), (6, "!! -- 7"), (7, "cat dog " * 9000), (7, "cat dog " * 9000), (8, "x" * 700_000 + " dog cat")]
ITEMS = [(1, "cat dog"), (1, "Cat, DOG; the"), (None, "dog the 7"), (4, None), (5, ""), (6, "nothing here"), (7, "éa Éa x")]


def search_tables(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, score int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("items_at_once", [1024, 2])
def test_lexical_search_on_odd_rows(spark, monkeypatch, items_at_once):
    """Nulls, repeats, ties, long texts and terms, clashing columns, and items in several blocks."""
    monkeypatch.setattr(lexical_search, "ITEMS", items_at_once)
    got = lexical_search.ranked(*search_tables(spark, DOCS, ITEMS))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == searched(DOCS, ITEMS)
    assert lexical_search.ranked(*search_tables(spark, [], ITEMS)).count() == lexical_search.ranked(*search_tables(spark, DOCS, [])).count() == 0


def test_lexical_search_of_many_ties(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 6)))) for k in range(600)]
    items = [(k, " ".join(rng.choices("abcdefghij", k=5))) for k in range(40)]
    got = lexical_search.ranked(*search_tables(spark, docs, items))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == searched(docs, items)


def test_shared_sums_are_the_items():
    rng = random.Random(5)
    sets = [set(rng.sample(range(60), rng.randint(0, 25))) for _ in range(80)] + [set(range(30))] * 3
    pairs, sums = lexical_search.shared(sets, 60)
    value = np.zeros(60 + len(pairs), np.int64)
    value[:60] = [3**k % 1_000_003 for k in range(60)]
    for node, a, b in lexical_search.levels(pairs, 60):
        value[node] = value[a] + value[b]
    assert [value[s].sum() if s else 0 for s in sums] == [sum(3**t % 1_000_003 for t in s) for s in sets]
    assert len(pairs) + sum(max(0, len(s) - 1) for s in sums) < 0.8 * sum(max(0, len(s) - 1) for s in sets)
    held = [{t for t in range(60 + len(pairs)) if t in s} for s in sums]
    assert not any(len(a & b) > 1 for k, a in enumerate(held) for b in held[:k])  # no pair is left that two items share


def coded(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by the definition, in plain integers."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, label, v + [0] * (parts * size - len(v))) for i, label, v in kept]
    books = [[v[p * size : p * size + size] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size : p * size + size], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for p in range(parts):
            for _, _, v in kept:
                groups[p, near(p, v)[1]].append(v[p * size : p * size + size])
        for (p, e), vs in groups.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, label, [near(p, v) for p in range(parts)]) for i, label, v in kept]
    errors = collections.Counter()
    for _, label, n in found:
        errors[label] += sum(f for f, _ in n)
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), sum(f for f, _ in n), errors[label], sha) for i, label, n in found), key=repr)


@pytest.mark.parametrize("width,block", [(32, 1 << 20), (16, 64), (20, 100)])
def test_vector_codes(spark, tmp_path, monkeypatch, width, block):
    """Against plain integers: nulls, non-finite and huge components, repeats, ties, short vectors, a clashing column, and blocks of a few rows."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(width)
    rows = [(int(k), int(k % 3) if k % 4 else None, [float(np.float32(x)) for x in rng.normal(size=width)]) for k in rng.permutation(150)]
    rows += [(3, 1, rows[0][2]), (3, 1, rows[0][2]), (None, 2, rows[1][2]), (200, None, None), (201, 1, [None] * width), (202, 1, [math.nan] * width), (203, 1, [math.inf] * width), (204, 9, [1.0] * 3), (205, 9, [30_000.0] * width), (206, 2, [-0.001] * width)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op12_vector_codes(spark, str(tmp_path))
    assert rows_of(got, "vec_id", "code", "error", "label_error", "codebooks_sha256") == coded([(i, label, None if v is None else v) for i, label, v in rows])


def test_vector_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, label string, embedding array<double>"
    few = [(1, "a", [0.5] * 16), (2, None, [0.25] * 16)]
    codes, books = vector_codes.compressed(spark.createDataFrame(few, schema))
    assert books.shape == (16, 2, 1) and rows_of(codes, "vec_id", "code", "error") == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    assert vector_codes.compressed(spark.createDataFrame([], schema))[0].count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, "a", [])], schema))[0].first()["code"] == "00" * 16
    huge = vector_codes.compressed(spark.createDataFrame([(1, "a", [1e30] * 16), (2, "b", [-1e30] * 16)], schema))[0]
    assert huge.count() == 2 and huge.filter("error < 0").count() == 0


def without_passages(rows, window=50):
    """(id, words, removed, digest of the rest) by the definition."""
    split = [(i, WORDS.findall((t or "").encode())) for i, t in rows]
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def made_texts(rng):
    """Passages of 40 to 200 words in texts of words of their own: whole, in part, twice in one text, one after the other, periodic, and at both ends of a text."""
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [own(n) for n in (40, 49, 50, 51, 80, 200)] + [["a"] * 120, ["a", "b"] * 70, ["x", "y", "z"] * 40]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p) // 2)
            text += own(rng.choice([0, 1, 30])) + (p if rng.random() < 0.6 else p[cut:] if rng.random() < 0.5 else p[: len(p) - cut])
        rows.append((k, rng.choice([" ", "\n", "\t ", " \r\n"]).join(text + own(rng.choice([0, 5])))))
    return rows


@pytest.mark.parametrize("block_bytes,longest", [(passages.BLOCK_BYTES, passages.LONGEST), (3000, 7)])
def test_passages(spark, block_bytes, longest):
    rng = random.Random(longest)
    rows = made_texts(rng)
    rows += [(i, rows[40 + k][1]) for k, i in enumerate((3, 3, 200, 201, None, None))] + [(300, None), (301, ""), (302, " \n"), (None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, words string, id int").repartition(5)
    got = passages.without_passages(frame, block_bytes=block_bytes, longest=longest)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == without_passages(rows)


def test_passages_of_long_texts_and_crowds(spark):
    """A text of several MB twice with one word changed, one word that has no end, and a passage that a thousand documents have."""
    rng = random.Random(11)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = [*long[:150_000], "other", *long[150_001:]]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "x" * 2_000_000), (4, "x" * 2_000_000)] + [(10 + k, f"own{k} {passage} last{k}") for k in range(1000)]
    got = {r["doc_id"]: r for r in passages.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 299_999 and got[2]["kept_sha256"] == hashlib.sha256(b"other").hexdigest()
    assert got[3]["n_removed"] == got[4]["n_removed"] == 0 and got[4]["n_words"] == 1
    assert got[10]["n_removed"] == 0 and all(got[10 + k]["n_removed"] == 60 for k in range(1, 1000))


def test_automata_go_over_shards_and_pieces(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 16)
    found = [([b"a", b"b", b"c"], 1), ([b"b", b"c"], 2), ([b"d"], 3), ([b"c", b"d", b"a", b"b"], 4)]
    for shard in (2, 5, 100):
        got = sorted(passages.Automata(found, shard).occurrences(b"a  b\nc d a b c zz"))
        assert got == [(0, 3, 1), (1, 3, 2), (2, 6, 4), (3, 4, 3), (4, 7, 1), (5, 7, 2)]
    assert list(passages.Automata([]).occurrences(b"a")) == []


def test_cut_rows():
    """Pieces join to their rows, are no longer than the limit but for runs without a break, and begin at breaks."""
    rng = random.Random(2)
    is_break = np.array([x == 32 for x in range(256)])
    for _ in range(200):
        texts = ["".join(rng.choices("ab ", weights=[5, 5, rng.random()], k=rng.choice([0, 1, 9, 60, 400]))).encode() for _ in range(rng.randint(1, 5))]
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        cuts, owner = common.cut_rows(buf, off, is_break, 16)
        parts = [buf[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert [b"".join(p for p, o in zip(parts, owner, strict=True) if o == k) for k in range(len(texts))] == texts
        assert [b for t in texts for b in t.split()] == [b for p in parts for b in p.split()]
        assert all(len(p) <= 16 or b" " not in p[1:-1] or b" " not in p[1:16] for p in parts)


def test_lines_that_share_a_digest_alone_stay(spark):
    """With digests of four bits: only lines that brute force removes go, and nearly nothing repeated stays with whole ones."""
    rng = random.Random(8)
    shared = [[f"line {k} {rng.random()}" for k in range(n)] for n in (2, 3, 7)]
    rows = [(k, "\n".join(sum((rng.choice([*shared, [f"own {rng.random()}" for _ in range(3)]]) for _ in range(4)), []))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = without_repeated_runs(rows)
    for digest in (lambda raw: bytes([hashlib.sha256(raw).digest()[0] & 15]), line_dedup._digest):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame, digest=digest).collect()}
        for i, t in rows:
            lines, left = t.split("\n"), got[i].split("\n") if got[i] else []
            gone = collections.Counter(lines) - collections.Counter(left)
            allowed = collections.Counter(lines) - collections.Counter(want[i][0].split("\n"))
            assert not gone - allowed and len(left) == len(lines) - gone.total()
            assert digest is not line_dedup._digest or got[i] == want[i][0]


def test_words_of_any_length(monkeypatch):
    """The trie and what goes on below it against one word at a time, with limits of all sizes; and a word of a million bytes in seconds."""
    import public_tokenizers

    rng = random.Random(1)
    arrays = lambda words: (np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])[:-1], np.cumsum([len(w) for w in words]))
    large = token_counts.Unigram(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    base = "".join(rng.choice(["the", "ing", "über", "日本", "x", "Q9", "tion"]) for _ in range(400)).encode()
    words = [base + bytes(rng.choices(b"abcdef", k=n)) for n in (0, 1, 5, 50, 2000)] + [base[:n] for n in (505, 509, 510, 511, 512, 513)] + [b"a", b"ab" * 300]
    small = token_counts.Unigram([b"a", b"ab", b"abc", b"cd", b"abcabcabc", b"d"])
    short = [bytes(rng.choices(b"abcde", k=n)) for n in range(1, 60)]
    for levels, step in ((512, 1 << 16), (512, 37), (9, 5), (4, 3), (1, 1)):
        monkeypatch.setattr(token_counts, "LONG", levels)
        monkeypatch.setattr(token_counts, "STEP", step)
        for model, some in ((large, words), (small, short)):
            assert model.counts(*arrays(some)).tolist() == [model.count_one(w) for w in some]
    monkeypatch.setattr(token_counts, "LONG", 512)
    monkeypatch.setattr(token_counts, "STEP", 1 << 16)
    assert 300_000 < large.counts(*arrays([bytes(rng.choices(b"abcdefghijklmnop", k=1_000_000))]))[0] < 1_000_000


def test_many_languages(spark):
    """Three hundred languages, the rarest with a document each to learn from: all are predicted, by words of their own."""
    rng = random.Random(6)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 8))) for _ in range(12)] for k in range(300)}
    rows = [(f"l{k:03d}", " ".join(rng.choices(words[f"l{k:03d}"], k=40))) for k in range(300) for _ in range(6 if k % 2 else 12)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    field = language.fit(docs)
    assert len(field.labels) == 300
    got = language.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.9 and got["lang_pred"].nunique() > 290


def test_similar_texts_in_crowds(spark):
    """Pairs of 0.8 and more in bands, each with unlike texts around, and a crowd of four hundred copies with edits of one text, most of them less alike to each other
    than to it: nine in ten and more of each band are joined, and nothing unlike."""
    rng = random.Random(3)
    own = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    texts, pairs = [], []
    for k in range(300):
        a = own(200)
        b = list(a)
        for p in rng.sample(range(40), (1, 2, 4)[k % 3]):
            b[5 * p] = own(1)[0]
        pairs.append((len(texts), len(texts) + 1))
        texts += [a, b]
    base = own(200)
    crowd = [len(texts)]
    texts.append(base)
    for _ in range(400):
        new = list(base)
        for p in rng.sample(range(40), rng.randint(1, 4)):
            new[5 * p] = own(1)[0]
        crowd.append(len(texts))
        texts.append(new)
    texts += [own(rng.randint(3, 200)) for _ in range(300)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in texts]
    got = {r["doc_id"]: r["component_id"] for r in similar_texts.similar(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")).collect()}
    bands = collections.defaultdict(list)
    for i, j in pairs:
        alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        if alike >= 0.8:
            bands[min(int(alike * 20), 19)].append(got[i] == got[j])
        else:
            assert got[i] != got[j]
    assert sum(map(len, bands.values())) > 150 and len(bands) >= 3 and all(np.mean(x) >= 0.9 for x in bands.values())
    near = [i for i in crowd if len(sets[i] & sets[crowd[0]]) >= 0.8 * len(sets[i] | sets[crowd[0]])]
    assert np.mean([got[i] == crowd[0] for i in near]) >= 0.99
    assert len({got[i] for i in range(len(texts))} - {got[i] for i in crowd} - {got[i] for p in pairs for i in p}) == 300


def test_parities_are_a_bound():
    rng = np.random.default_rng(11)
    close = 0
    for n in (0, 1, 5, 80, 600, 5000):
        x = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        for gone in (0.0, 0.1, 0.5, 1.0):
            y = np.union1d(x[rng.random(len(x)) >= gone], rng.integers(0, 2**32, int(n * gone), dtype=np.uint32))
            odd = similar_texts.parities([x, y])
            differ = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(x, y))
            close += differ > 0.7 * len(np.setxor1d(x, y)) > 0
    assert close >= 8 and similar_texts.parities([]).shape == (0, 8)


def test_pairs_of_a_key_lose_none_that_are_alike():
    """All pairs of sets that are alike and of different roots, against what the filters leave."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    base = [np.unique(rng.integers(0, 2**32, n, dtype=np.uint32)) for n in (3, 40, 300)]
    sets = [np.union1d(b[rng.random(len(b)) >= rng.choice([0.05, 0.1, 0.2])], rng.integers(0, 2**32, len(b) // 20, dtype=np.uint32)) for b in base for _ in range(30)]
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int64)), pa.array(np.arange(len(sets))), pa.array(np.arange(len(sets)) // 2), pa.array([x.astype("<u4").tobytes() for x in sets])], ["group", "node", "root", "shingles"])
    frequency = np.zeros(1 << 20, np.int64)
    for x in sets:
        np.add.at(frequency, x >> np.uint32(12), 1)
    (lists,) = similar_texts._prefixes(frequency, 0.8)(iter([rows]))
    lists = lists.sort_by([("key", "ascending"), ("size", "ascending"), ("node", "ascending")])
    found = {p for out in similar_texts._apart(0.8, True)(iter([lists.slice(0, 500), lists.slice(500)])) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i // 2 != j // 2 and similar_texts.alike(sets[i], sets[j], 0.8)}
    assert want <= found and len(want) > 100


def test_expected_transitions():
    """Against the sum over all label sequences, chains of different lengths together."""
    rng = np.random.default_rng(4)
    emit, moves = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    start, end = np.array([0, 5, 6]), np.array([5, 6, 11])
    want = np.zeros((3, 3))
    for s, e in zip(start, end, strict=True):
        total, weights = np.zeros((3, 3)), 0.0
        for path in np.ndindex(*[3] * (e - s)):
            steps = list(zip(path, path[1:], strict=False))
            w = np.exp(sum(emit[s + t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in steps))
            weights += w
            for a, b in steps:
                total[a, b] += w
        want += total / weights
    marginal, expected = language.forward_backward(emit, start, end, moves, pairs=True)
    assert np.allclose(expected, want) and np.allclose(marginal.sum(1), 1)


def test_training_is_the_gradient_of_the_likelihood():
    """The change of the log likelihood of one chain by each weight of the transitions, by differences, is seen minus expected transitions."""
    rng = np.random.default_rng(5)
    emit, moves, truth = rng.normal(size=(7, 4)), rng.normal(size=(4, 4)), rng.integers(0, 4, 7)

    def likelihood(m):
        best = emit[0].copy()
        for t in range(1, 7):
            best = np.log(np.exp(best[:, None] + m).sum(0)) + emit[t]
        return emit[np.arange(7), truth].sum() + m[truth[:-1], truth[1:]].sum() - np.log(np.exp(best).sum())

    _, expected = language.forward_backward(emit, np.array([0]), np.array([7]), moves, pairs=True)
    seen = np.zeros((4, 4))
    np.add.at(seen, (truth[:-1], truth[1:]), 1)
    for a in range(4):
        for b in range(4):
            step = np.zeros((4, 4))
            step[a, b] = 1e-6
            assert abs((likelihood(moves + step) - likelihood(moves - step)) / 2e-6 - (seen - expected)[a, b]) < 1e-6


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got, *names) == sorted(map(tuple, want.fetchall()), key=repr)
