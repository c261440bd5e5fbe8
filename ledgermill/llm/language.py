"""Language identification by a linear-chain conditional random field over words.

A line of text is a chain of words. Features of a word are its beginning and end (affixes), its character 2-grams and 3-grams and itself (lexicon), hashed
to ``BUCKETS`` weights for each language; transitions between the languages of neighbours are learnt too. Forward-backward labels every word, so texts that
switch languages get a label a word; a text's language is the one with the greatest sum of its words' marginals.

The field is fitted by AdaGrad on a bounded sample of labelled documents, whose word runs are also joined at random to code-switched chains of ``CHAIN``
words: at most ``SAMPLE_DOCS`` documents a language and ``SAMPLE_TOTAL`` in all, but one at least of each, drawn by a hash over all documents of a language; of
a longer document, a stretch of ``SAMPLE_CHARS`` code points. Every language is learnt: rows are bounded, languages are not.

Forward-backward is exact for lines of any length: a line longer than a block is worked on block by block at once, with the product of its transition
matrices carried from block to block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, Chunk, documents, held_out, ragged, text_chunks

BUCKETS, CHAIN, CHAINS, CHAINS_EACH, EPOCHS, STEP = 1 << 16, 40, 4000, 30, 3, 0.15
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 300, 2400, 20_000
UNKNOWN = "und"


class Words:
    """Feature buckets of distinct words."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        n = end - start
        at, owner = ragged(start, end)
        first = np.cumsum(n + 2) - n - 2  # where each marked word begins
        marked = np.empty(int((n + 2).sum()), np.int64)
        byte = buf[at].astype(np.int64)
        byte += 32 * ((byte >= 65) & (byte <= 90))
        marked[first] = 2
        marked[first + n + 1] = 3
        marked[at - np.repeat(start, n) + np.repeat(first + 1, n)] = byte
        last = first + n + 1
        mult, mask = 0x9E3779B1, BUCKETS - 1
        bucket = lambda code, kind: ((code * 8 + kind) * mult >> 11) & mask
        two = marked[:-1] << 8 | marked[1:]
        three = two[:-1] << 8 | marked[2:]
        keep2, keep3 = np.ones(len(marked), bool), np.ones(len(marked), bool)
        keep2[last] = False
        keep3[last] = keep3[last - 1] = False
        self.grams = [(bucket(two, 1)[keep2[:-1]], np.cumsum(n + 1) - n - 1), (bucket(three, 2)[keep3[:-2]], np.cumsum(n) - n)]
        up_to = lambda k: np.minimum(first + k, last)
        begin = marked[first + 1] << 24 | marked[up_to(2)] << 16 | marked[up_to(3)] << 8 | marked[up_to(4)]
        back = lambda k: np.maximum(last - k, first)
        close = marked[last - 1] << 24 | marked[back(2)] << 16 | marked[back(3)] << 8 | marked[back(4)]
        whole = np.add.reduceat(marked * (np.arange(len(marked)) - np.repeat(first, n + 2) + 1) ** 3, first) if len(n) else n
        self.single = [bucket(begin, 3), bucket(begin >> 8, 4), bucket(close, 5), bucket(close >> 8, 6), bucket(whole * 64 + np.minimum(n, 63), 7)]
        self.size = len(n)
        self._all = self._owner = None

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, weights.shape[1]))
        if self.size:
            for k in self.single:
                out += weights[k]
            for k, first in self.grams:
                out += np.add.reduceat(weights[k], first, axis=0)
        return out

    def gradient(self, by_word: np.ndarray) -> np.ndarray:
        if self._all is None:
            sizes = [(k, np.diff(np.append(first, len(k)))) for k, first in self.grams]
            self._all = np.concatenate([*self.single, *(k for k, _ in sizes)])
            self._owner = np.concatenate([*[np.arange(self.size)] * len(self.single), *(np.repeat(np.arange(self.size), n) for _, n in sizes)])
        return np.stack([np.bincount(self._all, weights=by_word[self._owner, c], minlength=BUCKETS) for c in range(by_word.shape[1])], 1)


def _normal(a: np.ndarray) -> np.ndarray:
    """Each entry of the first axis divided by its sum."""
    total = a.sum(axis=tuple(range(1, a.ndim)), keepdims=True)
    return a / np.maximum(total, 1e-300)


def _blocks(size: np.ndarray, labels: int, block: int) -> int:
    """Words of a block, at least ``block``: so many that the transition matrices of all blocks of long chains stay small."""
    long = int(size[size > block].sum()) if len(size) else 0
    return max(block, long * labels**2 >> 22)


def _carried(score: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of chains in order, the forward vector just before each and the backward vector just after it; zeros where its chain begins or ends."""
    n, labels = len(start), step.shape[0]
    through = np.repeat(np.eye(labels)[None], n, axis=0)  # from before a block to its last word
    for t in range(int(size.max())):
        at = np.flatnonzero(size > t)
        through[at] = _normal((through[at] @ step) * score[start[at] + t][:, None, :])
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))  # these have no transition before their first word
    ends = score[start[first]]
    for t in range(1, int(size[first].max())):
        ends = _normal((ends @ step) * score[start[first] + t])  # a first block of a long chain is full
    before, after = np.zeros((n, labels)), np.zeros((n, labels))
    before[first[first + 1 < n] + 1] = _normal(ends[first + 1 < n])
    for k in range(1, n):
        if chain[k] == chain[k - 1]:
            if k > 1 and chain[k - 2] == chain[k]:
                before[k] = before[k - 1] @ through[k - 1]
                before[k] /= before[k].sum()
        else:
            before[k] = 0
    for k in range(n - 2, -1, -1):
        if chain[k] == chain[k + 1]:
            after[k] = through[k + 1] @ (after[k + 1] if after[k + 1].any() else np.ones(labels))
            after[k] /= after[k].sum()
    return before, after


def forward_backward(emit: np.ndarray, start: np.ndarray, end: np.ndarray, moves: np.ndarray, pairs: bool = False, block: int = 1024):
    """Marginals of each word's label for chains ``emit[start:end]`` (log scores), each word in one chain; with ``pairs``, also the expected transitions.
    Chains of more than ``block`` words are worked on in blocks at once, unless ``pairs`` are asked for."""
    n, labels = emit.shape
    if not n or not labels:
        return (emit, np.zeros((labels, labels))) if pairs else emit
    score = np.exp(emit - emit.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    size = end - start
    before = after = None
    if not pairs and size.max() > (block := _blocks(size, labels, block)):
        count = -(-size // block)
        chain = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
        begin = start[chain] + place * block
        size = np.minimum(block, end[chain] - begin)
        start = begin
        cut = np.flatnonzero(count[chain] > 1)
        before, after = np.zeros((len(start), labels)), np.zeros((len(start), labels))
        before[cut], after[cut] = _carried(score, step, start[cut], size[cut], chain[cut])
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # chains longer than t
    ahead, behind = np.zeros((n, labels)), np.zeros((n, labels))
    a = None
    for t, m in enumerate(alive.tolist()):
        at = start[:m] + t
        if a is None:
            a = score[at]
            if before is not None:
                inside = np.flatnonzero(before[order].any(1))
                a[inside] = (before[order[inside]] @ step) * a[inside]
        else:
            a = (a[:m] @ step) * score[at]
        a = a / a.sum(1, keepdims=True)
        ahead[at] = a
    expected = np.zeros((labels, labels))
    last = np.ones((len(start), labels))
    if after is not None:
        inside = np.flatnonzero(after[order].any(1))
        last[inside] = after[order[inside]]
    b = np.zeros((0, labels))
    for t in range(len(alive) - 1, -1, -1):
        m = int(alive[t])
        at = start[:m] + t
        new = last[:m].copy()
        if len(b):
            later = score[at[: len(b)] + 1] * b
            if pairs:
                here = ahead[at[: len(b)]]
                expected += step * ((here / ((here @ step) * later).sum(1, keepdims=True)).T @ later)
            new[: len(b)] = later @ step.T
        b = new / new.sum(1, keepdims=True)
        behind[at] = b
    marginal = ahead * behind
    marginal /= np.maximum(marginal.sum(1, keepdims=True), 1e-300)
    return (marginal, expected) if pairs else marginal


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word of the texts and the marginals of its labels."""
        start, end = c.words()
        _, first, inverse = np.unique(c.hashes(start, end), return_index=True, return_inverse=True)
        emit = Words(c.buf, start[first], end[first]).emissions(self.weights)[inverse]
        line = np.searchsorted(c.lines()[0], start, side="right")
        chain = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        return start, end, forward_backward(emit, chain, np.append(chain[1:], len(line)) if len(line) else chain, self.moves)


def train(texts: list[tuple[str, str]]) -> Field:
    """A field from (text, language) pairs."""
    texts = sorted(t for t in texts if t[0].split())
    labels = sorted({x for _, x in texts})
    if not labels:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    off = np.cumsum([0, *(len(t.encode()) for t, _ in texts)]).astype(np.int64)
    c = Chunk(np.frombuffer("".join(t for t, _ in texts).encode(), np.uint8), off)
    start, end = c.words()
    _, first, word = np.unique(c.hashes(start, end), return_index=True, return_inverse=True)
    words = Words(c.buf, start[first], end[first])
    truth = np.array([labels.index(x) for _, x in texts])[c.row_of(start)]
    of = [np.flatnonzero(truth == k) for k in range(len(labels))]
    rng = np.random.default_rng(2)
    count = max(CHAINS, CHAINS_EACH * len(labels))
    chains = np.empty((count, CHAIN), np.int64)
    for chain in chains:  # half of one language, half of runs of several
        at = 0
        while at < CHAIN:
            own = of[rng.integers(len(labels))]
            n = CHAIN - at if at == 0 and rng.random() < 0.5 else int(min(CHAIN - at, 1 + rng.geometric(1 / 10)))
            begin = int(rng.integers(max(1, len(own) - n)))
            chain[at : at + n] = own[(begin + np.arange(n)) % len(own)]
            at += n
    weights, moves = np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels)))
    past, past_moves = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(count), max(1, count // 250)):
            token = chains[batch].ravel()
            bounds = np.arange(len(batch) + 1) * CHAIN
            emit = words.emissions(weights)[word[token]]
            marginal, expected = forward_backward(emit, bounds[:-1], bounds[1:], moves, pairs=True)
            error = np.eye(len(labels))[truth[token]] - marginal
            by_word = np.stack([np.bincount(word[token], weights=error[:, k], minlength=words.size) for k in range(len(labels))], 1)
            grad = words.gradient(by_word) / len(batch) - 1e-5 * weights
            t = truth[chains[batch]]
            seen = np.bincount((t[:, :-1] * len(labels) + t[:, 1:]).ravel(), minlength=len(labels) ** 2).reshape(moves.shape)
            grad_moves = (seen - expected) / len(batch)
            past += grad**2
            past_moves += grad_moves**2
            weights += STEP * grad / np.sqrt(past)
            moves += STEP * grad_moves / np.sqrt(past_moves)
    return Field(labels, weights.astype(np.float32), moves)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``text, lang`` of the bounded sample that :func:`fit` learns from: of the rows with a language that aren't held out, those of the least draws in each
    language. All rows are drawn from, long ones too; only a few times the sample is sorted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\S") & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = min(SAMPLE_DOCS, max(1, SAMPLE_TOTAL // max(1, len(counts))))
    # a draw of 63 bits; of n rows, those below this share hold the least `each` but for a chance of less than one in 10**9
    shares = {lang: min(1.0, (2 * each + 60) / n) for lang, n in counts.items()}
    limits = docs.sparkSession.createDataFrame([(lang, min(int(share * 2**63), 2**63 - 1)) for lang, share in shares.items()], "of string, most long")
    drawn = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).join(limits, F.col("lang") == F.col("of")).filter(F.col("draw") <= F.col("most"))
    least = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).filter(F.col("n") <= each)
    begin = F.pmod(F.col("draw"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    return least.select(F.substring("text", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """A field from the rows of ``docs`` with a language that aren't held out. Without one, a field without labels."""
    return train([(r["text"], r["lang"]) for r in sample(docs, id_col, text_col, lang_col).collect()])


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_words, n_switches`` of every row: the text's language, its share of the marginals of words with a letter, these words,
    and how often the most likely label changes from one to the next. Without a letter, or with a field that has no label: ``und``, 0, 0, 0."""

    def run(batches):
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        names = np.array([*field.labels, UNKNOWN], dtype=object)
        for b in batches:
            out = []
            for _, _, c in text_chunks(b.column(1), 8 * CHUNK_BYTES // max(8, len(field.labels))):  # a number for each word and language
                start, end, marginal = field.marginals(c)
                sums = np.concatenate([[0], np.cumsum(letter[c.buf])])
                use = sums[end] > sums[start]
                row, marginal = c.row_of(start[use]), marginal[use]
                n = np.bincount(row, minlength=c.rows)
                mass = np.stack([np.bincount(row, weights=marginal[:, k], minlength=c.rows) for k in range(len(field.labels))], 1) if field.labels else np.zeros((c.rows, 1))
                best = mass.argmax(1)
                known = (n > 0) & bool(field.labels)
                plain = np.concatenate([[0], np.cumsum(letter[c.buf] & (c.buf < 128))])
                for k in np.flatnonzero(known & (plain[c.off[1:]] == plain[c.off[:-1]])).tolist():
                    known[k] = any(x.isalpha() for x in c.text(k).decode())
                top = marginal.argmax(1) if field.labels else np.zeros(len(row), np.int64)
                change = np.bincount(row[1:][(row[1:] == row[:-1]) & (top[1:] != top[:-1])], minlength=c.rows) if len(row) else np.zeros(c.rows, np.int64)
                score = np.where(known, mass[np.arange(c.rows), best] / np.maximum(n, 1), 0.0)
                out.append((np.where(known, best, len(field.labels)), np.clip(score, 0, 1), n * known, change * known))
            cat = lambda k, kind: np.concatenate([x[k] for x in out]).astype(kind) if out else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[cat(0, np.int64)], pa.string()), pa.array(cat(1, float)), pa.array(cat(2, np.int64)), pa.array(cat(3, np.int64))], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_words, n_switches`` of all documents. Null texts and texts without a letter are ``und`` with score 0, whether or not
    anything was learnt; null and repeated ids and repeated rows keep a row each; a null id is held out as the empty text is; an empty table gives no row."""
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
