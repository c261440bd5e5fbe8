"""Token counts of a unigram segmenter by dynamic programming over a trie.

Words (runs without ASCII white space, with the vocabulary's word mark in front) are cut into vocabulary pieces so that the sum of their scores is
greatest. Each task inserts the distinct words of its rows in a trie, level by level, and computes the best score of a path once per node, so once per
shared prefix; a word's count is stored at its terminal node. Below ``LONG`` bytes words hardly share anything: there each node has one child, so a longer word goes on from
its node alone, with the pieces that end at each of its bytes looked up for many bytes at once. Rows never leave their task: there is no shuffle.

Scores: log probabilities by Zipf's law over the order of the vocabulary file, ``-log(rank + 1) - log(H)``. A byte that no piece covers is a token of its
own with the least score less 10. Ties go to fewer tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, documents, mix, text_chunks

MARK = "▁".encode()
#: Words that a task remembers; then it starts anew. Levels of the trie that words share, in bytes, and how many bytes of a longer word are looked up at once.
CACHE_WORDS, LONG, STEP = 1_000_000, 512, 1 << 16
_BITS = 20


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece file in the order of their ids, without its control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not any(f(i) for f in own)]


def zipf_scores(n: int) -> np.ndarray:
    ranks = np.arange(1, n + 1)
    return -np.log(ranks) - np.log((1 / ranks).sum())


class Unigram:
    """A vocabulary with scores."""

    def __init__(self, pieces: list[bytes]):
        scores = zipf_scores(len(pieces))
        self.scores: dict[bytes, float] = {}
        for p, s in zip(pieces, scores.tolist(), strict=True):
            self.scores.setdefault(p, s)
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = float(scores[-1]) - 10 if len(scores) else -10.0
        names = list(self.scores)
        self._arrays = self._table(names)

    def _table(self, names):
        buf = np.frombuffer(b"".join(names), np.uint8)
        end = np.cumsum([len(x) for x in names]).astype(np.int64)
        start = end - np.array([len(x) for x in names], np.int64)
        up, down = _powers(len(buf) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        order = np.argsort(h)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return h[order], np.array([self.scores[x] for x in names])[order], maybe

    def count_one(self, word: bytes) -> int:
        """Plain Viterbi over one word."""
        word = MARK + word
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for i in range(1, len(word) + 1):
            b, c = best[i - 1]
            top = (b + self.scores.get(word[i - 1 : i], self.unknown), c - 1)
            for k in range(2, min(i, self.longest) + 1):
                s = self.scores.get(word[i - k : i])
                if s is not None:
                    b, c = best[i - k]
                    top = max(top, (b + s, c - 1))
            best[i] = top
        return -best[-1][1]

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each of the distinct words ``buf[start:end]`` by one pass over their trie."""
        out = np.zeros(len(start), np.int64)
        alive = np.arange(len(start))
        keys, scores, maybe = self._arrays
        up, down = _powers(LONG + len(MARK) + 2)
        parents, best, tokens, sums = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        node = np.zeros(len(alive), np.int64)  # of each word that is still going, at this depth
        mark, depth = np.frombuffer(MARK, np.uint8), 0
        while len(alive):
            if depth == LONG:
                for word, n in zip(alive.tolist(), node.tolist(), strict=True):
                    path = [n]
                    for k in range(min(depth, self.longest - 1)):
                        path.append(int(parents[depth - k][path[-1]]))
                    held = [(float(best[depth - k][x]), int(tokens[depth - k][x])) for k, x in enumerate(path)][::-1]
                    out[word] = self._tail(np.concatenate([mark, buf[start[word] : end[word]]])[depth + 1 - len(held) :], held)
                break
            if depth < len(mark):
                byte = np.full(len(alive), mark[depth], np.int64)
            else:
                at = start[alive] + depth - len(mark)
                done = at >= end[alive]
                out[alive[done]] = tokens[-1][node[done]]
                alive, node, at = alive[~done], node[~done], at[~done]
                if not len(alive):
                    break
                byte = buf[at].astype(np.int64)
            path, node = np.unique(node * 256 + byte, return_inverse=True)
            parent = path >> 8
            depth += 1
            parents.append(parent)
            sums.append(sums[-1][parent] + ((path & 255).astype(np.uint64) + np.uint64(1)) * up[depth - 1])
            score, fewest = best[-1][parent] + self.unknown, tokens[-1][parent] + 1
            up_to = np.arange(len(path))
            for k in range(1, min(depth, self.longest) + 1):
                up_to = parents[depth - k + 1][up_to]
                h = mix((sums[-1] - sums[depth - k][up_to]) * down[depth - k] + np.uint64(k))
                hit = np.flatnonzero(maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                if not len(hit):
                    continue
                place = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                same = keys[place] == h[hit]
                hit, place = hit[same], place[same]
                new, n = best[depth - k][up_to[hit]] + scores[place], tokens[depth - k][up_to[hit]] + 1
                better = (new > score[hit]) | ((new == score[hit]) & (n < fewest[hit])) if k > 1 else np.ones(len(hit), bool)
                score[hit[better]], fewest[hit[better]] = new[better], n[better]
            best.append(score)
            tokens.append(fewest)
        return out


    def _tail(self, raw: np.ndarray, held: list[tuple[float, int]]) -> int:
        """Tokens of a word whose last bytes are ``raw``; ``held``: score and tokens of the best path to each of the first places between them."""
        keys, scores, maybe = self._arrays
        for done in range(len(held) - 1, len(raw), STEP):
            known = len(held) - 1
            part = raw[done - known : done + STEP]
            up, down = _powers(len(part) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1])])
            ends, sizes, gains = [], [], []
            for k in range(1, min(len(part), self.longest) + 1):
                first = max(known + 1, k)  # a piece that ends at a new place, and begins in this part
                stop = np.arange(first, len(part) + 1)
                h = mix((sums[first:] - sums[first - k : len(sums) - k]) * down[first - k : len(sums) - k] + np.uint64(k))
                hit = np.flatnonzero(maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1) if len(keys) else hit[:0]
                hit, place = (x[keys[place] == h[hit]] for x in (hit, place)) if len(keys) else (hit[:0], hit[:0])
                ends.append(stop[hit])
                sizes.append(np.full(len(hit), k))
                gains.append(scores[place])
            ends, sizes, gains = (np.concatenate(x) for x in (ends, sizes, gains))
            order = np.lexsort((sizes, ends))
            bounds = np.searchsorted(ends[order], np.arange(known + 1, len(part) + 2)).tolist()
            sizes, gains = sizes[order].tolist(), gains[order].tolist()
            best = list(held)
            for i in range(len(part) - known):
                score, fewest = best[-1]
                top = (score + self.unknown, fewest + 1)
                for k in range(bounds[i], bounds[i + 1]):
                    score, fewest = best[-sizes[k]]
                    new = (score + gains[k], fewest + 1)
                    if sizes[k] == 1 or new[0] > top[0] or (new[0] == top[0] and new[1] < top[1]):
                        top = new
                best.append(top)
            held = best[-max(1, self.longest) :]
        return held[-1][1]


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_distinct, n_tokens`` of every row: its words, its different words, and its tokens. Null and empty texts have none of them;
    null and repeated ids are kept."""

    def run(batches):
        model = Unigram(pieces)
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            out = []
            for _, _, c in text_chunks(b.column(1), 4 << 20):
                start, end = c.words()
                h, first, inverse = np.unique(c.hashes(start, end), return_index=True, return_inverse=True)
                place = np.searchsorted(known, h)
                old = np.zeros(len(h), bool)
                if len(known):
                    old = known[np.minimum(place, len(known) - 1)] == h
                here = np.zeros(len(h), np.int64)
                here[old] = counts[place[old]] if len(known) else 0
                here[~old] = model.counts(c.buf, start[first[~old]], end[first[~old]])
                if len(known) + (~old).sum() > CACHE_WORDS:
                    known, counts = h, here
                else:
                    merged = np.concatenate([known, h[~old]])
                    order = np.argsort(merged, kind="stable")
                    known, counts = merged[order], np.concatenate([counts, here[~old]])[order]
                row = c.row_of(start)
                pairs = np.unique(row * len(h) + inverse) if len(h) else np.zeros(0, np.int64)
                out.append([np.bincount(row, minlength=c.rows), np.bincount(pairs // max(1, len(h)), minlength=c.rows), np.bincount(row, weights=here[inverse], minlength=c.rows)])
            columns = [np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_distinct", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_distinct long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_distinct, n_tokens`` of all documents, with the pieces of the public 32k vocabulary. Null and empty texts count 0; null and repeated ids
    and repeated rows keep a row each; of equally good cuts that with fewer tokens counts; an empty table gives no row."""
    return token_counts(documents(spark, sf_dir), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
