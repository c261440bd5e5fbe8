"""Packing documents into token sequences by shortest-pack-first over the histogram of lengths.

A document's ids (and an end id) are cut into pieces of ``MAX_TOKENS`` and a rest. Only the histogram of piece lengths, at most ``MAX_TOKENS`` rows,
reaches the driver: lengths are placed longest first, all pieces of a length at once, each into the shortest pack that has room, and what is kept are
counts of packing patterns. Each pattern then owns a range of ranks of every length it holds, and pieces join it by length and rank.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
import zlib
from array import array
from pathlib import Path

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, save, text_buffer
from .ranks import ranked

MAX_TOKENS, END_ID = 2048, 1
#: Words whose ids a Python worker remembers, in two generations; those that are met again move to the newer one.
CACHE_WORDS = 250_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

# Of words in these characters, lower-cased, the tokenizer's own parts; in this range no normalisation changes them further.
_PLAIN = re.compile("[!-~\u00a1-\u017f]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\\w]|_)+")
_SELVES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level models write a byte as a printable character: itself, or else the next from U+0100 on.
_SHOWN = {b: 0x100 + n for n, b in enumerate(sorted(set(range(256)) - set(_SELVES)))}


class WordIds:
    """From a word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit bytes. The tokenizer drops white space, and no token or
    normalisation reaches across it, so a text's ids are those of its words side by side."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(Path(path).read_text())
        self.plain = parts["pre_tokenizer"]["pretokenizers"][1:] and parts["model"]["type"] == "BPE" and [a["content"][:2] for a in parts["added_tokens"]] == ["<|", "<|"]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(_SHOWN)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._part, _PARTS.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, words: list[bytes]) -> bytes:
        new, old = self.new, self.old
        for w in set(words).difference(new):
            ids = old.get(w)
            new[w] = self._ids(w) if ids is None else ids
        found = b"".join(map(new.__getitem__, words))
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        return found


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, which serves many tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and with ``ids``, the ids themselves) of every piece. Null text counts as empty: one piece with
    the end id alone. Null and repeated ids keep a row for each of their pieces."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        known = word_ids(tokenizer)
        for b in batches:
            buf, off = text_buffer(b.column(1))
            names = b.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for i, name in enumerate(names):
                words = buf[off[i] : off[i + 1]].tobytes().split()
                raw = known.of(words) + end
                total = len(raw) // 4
                for s in range(0, total, max_tokens):
                    part = raw[4 * s : 4 * (s + max_tokens)]
                    for column, x in zip(out, (name, s, len(part) // 4, zlib.crc32(part), total, part if ids else None), strict=True):
                        column.append(x)
                if len(out[0]) >= 20_000:
                    yield batch(out)
                    out = [[], [], [], [], [], []]
            yield batch(out)

    def batch(out):
        arrays = [pa.array(c, pa.int64()) for c in out[:5]]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(out[5], pa.binary())] if ids else []), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def patterns(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, copies), ...]) for the pieces counted in ``histogram``, by shortest-pack-first."""
    if any(not 1 <= n <= size for n in histogram):
        raise ValueError(f"lengths are 1 to {size}")
    order = itertools.count()
    open_: list[tuple[int, int, int, list]] = []  # (used, order, packs, [(length, copies)]), shortest first
    done = []
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left and open_ and open_[0][0] + n <= size:
            used, _, packs, held = heapq.heappop(open_)
            take = min(left, packs)
            if take < packs:
                heapq.heappush(open_, (used, next(order), packs - take, list(held)))
            if held[-1][0] == n:
                held[-1] = (n, held[-1][1] + 1)
            else:
                held.append((n, 1))
            left -= take
            heapq.heappush(open_, (used + n, next(order), take, held))
        each = size // n
        for packs, copies in ((left // each, each), (1, left % each)):
            if packs and copies:
                heapq.heappush(open_, (n * copies, next(order), packs, [(n, copies)]))
        while open_ and open_[0][0] == size:  # the shortest is full, so all are
            done.append(heapq.heappop(open_)[2:])
    return [(packs, held) for packs, held in done] + [(packs, held) for _, _, packs, held in sorted(open_)]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, packs, first sequence, offset) of each pattern's share of a length."""
    out, taken, sequence = [], {}, 0
    for packs, held in found:
        offset = 0
        for n, copies in held:
            first = taken.get(n, 0)
            taken[n] = first + packs * copies
            out.append((n, first, taken[n], packs, sequence, offset))
            offset += n * copies
        sequence += packs
    return out


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces ``doc_id, start, length, ...``. Sequences are gapless from offset 0. An empty table gives none."""
    counted = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_tokens rows at most
    table = slots(patterns(counted, max_tokens))
    spark = rows.sparkSession
    held = spark.createDataFrame(table, "s_length long, s_first long, s_end long, s_packs long, s_sequence long, s_offset long")
    # a slot for each length and pattern: bounded by the histogram, not by the pieces
    at = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_end"))
    place = F.col("rank") - F.col("s_first")
    packed = ranked(rows, ["length"], ["doc_id", "start", "ids_crc32"], sum(counted.values())).join(F.broadcast(held), at)
    sequence, offset = F.col("s_sequence") + place % F.col("s_packs"), F.col("s_offset") + F.floor(place / F.col("s_packs")) * F.col("length")
    return packed.withColumn("sequence_id", sequence).withColumn("offset", offset.cast("long")).select(*rows.columns, "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of all documents. A null or empty text is one piece, the end id; null and
    repeated ids and repeated rows keep their own pieces; pieces of one length are interchangeable, ties between them go by id, start and digest; an empty table
    gives no row."""
    stored, _ = save(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(stored)
