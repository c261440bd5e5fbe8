"""Keyword counts for lists of any length: the list is a table, and words of the pages are joined with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save
from .keywords import distinct_keywords, normal_text

#: Letters by which places are first looked up, where phrases have so many.
STEM = 8
#: Bits of the table of phrases: at least 16 for each, at most these.
MOST_BITS = 1 << 27
#: Letters of pages that are looked at together.
LETTERS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class _Words:
    """Texts as words; a phrase begins and ends with whole words."""

    of = staticmethod(lambda text: F.split(text, " "))
    cut, size, blanks = staticmethod(F.slice), staticmethod(F.size), True
    text = staticmethod(lambda text: text)


class _Letters:
    """Texts as letters without blanks; a phrase may begin anywhere."""

    of = staticmethod(lambda text: F.replace(text, F.lit(" "), F.lit("")))
    cut, size, blanks = staticmethod(F.substring), staticmethod(F.length), False
    text = of


def _knotted(unit, phrase: Column) -> Column:
    """Whether a phrase can begin before an earlier one of it has ended."""
    n = unit.size(phrase)
    return (n > 1) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: unit.cut(phrase, k + 1, n - k) == unit.cut(phrase, F.lit(1), n - k))


def _apart(places: Column, size: Column) -> Column:
    """How many of ``places`` are taken from left to right, if each covers ``size``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("free"))
    take = lambda s, p: F.when(p >= s["free"], F.struct((s["n"] + 1).alias("n"), (p + size).alias("free"))).otherwise(s)
    return F.aggregate(F.array_sort(places), start, take, lambda s: s["n"])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _hashes(letters: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
    """A function that hashes ``letters[i : i + n]`` for many places i at once."""
    with np.errstate(over="ignore"):
        upto = np.concatenate([[np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[0][: len(letters)], dtype=np.uint64)])

    def of(at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (upto[at + n] - upto[at]) * powers[1][at] + np.uint64(n)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(29))

    return of


def _listed_bits(phrases: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of ``bits`` bits in bytes: of the phrases, and of the first letters of those that have ``STEM`` or more. Tasks make places of bits, which are put together by
    words before they come to the driver."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                texts = [x.encode() for x in b.column(0).slice(at, 8192).to_pylist()]
                buf = np.frombuffer(b"".join(texts), np.uint8)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                of, start = _hashes(buf, _powers(len(buf))), np.cumsum(size) - size
                found = [(0, of(start[size == n], n)) for n in np.unique(size).tolist()] + [(1, of(start[size >= STEM], STEM))]
                kind = np.concatenate([np.full(len(x), k, np.int8) for k, x in found])
                place = (np.concatenate([x for _, x in found]) % np.uint64(bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place >> 6), pa.array(np.int64(1) << (place & 63))], ["kind", "word", "bit"])

    made = phrases.select("__phrase").mapInArrow(run, "kind byte, word long, bit long").groupBy("kind", "word").agg(F.bit_or("bit").alias("b"))
    got = made.toArrow()
    tables = np.zeros((2, bits >> 6), np.int64)
    tables[got["kind"].to_numpy(), got["word"].to_numpy()] = got["b"].to_numpy()
    return tables[0].view(np.uint8), tables[1].view(np.uint8)


def _met(pages: DataFrame, keys: list[str], blanks: bool, tables, sizes: list[int]) -> DataFrame:
    """``*keys, __i, __phrase`` of the places of ``__text`` at which a phrase of the table begins; a few others are among them. Texts go by pieces that overlap."""
    long_ = [n for n in sizes if n >= STEM]
    short = [n for n in sizes if n < STEM]
    shared = pages.sparkSession.sparkContext.broadcast((tables, _powers(LETTERS + 2 * (max(sizes) + 2))))

    def run(batches):
        (whole, stems), powers = shared.value

        def has(table, x):
            place = (x % np.uint64(8 * len(table))).astype(np.int64)
            return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

        def pieces(texts, size):
            """Rows that are looked at together, with their texts put together and ended by a zero each; a long one comes in parts."""
            at, end = 0, np.cumsum(size)
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + LETTERS, "right")))
                yield at, b"\0".join(texts[at:to])
                at = to

        for b in batches:
            texts = [x.encode() for x in b.column(len(keys)).to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            starts = np.cumsum(size) - size
            for row, text in pieces(texts, size):
                for at in range(0, max(len(text), 1), LETTERS):
                    begin = max(at - 1, 0)
                    part = text[begin : at + LETTERS + max(sizes) + 1]
                    buf = np.frombuffer(part, np.uint8)
                    of, apart = _hashes(buf, powers), (buf == 32) | (buf == 0)
                    places = np.arange(at - begin, min(at - begin + LETTERS, len(buf)))
                    ends = np.concatenate([apart, [True]])  # a blank, or the end of the text
                    places = places[~apart[places]]
                    if blanks:
                        places = places[(places == 0) | apart[places - 1]]
                    known = places[places + STEM <= len(buf)]
                    known = known[has(stems, of(known, STEM))]
                    out_at, out_n = [], []
                    for some, of_sizes in ((places, short), (known, long_)):
                        for n in of_sizes:
                            p = some[some + n <= len(buf)]
                            if blanks:
                                p = p[ends[p + n]]
                            p = p[has(whole, of(p, n))]
                            out_at.append(p)
                            out_n.append(np.full(len(p), n))
                    i, n = np.concatenate(out_at), np.concatenate(out_n)
                    for k in range(0, len(i), 1 << 14):
                        some, some_n = i[k : k + (1 << 14)], n[k : k + (1 << 14)]
                        phrases = pa.array([part[x : x + y].decode() for x, y in zip(some.tolist(), some_n.tolist(), strict=True)], pa.string())
                        where = some + begin + starts[row]
                        owner = np.searchsorted(starts, where, "right") - 1
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(owner)) for c in range(len(keys))), pa.array(where - starts[owner]), phrases], names=[*keys, "__i", "__phrase"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)
    return pages.select(*keys, "__text").mapInArrow(run, f"{schema}, __i long, __phrase string")


def _found(unit, pages: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, __pos, n`` of the texts ``__text`` and phrases ``__pos, __norm``."""
    parts = unit.of(F.col("__norm"))
    phrases = listed.select("__pos", unit.text(F.col("__norm")).alias("__phrase"), unit.size(parts).alias("__size"), _knotted(unit, parts).alias("__knotted"))
    sizes = [r[0] for r in phrases.select(F.length("__phrase")).distinct().collect()]
    if not sizes:
        return pages.limit(0).select(*keys, F.lit(None).cast("long").alias("__pos"), F.lit(None).cast("long").alias("n"))
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * phrases.count() - 1).bit_length()))
    texts = pages.withColumn("__text", unit.text(F.col("__text")))
    met = _met(texts, keys, unit.blanks, _listed_bits(phrases, bits), sizes)
    if unit.blanks:  # places are counted in words
        met = met.join(phrases, "__phrase").withColumn("__size", F.length("__phrase") + 1)
    else:
        met = met.join(phrases, "__phrase")
    # of phrases that overlap themselves places are kept, of others a count
    counted = met.groupBy(*keys, "__pos").agg(F.count(F.lit(1)).alias("__n"), F.collect_list(F.when(F.col("__knotted"), F.col("__i"))).alias("__places"), F.first("__size").alias("__size"))
    return counted.select(*keys, "__pos", F.when(F.size("__places") > 0, _apart(F.col("__places"), F.col("__size"))).otherwise(F.col("__n")).alias("n"))


def list_counts(pages: DataFrame, keywords: DataFrame, keys: list[str], text_col: str = "text", ocr: Column | None = None) -> DataFrame:
    """``*keys, kw_pos, keyword, n``: how often each keyword of the table ``kw_pos, keyword`` is on each page, counted as :func:`keywords.page_counts` counts. ``keys``
    name a page. Pages with a null or empty text, lists without a keyword and keywords without a letter or figure give no row; of keywords of one normal form
    the first counts.

    The plan is the same for lists of any length. Tables of bits, of hashes of the keywords and of their first letters, are broadcast (16 MB each at most); tasks hash
    the places of their pages and keep those at which a keyword can begin, which are then joined with the keywords by their text. So only what was found, and what a
    bit in eight or less finds beside it, is shuffled. On ``ocr`` pages, phrases and words of eight letters or more that aren't found so are looked for letter by letter with
    blanks left out.
    """
    listed = save(distinct_keywords(keywords).select(F.col("kw_pos").alias("__pos"), F.col("keyword").alias("__keyword"), F.col("norm").alias("__norm")), "listed")  # read several times
    full = pages.filter(F.coalesce(F.col(text_col), F.lit("")) != "")

    def found(unit, of: DataFrame, phrases: DataFrame, way: int) -> DataFrame:
        return _found(unit, of.select(*keys, normal_text(F.col(text_col)).alias("__text")), phrases, keys).withColumn("__way", F.lit(way))

    counted = found(_Words, full, listed, 0)
    if ocr is not None:
        compact = listed.filter(F.contains("__norm", F.lit(" ")) | (F.length("__norm") >= 8))
        counted = counted.unionByName(found(_Letters, full.filter(ocr), compact, 1))
    best = counted.groupBy(*keys, "__pos").agg(F.min_by("n", "__way").alias("n"))
    out = best.join(listed.select(F.col("__pos").alias("__p"), "__keyword"), F.col("__pos") == F.col("__p"))
    return out.select(*keys, F.col("__pos").alias("kw_pos"), F.col("__keyword").alias("keyword"), "n")
