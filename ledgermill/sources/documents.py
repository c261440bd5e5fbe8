"""Electronic documents from files: bytes to text by the encoding that a file declares."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at a file's start in which an encoding is declared.
DECLARED_WITHIN = 4096
#: Files beyond this many bytes aren't loaded: a row can't hold them.
LARGEST = 1 << 30
#: Tasks a core at least, and how many of the parts that Spark makes of files go to one task at most where there are more.
PARTS, FEWER = 4, 64
_MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
_XML = re.compile(rb"""^\s*<\?xml[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9._:-]+)""")
_META = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)""", re.I)


def encoding_of(raw: bytes) -> str:
    """The encoding of a document: by its byte order mark, else its XML declaration, else its meta element, else UTF-8. Who can read a declaration byte by byte
    isn't in UTF-16, whatever it says."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    head = raw[:DECLARED_WITHIN]
    found = _XML.search(head) or _META.search(head)
    name = found[1].decode().lower() if found else "utf-8"
    name = "utf-8" if name.startswith(("utf-16", "utf-32", "utf16", "utf32")) else name
    return "cp1252" if name in ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii") else name  # as browsers read it


def decoded(raw: bytes) -> tuple[str | None, str | None]:
    """(text, None), or (None, what is wrong) of bytes that aren't text in their encoding, or whose encoding is unknown."""
    name = encoding_of(raw)
    try:
        # the five bytes that cp1252 leaves open are read as they are in Latin-1
        return raw.decode(name, "ledgermill.latin" if name == "cp1252" else "strict"), None
    except LookupError:
        return None, f"unknown encoding {name}"
    except UnicodeDecodeError:
        return None, f"not text in {name}"


def _as_latin(e: UnicodeError):
    if not isinstance(e, UnicodeDecodeError):
        raise e
    return e.object[e.start : e.end].decode("latin-1"), e.end


codecs.register_error("ledgermill.latin", _as_latin)


def _decoded(batches):
    for b in batches:
        for k in range(b.num_rows):  # files are large
            text, error = decoded(b.column(1)[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([text], pa.string()), pa.array([error], pa.string())], ["url", "html", "error"])


def read_files(spark: SparkSession, path: str, pattern: str = "*", largest: int = LARGEST) -> DataFrame:
    """``url, html, error`` of every file below ``path`` whose name fits ``pattern``: its place, its text, or instead why it can't be read; a file costs only its own row.
    Of files without a byte Spark makes no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    # Spark counts each file as some MB, so a task would take a few of them; a task costs as much as a hundred small files
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(1, PARTS * spark.sparkContext.defaultParallelism, parts // FEWER))
    read = files.filter(F.col("length") <= largest).select("path", "content").mapInArrow(_decoded, "url string, html string, error string")
    over = files.filter(F.col("length") > largest).select(F.col("path").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("file too large").alias("error"))
    return read.union(over)
