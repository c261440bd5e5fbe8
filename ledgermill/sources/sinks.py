"""Writing results and summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.report import output_rows, summary_block


def write_results(rows: DataFrame, path: str, fmt: str = "parquet", by_status: bool = False) -> None:
    """One row for each input row in input order, in the fixed columns: of decided rows, or of those of :func:`output_rows`; ``by_status`` makes a folder for each
    status."""
    rows = rows if "accounts_pdf" in rows.columns else output_rows(rows)
    writer = rows.orderBy("row_no").write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy("turnover_status") if by_status else writer).save(path)


def write_summary(rows: DataFrame, path: str, fmt: str = "parquet", keywords: list[str] | None = None) -> None:
    """Counts and meanings of the statuses and, with ``keywords``, the block about them: a dozen rows in one file."""
    summary_block(rows, keywords).orderBy("pos").coalesce(1).write.mode("overwrite").format(fmt).save(path)


def write_files(files: DataFrame, path: str) -> None:
    """Rows ``name, content`` as files below the folder, a file a row, by whatever file system of pyarrow the path names. Executors write a file at its place, so a task that runs
    again writes the same ones, and nothing is moved in the end. A name may have folders; names are different, and ``path`` is new."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
        folders = set()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": pa.array([b.num_rows], pa.int64())})

    files.select("name", "content").mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()
