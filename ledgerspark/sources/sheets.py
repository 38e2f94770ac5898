"""A workbook's cells written as one CSV file per sheet, through Spark's data source API.

Tasks write whole sheets into a staging folder of their own; the driver moves them into place once all tasks have succeeded, so that a failed task or
a task that runs twice leaves no sheet. The folder must be one that driver and executors share; any file system that Arrow opens will do.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "ledgerspark_sheets"
STAGING = "_staging-"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.stage = f"{self.path}/{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Rows come sorted by sheet, row and col; a sheet is written line by line, its rows and columns from 1 on, formulas before values."""
        context = TaskContext.get()
        folder = f"{self.stage}/{context.partitionId()}-{context.taskAttemptId()}"
        system, base = _open(folder)
        system.create_dir(base)
        files = []
        for sheet, cells in groupby(iterator, key=lambda r: r["sheet"]):
            name = f"{quote(sheet, safe=' ')}.csv"
            with system.open_output_stream(f"{base}/{name}") as out, io.TextIOWrapper(out, "utf-8", newline="") as text:
                lines, below = csv.writer(text, lineterminator="\n"), 1
                for at, line in groupby(cells, key=lambda r: r["row"]):
                    for _ in range(below, at):
                        lines.writerow([])
                    known = {c["col"]: c["formula"] if c["formula"] is not None else c["value"] for c in line}
                    lines.writerow([known.get(k) or "" for k in range(1, max(known) + 1)])
                    below = at + 1
            files.append(name)
        return Written(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _open(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File and old.path.endswith(".csv"):
                    system.delete_file(old.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{_open(m.folder)[1]}/{name}", f"{base}/{name}")
        self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, base = _open(self.stage)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class SheetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options["path"], overwrite)


def write_sheets(cells: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """cells (sheet, row, col, value, formula) -> one CSV file per sheet under path; a sheet is one task's, and no task holds more than a row of it."""
    cells.sparkSession.dataSource.register(SheetSink)
    whole = cells.select("sheet", "row", "col", "value", "formula").repartition("sheet").sortWithinPartitions("sheet", "row", "col")
    whole.write.format(NAME).mode(mode).save(path)
