"""Readers and writers of the document store.

Readers of PDF, image and workbook files are interfaces: their libraries are not part of this engine. A reader is any callable from
(path, content) to rows of pages; a file that fails gives a row with its error and the batch goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PageReader = Callable[[str, bytes], list[str]]
PAGES = "path string, hash string, page int, text string, blank boolean, error string"


def read_pages(spark: SparkSession, folder: str, reader: PageReader, ocr: PageReader | None = None, pattern: str = "*") -> DataFrame:
    """Pages of all files of a folder; blank pages are read again by the second reader, if there is one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content", F.sha2("content", 256).alias("hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, digest in zip(batch["path"], batch["content"], batch["hash"]):
                try:
                    pages = reader(path, bytes(content))
                    if ocr and any(not p.strip() for p in pages):
                        again = ocr(path, bytes(content))
                        pages = [p if p.strip() or q is None else q for p, q in zip_longest(pages, again[:len(pages)])]  # the first reader's pages all stay
                    rows += [(path, digest, k, p, not p.strip(), None) for k, p in enumerate(pages, 1)]
                except Exception as e:  # one bad file must not stop the batch
                    rows.append((path, digest, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "hash", "page", "text", "blank", "error"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return files.mapInPandas(run, PAGES)


def plain_text_reader(path: str, content: bytes) -> list[str]:
    """Text files, pages parted by form feeds."""
    return content.decode("utf-8").split("\f")


def read_work(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A saved tree of batches, payments and lines (JSON) as three tables with positions."""
    tree = spark.read.option("multiLine", True).json(path)
    batches = tree.select(F.posexplode("lotes").alias("orden", "l"))
    pays = batches.select(F.col("l.hoja").alias("hoja"), F.posexplode("l.registros").alias("orden", "r"))
    lines = pays.select("hoja", F.col("orden").alias("registro"), F.posexplode("r.renglones").alias("orden", "x"))
    return {
        "lotes": batches.select("orden", "l.*").drop("registros"),
        "registros": pays.select("hoja", "orden", "r.*").drop("renglones"),
        "renglones": lines.select("hoja", "registro", "orden", "x.*"),
    }


def write_cells(cells: DataFrame, path: str) -> None:
    """A workbook as rows (sheet, row, col, value, formula), one folder per sheet; sheets are repartitioned, never collected."""
    cells.repartition("sheet").sortWithinPartitions("sheet", "row", "col").write.mode("overwrite").partitionBy("sheet").parquet(path)


def sheet_names(batches: DataFrame) -> DataFrame:
    """Names of at most 31 characters without the forbidden ones; a name that is taken, in any case, gets the next free number.

    The sheets of one workbook are few, and each name depends on those before it: they are named in one group.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*batches.schema.fields, T.StructField("sheet", T.StringType())])

    def name(group: pd.DataFrame) -> pd.DataFrame:
        group, taken, out = group.sort_values("position"), set(), []
        for base in group.pop("_base"):
            sheet, k = base, 1
            while sheet.lower() in taken:
                k += 1
                sheet = f"{base} {k}"
            taken.add(sheet.lower())
            out.append(sheet)
        return group.assign(sheet=out)

    base = F.substring(F.regexp_replace("name", r"[\[\]:*?/\\]", " "), 1, 27)
    return batches.withColumn("_base", base).groupBy().applyInPandas(name, schema)
