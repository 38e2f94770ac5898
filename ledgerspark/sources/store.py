"""Stored tables in one folder per owner: a write replaces the folders of the owners that it has, and no other file changes."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import upsert
from .shared import kept


def write_owners(rows: DataFrame, path: str, owner: str) -> None:
    """Replaces the rows of all owners in rows; owners are dealt to tasks, so that each one's folder has one file, of a sorted task."""
    rows.repartition(owner).sortWithinPartitions(owner).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def upsert_owners(spark: SparkSession, incoming: DataFrame, path: str, owner: str, keys: list[str]) -> None:
    """Incoming rows replace stored ones with the same owner and keys, others of their owners stay; only the folders of these owners are read and written."""
    owners = incoming.select(owner).distinct()
    stored = spark.read.parquet(path)
    touched = stored.join(owners, owner, "left_semi").select(*incoming.columns)
    merged = upsert(touched.select(owner, *keys, *[c for c in incoming.columns if c not in (owner, *keys)]), incoming, [owner, *keys])
    write_owners(kept(merged.select(*incoming.columns), "owners"), path, owner)  # read in full before a folder is replaced


def replace_children(spark: SparkSession, incoming: DataFrame, path: str, owner: str, parent: str, items: str) -> None:
    """The children (owner, parent, position, value) of each incoming parent are replaced by its items, numbered from 0; other parents' stay."""
    new = incoming.select(owner, parent, F.posexplode(items).alias("position", "value"))
    stored = spark.read.parquet(path).select(owner, parent, "position", "value")
    touched = stored.join(incoming.select(owner).distinct(), owner, "left_semi").join(incoming.select(owner, parent), [owner, parent], "left_anti")
    write_owners(kept(touched.unionByName(new), "children"), path, owner)


def delete_owner(spark: SparkSession, path: str, owner: str, value: str) -> bool:
    """Removes an owner's folder; false if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{owner}={quote(value, safe=' ')}")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.delete(folder, True))
