"""Derived tables kept between runs: made once, found again by any later session.

A table is known by its name and a fingerprint of the files and the settings it
comes from, so a changed input or setting makes a new one. It is published by
an entry written after the data are complete: a table without an entry, left by a
run that broke off, is never read. Entries are small tables of their own; runs
at the same time do not disturb each other, and the latest entry counts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

_ENTRY = "fingerprint string, folder string, columns string, at double"


def store_root(spark: SparkSession) -> str:
    """A folder that outlives the session: below ``spark.checkpoint.dir`` as set, or this session's own where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(named or shared_dir(spark)).rstrip('/')}/kept"


def fingerprint(spark: SparkSession, paths: list[str], settings: dict) -> str:
    """Of the names, sizes and times of all files below ``paths`` (not their contents) and of the settings, in any order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length").agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    told = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha256(f"{tuple(map(str, row))}|{told}".encode()).hexdigest()


def _entries(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return _read(spark, f"{root}/{name}/entries/*", _ENTRY)


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _enter(spark: SparkSession, root: str, name: str, mark: str, folder: str | None, columns: str | None) -> None:
    row = spark.createDataFrame([(mark, folder, columns, time.time())], _ENTRY)
    row.coalesce(1).write.parquet(f"{root}/{name}/entries/{uuid.uuid4().hex}")


def find(spark: SparkSession, root: str, name: str, mark: str) -> DataFrame | None:
    """The published table, or None: never made, withdrawn, or its files are gone."""
    entries = _entries(spark, root, name)
    row = entries.where(F.col("fingerprint") == mark).orderBy(F.desc("at"), "folder").first() if entries is not None else None
    if row is None or row["folder"] is None:
        return None
    return _read(spark, row["folder"], StructType.fromJson(json.loads(row["columns"])))


def kept(spark: SparkSession, name: str, paths: list[str], settings: dict, make: Callable[[], DataFrame],
         root: str | None = None) -> DataFrame:
    """``make()``, or what an earlier run made of the same files with the same settings.

    ``settings`` should name all that ``make`` depends on, a version of its own code included.
    """
    root = root or store_root(spark)
    mark = fingerprint(spark, paths, settings)
    found = find(spark, root, name, mark)
    if found is not None:
        return found
    table = make()
    folder = f"{root}/{name}/data/{mark[:16]}-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    _enter(spark, root, name, mark, folder, table.schema.json())
    return _read(spark, folder, table.schema)


def withdraw(spark: SparkSession, name: str, paths: list[str], settings: dict, root: str | None = None) -> None:
    """Make the next run compute the table again. Sessions that read the old one still can."""
    _enter(spark, root or store_root(spark), name, fingerprint(spark, paths, settings), None, None)
