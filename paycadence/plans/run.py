"""Runs many reports and writes them as CSV and JSON.

    python -m paycadence.plans.run TABLES OUT [report ...]

Frames that several reports use (the lease cohort, its journeys, lease states, first
payers) are computed once and stored below ``spark.checkpoint.dir``, which must be a
folder that every executor reaches. A lost executor then costs a re-read of that table,
not a recomputation of the history behind it. The run's own folder there is removed at
its end.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import SparkSession

from ..session import session
from ..sources.base import Tables
from ..sources.marts import read_csv, write_bundle, write_csv
from ..sources.tables import StarTables
from .reports import BUILDERS
from .windows import TEST_WINDOWS, Windows


def shared_folder(spark: SparkSession) -> str:
    """A new folder for this run below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
    folder = f"{base.rstrip('/')}/paycadence-{uuid4().hex}"
    local = _files(spark, folder)[0].getUri().getScheme() == "file"
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{base} is a folder of one machine; executors on others don't reach it")
    return folder


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def run(tables: Tables, windows: Windows, out: str, names: Sequence[str] = ()) -> list[str]:
    """Writes each report to ``out/csv/NAME`` and ``out/json/dataset=NAME``; returns the names."""
    spark = tables.spark
    folder = shared_folder(spark)
    names = list(names) or sorted(BUILDERS)
    try:
        with tables.sharing(folder):
            for name in names:
                report = BUILDERS[name](tables, windows)
                write_csv(report, f"{out}/csv/{name}")
                # Reports are small: reading the finished rows back is cheaper than computing them again.
                finished = read_csv(spark, f"{out}/csv/{name}", report.schema)
                write_bundle({name: finished}, f"{out}/json")
    finally:
        files, path = _files(spark, folder)
        files.delete(path, True)
    return names


if __name__ == "__main__":
    run(StarTables(session(), sys.argv[1]), TEST_WINDOWS, sys.argv[2], sys.argv[3:])
