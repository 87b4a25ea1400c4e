"""Sessions, and getting this package to Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import graphloom


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package (once a context), so that queries run from any working folder."""
    context = spark.sparkContext
    if not getattr(context, "_graphloom_shipped", False):
        top = os.path.dirname(os.path.abspath(graphloom.__file__))
        folder = tempfile.mkdtemp(prefix="graphloom-ship-")
        path = os.path.join(folder, "graphloom_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder_, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder_, n)
                        z.write(full, os.path.join("graphloom", os.path.relpath(full, top)))
        context.addPyFile(path)
        context._graphloom_shipped = True
        import atexit

        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
