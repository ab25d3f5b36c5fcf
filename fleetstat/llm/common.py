"""Helpers the operators share: tables, the shared scratch folder, null-safe text."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch; long texts are cut into smaller batches by `slices`.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they find it from whatever folder they start."""
    context = spark.sparkContext
    if getattr(context, "_fleetstat_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='fleetstat-package-')}/fleetstat", "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(name)
    context._fleetstat_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a session that names none gets its own, and only on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="fleetstat-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for one run of one step."""
    return f"{shared_folder(spark)}/fleetstat-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so that a lost executor costs one task."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(sizes, limit: int = BATCH_BYTES):
    """Cut a batch into index ranges of about `limit` bytes; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
