"""Access to telemetry relations, whichever way they are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstat.session import configure
from fleetstat.sources import fixtures
from fleetstat.sources.schemas import OPTIONAL, SCHEMAS


#: Tables that a derivation joins with another growing one; they are shuffled (see ``operators.joins.shuffled``).
SHUFFLED = {"table_stats": ("part",)}


def schema_of(relation: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[relation]) if isinstance(SCHEMAS[relation], str) else SCHEMAS[relation]


def conform(df: DataFrame, relation: str) -> DataFrame:
    """Give a frame the relation's schema.

    A missing optional column becomes a typed NULL, a missing required one is an
    error naming it; further columns are left out so that scans stay narrow.
    """
    wanted = schema_of(relation)
    missing = [f.name for f in wanted if f.name not in df.columns]
    required = [name for name in missing if name not in OPTIONAL.get(relation, ())]
    if required:
        raise ValueError(f"relation {relation}: missing required column(s) {', '.join(required)}")
    return df.select(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name in missing
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in wanted
    ])


def read_snapshot(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """Scan one relation stored as Parquet (optionally partitioned by snap_date)."""
    return conform(spark.read.parquet(path), relation)


def read_snapshot_jdbc(spark: SparkSession, relation: str, *, url: str, dbtable: str, partition_column: str,
                       lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Pull one relation over JDBC in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=dbtable, partitionColumn=partition_column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions), **options)
    return conform(reader.load(), relation)


def read_snapshot_stream(spark: SparkSession, path: str, relation: str, max_files: int | None = None) -> DataFrame:
    """The same relation as a stream of scrape files."""
    reader = spark.readStream.schema(schema_of(relation))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


class Snapshots:
    """Lazily resolved relations: ``snaps.statements``, ``snaps.locks`` and so on."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame]):
        self.spark = configure(spark)
        self._load = load
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, relation: str) -> DataFrame:
        if relation.startswith("_"):
            raise AttributeError(relation)
        if relation not in self._cache:
            self._cache[relation] = self._load(relation)
        return self._cache[relation]

    @classmethod
    def from_path(cls, spark: SparkSession, root: str) -> "Snapshots":
        """One Parquet folder per relation below ``root``."""
        return cls(spark, lambda relation: read_snapshot(spark, f"{root}/{relation}", relation))

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Snapshots":
        """Relations held as frames; columns the caller left out are NULL."""
        def load(relation: str) -> DataFrame:
            frame = frames[relation]
            if relation not in SCHEMAS:
                return frame
            wanted = schema_of(relation)
            return frame.select(*[
                (F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in wanted
            ])
        return cls(spark, load)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> "Snapshots":
        """Relations derived from the shared test tables."""
        texts = fixtures.definitions("spark")

        def load(relation: str) -> DataFrame:
            if relation in fixtures.TABLES:
                return spark.read.parquet(f"{sf_dir}/{relation}.parquet")
            text = texts[relation]
            for table in fixtures.TABLES:
                view = spark.read.parquet(f"{sf_dir}/{table}.parquet") if _mentions(text, table) else None
                if view is not None:
                    if table in SHUFFLED.get(relation, ()):
                        view = view.hint("merge")
                    view.createOrReplaceTempView(table)
            return spark.sql(text)
        return cls(spark, load)


def _mentions(text: str, table: str) -> bool:
    import re
    return re.search(rf"\b(FROM|JOIN)\s+{table}\b", text) is not None
