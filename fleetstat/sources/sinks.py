"""Exposition formats, report files and retention of stored snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, percent

# Metric, type and help text of the exposition format.
METRIC_HELP = [
    ("pg_up", "gauge", "PostgreSQL server is up"),
    ("pg_connections_total", "gauge", "Total number of connections"),
    ("pg_connections_active", "gauge", "Number of active connections"),
    ("pg_connections_idle", "gauge", "Number of idle connections"),
    ("pg_database_size_bytes", "gauge", "Size of database in bytes"),
    ("pg_transactions_total", "counter", "Total transactions"),
    ("pg_commits_total", "counter", "Total commits"),
    ("pg_rollbacks_total", "counter", "Total rollbacks"),
    ("pg_blocks_read_total", "counter", "Total blocks read"),
    ("pg_blocks_hit_total", "counter", "Total blocks hit"),
    ("pg_temp_files_total", "counter", "Total temporary files"),
    ("pg_temp_bytes_total", "counter", "Total temporary bytes"),
    ("pg_table_size_bytes", "gauge", "Size of table in bytes"),
    ("pg_locks_count", "gauge", "Number of locks by mode"),
    ("pg_stat_activity_connections", "gauge", "Number of connections by state"),
    ("pg_replication_lag_seconds", "gauge", "Replication lag in seconds"),
    ("pg_stat_statements_calls_total", "counter", "Number of times executed"),
    ("pg_stat_statements_total_time_seconds", "counter", "Total time spent in the statement"),
    ("pg_stat_statements_mean_time_seconds", "gauge", "Mean time spent in the statement"),
    ("pg_slow_queries", "gauge", "Calls of slow statements by query hash"),
]


def metric_rows(df: DataFrame, values: dict[str, Column], labels: dict[str, Column] | None = None) -> DataFrame:
    """Wide rows to (metric, labels, value), one row per value that is not NULL."""
    pairs = [x for k, c in (labels or {}).items() for x in (F.lit(k), c.cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    records = [F.struct(F.lit(name).alias("metric"), label_map.alias("labels"), v.cast("double").alias("value"))
               for name, v in values.items()]
    return df.select(*SNAP, F.inline(F.array(*records))).where("value IS NOT NULL")


def value_text(value: str = "value") -> Column:
    """Whole numbers without a fraction, others with six decimals."""
    v = F.col(value)
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("decimal(28,6)").cast("string"))


def escaped(value: Column, *characters: str) -> Column:
    """A backslash before each of the characters; a line feed becomes the two characters of its escape."""
    for c in characters:
        value = F.replace(value, F.lit(c), F.lit("\\" + c))
    return F.replace(value, F.lit("\n"), F.lit("\\n"))


def label_text(labels: str = "labels") -> Column:
    """k="v" pairs in key order, separated by commas; quotes, backslashes and line feeds of a value are escaped."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"], "\\", '"'), F.lit('"')))
    return F.array_join(pairs, ",")


def tag_text(labels: str = "labels") -> Column:
    """k=v tags in key order; blanks, commas and equals signs of a value are escaped."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), escaped(e["value"], " ", ",", "=")))
    return F.array_join(pairs, ",")


def to_prometheus_lines(metrics: DataFrame) -> DataFrame:
    """Sample lines, with one help and one type line per metric of a snapshot ahead of them (``part`` 0, 1, 2)."""
    braces = F.when(F.size("labels") > 0, F.concat(F.lit("{"), label_text(), F.lit("}"))).otherwise("")
    samples = metrics.select(*SNAP, "metric", F.lit(2).alias("part"), F.concat("metric", braces, F.lit(" "), value_text()).alias("line"))
    catalogue = F.create_map(*[x for name, kind, text in METRIC_HELP for x in (
        F.lit(name), F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("help")))])
    present = metrics.select(*SNAP, "metric").distinct().withColumn("about", F.try_element_at(catalogue, F.col("metric")))
    headers = present.select(*SNAP, "metric", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "metric", F.lit(" "), F.coalesce("about.help", "metric")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), F.coalesce("about.kind", F.lit("untyped"))).alias("line")))))
    return headers.unionByName(samples)


def to_influx_lines(metrics: DataFrame, servers: DataFrame, measurement: str = "postgresql", database: str = "postgres") -> DataFrame:
    """Line protocol with host, database and metric labels as tags and nanosecond times."""
    hosts = servers.select(*SNAP, "host")
    tags = F.concat_ws(",", F.lit(measurement), F.concat(F.lit("host="), escaped(F.coalesce("host", F.lit("localhost")), " ", ",", "=")),
                       F.concat(F.lit("database="), escaped(F.lit(database), " ", ",", "=")), F.when(F.size("labels") > 0, tag_text()))
    ns = (F.unix_micros("snap_ts") * 1000).cast("string")
    return metrics.join(hosts, SNAP, "left").select(*SNAP, F.concat(tags, F.lit(" "), "metric", F.lit("="), value_text(), F.lit(" "), ns).alias("line"))


def to_metrics_json(metrics: DataFrame, servers: DataFrame, database: str = "postgres") -> DataFrame:
    """One object per server. The map holds one entry per metric name and label set, a fixed catalogue."""
    name = F.when(F.size("labels") > 0, F.concat("metric", F.lit("{"), label_text(), F.lit("}"))).otherwise(F.col("metric"))
    maps = metrics.groupBy(*SNAP).agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct(name.alias("name"), "value")))).alias("metrics"))
    body = F.struct(F.date_format("snap_ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(database).alias("database"),
                    "host", "port", "metrics")
    return maps.join(servers.select(*SNAP, "host", "port"), SNAP, "left").select(*SNAP, F.to_json(body).alias("body"))


def to_report_json(findings: DataFrame, servers: DataFrame, database: str = "postgres") -> DataFrame:
    """One document per server with a section per check: its findings counted and the worst one quoted.

    The findings themselves are lines of their own (``to_section_lines``): a check
    may have any number of them, so they are never gathered into one row.
    """
    ranked = F.struct(severity_rank().alias("rank"), "message")
    sections = findings.groupBy(*SNAP, "check_name").agg(F.count(F.lit(1)).alias("findings"), F.min(ranked).alias("worst"))
    gathered = sections.groupBy(*SNAP).agg(F.sort_array(F.collect_list(F.struct(
        F.col("check_name").alias("name"), "findings", F.col("worst.message").alias("content")))).alias("sections"))
    meta = F.struct(F.date_format("snap_ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated"), F.lit(database).alias("database"),
                    "host", "version", F.lit("1.0").alias("format_version"))
    return gathered.join(servers.select(*SNAP, "host", "version"), SNAP, "left").select(
        *SNAP, F.to_json(F.struct(meta.alias("report_metadata"), "sections")).alias("body"))


def to_section_lines(findings: DataFrame) -> DataFrame:
    """Every finding as one JSON line under its section name."""
    return findings.select(*SNAP, F.to_json(F.struct(
        F.col("check_name").alias("name"), "object", "severity", "message", "value")).alias("line"))


SEVERITIES = ("CRITICAL", "ERROR", "HIGH", "WARNING", "MEDIUM", "NOTICE", "INFO", "LOW", "OK")


def severity_rank(severity: str = "severity") -> Column:
    chain = F
    for rank, name in enumerate(SEVERITIES):
        chain = chain.when(F.col(severity) == name, F.lit(rank))
    return chain.otherwise(F.lit(len(SEVERITIES)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _per_scrape(df: DataFrame) -> DataFrame:
    """Folder columns of a written scrape: its day, and its time of day."""
    return df.withColumn("snap_date", F.to_date("snap_ts")).withColumn("scrape", F.date_format("snap_ts", "HHmmss.SSSSSS"))


def write_lines(df: DataFrame, path: str) -> None:
    """Text files, one folder per scrape; the order inside a metric is kept by sorting each task's rows.

    Writing a scrape again replaces its folder and leaves all others.
    """
    keys = [c for c in ("server_id", "metric", "part") if c in df.columns]
    rows = _per_scrape(df).sortWithinPartitions(*keys).select("snap_date", "scrape", "line")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date", "scrape").text(path)


def write_findings(df: DataFrame, path: str) -> None:
    """Findings in a table with one folder per scrape, for trends. Writing a scrape again replaces its folder."""
    _per_scrape(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date", "scrape").parquet(path)


# --- retention --------------------------------------------------------------------

def retention_tiers(df: DataFrame, as_of: Column, keep_days: int = 30, compress_days: int = 7) -> DataFrame:
    """Tier of every stored snapshot: KEEP while recent, COMPRESS when older, DELETE when expired. The tiers are disjoint."""
    days = F.date_diff(F.to_date(as_of), F.to_date("snap_ts"))
    tier = F.when(days > keep_days, "DELETE").when(days > compress_days, "COMPRESS").otherwise("KEEP")
    return df.withColumn("age_days", days).withColumn("tier", tier)


def retention_summary(tiered: DataFrame) -> DataFrame:
    """Dry run: what each tier holds."""
    total = F.sum("size_bytes")
    return tiered.groupBy("tier").agg(
        F.count(F.lit(1)).alias("snapshots"), total.alias("bytes"), percent(total, F.lit(100 * 1024**2)).alias("megabytes"),
        F.min("snap_ts").alias("oldest"), F.max("snap_ts").alias("newest"))


def day_manifest(df: DataFrame) -> DataFrame:
    """Rows and a digest of every day. The digest is a sum over rows, so neither their order nor their files matter."""
    row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.groupBy(F.to_date("snap_ts").alias("snap_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def _stored_days(spark, path: str) -> tuple[object, object, dict[datetime.date, object]]:
    """File system, root and the folders of the days that lie at ``path``."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, days = root.getFileSystem(hadoop), {}
    if files.exists(root):
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("snap_date=") and name[10:12].isdigit():
                days[datetime.date.fromisoformat(name[10:])] = status.getPath()
    return files, root, days


def read_manifest(spark, path: str) -> dict[datetime.date, tuple[int, str, str]]:
    """What the table at ``path`` says it holds: rows, digest and tier of each day. One row for each day that is kept."""
    files, _, _ = _stored_days(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not files.exists(place):
        return {}
    rows = spark.read.schema("snap_date date, n_rows long, digest string, tier string").parquet(str(place)).collect()
    return {r["snap_date"]: (r["n_rows"], r["digest"], r["tier"]) for r in rows}


def apply_retention(df: DataFrame, path: str, as_of: Column, keep_days: int = 30, compress_days: int = 7) -> list[str]:
    """Bring the table at ``path`` (one folder per day) up to date; returns the expired days it dropped.

    A manifest beside the days says how many rows each holds, their digest and their tier. Days whose rows or tier
    differ from it are written anew from ``df``, so scrapes that arrive late for a day that is already there are not
    lost; all other days are left alone. Recent days have fast and older days dense compression. Expired days are
    removed as folders, without reading them. The manifest is written after the days, so a run that breaks off is
    made good by the next one. Days that ``df`` no longer holds stay until they expire; rows without a time belong to
    no day. The driver sees one row per day that is kept.
    """
    spark = df.sparkSession
    today, = spark.range(1).select(F.to_date(as_of)).first()
    files, _, stored = _stored_days(spark, path)
    known = {day: entry for day, entry in read_manifest(spark, path).items() if day in stored}
    expired = [day for day in stored if (today - day).days > keep_days]
    for day in expired:
        files.delete(stored[day], True)
        known.pop(day, None)

    days = retention_tiers(day_manifest(df).withColumn("snap_ts", F.col("snap_date")), as_of, keep_days, compress_days).where(
        "tier <> 'DELETE' AND snap_date IS NOT NULL")
    current = {r["snap_date"]: (r["n_rows"], r["digest"], r["tier"]) for r in days.select("snap_date", "n_rows", "digest", "tier").collect()}
    dated = df.withColumn("snap_date", F.to_date("snap_ts"))
    for tier, codec in (("KEEP", "snappy"), ("COMPRESS", "zstd")):
        changed = [day for day, entry in current.items() if entry[2] == tier and known.get(day) != entry]
        if changed:
            (dated.where(F.col("snap_date").isin(changed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("compression", codec).partitionBy("snap_date").parquet(path))
    entries = [(day, *entry) for day, entry in sorted((known | current).items())]
    spark.createDataFrame(entries, "snap_date date, n_rows long, digest string, tier string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return sorted(day.isoformat() for day in expired)
