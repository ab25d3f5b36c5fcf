"""Column statistics computed from the data itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _width(f: T.StructField) -> Column:
    """Bytes of a value: the text length, or the fixed size of the type."""
    if isinstance(f.dataType, T.StringType):
        return F.octet_length(f.name).cast("bigint")
    sizes = {T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.BooleanType: 1, T.ShortType: 2}
    return F.when(F.col(f.name).isNotNull(), F.lit(sizes.get(type(f.dataType), 8)).cast("bigint"))


def _profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def column_profile(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """Null fraction, distinct values (-1 when all differ), width, extremes and top counts per column.

    One pass computes the scalar statistics. Value counts are one further
    aggregation over (column, value) pairs, partial before the shuffle, so a
    value filling most of the table crosses the network once per task. With ``exact``
    the distinct count is the number of groups of that aggregation, otherwise a sketch.
    Paths inside nested columns are the matter of ``distribution.nested_profile``.
    """
    fields = _profiled(df)
    texts = {f.name: F.col(f.name).cast("string") for f in fields}

    scalars = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        scalars += [
            F.count(f.name).alias(f"_c{i}"), F.sum(_width(f)).alias(f"_w{i}"),
            F.approx_count_distinct(f.name).alias(f"_d{i}"),
        ]
    one = df.agg(*scalars)
    per_column = F.array(*[
        F.struct(F.lit(f.name).alias("attname"), F.col("_n"), F.col(f"_c{i}").alias("_count"),
                 F.col(f"_w{i}").alias("_bytes"), F.col(f"_d{i}").alias("_approx"))
        for i, f in enumerate(fields)])
    stats = one.select(F.inline(per_column))

    # Long values are counted by digest, so whole documents are not shuffled to find repeats.
    texts = {
        name: F.when(F.length(text) > 32, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)
        for name, text in texts.items()
    }
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("attname"), texts[f.name].alias("value")) for f in fields]))).where("value IS NOT NULL")
    counts = pairs.groupBy("attname", "value").agg(F.count(F.lit(1)).alias("freq"))
    tops = counts.groupBy("attname").agg(
        F.count(F.lit(1)).alias("_exact"),
        F.max("freq").alias("top_frequency"),
        F.count_if(F.col("freq") > 1).alias("repeated_values"))
    joined = stats.join(tops, "attname", "left")
    distinct = F.coalesce("_exact", F.lit(0)) if exact else F.coalesce("_approx", F.lit(0))
    return joined.select(
        F.lit(table).alias("table_name"), "attname", F.col("_n").alias("row_count"),
        F.try_divide((F.col("_n") - F.col("_count")).cast("double"), F.col("_n").cast("double")).alias("null_frac"),
        F.when((distinct > 0) & (F.coalesce("top_frequency", F.lit(0)) == 1), F.lit(-1)).otherwise(distinct).cast("bigint").alias("n_distinct"),
        F.try_divide(F.col("_bytes").cast("double"), F.col("_count").cast("double")).alias("avg_width"),
        F.coalesce("top_frequency", F.lit(0)).cast("bigint").alias("top_frequency"),
        F.coalesce("repeated_values", F.lit(0)).cast("bigint").alias("repeated_values"),
    )
