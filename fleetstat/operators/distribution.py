"""How the values of a table are distributed: paths into nested columns, most common values, histogram bounds, order correlation.

A table is read as *cells*, one for each value at a path: ``col`` for plain columns, ``col.field`` for structs, ``col[]`` and
``col.size`` for arrays, ``col.keys[]`` and ``col.values[]`` for maps, and ``col.key`` for columns named as JSON text.
All columns go through one aggregation or one sort together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstat.operators.graphs import cut_lineage

COMMON = 10
BUCKETS = 10
#: Values a summary follows at once for each path, and how many it may name.
TRACKED, NAMED = 16384, 5000
#: Longer texts are counted by digest, so whole documents are not shuffled to find repeats.
LONG_TEXT = 32
JSON_DEPTH = 3

_FIXED = {T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.BooleanType: 1, T.ShortType: 2, T.ByteType: 1}


def _cell(path: Column, value: Column, dtype: T.DataType) -> Column:
    """attname, text (NULL for floating point), number (NULL for what has no number) and width of one value."""
    text, number, width = value.cast("string"), F.lit(None).cast("double"), F.lit(_FIXED.get(type(dtype), 8))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text, number = F.lit(None).cast("string"), value.cast("double")
    elif isinstance(dtype, T.NumericType):
        number = value.cast("double")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.unix_micros(value.cast("timestamp")).cast("double")
    elif isinstance(dtype, T.BinaryType):
        text, width = F.base64(value), F.octet_length(value)
    elif isinstance(dtype, T.StringType):
        width = F.octet_length(value)
    return F.struct(path.alias("attname"), text.alias("text"), number.alias("number"), F.when(value.isNotNull(), width).cast("bigint").alias("width"))


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _fields(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: v.getField(name))


def _json_cells(value: Column, prefix: Column, depth: int) -> Column:
    """Cells of a JSON object, path by path; arrays, and objects deeper than `depth`, stay text."""
    def entry(e: Column) -> Column:
        path = F.concat(prefix, F.lit("."), e["key"])
        plain = F.array(_cell(path, e["value"], T.StringType()))
        return plain if depth == 1 else F.when(e["value"].startswith("{"), _json_cells(e["value"], path, depth - 1)).otherwise(plain)
    found = F.flatten(F.transform(F.map_entries(F.from_json(value, "map<string,string>")), entry))
    return F.coalesce(found, F.array().cast("array<struct<attname:string,text:string,number:double,width:bigint>>"))


def _leaves(schema: T.StructType, json: tuple[str, ...], nested_only: bool) -> list[Column]:
    """An array of cells for each path of the schema."""
    found: list[Column] = []

    def visit(path: str, dtype: T.DataType, values: Column, nested: bool) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype:
                visit(f"{path}.{f.name}", f.dataType, _fields(values, f.name), True)
        elif isinstance(dtype, T.ArrayType):
            found.append(F.transform(values, lambda v: _cell(F.lit(f"{path}.size"), F.when(v.isNotNull(), F.size(v)), T.IntegerType())))
            visit(f"{path}[]", dtype.elementType, F.flatten(_present(values)), True)
        elif isinstance(dtype, T.MapType):
            visit(f"{path}.keys", T.ArrayType(dtype.keyType), F.transform(values, F.map_keys), True)
            visit(f"{path}.values", T.ArrayType(dtype.valueType), F.transform(values, F.map_values), True)
        elif path in json:
            found.append(F.flatten(F.transform(values, lambda v: _json_cells(v, F.lit(path), JSON_DEPTH))))
        elif nested or not nested_only:
            found.append(F.transform(values, lambda v: _cell(F.lit(path), v, dtype)))

    for f in schema:
        visit(f.name, f.dataType, F.array(F.col(f"`{f.name}`")), False)
    return found


def cells(df: DataFrame, *, json: tuple[str, ...] = (), nested_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each value: attname, text, number, width, besides the columns to keep with it."""
    schema = T.StructType([f for f in df.schema if f.name not in keep])
    leaves = _leaves(schema, json, nested_only)
    if not leaves:
        raise ValueError("no column to read cells from")
    return df.select(*keep, F.inline(F.concat(*leaves)))


def _keyed(found: DataFrame) -> DataFrame:
    """Cells that are not NULL, with one text that tells values apart."""
    short = F.when(F.length("text") > LONG_TEXT, F.concat(F.lit("md5:"), F.md5("text"))).otherwise(F.col("text"))
    return found.where("text IS NOT NULL OR number IS NOT NULL").select(
        "attname", "number", short.alias("value"), F.coalesce(short, F.col("number").cast("string")).alias("key"))


def _counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("attname", "key").agg(F.first("value").alias("value"), F.first("number").alias("number"), F.count("*").alias("freq"))


def nested_profile(df: DataFrame, table: str, json: tuple[str, ...] = ()) -> DataFrame:
    """Null fraction, distinct values (-1 when all differ), width and top count of each path inside nested columns."""
    found = cells(df, json=json, nested_only=True)
    sizes = found.groupBy("attname").agg(
        F.count("*").alias("cell_count"), F.count_if(F.expr("text IS NULL AND number IS NULL")).alias("nulls"),
        F.sum("width").alias("bytes"))
    tops = _counts(_keyed(found)).groupBy("attname").agg(
        F.count("*").alias("distinct"), F.max("freq").alias("top"), F.count_if(F.col("freq") > 1).alias("repeated"))
    unique = (F.col("distinct") > 0) & (F.col("top") == 1)
    return sizes.join(tops, "attname", "left").select(
        F.lit(table).alias("table_name"), "attname", "cell_count",
        F.try_divide(F.col("nulls").cast("double"), F.col("cell_count").cast("double")).alias("null_frac"),
        F.when(unique, F.lit(-1)).otherwise(F.coalesce("distinct", F.lit(0))).cast("bigint").alias("n_distinct"),
        F.try_divide(F.col("bytes").cast("double"), (F.col("cell_count") - F.col("nulls")).cast("double")).alias("avg_width"),
        F.coalesce("top", F.lit(0)).cast("bigint").alias("top_frequency"), F.coalesce("repeated", F.lit(0)).cast("bigint").alias("repeated_values"))


def most_common_values(df: DataFrame, table: str, k: int = COMMON, *, json: tuple[str, ...] = (), tracked: int = TRACKED, named: int = NAMED) -> DataFrame:
    """The k most frequent values of each path, exactly; ties go to the smaller value.

    Every task keeps a heavy-hitter summary of bounded size for each path, and the summaries are merged. What they
    name is then counted exactly. A value they do not name occurs at most as often as what is left over, so where the
    k-th count is above that (or nothing is left) the answer is exact; only the other paths are counted in full.
    """
    keyed = _keyed(cells(df, json=json))
    summaries = cut_lineage(keyed.groupBy("attname").agg(F.count("*").alias("total"), F.expr(f"approx_top_k(key, {named}, {tracked})").alias("items")))
    candidates = summaries.select("attname", F.explode("items").alias("i")).select("attname", F.col("i.item").alias("key"))
    counted = cut_lineage(_counts(keyed.join(candidates, ["attname", "key"])))
    order = Window.partitionBy("attname").orderBy(F.desc("freq"), "number", "key")

    def first_of(counts: DataFrame) -> DataFrame:
        return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = first_of(counted)
    least = best.groupBy("attname").agg(F.min("freq").alias("kth"), F.count("*").alias("got"))
    covered = counted.groupBy("attname").agg(F.sum("freq").alias("covered"))
    left_over = F.col("total") - F.coalesce("covered", F.lit(0))
    settled = (left_over == 0) | ((F.col("got") == k) & (F.col("kth") > left_over))
    judged = summaries.select("attname", "total").join(covered, "attname", "left").join(least, "attname", "left").select(
        "attname", F.coalesce(settled, F.lit(False)).alias("settled"))
    open_paths = cut_lineage(judged.where("NOT settled").select("attname"))
    if not open_paths.isEmpty():
        in_full = _counts(keyed.join(F.broadcast(open_paths) if open_paths.count() <= NAMED else open_paths, "attname", "left_semi"))
        best = best.join(open_paths, "attname", "left_anti").unionByName(first_of(in_full))
    return best.select(F.lit(table).alias("table_name"), "attname", "rank", "value", "number", "freq")


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rank of each row among those of the same ``by``, from a sort of all rows that is cut into ranges.

    A row's rank is its place in its range and what earlier ranges hold, so no task sorts more than its range whatever
    a column holds. Ties in ``order`` may take either place: name columns that tell rows apart. The sorted rows are
    written once, so that places and counts speak of the same ranges.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = cut_lineage(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).select(
        "*", F.spark_partition_id().alias("_range"), place.alias("_place")))
    counts = ranges.groupBy(by, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return ranges.join(starts, [by, "_range"]).withColumn("rank", F.col("_before") + F.col("_place") - F.col("_first") + 1).drop("_range", "_place", "_first", "_before")


def histogram_bounds(df: DataFrame, table: str, buckets: int = BUCKETS, *, json: tuple[str, ...] = ()) -> DataFrame:
    """The values that cut each path's sorted values into parts of equal size, exactly: bound j has rank 1 + j (n - 1) div buckets."""
    present = cells(df, json=json).where("text IS NOT NULL OR number IS NOT NULL").select(
        "attname", "number", "text", F.monotonically_increasing_id().alias("tie"))
    in_order = ranked(present, "attname", ["number", "text", "tie"])
    sizes = in_order.groupBy("attname").agg(F.count("*").alias("n"))
    wanted = sizes.select("attname", "n", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("bucket")).select(
        "attname", "bucket", F.expr(f"1 + (bucket * (n - 1)) div {buckets}").alias("rank"))
    return in_order.join(wanted, ["attname", "rank"]).select(
        F.lit(table).alias("table_name"), "attname", "bucket", F.col("text").alias("bound_text"), F.col("number").alias("bound_number"))


def _rank_key(f: T.StructField) -> Column:
    """attname, number and text that order one column's values; no text where the number alone tells values apart."""
    cell = _cell(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType)
    number, text = cell["number"], cell["text"]
    if isinstance(f.dataType, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.when(F.abs(number) >= 2.0**53, text)
    return F.struct(cell["attname"].alias("attname"), number.alias("number"), text.alias("text"))


def order_correlation(df: DataFrame, table: str, order: list[str]) -> DataFrame:
    """Correlation of each plain column's value rank (ties in row order) with the row's place in the table by ``order``.

    Rows are sorted by ``order`` and their cells by value, both cut into ranges, and neither is written: a place is the
    one inside the range and what earlier ranges hold, and so is a rank. Means and products are summed for the cells
    that a range of rows and a range of cells share, which is all that is kept; what lies before them is added there.
    """
    plain = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    names = [f.name for f in plain]
    by_row, by_value = [*order, *[c for c in names if c not in order]], ["attname", "number", "text", "_row"]
    inside = lambda c: c.bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(*names).repartitionByRange(*by_row).sortWithinPartitions(*by_row).withColumn("_row", F.monotonically_increasing_id())
    values = rows.select("_row", F.inline(F.array(*map(_rank_key, plain)))).where("text IS NOT NULL OR number IS NOT NULL")
    placed = values.repartitionByRange(*by_value).sortWithinPartitions(*by_value).select(
        "attname", F.shiftright("_row", 33).alias("_range"), inside(F.col("_row")).alias("x"),
        F.spark_partition_id().alias("_part"), inside(F.monotonically_increasing_id()).alias("y"))
    product = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    sums = cut_lineage(placed.groupBy("attname", "_range", "_part").agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), product("x", "x").alias("xx"), product("x", "y").alias("xy"),
        F.max("x").alias("_last"), F.min("y").alias("_first")))
    # A row without any value sorts before all others, so the last row of a range has one, or all places shift alike.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.groupBy("_range").agg((F.max("_last") + 1).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    bases = sums.groupBy("attname", "_part").agg(F.sum("n").alias("n"), F.min("_first").alias("_first")).select(
        "attname", "_part", (F.coalesce(F.sum("n").over(earlier(Window.partitionBy("attname").orderBy("_part"))), F.lit(0)) - F.col("_first")).alias("_base"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    located = sums.join(starts, "_range").join(bases, ["attname", "_part"]).select(
        "attname", "n", (F.col("_start") + x).alias("x"), (F.col("_base") + y).alias("y"),
        (F.col("xx") - n * x * x).alias("xx"), (F.col("xy") - n * x * y).alias("xy"))
    means = located.groupBy("attname").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value_count"), (F.sum(n * x) / F.sum("n")).alias("_x"), (F.sum(n * y) / F.sum("n")).alias("_y"))
    found = located.join(means, "attname").groupBy("attname", "value_count").agg(
        F.sum(F.col("xx") + n * (x - F.col("_x")) * (x - F.col("_x"))).alias("xx"),
        F.sum(F.col("xy") + n * (x - F.col("_x")) * (y - F.col("_y"))).alias("xy"))
    count = F.col("value_count").cast("double")
    ranks = count * (count * count - 1) / 12  # squares of 1 to n about their mean
    return found.select(
        F.lit(table).alias("table_name"), "attname", "value_count",
        F.round(F.when(F.col("value_count") > 1, F.col("xy") / F.sqrt("xx") / F.sqrt(ranks)), 6).alias("correlation"))


def statistics(df: DataFrame, table: str, profile: DataFrame, order: list[str], target: int = 100) -> DataFrame:
    """What a planner keeps of each plain column: profile, number of common values (met more than once) and of distinct bounds, correlation."""
    common = most_common_values(df, table, target).where("freq > 1").groupBy("attname").agg(F.count("*").alias("mcv_count"))
    text = F.coalesce("bound_text", F.col("bound_number").cast("string"))
    bounds = histogram_bounds(df, table, target).groupBy("attname").agg(F.countDistinct(text).alias("histogram_buckets"))
    found = order_correlation(df, table, order).select("attname", "correlation")
    return profile.join(common, "attname", "left").join(bounds, "attname", "left").join(found, "attname", "left")
