"""Distribution of values: nested paths, exact common values from bounded summaries, bounds and ranks from range-cut sorts."""

import random
from collections import Counter

import numpy as np
import pytest

from fleetstat.operators import distribution as D


def test_paths_into_nested_columns(spark):
    df = spark.createDataFrame(
        [(1, [1.5, None], {"a": [1, 2]}, (7, ["x", "y"]), '{"k": 1, "o": {"p": "q", "r": {"deep": {"er": 1}}}, "l": [1, 2]}', bytearray(b"ab")),
         (2, None, None, None, "no json", None), (3, [], {}, (None, None), None, bytearray(b"ab"))],
        "id long, f array<double>, m map<string,array<int>>, s struct<n:int,t:array<string>>, j string, b binary")
    got = Counter((r["attname"], r["text"], r["number"]) for r in D.cells(df, json=("j",)).collect())
    assert got[("f[]", None, 1.5)] == 1 and got[("f[]", None, None)] == 1
    assert got[("f.size", "2", 2.0)] == 1 and got[("f.size", "0", 0.0)] == 1 and got[("f.size", None, None)] == 1
    assert got[("m.keys[]", "a", None)] == 1 and got[("m.values[][]", "2", 2.0)] == 1 and got[("m.values[].size", "2", 2.0)] == 1
    assert got[("s.n", "7", 7.0)] == 1 and got[("s.n", None, None)] == 2 and got[("s.t[]", "y", None)] == 1
    assert got[("j.k", "1", None)] == 1 and got[("j.o.p", "q", None)] == 1 and got[("j.l", "[1,2]", None)] == 1
    assert got[("j.o.r.deep", '{"er":1}', None)] == 1 and got[("b", "YWI=", None)] == 2
    nested = {r["attname"]: r for r in D.nested_profile(df, "t", ("j",)).collect()}
    assert nested["f[]"]["null_frac"] == 0.5 and nested["f[]"]["n_distinct"] == -1 and "id" not in nested and "b" not in nested
    with pytest.raises(ValueError):
        D.cells(df.select("id"), nested_only=True)


def exact_top(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(((v, n) for v, n in counts.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("tracked, named", [(D.TRACKED, D.NAMED), (8, 8), (8, 2)])
def test_common_values_are_exact_whatever_the_summaries_hold(spark, tracked, named):
    """Few heavy values, a flat column, a unique one, ties at the border and a hot value with a third of all rows."""
    rng = random.Random(1)
    rows = [(rng.choice([1] * 30 + list(range(60))), rng.randrange(400), i, "hot" if i % 3 == 0 else f"v{i % 50:02}", None, "a" * 40 + str(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "heavy int, flat long, one long, hot string, void string, wide string").repartition(5)
    found = D.most_common_values(df, "t", 5, tracked=tracked, named=named).collect()
    for i, name in enumerate(df.columns[:4]):
        got = [(r["value"], r["freq"]) for r in sorted(found, key=lambda r: r["rank"]) if r["attname"] == name]
        assert got == [(str(v), n) for v, n in exact_top([r[i] for r in rows], 5)]
    assert not [r for r in found if r["attname"] == "void"]
    assert {r["value"][:4] for r in found if r["attname"] == "wide"} == {"md5:"}


def test_bounds_and_ranks(spark):
    rng = random.Random(2)
    rows = [(i, 5.0 if i % 2 else rng.random() * 10, rng.choice(["x", "y", None]), None) for i in range(501)]
    df = spark.createDataFrame(rows, "id long, d double, t string, void int").repartition(7)
    found = D.histogram_bounds(df, "t", 4).collect()
    for i, name in ((0, "id"), (1, "d"), (2, "t")):
        values = sorted(r[i] for r in rows if r[i] is not None)
        want = [values[j * (len(values) - 1) // 4] for j in range(5)]
        got = [r["bound_text"] if name == "t" else r["bound_number"] for r in sorted(found, key=lambda r: r["bucket"]) if r["attname"] == name]
        assert got == want
    assert not [r for r in found if r["attname"] == "void"]
    few = D.histogram_bounds(df.where("id < 2").select("id"), "t", 4).orderBy("bucket").collect()
    assert [r["bound_number"] for r in few] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert D.histogram_bounds(df.where("id < 0"), "t").collect() == []


def test_order_correlation(spark):
    rng = random.Random(3)
    rows = [(i, 2 * i, -i, rng.randrange(9), "same", None if i % 4 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, up long, down long, few int, same string, some double").repartition(6)
    got = {r["attname"]: r for r in D.order_correlation(df, "t", ["id"]).collect()}
    assert got["up"]["correlation"] == 1.0 and got["down"]["correlation"] == -1.0 and got["same"]["correlation"] == 1.0
    assert got["some"]["value_count"] == 75 and got["some"]["correlation"] == 1.0
    place = {i: k for k, i in enumerate(sorted(range(300), key=lambda i: (rows[i][3], i)))}
    want = np.corrcoef(np.arange(300), [place[i] for i in range(300)])[0, 1]
    assert got["few"]["correlation"] == pytest.approx(want, abs=1e-6)


def test_no_range_holds_a_hot_value(spark):
    """Ties are told apart, so a value in every row is cut into ranges like any other."""
    df = spark.range(4000).selectExpr("1 AS one", "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = D.ranked(df.selectExpr("'c' AS attname", "cast(one AS double) AS number", "id AS tie"), "attname", ["number", "tie"])
        assert sorted(r["rank"] for r in rows.collect()) == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
