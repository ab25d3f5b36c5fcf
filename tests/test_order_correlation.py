"""Order correlation over many ranges of rows and of cells, against ranks counted one by one, and what it writes."""

import math
import random

import numpy as np
import pytest

from fleetstat.operators import distribution as D

TOP = 2**53


@pytest.fixture(params=[True, False])
def cut(spark, request):
    """With and without small ranges merged."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param).lower())
    yield
    spark.conf.set(name, before)


def brute_force(rows, names, order):
    """Rows in order (NULLs first, ties by the other columns), then each column's ranks; None for a column of one value."""
    by = [names.index(c) for c in [*order, *[n for n in names if n not in order]]]
    low = lambda v: (v is not None, not isinstance(v, str) and v is not None and math.isnan(v), v if v is not None and v == v else 0)
    rows = sorted(rows, key=lambda r: [low(r[i]) for i in by])
    found = {}
    for i, name in enumerate(names):
        places = [k for k, r in enumerate(rows) if r[i] is not None]
        text = lambda k: str(rows[k][i]) if isinstance(rows[k][i], int) and abs(rows[k][i]) >= TOP else ""
        number = lambda k: float(rows[k][i]) if isinstance(rows[k][i], int) else rows[k][i]
        ranks = {k: j for j, k in enumerate(sorted(places, key=lambda k: (low(number(k)), text(k), k)))}
        if places:
            found[name] = (len(places), np.corrcoef(places, [ranks[k] for k in places])[0, 1] if len(places) > 1 else None)
    return found


def test_places_and_ranks_over_many_ranges(spark, cut, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.randrange(5), rng.choice([None, "x", "y", f"t{i}"]), rng.choice([float("nan"), None, 0.5, rng.random()]),
             rng.choice([TOP + rng.randrange(5), -TOP - rng.randrange(5), i]), 7 if i == 900 else None) for i in range(1500)]
    rows += rows[:200] + [(None,) * 6] * 50
    names = ["k", "few", "t", "d", "big", "once"]
    df = spark.createDataFrame(rows, "k long, few int, t string, d double, big long, once int").repartition(9)
    written = []
    keep = D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    got = {r.attname: (r.value_count, r.correlation) for r in D.order_correlation(df, "t", ["k"]).collect()}
    want = brute_force(rows, names, ["k"])
    assert set(got) == set(want) and got["once"] in ((1, None), (2, 1.0))
    for name, (count, correlation) in want.items():
        assert got[name][0] == count
        assert got[name][1] == (correlation if correlation is None else pytest.approx(correlation, abs=1e-6))
    assert sum(w.count() for w in written) < len(rows)  # sums only: neither rows nor cells are written a second time


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "k long, t string")
    assert D.order_correlation(df.where("k < 0"), "t", ["k"]).collect() == []
    assert [(r.attname, r.value_count, r.correlation) for r in D.order_correlation(df, "t", ["k"]).orderBy("attname").collect()] == [("k", 1, None), ("t", 1, None)]
    assert D.order_correlation(df.where("k IS NULL"), "t", ["k"]).collect() == []
