"""Queries against their SQL on small tables made for the case: rows that repeat, texts cut anywhere, means just at a bound."""

import datetime as dt

import duckdb
import pytest

from strandweave.registry import ORACLES, QUERIES


def compared(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL), sorted; tables: a list of dicts each, types by DuckDB's of the values."""
    con = duckdb.connect()
    for t, (kinds, rows) in tables.items():
        con.execute(f"create table {t} ({kinds})")
        con.executemany(f"insert into {t} values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    said = con.execute(ORACLES[name])
    columns = [d[0] for d in said.description]
    want = sorted(said.fetchall())
    return sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()), want


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar"


def test_references_without_end(spark, tmp_path):
    rows = [(1, "u", "<p>a &amp; b &copy; &quot;c&quot; <b>x</b> &am"), (2, "u", "x &amp<p>&&amp;amp; &middot; &lt; &quo"), (3, "u", "&copy no end &#65; &ampp")]
    got, want = compared(spark, tmp_path, "b16_neutral_markup", pages=("page_id bigint, url varchar, html varchar", rows))
    assert got == want


def test_lines_that_come_twice_are_one_segment(spark, tmp_path):
    day = lambda n: dt.datetime(1998, 1, 1) + dt.timedelta(days=n)
    orders = [(3, 7, "O", 1.0, day(0), "1"), (4, 7, "O", 1.0, day(40), "1")]
    line = lambda order, number, ship: (order, 1, 1, number, 1.0, 1.0, 0.0, 0.0, "N", "O", day(ship))
    items = [line(3, 3, 30), line(3, 3, 30), line(4, 1, 60)]
    kinds = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp"
    got, want = compared(spark, tmp_path, "d14_passport", orders=("o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar", orders), lineitem=(kinds, items))
    assert got == want == [(7, 0, 0, 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_mean_at_the_bound_hangs_on_no_split(spark, tmp_path, parts):
    """62 weights whose mean is just 0.5: added one after another it comes out below."""
    import random

    r = random.Random(5)
    while True:
        w = [r.randrange(100) for _ in range(61)]
        w.append(3100 - sum(w))
        s = 0.0
        for x in w:
            s += x / 100
        if 0 <= w[-1] < 100 and s / 62 < 0.5:
            break
    rows = [(k, dt.datetime(2024, 1, 1), 5, "view", 1.0, f'{{"k": {x}}}') for k, x in enumerate(w)]
    _, want = compared(spark, tmp_path, "b13_suspects", events=(EVENTS, rows))
    folder = tmp_path / "split"
    spark.read.parquet(f"{tmp_path}/events.parquet").repartition(parts, "event_id").write.parquet(f"{folder}/events.parquet")
    assert [tuple(x) for x in QUERIES["b13_suspects"](spark, str(folder)).collect()] == want == [(5,)]


def test_numbers_and_lines_over_many_stretches(spark, monkeypatch):
    """Rows numbered and interpolated in stretches of five rows, none of them a whole series: nulls, nan and ends as in one window."""
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from strandweave.operators import intervals, signal, windows

    monkeypatch.setattr(windows, "STRETCH", 5)
    r = np.random.default_rng(3)
    rows = [("a" if k % 3 else None, None if k % 17 == 0 else int(r.integers(0, 400)) ** 2, k) for k in range(120)]
    df = spark.createDataFrame(rows, "s string, x long, y long")
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("x", "y")) - 1)
    got = windows.numbered(df, ["s"], ["x", "y"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_cut" in plan

    knots = [("a", float(x), float(y)) for x, y in zip(r.integers(-50, 50, 20), r.integers(0, 9, 20))] + [("b", 1.0, 4.0)]
    probes = [("a", float(x)) for x in r.uniform(-80, 80, 60)] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("a", -float("inf")), ("b", -3.0), ("b", 9.0), ("c", 1.0)]
    p, k = spark.createDataFrame(probes, "s string, t double"), spark.createDataFrame(knots, "s string, kt double, kv double")
    few = sorted(map(tuple, intervals.interpolated(p, k, ["s"]).collect()), key=repr)
    monkeypatch.setattr(windows, "STRETCH", 10**6)
    assert repr(few) == repr(sorted(map(tuple, intervals.interpolated(p, k, ["s"]).collect()), key=repr))
    x, y = zip(*sorted({x: y for _, x, y in sorted(knots[:-1])}.items()))
    for s, t, v in few:
        if s == "a" and t is not None and np.isfinite(t):
            assert abs(v - np.interp(t, x, y)) < 1e-12

    grid = spark.createDataFrame([("a", i) for i in range(200)] + [("z", 7)], "s string, i long")
    curve = spark.createDataFrame([("a", float(t), t % 7 / 10) for t in range(0, 20, 2)], "s string, t double, shift double")
    cuts = spark.createDataFrame([("a", 3.0), ("a", 9.5), ("a", 9.7), ("a", 14.0)], "s string, tc double")
    whole = sorted(map(tuple, signal.piecewise_places(grid, curve, cuts, ["s"], 10.0).collect()))
    monkeypatch.setattr(windows, "STRETCH", 5)
    assert whole == sorted(map(tuple, signal.piecewise_places(grid, curve, cuts, ["s"], 10.0).collect()))
