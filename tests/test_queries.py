"""Every registered query runs; those with SQL equal what DuckDB finds."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = driver.catalog.QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(rows, names):
    one = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in OWN if n in driver.catalog.ORACLES])
def test_equals_sql(spark, sf, duck, name):
    df = OWN[name](spark, sf)
    found = duck.execute(driver.catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    norm = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert plain([[norm(v) for v in r] for r in df.collect()], df.columns) == plain([[norm(v) for v in r] for r in found.fetchall()], names)


@pytest.mark.parametrize("name", [n for n in OWN if n not in driver.catalog.ORACLES])
def test_runs(spark, sf, name):
    assert OWN[name](spark, sf).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_set_cover_against_greedy(spark, sf):
    from fieldloom.plans import catalog

    ranked = catalog.ranked(spark, sf).toPandas()
    got = {r.plot_id: r for r in OWN["set_cover"](spark, sf).collect()}
    for plot, g in ranked.groupby("plot_id"):
        g = g.sort_values("rank").head(16)
        x0, y0, x1, y1 = g.iloc[0][["x0", "y0", "x1", "y1"]]
        nodes = [(x0 + (x1 - x0) * (k % 5 / 4), y0 + (y1 - y0) * (k // 5 / 12)) for k in range(65)]
        sees = [{k for k, (x, y) in enumerate(nodes) if r.fx0 <= x < r.fx1 and r.fy0 <= y < r.fy1} for r in g.itertuples()]
        have, used = set(sees[0]), [0]
        while len(have) < 65 and len(used) < 8 and max(len(s - have) for s in sees):
            used.append(max(range(len(sees)), key=lambda j: (len(sees[j] - have), -j)))
            have |= sees[used[-1]]
        assert (got[plot].frames, got[plot].covered) == (",".join(str(g.camera.iloc[k]) for k in used), len(have))
