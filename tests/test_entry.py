"""The registry, and a slice of the queries against their SQL twins at the smallest scale."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("LEXMILL_TESTDATA", "/root/testdata/sf0.001"))
SOME = ["p1_found", "p2_found", "p2_known", "p4_found", "p4_lines", "p5_found", "p6_found", "t_annotation_prefix", "t_cells", "s_translations", "j_misses", "q_suggest", "c_first_emission", "h_synset_status", "w_runs"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SOME) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_twins(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    order = [list(rel.columns).index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_no_shortcuts_in_plans(spark):
    if not DATA.exists():
        pytest.skip("test tables are not here")

    def plan(name):
        """The plan as it ran, without the initial plans."""
        df = entry.queries()[name](spark, str(DATA))
        df.collect()
        out, skip = [], None
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            skip = None if skip is not None and depth <= skip and "Initial Plan" not in line and "+- *" in line else skip
            skip = depth if "Initial Plan" in line else skip
            if skip is None:
                out.append(line)
        return "\n".join(out)

    counts, found, orphans = plan("p6_counts"), plan("p6_found"), plan("p4_found")
    assert "ReadSchema: struct<c1:string,c5:string>" in counts and "Python" not in counts and counts.count("LeftOuter") == 1
    # The total of all rows reads the shuffle of the per-key states again: one join, one scan of the rows.
    assert found.count("LeftOuter") == 1 and found.count("c1:string") == 1 and "ReusedExchange" in found
    assert orphans.count("LeftAnti") == 1
