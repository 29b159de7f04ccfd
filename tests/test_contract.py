"""The driver contract: flagship, registry consistency, and a few queries against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r["horizon"] for r in sorted(rows, key=lambda r: r["horizon"])] == [30, 60, 90]
    assert all(r["oos_emitted"] == r["eligible_days"] > 0 for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["feat_rsi14", "win_zdev150", "join_asof_backward", "agg_label_layers",
                                  "bt_long_walkforward", "snk_upsert_coalesce", "str_minute_bars"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), cols) is None


@pytest.mark.parametrize("name, parts", [
    ("exp_label_diagnostic_all", {"layers": "exp_label_diagnostic_layers", "missing": "agg_missing", "jumps": "win_jumps"}),
    ("exp_snapshot_audit_all", {"summary": "exp_snapshot_audit_summary", "ratios": "exp_snapshot_audit_ratios", "changed_by_year": "agg_changed_by_year",
                                           "islands": "win_islands", "contamination": "win_trailing_contamination"})])
def test_composites_hold_all_their_sections(spark, name, parts):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()[name](spark, sf).cache()
    want = {"exp_label_diagnostic_all": {"distribution", "contamination"}, "exp_snapshot_audit_all": {"metrics"}}[name] | set(parts)
    assert {r.section for r in got.select("section").distinct().collect()} == want - {s for s, q in parts.items() if s == "jumps" and entry.queries()[q](spark, sf).isEmpty()}
    for section, query in parts.items():
        df = entry.queries()[query](spark, sf)
        rows = lambda x: sorted(map(str, x.select(*df.columns).collect()))
        assert rows(got.where(f"section = '{section}'")) == rows(df)
