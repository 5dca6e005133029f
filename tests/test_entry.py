"""The driver contract, and every query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelyard.plans import all_queries, all_sql

SMOKE = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def test_entry_returns_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["n_dates", "ic_mean", "ic_std", "ic_ir", "positive_ratio", "t_stat"] and out.count() == 1


def test_names_agree():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) > 150 and set(sql) <= set(qs)
    # of the library's own queries only fitted models have no SQL form
    assert set(all_queries()) - set(all_sql()) == {"model_out_of_fold"}


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    df = entry.queries()[name](spark, SMOKE)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))


def test_facts_store_their_bars_once_and_keep_one_table(spark, monkeypatch):
    """Bars are made once, and of the stored tables only the result stays."""
    from pathlib import Path

    from panelyard.plans import chart_queries, score_queries
    from panelyard.session import shared_folder
    calls, bars = [], score_queries.weekly_bars
    for module in (score_queries, chart_queries):
        monkeypatch.setattr(module, "weekly_bars", lambda *a: calls.append(1) or bars(*a))
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = {p.name for p in folder.glob("panelyard-*")}
    facts = score_queries.facts(spark, entry.SMOKE_DIR)
    assert facts.count() == 10 and len(calls) == 1
    assert len({p.name for p in folder.glob("panelyard-*")} - before) == 1
