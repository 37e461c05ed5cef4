import duckdb
import pytest

import __spark_entry__ as e
from tests.helpers import TABLES, assert_same
from tonegauge.oracles import ORACLE_SQL
from tonegauge.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), sf, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"volume_bands", "evidence_overlay"}))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).collect()


def test_release_metrics_hold(spark, sf):
    assert all(r.failures == 0 and r.rows > 0 for r in QUERIES["release_metrics"](spark, sf).collect())


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["deadline_resolution", "text_mentions"])
def test_times_do_not_depend_on_the_sessions_zone(spark, sf, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert_same(QUERIES[name](spark, sf), sf, ORACLE_SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_overlay_deals_documents_out(spark, sf, monkeypatch):
    from tonegauge.plans import store

    plans, write = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    assert QUERIES["document_overlay"](spark, sf).count() > 0
    assert "REPARTITION_BY_NUM" in plans[0]  # before their words are looked for


def test_words_of_texts_are_found_once(spark, sf):
    plan = QUERIES["text_mentions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "words" in plan and "regexp" not in plan and "split(" not in plan  # not for each event that says them


def _in_place_of(folder, sf, table, sql):
    """The folder's path, holding sf's tables but for one, which holds what the SQL gives."""
    for t in TABLES:
        if t != table:
            (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    duckdb.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
    return str(folder)


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
def test_deadlines_of_times_near_the_next_minute(spark, sf, tmp_path, kind):
    """Half a millisecond before a minute is that minute for epoch_ms, and a negative id's phrase counts from the end."""
    times = [f"2024-01-{d} {clock}" for d in ("05", "15", "31") for clock in ("11:59:59.9995", "16:59:59.999499", "17:00:59.999999", "23:59:59.9996", "12:00:00.000499")]
    rows = ", ".join(f"(({n} - 9) * 18 + {k} + 1, {kind} '{t}{'+00' if kind == 'TIMESTAMPTZ' else ''}')" for n, t in enumerate([*times, *times]) for k in range(18))
    at = _in_place_of(tmp_path, sf, "events", f"SELECT CAST(v.event_id AS BIGINT) AS event_id, v.ts FROM (VALUES {rows}, (999, NULL)) AS v(event_id, ts)")
    assert_same(QUERIES["deadline_resolution"](spark, at), at, ORACLE_SQL["deadline_resolution"])


def test_rules_in_documents_of_odd_ids(spark, sf, tmp_path):
    """A document without id has no examples and so no text; a negative id's examples count from the end."""
    odd = "SELECT CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(n - 600 AS BIGINT) END AS doc_id, CASE WHEN n % 7 = 0 THEN NULL ELSE 'Could you send it ASAP, please?' || n END AS text FROM range(1200) AS t(n)"
    at = _in_place_of(tmp_path, sf, "documents", odd)
    assert_same(QUERIES["document_rule_hits"](spark, at), at, ORACLE_SQL["document_rule_hits"])
