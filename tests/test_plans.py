"""Plan shapes that matter at scale, read from ``explain()`` output."""

import __spark_entry__ as entry

from conftest import SF_SMALL


def plan_of(df, capsys):
    # other tests cache tables; look at the plan over the files themselves
    df.sparkSession.catalog.clearCache()
    df.explain("formatted")
    return capsys.readouterr().out


def test_keyword_classification_needs_no_shuffle(spark, capsys):
    plan = plan_of(entry.queries()["page_keywords"](spark, SF_SMALL), capsys)
    assert "Exchange" not in plan


def test_recommend_uses_partial_top_n_and_equi_joins(spark, capsys):
    plan = plan_of(entry.queries()["recommend_batch"](spark, SF_SMALL), capsys)
    assert plan.count("WindowGroupLimit") >= 2  # partial before the shuffle, final after
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_city_stats_reads_only_needed_columns(spark, capsys):
    plan = plan_of(entry.queries()["city_stats"](spark, SF_SMALL), capsys)
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("venue_name" not in s and "latitude" not in s for s in schemas)


def test_mode_is_two_partial_aggregations(spark, capsys):
    plan = plan_of(entry.queries()["mode_price_by_city"](spark, SF_SMALL), capsys)
    assert "Window" not in plan
    assert plan.count("HashAggregate") >= 4
