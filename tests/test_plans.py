"""Plan checks: no Python in the hot path, filters reach the scan, top-N is limited on
the map side, fixed lookups need no join."""

import __spark_entry__ as E
from conftest import SMALL

PY_OK = {"scored_blocks"}   # V1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_no_python_udfs_outside_hooks(spark):
    q = E.queries()
    for k in ("issue_messages", "page_text_lines", "url_resolve", "top_articles", "newsletter_html",
              "news_tier1", "trailing_rate", "classify_category", "dedup_exact", "text_blocks", "text_blocks_udf"):
        p = plan(q[k](spark, SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p, k


def test_hook_uses_arrow(spark):
    p = plan(E.queries()["scored_blocks"](spark, SMALL))
    assert "MapInPandas" in p or "PythonMapInArrow" in p


def test_date_filter_pushed_down(spark):
    p = plan(E.queries()["filter_dates"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_newest_n_uses_group_limit(spark):
    for k in ("newest_n", "top5", "mailbox_query"):
        assert "WindowGroupLimit" in plan(E.queries()[k](spark, SMALL)), k


def test_colour_lookup_is_not_a_join(spark):
    p = plan(E.queries()["category_color"](spark, SMALL))
    assert "Join" not in p


def test_no_cartesian_products(spark):
    for k, fn in E.queries().items():
        if k == "pipeline" or k[:2] == "op":               # these run jobs while they are built; tests/llm has them
            continue
        p = plan(fn(spark, SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, k


def test_config_json_parsed_after_routing(spark):
    """No predicate on from_json(text) may reach below the routing join (it would parse
    every message instead of the config mails)."""
    from quire.plans import queries as Q
    p = Q.folded_config(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in p.splitlines() if "Filter" in line and "from_json" in line]
