"""Plan properties of the registered queries (the scale review, kept as tests)."""

import contextlib
import io
import re

import pytest

from veilgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _details(txt):
    """(operator name, body) for each numbered node of a formatted plan."""
    out = []
    for head, body in re.findall(r"^\(\d+\) (.+?)$(.*?)(?=^\(\d+\)|\Z)", txt, flags=re.M | re.S):
        out.append((re.sub(r" \[codegen id : \d+\]", "", head).strip(), body))
    return out


# Building these runs their pipeline (streaming replay, CSV export); their own
# plans are reads of what they wrote, checked in test_entry.
EXECUTED_AT_BUILD = {"events_stream_notifications", "events_table_export", "export_customers_like", "audit_log_appended"}


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF)) for name, fn in QUERIES.items() if name not in EXECUTED_AT_BUILD}


def test_no_pairwise_joins_and_no_python(plans):
    for name, txt in plans.items():
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in txt, (name, bad)


def test_hidden_columns_never_scanned(plans):
    hidden = {
        "governed_lineitem_ops_viewer": ("l_discount", "l_tax"),
        "governed_customer_like_sales_viewer": ("c_acctbal",),
        "governed_segment_orders_sales_viewer": ("c_acctbal",),
        "governed_part_preview": ("p_retailprice",),
    }
    for name, cols in hidden.items():
        schemas = re.findall(r"ReadSchema: (struct<.*?>)", plans[name])
        assert schemas, name
        for s in schemas:
            for c in cols:
                assert f"{c}:" not in s, (name, c, s)


def test_filters_reach_the_scan(plans):
    assert "EqualTo(o_orderstatus,F)" in plans["audit_orders_update"]
    assert "StringStartsWith(c_name,Customer#00000)" in plans["governed_customer_like_sales_viewer"]
    assert "EqualTo(event_type,purchase)" in plans["events_audit_lookup"]
    assert "LessThan(o_orderdate" in plans["orders_export_increment"]


def test_audit_lookup_shuffles_once(plans):
    nodes = _details(plans["events_audit_lookup"])
    assert sum(1 for n, _ in nodes if n == "Exchange") == 1
    assert sum(1 for n, _ in nodes if n == "Window") == 1


def test_in_row_audit_is_one_narrow_pass(plans):
    nodes = [n for n, _ in _details(plans["audit_orders_update"])]
    assert not any(x in n for n in nodes for x in ("Join", "Exchange", "Sort"))


def test_reports_neither_sort_merge_nor_deal_round(plans):
    for name, txt in plans.items():
        if name.startswith(("report_", "events_")):
            assert "SortMergeJoin" not in txt and "RoundRobin" not in txt, name
    assert not any("Exchange" in n for n, _ in _details(plans["report_outcomes"]) if n != "BroadcastExchange")


def test_events_queries_do_not_go_through_text(plans):
    for name in ("events_route", "events_deduped", "events_quality", "events_archive", "events_notifications"):
        assert "parsejson" not in plans[name].lower() and "from_json" not in plans[name] and "to_json" not in plans[name], name
    # The text is parsed once, to a VARIANT.
    assert plans["events_normalized"].lower().count("parsejson(") == 1
    assert sum(1 for n, _ in _details(plans["events_dead_letters"]) if n.startswith("Scan parquet")) == 1
