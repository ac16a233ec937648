"""Plan guards: no cross joins and no row-at-a-time Python UDFs in any
registered batch query; scans carry pushed filters."""

from conftest import SF01

STREAM = "stream_"


def test_no_forbidden_nodes(spark):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from plan_audit import audit

    from keyfold.plans.catalogue import QUERIES

    bad = {}
    for name, q in QUERIES.items():
        if name.startswith(STREAM):
            continue
        a = audit(q(spark, SF01))
        if a["forbidden"]:
            bad[name] = a["forbidden"]
    assert bad == {}


def test_event_scans_push_type_filter(spark):
    from keyfold.operators import reserve
    from keyfold.plans import params as P
    from keyfold.sources import testdata as td

    d = td.domain_events(td.table(spark, SF01, "events"), P.UNIT.restock_qty, ("add", "restock"))
    t = reserve.stock_rows(d, P.UNIT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in t
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in t
