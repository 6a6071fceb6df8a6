import pytest

from tessera.plans import analytics, detection, forecasting, news, relational
from tests import oracle

SF = "/root/testdata/sf0.01"
PLANS = (forecasting, detection, news, relational, analytics)
CHECKED = [(p, n) for p in PLANS for n in p.ORACLE]
OTHERS = [(p, n) for p in PLANS for n in p.QUERIES if n not in p.ORACLE]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("plan,name", CHECKED, ids=[n for _, n in CHECKED])
def test_query_equals_its_sql(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, SF)
    oracle.same(df.collect(), df.columns, duck.sql(plan.ORACLE[name]))


@pytest.mark.parametrize("plan,name", OTHERS, ids=[n for _, n in OTHERS])
def test_query_without_sql_gives_rows(spark, plan, name):
    assert plan.QUERIES[name](spark, SF).count() > 0


def test_pushdown_reaches_the_scan(spark):
    plan = relational.scan_pruned(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "l_extendedprice" not in plan


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
