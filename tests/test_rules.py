"""Rules stated in SQL, plugged into the plans as table functions."""

import datetime as dt

import pytest

from factorspark.operators.portfolio import drift_nav, implied_premium
from factorspark.plans.rules import score_rule, target_rule

DAY = dt.date(2024, 1, 31)


def panel(spark, rows):
    return spark.createDataFrame(rows, "t date, sid long, EY double, MOM double")


def test_score_rule_takes_arguments_and_another_panel(spark):
    first = panel(spark, [(DAY, 1, 0.2, 1.0), (DAY, 2, None, 3.0)])
    rule = score_rule(first, "blend_score", "SELECT t, sid, part * EY + (1 - part) * MOM FROM rule_panel", "part DOUBLE DEFAULT 0.5")
    one = first.transform(rule)
    other = panel(spark, [(DAY, 9, 1.0, 0.0)]).transform(rule, 0.25)
    assert {(r.sid, r.score) for r in one.collect()} == {(1, 0.6), (2, None)}  # still the panel it was made over
    assert [tuple(r) for r in other.collect()] == [(DAY, 9, 0.25)]
    assert [r.score for r in spark.sql("SELECT * FROM blend_score(part => 1D)").collect()] == [1.0]
    assert "Python" not in other._jdf.queryExecution().toString().replace("PythonSQL", "")


def test_filters_go_through_the_function(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, [(DAY, i, i / 10, 0.0) for i in range(20)]).write.parquet(path)
    p = spark.read.parquet(path)
    rule = score_rule(p, "plain_score", "SELECT t, sid, EY FROM rule_panel")
    plan = p.transform(rule).filter("sid = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sid,3)" in plan and "MOM" not in plan


def test_rule_is_replaced_and_checked(spark):
    p = panel(spark, [(DAY, 1, 0.2, 1.0)])
    score_rule(p, "again_score", "SELECT t, sid, EY FROM rule_panel")
    rule = score_rule(p, "again_score", "SELECT t, sid, MOM FROM rule_panel")
    assert p.transform(rule).first().score == 1.0
    with pytest.raises(Exception, match="no_such_column"):
        score_rule(p, "bad_score", "SELECT t, sid, no_such_column FROM rule_panel")
    assert panel(spark, []).transform(rule).count() == 0


def test_target_rule_drives_a_nav(spark):
    days = spark.createDataFrame([(0, "bear"), (2, "risk_on")], "i long, regime string")
    rule = target_rule(days, "two_target", """SELECT i, s.k, s.w FROM (SELECT i, CASE regime WHEN 'bear' THEN low ELSE 1D END AS e FROM rule_days)
        LATERAL VIEW explode(array(named_struct('k', 'eq', 'w', e), named_struct('k', 'cdi', 'w', 1 - e))) x AS s""", "low DOUBLE")
    rets = spark.createDataFrame([(i, s, r) for i in range(5) for s, r in (("eq", 0.1), ("cdi", 0.0))], "i long, sleeve string, ret double")
    rets = rets.selectExpr("'v' v", "i", "date_add(date'2024-01-01', int(i)) date", "sleeve", "ret")
    nav = {r.i: r.nav for r in drift_nav(rets, days.transform(rule, 0.5).selectExpr("'v' v", "*"), ["v"], k=2).collect()}
    up = 100 * 0.999 * (0.5 * 1.21 + 0.5)
    share = 0.5 * 1.21 / (0.5 * 1.21 + 0.5)
    assert nav[4] == pytest.approx(up * (1 - 2 * (1 - share) * 0.001) * 1.21)


def test_premium_of_the_basket_in_force(spark):
    basket = spark.createDataFrame([(dt.date(2024, 1, 31), 1, 0.2), (dt.date(2024, 1, 31), 2, None), (dt.date(2024, 1, 31), 3, 0.1), (dt.date(2024, 2, 29), 1, None)], "t date, sid long, ey double")
    rates = spark.createDataFrame([(dt.date(2024, 1, 30), 0.0), (dt.date(2024, 1, 31), 0.0), (dt.date(2024, 2, 28), 0.0004), (dt.date(2024, 2, 29), 0.0)], "date date, cdi double")
    got = {r.date.isoformat(): r.erp for r in implied_premium(basket, rates).collect()}
    assert got["2024-01-30"] is None and got["2024-02-29"] is None  # no basket yet; a basket without a yield
    assert got["2024-01-31"] == pytest.approx(0.15) and got["2024-02-28"] == pytest.approx(0.15 - (1.0004 ** 252 - 1))
