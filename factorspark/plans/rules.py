"""Rules in SQL: a user states a score or an allocation as a table function and the plans take it without code here.

A rule reads one view: ``rule_panel``, the factor panel, or ``rule_days``, a row for each rebalance. It becomes a temporary function of the session, so
it can be called with arguments from any SQL as well, and Catalyst inlines it: filters and pruned columns reach the panel, and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: What a score rule and a target rule return. A row for each (t, sid), for each (i, sleeve); a null score leaves a name out.
SCORE, TARGET = "t DATE, sid BIGINT, score DOUBLE", "i BIGINT, sleeve STRING, w DOUBLE"
PANEL_VIEW, DAYS_VIEW = "rule_panel", "rule_days"


def score_rule(panel: DataFrame, name: str, body: str, parameters: str = "") -> Callable[..., DataFrame]:
    """Registers ``body``, a query over ``rule_panel``, as the score rule ``name``; returns it for ``panel.transform(rule, *arguments)``.

    ``parameters`` are declared as in SQL, ``momentum DOUBLE DEFAULT 0.5``. A rule of that name is replaced. ``panel`` gives the view its
    columns; a later panel may have more.
    """
    return _rule(panel, PANEL_VIEW, name, SCORE, body, parameters)


def target_rule(days: DataFrame, name: str, body: str, parameters: str = "") -> Callable[..., DataFrame]:
    """Likewise an allocation: a query over ``rule_days`` that gives each rebalance ``i`` its weights by sleeve."""
    return _rule(days, DAYS_VIEW, name, TARGET, body, parameters)


def _rule(frame: DataFrame, view: str, name: str, returns: str, body: str, parameters: str) -> Callable[..., DataFrame]:
    frame.createOrReplaceTempView(view)
    frame.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({returns}) RETURN {body}")

    def apply(over: DataFrame, *arguments) -> DataFrame:
        # a frame binds its view when it is made, so the next call may put another frame there
        over.createOrReplaceTempView(view)
        return over.sparkSession.sql(f"SELECT * FROM {name}({', '.join('?' * len(arguments))})", args=list(arguments))

    return apply
