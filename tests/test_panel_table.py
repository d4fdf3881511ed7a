"""The panel by month: what an update opens and builds, against the full build."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts
from factorspark.plans import panel as N
from factorspark.plans.panel_table import BARS, PanelTable

START, VALUES, SETTINGS = dt.date(2015, 1, 1), ["ni"], {"fill": 5, "min_beta": 30}


@pytest.fixture(scope="module")
def inputs(spark):
    days = [d for i in range(365 * 4) if (d := START + dt.timedelta(days=i)).weekday() < 5]
    px = lambda s, i: 20 + s + 5 * math.sin(i / (17 + s)) + i / 100
    bars = [(s, d, i, px(s, i), px(s, i), 1e6 * (s + 1), px(s, i) / px(s, i - 1) - 1 if i else None, 0.1 if i % 97 == s else 0.0) for s in range(4) for i, d in enumerate(days) if (i + s) % 11]
    bars = spark.createDataFrame(bars, BARS).persist()
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, sno bigint")
    index = bars.groupBy("sno", "date").agg(F.avg("close").alias("close")).persist()
    docs = spark.createDataFrame([(s, dt.date(y, 12, 31), dt.date(y + 1, 3, 15), float(y + s)) for s in range(4) for y in (2014, 2015, 2016, 2017)], "issuer bigint, dt_refer date, available_from date, ni double")
    links = spark.createDataFrame([(s, s, "x", False) for s in range(4)], "sid bigint, issuer bigint, sector string, is_fin boolean")
    return bars, sessions, index, docs, links


def put(bars, table, part):
    bars.filter(part).withColumn("month", F.date_format("date", "yyyy-MM")).repartition("month").write.mode("append").partitionBy("month").parquet(table.bars)


def parts(inputs, until):
    _, sessions, index, docs, links = inputs
    months = ts.month_ends(sessions.filter(F.col("date") < until))
    members = months.select("t").join(F.broadcast(links.agg(F.collect_list("sid").alias("s")))).select("t", F.explode("s").alias("sid"))
    return index.filter(F.col("date") < until), months, members, docs, VALUES, links


def rows(df):
    return {(str(r.t), r.sid): tuple(None if v is None else round(v, 8) if isinstance(v, float) else v for v in r[2:]) for r in df.select("t", "sid", "MOM", "VOL", "BETA", "LIQ", "dy", "px", "fwd", "ni", "doc_ref").collect()}


def test_updates_equal_the_full_build_and_open_only_the_look_back(spark, inputs, tmp_path):
    bars = inputs[0]
    table = PanelTable(spark, str(tmp_path / "panel"), str(tmp_path / "bars"))
    put(bars, table, "date < '2018-09-01'")
    first = table.update(*parts(inputs, "2018-09-01"), **SETTINGS)
    assert first[0] == "2016-01" and first[-1] == "2018-07"
    assert table.update(*parts(inputs, "2018-09-01"), **SETTINGS) == [] and table.opened == []
    put(bars, table, "date >= '2018-09-01' AND date < '2018-10-01'")
    assert table.update(*parts(inputs, "2018-10-01"), **SETTINGS) == ["2018-08"]
    assert table.opened[0] == "2016-12" and table.opened[-1] == "2018-09" and len(table.opened) == 22
    index, months, members, docs, values, links = parts(inputs, "2018-10-01")
    full = N.factor_panel(bars.filter("date < '2018-10-01'"), index.select("sno", "close"), months, members, docs, values, links, **SETTINGS)
    got, want = rows(table.read()), rows(full)
    assert got.keys() == want.keys() and len(got) == 4 * 32
    assert all(a == b or a == pytest.approx(b, rel=1e-6) for k in want for a, b in zip(got[k], want[k], strict=True))

    more = docs.unionByName(spark.createDataFrame([(2, dt.date(2017, 12, 31), dt.date(2018, 5, 2), 99.0)], docs.schema))
    again = table.update(index, months, members, more, values, links, **SETTINGS)
    assert again == ["2018-05", "2018-06", "2018-07", "2018-08"] and {r.ni for r in table.read().filter("sid = 2 AND t > '2018-06-01'").collect()} == {99.0}


def test_a_failed_update_leaves_the_table_as_it_was(spark, inputs, tmp_path, monkeypatch):
    table = PanelTable(spark, str(tmp_path / "panel"), str(tmp_path / "bars"))
    put(inputs[0], table, "date < '2016-06-01'")
    table.update(*parts(inputs, "2016-06-01"), **SETTINGS)
    seen = rows(table.read())
    put(inputs[0], table, "date >= '2016-06-01' AND date < '2016-08-01'")

    def lost(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(PanelTable, "_build", lost)
        with pytest.raises(RuntimeError):
            table.update(*parts(inputs, "2016-08-01"), **SETTINGS)
    assert rows(table.read()) == seen
    assert "2016-06" in table.update(*parts(inputs, "2016-08-01"), **SETTINGS) and len(rows(table.read())) > len(seen)
