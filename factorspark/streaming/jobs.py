"""Streaming counterparts of the incremental operators.

Sources are file or message streams with an event time; late data is bounded by a watermark. Each
job returns the streaming frame or starts a query with a checkpoint in the folder it is given.
"""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factorspark.operators import technical as T
from factorspark.operators import timeseries as ts

PERIOD = 14


def tick_stream(spark: SparkSession, path: str, pattern: str, schema) -> DataFrame:
    """Ticks from parquet files as they arrive."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return raw.select(F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("px"), "event_type")


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily bars by tumbling windows; a day is final once the watermark has passed its end."""
    seq = F.struct("ts", "event_id")
    return (ticks.withWatermark("ts", late).groupBy("sid", F.window("ts", "1 day").alias("w"))
            .agg(F.min_by("px", seq).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", seq).alias("close"),
                 F.sum("px").alias("volume"), F.count("*").alias("trades"))
            .select("sid", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume", "trades"))


def rolling_activity(ticks: DataFrame, late: str = "2 days", span: str = "5 days", step: str = "1 day") -> DataFrame:
    """Volume and trade count over sliding windows."""
    return (ticks.withWatermark("ts", late).groupBy("sid", F.window("ts", span, step).alias("w"))
            .agg(F.sum("px").alias("volume"), F.count("*").alias("trades"))
            .select("sid", F.to_date("w.start").alias("start"), F.to_date("w.end").alias("end"), "volume", "trades"))


def level_alerts(ticks: DataFrame, levels: DataFrame, late: str = "2 days") -> DataFrame:
    """Alerts of a tick stream against a static table of levels, each kind once per name and day."""
    live = ticks.withWatermark("ts", late).withColumnRenamed("px", "price").withColumn("day", F.to_date("ts"))
    hits = T.level_alerts(levels, live, ["sid"])
    return hits.dropDuplicatesWithinWatermark(["sid", "day", "kind"]).select("sid", "day", "kind")


def run_to_table(df: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Processes what is available into a parquet table and returns it; resumable by its checkpoint."""
    spark = df.sparkSession
    table = os.path.join(folder, name)
    q = (df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", os.path.join(folder, name + "-state"))
         .trigger(availableNow=True).start(table))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(table)


def run_append_log(df: DataFrame, folder: str, date: str) -> DataFrame:
    """Append-only run log, partitioned by month."""
    spark = df.sparkSession
    table = os.path.join(folder, "log")
    out = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    q = (out.writeStream.outputMode("append").format("json").partitionBy("month").option("checkpointLocation", os.path.join(folder, "log-state"))
         .trigger(availableNow=True).start(table))
    q.awaitTermination()
    return spark.read.schema(out.schema).json(table)


def upsert_nav(points: DataFrame, existing: DataFrame, trading: DataFrame | None = None, window_start: str | None = None) -> DataFrame:
    """Merges NAV points by (curve, date) and re-chains the levels.

    A final point replaces a provisional one; of several updates the latest batch wins. Inside the
    reconcile window, points on days without a session are removed. One curve has one row per day.
    """
    rows = existing.withColumn("_rank", F.lit(0)).unionByName(points.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in points.columns if c not in ("curve", "date")]
    pick = F.max_by(F.struct(*rest), F.struct((~F.coalesce("provisional", F.lit(False))).cast("int").alias("f"), "_rank", "version"))
    merged = rows.groupBy("curve", "date").agg(pick.alias("_r")).select("curve", "date", "_r.*")
    if trading is not None:
        merged = merged.join(trading.select("date", F.lit(True).alias("_open")), "date", "left")
        keep = F.col("_open").isNotNull()
        if window_start:
            keep = keep | (F.col("date") < window_start)
        merged = merged.filter(keep).drop("_open")
    return chain_nav(merged)


def chain_nav(points: DataFrame) -> DataFrame:
    """Levels from returns; a null return does not move a level, a null rate on a settled session
    takes the last known rate."""
    w = Window.partitionBy("curve").orderBy("date")
    known = F.last("cdi_ret", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    settled = ~F.coalesce("provisional", F.lit(False)) & F.col("index_ret").isNotNull()
    rate = F.coalesce("cdi_ret", F.when(settled, known))
    return (points.withColumn("nav", ts.chain(F.col("port_ret"), w)).withColumn("index_nav", ts.chain(F.col("index_ret"), w))
            .withColumn("_rate", rate).withColumn("cdi_nav", ts.chain(F.col("_rate"), w)).drop("_rate"))


class WilderProcessor(StatefulProcessor):
    """RSI and ATR of each security as a state machine over its ticks in event-time order.

    The state is the last price, the number of changes and the three averages; during the first
    14 changes the averages hold sums.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("wilder", "n int, last double, gain double, loss double, tr double")

    def handleInputRows(self, key, rows, timerValues):
        state = self._state.get() if self._state.exists() else (0, None, 0.0, 0.0, 0.0)
        n, last, gain, loss, tr = state
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for px in pdf["px"]:
            if last is not None:
                d = px - last
                up, down, move = max(d, 0.0), max(-d, 0.0), abs(d)
                n += 1
                if n <= PERIOD:
                    gain, loss, tr = gain + up / PERIOD, loss + down / PERIOD, tr + move / PERIOD
                else:
                    gain, loss, tr = (gain * 13 + up) / PERIOD, (loss * 13 + down) / PERIOD, (tr * 13 + move) / PERIOD
            last = px
        self._state.update((int(n), float(last), float(gain), float(loss), float(tr)))
        if n >= PERIOD:
            rsi = (100.0 if gain > 0 else 50.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
            yield pd.DataFrame({"sid": [key[0]], "n": [n], "rsi": [rsi], "atr": [tr]})

    def close(self) -> None:
        pass


def wilder(ticks: DataFrame) -> DataFrame:
    """Current RSI and ATR per security after every micro-batch."""
    return ticks.groupBy("sid").transformWithStateInPandas(
        statefulProcessor=WilderProcessor(), outputStructType="sid long, n int, rsi double, atr double", outputMode="Update", timeMode="None")


class WilderInOrder(StatefulProcessor):
    """RSI and ATR over ticks in event-time order, whatever order and batch they come in.

    Ticks wait in a list until the watermark has passed them, so none can come before them any more; a timer at the earliest one
    wakes the security. Then all that are due are taken in order into three averages, and what is left sets the next timer. A security
    without a tick for ``idle_ms`` of event time is forgotten, so the state does not grow with names that are gone.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("wilder", "n int, last double, at long, gain double, loss double, tr double")
        self.waiting = handle.getListState("waiting", "us long, event_id long, px double")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        us = new["ts"].astype("datetime64[us]").astype("int64")
        self.waiting.appendList([(int(a), int(b), float(c)) for a, b, c in zip(us, new["event_id"], new["px"], strict=True)])
        self.handle.registerTimer(int(us.min()) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        ticks = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in ticks if x[0] // 1000 < now]
        left = ticks[len(due) :]
        if due:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000)
        if not due:
            if not left and self.done.exists() and self.done.get()[2] + self.idle_ms <= now:
                self.done.clear()
            return
        state = wilder_step(self.done.get() if self.done.exists() else None, [x[2] for x in due], due[-1][0] // 1000)
        self.done.update(state)
        self.handle.registerTimer(state[2] + self.idle_ms)
        n, _, at, gain, loss, tr = state
        if n >= PERIOD:
            rsi = (100.0 if gain > 0 else 50.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
            yield pd.DataFrame({"sid": [key[0]], "n": [n], "rsi": [rsi], "atr": [tr]})

    def close(self) -> None:
        pass


def wilder_step(state: tuple | None, prices: list[float], at: int) -> tuple:
    """The averages after more prices; during the first changes they hold sums, then each change has the weight of one period."""
    n, last, _, *means = state or (0, None, 0, 0.0, 0.0, 0.0)
    p = np.array(([] if last is None else [last]) + prices, float)
    d = np.diff(p)
    moves = [np.maximum(d, 0.0), np.maximum(-d, 0.0), np.abs(d)]
    first = max(0, min(len(d), PERIOD - n))
    means = [m + x[:first].sum() / PERIOD for m, x in zip(means, moves, strict=True)]
    if len(d) > first:
        means = [float(pd.Series([m, *x[first:]]).ewm(alpha=1 / PERIOD, adjust=False).mean().iloc[-1]) for m, x in zip(means, moves, strict=True)]
    return (int(n + len(d)), float(p[-1]), int(at), *map(float, means))


def wilder_in_order(ticks: DataFrame, late: str = "2 days", idle_days: int = 365) -> DataFrame:
    """RSI and ATR per security of the ticks that the watermark has passed, as it passes them."""
    live = ticks.withWatermark("ts", late).select("sid", "ts", "event_id", "px")
    return live.groupBy("sid").transformWithStateInPandas(
        statefulProcessor=WilderInOrder(idle_days * 86_400_000), outputStructType="sid long, n int, rsi double, atr double", outputMode="Update", timeMode="EventTime")


class LevelsInForce(StatefulProcessor):
    """Alerts of ticks against the stop and target that were in force when they came.

    Ticks and versions of levels wait until the watermark has passed them; then those that are due are taken in event-time order, a
    version before the ticks of its instant, of several of one instant the one with the highest number. What remains is the version in force
    and the alerts already given on its last day: each kind is told once per day.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tick boolean, number long, px double, stop double, target double")
        self.force = handle.getValueState("force", "stop double, target double, day int, told string")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        us = new["ts"].astype("datetime64[us]").astype("int64")
        number = [None if pd.isna(x) else float(x) for x in new["px"]], *([None if pd.isna(x) else float(x) for x in new[c]] for c in ("stop", "target"))
        self.waiting.appendList(list(zip(map(int, us), map(bool, new["tick"]), map(int, new["number"]), *number, strict=True)))
        self.handle.registerTimer(int(us.min()) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        there = sorted(self.waiting.get(), key=lambda x: x[:3]) if self.waiting.exists() else []
        due = [x for x in there if x[0] // 1000 < now]
        if not due:
            return
        left = there[len(due) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000)
        else:
            self.waiting.clear()
        stop, target, day, told = self.force.get() if self.force.exists() else (None, None, None, "")
        found, stop, target = alerts_in_force(due, stop, target)
        kinds = {(day, k) for k in (told or "").split(",") if k}
        fresh = [x for x in dict.fromkeys(found) if x not in kinds]
        if found:
            day = max(d for d, _ in found)
            told = ",".join(sorted(k for d, k in {*kinds, *found} if d == day))
        self.force.update((stop, target, day, told))
        if fresh:
            yield pd.DataFrame({"sid": [key[0]] * len(fresh), "day": [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d, _ in fresh], "kind": [k for _, k in fresh]})

    def close(self) -> None:
        pass


def alerts_in_force(due: list[tuple], stop: float | None, target: float | None) -> tuple[list[tuple[int, str]], float | None, float | None]:
    """Day and kind of each alert of rows in event-time order, and the levels in force after them. A level of zero or less is none."""
    frame = pd.DataFrame([(0, False, 0, None, stop, target), *due], columns=["us", "tick", "number", "px", "stop", "target"])
    version = (~frame["tick"]).cumsum() - 1
    held = frame.loc[~frame["tick"], ["stop", "target"]].astype(float).to_numpy()
    low, high = (np.where(held[version, i] > 0, held[version, i], np.nan) for i in (0, 1))
    px = np.where(frame["tick"], frame["px"].astype(float), np.nan)
    px[~(px > 0)] = np.nan
    hit = px <= low
    with np.errstate(invalid="ignore"):
        kinds = {"stop_hit": hit, "stop_near": ~hit & ((px - low) / px < T.STOP_NEAR), "target_hit": ~hit & (px >= high)}
    day = (frame["us"] // 86_400_000_000).to_numpy()
    found = sorted((int(i), int(day[i]), kind) for kind, at in kinds.items() for i in np.flatnonzero(at))
    last = [None if np.isnan(x) else float(x) for x in held[-1]]
    return [(d, kind) for _, d, kind in found], *last


def level_alerts_in_force(ticks: DataFrame, levels: DataFrame, late: str = "2 days") -> DataFrame:
    """Alerts of a tick stream against a stream of versions of levels: sid, day, kind, each once per name and day.

    ``levels`` has sid, ts, version, stop and target; a version holds from its ts to the next one of its name, and before the first a
    name has no alert. One watermark over both streams decides what is late, so a name whose levels rarely change holds nothing up;
    a version that comes later than that is dropped like a late tick. Days are those of the session's time zone at UTC.
    """
    none = F.lit(None).cast("double")
    a = ticks.select("sid", "ts", F.lit(True).alias("tick"), F.col("event_id").cast("long").alias("number"), F.col("px").cast("double").alias("px"), none.alias("stop"), none.alias("target"))
    b = levels.select("sid", "ts", F.lit(False).alias("tick"), F.col("version").cast("long").alias("number"), none.alias("px"), F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"))
    return a.unionByName(b).withWatermark("ts", late).groupBy("sid").transformWithStateInPandas(
        statefulProcessor=LevelsInForce(), outputStructType="sid long, day date, kind string", outputMode="Append", timeMode="EventTime")


class RevisedBars(StatefulProcessor):
    """Daily bars that are told as they form: provisional with each batch that changes them, final once the watermark has passed their day.

    The state is a row for each open day; the watermark bounds how many there are. A timer at the end of the earliest one closes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"day int, revision int, {_BAR}")

    def handleInputRows(self, key, rows, timerValues):
        new = merged_bars(pd.concat([_parts(x) for x in rows]))
        there = _bars(self.open)
        both = merged_bars(pd.concat([there[new.columns], new])) if len(there) else new
        changed = both["day"].isin(new["day"])
        both["revision"] = both["day"].map(there.set_index("day")["revision"]).fillna(0).astype(int) + changed
        self._keep(both)
        yield _told(key, both[changed], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        there = _bars(self.open)
        over = (there["day"].astype("int64") + 1) * _DAY_MS <= timerValues.getCurrentWatermarkInMs()
        self._keep(there[~over])
        if over.any():
            last = there[over].copy()
            last["revision"] += 1
            yield _told(key, last, True)

    def _keep(self, bars: pd.DataFrame) -> None:
        if len(bars):
            self.open.put([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in bars[_BAR_COLUMNS].itertuples(index=False)])
            self.handle.registerTimer((int(bars["day"].min()) + 1) * _DAY_MS)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


_DAY_MS = 86_400_000
_BAR = "first_us long, first_id long, open double, high double, low double, last_us long, last_id long, close double, volume double, trades long"
_BAR_COLUMNS = ["day", "revision", *(c.split(" ")[0] for c in _BAR.split(", "))]


def _bars(state) -> pd.DataFrame:
    return pd.DataFrame(list(state.get()) if state.exists() else [], columns=_BAR_COLUMNS)


def _parts(ticks: pd.DataFrame) -> pd.DataFrame:
    """Each tick as a bar of its own."""
    us = ticks["ts"].astype("datetime64[us]").astype("int64")
    px = ticks["px"]
    return pd.DataFrame({"day": us // (_DAY_MS * 1000), "first_us": us, "first_id": ticks["event_id"], "open": px, "high": px, "low": px, "last_us": us, "last_id": ticks["event_id"], "close": px, "volume": px, "trades": 1})


def merged_bars(parts: pd.DataFrame) -> pd.DataFrame:
    """Bars of the same day as one, whatever their order."""
    by_first = parts.sort_values(["day", "first_us", "first_id"]).groupby("day")[["first_us", "first_id", "open"]].first()
    by_last = parts.sort_values(["day", "last_us", "last_id"]).groupby("day")[["last_us", "last_id", "close"]].last()
    rest = parts.groupby("day").agg(high=("high", "max"), low=("low", "min"), volume=("volume", "sum"), trades=("trades", "sum"))
    return by_first.join(by_last).join(rest).reset_index()[[c for c in _BAR_COLUMNS if c != "revision"]]


def _told(key: tuple, bars: pd.DataFrame, final: bool) -> pd.DataFrame:
    day = pd.to_datetime(bars["day"].astype("int64"), unit="D").dt.date
    return pd.DataFrame({"sid": key[0], "date": day, **{c: bars[c] for c in ("open", "high", "low", "close", "volume", "trades", "revision")}, "final": final})


def revised_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily bars as they form: a row with the next revision for each batch that changes a day, and one ``final`` row when it closes.

    A tick within the watermark revises its day; one behind it is dropped, so nothing follows a final row.
    """
    live = ticks.withWatermark("ts", late).select("sid", "ts", "event_id", F.col("px").cast("double").alias("px"))
    schema = "sid long, date date, open double, high double, low double, close double, volume double, trades long, revision int, final boolean"
    return live.groupBy("sid").transformWithStateInPandas(statefulProcessor=RevisedBars(), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def run_updates(df: DataFrame, folder: str) -> DataFrame:
    """Runs an updating stream to the end of what is there and returns all its rows; a batch replaces those of an earlier attempt of it."""
    q = (df.writeStream.outputMode("update").option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True)
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(os.path.join(folder, "out", f"batch={e}"))).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(os.path.join(folder, "out"))


def latest_of(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Runs an updating stream to the end of what is there and returns the last row of each key.

    ``df`` must come from ``stateful_session``; the rows of a batch replace those of an earlier attempt of it.
    """
    q = (df.writeStream.outputMode("update").option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True)
         .foreachBatch(lambda b, e: b.withColumn("epoch", F.lit(e).cast("long")).write.mode("overwrite").parquet(os.path.join(folder, "out", f"batch={e}"))).start())
    q.awaitTermination()
    rest = [c for c in df.columns if c != key]
    out = df.sparkSession.read.schema(df.schema.add("epoch", "long")).parquet(os.path.join(folder, "out"))
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("v")).select(key, "v.*")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the state store that such processors need; the caller's settings stay."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own
