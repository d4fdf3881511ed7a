"""Time-series operators over long tables (key, date or session ordinal, value).

A window per security is bounded: a security has at most one row per session, and every caller
aggregates raw prints to bars first. Lags count *sessions*: frames range over the session
ordinal, so a sparse series needs no dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.scalars import sane


def sessions(df: DataFrame, date: str = "date") -> DataFrame:
    """Trading sessions with their 1-based ordinal.

    The global order runs over distinct dates only, at most one row per calendar day.
    """
    return df.select(date).distinct().withColumn("sno", F.row_number().over(Window.orderBy(date)).cast("long"))


def by_row(key: str = "sid", order: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(order)


def returns(value: str, w: Window, log: bool = False, fill: str | None = None) -> Column:
    """Return against the previous row; ``fill='ffill'`` carries the last value over nulls."""
    now, before = F.col(value), F.lag(value).over(w)
    if fill == "ffill":
        now = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ratio = now / F.when(before > 0, before)
    return F.log(ratio) if log else ratio - 1


def at_session(value: str, sno_window: Window, back: int, fill_limit: int = 0) -> Column:
    """Value ``back`` sessions ago; ``fill_limit`` sessions of carry-forward are allowed.

    ``sno_window`` orders by the session ordinal.
    """
    frame = sno_window.rangeBetween(-(back + fill_limit), -back)
    return F.last(value, ignorenulls=True).over(frame)


def ffill(value: str, w: Window, limit: int | None = None) -> Column:
    lo = Window.unboundedPreceding if limit is None else -limit
    return F.last(value, ignorenulls=True).over(w.rowsBetween(lo, 0))


def trailing_return(value: str, sno_window: Window, past: int, skip: int = 0, fill_limit: int = 0) -> Column:
    """P[t-skip] / P[t-past] - 1 in sessions; null when the past price is not positive.

    The study measures with ``past=252``; the live rule counts the current session into its
    window, which is ``past=251``.
    """
    then = at_session(value, sno_window, past, fill_limit)
    return at_session(value, sno_window, skip, fill_limit) / F.when(then > 0, then) - 1


def live_trailing_return(value: str, sno: str, sno_window: Window, window: int, skip: int,
                         fill_limit: int = 0) -> Column:
    """As ``trailing_return`` with the live rule.

    The current session counts into the window, and a window longer than the history is clipped
    to it, which during the first ``window`` sessions means the second session of the panel.
    """
    run = sno_window.rowsBetween(Window.unboundedPreceding, 0)
    second = F.last(F.when(F.col(sno).between(2 - fill_limit, 2), F.col(value)), ignorenulls=True).over(run)
    then = F.when(F.col(sno) > window, at_session(value, sno_window, window - 1, fill_limit)).otherwise(second)
    ret = at_session(value, sno_window, skip, fill_limit) / F.when(then > 0, then) - 1
    return F.when(F.col(sno) >= skip + 2, ret)


def rolling_moments(df: DataFrame, value: str, w: Window, n: int, prefix: str) -> DataFrame:
    """Count, mean and sample deviation over the last ``n`` rows, by prefix sums.

    A sliding frame would be re-evaluated for every row (n updates each); three running sums and
    one lag make the cost independent of the window length. NaN and infinities count as missing, as
    a running sum would never lose them again. Adds ``<prefix>_n/_mean/_std``.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = sane(F.col(value).cast("double"))
    df = (df.withColumn("_c", F.count(v).over(run))
            .withColumn("_s", F.coalesce(F.sum(v).over(run), F.lit(0.0)))
            .withColumn("_q", F.coalesce(F.sum(v * v).over(run), F.lit(0.0))))
    c = F.col("_c") - F.lag("_c", n, 0).over(w)
    s = F.col("_s") - F.lag("_s", n, 0.0).over(w)
    q = F.col("_q") - F.lag("_q", n, 0.0).over(w)
    df = df.withColumn(f"{prefix}_n", c).withColumn("_rs", s).withColumn("_rq", q)
    n_, rs, rq = F.col(f"{prefix}_n"), F.col("_rs"), F.col("_rq")
    var = F.greatest((rq - rs * rs / n_) / (n_ - 1), F.lit(0.0))
    return (df.withColumn(f"{prefix}_mean", F.when(n_ > 0, rs / n_))
              .withColumn(f"{prefix}_std", F.when(n_ > 1, F.sqrt(var)))
              .drop("_c", "_s", "_q", "_rs", "_rq"))


def rolling_vol(df: DataFrame, ret: str, w: Window, n: int, out: str, min_rows: int = 30) -> DataFrame:
    """Annualised deviation of the last ``n`` returns; null below ``min_rows`` returns."""
    df = rolling_moments(df, ret, w, n, "_v")
    return (df.withColumn(out, F.when(F.col("_v_n") >= min_rows, F.col("_v_std") * F.sqrt(F.lit(252.0))))
              .drop("_v_n", "_v_mean", "_v_std"))


def sma(value: str, w: Window, n: int) -> Column:
    """Mean of the last ``n`` rows, null while the series is shorter."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= n, F.avg(value).over(frame))


def chain(ret: Column, w: Window, base: float = 100.0) -> Column:
    """Level of compounded returns; a null return leaves the level unchanged."""
    growth = F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.lit(base) * growth


def drawdown(nav: str, w: Window) -> Column:
    return F.col(nav) / F.max(nav).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
         values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """As-of join: for every left row the nearest right row in time.

    Union of both sides plus one ``last(ignorenulls)`` window per key: a single shuffle on the
    key, no pair expansion. ``strict`` excludes equal times; ``forward`` looks ahead. The right
    side holds at most one row per key and time. Adds ``values`` and ``<right_time>_matched``.
    """
    right_first = strict if forward else not strict
    left_rank, right_rank = (1, 0) if right_first else (0, 1)
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(v) for v in values])
    lcols = left.columns
    a = left.select(*on, F.col(left_time).alias("_time"), F.lit(left_rank).alias("_rank"),
                    F.struct(*lcols).alias("_left"))
    b = right.select(*on, F.col(right_time).alias("_time"), F.lit(right_rank).alias("_rank"),
                     payload.alias("_right"))
    # forward runs the same growing frame from the end; a frame that shrinks would be evaluated anew for each row
    order = [F.desc(c) if forward else F.asc(c) for c in ("_time", "_rank")]
    pick = F.last("_right", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_hit", pick).filter("_left is not null")
    return both.select(*[F.col(f"_left.{c}").alias(c) for c in lcols],
                       *[F.col(f"_hit.{v}").alias(v) for v in values],
                       F.col("_hit._t").alias(f"{right_time}_matched"))


def month_ends(sess: DataFrame) -> DataFrame:
    """Last session of each month with the session before it and the neighbouring month ends."""
    w = Window.orderBy("date")
    prev = sess.withColumn("t_prev", F.lag("date").over(w)).withColumn("prev_sno", F.lag("sno").over(w))
    m = (prev.groupBy(F.trunc("date", "month").alias("month"))
         .agg(F.max(F.struct("date", "sno", "t_prev", "prev_sno")).alias("m")))
    wm = Window.orderBy("month")
    return m.select("month", F.col("m.date").alias("t"), F.col("m.sno").alias("t_sno"),
                    F.col("m.t_prev").alias("t_prev"), F.col("m.prev_sno").alias("prev_sno"),
                    F.lead("m.date").over(wm).alias("t_next"), F.lead("m.sno").over(wm).alias("next_sno"))


def densify(df: DataFrame, key: str, sno: str, values: list[str], limit: int | None = None,
            last_sno: Column | None = None) -> DataFrame:
    """Session grid with carried values: each row is repeated over the sessions up to the next
    row of its key (or ``limit`` sessions). A generate step, never a cross join."""
    w = Window.partitionBy(key).orderBy(sno)
    nxt = F.lead(sno).over(w)
    end = F.coalesce(nxt - 1, last_sno if last_sno is not None else F.col(sno))
    if limit is not None:
        end = F.least(end, F.col(sno) + limit)
    return (df.withColumn("_end", end)
            .select(key, F.col(sno).alias("_own"), *values, F.explode(F.sequence(F.col(sno), "_end")).alias("sno"))
            .withColumn("filled", F.col("sno") > F.col("_own")).drop("_own"))


def valid_at(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, values: list[str], start: str = "start", finish: str = "finish") -> DataFrame:
    """Adds to every row the values of the range of its key that holds its day; nulls where none does.

    A range goes from ``start`` to ``finish``, both included; a null bound is open. Ranges are cut into calendar years, within the years
    that the rows span, and meet the rows by key and year, an equality that Spark can hash and split; only the ranges of that year
    are compared by day. If several ranges of a key hold the day, the one that starts last counts, of those the largest values. Rows
    are looked up once for each key and day, however often they stand there.
    """
    day = F.col(at).cast("date")
    probes = rows.select(*keys, day.alias("_at")).distinct()
    span = probes.agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))  # one row
    r = ranges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).alias("_start"), F.col(finish).alias("_finish"), F.struct(*values).alias("_v")).join(F.broadcast(span))
    first, last = F.year(F.greatest("_start", "_from")), F.year(F.least("_finish", "_to"))  # both skip nulls
    r = r.filter(first <= last).withColumn("_year", F.explode(F.sequence(first, last))).drop("_from", "_to")
    match = F.year("_at") == F.col("_year")
    for i, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"_k{i}"))
    held = F.coalesce(F.col("_at") >= F.col("_start"), F.lit(True)) & F.coalesce(F.col("_at") <= F.col("_finish"), F.lit(True))
    best = F.max(F.struct("_start", "_v")).alias("_b")
    found = probes.join(r, match).filter(held).groupBy(*keys, "_at").agg(best).select(*keys, "_at", *[F.col(f"_b._v.{v}").alias(v) for v in values])
    return rows.withColumn("_at", day).join(found, [*keys, "_at"], "left").drop("_at")


def until_next(rows: DataFrame, keys: list[str], start: str, finish: str = "finish") -> DataFrame:
    """Ranges from dated states: each one lasts until the day before its key's next, the last one is open."""
    w = Window.partitionBy(*keys).orderBy(start)
    return rows.withColumn(finish, F.date_sub(F.lead(start).over(w), 1))
