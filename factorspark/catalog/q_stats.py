"""Statistics queries on monthly series and panel information coefficients."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.catalog import q_panel as QP
from factorspark.catalog.q_scalars import sql_cdf, sql_ppf
from factorspark.catalog.registry import query
from factorspark.functions.normal import student_t_p, two_sided_p
from factorspark.operators import regimes as R
from factorspark.operators import stats as S
from factorspark.operators import timeseries as ts
from factorspark.plans import panel as N
from factorspark.plans import study as Y
from factorspark.session import cut_lineage

MS_SQL = "WITH ms AS (SELECT sid, date_trunc('month', date) AS t, tanh(arg_max(close, date) / arg_min(open, date) - 1) / 5 AS r FROM bars GROUP BY ALL)"


def series(t):
    return t.bars.groupBy("sid", F.trunc("date", "month").alias("t")).agg(
        (F.tanh(F.max_by("close", "date") / F.min_by("open", "date") - 1) / 5).alias("r"))


def sql_nw(src, keys, x, order, lag, name="nw"):
    prods = ", ".join(f"sum(d * l{k}) AS g{k}" for k in range(1, lag + 1))
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY {keys} ORDER BY {order}) AS l{k}" for k in range(1, lag + 1))
    var = " + ".join(["g0"] + [f"2 * {1 - k / (lag + 1)!r} * coalesce(g{k}, 0)" for k in range(1, lag + 1)])
    return f"""
{name}_d AS (SELECT *, {x} - avg({x}) OVER (PARTITION BY {keys}) AS d FROM {src} WHERE {x} IS NOT NULL),
{name}_l AS (SELECT *, {lags} FROM {name}_d),
{name}_g AS (SELECT {keys}, count(*) AS n, avg({x}) AS mean, sum(d * d) AS g0, {prods} FROM {name}_l GROUP BY ALL),
{name} AS (SELECT {keys}, n, mean, CASE WHEN n >= 3 AND {var} > 1e-300 THEN mean / sqrt(({var}) / n / n) END AS t_nw FROM {name}_g)"""


def sql_student_p(t, df, terms=4000):
    """Two-sided Student-t p-value as the power series of the incomplete beta function at t^2 / (df + t^2), for any real df."""
    y = f"greatest(({t}) * ({t}) / (({df}) + ({t}) * ({t})), 1e-300)"
    a = f"(({df}) / 2.0)"
    series = (f"list_sum(list_transform(range(0, {terms}), lambda term_: exp(lgamma({a} + 0.5 + term_) - lgamma({a} + 0.5) - lgamma(1.5 + term_) + lgamma(1.5) + term_ * ln({y}))))")
    return f"(1 - exp(lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5) + 0.5 * ln({y}) + {a} * ln(1 - {y})) * 2 * {series})"


@query("agg_newey_west_t", "sid:i n:i mean:6 t_nw:5", MS_SQL + "," + sql_nw("ms", "sid", "r", "t", 3) + " SELECT * FROM nw")
def _(t):
    return S.newey_west(series(t), ["sid"], "r", "t", 3)


MOM_SQL = MS_SQL + """,
dm AS (SELECT *, r - avg(r) OVER (PARTITION BY sid) AS d FROM ms),
mo AS (SELECT sid, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM dm GROUP BY sid),
sh AS (SELECT *, mean / std AS sr, m3 / pow(std, 3) AS sk, m4 / pow(std, 4) AS ku FROM mo)
"""


def shaped(t):
    skew, kurt = S.study_shape()
    m = S.series_moments(series(t), ["sid"], "r")
    return m.withColumn("sr", F.col("mean") / F.col("std")).withColumn("sk", skew).withColumn("ku", kurt)


@query("agg_sharpe", "sid:i sharpe:6", MOM_SQL + "SELECT sid, CASE WHEN n >= 6 AND std > 0 THEN sr * sqrt(12) END AS sharpe FROM sh")
def _(t):
    return shaped(t).withColumn("sharpe", S.sharpe(F.col("mean"), F.col("std"), F.col("n")))


PSR = "(sr - {b}) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12))"
EMS = f"(sqrt(v) * ({1 - S.EULER_GAMMA!r} * {sql_ppf(f'CAST({1 - 1 / 82!r} AS DOUBLE)')} + {S.EULER_GAMMA!r} * {sql_ppf(f'CAST({1 - 1 / (82 * 2.718281828459045)!r} AS DOUBLE)')}))"


@query("agg_psr", "sid:i psr:6", MOM_SQL + f"SELECT sid, {sql_cdf('z')} AS psr FROM (SELECT sid, {PSR.format(b=0)} AS z FROM sh)")
def _(t):
    return shaped(t).withColumn("psr", S.probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("sk"), F.col("ku")))


@query("agg_expected_max_sharpe", "sid:i sr0:7", MOM_SQL + f"SELECT sid, {EMS} AS sr0 FROM (SELECT sid, std * std AS v FROM sh)")
def _(t):
    return shaped(t).withColumn("sr0", S.expected_max_sharpe(82, F.col("std") * F.col("std")))


@query("agg_dsr", "sid:i dsr:6", MOM_SQL + f", v AS (SELECT var_pop(sr) AS v FROM sh) SELECT sid, {sql_cdf('z')} AS dsr FROM (SELECT sid, {PSR.format(b=EMS)} AS z FROM sh, v)")
def _(t):
    df = shaped(t)
    var = df.agg(F.var_pop("sr").alias("v"))
    return df.join(F.broadcast(var)).withColumn("dsr", S.probabilistic_sharpe(
        F.col("sr"), F.col("n"), F.col("sk"), F.col("ku"), S.expected_max_sharpe(82, F.col("v"))))


@query("unbiased_shape", "sid:i skew:6 kurt:6", MS_SQL + "SELECT sid, skewness(r) AS skew, kurtosis(r) + 3 AS kurt FROM ms GROUP BY sid")
def _(t):
    skew, kurt = S.unbiased_shape()
    return S.series_moments(series(t), ["sid"], "r").withColumn("skew", skew).withColumn("kurt", kurt)


P_SQL = MS_SQL + "," + sql_nw("ms", "sid", "r", "t", 3) + f""",
pv AS (SELECT sid, sid % 5 AS fam, 2 * (1 - {sql_cdf('abs(t_nw)')}) AS p FROM nw WHERE t_nw IS NOT NULL)
"""


def pvalues(t):
    nw = S.newey_west(series(t), ["sid"], "r", "t", 3).filter("t_nw is not null")
    return nw.select("sid", (F.col("sid") % 5).alias("fam"), two_sided_p(F.col("t_nw")).alias("p"), "n", "t_nw")


@query("agg_p_value", "sid:i p:7", P_SQL + "SELECT sid, p FROM pv")
def _(t):
    return pvalues(t)


@query("agg_p_value_student", "sid:i p:6", P_SQL + f"SELECT sid, {sql_student_p('t_nw', 'n - 1')} AS p FROM nw WHERE t_nw IS NOT NULL")
def _(t):
    return pvalues(t).select("sid", student_t_p("t_nw", (F.col("n") - 1).cast("double")).alias("p"))


@query("agg_benjamini_hochberg", "sid:i fam:i p:7 q_value:6 reject:b", P_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, sid) AS i, count(*) OVER (PARTITION BY fam) AS m FROM pv)
SELECT *, least(1, min(p * m / i) OVER (PARTITION BY fam ORDER BY p DESC, sid DESC)) AS q_value, least(1, min(p * m / i) OVER (PARTITION BY fam ORDER BY p DESC, sid DESC)) <= 0.05 AS reject FROM rk""")
def _(t):
    return S.benjamini_hochberg(pvalues(t), ["fam"], "p", "sid")


DIRECTED = " UNION ALL ".join(f"SELECT t, sid, sector, fwd, is_fin, '{f}' AS factor, CASE WHEN {f} IS NOT NULL THEN {QP._sql_value(f)} END * {d} AS x0 FROM panel" for f, d in N.FACTORS.items())
SIG_SQL = QP.PANEL_SQL + f""",
s0 AS ({DIRECTED}),
s1 AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN (rank() OVER (PARTITION BY t, factor, x0 IS NULL ORDER BY x0) + (count(*) OVER (PARTITION BY t, factor, x0) - 1) / 2) / count(x0) OVER (PARTITION BY t, factor) END AS p FROM s0),
s2 AS (SELECT *, p - avg(p) OVER (PARTITION BY t, factor, sector) AS sn FROM s1),
sig AS (SELECT t, sid, factor, fwd, is_fin, false AS neutral, x0 AS x FROM s2 UNION ALL SELECT t, sid, factor, fwd, is_fin, true, round(sn, 10) FROM s2)
"""


def sql_ic(src, keys, fwd="fwd", min_n=20, name="ics"):
    return f"""
{name}_b AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2 AS ra, rank() OVER (PARTITION BY {keys} ORDER BY {fwd}) + (count(*) OVER (PARTITION BY {keys}, {fwd}) - 1) / 2 AS rb
  FROM {src} WHERE x IS NOT NULL AND {fwd} IS NOT NULL),
{name} AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {min_n} AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 12) END AS ic FROM {name}_b GROUP BY ALL)"""


def signals(t, panel=None):
    return Y.signals(panel if panel is not None else QP.panel(t), ["fwd", "is_fin"]).withColumn("x", F.when(F.col("neutral"), F.round("x", 10)).otherwise(F.col("x")))


IC_SQL = SIG_SQL + "," + sql_ic("sig", "factor, neutral, t")


@query("join_cross_variants", "factor:s neutral:b t:t sid:i x:10", SIG_SQL + "SELECT * REPLACE (CASE WHEN neutral THEN x ELSE round(x, 5) END AS x) FROM sig")
def _(t):
    return signals(t).withColumn("x", F.when(F.col("neutral"), F.col("x")).otherwise(F.round("x", 5)))


@query("agg_rank_ic", "factor:s neutral:b t:t n:i ic:6", IC_SQL + " SELECT * FROM ics")
def _(t):
    return Y.ic_series(signals(t))


TRAIN = "1998-12-31"


def train_end():
    return F.lit(TRAIN).cast("date")


STUDY_SQL = IC_SQL + f""",
hf AS (SELECT *, CASE WHEN t <= DATE '{TRAIN}' THEN 'train' ELSE 'test' END AS half FROM ics),""" + sql_nw("hf", "factor, neutral, half", "ic", "t", 3) + f""",
pq AS (SELECT *, 2 * (1 - {sql_cdf('abs(t_nw)')}) AS p FROM nw WHERE t_nw IS NOT NULL),
pr_ AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY p, factor || '|' || neutral) AS i, count(*) OVER (PARTITION BY half) AS m FROM pq)
SELECT *, least(1, min(p * m / i) OVER (PARTITION BY half ORDER BY p DESC, factor || '|' || neutral DESC)) <= 0.05 AS reject FROM pr_"""


@query("factor_study", "factor:s neutral:b half:s n:i mean:5 t_nw:4 p:5 reject:b", STUDY_SQL)
def _(t):
    return Y.ic_table(Y.ic_series(signals(t)), ["factor", "neutral"], train_end())


HORIZON_SQL = QP.PANEL_SQL + f""",
fh AS (SELECT sid, date AS t, sno, {", ".join(f"CASE WHEN sno + {h} <= (SELECT max(sno) FROM sessions) THEN last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN CURRENT ROW AND {h} FOLLOWING) / close - 1 END AS f{h}" for h in (5, 20, 60))} FROM sbars),
hl AS (SELECT p.t, p.sid, p.factor, p.x0 AS x, h.days, CASE h.days WHEN 5 THEN f5 WHEN 20 THEN f20 ELSE f60 END AS f FROM ({DIRECTED}) p JOIN fh USING (t, sid), (VALUES (5), (20), (60)) h(days)),""" + sql_ic("hl", "factor, days, t", "f", 8, "hic")


def horizon_ics(t):
    """IC of every factor against the 5, 20 and 60 session return from the month end."""
    last = t.sessions.agg(F.max("sno").alias("last_sno"))
    p = QP.panel(t)
    # a horizon looks along one security, so only those of the panel are sorted
    fh = t.sbars.join(p.select("sid").distinct(), "sid", "left_semi").join(F.broadcast(last)).select("sid", F.col("date").alias("t"), *[R.forward_h("close", h).alias(f"f{h}") for h in (5, 20, 60)])
    rows = N.factor_rows(p, N.FACTORS, []).withColumn("x", F.col("x") * F.col("dir")).join(fh, ["t", "sid"])
    hs = F.explode(F.array(*[F.struct(F.lit(h).alias("days"), F.col(f"f{h}").alias("f")) for h in (5, 20, 60)]))
    long = rows.select("t", "sid", "factor", "x", hs.alias("h")).select("t", "sid", "factor", "x", "h.*")
    return S.rank_ic(long, ["factor", "days", "t"], "x", "f", 8).withColumnsRenamed({"t": "date", "n": "n_tickers"})


@query("factor_ic", "factor:s days:i date:t ic:6 n_tickers:i", HORIZON_SQL + " SELECT factor, days, t AS date, ic, n AS n_tickers FROM hic")
def _(t):
    return horizon_ics(t)


@query("agg_ic_summary", "factor:s days:i mean_ic:6 ir:5 hit_rate:6 n_obs:i lag:i mean_n:4", HORIZON_SQL + """
SELECT factor, days, avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) AS ir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS hit_rate, count(*) AS n_obs, ceil(days / 5) - 1 AS lag, avg(n) AS mean_n FROM hic WHERE ic IS NOT NULL GROUP BY factor, days""")
def _(t):
    return S.ic_summary(horizon_ics(t), ["factor", "days"], "days")


LAGS = {5: 0, 20: 3, 60: 11}


@query("ic_tests", "factor:s days:i n_eff:4 t_nw:4 p_value:5 q_value:5 reject:b", HORIZON_SQL + "," + ",".join(
    f"h{d} AS (SELECT * FROM hic WHERE days = {d})," + sql_nw(f"h{d}", "factor, days", "ic", "t", lag, f"nw{d}") for d, lag in LAGS.items()) + f""",
al AS ({" UNION ALL ".join(f"SELECT factor, days, n / {lag + 1} AS n_eff, t_nw FROM nw{d}" for d, lag in LAGS.items())}),
pt AS (SELECT *, {sql_student_p('t_nw', 'greatest(n_eff - 1, 1)')} AS p_value FROM al WHERE n_eff >= 3 AND t_nw IS NOT NULL),
rk AS (SELECT *, factor || '|' || days AS tie, row_number() OVER (ORDER BY p_value, factor || '|' || days) AS i, count(*) OVER () AS m FROM pt),
qv AS (SELECT *, least(1, min(p_value * m / i) OVER (ORDER BY p_value DESC, tie DESC)) AS q_value FROM rk)
SELECT *, q_value <= 0.05 AS reject FROM qv""")
def _(t):
    s = S.ic_summary(horizon_ics(t), ["factor", "days"], "days", min_eff=3)
    return S.benjamini_hochberg(s.withColumn("k", F.lit(1)).withColumn("tie", F.concat_ws("|", "factor", "days")), ["k"], "p_value", "tie")


@query("agg_ic_decay", "factor:s n_points:i half_life:4 ic_zero:5", HORIZON_SQL + """,
sm AS (SELECT factor, days, avg(ic) AS m FROM hic WHERE ic IS NOT NULL GROUP BY ALL),
rg AS (SELECT factor, count(CASE WHEN m > 0 THEN 1 END) AS n_points, regr_slope(ln(CASE WHEN m > 0 THEN m END), days) AS s, regr_intercept(ln(CASE WHEN m > 0 THEN m END), days) AS i FROM sm GROUP BY factor)
SELECT factor, n_points, CASE WHEN n_points >= 2 AND s < 0 THEN ln(2) / -s END AS half_life, CASE WHEN n_points >= 2 AND s < 0 THEN exp(i) END AS ic_zero FROM rg""")
def _(t):
    m = horizon_ics(t).filter("ic is not null").groupBy("factor", "days").agg(F.avg("ic").alias("mean_ic"))
    return S.ic_decay(m, ["factor"], "days")


@query("agg_power_weeks", "sd:6 weeks:i", HORIZON_SQL + """,
sd AS (SELECT factor, stddev_samp(ic) AS s FROM hic WHERE ic IS NOT NULL AND days = 5 GROUP BY factor HAVING count(*) > 2)
SELECT median(s) AS sd, ceil(pow((1.959963984540054 + 0.8416212335729143) * median(s) / 0.05, 2)) AS weeks FROM sd""")
def _(t):
    return S.power_weeks(horizon_ics(t).filter("days = 5"), "factor")


BENCH_SQL = """
bn AS (SELECT t, lead(l) OVER (ORDER BY t) / l - 1 AS cdi, lead(c) OVER (ORDER BY t) / c - 1 AS index_ret FROM (
  SELECT date AS t, product(1 + cdi) OVER (ORDER BY sno) AS l, i.close AS c FROM cdi JOIN index_close i USING (date, sno)) WHERE t IN (SELECT max(date) FROM sessions GROUP BY date_trunc('month', date)))"""


def bench(t):
    """Rate and index return from each month end to the next."""
    w = Window.partitionBy(F.lit(1)).orderBy("sno")
    lv = t.cdi.withColumn("l", F.product(1 + F.col("cdi")).over(w)).join(t.index_close.select("date", "close"), "date")
    ends = ts.month_ends(t.sessions).select(F.col("t").alias("date")).join(lv, "date")
    wm = Window.partitionBy(F.lit(1)).orderBy("date")
    return ends.select(F.col("date").alias("t"), (F.lead("l").over(wm) / F.col("l") - 1).alias("cdi"), (F.lead("close").over(wm) / F.col("close") - 1).alias("index_ret"))


GRID_SQL = QP.PILLAR_SQL + """,
gr AS (SELECT a * 5 + b AS k, a / 4 AS wf, b / 4 AS wm, (4 - a - b) / 4 AS wq FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4),
gn AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS g FROM gr),
gs AS (SELECT g, t, sid, fwd, round((wf * coalesce(fund_z, 0) + wm * coalesce(mom_z, 0) + wq * coalesce(qual_z, 0)) / nullif(CASE WHEN fund_z IS NOT NULL THEN wf ELSE 0 END + CASE WHEN mom_z IS NOT NULL THEN wm ELSE 0 END + CASE WHEN qual_z IS NOT NULL THEN wq ELSE 0 END, 0), 8) AS score FROM pil, gn),""" + QP.sql_portfolio("""SELECT g, 'Q' || b AS leg, t, sid, 1 / count(*) OVER (PARTITION BY g, t, b) AS w, fwd FROM (
  SELECT *, CAST(greatest(1, ceil(5 * (row_number() OVER (PARTITION BY g, t ORDER BY score, sid) - 1) / (count(*) OVER (PARTITION BY g, t) - 1))) AS INT) AS b, count(*) OVER (PARTITION BY g, t) AS n FROM gs WHERE score IS NOT NULL)
  WHERE n >= 15 AND b = 5""", "g, leg") + "," + BENCH_SQL + f""",
gsh AS (SELECT g, CASE WHEN count(net - cdi) >= 6 THEN avg(net - cdi) / stddev_samp(net - cdi) * sqrt(12) END AS sharpe FROM pf JOIN bn USING (t) WHERE t <= DATE '{TRAIN}' GROUP BY g)
"""


def grid_returns(t):
    sc = Y.grid_scores(QP.pillars(t)).withColumn("score", F.round("score", 8))
    legs = N.quintile_legs(sc, QP.panel(t), ["g"]).filter("leg = 'Q5'")
    from factorspark.operators import portfolio as W
    return W.rebalanced_returns(legs, N.costs(QP.panel(t)), ["g", "leg"])


@query("study_grid", "g:i sharpe:4", GRID_SQL + "SELECT * FROM gsh")
def _(t):
    return Y.train_sharpe(grid_returns(t), bench(t), ["g"], train_end())


@query("best_of_grid", "g:i sharpe:4", GRID_SQL + "SELECT arg_max(g, sharpe) AS g, max(sharpe) AS sharpe FROM gsh")
def _(t):
    s = Y.train_sharpe(grid_returns(t), bench(t), ["g"], train_end())
    return s.agg(F.max_by("g", "sharpe").alias("g"), F.max("sharpe").alias("sharpe"))


SUM_SQL = QP.QUINT_SQL + "," + BENCH_SQL + f""",
ps AS (SELECT * FROM (VALUES ('train', DATE '1995-01-01', DATE '{TRAIN}'), ('test', DATE '1999-01-01', DATE '2002-01-01')) v(period, s, e)),
r_ AS (SELECT leg, period, t, net / 50 AS r, net / 50 - cdi AS e, net / 50 - index_ret AS ei FROM pf JOIN bn USING (t) JOIN ps ON t BETWEEN ps.s AND ps.e WHERE cdi IS NOT NULL),
nv AS (SELECT *, product(1 + r) OVER (PARTITION BY leg, period ORDER BY t) AS nav FROM r_),
dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY leg, period ORDER BY t) - 1 AS dd FROM nv),
gg AS (SELECT leg, period, arg_max(nav, t) AS nav, count(*) AS n, stddev_samp(r) AS sd, min(dd) AS maxdd, avg(ei) AS ei FROM dd GROUP BY ALL),
de AS (SELECT *, e - avg(e) OVER (PARTITION BY leg, period) AS d FROM r_),
me_ AS (SELECT leg, period, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM de GROUP BY ALL),
ms_ AS (SELECT *, mean / std AS sr, m3 / pow(std, 3) AS sk, m4 / pow(std, 4) AS ku, var_pop(mean / std) OVER (PARTITION BY period) AS v FROM me_),
mz AS (SELECT *, {PSR.format(b=0)} AS z1, {PSR.format(b=EMS)} AS z2 FROM ms_),""" + sql_nw("r_", "leg, period", "ei", "t", 3, "nt") + f"""
SELECT leg, period, pow(gg.nav, 12 / gg.n) - 1 AS ann, sd * sqrt(12) AS vol, sr * sqrt(12) AS sharpe, ei * 12 AS excess_ann, t_nw AS t_index, maxdd, {sql_cdf('z1')} AS psr, {sql_cdf('z2')} AS dsr, gg.n AS n
FROM gg JOIN mz USING (leg, period) JOIN nt USING (leg, period)"""


@query("study_summary", "leg:s period:s ann:5 vol:5 sharpe:4 excess_ann:4 t_index:4 maxdd:5 psr:5 dsr:5 n:i", SUM_SQL)
def _(t):
    rets = QP.quintile_portfolio(t).withColumn("net", F.col("net") / 50)
    periods = t.spark.createDataFrame([("train", "1995-01-01", TRAIN), ("test", "1999-01-01", "2002-01-01")], "period string, start string, end string")
    periods = periods.select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return Y.summary(rets, bench(t).filter("cdi is not null"), ["leg"], periods)


@query("robustness_slices", "slice:s factor:s mean:5 t_nw:4", SIG_SQL + "," + """
sl AS (SELECT 'all' AS slice, * FROM sig WHERE NOT neutral UNION ALL SELECT 'ex_financials', * FROM sig WHERE NOT neutral AND NOT is_fin UNION ALL SELECT 'ex_named', * FROM sig WHERE NOT neutral AND sid % 9 <> 0),""" + sql_ic("sl", "slice, factor, t", "fwd", 10, "sic") + "," + sql_nw("sic", "slice, factor", "ic", "t", 3) + " SELECT * FROM nw")
def _(t):
    p = Y.robustness(QP.panel(t), {"all": F.lit(True), "ex_financials": ~F.col("is_fin"), "ex_named": F.col("sid") % 9 != 0})
    rows = N.factor_rows(p, N.FACTORS, ["slice", "fwd"]).withColumn("x", F.col("x") * F.col("dir"))
    ics = S.rank_ic(rows, ["slice", "factor", "t"], "x", "fwd", 10)
    return S.newey_west(ics, ["slice", "factor"], "ic", "t", 3)


@query("bootstrap_sharpe_diff", "sid:i lo:6 hi:6 reps:i", MS_SQL + """,
mk AS (SELECT t, avg(r) AS m FROM ms GROUP BY t),
rw AS (SELECT sid, r, m, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS i FROM ms JOIN mk USING (t) WHERE r IS NOT NULL AND m IS NOT NULL),
sz AS (SELECT sid, count(*) AS n FROM rw GROUP BY sid),
bl AS (SELECT sid, n, rep, blk FROM sz, unnest(generate_series(1, 2000)) AS a(rep), unnest(generate_series(0, n // 6)) AS b(blk)),
st AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '0', sid, rep, blk)), 1, 15) AS BIGINT) % n AS start FROM bl),
dr AS (SELECT sid, rep, (start + k) % n AS i FROM st, unnest(generate_series(0, 5)) AS c(k) WHERE blk * 6 + k < n),
df AS (SELECT sid, rep, (avg(r) / CASE WHEN stddev_samp(r) > 0 THEN stddev_samp(r) END - avg(m) / CASE WHEN stddev_samp(m) > 0 THEN stddev_samp(m) END) * sqrt(12) AS diff FROM dr JOIN rw USING (sid, i) GROUP BY sid, rep)
SELECT sid, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, count(*) AS reps FROM df GROUP BY sid""")
def _(t):
    own = cut_lineage(series(t))  # read for the market and for each security
    market = own.groupBy("t").agg(F.avg("r").alias("m"))
    return S.block_bootstrap_sharpe_diff(own.join(market, "t"), ["sid"], "r", "m", "t")
