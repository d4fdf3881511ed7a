"""Risk model queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import risk as K
from factorspark.operators import timeseries as ts
from factorspark.operators import portfolio as W
from factorspark.session import cut_lineage


def weekly(t):
    """Weekly log returns of all securities, so that common dates are dense, and the market's."""
    b = t.bars.groupBy("sid", F.date_add(F.trunc("date", "week"), 6).alias("date")).agg(F.max_by("close", "date").alias("close"))
    r = b.select("sid", "date", ts.returns("close", ts.by_row(), log=True).alias("r")).filter("r is not null")
    ix = t.index_close.groupBy(F.date_add(F.trunc("date", "week"), 6).alias("date")).agg(F.max_by("close", "date").alias("close")).withColumn("sid", F.lit(0))
    m = ix.select("date", ts.returns("close", ts.by_row(), log=True).alias("m")).filter("m is not null")
    return r, m


def six_month_alpha(t):
    """Half a year's return up to a month ago, less the index's, at the last session of each security."""
    w, wi = Window.partitionBy("sid").orderBy("sno"), Window.partitionBy(F.lit(1)).orderBy("sno")
    index = t.index_close.select("sno", ts.trailing_return("close", wi, 125, 21).alias("index_ret"))
    stock = t.sbars.select("sid", "sno", ts.trailing_return("close", w, 125, 21, 20).alias("ret")).groupBy("sid").agg(F.max_by(F.struct("ret"), "sno").alias("_r"), F.max("sno").alias("sno"))
    # rounded, so that the last bits of a quotient don't decide a rank
    return stock.join(index, "sno").select("sid", F.round(F.col("_r.ret") - F.col("index_ret"), 9).alias("alpha_6m"))


def chars(t):
    t.keep_bars("close")
    c = t.fundamentals.select("sid", "sector", "market_cap", F.when(F.col("pl") > 0, 1 / F.col("pl")).alias("earnings_yield"))
    return cut_lineage(c.join(six_month_alpha(t), "sid", "left"))  # read by every leg and by the sectors


#: Factors over the five sectors of the tables, in the order of projection; the first sector is the baseline.
FACTORS = ("MKT", "SMB", "HML", "UMD", "SEC_AMERICA", "SEC_ASIA", "SEC_EUROPE", "SEC_MIDDLE EAST")
_K = len(FACTORS)

WEEK_SQL = """
WITH wk AS (SELECT sid, date_trunc('week', date) AS w, arg_max(close, date) AS close FROM bars GROUP BY ALL),
r0 AS (SELECT sid, CAST(w + INTERVAL 6 DAY AS DATE) AS date, ln(close / lag(close) OVER (PARTITION BY sid ORDER BY w)) AS r FROM wk),
iw AS (SELECT CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS date, arg_max(close, date) AS c FROM index_close GROUP BY 1),
mk0 AS (SELECT * FROM (SELECT date, ln(c / lag(c) OVER (ORDER BY date)) AS f FROM iw) WHERE f IS NOT NULL),
cd0 AS (SELECT date FROM (SELECT DISTINCT date FROM r0 WHERE r IS NOT NULL ORDER BY date DESC LIMIT 252) JOIN (SELECT date FROM mk0 ORDER BY date DESC LIMIT 252) USING (date)),
cd AS (SELECT date FROM cd0 WHERE (SELECT count(*) FROM cd0) >= 30),
rt AS (SELECT * FROM r0 JOIN cd USING (date) WHERE r IS NOT NULL), mk AS (SELECT date, 'MKT' AS factor, f FROM mk0 JOIN cd USING (date)),
"""


def returns(t):
    t.keep_bars("close")
    r, m = weekly(t)
    r, m = K.lookback(cut_lineage(r), m)  # read for the last dates and for the rows of these
    return cut_lineage(K.winsorized_returns(r)), m  # read by every leg and sector


def model(t):
    r, m = returns(t)
    f = cut_lineage(K.orthogonalize(K.factor_returns(r, m, chars(t))))
    return f, K.exposures(r, f)


FACTOR_SQL = WEEK_SQL + """
sd AS (SELECT sid, stddev_samp(r) * 3 AS b FROM rt GROUP BY sid), rw AS (SELECT rt.sid, date, greatest(-b, least(b, r)) AS r FROM rt JOIN sd USING (sid) WHERE b IS NOT NULL),
ag AS (SELECT sid, sno, last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 41 PRECEDING AND 21 PRECEDING) AS p21,
  last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 145 PRECEDING AND 125 PRECEDING) AS p125 FROM sbars),
ai AS (SELECT sno, lag(close, 21) OVER (ORDER BY sno) / lag(close, 125) OVER (ORDER BY sno) - 1 AS ir FROM index_close),
al6 AS (SELECT sid, round(p21 / p125 - 1 - ir, 9) AS al FROM (SELECT * FROM ag QUALIFY row_number() OVER (PARTITION BY sid ORDER BY sno DESC) = 1) JOIN ai USING (sno)),
ch AS (SELECT sid, sector, market_cap, CASE WHEN pl > 0 THEN 1 / pl END AS ey, al FROM fundamentals LEFT JOIN al6 USING (sid)),
lg AS (SELECT sid, 'SMB' AS factor, CASE WHEN row_number() OVER (ORDER BY market_cap, sid) <= count(*) OVER () // 3 THEN 1 WHEN row_number() OVER (ORDER BY market_cap, sid) > count(*) OVER () - count(*) OVER () // 3 THEN -1 END AS leg FROM ch
  UNION ALL SELECT sid, 'HML', CASE WHEN row_number() OVER (ORDER BY ey, sid) <= count(*) OVER () // 3 THEN -1 WHEN row_number() OVER (ORDER BY ey, sid) > count(*) OVER () - count(*) OVER () // 3 THEN 1 END FROM ch WHERE ey IS NOT NULL
  UNION ALL SELECT sid, 'UMD', CASE WHEN row_number() OVER (ORDER BY al, sid) <= count(*) OVER () // 3 THEN -1 WHEN row_number() OVER (ORDER BY al, sid) > count(*) OVER () - count(*) OVER () // 3 THEN 1 END FROM ch WHERE al IS NOT NULL),
st AS (SELECT date, factor, avg(r) FILTER (leg = 1) - avg(r) FILTER (leg = -1) AS f FROM rw JOIN lg USING (sid) GROUP BY ALL),
sc AS (SELECT sector FROM ch GROUP BY sector HAVING count(*) >= 2), un AS (SELECT date, avg(r) AS u FROM rw GROUP BY date),
se AS (SELECT date, 'SEC_' || sector AS factor, avg(r) - max(u) AS f FROM rw JOIN ch USING (sid) JOIN sc USING (sector) JOIN un USING (date) WHERE sector <> (SELECT min(sector) FROM sc) GROUP BY ALL),
fr AS (SELECT * FROM mk UNION ALL SELECT * FROM st WHERE f IS NOT NULL UNION ALL SELECT * FROM se)
"""


def _projections() -> str:
    """Each factor in turn is projected out of those behind it, then the model's means, covariances and one sweep for each factor."""
    cols = range(_K)
    wide = ", ".join(f"max(f) FILTER (factor = '{x}') AS f{i}" for i, x in enumerate(FACTORS))
    ctes = [f"w0 AS MATERIALIZED (SELECT date, {wide} FROM fr GROUP BY date HAVING count(*) = (SELECT count(DISTINCT factor) FROM fr))",
            "g0 AS MATERIALIZED (SELECT date, f0 AS raw0, " + ", ".join(f"f{i} - avg(f{i}) OVER () AS f{i}" for i in cols) + " FROM w0)"]
    for k in range(_K - 1):
        step = ", ".join(f"f{j} - f{k} * sum(f{j} * f{k}) OVER () / sum(f{k} * f{k}) OVER () AS f{j}" if j > k else f"f{j}" for j in cols)
        ctes.append(f"g{k + 1} AS MATERIALIZED (SELECT date, raw0, {step} FROM g{k})")
    ctes.append(f"og AS MATERIALIZED (SELECT date, raw0 AS f0, {', '.join(f'f{i}' for i in cols if i)} FROM g{_K - 1})")
    ctes.append(f"ry AS MATERIALIZED (SELECT sid, r AS f{_K}, og.* FROM rw JOIN og USING (date))")
    cells = [(i, j) for i in range(_K + 1) for j in range(i, _K + 1)]
    ctes.append("s0 AS MATERIALIZED (SELECT sid, " + ", ".join(f"covar_samp(f{i}, f{j}) AS c{i}_{j}" for i, j in cells)
                + f", c{_K}_{_K} AS total, " + ", ".join(f"avg(f{i}) AS m{i}" for i in range(_K + 1)) + " FROM ry GROUP BY sid HAVING count(*) >= 20)")
    # after step k the rows and columns up to k are solved: c{k}_{y} of the swept ones are the coefficients
    for k in cols:
        def cell(i, j):
            a, b = f"c{min(i, k)}_{max(i, k)}", f"c{min(j, k)}_{max(j, k)}"
            if i == j == k:
                return f"-1 / c{k}_{k}"
            if k in (i, j):
                other = i if j == k else j
                return f"c{min(other, k)}_{max(other, k)} / c{k}_{k}"
            return f"c{i}_{j} - {a} * {b} / c{k}_{k}"
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT sid, total, {', '.join(f'm{i}' for i in range(_K + 1))}, " + ", ".join(f"{cell(i, j)} AS c{i}_{j}" for i, j in cells) + f" FROM s{k})")
    names = ", ".join(f"'{x}'" for x in ("alpha", *FACTORS))
    alpha = f"m{_K} - " + " - ".join(f"c{i}_{_K} * m{i}" for i in cols)
    ctes.append(f"ex AS MATERIALIZED (SELECT sid, unnest([{names}]) AS factor, unnest([{alpha}, {', '.join(f'c{i}_{_K}' for i in cols)}]) AS beta, "
                f"sqrt(greatest(c{_K}_{_K}, 0) * 252) AS specific, greatest(0, 1 - c{_K}_{_K} / total) AS r2 FROM s{_K})")
    ctes.append(f"ol AS (SELECT date, unnest([{names[len(chr(39) + 'alpha' + chr(39) + ', '):]}]) AS factor, unnest([{', '.join(f'f{i}' for i in cols)}]) AS f FROM og)")
    return ",".join("\n" + c for c in ctes)


MODEL_SQL = FACTOR_SQL + "," + _projections()


@query("risk_factor_returns", "date:t factor:s f:6", FACTOR_SQL + "SELECT * FROM fr")
def _(t):
    r, m = returns(t)
    return K.factor_returns(r, m, chars(t))


@query("risk_model", "sid:i factor:s beta:5 specific:5 r2:5", MODEL_SQL + "SELECT * FROM ex")
def _(t):
    return model(t)[1]


@query("risk_decomposition", "sector:s factor:s b:5 contribution:5 total_vol:5 factor_vol:5 specific_vol:5 factor_pct:5", MODEL_SQL + """,
cv AS (SELECT a.factor AS f1, b.factor AS f2, covar_samp(a.f, b.f) * 252 AS cov FROM ol a JOIN ol b USING (date) GROUP BY ALL),
hv AS (SELECT sid, sector, acctbal + 2000 AS v, specific FROM securities JOIN (SELECT DISTINCT sid, specific FROM ex) USING (sid)),
hw AS (SELECT *, v / sum(v) OVER (PARTITION BY sector) AS w FROM hv),
sp AS (SELECT sector, sum(w * w * specific * specific) AS sv FROM hw GROUP BY sector),
be AS (SELECT sector, factor, sum(w * beta) AS b FROM hw JOIN ex USING (sid) WHERE factor <> 'alpha' GROUP BY ALL),
ct AS (SELECT x.sector, x.factor, max(x.b) AS b, sum(x.b * cov * y.b) AS contribution FROM be x JOIN be y ON x.sector = y.sector JOIN cv ON f1 = x.factor AND f2 = y.factor GROUP BY x.sector, x.factor),
fv AS (SELECT sector, sum(contribution) AS fvar FROM ct GROUP BY sector)
SELECT sector, factor, b, contribution, sqrt(fvar + sv) AS total_vol, sqrt(greatest(fvar, 0)) AS factor_vol, sqrt(sv) AS specific_vol, fvar / (fvar + sv) AS factor_pct
FROM ct JOIN fv USING (sector) JOIN sp USING (sector)""")
def _(t):
    f, e = model(t)
    w = W.normalize_weights(t.securities.select("sector", "sid", (F.col("acctbal") + 2000).alias("v")), ["sector"], "v", "sum")
    return K.risk_decomposition(w.select("sector", "sid", "w"), cut_lineage(e), K.factor_cov(f), ["sector"])
