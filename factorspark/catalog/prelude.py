"""The derived engine tables in SQL, as common table expressions included on demand."""

from __future__ import annotations

import re

from factorspark.sources.derived import ACCOUNTS

CTES: dict[str, str] = {
    "listings": """
        WITH s AS (SELECT s_suppkey AS sid, DATE '1993-07-01' + CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 1800 AS INTEGER) AS day FROM supplier)
        SELECT sid, sid AS issuer, CAST(DATE '0001-01-01' AS DATE) AS start, day - 1 AS finish FROM s
        UNION ALL SELECT sid, sid * 3 + 1, day, CASE WHEN sid % 3 = 0 THEN day + 400 END FROM s
        UNION ALL SELECT sid, sid, day + 500, NULL FROM s WHERE sid % 3 = 0""",
    "segments": "SELECT o_custkey AS issuer, year(o_orderdate) AS year, arg_max(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY ALL",
    "securities": """
        SELECT s_suppkey AS sid,
               lpad(CAST(s_suppkey // 2 AS VARCHAR), 6, '0')
                 || CASE WHEN s_suppkey % 10 = 5 THEN '11' WHEN s_suppkey % 2 = 0 THEN '3' ELSE '4' END AS ticker,
               lpad(CAST(s_suppkey // 2 AS VARCHAR), 6, '0') AS root,
               CASE WHEN s_suppkey % 10 = 5 THEN '11' WHEN s_suppkey % 2 = 0 THEN '3' ELSE '4' END AS cls,
               CASE WHEN s_suppkey % 10 = 9 THEN 'DRN' WHEN s_suppkey % 10 = 5 THEN 'UNT'
                    WHEN s_suppkey % 2 = 0 THEN 'ON' ELSE 'PN' END AS kind,
               r_name AS sector, n_name AS subsector,
               CASE WHEN n_regionkey <= 1 THEN 'commodity_export' WHEN n_regionkey = 2 THEN 'financials'
                    ELSE 'other' END AS theme,
               s_acctbal AS acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "trades": """
        SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS date, l_orderkey AS orderkey, l_linenumber AS line,
               l_partkey AS part, l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS value,
               l_returnflag AS flag, l_linestatus AS status, l_discount AS disc, l_tax AS tax
        FROM lineitem""",
    "bars": """
        SELECT sid, date, first(px ORDER BY orderkey, line, part, value) AS open, max(px) AS high, min(px) AS low,
               last(px ORDER BY orderkey, line, part, value) AS close, round(sum(value), 2) AS volume,
               count(*) AS trades, sum(qty) AS quantity,
               max(CASE WHEN flag = 'R' AND disc >= 0.09 THEN 2 WHEN flag = 'A' AND disc >= 0.1 THEN 1 ELSE 0 END) AS mark
        FROM trades GROUP BY sid, date""",
    "spec_bars": """
        SELECT b.sid, date, open, high, low, close, volume, trades, quantity, ticker, root, cls, kind, sector,
               subsector, theme,
               kind || CASE WHEN b.sid % 3 = 0 THEN '*' ELSE '' END || ' NM'
                 || CASE mark WHEN 2 THEN ' EB' WHEN 1 THEN ' ED' ELSE '' END AS spec,
               'BR' || substr(root, 3, 4) || 'AC' || CASE WHEN cls = '3' THEN 'NOR' ELSE 'NPR' END
                 || substr(root, 5, 2) AS isin
        FROM bars b JOIN securities USING (sid)""",
    "sessions": "SELECT date, row_number() OVER (ORDER BY date) AS sno FROM (SELECT DISTINCT date FROM trades)",
    "sbars": "SELECT b.*, s.sno FROM bars b JOIN sessions s USING (date)",
    "index_close": """
        SELECT date, sno, close FROM (SELECT date, round(avg(close), 9) AS close FROM bars GROUP BY date)
        JOIN sessions USING (date)""",
    "cdi": """
        SELECT date, sno, cdi FROM (SELECT date, round(avg(tax) / 100, 12) AS cdi FROM trades GROUP BY date)
        JOIN sessions USING (date)""",
    "cash_events": """
        SELECT root, kind AS type, date AS last_date_prior, px * tax / 10 AS value,
               CASE WHEN status = 'O' THEN 'JRS CAP PROPRIO' ELSE 'DIVIDENDO' END AS label
        FROM trades JOIN securities USING (sid)
        WHERE flag = 'R' AND disc <= 0.02 AND px * tax / 10 > 0""",
    "stock_events": """
        SELECT sid, date AS last_date_prior,
               CASE WHEN line <= 2 THEN 2.0 WHEN line <= 4 THEN 1.1 WHEN line = 5 THEN 0.5 ELSE 0.1 END::DOUBLE AS multiplier
        FROM trades WHERE flag = 'A' AND disc >= 0.1 AND tax >= 0.06""",
    "supplier_x": "SELECT s_suppkey AS sid, CAST(s_nationkey AS BIGINT) AS sector, s_acctbal AS value FROM supplier",
    "order_docs": """
        SELECT o_custkey AS issuer, last_day(CAST(o_orderdate AS DATE)) AS dt_refer,
               CASE WHEN month(o_orderdate) = 12 THEN 'DFP' ELSE 'ITR' END AS form, o_orderkey AS version,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS received, o_totalprice AS value
        FROM orders""",
    "filings": """
        SELECT issuer, dt_refer, form, min(received) AS available_from, max(received) AS last_received,
               count(DISTINCT version) AS n_versions, arg_max(value, version) AS value
        FROM order_docs GROUP BY ALL""",
    "accounts": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{s}', '{c}', '{d}', {g})" for i, (s, c, d, g) in enumerate(ACCOUNTS)) + ") v(k, sheet, code, ds, sign)",
    "statement_lines": f"""
        SELECT o_custkey // 10 AS issuer,
               last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS dt_refer, sheet,
               CASE WHEN l_linestatus = 'O' THEN 'con' ELSE 'ind' END AS scope,
               CASE WHEN l_returnflag = 'R' THEN 'PENÚLTIMO' ELSE 'ÚLTIMO' END AS ordem,
               CAST(CASE WHEN l_tax > 0.05 THEN date_trunc('quarter', o_orderdate) ELSE date_trunc('year', o_orderdate) END AS DATE) AS ini,
               code, ds, round(sum(l_extendedprice * sign), 2) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN accounts ON k = l_partkey % {len(ACCOUNTS)} GROUP BY ALL""",
    "fundamentals": """
        SELECT sid, ticker, root, sector, subsector, theme,
               CASE WHEN sid % 13 <> 0 THEN acctbal / 250 - 4 END AS pl,
               CASE WHEN sid % 17 <> 0 THEN 0.2::DOUBLE + (sid * 37 % 91) / 20 END AS pvp,
               CASE WHEN sid % 7 = 0 THEN (sid * 53 % 60) / 1 + 6 ELSE (sid * 53 % 97) / 100 - 0.3::DOUBLE END AS roe,
               CASE WHEN sid % 5 <> 0 THEN (sid * 29 % 83) / 100 - 0.2::DOUBLE END AS roic,
               CASE WHEN sid % 11 <> 0 THEN (sid * 71 % 127) / 10 - 1 END AS debt_ebitda,
               CASE WHEN sid % 4 = 0 THEN (sid * 31 % 25) / 1 ELSE (sid * 31 % 25) / 100 END AS dividend_yield,
               (sid * 43 % 50) / 10 - 1 AS beta,
               (sid * 97 % 211) * 300000.0::DOUBLE + 1000 AS adv,
               acctbal * 1000000 + 2000000000 AS market_cap,
               CASE WHEN sid % 3 = 0 THEN (sid * 19 % 30) / 10 END AS fcf_payout,
               (sid * 23 % 61) / 100 - 0.2::DOUBLE AS revenue_growth_3y,
               (sid * 67 % 71) / 100 - 0.3::DOUBLE AS earnings_growth_3y,
               (sid * 13 % 41) / 100 - 0.1::DOUBLE AS asset_growth,
               CASE WHEN sid % 6 <> 0 THEN 1 + (sid * 11 % 40) / 10 END AS analyst_score,
               CASE WHEN sid % 2 = 0 THEN (sid * 17 % 90) / 100 - 0.3::DOUBLE END AS target_upside
        FROM securities""",
    "ticks": "SELECT user_id AS sid, ts, event_id, value AS px, event_type FROM events",
    "baskets": """
        SELECT o_custkey AS rec, CAST(date_trunc('month', o_orderdate) AS DATE) AS rec_date, l_suppkey AS sid,
               round(sum(l_extendedprice), 2) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
}


def with_prelude(body: str, **extra: str) -> str:
    """Prefixes ``body`` with the expressions it reaches, in dependency order.

    An ``extra`` value may itself start with ``WITH``; it is then nested in parentheses.
    """
    defs = {**CTES, **extra}
    ordered: list[str] = []

    def visit(text: str, seen: tuple[str, ...]):
        for name in defs:
            if name not in seen and name not in ordered and re.search(rf"\b{name}\b", text):
                visit(defs[name], (*seen, name))
                ordered.append(name)

    visit(body, ())
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({defs[name]})" for name in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"
