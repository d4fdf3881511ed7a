"""Scalar column helpers: text, numbers, friction, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"

FRICTION_BPS = 13.0
ADV_REFERENCE = 50_000_000.0
LIQUIDITY_THRESHOLD = 10_000_000.0
TRADING_DAYS = 252


def normalize_text(s: Column) -> Column:
    """Accents dropped, other non-ASCII removed, blanks collapsed, lower case."""
    plain = F.regexp_replace(F.translate(s, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def br_number(s: Column) -> Column:
    """``1.234,56`` to a double; null when it is not a number."""
    return F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".").try_cast("double")


def br_date(s: Column) -> Column:
    """``dd/mm/yyyy`` to a date; null when it is not a date."""
    return F.to_date(F.try_to_timestamp(s, F.lit("dd/MM/yyyy")))


def share_multiplier(label: Column, factor: Column) -> Column:
    """New shares per old share of a stock event, null for events without one."""
    up = F.upper(label)
    grows = up.startswith("DESDOBRAMENTO") | up.startswith("BONIFICACAO")
    return F.when(grows, 1 + factor / 100).when(up.startswith("GRUPAMENTO"), factor)


def code_depth(code: Column) -> Column:
    """Number of dots of a dotted account code."""
    return F.size(F.split(code, r"\.")) - 1


def months_between_rounded(start: Column, end: Column) -> Column:
    return F.round(F.datediff(end, start) / 30.44).cast("int")


def isin_class(isin: Column) -> Column:
    """Share class letters embedded in an ISIN, after the country and issuer code."""
    return F.substring(isin, 7, 5)


def friction(adv: Column, unknown: str = "base") -> Column:
    """One-side trading cost as a fraction; grows with illiquidity up to five times.

    ``unknown`` says what a missing or non-positive volume costs: ``base`` charges the base
    rate, ``floor`` treats it as a volume of one.
    """
    base = FRICTION_BPS / 10_000
    scale = F.sqrt(F.lit(ADV_REFERENCE) / F.greatest(adv, F.lit(1.0)))
    cost = base * F.greatest(F.lit(1.0), F.least(F.lit(5.0), scale))
    if unknown == "floor":
        return F.when(adv.isNull(), F.lit(base)).otherwise(cost)
    return F.when(adv.isNull() | (adv <= 0), F.lit(base)).otherwise(cost)


def liquidity_penalty(adv: Column) -> Column:
    raw = F.sqrt(F.greatest(adv, F.lit(0.0)) / LIQUIDITY_THRESHOLD)
    return F.coalesce(F.greatest(F.lit(0.5), F.least(F.lit(1.0), raw)), F.lit(1.0))


def annualize(daily: Column) -> Column:
    return F.when(daily > -1, F.pow(1 + daily, F.lit(TRADING_DAYS)) - 1)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bounds a value; a null stays null (``greatest``/``least`` skip nulls, so guard it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return a / F.when(b != 0, b)


def sane(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year (Meeus/Jones/Butcher)."""
    def idiv(a, b):
        return F.floor(a / b).cast("int")

    a = year % 19
    b, c = idiv(year, 100), year % 100
    h = (19 * a + b - idiv(b, 4) - idiv(b - idiv(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * idiv(c, 4) - h - c % 4) % 7
    m = idiv(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, idiv(n, 31), n % 31 + 1)
