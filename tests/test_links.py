"""Validity ranges: a re-listed ticker, open and overlapping ranges, and the links of the panel at a date."""
import datetime as dt
import random
from collections import Counter

from factorspark.operators import timeseries as ts
from factorspark.plans import panel as N

D = dt.date.fromisoformat
RANGE = "sid long, issuer long, start date, finish date"


def at(spark, rows, ranges, **more):
    left = spark.createDataFrame([(s, D(d)) for s, d in rows], "sid long, t date")
    right = spark.createDataFrame([(s, i, a and D(a), b and D(b)) for s, i, a, b in ranges], RANGE)
    return Counter((r.sid, str(r.t), r.issuer) for r in ts.valid_at(left, right, ["sid"], "t", ["issuer"]).collect())


def test_a_relisted_ticker_has_its_issuer_of_the_day(spark):
    ranges = [(1, 10, "1999-03-01", "2004-06-30"), (1, 20, "2006-01-01", None), (2, 30, None, "2000-12-31")]
    rows = [(1, "1999-02-28"), (1, "1999-03-01"), (1, "2004-06-30"), (1, "2004-07-01"), (1, "2005-12-31"), (1, "2006-01-01"), (1, "2030-01-01"), (2, "1980-01-01"), (2, "2001-01-01"), (3, "2000-01-01")]
    got = at(spark, rows, ranges)
    assert {k[:2]: k[2] for k in got} == {(1, "1999-02-28"): None, (1, "1999-03-01"): 10, (1, "2004-06-30"): 10, (1, "2004-07-01"): None, (1, "2005-12-31"): None, (1, "2006-01-01"): 20,
                                          (1, "2030-01-01"): 20, (2, "1980-01-01"): 30, (2, "2001-01-01"): None, (3, "2000-01-01"): None}


def test_rows_have_one_match_each(spark):
    ranges = [(1, 10, None, None), (1, 20, "2000-01-01", None), (1, 30, "2000-01-01", "2000-12-31"), (1, 40, "2001-05-01", "2001-04-01")]
    rows = [(1, "1999-06-01"), (1, "2000-06-01"), (1, "2000-06-01"), (1, "2001-06-01")]
    assert at(spark, rows, ranges) == Counter({(1, "1999-06-01", 10): 1, (1, "2000-06-01", 30): 2, (1, "2001-06-01", 20): 1})
    assert at(spark, rows[:1], []) == Counter({(1, "1999-06-01", None): 1}) and at(spark, [], ranges) == Counter()


def test_random_ranges_against_a_search(spark):
    rng = random.Random(4)
    day = lambda: str(dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(9000)))
    ranges = [(rng.randrange(5), i, rng.choice([None, day(), day()]), rng.choice([None, day(), day()])) for i in range(60)]
    rows = [(rng.randrange(6), day()) for _ in range(400)]
    want = Counter()
    for s, d in rows:
        held = [(a is not None, a or "", i) for k, i, a, b in ranges if k == s and (a is None or a <= d) and (b is None or d <= b)]
        want[s, d, max(held)[2] if held else None] += 1
    assert at(spark, rows, ranges) == want


def test_links_follow_issuer_and_year(spark):
    members = spark.createDataFrame([(D(t), s) for t in ("2001-01-31", "2003-01-31", "2010-01-31") for s in (1, 2)], "t date, sid long")
    listings = spark.createDataFrame([(1, 10, None, D("2002-12-31")), (1, 20, D("2003-01-01"), None)], RANGE)
    segments = spark.createDataFrame([(10, 2000, "banks"), (10, 2001, "oil"), (20, 2002, "banks"), (20, 2004, "steel")], "issuer long, year int, segment string")
    got = {(str(r.t), r.sid): (r.issuer, r.sector, r.is_fin) for r in N.links_at(members, listings, segments, "banks").collect()}
    assert got == {("2001-01-31", 1): (10, "oil", False), ("2003-01-31", 1): (20, "banks", True), ("2010-01-31", 1): (20, "steel", False), **{(t, 2): (None, None, False) for t in ("2001-01-31", "2003-01-31", "2010-01-31")}}
