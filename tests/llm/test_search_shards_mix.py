"""Top-k, sharding and mixing against brute force and their laws."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import mix, shards, topk


def best(rows, k, every):
    out = set()
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in {(i, tuple(v)) for i, v in fit if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fit if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shape", [(500, 16, 20, 64, 8), (120, 3, 200, 8192, 2048)])
def test_top_k_against_brute_force(spark, shape):
    n, width, k, block, slot = shape
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, width) / 16]) for i in rng.permutation(n)]  # many ties
    rows += [(1001, None), (1020, [float("nan")] * width), (1040, [None] + [1.0] * (width - 1)), (1060, [1.0]), (1080, []), (1100, [float("inf")] * width), (None, [1.0] * width), (1061, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as v").repartition(3)
    got = topk.top_k(df, k=k, block=block, slot=slot).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best(rows, k, 20)


def test_top_k_large_values_repeated_rows_and_no_rows(spark):
    rows = [(0, [3.0e5, -2.5e5]), (0, [3.0e5, -2.5e5]), (1, [1.0e7, 5.0]), (2, [-3.0, 1.0e8]), (2, [-3.0, 1.0e8]), (3, [0.0, -0.001])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    a = [math.floor(64 * float(np.float32(x))) for x in rows[0][1]]
    scored = sorted((-sum(x * math.floor(64 * float(np.float32(y))) for x, y in zip(a, v, strict=True)), i) for i, v in rows if i)
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_top_k_with_a_vector_wider_than_the_queries_in_one_block(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 16]) for i in range(30)] + [(31, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = topk.top_k(df, k=5, block=8).collect()
    assert len(got) == 10
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best(rows, 5, 20)
    same = [(0, [0.5, 0.25]), (0, [0.5, 0.25, 0.0]), (0, [0.501, 0.25]), (0, [0.5, 0.25, 0.001, 0.0])] + [(i, [i / 16]) for i in range(1, 9)]
    got = topk.top_k(spark.createDataFrame(same, "vec_id long, embedding array<float>"), k=3).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 8), (2, 7), (3, 6)]


def test_shards_are_exact_and_gapless(docs):
    rows = [(i % 50 if i % 3 else None, [None, "", "é" * 9, "same"][i % 4]) for i in range(1003)]
    got = shards.shuffle_shards(docs(rows, extra=True).repartition(3), chunk=20).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_few_and_no_rows_to_shard(docs):
    assert sorted((r.shard, r.slot) for r in shards.shuffle_shards(docs([(1, "a"), (2, "b")])).collect()) == [(0, 0), (1, 0)]
    assert shards.shuffle_shards(docs([])).collect() == []


def test_hypergeometric_draws_follow_the_law(spark):
    total, good, draws, n = 60, 23, 17, 20_000
    u = (F.col("id") + 0.5) / n
    got = Counter(r.x for r in spark.range(n).select(shards.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), u).alias("x")).collect())
    for x in range(draws + 1):
        law = math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws)
        assert abs(got[x] / n - law) < 2 / n
    edges = spark.range(1).select(*[shards.hypergeometric(F.lit(t), F.lit(g), F.lit(d), F.lit(v)).alias(f"c{i}") for i, (t, g, d, v) in enumerate([(0, 0, 0, 0.3), (9, 9, 4, 0.9), (9, 0, 4, 0.1), (9, 5, 9, 0.5), (10**12, 10**11, 10**10, 0.5)])]).first()
    assert tuple(edges)[:4] == (0, 4, 0, 5) and abs(edges[4] - 10**9) < 12 * 30_000  # standard deviations; u walks outwards from the mode


def test_matrix_keeps_both_margins(spark):
    sizes = spark.createDataFrame([(i, 10 * i % 37) for i in range(30)], "part int, n long")
    got = {r.part: list(r.counts) for r in shards.matrix(sizes, 8, 1).collect()}
    n = {i: 10 * i % 37 for i in range(30)}
    assert {p: sum(c) for p, c in got.items()} == n
    ends = [sum(c[s] for c in got.values()) for s in range(8)]
    assert sum(ends) == sum(n.values()) and max(ends) - min(ends) <= 1


def test_shuffle_is_uniform(docs):
    """Every row is equally likely in each shard and slot: means over seeds."""
    d = docs([(i, str(i)) for i in range(40)])
    hits = np.zeros((40, 8))
    for seed in range(12):
        for r in shards.shuffle_shards(d, seed=seed, partitions=5).collect():
            hits[r.doc_id, r.shard] += 1
    chi = ((hits - 1.5) ** 2 / 1.5).sum()
    assert abs(chi - 280) < 5 * math.sqrt(2 * 280)


def filled(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by resharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: repeats * sizes[s] for s in names}
    full, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level >= cap[s]]
        if not over:
            return {s: float(cap[s]) if s in full else w[s] * level for s in names}
        full |= set(over)
        left -= sum(cap[s] for s in over)


def test_mix_targets_budget_and_limits(docs):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", [None, "a", "b", "ß", "Z", "tiny"][int(rng.choice(6, p=[0.1, 0.4, 0.2, 0.1, 0.19, 0.01]))]) for i in range(1500)]
    rows += [(1, rows[1][1], "en", rows[1][3]), (None, "a b", "en", "a"), (9000, None, "en", "a"), (9001, "  x\x0by", "en", "none of it"), (9002, None, "en", "empty")]
    got = mix.mix(docs(rows, extra=True), chunk=100).collect()
    count = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    goal = filled(dict(sizes))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, count(t), s) for d, t, _, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    budget = 1.5 * sum(sizes.values())
    assert 0 <= budget - sum(taken.values()) <= 40
    assert all(abs(taken[s] - goal[s]) <= 45 for s in goal)
    again = mix.mix(docs(rows).repartition(5), chunk=33).collect()
    assert Counter((r.doc_id, r.size, r.source, r.taken) for r in got) == Counter((r.doc_id, r.size, r.source, r.taken) for r in again)


def test_take_repeats_rows_as_planned(docs):
    d = docs([(1, "a b c", "en", "x"), (2, "d e", "en", "x"), (2, "d e", "en", "x"), (3, "f", "en", "y"), (4, None, "en", "y")], extra=True)
    plan = mix.mix(d)
    out = mix.take(d, plan)
    assert out.columns == d.columns
    expected = Counter()
    for r in plan.collect():
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +expected
    assert mix.mix(docs([])).collect() == [] and mix.take(docs([]), mix.mix(docs([]))).collect() == []
