"""Exact, near and substring dedup against brute force."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from factorspark.llm import mph, simhash, suffix
from factorspark.llm.common import components

ROWS = [(5, "a b\tc"), (3, "a b  c"), (9, "abc"), (4, None), (8, ""), (7, " \n"), (2, "é x"), (1, "éx"), (11, "z" * 200_000), (12, "z" * 200_000 + "\r")]


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(v)[1], len(v), d == min(v)[1], hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, d in v}


@pytest.mark.parametrize("bucket", [32_000, 2])
def test_exact_dedup(docs, bucket):
    got = mph.exact_dedup(docs(ROWS, extra=True), bucket).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact(ROWS)


def test_exact_dedup_repeated_rows_null_ids_and_no_rows(docs):
    got = mph.exact_dedup(docs([(1, "a"), (1, "a"), (None, "a"), (None, "q"), (2, " a")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 2, 4, False), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True)]
    got = mph.exact_dedup(docs([(1, "a"), (1, "a"), (3, "a")])).collect()
    assert sorted((r.doc_id, r.kept) for r in got).count((1, True)) == 1 and all(r.keep_id == 1 for r in got)
    assert mph.exact_dedup(docs([])).collect() == []


def test_keep_rows_keeps_columns_and_one_of_repeated_rows(docs):
    d = docs([(1, "a", "en", "s"), (1, "a", "en", "s"), (2, "a", "de", "t"), (None, "b", None, None)], extra=True)
    keys = mph.exact_dedup(d).filter("kept").select("doc_id", "text_key")
    kept = mph.keep_rows(d, keys)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (1, "a")]


def test_perfect_hash_is_minimal_and_strangers_fail_the_byte_check():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    words[1:50, 0] = words[0, 0]  # digests that share a part
    levels, slots = mph.build(words)
    assert sorted(slots) == list(range(5000)) and (mph.find(levels, words) == slots).all()
    others = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    held = words[np.argsort(slots)]
    at = mph.find(levels, others)
    assert not ((at >= 0) & (held[at] == others).all(axis=1)).any()


def mark(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(marks):
    """Smallest id reachable over links of at most two bits."""
    root = {d: d for d in marks}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in marks}


def test_near_dedup_against_brute_force(docs):
    r = random.Random(3)
    rows = []
    for base in range(12):
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(30)) for _ in range(r.choice([40, 600, 1500]))]
        for copy in range(8):
            own = list(words)
            for _ in range(copy % 4):
                own[r.randrange(len(own))] = "edit"
            rows.append((base * 100 + copy, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, "one two"), (5005, "One\ttwo"), (5006, "a b c"), (5007, "x " * 50_000)]
    marks = {d: mark(t) for d, t in rows}
    got = simhash.near_dedup(docs(rows, extra=True)).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {d: f"{m:016x}" for d, m in marks.items()}
    assert {x.doc_id: x.component_id for x in got} == grouped(marks)
    assert any(x.n_links for x in got)
    ids = [x.doc_id for x in simhash.survivors(simhash.near_dedup(docs(rows))).collect()]
    assert sorted(ids) == sorted(set(grouped(marks).values()))


def test_anchors_cover_every_pair_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000)
    flips = rng.integers(0, 64, (2, 3000))
    y = (x.view(np.uint64) ^ (np.uint64(1) << flips[0].astype(np.uint64)) ^ (np.uint64(1) << flips[1].astype(np.uint64))).view(np.int64)
    at, anchor = simhash.guest_anchors(y)
    assert set(range(3000)) <= set(at[anchor == simhash.home_anchor(x)[at]])
    assert len(anchor) / 3000 < 70


def test_near_dedup_null_ids_repeated_rows_and_no_rows(docs):
    got = simhash.near_dedup(docs([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert simhash.near_dedup(docs([])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(9)
    names = r.sample(range(10_000), 400)
    pairs = list(zip(names[:200], names[1:200], strict=False)) + [(names[200], x) for x in names[201:400]]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    chain, star = min(names[:200]), min(names[200:])
    expected = {x: chain for x in names[:200] if x != chain} | {x: star for x in names[200:] if x != star}
    assert got == expected


def cut(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            seq = tuple(words[i : i + window])
            if seq in seen:
                gone[i : i + window] = [True] * window
            seen.add(seq)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("window", "group"), [(20, 4_000_000), (20, 300), (3, 40), (1, 10)])
def test_substring_dedup_against_brute_force(docs, window, group):
    r = random.Random(window)
    line = "this very line stands in many documents of all kinds and it has just over twenty words so that it counts as one"
    rows = []
    for d in r.sample(range(10_000), 60):
        parts = [" ".join(r.choice(["a", "b", "cé", "d"]) + str(r.randrange(40)) for _ in range(r.randrange(60))) for _ in range(3)]
        rows.append((d, f"{parts[0]}\n{line}\t {parts[1]} {line if r.random() < 0.3 else ''}{parts[2]}"))
    rows += [(20_000 + i, rows[i][1]) for i in range(10)] + [(30_000, None), (30_001, ""), (30_002, "a"), (30_003, " ".join(["w"] * 5000))]
    got = suffix.substring_dedup(docs(rows, extra=True), window, group).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == cut(rows, window)


def test_substring_dedup_packs_of_different_tasks(docs, monkeypatch):
    rows = [(d, " ".join(f"w{(d * 7 + i) % 97}" for i in range(50))) for d in range(300)]
    got = suffix.substring_dedup(docs(rows).repartition(7), 20, 2000, spans=True, texts=True).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == cut(rows, 20)
    for x in got:
        assert sum(s.words for s in x.spans) == x.n_removed and len(x.kept.split()) == x.n_words - x.n_removed


def test_substring_dedup_shared_ids_null_ids_and_no_rows(docs):
    text = " ".join(f"w{i}" for i in range(30))
    same = suffix.substring_dedup(docs([(1, text), (1, text)])).collect()
    assert [x.n_removed for x in same] == [0, 0]
    got = suffix.substring_dedup(docs([(1, text), (None, text), (1, text + " x")])).collect()
    assert sorted(x.n_removed for x in got) == [0, 30, 30] and [x.n_removed for x in got if x.doc_id is None] == [30]
    assert suffix.substring_dedup(docs([])).collect() == []
