"""Token store, conversation repair and ranked search against brute force, on odd inputs and at block borders."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorspark.llm import ranked, repair, tokenstore

CONV = "conv_id long, turn long, role string, text string"


# token store

@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "a", "a b", " a b", "a  b", "a b ", "a\n\nb c", "a \nb", "x  y z", "don't  stop\t now", "a\x1c b", "1 2 3", "é ü ß", "日本 語", "  a b", "a\x85 b c", "'s 't 're it's", "<|endoftext|> a <|endoftext|>b", "b" * 3000, ("word " * 5000) + "end"]


@pytest.mark.parametrize("text", ODD)
def test_runs_give_the_ids_of_the_whole_text(plain, text):
    e = tokenstore.encoder(tokenstore.default_tokenizer())
    assert np.frombuffer(e.encode(text), e.kind).tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'1 \n\t \x1c.é日s"), max_size=30))
def test_runs_of_random_texts(plain, text):
    e = tokenstore.encoder(tokenstore.default_tokenizer())
    assert np.frombuffer(e.encode(text), e.kind).tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def by_hand(plain, rows):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store_of_odd_rows(docs, plain):
    rows = [(i * 7 % 41, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (-5, "below zero")]
    got = tokenstore.encode_and_read(docs(rows, extra=True), bucket=4).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((s, d, n, c) for d, s, n, c in by_hand(plain, rows))


def test_store_with_one_id_on_most_rows(docs, spark, plain):
    rows = [(7, f"copy {i % 3}") for i in range(300)] + [(7, "same")] * 200 + [(i, f"other {i}") for i in range(50)] + [(None, None)] * 20
    store = tokenstore.write(docs(rows).repartition(7), tokenstore.new_folder(spark), bucket=50, parts=9)
    assert store.shards.count() > 1 and store.index.count() > 1
    keys = Counter((r.id, r.none, r.nth) for r in store.documents.collect())
    assert set(keys.values()) == {1} and sum(k[0] == 7 and not k[1] for k in keys) == 501  # 7 is among the others too
    got = store.read(store.find(store.documents), ids=True).collect()
    assert Counter((None if r.none else r.id, tuple(r.ids)) for r in got) == Counter((d, tuple(plain.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *itertools.accumulate(r.n for r in ordered[:-1])]
    assert [(r.none, r.id) for r in ordered] == sorted((r.none, r.id) for r in ordered)


def test_keyed_access_and_strangers(docs, spark, plain):
    rows = [(i, f"text number {i}") for i in range(200)]
    store = tokenstore.write(docs(rows), tokenstore.new_folder(spark), bucket=64)
    assert store.get(17).tolist() == plain.encode("text number 17", add_special_tokens=False).ids + [0]
    assert store.get(17, nth=1) is None and store.get(999) is None and store.get(None) is None
    strangers = spark.range(1000, 3000).selectExpr("id", "false AS none", "0L AS nth")
    assert store.find(strangers).count() == 0
    assert store.find(store.documents.unionByName(strangers)).count() == 200


def test_store_of_nothing(docs, spark):
    assert tokenstore.encode_and_read(docs([])).collect() == []
    store = tokenstore.write(docs([]), tokenstore.new_folder(spark))
    assert store.get(1) is None


def test_payload_files_hold_the_ids_and_nothing_else(docs, spark, plain):
    rows = [(i, f"document {i}") for i in range(30)]
    store = tokenstore.write(docs(rows), tokenstore.new_folder(spark))
    raw = b"".join(open(f"{store.folder}/{r.file}", "rb").read() for r in store.shards.orderBy("part").collect())
    assert np.frombuffer(raw, "<u2").tolist() == [x for _, t in rows for x in [*plain.encode(t, add_special_tokens=False).ids, 0]]


# conversation repair

def every_way(rows):
    """The least (cost, audit) over all edit sequences with up to two insertions at each place."""
    best = None
    for edits in itertools.product("KDua", repeat=len(rows)):
        if any(r == "-" and e != "D" for r, e in zip(rows, edits)):
            continue
        cost = sum({"K": 0, "D": 2}.get(e, 1) + 5 * (e != "D" and r.isupper()) for r, e in zip(rows, edits))
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            out, audit = gaps[0], "I" * len(gaps[0])
            for r, e, g in zip(rows, edits, gaps[1:]):
                out += ("" if e == "D" else r.lower() if e == "K" else e) + g
                audit += (e if e in "KD" else "R") + "I" * len(g)
            if re.fullmatch("(s?(ua)+)?", out):
                best = min(best or (99, ""), (cost + 5 * sum(map(len, gaps)), audit))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_agenda_against_every_way(seed):
    rng = random.Random(seed)
    rows = "".join(rng.choice("suaxSUA-") for _ in range(seed % 4))
    assert repair.goal(repair.span(rows)) == every_way(rows)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ssuuaaxSUA-"), max_size=40), st.integers(1, 9))
def test_spans_meet_as_one(rows, size):
    cut = [repair.leaf(rows[i : i + size]) for i in range(0, len(rows), size)] or [repair.leaf("")]
    whole = repair.leaf(rows)
    assert {k: whole[k] for k in whole} == repair.joined(cut)


def test_insertion_is_found_where_it_is_cheapest():
    assert repair.goal(repair.span("u")) == (2, "D")
    assert repair.goal(repair.span("sa")) == (1, "RK")
    assert repair.leaf("", (2,))[2, 3] == (5, "I")


def repaired_by_hand(rows):
    """Damage, faults, dynamic programme and hash of one conversation, in plain Python."""
    kept = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        place = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(place, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    kept.sort(key=lambda r: r[0])
    turns = [p[1] for p, _, _ in kept if p[0]]
    counts, seen, letters = Counter(), set(), []
    for _, role, text in kept:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        letters.append((role[:1], fault))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    ways = {0: (0, "", ())}
    def widened(ways):
        for _ in range(2):
            for q, (c, a, out) in list(ways.items()):
                r = "a" if q == 2 else "u"
                new = (c + 5, a + "I", (*out, {"u": "user:", "a": "assistant:"}[r]))
                ways[step[q, r]] = min(ways.get(step[q, r], (1 << 60,)), new)
        return ways
    for (init, fault), (_, role, text) in zip(letters, kept):
        new = {}
        for q, (c, a, out) in widened(ways).items():
            options = [(q, c + 2, a + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                r = "a" if q == 2 else "u"
                options.append((step[q, r], c + 1 + more, a + "R", (*out, f"{repair.ROLES[r]}:{text}")))
                if (q, init) in step:
                    options.append((step[q, init], c + more, a + "K", (*out, f"{role}:{text}")))
            for t, *way in options:
                new[t] = min(new.get(t, (1 << 60,)), tuple(way))
        ways = new
    cost, audit, out = min(w for q, w in widened(ways).items() if q in (0, 3))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Hello.", "How are you?", "Fine", "", "  ", "\t.\n", None, "Same text here.", "Ünïcode!", "ends with nbsp. ", "a.b"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("parts", [2, 7])
def test_repair_against_plain_python(spark, parts):
    rows = conversations(1)
    rows += [(500, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(400)] + [(501, 3, "user", "again.")] * 150 + [(502, i, "user", "the same") for i in range(120)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], CONV + ", audit string, part string, kind string").repartition(5)
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {c: repaired_by_hand([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_a_conversation_without_rows_left(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(conv, 0, "user", "gone.")], CONV)).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(spark.createDataFrame([], CONV)).collect() == []


def test_repaired_rows_are_legal_and_match_the_audit(spark):
    rows = repair.undamaged(spark.createDataFrame([(1, 0, "system", "Rules."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Cut"), (1, 3, "user", "Yes?"), (2, 0, "user", "Q?"), (2, 1, "assistant", "A.")], CONV))
    planned = repair.plans(rows)
    out = repair.repaired(rows, planned).orderBy("conv_id", "pos").collect()
    for conv in (1, 2):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out if r.conv_id == conv))
    assert [(r.role, r.text) for r in out if r.conv_id == 2] == [("user", "Q?"), ("assistant", "A.")]
    assert Counter("".join(r.audit for r in planned.collect()).replace("D", "")) == Counter(r.edit for r in out)


# ranked search

def ranked_by_hand(rows, items, top=20):
    pattern = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(d, Counter(pattern.findall(t.translate(lower)))) for d, t in rows if t]
    docs = [(d, c) for d, c in docs if c]
    total, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        q = Counter(pattern.findall((text or "").translate(lower)))
        scores = []
        for d, c in docs:
            m = 75 + (25 * c.total() * total) // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(scores[:top])]
    return out


@pytest.mark.parametrize(("top", "most"), [(20, 200_000), (3, 5)])
def test_search_against_brute_force(docs, spark, top, most):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "Ünder", "日本", "x1", "don't", "a_b", "42", "the", "the", "the"]
    rows = [(i // 2, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(200)]
    rows += [(None, "alpha beta"), (None, None), (900, "..."), (901, "the " * 4000)] + [(950, "alpha gamma")] * 30
    items = [(1, "alpha the the"), (2, "BETA 日本"), (3, None), (4, ""), (5, "nowhere"), (6, "alpha the the"), (6, "ünder x1"), (None, "42 don't")]
    got = ranked.search(docs(rows, extra=True), spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, key string, rank int"), top, most).collect()
    assert Counter(map(tuple, got)) == Counter(ranked_by_hand(rows, items, top))


def test_search_of_nothing(docs, spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked.search(docs([]), items).collect() == []
    assert ranked.search(docs([(1, "alpha")]), items.limit(0)).collect() == []
    assert ranked.search(docs([(1, None), (2, "?")]), items).collect() == []


def test_a_word_is_held_once_and_parts_go_to_the_tokenizer_together():
    """Runs and their first parts share a table; a text with many new parts costs two calls, not one for each."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, e = Tokenizer.from_file(path), tokenstore.Encoder(path)
    calls, whole = [], e.whole
    e.whole = lambda text: (calls.append(text), whole(text))[1]
    texts = ["one two, two-fold (three) na\u00efve x2 and" + "-a" * 100, " ".join(f"w{i}x, y{i};{i}" for i in range(300)), "", "a b\tc d", "\u4e2d\u6587 word, word\u3002 \u00e9t\u00e9."]
    got = e.encode_all(texts) + e.encode_all(texts)
    want = [np.array([*plain.encode(x, add_special_tokens=False).ids, tokenstore.END], e.kind).tobytes() for x in texts]
    assert got == want * 2
    assert len(calls) < 20 and not hasattr(e, "heads")
    assert e.runs["two,"] == e.runs["two"] + e.tails[","] and max(map(len, e.tails)) <= tokenstore.LONGEST_RUN
