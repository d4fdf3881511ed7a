"""BPE, language id, URL filter and HTML extraction."""
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from factorspark.llm import bpe, html, langid, urls

PIECES = ["a", "b", "the", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "漢", "字", "!", "...", "'", "’", "x" * 30, "​", "😀", "\x00", " the", " ", "\r\n"]


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.default_ranks()
    return bpe.Coder(*ranks), [bpe.Coder(*ranks, leaf=a, piece_leaf=b, window=c) for a, b, c in ((1, 1, 1), (7, 6, 2), (20, 3, 4))]


def test_tree_equals_plain_encoding(coders):
    plain, trees = coders
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(60)))
        ids = plain.plain.encode_ordinary(text)
        for c in trees:
            assert c.encode(text) == ids and c.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, " " * 9000, "\n" * 9999 + "x", "é" * 9000, "thertion" * 3000, "!?" * 6000, "'re" * 4000, "a1" * 5000, "word " * 4000])
def test_long_texts(coders, text):
    ids = coders[0].plain.encode_ordinary(text)
    assert coders[0].encode(text) == ids and coders[0].decode(ids) == text.encode()


def test_encode_rows(docs, coders):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, "x"), (2, None), (3, ""), (4, "longer text " * 3000)]
    got = bpe.encode(docs(rows, extra=True)).collect()
    plain = coders[0].plain
    key = lambda x: (x[0] or 0, x[1])
    expected = sorted(((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), i) for d, t in rows for i in [plain.encode_ordinary(t or "")]), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got), key=key) == expected
    assert bpe.encode(docs([]), ids=False).collect() == []


def test_language_id_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in got} == {True, False} and len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_id_odd_rows(docs):
    rows = [(i, "the cat and the dog of the house", "en", "s") for i in range(12)] + [(i, "der hund und die katze des hauses", "de", "s") for i in range(20, 32)]
    rows += [(None, "der hund", None, "s"), (40, None, "en", "s"), (41, "", "de", "s"), (42, "123 !? \n", "en", "s"), (43, "und die " * 40_000, None, "s"), (43, "漢字", None, "s"), (44, "THE CAT AND THE DOG", "xx" if zlib.crc32(b"44") % 4 == 2 else None, "s")]
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in langid.language_id(docs(rows, extra=True)).collect()]
    by = {r[0]: r[1] for r in got}
    assert len(got) == len(rows) and by[40] == by[41] == by[42] == "und" and by[None] == "de" and by[44] == "en" and by[0] == "en" and by[20] == "de"
    assert all((r[1] == "und") == (r[2] == 0) for r in got) and [r[3] for r in got if r[0] is None] == [False]
    assert {r.lang_pred for r in langid.language_id(docs([(1, "abc", None, "s")])).collect()} == {"und"}
    assert langid.language_id(docs([])).collect() == []


def test_batch_scores_equal_a_plain_sum():
    r = random.Random(4)
    texts = ["".join(r.choice("abc é1\n漢") for _ in range(r.randrange(40))) for _ in range(50)] + [""]
    rng = np.random.default_rng(1)
    weight = np.vstack([rng.normal(size=(1 << langid.BITS, 3)), np.zeros(3)]).astype(np.float32)
    model = langid.Model(["x", "y", "z"], np.log([0.5, 0.3, 0.2]), weight)
    best, sure, has = model.score(texts)
    for i, t in enumerate(texts):
        alone = model.score([t])
        assert alone[0][0] == best[i] and math.isclose(alone[1][0], sure[i], rel_tol=1e-6) and alone[2][0] == has[i] == any(c.isalpha() for c in t)


def split_by_hand(name, cost, unknown):
    """Cheapest of all ways to split."""
    if not name:
        return 0.0, []
    return min(((lambda rest: (cost.get(name[:i], unknown(name[:i])) + rest[0], [name[:i], *rest[1]]))(split_by_hand(name[i:], cost, unknown)) for i in range(1, len(name) + 1)), key=lambda x: x[0])


def test_segmentation_against_all_splits():
    s = urls.Splitter({"cheap": 50, "pills": 40, "pill": 60, "che": 5, "ap": 7, "spills": 1, "the": 90, "rapist": 3, "therapist": 2})
    for name in ("cheappills", "therapist", "xcheap", "pillspills", "zzz", "a"):
        cost, _ = split_by_hand(name, s.cost, lambda w: s.unknown + s.each * len(w))
        words = s.split(name)
        assert "".join(words) == name and math.isclose(sum(s.cost.get(w, s.unknown + s.each * len(w)) for w in words), cost)


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = ["http://A.Example.com/en/1", "https://www.example.com/en/2?x=/", "https://x.www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://example.com?x", "ftp://b.net/es/a#b", "http://net/fr/", "http://anet/fr/",
        "http://q.org/en/1", "nothing", "", None, "://", "http://ÀB.com/", "http://x.com/é://y.net/fr/", "a\nb://c.net/es/\nz", "http://cheappills.org/en/spam"]


def test_url_rules_and_verdicts(spark):
    rows = [(i, u, "<p>cheap pills cheap pills</p>" if i % 2 else None) for i, u in enumerate(URLS)] + [(None, URLS[0], ""), (0, URLS[0], "x"), (0, URLS[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as score", "3 as rule")
    got = urls.url_filter(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judge(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == (verdict or ("block" if by[i].score > 0 else "allow"))
    assert by[17].words[:2] == ["cheap", "pills"]
    assert urls.url_filter(df.limit(0)).collect() == []
    assert urls.url_filter(df.filter("page_id = 9")).first().verdict == "allow"


def test_url_vocabulary_is_bounded_and_whole(spark):
    df = spark.createDataFrame([(1, "http://aa.com/", "bb bb cc cc cc cc dd")], "page_id long, url string, html string")
    assert urls.unigrams(df, 100) == {"http": 1, "aa": 1, "com": 1, "bb": 2, "cc": 4, "dd": 1}
    assert urls.unigrams(df, 2) == {"bb": 2, "cc": 4} and urls.unigrams(df, 1) == {"cc": 4}


def test_a_host_seen_on_many_pages_is_split_into_known_words(spark):
    rows = [(i, "https://www.casinowin.com/en/%d" % i, "<p>the casino, a win</p><footer>&copy; casinowin.com see https://casinowin.com/x</footer>") for i in range(40)]
    rows += [(100 + i, "https://other.org/a", "<p>casino and win, more at www.casinowin.com or http://casinowin.com</p>") for i in range(20)]
    rows += [(200 + i, "https://cheap-pills.com/", "") for i in range(10)] + [(300 + i, "https://cheappills.com/", "&copy; cheappills.com") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert not {"casinowin", "cheappills"} & set(urls.unigrams(df, own=False))
    assert {tuple(r.words[-6:-3]) for r in urls.url_filter(df).collect() if r.page_id < 100} == {("casino", "win", "com")}
    assert {tuple(r.words[:2]) for r in urls.url_filter(df).collect() if r.page_id >= 200} == {("cheap", "pills")}


@pytest.fixture(scope="module")
def trees():
    return html.model()


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, dear reader.</p></div><article><h1>The  title &amp; more</h1><p>First&nbsp;paragraph,<br>of <b>bold</b> words.</p>
<div class="ad">Buy this now, it is cheap.</div><p>Second &lt;paragraph&gt;</p><ul><li>An item<li>Another</ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this article at all.</p></div></section>
<aside class="sidebar"><p>Read more of it.</p></aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; us</footer></body></html>"""


def test_extraction_of_a_page(trees):
    assert html.extract([PAGE], trees) == ["The title & more\nFirst paragraph, of bold words.\nSecond <paragraph>\nAn item\nAnother"]


@pytest.mark.parametrize("purpose", ["id='cookie-consent'", "role='complementary'", "id='comments'", "aria-label='advertisement'"])
def test_attributes_behind_long_class_lists_count(trees, purpose):
    utilities = " ".join(f"flex p-{i} mt-{i} w-{i}" for i in range(60))
    notice = f"<div class='{utilities}' {purpose}><p>We use small files to keep what you have chosen, dear reader.</p></div>"
    assert len(utilities) > 600
    nodes = html.Tree(notice).nodes
    assert nodes[1].groups == html.Tree(f"<div {purpose}>x</div>").nodes[1].groups and nodes[1].groups
    page = PAGE.replace("<p>Second", notice + "<p>Second")
    assert html.extract([page], trees) == html.extract([PAGE], trees)


def test_only_scripts_styles_and_form_controls_are_silent(trees):
    text = lambda page: html.main_text(nodes := html.Tree(page).nodes, [True] * len(nodes))
    assert text("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds, <object data=x>a chart</object> <svg><path/><text>label</text></svg></p><h2><button>Part one</button></h2><noscript><p>plain</p></noscript>") == "so a=1 holds, a chart label\nPart one\nplain"
    for inner in ("<iframe src=x>a <b>frame</b></iframe>", "<video>a <b>frame</b></video>"):
        assert text(f"<p>{inner} here</p>") == "a frame here"
    for cut in ("<select><option>x", "<template><div>x</div>x", "<datalist><option>x", "<template><p>x<br>x"):
        assert text(f"<div><div>one {cut}</div><p>two</p></div><p>three</p>") == "one\ntwo\nthree"
    for whole in ("<select><option>x<option>y</select>", "<template><div>x</div><p>y<template/></template>", "<script>'</p>'</script>", "<style/>", "<textarea>x</textarea>"):
        assert text(f"<div>one {whole} two</div>") == "one two"
    page = PAGE.replace("First&nbsp;paragraph", "First <math><mi>x</mi></math>&nbsp;paragraph")
    assert html.extract([page], trees)[0].split("\n")[1] == "First x paragraph, of bold words."


def test_extraction_of_composed_pages(trees):
    composer, right = html.Composer(77), 0
    for _ in range(200):
        page = composer.page()
        nodes = html.Tree(page).nodes
        expected = html.main_text(nodes, [any(composer.MARK in t for t in x.text) for x in nodes]).replace(composer.MARK, "")
        right += html.extract([page.replace(composer.MARK, "")], trees)[0] == expected
    assert right >= 150


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        margin = rng.normal(0, 2, n)
        cost = lambda kept: sum(math.log1p(math.exp(-m if k else m)) for k, m in zip(kept, margin, strict=True))
        ways = [[True, *(bool(w >> i & 1) for i in range(n - 1))] for w in range(1 << (n - 1))]
        best = min((w for w in ways if all(not w[i] or w[parent[i]] for i in range(1, n))), key=cost)
        got = html.decode(parent, margin)
        assert math.isclose(cost(got), cost(best)) and all(not got[i] or got[parent[i]] for i in range(1, n))


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", ""), (4, "w", "<p>cut <b"), (5, "x", "<article><p>" + "word " * 60_000 + "</p></article>"), (6, "y", "<nav><a href=x>only a menu</a></nav>"), (7, "z", "<script>x")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as text", "0 as n_chars")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[None].text == by[3].text == by[6].text == by[7].text == "" and by[5].n_chars == 5 * 60_000 - 1 and by[1].text.startswith("The title")
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_host_labels_with_digits_and_words_of_any_script():
    s = urls.Splitter({"casino": 50, "win": 40, "for\u00eat": 9, "verte": 9})
    assert urls.tokens("casino24win.xyz", "", s)[0] == ["casino", "0", "win", "xyz", ".xyz"]
    assert urls.tokens("casinowin7.4you.xyz", "/A/12", s) == (["casino", "win", "0", "0", "you", "xyz", ".xyz"], ["/a", "/0"])
    assert urls.tokens("for\u00eatverte.fr", "", s)[0] == ["for\u00eat", "verte", "fr", ".fr"]
    long = "casinowin" * 5000
    assert urls.tokens(long + ".xyz", "", s)[0][:-2] == ["casino", "win"] * 5000


def test_vocabulary_counts_whole_words(spark):
    long = "abc" * 10
    df = spark.createDataFrame([(1, "http://x.org/", f"for\u00eat gr\u00f6\u00dfe \u00fcber {long} {long} a1b for\u00eat")], "page_id long, url string, html string")
    assert urls.unigrams(df, 100, own=False) == {"for\u00eat": 2, "gr\u00f6\u00dfe": 1, "\u00fcber": 1}


def test_verdicts_against_plain_counts(spark):
    """Own counts of words, own search of the best split, own naive Bayes."""
    rng = random.Random(5)
    good, bad = ["garden", "green", "house", "school", "books"], ["casino", "win", "pills", "cheap", "bet"]
    rows = []
    for i in range(200):
        words = bad if i % 2 else good
        name = "".join(rng.sample(words, 2)) + rng.choice(["", "24", "7x"])
        top = rng.choice(["com", "net", "xyz"])
        path = {"com": "/", "net": "/es/"}.get(top, "/") if top != "xyz" else rng.choice(["/", "/fr/a", "/12/b"])
        if i % 2 == 0 and top == "net":
            top = "com"
        if i % 2 and top == "com":
            top, path = "net", "/fr/x"
        rows.append((i, f"http://www.{name}.{top}{path}{rng.choice(words)}", " ".join(rng.choices(good + bad + ["the"], k=12))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.url_filter(df).collect()}
    seen = Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        names = {w for label in host.split(".") for w in re.findall("[a-z]{2,}", label)}
        seen.update(w for w in re.findall("[a-z]{2,}", html) if w not in names)
    total = sum(seen.values()) + 1

    def cost(w):
        return -math.log(seen[w] / total) if w in seen else math.log(total) + math.log(10) + len(w) * math.log(10)

    def splits(name):
        if not name:
            return 0.0, []
        return min(((cost(name[:k]) + rest[0], [name[:k], *rest[1]]) for k in range(1, len(name) + 1) for rest in [best(name[k:])]), key=lambda x: x[0])

    memo = {}

    def best(name):
        if name not in memo:
            memo[name] = splits(name)
        return memo[name]

    def words_of(url):
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        out = []
        for label in host.split("."):
            for run in re.findall("[a-z]+|[0-9]+", label):
                out += ["0"] if run.isdigit() else best(run)[1]
        return [*out, "." + host.split(".")[-1], *("/0" if t.isdigit() else "/" + t for t in re.findall("[a-z0-9]+", path))]

    buckets, classes = {0: Counter(), 1: Counter()}, Counter()
    place = lambda w: zlib.crc32(w.encode()) % 65536
    for i, url, _ in rows:
        _, _, rule, verdict = judge(url)
        if rule:
            classes[verdict == "block"] += 1
            buckets[verdict == "block"].update(map(place, words_of(url)))
    sums = {k: sum(c.values()) + 65536 for k, c in buckets.items()}
    checked = 0
    for i, url, _ in rows:
        _, _, rule, verdict = judge(url)
        assert got[i].words == words_of(url)
        odds = math.log(classes[1] / classes[0]) + sum(math.log((buckets[1][place(w)] + 1) / sums[1]) - math.log((buckets[0][place(w)] + 1) / sums[0]) for w in words_of(url))
        assert got[i].score == pytest.approx(odds)
        assert got[i].verdict == (verdict if rule else "block" if odds > 0 else "allow")
        checked += rule is None
    assert checked > 20


def test_known_languages_and_no_others(docs):
    rows = [(i, f"der hund nummer {i} und seine katze im garten", "de") for i in range(40)] + [(100 + i, f"the dog number {i} and her cat in the garden", "en") for i in range(40)]
    rows += [(500, "\u732b\u306f\u5ead\u3067\u5bdd\u3066\u3044\u308b " * 9, None), (501, "123 !", None), (502, None, "en"), (503, "", "en"), (504, "the garden and the cat", None), (None, "katze und hund", None), (504, "the garden and the cat", None)]
    d = docs(rows, extra=True).selectExpr("*", "'x' AS lang_pred", "'x' AS __text", "'y' AS known")
    got = langid.known_only(d, langid.train(d))
    assert got.columns == d.columns
    kept = Counter(r.doc_id for r in got.collect())
    assert not {500, 501, 502, 503} & kept.keys() and kept[504] == 2 and kept[None] == 1 and sum(kept.values()) == 83


@pytest.mark.parametrize("page", [
    "<div>" + "<span>x" * 100_000, "<p>" + "<b>" * 50_000 + "</i>x" * 50_000, "<div>" + "<b>" * 50_000 + "<p>x</p>" * 50_000,
    "<blockquote>" * 30_000 + "</p><td>x" * 30_000, "<select>" + "<b>" * 50_000 + "</i>" * 50_000 + "</select>x"])
def test_pages_with_open_elements_take_linear_time(page):
    """A hundred thousand elements that nothing closes, and end tags that close nothing: seconds, where a scan of what is open takes minutes."""
    start = time.process_time()
    nodes = html.Tree(page).nodes
    assert time.process_time() - start < 20 and sum(len("".join(n.text)) for n in nodes) == page.count("x")


def test_features_in_slices_equal_those_at_once():
    nodes = html.Tree(PAGE * 3).nodes
    assert np.array_equal(np.concatenate(list(html.feature_rows(nodes, 5))), html.features(nodes)) and html.features(nodes).shape == (len(nodes), len(html.FEATURES))


def test_a_long_text_is_scored_in_windows():
    """Four million characters in twenty languages, in some tens of megabytes beside the text; the sums are those of all n-grams at once."""
    model = langid.Model([str(i) for i in range(20)], np.zeros(20), np.random.default_rng(0).normal(-9, 1, ((1 << langid.BITS) + 1, 20)).astype(np.float32))
    model.weight[-1] = 0
    text = "some words of a long text, ΑΣ " * 8_000
    code, first, _ = langid.codes([text])
    found = langid.buckets(code)
    (total, n, has), = model.totals([text])
    assert n[0] == (found >= 0).sum() and has[0] and np.allclose(total[0], model.weight[found].sum(axis=(0, 1), dtype=np.float64), rtol=1e-6)  # a place adds its three weights as floats
    assert np.array_equal(np.concatenate(list(langid.windows(code, 7))), found)
    tracemalloc.start()
    model.score([text * 16])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
