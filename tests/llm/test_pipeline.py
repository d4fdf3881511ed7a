"""The pipeline against a brute-force version, and the registered queries against their SQL."""
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from factorspark.llm import bpe, mix
from factorspark.llm.queries import ORACLE_SQL, QUERIES
from llm_brute import exact, grouped, mark


def test_pipeline_against_brute_force(docs, spark, tmp_path):
    base = " ".join(f"word{i % 50}" for i in range(400))
    rows = [(1, base, "en", "a"), (2, base + " ", "en", "b"), (3, base.upper(), "en", "a"), (4, "123", "en", "a"), (5, None, "en", "b"), (6, "short text here", "en", "b"), (7, "another short one", "en", "a"), (8, "short  texthere", "en", "c")]
    rows += [(20 + i, f"der hund nummer {i} und seine katze {i * 7}", "de", "b") for i in range(12)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {d: (t, s) for d, t, _, s in rows if t is not None and any(c.isalpha() for c in t)}
    won = exact([(d, t) for d, (t, _) in left.items()])
    left = {d: x for d, x in left.items() if won[d][2]}
    roots = grouped({d: mark(t) for d, (t, _) in left.items()})
    left = {d: x for d, x in left.items() if roots[d] == d}
    plan = mix.mix(docs([(d, t, "en", s) for d, (t, s) in left.items()])).collect()
    coder = bpe.Coder(*bpe.default_ranks())
    expected = Counter({(r.doc_id, len(coder.plain.encode_ordinary(left[r.doc_id][0]))): r.copies for r in plan if r.copies})
    assert Counter((r.doc_id, r.n_tokens) for r in got) == expected and expected


def test_stages_keep_the_columns_of_documents(docs, spark):
    d = docs([(1, "some words here", "en", "a"), (2, "other words there", "en", None), (None, "third text", None, "b")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, "").columns == d.columns
        assert stage(spark, d.limit(0), "").collect() == []
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_clashing_columns_and_repeated_rows(docs, spark):
    rows = [(1, "some words here", "en", "a")] * 3 + [(2, "other words there", "en", None), (None, "third text", None, "b"), (None, "third text", None, "b"), (4, None, "en", "a"), (5, "", "en", "a")]
    d = docs(rows, extra=True).selectExpr("*", *[f"'x' AS `{c}`" for c in ("lang_pred", "text_key", "row_key", "copies", "component_id", "fingerprint", "word", "known", "taken")])
    left = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, d, "").collect()) == Counter((i, t) for i, t, *_ in rows if t)
    got = left.collect()
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows if t} and got
    assert corpus_pipeline.STAGES[-1][1](spark, left, "").count() == len(got)


def test_language_stage_keeps_texts_with_letters_when_no_language_was_learnt(docs, spark):
    d = docs([(1, "some clean words", None, "a"), (2, "ein Text", None, "b"), (3, "123 !", None, "a"), (4, None, None, "a"), (None, "third", None, "b")])
    got = corpus_pipeline.language_id(spark, d, "").collect()
    assert Counter(r.text for r in got) == Counter(["some clean words", "ein Text", "third"])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    rows = con.execute(ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    df = QUERIES[name](spark, root)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(rows)
