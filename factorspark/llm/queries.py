"""Registered queries of the operators, over whole tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorspark.llm import bpe, html, langid, mix, mph, ranked, repair, shards, simhash, suffix, tokenstore, topk, urls
from factorspark.llm.common import table


def op1_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    return html.extract_pages(table(spark, root, "pages"))


def op2_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix.substring_dedup(table(spark, root, "documents"))


def op3_exact_topk(spark: SparkSession, root: str) -> DataFrame:
    return topk.top_k(table(spark, root, "embeddings"))


def op4_shard_shuffle(spark: SparkSession, root: str) -> DataFrame:
    return shards.shuffle_shards(table(spark, root, "documents"))


def op5_simhash_neardup(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_dedup(table(spark, root, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op6_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return mph.exact_dedup(table(spark, root, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode(table(spark, root, "documents"), ids=False)


def op8_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, root: str) -> DataFrame:
    return langid.language_id(table(spark, root, "documents"))


def op10_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return urls.url_filter(table(spark, root, "pages"))


def op11_token_store(spark: SparkSession, root: str) -> DataFrame:
    return tokenstore.encode_and_read(table(spark, root, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    return repair.repair(table(spark, root, "conversations"))


def op13_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranked.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_substring_dedup, op3_exact_topk, op4_shard_shuffle, op5_simhash_neardup, op6_exact_dedup, op7_byte_bpe, op8_source_mix, op9_language_id, op10_url_filter,
                            op11_token_store, op12_conversation_repair, op13_ranked_search)
}

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i AS start, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS seq
            FROM docs, unnest(generate_series(1, len(ws) - 19)) AS t(i)),
later AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS i FROM later, unnest(generate_series(0, 19)) AS t(k)),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS left_over, count(*) AS n
         FROM (SELECT doc_id, i, ws[i] AS word FROM docs, unnest(generate_series(1, len(ws))) AS t(i)) AS w
         ANTI JOIN gone AS g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM docs AS d LEFT JOIN kept AS k ON d.doc_id = k.doc_id""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) for x in embedding] AS q FROM embeddings),
parts AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v AS a, v AS b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM parts)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op8_source_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark FROM documents),
k AS (SELECT *, substr(md5(concat_ws('|', '{mix.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), mark)), 1, 15) AS pos_key, row_number() OVER (ORDER BY doc_id, mark) AS rid FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
f AS (SELECT *, source_size * 2 AS cap, coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total
      FROM s WINDOW o AS (ORDER BY source_size * 2 / weight, source NULLS LAST)),
m AS (SELECT *, (CAST(total AS DOUBLE) * 1.5 - CAST(filled AS DOUBLE)) / CAST(rest AS DOUBLE) AS multiple FROM f),
g AS (SELECT source, source_size, total, CASE WHEN cap <= weight * multiple THEN CAST(cap AS DOUBLE)
             ELSE weight * max(CASE WHEN cap > weight * multiple THEN multiple END) OVER () END AS target FROM m),
q AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY pos_key, doc_id, mark ROWS UNBOUNDED PRECEDING) AS offered FROM k WHERE size > 0),
c AS (SELECT q.rid, q.size, q.source, q.pos_key, q.doc_id, q.mark, turn, g.total, CAST(q.offered + turn * g.source_size AS DOUBLE) / g.target AS finish
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source, unnest([0, 1]) AS t(turn)),
e AS (SELECT rid, size, total, sum(size) OVER (ORDER BY finish, source NULLS LAST, pos_key, doc_id, mark, turn ROWS UNBOUNDED PRECEDING) AS served FROM c),
t AS (SELECT rid, count(*) AS copies FROM e WHERE served <= total * 1.5 GROUP BY rid)
SELECT k.doc_id, k.size, g.source_size, g.target, CAST(k.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source LEFT JOIN t ON k.rid = t.rid""",
    "op12_conversation_repair": f"""
WITH RECURSIVE marked AS (SELECT *, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0 FROM conversations),
damaged AS (SELECT conv_id, turn, role0, text0, CASE WHEN k = 4 THEN 'user' ELSE role0 END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
            FROM marked, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, sha256(text0)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
judged AS (SELECT *, left(role, 1) AS init, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
inserts(q, q2, cost, audit, rows) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (3, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:'])),
edits(q, edit, init, q2, cost, role) AS (VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (0, 'R', NULL, 2, 1, 'user'), (1, 'R', NULL, 2, 1, 'user'),
    (3, 'R', NULL, 2, 1, 'user'), (2, 'R', NULL, 3, 1, 'assistant'), (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL), (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 3, 2, NULL)),
ways(conv_id, i, q, cost, audit, rows) AS (
    SELECT conv_id, 0, 0, 0, '', CAST([] AS VARCHAR[]) FROM counts
    UNION ALL
    SELECT w.conv_id, w.i + 1, e.q2, w.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || n.audit || e.edit AS audit,
           list_concat(w.rows, n.rows, CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.role, j.role) || ':' || j.text] END) AS rows
    FROM ways AS w JOIN judged AS j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1 JOIN inserts AS n ON n.q = w.q JOIN edits AS e ON e.q = n.q2
    WHERE e.edit = 'D' OR (coalesce(j.fault, '') NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.init = j.init))
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, e.q2 ORDER BY w.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END, w.audit || n.audit || e.edit) = 1),
goals AS (SELECT c.*, w.cost + n.cost AS cost, w.audit || n.audit AS audit, list_concat(w.rows, n.rows) AS rows
          FROM counts AS c JOIN ways AS w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts AS n ON n.q = w.q WHERE n.q2 IN (0, 3)
          QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost + n.cost, w.audit || n.audit) = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN goals AS g ON a.conv_id IS NOT DISTINCT FROM g.conv_id""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
docs AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tfs AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(ts) AS term FROM docs) GROUP BY ALL),
items AS (SELECT iid, item_id, term, count(*) AS often FROM (SELECT iid, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS ts FROM benchmark)) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
scored AS (SELECT iid, item_id, rid, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
           FROM items JOIN tfs USING (term) JOIN weights USING (term), whole GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
