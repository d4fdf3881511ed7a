"""URL filter: rules first, then a classifier over the words of host and path.

Concatenated names in hosts are split into words by the most likely path through a unigram model (Viterbi). The words of host and path
then go to a multinomial naive Bayes model, which has learnt from the URLs that a rule decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import settle, ship

#: Host and path start of a rule, and its verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ALLOW, BLOCK = "allow", "block"
#: Words of the unigram model, the longest that a split can name, and log2 of the token buckets of the classifier.
VOCABULARY, LONGEST, BITS = 50_000, 24, 16
#: Words are whole runs of letters of any script; in a label, runs of digits stand between them.
_WORD = re.compile(r"[^\W\d_]{2,}")
_RUN = re.compile(r"\d+|[^\W\d_]+|[^\W_]")
_TAG = re.compile(r"<[^>]*>")
#: Host of a URL, words that its owner has parted by a sign, and addresses that a text prints.
_HOST = re.compile(r"://([^/?#]*)")
_PARTED = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)+")
_ADDRESS = re.compile(r"[a-z]+://\S*|\bwww\.\S*")
_TOKEN = re.compile(r"[^\W_]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def unigrams(pages: DataFrame, size: int = VOCABULARY, own: bool = True) -> dict[str, int]:
    """The most frequent words of all pages' texts and URLs, ``size`` at most, which bounds what is broadcast.

    Without ``own``, what may be a concatenated name does not count, as it would be a word itself, which costs less than any split: labels
    without a hyphen of a page's own host, in its text too, and addresses that texts print. Of a URL only hyphenated words count.
    Counts are over all rows. A histogram of their logarithms gives the lowest count from which on the words fit, so that only these
    reach the driver, and words of nearly the same count come together or not at all. Words longer than a split can name are counted as
    a whole and left out then, so that the bound holds for bytes too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for url, html in zip(batch.column("url"), batch.column("html"), strict=True):
                address, text = ((x.as_py() or "") for x in (url, html))
                text = _TAG.sub(" ", text).lower()
                if own:
                    seen.update(_WORD.findall(_TAG.sub(" ", address).lower()))
                    seen.update(_WORD.findall(text))
                else:
                    host = _HOST.search(address)
                    names = host[1].lower().split(".") if host else ()
                    labels = {w for name in names if not _PARTED.search(name) for w in _WORD.findall(name)}
                    seen.update(w for w in _WORD.findall(_ADDRESS.sub(" ", text)) if w not in labels)
                    seen.update(w for run in _PARTED.findall(address.lower()) for w in _WORD.findall(run))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = ship(pages).select("url", "html").mapInArrow(run, "word string, n long").filter(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    counts = settle(counts.withColumn("step", F.floor(F.log2("n") * 16)))
    lowest, room = 1 << 20, size
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["step"]
    return {r["word"]: r["n"] for r in counts.filter(F.col("step") >= lowest).collect()}


class Splitter:
    """Most likely words of a name without spaces; digits and other signs part words, unknown stretches cost more the longer they are."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown, self.each = math.log(total) + math.log(10), math.log(10)
        self.seen: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if len(name) > 4 * LONGEST:  # a long one is not worth remembering
            return tuple(self._path(name))
        if name not in self.seen:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            self.seen[name] = tuple(self._path(name))
        return self.seen[name]

    def _path(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                cost = self.cost.get(word)
                options.append((best[start] + (self.unknown + self.each * len(word) if cost is None else cost), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def tokens(host: str, path: str, splitter: Splitter) -> tuple[list[str], list[str]]:
    """Words of the host with its top domain marked, and words of the path; numbers count as one word.

    A label is cut into runs of letters and of digits; each run of letters is split on its own, each run of digits is one ``0``.
    """
    labels = _TOKEN.findall(host.lower())
    words = [w for label in labels for run in _RUN.findall(label) for w in (("0",) if run.isdecimal() else splitter.split(run))]
    if labels:
        words.append("." + labels[-1])
    return words, ["/" + (t.lower() if not t.isdigit() else "0") for t in _TOKEN.findall(path)]


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def _learn(judged: DataFrame, splitter) -> tuple[np.ndarray, np.ndarray]:
    """Counts of token buckets and of rows, by class, over all rows that a rule decides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter.value
        for batch in batches:
            seen: Counter[tuple[int, int]] = Counter()
            for host, path, blocked in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "blocked")), strict=True):
                seen[blocked, -1] += 1
                seen.update((blocked, _bucket(t)) for part in tokens(host, path, split) for t in part)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["blocked", "bucket", "n"])

    counts, rows = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in judged.mapInArrow(run, "blocked int, bucket int, n long").groupBy("blocked", "bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            rows[r["blocked"]] = r["n"]
        else:
            counts[r["blocked"], r["bucket"]] = r["n"]
    return counts, rows


def url_filter(pages: DataFrame, rules=RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """Judges every URL: page_id, host, path, rule, verdict, words (of the segmented host and the path), score (log-odds of a block).

    A null url or one without ``://`` has an empty host and path, which no rule fits and whose words say nothing but the classes' shares.
    Where no rule decides, a positive score blocks. If rules decide nothing, or always the same way, that way (or allow) goes for
    all. Very long urls are judged whole, in time linear in their length. Repeated rows have the same verdict; a null page_id or html is kept as it is; other columns are not read; an empty
    table gives an empty result. What reaches the driver is bounded by the vocabulary and the buckets.
    """
    context = pages.sparkSession.sparkContext
    splitter = context.broadcast(Splitter(unigrams(pages, vocabulary, own=False)))
    parts = ship(pages).select("page_id", host_of().alias("host"), path_of().alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])[F.col("rule")]
    judged = parts.filter("rule is not null").select("host", "path", (said == BLOCK).cast("int").alias("blocked"))
    counts, rows = _learn(judged, splitter)
    smooth = counts + 1.0
    weight = np.log(smooth[1]) - np.log(smooth[0]) + math.log(smooth[0].sum()) - math.log(smooth[1].sum())
    prior = math.log(rows[1] / rows[0]) if rows.all() else math.copysign(1e9, rows[1] - rows[0] - 0.5)
    model = context.broadcast((weight, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, (w, p) = splitter.value, model.value
        for batch in batches:
            words, scores = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = [t for part in tokens(host, path, split) for t in part]
                words.append(found)
                scores.append(p + sum(float(w[_bucket(t)]) for t in found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(scores, pa.float64())], [*batch.schema.names, "words", "score"])

    schema = "page_id long, host string, path string, rule string, words array<string>, score double"
    scored = parts.select(F.col("page_id").cast("long"), "host", "path", "rule").mapInArrow(run, schema)
    verdict = F.coalesce(said, F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score")
