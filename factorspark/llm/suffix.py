"""Substring deduplication with prefix-partitioned suffix trees.

A suffix is a document's text from one of its words on. Suffixes are dealt to groups by a prefix of variable length: the shortest
of 1, 3, 8 or all words of a window whose count in the corpus leaves room for others in memory. All suffixes with a common window are in one group. A
group's suffixes, in order, are its subtree; a node at the depth of a whole window with two suffixes below it is a repeat. Every suffix
but the earliest below such a node starts a window that stands earlier in the corpus. Deeper nodes add nothing to these
starts: a longer repeat is the chain of the nodes that its successive words reach, so maximal repeats are the runs of starts.

Edges are compared by 64-bit hashes of the words on them. What is exchanged is one row for each group and some megabytes of text, with
packed columns, and each of these holds a window once however often it stands there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import as_bytes, mixed, ship, steps

WINDOW = 20
#: Prefix lengths before the whole window; suffixes that one group holds in memory; groups at most (then they grow).
LENGTHS, GROUP, MOST_GROUPS = (1, 3, 8), 4_000_000, 100_000
#: Bytes of text whose windows are packed together.
PACK = 8 << 20
#: Bytes of text for a word, on the low side, to foresee the number of suffixes.
WORD_BYTES = 4


def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words of each text."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for one in words for w in one), np.uint64, int(counts.sum())), counts


def prefixes(sym: np.ndarray, counts: np.ndarray, window: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text and start of every window, and the hashes of its prefixes of the given lengths, the last one the whole window's."""
    n = len(sym) - window + 1
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    start = np.arange(len(sym)) - first[text]
    valid = np.flatnonzero(start + window <= counts[text])
    rolled, out = np.zeros(max(0, n), np.uint64), []
    for j, factor in enumerate(_factors(window)):
        if n > 0:
            rolled += sym[j : n + j] * factor
        if j + 1 in lengths:
            out.append(mixed(rolled[valid] + np.uint64(j)))
    return text[valid], start[valid], out


def _sorted_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    at = np.searchsorted(held, values)
    return held[np.minimum(at, len(held) - 1)] == values


def frequent(texts: DataFrame, window: int, share: float, bound: int) -> dict[int, np.ndarray]:
    """Hashes of the prefixes with over ``bound`` suffixes, by length.

    A prefix that holds a share of all suffixes holds at least this share of some pack; packs report what reaches half the
    share, so at most 2 / share prefixes of a length each, and at most 1 / share of each length reach the driver.
    """
    lengths = tuple(x for x in LENGTHS if x < window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t or b"" for t in as_bytes(batch.column("text"))]
            for a, b in steps([len(t) for t in data], PACK):
                _, start, hashes = prefixes(*symbols(data[a:b]), window, (*lengths, window))
                for length, h in zip(lengths, hashes, strict=False):
                    value, n = np.unique(h, return_counts=True)
                    big = n >= max(2, len(start) * share / 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(big.sum(), length, np.int32)), pa.array(value[big].view(np.int64)), pa.array(n[big])], ["length", "value", "n"])

    found = ship(texts).select("text").mapInArrow(run, "length int, value long, n long").groupBy("length", "value").agg(F.sum("n").alias("n")).filter(F.col("n") > bound).collect()
    return {x: np.sort(np.array([r["value"] for r in found if r["length"] == x], np.int64).view(np.uint64)) for x in lengths}


def _small(values: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each value; 255 stands for one that does not fit and follows among the far ones."""
    far = (values < 0) | (values >= 255)
    return np.where(far, 255, values).astype(np.uint8).tobytes(), values[far].astype("<i8").tobytes()


def _values(small: bytes, far: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(far, "<i8")
    return out


_PACKED = {"group": pa.int32(), "known": pa.bool_(), "hashes": pa.binary(), "docs": pa.binary(), "far_docs": pa.binary(), "keys": pa.binary(), "runs": pa.binary(), "far_runs": pa.binary(), "starts": pa.binary(), "far_starts": pa.binary()}


_SCHEMA = "group int, known boolean, hashes binary, docs binary, far_docs binary, keys binary, runs binary, far_runs binary, starts binary, far_starts binary"


def _packs(group: np.ndarray, known: bool, hashes: np.ndarray | None, text: np.ndarray, start: np.ndarray, doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """One row for each group: suffixes in the order of documents, as a run for each document and steps between its starts."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    rows: list[tuple] = []
    for part in np.split(order, cuts) if len(order) else []:
        t = text[part]
        edge = np.flatnonzero(np.diff(t, prepend=-1))
        which = t[edge]
        step = np.diff(start[part], prepend=0)
        step[edge] = start[part][edge]
        rows.append((int(group[part[0]]), known, b"" if hashes is None else hashes[part].tobytes(), *_small(np.diff(doc[which], prepend=0)), key[which].tobytes(),
                     *_small(np.diff(np.append(edge, len(t)))), *_small(step)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_PACKED.values())], list(_PACKED))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and keys of the runs, and the run and start of each suffix."""
    runs = _values(row["runs"], row["far_runs"])
    steps_ = _values(row["starts"], row["far_starts"])
    first = np.cumsum(runs) - runs
    total = np.cumsum(steps_)
    start = total - np.repeat(total[first] - steps_[first], runs)
    return np.cumsum(_values(row["docs"], row["far_docs"])), np.frombuffer(row["keys"], np.int64), np.repeat(np.arange(len(runs), dtype=np.int32), runs), start.astype(np.int32)


def suffixes(texts: DataFrame, window: int, groups: int, large: dict[int, np.ndarray]) -> DataFrame:
    """Packed suffixes by group. A window that stands in a pack before is ``known`` to be a repeat, and needs no hash further on."""
    shared = texts.sparkSession.sparkContext.broadcast(large)
    lengths = tuple(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            data = [t or b"" for t in as_bytes(batch.column("text"))]
            docs, keys = (batch.column(c).to_numpy() for c in ("doc", "key"))
            for a, b in steps([len(t) for t in data], PACK):
                rows = a + np.lexsort((keys[a:b], docs[a:b]))
                same = (np.diff(docs[rows], prepend=0) == 0) & (np.diff(keys[rows], prepend=0) == 0)
                same[0] = False
                rows = rows[~same]
                text, start, hashes = prefixes(*symbols([data[i] for i in rows]), window, (*lengths, window))
                if not len(text):
                    continue
                whole = hashes[-1]
                group = mixed(whole) % np.uint64(groups)
                for length, h in reversed(list(zip(lengths, hashes, strict=False))):
                    group = np.where(_sorted_in(h, held[length]), group, mixed(h + np.uint64(length)) % np.uint64(groups))
                order = np.argsort(whole, kind="stable")
                first = np.ones(len(order), bool)
                first[order[1:]] = whole[order[1:]] != whole[order[:-1]]
                d, k = docs[rows], keys[rows]
                yield _packs(group[first], False, whole[first], text[first], start[first], d, k)
                rest = ~first
                yield _packs(mixed(text[rest].astype(np.uint64) + whole[:1]) % np.uint64(groups), True, None, text[rest], start[rest], d, k)

    return texts.mapInArrow(run, _SCHEMA)


def _all(packs: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents and keys of all runs; run, start, hash and ``known`` of all suffixes."""
    hashes, docs, keys, runs, starts, known = [], [], [], [], [], []
    count = 0
    for batch in packs.to_batches():
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in _PACKED}
            d, k, r, s = _unpack(row)
            docs.append(d), keys.append(k), runs.append(r + np.int32(count)), starts.append(s)
            count += len(d)
            known.append(np.full(len(s), row["known"]))
            hashes.append(np.zeros(len(s), np.uint64) if row["known"] else np.frombuffer(row["hashes"], np.uint64))
    return tuple(map(np.concatenate, (docs, keys, runs, starts, hashes, known)))


def _by_document(at: np.ndarray, d: np.ndarray, k: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in the order of documents and starts, and where each document begins."""
    at = at[np.lexsort((s[at], k[r[at]], d[r[at]]))]
    return at, np.flatnonzero(np.append(True, (np.diff(d[r[at]]) != 0) | (np.diff(k[r[at]]) != 0)))[: len(at)]


def repeats_of_group(packs: pa.Table, buckets: int) -> pa.Table:
    """Suffixes that have an earlier one below the same deep node, packed for the bucket of their document."""
    d, k, r, s, h, gone = _all(packs)
    fresh = np.flatnonzero(~gone)
    order = fresh[np.argsort(h[fresh], kind="stable")]
    alike = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(order), bool)
    shared[1:] |= alike
    shared[:-1] |= alike
    below = order[shared]
    below = below[np.lexsort((s[below], k[r[below]], d[r[below]], h[below]))]
    if len(below):
        node = np.flatnonzero(np.diff(h[below], prepend=h[below[:1]] + np.uint64(1)))
        earliest = below[np.repeat(node, np.diff(np.append(node, len(below))))]
        gone[below[(d[r[below]] != d[r[earliest]]) | (k[r[below]] != k[r[earliest]]) | (s[below] != s[earliest])]] = True
    at, edge = _by_document(np.flatnonzero(gone), d, k, r, s)
    doc, key = d[r[at[edge]]], k[r[at[edge]]]
    text = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(at))))
    bucket = (mixed(doc.view(np.uint64) ^ mixed(key.view(np.uint64))) % np.uint64(buckets))[text]
    return pa.Table.from_batches([_packs(bucket, True, None, text, s[at].astype(np.int64), doc, key)])


def starts_of_bucket(packs: pa.Table) -> pa.Table:
    """A row for each document of a bucket with repeats: the starts, as 32-bit numbers."""
    d, k, r, s, _, _ = _all(packs)
    at, edge = _by_document(np.arange(len(s)), d, k, r, s)
    ends = np.append(edge, len(at)).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(s[at].astype("<u4").tobytes())])
    return pa.table({"doc": pa.array(d[r[at[edge]]]), "key": pa.array(k[r[at[edge]]]), "starts": packed})


def repeat_starts(texts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """For rows (doc, key, text): the starts of windows that stand earlier too, as 32-bit numbers, a row for each document with any."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    expected = size // WORD_BYTES
    bound = max(group, expected // MOST_GROUPS)
    groups = max(1, -(-expected // bound))
    large = frequent(texts, window, bound / (4 * max(1, expected)), bound // 4) if groups > 1 else {x: np.array([], np.uint64) for x in LENGTHS if x < window}
    found = suffixes(ship(texts), window, groups, large).groupBy("group").applyInArrow(lambda packs: repeats_of_group(packs, groups), _SCHEMA)
    return found.groupBy("group").applyInArrow(starts_of_bucket, "doc long, key long, starts binary")


def covered(n: int, starts: bytes, window: int) -> np.ndarray:
    """Which of ``n`` words a window with one of the starts covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:n]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP, spans: bool = False, texts: bool = False) -> DataFrame:
    """Removes the words of every window of ``window`` words that starts earlier too, in a smaller doc_id or earlier in the document.

    Returns a row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256; with ``spans`` the removed
    stretches as (first word, words), with ``texts`` the kept words. Null and empty texts have no words. A null doc_id comes after all
    others. Rows that share a doc_id are taken in the order of their texts' hashes; rows with the same text too are one document, which
    is not its own earlier copy, and have the same result. Other columns are not read; an empty table gives an empty result.
    """
    base = ship(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    if base.groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").isEmpty():
        base = base.withColumn("key", F.lit(0).cast("long"))  # the id alone tells texts apart, and no hash need travel
    found = repeat_starts(base.select("doc", "key", "text"), window, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, starts in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                kept = words
                if starts:
                    gone = covered(len(words), starts, window)
                    kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                left = b" ".join(kept)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), [{"first": int(a), "words": int(b - a)} for a, b in edge.reshape(-1, 2)] if spans else None, left.decode() if texts else None))
            kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
            kinds += [("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))] * spans
            cols = [0, 1, 2, *[3] * spans, *[4] * texts]
            kinds += [("kept", pa.string())] * texts
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in out], kind) for i, (_, kind) in zip(cols, kinds, strict=True)]], ["doc_id", *[n for n, _ in kinds]])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", spans array<struct<first: long, words: long>>" * spans + ", kept string" * texts
    return base.join(found, ["doc", "key"], "left").select(F.col("doc_id").cast("long"), "text", "starts").mapInArrow(run, schema)
