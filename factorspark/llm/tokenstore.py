"""Token ids in raw binary shards, found by document key through a minimal perfect hash.

A store is a folder:

* ``payload-<part>-<mark>.ids``: the ids of whole documents in ascending doc_id order, each document closed by the end id, as
  little-endian unsigned integers without any framing, two bytes wide if the vocabulary allows it, else four;
* ``index-<bucket>-<mark>.mph``: a minimal perfect hash over the keys of one bucket, and for each slot a 64-bit fingerprint of its key, the part,
  the place of the first id in that part's payload, and the number of ids;
* ``shards`` and ``index``: Parquet tables that name the valid files, with the number of ids before each part. A task that is
  repeated writes files of another name; only those of the attempt that succeeded are named, so lost executors leave nothing half done.

The key of a document is its doc_id and its place among the documents of that id, so that repeated ids have entries of their own.
A lookup hashes the key to a bucket and a slot, compares fingerprints and reads that slice of the payload: its cost depends
neither on the number of documents nor on that of the parts. Files are opened through Arrow's file systems, from the tasks.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.common import checkpoint_root, mixed, ship, steps
from factorspark.llm.mph import build, find

#: Keys of one index file on average; runs of text and parts behind the first whose ids a worker remembers from step to step; the longest
#: of these parts that it remembers.
BUCKET, MOST_RUNS, MOST_TAILS, LONGEST_RUN = 20_000, 1_200_000, 500_000, 64
#: Places inside a run that no match crosses: a Latin letter ends, and an ASCII character that is no letter begins.
PARTS = re.compile("(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F])(?=[\x00-@\\[-`{-\x7F])")
#: Id that closes a document. Ids that are read from a payload at once.
END, SLICE = 0, 1 << 20
MAGIC = b"IDX1"


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct run of a text once.

    The pattern of a byte-level tokenizer never matches across a place between a visible character and one space that a
    visible character follows, nor across one between a letter and an ASCII character that is none. So a text's ids are those of its runs
    between such spaces, and a run's are those of its parts. Runs and parts that a worker has met are looked up, the new ones of many texts
    go to the tokenizer in one call. A text with other white space at these places, or with a special token, is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        # a byte-level vocabulary writes every byte as one character
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([END], self.kind).tobytes()
        self.runs: dict[str, bytes] = {}  # run behind a space, or the first part of one, which is a run too
        self.tails: dict[str, bytes] = {}  # other parts

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _tail(self, part: str) -> bytes:
        ids = self.tails.get(part)
        if ids is None:
            ids = self.whole(part)
            if len(part) <= LONGEST_RUN:
                self.tails[part] = ids
        return ids

    def _learn(self, runs: set[str]) -> None:
        """Adds the ids of runs behind a space; runs that do not begin and end with a visible character are left out."""
        held, tails, cut, new = self.runs, self.tails, [], set()
        for run in runs:
            if run.isalpha():  # nothing to cut
                new.add(run)
            elif run and not run[0].isspace() and not run[-1].isspace():
                parts = PARTS.split(run)
                if len(parts) > 1:
                    cut.append((run, parts))
                new.add(parts[0])
        new = list(new.difference(held))
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(x.encode()) + 1 for x in new])) + 1
            held.update(zip(new, self._slices(ids, ends), strict=True))
        fresh = list({part for _, parts in cut for part in parts[1:]}.difference(tails))
        if fresh:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            tails.update(zip(fresh, self._slices(np.array(list(chain.from_iterable(ids)), np.int64), np.cumsum([len(x) for x in ids])), strict=True))
        for run, parts in cut:
            held[run] = held[parts[0]] + (tails[parts[1]] if len(parts) == 2 else b"".join([tails[part] for part in parts[1:]]))
        for part in fresh:
            if len(part) > LONGEST_RUN:
                del tails[part]

    def _slices(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Consecutive ids as bytes of the payload, cut at ``ends``."""
        coded, at = ids.astype(self.kind).tobytes(), (ends * self.width).tolist()
        return [coded[a:b] for a, b in zip([0, *at], at)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids and the end id, as bytes of the payload."""
        for held, most in ((self.runs, MOST_RUNS), (self.tails, MOST_TAILS)):
            if len(held) > most:
                held.clear()
        split = [text.split(" ") for text in texts]
        self._learn(set(chain.from_iterable(split)).difference(self.runs))
        return [self._one(text, runs) + self.end for text, runs in zip(texts, split, strict=True)]

    def _one(self, text: str, runs: list[str]) -> bytes:
        if len(runs) > 1 and not any(s in text for s in self.special) and (runs[0] == "" or not runs[0][-1].isspace()):
            try:
                return self._tail(runs[0]) + b"".join(map(self.runs.__getitem__, runs[1:]))
            except KeyError:  # a run without visible ends
                pass
        return self.whole(text)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write_payload(docs: DataFrame, folder: str, tokenizer: str | None) -> DataFrame:
    """One payload file for each sorted partition; a row for each document: id, none, nth (in its part), part, file, at, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer or default_tokenizer())
        out, name, at, last, nth = None, "", 0, None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store, base = _open(folder)
                name = f"payload-{batch.column('part')[0].as_py()}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{base}/{name}")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = list(zip(batch.column("id").to_pylist(), batch.column("none").to_pylist(), strict=True))
            places, sizes, nths = [], [], []
            for a, b in steps([len(t) for t in texts]):
                coded = e.encode_all(texts[a:b])
                out.write(b"".join(coded))
                for key, ids in zip(keys[a:b], coded, strict=True):
                    nth = nth + 1 if key == last else 0
                    last = key
                    nths.append(nth)
                    places.append(at)
                    sizes.append(len(ids) // e.width)
                    at += sizes[-1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("none"), pa.array(nths, pa.int64()), batch.column("part"), pa.array([name] * len(texts), pa.string()),
                                              pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["id", "none", "nth", "part", "file", "at", "n"])
        if out is not None:
            out.close()

    return docs.mapInArrow(run, "id long, none boolean, nth long, part int, file string, at long, n long")


def _hashes() -> list[Column]:
    """Place and fingerprint of a key."""
    key = [F.col("id"), F.col("none"), F.col("nth")]
    return [F.xxhash64(*key).alias("h"), F.xxhash64(F.lit("fingerprint"), *key).alias("f")]


def _words(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    h, f = h.view(np.uint64), f.view(np.uint64)
    return np.stack([mixed(h), mixed(f ^ np.uint64(0x9E3779B97F4A7C15)), mixed(h ^ (f << np.uint64(1))), mixed(h + f)], axis=1)


_ENTRY = np.dtype([("mark", "<u8"), ("part", "<u4"), ("at", "<u8"), ("n", "<u8")])


def pack(h: np.ndarray, f: np.ndarray, part: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """One index file: magic, keys, levels, their sizes, their bits, entries by slot."""
    levels, slots = build(_words(h, f))
    entries = np.empty(len(h), _ENTRY)
    entries["mark"][slots], entries["part"][slots], entries["at"][slots], entries["n"][slots] = f.view(np.uint64), part, at, n
    sizes = [len(x) for x in levels]
    return MAGIC + struct.pack(f"<QI{len(sizes)}Q", len(h), len(sizes), *sizes) + np.packbits(np.concatenate(levels)).tobytes() + entries.tobytes()


class Index:
    """One index file; its bits are held, its entries are read slot by slot or at once."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.keys, depth = struct.unpack("<4sQI", handle.read_at(16, 0))
        if magic != MAGIC:
            raise ValueError("not an index file")
        sizes = struct.unpack(f"<{depth}Q", handle.read_at(8 * depth, 16))
        total = sum(sizes)
        start = 16 + 8 * depth
        bits = np.unpackbits(np.frombuffer(handle.read_at((total + 7) // 8, start), np.uint8), count=total).astype(bool)
        self.levels = np.split(bits, np.cumsum(sizes)[:-1])
        self.entries = start + (total + 7) // 8

    def find(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its entry (any, if not)."""
        slots = find(self.levels, _words(h, f))
        if len(slots) == 1:
            raw = self.handle.read_at(_ENTRY.itemsize, self.entries + _ENTRY.itemsize * max(0, int(slots[0])))
            got = np.frombuffer(raw, _ENTRY)
        else:
            got = np.frombuffer(self.handle.read_at(_ENTRY.itemsize * self.keys, self.entries), _ENTRY)[slots]
        return (slots >= 0) & (got["mark"] == f.view(np.uint64)), got


def _write_index(rows: DataFrame, folder: str, buckets: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("h", "f", "part", "at", "n")}
        bucket = group.column("bucket")[0].as_py()
        store, base = _open(folder)
        name = f"index-{bucket}-{uuid.uuid4().hex}.mph"
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(pack(**col))
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "file": [name], "keys": pa.array([len(group)], pa.int64())})

    keyed = rows.select(*_hashes(), "part", "at", "n").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(run, "bucket long, file string, keys long")


@dataclass
class Store:
    """A written store. ``documents`` has a row for each document: id, none (whether the doc_id is null), nth."""

    folder: str
    width: int
    buckets: int
    documents: DataFrame
    shards: DataFrame
    index: DataFrame

    def find(self, keys: DataFrame) -> DataFrame:
        """Entries of keys (id, none, nth): part, at, n, and start over all parts; keys that are not there go."""
        folder = self.folder

        def run(group: pa.Table) -> pa.Table:
            store, base = _open(folder)
            with store.open_input_file(f"{base}/{group.column('file')[0].as_py()}") as handle:
                there, got = Index(handle).find(group.column("h").to_numpy(), group.column("f").to_numpy())
            kept = group.select(["id", "none", "nth"]).filter(pa.array(there))
            return pa.table([*kept.columns, *(pa.array(got[c][there].astype(np.int64)) for c in ("part", "at", "n"))], names=["id", "none", "nth", "part", "at", "n"])

        keyed = keys.select("id", "none", "nth", *_hashes()).withColumn("bucket", F.pmod("h", F.lit(self.buckets)))
        named = keyed.join(self.index.select("bucket", "file"), "bucket")
        found = named.groupBy("bucket").applyInArrow(run, "id long, none boolean, nth long, part long, at long, n long")
        return found.join(self.shards.select("part", "file", F.col("start").alias("__start")), "part").withColumn("start", F.col("__start") + F.col("at")).drop("__start")

    def read(self, found: DataFrame, ids: bool = False) -> DataFrame:
        """Adds to the rows of ``find`` ids_crc32 (of the ids as four bytes each) and, if asked for, the ids, from the payload files.

        Rows are sorted by place, so that a file is read forwards; a document is read in slices.
        """
        folder, width = self.folder, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = _open(folder)
            name, handle = None, None
            for batch in batches:
                sums, kept = [], []
                for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        name, handle = file, store.open_input_file(f"{base}/{file}")
                    crc, parts = 0, []
                    for a in range(0, n, SLICE):
                        got = np.frombuffer(handle.read_at(width * min(SLICE, n - a), width * (at + a)), f"<u{width}")
                        crc = zlib.crc32(got.astype("<u4").tobytes(), crc)
                        parts.append(got)
                    sums.append(crc)
                    kept.append(np.concatenate(parts).astype(np.int64) if ids and parts else None)
                cols = [*batch.columns, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int64()))] * ids, [*batch.schema.names, "ids_crc32"] + ["ids"] * ids)
            if handle is not None:
                handle.close()

        rows = found.select("id", "none", "nth", "start", "n", "part", "file", "at")
        schema = "id long, none boolean, nth long, start long, n long, part long, file string, at long, ids_crc32 long" + ", ids array<long>" * ids
        return rows.repartitionByRange("part", "at").sortWithinPartitions("part", "at").mapInArrow(run, schema)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or None: a lookup of the file's name, one of the slot and one read of the payload."""
        key = self.index.sparkSession.range(1).select(F.lit(doc_id or 0).cast("long").alias("id"), F.lit(doc_id is None).alias("none"), F.lit(nth).cast("long").alias("nth"))
        row = key.select(*_hashes()).withColumn("bucket", F.pmod("h", F.lit(self.buckets))).join(self.index, "bucket").first()
        if row is None:
            return None
        store, base = _open(self.folder)
        with store.open_input_file(f"{base}/{row['file']}") as handle:
            there, got = Index(handle).find(np.array([row["h"]]), np.array([row["f"]]))
        if not there[0]:
            return None
        shard = self.shards.filter(F.col("part") == int(got["part"][0])).first()
        with store.open_input_file(f"{base}/{shard['file']}") as handle:
            return np.frombuffer(handle.read_at(self.width * int(got["n"][0]), self.width * int(got["at"][0])), f"<u{self.width}")


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, bucket: int = BUCKET, parts: int | None = None) -> Store:
    """Writes a store of the documents (doc_id, text) into a new folder that all executors share, in ``parts`` payload files or as many as Spark deals.

    A null text counts as empty and has the end id alone. Documents stand in ascending doc_id order, null ids last, those of one id by a hash
    of the text; repeated rows are documents of their own. Very long texts are encoded in one task each and read in slices.
    An empty table gives a store without payload or index files. Other columns are not read. One id on most rows is no burden:
    parts are cut by text and row as well, and keys count the documents of an id.
    """
    import public_tokenizers  # noqa: F401  the default file must be there before the work starts

    spark = docs.sparkSession
    rows = ship(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["none", "id", "tie", "row"]
    placed = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select("id", "none", "text", F.spark_partition_id().alias("part"))
    _write_payload(placed, folder, tokenizer).write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    key = F.struct("none", "id")
    shards = placed.groupBy("part", "file").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"), F.min(key).alias("first"), F.max(key).alias("last"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    shards.withColumn("start", F.coalesce(F.sum("ids").over(ahead), F.lit(0))).write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    # an id can run on into the next parts, where it is the first: there its documents are counted on
    last = placed.join(shards.select("part", "last"), "part").filter(key == F.col("last")).groupBy("part", "none", "id").agg(F.count("*").alias("run"))
    first = shards.select("part", "first.none", "first.id").join(last.withColumnRenamed("part", "earlier"), ["none", "id"]).filter("earlier < part")
    base = first.groupBy("part", "none", "id").agg(F.sum("run").alias("base"))
    documents = placed.join(base, ["part", "none", "id"], "left").withColumn("nth", F.col("nth") + F.coalesce("base", F.lit(0)))
    documents.select("id", "none", "nth", "part", "at", "n").write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    buckets = max(1, -(-documents.count() // bucket))
    _write_index(documents, folder, buckets).write.parquet(f"{folder}/index")
    return Store(folder, encoder(tokenizer or default_tokenizer()).width, buckets, documents.select("id", "none", "nth"), shards, spark.read.parquet(f"{folder}/index"))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one; it must exist, as tasks open files in it."""
    folder = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return folder


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Writes a store of ``docs`` and reads every document back by its key: doc_id, start, n_tokens, ids_crc32, nth, part, at."""
    store = write(docs, new_folder(docs.sparkSession), tokenizer, bucket)
    read = store.read(store.find(store.documents))
    return read.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32", "nth", "part", "at")
