"""Conversation structure repair: the lightest derivation of a legal conversation, found with Knuth's agenda.

A legal conversation has the role initials ``(s?(ua)+)?``. The automaton of that pattern has four states. An item ``(i, q)`` says that the
first i rows of a span have been edited so that the automaton stands in q; a deduction keeps, re-roles or deletes the next row, or
inserts one, and makes an item dearer by the edit's cost and longer by its initial. These functions are superior in the order of
(cost, audit): no result comes before what it is made of, and two derivations of one item with equal costs have as many edits, so neither audit
is the beginning of the other and their order stays when more edits follow. So items are popped from the agenda lightest first, the first pop
of an item is final, and the first goal is the answer.

Spans of one conversation meet by a deduction with two antecedents, ``(left, p, m)`` and ``(right, m, q)`` give ``(whole, p, q)``: costs
add up, audits are joined. So long conversations are cut into leaves, and one that holds a large part of all rows is cut over the partitions
of a range sort by conversation and turn; only its edit letters come together. Texts travel once, to be written out or
hashed in order, and stream through a task without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import WHITE, settle, ship

#: Costs of the edits; a truncated row that is not deleted adds the last.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; where an initial leads; the one role that fits next besides s.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FITS = {0: "u", 1: "u", 2: "a", 3: "u"}
STATES, GOALS = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a leaf span.
LEAF = 64
#: What a row is to the agenda: its initial as it is, marked if truncated, or one that must go.
GONE = "-"
Span = dict[tuple[int, int], tuple[int, str]]


def leaf(rows: str, starts: tuple[int, ...] = tuple(STATES)) -> Span:
    """Lightest (cost, audit) of each way through some rows: from a state to a state.

    A row is one letter: s, u, a or another initial, in capitals if truncated, or ``-`` if it must be deleted.
    """
    found: Span = {}
    for p in starts:
        agenda: list[tuple[int, str, int, int]] = [(0, "", 0, p)]
        final: set[tuple[int, int]] = set()
        while agenda:
            cost, audit, i, q = heappop(agenda)
            if (i, q) in final:
                continue
            final.add((i, q))
            fits = FITS[q]
            heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[q, fits]))
            if i == len(rows):
                found[p, q] = (cost, audit)
                continue
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            row = rows[i]
            if row != GONE:
                more = TRUNCATED if row.isupper() else 0
                heappush(agenda, (cost + REROLE + more, audit + "R", i + 1, NEXT[q, fits]))
                kept = NEXT.get((q, row.lower()))
                if kept is not None:
                    heappush(agenda, (cost + KEEP + more, audit + "K", i + 1, kept))
    return found


def join(left: Span, right: Span) -> Span:
    """The span of two neighbours; the lightest of each pair of ends is the first to leave the agenda."""
    agenda = [(c1 + c2, a1 + a2, p, q) for (p, m), (c1, a1) in left.items() for (n, q), (c2, a2) in right.items() if m == n]
    heapify(agenda)
    found: Span = {}
    while agenda:
        cost, audit, p, q = heappop(agenda)
        found.setdefault((p, q), (cost, audit))
    return found


def joined(spans: list[Span]) -> Span:
    """Spans in order, joined by halves."""
    if len(spans) <= 2:
        return spans[0] if len(spans) == 1 else join(*spans)
    return join(joined(spans[: len(spans) // 2]), joined(spans[len(spans) // 2 :]))


def span(rows: str, starts: tuple[int, ...] = tuple(STATES)) -> Span:
    if len(rows) <= LEAF:
        return leaf(rows, starts)
    cuts = range(0, len(rows), LEAF)
    return joined([leaf(rows[i : i + LEAF], starts if i == 0 else tuple(STATES)) for i in cuts])


def goal(whole: Span) -> tuple[int, str]:
    """Cost and audit of the lightest legal conversation."""
    return min(whole[0, q] for q in GOALS if (0, q) in whole)


def damaged(rows: DataFrame) -> DataFrame:
    """Damages rows by a checksum of conversation and turn: conv_id, turn, and role and text before (role0, text0) and after; n copies (0: dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    k = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role0"), text.alias("text0"), F.when(k == 4, "user").otherwise(role).alias("role"),
                       F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("n"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for rows that are taken as they are."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role0"), text.alias("text0"), role.alias("role"), text.alias("text"), F.lit(1).alias("n"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


#: Place of a row in its conversation: turn (nulls first), then role and the text's digest as they were before damage.
_PLACE = ["turn", "role0", "mark0"]


def judged(rows: DataFrame) -> DataFrame:
    """One row for equal rows: conv_id, the place, n, init (initial of the role), fault (blank, duplicate, truncated or null) of the first of them.

    Only digests of the texts travel. The first place of a role and text is a pre-aggregated minimum, joined back, so a text that stands in
    most rows of a conversation is no burden.
    """
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    end = F.substring(shown, -1, 1)
    slim = rows.select("conv_id", "turn", "role0", _digest("text0").alias("mark0"), "role", _digest("text").alias("mark"), "n", (F.translate("text", WHITE, "") == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    slim = slim.groupBy("conv_id", *_PLACE, "role", "mark", "blank", "cut").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.col("role0").alias("c"), F.col("mark0").alias("d"))
    first = slim.filter("n > 0").groupBy("conv_id", "role", "mark").agg(F.min(place).alias("first")).select(F.col("conv_id").alias("fc"), F.col("role").alias("fr"), F.col("mark").alias("fm"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("role") == F.col("fr")) & (F.col("mark") == F.col("fm"))
    late = F.coalesce(place > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(late, "duplicate").when(F.col("cut"), "truncated")
    return slim.join(first, same, "left").select("conv_id", *_PLACE, "n", F.substring("role", 1, 1).alias("init"), fault.alias("fault"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SEGMENT = "conv_id {kind}, part int, low long, high long, turns long, first string, last string, {counts}, p array<int>, q array<int>, cost array<long>, audit array<string>"


class _Segment:
    """What a partition holds of one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.rows = conv, []
        self.low = self.high = None
        self.turns, self.first, self.last = 0, None, None
        self.count = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, n: int, init: str, fault: str | None) -> None:
        if not n:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is None:
            self.first = init
        else:
            self.count["illegal"] += self.last + init not in LEGAL
        self.last = init
        self.count["illegal"] += n - 1  # no initial may follow itself
        again = "blank" if fault == "blank" else "duplicate"
        if fault:
            self.count[fault] += 1
        self.count[again] += n - 1
        letter = init if init in ("s", "u", "a") else "x"
        self.rows.append((GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter) + GONE * (n - 1))

    def row(self, part: int, begins: bool, ends: bool) -> tuple:
        whole = span("".join(self.rows), (0,) if begins else tuple(STATES))
        if begins and ends:
            cost, audit = goal(whole)
            whole = {(0, 0): (cost, audit)}
        return (self.conv, part, self.low, self.high, self.turns, self.first, self.last, *self.count.values(), [p for p, _ in whole], [q for _, q in whole], [c for c, _ in whole.values()], [a for _, a in whole.values()])


def segments(rows: DataFrame) -> DataFrame:
    """One row for each conversation and partition of the range sort: counts, and the lightest ways through the rows there.

    Only the first and the last conversation of a partition can have rows elsewhere; the others are solved at once.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _SEGMENT.format(kind=kind, counts=", ".join(f"{c} long" for c in _COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begins, part, out = None, False, 0, []
        names = None
        for batch in batches:
            names = batch.schema.field("conv_id").type
            for conv, turn, n, init, fault, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "n", "init", "fault", "part")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(part, begins, True))
                        begins = True
                    now = _Segment(conv)
                now.add(turn, n, init, fault)
            if len(out) >= 1000:
                yield _batch(out, names)
                out = []
        if now is not None:
            out.append(now.row(part, begins, False))
            yield _batch(out, names)

    order = ["conv_id", *_PLACE]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turn", "n", "init", "fault", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(_COUNTS), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
    names = ["conv_id", "part", "low", "high", "turns", "first", "last", *_COUNTS, "p", "q", "cost", "audit"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def plans(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (as ``damaged`` gives them): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = segments(judged(rows))
    whole = F.struct(*[c for c in parts.columns if c != "conv_id"])
    gathered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(whole)).alias("parts"))  # a segment for each partition at most
    schema = f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string"

    def meet(found: list[dict]) -> tuple:
        count = {c: sum(x[c] for x in found) for c in _COUNTS}
        spans, last, low, high, turns = [], None, None, None, 0
        for x in found:
            spans.append({(p, q): (c, a) for p, q, c, a in zip(x["p"], x["q"], x["cost"], x["audit"], strict=True)})
            if x["first"] is not None:
                count["illegal"] += last is not None and last + x["first"] not in LEGAL
                last = x["last"]
            if x["low"] is not None:
                turns += x["turns"] - (high == x["low"])
                low, high = x["low"] if low is None else low, x["high"]
        cost, audit = goal(joined(spans))
        return (0 if low is None else high - low + 1 - turns, *count.values(), cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(meet(x) for x in batch.column("parts").to_pylist()), strict=True)) or [()] * (len(_COUNTS) + 3)
            kinds = [pa.int64()] * (len(_COUNTS) + 2) + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "gaps", *_COUNTS, "cost", "audit"])

    return gathered.mapInArrow(run, schema)


class _Writer:
    """Follows an audit along the rows of a conversation; gives the rows that stand in the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._fit(), "", "I"

    def _fit(self) -> str:
        fits = FITS[self.state]
        self.state = NEXT[self.state, fits]
        return ROLES[fits]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._fit(), text, "R"
        elif edit == "K":
            self.state = NEXT[self.state, role[:1]]
            yield role, text, "K"


def _stream(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Texts of each conversation in order behind its audit, in one partition."""
    none = F.lit(None)
    heads = planned.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role0"), none.cast("binary").alias("mark0"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(0).alias("n"), "audit")
    texts = rows.filter("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role0", _digest("text0").alias("mark0"), "role", "text", "n", none.cast("string").alias("audit"))
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_PLACE).select("conv_id", "kind", "role", "text", "n", "audit")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id and the rows of the repaired conversation, one by one; an empty tuple's place ends each conversation."""
    writer, conv = None, None
    for batch in batches:
        for c, kind, role, text, n, audit in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "n", "audit")), strict=True):
            if kind == 0:
                if writer is not None:
                    yield from ((conv, *x) for x in writer.inserted())
                    yield (conv,)
                writer, conv = _Writer(audit), c
                continue
            for _ in range(n):
                yield from ((conv, *x) for x in writer.row(role, text))
    if writer is not None:
        yield from ((conv, *x) for x in writer.inserted())
        yield (conv,)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, pos (from 0), role, text, edit (K, R or I)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pos, field = [], 0, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal field
            for batch in batches:
                field = batch.schema.field("conv_id").type
                yield batch

        def pack() -> pa.RecordBatch:
            kinds = [field, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "pos", "role", "text", "edit"])

        for x in _replayed(watched()):
            if len(x) == 1:
                pos = 0
                continue
            out.append((x[0], pos, *x[1:]))
            pos += 1
            if len(out) >= 1000:
                yield pack()
                out = []
        if out:
            yield pack()

    return _stream(rows, planned).mapInArrow(run, f"conv_id {kind}, pos long, role string, text string, edit string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: of ``role:text`` of the repaired rows, joined by newlines, hashed as they stream by."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, field, digest, between = [], None, hashlib.sha256(), b""

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal field
            for batch in batches:
                field = batch.schema.field("conv_id").type
                yield batch

        for x in _replayed(watched()):
            if len(x) > 1:
                digest.update(between + f"{x[1]}:{x[2]}".encode())
                between = b"\n"
                continue
            out.append((x[0], digest.hexdigest()))
            digest, between = hashlib.sha256(), b""
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], field), pa.array([d for _, d in out])], ["conv_id", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], field), pa.array([d for _, d in out])], ["conv_id", "repaired_sha256"])

    return _stream(rows, planned).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Repairs every conversation of ``conversations`` (conv_id, turn, role, text), damaged before or as it is.

    Returns a row for each conv_id, null as one of them: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Nulls
    count as one space, but for the order and the gaps of turns. Rows of one turn go by role and SHA-256 of their text; repeated rows are
    duplicates of the first. Empty texts are blank. A conversation without rows after damage has zeros, an empty audit and the hash
    of nothing. Other columns are not read; an empty table gives an empty result. ``repaired`` gives the rows themselves.
    """
    rows = (damaged if damage else undamaged)(ship(conversations))
    planned = settle(plans(rows))
    hashed = digests(rows, planned).withColumnRenamed("conv_id", "__conv")
    return planned.join(hashed, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
