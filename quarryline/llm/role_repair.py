"""Conversation structure repair by error-correcting Earley parsing.

A weighted grammar says which roles may follow each other; error productions let a row be deleted or given another role, and
a row be inserted, at a cost. The chart is built row by row; an item keeps the least (cost, audit) by which it can be
reached. All rules are left-linear, so each item begins at the start of the conversation or at the row before, and a chart
set follows from the one before it alone: a set is made once for each pattern of costs and then looked up, and rows
stream through in order. Conversations are sorted by range over all tasks, so one that is larger than a task's share is
parsed in segments, each from every state in which it may begin, and the segments are put together by their ends.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Nonterminals that stand for what has been read: nothing yet, a system row, an open question, a whole exchange.
STATES = ("Empty", "Head", "Open", "Whole")
#: The symbol that a completed chart derives, and its rules' right sides; a symbol in lower case is a terminal.
RULES = {
    "Talk": (("Empty",), ("Whole",)),
    "Empty": (("Empty", "deleted"),),
    "Head": (("Empty", "system"), ("Head", "deleted")),
    "Open": (("Empty", "User"), ("Head", "User"), ("Whole", "User"), ("Open", "deleted")),
    "Whole": (("Open", "Assistant"), ("Whole", "deleted")),
    "User": (("user",), ("to_user",), ("new_user",)),
    "Assistant": (("assistant",), ("to_assistant",), ("new_assistant",)),
}
#: What reads a row: terminal, initials that it reads (None: any), cost, letter.
READING = (("system", "s", 0, "K"), ("user", "u", 0, "K"), ("assistant", "a", 0, "K"), ("to_user", None, 1, "U"), ("to_assistant", None, 1, "A"), ("deleted", None, 2, "D"))
#: What is inserted before a row or at the end: terminal, cost, letter.
INSERTED = (("new_user", 5, "u"), ("new_assistant", 5, "a"))
#: What an undeleted row costs whose text breaks off.
BREAK = 5
#: The initials of the edits that the letters stand for. A letter also tells the role, which the grammar leaves no choice of.
INITIALS = str.maketrans("UAua", "RRII")

Value = tuple[int, int, str]  # cost, rank of the audit up to the row before, letters since
Kernel = tuple[tuple[str, int, int], ...]  # symbol, cost, rank


def _chart_set(kernel: Kernel) -> dict[tuple[str, tuple[str, ...], int], tuple[Value, str]]:
    """All items of a chart set whose completed symbols over the rows before are `kernel`: (left side, right side, place of
    the dot) -> (value, the kernel's symbol that it stems from). Predicted items of symbols that begin here have the
    value of nothing; inserted rows complete theirs within the set, the cheapest first."""
    done: dict[str, tuple[Value, str]] = {}
    heap = [((cost, rank, ""), symbol, symbol) for symbol, cost, rank in kernel]
    heapq.heapify(heap)
    items = {}
    while heap:
        value, symbol, stem = heapq.heappop(heap)
        if symbol in done:
            continue
        done[symbol] = value, stem
        for left, sides in RULES.items():
            for right in sides:
                if right[0] != symbol:
                    continue
                if len(right) == 1:  # completed at once
                    heapq.heappush(heap, (value, left, stem))
                    continue
                items[left, right, 1] = value, stem
                for terminal, cost, letter in INSERTED:
                    if (terminal,) in RULES.get(right[1], ()):
                        heapq.heappush(heap, ((value[0] + cost, value[1], value[2] + letter), left, stem))
    return items | {(symbol, (), 0): found for symbol, found in done.items()}


@lru_cache(maxsize=1 << 16)
def _read(kernel: Kernel, initial: str, must_go: bool, broken: bool) -> tuple[Kernel, int, tuple[tuple[str, str, str], ...]]:
    """The next chart set's kernel after a row, with costs from 0 and ranks from 0; what was taken off the costs; and for
    each symbol (itself, the symbol of the set before that it stems from, the letters of its edits)."""
    best: dict[str, tuple[tuple[int, int, str], str, str]] = {}
    for (left, right, dot), ((cost, rank, tail), stem) in _chart_set(kernel).items():
        if not right or dot >= len(right):
            continue
        for terminal, reads, price, letter in READING:
            # the symbol after the dot is this terminal, or one that is predicted here and has it as a rule
            if right[dot] != terminal and (terminal,) not in RULES.get(right[dot], ()):
                continue
            if (reads is not None and reads != initial) or (must_go and letter != "D"):
                continue
            letters = tail + letter
            value = (cost + price + BREAK * (broken and letter != "D"), rank, letters.translate(INITIALS))
            if left not in best or value < best[left][0]:
                best[left] = value, stem, letters
    least = min(v[0] for v, _, _ in best.values())
    # audits up to here have equally many rows, so none begins another and their order is that of the values without costs
    order = {k: n for n, k in enumerate(sorted({v[1:] for v, _, _ in best.values()}))}
    found = sorted(best.items())
    return tuple((s, v[0] - least, order[v[1:]]) for s, (v, _, _) in found), least, tuple((s, stem, letters) for s, (_, stem, letters) in found)


@lru_cache(maxsize=1 << 16)
def _ended(kernel: Kernel) -> tuple[int, str, str]:
    """Of a completed chart: its cost, the symbol that it stems from and the letters of what is inserted at the end."""
    (cost, _, tail), stem = _chart_set(kernel)["Talk", (), 0]
    return cost, stem, tail


class Chart:
    """A chart that has begun with one symbol, and what leads back through it."""

    def __init__(self, begun: str):
        self.kernel: Kernel = ((begun, 0, 0),)
        self.base = 0
        self.back: list[tuple[tuple[str, str, str], ...]] = []

    def read(self, initial: str, must_go: bool, broken: bool) -> None:
        self.kernel, least, back = _read(self.kernel, initial, must_go, broken)
        self.base += least
        self.back.append(back)

    def cost(self, symbol: str) -> int:
        return self.base + next(c for s, c, _ in self.kernel if s == symbol)

    def symbols(self) -> list[str]:
        return [s for s, _, _ in self.kernel]

    def edits(self, symbol: str) -> list[str]:
        """The letters of each row on the best way to a symbol."""
        out = []
        for back in reversed(self.back):
            _, symbol, letters = next(b for b in back if b[0] == symbol)
            out.append(letters)
        return out[::-1]

    def ended(self) -> tuple[int, str, str]:
        cost, symbol, tail = _ended(self.kernel)
        return self.base + cost, symbol, tail


def repaired_roles(rows: list[tuple[str, bool, bool]]) -> tuple[int, list[str], str]:
    """The cheapest repair of rows (initial, must be deleted, breaks off): cost, each row's letters, letters at the end."""
    chart = Chart("Empty")
    for row in rows:
        chart.read(*row)
    cost, symbol, tail = chart.ended()
    return cost, chart.edits(symbol), tail


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after a damage that crc32 of `conv_id:turn` modulo 20 chooses: 0 drops the row,
    1 empties its text, 2 takes the marks [.!?] out of it, 3 repeats the row, 4 makes its role user. A null is one space,
    in the text, the role and what is hashed."""
    bare = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(bare("conv_id"), F.lit(":"), bare("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(bare("text"), "[.!?]", "")).otherwise(bare("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(bare("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"))
    return out.where("kind <> 0").drop("kind")


#: A character that isn't ASCII white space.
_INK = r"[^\x20\x09-\x0D]"


def faulted(rows: DataFrame) -> DataFrame:
    """Each different row once, as a written table: conv_id, turn, role, text, copies, row_key (a hash of all), blank,
    broken, and seen (whether an earlier turn has this role and text). Equal rows count together before they are dealt."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    said = F.sha2(F.concat_ws("\x00", part("conv_id"), "role", "text"), 256)
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ink = F.regexp_extract(F.col("text"), rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    each = materialize(each.select("*", said.alias("said"), F.sha2(F.concat_ws("\x00", said, part("turn")), 256).alias("row_key"), (ink == "").alias("blank"), (~ink.isin(".", "!", "?")).alias("broken")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = each.groupBy("said").agg(F.min(place).alias("first"))
    out = materialize(each.join(first, "said").withColumn("seen", ~F.col("first").eqNullSafe(place)).drop("said", "first"))
    discard(each)
    return out


SEGMENT = "conv_id {}, part long, at long, begun string, upto string, cost long, audit string, row_key string, copy long, letters string, edge boolean, initials string, illegal long, tail string"
LEGAL = ("su", "ua", "au")


def parsed(rows: DataFrame) -> DataFrame:
    """Rows of `faulted` parsed in order, as a written table. For each run of rows of a conversation in a task: a row without
    row_key for each pair of states in which it may begin and end (cost, audit, its first and last initials, illegal
    neighbours within), and rows with row_key for each row's letters on that way. A run that may go on in a neighbouring
    task has `edge`; others begin with Empty and end with `Talk`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def told(conv, part: int, first: int, run: "_Run", edge_before: bool, edge_after: bool) -> Iterator[dict]:
        common = {"conv_id": conv, "part": part, "edge": edge_before or edge_after}
        for begun, chart in run.charts.items():
            ways = [("Talk", *chart.ended())] if begun == "Empty" or edge_before else []
            ways += [(s, chart.cost(s), s, "") for s in chart.symbols()] if edge_after else []
            for upto, cost, symbol, tail in ways:
                edits = chart.edits(symbol)
                yield common | {"at": first, "begun": begun, "upto": upto, "cost": cost, "audit": ("".join(edits) + tail).translate(INITIALS), "initials": run.ends, "illegal": run.illegal, "tail": tail}
                for n, (key, copy) in enumerate(run.keys):
                    yield common | {"at": first + n, "begun": begun, "upto": upto, "row_key": key, "copy": copy, "letters": edits[n]}

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, run, conv, held = TaskContext.get().partitionId(), 0, None, None, []

        def emitted(rows: Iterator[dict], least: int = 4096) -> Iterator[pa.RecordBatch]:
            for row in rows:
                held.append(row)
                if len(held) > least:
                    yield flushed()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([h.get(n) for h in held], t) for n, t in zip(names, types, strict=True)], names)
            held.clear()
            return out

        types = None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *[{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SEGMENT.split(", ")[1:]]]
            for c, role, key, copies, blank, broken, seen in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "role", "row_key", "copies", "blank", "broken", "seen")], strict=True):
                if run is None or c != conv:
                    if run is not None:
                        yield from emitted(told(conv, part, at - len(run.keys), run, at == len(run.keys), False))
                    run, conv = _Run(STATES if run is None else ("Empty",)), c
                for copy in range(copies):
                    run.read(role[:1], blank or seen or copy > 0, broken and not blank, key, copy)
                    at += 1
        if run is not None:
            yield from emitted(told(conv, part, at - len(run.keys), run, at == len(run.keys), True))
        if held:
            yield flushed()

    keys = ["conv_id", "turn", "role", "row_key"]  # ascending, nulls first
    ordered = rows.select(*keys, "copies", "blank", "broken", "seen").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.mapInArrow(run_all, SEGMENT.format(kind)))


class _Run:
    """Consecutive rows of one conversation in one task, parsed from each symbol that it may begin with."""

    def __init__(self, begun: tuple[str, ...]):
        self.charts = {s: Chart(s) for s in begun}
        self.keys: list[tuple[str, int]] = []
        self.ends, self.illegal = "", 0

    def read(self, initial: str, must_go: bool, broken: bool, key: str, copy: int) -> None:
        for chart in self.charts.values():
            chart.read(initial, must_go, broken)
        shown = initial or "-"
        if self.keys:
            self.illegal += self.ends[1:] + shown not in LEGAL
        self.ends = (self.ends[:1] or shown) + shown
        self.keys.append((key, copy))


def joined(group: pd.DataFrame) -> pd.DataFrame:
    """The way through the segments of one conversation: for each its begin and end, with the cost and audit of the whole in
    the first one's row. Costs and audits are added up segment by segment, the least kept for each state."""
    parts = [g for _, g in group.sort_values(["part", "at"]).groupby(["part", "at"], sort=True)]
    ways = {"Empty": (0, "", ())}
    for n, part in enumerate(parts):
        last, new = n == len(parts) - 1, {}
        for r in part.itertuples():
            if r.begun in ways and (r.upto == "Talk") == last:
                cost, audit, path = ways[r.begun]
                way = (cost + r.cost, audit + r.audit, (*path, (r.part, r.at, r.begun, r.upto, r.tail)))
                if r.upto not in new or way[:2] < new[r.upto][:2]:
                    new[r.upto] = way
        ways = new
    cost, audit, path = ways["Talk"]
    ends = [p["initials"].iloc[0] for p in parts]
    illegal = sum(int(p["illegal"].iloc[0]) for p in parts) + sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    return pd.DataFrame([{"conv_id": group["conv_id"].iloc[0], "part": p, "begin_at": at, "begun": begun, "upto": upto, "tail": tail, "cost": cost if k == 0 else None, "audit": audit if k == 0 else None, "illegal": illegal if k == 0 else None} for k, (p, at, begun, upto, tail) in enumerate(path)])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text, copies; see `damaged`), each in the order of its turns, nulls first, rows
    of one turn by role and a hash of the text.

    A row's fault is the first that holds: blank (no character but ASCII white space), duplicate (role and text seen
    earlier in the conversation), truncated (the last such character isn't one of .!?). Keeping a row costs 0, another role 1,
    deleting 2, which blank and duplicate rows need, inserting a row without text 5; a truncated row that stays costs 5
    more. The cheapest edits that leave an optional system row and then user and assistant in turn (or no row) are made; of
    those as cheap, the ones whose initials come first. A role that is empty or begins with another letter can't be kept.

    Returns (conversations, repaired rows): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each
    conversation that has a row; and conv_id, place, role, text, edit (K, R or I) in order. A null conv_id is a conversation
    like others; other columns aren't returned; an empty table gives empty ones. A conversation's audit is one value, a
    character an edit, and its segments' audits meet in one task, a row for each task that it is dealt over.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    known = faulted(rows)
    found = parsed(known)
    segments = found.where("row_key IS NULL")
    alone = segments.where("NOT edge").select("conv_id", "part", F.col("at").alias("begin_at"), "begun", "upto", "tail", "cost", "audit", "illegal")
    edges = segments.where("edge").groupBy("conv_id").applyInPandas(joined, f"conv_id {kind}, part long, begin_at long, begun string, upto string, tail string, cost long, audit string, illegal long")
    ways = materialize(alone.unionByName(edges))
    one = F.col("copies")
    distinct_turns = F.count_distinct("turn")
    counts = known.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct_turns, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), one).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.when(F.col("seen"), one).otherwise(one - 1)).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("seen") & F.col("broken"), 1).otherwise(0)).alias("truncated"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    whole = ways.where("cost IS NOT NULL")
    summary = counts.join(whole, same(counts, whole)).select(counts["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # the letters of the way that was taken: a run that is whole has one, of others those with the begin and end chosen count
    mine = found.where("row_key IS NOT NULL")
    a, b = mine.where("edge").alias("a"), ways.alias("b")
    chosen = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.begun") == F.col("b.begun")) & (F.col("a.upto") == F.col("b.upto")), "left_semi")
    edits = mine.where("NOT edge").unionByName(chosen)
    letters = edits.select("part", "at", "row_key", F.posexplode(F.split("letters", "")).alias("n", "letter")).where("letter <> 'D'")
    role = F.when(F.col("letter").isin("U", "u"), "user").when(F.col("letter").isin("A", "a"), "assistant").otherwise(F.col("role"))
    new = F.col("letter").isin("u", "a")
    place = F.struct("part", "at", "n")
    rows_left = letters.join(known.select("conv_id", "row_key", "role", "text"), "row_key").select("conv_id", place.alias("place"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), F.translate("letter", "UAua", "RRII").alias("edit"))
    tails = ways.where("tail <> ''").select("conv_id", "part", F.posexplode(F.split("tail", "")).alias("n", "letter"))
    last = F.struct("part", F.lit((1 << 63) - 1).alias("at"), "n")
    added = tails.select("conv_id", last.alias("place"), role_of("letter").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    return summary, rows_left.unionByName(added)


def role_of(letter: str) -> Column:
    return F.when(F.col(letter) == "u", "user").otherwise("assistant")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each conversation's `role:text` lines, joined by newlines. Lines stream through
    it in order, as the hash takes them one after the other; no conversation is held whole."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, type_ = None, None, None
        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for c, role, text in zip(*[x.to_pylist() for x in batch.columns[:3]], strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type_), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    ordered = repaired.select("conv_id", "role", "text", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired: its faults, cost, audit and the hash of what it has become."""
    summary, repaired = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    hashes = digests(repaired)
    nothing = hashlib.sha256(b"").hexdigest()
    out = every.alias("e").join(summary.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")), "left").join(hashes.alias("h"), F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("e.conv_id").alias("conv_id"), *numbers, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
