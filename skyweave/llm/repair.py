"""Repair of the structure of conversations by cheapest edits, after Hirschberg.

A repaired conversation has roles whose initials read `(s?(ua)+)?`. Its rows go
through four states (nothing yet, after a system, a user, an assistant row) by
edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant row 2; a truncated row that stays adds 1; blank rows and repeats of
an earlier role and text must go. Of the cheapest edits those win whose
initials, in order, are least in ASCII.

Divide and conquer in linear space: from the known state before a run of rows
the forward vector holds, for each state, the least cost up to the middle and
the order of the four least audits; from the end comes the backward vector of
costs; the audit-least of the cheapest crossings is where both halves are
solved in turn. No audit to the middle begins another one (it ends with the
row before the middle), so their order settles it. All conversations of a
batch take these steps together.

Rows are numbered in order by a range partitioning, so that a conversation may
go over many tasks; it is cut into runs of 1,024 rows. A run is a 4 x 4 table of
costs and orders, runs of runs are too, and the same crossing search over such
tables finds the states between runs, then those inside. Only a conversation's
digest and audit (one value each) are made by one task, which holds a row at a
time.

Nulls in conv_id are one conversation; null turns come first; a null role or
text counts as one space; an empty role has no initial; rows of one turn come
in the order of a digest of role and text, equal ones side by side (they are
counted, not carried). Texts may be of any length. Extra columns go. A
conversation without rows has an empty audit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_edges, small_batches, whole_groups, written

#: States: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row of an initial, and after an inserted or reroled row, by the state before.
KEEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ADDS = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that make a conversation whole, by its last state.
TAIL = (0, 2, 1, 0)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
INITIALS = ("", "s", "u", "a")
NEVER = 1 << 40
#: Rows of a run, and runs of a run of runs: powers of two.
RUN_BITS = 10
CONV, TURN, ROLE, TEXT = "conv_id", "turn", "role", "text"


def _row_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Costs, orders and edits (inserts before the row, then what happens to it) from state to state for each class of rows.

    Classes: 2 * initial + truncated, then one for rows that must go.
    """
    cost, edit = np.full((9, 4, 4), NEVER, np.int64), np.zeros((9, 4, 4), np.int64)
    ways = sorted("I" * n + op for n in range(3) for op in "DKR")
    for kind in range(9):
        initial, cut = INITIALS[kind // 2] if kind < 8 else "", kind % 2 if kind < 8 else 0
        for start in range(4):
            for k, way in enumerate(ways):  # in ASCII order, so the first of equal costs stays
                at, price = start, 0
                for _ in way[:-1]:
                    at, price = ADDS[at], price + COST["I"]
                if way[-1] != "D":
                    if kind == 8 or (way[-1] == "K" and (at, initial) not in KEEPS):
                        continue
                    at = KEEPS[at, initial] if way[-1] == "K" else ADDS[at]
                    price += cut
                price += COST[way[-1]]
                if price < cost[kind, start, at]:
                    cost[kind, start, at], edit[kind, start, at] = price, k
    return cost, edit.argsort(axis=2).argsort(axis=2), edit, ways


ROW_COST, ROW_ORDER, ROW_EDIT, WAYS = _row_tables()
#: What is left to pay at the end of a conversation, by its last state.
FINAL = np.array([COST["I"] * n for n in TAIL], np.int64)


def forward(cost: np.ndarray, order: np.ndarray, step_cost: np.ndarray, step_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and order of audits [..., 4] after one more table [..., 4, 4]."""
    key = np.minimum(cost[..., :, None] + step_cost, NEVER) * 4 + order[..., :, None]
    came = key.argmin(axis=-2)
    after = np.take_along_axis(key, came[..., None, :], -2)[..., 0, :] // 4
    place = np.take_along_axis(order, came, -1) * 4 + np.take_along_axis(step_order, came[..., None, :], -2)[..., 0, :]
    place = place + np.where(after >= NEVER, 64, 0)
    return after, (place[..., None, :] < place[..., :, None]).sum(axis=-1)


def backward(cost: np.ndarray, step_cost: np.ndarray) -> np.ndarray:
    return np.minimum((step_cost + cost[..., None, :]).min(axis=-1), NEVER)


def transfers(cost: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables of whole runs [low, high) of tables."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)[None].repeat(len(low), 0).astype(np.int64)
    rank = np.zeros((len(low), 4, 4), np.int64)
    active, k = np.arange(len(low)), 0
    while len(active := active[low[active] + k < high[active]]):
        at = low[active] + k
        total[active], rank[active] = forward(total[active], rank[active], cost[at][:, None], order[at][:, None])
        k += 1
    return total, rank


def crossings(cost: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, final: np.ndarray) -> np.ndarray:
    """The state after each table of the runs [low, high), from their start states to the least of their final costs [run, 4]."""
    after = np.full(len(cost), -1)
    one = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
    while len(low):
        single = high - low == 1
        if single.any():
            at, s = low[single], start[single]
            after[at] = (np.minimum(cost[at, s] + final[single], NEVER) * 4 + order[at, s]).argmin(axis=1)
        low, high, start, final = low[~single], high[~single], start[~single], final[~single]
        middle = (low + high) // 2
        ahead, rank, behind = one[start], np.zeros((len(low), 4), np.int64), final.copy()
        active, k = np.arange(len(low)), 0
        while len(active := active[low[active] + k < middle[active]]):
            at = low[active] + k
            ahead[active], rank[active] = forward(ahead[active], rank[active], cost[at], order[at])
            k += 1
        active, k = np.arange(len(low)), 1
        while len(active := active[high[active] - k >= middle[active]]):
            behind[active] = backward(behind[active], cost[high[active] - k])
            k += 1
        cross = (np.minimum(ahead + behind, NEVER) * 4 + rank).argmin(axis=1)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        start, final = np.concatenate([start, cross]), np.concatenate([one[cross], final])
    return after


# -- runs as tables of rows --------------------------------------------------------------------------


def _lists(values: np.ndarray) -> pa.ListArray:
    """Tables [n, 4, 4] as lists of 16."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * 16, pa.array(values.reshape(-1).astype(np.int64)))


def _tables(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders of the items of a table: given as lists, or by the class of rows."""
    if "kind" in own.column_names:
        kind = own.column("kind").to_numpy()
        return ROW_COST[kind] + 3 * own.column("deletes").to_numpy()[:, None, None], ROW_ORDER[kind]
    return tuple(own.column(c).combine_chunks().flatten().to_numpy().reshape(-1, 4, 4) for c in ("cost", "rank"))


ITEM = f"{CONV} long, at long, cost array<long>, rank array<long>"
BOUND = f"{CONV} long, at long, before int, after int, last boolean"


def _joined_runs(items: DataFrame) -> DataFrame:
    """Runs of items (with `run`) as items."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(batches, ["run", CONV]):
            low, high = group_edges(own, ["run", CONV])
            cost, rank = transfers(*_tables(own), low, high)
            yield pa.RecordBatch.from_arrays([own.column(CONV).take(low).combine_chunks(), own.column("run").take(low).combine_chunks(), _lists(cost), _lists(rank)], names=[CONV, "at", "cost", "rank"])

    return items.repartition("run").sortWithinPartitions("run", CONV, "at").mapInArrow(join, ITEM)


def _bounds(items: DataFrame) -> DataFrame:
    """The states before and after every item of each conversation."""
    most = items.groupBy(CONV).count().agg(F.max("count")).first()[0] or 0
    if most > 1 << RUN_BITS:
        items = items.withColumn("run", F.shiftright("at", RUN_BITS))
        parents = written(_joined_runs(items), "repair-runs")
        return _inside(items, _bounds(parents), "cost array<long>, rank array<long>").select(CONV, "at", "before", "after", "last")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(batches, [CONV]):
            low, high = group_edges(own, [CONV])
            after = crossings(*_tables(own), low, high, np.zeros(len(low), np.int64), np.tile(FINAL, (len(low), 1)))
            before, last = np.roll(after, 1), np.zeros(len(own), bool)
            before[low], last[high - 1] = EMPTY, True
            yield pa.RecordBatch.from_arrays([own.column(CONV).combine_chunks(), own.column("at").combine_chunks(), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(last)], names=[CONV, "at", "before", "after", "last"])

    return items.repartition(CONV).sortWithinPartitions(CONV, "at").mapInArrow(cross, BOUND)


def _inside(items: DataFrame, bounds: DataFrame, columns: str) -> DataFrame:
    """Items with the states before and after each, from those of their runs (bounds: at is the run)."""
    names = [c.split()[0] for c in columns.split(", ")]
    null = {f.name: F.lit(None).cast(f.dataType) for f in items.schema}
    both = items.select("run", CONV, "at", *names, F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"), F.lit(None).cast("boolean").alias("last"))
    both = both.union(bounds.select(F.col("at").alias("run"), CONV, F.lit(-1).cast("long"), *(null[c] for c in names), "before", "after", "last"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(batches, ["run", CONV]):
            bound = own.column("at").to_numpy() == -1  # each group's first row
            given, own = own.filter(pa.array(bound)), own.filter(pa.array(~bound))
            low, high = group_edges(own, ["run", CONV])
            start, stop, closing = (given.column(c).to_numpy() for c in ("before", "after", "last"))
            after = crossings(*_tables(own), low, high, start, np.where(np.arange(4) == stop[:, None], 0, NEVER).astype(np.int64))
            before, last = np.roll(after, 1), np.zeros(len(own), bool)
            before[low], last[high - 1] = start, closing
            columns = [own.column(c).combine_chunks() for c in (CONV, "at", *names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(last)], names=[CONV, "at", *names, "before", "after", "last"])

    return both.repartition("run").sortWithinPartitions("run", CONV, "at").mapInArrow(cross, f"{CONV} long, at long, {columns}, before int, after int, last boolean")


# -- rows ------------------------------------------------------------------------------------------------


def canonical(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with a space for a null role or text."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(F.col(CONV).cast("long").alias(CONV), F.col(TURN).cast("long").alias(TURN), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (ROLE, TEXT)), copies.cast("long").alias("copies"))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults as the contract of the query puts them in, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it a user's."""
    rows = canonical(conversations)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (CONV, TURN)))
    rows = rows.withColumn("fault", F.crc32(key) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(TEXT, ".!?", "")).otherwise(F.col(TEXT))
    return rows.select(CONV, TURN, F.when(F.col("fault") == 4, "user").otherwise(F.col(ROLE)).alias(ROLE), text.alias(TEXT), (F.col("copies") * F.when(F.col("fault") == 3, 2).otherwise(1)).alias("copies"))


def _digest(*columns: str) -> F.Column:
    parts = [x for c in columns for x in (F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.unhex(F.md5(F.concat(*parts)))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, numbered in order by `at`: initial, blank, truncated, how many, and digests of the row (key) and of what is said in the conversation (said)."""
    last = F.expr(f"right(rtrim('\\t\\n\\x0b\\f\\r ', {TEXT}), 1)")
    narrow = rows.select(
        CONV, TURN, _digest(CONV, TURN, ROLE, TEXT).alias("key"), _digest(CONV, ROLE, TEXT).alias("said"), F.substring(ROLE, 1, 1).alias("initial"),
        (~F.col(TEXT).rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "copies",
    )
    narrow = narrow.groupBy(*(c for c in narrow.columns if c != "copies")).agg(F.sum("copies").alias("copies"))
    order = [CONV, TURN, "key"]
    return written(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "repair-rows")


def edits_of(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of each row, in order: (conv_id, at, turn, key, initial, blank, duplicate, truncated, copies, edit, deletes, tail, before, after).

    edit: `I`s for rows put in before it, then K, R or D for the first of its
    copies; deletes: further copies, that all go; tail: rows put in at the end
    of the conversation. before and after are states. A repeat of an earlier
    role and text is `duplicate` in all its copies, else in all but the first.
    """
    rows = numbered_rows(canonical(conversations))
    first = rows.where("not blank").groupBy("said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    rows = rows.join(first, "at", "left").withColumn("duplicate", ~F.col("blank") & F.col("new").isNull())
    initial = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(0)
    kind = F.when(F.col("blank") | F.col("duplicate"), 8).otherwise(initial * 2 + F.col("truncated").cast("int"))
    rows = rows.select(CONV, "at", TURN, "key", "initial", "blank", "duplicate", "truncated", "copies", kind.cast("int").alias("kind"), (F.col("copies") - 1).alias("deletes"), F.shiftright("at", RUN_BITS).alias("run"))
    rows = written(rows, "repair-classes")
    runs = written(_joined_runs(rows.select(CONV, "at", "kind", "deletes", "run")), "repair-runs")
    kept = ["turn long", "key binary", "initial string", "blank boolean", "duplicate boolean", "truncated boolean", "copies long", "kind int", "deletes long"]
    found = _inside(rows, _bounds(runs), ", ".join(kept))
    table = [[[WAYS[k] for k in row] for row in kind] for kind in ROW_EDIT.tolist()]
    way = F.get(F.get(F.get(F.lit(table), F.col("kind")), F.col("before")), F.col("after"))
    tail = F.when(F.col("last"), F.get(F.lit(list(TAIL)), F.col("after"))).otherwise(0)
    return found.select(CONV, "at", TURN, "key", "initial", "blank", "duplicate", "truncated", "copies", way.alias("edit"), "deletes", tail.alias("tail"), "before", "after")


def _with_texts(rows: DataFrame, edits: DataFrame, by: str, ids: DataFrame | None = None) -> DataFrame:
    """Edits with the role and text of their rows; the texts move once, to where `by` says. ids: conversations (conv_id) that get an empty row besides."""
    whole = F.struct(*(c for c in edits.columns if c not in (CONV, "key"))).alias("own")
    left = edits.select(CONV, "key", whole, F.lit(None).cast("string").alias(ROLE), F.lit(None).cast("string").alias(TEXT))
    right = rows.select(CONV, _digest(CONV, TURN, ROLE, TEXT).alias("key"), F.lit(None).cast(left.schema["own"].dataType).alias("own"), ROLE, TEXT)
    both = left.union(right)
    if ids is not None:
        both = both.union(ids.select(F.col(CONV).cast("long")).distinct().select(CONV, *(F.lit(None).cast(both.schema[c].dataType) for c in both.columns[1:])))
    both = both.repartition(by).groupBy(CONV, "key").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("own", ROLE, TEXT)))
    return both.select(CONV, "key", "own.*", ROLE, TEXT)


def said_by(way: str, before: int, role: str, tail: int, after: int) -> tuple[list[str], int | None, list[str]]:
    """Roles of what a row becomes: of rows put in before it and of itself, the place of its own text among them (None if it goes), and roles put in at the end."""
    roles, at, end = [], before, []
    for c in way:
        if c == "I":
            at = ADDS[at]
            roles.append(NAMES[at])
        elif c == "R":
            roles.append(NAMES[ADDS[at]])
        elif c == "K":
            roles.append(role)
    for _ in range(tail):
        after = ADDS[after]
        end.append(NAMES[after])
    return roles, (None if way[-1] == "D" else len(roles) - 1), end


def repaired_messages(conversations: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, at, part, role, text) in the order of (at, part), with empty texts for rows put in."""
    small_batches(conversations.sparkSession)
    rows = canonical(conversations)
    edits = edits_of(conversations) if edits is None else edits
    whole = _with_texts(rows, edits, "key").select(CONV, "at", "edit", "before", "after", "tail", ROLE, TEXT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, at, way, before, after, tail, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                roles, own, end = said_by(way, before, role, tail, after)
                out += [(conv, at, k, r, text if k == own else "") for k, r in enumerate(roles + end)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=[CONV, "at", "part", ROLE, TEXT])

    return whole.mapInArrow(apply, f"{CONV} long, at long, part int, {ROLE} string, {TEXT} string")


#: Adjacent initials that a whole conversation may have.
LEGAL = {"su", "ua", "au"}
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is told of one conversation, row by row."""

    def __init__(self) -> None:
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.hash, self.first = hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def row(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool, copies: int, edit: str, deletes: int, tail: int, before: int, after: int, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        more = copies - 1
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies if duplicate else more
        fresh = not blank and not duplicate
        self.truncated += fresh and truncated
        self.illegal += more + (self.initial is not None and self.initial + initial not in LEGAL)
        self.initial = initial
        self.cost += sum(COST[c] for c in edit) + COST["D"] * deletes + COST["I"] * tail + (truncated and edit[-1] != "D")
        self.audit += [edit, "D" * deletes, "I" * tail]
        roles, own, end = said_by(edit, before, role, tail, after)
        for k, r in enumerate(roles + end):
            self.say(r, text if k == own else "")

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digests(conversations: DataFrame, edits: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """DIGESTS of each conversation, and of those in ids (conv_id) that have no rows."""
    small_batches(conversations.sparkSession)
    edits = edits_of(conversations) if edits is None else edits
    names = [TURN, "initial", "blank", "duplicate", "truncated", "copies", "edit", "deletes", "tail", "before", "after", ROLE, TEXT]
    whole = _with_texts(canonical(conversations), edits, CONV, ids).select(CONV, "at", *names)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in DIGESTS.split(", ")])

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for this, at, *row in zip(*columns, strict=True):
                if own is None or this != conv:
                    if own is not None:
                        done.append((conv, *own.told()))
                    conv, own = this, _Conversation()
                if at is not None:
                    own.row(*row)
            if done:
                yield out(done)
        if own is not None:
            yield out([(conv, *own.told())])

    return whole.sortWithinPartitions(CONV, "at").mapInArrow(tell, DIGESTS)
