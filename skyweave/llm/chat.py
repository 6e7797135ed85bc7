"""Chat formatting of reply trees: each chosen root-to-leaf path becomes one conversation with a loss mask.

Messages name the message they reply to. Self-joins that double what each
message knows (who stands 1, 2, 4, ... replies above it) find the root, depth
and summed score of every message in as many joins as the logarithm of the
longest path. Branches are ranked by score at each leaf; the best `paths` of a
tree are chosen, and the doubled links, taken from the longest to the shortest,
list the messages of each chosen path.

The template marks a turn as `<|im_start|>role`, a line end, the text and
`<|im_end|>` with a line end. In roles and texts a `<` before a `|` gets a
backslash after it, and so does one that has backslashes there already;
reading back takes one away. Roles write line ends and backslashes as escapes.
So no text can open or close a turn, whatever it says.

A conversation is one row, or several in order where it has over `most`
characters. Texts move once, to the task of their tree, which holds a turn and
a part at a time. A null text or role counts as empty and a null score as 0; a
null tree is one tree; a null id is a message of its own without replies; rows
that repeat an id of a tree are one message (the one of the best score, then role);
a reply to what isn't there is a root; so is each message in or below a circle
of replies. Extra columns go. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

START, END = "<|im_start|>", "<|im_end|>"
#: What the loss is taken over.
ANSWERS = "assistant"
PARTS = "tree long, path long, part int, text string, n_turns int, loss array<struct<start: int, end: int>>"


# -- paths ------------------------------------------------------------------------------------------


def doubled(links: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Tables of links (id, up) over 1, 2, 4, ... replies, (id, depth, total) of every message, and the links that were used.

    links: (tree, id, up, score) with unique ids; up is null at roots. What has
    a link still after as many rounds as the number of messages has bits lies
    in or below a circle of replies, and becomes a root.
    """
    bits = links.count().bit_length()
    state = written(links.select("id", "up", F.lit(0).alias("depth"), F.col("score").alias("total")), "chat-links")
    levels: list[DataFrame] = []
    while not (going := state.where("up IS NOT NULL")).isEmpty():
        if len(levels) > bits:
            alone = going.select("id", F.lit(True).alias("alone"))
            cut = links.join(alone, "id", "left").select("tree", "id", F.when(F.col("alone").isNull(), F.col("up")).alias("up"), "score")
            return doubled(written(cut, "chat-messages"))
        levels.append(going.select("id", "up"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("higher"), F.col("total").alias("more"))
        # what has no link any more knows its whole way to the root
        depth = F.when(F.col("next").isNull(), F.col("higher") + (1 << len(levels) - 1)).otherwise(0).cast("int")
        moved = going.join(above, "up").select("id", F.col("next").alias("up"), depth.alias("depth"), (F.col("total") + F.col("more")).alias("total"))
        state = written(state.where("up IS NULL").unionByName(moved), "chat-links")
    return levels, state.select("id", "depth", "total"), links


def choose_paths(links: DataFrame, paths: int | None = 1) -> DataFrame:
    """(tree, path, place, id) of the messages of the chosen paths.

    links: (tree, id, up, score), ids unique longs, up null or one of them. A
    path is known by its leaf and scores the sum of its messages; equal sums go
    by the leaf's id. paths: how many of each tree (None: all).
    """
    levels, found, links = doubled(links)
    leaves = links.join(links.select(F.col("up").alias("id")), "id", "left_anti").select("tree", "id").join(found, "id")
    if paths is not None:
        # the best of salted groups first: a tree may have very many leaves
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), F.asc("id")))
        best = leaves.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", rank("tree", "salt")).where(F.col("rank") <= paths)
        leaves = best.withColumn("rank", rank("tree")).where(F.col("rank") <= paths)
    chosen = leaves.select("tree", F.col("id").alias("path"), F.col("depth").alias("place"), "id")
    for k in reversed(range(len(levels))):
        chosen = written(chosen, "chat-paths")  # it is read twice, by each round
        above = chosen.join(levels[k], "id").select("tree", "path", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("id"))
        chosen = chosen.union(above)
    return chosen


# -- the template --------------------------------------------------------------------------------------


def escaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: F.Column) -> F.Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: DataFrame, most: int = 1_000_000) -> DataFrame:
    """PARTS of turns (tree, path, place, role, text, copies) that lie together by tree and path in order.

    A part holds whole turns, of `most` characters together at the most but for
    its first turn. loss: places of the assistants' texts in it (escaped, code
    points, ends exclusive). copies: how often the turn follows itself.
    """
    small_batches(turns.sparkSession)
    marked = turns.select("tree", "path", "copies", (F.col("role") == ANSWERS).alias("answers"), F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, held, size, n, loss, out, waiting = None, 0, [], 0, 0, [], [], 0

        def close() -> None:
            nonlocal part, held, size, n, loss, waiting
            waiting += size
            out.append((*own, part, "".join(held), n, [{"start": s, "end": e} for s, e in loss]))
            part, held, size, n, loss = part + 1, [], 0, 0, []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), span)
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["tree", "path", "part", "text", "n_turns", "loss"])

        for batch in batches:
            for tree, path, copies, answers, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (tree, path):
                    if own is not None:
                        close()
                    own, part = (tree, path), 0
                turn = f"{head}{body}{END}\n"
                for _ in range(copies):
                    if held and size + len(turn) > most:
                        close()
                    if answers:
                        loss.append((size + len(head), size + len(head) + len(body)))
                    held.append(turn)
                    size, n = size + len(turn), n + 1
                    if waiting > most:
                        yield batch_of()
                        waiting = 0
            if out:
                yield batch_of()
        if own is not None:
            close()
            yield batch_of()

    return marked.mapInArrow(join, PARTS)


def turns_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of the turns of a formatted text, by its marks; start and end are of the escaped text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        if not text.startswith(START, at) or text[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        yield unescaped_role(text[at + len(START) : line]), line + 1, end
        at = end + len(END) + 1


READ = "tree long, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, together: bool = False) -> DataFrame:
    """READ of each formatted conversation, by parsing its marks and cutting out what its loss mask covers.

    together: the parts lie as `formatted` leaves them, so nothing moves.
    """
    if not together:
        parts = parts.repartition("tree", "path").sortWithinPartitions("tree", "path", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in READ.split(", ")])

        def told() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return (*own, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            done = []
            for tree, path, _, text, _, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (tree, path):
                    if own is not None:
                        done.append(told())
                    own, state = (tree, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, s, e in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{unescaped(text[s:e])}\n".encode())
                for span in loss:
                    learnt = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
            if done:
                yield batch_of(done)
        if own is not None:
            yield batch_of([told()])

    return parts.mapInArrow(read, READ)


# -- from messages and conversations -----------------------------------------------------------------------


def _digest(*columns: str) -> F.Column:
    """A digest of 16 bytes that tells nulls and where values end."""
    parts = [x for c in columns for x in (F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.unhex(F.md5(F.concat(*parts)))


def _turns(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Turns of the chosen paths in order. texts: (tree, key, role, text); chosen: (tree, path, place, key, copies). Texts move once, by their tree."""
    null = lambda kind: F.lit(None).cast(kind)
    where = chosen.select("tree", "key", F.struct("path", "place", "copies").alias("own"), null("string").alias("role"), null("string").alias("text"))
    both = texts.select("tree", "key", null(where.schema["own"].dataType).alias("own"), "role", "text").union(where).repartition("tree")
    # places of a message follow its text
    so_far = Window.partitionBy("tree", "key").orderBy(F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.select("tree", "own", *(F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("role", "text"))).where("own IS NOT NULL")
    return met.select("tree", "own.path", "own.place", "own.copies", "role", "text").sortWithinPartitions("tree", "path", "place")


def _said(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))


def format_replies(messages: DataFrame, paths: int | None = 1, most: int = 1_000_000) -> DataFrame:
    """PARTS of the best paths of messages (tree, id, parent, role, text, score); see `choose_paths` and `formatted`."""
    rows = messages.select(F.col("tree").cast("long").alias("tree"), *(F.col(c).cast("string").alias(c) for c in ("id", "parent")), "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = _said(rows, "tree", "id", "parent", "score").withColumn("key", _digest("tree", "id", "role", "text"))
    # a message without its text; of rows that repeat an id the first
    named = F.when(F.col("id").isNull(), _digest("tree", "role", "text")).otherwise(_digest("tree", "id"))
    narrow = rows.select("tree", named.alias("name"), F.when(F.col("parent").isNotNull(), _digest("tree", "parent")).alias("reply_to"), F.struct((-F.col("score")).alias("worse"), F.substring("role", 1, 64).alias("role"), "key").alias("rank"))
    first = narrow.groupBy("tree", "name").agg(F.min(F.struct("rank", "reply_to")).alias("first")).select("tree", "name", "first.rank.key", (-F.col("first.rank.worse")).alias("score"), "first.reply_to")
    first = written(first.withColumn("id", F.monotonically_increasing_id()), "chat-first")
    links = first.join(first.select(F.col("name").alias("reply_to"), F.col("id").alias("up")), "reply_to", "left").select("tree", "id", "up", "score")
    chosen = choose_paths(written(links, "chat-messages"), paths).join(first.select("id", "key"), "id")
    return formatted(_turns(rows, chosen.select("tree", "path", "place", "key", F.lit(1).cast("long").alias("copies"))), most)


def format_conversations(conversations: DataFrame, most: int = 1_000_000) -> DataFrame:
    """PARTS of conversations (conv_id, turn, role, text): each row replies to the one before it by turn, so a conversation is a tree of one path.

    Null turns come first; rows of one turn come in the order of a digest, equal
    ones side by side (they are one message with a count).
    """
    rows = _said(conversations, F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn")).withColumn("key", _digest("tree", "turn", "role", "text"))
    order = ["tree", "turn", "key"]
    narrow = rows.groupBy(*order).agg(F.count("*").alias("copies")).repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = written(narrow.select("tree", "key", "copies", F.monotonically_increasing_id().alias("id")), "chat-rows")
    # the row before: in the same task's range, or the last of the conversation in an earlier range
    task = narrow.withColumn("task", F.shiftright("id", 33))
    ranges = task.groupBy("tree", "task").agg(F.max("id").alias("last"))
    ranges = ranges.select("tree", "task", F.lag("last").over(Window.partitionBy("tree").orderBy("task")).alias("earlier")).where("earlier IS NOT NULL")
    task = task.withColumn("up", F.lag("id").over(Window.partitionBy("tree", "task").orderBy("id"))).alias("t")
    here = F.col("t.tree").eqNullSafe(F.col("r.tree")) & (F.col("t.task") == F.col("r.task"))
    links = task.join(ranges.alias("r"), here, "left").select("t.tree", "id", F.coalesce("up", "earlier").alias("up"), F.lit(0.0).alias("score"))
    chosen = choose_paths(written(links, "chat-messages")).join(narrow.select("id", "key", "copies"), "id")
    return formatted(_turns(rows, chosen.select("tree", "path", "place", "key", "copies")), most)
