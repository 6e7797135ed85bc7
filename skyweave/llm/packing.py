"""Best-fit packing of token pieces into sequences, by large-item matching.

Each text is encoded once; the end id follows; a document longer than the
capacity is cut into full pieces after a first one that may be shorter. Only
the counts of piece lengths (at most `capacity` numbers) go to the driver. It
plans the sequences by length: pieces above a third of the capacity are
matched greedily, the longest with the longest that fits, at most two to a
sequence; shorter ones, longest first, go where they leave the least room.
The plan says for each length which ranks go to which sequences; a piece finds
its place from its rank among the pieces of its length, which Spark numbers in
salted groups.

A null text counts as empty (the end id alone); a null id stays null; repeated
rows are packed each; extra columns go; texts of any length and make are
encoded whole. Ids are those of the tokenizer file,
which takes its added tokens as whole ones wherever a text has them; the merges
are run by the ranks file of the same vocabulary.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_rows, written

_ENCODERS: dict[int, tiktoken.Encoding] = {}


def ranks_file(path: str | None = None) -> bytes:
    """The ranks of the byte-level vocabulary, about 1 MB: the same ids as byte_bpe_50k.json gives."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The tokens that the tokenizer file adds to its vocabulary, with their ids."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(ranks: bytes, added: dict[str, int]) -> tiktoken.Encoding:
    key = zlib.crc32(ranks + repr(sorted(added.items())).encode())
    if key not in _ENCODERS:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in added.values()}, special_tokens=added)
    return _ENCODERS[key]


#: The characters that the pattern calls white space; a run of so many of them would overflow its matcher.
WHITE, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 100_000
_WHITE_RUNS = re.compile(f"[{WHITE}]+")


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text. Very long runs of white space are cut out by the pattern's own rule: before another character the run without its last one is a piece, at the end all of it is."""
    runs = [m.span() for m in _WHITE_RUNS.finditer(text) if m.end() - m.start() >= LONG_RUN] if len(text) >= LONG_RUN else []
    if not runs:
        return enc.encode_to_numpy(text, allowed_special="all")
    out, at = [], 0
    for start, end in runs:
        stop = end if end == len(text) or text.startswith(tuple(enc.special_tokens_set), end) else end - 1
        out += [enc.encode_to_numpy(text[at:start], allowed_special="all"), np.array(enc._encode_single_piece(text[start:stop].encode()), np.uint32)]
        at = stop
    return np.concatenate([*out, enc.encode_to_numpy(text[at:], allowed_special="all")]).astype(np.uint32)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of that many ids: full ones, but for the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], ranks: Broadcast, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(*ranks.value)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    for batch in batches:
        rows, all_ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(enc, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                own = ids[start : start + length]
                rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes())))
                if with_ids:
                    all_ids.append(own)
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int64()))] * with_ids, names=names)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks or ranks_file(), added_tokens()))  # about 1 MB
    rows = text_rows(docs, id_col, text_col)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(lambda it: _pieces(it, sent, end_id, capacity, with_ids), schema.replace("piece int", "piece long"))


@dataclass
class Plan:
    """Runs of ranks of a length that go, one each, to consecutive sequences at one offset."""

    capacity: int
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def plan_sequences(counts: np.ndarray, capacity: int) -> Plan:
    """counts[n]: how many pieces have length n, for n from 0 to capacity."""
    plan, left, done = Plan(capacity), counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)

    def put(length: int, first: int, many: int, offset: int) -> None:
        plan.length.append(length)
        plan.rank.append(int(done[length]))
        plan.sequence.append(first)
        plan.offset.append(offset)
        done[length] += many
        left[length] -= many

    def opened(many: int) -> int:
        plan.sequences += many
        return plan.sequences - many

    smallest_large = capacity // 3 + 1
    for n in range(capacity, smallest_large - 1, -1):
        while left[n]:
            fits = np.flatnonzero(left[smallest_large : min(n, capacity - n) + 1])
            mates = [int(m) + smallest_large for m in fits[::-1][:2] if m + smallest_large < n or left[n] > 1]
            mate = mates[0] if mates else 0
            many = int(left[n] // 2 if mate == n else min(left[n], left[mate]) if mate else left[n])
            first = opened(many)
            put(n, first, many, 0)
            if mate:
                put(mate, first, many, n)
            rooms[capacity - n - mate].append((first, many))
    for n in range(smallest_large - 1, 0, -1):
        room = n
        while left[n]:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                many = int(-(-left[n] // (capacity // n)))
                first, room = opened(many), capacity
            else:
                first, many = rooms[room].pop()
            used = int(min(many, left[n]))
            put(n, first, used, capacity - room)
            if used < many:
                rooms[room].append((first + used, many - used))
            rooms[room - n].append((first, used))
            room = n if room - n >= n else room
    return plan


def ranked(pieces: DataFrame, group_rows: int = 1000) -> DataFrame:
    """With `rank`: a number from 0 for each piece among those of its length. A length is numbered in groups of about group_rows."""
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    many = pieces.groupBy("length").agg((F.floor(F.count("*") / group_rows) + 1).alias("salts"))  # a row for each length, at most as many as the capacity
    salted = pieces.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64(*keys), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)) - 1)
    return numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Columns of pieces (with a length from 1 to capacity), sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = plan_sequences(counts, capacity)
    start = np.array(plan.length, np.int64) << 40 | np.array(plan.rank, np.int64)
    order = np.argsort(start)
    sent = spark.sparkContext.broadcast((start[order], np.array(plan.sequence, np.int64)[order], np.array(plan.offset, np.int64)[order]))
    rows = ranked(pieces)
    out = [c for c in rows.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequence, offset = sent.value
        for batch in batches:
            key = batch.column("length").to_numpy() << 40 | batch.column("rank").to_numpy()
            at = np.searchsorted(starts, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(sequence[at] + key - starts[at]), pa.array(offset[at])], names=[*out, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece."""
    pieces = written(token_pieces(docs, id_col, text_col, capacity, end_id, ranks, with_ids), "packing-pieces")
    return pack(pieces, capacity).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
