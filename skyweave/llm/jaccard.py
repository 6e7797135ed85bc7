"""Exact n-gram Jaccard join by signature trees.

1. A text's set is its distinct word shingles, hashed to 64 bits; equal sets
   (by a digest of 128 bits of the sorted hashes) are one node from then on.
2. Two sets of similarity >= t share a token among the |x| - ceil(t|x|) + 1
   first of each, under any one order of tokens. Tokens that only one set has
   come first in that order and tokens that many sets have come last, by
   counts of hash slots, at least as many as there are tokens, so few sets meet
   by accident. The counts are files that executors fetch from the shared
   folder and read a part at a time, so no task holds them whole. Sets that
   meet inside a chunk of texts are linked there; a window over the tokens
   links the chunks. A token that many sets have is dealt to windows of a
   bounded size, and their first sets to one more. The components of these
   meetings are cells: similar sets share a cell.
3. Each cell's sets are compared by signature trees. A node has the OR of its
   members' token bitmaps, their range of sizes and the most tokens that a
   member has above its set bits. Two trees are walked together; a pair of
   nodes goes on only if its largest possible overlap is enough. Pairs of
   sets that stay are compared exactly, unless already linked to each other.
   A large cell is split into size bands and blocks, and pairs of blocks are
   compared in tasks of their own.
4. The components of the links are the groups.

Nulls and empty texts have no set and link with nothing. A null id gets its
size, but no component, and links nothing. Rows that repeat an id with another
text are rows of their own; a group's id is the smallest id in it. Extra
columns go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_fetched, fetched, forget, spread, spread_parts, task_tables, text_rows, written
from .text import chunks, words

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK_TOKENS = 1_000_000
FAN = 8


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text in order, and where each set begins."""
    flat, at = words(texts, lower=True)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    w = pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    lengths = np.diff(at)
    full = np.zeros(max(len(w) - size + 1, 0), np.uint64)
    for k in range(size if len(full) else 0):
        full = full * MULTIPLIER + w[k : len(w) - size + 1 + k]
    full = mixed(full).view(np.int64)
    out, ends = [], [0]
    for i in range(len(texts)):
        a, n = at[i], lengths[i]
        if n >= size:
            own = np.sort(full[a : a + n - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in w[a : a + n]:
                    h = h * MULTIPLIER + x
                own = mixed(np.array([h + MULTIPLIER])).view(np.int64)
        else:
            own = full[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else full[:0]), np.array(ends)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """The two halves of each set's digest of 128 bits, as two rows of int64."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(raw, "<i8").reshape(-1, 2).T.astype(np.int64)


def split(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


SEGMENTS = 256
#: Slots are the low bits of tokens, so many or, where there are fewer slots, the first of these.
SLOT_BITS = 34
LEAST_SLOTS = 1 << 28
#: A task that looks counts up holds those of so many slots at a time.
PART_SLOTS = 1 << 20
GROUP = 32
#: Tokens whose counts are looked up in one reading of the files.
LOOKUP_TOKENS = 1_000_000
COLUMNS = ["doc_id", "n", "half", "rest", "segment", "slots"]
SCHEMA = "doc_id long, n long, half long, rest long, segment int, slots binary"


def slots_for(n_tokens: int) -> int:
    """As many slots as there are tokens or more: with fewer most tokens would seem shared, and unlike sets would meet by them."""
    return min(max(LEAST_SLOTS, 1 << n_tokens.bit_length()), 1 << SLOT_BITS)


def slot_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (tokens & ((1 << SLOT_BITS) - 1)) >> (SLOT_BITS + 1 - slots.bit_length())


def part_slots(slots: int) -> int:
    return min(PART_SLOTS, slots // SEGMENTS)


def _slot_rows(tokens: list[np.ndarray]) -> pa.RecordBatch:
    """The tokens' finest slots, packed by segment: gaps between sorted places, compressed."""
    flat = np.sort(slot_of(np.concatenate(tokens), 1 << SLOT_BITS))
    width = (1 << SLOT_BITS) // SEGMENTS
    cuts = np.searchsorted(flat, np.arange(SEGMENTS + 1) * width)
    packed = [zlib.compress(np.diff(flat[i:j], prepend=k * width).astype(np.uint32).tobytes(), 1) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    none = pa.nulls(SEGMENTS, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], names=COLUMNS)


def _sets_and_slots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, half, rest), and rows (segment, slots) of all tokens."""
    held: list[np.ndarray] = []
    for batch in batches:
        for part in chunks(batch.column(1)):
            tokens, at = shingle_sets(batch.column(1)[part.start : part.stop], size)
            n = np.diff(at)
            half, rest = digests(split(tokens, at))
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(n, pa.int64()), pa.array(half, mask=n == 0), pa.array(rest, mask=n == 0), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=COLUMNS)
            held.append(tokens)
            if sum(map(len, held)) > 1_000_000:
                yield _slot_rows(held)
                held = []
    if held:
        yield _slot_rows(held)


def _slot_counts(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """(part, bits, levels): the slots that are hit twice or more, and for each group of slots the log of its most hits."""
    width, shift = part_slots(slots), SLOT_BITS + 1 - slots.bit_length()
    for rows in task_tables(batches, "segment"):
        hits = np.zeros(slots // SEGMENTS, np.uint32)
        for packed in rows["slots"]:
            np.add.at(hits, np.cumsum(np.frombuffer(zlib.decompress(packed.as_py()), np.uint32), dtype=np.int64) >> shift, 1)
        first = rows["segment"][0].as_py() * (len(hits) // width)
        for k, own in enumerate(hits.reshape(-1, width)):
            levels = np.minimum(4 * np.log2(np.maximum(own.reshape(-1, GROUP).max(axis=1), 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([np.packbits(own > 1, bitorder="little").tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary())], names=["part", "bits", "levels"])


def looked_up(tokens: np.ndarray, files: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token whether its slot is hit twice or more, and the level of its slot's group."""
    width, slot = part_slots(slots), slot_of(tokens, slots)
    order = np.argsort(slot)
    place = slot[order]
    cuts = np.searchsorted(place, np.arange(slots // width + 1) * width)
    shared, level = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.uint8)
    for name in files:
        with pq.ParquetFile(SparkFiles.get(name), pre_buffer=False, buffer_size=1 << 20) as table:
            for batch in table.iter_batches(batch_size=16, use_threads=False):
                for k, bits, levels in zip(batch.column("part").to_pylist(), batch.column("bits"), batch.column("levels"), strict=True):
                    own, at = order[cuts[k] : cuts[k + 1]], place[cuts[k] : cuts[k + 1]] - k * width
                    shared[own] = (np.frombuffer(bits.as_buffer(), np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    level[own] = np.frombuffer(levels.as_buffer(), np.uint8)[at // GROUP]
    return shared, level


def prefixes(n: np.ndarray, shared: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of prefix tokens that other sets may have too, and the index of each one's set. n: sizes of sets, whose tokens stand one after another.

    The order of tokens: those that no other set has (by shared; a wrong one
    only costs work), then the others by how many sets have them (about, by
    levels) and by hash. Tokens of the first kind meet nobody and go.
    """
    owner = np.repeat(np.arange(len(n)), n)
    own_shared = np.bincount(owner[shared], minlength=len(n))
    p = np.where(n > 0, prefix_length(n, percent) - (n - own_shared), 0)  # under 1: too few shared tokens for any link
    place = np.flatnonzero(shared & (p > 0)[owner])
    owner = owner[place]
    order = np.argsort(owner * 256 + levels[place], kind="stable")
    place, owner = place[order], owner[order]
    begin = np.concatenate([[0], np.cumsum(np.where(p > 0, own_shared, 0))])
    take = np.arange(len(place)) - begin[owner] < p[owner]
    return place[take], owner[take]


#: About how many sets with a token go to one window.
SALT_SETS = 4096


def _meetings(batches: Iterator[pa.RecordBatch], size: int, percent: int, files: list[str], slots: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, salts, node): one for each prefix token and chunk; rows (node, other): sets of a chunk that meet by a token. salts: over how many windows the token's rows are dealt."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in chunks(batch.column(1)):
            tokens, at = shingle_sets(batch.column(1)[part.start : part.stop], size)
            held.append((tokens, np.diff(at), digests(split(tokens, at))[0]))  # sets of equal halves only share a cell
            if sum(len(tokens) for tokens, _, _ in held) >= LOOKUP_TOKENS:
                yield from _met(held, percent, files, slots)
                held = []
    if held:
        yield from _met(held, percent, files, slots)


def _met(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], percent: int, files: list[str], slots: int) -> Iterator[pa.RecordBatch]:
    names = ["token", "salts", "node", "other"]
    tokens, n, node = (np.concatenate(x) for x in zip(*held, strict=True))
    _, first = np.unique(node, return_index=True)  # equal sets count once
    once = np.zeros(len(node), bool)
    once[first] = True
    shared, levels = looked_up(tokens, files, slots)
    place, owner = prefixes(n, shared, levels, percent)
    place, own = place[once[owner]], node[owner[once[owner]]]
    token, level = tokens[place], levels[place]
    order = np.lexsort((own, token))
    token, level, own = token[order], level[order], own[order]
    head = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    star = own[head][np.cumsum(head) - 1] if len(token) else own
    a, b = np.unique(np.stack([star[~head], own[~head]]), axis=1) if (~head).any() else (own[:0], own[:0])
    token, level, own = token[head], level[head], own[head]
    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array((2.0 ** (level / 4) // SALT_SETS).astype(np.int64) + 1), pa.array(own), pa.nulls(len(own), pa.int64())], names=names)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=names)


class Tree:
    """Levels of a signature tree over sets sorted by size; level 0 holds the sets."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.array([len(s) for s in sets])
        self.order = np.lexsort(([s[0] for s in sets], n))
        self.sets = [sets[i] for i in self.order]
        n = n[self.order]
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(self.sets):
            place = s & (bits - 1)
            np.bitwise_or.at(maps[i], place >> 3, (1 << (place & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        spare = n - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, n, n, spare)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a similar pair, by sizes and by the largest possible overlap."""
    (maps_a, low_a, high_a, spare_a), (maps_b, low_b, high_b, spare_b) = a, b
    keep = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    at = np.flatnonzero(keep)
    step = max(1, 8_000_000 // maps_a.shape[1] // 8)
    for k in range(0, len(at), step):
        p, q = i[at[k : k + step]], j[at[k : k + step]]
        overlap = np.bitwise_count(maps_a[p] & maps_b[q]).sum(axis=1) + np.minimum(spare_a[p], spare_b[q])
        # 100 o >= percent (x + y - o), for the smallest sizes of both
        keep[at[k : k + step]] = (100 + percent) * overlap >= percent * (low_a[p] + low_b[q])
    return keep


def dual_walk(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (places in the trees) that no node pair could rule out; a is b: each pair once."""
    same = a is b
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, int), np.zeros(1, int)
    while True:
        keep = _possible(a.levels[level_a], b.levels[level_b], i, j, percent)
        i, j = i[keep], j[keep]
        if level_a == level_b == 0 or not len(i):
            return i, j
        step_a, step_b = level_a >= level_b and level_a > 0, level_b >= level_a and level_b > 0
        if step_a:
            level_a -= 1
            i, j = (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN)
            ok = i < len(a.levels[level_a][1])
            i, j = i[ok], j[ok]
        if step_b:
            level_b -= 1
            i, j = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
            ok = j < len(b.levels[level_b][1])
            i, j = i[ok], j[ok]
        if same:
            ok = i < j if level_a == 0 else i <= j
            i, j = i[ok], j[ok]


def similar_links(nodes_a: list[int], sets_a: list[np.ndarray], nodes_b: list[int] | None, sets_b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A forest that links what pairs of similar sets link, within one list or across two."""
    bits = 1024
    while bits < 4 * max(map(len, sets_a + (sets_b or []))) and bits < 1 << 16:
        bits *= 2
    a = Tree(sets_a, bits)
    b = a if sets_b is None else Tree(sets_b, bits)
    name_a = [nodes_a[i] for i in a.order]
    name_b = name_a if sets_b is None else [nodes_b[i] for i in b.order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    links = []
    i, j = dual_walk(a, b, percent)
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        u, v = find(name_a[p]), find(name_b[q])
        if u == v:
            continue
        x, y = a.sets[p], b.sets[q]
        both = np.concatenate([x, y])
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        if 100 * inter >= percent * (len(x) + len(y) - inter):
            root[max(u, v)] = min(u, v)
            links.append((name_a[p], name_b[q]))
    return links


def _compare(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by task and side; a task's rows may go over several batches."""
    held: list[pd.DataFrame] = []

    def done(parts: list[pd.DataFrame]) -> list[tuple[int, int]]:
        pdf = pd.concat(parts) if len(parts) > 1 else parts[0]
        links = []
        starts = np.flatnonzero(np.concatenate([[True], pdf["task"].to_numpy()[1:] != pdf["task"].to_numpy()[:-1]]))
        nodes, sides, raw = pdf["node"].tolist(), pdf["side"].to_numpy(), pdf["tokens"].tolist()
        for s, e in zip(starts, [*starts[1:], len(pdf)], strict=True):
            cut = s + int((sides[s:e] == 0).sum())
            sets = [np.frombuffer(x, np.int64) for x in raw[s:e]]
            if cut == e:
                links += similar_links(nodes[s:e], sets, None, None, percent) if e - s > 1 else []
            elif cut > s:
                links += similar_links(nodes[s:cut], sets[: cut - s], nodes[cut:e], sets[cut - s :], percent)
        return links

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        task = pdf["task"].to_numpy()
        if held[0]["task"].iloc[0] == task[-1]:
            continue
        last = len(task) - int((task == task[-1]).sum())
        rest = held.pop()
        parts = [*held, rest.iloc[:last]]
        held = [rest.iloc[last:]]
        links = done([p for p in parts if len(p)])
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])
    if held and (links := done(held)):
        yield pd.DataFrame(links, columns=["a", "b"])


def _set_rows(batches: Iterator[pa.RecordBatch], size: int, mask: str, bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, half, rest, tokens) of the rows whose id may be wanted; mask: bits of hashed ids, of a fixed number."""

    def filled(found: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out = np.zeros(bits // 64, np.int64)
        for batch in found:
            out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
        return {"wanted": out.view(np.uint8)}

    wanted = fetched(mask, filled, 50_000)["wanted"]
    for batch in batches:
        ids = pc.fill_null(batch.column(0), 0).to_numpy()
        place = id_place(ids, len(wanted) * 8)
        hit = (wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        batch = batch.filter(pc.and_(pa.array(hit), pc.is_valid(batch.column(0))))
        for part in chunks(batch.column(1)):
            tokens, at = shingle_sets(batch.column(1)[part.start : part.stop], size)
            own = split(tokens, at)
            half, rest = digests(own)
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(half), pa.array(rest), pa.array([t.tobytes() for t in own], pa.binary())], names=["doc_id", "half", "rest", "tokens"])
    del wanted
    drop_fetched(mask)


def id_place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, slots: int | None = None, filter_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the smallest id reachable by pairs with 100 * overlap >= percent * union."""
    rows = text_rows(docs, id_col, text_col)
    found = written(rows.mapInArrow(lambda it: _sets_and_slots(it, size), SCHEMA), "jaccard-sets")
    if slots is None:
        slots = slots_for(found.agg(F.sum("n")).first()[0] or 0)
    sets = found.where("n is not null").select("doc_id", "n", "half", "rest")
    with_id = sets.where("doc_id is not null and half is not null")

    # a bit for each hash slot and a byte for each group of slots
    packed = found.where("segment is not null").select("segment", "slots").repartition("segment").sortWithinPartitions("segment")
    counted = spread_parts(packed.mapInArrow(lambda it: _slot_counts(it, slots), "part int, bits binary, levels binary"), "jaccard-slots")
    met = rows.where("doc_id is not null").mapInArrow(lambda it: _meetings(it, size, percent, counted, slots), "token long, salts long, node long, other long")
    edges = written(linked_by_tokens(met), "jaccard-meetings")
    heads = edges.where("other is null")
    met_heads = heads.select("node", F.lag("node").over(Window.partitionBy("token").orderBy("node")).alias("other")).where("other <> node")
    both = edges.where("other is not null").select("node", "other").union(met_heads)
    cells = written(components(both.toDF("a", "b"), "jaccard-cells").toDF("half", "cell"), "jaccard-cells")

    # one row of each candidate set, whose tokens are made again from its text; its number is fixed as it is written
    keepers = with_id.join(cells, "half").groupBy("half", "rest", "cell").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    keepers = written(keepers.withColumn("node", F.monotonically_increasing_id()), "jaccard-keepers")
    bits = keepers.select("doc_id").mapInPandas(lambda it: _bits(it, filter_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    mask = spread(bits, "jaccard-wanted")
    again = rows.mapInArrow(lambda it: _set_rows(it, size, mask, filter_bits), "doc_id long, half long, rest long, tokens binary")

    # bands of sizes: similar sets are in the same band or in bands next to each other
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9)
    # sums are written before they are joined to the rows that they sum: so Spark can split the rows of a large cell
    weights = written(keepers.groupBy("cell").agg(F.sum("n").alias("cell_n")), "jaccard-weights")
    placed = keepers.join(weights, "cell").select("node", "half", "rest", "cell", "doc_id", F.when(F.col("cell_n") <= BLOCK_TOKENS, -9).otherwise(band).cast("int").alias("band"), "n")
    blocks = placed.groupBy("cell", "band").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    blocks = blocks.join(blocks.select("cell", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")), ["cell", "band"], "left").join(blocks.select("cell", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), ["cell", "band"], "left")
    blocks = written(blocks, "jaccard-blocks")
    placed = placed.join(blocks, ["cell", "band"]).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    # tasks of a block: (own band, lower block, higher block), and with each block of the bands above and below
    tasks = F.expr("""concat(
        transform(sequence(0, blocks - 1), k -> named_struct('band', band, 'p', least(k, block), 'q', greatest(k, block), 'side', if(k < block, 1, 0), 'next', 0)),
        if(above is null or band < 0, array(), transform(sequence(0, coalesce(above, 1) - 1), k -> named_struct('band', band, 'p', block, 'q', k, 'side', 0, 'next', 1))),
        if(below is null or band < 0, array(), transform(sequence(0, coalesce(below, 1) - 1), k -> named_struct('band', band - 1, 'p', k, 'q', block, 'side', 1, 'next', 1))))""")
    work = placed.select("node", "half", "rest", "doc_id", "cell", F.explode(tasks).alias("t")).select("node", "half", "rest", "doc_id", F.xxhash64("cell", "t.band", "t.p", "t.q", "t.next").alias("task"), "t.side")
    joined = again.join(work, ["doc_id", "half", "rest"]).select("task", "side", "node", "tokens").repartition("task").sortWithinPartitions("task", "side")
    # written first: a task with two Python steps, one on the other, holds two workers, and each of them lives on
    links = written(joined.mapInPandas(lambda it: _compare(it, percent), "a long, b long"), "jaccard-similar")
    groups = components(links, "jaccard-links").toDF("node", "group")
    linked = written(keepers.select("node", "half", "rest").join(groups, "node").select("half", "rest", "group"), "jaccard-linked")

    # a group is known by the number of its first node, or by the digest of a set that links with no other
    known = sets.join(linked, ["half", "rest"], "left").select("doc_id", "n", F.col("group").isNotNull().alias("many"), F.coalesce("group", "half").alias("group"), F.when(F.col("group").isNull(), F.col("rest")).otherwise(0).alias("part"))
    known = written(known, "jaccard-groups")
    keys = ["many", "group", "part"]
    low = known.where("group is not null and part is not null").groupBy(*keys).agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    low = written(low, "jaccard-lowest")
    forget(docs.sparkSession, found, edges, cells, keepers, weights, blocks, links, linked)
    out = known.join(low, keys, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


def linked_by_tokens(met: DataFrame) -> DataFrame:
    """(token, node, other) of met: each node with the one before it that has its token. Of a token with several windows, the first node of each comes without another."""
    # rows of a chunk's own links have no token: each is a window of its own
    rows = met.select(F.coalesce("token", F.xxhash64("node", "other")).alias("token"), F.coalesce("salts", F.lit(1)).alias("salts"), "node", "other")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    before = F.lag("node").over(Window.partitionBy("token", "salt").orderBy("node"))
    return rows.select("token", "salts", "node", F.coalesce("other", before).alias("other")).where("other <> node or other is null and salts > 1").drop("salts")


def _bits(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        place = id_place(pdf["doc_id"].to_numpy(), bits)
        yield pd.DataFrame({"word": place >> 6, "bits": np.left_shift(np.int64(1), place & 63)}).groupby("word", as_index=False)["bits"].agg(np.bitwise_or.reduce) if len(pdf) else pd.DataFrame({"word": place, "bits": place})


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, but for those whose id isn't the smallest of its group; null ids stay."""
    found = jaccard_groups(docs, id_col, text_col, size, percent)
    go = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(go, id_col, "left_anti").select(*docs.columns)
