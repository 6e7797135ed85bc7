"""Phrase collocations by suffix sorting: phrases of 2 to 4 words and how firmly their parts belong together.

Texts become word codes (64 bits of language and word, checked to differ for
all words of the corpus). Pairs of adjacent words are counted by hashed slots;
suffixes whose leading pair can't be frequent are abandoned before anything of
them moves. The others, at most four words each, are routed by their leading
pair, so that all suffixes that begin alike meet in one bucket. There a
multikey three-way quicksort of pointers goes down to the fourth word: the size
of an equal partition is the count of its phrase, and partitions below `least`
are abandoned. Suffixes of a pair with very many occurrences are routed by all
their words instead, and their partial counts are added up.

Two bit tables of fixed size (32 MB and 2 MB, whatever the input) tell which
slots are frequent and which very frequent; they are files that executors fetch.
Two pairs in one slot make more suffixes move, not other results. Equal
suffixes of a task are one with a weight.

A null text counts as empty and a null language as `und`; ids aren't used, so
null and repeated ids count as any row; repeated rows count each time; extra
columns go. Texts are read whole. Without frequent phrases there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_fetched, fetched, forget, small_batches, spread, task_tables, written
from .text import chunks, words

#: Longest phrase, in words.
DEPTH = 4
#: Characters that end a piece; spaces and tabs part words.
BREAKS = "[.,;:!?\n\x0b\x0c\r]+"
#: Slots of the tables of frequent and of very frequent leading pairs, as powers of two.
FREQUENT_BITS, HOT_BITS = 28, 24
#: Tokens that a task holds before it sends what it has; pairs and suffixes of a bucket.
HELD, BUCKET = 2_000_000, 2_000_000
KEY = ["c1", "c2", "c3", "c4"]


def codes_of(texts: pa.Array, langs: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Codes of all tokens of the texts in order (0 for a break; each text ends with one), their texts, and the tokens themselves."""
    spaced = pc.binary_join_element_wise(pc.replace_substring_regex(pc.fill_null(texts, ""), BREAKS, " . "), " .", "")
    flat, at = words(spaced, lower=True)
    tokens = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in tokens.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(tokens.dictionary))
    spoken = langs.dictionary_encode()
    lang = np.fromiter((xxhash.xxh3_64_intdigest(x, seed + 1) for x in spoken.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(spoken.dictionary))
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    index = tokens.indices.to_numpy()
    codes = own[index] + lang[spoken.indices.to_numpy()][row] if len(index) else np.zeros(0, np.uint64)
    end = pc.index(tokens.dictionary, ".").as_py()
    codes[index == end] = 0
    return codes, row, tokens


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 well mixed bits of two codes in this order."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x8CB92BA72F3D8DD7)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _held(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    """Codes of the texts of a task, some millions at a time."""
    parts, size = [], 0
    for batch in batches:
        for part in chunks(batch.column(1)):
            codes, _, _ = codes_of(batch.column(1)[part.start : part.stop], batch.column(0)[part.start : part.stop], seed)
            parts.append(codes)
            size += len(codes)
            if size >= HELD:
                yield np.concatenate(parts)
                parts, size = [], 0
    if size:
        yield np.concatenate(parts)


# -- words -------------------------------------------------------------------------------------


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, code, n) of every word of rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1)):
                langs = batch.column(0)[part.start : part.stop]
                codes, row, tokens = codes_of(batch.column(1)[part.start : part.stop], langs, seed)
                spoken = langs.dictionary_encode()
                both = spoken.indices.to_numpy().astype(np.int64)[row] << 32 | tokens.indices.to_numpy()
                kinds, first, n = np.unique(both, return_index=True, return_counts=True)
                word = codes[first] != 0
                kinds, first, n = kinds[word], first[word], n[word]
                columns = [spoken.dictionary.take(pa.array(kinds >> 32)), tokens.dictionary.take(pa.array(kinds & 0xFFFFFFFF)), pa.array(codes[first].view(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.string()), columns[1].cast(pa.string()), *columns[2:]], names=["lang", "word", "code", "n"])

    found = rows.mapInArrow(count, "lang string, word string, code long, n long")
    return found.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def checked_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """Word counts under codes that differ for all words, and the seed that gives them."""
    seed = 0
    while True:
        table = written(word_counts(rows, seed), "collocation-words")
        if table.where("code = 0").union(table.groupBy("code").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.lit(""), F.lit(""), "code", "n_")).isEmpty():
            return table, seed
        forget(rows.sparkSession, table)
        seed += 2


# -- leading pairs -------------------------------------------------------------------------------


def _cut(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of rows that are sorted by bucket."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        if e > s:
            yield int(bucket[s]), [c[s:e] for c in columns]


def pair_slots(rows: DataFrame, seed: int, bits: int, least: int, hot: int) -> DataFrame:
    """(bucket, frequent, very_frequent, n): of the slots with these leading bits, those with `least` and with `hot` pairs as bit strings, and how many pairs are in frequent slots.

    A slot is the next 32 bits of a pair's hash, so more buckets make more slots.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _held(batches, seed):
            there = (codes[:-1] != 0) & (codes[1:] != 0)
            slots = np.sort(pair_hash(codes[:-1][there], codes[1:][there]) >> np.uint64(32 - bits))
            first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, int)
            many = np.diff(np.append(first, len(slots))).astype("<u4")
            slots = slots[first]
            out = []
            for bucket, (slot, n) in _cut((slots >> np.uint64(32)).astype(np.int64), slots.astype("<u4"), many):
                out.append((bucket, slot[n == 1].tobytes(), slot[n > 1].tobytes(), n[n > 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "once", "more", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in task_tables(batches, "bucket"):
            once, more, times = (np.frombuffer(b"".join(own.column(c).to_pylist()), "<u4") for c in ("once", "more", "times"))
            slots, n = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), times.astype(np.int64)])
            order = np.argsort(slots, kind="stable")
            slots = slots[order]
            first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
            total = np.add.reduceat(n[order], first)
            slots = slots[first]

            def table(least: int, size: int) -> bytes:
                flags = np.zeros(1 << (size - bits), bool)
                flags[slots[total >= least] >> np.uint32(32 - (size - bits))] = True
                return np.packbits(flags).tobytes()

            frequent = total >= least
            yield pa.RecordBatch.from_arrays(
                [own.column("bucket")[:1].combine_chunks(), pa.array([table(least, FREQUENT_BITS)], pa.binary()), pa.array([table(hot, HOT_BITS)], pa.binary()), pa.array([int(total[frequent].sum())], pa.int64())],
                names=["bucket", "frequent", "very_frequent", "n"],
            )

    sent = rows.mapInArrow(count, "bucket int, once binary, more binary, times binary")
    return sent.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, frequent binary, very_frequent binary, n long")


def _tables(name: str, bits: int) -> dict[str, np.ndarray]:
    """The two bit tables of `pair_slots`, in a task."""

    def make(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out = {"frequent": np.zeros(1 << (FREQUENT_BITS - 3), np.uint8), "very_frequent": np.zeros(1 << (HOT_BITS - 3), np.uint8)}
        for batch in batches:
            for kind, table in out.items():
                width = len(table) >> bits
                for bucket, own in zip(batch.column("bucket").to_pylist(), batch.column(kind), strict=True):
                    table[bucket * width : (bucket + 1) * width] = np.frombuffer(own.as_buffer(), np.uint8)
        return out

    return fetched(name, make)


def _set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


# -- suffixes --------------------------------------------------------------------------------------


def suffixes(codes: np.ndarray, tables: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that begin with a frequent pair, cut to four words and where a pair isn't frequent (0 after the cut): distinct ones, their weights, the hash of their leading pair, and whether that is very frequent."""
    there = (codes[:-1] != 0) & (codes[1:] != 0)
    at = np.flatnonzero(there)
    hashes = pair_hash(codes[at], codes[at + 1])
    keep = _set(tables["frequent"], hashes >> np.uint64(64 - FREQUENT_BITS))
    at, hashes = at[keep], hashes[keep]
    goes_on = np.zeros(len(codes) + DEPTH, bool)
    goes_on[at] = True
    padded = np.concatenate([codes, np.zeros(DEPTH, np.uint64)])
    rows = np.empty((len(at), DEPTH), np.uint64)
    rows[:, 0], rows[:, 1] = codes[at], codes[at + 1]
    so_far = np.ones(len(at), bool)
    for k in range(2, DEPTH):
        so_far &= goes_on[at + k - 1]
        rows[:, k] = np.where(so_far, padded[at + k], 0)
    whole = pair_hash(pair_hash(hashes, rows[:, 2]), rows[:, 3])
    order = np.argsort(whole, kind="stable")
    rows, whole, hashes = rows[order], whole[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, int)
    weight = np.diff(np.append(first, len(rows))).astype("<u4")
    rows, whole, hashes = rows[first], whole[first], hashes[first]
    hot = _set(tables["very_frequent"], hashes >> np.uint64(64 - HOT_BITS))
    return rows, weight, np.where(hot, whole, hashes), hot


def three_way(rows: np.ndarray, weight: np.ndarray, least: int, partial: bool = False) -> Iterator[tuple[int, int, int]]:
    """(row, words, count) of each phrase of two words or more among the suffixes: multikey three-way quicksort of pointers.

    A partition is parted by a pivot's word at its depth into smaller, equal and
    larger; the equal one is a phrase of one more word, counted by its weight,
    and goes one word deeper. Partitions that weigh less than `least` are
    abandoned. partial: what is shorter than four words is counted elsewhere
    too, so it is told however small.
    """
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        own, depth = todo.pop()
        enough = 1 if partial and depth < DEPTH else least
        if not len(own) or weight[own].sum() < enough:
            continue
        key = rows[own, depth]
        pivot = key[len(key) // 2]
        equal = own[key == pivot]
        if len(equal) < len(own):
            todo += [(own[key < pivot], depth), (own[key > pivot], depth)]
        total = int(weight[equal].sum())
        if total < (1 if partial and depth + 1 < DEPTH else least):
            continue
        if depth:
            yield int(equal[0]), depth + 1, total
        if depth + 1 < DEPTH:
            todo.append((equal[rows[equal, depth + 1] != 0], depth + 1))


def phrase_counts(rows: DataFrame, seed: int, least: int) -> DataFrame:
    """(c1, c2, c3, c4, a) of every phrase with `least` occurrences or more; 0 where it is shorter."""
    spark = rows.sparkSession
    n = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(24, max(4, math.ceil(math.log2(n / 6 / BUCKET + 1))))
    slots = written(pair_slots(rows, seed, bits, least, BUCKET // 4), "collocation-slots")
    moved = slots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    file = spread(slots, "collocation-tables")
    route = min(24, max(4, math.ceil(math.log2(moved / BUCKET + 1))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(file, bits)
        for codes in _held(batches, seed):
            found, weight, key, hot = suffixes(codes, tables)
            bucket = (key >> np.uint64(64 - route)).astype(np.int64) + (hot.astype(np.int64) << route)
            order = np.argsort(bucket, kind="stable")
            out = [(b, r.tobytes(), w.tobytes()) for b, (r, w) in _cut(bucket[order], found[order].astype("<u8"), weight[order])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2))], names=["bucket", "suffixes", "weights"])
        del tables
        drop_fetched(file)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in task_tables(batches, "bucket"):
            found = np.frombuffer(b"".join(own.column("suffixes").to_pylist()), "<u8").reshape(-1, DEPTH)
            weight = np.frombuffer(b"".join(own.column("weights").to_pylist()), "<u4").astype(np.int64)
            out = list(three_way(found, weight, least, bool(own.column("bucket")[0].as_py() >> route)))
            at, depth, total = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            codes = np.where(np.arange(DEPTH) < depth[:, None], found[at], 0).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(codes[:, k]) for k in range(DEPTH)), pa.array(total)], names=[*KEY, "a"])

    sent = rows.mapInArrow(send, "bucket long, suffixes binary, weights binary")
    sorted_ = sent.repartition(1 << route, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, ", ".join(f"{c} long" for c in [*KEY, "a"]))
    counts = written(sorted_.groupBy(*KEY).agg(F.sum("a").alias("a")).where(F.col("a") >= least), "collocation-phrases")
    forget(spark, slots)
    return counts


# -- scores --------------------------------------------------------------------------------------------


def _part(first: int, last: int) -> F.Column:
    """The words first to last (from 1) of a phrase, as a key of four codes."""
    return F.struct(*((F.col(f"c{first + k}") if first + k <= last else F.lit(0).cast("long")).alias(f"c{k + 1}") for k in range(DEPTH)))


def _cuts(name: str, parts: dict[int, list[tuple[int, F.Column, F.Column]]]) -> F.Column:
    """An array of what `parts` gives for a phrase of 2, 3 or 4 words: (k, left, right)."""
    made = {size: F.array(*(F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right")) for k, left, right in own)) for size, own in parts.items()}
    return F.when(F.col("c3") == 0, made[2]).when(F.col("c4") == 0, made[3]).otherwise(made[4]).alias(name)


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases with l, r and score of their lowest-scoring cut. counts: (KEY, f) of all phrases and words. Products are exact decimals."""
    cuts = {size: [(k, _part(1, k), _part(k + 1, size)) for k in range(1, size)] for size in (2, 3, 4)}
    rows = phrases.select(*KEY, "a", F.explode(_cuts("cut", cuts)).alias("cut")).select(*KEY, "a", "cut.*")
    known = counts.select(F.struct(*KEY).alias("part"), "f")
    rows = rows.join(known.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    rows = rows.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    return rows.groupBy(*KEY, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(*KEY, "a", "best.l", "best.r", "best.score")


def unabsorbed(phrases: DataFrame) -> DataFrame:
    """phrases without those that a longer one takes in with four fifths of their occurrences or more."""
    inside = {2: [], 3: [_part(1, 2), _part(2, 3)], 4: [_part(1, 2), _part(2, 3), _part(3, 4), _part(1, 3), _part(2, 4)]}
    longer = phrases.where("c3 <> 0").select("a", F.explode(F.when(F.col("c4") == 0, F.array(*inside[3])).otherwise(F.array(*inside[4]))).alias("inner"))
    most = longer.groupBy("inner").agg(F.max("a").alias("most")).select("inner.*", "most")
    kept = F.coalesce(F.expr("CAST(most AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80"), F.lit(True))
    return phrases.join(most, KEY, "left").where(kept).drop("most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score.

    a: occurrences of the phrase; l and r: of the two parts of its
    lowest-scoring cut; n: words of the language; score: floor(2000000 a / (l + r)).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table, seed = checked_words(rows)
    phrases = phrase_counts(rows, seed, least)
    zero = F.lit(0).cast("long")
    frequent = table.where(F.col("n") >= least)
    counts = phrases.withColumnRenamed("a", "f").union(frequent.select("code", zero, zero, zero, "n"))
    found = scored(unabsorbed(phrases), counts)
    names = frequent.select("code", "word")
    found = found.join(frequent.select(F.col("code").alias("c1"), "lang", F.col("word").alias("w1")), "c1")
    for k in range(2, DEPTH + 1):
        found = found.join(names.toDF(f"c{k}", f"w{k}"), f"c{k}", "left")
    found = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "a", "l", "r", "score")
    found = written(found, "collocation-scores")
    # the best of salted groups first, so that no task sorts a whole language
    salts = found.count() // 100_000 + 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
