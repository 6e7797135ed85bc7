"""A hierarchical Pitman-Yor model of words, for perplexity.

Word and pair counts cover all training texts. Every context (the word before)
has a restaurant that seats every pair seen with it; all context restaurants
share one parent over all words, whose base is uniform over the words seen and
one unseen word. Nothing depends on the size of the input: words, pairs and
their seats are Spark tables, met by joins, and only sums reach the driver.

Words are known by 64-bit digests, and pairs by 64-bit digests of these when
texts are scored. Pairs and words with one customer have one table whatever is
drawn, so the sweeps pass over the others only and count these.

Most distinct pairs occur once. Their probability needs nothing but what their
context and their word have, so only counts are kept of them; a text's pairs
count as such first, and those with more customers correct that when the table
of pairs meets the texts. Values of common words (a list of at most `hot_words`
that a sample of texts gives) and the pairs that occur most (at most
`hot_pairs`) are files that executors fetch. Pairs with a word that isn't on the
list are rows of the table of pairs, whatever their count. Which words and pairs
these files hold changes what is moved, not what a text scores.

Seating is sampled by Gibbs sweeps. A round brings each pair the parent's
predictive probability and the tables of its context, then sweeps over the
restaurants of a task several times: a restaurant's dishes take turns, one
after another up to TURNS dishes, else a TURNS-th of them at a time, and each
is drawn given the tables of all others as they are by then. The parent's
tables are drawn after each round in the same way. Up to EXACT customers a
dish's conditional is exact, by generalised Stirling numbers; for more
customers their seating is followed in blocks that grow by an eighth and its
number of tables is drawn from the normal limit. The draws are hashes of dish
and sweep, so a task that runs again draws the same. Predictive probabilities
are averaged over the sweeps of the rounds after the first.

A null text counts as empty: its only token is the end. A null id belongs to
fold 0, so it trains unless that is held out. Repeated rows keep a row each,
and each trains. Without training texts every text has probability 1.
"""

from __future__ import annotations

import collections
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetched, forget, remainder, settings, spread, text_rows, written
from .text import chunks, words

EXACT, FEW = 64, 16
#: Dishes of so many customers are drawn together.
BANDS = ((2, 2), (3, 3), (4, 4), (5, 6), (7, 10), (11, FEW), (FEW + 1, 24), (25, 36), (37, EXACT))
CHUNK = 4_000_000


def uniform(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number in (0, 1) for each key and sweep."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(sweep + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


@lru_cache(maxsize=4)
def log_stirling(d: float) -> np.ndarray:
    """Log generalised Stirling numbers of n customers at k tables, for n and k up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0
    k = np.arange(EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(n - d * k > 0, np.log(np.maximum(n - d * k, 1e-300)) + s[n], -np.inf)
            stay[0] = -np.inf
            s[n + 1] = np.logaddexp(np.concatenate([[-np.inf], s[n, :-1]]), stay)
    return s


@lru_cache(maxsize=4)
def likelier(d: float) -> np.ndarray:
    """How much likelier k + 1 tables than k are for n customers up to FEW, before base and restaurant count; 0 for more tables than customers."""
    out = np.zeros((FEW + 1, FEW))
    for n in range(1, FEW + 1):
        out[n, 1:n] = np.exp(np.diff(log_stirling(d)[n, 1 : n + 1]))
    return out


def draw_tables(keys: np.ndarray, sweep: int, customers: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float) -> np.ndarray:
    """Tables of each dish, given the parent's probability of it and the other tables of its restaurant."""
    tables = np.ones(len(customers))
    u = uniform(keys, sweep)
    stirling = log_stirling(d)
    log_base = np.log(base)
    small = np.minimum(customers, EXACT + 1).astype(np.uint8)
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(EXACT + 2))
    for low, c in BANDS:
        for at in range(edges[low], edges[c + 1], 5_000):
            r = order[at : min(at + 5_000, edges[c + 1])]
            k = np.arange(c)
            if c <= FEW:  # without logarithms
                p = np.ones((len(r), c))
                p[:, 1:] = likelier(d)[customers[r], 1:c] * base[r, None] * (theta + d * (others[r, None] + k[1:]))
                p = np.cumsum(np.cumprod(p, axis=1), axis=1)
            else:
                logs = stirling[customers[r], 1 : c + 1] + log_base[r, None] * (k + 1) + np.cumsum(np.log(theta + d * (others[r, None] + k)), axis=1)
                p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[r] = 1 + (p < u[r, None] * p[:, -1:]).sum(axis=1)
    r = np.flatnonzero(customers > EXACT)
    if len(r):
        c, t, seated, spread = customers[r].astype(float), np.ones(len(r)), np.ones(len(r)), np.zeros(len(r))
        while (left := c - seated).any():
            block = np.minimum(left, np.maximum(1, seated // 8))
            fresh = (theta + d * (others[r] + t)) * base[r]
            p = fresh / (seated - d * t + fresh)
            t, seated, spread = t + block * p, seated + block, spread + block * p * (1 - p)
        normal = np.sqrt(-2 * np.log(u[r])) * np.cos(2 * np.pi * uniform(keys[r], sweep + 1000))
        tables[r] = np.clip(np.rint(t + normal * np.sqrt(spread)), 1, c)
    return tables


def discount(one: int, two: int) -> float:
    """From how many dishes have one customer and how many have two."""
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


# -- seats as tables --------------------------------------------------------------------------

END, BEGIN = 0, 1
BLOCK = 50_000
TURNS = 8
SHORT = 64


def _stirred(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))


def digests(found: pa.Array) -> np.ndarray:
    """64-bit digests of words; those of the end and the begin of a text are no word's. Words up to SHORT bytes are taken 8 bytes at a time."""
    if not len(found):
        return np.zeros(0, np.int64)
    found = found.cast(pa.large_binary())
    at = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = np.concatenate([np.frombuffer(found.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = at[:-1] - at[0], np.diff(at)
    h = _stirred(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rows = np.arange(len(size))
    for k in range(0, SHORT, 8):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        left = np.minimum(size[rows] - k, 8)
        lane = lanes[start[rows] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(np.uint64))
        with np.errstate(over="ignore"):
            h[rows] = _stirred((h[rows] ^ lane) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    h = h.view(np.int64)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        h[long] = pd.util.hash_array(np.array([x.hex() for x in found.take(pa.array(long)).to_pylist()], object), categorize=False).view(np.int64)
    return np.where((h == END) | (h == BEGIN), h + 2, h)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and dishes of all tokens with an end for each text, as places in the digests that come last; and each token's text."""
    flat, at = words(texts, lower=True)
    code = flat.dictionary_encode()
    names = np.concatenate([[END, BEGIN], digests(code.dictionary)])
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    dish = np.empty(len(flat) + n, np.int64)
    word = np.ones(len(dish), bool)
    word[ends] = False
    dish[word], dish[ends] = code.indices.to_numpy().astype(np.int64) + 2, END
    context = np.concatenate([[BEGIN], dish[:-1]])
    context[at[:-1] + np.arange(n)] = BEGIN
    return context, dish, np.repeat(np.arange(n), np.diff(at) + 1), names


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.view(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(27))).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n) of the words and ends of (doc_id, text, trains)."""
    for batch in batches:
        for part in chunks(batch.column(1), CHUNK):
            _, dish, _, names = coded(batch.column(1)[part.start : part.stop])
            n = np.bincount(dish, minlength=len(names))
            yield from pa.table({"w": names[n > 0], "n": n[n > 0]}).to_batches(BLOCK)


def common_words(rows: DataFrame, most: int, sample: int) -> tuple[DataFrame, list[int], float]:
    """(w) of at most `most` words that a sample of about `sample` rows has most often; those that are over a 500th of its tokens or over about 1,000,000 tokens of all rows; and about how many tokens all rows have."""
    n = rows.count()
    some = rows if n <= sample else rows.sample(False, sample / n, 7)
    counts = written(some.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-common")
    total, times = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], max(1.0, n / sample)
    heavy = [r["w"] for r in counts.where((F.col("n") * 500 > total) | (F.col("n") * times > 1_000_000)).collect()]  # under 500, or one for 1,000,000 tokens
    return counts.where(F.col("n") >= least_count(counts, most)).select("w"), heavy, total * times


def least_count(counts: DataFrame, most: int) -> int:
    """The least n that at most `most` rows reach, among whole numbers from 2 to 1000 and steps of a twentieth above."""
    step = F.expr("if(n < 1000, n, 1000 + floor(log(n / 1000) / log(1.05)))").cast("long")
    by_step = counts.where("n >= 2").groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).collect()  # under 2000 rows
    found, least = 0, 1 << 62
    for r in sorted(by_step, key=lambda r: -r["step"]):
        found += r["rows"]
        if found > most:
            break
        least = int(r["n"])
    return least


def _listed(found: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    own = [b.column("w").to_numpy() for b in found]
    return {"w": np.unique(np.concatenate([*own, [END, BEGIN]]).astype(np.int64))}


def place_of(names: np.ndarray, sorted_names: np.ndarray) -> np.ndarray:
    """Places in the sorted names, -1 for those that aren't there. They are looked up in order, which is several times as fast."""
    order = np.argsort(names)
    names = names[order]
    near = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    at = np.empty(len(names), np.int64)
    at[order] = np.where(sorted_names[near] == names, near, -1)
    return at


# -- rows of blocks -----------------------------------------------------------------------------

#: A row holds what a place has of a kind: columns of numbers, each as one value. Spark deals and sorts places; the tasks look into them.
ROW = "place int, kind int, parts array<binary>"
SEEN, SEATED, REST, WORDS, BELOW, ASKS, MORE_ASKS, ANSWER, HEAVY, SUMS, HIST, KEPT, CONTEXT, TEXT, POSTING, GAIN, KNOWN = range(17)
I4, I8, F8 = np.int32, np.int64, np.float64
#: About how many tokens of texts meet at a place.
PLACE_TOKENS = 400_000
#: Rows that Python gets at a time: a row of blocks may have 1 MB.
BATCH_ROWS = 100

#: For rows that may have 1 MB. Spark's writers look at the size of pages and row groups after 100 rows, its readers hold 4,096 rows and give Python up to 64 MB at a time.
LARGE_ROWS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4000000",
    "spark.sql.parquet.columnarReaderBatchSize": "64",
    "parquet.block.size": "8000000",
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}

Row = tuple[int, int, list[np.ndarray]]


def packed(rows: Iterable[Row], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    size = 0

    def batch() -> pa.RecordBatch:
        place, kind, parts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(kind, pa.int32()), pa.array([[x.tobytes() for x in p] for p in parts], pa.list_(pa.binary()))], names=["place", "kind", "parts"])

    for row in rows:
        held.append(row)
        size += sum(x.nbytes for x in row[2])
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def arrays(rows: list[list[pa.Buffer]], *kinds: type, first: int = 0) -> list[np.ndarray]:
    """The columns of some rows, one after another."""
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(r[k], t) for r in rows if r[k].size)]) for k, t in enumerate(kinds, first)]


def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[list[pa.Buffer]]]]]:
    """Each place with its rows by kind, from rows that are sorted by place."""
    now, found = -1, collections.defaultdict(list)
    for batch in batches:
        parts = batch.column(2)
        flat, at = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        for k, (place, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if place != now:
                if found:
                    yield now, found
                now, found = place, collections.defaultdict(list)
            found[kind].append([flat[j].as_buffer() for j in range(at[k], at[k + 1])])
    if found:
        yield now, found
    pa.default_memory_pool().release_unused()


def place_numbers(key: np.ndarray, places: int) -> np.ndarray:
    at = _stirred(key.astype(np.int64).view(np.uint64)) % np.uint64(places)
    return at.astype(np.uint16 if places < 1 << 16 else np.int32)


def wide(places: int) -> int:
    """How many places words, and texts, have: fewer and larger ones than contexts, so that fewer blocks go between them."""
    return max(8, places // 6)


def dealt(place: np.ndarray, kind: int, *columns: np.ndarray, runs: np.ndarray | None = None) -> Iterator[Row]:
    """A row for each place; runs: a column that goes first as values and how often each comes one after another."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    low = starts(place)
    high = np.append(low[1:], len(place))
    if runs is not None:
        runs = runs[order]
        new = np.concatenate([[True], runs[1:] != runs[:-1]])
        new[low] = True
        first = np.flatnonzero(new)
        values, times = runs[first], np.diff(first, append=len(place)).astype(I4)
        a, b = np.searchsorted(first, low), np.searchsorted(first, high)
    for k, (s, e) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        yield int(place[s]), kind, [*([values[a[k] : b[k]], times[a[k] : b[k]]] if runs is not None else []), *(c[s:e] for c in columns)]


def met(df: DataFrame) -> DataFrame:
    """Rows of a place come one after another, in one task."""
    return df.repartition("place").sortWithinPartitions("place")


def of_kind(df: DataFrame, *kinds: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def collected(df: DataFrame, kind: int, *kinds: type) -> list[np.ndarray]:
    """Small columns of a kind: sums of a place, or of the heavy contexts."""
    return arrays([[pa.py_buffer(bytes(x)) for x in r["parts"]] for r in of_kind(df, kind).select("parts").collect()], *kinds)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 2_000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Fewer and larger batches: words that texts share are looked at once. At most `rows`, if a batch has at most half of that."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
            pa.default_memory_pool().release_unused()
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    pa.default_memory_pool().release_unused()


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)


def context_places(u: np.ndarray, w: np.ndarray, heavy: np.ndarray, places: int) -> np.ndarray:
    """Where a pair is: the place of its context; the pairs of a heavy context are dealt to 64."""
    return place_numbers(np.where(np.isin(u, heavy), u + 1_000_003 * (1 + (w & 63)), u), places)


def _seen(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """SEEN rows (u, w, n) of the pairs in (doc_id, text, trains): n counts those that train, those of other texts are below 0."""
    for batch in gathered(batches):
        for part in chunks(batch.column(1), CHUNK):
            context, dish, text, names = coded(batch.column(1)[part.start : part.stop])
            trains = batch.column(2)[part.start : part.stop].to_numpy(zero_copy_only=False).astype(bool)[text]
            key = np.sort((context << 32) | (dish << 1) | trains)
            first = starts(key)
            n, key = np.diff(first, append=len(key)), key[first]
            u, w = names[key >> 32], names[(key >> 1) & 0x7FFFFFFF]
            yield from packed(dealt(context_places(u, w, heavy, places), SEEN, w, np.where(key & 1, n, -n).astype(I4), runs=u))


def steps(n: np.ndarray) -> np.ndarray:
    """n up to 100, then steps of a twentieth."""
    return np.where(n < 100, n, 100 + np.log(np.maximum(n, 100) / 100) / np.log(1.05)).astype(I4)


def _tally(batches: Iterator[pa.RecordBatch], listed: str, heavy: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """Of SEEN rows: SEATED (u, times, single, types; w, n, tables), pairs of two customers or more; REST (u, times, seen, single; w, n), all contexts and the other pairs that are kept; WORDS (w, tokens, pairs of one token, pairs); ASKS and MORE_ASKS (w, place): words that aren't listed of either; HEAVY, SUMS, HIST.

    Kept are pairs that occur twice or more, those that occur once and are asked
    for, and those with a word that isn't listed.
    """
    known = fetched(listed, _listed, BLOCK)["w"]
    for place, found in by_place(batches):
        u, times, w, n = arrays(found.pop(SEEN), I8, I4, I8, I4)
        own, at = np.unique(u, return_inverse=True)
        names, word = np.unique(w, return_inverse=True)
        key = (np.repeat(at, times) << 32) | word
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = starts(key)
        at, word, asked, n = key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(n < 0, first, dtype=I8) > 0, np.add.reduceat(np.maximum(n, 0), first, dtype=I8)
        w = names[word]
        seen, single, types = (np.bincount(at, weights=x, minlength=len(own)).astype(I8) for x in (n, n == 1, n > 0))
        rare_w = (place_of(names, known) < 0)[word]
        several = n >= 2
        other = ~several & (((n == 1) & asked) | rare_w | (place_of(own, known) < 0)[at])

        def rows(place=place, w=w, n=n, at=at, own=own, names=names, word=word, seen=seen, single=single, types=types, rare_w=rare_w, several=several, other=other) -> Iterator[Row]:
            times = np.bincount(at[several], minlength=len(own)).astype(I4)
            some = times > 0
            yield place, SEATED, [own[some], times[some], single[some], types[some], w[several], n[several].astype(I4), np.ones(int(several.sum()), I4)]
            yield place, REST, [own, np.bincount(at[other], minlength=len(own)).astype(I4), seen, single, w[other], n[other].astype(np.int8)]
            tokens, ones, pairs = (np.bincount(word, weights=x, minlength=len(names)).astype(I8) for x in (n, n == 1, n > 0))
            yield from dealt(place_numbers(names[pairs > 0], wide(places)), WORDS, *(x[pairs > 0] for x in (names, tokens, ones, pairs)))
            asks = np.unique(w[several & rare_w])
            for kind, names in ((ASKS, asks), (MORE_ASKS, np.setdiff1d(w[other & rare_w], asks))):
                yield from dealt(place_numbers(names, wide(places)), kind, names, np.full(len(names), place, I4))
            split = np.isin(own, heavy)
            yield place, HEAVY, [own[split], seen[split], single[split], types[split]]
            yield place, SUMS, [np.array([n.sum(), (n == 1).sum(), (n > 0).sum(), (n == 2).sum()], I8)]
            step, first, count = np.unique(steps(n[several]), return_index=True, return_counts=True)
            yield place, HIST, [step, count]

        yield from packed(rows())


def swept(restaurant: np.ndarray, keys: np.ndarray, n: np.ndarray, tables: np.ndarray, base: np.ndarray, outside: np.ndarray, d: float, theta: float, sweeps: range) -> tuple[np.ndarray, np.ndarray]:
    """Tables after some sweeps over dishes sorted by restaurant (0, 1, ...), and their sum over the sweeps. outside: tables of each restaurant that aren't here."""
    tables, total = tables.astype(float), np.zeros(len(tables))
    live = outside + np.bincount(restaurant, weights=tables, minlength=len(outside))
    first = np.flatnonzero(np.diff(restaurant, prepend=-1))
    turn = (np.arange(len(restaurant)) - first[restaurant]) % TURNS
    turns = [r for k in range(TURNS) if len(r := np.flatnonzero(turn == k))]
    for sweep in sweeps:
        for r in turns:
            new = draw_tables(keys[r], sweep, n[r], base[r], live[restaurant[r]] - tables[r], d, theta)
            live += np.bincount(restaurant[r], weights=new - tables[r], minlength=len(live))
            tables[r] = new
        total += tables
    return tables, total


@dataclass
class Told:
    """What the parent says of a word: its p is (own + share) / room, for each averaged round or for one."""

    share: list[float]
    room: list[float]
    hapax_own: list[float]

    def p(self, own: list[np.ndarray], c: np.ndarray) -> list[np.ndarray]:
        return [(np.where(c == 1, one, o) + s) / r for o, s, r, one in zip(own, self.share, self.room, self.hapax_own, strict=True)]


#: Of a WORDS row: w, tokens, pairs of one token, pairs, tables, customers; places in w and places that ask, of either kind; then what a word has of its own after each averaged round.
WORD_PARTS = (I8, I8, I8, I8, I8, I8, I4, I4, I4, I4)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WORDS rows for good, each word once; SUMS: words, and those of one token."""
    for place, found in by_place(batches):
        w, *sums = arrays(found[WORDS], I8, I8, I8, I8)
        names, at = np.unique(w, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(names)).astype(I8) for x in sums]
        asks = []
        for kind in (ASKS, MORE_ASKS):
            w, source = arrays(found[kind], I8, I4)
            at = place_of(w, names) if len(names) else np.full(len(w), -1)
            asks += [at[at >= 0].astype(I4), source[at >= 0]]
        yield from packed([(place, WORDS, [names, *sums, np.ones(len(names), I8), np.zeros(len(names), I8), *asks]), (place, SUMS, [np.array([len(names), (sums[0] == 1).sum()], I8)])])


def word_columns(parts: list[pa.Buffer]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return arrays([parts], *WORD_PARTS), arrays([parts], *[F8] * (len(parts) - len(WORD_PARTS)), first=len(WORD_PARTS))


def _customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WORDS rows with the tables below each word as its customers, from WORDS and BELOW; SUMS: words of two tokens or more with one customer, with two, and all their customers."""
    for place, found in by_place(batches):
        w, tables = arrays(found[BELOW], I8, I4)
        for parts in found[WORDS]:
            columns, own = word_columns(parts)
            names, c, single = columns[:3]
            guests = single + (np.bincount(np.maximum(place_of(w, names), 0), weights=tables, minlength=len(names)).astype(I8) if len(w) else 0)
            columns[5] = np.where(c >= 2, guests, 0)
            yield from packed([(place, WORDS, [*columns, *own]), (place, SUMS, [np.array([(columns[5] == 1).sum(), (columns[5] == 2).sum(), columns[5].sum()], I8)])])


def _draw_parent(batches: Iterator[pa.RecordBatch], sweep: int, d: float, theta: float, base: float, all_tables: float) -> Iterator[pa.RecordBatch]:
    """WORDS rows with the parent's tables drawn anew, given its customers, and what a word has of its own; SUMS: tables."""
    for place, found in by_place(batches):
        for parts in found[WORDS]:
            columns, own = word_columns(parts)
            names, c, _, _, old, guests = columns[:6]
            r = np.flatnonzero(c >= 2)
            if len(r):
                new, _ = swept(np.zeros(len(r), int), names[r], guests[r], old[r], np.full(len(r), base), np.array([all_tables - old[r].sum()]), d, theta, range(sweep, sweep + 1))
                old = old.copy()
                old[r] = new.astype(I8)
            columns[4] = old
            yield from packed([(place, WORDS, [*columns, *own, np.where(c >= 2, guests - d * old, 0.0)]), (place, SUMS, [np.array([old[r].sum()], I8)])])


def _told(batches: Iterator[pa.RecordBatch], told: Told | None, first: tuple[float, float], latest: bool) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Each place with its columns of words and their p, of the latest round or of all averaged ones. Before any round p is by pairs."""
    for place, found in by_place(batches):
        for parts in found[WORDS]:
            columns, own = word_columns(parts)
            p = told.p(own[-1:] if latest else own[1:], columns[1]) if told else [(columns[3] + first[0]) / first[1]]
            yield place, columns, p


def _answers(batches: Iterator[pa.RecordBatch], told: Told | None, first: tuple[float, float], latest: bool) -> Iterator[pa.RecordBatch]:
    """ANSWER rows (w, tokens, p...) for the places that ask."""
    for _, columns, p in _told(batches, told, first, latest):
        at, source = columns[6:8] if latest else (np.concatenate(columns[k : k + 3 : 2]) for k in (6, 7))
        yield from packed(dealt(source, ANSWER, columns[0][at], columns[1][at], *(x[at] for x in p)))


def _told_listed(batches: Iterator[pa.RecordBatch], listed: str, told: Told | None, first: tuple[float, float], latest: bool) -> Iterator[pa.RecordBatch]:
    """(w, c, p1, ...) of the listed words."""
    known = fetched(listed, _listed, BLOCK)["w"]
    for _, columns, p in _told(batches, told, first, latest):
        at = np.flatnonzero(place_of(columns[0], known) >= 0)
        yield from pa.table({"w": columns[0][at], "c": columns[1][at], **{f"p{k}": x[at] for k, x in enumerate(p, 1)}}).to_batches(BLOCK)


def _told_words(found: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    parts = list(found)
    t = pa.Table.from_batches(parts).sort_by("w") if parts else pa.table({"w": np.zeros(0, I8)})
    return {c: t[c].to_numpy() for c in t.column_names}


def p_of(w: np.ndarray, common: dict[str, np.ndarray], answers: list[list[pa.Buffer]], nothing: list[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens and p... of words: listed ones by the fetched file, others by answers."""
    c, p = np.zeros(len(w), I8), [np.full(len(w), x) for x in nothing]
    columns = arrays(answers, I8, I8, *[F8] * len(nothing)) if answers else [np.zeros(0, I8)]
    order = np.argsort(columns[0])
    for source in ([common[k] for k in ("w", "c", *(f"p{k + 1}" for k in range(len(nothing)))) if k in common], [x[order] for x in columns]):
        if len(source[0]):
            at = place_of(w, source[0])
            hit = at >= 0
            for to, x in zip([c, *p], source[1:], strict=True):
                to[hit] = x[at[hit]]
    return c, p


@dataclass
class Split:
    """The heavy contexts, whose pairs are in several places: what all places have of them."""

    u: np.ndarray
    sums: dict[str, np.ndarray]

    def of(self, name: str, u: np.ndarray, here: np.ndarray) -> np.ndarray:
        """`here`, or what all places have."""
        if not len(self.u):
            return here
        at = place_of(u, self.u)
        return np.where(at >= 0, self.sums[name][at], here)


def summed(u: np.ndarray, **columns: np.ndarray) -> Split:
    names, at = np.unique(u, return_inverse=True)
    return Split(names, {k: np.bincount(at, weights=x, minlength=len(names)) for k, x in columns.items()})


def _draw_seats(batches: Iterator[pa.RecordBatch], sweeps: range, d: float, theta: float, p_file: str, unseen: float, split: Split, tables_of: Split, keep: bool, places: int) -> Iterator[pa.RecordBatch]:
    """SEATED rows with tables drawn anew from the parent's p and the tables of the context, and their sum over the sweeps if that is kept; BELOW (w, tables); HEAVY (u, tables, drawn)."""
    common = fetched(p_file, _told_words, BLOCK)
    for place, found in by_place(batches):
        for parts in found[SEATED]:
            u, times, single, types, w, n, old, *sums = arrays([parts], I8, I4, I8, I8, I8, *[I4] * (len(parts) - 5))
            names, back = np.unique(w, return_inverse=True)
            _, (p,) = p_of(names, common, found[ANSWER], [unseen])
            p = p[back]
            at = np.repeat(np.arange(len(u)), times)
            here = np.bincount(at, weights=old, minlength=len(u))
            all_tables = tables_of.of("tables", u, single + here)
            tables, total = swept(at, _mixed(u[at], w), n, old, p, all_tables - here, d, theta, sweeps) if len(u) else (old, old)
            tables, total = tables.astype(I4), total.astype(I4)
            below = np.bincount(back, weights=tables, minlength=len(names)).astype(I4)
            cut = np.isin(u, split.u)
            mine = (np.bincount(at, weights=x, minlength=len(u))[cut].astype(I8) for x in (tables, total))
            yield from packed([(place, SEATED, [u, times, single, types, w, n, tables, *sums, *[total] * keep]), *dealt(place_numbers(names, wide(places)), BELOW, names, below), (place, HEAVY, [u[cut], *mine])])


def _kept(batches: Iterator[pa.RecordBatch], p_file: str, listed: str, unseen: list[float], split: Split, drawn: list[Split], d: float, theta: float, sweeps: int) -> Iterator[pa.RecordBatch]:
    """KEPT rows (u, times; w, n, tables: their sum over all draws) of pairs of listed words, with (u, times; w, log_p, tokens of w) of the others; CONTEXT (u, room, b...) of listed contexts."""
    common, known = fetched(p_file, _told_words, BLOCK), fetched(listed, _listed, BLOCK)["w"]
    draws = sweeps * len(unseen)
    for place, found in by_place(batches):
        u, times, seen, single, w, n = arrays(found[REST], I8, I4, I8, I8, I8, np.int8)
        u2, times2, _, _, w2, n2, _, *s = arrays(found[SEATED], I8, I4, I8, I8, I8, *[I4] * (2 + len(unseen)))
        at, at2 = np.repeat(np.arange(len(u)), times), np.repeat(place_of(u2, u), times2)
        seen, single = split.of("seen", u, seen), split.of("single", u, single)
        own = [x.of("drawn", u, np.bincount(at2, weights=y, minlength=len(u))) for x, y in zip(drawn, s, strict=True)]
        b, room = [theta + d * (single + x / sweeps) for x in own], seen + theta
        at, w, n, tables = np.concatenate([at, at2]), np.concatenate([w, w2]), np.concatenate([n.astype(I4), n2]), np.concatenate([n.astype(I4) * draws, sum(s)])
        order = np.argsort(at, kind="stable")
        at, w, n, tables = at[order], w[order], n[order], tables[order]
        u_listed = place_of(u, known) >= 0
        rare = ~u_listed[at] | (place_of(w, known) < 0)
        r, i = at[rare], at[~rare]
        c, p = p_of(w[rare], common, found[ANSWER], unseen)
        shared = sum(x[r] * y for x, y in zip(b, p, strict=True)) / len(p)
        log_p = np.log10((n[rare] - d * tables[rare] / draws + shared) / room[r])
        c = np.where(place_of(w[rare], known) < 0, c, 0)
        count = lambda x: np.bincount(x, minlength=len(u)).astype(I4)  # noqa: B023, E731
        f = np.flatnonzero(u_listed)
        a, z = count(i), count(r)
        yield from packed([(place, KEPT, [u[a > 0], a[a > 0], w[~rare], n[~rare], tables[~rare], u[z > 0], z[z > 0], w[rare], log_p, c.astype(I4)]), (place, CONTEXT, [u[f], room[f], *(x[f] for x in b)])])


def _hot_words(found: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Listed words in order, p and b with a row for each averaged round."""
    t = pa.Table.from_batches(list(found)).sort_by("w")
    several = lambda x: np.stack([t[c].to_numpy() for c in t.column_names if c[0] == x and c[1:].isdigit()])
    return {"w": t["w"].to_numpy(), "log_c": np.log10(t["c"].to_numpy() + 1.0), "room": t["room"].to_numpy(), "p": several("p"), "b": several("b")}


def gains(parts: list[pa.Buffer], common: dict[str, np.ndarray], d: float, draws: int) -> tuple[np.ndarray, ...]:
    """u, w, n, gain_train, gain_held, c of the pairs of a KEPT row. n of pairs with a word that isn't listed is 0."""
    u, times, w, n, tables = arrays([parts], I8, I4, I8, I4, I4)
    rare_u, rare_times, rare_w, log_p, c = arrays([parts], I8, I4, I8, F8, I4, first=5)
    u, rare_u = np.repeat(u, times), np.repeat(rare_u, rare_times)
    i, j = np.repeat(place_of(np.frombuffer(parts[0], I8), common["w"]), times) if len(times) else np.zeros(0, int), place_of(w, common["w"])
    shared = (common["b"][:, i] * common["p"][:, j]).mean(axis=0)
    own = np.log10(n - d * tables / draws + shared)  # the room of the context is that of what it is less
    train, held = np.where(n == 1, 0.0, own - np.log10(1 - d + shared)), own - np.log10(shared)
    both = lambda x, y: np.concatenate([x, y])
    return both(u, rare_u), both(w, rare_w), both(n, np.zeros(len(c), I4)), both(train, log_p), both(held, log_p), both(np.zeros(len(w), I4), c)


def _pair_rows(batches: Iterator[pa.RecordBatch], words_file: str, d: float, draws: int, least: int) -> Iterator[pa.RecordBatch]:
    """(u, w, gain_train, gain_held, c) of KEPT rows: of pairs that occur so often, or of all if that is 0."""
    common = fetched(words_file, _hot_words, BLOCK)
    for _, found in by_place(batches):
        for parts in found[KEPT]:
            u, w, n, train, held, c = gains(parts, common, d, draws)
            r = n >= least
            yield from pa.table({"u": u[r], "w": w[r], "gain_train": train[r], "gain_held": held[r], "c": c[r].astype(I8)}).to_batches(BLOCK)


@dataclass
class Seats:
    """What a text's pairs meet.

    blocks: KEPT rows of the kept pairs. pairs: (pair, gain_train, gain_held, c)
    of them, and hot: the same with u and w of the few pairs of listed words that
    occur most: the log10 of the pair's probability, less what it would be had it
    one customer (for texts that train) or none (for others); whole, and the
    training tokens c of w if w isn't listed, for pairs with a word that isn't
    listed. words: the file, for `fetched`, with (w, c, p..., room, b...) of the
    listed words, as words and as contexts.
    """

    blocks: DataFrame
    pairs: DataFrame
    hot: DataFrame
    words: str
    tokens: int
    kinds: int
    d: float
    draws: int
    heavy: np.ndarray
    places: int


PAIR_ROW = "u long, w long, gain_train double, gain_held double, c long"


def seat(rows: DataFrame, theta: float = 1.0, rounds: int = 3, sweeps: int = 3, hot_words: int = 300_000, hot_pairs: int = 100_000, sample: int = 20_000) -> Seats:
    """rows: (doc_id, text, trains). Pairs of all texts get their probability by those that train.

    rounds: how often contexts and parent tell each other their tables; the first one isn't averaged.
    sweeps: over a place's restaurants in a round.
    """
    spark = rows.sparkSession
    common, heavy, about = common_words(rows, hot_words, sample)
    listed, heavy, places = spread(common, "lm-listed"), np.unique(np.array(heavy, np.int64)), max(8, int(about / PLACE_TOKENS))
    seen = rows.mapInArrow(lambda it: _seen(it, heavy, places), ROW)
    found = written(met(seen).mapInArrow(lambda it: _tally(it, listed, heavy, places), ROW), "lm-tallies")
    tokens, singles, types, twos = (int(x) for x in collected(found, SUMS, I8)[0].reshape(-1, 4).sum(axis=0))
    u, *sums = collected(found, HEAVY, I8, I8, I8, I8)
    split = summed(u, **dict(zip(("seen", "single", "tables"), sums, strict=True)))  # a table for each pair, to begin with
    step, count = collected(found, HIST, I4, I8)
    d = discount(singles, twos)
    parent = written(met(of_kind(found, WORDS, ASKS, MORE_ASKS)).mapInArrow(_words, ROW), "lm-words")
    kinds, hapax = (int(x) for x in collected(parent, SUMS, I8)[0].reshape(-1, 2).sum(axis=0))
    base = 1 / (kinds + 1)
    first, told, told_now = (base, float(types + 1)), Told([], [], []), None
    seated, tables_of, drawn, parent_tables = found, split, [], float(kinds)
    for number in range(rounds):
        ask = lambda it, told=told_now: _answers(it, told, first, True)
        p_rows = of_kind(parent, WORDS).mapInArrow(lambda it, told=told_now: _told_listed(it, listed, told, first, True), "w long, c long, p1 double")
        p_file = spread(p_rows, "lm-p")
        unseen = told_now.share[0] / told_now.room[0] if told_now else first[0] / first[1]
        meeting = met(of_kind(seated, SEATED).union(of_kind(parent, WORDS).mapInArrow(ask, ROW)))
        draw = lambda it, at=number, file=p_file, un=unseen, of=tables_of: _draw_seats(it, range(at * sweeps, at * sweeps + sweeps), d, theta, file, un, split, of, at > 0, places)
        old, seated = seated, written(meeting.mapInArrow(draw, ROW), "lm-seats")
        if number:
            forget(spark, old)
        u, own_tables, own_drawn = collected(seated, HEAVY, I8, I8, I8)
        now = summed(u, tables=own_tables, drawn=own_drawn)
        tables_of = Split(split.u, {"tables": split.sums["single"] + now.of("tables", split.u, np.zeros(len(split.u)))})
        if number:
            drawn.append(Split(split.u, {"drawn": now.of("drawn", split.u, np.zeros(len(split.u)))}))
        # the parent's customers are the tables below it
        guests = written(met(of_kind(parent, WORDS).union(of_kind(seated, BELOW))).mapInArrow(_customers, ROW), "lm-guests")
        one, two, customers = (int(x) for x in collected(guests, SUMS, I8)[0].reshape(-1, 3).sum(axis=0))
        parent_d = discount(one + hapax, two)
        fresh = of_kind(guests, WORDS).mapInArrow(lambda it, at=number, dp=parent_d, all_=parent_tables: _draw_parent(it, at, dp, theta, base, all_), ROW)
        old, parent = parent, written(fresh, "lm-parent")
        forget(spark, guests, old)
        parent_tables = float(collected(parent, SUMS, I8)[0].sum() + hapax)
        share, room = (theta + parent_d * parent_tables) * base, theta + float(customers + hapax)
        told_now = Told([share], [room], [1 - parent_d])
        if number:  # what all words get of the parent, its customers with theta, and what a word of one token has of its own
            told = Told(told.share + [share], told.room + [room], told.hapax_own + [1 - parent_d])

    samples = range(1, rounds)
    p_names = ", ".join(f"p{k} double" for k in samples)
    p_rows = written(of_kind(parent, WORDS).mapInArrow(lambda it: _told_listed(it, listed, told, first, False), f"w long, c long, {p_names}"), "lm-told")
    p_file, unseen = spread(p_rows, "lm-told-p"), [s / r for s, r in zip(told.share, told.room, strict=True)]
    meeting = met(of_kind(seated, SEATED).union(of_kind(found, REST)).union(of_kind(parent, WORDS).mapInArrow(lambda it: _answers(it, told, first, False), ROW)))
    kept = written(meeting.mapInArrow(lambda it: _kept(it, p_file, listed, unseen, split, drawn, d, theta, sweeps), ROW), "lm-pairs")
    forget(spark, found, seated, parent)
    contexts = of_kind(kept, CONTEXT).mapInArrow(lambda it: _context_rows(it, len(samples)), "w long, room double, " + ", ".join(f"b{k} double" for k in samples))
    contexts = contexts.groupBy("w").agg(*(F.first(c).alias(c) for c in ("room", *(f"b{k}" for k in samples))))
    names = common.union(spark.range(END, BEGIN + 1).toDF("w")).distinct()  # a list of tuples would start workers of a second kind
    nothing = {"c": 0, "room": theta} | {f"b{k}": theta for k in samples} | {f"p{k}": unseen[k - 1] for k in samples}
    words = names.join(p_rows, "w", "left").join(contexts, "w", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in nothing.items()})
    words_file, draws = spread(words.select("w", "c", *(f"p{k}" for k in samples), "room", *(f"b{k}" for k in samples)), "lm-hot-words"), sweeps * len(samples)
    least = least_step(step, count, hot_pairs)
    hot = written(of_kind(kept, KEPT).mapInArrow(lambda it: _pair_rows(it, words_file, d, draws, least), PAIR_ROW), "lm-hot-pairs")
    pairs = of_kind(kept, KEPT).mapInArrow(lambda it: _pair_rows(it, words_file, d, draws, 0), PAIR_ROW)
    pairs = pairs.select(F.xxhash64("u", "w").alias("pair"), "gain_train", "gain_held", "c")
    return Seats(kept, pairs, hot, words_file, tokens, kinds, d, draws, heavy, places)


def _context_rows(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    for _, found in by_place(batches):
        u, room, *b = arrays(found[CONTEXT], I8, F8, *[F8] * samples)
        yield from pa.table({"w": u, "room": room, **{f"b{k}": x for k, x in enumerate(b, 1)}}).to_batches(BLOCK)


def least_step(step: np.ndarray, count: np.ndarray, most: int) -> int:
    """The least n, by the pairs of each step, that at most `most` pairs reach."""
    names, at = np.unique(step, return_inverse=True)
    reach = np.cumsum(np.bincount(at, weights=count, minlength=len(names))[::-1])[::-1]
    fits = names[reach <= most]
    if not len(fits):
        return 1 << 62
    n = int(fits[0])
    return n if n < 100 else int(100 * 1.05 ** (n - 100)) + 1


# -- scoring ----------------------------------------------------------------------------------


def _hot_pairs(found: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Pairs by their mixed digests, in order."""
    kinds = {"u": np.int64, "w": np.int64, "gain_train": np.float64, "gain_held": np.float64}
    parts = list(found)
    out = {c: np.concatenate([*(b.column(c).to_numpy() for b in parts), np.zeros(0, kind)]).astype(kind) for c, kind in kinds.items()}
    key = _mixed(out["u"], out["w"])
    order = np.argsort(key)
    return {"key": key[order], **{c: x[order] for c, x in out.items()}}


def text_places(key: np.ndarray, places: int) -> np.ndarray:
    """Where the sums of a text meet: texts that were read together go together."""
    return place_numbers(key >> 11, wide(places))


def _asked(batches: Iterator[pa.RecordBatch], words_file: str, pairs_file: str, d: float, heavy: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """TEXT rows (key, doc_id, whether it is one, tokens, known ones, base, score), with what the fetched files give, and POSTING rows (first key; u, times; w, text, n) of the pairs that may be kept. A text's key is odd if it trains."""
    common, pairs = fetched(words_file, _hot_words, BLOCK), fetched(pairs_file, _hot_pairs, BLOCK)
    number = TaskContext.get().partitionId() << 39
    for batch in gathered(batches, size=2_000_000):
        for part in chunks(batch.column(1), CHUNK):
            context, dish, text, names = coded(batch.column(1)[part.start : part.stop])
            trains = batch.column(2)[part.start : part.stop].to_numpy(zero_copy_only=False).astype(bool)
            rows = part.stop - part.start
            if rows < 1 << 11 and len(names) < 1 << 26:  # a text's pairs once; more than that stay apart, and are summed later
                both = np.sort((context << 37) | (dish << 11) | text)
                first = starts(both)
                n, both = np.diff(first, append=len(both)), both[first]
                context, dish, text = both >> 37, (both >> 11) & ((1 << 26) - 1), both & ((1 << 11) - 1)
            else:
                order = np.lexsort((dish, context))
                context, dish, text, n = context[order], dish[order], text[order], np.ones(len(order), np.int64)
            sums = lambda at, x: np.bincount(text[at], weights=n[at] * x, minlength=rows).astype(float)  # noqa: E731, B023
            place = place_of(names, common["w"])
            u_at, w_at = place[context], place[dish]
            is_word = np.flatnonzero(w_at >= 0)
            log_c = common["log_c"][w_at[is_word]]
            is_pair = np.flatnonzero((u_at >= 0) & (w_at >= 0))
            i, j = u_at[is_pair], w_at[is_pair]
            own = (1 - d) * trains[text[is_pair]]
            score = sums(is_pair, np.log10((own + (common["b"][:, i] * common["p"][:, j]).mean(axis=0)) / common["room"][i]))
            u, w = names[context], names[dish]
            hit = np.zeros(len(u), bool)
            if len(pairs["key"]):
                at = place_of(_mixed(u[is_pair], w[is_pair]), pairs["key"])
                real = (at >= 0) & (pairs["u"][at] == u[is_pair]) & (pairs["w"][at] == w[is_pair])
                is_hot, mine = is_pair[real], at[real]
                hit[is_hot] = True
                score += sums(is_hot, np.where(trains[text[is_hot]], pairs["gain_train"][mine], pairs["gain_held"][mine]))
            keys, ids = 2 * (number + np.arange(rows)) + trains, batch.column(0)[part.start : part.stop]
            whole = [keys, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.bincount(text, weights=n, minlength=rows).astype(I8), sums(is_word, log_c > 0).astype(I8), sums(is_word, log_c), score]
            yield from packed(dealt(text_places(keys, places), TEXT, *whole))
            left = np.flatnonzero(~hit)
            u, w = u[left], w[left]
            # one number for a text and whether it trains
            code = (2 * text[left] + trains[text[left]]).astype(I4)
            code = code.astype(np.uint16) if rows < 1 << 15 else code
            yield from packed((at, kind, [np.array([2 * number, code.itemsize]), *columns]) for at, kind, columns in dealt(context_places(u, w, heavy, places), POSTING, w, code, n[left].astype(I4), runs=u))
            number += rows


def _met(batches: Iterator[pa.RecordBatch], words_file: str, d: float, draws: int, places: int, group: int = 1024) -> Iterator[pa.RecordBatch]:
    """TEXT rows as they are, and GAIN (key, score) and KNOWN (key, tokens, base) rows of what the postings of a place get from its kept pairs."""
    common = fetched(words_file, _hot_words, BLOCK)
    for place, found in by_place(batches):
        yield from packed((place, TEXT, [np.frombuffer(x, np.uint8) for x in parts]) for parts in found.pop(TEXT, []))
        postings, kept = found.pop(POSTING, []), found.pop(KEPT, [])
        if not postings or not kept:
            continue
        u, w, _, train, held, c = (np.concatenate(x) for x in zip(*(gains(parts, common, d, draws) for parts in kept), strict=True))
        key = _mixed(u, w)
        order = np.argsort(key)
        key, u, w, train, held, c = (x[order] for x in (key, u, w, train, held, c))
        if not len(key):
            continue
        for s in range(0, len(postings), group):
            texts, us, ws, ns = [], [], [], []
            for (first, width), parts in ((np.frombuffer(p[0], I8), p) for p in postings[s : s + group]):
                (pu, times, pw), (code,), (n,) = arrays([parts], I8, I4, I8, first=1), arrays([parts], np.uint16 if width == 2 else I4, first=4), arrays([parts], I4, first=5)
                texts.append(first + code.astype(I8))
                us.append(np.repeat(pu, times))
                ws.append(pw)
                ns.append(n)
            text, pu, pw, n = (np.concatenate(x) for x in (texts, us, ws, ns))
            at = place_of(_mixed(pu, pw), key)
            hit = np.flatnonzero((at >= 0) & (u[at] == pu) & (w[at] == pw))
            text, at, n = text[hit], at[hit], n[hit]
            names, back = np.unique(text, return_inverse=True)
            gain = np.bincount(back, weights=n * np.where(text & 1, train[at], held[at]), minlength=len(names))
            yield from packed(dealt(text_places(names, places), GAIN, names, gain))
            more = np.flatnonzero(c[at] > 0)
            if len(more):
                names, back = np.unique(text[more], return_inverse=True)
                tokens, base = (np.bincount(back, weights=n[more] * x, minlength=len(names)) for x in (np.ones(len(more)), np.log10(c[at[more]] + 1.0)))
                yield from packed(dealt(text_places(names, places), KNOWN, names, tokens.astype(I4), base))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, n_known, base, score) of each text."""
    for _, found in by_place(batches):
        key, ids, valid, tokens, known, base, score = arrays(found[TEXT], I8, I8, np.bool_, I8, I8, F8, F8)
        order = np.argsort(key)
        key, ids, valid, tokens, known, base, score = (x[order] for x in (key, ids, valid, tokens, known, base, score))
        for kind, kinds in ((GAIN, (F8,)), (KNOWN, (I4, F8))):
            if found[kind]:
                names, *sums = arrays(found[kind], I8, *kinds)
                more = [np.bincount(place_of(names, key), weights=x, minlength=len(key)) for x in sums]
                score = score + more[0] if kind == GAIN else score
                known, base = (known + more[0].astype(I8), base + more[1]) if kind == KNOWN else (known, base)
        yield from pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": tokens, "n_known": known, "base": base, "score": score}).to_batches(BLOCK)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, hot_pairs: int = 100_000, hot_words: int = 300_000, rounds: int = 3, sweeps: int = 3, turns: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, learnt from the folds that aren't held out.

    turns: so many parts of the texts meet the kept pairs one after another, so that the pairs of a part alone are on disk.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col, BATCH_ROWS).withColumn("trains", remainder("doc_id", folds) != held_fold)
    with settings(spark, LARGE_ROWS):
        model = seat(rows, rounds=rounds, sweeps=sweeps, hot_words=hot_words, hot_pairs=hot_pairs)
        pairs_file, words_file, d, draws, heavy, places = spread(model.hot, "lm-hot"), model.words, model.d, model.draws, model.heavy, model.places
        forget(spark, model.hot)
        parts = []
        for turn in range(turns):
            asked = rows.where(remainder("doc_id", turns) == turn).mapInArrow(lambda it: _asked(it, words_file, pairs_file, d, heavy, places), ROW)
            sums = met(asked.union(of_kind(model.blocks, KEPT))).mapInArrow(lambda it: _met(it, words_file, d, draws, places), ROW)
            parts.append(written(met(sums).mapInArrow(_whole, "doc_id long, n_tokens long, n_known long, base double, score double"), "lm-scores"))
        forget(spark, model.blocks)
    whole = reduce(DataFrame.union, parts)
    floor = float(np.log10(model.tokens + model.kinds + 1.0))
    return whole.select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")
