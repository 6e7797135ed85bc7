"""Secret scans by grammar inference.

Base patterns give labelled credentials. For each kind the labelled strings
become a prefix tree whose states are merged where their statistics agree
(state merging under Hoeffding bounds), which gives a probabilistic automaton.
Every candidate (a run of credential characters in any whole text) is scored:
its log-likelihood under the automaton less that under a character-pair model
of the candidates that no base pattern marks, by character. What scores above
a learnt threshold is a further span, of kind "format".

All distinct credentials and all other distinct candidates teach, whole: they
are Spark tables. An automaton grows in rounds: each credential walks as far as
its states go, and what follows the edge where it leaves them is counted over
all of them. Edges whose statistics agree with a state's lead to that state;
the others become states. The driver gets edges, states and counts of these,
never the strings. Scores are counted by thousandths, and quantiles come from
these counts.

Kinds with fewer than 20 distinct labelled credentials are learnt together, as
one automaton (from two strings on). Thresholds lie under the scores that
credentials have under automata which didn't learn from them. The background
may hold credentials that no base pattern marks; the thresholds and the pair
model allow for these. A null text counts as empty. Null ids and repeated
rows keep a row each; extra columns go. Without labelled credentials only base
spans are given (there are none then).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, text_rows, written
from .text import chunks

#: Fixed patterns of the base kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
STOP = 128  # the symbol at a string's end; the others are character codes
Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start and kind; code points, end exclusive."""
    found = [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class State:
    count: int = 0
    stop: int = 0
    next: dict[str, State] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> State:
    root = State()
    for s in strings:
        at = root
        at.count += 1
        for c in s:
            at = at.next.setdefault(c, State())
            at.count += 1
        at.stop += 1
    return root


def compatible(a: State, b: State, alpha: float) -> bool:
    """Whether stops and symbols after both states, and after what follows both, agree under Hoeffding bounds."""
    width = math.sqrt(0.5 * math.log(2 / alpha))
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        bound = width * (1 / math.sqrt(x.count) + 1 / math.sqrt(y.count))
        if bound >= 1:
            continue
        if abs(x.stop / x.count - y.stop / y.count) > bound:
            return False
        for c in x.next.keys() | y.next.keys():
            p, q = x.next.get(c), y.next.get(c)
            if abs((p.count / x.count if p else 0) - (q.count / y.count if q else 0)) > bound:
                return False
            if p and q:
                todo.append((p, q))
    return True


def fold(a: State, b: State) -> None:
    """Merge b into a, and what follows by equal symbols."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.count += y.count
        x.stop += y.stop
        for c, q in y.next.items():
            if c in x.next:
                if x.next[c] is not q:
                    todo.append((x.next[c], q))
            else:
                x.next[c] = q


def infer(strings: list[str], alpha: float = 0.05) -> list[State]:
    """States of the merged automaton, the first is where strings begin."""
    root = prefix_tree(strings)
    red = [root]
    known = {id(root)}
    while True:
        blue = [(q.count, k, c, q) for k, r in enumerate(red) for c, q in r.next.items() if id(q) not in known]
        if not blue:
            return red
        _, k, c, state = max(blue, key=lambda b: (b[0], -b[1], b[2]))
        for r in red:
            if compatible(r, state, alpha):
                red[k].next[c] = r
                fold(r, state)
                break
        else:
            red.append(state)
            known.add(id(state))


@dataclass
class Automaton:
    """Next state and log-likelihood by state and character code; the last state is for what goes on where all strings ended."""

    next: np.ndarray
    log_p: np.ndarray
    log_stop: np.ndarray


def automaton(states: list[State]) -> Automaton:
    number = {id(s): k for k, s in enumerate(states)}
    step, counts = np.full((len(states), 128), -1, np.int64), np.zeros((len(states), 129))
    for s in states:
        k = number[id(s)]
        counts[k, STOP] = s.stop
        total = sum(q.count for q in s.next.values())
        for c, q in s.next.items():  # shares of what isn't a stop, by the counts that arrived
            step[k, ord(c)], counts[k, ord(c)] = number[id(q)], (s.count - s.stop) * q.count / total
    return smoothed(step, counts)


def smoothed(step: np.ndarray, counts: np.ndarray, smooth: float = 0.5) -> Automaton:
    """The automaton of states that characters lead to (-1: none does) and of how often each symbol follows a state."""
    dead = len(step)
    total = counts.sum(axis=1, keepdims=True) + smooth * 129
    log_p, log_stop = np.full((dead + 1, 128), math.log(1e-4)), np.full(dead + 1, math.log(1e-4))
    log_p[:dead], log_stop[:dead] = np.log((counts[:, :STOP] + smooth) / total), np.log((counts[:, STOP] + smooth) / total[:, 0])
    follows = np.full((dead + 1, 128), dead, np.int64)
    arrived = counts.sum(axis=1)
    for k in range(dead):
        known = np.flatnonzero(step[k] >= 0)
        if len(known):  # a character that never followed goes where most do: it's the place that tells what comes next
            follows[k] = step[k, known[np.lexsort((known, arrived[step[k, known]]))[-1]]]
            follows[k, known] = step[k, known]
    # characters that no string has: as likely together as those that occur once (Good and Turing's estimate)
    often = counts[:, :STOP].sum(axis=0)
    new = often == 0
    log_p[:dead, new] = math.log((np.count_nonzero((often > 0) & (often < 1.5)) + 0.5) / (often.sum() + 1) / max(1, new.sum()))
    return Automaton(follows, log_p, log_stop)


@dataclass
class Symbols:
    """The symbols of some strings one after another, each string with a stop; where each begins, and its characters."""

    codes: np.ndarray
    first: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, strings: list[str]) -> Symbols:
        codes = np.frombuffer("".join(s + "\n" for s in strings).encode("ascii"), np.uint8).astype(np.int64)
        ends = np.flatnonzero(codes == 10)
        codes[ends] = STOP
        first = np.concatenate([[0], ends + 1])[:-1]
        return cls(codes, first, ends - first)

    def pairs(self) -> np.ndarray:
        """How often each symbol follows each, as a table; a string begins after a stop."""
        before = np.concatenate([[STOP], self.codes])[:-1]
        return np.bincount(before * 129 + self.codes, minlength=129 * 129).reshape(129, 129)

    def states(self, step: np.ndarray, start: int = 0) -> np.ndarray:
        """The state before each symbol; all strings step together, the longest go on alone. A last row of step that leads to -1 holds those that have left."""
        out = np.full(len(self.codes), -1, np.int64)
        order = np.argsort(-self.length, kind="stable")
        first, length = self.first[order], self.length[order]
        state, k, n = np.full(len(order), start, np.int64), 0, len(order)
        out[first] = start
        while n := int(np.searchsorted(-length[:n], -k, side="left")):
            if n <= 4 and length[0] > k + 500:
                table = step.tolist()
                for at, stop, s in zip((first[:n] + k).tolist(), (first[:n] + length[:n]).tolist(), state[:n].tolist(), strict=True):
                    gone = []
                    for c in self.codes[at:stop].tolist():
                        s = table[s][c]
                        gone.append(s)
                    out[at + 1 : stop + 1] = gone
                break
            at = first[:n] + k
            state[:n] = step[state[:n], self.codes[at]]
            out[at + 1] = state[:n]
            k += 1
        return out


def pair_model(counts: np.ndarray) -> Automaton:
    """The background: each character given the one before, as an automaton with a state for each character. counts: a table of `pairs`."""
    unigram = counts.sum(axis=0) + 0.5
    p = (counts + 2 * unigram / unigram.sum()) / (counts.sum(axis=1, keepdims=True) + 2)
    return Automaton(np.tile(np.arange(128), (129, 1)), np.log(p[:, :128]), np.log(p[:, 128]))


def log_likelihood(model: Automaton, strings: list[str] | Symbols, start: int = 0) -> np.ndarray:
    """By character (the end counts as one), of each string."""
    s = strings if isinstance(strings, Symbols) else Symbols.of(strings)
    if not len(s.first):
        return np.zeros(0)
    state = np.concatenate([[STOP], s.codes[:-1]]) if start == STOP else s.states(model.next, start)  # the pair model's states are the symbols before
    return np.add.reduceat(np.column_stack([model.log_p, model.log_stop])[state, s.codes], s.first) / (s.length + 1)


@dataclass
class Scorer:
    automata: list[Automaton]
    thresholds: list[float]
    background: Automaton

    def formats(self, strings: list[str]) -> np.ndarray:
        """Which candidates are formatted like a credential."""
        hit = np.zeros(len(strings), bool)
        if strings:
            strings = Symbols.of(strings)
            plain = log_likelihood(self.background, strings, STOP)
            for model, threshold in zip(self.automata, self.thresholds, strict=True):
                hit |= log_likelihood(model, strings) - plain > threshold
        return hit


#: Kinds with fewer labelled credentials are learnt together; folds of the held-out scores; credentials that thresholds leave out.
POOLED, FOLDS, LEFT_OUT = 20, 5, 0.01


@dataclass
class Scores:
    """Scores in order, and how many have each."""

    value: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, scores: np.ndarray) -> Scores:
        return cls(*np.unique(scores, return_counts=True))

    def __len__(self) -> int:
        return int(self.n.sum())

    def at(self, place: int) -> float:
        """The score at a place (from 0) among all in order."""
        return float(self.value[np.searchsorted(np.cumsum(self.n), place, side="right")])

    def quantile(self, q: float) -> float:
        place = q * (len(self) - 1)
        low, high = self.at(math.floor(place)), self.at(math.ceil(place))
        return low + (high - low) * (place - math.floor(place))

    def std(self) -> float:
        mean = np.average(self.value, weights=self.n)
        return math.sqrt(np.average((self.value - mean) ** 2, weights=self.n))

    def between(self, low: float, high: float = math.inf) -> Scores:
        keep = (self.value >= low) & (self.value < high)
        return Scores(self.value[keep], self.n[keep])


def robust_threshold(own: Scores, other: Scores) -> float:
    """Under nearly all credentials (held-out scores own) and over the ordinary strings among the background (scores other), which may hold unmarked credentials.

    The threshold is over the background without its upper quarter. What scores
    more is taken for credentials where it lies as high as credentials do; where
    more lies lower than that explains, it is an ordinary tail, and the
    threshold goes above it.
    """
    # fewer scores tell less of the lower end
    low = max(own.quantile(LEFT_OUT) - 0.1 - 4 * own.std() / math.sqrt(len(own)), 0.2) if len(own) else 0.2
    if not len(other):
        return low
    low = max(low, other.quantile(0.75) + 0.1)
    quarter = own.quantile(0.25) if len(own) else math.inf
    high = len(other.between(quarter))
    between = other.between(low, quarter)
    # credentials lie over the quarter more often than under it; an ordinary tail falls off upwards
    ordinary = math.ceil(len(between) - (high + 3 * math.sqrt(high + 1) + 2e-4 * len(other)))
    return between.at(ordinary - 1) + 0.1 if ordinary > 0 else low


def grouped(credentials: dict[str, list[str]]) -> list[list[str]]:
    """What automata are learnt from: each kind with 20 credentials or more, and all others together (two at least: one string shows no format)."""
    kinds = [sorted(credentials.get(kind, [])) for kind in KINDS]
    pooled = sorted({v for strings in kinds if len(strings) < POOLED for v in strings})
    return [k for k in kinds if len(k) >= POOLED] + ([pooled] if len(pooled) > 1 else [])


def held_out(strings: list[str]) -> list[tuple[list[str], Automaton]]:
    """Folds of the strings (by hash, so that neighbours part), each with the automaton of the other folds."""
    by_hash = sorted(strings, key=lambda v: hashlib.blake2b(v.encode(), digest_size=8).digest())
    n = min(FOLDS, len(strings))
    return [(by_hash[k::n], automaton(infer(sorted(v for j in range(n) if j != k for v in by_hash[j::n])))) for k in range(n)]


def fit(credentials: dict[str, list[str]], background: list[str]) -> Scorer | None:
    """Automata of the kinds, and for each the threshold over nearly all ordinary background and under nearly all credentials that it didn't learn from.

    For strings that one process holds; `learn` does the same with tables.
    """
    kinds = grouped(credentials)
    if not kinds:
        return None
    automata = [automaton(infer(strings)) for strings in kinds]
    ordinary = background
    for step in range(3):  # the pair model learns from all background, then without the quarter most like credentials, then from all that it explains better than the automata
        plain = pair_model(Symbols.of(ordinary).pairs())
        rest = log_likelihood(plain, background, STOP) if background else np.zeros(0)
        others = [log_likelihood(model, background) - rest if background else rest for model in automata]
        if background and step < 2:
            like = np.max(others, axis=0)
            most = 0.0 if step else np.quantile(like, 0.75)
            ordinary = [v for v, x in zip(background, like, strict=True) if x <= most]
    owns = [np.concatenate([log_likelihood(model, fold) - log_likelihood(plain, fold, STOP) for fold, model in held_out(strings)]) for strings in kinds]
    return Scorer(automata, [robust_threshold(Scores.of(own), Scores.of(other)) for own, other in zip(owns, others, strict=True)], plain)


def _values(batches: Iterator[pa.RecordBatch], background: int | None = None) -> Iterator[pa.RecordBatch]:
    """(kind, value, rank), distinct in a batch: credentials of the base kinds, and other candidates as kind plain.

    background: no more of a task's other candidates, those with the smallest hashes; None: all.
    """
    kept: dict[str, int] = {}
    most = 1 << 63

    def table_of(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        kind, value, rank = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(rank, pa.int64())], names=["kind", "value", "rank"])

    for batch in batches:
        found: set[tuple[str, str]] = set()
        plain: set[str] = set()
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            found.update((k, v) for k, _, _, v in spans)
            marked = Coverage([(s, e) for _, s, e, _ in spans])
            plain.update(m[0] for m in CANDIDATE.finditer(text or "") if not marked.touches(m.start(), m.end()))
        if background is None:
            found.update(("plain", v) for v in plain)
        else:
            for v in plain:
                if (rank := int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest()) >> 1) <= most:
                    kept[v] = rank
            if len(kept) > 2 * background:
                kept = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[:background])
                most = max(kept.values())
        yield table_of([(k, v, 0) for k, v in sorted(found)])
    yield table_of([("plain", v, rank) for v, rank in sorted(kept.items(), key=lambda x: (x[1], x[0]))[:background]])


# -- learning from tables -------------------------------------------------------------------

Model = tuple[int, int]  # a group of kinds, and the fold that it doesn't learn from (-1: it learns from all)
ROOT = -1  # the edge that leads to where strings begin
ROWS = 50_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Groups, folds and values of (g, fold, value)."""
    for batch in batches:
        for part in chunks(batch.column(2)):
            yield batch.column(0).to_numpy()[part], batch.column(1).to_numpy()[part], batch.column(2)[part.start : part.stop].to_pylist()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _tails(batches: Iterator[pa.RecordBatch], steps: dict[Model, np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """(g, left, edge, path, symbol, n) of what follows the edge where each string leaves the states that there are (state * 128 + character): each symbol, and a digest of what lies between the edge and it (0: nothing). Without a step the edge is ROOT."""
    for g, fold, values in _parts(batches):
        for (own, left), step in steps.items():
            mine = np.flatnonzero((g == own) & (fold != left))
            if not len(mine):
                continue
            s = Symbols.of([values[k] for k in mine])
            string = np.repeat(np.arange(len(mine)), s.length + 1)
            if step is None:
                edge, begin = np.full(len(mine), ROOT), s.first
                keep = np.ones(len(string), bool)
            else:
                state = s.states(step)
                keep = state < 0
                at = np.flatnonzero(keep)
                begin = np.full(len(mine), len(state), np.int64)
                begin[string[at][::-1]] = at[::-1]  # the first symbol after the edge
                edge = np.where(begin < len(state), state[begin - 1] * 128 + s.codes[begin - 1], 0)
            codes, string = s.codes[keep], string[keep]
            if not len(codes):
                continue
            place = np.flatnonzero(keep) - begin[string]
            sums = np.cumsum(_mixed(place * 129 + codes)) - _mixed(place * 129 + codes)
            path = sums - sums[np.flatnonzero(place == 0)][np.cumsum(place == 0) - 1]
            rows = pa.table({"g": np.full(len(codes), own, np.int32), "left": np.full(len(codes), left, np.int32), "edge": edge[string], "path": path.view(np.int64), "symbol": codes.astype(np.int32)})
            counted = rows.group_by(rows.column_names).aggregate([([], "count_all")]).rename_columns([*rows.column_names, "n"])
            yield from counted.to_batches(ROWS)


def _followed(tails: DataFrame, least: int) -> DataFrame:
    """(g, left, edge, path, n, symbols, counts): what follows each path over all strings. Paths that are too rare to differ from any under the bounds go, but for those of no symbols."""
    key = ["g", "left", "edge", "path"]
    each = tails.groupBy(*key, "symbol").agg(F.sum("n").alias("n"))
    both = each.groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list(F.struct("symbol", "n")).alias("each"))
    return both.where((F.col("n") > least) | (F.col("path") == 0)).select(*key, "n", F.col("each.symbol").alias("symbols"), F.col("each.n").alias("counts"))


def _unlike(batches: Iterator[pa.RecordBatch], width: dict[Model, float]) -> Iterator[pa.RecordBatch]:
    """(g, left, edge, other) of the pairs of what follows a path (n, symbols, counts and other_...) that don't agree under the bounds."""

    def dense(batch: pa.RecordBatch, before: str) -> np.ndarray:
        symbols, counts = batch.column(before + "symbols"), batch.column(before + "counts")
        out = np.zeros((batch.num_rows, 129))
        out[np.repeat(np.arange(batch.num_rows), pc.list_value_length(symbols).to_numpy()), symbols.flatten().to_numpy()] = counts.flatten().to_numpy()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = (batch.column(c).to_numpy()[:, None] for c in ("n", "other_n"))
        wide = np.array([width[k] for k in zip(batch.column("g").to_pylist(), batch.column("left").to_pylist(), strict=True)])[:, None]
        bad = (np.abs(dense(batch, "") / n - dense(batch, "other_") / m) > wide * (1 / np.sqrt(n) + 1 / np.sqrt(m))).any(axis=1)
        yield batch.select(["g", "left", "edge", "other"]).filter(pa.array(bad))


def grown(strings: DataFrame, sizes: dict[Model, int], alpha: float = 0.05) -> dict[Model, np.ndarray]:
    """The states that characters lead to (-1: none does) in the merged automaton of each model, with a last row of -1.

    strings: (g, fold, value). sizes: how many strings each model learns from;
    alpha is divided by it, as tests grow in number with the strings.
    """
    spark = strings.sparkSession
    width = {m: math.sqrt(0.5 * math.log(2 * n / alpha)) for m, n in sizes.items()}
    least = int(min(width.values()) ** 2)  # with so few the bound is 1 or more
    key = ["g", "left"]

    def next_tails(steps: dict[Model, np.ndarray | None]) -> DataFrame:
        rows = strings.mapInArrow(lambda it: _tails(it, steps), "g int, left int, edge long, path long, symbol int, n long")
        return written(_followed(rows, least), "secret-tails")

    def unlike(tails: DataFrame, others: DataFrame) -> set[tuple[int, int, int, int]]:
        """others: with a column other that names them."""
        other = others.select(*key, "path", "other", *(F.col(c).alias(f"other_{c}") for c in ("n", "symbols", "counts")))
        met = tails.where(F.col("n") > least).join(other, [*key, "path"]).select(*key, "edge", "other", "n", "symbols", "counts", "other_n", "other_symbols", "other_counts")
        found = met.mapInArrow(lambda it: _unlike(it, width), "g int, left int, edge long, other long").distinct()
        return {tuple(r) for r in found.collect()}  # edges by states

    def named(tails: DataFrame, names: list[tuple[int, int, int, int]]) -> DataFrame:
        """The rows of some edges, with a name each."""
        g, left, edge, other = zip(*names, strict=True)
        # from Arrow: a list of tuples would go through workers of a second kind in the executors
        rows = spark.createDataFrame(pa.table({"g": pa.array(g, pa.int32()), "left": pa.array(left, pa.int32()), "edge": pa.array(edge, pa.int64()), "other": pa.array(other, pa.int64())}))
        return tails.join(F.broadcast(rows), [*key, "edge"])

    made = [next_tails(dict.fromkeys(sizes))]
    steps = {m: np.full((2, 128), -1, np.int64) for m in sizes}
    states = made[0].withColumn("other", F.lit(0).cast("long"))
    while True:
        tails = next_tails(steps)
        made.append(tails)
        edges = [(r.g, r.left, r.edge, r.n) for r in tails.where("path = 0").select(*key, "edge", "n").collect()]
        if not edges:
            break
        edges = [e[:3] for e in sorted(edges, key=lambda e: (-e[3], e))]
        differ = unlike(tails, states)
        alone = []
        for g, left, edge in edges:
            step = steps[g, left]
            like = next((k for k in range(len(step) - 1) if (g, left, edge, k) not in differ), None)
            if like is None:
                alone.append((g, left, edge))
            else:
                step[edge >> 7, edge & 127] = like
        if alone:
            # those that are like no state may be like one another
            several = [m for m in sizes if sum(e[:2] == m for e in alone) > 1]
            rivals = [(*e, e[2]) for e in alone if e[:2] in several]
            differ = unlike(named(tails, rivals).drop("other"), named(tails, rivals)) if rivals else set()
            new: dict[Model, list[tuple[int, int]]] = {m: [] for m in sizes}
            for g, left, edge in alone:
                step = steps[g, left]
                like = next((k for e, k in new[g, left] if (g, left, edge, e) not in differ), None)
                if like is None:
                    like = len(step) - 1
                    steps[g, left] = step = np.vstack([step, np.full((1, 128), -1, np.int64)])
                    new[g, left].append((edge, like))
                step[edge >> 7, edge & 127] = like
            fresh = [(*m, edge, k) for m, own in new.items() for edge, k in own]
            states = states.unionByName(named(tails, fresh).select(*states.columns))
    forget(spark, *made)
    return steps


def _followers(batches: Iterator[pa.RecordBatch], steps: dict[Model, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(g, left, place, n): how often a symbol follows a state (place: state * 129 + symbol)."""
    counts = {m: np.zeros(129 * len(step), np.int64) for m, step in steps.items()}
    for g, fold, values in _parts(batches):
        for (own, left), step in steps.items():
            s = Symbols.of([values[k] for k in np.flatnonzero((g == own) & (fold != left))])
            counts[own, left] += np.bincount(s.states(step) * 129 + s.codes, minlength=129 * len(step))
    for (own, left), n in counts.items():
        at = np.flatnonzero(n)
        yield from pa.table({"g": np.full(len(at), own, np.int32), "left": np.full(len(at), left, np.int32), "place": at, "n": n[at]}).to_batches(ROWS)


def _counted(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *names: str) -> list[tuple[int, ...]]:
    """Whole numbers that tasks count, added up by all but the last."""
    rows = df.mapInArrow(each, ", ".join(f"{c} {'int' if c in ('g', 'left') else 'long'}" for c in names))
    return [tuple(r) for r in rows.groupBy(*names[:-1]).agg(F.sum(names[-1])).collect()]


def _binned(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1000).astype(np.int64)


def _histogram(scored: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(g, score, n) of pairs of a group and its scores, in thousandths."""
    for g, scores in scored:
        score, n = np.unique(_binned(scores), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), g, np.int32)), pa.array(score), pa.array(n)], names=["g", "score", "n"])


def _scores(rows: list[tuple[int, ...]], g: int) -> Scores:
    own = sorted((score / 1000, n) for k, score, n in rows if k == g)
    return Scores(np.array([x for x, _ in own]), np.array([n for _, n in own], np.int64))


def _likeness(s: Symbols, automata: list[Automaton], plain: Automaton) -> list[np.ndarray]:
    rest = log_likelihood(plain, s, STOP)
    return [log_likelihood(model, s) - rest for model in automata]


def learn(texts: DataFrame) -> Scorer | None:
    """texts: a column text. All distinct credentials and other candidates teach."""
    values = texts.select("text").mapInArrow(_values, "kind string, value string, rank long").select("kind", "value").distinct()
    values = written(values, "secret-values")
    spark = values.sparkSession
    by_kind = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}
    large = [kind for kind in KINDS if by_kind.get(kind, 0) >= POOLED]
    small = values.where(F.col("kind").isin([kind for kind in KINDS if kind not in large])).select("value").distinct()
    pooled = small.count()  # under 20 of each kind
    if not large and pooled < 2:
        forget(spark, values)
        return None
    fold = F.pmod(F.xxhash64("value"), F.lit(FOLDS)).cast("int")
    strings = values.where(F.col("kind").isin(large)).select(F.array_position(F.lit(large).cast("array<string>"), F.col("kind")).cast("int").alias("g"), fold.alias("fold"), "value")
    groups = list(range(1, len(large) + 1))
    if pooled > 1:
        groups.append(len(large) + 1)
        turn = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("value"), "value"))
        strings = strings.union(small.withColumn("g", F.lit(groups[-1])).select("g", (turn % min(FOLDS, pooled)).cast("int").alias("fold"), "value"))
    strings = written(strings, "secret-strings")
    background = written(values.where("kind = 'plain'").select("value"), "secret-background")

    of_fold = {(r["g"], r["fold"]): r["count"] for r in strings.groupBy("g", "fold").count().collect()}
    sizes = {(g, left): n for g in groups for left in range(-1, FOLDS) if (n := sum(c for (k, f), c in of_fold.items() if k == g and f != left)) and (left < 0 or (g, left) in of_fold)}
    steps = grown(strings, sizes)
    counts = {m: np.zeros(129 * len(step)) for m, step in steps.items()}
    for g, left, place, n in _counted(strings, lambda it: _followers(it, steps), "g", "left", "place", "n"):
        counts[g, left][place] = n
    models = {m: smoothed(step[:-1], counts[m].reshape(-1, 129)[:-1]) for m, step in steps.items()}
    automata = [models[g, -1] for g in groups]

    def all_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[Symbols]:
        for batch in batches:
            for part in chunks(batch.column(0)):
                yield Symbols.of(batch.column(0)[part.start : part.stop].to_pylist())

    def pairs(it: Iterator[pa.RecordBatch], plain: Automaton | None, most: int) -> Iterator[pa.RecordBatch]:
        total = np.zeros(129 * 129, np.int64)
        for s in all_symbols(it):
            if plain is not None:
                keep = _binned(np.max(_likeness(s, automata, plain), axis=0)) <= most
                ends = np.repeat(keep, s.length + 1)
                s = Symbols(s.codes[ends], s.first[:0], s.length[keep])
            total += s.pairs().ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    # the pair model learns from all background, then without the quarter most like credentials, then from all that it explains better than the automata
    def background_model(before: Automaton | None = None, most: int = 0) -> Automaton:
        table = np.zeros(129 * 129)
        for place, n in _counted(background, lambda it: pairs(it, before, most), "place", "n"):
            table[place] = n
        return pair_model(table.reshape(129, 129))

    plain = background_model()
    like = _scores(_counted(background, lambda it: _histogram((0, np.max(_likeness(s, automata, plain), axis=0)) for s in all_symbols(it)), "g", "score", "n"), 0)
    if len(like):
        plain = background_model(plain, round(like.at(math.floor(0.75 * (len(like) - 1))) * 1000))
        plain = background_model(plain, 0)
    others = _counted(background, lambda it: _histogram((g, x) for s in all_symbols(it) for g, x in zip(groups, _likeness(s, automata, plain), strict=True)), "g", "score", "n")

    def held_scores(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for g, fold, found in _parts(it):
            for (own, left), model in models.items():
                if len(mine := np.flatnonzero((g == own) & (fold == left))):
                    yield own, _likeness(Symbols.of([found[k] for k in mine]), [model], plain)[0]

    owns = _counted(strings, lambda it: _histogram(held_scores(it)), "g", "score", "n")
    forget(spark, values, strings, background)
    return Scorer(automata, [robust_threshold(_scores(owns, g), _scores(others, g)) for g in groups], plain)


class Coverage:
    """What spans cover, as intervals in order; spans that touch are one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def whole(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and end <= self.ends[k]

    def touches(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and start < self.ends[k]


def scan_chunk(texts: list[str], scorer: Scorer | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [[s[:3] for s in base_spans(t)] for t in texts]
    if scorer is None:
        yield from ((b, b) for b in base)
        return
    unique = list({v for t in texts for v in CANDIDATE.findall(t)})
    hits = {v for v, hit in zip(unique, scorer.formats(unique), strict=True) if hit}
    for text, own in zip(texts, base, strict=True):
        more = []
        if hits:
            done = Coverage([(s, e) for _, s, e in own])
            more = [("format", m.start(), m.end()) for m in CANDIDATE.finditer(text) if m[0] in hits and not done.whole(m.start(), m.end())]
        yield own, sorted(own + more, key=lambda s: (s[1], (*KINDS, "format").index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>, n_base, plus the digest columns) of each row of docs.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans (text),
    spans_found (the spans as an array), of code points, ends exclusive.
    """
    rows = text_rows(docs, id_col, text_col)
    scorer = docs.sparkSession.sparkContext.broadcast(learn(rows))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "spans_found"]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in chunks(batch.column(1)):
                texts = pc.fill_null(batch.column(1)[part.start : part.stop], "").to_pylist()
                out = [[] for _ in range(6)]
                for own, every in scan_chunk(texts, scorer.value):
                    for k, kind in enumerate(KINDS):
                        out[k].append(sum(s[0] == kind for s in own))
                    out[3].append(hashlib.sha256(joined(own).encode()).hexdigest())
                    out[4].append(joined(every))
                    out[5].append([{"kind": k, "start": s, "end": e} for k, s, e in every])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], span_type)], names=names)

    return rows.mapInArrow(batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, spans_found array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of docs, with every span of text_col replaced by the mark; null texts stay null."""
    small_batches(docs.sparkSession)
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col(text_col).cast("string").alias("text"))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in chunks(batch.column(1)):
                own = batch.column(1)[part.start : part.stop].to_pylist()
                texts = [t or "" for t in own]
                clean = [redacted(t, every, mark) for t, (_, every) in zip(texts, scan_chunk(texts, scorer.value), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array([None if t is None else c for t, c in zip(own, clean, strict=True)], pa.string())], names=["row_", "clean_"])

    rows = docs.select(F.struct("*").alias("row_"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(batches, f"row_ {rows.schema['row_'].dataType.simpleString()}, clean_ string")
    return done.select(*(F.col("clean_").alias(c) if c == text_col else F.col("row_").getField(c).alias(c) for c in docs.columns))
