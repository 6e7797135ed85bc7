"""Mixing to target weights by soft membership, with DataFrame functions only.

1. A classifier learns from a labelled table (at most `sample` labelled
   documents, the first by hash): a naive Bayes over binned document measures
   and over marker words of each domain, also learnt. Its tables are literals
   of one Spark expression that gives every document its domain posteriors.
2. Rates r >= 0 of documents minimise the weighted squares of
   sum_i r_i n_i p_ik - target_k by projected gradient steps from r = 1, with
   momentum that starts anew where it goes too far. A step needs only the
   residual of each domain, which Spark sums; the rate of a document is a fold
   over the steps so far, so nothing but a few numbers goes to the driver and
   no lineage grows. Totals that stay short of the targets by more than the
   tolerance (they may be out of reach) are told by a warning and by Mix.gap.
3. A document gets floor(rate + u) copies, u a hash of its id in [0, 1): the
   expected token totals are the fitted ones.

A null text counts as empty, with no tokens. Null ids share one u. Labels that
are null don't teach; without labelled documents all domains are equally
likely. Repeated ids keep a row each. With no tokens at all every rate is 1.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACED = "lower(text_)"
for _c in ("\\n", "\\t", "\\r", "\\u000B", "\\u000C"):
    _SPACED = f"replace({_SPACED}, '{_c}', ' ')"
#: Words between white space: single characters are replaced and split on without regular expressions.
WORDS = f"array_remove(split({_SPACED}, ' ', -1), '')"
_PLAIN = "text_"
for _c in "#*$%&|<>":
    _PLAIN = f"replace({_PLAIN}, '{_c}', '')"
#: Bins of document measures, as SQL over text_, distinct_ (its distinct words) and n_ (its words).
MEASURES = {
    "length": "least(15, int(log2(1 + n_)))",
    "symbols": f"least(9, int(log2(1 + 64 * (length(text_) - length({_PLAIN})) / greatest(n_, 1))))",
    "shouts": "least(9, int(log2(1 + 64 * (length(text_) - length(replace(text_, '!', ''))) / greatest(n_, 1))))",
    "distinct": "least(10, int(10 * size(distinct_) / greatest(n_, 1)))",
}


def _measured(rows: DataFrame) -> DataFrame:
    """rows (row_, text_) with words_, distinct_, n_. A document's own columns are inside row_, so no name can clash."""
    rows = rows.withColumn("words_", F.expr(WORDS))
    return rows.withColumn("distinct_", F.array_distinct("words_")).withColumn("n_", F.size("words_").cast("long"))


def _text_array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_")


@dataclass
class Classifier:
    """Naive Bayes: log priors, marker words of each domain, and log likelihoods by measure, domain and bin."""

    domains: list[str]
    log_prior: list[float]
    markers: dict[str, list[str]]
    tables: dict[str, list[list[float]]]

    def bins(self) -> dict[str, Column]:
        found = {name: F.expr(sql) for name, sql in MEASURES.items()}
        return found | {f"marks_{d}": F.least(F.lit(3), F.size(F.array_intersect("marks_", _text_array(words)))) for d, words in self.markers.items()}

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with marks_: the marker words of any domain in each text."""
        every = sorted({w for words in self.markers.values() for w in words})
        return rows.withColumn("marks_", F.array_intersect("distinct_", _text_array(every)))

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """rows of _measured with posterior_: an array in the order of domains."""
        rows = self.marked(rows).withColumn("bins_", F.array(*(b.cast("int") for b in self.bins().values())))
        logs = []
        for k, prior in enumerate(self.log_prior):
            total = F.lit(prior)
            for m, name in enumerate(self.bins()):
                if name in self.tables:
                    total = total + F.get(F.array(*map(F.lit, self.tables[name][k])), F.get("bins_", F.lit(m)))
            logs.append(total)
        rows = rows.withColumn("logs_", F.array(*logs)).withColumn("logs_", F.expr("transform(logs_, x -> exp(x - array_max(logs_)))"))
        return rows.withColumn("posterior_", F.expr("transform(logs_, x -> x / aggregate(logs_, 0D, (a, b) -> a + b))"))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, markers: int = 16, support: int = 10) -> Classifier:
    """labels: (doc_id, domain). The sampled labels are at most `sample` rows and are broadcast, so no text is moved."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id_"), F.col("domain").alias("domain_")).where(F.col("label_id_").isNotNull() & F.col("domain_").isin(domains))
    known = known.orderBy(F.xxhash64("label_id_"), "label_id_", "domain_").limit(sample)
    taught = docs.select(F.col(id_col).cast("long").alias("label_id_"), _text(text_col)).join(F.broadcast(known), "label_id_")
    rows = written(_measured(taught).select("domain_", "text_", "distinct_", "n_"), "mixing-labelled")
    sizes = {r["domain_"]: r["n"] for r in rows.groupBy("domain_").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    model = Classifier(domains, [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains], {d: [] for d in domains}, {})
    if not total:
        return model
    seen = rows.select("domain_", F.explode("distinct_").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain_") == d, 1)).alias(f"n_{k}") for k, d in enumerate(domains))).where(f"n >= {support}")
    seen = written(seen, "mixing-words")
    for k, d in enumerate(domains):
        mine, rest = sizes.get(d, 0), total - sizes.get(d, 0)
        odds = F.log((F.col(f"n_{k}") + 0.5) / (mine + 1)) - F.log((F.col("n") - F.col(f"n_{k}") + 0.5) / (rest + 1))
        best = seen.where(F.col(f"n_{k}") >= support).select("word", odds.alias("odds")).where("odds > 1.5").orderBy(F.desc("odds"), "word").limit(markers)
        model.markers[d] = [r["word"] for r in best.collect()]
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), b.cast("int").alias("bin")) for m, b in model.bins().items()))).alias("c")
    counts: dict[tuple[str, str, int], int] = {(r["measure"], r["domain_"], r["bin"]): r["n"] for r in model.marked(rows).select("domain_", cells).select("domain_", "c.measure", "c.bin").groupBy("domain_", "measure", "bin").agg(F.count("*").alias("n")).collect()}
    for m in model.bins():
        width = 16 if m in MEASURES else 4
        model.tables[m] = [[math.log((counts.get((m, d, b), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * width)) for b in range(width)] for d in domains]
    return model


def _gap(reached: list[float], targets: list[float]) -> float:
    return max((abs(a - t) / max(t, 1e-6 * sum(targets)) for a, t in zip(reached, targets, strict=True) if sum(targets)), default=0.0)


@dataclass
class Mix:
    """A fitted mixing: the projected steps, the totals that it reached, and all rows (row_, n_, posterior_)."""

    domains: list[str]
    rows: DataFrame
    steps: list[tuple[list[float], float]]
    targets: list[float]
    reached: list[float]

    @property
    def gap(self) -> float:
        """The largest difference of a domain's total from its target, by the target."""
        return _gap(self.reached, self.targets)

    def rates(self, id_col: str = "doc_id") -> DataFrame:
        """All rows (row_, n_, posterior_) with rate_ and copies_."""
        rows = self.rows.withColumn("rate_", F.round(rate_after(self.steps, "posterior_")["r"], 9))
        u = F.pmod(F.xxhash64(F.col("row_").getField(id_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
        return rows.withColumn("copies_", F.floor(F.col("rate_") + u))


def rate_after(steps: list[tuple[list[float], float]], posterior: str) -> Column:
    """The fold of projected steps from rates of 1, as a struct: r, the rate, and y, where the next gradient is taken.

    A step (g, b): r' = max(0, y - p . g), y' = r' + b (r' - r).
    """
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return start
    moves = F.array(*(F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(float(b)).alias("b")) for g, b in steps))
    dot = lambda g: F.aggregate(F.zip_with(F.col(posterior), g, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    moved = lambda at, s: F.greatest(F.lit(0.0), at["y"] - dot(s["g"]))
    ahead = lambda r, at, s: F.struct(r.alias("r"), (r + s["b"] * (r - at["r"])).alias("y"))
    return F.aggregate(moves, start, lambda at, s: F.transform(F.array(moved(at, s)), lambda r: ahead(r, at, s))[0])


def fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float], epochs: float = 1.0, main: str | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 60, tolerance: float = 1e-3, sample: int = 20_000, keep: list[str] | None = None) -> Mix:
    """Fit rates whose expected token totals are in proportion to weights.

    keep: the columns of docs that the fitted rows hold, all unless given.
    The totals are such that the domain `main` (the heaviest by weight) gets
    `epochs` times the tokens that it has. The steps go on until all totals are
    within `tolerance` of their targets or come no nearer; `rounds` only guards
    against a search without end, and what is left is told by a warning.
    """
    domains = sorted(weights)
    model = fit_classifier(docs, labels, domains, id_col, text_col, sample)
    # texts are read once: what follows reads the posteriors, and the rows once more at the end
    own = docs.select(F.struct(*(keep if keep is not None else docs.columns)).alias("row_"), _text(text_col))
    whole = written(model.posteriors(_measured(own)).select("row_", "n_", "posterior_"), "mixing-posteriors")
    rows = whole.select("n_", "posterior_")
    p = [F.get("posterior_", F.lit(k)) for k in range(len(domains))]

    size = len(domains)

    def sums(steps: list[tuple[list[float], float]], *more: Column) -> list[float]:
        """Totals of the domains at r, then at y, then sums of more."""
        at = rows.withColumn("at_", rate_after(steps, "posterior_"))
        return list(at.agg(*(F.coalesce(F.sum(F.col(f"at_.{x}") * F.col("n_") * q), F.lit(0.0)) for x in "ry" for q in p), *(F.coalesce(F.sum(m), F.lit(0.0)) for m in more)).first())

    # the Gram matrix of posteriors, weighted by tokens; its row sums are the tokens that a domain has
    first = sums([], *(F.col("n_") * a * b for a in p for b in p))
    natural, gram = first[:size], np.array(first[2 * size :]).reshape(size, size)
    main = main or max(domains, key=lambda d: (weights[d], d))
    total = epochs * natural[domains.index(main)] / weights[main]
    targets = [total * weights[d] for d in domains]
    if not sum(natural) or not total:
        return Mix(domains, whole, [], targets, natural)
    # squared differences are weighted by 1 / row sum: the gradient, in the metric of tokens, is p . (difference / row sum),
    # so a rate depends on posteriors alone, and no eigenvalue is over 1, so whole steps never overshoot
    width = np.maximum(gram.sum(axis=1), 1e-6 * sum(natural))
    loss = lambda now: float((np.square(np.subtract(now, targets)) / width).sum())
    steps: list[tuple[list[float], float]] = []
    reached, ahead, pace, still = natural, natural, 1.0, 0
    while len(steps) < rounds and still < 3 and _gap(reached, targets) >= tolerance:
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        steps.append(((np.subtract(ahead, targets) / width).tolist(), (pace - 1) / faster))
        now = sums(steps)
        after, ahead = now[:size], now[size:]
        still = still + 1 if loss(after) > 0.99 * loss(reached) else 0
        if loss(after) > loss(reached):  # the momentum went too far: start anew from here
            steps[-1], ahead, faster = (steps[-1][0], 0.0), after, 1.0
        reached, pace = after, faster
    found = Mix(domains, whole, steps, targets, reached)
    if found.gap >= tolerance:
        warnings.warn(f"mixing totals stay {found.gap:.2%} from the targets: {dict(zip(domains, zip(reached, targets, strict=True), strict=True))}", stacklevel=2)
    return found


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], epochs: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, each as often as its copies say."""
    rows = fit(docs, label_domains(labels), weights, epochs, id_col=id_col, text_col=text_col).rates(id_col)
    return rows.where("copies_ > 0").select("row_", F.explode(F.expr("sequence(1, copies_)"))).select("row_.*")


#: The shares of expected tokens that the production query asks for.
WEIGHTS = {"clean": 0.94, "junk": 0.02, "toxic": 0.04}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): junk where quality is 0, else toxic where toxic is 1, else clean; null quality gives none."""
    return labels.select("doc_id", F.expr("case when quality = 0 then 'junk' when quality is null then null when toxic = 1 then 'toxic' else 'clean' end").alias("domain"))


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, epochs: float = 1.1) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = fit(docs, label_domains(labels), weights, epochs, keep=["doc_id"])
    shares = [F.get("posterior_", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(found.domains)]
    return found.rates().select("row_.doc_id", F.col("n_").alias("n_tokens"), *shares, F.col("rate_").alias("rate"), F.col("copies_").cast("long").alias("copies"))
