"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label (by two 64-bit hashes) become one node with a weight.
The nodes of a label are dealt to tiles; each pair of tiles is a task. A task
multiplies the int8 tiles (in float32, SLAB components at a time, so that the
integer products are exact) and adds for each vector the norm of its own
quantisation error: an upper bound of the cosine. Only pairs whose bound reaches
the threshold are computed again in double precision, from the vectors as they
were given. A task sends counts of links and a forest of links, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing. Vectors of different lengths don't
link. A row that repeats an id counts as another vector; a row with a null id
counts too, but names no component. Extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, task_tables, union_find, written

TILE_ROWS = 2048
#: 127 * 127 * SLAB is under 2 ** 24, up to where float32 counts exactly.
SLAB = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, the step of each, and a bound of the norm of each one's error."""
    step = np.abs(x).max(axis=1) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    error = np.linalg.norm(x - code * step[:, None], axis=1)
    return code, step, error * (1 + 1e-12) + 1e-14


def scaled(v: np.ndarray) -> np.ndarray:
    """By powers of two, so that no component is over 1; that loses no digit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, all of a by all of b."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLAB):
        out += a[:, at : at + SLAB].astype(np.float32) @ b[:, at : at + SLAB].astype(np.float32).T
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of vectors with cosine >= threshold, in double precision; b None: pairs i < j within a."""
    a = scaled(a)
    square_a = np.einsum("nd,nd->n", a, a)
    qa, sa, ea = quantise(a / np.sqrt(square_a)[:, None])
    if b is None:
        other, square_b, qb, sb, eb = a, square_a, qa, sa, ea
    else:
        other = scaled(b)
        square_b = np.einsum("nd,nd->n", other, other)
        qb, sb, eb = quantise(other / np.sqrt(square_b)[:, None])
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and |x'| <= 1 + |x - x'|; 1e-9 covers rounding here
    for at in range(0, len(a), rows):
        product = int_products(qa[at : at + rows], qb)
        bound = product * (sa[at : at + rows, None] * sb) + (ea[at : at + rows, None] + (1 + ea[at : at + rows, None]) * eb) + 1e-9
        i, j = np.nonzero(bound >= threshold)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            hit = np.einsum("nd,nd->n", a[p], other[q]) / np.sqrt(square_a[p] * square_b[q]) >= threshold
            if hit.any():
                yield p[hit], q[hit]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for rows in task_tables(batches):
        rows = rows.combine_chunks()
        side = rows["side"].to_numpy()
        vectors = rows["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(side), -1)
        node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
        cut = int((side == 0).sum())
        if cut == 0 or (own := len(side) == cut) and cut == 1:
            continue
        count = np.zeros(len(side), np.int64)
        left, right = node[:0], node[:0]
        for p, q in linked_pairs(vectors[:cut], None if own else vectors[cut:], threshold):
            q = q if own else q + cut
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            nodes, low = union_find(np.concatenate([left, node[p]]), np.concatenate([right, node[q]]))
            left, right = low[nodes != low], nodes[nodes != low]
        some = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(count[some])], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.nulls(len(left), pa.int64())], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs of equal label with cosine >= threshold."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # what tasks are sent; they compute in doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("label"))
    fit = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("half", F.expr(f"if({fit}, xxhash64(label, v), null)")).withColumn("rest", F.expr("if(half is null, null, xxhash64('rest', v, label))"))
    nodes = rows.where("half is not null").groupBy("half", "rest").agg(F.count("*").alias("weight"), F.min("label").alias("label"), F.min("v").alias("v"))
    # a node's number is fixed as it is written
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "embedding-nodes").withColumn("size", F.size("v"))
    ids = rows.select("vec_id", "half", "rest").join(nodes.select("half", "rest", "node"), ["half", "rest"], "left").select("vec_id", "node")
    tiles = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / tile_rows).alias("tiles"))
    placed = nodes.join(tiles, ["label", "size"]).withColumn("tile", F.expr("pmod(hash(node), tiles)"))
    pairs = F.explode(F.expr("transform(sequence(0, tiles - 1), k -> named_struct('p', least(k, tile), 'q', greatest(k, tile), 'side', if(k < tile, 1, 0)))"))
    tasks = placed.select("label", "size", "node", "weight", "v", pairs.alias("t")).select(F.xxhash64("label", "size", "t.p", "t.q").alias("task"), "t.side", "node", "weight", "v")
    work = tasks.repartition("task").sortWithinPartitions("task", "side")
    found = written(work.mapInArrow(lambda it: _compare(it, threshold), "a long, b long, n long"), "embedding-links")

    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"), "embedding-groups").toDF("node", "group")
    facts = nodes.select("node", "weight").join(counts, "node", "left").join(groups, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("group", "node").alias("group"))
    known = ids.join(facts, "node", "left")
    low = known.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("low"))
    out = known.join(low, "group", "left").withColumn("component_id", F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
