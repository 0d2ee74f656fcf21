"""Near-duplicate vectors by a random-projection tree forest.

Every tree splits by random directions, one per level, at medians of a bounded
sample.  A vector within SPILL of a split goes to both sides, so two vectors
at cosine 0.98 part in one of TREES trees with a chance below one in a hundred
at the depths used, and in all of them practically never.  Below the depth the
sample supports, splits go through the centroid of the last sampled node.
Every row is indexed; only the sample reaches the driver.

Leaves are compared exactly (double precision) in blocks of BLOCK vectors; a
leaf that no split thins out, such as a great group of near copies, becomes
several block pairs, so no task holds more than two blocks and nothing is
dropped.  A pair that meets in several leaves counts in the least of them
only.  Tasks return one row per vector: how many links it has there, and the
least vector of its links' component.  Pairs are never written.

Equal vectors of one label are one vector with a multiplicity.  Vectors that
are null, zero, or hold null or non-finite components, and null labels, link
with nothing.  Vectors of different length are not compared.  Labels that are
not whole numbers are told apart by a 64-bit hash of their text.  Rows that
share a vec_id are vectors of their own: each counts the other as a link if
they are near.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm.common import mix
from tomewright.llm.graph import components
from tomewright.session import cut_lineage

TREES, SPILL, LEAF, BLOCK = 4, 0.025, 400, 1200


def directions(dim: int, tree: int, depth: int) -> np.ndarray:
    r = np.random.default_rng([dim, tree, 11]).normal(size=(max(depth, 1), dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def grow(x: np.ndarray, tree: int, depth: int, least: int = 64) -> tuple[np.ndarray, int]:
    """Split values of the sampled levels (heap order; nan where a node has too few samples), and their depth."""
    known = min(depth, max(int(math.log2(max(len(x) / least, 1))), 0))
    p = x @ directions(x.shape[1], tree, depth).T
    cut = np.full(2 ** (known + 1) - 1, np.nan)
    node = np.zeros(len(x), np.int64)
    for level in range(known):
        for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
            here = p[node == k, level]
            cut[k] = np.median(here) if len(here) else 0.0
        node = 2 * node + 1 + (p[:, level] >= cut[node])
    return cut, known


def leaves(x: np.ndarray, trees: list, depth: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf each unit vector falls into; ``trees`` from ``fit``."""
    rows, keys = [], []
    for t, (cut, known, centre) in enumerate(trees):
        r = directions(x.shape[1], t, depth)
        p, row, node, path = x @ r.T, np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
        for level in range(depth):
            if level < known:
                at = cut[node]
            else:                                   # node stays that of the last sampled level
                at = centre[node - (2 ** known - 1)] @ r[level]
            left, right = p[row, level] < at + spill, p[row, level] >= at - spill
            step = node if level >= known else None
            down = [(left, 1), (right, 2)]
            row = np.concatenate([row[m] for m, _ in down])
            path = np.concatenate([path[m] * np.uint64(2) + np.uint64(k - 1) for m, k in down])
            node = np.concatenate([(node[m] if step is not None else 2 * node[m] + k) for m, k in down])
        rows.append(row)
        keys.append(mix(path * np.uint64(2 * TREES + 1) + np.uint64(t + 1)))
    return np.concatenate(rows), np.concatenate(keys)


def fit(sample: np.ndarray, depth: int, n_trees: int) -> list:
    """Trees over unit vectors: split values, sampled depth, centroid of each node at that depth."""
    out = []
    for t in range(n_trees):
        cut, known = grow(sample, t, depth)
        p, node = sample @ directions(sample.shape[1], t, depth).T, np.zeros(len(sample), np.int64)
        for level in range(known):
            node = 2 * node + 1 + (p[:, level] >= cut[node])
        centre = np.zeros((2 ** known, sample.shape[1]))
        at = node - (2 ** known - 1)
        np.add.at(centre, at, sample)
        out.append((cut, known, centre / np.maximum(np.bincount(at, minlength=2 ** known), 1)[:, None]))
    return out


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(least: float):
    """One leaf block (or pair of blocks) -> links and local root of each vector."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = pdf["leaf"].iat[0], pdf["i"].iat[0], pdf["j"].iat[0]
        out = []
        for _, g in pdf.groupby(["label", "dim"]):
            g = g.sort_values("rep")
            x = unit(g["embedding"])
            own = g["own"].to_numpy()
            near = x @ x.T >= least
            if i != j:
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            busy = np.flatnonzero(near.any(axis=1))
            if not len(busy):
                continue
            near, g = near[np.ix_(busy, busy)], g.iloc[busy]
            # pairs that already share a smaller leaf count there
            before = [v[v < leaf] for v in (np.asarray(a, np.int64) for a in g["leaves"])]
            ids, inv = np.unique(np.concatenate(before), return_inverse=True)
            m = np.zeros((len(busy), max(len(ids), 1)), np.float32)
            m[np.repeat(np.arange(len(busy)), [len(v) for v in before]), inv] = 1
            fresh = near & (m @ m.T == 0)
            root = np.arange(len(busy))
            while True:
                new = np.minimum(root, np.where(near, root[None, :], len(busy)).min(axis=1))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            rep = g["rep"].to_numpy()
            out.append(pd.DataFrame({"rep": rep, "links": (fresh @ g["n"].to_numpy(np.int64)), "root": rep[root]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
    return run


def near_vectors(rows: DataFrame, least: float = 0.98, sample_rows: int = 20_000, trees: int = TREES, spill: float = SPILL,
                 leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per input row.

    ``sample_rows`` bounds the sample on which the trees are fitted.
    """
    e = F.col("embedding")
    good = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull()
            & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
            & F.exists(e, lambda v: v != 0))
    key = [F.xxhash64("label", "embedding", F.lit(s)).alias(f"k{s}") for s in (1, 2)]
    base = rows.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"), *key)
    uniq = cut_lineage(base.where("good").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"),
        F.first("label").alias("label"), F.first(F.size("embedding")).alias("dim")))
    most = uniq.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    depth = max(int(math.ceil(math.log2(max(most / leaf, 1)))), 0)
    dims = [r["dim"] for r in uniq.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dim").limit(64).collect()]
    fitted = {}
    for d in dims:
        got = uniq.where(F.col("dim") == d).orderBy(F.xxhash64("rep")).limit(sample_rows).select("embedding").toPandas()
        fitted[d] = fit(unit(got["embedding"]), depth, trees)

    def index(it):
        for b in it:
            n = b.num_rows
            dim = b.column(b.schema.get_field_index("dim")).to_numpy()
            label = mix(b.column(b.schema.get_field_index("label")).cast(pa.int64()).to_numpy().astype(np.uint64))
            vec = b.column(b.schema.get_field_index("embedding"))
            row, leaf_ = [], []
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                if d in fitted:
                    r, k = leaves(unit(vec.take(pa.array(at)).to_pylist()), fitted[d], depth, spill)
                else:                               # a rare length: one leaf, compared in blocks
                    r, k = np.arange(len(at)), np.zeros(len(at), np.uint64)
                row.append(at[r])
                leaf_.append(mix(k + label[at[r]] + np.uint64(d)))
            row, leaf_ = np.concatenate(row), np.concatenate(leaf_).view(np.int64)
            order = np.lexsort((leaf_, row))
            off = np.searchsorted(row[order], np.arange(n + 1))
            col = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(leaf_[order]))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, "leaves"])
    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.xxhash64(F.col("label").cast("string"))
    u = uniq.select("rep", "n", "embedding", label.alias("label"), "dim")
    placed = cut_lineage(u.mapInArrow(index, "rep long, n long, embedding " + rows.schema["embedding"].dataType.simpleString()
                                      + ", label long, dim int, leaves array<long>"))
    spots = placed.select("*", F.explode("leaves").alias("leaf"))
    sizes = spots.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    spots = spots.join(sizes, "leaf").withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    spots = spots.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spots = spots.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n",
                         "embedding", "label", "dim", "leaves")
    part = cut_lineage(spots.groupBy("leaf", "i", "j").applyInPandas(_compare(least), "rep long, links long, root long"))
    roots = components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = part.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (uniq.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l"), F.coalesce("root", "rep").alias("c")))
    out = base.select("vec_id", *[F.when(F.col("good"), F.col(k)).alias(k) for k in ("k1", "k2")]).join(known, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("c", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
