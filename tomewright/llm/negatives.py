"""Hard negatives by angular triangle filtering.

Vectors become integers, floor(scale * x); a score is their inner product.
For every anchor the first ``positives`` other rows of its label are its
positives, and for each positive the first ``negatives`` rows of other labels
whose score lies between ``low`` and ``high`` per cent of the positive's.
Higher scores come first, ties by smaller vec_id.

* Angles.  Each row stores its angles to a few reference directions (spread
  out over a bounded sample).  If an anchor has angle a to a direction and a
  row has t, the angle between both lies in [|a - t|, min(a + t, 2 pi - a - t)];
  cosines times norms bound the score, widened by more than any rounding.
* Blocks.  Rows are range-partitioned by label, nearest direction and angle
  and cut into blocks.  The extremes of each block (a small table, its size
  bounded by growing blocks beyond BLOCKS) tell for every anchor which blocks
  can hold a positive, or a negative inside one of its windows.  Only these
  pairs of an anchor and a block meet; anchors come in chunks, so a task holds
  one block and one chunk.
* Scoring.  Inside such a pair only rows whose bounds overlap a window are
  scored, in exact integer arithmetic.  A block returns at most ``positives``
  or ``negatives`` rows an anchor and positive, which are then ranked.

The bounds only save work, so results are exact.  Rows with a null vec_id,
label or vector or a null or non-finite component take no part; vectors of
different length don't meet; the zero vector scores 0.  Repeated rows and ids
are rows of their own (an anchor's twin is another row); ties beyond vec_id
go by place.  Labels are compared as text.  Components beyond 2**52 count as
2**52, scores beyond a long as its limit.  An empty table or no anchor gives
no rows.  Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright.session import cut_lineage

REFERENCES, SAMPLE, DIMS = 8, 2048, 16      # directions per vector length, rows they are chosen from, lengths that are sampled
BLOCK, BLOCKS, CHUNK = 4096, 65_536, 2048   # rows of a block, blocks before they grow, anchors of a chunk
CELL = 1 << 20                              # pairs whose bounds a task holds at once
EPS, SLACK = 1e-6, 1e-9                     # radians and relative score by which bounds are widened
LIMIT = 2 ** 52
ROW = "block long, pos long, vec_id long, lab string, dim int, v binary, norm double, ang binary"


def integers(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of equal length, kept within LIMIT."""
    with np.errstate(over="ignore"):
        x = np.floor(np.array(vectors, float).reshape(len(vectors), -1) * scale)
    return np.clip(x, -LIMIT, LIMIT).astype(np.int64)


def reference_directions(sample: np.ndarray, dim: int, count: int = REFERENCES) -> np.ndarray:
    """Unit directions: the sample's first row, then always the one farthest from those chosen."""
    norm = np.linalg.norm(sample, axis=1) if len(sample) else np.zeros(0)
    unit = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        r = np.random.default_rng([dim, 12]).normal(size=(count, max(dim, 1)))
        return (r / np.linalg.norm(r, axis=1, keepdims=True))[:, :dim]
    chosen, near = [unit[0]], unit @ unit[0]
    while len(chosen) < count:
        far = int(near.argmin())
        chosen.append(unit[far])
        near = np.maximum(near, unit @ unit[far])
    return np.array(chosen)


def angles(v: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the references (a zero vector: angles 0, its bounds vanish with the norm)."""
    x = v.astype(float)
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = np.nan_to_num((x @ refs.T) / norm[:, None], nan=1.0)
    return norm, np.arccos(np.clip(cos, -1, 1))


def score_bounds(near: np.ndarray, far: np.ndarray, norm_lo: np.ndarray, norm_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score at angles near .. far and products of norms norm_lo .. norm_hi."""
    top, bottom = np.cos(np.maximum(near - EPS, 0)), np.cos(np.minimum(far + EPS, np.pi))
    slack = SLACK * norm_hi + 1e-6
    up = np.floor(np.where(top > 0, norm_hi, norm_lo) * top + slack)
    low = np.ceil(np.where(bottom > 0, norm_lo, norm_hi) * bottom - slack)
    return low, up


def pair_bounds(a_ang: np.ndarray, a_norm: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_lo: np.ndarray,
                n_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds of anchors against rows (lo = hi) or blocks whose angles to each reference lie in lo .. hi."""
    near, far = np.zeros((len(a_ang), len(lo))), np.full((len(a_ang), len(lo)), np.pi)
    for j in range(a_ang.shape[1]):
        a = a_ang[:, j, None]
        np.maximum(near, np.maximum(a - hi[:, j], lo[:, j] - a), out=near)
        # greatest angle: min(s, 2 pi - s) for sums s in a + lo .. a + hi peaks at pi
        s, t = a + hi[:, j], 2 * np.pi - a - lo[:, j]
        np.minimum(far, np.minimum(np.minimum(s, t), np.pi), out=far)
    return score_bounds(near, far, a_norm[:, None] * n_lo, a_norm[:, None] * n_hi)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while these are exact, else in Python integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    big = a.astype(object) @ b.T.astype(object)
    return np.clip(big, 1 - 2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _unpack(col: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1)


def _place(rows: DataFrame, scale: float, block: int) -> DataFrame:
    """ROW of all rows that take part, in blocks of like label and direction."""
    e = F.col("embedding")
    good = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull()
            & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    base = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("lab"),
                                   e.cast("array<double>").alias("e"), F.size("embedding").alias("dim"))
    common = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()
    refs = {}
    for r in common:
        got = base.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id", "e").limit(SAMPLE).select("e").collect()
        refs[r["dim"]] = reference_directions(integers([x["e"] for x in got], scale).astype(float), r["dim"])
    n_rows = sum(r["n"] for r in common)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dim, vec = b.column(3).to_numpy(), b.column(2)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                v = integers(vec.take(pa.array(at)).to_pylist(), scale)
                norm, ang = angles(v, refs[d] if d in refs else reference_directions(np.zeros((0, d)), d))
                near = ang.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), _pack(v),
                     pa.array(norm), _pack(ang), pa.array(near, pa.int32()), pa.array(ang[np.arange(len(at)), near])],
                    names=["vec_id", "lab", "dim", "v", "norm", "ang", "near", "theta"])
    placed = base.mapInArrow(index, ROW.split("pos long, ")[1] + ", near int, theta double")
    order = ["dim", "lab", "near", "theta", F.xxhash64("vec_id"), "vec_id", "v"]
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / (64 * block)))
    most = max(block, math.ceil(n_rows / BLOCKS))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled, last = TaskContext.get().partitionId() << 32, 0, None
        for b in it:
            dims, blocks, pos = b.column(2).to_pylist(), [], []
            for d in dims:
                if filled == most or d != last:
                    number, filled, last = number + 1, 0, d
                blocks.append(number)
                pos.append(filled)
                filled += 1
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(pos, pa.int64()), *b.columns[:6]],
                                             names=["block", "pos", *b.schema.names[:6]])
    return cut_lineage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, ROW))


class Blocks:
    """Extremes of all blocks, at most about BLOCKS rows: angles to each reference, norms, labels, sizes."""

    def __init__(self, placed: DataFrame):
        def extremes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for (block, dim), g in pdf.groupby(["block", "dim"]):
                    ang = _unpack(g["ang"], np.float64)
                    yield pd.DataFrame({"block": [block], "dim": [dim], "n": [len(g)], "lab_lo": [g["lab"].min()], "lab_hi": [g["lab"].max()],
                                        "norm_lo": [g["norm"].min()], "norm_hi": [g["norm"].max()],
                                        "lo": [ang.min(axis=0).tolist()], "hi": [ang.max(axis=0).tolist()]})
        part = placed.select("block", "dim", "lab", "norm", "ang").mapInPandas(
            extremes, "block long, dim int, n long, lab_lo string, lab_hi string, norm_lo double, norm_hi double, lo array<double>, hi array<double>")
        pdf = part.groupBy("block", "dim").agg(
            F.sum("n").alias("n"), F.min("lab_lo").alias("lab_lo"), F.max("lab_hi").alias("lab_hi"), F.min("norm_lo").alias("norm_lo"),
            F.max("norm_hi").alias("norm_hi"), *[F.min(F.col("lo")[j]).alias(f"lo{j}") for j in range(REFERENCES)],
            *[F.max(F.col("hi")[j]).alias(f"hi{j}") for j in range(REFERENCES)]).toPandas().sort_values("block")
        self.block, self.dim, self.n = (pdf[c].to_numpy(np.int64) for c in ("block", "dim", "n"))
        self.lab_lo, self.lab_hi = (pdf[c].to_numpy(object) for c in ("lab_lo", "lab_hi"))
        self.norm_lo, self.norm_hi = (pdf[c].to_numpy(float) for c in ("norm_lo", "norm_hi"))
        self.lo, self.hi = (pdf[[f"{k}{j}" for j in range(REFERENCES)]].to_numpy(float) for k in ("lo", "hi"))

    def of_dim(self, d: int) -> "Blocks":
        out = object.__new__(Blocks)
        at = self.dim == d
        out.__dict__.update({k: v[at] for k, v in self.__dict__.items()})
        return out


def kth_bound(low: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the score that k rows reach for sure, given blocks of n rows with least score low (-inf: none)."""
    order = np.argsort(-low, axis=1, kind="stable")
    enough = np.cumsum(np.take_along_axis(n, order, axis=1), axis=1) >= k
    first = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
    return np.where(enough.any(axis=1), np.take_along_axis(low, first, axis=1)[:, 0], -np.inf)


def _meet(anchors: DataFrame, blocks: Blocks, choose: Callable, extra: str) -> DataFrame:
    """Each anchor once per block that ``choose`` keeps for it, with ``extra`` columns passed through."""
    shared = anchors.sparkSession.sparkContext.broadcast(blocks)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for d, g in pdf.groupby("dim"):
                own = shared.value.of_dim(d)
                step = max(CELL // max(len(own.n), 1), 1)
                for lo in range(0, len(g), step):
                    part = g.iloc[lo:lo + step]
                    low, up = pair_bounds(_unpack(part["ang"], np.float64), part["norm"].to_numpy(), own.lo, own.hi, own.norm_lo, own.norm_hi)
                    a, b = np.nonzero(choose(part, own, low, up))
                    yield part.iloc[a].assign(block=own.block[b])
    return anchors.mapInPandas(run, "block long, chunk int, ablock long, apos long, vec_id long, lab string, dim int, v binary, norm double, "
                                    "ang binary" + extra)


def _cells(near: DataFrame, placed: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` over every (block, chunk) in which an anchor and a block meet."""
    pairs = near.select(F.col("block").alias("block"), F.col("chunk").alias("chunk")).distinct()     # columns of their own
    rows = placed.join(pairs, "block")
    return near.groupBy("block", "chunk").cogroup(rows.groupBy("block", "chunk")).applyInPandas(kernel, schema)


def _portions(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple]:
    """Portions of anchors with their bounds against all rows of the block."""
    b_ang, b_norm, b_v = _unpack(rows["ang"], np.float64), rows["norm"].to_numpy(), _unpack(rows["v"], np.int64)
    step = max(CELL // max(len(rows), 1), 1)
    for lo in range(0, len(anchors), step):
        part = anchors.iloc[lo:lo + step]
        low, up = pair_bounds(_unpack(part["ang"], np.float64), part["norm"].to_numpy(), b_ang, b_ang, b_norm, b_norm)
        yield part, _unpack(part["v"], np.int64), b_v, low, up


def _scored(a_v: np.ndarray, b_v: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that any anchor of the portion needs, and their scores."""
    cols = np.flatnonzero(mask.any(axis=0))
    return cols, exact_scores(a_v, b_v[cols])


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Rows (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition over vec_id that marks the anchors.
    """
    placed = _place(rows, scale, block)
    blocks = Blocks(placed)
    chosen = placed.where(anchor)
    n_chunks = max(math.ceil(chosen.count() / chunk), 1)
    chosen = chosen.select(F.lit(0).cast("long").alias("block"), F.pmod(F.xxhash64("block", "pos"), F.lit(n_chunks)).cast("int").alias("chunk"),
                           F.col("block").alias("ablock"), F.col("pos").alias("apos"), "vec_id", "lab", "dim", "v", "norm", "ang")

    def may_hold_positive(part: pd.DataFrame, own: Blocks, lo: np.ndarray, up: np.ndarray) -> np.ndarray:
        lab = part["lab"].to_numpy(object)[:, None]
        some, all_ = (own.lab_lo <= lab) & (lab <= own.lab_hi), (own.lab_lo == lab) & (own.lab_hi == lab)
        others = own.n - (own.block == part["ablock"].to_numpy()[:, None])
        least = kth_bound(np.where(all_, lo, -np.inf), np.where(all_, others, 0), positives)
        return some & (up >= least[:, None])

    def first_positives(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        lab, vec, pos = rows["lab"].to_numpy(object), rows["vec_id"].to_numpy(), rows["pos"].to_numpy()
        for part, a_v, b_v, lo, up in _portions(anchors, rows):
            mask = (lab == part["lab"].to_numpy(object)[:, None]) & ~((part["ablock"].to_numpy() == key[0])[:, None]
                                                                      & (part["apos"].to_numpy()[:, None] == pos))
            least = kth_bound(np.where(mask, lo, -np.inf), mask.astype(np.int64), positives)
            mask &= up >= least[:, None]
            cols, score = _scored(a_v, b_v, mask)
            for r in range(len(part)):
                at = np.flatnonzero(mask[r, cols])
                s = score[r, at]
                if len(at) > positives:                 # the best and all that tie with the last of them
                    keep = s >= np.partition(s, len(s) - positives)[len(s) - positives]
                    at, s = at[keep], s[keep]
                c = cols[at]
                first = np.lexsort((pos[c], vec[c], -s))[:positives]
                out.append(pd.DataFrame({"ablock": part["ablock"].iat[r], "apos": part["apos"].iat[r], "positive_id": vec[c][first],
                                         "positive_score": s[first], "block": key[0], "pos": pos[c][first]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["ablock", "apos", "positive_id", "positive_score", "block", "pos"])

    found = _cells(_meet(chosen, blocks, may_hold_positive, ""), placed, first_positives,
                   "ablock long, apos long, positive_id long, positive_score long, block long, pos long")
    own = Window.partitionBy("ablock", "apos").orderBy(F.desc("positive_score"), "positive_id", "block", "pos")
    best = found.withColumn("k", F.row_number().over(own)).where(F.col("k") <= positives)
    best = best.groupBy("ablock", "apos").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("p"))
    best = best.select("ablock", "apos", F.transform("p", lambda x: x["positive_id"]).alias("p_ids"),
                       F.transform("p", lambda x: x["positive_score"]).alias("p_scores"))
    ready = cut_lineage(chosen.join(best, ["ablock", "apos"]).select(*chosen.columns, "p_ids", "p_scores"))

    def may_hold_negative(part: pd.DataFrame, own: Blocks, lo: np.ndarray, up: np.ndarray) -> np.ndarray:
        lab = part["lab"].to_numpy(object)[:, None]
        none, some = (own.lab_lo > lab) | (own.lab_hi < lab), ~((own.lab_lo == lab) & (own.lab_hi == lab))
        out = np.zeros(lo.shape, bool)
        for k in range(positives):
            p = np.array([s[k] if len(s) > k else -1 for s in part["p_scores"]], float)[:, None]
            hit = some & (p >= 0) & (100 * up >= low * p) & (100 * lo <= high * p)
            sure = none & (100 * lo >= low * p) & (100 * up <= high * p)
            least = kth_bound(np.where(sure, lo, -np.inf), np.where(sure, own.n, 0), negatives)
            out |= hit & (up >= least[:, None])
        return out

    def first_negatives(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        lab, vec, pos = rows["lab"].to_numpy(object), rows["vec_id"].to_numpy(), rows["pos"].to_numpy()
        for part, a_v, b_v, lo, up in _portions(anchors, rows):
            other = lab != part["lab"].to_numpy(object)[:, None]
            mask = np.zeros(other.shape, bool)
            for k in range(positives):
                p = np.array([s[k] if len(s) > k else -1 for s in part["p_scores"]], float)[:, None]
                mask |= other & (p >= 0) & (100 * up >= low * p) & (100 * lo <= high * p)
            cols, score = _scored(a_v, b_v, mask)
            for r in range(len(part)):
                at = np.flatnonzero(mask[r, cols])
                order = np.lexsort((pos[cols[at]], vec[cols[at]], -score[r, at]))
                c, s = cols[at][order], score[r, at][order]
                for k, (i, p) in enumerate(zip(part["p_ids"].iat[r], part["p_scores"].iat[r])):
                    # 100 * s <= high * p and 100 * s >= low * p in whole numbers
                    a, z = np.searchsorted(-s, -((high * int(p)) // 100)), np.searchsorted(-s, (-low * int(p)) // 100, side="right")
                    z = min(z, a + negatives)
                    if z > a:
                        out.append((part["ablock"].iat[r], part["apos"].iat[r], part["vec_id"].iat[r], k, i, p, vec[c][a:z], s[a:z], pos[c][a:z]))
        n = [len(o[6]) for o in out]
        cols = {name: np.repeat(np.array([o[j] for o in out], np.int64), n)
                for j, name in enumerate(("ablock", "apos", "anchor_id", "k", "positive_id", "positive_score"))}
        cols |= {name: np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64)
                 for j, name in ((6, "negative_id"), (7, "negative_score"), (8, "pos"))}
        return pd.DataFrame(cols | {"block": np.full(sum(n), key[0], np.int64)})

    near = _meet(ready, blocks, may_hold_negative, ", p_ids array<long>, p_scores array<long>")
    got = _cells(near, placed, first_negatives, "ablock long, apos long, anchor_id long, k long, positive_id long, positive_score long, "
                                                "negative_id long, negative_score long, pos long, block long")
    own = Window.partitionBy("ablock", "apos", "k").orderBy(F.desc("negative_score"), "negative_id", "block", "pos")
    got = got.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= negatives)
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
