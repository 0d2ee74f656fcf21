"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (its whole text; a short rest
joins the passage before).  Every passage is encoded as shares of byte classes
and of repeated words.  A gated attention (tanh times sigmoid) gives each
passage a weight within its document; the weighted sum of the encodings is
scored by a logistic unit.  All parameters are learned from document labels
only, by mini-batch Adam in numpy on a bounded sample; scoring runs on Spark.

Null and empty texts are one empty passage.  Without labels of both classes
every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import (IS_SPACE, add_columns, byte_rows, byte_set, labelled_sample, map_batches, remainder,
                                   run_starts, segment_hash, words)

PASSAGE, LEAST = 64, 16
MARKS = "!?.,;:'\"()[]{}<>|#*$%&@+=-_/\\~^`"
KINDS = 5 + len(MARKS)
WIDTH = KINDS + 6

_kind = np.full(256, 5 + len(MARKS), np.int64)         # the last: control bytes, not used
_kind[[*range(97, 123)]] = 0
_kind[[*range(65, 91)]] = 1
_kind[[*range(48, 58)]] = 2
_kind[128:] = 3
_kind[10] = 4
for _i, _c in enumerate(MARKS):
    _kind[ord(_c)] = 5 + _i


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and the row each belongs to (every row has at least one)."""
    raw, off = byte_rows(col)
    n = len(off) - 1
    start, end, row = words(raw, off)
    count = np.bincount(row, minlength=n)
    parts = np.maximum((count + PASSAGE - LEAST) // PASSAGE, 1)
    first = np.r_[0, np.cumsum(parts)]
    begin = np.r_[0, np.cumsum(count)][:-1]
    inside = np.arange(len(row)) - begin[row]
    pid = first[row] + np.minimum(inside // PASSAGE, parts[row] - 1)      # passage of each word
    total = int(first[-1])
    prow = np.repeat(np.arange(n), parts)
    x = np.zeros((total, WIDTH))
    if len(row):
        # bytes belong to the passage of the word before (or the first of the row)
        lead = run_starts(pid)
        cuts = start[lead].copy()
        fresh = np.r_[True, row[lead][1:] != row[lead][:-1]]
        cuts[fresh] = off[row[lead[fresh]]]
        own = np.repeat(pid[lead], np.diff(np.r_[cuts, len(raw)])) if len(lead) else np.zeros(0, np.int64)
        use = raw[cuts[0]:]
        hist = np.bincount(own * (KINDS + 1) + _kind[use], minlength=total * (KINDS + 1)).reshape(total, -1)[:, :KINDS]
        nw = np.maximum(np.bincount(pid, minlength=total), 1)[:, None]
        h = segment_hash(raw, start, end)
        size = end - start
        key = np.unique(np.c_[pid.astype(np.uint64), h], axis=0)[:, 0].astype(np.int64) if len(h) < 64 else _distinct(pid, h)
        distinct = np.bincount(key, minlength=total)
        twins = np.bincount(pid[1:][(h[1:] == h[:-1]) & (pid[1:] == pid[:-1])], minlength=total)
        shout = np.bincount(pid[IS_UPPER[raw[start]] & IS_UPPER[raw[np.maximum(end - 3, start)]]], minlength=total)
        mean = np.bincount(pid, size, minlength=total)
        x[:, :KINDS] = np.log1p(hist / nw * 4.0)
        x[:, KINDS:] = np.c_[distinct / nw[:, 0], twins / nw[:, 0], shout / nw[:, 0], np.minimum(mean / nw[:, 0], 30) / 10,
                             np.minimum(nw[:, 0] / PASSAGE, 1.5), np.bincount(pid, minlength=total) == 0]
    else:
        x[:, -1] = 1.0
    return x, prow


IS_UPPER = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _distinct(pid: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Passage of every distinct (passage, word)."""
    order = np.lexsort((h, pid))
    p, w = pid[order], h[order]
    return p[np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])]]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray               # hidden x width
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def forward(self, x: np.ndarray, bag: np.ndarray):
        """Standardised encodings and ascending bag numbers -> everything backward needs."""
        t, s = np.tanh(x @ self.v.T), 1 / (1 + np.exp(-np.clip(x @ self.u.T, -30, 30)))
        e = (t * s) @ self.w
        at = run_starts(bag)
        size = np.diff(np.r_[at, len(bag)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        a = e / np.repeat(np.add.reduceat(e, at), size)
        z = np.add.reduceat(a[:, None] * x, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))
        return p, z, a, t, s, at, size

    def score(self, col: pa.Array) -> np.ndarray:
        x, row = encode(col)
        return self.forward((x - self.mean) / self.scale, row)[0] if len(row) else np.zeros(0)


@dataclass
class Constant:
    value: float

    def score(self, col: pa.Array) -> np.ndarray:
        return np.full(len(col), self.value)


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 16, epochs: int = 25, seed: int = 5,
        decay: float = 1e-4) -> Model:
    """Learn all parameters; ``bag`` numbers rows of ``y`` and ascends."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / scale
    d = x.shape[1]
    m = Model(mean, scale, rng.normal(0, d ** -0.5, (hidden, d)), rng.normal(0, d ** -0.5, (hidden, d)),
              rng.normal(0, 0.1, hidden), np.zeros(d), 0.0)
    names = ("v", "u", "w", "c", "b")
    mom = {k: [np.zeros_like(np.asarray(getattr(m, k), float)), np.zeros_like(np.asarray(getattr(m, k), float))] for k in names}
    first = np.r_[run_starts(bag), len(bag)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for lo in range(0, len(order), 256):
            pick = order[lo:lo + 256]
            size = first[pick + 1] - first[pick]
            rows = np.repeat(first[pick] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            xb = x[rows]
            p, z, a, t, s, at, _ = m.forward(xb, np.repeat(np.arange(len(pick)), size))
            delta = (p - y[pick]) * weight[pick] / len(pick)
            da = np.repeat(delta, size) * (xb @ m.c)
            de = a * (da - np.repeat(np.add.reduceat(a * da, at), size))
            dg = de[:, None] * m.w
            grad = {"v": (dg * s * (1 - t * t)).T @ xb, "u": (dg * t * s * (1 - s)).T @ xb, "w": (t * s).T @ de,
                    "c": z.T @ delta, "b": delta.sum()}
            step += 1
            for k in names:
                value, (m1, m2) = np.asarray(getattr(m, k), float), mom[k]
                g = grad[k] + (decay * value if k != "b" else 0)
                m1[...] = 0.9 * m1 + 0.1 * g
                m2[...] = 0.999 * m2 + 0.001 * g * g
                new = value - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
                setattr(m, k, new if k != "b" else float(new))
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 200_000) -> Model | Constant:
    """Fit on at most ``2 * per_class`` labelled training texts of at most ``longest`` characters.

    Rows with crc32(doc_id) mod 3 = 1 are never used.  Passage encodings of
    the sample reach the driver; classes are weighted back to their shares.
    """
    sample = labelled_sample(docs, labels, "quality", 3, 1, per_class).where(F.length("text") <= longest)
    sizes = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1)).where(remainder(3) != 1)
             .groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, row = encode(b.column(0))
        ends = np.r_[run_starts(row), len(row)] * WIDTH
        return pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                                                pa.array(x.ravel(), pa.float64()))], names=["y", "x"])
    rows = map_batches(sample.select("text", F.col("y")), run, "text", "y int, x array<double>").toPandas()
    total = sum(sizes.values())
    if rows["y"].nunique() < 2:
        return Constant(sizes.get(1, 0) / total if total else 0.5)
    # the order of rows must not depend on partitions
    rows = rows.assign(k=[float(np.sum(v)) for v in rows["x"]], n=[len(v) for v in rows["x"]]).sort_values(["k", "n", "y"])
    y = rows["y"].to_numpy(float)
    x = np.concatenate(rows["x"].to_list()).reshape(-1, WIDTH)
    bag = np.repeat(np.arange(len(y)), rows["n"].to_numpy() // WIDTH)
    share = {k: sizes.get(k, 1) / total / max((y == k).mean(), 1e-9) for k in (0, 1)}
    return fit(x, bag, y, np.where(y == 1, share[1], share[0]))


def with_score(docs: DataFrame, model: Model | Constant, name: str = "score", text: str = "text") -> DataFrame:
    """All columns of the documents plus the score (0 to 1)."""
    return add_columns(docs, text, lambda col: [model.score(col)], {name: "double"})
