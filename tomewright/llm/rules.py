"""Quality rules: statistics of a text and an isolation forest over them.

Statistics are exact and computed inside the row: words, code points in words,
symbols, lines that repeat an earlier line, words in eight-word windows that
occur twice or more, and shares derived from them.  Two base rules reject a
text at once (too few words, too much repetition).  The rest is judged by an
isolation forest: trees of random splits over the shares of labelled good
texts (of all labelled ones where fewer than two are good); texts that few
splits isolate, or that fall where few of them are, are anomalous.  Bad texts widen the range of the splits but do
not count: a cluster of them would seem as dense as the normal ones.  The score threshold is the one
that separates labelled rows best while at most ``max_loss`` of the good ones
fall.

Null and empty texts have all counts 0 and fail the base rule.  Without
labelled rows only the base rules act.  Repeated rows and ids are judged one by
one, texts of any length whole, an empty table gives no rows.  Extra columns
pass through; input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import (IS_SPACE, add_columns, byte_rows, byte_set, join_hash, mix, per_row, segment_hash, windows,
                                   words)
from tomewright.operators.ordered import ordered_scan
from tomewright.session import cut_lineage

SYMBOLS = byte_set("#*$%&|<>")
UPPER, BANG = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_set("!?")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols", "dup_lines", "repeats", "upper", "bangs", "twins")
_S = [f"s{i}" for i in range(len(SHARES))]


def _repeated(group: np.ndarray) -> np.ndarray:
    """True for every value that occurs more than once."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    same = group[order][1:] == group[order][:-1]
    out = np.zeros(len(group), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x COUNTS) and shares (rows x SHARES) of the texts."""
    raw, off = byte_rows(col)
    n = len(off) - 1
    start, end, row = words(raw, off)
    h = segment_hash(raw, start, end)
    tag = mix(np.arange(n).astype(np.uint64) + np.uint64(1))
    n_words = np.bincount(row, minlength=n)
    solid = ~IS_SPACE[raw]
    letters = per_row(solid & ((raw & 0xC0) != 0x80), off)
    symbols = per_row(SYMBOLS[raw], off)
    # lines with a word
    cut = np.unique(np.r_[off, np.flatnonzero(raw == 10), np.flatnonzero(raw == 10) + 1])
    a, b = cut[:-1], cut[1:]
    full = np.r_[0, np.cumsum(solid)]
    keep = full[b] > full[a] if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    lrow = np.searchsorted(off, a, side="right") - 1
    lkey = join_hash(segment_hash(raw, a, b), tag[lrow]) if len(a) else np.zeros(0, np.uint64)
    lines = np.bincount(lrow, minlength=n)
    _, first = np.unique(lkey, return_index=True)
    dups = lines - np.bincount(lrow[first], minlength=n)
    # words in repeated eight-word windows
    w, at = windows(h, row, 8)
    twice = _repeated(join_hash(w, tag[row[at]])) if len(w) else np.zeros(0, bool)
    edge = np.zeros(len(h) + 9, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 8, -1)
    repeats = np.bincount(row[np.cumsum(edge)[:len(h)] > 0], minlength=n)
    twins = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) else np.zeros(n, np.int64)
    counts = np.c_[n_words, letters, symbols, dups, repeats].astype(np.int64)
    nw, nl = np.maximum(n_words, 1), np.maximum(letters, 1)
    shares = np.c_[symbols / nl, dups / np.maximum(lines, 1), repeats / nw, per_row(UPPER[raw], off) / nl,
                   per_row(BANG[raw], off) / nw, twins / nw]
    return counts, shares


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees of random oblique splits, as heaps: child of node i is 2i + 1 or 2i + 2.

    Shares are first divided by their usual size among good rows, so that a
    split along a random direction weighs them alike.
    """
    usual: np.ndarray
    direction: np.ndarray       # trees x nodes x shares
    split: np.ndarray           # nan: leaf
    path: np.ndarray            # expected path length at a leaf
    sample: int
    threshold: float = 2.0      # above: anomalous (2: none is)

    @staticmethod
    def scaled(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
        return np.log1p(x / usual)

    @classmethod
    def grow(cls, x: np.ndarray, good: np.ndarray, usual: np.ndarray, trees: int = 100, sample: int = 32, seed: int = 7) -> "Forest":
        """Trees over samples of the good rows.

        A split falls anywhere between the extremes of all sampled rows, bad
        ones included, but only good rows count: where at most one is left, the
        path ends.
        """
        rng, x = np.random.default_rng(seed), cls.scaled(x, usual)
        own, other = x[good], x[~good]
        sample, beside = min(sample, len(own)), min(sample, len(other))
        depth = max(int(np.ceil(np.log2(max(sample, 2)))), 1)
        size = 2 ** (depth + 1) - 1
        v, s, p = np.zeros((trees, size, x.shape[1])), np.full((trees, size), np.nan), np.zeros((trees, size))
        for t in range(trees):
            todo = [(0, 0, own[rng.choice(len(own), sample, replace=False)], other[rng.choice(len(other), beside, replace=False)])]
            while todo:
                node, d, pts, rest = todo.pop()
                way = rng.normal(size=x.shape[1])
                at, by = pts @ way, rest @ way
                both = np.r_[at, by]
                if len(pts) < 2 or d == depth or np.ptp(both) <= 1e-12:
                    p[t, node] = d + average_path(len(pts))
                    continue
                cut = rng.uniform(both.min(), both.max())
                v[t, node], s[t, node] = way, cut
                todo += [(2 * node + 1, d + 1, pts[at <= cut], rest[by <= cut]), (2 * node + 2, d + 1, pts[at > cut], rest[by > cut])]
        return cls(usual, v, s, p, sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: short average paths score high."""
        x = self.scaled(x, self.usual)
        total = np.zeros(len(x))
        for v, s, p in zip(self.direction, self.split, self.path):
            node, live = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(live):
                live = live[~np.isnan(s[node[live]])]
                at = node[live]
                node[live] = 2 * at + 1 + (np.einsum("ij,ij->i", x[live], v[at]) > s[at])
            total += p[node]
        return 2.0 ** (-total / len(self.split) / max(float(average_path(self.sample)), 1e-9))


def usual_shares(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """What all but one in two hundred good rows stay below, plus a hundredth."""
    base = x[good] if good.any() else x
    return np.quantile(base, 0.995, axis=0) + 0.01 if len(base) else np.ones(x.shape[1])


def _usual(marked: DataFrame, n: int) -> np.ndarray:
    """``usual_shares`` of all ``n`` rows: exact quantiles by the ranks of distinct values."""
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(_S)])).alias("x")
    each = marked.select(pair).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    at = 0.995 * (n - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    ranked = ordered_scan(each, ["k"], "v", total={"before": F.col("n")})
    inside = lambda r: (F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("n"))
    rows = ranked.where(inside(lo) | inside(hi)).select("k", "v", inside(lo).alias("lo"), inside(hi).alias("hi")).collect()   # two values a share at most
    low, high = ({r["k"]: r["v"] for r in rows if r[c]} for c in ("lo", "hi"))
    return np.array([low[i] + (high[i] - low[i]) * (at - lo) for i in range(len(_S))]) + 0.01


def _grown(marked: DataFrame, usual: np.ndarray, n: int, trees: int, depth: int, seed: int) -> Forest:
    """A forest over all rows, level by level: each level is one aggregate by (tree, node) of extremes and counts."""
    rng, size, k = np.random.default_rng(seed), 2 ** (depth + 1) - 1, len(_S)
    forest = Forest(usual, rng.normal(size=(trees, size, k)), np.full((trees, size), np.nan), np.zeros((trees, size)), n)
    for d in range(depth + 1):
        def run(it, forest=forest):
            for b in it:
                x = Forest.scaled(np.column_stack([b.column(i).to_numpy() for i in range(k)]), forest.usual)
                own = b.column(k).to_numpy().astype(np.int64)
                for t in range(trees):
                    v, s = forest.direction[t], forest.split[t]
                    node, live = np.zeros(len(x), np.int64), np.arange(len(x))
                    for _ in range(d):
                        live = live[~np.isnan(s[node[live]])]
                        at = node[live]
                        node[live] = 2 * at + 1 + (np.einsum("ij,ij->i", x[live], v[at]) > s[at])
                    live = live[node[live] >= 2 ** d - 1]
                    if not len(live):
                        continue
                    at = node[live]
                    by = np.einsum("ij,ij->i", x[live], v[at])
                    order = np.argsort(at, kind="stable")
                    at, by, mine = at[order], by[order], own[live][order]
                    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(t * size + at[cut]), pa.array(np.add.reduceat(mine, cut)),
                                                      pa.array(np.minimum.reduceat(by, cut)), pa.array(np.maximum.reduceat(by, cut))],
                                                     names=["cell", "n", "lo", "hi"])
        cells = marked.select(*_S, "own").mapInArrow(run, "cell long, n long, lo double, hi double").groupBy("cell").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("cell").collect()     # trees * 2 ** d at most
        for c in cells:
            t, node = divmod(c["cell"], size)
            if c["n"] < 2 or d == depth or c["hi"] - c["lo"] <= 1e-12:
                forest.path[t, node] = d + average_path(c["n"])
            else:
                forest.split[t, node] = rng.uniform(c["lo"], c["hi"])
                forest.path[t, 2 * node + 1:2 * node + 3] = d + 1        # a side that no labelled row takes is a leaf of none
    return forest


def _threshold(marked: DataFrame, forest: Forest, ups: int, downs: int, max_loss: float) -> float:
    """The cut that parts all labelled rows best, from counts below every distinct score."""
    def run(it):
        for b in it:
            score = forest.score(np.column_stack([b.column(i).to_numpy() for i in range(len(_S))]))
            yield pa.RecordBatch.from_arrays([pa.array(score), b.column(len(_S))], names=["score", "y"])
    each = marked.select(*_S, F.col("y").cast("long").alias("y")).mapInArrow(run, "score double, y long").groupBy("score").agg(
        F.sum("y").alias("up"), F.sum(1 - F.col("y")).alias("down")).withColumn("k", F.lit(0))
    seen = ordered_scan(each, ["k"], "score", total={"u": F.col("up"), "v": F.col("down")}, ahead={"upper": F.col("score")})
    loss, caught = 1 - (F.col("u") + F.col("up")) / ups, 1 - (F.col("v") + F.col("down")) / downs
    best = seen.where(loss <= max_loss).select("score", "upper", (caught - loss).alias("gain")).orderBy(F.desc("gain"), "score").first()
    if best is None or best["gain"] <= 0:
        return 2.0
    return float((best["score"] + (best["score"] if best["upper"] is None else best["upper"])) / 2)


def learn(docs: DataFrame, labels: DataFrame, max_loss: float = 0.002, trees: int = 100, depth: int = 5, seed: int = 7) -> Forest | None:
    """Grow the forest on all labelled texts and set its threshold on all of them.

    Shares are computed where the texts are and written (narrow) once; usual
    sizes, extremes and counts of every node, and the threshold are aggregates
    over them.  Only nodes reach the driver.
    """
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    names = {c: "double" for c in _S} | {"ok": "boolean"}

    def run(col: pa.Array) -> list:
        counts, shares = statistics(col)
        return [*shares.T, ~base_failed(counts)]
    shares = cut_lineage(add_columns(docs.select("doc_id", "text"), "text", run, names).where("ok").drop("text", "ok"))
    marked = cut_lineage(shares.join(y, "doc_id"))
    n = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("good")).first()
    if n["n"] < 2:
        return None
    own = F.lit(True) if n["good"] < 2 else F.col("y") == 1
    marked = marked.withColumn("own", own.cast("long"))
    usual = _usual(marked.where("y = 1") if n["good"] else marked, n["good"] or n["n"])
    forest = _grown(marked, usual, n["n"] if n["good"] < 2 else n["good"], trees, depth, seed)
    if 0 < n["good"] < n["n"]:
        forest.threshold = _threshold(marked, forest, n["good"], n["n"] - n["good"], max_loss)
    return forest


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """All columns plus the counts, base_failed, anomaly (score) and kept."""
    def run(col: pa.Array) -> list:
        counts, shares = statistics(col)
        bad = base_failed(counts)
        score = forest.score(shares) if forest else np.zeros(len(counts))
        return [*counts.T, bad, score, ~bad & ~(score > (forest.threshold if forest else 2.0))]
    return add_columns(docs, text, run, {c: "long" for c in COUNTS} | {"base_failed": "boolean", "anomaly": "double", "kept": "boolean"})
