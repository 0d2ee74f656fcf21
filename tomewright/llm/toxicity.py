"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, reported
speech, other); punctuation and line feeds end a clause.  Four small
transducers watch a clause: negation opens a window of NEG_REACH words,
reported speech holds until the clause ends, a target opens a window of
TARGET_REACH words, a threat waits THREAT_REACH words for its target.  Their
product is one transducer over the classes; it emits a pattern wherever an
insult or a completed threat is matched, together with what surrounds it.
Only clauses that hold an insult or threat word are run, all of a batch in
step.  A document is scored by the weights of its matched patterns.

Insult words are a short general list plus stems learned from labelled texts:
word beginnings (or whole words) whose documents are toxic far more often than
chance allows.  The weights of the patterns are learned by logistic regression
that is pulled towards plausible values, so a small table gives a usable model.

Null and empty texts match nothing and get the base rate; without labels the
prior weights are used.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import add_columns, labelled_sample, map_batches, training_labels
from tomewright.session import cut_lineage

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
NEG_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 4

# fixed values: seed words of the grammar, four languages
INSULTS = ("idiot idiots stupid moron morons loser losers pathetic scum worthless trash garbage clown disgusting dumb "
           "imbecile dumbass bastard dummkopf arschloch abschaum connard ordure imbécile estúpido escoria").split()
THREATS = ("kill hurt destroy burn shoot stab strangle murder töten umbringen verletzen tuer frapper matar golpear").split()
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie tu te toi vous il elle tú usted vosotros ellos".split()
NEGATIONS = "not no never nor neither nicht kein keine nie pas jamais aucun nunca jamás tampoco".split()
REPORTS = ("said says called calls reported quoted quotes wrote claimed alleged sagte nannte zitierte appelé déclaré "
           "dijo llamó según").split()

_TOKEN = regex.compile(r"[^\W\d_]+|[.!?;\n]")
PATTERNS, FEATURES = 12, 13                   # insult x (negated, reported, targeted), threat x (negated, reported)
# log-odds that one plain / targeted / negated / reported match adds before labels are seen
PRIOR = np.array([4.0, 5.0, 1.0, 1.5, 0.5, 0.7, 0.2, 0.3, 5.0, 1.5, 1.0, 0.3,
                  0.5])      # the last: density of matches


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Product of the four transducers: next state and emitted pattern (0: none) by (state, class)."""
    states = list(product(range(NEG_REACH + 1), range(2), range(TARGET_REACH + 1), range(THREAT_REACH + 1)))
    number = {s: i for i, s in enumerate(states)}
    step, emit = np.zeros((len(states), 7), np.int64), np.zeros((len(states), 7), np.int64)
    for s, (neg, rep, tgt, thr) in enumerate(states):
        for c in range(7):
            if c == BREAK:
                nxt = (0, 0, 0, 0)
            else:
                nxt = (NEG_REACH if c == NEGATION else max(neg - 1, 0), int(rep or c == REPORT),
                       TARGET_REACH if c == TARGET else max(tgt - 1, 0), THREAT_REACH if c == THREAT else max(thr - 1, 0))
            if c == INSULT:
                emit[s, c] = 1 + 4 * (rep > 0) + 2 * (neg > 0) + (tgt > 0)
            elif c == TARGET and thr > 0:
                emit[s, c] = 9 + 2 * (rep > 0) + (neg > 0)
                nxt = (*nxt[:3], 0)
            step[s, c] = number[nxt]
    return step, emit


@dataclass
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)       # word beginning, or whole word with a final '$' -> weight
    beta: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    base: float = math.log(0.02 / 0.98)

    def __post_init__(self):
        self.step, self.emit = compose()
        self.fixed = {w: (c, 1.0) for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS),
                                                (INSULT, INSULTS)) for w in ws} | {c: (BREAK, 0.0) for c in ".!?;\n"}
        self.lengths = sorted({len(s) for s in self.stems if not s.endswith("$")})
        self.cache = _Classes(self)

    def classify(self, word: str) -> tuple[int, float]:
        if word in self.fixed:
            return self.fixed[word]
        if word + "$" in self.stems:
            return INSULT, self.stems[word + "$"]
        for n in self.lengths:
            if word[:n] in self.stems and len(word) >= n:
                return INSULT, self.stems[word[:n]]
        return OTHER, 0.0

    def patterns(self, texts: list[str]) -> np.ndarray:
        """Summed weight of each pattern in each text."""
        out = np.zeros((len(texts), PATTERNS))
        if len(self.cache) > 500_000:
            self.cache.clear()
        seen = self.cache.__getitem__
        found = [list(map(seen, _TOKEN.findall(t.lower()))) for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        if not n.sum():
            return out
        code = np.array([c for f in found for c in f], np.int64)
        cls, doc = code & 7, np.repeat(np.arange(len(texts)), n)
        end = cls == BREAK
        clause = np.cumsum(np.r_[True, end[:-1] | (doc[1:] != doc[:-1])]) - 1
        live = np.zeros(clause[-1] + 1, bool)
        live[clause[(cls == INSULT) | (cls == THREAT)]] = True
        at = np.flatnonzero(live[clause])
        if not len(at):
            return out
        start = np.flatnonzero(np.r_[True, clause[at][1:] != clause[at][:-1]])
        size = np.diff(np.r_[start, len(at)])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state = np.zeros(len(start), np.int64)
        for k in range(int(size[0])):
            m = int(np.searchsorted(-size, -k, side="left"))       # clauses longer than k
            tok = at[start[:m] + k]
            hit = self.emit[state[:m], cls[tok]]
            state[:m] = self.step[state[:m], cls[tok]]
            if hit.any():
                w = np.flatnonzero(hit)
                np.add.at(out, (doc[tok[w]], hit[w] - 1), (code[tok[w]] >> 3) / 16.0)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Pattern sums up to 3, and the weight of all matches in a hundred six-letter words up to 4."""
        p = self.patterns(texts)
        size = np.array([len(t) for t in texts]) / 600.0
        return np.c_[np.minimum(p, 3.0), np.minimum(p.sum(1) / np.maximum(size, 0.3), 4.0)]

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.base + self.features(texts) @ self.beta
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Classes(dict):
    """Word -> class + 8 * weight in sixteenths, computed on first sight."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str) -> int:
        c, w = self.grammar.classify(word)
        self[word] = v = c | int(round(16 * w)) << 3
        return v

    def __reduce__(self):
        return _Classes, (self.grammar,)


def stem_counts(sample: DataFrame, shortest: int = 3, longest: int = 7) -> DataFrame:
    """For each word beginning or whole word ('$'): toxic and other texts that hold it, and its occurrences there."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = {(y, what): Counter() for y in (0, 1) for what in "do"}
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own: Counter = Counter()
            for w, k in Counter(_TOKEN.findall(t.lower())).items():
                if w.isalpha():
                    own.update(dict.fromkeys([w[:i] for i in range(shortest, min(longest, len(w)) + 1)] + [w + "$"], k))
            n[y, "o"].update(own)
            n[y, "d"].update(own.keys())
        keys = list(n[0, "d"].keys() | n[1, "d"].keys())
        cols = [pa.array([n[c][k] for k in keys], pa.int64()) for c in ((1, "d"), (0, "d"), (1, "o"), (0, "o"))]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *cols], names=["stem", "d1", "d0", "o1", "o0"])
    rows = map_batches(sample.select("text", "y"), run, "text", "stem string, d1 long, d0 long, o1 long, o0 long")
    return rows.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "o1", "o0")])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 6000, max_stems: int = 2000,
          evidence: float = 8.0, ratio: float = 10.0) -> Grammar:
    """Fit stems and pattern weights on at most ``2 * per_class`` labelled training texts.

    A stem needs a log likelihood ratio of ``evidence`` of its toxic texts
    against their share in the sample, and must occur at least ``ratio`` times
    as often per word in toxic texts as in others.  The fit weights both
    classes back to their shares among all labelled training rows, so that
    scores do not depend on whether the sample is full.  Only ``max_stems``
    candidates and the pattern sums of the sample reach the driver.
    """
    sample = cut_lineage(labelled_sample(docs, labels, "toxic", 4, 2, per_class))
    total = sample.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.length("text")),
                       F.sum((1 - F.col("y")) * F.length("text"))).first()
    n, toxic = total[0], total[1] or 0
    if not toxic or toxic == n:
        return Grammar()
    share, much = toxic / n, max(total[2], 1) / max(total[3], 1)
    p = F.col("d1") / (F.col("d1") + F.col("d0"))
    llr = F.col("d1") * F.log(p / share) + F.when(F.col("d0") > 0, F.col("d0") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    times = F.col("o1") / (F.col("o0") + 0.5) / much
    top = (stem_counts(sample).where((p > share) & (F.col("d1") >= 4)).withColumns({"llr": llr, "times": times})
           .where((F.col("llr") >= evidence) & (F.col("times") >= ratio))
           .withColumn("gain", F.col("o1") * F.log("times")).orderBy(F.desc("gain"), "stem").limit(max_stems).collect())
    stems: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (-r["gain"], len(r["stem"]), r["stem"])):      # one stem of each family
        s = r["stem"].rstrip("$")
        if not any(s.startswith(t.rstrip("$")) or t.startswith(s) for t in stems):
            stems[r["stem"]] = min(1.0, math.log(r["times"]) / 4)
    g = Grammar(stems)
    rows = add_columns(sample.select("text", "y"), "text", _sums(g), {f"p{i}": "double" for i in range(FEATURES)})
    pdf = rows.drop("text").toPandas()
    x, y = pdf[[f"p{i}" for i in range(FEATURES)]].to_numpy(), pdf["y"].to_numpy(float)
    x = np.c_[np.ones(len(x)), x]
    sizes = {r["y"]: r["count"] for r in training_labels(labels, "toxic", 4, 2).groupBy("y").count().collect()}
    rate = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    prior = np.r_[g.base, PRIOR]
    w, pull = prior.copy(), np.r_[0.1, np.full(FEATURES, 1.0)]
    for _ in range(50):                                                  # Newton steps, pulled to the prior
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - y)) + pull * (w - prior)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return Grammar(stems, np.maximum(w[1:], 0.0), float(w[0]))


def _sums(g: Grammar):
    return lambda col: list(g.features([t or "" for t in col.to_pylist()]).T)


def with_score(docs: DataFrame, grammar: Grammar, name: str = "score", text: str = "text") -> DataFrame:
    """All columns of the documents plus the score (0 to 1)."""
    return add_columns(docs, text, lambda col: [grammar.score([t or "" for t in col.to_pylist()])], {name: "double"})
