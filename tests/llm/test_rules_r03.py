"""Third round: the quality rules learn from every labelled row."""

import random

import numpy as np
import pyarrow as pa

from tomewright.llm import rules


def test_every_labelled_row_counts(documents, labels):
    rng = random.Random(6)
    vocab = [a + b for a in "bdfgk" for b in ("alo", "eru", "imi", "ona")]
    rows = [(k, " ".join(rng.choice(vocab) + rng.choice(["", "", "!", "#"]) * (k % 2) for _ in range(40 + k % 30))) for k in range(300)]
    rows += [(k, " ".join(rng.choice(vocab).upper() + "!#$" for _ in range(60))) for k in range(300, 330)] + [(400, "too short"), (401, None)]
    forest = rules.learn(documents(rows), labels([(k, int(k < 300), 0) for k, _ in rows]))
    counts, shares = rules.statistics(pa.array([t for k, t in rows if k < 330]))
    ok, good = ~rules.base_failed(counts), np.arange(330) < 300
    assert forest.sample == (ok & good).sum()
    assert np.allclose(forest.usual, rules.usual_shares(shares[ok], good[ok]), atol=1e-12)
    # the leaves of a tree hold all good rows: the root's split lies between the extremes of all rows
    by = rules.Forest.scaled(shares[ok], forest.usual) @ forest.direction[:, 0].T
    assert ((by.min(axis=0) <= forest.split[:, 0]) & (forest.split[:, 0] <= by.max(axis=0))).all()
    score = forest.score(shares)
    cuts = np.unique(score[ok])
    gain = [np.mean(score[ok & ~good] > c) - np.mean(score[ok & good] > c) if np.mean(score[ok & good] > c) <= 0.002 else -1 for c in cuts]
    assert cuts[np.argmax(gain)] <= forest.threshold < cuts[min(np.argmax(gain) + 1, len(cuts) - 1)] + 1e-12
    assert (score[ok & ~good] > forest.threshold).all()
