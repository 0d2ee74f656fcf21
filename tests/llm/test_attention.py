"""The attention model's forward pass against plain loops, and what it learns."""

import math

import numpy as np

from tomewright.llm.attention import Model, fit


def plain(m, passages):
    """Score of one document: gated weights of its passages, their mean, a logistic unit."""
    def dot(a, b):
        return sum(p * q for p, q in zip(a, b))
    raw = [sum(w * math.tanh(dot(v, x)) / (1 + math.exp(-dot(u, x))) for v, u, w in zip(m.v, m.u, m.w)) for x in passages]
    weight = [math.exp(r) for r in raw]
    z = [sum(w * x[k] for w, x in zip(weight, passages)) / sum(weight) for k in range(len(passages[0]))]
    return 1 / (1 + math.exp(-dot(z, m.c) - m.b))


def test_forward_equals_plain_loops():
    rng = np.random.default_rng(2)
    m = Model(np.zeros(5), np.ones(5), rng.normal(size=(3, 5)), rng.normal(size=(3, 5)), rng.normal(size=3), rng.normal(size=5), 0.3)
    size = [1, 4, 2, 7, 1]
    x, bag = rng.normal(size=(sum(size), 5)), np.repeat(np.arange(5), size)
    got = m.forward(x, bag)
    want = [plain(m, x[bag == k].tolist()) for k in range(5)]
    assert np.allclose(got[0], want, atol=1e-12)
    assert np.allclose([got[2][bag == k].sum() for k in range(5)], 1)           # attention weights of a document


def test_attention_finds_the_passage_that_decides():
    """A document is good if one of its passages is; only the document's label is known."""
    rng = np.random.default_rng(6)
    size = rng.integers(2, 9, 600)
    bag, y = np.repeat(np.arange(600), size), rng.integers(0, 2, 600)
    x = rng.normal(size=(size.sum(), 6))
    lead = np.r_[0, np.cumsum(size)[:-1]] + rng.integers(0, size)
    x[lead, 0] = np.where(y == 1, 5, 0)
    m = fit(x, bag, y, np.ones(600))
    p, _, a, *_ = m.forward((x - m.mean) / m.scale, bag)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95
    good = y == 1
    assert a[lead[good]].mean() > 2 * (1 / size[good]).mean()
