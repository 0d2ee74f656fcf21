"""Cases of the second advice: learned scores at capped samples, short texts in samples."""

import math
import random

import pytest

from tomewright.llm import toxicity
from tomewright.llm.common import labelled_sample


def logit(p):
    return math.log(p / (1 - p))


def test_toxicity_does_not_move_with_the_cap(documents, labels):
    """One toxic text in eleven: a sample full of both classes gives the odds of all rows."""
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "bdfgklmn" for b in ("alo", "eru", "imi", "ona", "usk")]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, marks = [], []
    for k in range(1320):
        toxic = k % 11 == 0
        hit = rng.random() < (0.7 if toxic else 0.02)
        rows.append((k, f"{words(20)} you are {'an' if toxic else 'not an'} idiot {words(10)}" if hit else words(30)))
        marks.append((k, 0, int(toxic)))
    docs, lab = documents(rows), labels(marks)
    texts = [words(30), words(30) + " not an idiot " + words(5)]
    for a, b in zip(toxicity.learn(docs, lab).score(texts), toxicity.learn(docs, lab, per_class=80).score(texts)):
        assert abs(logit(a) - logit(b)) < 0.8, (a, b)


@pytest.mark.parametrize("parts", [1, 40])
def test_sample_keeps_every_short_text(documents, labels, parts):
    """Texts below five words, empty and null ones stand for themselves, however the rows are dealt out."""
    short = [None, "", "ok", "no thanks", "see you later", "a b c d"]
    rows = [(k, short[k % 6]) for k in range(240)]
    near = "the same long text of more than five words"
    docs = documents(rows + [rows[2]] + [(k, near) for k in range(300, 310)]).repartition(parts)
    lab = labels([(k, k % 2, k % 2) for k in [*range(240), *range(300, 310)]])
    got = labelled_sample(docs, lab, "toxic", 4, 9, 1000).collect()
    want = sorted((t or "", k % 2) for k, t in rows) + [(near, 0)]
    assert sorted((r["text"], r["y"]) for r in got) == sorted(want)
