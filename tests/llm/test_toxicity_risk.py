"""The non-negative PU fit against its definition: risks by loops over texts, slopes by differences."""

import math
import random

import numpy as np
import pytest

from asofkit.llm import toxicity


def loss(z, toxic):
    return math.log1p(math.exp(-z)) if toxic else math.log1p(math.exp(z))


def score(text, w, b):
    return sum(w.get(f, 0.0) for f in text) + b


def clean_risk(pos, un, prior, w, b):
    """Risk of the clean class: unlabelled texts as clean, less the toxic share of them."""
    return sum(loss(score(t, w, b), False) for t in un) / len(un) - prior * sum(loss(score(t, w, b), False) for t in pos) / len(pos)


def toxic_risk(pos, prior, w, b):
    return prior * sum(loss(score(t, w, b), True) for t in pos) / len(pos)


def slope(f, w, b, at, h=1e-5):
    """Central difference for feature ``at``, or for the bias."""
    moved = lambda d: (w, b + d) if at is None else ({**w, at: w[at] + d}, b)
    return (f(*moved(h)) - f(*moved(-h))) / (2 * h)


def plain_fit(pos, un, prior, s):
    chosen = []
    for f in sorted({f for t in pos + un for f in t}):
        n_pos, expected = sum(f in t for t in pos), sum(f in t for t in un) * len(pos) / len(un)
        if (n_pos - expected) / math.sqrt(expected + 1) >= s.least_z and prior * n_pos >= s.least_precision * expected:
            chosen.append(f)
    w, b = dict.fromkeys(chosen, 0.0), -1.0
    state = {k: [0.0, 0.0] for k in [*chosen, None]}
    corrected = 0
    for t in range(1, s.epochs + 1):
        if clean_risk(pos, un, prior, w, b) >= 0:
            risk = lambda w, b: toxic_risk(pos, prior, w, b) + clean_risk(pos, un, prior, w, b)
        else:
            corrected += 1
            risk = lambda w, b: -clean_risk(pos, un, prior, w, b)
        steps = {}
        for k in state:
            g = slope(risk, w, b, k) + (s.decay * w[k] if k is not None else 0)
            m, v = state[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = [m, v]
            steps[k] = s.rate * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = {k: w[k] - steps[k] for k in w}, b - steps[None]
    return w, b, corrected


@pytest.mark.parametrize("prior,noise,expect_correction", [(0.1, 0.4, False), (0.9, 0.02, True)])
def test_fit_follows_the_risk(prior, noise, expect_correction):
    r = random.Random(3)
    pos = [{f for f in range(4) if r.random() < 0.8} | {f for f in range(4, 9) if r.random() < 0.3} for _ in range(40)]
    un = [({f for f in range(4) if r.random() < 0.8} if r.random() < noise else set()) | {f for f in range(4, 9) if r.random() < 0.3} for _ in range(120)]
    s = toxicity.Settings(epochs=60, least_z=2.0, least_precision=0.1)
    w, b, corrected = plain_fit(pos, un, prior, s)
    got = toxicity.fit_nnpu(*[[np.array(sorted(t), dtype=np.int32) for t in texts] for texts in (pos, un)], prior, s)
    assert set(np.flatnonzero(got[:-1])) == set(w) and len(w) == 4
    assert got[-1] == pytest.approx(b, abs=1e-3) and all(got[f] == pytest.approx(w[f], abs=1e-3) for f in w)
    assert bool(corrected) == expect_correction


def test_nothing_to_learn_from():
    for pos, un in (([], [np.array([1])]), ([np.array([1])], [])):
        w = toxicity.fit_nnpu(pos, un, 0.5, toxicity.Settings())
        assert not w[:-1].any() and w[-1] == -4
