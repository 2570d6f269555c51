"""What the driver holds while it trains: the sample once, and only the features that tell."""

import tracemalloc

import numpy as np

from asofkit.llm import toxicity


def test_training_does_not_copy_the_sample():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, toxicity.FEATURES, 1500, dtype=np.int32)) for _ in range(8000)]
    positive = [np.unique(np.append(r, 17)).astype(np.int32) for r in rows[:2000]]
    size = sum(r.nbytes for r in rows)
    tracemalloc.start()
    try:
        w = toxicity.fit_nnpu(positive, rows[2000:], 0.2, toxicity.Settings(epochs=2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert w[17] > 0
    assert peak < 0.8 * size, (peak, size)
