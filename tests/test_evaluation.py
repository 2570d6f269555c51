"""Walk-forward fits of many windows against a fit of each by itself."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.operators import evaluation

T0 = datetime(2024, 1, 1)
FEATURES = ["a", "b", "flat"]


def newton(x, y, penalty):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), x.T @ (p - y) + penalty * beta)
        beta -= step
    return beta


def plain(series, train_ratio, size, horizon, least_train, least_window):
    """(instrument, row) -> p."""
    windows = {}
    for name, rows in series.items():
        first = int(len(rows) * train_ratio)
        for w, start in enumerate(range(first, len(rows), size)):
            end, test = max(start - horizon, 0), range(start, min(start + size, len(rows)))
            if end >= least_train and len(test) >= least_window:
                windows.setdefault(w, {})[name] = (end, test)
    out = {}
    for w, parts in windows.items():
        pick = lambda f: np.array([series[s][i] for s, (end, _) in parts.items() for i in f(end)])
        train, check = pick(lambda end: range(int(end * 0.8))), pick(lambda end: range(int(end * 0.8), end))
        mean, std = train[:, :3].mean(0), train[:, :3].std(0)
        scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0)
        design = lambda r: np.column_stack([(r[:, :3] - mean) * scale, np.ones(len(r))])
        beta = newton(design(train), train[:, 3], np.array([1.0, 1.0, 1.0, 0.0]))
        platt = newton(np.column_stack([design(check) @ beta, np.ones(len(check))]), check[:, 3], np.zeros(2))
        for s, (_, test) in parts.items():
            z = design(np.array([series[s][i] for i in test])) @ beta
            out.update({(s, i): 1 / (1 + np.exp(-(z[k] * platt[0] + platt[1]))) for k, i in enumerate(test)})
    return out


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(1)
    made = {}
    for name, n in (("x", 900), ("y", 1300), ("short", 40)):
        a, b = r.normal(3, 2, n), r.normal(0, 1, n)
        hit = (a - 3 + 2 * b + r.normal(0, 3, n) > 0).astype(float)
        made[name] = np.column_stack([a, b, np.full(n, 7.0), hit])
    return made


def frame(spark, series):
    rows = [(s, T0 + timedelta(hours=i), *map(float, v[:3]), bool(v[3])) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "instrument string, open_time timestamp, a double, b double, flat double, hit boolean")


@pytest.mark.parametrize("size", [60, 5])
def test_every_window_as_if_fitted_alone(spark, series, size):
    got = evaluation.model_windows(frame(spark, series), F.col("open_time"), FEATURES, "hit", 0.5, size, 4, 100, 5).collect()
    want = plain(series, 0.5, size, 4, 100, 5)
    assert {(r.instrument, r.row) for r in got} == set(want) and len({r.window for r in got}) == len(range(650, 1300, size))
    assert max(abs(r.p - want[r.instrument, r.row]) for r in got) < 1e-7


def test_jobs_do_not_grow_with_windows(spark, series):
    d = frame(spark, {"y": series["y"]})
    jobs = []
    for size in (100, 2):
        spark.sparkContext.setJobGroup(f"w{size}", "fits")
        evaluation.model_windows(d, F.col("open_time"), FEATURES, "hit", 0.5, size, 4, 100, 2).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"w{size}")))
    assert jobs[1] < 1.5 * jobs[0]  # 325 windows and 7


def test_no_windows(spark, series):
    assert evaluation.model_windows(frame(spark, {"short": series["short"]}), F.col("open_time"), FEATURES, "hit", 0.5, 10, 4, 100, 5).count() == 0
    assert evaluation.model_windows(frame(spark, series).limit(0), F.col("open_time"), FEATURES, "hit", 0.5, 10, 4, 100, 5).count() == 0
