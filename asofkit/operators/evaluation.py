"""Walk-forward evaluation of features, baselines and models on rows that no training saw."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from . import signal, skill, windows


def walk_forward_ic(df: DataFrame, by: list[str], order: list[Column], signals: list[str], ret: str, train_ratio: float, window_rows: int, horizon: int,
                    min_train: int, min_window: int) -> DataFrame:
    """(by, signal, window, n, ic): rank correlation of each signal with the return in every used test window."""
    w = windows.walk_forward(df, by, order, train_ratio, window_rows, horizon, min_train, min_window).where("used")
    long = w.select(*by, "window", F.col(ret).cast("double").alias("ret"), *[F.col(s).cast("double").alias(s) for s in signals]).unpivot([*by, "window", "ret"], signals, "signal", "value")
    return skill.spearman(long.where("value is not null and ret is not null"), [*by, "signal", "window"], "value", "ret")


def summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """Per signal: windows with a value, mean rank correlation and its ratio to the deviation over windows."""
    return ics.groupBy(*by, "signal").agg(F.count("ic").alias("windows"), F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"))


#: Newton steps at most, and the change of a coefficient that ends them.
STEPS, SETTLED = 40, 1e-10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class WindowFits:
    """Logistic regressions of all windows at once.

    A row is in the training or calibration part of every window that ends late enough after it, so windows differ in
    little but where they end. Each task takes its rows against all windows as one matrix product and gives one row of
    sums a window; a Newton step is one job however many windows there are. The driver holds the windows' coefficients.
    """

    def __init__(self, rows: DataFrame, ends: dict[str, np.ndarray], features: list[str], hit: str):
        """``rows``: instrument, row, features, hit; ``ends``: for each instrument the train_end of each window (or 0)."""
        self.features, self.n_windows = features, len(next(iter(ends.values())))
        self.rows = rows.select("instrument", "row", *[F.col(f).cast("double").alias(f) for f in features], F.col(hit).cast("double").alias("y"))
        self.ends = ends
        m = len(features)
        self.mean, self.scale = np.zeros((self.n_windows, m)), np.ones((self.n_windows, m))
        self.beta, self.platt = np.zeros((self.n_windows, m + 1)), np.zeros((self.n_windows, 2))

    def _sums(self, part: str, values) -> np.ndarray:
        """Sums over the rows of a part: ``values(x, y, weight of each row in each window)`` -> (windows, k)."""
        ends, features = self.ends, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in features])
                y, row = b.column("y").to_numpy(zero_copy_only=False), b.column("row").to_numpy(zero_copy_only=False)
                names, code = np.unique(np.array(b.column("instrument").to_pylist(), dtype=object).astype(str), return_inverse=True)
                size = max(1, 300_000 // len(next(iter(ends.values()))))  # rows, so that rows times windows is bounded
                for i in range(0, len(y), size):
                    s = slice(i, i + size)
                    end = np.stack([ends[name] for name in names])[code[s]]
                    train = row[s, None] < np.floor(end * 0.8)
                    member = train if part == "train" else ~train & (row[s, None] < end)
                    more = values(x[s], y[s], member.astype(np.float64))
                    total = more if total is None else total + more
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["window", "sums"])

        met = self.rows.mapInArrow(run, "window long, sums array<double>").select("window", F.posexplode("sums").alias("k", "v"))
        found = met.groupBy("window", "k").agg(F.sum("v").alias("v")).collect()  # windows x coefficients
        width = 1 + max((r.k for r in found), default=0)
        out = np.zeros((self.n_windows, width))
        for r in found:
            out[r.window, r.k] = r.v
        return out

    def _newton(self, part: str, inputs, width: int, penalty: np.ndarray) -> np.ndarray:
        """Coefficients of each window for ``inputs(x)`` -> (rows, windows, width), by Newton steps over all windows."""
        beta = np.zeros((self.n_windows, width))
        upper = np.triu_indices(width)
        for _ in range(STEPS):
            def values(x, y, member, beta=beta):
                z = inputs(x)
                p = _sigmoid(np.einsum("nwk,wk->nw", z, beta))
                slope = np.einsum("nw,nwk->wk", member * (p - y[:, None]), z)
                curve = np.einsum("nw,nwk,nwl->wkl", member * p * (1 - p), z, z)
                return np.concatenate([slope, curve[:, upper[0], upper[1]]], axis=1)

            sums = self._sums(part, values)
            slope = sums[:, :width] + penalty * beta
            curve = np.zeros((self.n_windows, width, width))
            curve[:, upper[0], upper[1]] = sums[:, width:]
            curve = curve + np.triu(curve, 1).transpose(0, 2, 1) + np.diag(penalty + 1e-12)
            step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
            size = np.abs(step).max(axis=1, keepdims=True)
            beta = beta - step * np.minimum(1, 10 / np.maximum(size, 1e-300))  # a part of one class only would run away
            if size.max(initial=0) < SETTLED:
                break
        return beta

    def fit(self) -> "WindowFits":
        """Standardised by the training part's mean and population deviation (constant features are 0); an L2 penalty of 1/2
        on the weights; a second regression of the labels on the log-odds calibrates, from the part that training left out."""
        m = len(self.features)
        sums = self._sums("train", lambda x, y, w: np.concatenate([w.sum(0)[:, None], w.T @ x, w.T @ (x * x)], axis=1))
        n = np.maximum(sums[:, :1], 1)
        self.mean = sums[:, 1 : m + 1] / n
        centre = self.mean
        spread = self._sums("train", lambda x, y, w: np.einsum("nw,nwk->wk", w, (x[:, None, :] - centre[None]) ** 2)) / n
        self.scale = np.where(spread > 0, 1 / np.sqrt(np.where(spread > 0, spread, 1)), 0)
        scale = self.scale

        def inputs(x):
            z = (x[:, None, :] - centre[None]) * scale[None]
            return np.concatenate([z, np.ones((*z.shape[:2], 1))], axis=2)

        self.beta = beta = self._newton("train", inputs, m + 1, np.array([1.0] * m + [0.0]))

        def logits(x):
            z = np.einsum("nwk,wk->nw", inputs(x), beta)
            return np.stack([z, np.ones_like(z)], axis=2)

        self.platt = self._newton("validation", logits, 2, np.zeros(2))
        return self

    def score(self, tests: DataFrame) -> DataFrame:
        """Test rows with ``p`` of their own window's model; the columns of its model are joined by its number."""
        spark = tests.sparkSession
        table = [(w, *[float(v) for v in np.concatenate([self.mean[w], self.scale[w], self.beta[w], self.platt[w]])]) for w in range(self.n_windows)]
        m = len(self.features)
        names = [f"__{k}{i}" for k, size in (("m", m), ("s", m), ("b", m + 1), ("p", 2)) for i in range(size)]
        models = spark.createDataFrame(table, "window bigint, " + ", ".join(f"{c} double" for c in names))
        z = reduce(lambda t, u: t + u, [(F.col(f).cast("double") - F.col(f"__m{i}")) * F.col(f"__s{i}") * F.col(f"__b{i}") for i, f in enumerate(self.features)]) + F.col(f"__b{m}")
        p = 1 / (1 + F.exp(-(z * F.col("__p0") + F.col("__p1"))))
        return tests.join(F.broadcast(models), "window").withColumn("p", p).drop(*names)  # a row of coefficients per window


def model_windows(df: DataFrame, order: Column, features: list[str], hit: str, train_ratio: float, window_rows: int, horizon: int, min_train: int, min_window: int) -> DataFrame:
    """Test rows of every used window with ``p`` of a logistic model that was fitted anew on the rows before it; the last fifth of those calibrates it.

    All series train one model, with windows by each one's own rows. The number of jobs does not depend on the number
    of windows. An empty table gives no rows.
    """
    rows = cut(windows.walk_forward(df, ["instrument"], [order], train_ratio, window_rows, horizon, min_train, min_window).where("used"))
    every = df.withColumn("row", F.row_number().over(windows.Window.partitionBy("instrument").orderBy(order)) - 1)
    every = cut(every.select("instrument", "row", *features, hit))
    ends: dict[str, dict[int, int]] = {}
    for r in rows.select("instrument", "window", "train_end").distinct().collect():  # series x windows
        ends.setdefault(str(r.instrument), {})[r.window] = r.train_end
    n = 1 + max((w for e in ends.values() for w in e), default=-1)
    if not n:
        return rows.withColumn("p", F.lit(None).cast("double"))
    table = {name: np.array([e.get(w, 0) for w in range(n)], dtype=np.int64) for name, e in ends.items()}
    known = every.where(F.col("instrument").isin(*table))
    return WindowFits(known, table, features, hit).fit().score(rows)


def tree_windows(df: DataFrame, order: Column, features: list[str], hit: str, train_ratio: float, window_rows: int, horizon: int, min_train: int, min_window: int,
                 most: int = 50) -> DataFrame:
    """The same with boosted trees, which have no sums that windows could share: the driver fits one window after the other, at most ``most``."""
    rows = windows.walk_forward(df, ["instrument"], [order], train_ratio, window_rows, horizon, min_train, min_window)
    every = df.withColumn("row", F.row_number().over(windows.Window.partitionBy("instrument").orderBy(order)) - 1)
    ends = rows.where("used").select("instrument", "window", "train_end").distinct()
    numbers = sorted(r.window for r in ends.select("window").distinct().limit(most + 1).collect())
    if len(numbers) > most:
        raise ValueError(f"more than {most} windows")
    out = rows.where("false").withColumn("p", F.lit(None).cast("double"))
    for n in numbers:
        end = F.broadcast(ends.where(F.col("window") == n).select("instrument", "train_end"))  # one row per series
        past = every.join(end, "instrument").where("row < train_end").withColumn("part", F.when(F.col("row") < F.floor(F.col("train_end") * 0.8), "train").otherwise("validation"))
        test = rows.where("used").where(F.col("window") == n).withColumn("part", F.lit("test"))
        cols = ["instrument", "row", "part", hit, *features, *[c for c in df.columns if c not in {"instrument", hit, *features}]]
        one = signal.fit_signal(past.select(*cols).unionByName(test.select(*cols)), features, hit, "trees").withColumn("window", F.lit(n))
        out = out.unionByName(one, allowMissingColumns=True)
    return out
