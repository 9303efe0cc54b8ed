"""Support vector machines: all hinge problems of a table solved together.

One-vs-rest classes, costs, folds and kernel widths are columns of one weight matrix.  A
problem minimises |w|^2 / 2 + C * sum of s * max(0, 1 - y f(x))^2 over its rows, where the
weights s give the class and the rest half of the rows each.  A Newton step for all columns is one pass over
the rows: tasks add up gradient and curvature of the rows inside the margin, the sums of a
column meet in one task, which solves for its direction.  A second pass measures the loss
at ``STEPS`` lengths of the step.  Columns without progress leave; the solver ends when none is left.

An RBF kernel is its random Fourier features, made from the standardised columns inside
the tasks, so a grid of widths needs no wider table.  The rows are packed once into blocks
in the shared folder; passes read them from there, so a lost executor costs a task.  Tasks and
shuffles hold columns x (features + 1)^2 numbers, at most ``CURVATURE_BYTES`` a group of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import materialize

BLOCK_ROWS = 4096
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
TOLERANCE = 1e-6
CURVATURE_BYTES = 256 << 20


@dataclass(frozen=True)
class View:
    """A design matrix: rows outside ``fold``, standardised, then Fourier features if there are frequencies; a last column of ones."""

    fold: int
    mean: np.ndarray
    std: np.ndarray
    omega: np.ndarray | None
    phase: np.ndarray | None
    positive: np.ndarray  # weight of a row of each class in the class's own problem
    rest: np.ndarray  # weight of every other row in it
    gamma: float | None = None

    @property
    def width(self) -> int:
        return (len(self.mean) if self.omega is None else len(self.omega)) + 1

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.where(self.std > 0, (x - self.mean) / np.where(self.std > 0, self.std, 1.0), 0.0)
        if self.omega is not None:
            z = np.cos(z @ self.omega.T + self.phase) * math.sqrt(2.0 / len(self.omega))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


@dataclass(frozen=True)
class Unit:
    """The problems of all classes for one view and cost: ``len(classes)`` columns."""

    view: int
    cost: float


@dataclass(frozen=True)
class HingeModel:
    """One-vs-rest decisions of the classes; columns of ``weights`` are classes, the last row the intercepts."""

    features: tuple[str, ...]
    classes: tuple[int, ...]
    view: View
    weights: np.ndarray
    converged: bool

    def decisions(self, df: DataFrame, out: str) -> DataFrame:
        """Add the array of decision values, one per class; a NULL feature counts as 0.

        Linear decisions are generated code; Fourier features are a matrix product per Arrow batch.
        """
        view, x = self.view, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]
        if view.omega is not None:
            weights = self.weights

            @F.pandas_udf("array<double>")
            def decide(*columns: pd.Series) -> pd.Series:
                return pd.Series(list(view.design(np.stack([c.to_numpy(float) for c in columns], 1)) @ weights))

            return df.withColumn(out, decide(*x))
        names = [f"__z{i}" for i in range(len(x))]
        scaled = {n: (c - float(m)) / float(s) if s > 0 else F.lit(0.0) for n, c, m, s in zip(names, x, view.mean, view.std)}
        values = [_dot(names, w[:-1]) + float(w[-1]) for w in self.weights.T]
        return df.withColumns(scaled).withColumn(out, F.array(*values)).drop(*names)

    def score(self, df: DataFrame, out: str, keep_raw: str | None = None) -> DataFrame:
        """Add the class with the largest decision value; ties go to the first class."""
        raw = keep_raw or "__decisions"
        at = F.array_position(raw, F.array_max(raw)).cast("int")
        known = F.array(*[F.lit(int(c)) for c in self.classes])
        scored = self.decisions(df, raw).withColumn(out, F.element_at(known, at))
        return scored if keep_raw else scored.drop(raw)

    def importances(self) -> np.ndarray:
        """Mean size of each column's coefficient over the classes (of Fourier features where there are)."""
        return np.abs(self.weights[:-1]).mean(1)

    def save(self, spark: SparkSession, path: str) -> None:
        lists = lambda m: None if m is None else [list(map(float, r)) for r in np.atleast_2d(m)]
        v = self.view
        row = (list(self.features), list(map(int, self.classes)), lists(self.weights), lists(v.mean)[0], lists(v.std)[0], lists(v.omega),
               None if v.phase is None else lists(v.phase)[0], v.gamma, self.converged)
        spark.createDataFrame([row], "features array<string>, classes array<int>, weights array<array<double>>, mean array<double>, std array<double>, "
                              "omega array<array<double>>, phase array<double>, gamma double, converged boolean").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HingeModel:
        r = spark.read.parquet(path).first()
        omega, phase = (None, None) if r["omega"] is None else (np.array(r["omega"]), np.array(r["phase"]))
        none = np.zeros(len(r["classes"]))
        view = View(-1, np.array(r["mean"]), np.array(r["std"]), omega, phase, none, none, r["gamma"])
        return cls(tuple(r["features"]), tuple(r["classes"]), view, np.array(r["weights"]), r["converged"])


def _dot(names: list[str], weights: np.ndarray) -> Column:
    """The inner product as a balanced sum: generated code nests as deep as the expression."""
    parts = [F.col(n) * float(w) for n, w in zip(names, weights)]
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    return parts[0]


# --- the packed table ---------------------------------------------------------------
def pack(df: DataFrame, features: list[str], label: str, fold: str | None) -> DataFrame:
    """Blocks of rows: n, x (row-major doubles), y and fold (ints), written once."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = df.select(x.alias("x"), F.col(label).cast("int").alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                data = [part["x"].flatten().to_numpy(zero_copy_only=False).astype(float), *(part[c].to_numpy(zero_copy_only=False).astype(np.int32) for c in ("y", "fold"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in data)], names=["n", "x", "y", "fold"])

    return materialize(rows.filter(F.col("y").isNotNull()).mapInArrow(run, "n int, x binary, y binary, fold binary"), "hinge-rows")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"], np.int32), np.frombuffer(r["fold"], np.int32)


def _moments(df: DataFrame, features: list[str], label: str, fold: str | None) -> list[dict]:
    """Count, means and variances of every (fold, class): a row each."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    by = (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold")
    stats = [f(v).alias(f"{k}{i}") for i, v in enumerate(x.values()) for k, f in (("m", F.avg), ("v", F.var_pop))]
    found = df.filter(F.col(label).isNotNull()).groupBy(by, F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), *stats).collect()
    d = range(len(features))
    return [{"fold": r["fold"], "y": r["y"], "n": r["n"], "mean": np.array([r[f"m{i}"] for i in d]), "var": np.array([r[f"v{i}"] for i in d])} for r in found]


def _view(groups: list[dict], classes: list[int], fold: int, gamma: float | None, n_out: int, seed: int) -> View:
    use = [g for g in groups if g["fold"] != fold]
    n = np.array([g["n"] for g in use], float)[:, None]
    means, variances = np.array([g["mean"] for g in use]), np.array([g["var"] for g in use])
    mean = (n * means).sum(0) / n.sum()
    std = np.sqrt((n * (variances + (means - mean) ** 2)).sum(0) / n.sum())
    std[std <= 1e-12 * (1.0 + np.abs(mean))] = 0.0
    omega = phase = None
    if gamma is not None:
        from flowlens.operators.models import fourier_weights

        omega, phase = fourier_weights(len(mean), n_out, gamma, seed)
    size = np.array([sum(g["n"] for g in use if g["y"] == c) for c in classes], float)
    total = size.sum()
    half = lambda k: np.where(k > 0, total / (2.0 * np.maximum(k, 1.0)), 0.0)
    return View(fold, mean, std, omega, phase, half(size), half(total - size), gamma)


# --- passes ---------------------------------------------------------------------------
def _signs(y: np.ndarray, classes: np.ndarray, view: View) -> tuple[np.ndarray, np.ndarray]:
    """(+1 or -1, weight) of every row in every class's problem; rows of the view's fold weigh nothing."""
    own = y[:, None] == classes[None]
    return np.where(own, 1.0, -1.0), np.where(own, view.positive, view.rest)


def _by_view(units: list[Unit]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for u, unit in enumerate(units):
        out.setdefault(unit.view, []).append(u)
    return out


def newton(blocks: DataFrame, views: list[View], units: list[Unit], classes: np.ndarray, weights: list[np.ndarray],
           open_: list[np.ndarray]) -> list[np.ndarray]:
    """The Newton direction of every open column (zeros for the others)."""
    groups = _by_view(units)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for x, y, fold in _blocks(batches):
            for v, members in groups.items():
                keep = fold != views[v].fold
                z = views[v].design(x[keep])
                sign, weight = _signs(y[keep], classes, views[v])
                for u in members:
                    slack = 1.0 - sign * (z @ weights[u])
                    s = np.where(slack > 0, weight, 0.0)
                    for j in np.flatnonzero(open_[u]):
                        at = np.flatnonzero(s[:, j])
                        za, sa = z[at], s[at, j][:, None]
                        part = np.concatenate([za.T @ (sa * za), (za.T @ (sa[:, 0] * sign[at, j] * slack[at, j]))[None]])
                        if (u, j) in sums:
                            sums[u, j] += part
                        else:
                            sums[u, j] = part
        for (u, j), part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([int(j)], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             names=["u", "j", "part"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def result(u: int, j: int, total: np.ndarray) -> pa.RecordBatch:
            total = total.reshape(-1, views[units[u].view].width)
            cost, w = units[u].cost, weights[u][:, j]
            ridge = np.ones(len(w))
            ridge[-1] = 1e-6  # the intercept is not shrunk
            down = 2.0 * cost * total[-1] - ridge * w
            step = np.linalg.solve(2.0 * cost * total[:-1] + np.diag(ridge), down)
            return pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([j], pa.int32()), pa.array([step.tobytes()], pa.binary())], names=["u", "j", "part"])

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                key, part = (r["u"], r["j"]), np.frombuffer(r["part"])
                if last is not None and key != last:
                    yield result(*last, sums.pop(last))
                last = key
                sums[key] = sums[key] + part if key in sums else part
        if last is not None:
            yield result(*last, sums.pop(last))

    ddl = "u int, j int, part binary"
    found = blocks.mapInArrow(gather, ddl).repartition("u", "j").sortWithinPartitions("u", "j").mapInArrow(solve, ddl).collect()
    steps = [np.zeros_like(w) for w in weights]
    for r in found:  # one direction per column
        steps[r["u"]][:, r["j"]] = np.frombuffer(r["part"])
    return steps


def losses(blocks: DataFrame, views: list[View], units: list[Unit], classes: np.ndarray, weights: list[np.ndarray],
           steps: list[np.ndarray]) -> list[np.ndarray]:
    """Weighted squared hinge loss of every column at step lengths 0 and ``STEPS``: one (lengths x classes) array a unit."""
    groups, lengths = _by_view(units), (0.0, *STEPS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(units), len(lengths), len(classes)))
        for x, y, fold in _blocks(batches):
            for v, members in groups.items():
                keep = fold != views[v].fold
                z = views[v].design(x[keep])
                sign, weight = _signs(y[keep], classes, views[v])
                for u in members:
                    at, move = 1.0 - sign * (z @ weights[u]), sign * (z @ steps[u])
                    for k, t in enumerate(lengths):
                        sums[u, k] += (weight * np.maximum(at - t * move, 0.0) ** 2).sum(0)
        cell = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(sums.ravel())], names=["cell", "loss"])

    out = np.zeros(len(units) * len(lengths) * len(classes))
    for r in blocks.mapInArrow(gather, "cell long, loss double").groupBy("cell").agg(F.sum("loss").alias("loss")).collect():
        out[r["cell"]] = r["loss"]
    return list(out.reshape(len(units), len(lengths), len(classes)))


def solve(blocks: DataFrame, views: list[View], units: list[Unit], classes: np.ndarray, most: int = 40) -> tuple[list[np.ndarray], list[bool]]:
    """(weights, converged) of every unit."""
    weights = [np.zeros((views[u.view].width, len(classes))) for u in units]
    # a class without rows on either side has nothing to learn
    open_ = [(views[u.view].positive > 0) & (views[u.view].rest > 0) for u in units]
    lengths = np.array([0.0, *STEPS])
    for _ in range(most):
        steps = newton(blocks, views, units, classes, weights, open_)
        found = losses(blocks, views, units, classes, weights, steps)
        for u, unit in enumerate(units):
            w, d = weights[u][:-1], steps[u][:-1]
            size = 0.5 * ((w[None] + lengths[:, None, None] * d[None]) ** 2).sum(1)
            goal = size + unit.cost * found[u]
            best = goal.argmin(0)
            gain = goal[0] - goal[best, np.arange(len(classes))]
            weights[u] = weights[u] + steps[u] * lengths[best]
            open_[u] = open_[u] & (gain > TOLERANCE * (1.0 + goal[0]))
        if not any(o.any() for o in open_):
            break
    return weights, [not o.any() for o in open_]


def _groups(views: list[View], units: list[Unit], classes: int) -> Iterator[list[int]]:
    """Units in groups whose curvature fits the bound."""
    group, held = [], 0
    for u, unit in enumerate(units):
        size = 8 * classes * views[unit.view].width ** 2
        if group and held + size > CURVATURE_BYTES:
            yield group
            group, held = [], 0
        group.append(u)
        held += size
    if group:
        yield group


def solve_all(blocks: DataFrame, views: list[View], units: list[Unit], classes: list[int]) -> tuple[list[np.ndarray], list[bool]]:
    weights, converged = [], []
    for group in _groups(views, units, len(classes)):
        w, ok = solve(blocks, views, [units[u] for u in group], np.array(classes))
        weights += w
        converged += ok
    return weights, converged


# --- fitting and searching --------------------------------------------------------------
def fit(df: DataFrame, features: list[str], label: str, cost: float = 1.0, gamma: float | None = None, n_out: int = 64, seed: int = 42) -> HingeModel:
    """One-vs-rest SVM of every class in ``df``; ``gamma`` None is the linear kernel."""
    groups = _moments(df, features, label, None)
    classes = sorted({g["y"] for g in groups})
    view = _view(groups, classes, -1, gamma, n_out, seed)
    weights, converged = solve_all(pack(df, features, label, None), [view], [Unit(0, cost)], classes)
    return HingeModel(tuple(features), tuple(classes), view, weights[0], converged[0])


def search(df: DataFrame, features: list[str], label: str, fold: str, costs: list[float], gammas: list[float | None],
           n_out: int = 64, seed: int = 42) -> DataFrame:
    """cost, gamma, n, f1 (mean over folds of the weighted F1 of rows left out), converged: one row per point, all folds solved together.

    Points that are given twice are solved once and come out twice.
    """
    groups = _moments(df, features, label, fold)
    classes, folds = sorted({g["y"] for g in groups}), sorted({g["fold"] for g in groups})
    views = [_view(groups, classes, k, gamma, n_out, seed) for gamma in dict.fromkeys(gammas) for k in folds]
    units = [Unit(v, cost) for v in range(len(views)) for cost in dict.fromkeys(costs)]
    blocks = pack(df, features, label, fold)
    weights, converged = solve_all(blocks, views, units, classes)
    known = np.array(classes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for x, y, held in _blocks(batches):
            for v, members in _by_view(units).items():
                out = held == views[v].fold
                z = views[v].design(x[out])
                for u in members:
                    calls = known[(z @ weights[u]).argmax(1)] if len(z) else known[:0]
                    for (a, b), n in zip(*np.unique(np.stack([y[out], calls], 1), axis=0, return_counts=True)):
                        counts[u, int(a), int(b)] = counts.get((u, int(a), int(b)), 0) + int(n)
        rows = [(*k, n) for k, n in counts.items()] or np.zeros((0, 4), int)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(rows, np.int64).reshape(-1, 4)[:, c]) for c in range(4)], names=["u", "y", "pred", "n"])

    spark = df.sparkSession
    facts = spark.createDataFrame([(u, unit.cost, views[unit.view].gamma, bool(converged[u])) for u, unit in enumerate(units)],
                                  "u long, cost double, gamma double, converged boolean")
    calls = blocks.mapInArrow(predict, "u long, y long, pred long, n long")
    f1 = weighted_f1(calls, ["u"], "y", "pred", "n")
    solved = facts.join(f1, "u").groupBy(F.col("cost").alias("__c"), F.col("gamma").alias("__g")).agg(
        F.sum("n").alias("n"), F.avg("f1").alias("f1"), F.bool_and("converged").alias("converged"))
    points = spark.createDataFrame([(c, g) for g in gammas for c in costs], "cost double, gamma double")
    same = (F.col("cost") == F.col("__c")) & F.col("gamma").eqNullSafe(F.col("__g"))
    return points.join(solved, same).select("cost", "gamma", "n", "f1", "converged")


def weighted_f1(calls: DataFrame, by: list[str], truth: str, call: str, count: str | None = None) -> DataFrame:
    """``by``, n, f1: F1 of each class weighted by its rows, from given calls (or their counts); a class that is never right has F1 0."""
    n = F.sum(count) if count else F.count(F.lit(1))
    table = calls.groupBy(*by, F.col(truth).alias("__t"), F.col(call).alias("__p")).agg(n.alias("__n"))
    sides = F.array(F.struct(F.col("__t").alias("c"), F.col("__n").alias("t"), F.lit(0).cast("long").alias("p")),
                    F.struct(F.col("__p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("__n").alias("p")))
    one = table.withColumn("__hit", F.when(F.col("__t") == F.col("__p"), F.col("__n")).otherwise(0)).select(
        *by, F.posexplode(sides).alias("__side", "__s"), "__hit")
    classes = one.groupBy(*by, F.col("__s.c").alias("__c")).agg(
        F.sum("__s.t").alias("__t"), F.sum("__s.p").alias("__p"), F.sum(F.when(F.col("__side") == 0, F.col("__hit")).otherwise(0)).alias("__h"))
    f1 = 2.0 * F.col("__h") / (F.col("__t") + F.col("__p"))
    return classes.groupBy(*by).agg(F.sum("__t").alias("n"), (F.sum(f1 * F.col("__t")) / F.sum("__t")).alias("f1"))
