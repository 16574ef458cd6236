"""Many logistic probes at once: every pass over the packed blocks gives losses and gradients of all models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .landing import land


class _Model:
    """One probe (set of rows, held-out fold): standardized coefficients and intercepts by preconditioned L-BFGS, one evaluation per pass.

    The loss is the weighted mean of log losses plus ``reg`` / 2 times the squared standardized coefficients; intercepts are free. Two classes
    have one column of coefficients (binomial), more have one per class.
    """

    def __init__(self, name: str, fold: int, weight: np.ndarray, scale: np.ndarray, second: np.ndarray, reg: float):
        self.name, self.fold, self.weight, self.scale, self.reg = name, fold, weight, scale, reg
        self.classes, self.dim = len(weight), len(scale)
        self.columns = 1 if self.classes == 2 else self.classes
        self.at = np.zeros((self.dim + 1, self.columns))
        self.trial, self.value, self.grad = self.at, None, None
        self.memory: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.done = 1.0, False
        # curvature of the loss is at most half (a quarter for two classes) of the second moments
        curve = (0.25 if self.columns == 1 else 0.5) * second
        curve[np.arange(self.dim), np.arange(self.dim)] += reg
        curve[np.arange(self.dim + 1), np.arange(self.dim + 1)] += 1e-12
        self.precondition = np.linalg.inv(curve)

    def __getstate__(self) -> dict:
        """What tasks need."""
        return {k: getattr(self, k) for k in ("name", "fold", "weight", "scale", "classes", "columns", "trial", "at")}

    def terms(self, x: np.ndarray, y: np.ndarray):
        """Sum of weighted losses of rows and its gradient; ``x`` standardized with a column of ones."""
        z = x @ self.trial
        full = np.concatenate([np.zeros((len(x), 1)), z], 1) if self.columns == 1 else z
        full = np.where(self.weight > 0, full, -np.inf)
        top = full.max(1, keepdims=True)
        e = np.exp(full - top)
        w = self.weight[y]
        loss = w @ (np.log(e.sum(1)) + top[:, 0] - full[np.arange(len(x)), y])
        p = e / e.sum(1, keepdims=True)
        p[np.arange(len(x)), y] -= 1
        return loss, x.T @ ((p[:, 1:] if self.columns == 1 else p) * w[:, None])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.at
        full = np.concatenate([np.zeros((len(x), 1)), z], 1) if self.columns == 1 else z
        full = np.where(self.weight > 0, full, -np.inf)
        e = np.exp(full - full.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def take(self, loss: float, grad: np.ndarray, total: float, tol: float) -> None:
        """Use the summed loss and gradient at the trial point, and choose the next one."""
        loss, grad = loss / total, grad / total
        loss += self.reg / 2 * float((self.trial[:-1] ** 2).sum())
        grad = grad.copy()
        grad[:-1] += self.reg * self.trial[:-1]
        if self.value is not None:
            move = self.trial - self.at
            if loss > self.value + 1e-4 * float((self.grad * move).sum()) + 1e-15 * abs(self.value):
                self.step /= 2
                if self.step < 1e-10:
                    self.done = True
                self.trial = self.at + self.step * self.direction
                return
            change = grad - self.grad
            if (move * change).sum() > 1e-300:
                self.memory = [*self.memory[-9:], (move, change)]
        self.at, self.value, self.grad = self.trial, loss, grad
        if np.abs(grad).max() <= tol:
            self.done = True
            return
        q, used = grad.copy(), []
        for s, c in reversed(self.memory):
            a = (s * q).sum() / (s * c).sum()
            q -= a * c
            used.append(a)
        q = self.precondition @ q
        for (s, c), a in zip(self.memory, reversed(used)):
            q += s * (a - (c * q).sum() / (s * c).sum())
        self.direction, self.step = -q, 1.0
        self.trial = self.at + self.direction


def _each(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            m = batch.column(4)[k].values
            yield (batch.column(0)[k].as_py(), *[batch.column(c)[k].values.to_numpy() for c in (1, 2, 3)], m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1))


def _summed(blocks: DataFrame, size: int, body) -> np.ndarray:
    """Sum of what ``body(name, y, fold, train, x, out)`` adds to an array of ``size`` numbers; parts of tasks are added position by position."""
    def run(batches):
        out = np.zeros(size)
        for cells in _each(batches):
            body(*cells, out)
        yield pa.RecordBatch.from_pydict({"a": pa.array([out], pa.list_(pa.float64()))})

    got = blocks.select("name", "y", "fold", "train", "m").mapInArrow(run, "a array<double>").select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def probe_folds(vectors: dict[str, DataFrame], n_folds: int, classes: int, ids: Sequence[str], *, label: str = "label", x: str = "x", reg: float = 1e-3, balanced: bool = True,
                tol: float = 1e-9, most: int = 500) -> DataFrame:
    """CLU16: (name, fold, ids.., label, pred_label, prob): for every set of vectors and every fold, the rows of the fold by a multinomial
    (two classes: binomial) logistic regression fitted on the fold's training rows.

    Each entry of ``vectors`` has rows (ids.., fold, train, label 0 .. classes - 1, x): the fold that a row is held out of, and bit f of ``train`` set
    where the row trains the model of fold f. Features are scaled by their weighted sample std in the fold's
    training rows, constant ones have no weight; classes weigh alike with ``balanced``. All models are fitted together: a pass over the
    blocks gives loss and gradient of each, on the driver L-BFGS steps follow, preconditioned by the second moments. A model is done
    when no gradient entry exceeds ``tol`` (or its steps are lost in rounding); more than ``most`` passes raise. Driver and tasks hold
    models, whose number and width come from the settings, not rows.
    """
    blocks = None
    for name, df in vectors.items():
        p = B.pack(df.select(*ids, "fold", "train", label, x), [], ids, x, extra=["fold", "train", label])
        get = lambda k: F.expr(f"transform(ids, s -> cast(s.`{k}` as bigint))")
        p = p.select(F.lit(name).alias("name"), get(label).alias("y"), get("fold").alias("fold"), get("train").alias("train"), "m", F.transform("ids", lambda s: F.struct(*[s[i].alias(i) for i in ids])).alias("ids"))
        blocks = p if blocks is None else blocks.unionByName(p)
    blocks = land(blocks)
    dims = {r[0]: r[1] for r in blocks.groupBy("name").agg(F.max(F.size(F.get("m", 0)))).collect()}
    names = [n for n in vectors if n in dims]
    if not names:
        raise ValueError("no rows")
    spark = blocks.sparkSession

    # rows, sums and squares of each fold's training rows by class; second moments of all rows
    place, size = {}, 0
    for n in names:
        d = dims[n]
        place[n] = size, size + n_folds * classes * (1 + 2 * d)
        size = place[n][1] + (d + 1) ** 2

    def moments(name, y, fold, train, m, out):
        lo, hi = place[name]
        d = m.shape[1]
        t = out[lo:hi].reshape(n_folds, classes, 1 + 2 * d)
        every = np.concatenate([np.ones((len(m), 1)), m, m * m], 1)
        for f in range(n_folds):
            t[f] += (((train >> f) & 1)[:, None] * (y[:, None] == np.arange(classes))).T @ every
        one = np.concatenate([m, np.ones((len(m), 1))], 1)
        out[hi: hi + (d + 1) ** 2] += (one.T @ one).ravel()

    got = _summed(blocks, size, moments)
    models: list[_Model] = []
    totals = []
    for n in names:
        lo, hi = place[n]
        d = dims[n]
        t = got[lo:hi].reshape(n_folds, classes, 1 + 2 * d)
        second = got[hi: hi + (d + 1) ** 2].reshape(d + 1, d + 1)
        for f in range(n_folds):
            own = t[f]
            count = own[:, 0]
            present = (count > 0).sum()
            weight = np.where(count > 0, count.sum() / (present * np.maximum(count, 1)) if balanced else 1.0, 0.0)
            w = weight @ count
            mean = weight @ own[:, 1: d + 1] / max(w, 1e-300)
            free = w - (weight**2 @ count) / max(w, 1e-300)
            var = np.maximum(weight @ own[:, d + 1:] - w * mean**2, 0) / max(free, 1e-300)
            scale = np.where(var > 1e-24 * np.maximum(mean**2, 1e-300), 1 / np.sqrt(np.maximum(var, 1e-300)), 0.0)
            by = np.append(scale, 1.0)
            models.append(_Model(n, f, weight, scale, second / max(second[-1, -1], 1) * np.outer(by, by), reg))
            totals.append(w)

    for _ in range(most):
        some = [i for i, m in enumerate(models) if not m.done]
        if not some:
            break
        cuts = np.cumsum([0, *[1 + models[i].at.size for i in some]])
        box = spark.sparkContext.broadcast([(models[i], cuts[j], cuts[j + 1]) for j, i in enumerate(some)])

        def gradients(name, y, fold, train, m, out, box=box):
            for model, lo, hi in box.value:
                if model.name == name:
                    use = ((train >> model.fold) & 1) > 0
                    loss, grad = model.terms(np.concatenate([m[use] * model.scale, np.ones((int(use.sum()), 1))], 1), y[use])
                    out[lo] += loss
                    out[lo + 1: hi] += grad.ravel()

        sums = _summed(blocks, int(cuts[-1]), gradients)
        for j, i in enumerate(some):
            models[i].take(sums[cuts[j]], sums[cuts[j] + 1: cuts[j + 1]].reshape(models[i].at.shape), totals[i], tol)
    else:
        raise RuntimeError(f"a probe did not converge in {most} passes")
    box = spark.sparkContext.broadcast({(m.name, m.fold): m for m in models})

    def predict(batches):
        for batch in batches:
            for name, y, fold, _, m in _each([batch]):
                prob = np.zeros((len(m), classes))
                for f in np.unique(fold[fold >= 0]):
                    model, own = box.value[(name, int(f))], fold == f
                    prob[own] = model.probabilities(np.concatenate([m[own] * model.scale, np.ones((int(own.sum()), 1))], 1))
                yield pa.RecordBatch.from_pydict({"name": [name], "y": pa.array([y]), "fold": pa.array([fold]), "pred": pa.array([prob.argmax(1)], pa.list_(pa.int64())),
                                                  "prob": pa.array([prob.tolist()], pa.list_(pa.list_(pa.float64())))})

    # ids stay on the Spark side: a block's predictions meet them by the block's number
    kept = land(blocks.withColumn("_b", F.monotonically_increasing_id()))
    own = kept.select("name", "y", "fold", "train", "m", "_b")

    def numbered(batches):
        for batch in batches:
            for k, out in enumerate(predict([batch])):
                yield out.append_column("_b", batch.column(5).slice(k, 1))

    done = own.mapInArrow(numbered, "name string, y array<long>, fold array<long>, pred array<long>, prob array<array<double>>, _b long")
    z = done.join(kept.select("_b", "ids"), "_b").select("name", F.explode(F.arrays_zip("ids", "y", "fold", "pred", "prob")).alias("z"))
    return z.filter("z.fold >= 0").select("name", F.col("z.fold").alias("fold"), "z.ids.*", F.col("z.y").alias(label), F.col("z.pred").alias("pred_label"), F.col("z.prob").alias("prob"))
