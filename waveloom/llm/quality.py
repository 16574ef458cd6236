"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, linear hinge loss by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, slices, table, utf8, utf8_bytes

BITS = 18  # indicators are hashed to 2^18 columns
_KINDS = []
for _chars in (list(range(97, 123)) + list(range(128, 256)), range(65, 91), range(48, 58), map(ord, "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")):
    _t = np.zeros(256, np.int64)
    _t[list(_chars)] = 1
    _KINDS.append(_t)  # lower case or beyond ASCII, upper case, digits, symbols


def indicators(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every indicator that is on, each once, ascending.

    N-grams of three streams: byte trigrams; words; and the words' make-up (lower case, upper
    case, digits, symbols, equal to the word before), 1 to 3 words together.
    """
    w = Words(blob, offsets)
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    b = blob.astype(U64)
    whole = owner[:-2] == owner[2:] if len(b) > 2 else np.zeros(0, bool)
    tri = ((b[:-2] << U64(16)) | (b[1:-1] << U64(8)) | b[2:])[whole] if len(b) > 2 else b[:0]
    docs, marks = [owner[:-2][whole] if len(b) > 2 else owner[:0], w.doc], [mix(tri + U64(1 << 40)), w.hash]
    make = np.ones(len(w.start), np.int64)
    for k, t in enumerate(_KINDS):
        run = np.concatenate([[0], np.cumsum(t[blob])])
        make += np.where(run[w.end] > run[w.start], 1 << k, 0)
    if len(make):
        make[1:] += np.where((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]), 16, 0)
    for size in (1, 2, 3):
        m = len(make) - size + 1
        if m <= 0:
            break
        x = np.zeros(m, np.int64)
        for j in range(size):
            x = x * 64 + make[j: m + j]
        inside = w.doc[:m] == w.doc[size - 1:]
        docs.append(w.doc[:m][inside])
        marks.append(mix(x[inside].astype(U64) + U64(1 << 41)))
    key = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | (np.concatenate(marks) >> U64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def _runs(batch, text_col: str):
    blob, offsets = utf8_bytes(utf8(batch.column(batch.schema.get_field_index(text_col))))
    for lo, hi in slices(offsets, 1 << 18):
        yield lo, hi, *indicators(blob[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0, tol: float = 1e-3, max_epochs: int = 500):
    """Weights, bias and relative duality gap of the least |w|²/2 + cost * hinge losses, over unit-length rows of ``scale`` at the columns given.

    One dual variable at a time is set to its optimum inside [0, cost]; epochs run in a fixed random order
    until the largest change of an epoch is under ``tol``, or ``max_epochs`` are over: the gap says how far the result is from the optimum.
    """
    rng = np.random.default_rng(7)
    values = [scale[c] / max(np.linalg.norm(scale[c]), 1e-12) for c in rows]
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(max_epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            c, v = rows[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[c] @ v + bias) - 1) / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w[c] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < tol:
            break
    norm = float(w @ w + bias**2)
    primal = norm / 2 + cost * sum(max(0.0, 1 - t * (float(w[c] @ v) + bias)) for c, v, t in zip(rows, values, y, strict=True))
    return w, bias, (primal - (float(alpha.sum()) - norm / 2)) / max(primal, 1e-12)


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins to probabilities (Newton steps on smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    at = np.array([1.0, 0.0])
    loss = lambda p: float(np.sum(np.logaddexp(0, x @ p) - target * (x @ p)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        grad = x.T @ (p - target)
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        size = 1.0
        while loss(at - size * step) > loss(at) + 1e-12 and size > 1e-6:
            size /= 2
        at = at - size * step
    return max(float(at[0]), 1e-6), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Learn from all texts in ``docs`` that have a label 0 or 1; returns the model.

    Log-count ratios come from all labelled texts (summed per task before the shuffle; the result has
    2^18 columns at most). The linear model is fitted on at most ``max_fit`` labelled texts, those with the
    smallest hash of their id, one text per id; every fifth of them sets the score's slope and offset instead.
    Texts are read whole, however long. Without texts of one class the model is a constant: 1 unless only class 0 is known.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null")
    train = docs.select(F.col(id_col).alias("_id"), text_col)

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy()
            for lo, hi, doc, col in _runs(batch, text_col):
                for k in (0, 1):
                    sums[k] += np.bincount(col[y[lo: hi][doc] == k], minlength=1 << BITS)
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_pydict({"col": at, "bad": sums[0][at], "good": sums[1][at]})

    counted = (train.join(known.hint("merge"), "_id").mapInArrow(count, "col long, bad long, good long")
               .groupBy("col").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas())
    sums = np.ones((2, 1 << BITS))
    sums[0][counted["col"]] += counted["bad"]
    sums[1][counted["col"]] += counted["good"]
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())

    some = known.join(train.select("_id"), "_id").groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_fit)

    def gather(batches):
        for batch in batches:
            ids, y = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_y"))
            for lo, hi, doc, col in _runs(batch, text_col):
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pydict({"_id": ids.slice(lo, hi - lo), "_y": y.slice(lo, hi - lo),
                                                  "cols": pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(col.astype(np.int32)))})

    kind = docs.schema[id_col].dataType.simpleString()
    # of rows that share an id, the text with the smallest hash
    one = train.join(F.broadcast(some), "_id").groupBy("_id", "_y").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col))).alias(text_col)).select("_id", text_col, "_y")
    rows = one.mapInArrow(gather, f"_id {kind}, _y int, cols array<int>").toArrow()  # max_fit rows
    y = np.where(rows.column("_y").to_numpy() > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return {"constant": 0.0 if len(y) and y[0] < 0 else 1.0}
    order = np.argsort(rows.column("_id").to_numpy(), kind="stable")
    lists = rows.column("cols").combine_chunks()
    flat, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    cols = [flat[off[i]: off[i + 1]] for i in order]
    y = y[order]
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart[:] = False
    use = np.flatnonzero(~apart)
    w, bias, gap = dual_descent([cols[i] for i in use], ratio, y[use])
    test = np.flatnonzero(apart) if apart.any() else use
    margin = np.array([w[cols[i]] @ ratio[cols[i]] / max(np.linalg.norm(ratio[cols[i]]), 1e-12) + bias for i in test])
    slope, offset = _sigmoid_fit(margin, y[test])
    return {"weight": (w * ratio).astype(np.float32), "square": (ratio**2).astype(np.float32), "bias": bias, "gap": gap, "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (all by default) with a score (0 to 1, higher: class 1 likelier) and a prediction (score >= threshold).

    Reads the whole text and nothing else. Null and empty texts have no indicators and get the score of
    the bias alone. Repeated rows get equal scores. Columns of the input that have one of ``names`` are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in names]
    box = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2^18 numbers

    def work(batches):
        m = box.value
        for batch in batches:
            out = np.full(batch.num_rows, m.get("constant", 0.0))
            if "constant" not in m:
                for lo, hi, doc, col in _runs(batch, text_col):
                    sums = np.bincount(doc, m["weight"][col], hi - lo)
                    norm = np.sqrt(np.bincount(doc, m["square"][col], hi - lo))
                    z = m["slope"] * (sums / np.maximum(norm, 1e-12) + m["bias"]) + m["offset"]
                    out[lo: hi] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {names[0]: out, names[1]: (out >= threshold).astype(np.int32)})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(work, f"{schema}, `{names[0]}` double, `{names[1]}` int")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod 4 is not 2; score all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id", "held_out"])
