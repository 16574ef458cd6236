"""Approximate nearest neighbours: probed lists of rotated vectors, scanned in column blocks with early abandoning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

_PAIRS = 1 << 21  # products that are held at once


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of rows with an id and a vector that is not null, empty or zero and whose components are all finite."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(good)


class Index:
    """Rotation (principal axes first) and list centres, from a bounded sample; applied to every row."""

    def __init__(self, vectors: np.ndarray, lists: int, seed: int = 11, rounds: int = 20):
        rng = np.random.default_rng(seed)
        self.dim = vectors.shape[1]
        self.rotation = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]
        centres = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)]
        for _ in range(rounds):  # centres only shape the lists; every row is in exactly one, settled or not
            at = self.nearest(vectors, centres)
            n = np.bincount(at, minlength=len(centres))
            order = np.argsort(at, kind="stable")
            heads = np.concatenate([[0], np.cumsum(n)[:-1]])
            some = n > 0
            new = centres.copy()
            new[some] = np.add.reduceat(vectors[order], heads[some], axis=0) / n[some, None]
            if np.allclose(new, centres, atol=1e-6):
                break
            centres = new
        self.centres = centres

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = 0.5 * (centres**2).sum(1)
        step = max(1, _PAIRS // len(centres))
        return np.concatenate([np.argmax(x[k: k + step] @ centres.T - half, 1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Columns:
    """Rotated vectors with, for each column block end d, the norms of their first d and of their other columns."""

    def __init__(self, x: np.ndarray, ends: list[int]):
        self.x = x
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], 1)
        self.head = np.sqrt(total[:, ends])
        self.rest = np.sqrt(np.maximum(total[:, -1:] - total[:, ends], 0.0))

    def rows(self, some) -> Columns:
        out = object.__new__(Columns)
        out.x, out.head, out.rest = self.x[some], self.head[some], self.rest[some]
        return out


def ends_of(dim: int, column_block: int) -> list[int]:
    return [*range(column_block, dim, column_block), dim]


def scan_list(queries: Columns, floors: np.ndarray, cand: Columns, ends: list[int], z: float, alive: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of one list whose inner product reaches the query's floor, but for those that the scan drops wrongly.

    After d of D columns the partial product P of a pair stands beside the hypothesis that its whole product is the floor. With the
    directions of both vectors random inside the first d and the other columns, P and the rest R are independent with mean 0 and standard
    deviations p = |q_d| |x_d| / sqrt(d) and s = |q_rest| |x_rest| / sqrt(D - d); given P + R = floor, P has mean floor p²/(p² + s²) and standard
    deviation p s / sqrt(p² + s²). A pair whose P is more than ``z`` such deviations below that mean is abandoned. Blocks are
    products of all queries and candidates while more than a quarter of the pairs is alive; then only the pairs that are.
    ``alive`` receives (pairs alive after each block) and, last, all pairs.
    """
    m, n, dim = len(queries.x), len(cand.x), cand.x.shape[1]
    part, keep, a, b, lo = np.zeros((m, n)), np.ones((m, n), bool), None, None, 0
    left = []
    for k, d in enumerate(ends):
        if a is None:
            part += queries.x[:, lo:d] @ cand.x[:, lo:d].T
        else:
            part = part + np.einsum("ij,ij->i", queries.x[a, lo:d], cand.x[b, lo:d])
        lo = d
        if d == dim:
            least = floors[:, None] if a is None else floors[a]
        else:
            if a is None:
                p2 = np.multiply.outer(queries.head[:, k] ** 2 / d, cand.head[:, k] ** 2)
                s2 = np.multiply.outer(queries.rest[:, k] ** 2 / (dim - d), cand.rest[:, k] ** 2)
                f = floors[:, None]
            else:
                p2 = (queries.head[a, k] * cand.head[b, k]) ** 2 / d
                s2 = (queries.rest[a, k] * cand.rest[b, k]) ** 2 / (dim - d)
                f = floors[a]
            both = np.maximum(p2 + s2, 1e-300)
            least = f * p2 / both - z * np.sqrt(p2 * s2 / both) - 1e-9
        if a is None:
            keep &= part >= least
            left.append(int(keep.sum()))
            if left[-1] * 4 < keep.size or d == dim:
                a, b = np.nonzero(keep)
                part = part[a, b]
        else:
            some = part >= least
            a, b, part = a[some], b[some], part[some]
            left.append(len(a))
    if alive is not None:
        alive.append([*left, m * n])
    return a, b


def _best(own: np.ndarray, queries: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query place, id, score) of the k best pairs of each query, scores taken pair by pair from the original vectors."""
    other = own[a] != ids[b]
    a, b = a[other], b[other]
    score = np.einsum("ij,ij->i", queries[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[first], ids[b[first]], score[first]


def _few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows but for copies of a vector that has more than k others with smaller ids: ties go to smaller ids, so those cannot be among k."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    place = np.empty(len(x), np.int64)
    place[by] = np.arange(len(x)) - np.searchsorted(same[by], same[by], side="left")
    return np.sort(order[place <= k + 1])


_FOUND = "query_id long, vec_id long, score double"


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 20, lists: int | None = None, probe: float = 0.7, first: float = 0.06, sample: int = 16384, group: int | None = None,
                       chunk: int = 65536, column_block: int = 16, z: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query, without the query's own row.

    Score: inner product in double precision on the original vectors; ties to the smaller id. Vectors that
    are null, empty, zero, of another length than most, or hold null or non-finite components take no part, and
    neither do rows with a null id. Equal vectors are candidates each; repeated ids may appear
    repeatedly. With fewer than k candidates all are returned. An empty table gives no rows. Other columns are not read.

    Lists (about the square root of the rows, at most a sixteenth of the sample) are fitted on the ``sample`` vectors with the smallest hash
    of their id, a bounded sample; all rows are indexed. A query first scans the share ``first`` of the lists, its nearest ones, completely, and more until
    these hold 8 k rows; its k-th score there is its floor, so what passes the floor later does not grow with the table. Then it scans further lists, nearest first by product with the centre, up to the share ``probe``
    of all lists and until k rows are held, with early abandoning (``scan_list``). Directions without clusters need many lists.

    Lists are dealt to groups of about ``group`` rows (by default n / 64, between 4,096 and 131,072; a larger list is split by a hash), queries to chunks of
    about ``chunk``. A query goes once to each group that holds lists it probes, a candidate once to each chunk, so the exchange has
    queries x groups + candidates x chunks rows. A task holds one group and one chunk and returns k rows per query at most.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    base = usable(df, id_col, vec_col)
    picked = base.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # bounded sample
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = picked.column("vec").combine_chunks().value_lengths().to_numpy()
    dim = int(np.bincount(lengths).argmax())
    fit = np.array([v for v in picked.column("vec").to_pylist() if len(v) == dim])
    base = base.filter(F.size("vec") == dim)
    n = base.count()
    index = Index(fit, lists or max(1, min(round(math.sqrt(n)), max(1, len(fit) // 16))))
    n_lists, ends, first_share = len(index.centres), ends_of(dim, column_block), first
    box = spark.sparkContext.broadcast(index)  # lists x dim numbers

    def place(batches):
        ix = box.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_pydict({"list": ix.nearest(x, ix.centres).astype(np.int64), "id": b.column(0), "vec": b.column(1)})

    indexed, _ = scratch.land(base.mapInArrow(place, "list long, id long, vec array<double>"))
    sizes = np.zeros(n_lists, np.int64)
    for r in indexed.groupBy("list").count().collect():  # one row per list
        sizes[r[0]] = r[1]
    wide = group or min(131072, max(4096, n // 64))
    parts = np.maximum(1, np.ceil(sizes / wide)).astype(np.int64)
    # small lists share a group; each part of a large one has its own
    first, at, held = np.zeros(n_lists, np.int64), 0, 0
    for c in range(n_lists):
        if held and held + sizes[c] > wide:
            at, held = at + 1, 0
        first[c], held = at, held + sizes[c]
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
    asked, _ = scratch.land(usable(queries, id_col, vec_col).filter(F.size("vec") == dim))
    chunks = max(1, math.ceil(asked.count() / chunk))
    spot, lit = F.col("list").cast("int"), lambda v: F.array(*[F.lit(int(i)) for i in v])
    home = F.get(lit(first), spot) + F.pmod(F.xxhash64("id", F.lit(5)), F.get(lit(parts), spot)).cast("int")
    cand = indexed.select(home.cast("long").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "list", "id", "vec")
    nearby = spark.sparkContext.broadcast((sizes, first, parts))

    def send(far: bool):
        """Each query to the groups of its first lists, or of the others that it probes; ``lists`` has one bit per list."""
        def run(batches):
            ix = box.value
            sizes, first, parts = nearby.value
            for b in batches:
                names = b.schema.names
                q = _matrix(b.column(names.index("vec")), dim)
                for lo in range(0, len(q), 1024):
                    order = np.argsort(-(q[lo: lo + 1024] @ ix.centres.T), 1, kind="stable")
                    before = np.cumsum(sizes[order], 1) - sizes[order]
                    near = (before < 8 * k + 1) | (np.arange(n_lists) < math.ceil(first_share * n_lists))
                    use = ~near & ((np.arange(n_lists) < math.ceil(probe * n_lists)) | (before < k + 1)) if far else near
                    bits = np.zeros((len(order), n_lists), bool)
                    np.put_along_axis(bits, order, use & (sizes[order] > 0), 1)
                    row, to = [], []
                    for i in range(len(bits)):
                        some = np.flatnonzero(bits[i])
                        got = np.unique(np.concatenate([first[some], *[np.arange(first[c], first[c] + parts[c]) for c in some[parts[some] > 1]]])) if len(some) else some
                        to.append(got)
                        row.append(np.full(len(got), lo + i))
                    row, to = np.concatenate(row), np.concatenate(to)
                    packed = [r.tobytes() for r in np.packbits(bits, axis=1)]
                    yield pa.RecordBatch.from_pydict({"group": pa.array(to, pa.int64()), "id": b.column(names.index("id")).take(pa.array(row)), "vec": b.column(names.index("vec")).take(pa.array(row)),
                                                      "lists": pa.array([packed[r - lo] for r in row], pa.binary()),
                                                      "floor": b.column(names.index("floor")).take(pa.array(row)) if far else pa.array(np.zeros(len(row)))})
        return run

    def to_groups(df, far):
        out = df.mapInArrow(send(far), "group long, id long, vec array<double>, lists binary, floor double")
        return out.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))

    def search(far: bool):
        def run(c: pa.Table, q: pa.Table) -> pa.Table:
            ix = box.value
            out: list = [[], [], []]
            if c.num_rows and q.num_rows:
                x, ids, at = _matrix(c.column("vec"), dim), c.column("id").to_numpy(), c.column("list").to_numpy()
                some = _few_copies(x, ids, k)
                some = some[np.argsort(at[some], kind="stable")]
                x, ids, at = x[some], ids[some], at[some]
                qs, own, floor = _matrix(q.column("vec"), dim), q.column("id").to_numpy(), q.column("floor").to_numpy()
                bits = np.unpackbits(np.frombuffer(b"".join(q.column("lists").to_pylist()), np.uint8).reshape(len(qs), -1), axis=1)
                turned, asks = (Columns(v @ ix.rotation, ends) if far else None for v in (x, qs))
                names, heads = np.unique(at, return_index=True)
                for name, lo, hi in zip(names.tolist(), heads.tolist(), [*heads[1:].tolist(), len(x)]):
                    mine = np.flatnonzero(bits[:, name])
                    step = max(1, _PAIRS // (hi - lo))
                    for s in range(0, len(mine), step):
                        rows = mine[s: s + step]
                        if far:
                            a, b = scan_list(asks.rows(rows), floor[rows] - 1e-9, turned.rows(slice(lo, hi)), ends, z)
                        else:
                            score = qs[rows] @ x[lo:hi].T
                            a, b = np.nonzero(score >= (np.partition(score, -k - 1, 1)[:, [-k - 1]] if hi - lo > k else -np.inf) - 1e-9)
                        a, ids_, score = _best(own[rows], qs[rows], a, b, ids[lo:hi], x[lo:hi], k)
                        for o, v in zip(out, (own[rows[a]], ids_, score), strict=True):
                            o.append(v)
            found = [np.concatenate(v) if v else np.zeros(0) for v in out]
            order = np.lexsort((found[1], -found[2], found[0]))
            found = [v[order] for v in found]
            best = np.arange(len(order)) - np.searchsorted(found[0], found[0], side="left") < k
            return pa.table({n: pa.array(v[best], pa.float64() if n == "score" else pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found, strict=True)})
        return run

    def found(sent, far):
        return cand.groupBy("group", "chunk").cogroup(sent.groupBy("group", "chunk")).applyInArrow(search(far), _FOUND)

    near, _ = scratch.land(_top(found(to_groups(asked, False), False), k))
    floors = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    with_floor = asked.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.coalesce("floor", F.lit(-1.7e308)).alias("floor"))
    return _top(near.select("query_id", "vec_id", "score").unionByName(found(to_groups(with_floor, True), True)), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """Best k rows per query; ranks over at most k rows per (query, task)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
