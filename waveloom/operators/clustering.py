"""Clusters of windows, their quality, and what embeddings encode.

Vectors are rows (ids.., x array). Comparisons of all pairs run as numpy products of bounded blocks that
return sums or the nearest few per row; no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.exprs import a_dot, a_sum, a_unit, argmax_first, c, fixed_map, over, pick_first, random_hex, softmax
from . import blocks as B
from . import evaluation as ev
from . import forests, grids, probes
from . import kernels as K
from .grids import grid_search  # noqa: F401  CLU03
from .landing import land
from .ordered import attach, positions, quantiles
from .selection import stratified_folds

S, SEG = "subject_id", "segment_id"


def mean_vectors(df: DataFrame, by: Sequence[str], dim: int, x: str = "x", name: str = "centroid") -> DataFrame:
    """CLU12: mean vector and size per group, one partial average per dimension."""
    return df.groupBy(*by).agg(F.array(*[F.avg(F.get(x, k)) for k in range(dim)]).alias(name), F.count("*").alias("n"))


def _dist(a, b):
    return F.sqrt(a_sum(F.zip_with(c(a), c(b), lambda p, q: (p - q) * (p - q))))


# ---- fit and apply ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Clusterer:
    """Scaler with optional components (one row), and centres (one row), fitted on training rows."""

    base: DataFrame
    dims: int | None
    centres: DataFrame

    def place(self, df: DataFrame, ids: Sequence[str], x: str) -> DataFrame:
        """Blocks of the rows in the space of the centres."""
        b = B.pack(_clean(df, x).select(*ids, x), [], ids, x)
        return B.scale(b, self.base, []) if self.dims is None else B.project(b, self.base, [], self.dims)


def _clean(df: DataFrame, x: str) -> DataFrame:
    """NaN, infinities and missing components count as 0."""
    return df.withColumn(x, F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)))


def fit_clusterer(train: DataFrame, k: int = 6, dims: int | None = 8, seed: int = 42, x: str = "x", ids: Sequence[str] = ("vec_id",), starts: int = 10) -> Clusterer:
    """CLU01: scaler (population std), optional components (signs fixed) and k-means, fitted on training rows only.

    NaN and infinities count as 0; k is limited to the rows, ``dims`` to rows and features; without ``dims`` the
    scaled features are clustered. The best of ``starts`` starts is kept, each run until it settles.
    """
    b = land(B.pack(_clean(train, x).select(*ids, x), [], ids, x))
    n, d = b.agg(F.sum(F.size("m")), F.max(F.size(F.get("m", 0)))).first()
    if not n:
        raise ValueError("no training rows")
    eff = min(dims, n, d) if dims else None
    base = B.pca_models(b, [], eff or 1)
    z = land(B.project(b, base, [], eff) if eff else B.scale(b, base, []))
    return Clusterer(base, eff, grids.fit_one(z, min(k, n), starts=starts, seed=seed))


def apply_clusterer(model: Clusterer, df: DataFrame, x: str = "x", ids: Sequence[str] = ("vec_id",)) -> DataFrame:
    """CLU01: cluster id, distance to its centre, and the first two coordinates."""
    out = B.unpack(B.assign(model.place(df, ids, x), model.centres, []), [], ["m", "cluster", "distance"])
    out = out.withColumn("pca1", F.get("m", 0)).withColumn("pca2", F.get("m", 1)).drop("m")
    return df.join(out, list(ids)).select(*df.columns, "cluster", "distance", "pca1", "pca2")


def cluster_manifest(vectors: DataFrame, k: int = 6, dims: int | None = 8, seed: int = 42, split: str = "split", ids: Sequence[str] = ("vec_id",)) -> DataFrame:
    """CLU02: fit on train, apply to every split."""
    model = fit_clusterer(vectors.filter(F.col(split) == "train"), k, dims, seed, ids=ids)
    return apply_clusterer(model, vectors, ids=ids)


def prototype_vectors(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """CLU08: node features z-scored within a segment, then flat values and region means as one vector per graph."""
    from .graphs import region_features
    from .projections import normalize_nodes

    z = normalize_nodes(nodes)
    flat = z.groupBy("graph_id", S).agg(F.sort_array(F.collect_list(F.struct("node", "feature", "x"))).alias("_a"))
    reg = region_features(z, members).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("region", "feature", "mean"))).alias("_b"))
    return flat.join(reg, "graph_id").select("graph_id", S, F.concat(F.col("_a.x"), F.col("_b.mean")).alias("x"))


def prototypes(model: Clusterer, df: DataFrame, temperature: float = 1.0, x: str = "x", ids: Sequence[str] = ("graph_id",)) -> DataFrame:
    """CLU08: distances to every prototype, hard id, softmax(-d / T), ln(1 + d)."""
    d = B.unpack(B.distances(model.place(df, ids, x), model.centres, []), [], ["distances"])
    t = df.join(d, list(ids)).withColumn("prototype", (F.array_position("distances", F.array_min("distances")) - 1).cast("int"))
    return t.withColumn("soft", softmax(F.transform("distances", lambda v: -v / temperature))).withColumn("log_distances", F.transform("distances", F.log1p))


def prototype_usage(assigned: DataFrame) -> DataFrame:
    n = assigned.agg(F.count("*").alias("_n"))
    return attach(assigned.groupBy("prototype").agg(F.count("*").alias("n")), n, []).withColumn("usage", F.col("n") / F.col("_n")).drop("_n")


# ---- validity -----------------------------------------------------------------------------------

def _blocks(df: DataFrame, ids: Sequence[str], extra: Sequence[str], x: str, block: int) -> DataFrame:
    b = B.pack(df, [], ids, x, block, extra)
    return b.select("b", "ids", "m", *[F.expr(f"transform(ids, s -> cast(s.{e} as bigint))").alias(e) for e in (*ids, *extra)])


def _block_pairs(blocks: DataFrame, cols: Sequence[str], both: bool = False) -> DataFrame:
    """Every pair of blocks b <= o once (or in both orders), joined on explicit partner numbers."""
    n = blocks.agg((F.max("b") + 1).alias("_btw"))
    partners = F.sequence(F.lit(0).cast("long"), F.col("_btw") - 1) if both else F.sequence(F.col("b"), F.col("_btw") - 1)
    left = attach(blocks.select("b", *[F.col(k).alias(f"l_{k}") for k in cols]), n, []).withColumn("o", F.explode(partners)).drop("_btw")
    return left.join(blocks.select(F.col("b").alias("o"), *[F.col(k).alias(f"r_{k}") for k in cols]), "o")


def _dense_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _distance_sums(p: np.ndarray, others: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of the distances of each row of p to all rows of the others; few rows of p at a time, so that what is held stays small."""
    a = np.column_stack([-2 * p, (p**2).sum(1), np.ones(len(p))])
    out = np.zeros(len(p))
    for q in others:
        b = np.column_stack([q, np.ones(len(q)), (q**2).sum(1)]).T
        for lo in range(0, len(p), 256):
            d = a[lo: lo + 256] @ b
            np.maximum(d, 0, out=d)
            out[lo: lo + 256] += np.sqrt(d, out=d).sum(1)
    return out


def _numbered(df: DataFrame, by: str, ids: Sequence[str], x: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (by, b, ids, m, n_b) of rows that share ``by``, numbered from 0 there; and (by, n_b)."""
    b = B.pack(df, [by], ids, x, block)
    count = b.groupBy(by).agg((F.max("b") + 1).alias("n_b"))
    return b, count


def silhouette(df: DataFrame, ids: Sequence[str], cluster: str = "cluster", x: str = "x", block: int = 2048, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean silhouette with Euclidean distances.

    Exact form: a row's mean distance to a cluster lies between its distance d to the cluster's mean and sqrt(d^2 + v), v the cluster's mean
    squared distance to that mean. So sums of distances are taken to the row's own cluster and to those clusters only whose lower bound
    does not exceed the least upper bound of the other clusters; blocks hold rows of one cluster, and a block meets the blocks of a cluster
    if one of its rows needs that cluster. Up to 32 blocks form a group, and a group meets a group in one task: so a block moves once per group of blocks
    that it meets, not once per block. Own clusters stay quadratic in their size. With ``sample``, the silhouette of that many rows with the
    smallest keyed hash, among themselves: a bounded documented sample, the same rows in every run.
    """
    if sample is not None:
        df = pick_first(df, [], random_hex(F.lit(int(seed)), F.to_json(F.struct(*ids))), k=sample)
    df = df.select(*ids, F.col(cluster).cast("long").alias("c"), F.col(x).alias("x"))
    bl, count = _numbered(df, "c", ids, "x", block)
    bl = land(bl.select("c", "b", "m"))
    # one row per cluster: number of blocks, rows, mean, mean squared distance to the mean
    mom = B.moments(bl, ["c"]).join(count, "c").orderBy("c").collect()
    if not mom:
        return df.agg(F.avg(F.lit(None).cast("double")).alias("silhouette"))
    parts = [B._split(np.asarray(r["moments"], float)) for r in mom]
    names, n, mean = np.array([r["c"] for r in mom]), np.array([p[0] for p in parts]), np.stack([p[1] for p in parts])
    spread = np.array([max(np.trace(p[2]) - (p[1] ** 2).sum(), 0.0) for p in parts])
    blocks_of = {r["c"]: r["n_b"] for r in mom}
    box = df.sparkSession.sparkContext.broadcast((names, n, mean, spread))

    @F.pandas_udf("array<long>")
    def needed(c_: pd.Series, m: pd.Series) -> pd.Series:
        names, n, mean, spread = box.value
        out = []
        for own, a in zip(c_, m):
            d = _dense_dist(K.matrix(a), mean)
            me = int(np.searchsorted(names, own))
            high = np.sqrt(d**2 + spread)
            high[:, me] = np.inf
            use = (d <= high.min(1)[:, None] * (1 + 1e-9) + 1e-9).any(0)
            use[me] = True
            out.append(names[use].tolist())
        return pd.Series(out)

    @F.pandas_udf("binary")
    def packed(m: pd.Series) -> pd.Series:
        return pd.Series([K.packed(K.matrix(a)) for a in m])

    dim = len(mean[0])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of distances of the rows of each left block to all rows of the right blocks."""
        far = [K.unpacked(v, dim).astype(float) for v in right.column("r_x").to_pylist()]
        out = [_distance_sums(K.unpacked(v, dim).astype(float), far) for v in left.column("x").to_pylist()]
        return pa.table({"c": left.column("c"), "b": left.column("b"), "to": left.column("to"), "sums": pa.array(out, pa.list_(pa.float64()))})

    wide = max(1, min(_GROUP, math.ceil(math.sqrt(sum(blocks_of.values())))))
    last = F.element_at(fixed_map({int(k): (int(v) - 1) // wide for k, v in blocks_of.items()}), F.col("to"))
    group = lambda v: F.floor(F.col(v) / wide)
    tile = ["c", "gl", "to", "gr"]
    left = bl.select("c", "b", packed("m").alias("x"), needed("c", "m").alias("all")).withColumn("to", F.explode("all")).withColumn("gr", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    left = left.select("c", group("b").alias("gl"), "to", "gr", "b", "x")
    tiles = land(left.select(*tile).distinct())  # at most one row per pair of groups
    right = tiles.join(bl.select(F.col("c").alias("to"), group("b").alias("gr"), packed("m").alias("r_x")), ["to", "gr"])
    # a fixed number of partitions, so that small but costly tiles are not packed into few tasks
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (v.repartition(width, *tile) for v in (left, right))
    p = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(meet, "c long, b long, to long, sums array<double>")
    tot = B.sum_arrays(p, ["c", "b", "to"], "sums").groupBy("c", "b").agg(F.collect_list(F.struct("to", "sums")).alias("all"))

    @F.pandas_udf("double")
    def value(c_: pd.Series, every: pd.Series) -> pd.Series:
        names, n, _, _ = box.value
        out = []
        for own, some in zip(c_, every):
            a, b = None, np.full(len(some[0]["sums"]), np.inf)
            for e in some:
                s, size = np.asarray(e["sums"], float), n[int(np.searchsorted(names, e["to"]))]
                if e["to"] == own:
                    a, alone = s / max(size - 1, 1), size < 2
                else:
                    b = np.minimum(b, s / size)
            out.append(0.0 if alone or not np.isfinite(b).all() else float(((b - a) / np.maximum(np.maximum(a, b), 1e-300)).sum()))
        return pd.Series(out)

    return tot.select(value("c", "all").alias("v")).agg((F.sum("v") / float(n.sum())).alias("silhouette"))


def validity(df: DataFrame, ids: Sequence[str], dim: int, cluster: str = "cluster", x: str = "x", sample: int | None = None, seed: int = 42) -> DataFrame:
    """CLU04: silhouette, Calinski-Harabasz and Davies-Bouldin of given clusters in one row; with ``sample``, of a seeded sample of that many rows."""
    if sample is not None:
        df = land(pick_first(df, [], random_hex(F.lit(int(seed)), F.to_json(F.struct(*ids))), k=sample))
    cen = mean_vectors(df, [cluster], dim, x)
    all_ = df.agg(F.array(*[F.avg(F.get(x, k)) for k in range(dim)]).alias("_g"), F.count("*").alias("_all"))
    d = df.join(F.broadcast(cen), cluster).withColumn("_d", _dist(x, "centroid"))
    per = d.groupBy(cluster).agg(F.sum(F.col("_d") * F.col("_d")).alias("_w"), F.avg("_d").alias("_s"), F.first("centroid").alias("_c"), F.count("*").alias("_n"))
    one = attach(per, all_, []).withColumn("_b", F.col("_n") * F.pow(_dist("_c", "_g"), F.lit(2)))
    g = one.agg(F.sum("_w").alias("_wth"), F.sum("_b").alias("_btw"), F.count("*").alias("_k"), F.max("_all").alias("_all"), F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("k"), F.col("_s").alias("s"), F.col("_c").alias("c")))).alias("_l"))
    worst = F.transform("_l", lambda a: F.array_max(F.transform(F.filter("_l", lambda b: b["k"] != a["k"]), lambda b: (a["s"] + b["s"]) / F.sqrt(F.aggregate(F.zip_with(a["c"], b["c"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))))
    g = g.select((F.col("_btw") / (F.col("_k") - 1) / (F.col("_wth") / (F.col("_all") - F.col("_k")))).alias("calinski_harabasz"), (a_sum(worst) / F.col("_k")).alias("davies_bouldin"), F.col("_k").alias("n_clusters"), F.col("_all").alias("n_rows"))
    return attach(g, silhouette(df, ids, cluster, x), [])


def contingency_metrics(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """CLU04: mutual information, its normalized form (arithmetic mean), chi-square with p, and Cramer's V."""
    # counts as doubles: products of three counts leave the range of a long from some ten million rows on
    n = df.groupBy(cluster, label).agg(F.count("*").cast("double").alias("o"))
    r, k = n.groupBy(cluster).agg(F.sum("o").alias("_r")), n.groupBy(label).agg(F.sum("o").alias("_c"))
    j = attach(n.join(r, cluster).join(k, label), n.agg(F.sum("o").alias("_all")), [])
    # a cell without rows still adds its expected count to chi-square: sum o2/e - N covers all cells
    g = j.agg(F.sum(F.col("o") / F.col("_all") * F.ln(F.col("o") * F.col("_all") / (F.col("_r") * F.col("_c")))).alias("mutual_info"), (F.sum(F.col("o") * F.col("o") * F.col("_all") / (F.col("_r") * F.col("_c"))) - F.max("_all")).alias("chi2"), F.max("_all").alias("n"))
    h = lambda d, v: attach(d, n.agg(F.sum("o").alias("_all")), []).agg(F.sum(-F.col(v) / F.col("_all") * F.ln(F.col(v) / F.col("_all"))).alias("_h"), F.count("*").alias("_k"))
    g = attach(attach(g, h(r, "_r").select(F.col("_h").alias("_hr"), F.col("_k").alias("_kr")), []), h(k, "_c").select(F.col("_h").alias("_hc"), F.col("_k").alias("_kc")), [])
    dof = (F.col("_kr") - 1) * (F.col("_kc") - 1)
    return g.select(F.col("n").cast("long").alias("n"), "mutual_info", F.coalesce(F.try_divide(F.col("mutual_info"), (F.col("_hr") + F.col("_hc")) / 2), F.lit(1.0)).alias("normalized_mutual_info"), "chi2", dof.alias("dof"), tails.p_chi2(F.col("chi2"), dof).alias("p_value"),
                    F.sqrt(F.greatest("chi2", F.lit(0.0)) / (F.col("n") * F.greatest(F.least(F.col("_kr") - 1, F.col("_kc") - 1), F.lit(1)))).alias("cramers_v"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """CLU03: adjusted Rand index of two labelings."""
    pairs = lambda v: F.sum(F.col(v).cast("double") * (F.col(v) - 1) / 2)
    n = df.groupBy(a, b).agg(F.count("*").alias("o"))
    t = n.agg(pairs("o").alias("_ij"), F.sum("o").alias("_all"))
    ra, rb = n.groupBy(a).agg(F.sum("o").alias("s")).agg(pairs("s").alias("_a")), n.groupBy(b).agg(F.sum("o").alias("s")).agg(pairs("s").alias("_b"))
    g = attach(attach(t, ra, []), rb, [])
    exp = F.col("_a") * F.col("_b") / (F.col("_all").cast("double") * (F.col("_all") - 1) / 2)
    return g.select(F.coalesce(F.try_divide(F.col("_ij") - exp, (F.col("_a") + F.col("_b")) / 2 - exp), F.lit(1.0)).alias("ari"))


# ---- cluster reports ----------------------------------------------------------------------------

def crosstab(df: DataFrame, clusters: Sequence[int], cluster: str = "cluster", normalize: bool = False) -> DataFrame:
    """CLU05: subject x cluster counts, optionally as shares of the row."""
    g = df.groupBy(S).agg(*[F.sum(F.when(F.col(cluster) == k, 1).otherwise(0)).alias(f"cluster_{k}") for k in clusters], F.count("*").alias("n_segments"))
    if normalize:
        for k in clusters:
            g = g.withColumn(f"cluster_{k}", F.col(f"cluster_{k}") / F.col("n_segments"))
    return g


def subject_distribution(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """CLU05: dominant cluster (smallest id on ties), its share, entropy and entropy / ln K with K = all clusters."""
    n = df.groupBy(S, cluster).agg(F.count("*").alias("_n"))
    t = n.groupBy(S).agg(F.sum("_n").alias("n_segments"), F.count("*").alias("n_clusters_present"), F.max_by(cluster, F.struct(F.col("_n"), -F.col(cluster))).alias("dominant_cluster"), F.max("_n").alias("_top"),
                         F.sum(-F.col("_n") * F.ln(F.col("_n").cast("double"))).alias("_h"))
    t = attach(t, n.agg(F.count_distinct(cluster).alias("_kall")), [])
    ent = F.col("_h") / F.col("n_segments") + F.ln(F.col("n_segments").cast("double"))
    return t.select(S, "n_segments", "n_clusters_present", "dominant_cluster", (F.col("_top") / F.col("n_segments")).alias("dominant_share"), ent.alias("entropy"),
                    F.when(F.col("_kall") > 1, ent / F.ln(F.col("_kall").cast("double"))).otherwise(0.0).alias("entropy_norm"))


def _spread_of(n: DataFrame, by: str, total: str = "n_segments") -> DataFrame:
    """Counts (by, other, _n) to size, number present, largest, and normalized entropy over those present."""
    g = n.groupBy(by).agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"), F.max("_n").alias("_top"), F.sum(-F.col("_n") * F.ln(F.col("_n").cast("double"))).alias("_h"))
    ent = F.col("_h") / F.col("_t") + F.ln(F.col("_t").cast("double"))
    return g.withColumn("_e", F.when(F.col("_k") > 1, ent / F.ln(F.col("_k").cast("double"))).otherwise(0.0))


def cluster_summary(df: DataFrame, *, cluster: str = "cluster", label: str = "label", distance: str = "distance", min_size: int = 20, dominated: float = 0.40, low_clean: float = 0.70) -> DataFrame:
    """CLU06: size, subjects, largest subject share, entropies, class enrichment, distance statistics, flags, recommendation."""
    ns = df.groupBy(cluster, S).agg(F.count("*").alias("_n"))
    top = ns.groupBy(cluster).agg(F.max_by(S, F.struct(F.col("_n"), -F.col(S))).alias("top_subject"))
    sub = _spread_of(ns, cluster).select(cluster, F.col("_t").alias("n_segments"), F.col("_k").alias("n_subjects"), (F.col("_top") / F.col("_t")).alias("top_subject_share"), F.col("_e").alias("subject_entropy_norm"))
    nl = df.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    lab = _spread_of(nl, cluster).select(cluster, F.col("_k").alias("n_classes_present"), (F.col("_top") / F.col("_t")).alias("majority_label_share"), F.col("_e").alias("class_entropy_norm"), F.col("_t").alias("_t"))
    gl = attach(nl.groupBy(label).agg(F.sum("_n").alias("_g")), nl.agg(F.sum("_n").alias("_gall")), [])
    e = nl.join(lab.select(cluster, "_t"), cluster).join(gl, label).withColumn("_e", (F.col("_n") / F.col("_t")) / (F.col("_g") / F.col("_gall") + 1e-12))
    enr = e.groupBy(cluster).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("majority_label"), F.max_by(label, F.struct(F.col("_e"), -F.col(label))).alias("enriched_label"), F.max("_e").alias("max_class_enrichment"))
    st = df.groupBy(cluster).agg(F.avg(F.col("keep_clean").cast("double")).alias("clean_ratio"), F.avg(distance).alias("distance_mean"), F.stddev_pop(distance).alias("distance_std"), F.max(distance).alias("distance_max"))
    q = quantiles(df, [cluster], distance, {"distance_median": 0.5, "distance_p90": 0.9})
    r = sub.join(top, cluster).join(lab.drop("_t"), cluster).join(enr, cluster).join(st, cluster).join(q, cluster)
    cut = quantiles(st, [], "distance_mean", {"_a": 0.25, "_b": 0.75})
    r = attach(r, cut, []).withColumn("_far", F.col("_b") + 1.5 * (F.col("_b") - F.col("_a")))
    r = (r.withColumn("flag_tiny", F.col("n_segments") < min_size).withColumn("flag_dominated", F.col("top_subject_share") >= dominated)
         .withColumn("flag_low_diversity", F.col("subject_entropy_norm") < 0.5).withColumn("flag_low_clean", F.col("clean_ratio") < low_clean).withColumn("flag_far", F.col("distance_mean") > F.col("_far"))
         .withColumn("flag_class_pure", (F.col("majority_label_share") >= 0.8) & (F.col("flag_dominated") | (F.col("n_subjects") < 5))))
    rec = (F.when(F.col("flag_low_clean") | F.col("flag_far") | F.col("flag_tiny"), "exclude_or_inspect_as_noise").when(F.col("flag_dominated") | F.col("flag_low_diversity"), "inspect_subject_fingerprint")
           .when(F.col("majority_label_share") >= 0.7, "possible_disease_or_confound_cluster").otherwise("useful_common_state_cluster"))
    return r.withColumn("recommendation", rec).drop("_a", "_b", "_far")


def representatives(df: DataFrame, *, cluster: str = "cluster", distance: str = "distance", score: str = "score") -> DataFrame:
    """CLU07: closest, farthest and cleanest window per cluster."""
    key = F.struct(F.col(S), F.col(SEG))
    low = lambda v: F.struct(v, F.col(S), F.col(SEG))
    g = df.groupBy(cluster).agg(F.min_by(key, low(F.col(distance))).alias("closest_to_centroid"), F.min_by(key, low(-F.col(distance))).alias("farthest_from_centroid"), F.min_by(key, low(-F.col(score))).alias("highest_score"))
    return g.unpivot([cluster], ["closest_to_centroid", "farthest_from_centroid", "highest_score"], "rep_type", "r").select(cluster, "rep_type", f"r.{S}", f"r.{SEG}")


def nearest_per_prototype(df: DataFrame, n: int, *, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """CLU07: the n nearest windows per prototype with rank."""
    return pick_first(df, [cluster], F.col(distance), F.col(S), F.col(SEG), k=n, rank="rank")


# ---- all pairs ----------------------------------------------------------------------------------

def pair_distances(df: DataFrame, ids: Sequence[str] = ("vec_id",), *, label: str = "label", x: str = "x", block: int = 2048) -> DataFrame:
    """CLU09: mean and population std of Euclidean distances over pairs of one subject, one class across subjects, two classes."""

    @F.pandas_udf("array<double>")
    def sums(m: pd.Series, s: pd.Series, y: pd.Series, o: pd.Series, t: pd.Series, z: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for a, s1, y1, b, s2, y2, diag in zip(m, s, y, o, t, z, same):
            d = _dense_dist(K.matrix(a), K.matrix(b))
            one = np.asarray(s1)[:, None] == np.asarray(s2)[None]
            cls = np.asarray(y1)[:, None] == np.asarray(y2)[None]
            use = np.triu(np.ones(d.shape, bool), 1) if diag else np.ones(d.shape, bool)
            row = []
            for mask in (one & use, ~one & cls & use, ~one & ~cls & use):
                v = d[mask]
                row += [float(len(v)), v.sum(), (v**2).sum()]
            out.append(row)
        return pd.Series(out)

    p = _block_pairs(_blocks(df, ids, [S, label], x, block), ["m", S, label])
    p = p.select(sums("l_m", f"l_{S}", f"l_{label}", "r_m", f"r_{S}", f"r_{label}", F.col("b") == F.col("o")).alias("sums"))
    t = B.sum_arrays(p, [], "sums")
    rows = F.array(*[F.struct(F.lit(n).alias("kind"), F.get("sums", 3 * k).alias("n"), F.get("sums", 3 * k + 1).alias("s"), F.get("sums", 3 * k + 2).alias("q")) for k, n in enumerate(["same_subject", "same_class_other_subject", "diff_class"])])
    e = t.select(F.explode(rows).alias("e")).select("e.*")
    mean = F.try_divide("s", "n")
    return e.select("kind", F.col("n").cast("long").alias("n_pairs"), mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("std"))


def sampled_pair_distances(df: DataFrame, n_pairs: int, seed: int = 42, *, id_col: str = "vec_id", label: str = "label", x: str = "x") -> DataFrame:
    """CLU09, sampled form: a seeded draw of ``n_pairs`` pairs of places in the numbered table."""
    from ..functions.exprs import random_below

    at = positions(df.select(id_col, S, label, x), [], [id_col], "_p")
    n = df.agg(F.count("*").alias("_all"))
    d = attach(df.sparkSession.range(n_pairs).withColumnRenamed("id", "pair"), n, [])
    d = d.withColumn("_i", random_below("_all", F.lit(seed), F.lit("i"), "pair")).withColumn("_j", random_below(F.col("_all") - 1, F.lit(seed), F.lit("j"), "pair"))
    d = d.withColumn("_j", F.when(F.col("_j") >= F.col("_i"), F.col("_j") + 1).otherwise(F.col("_j")))
    a = at.select(F.col("_p").alias("_i"), F.col(S).alias("s1"), F.col(label).alias("y1"), F.col(x).alias("x1"))
    b = at.select(F.col("_p").alias("_j"), F.col(S).alias("s2"), F.col(label).alias("y2"), F.col(x).alias("x2"))
    j = d.join(a, "_i").join(b, "_j")
    kind = F.when(F.col("s1") == F.col("s2"), "same_subject").when(F.col("y1") == F.col("y2"), "same_class_other_subject").otherwise("diff_class")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_pairs"), F.avg(_dist("x1", "x2")).alias("mean"), F.stddev_pop(_dist("x1", "x2")).alias("std"))


def _shells(df: DataFrame, id_col: str, extra: Sequence[str], x: str, block: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Blocks (cell, b, low, high, m, columns as arrays) of rows near each other, and the cells' centres.

    Centres are the 4 sqrt(n / block) rows with the smallest keyed hash; a row belongs to the nearest one. The rows of a cell are cut into blocks in
    the order of their distance to the centre, so a block is a shell between the distances low and high.
    """
    n = df.count()
    cells = max(1, math.ceil(4 * math.sqrt(n / block))) if n > block else 1
    picked = pick_first(df, [], random_hex(F.lit(seed), F.col(id_col)), k=cells).select(x).collect()  # sqrt(n / block) vectors
    centre = np.array([r[0] for r in picked], float)
    box = df.sparkSession.sparkContext.broadcast(centre)

    @F.pandas_udf("struct<cell:long,far:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        d = _dense_dist(K.matrix(v), box.value)
        at = d.argmin(1)
        return pd.DataFrame({"cell": at, "far": d[np.arange(len(d)), at]})

    placed = df.select(id_col, *extra, F.col(x).alias("x"), place(x).alias("p")).select("*", "p.cell", "p.far").drop("p")
    b = positions(placed, ["cell"], ["far", id_col], "_at").withColumn("b", F.floor(F.col("_at") / block))
    row = F.sort_array(F.collect_list(F.struct(F.col(id_col).cast("long").alias(id_col), *[F.col(e).cast("long").alias(e) for e in extra], "x")))
    g = b.groupBy("cell", "b").agg(F.min("far").alias("low"), F.max("far").alias("high"), row.alias("_r"))
    return land(g.select("cell", "b", "low", "high", F.col("_r.x").alias("m"), *[F.col(f"_r.{e}").alias(e) for e in (id_col, *extra)])), centre


def _top_of(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest entries of each row, smallest first, the first of equal ones first."""
    if d.shape[1] > 4 * k:
        cut = np.partition(d, k - 1, axis=1)[:, k - 1]
        out = np.full((len(d), k), -1)
        for r in range(len(d)):
            some = np.flatnonzero(d[r] <= cut[r])
            out[r] = some[np.argsort(d[r, some], kind="stable")[:k]]
        return out
    return np.argsort(d, axis=1, kind="stable")[:, :k]


_GROUP = 32  # blocks at most that are compared with as many others in one task


def nearest(df: DataFrame, k: int, id_col: str = "vec_id", *, label: str = "label", x: str = "x", block: int = 2048, metric: str = "euclidean", other_subject: bool = False, seed: int = 42,
            visits: list | None = None) -> DataFrame:
    """The k nearest rows of every row: (id, subject, label, rank, other, other subject, other label), exact; ties to the smaller id.

    Rows are packed into shells around cell centres. A block's own rows give each row a first bound on its k-th distance. By the triangle
    inequality a row within that bound of a row q lies in a shell whose distances to the centre are within the bound of q's distance to it; so a block meets
    only the shells that one of its rows could need. These pairs are found by joining intervals with the table of shells, before
    any vector moves. Up to 32 blocks form a group, and a group meets a group in one task: so a block moves once per group that it needs, not once per
    block, and returns the k nearest found there, not k per visit. Rows in tight groups visit few blocks; rows without groups, or many equal
    rows, visit nearly all, which is the square of the number of rows. ``visits`` receives (block pairs visited, all block pairs).
    """
    u = df if metric == "euclidean" else df.withColumn(x, a_unit(x))
    if u.isEmpty():
        return df.sparkSession.createDataFrame([], "id bigint, s bigint, y bigint, o bigint, t bigint, z bigint, d double, rank int")
    bl, centre = _shells(u, id_col, [S, label], x, block, seed)
    box = df.sparkSession.sparkContext.broadcast(centre)

    def compare(p, i1, s1, q, i2, s2):
        d = _dense_dist(p, q) if metric == "euclidean" else -(p @ q.T)
        d[(s1[:, None] == s2[None]) if other_subject else (i1[:, None] == i2[None])] = np.inf
        return d

    def slack(p):
        return 1e-6 * (1 + np.linalg.norm(p, axis=1))

    @F.pandas_udf("struct<bound:array<double>,low:array<double>,high:array<double>>")
    def bounds(m: pd.Series, i: pd.Series, s: pd.Series) -> pd.DataFrame:
        """Per row its bound; per cell the distances to its centre between which a row could be needed."""
        out = []
        for a, i1, s1 in zip(m, i, s):
            i1, s1 = np.asarray(i1), np.asarray(s1)
            p = K.matrix(a)
            d = compare(p, i1, s1, p, i1, s1)
            bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(p), np.inf)
            # a cosine of unit (or zero) vectors is at least c where their distance is at most sqrt(|q|^2 + 1 - 2 c)
            reach = bound if metric == "euclidean" else np.sqrt(np.maximum((p**2).sum(1) + 1 + 2 * bound, 0))
            far, reach = _dense_dist(p, box.value), (reach + slack(p))[:, None]
            out.append({"bound": bound.tolist(), "low": (far - reach).min(0).tolist(), "high": (far + reach).max(0).tolist()})
        return pd.DataFrame(out)

    def cells(t: pa.Table, r: int, m: str, names: Sequence[str]) -> list[np.ndarray]:
        m = t.column(m)[r].values
        return [m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1), *[t.column(v)[r].values.to_numpy(zero_copy_only=False) for v in names]]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest of each row of the left blocks in the right blocks that they need."""
        spot = {no: r for r, no in enumerate(right.column("at").to_pylist())}
        out = []
        for r in range(left.num_rows):
            p, i1, s1, y1, most = cells(left, r, "m", [id_col, S, label, "bound"])
            most, best = most + slack(p), None
            for no in left.column("wants")[r].as_py():
                q, i2, s2, y2 = cells(right, spot[no], "r_m", [f"r_{v}" for v in (id_col, S, label)])
                d = compare(p, i1, s1, q, i2, s2)
                d[d > most[:, None]] = np.inf
                # i2 is sorted, so the first of equal ones has the smaller id
                at = _top_of(d, min(k, d.shape[1]))
                some = [np.take_along_axis(d, at, 1), i2[at], s2[at], y2[at]]
                if best is not None:
                    some = [np.concatenate(v, 1) for v in zip(best, some)]
                    first = np.lexsort((some[1], some[0]), axis=1)[:, :k]
                    some = [np.take_along_axis(v, first, 1) for v in some]
                best = some
                if best[0].shape[1] == k:
                    most = np.minimum(most, best[0][:, -1])
            row, col = np.nonzero(np.isfinite(best[0]))
            out.append([i1[row], s1[row], y1[row], *[v[row, col] for v in (best[1], best[2], best[3], best[0])]])
        return pa.table({n: np.concatenate([v[c_] for v in out]) for c_, n in enumerate("id s y o t z d".split())})

    numbers = land(bl.select("cell", "b").withColumn("no", (F.row_number().over(over([], "cell", "b")) - 1).cast("long")))  # one row per block
    n_blocks = numbers.count()
    wide = max(1, min(_GROUP, math.ceil(math.sqrt(n_blocks))))
    group = lambda v: F.floor(F.col(v) / wide)
    bl = bl.join(numbers, ["cell", "b"])
    asks = land(bl.select(F.col("no").alias("me"), "m", id_col, S, label, bounds("m", id_col, S).alias("q")))
    needs = asks.select("me", F.posexplode(F.arrays_zip("q.low", "q.high")).alias("to", "z")).select("me", "to", "z.low", "z.high")
    shell = bl.select(F.col("cell").alias("to"), F.col("no").alias("at"), F.col("low").alias("from_"), F.col("high").alias("upto"))
    pairs = land(needs.join(shell, "to").filter("from_ <= high and upto >= low").select("me", "at"))
    if visits is not None:
        visits.append((pairs.count(), n_blocks**2))
    vectors = asks.select("me", "m", id_col, S, label, F.col("q.bound").alias("bound"))
    left = pairs.groupBy("me", group("at").alias("gr")).agg(F.collect_list("at").alias("wants")).join(vectors, "me").withColumn("gl", group("me"))
    right = pairs.select(group("me").alias("gl"), "at").distinct().join(
        asks.select(F.col("me").alias("at"), *[F.col(v).alias(f"r_{v}") for v in ("m", id_col, S, label)]), "at").withColumn("gr", group("at"))
    # a fixed number of partitions, so that small but costly groups are not packed into few tasks
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (v.repartition(width, "gl", "gr") for v in (left, right))
    e = left.groupBy("gl", "gr").cogroup(right.groupBy("gl", "gr")).applyInArrow(meet, "id bigint, s bigint, y bigint, o bigint, t bigint, z bigint, d double")
    return pick_first(e, ["id"], F.col("d"), F.col("o"), k=k, rank="rank")


def knn_purity(df: DataFrame, k: int = 10, id_col: str = "vec_id", **kw) -> DataFrame:
    """CLU10: share of the k nearest with the same class, and the same subject: mean and population std over rows."""
    n = nearest(df, k, id_col, **kw).groupBy("id").agg(F.avg((F.col("y") == F.col("z")).cast("double")).alias("c"), F.avg((F.col("s") == F.col("t")).cast("double")).alias("s"))
    return n.agg(F.avg("c").alias("knn_class_purity_mean"), F.avg("s").alias("knn_subject_purity_mean"), F.stddev_pop("c").alias("knn_class_purity_std"), F.stddev_pop("s").alias("knn_subject_purity_std"))


def fingerprint(df: DataFrame, dim: int, id_col: str = "vec_id", label: str = "label", x: str = "x") -> DataFrame:
    """CLU11: mean cosine to the same subject, the same class elsewhere and other classes, and nearest-neighbour retrieval.

    A mean cosine of a row to a group is a product with the group's summed unit vectors, so means need no pairs; only the two
    nearest-neighbour rates use block products.
    """
    u = df.select(id_col, S, label, a_unit(x).alias("u"))
    def tot(by, n):
        return u.groupBy(*by).agg(F.array(*[F.sum(F.get("u", k)) for k in range(dim)]).alias(f"_v{n}"), F.count("*").alias(f"_n{n}"))
    j = attach(u.join(tot([S], "s"), S).join(tot([label], "y"), label).join(tot([S, label], "b"), [S, label]), tot([], "a"), [])
    same = F.try_divide(a_dot("u", "_vs") - a_dot("u", "u"), F.nullif(F.col("_ns") - 1, F.lit(0)))
    cls = F.try_divide(a_dot("u", "_vy") - a_dot("u", "_vb"), F.nullif(F.col("_ny") - F.col("_nb"), F.lit(0)))
    diff = F.try_divide(a_dot("u", "_va") - a_dot("u", "_vy"), F.nullif(F.col("_na") - F.col("_ny"), F.lit(0)))
    means = j.agg(F.avg(same).alias("mean_cosine_same_subject"), F.avg(cls).alias("mean_cosine_same_class_other_subject"), F.avg(diff).alias("mean_cosine_diff_class"))
    n1 = nearest(df, 1, id_col, label=label, x=x, metric="cosine").agg(F.avg((F.col("s") == F.col("t")).cast("double")).alias("top1_same_subject_retrieval"))
    n2 = nearest(df, 1, id_col, label=label, x=x, metric="cosine", other_subject=True).agg(F.avg((F.col("y") == F.col("z")).cast("double")).alias("top1_same_class_other_subject_retrieval"))
    return attach(attach(means, n1, []), n2, [])


# ---- centroids ----------------------------------------------------------------------------------

def heterogeneity(df: DataFrame, dim: int, x: str = "x") -> DataFrame:
    """CLU12: mean and population std of the distance to the subject's centroid."""
    d = df.join(mean_vectors(df, [S], dim, x), S).withColumn("_d", _dist(x, "centroid"))
    return d.groupBy(S).agg(F.count("*").alias("n_segments"), F.avg("_d").alias("within_subject_mean_dist"), F.stddev_pop("_d").alias("within_subject_std_dist"))


def nearest_class(df: DataFrame, dim: int, label: str = "label", x: str = "x") -> DataFrame:
    """CLU13: nearest class centroid (smaller label on ties) and whether it is the row's class. Centroids are one small row."""
    cen = mean_vectors(df, [label], dim, x).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("y"), "centroid"))).alias("_c"))
    d = F.array_min(F.transform("_c", lambda k: F.struct(F.sqrt(F.aggregate(F.zip_with(F.col(x), k["centroid"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)).alias("d"), k["y"].alias("y"))))
    return attach(df, cen, []).withColumn("nearest_class", d["y"]).withColumn("matches", F.col("nearest_class") == F.col(label)).drop("_c")


def scatter_ratio(df: DataFrame, dim: int, label: str = "label", x: str = "x") -> DataFrame:
    """CLU04: between-class over within-class scatter."""
    cen = mean_vectors(df, [label], dim, x)
    all_ = df.agg(F.array(*[F.avg(F.get(x, k)) for k in range(dim)]).alias("_g"))
    b = attach(cen, all_, []).agg(F.sum(F.col("n") * F.pow(_dist("centroid", "_g"), F.lit(2))).alias("between"))
    w = df.join(cen, label).agg(F.sum(F.pow(_dist(x, "centroid"), F.lit(2))).alias("within"))
    return attach(b, w, []).withColumn("ratio", F.try_divide("between", "within"))


def align_folds(train: DataFrame, test: DataFrame, reference: int, dim: int, min_anchors: int = 3) -> DataFrame:
    """CLU14: rotate each fold's test embeddings onto the reference fold by orthogonal Procrustes on shared training subjects.

    Cross products are summed over blocks per fold and solved in a task; the d x d rotation joins the test rows of its fold.
    """
    ref = train.filter(F.col("fold") == reference).select(S, F.col("x").alias("_t"))
    both = train.filter(F.col("fold") != reference).join(ref, S).select("fold", S, F.concat("x", "_t").alias("x"))
    mom = B.moments(B.pack(both, ["fold"], [S]), ["fold"])

    @F.pandas_udf("array<double>")
    def rotation(p: pd.Series) -> pd.Series:
        out = []
        for v in p:
            n, mu, second = B._split(np.asarray(v, float))
            if n < min_anchors:
                raise ValueError(f"a fold shares only {int(n)} training subjects with the reference fold")
            cross = second[:dim, dim:] - np.outer(mu[:dim], mu[dim:])
            u, _, vt = np.linalg.svd(cross)
            out.append(np.concatenate([mu, (u @ vt).ravel()]))
        return pd.Series(out)

    model = mom.select("fold", rotation("moments").alias("model"))
    tb = B.pack(test, ["fold"], [S])

    def fn(m, p):
        if p.size == 0:
            return m.tolist()
        return ((m - p[:dim]) @ p[2 * dim:].reshape(dim, dim) + p[dim:2 * dim]).tolist()

    j = tb.join(model, "fold", "left").withColumn("model", F.coalesce("model", F.array().cast("array<double>")))
    return B.unpack(j.withColumn("aligned", B._per_block(fn, "array<array<double>>")("m", "model")), ["fold"], ["aligned"])


def explained_variance(df: DataFrame, dims: int, ids: Sequence[str], x: str = "x") -> DataFrame:
    """CLU15: explained share per component and cumulative."""
    return B.explained(B.pca_models(B.pack(df, [], ids, x), [], dims), [], dims)


def scores_2d(df: DataFrame, ids: Sequence[str], x: str = "x") -> DataFrame:
    """CLU15: first two component scores."""
    b = B.pack(df, [], ids, x)
    return B.unpack(B.project(b, B.pca_models(b, [], 2), [], 2), [], ["m"]).withColumn("pc1", F.get("m", 0)).withColumn("pc2", F.get("m", 1)).drop("m")


# ---- probes -------------------------------------------------------------------------------------

def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Row weights N / (C n_c)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    t = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_cls"))
    return df.join(F.broadcast(attach(n, t, []).select(label, (F.col("_all") / (F.col("_cls") * F.col("_n"))).alias("weight"))), label)


def linear_probe(train: DataFrame, test: DataFrame, label: str = "label", x: str = "x", balanced: bool = False, max_iter: int = 100, converge: bool = False) -> DataFrame:
    """CLU16: logistic regression on embeddings; test rows with pred_label and prob. With ``converge`` a fit that ``max_iter`` cuts off raises."""
    tr = (balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))).withColumn("features", array_to_vector(x)).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="weight", maxIter=max_iter, regParam=1e-3, standardization=True).fit(tr)
    if converge and model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the probe did not converge in {max_iter} iterations")
    t = model.transform(test.withColumn("features", array_to_vector(x)))
    return t.select(*test.columns, F.col("prediction").cast("long").alias("pred_label"), vector_to_array("probability").alias("prob"))


def probe_metrics(pred: DataFrame, label: str = "label") -> DataFrame:
    return ev.summary_rates(ev.confusion(pred, true=label))


def forest_votes(forest: forests.Forest, held: DataFrame, *, label: str = "label", x: str = "x") -> tuple[DataFrame, DataFrame, DataFrame]:
    """CLU17: window predictions and subject votes of the rows ``held`` out (with ``split``) for every seed of a forest, and rates
    per seed and split: of windows as ``val_segment``, of subjects as ``val``."""
    keys = ["seed", "split", S]
    p = forests.predict(forest, held, [k for k in held.columns if k != x], x)
    windows = land(p.withColumn("true_label", F.col(label)).withColumn("pred_label", argmax_first("prob").cast("long")))
    subjects = land(ev.soft_vote(windows, forest.classes, keys))
    named = windows.select("seed", F.concat("split", F.lit("_segment")).alias("split"), "true_label", "pred_label").unionByName(subjects.select("seed", "split", "true_label", "pred_label"))
    return windows, subjects, ev.summary_rates(ev.confusion(named, keys=keys[:2]), keys[:2])


def forest_runs(train: DataFrame, held: DataFrame, n_classes: int, seeds: Sequence[int] = (15, 42, 100), *, label: str = "label", trees: int = 300, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CLU17: random forests of ``trees`` trees for each seed, all grown together, and ``forest_votes`` of the rows held out."""
    return forest_votes(forests.grow_forest(train, n_classes, seeds, trees=trees, label=label, **kw), held, label=label)


COMBINED_WEIGHTS = [
    ("probe_macro_f1_mean", 2.0), ("probe_bal_acc_mean", 1.5), ("knn_class_purity_mean", 1.0), ("segment_centroid_match_rate", 1.0), ("subject_centroid_match_rate", 0.8),
    ("bw_scatter_ratio_segments", 0.8), ("bw_scatter_ratio_subjects", 0.8), ("knn_subject_purity_mean", -0.8), ("probe_macro_f1_std", -0.5), ("probe_bal_acc_std", -0.3)]  # fixed values


def combined_score(metrics: DataFrame) -> DataFrame:
    """CLU18: fixed weights over ten metrics; a missing metric counts 0."""
    s = F.lit(0.0)
    for name, w in COMBINED_WEIGHTS:
        if name in metrics.columns:
            s = s + w * F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return metrics.withColumn("combined_score", s)


def feature_metrics(vectors: DataFrame, dim: int, n_folds: int = 5, max_iter: int = 8000) -> DataFrame:
    """CLU18: the ten metrics of ``combined_score`` of one set of vectors (vec_id, subject_id, label, x), as one row.

    The probe reads subject centroids, fold by fold, to convergence; its std over folds is that of the population.
    """
    cen = land(mean_vectors(vectors, [S, "label"], dim, name="x"))
    folds = land(stratified_folds(cen.select(S, "label"), n_folds).select("fold", S, (F.col("role") == "test").alias("_test")))
    pred = None
    for fold in range(n_folds):
        r = land(cen.join(folds.filter(F.col("fold") == fold), S))
        p = linear_probe(r.filter("not _test"), r.filter("_test"), balanced=True, max_iter=max_iter, converge=True).select("fold", F.col("label").alias("true_label"), "pred_label")
        pred = p if pred is None else pred.unionByName(p)
    out = ev.summary_rates(ev.confusion(pred, keys=["fold"]), ["fold"]).agg(
        F.avg("macro_f1").alias("probe_macro_f1_mean"), F.stddev_pop("macro_f1").alias("probe_macro_f1_std"),
        F.avg("balanced_accuracy").alias("probe_bal_acc_mean"), F.stddev_pop("balanced_accuracy").alias("probe_bal_acc_std"))
    return attach(out, geometry_metrics(vectors, dim), [])


def geometry_metrics(vectors: DataFrame, dim: int) -> DataFrame:
    """CLU18: the six of the ten metrics that read the vectors alone: neighbour purities, and match rates and scatter ratios of windows and subject centroids."""
    out = knn_purity(vectors).select("knn_class_purity_mean", "knn_subject_purity_mean")
    for name, v in (("segment", vectors), ("subject", land(mean_vectors(vectors, [S, "label"], dim, name="x")))):
        out = attach(out, nearest_class(v, dim).agg(F.avg(F.col("matches").cast("int")).alias(f"{name}_centroid_match_rate")), [])
        out = attach(out, scatter_ratio(v, dim).select(F.col("ratio").alias(f"bw_scatter_ratio_{name}s")), [])
    return out


def worthiness_report(vectors: dict[str, DataFrame], folds: DataFrame, stability: DataFrame, n_folds: int, max_iter: int = 8000) -> DataFrame:
    """CLU19: per fold and representation, subject-level rates of a balanced linear probe, with the stability of the graphs.
    A probe that does not converge raises.

    ``vectors`` maps a representation (node flat, node mean, edge, combined) to rows (subject_id, label, x)."""
    out = None
    for fold in range(n_folds):
        role = folds.filter(F.col("fold") == fold).select(S, "role")
        for name, v in vectors.items():
            r = land(v.join(role, S))
            p = linear_probe(r.filter("role = 'train'"), r.filter("role = 'test'"), balanced=True, max_iter=max_iter, converge=True)
            voted = ev.soft_vote(p.withColumnRenamed("label", "true_label"), 3, [S])
            m = ev.summary_rates(ev.confusion(voted)).select(F.lit(fold).alias("fold"), F.lit(name).alias("representation"), "accuracy", "macro_f1", "n_samples")
            out = m if out is None else out.unionByName(m)
    return attach(out, stability, [])


def segment_vectors(summary: DataFrame, graphs: DataFrame, mode: str = "summary_only", target_nodes: int = 23) -> DataFrame:
    """CLU20: graph summary alone, after flat node features, or after node features padded with zeros (or cut) to a node count."""
    if mode == "summary_only":
        return summary.select("graph_id", F.col("summary").alias("x"))
    j = graphs.select("graph_id", "nodes").join(summary, "graph_id")
    nodes = F.col("nodes")
    if mode == "padded":
        zero = F.transform(F.get("nodes", 0), lambda v: F.lit(0.0))
        nodes = F.slice(F.concat("nodes", F.array_repeat(zero, target_nodes)), 1, target_nodes)
    return j.select("graph_id", F.concat(F.flatten(nodes), "summary").alias("x"))

