"""Construction, fusion and statistics of many small graphs.

An edge table holds (graph.., i < j, w), a node table (graph.., node, feature, x) and a graph table one row per
graph with ``nodes`` as an array of feature arrays. A graph has tens of nodes, so partitions by graph are
small; scale comes from the number of graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_dot, a_mean, c, over, pick_first, random_hex
from . import kernels as K
from .connectivity import feature_similarity, mirror
from .landing import land
from .ordered import attach, positions, quantiles

G = ("graph_id",)


# ---- topologies ---------------------------------------------------------------------------------

def undirected_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct i < j pairs."""
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).filter("i <> j").distinct()


def fixed_topology(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """GRA01: edges on a fixed list of channel pairs (complete when there is no list)."""
    return edges if pairs is None else edges.join(undirected_pairs(pairs), ["i", "j"], "left_semi").select(edges.columns)


def with_self_loops(edges: DataFrame, graphs: DataFrame, n_nodes, graph: Sequence[str] = G, w: str = "w", value: float = 1.0) -> DataFrame:
    loop = graphs.select(*graph, F.explode(F.sequence(F.lit(0), c(n_nodes) - 1 if not isinstance(n_nodes, int) else F.lit(n_nodes - 1))).alias("i"))
    return edges.select(*graph, "i", "j", w).unionByName(loop.select(*graph, "i", F.col("i").alias("j"), F.lit(value).alias(w)))


def threshold_topology(edges: DataFrame, threshold: float, *, absolute: bool = True, w: str = "w") -> DataFrame:
    """GRA02: edges at or above the threshold."""
    return edges.filter((F.abs(w) if absolute else F.col(w)) >= threshold)


def topk_per_node(edges: DataFrame, k: int, *, absolute: bool = True, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA03: an edge stays if either end has it among its k largest; ties go to the smaller neighbour."""
    key = F.abs(w) if absolute else F.col(w)
    picked = pick_first(mirror(edges), [*graph, "i"], key.desc(), F.col("j"), k=k)
    rest = [x for x in edges.columns if x not in (*graph, "i", "j")]
    return picked.groupBy(*graph, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        *[F.max(x).alias(x) for x in rest]).select(edges.columns)


def _per_graph(edges: DataFrame, graph: Sequence[str], w: str, fn, extra: str = "") -> DataFrame:
    """Edges kept by ``fn(i, j, w) -> mask`` on whole graphs, in Arrow batches of many graphs."""

    @F.pandas_udf("array<boolean>")
    def run(i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([fn(np.asarray(a), np.asarray(b), np.asarray(d, float)) for a, b, d in zip(i, j, v)])

    rest = [x for x in edges.columns if x not in (*graph, "i", "j", w)]
    g = edges.groupBy(*graph).agg(F.sort_array(F.collect_list(F.struct("i", "j", F.col(w).alias("w"), *rest))).alias("_e"))
    g = g.withColumn("_k", run(F.col("_e.i"), F.col("_e.j"), F.col("_e.w")))
    z = g.select(*graph, F.explode_outer(F.arrays_zip("_e", "_k")).alias("z")).filter("z._k")
    return z.select(*graph, F.col("z._e.i").alias("i"), F.col("z._e.j").alias("j"), F.col("z._e.w").alias(w),
                    *[F.col(f"z._e.{r}").alias(r) for r in rest]).select(edges.columns)


def _tree_mask(i, j, key) -> np.ndarray:
    """Joined components over edges in descending key order (stable)."""
    ids = {n: k for k, n in enumerate(sorted(set(i.tolist()) | set(j.tolist())))}
    comp = list(range(len(ids)))
    keep = np.zeros(len(i), bool)
    for e in np.argsort(-key, kind="stable"):
        a, b = comp[ids[i[e]]], comp[ids[j[e]]]
        if a != b:
            keep[e] = True
            comp = [a if x == b else x for x in comp]
    return keep


def _top_share(key: np.ndarray, share: float | None) -> np.ndarray:
    """Mask of the max(1, ceil(m share)) (or that many, when above 1) largest entries."""
    m = len(key)
    if share is None:
        return np.ones(m, bool)
    keep = int(np.ceil(m * share)) if 0 < share <= 1 else int(share)
    mask = np.zeros(m, bool)
    mask[np.argsort(-key, kind="stable")[:max(1, min(m, keep))]] = True
    return mask


def spanning_tree(edges: DataFrame, mode: str = "maximum", *, top_percent: float | None = None, keep_top: bool = False,
                  graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA04: spanning tree; ``top_percent`` first keeps the strongest share by |w| and falls back to all edges if that
    disconnects the graph; ``keep_top`` adds that share to the tree of the whole graph instead."""
    sign = 1.0 if mode == "maximum" else -1.0

    def fn(i, j, v):
        if top_percent is None:
            return _tree_mask(i, j, sign * v)
        top = _top_share(np.abs(v), top_percent)
        if keep_top:
            return _tree_mask(i, j, sign * v) | top
        out = np.zeros(len(v), bool)
        n = len(set(i.tolist()) | set(j.tolist()))
        out[top] = _tree_mask(i[top], j[top], sign * v[top])
        return out if out.sum() == n - 1 else _tree_mask(i, j, sign * v)

    return _per_graph(edges, graph, w, fn)


def top_edges(edges: DataFrame, *, k: int | None = None, share: float | None = None, absolute: bool = True,
              graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA05: the k, or max(1, ceil(m share)), largest edges of each graph; ties by (i, j)."""
    key = F.abs(w) if absolute else F.col(w)
    r = edges.withColumn("_r", F.row_number().over(over(list(graph), key.desc(), F.col("i"), F.col("j"))))
    lim = F.lit(k) if k is not None else F.greatest(F.lit(1), F.ceil(F.count("*").over(over(list(graph))) * F.lit(share)))
    return r.withColumn("_m", lim).filter("_r <= _m").drop("_r", "_m")


def reconnect_isolates(edges: DataFrame, share: float | None = None, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA06: the strongest share, then each node without an edge gets its strongest one, in node order."""

    def fn(i, j, v):
        keep = _top_share(np.abs(v), share)
        nodes = sorted(set(i.tolist()) | set(j.tolist()))
        deg = {n: int(((i == n) | (j == n))[keep].sum()) for n in nodes}
        for n in nodes:
            if deg[n] == 0:
                mine = np.flatnonzero((i == n) | (j == n))
                e = mine[np.argmax(np.abs(v[mine]))]
                keep[e] = True
                deg[int(i[e])] += 1
                deg[int(j[e])] += 1
        return keep

    return _per_graph(edges, graph, w, fn)


def edge_filter(edges: DataFrame, method: str, *, fixed: DataFrame | None = None, k: int | None = None, share: float | None = None,
                flavor: str = "tree", coords: DataFrame | None = None, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA07: named edge filters. Flavor 'tree': mst, fixed, topk (per node), reconnect (GRA06), combined = mst + fixed,
    overlap = mst & fixed, euclidean_knn. Flavor 'global': full, mst, fixed, topk (global, signed), reconnect = fixed + mst,
    combined = fixed + topk, overlap = fixed & topk."""
    key = [*graph, "i", "j"]
    both = lambda a, b: a.unionByName(b).dropDuplicates(key)
    common = lambda a, b: a.join(b.select(*key), key, "left_semi").select(edges.columns)
    kw = {"graph": graph, "w": w}
    m = method.lower()
    if m in ("full", "none", "all", "dense"):
        return edges
    if m == "mst":
        return spanning_tree(edges, top_percent=share if flavor == "tree" else None, **kw)
    if m == "fixed":
        return fixed_topology(edges, fixed)
    if m == "topk" and flavor == "tree":
        return topk_per_node(edges, k, **kw)
    if m == "euclidean_knn":
        return fixed_topology(edges, spatial_pairs(coords, "knn", k=k))
    if m == "topk":
        return top_edges(edges, k=k, share=share, absolute=False, **kw)
    if m == "reconnect" and flavor == "tree":
        return reconnect_isolates(edges, share, **kw)
    if m == "reconnect":
        return both(fixed_topology(edges, fixed), spanning_tree(edges, **kw))
    part = spanning_tree(edges, top_percent=share, **kw) if flavor == "tree" else top_edges(edges, k=k, share=share, absolute=False, **kw)
    if m == "combined":
        return both(part, fixed_topology(edges, fixed))
    if m == "overlap":
        return common(part, fixed_topology(edges, fixed))
    raise ValueError(f"unknown edge filter {method!r}")


def spatial_pairs(coords: DataFrame, method: str = "knn", *, k: int = 3, radius: float | None = None, weight: str = "inverse",
                  sigma: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """GRA08: neighbours of positions (group.., node, x, y, z) by distance, weighted 1 / (d + 1e-8) or by a Gaussian.

    Pairs are made inside one layout (tens of channels) by expanding its array, not by a cross join.
    """
    g = coords.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("node", "x", "y", "z"))).alias("_c"))
    g = g.select(*group, "_c", F.explode("_c").alias("_a")).select(*group, "_a", F.explode("_c").alias("_b")).filter("_a.node <> _b.node")
    d = F.sqrt(sum((F.pow(F.col(f"_a.{k_}") - F.col(f"_b.{k_}"), F.lit(2)) for k_ in "xyz"), F.lit(0.0)))
    p = g.select(*group, F.col("_a.node").alias("i"), F.col("_b.node").alias("j"), d.alias("d"))
    if method == "knn":
        p = pick_first(p, [*group, "i"], F.col("d"), F.col("j"), k=k)
    elif method == "radius":
        p = p.filter(F.col("d") <= radius)
    else:
        raise ValueError("method must be 'knn' or 'radius'")
    w = 1 / (F.col("d") + EPS) if weight == "inverse" else F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    return p.groupBy(*group, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("d").alias("d")).withColumn("w", w)


def hemisphere_pairs(channels: DataFrame, group: Sequence[str] = (), channel: str = "channel") -> DataFrame:
    """GRA09: left-right partner channels: odd number n pairs with n + 1, for each token of a bipolar name."""
    token = lambda s: F.when(s.rlike(r"^[A-Za-z]+\d+$"), F.concat(
        F.regexp_extract(s, r"^([A-Za-z]+)(\d+)$", 1),
        (lambda n: F.when(n % 2 == 1, n + 1).otherwise(n - 1))(F.regexp_extract(s, r"^([A-Za-z]+)(\d+)$", 2).try_cast("int")).cast("string")))
    parts = F.transform(F.split(c(channel), "-"), token)
    partner = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "-"))
    ch = channels.select(*group, F.col(channel).alias("a")).distinct()
    b = channels.select(*group, F.col(channel).alias("b")).distinct()
    want = channels.select(*group, F.col(channel).alias("a"), partner.alias("b")).distinct().filter("b IS NOT NULL AND a < b")
    return want.join(b, [*group, "b"], "left_semi").join(ch, [*group, "a"], "left_semi").select(*group, "a", "b")


def shared_electrode_pairs(channels: DataFrame, group: Sequence[str] = (), channel: str = "channel") -> DataFrame:
    """GRA28: bipolar channels whose electrode pairs meet. Channels sharing an electrode find each other by an equi join on it."""
    e = channels.select(*group, F.col(channel).alias("name"), F.explode(F.split(c(channel), "-")).alias("_el")).distinct()
    a, b = e.withColumnRenamed("name", "a"), e.withColumnRenamed("name", "b")
    return a.join(b, [*group, "_el"]).filter("a < b").select(*group, "a", "b").distinct()


# ---- regions ------------------------------------------------------------------------------------

def region_clique(edges: DataFrame, members: DataFrame, *, weight: str = "mean", combine: str = "sum", graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA10: members of a region are joined with the region's weight (mean, mean_abs or ones of its member edges); edges in
    several regions are summed or maximized. ``members`` (region, node) is a small constant."""
    m = F.broadcast(members.select("region", F.col("node").alias("i")))
    n = F.broadcast(members.select(F.col("region").alias("_r"), F.col("node").alias("j")))
    inside = edges.join(m, "i").join(n, "j").filter("region = _r")
    agg = {"mean": F.avg(w), "mean_abs": F.avg(F.abs(w)), "ones": F.lit(1.0)}[weight]
    hw = inside.groupBy(*graph, "region").agg(agg.alias("_h"))
    pairs = members.alias("a").join(members.alias("b"), "region").select("region", F.col("a.node").alias("i"), F.col("b.node").alias("j")).filter("i < j")
    comb = {"sum": F.sum, "max": F.max}[combine]
    out = hw.join(F.broadcast(pairs), "region").groupBy(*graph, "i", "j").agg(comb("_h").alias(w))
    # the matrix starts at zero, so a maximum is never below it
    return out.withColumn(w, F.greatest(F.col(w), F.lit(0.0))) if combine == "max" else out


def region_proxy(members: DataFrame) -> DataFrame:
    """GRA10: for nodes in common regions, the sum of 1 / region size."""
    size = members.groupBy("region").agg(F.count("*").alias("_n"))
    pairs = members.alias("a").join(members.alias("b"), "region").select("region", F.col("a.node").alias("i"), F.col("b.node").alias("j")).filter("i < j")
    return pairs.join(size, "region").groupBy("i", "j").agg(F.sum(1 / F.col("_n")).alias("w"))


def region_features(nodes: DataFrame, members: DataFrame, *, std: bool = False, keys: Sequence[str] = G) -> DataFrame:
    """GRA25: mean (and population std) of node features per region."""
    n = nodes.join(F.broadcast(members), "node")
    aggs = [F.avg("x").alias("mean")] + ([F.stddev_pop("x").alias("std")] if std else [])
    return n.groupBy(*keys, "region", "feature").agg(*aggs)


def region_vector(nodes: DataFrame, members: DataFrame, mode: str = "region_mean_std", keys: Sequence[str] = G) -> DataFrame:
    """GRA25: node features as one vector: 'flatten', 'region_mean_std' (mean then std block per region), 'legacy' (both)."""
    flat = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", "feature", "x"))).alias("_s")).select(*keys, F.col("_s.x").alias("flat"))
    if mode == "flatten":
        return flat.withColumnRenamed("flat", "vector")
    r = region_features(nodes, members, std=True, keys=keys)
    two = r.select(*keys, "region", F.explode(F.array(F.struct(F.lit(0).alias("b"), "feature", F.col("mean").alias("v")),
                                                       F.struct(F.lit(1).alias("b"), "feature", F.col("std").alias("v")))).alias("e"))
    reg = two.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("region", "e.b", "e.feature", "e.v"))).alias("_s")).select(*keys, F.col("_s.v").alias("reg"))
    if mode == "region_mean_std":
        return reg.withColumnRenamed("reg", "vector")
    return flat.join(reg, list(keys)).select(*keys, F.concat("flat", "reg").alias("vector"))


def region_bank(edges: DataFrame, members: DataFrame, sources: Sequence[tuple], graph: Sequence[str] = G) -> DataFrame:
    """GRA30: region x region mean edges for each listed (metric, band) candidate."""
    from .connectivity import region_matrix

    hit = F.lit(None).cast("int")
    for k, (m, b) in enumerate(sources):
        cond = (F.col("metric") == m) & (F.col("band").isNull() if b is None else F.col("band") == b)
        hit = F.coalesce(hit, F.when(cond, F.lit(k)))
    e = edges.withColumn("cand", hit).filter("cand IS NOT NULL")
    return region_matrix(e, members.select(F.col("node").alias("channel"), "region"), [*graph, "cand"], "value")


# ---- banks --------------------------------------------------------------------------------------

def feature_topology(graphs: DataFrame, mode: str = "topk", *, similarity: str = "cosine", threshold: float | None = None, k: int = 3,
                     zscore_nodes: bool = False, clip_negative: bool = False, rescale: bool = False, fixed: DataFrame | None = None,
                     gamma: float | None = None, tau: float | None = None, graph: Sequence[str] = G) -> DataFrame:
    """GRA27: similarity of node features, then full, threshold, topk, mst, min_st or fixed; ``rescale`` maps cosine to (s + 1) / 2."""
    g = graphs
    if zscore_nodes:
        cols = F.transform(F.sequence(F.lit(0), F.size(F.element_at("nodes", 1)) - 1), lambda f: F.transform("nodes", lambda v: F.get(v, f)))
        stat = F.transform(cols, lambda v: F.struct(a_mean(v).alias("m"), F.sqrt(F.greatest(a_dot(v, v) / F.size(v) - a_mean(v) * a_mean(v), F.lit(0.0))).alias("s")))
        g = g.withColumn("_st", stat).withColumn("nodes", F.transform("nodes", lambda v: F.zip_with(
            v, "_st", lambda x, s: (x - s["m"]) / F.when(s["s"] < EPS, 1.0).otherwise(s["s"]))))
    e = feature_similarity(g, similarity, gamma=gamma, tau=tau, carry=graph)
    if rescale:
        e = e.withColumn("w", (F.col("w") + 1) / 2)
    if clip_negative:
        e = e.withColumn("w", F.greatest("w", F.lit(0.0)))
    return {"full": lambda: e, "threshold": lambda: threshold_topology(e, threshold), "topk": lambda: topk_per_node(e, k, graph=graph),
            "mst": lambda: spanning_tree(e, graph=graph), "min_st": lambda: spanning_tree(e, "minimum", graph=graph),
            "fixed": lambda: fixed_topology(e, fixed)}[mode]()


def topology(edges: DataFrame, mode: str, *, threshold: float | None = None, k: int | None = None, fixed: DataFrame | None = None,
             graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA02: 'full', 'threshold', 'topk', 'mst' or 'fixed' on a connectivity source."""
    return {"full": lambda: edges, "threshold": lambda: threshold_topology(edges, threshold, w=w), "topk": lambda: topk_per_node(edges, k, graph=graph, w=w),
            "mst": lambda: spanning_tree(edges, graph=graph, w=w), "fixed": lambda: fixed_topology(edges, fixed)}[mode]()


def graph_bank(sources: DataFrame, specs: Sequence[dict], *, fixed: DataFrame | None = None, custom: DataFrame | None = None, graph: Sequence[str] = G) -> DataFrame:
    """GRA11: one candidate graph per spec: rows (graph.., cand, i, j, topo, weight, adj).

    ``sources`` is (graph.., source, i, j, w). A spec has name, topology (mode), source (of the topology), threshold / k, and
    weight: 'binary', 'topology_weight', 'similarity' (the weights of the topology's source), 'connectivity' with
    weight_source, or 'custom'. Every entry keeps its weight; ``adj`` is weight x topology.
    """
    out = None
    key = [*graph, "i", "j"]
    for spec in specs:
        src = sources.filter(F.col("source") == spec["source"]).select(*key, "w")
        topo = topology(src, spec["topology"], threshold=spec.get("threshold"), k=spec.get("k"), fixed=fixed, graph=graph)
        kind = spec.get("weight", "topology_weight")
        base = sources.filter(F.col("source") == spec["weight_source"]).select(*key, "w") if kind == "connectivity" else custom.select(*key, "w") if kind == "custom" else src
        weight = F.lit(1.0) if kind == "binary" else F.col("w")
        e = base.join(topo.select(*key, F.lit(1).alias("topo")), key, "left").select(
            *graph, F.lit(spec["name"]).alias("cand"), "i", "j", F.coalesce("topo", F.lit(0)).alias("topo"), weight.alias("weight"))
        e = e.withColumn("adj", F.col("topo") * F.col("weight"))
        out = e if out is None else out.unionByName(e)
    return out


def fuse_bank(bank: DataFrame, *, method: str = "mean", rule: str = "union", weights: dict | None = None, vote: float = 0.5,
              select: str | None = None, graph: Sequence[str] = G) -> DataFrame:
    """GRA12: fuse candidates: topology by union, intersection or weighted vote; weights by mean (also 'sum'), median, the
    value of largest size ('max'), or one selected candidate."""
    if method == "select":
        return bank.filter(F.col("cand") == select).select(*graph, "i", "j", "topo", "weight", "adj")
    b = bank.withColumn("_q", F.lit(1.0))
    if weights:
        q = F.lit(None).cast("double")
        for name, v in weights.items():
            q = F.when(F.col("cand") == name, float(v)).otherwise(q)
        b = b.withColumn("_q", q)
    total = F.greatest(F.sum("_q"), F.lit(EPS))
    big = lambda v: F.max_by(v, F.struct(F.abs(v).alias("a"), F.concat(F.lit("-"), "cand").alias("b")))
    comb = {"mean": lambda v: F.sum(F.col(v) * F.col("_q")) / total, "sum": lambda v: F.sum(F.col(v) * F.col("_q")) / total,
            "median": lambda v: F.percentile(v, F.lit(0.5)), "max": big}[method]
    topo = {"union": F.max("topo"), "intersection": F.min("topo"), "vote": F.when(F.sum(F.col("topo") * F.col("_q")) / total >= vote, 1).otherwise(0)}[rule]
    return b.groupBy(*graph, "i", "j").agg(topo.alias("topo"), comb("weight").alias("weight"), comb("adj").alias("_a")).withColumn(
        "adj", F.col("topo") * F.col("_a")).drop("_a")


def assemble_graphs(nodes: DataFrame, edges: DataFrame, level: Sequence[str], build: Callable[[DataFrame], DataFrame], *, how: str = "mean") -> tuple[DataFrame, DataFrame]:
    """GRA13: graphs of a longer level: node features and connectivity reduced over the level, then a topology."""
    from .windows import to_level

    n = to_level(nodes, [*level, "node", "feature"], "x", how)
    e = to_level(edges, [*level, "i", "j"], "w", how)
    return n, build(e)


# ---- vectors and matrices -----------------------------------------------------------------------

def graph_vector(nodes: DataFrame, edges: DataFrame, graph: Sequence[str] = G, zscore_nodes: bool = True) -> DataFrame:
    """GRA14: z-scored node features row by row, then the upper triangle, as one array."""
    from .projections import normalize_nodes

    n = normalize_nodes(nodes, graph=graph[0]) if zscore_nodes else nodes
    f = n.groupBy(*graph).agg(F.sort_array(F.collect_list(F.struct("node", "feature", "x"))).alias("_n"))
    e = edges.groupBy(*graph).agg(F.sort_array(F.collect_list(F.struct("i", "j", "w"))).alias("_e"))
    return f.join(e, list(graph)).select(*graph, F.concat(F.col("_n.x"), F.col("_e.w")).alias("vector"))


def _every(graphs: DataFrame | None, edges: DataFrame, graph: Sequence[str]) -> DataFrame:
    """One row per graph: those of ``graphs``, so that graphs without an edge count; else those that have edges."""
    return (edges if graphs is None else graphs).select(*graph).distinct()


def _packed(edges: DataFrame, graphs: DataFrame | None, graph: Sequence[str], w: str | None) -> DataFrame:
    """One row per graph with its edges in one array ``_e`` (empty for a graph without edges)."""
    e = F.struct("i", "j", F.col(w).alias("w")) if w else F.struct("i", "j")
    g = edges.groupBy(*graph).agg(F.sort_array(F.collect_list(e)).alias("_e"))
    return g if graphs is None else _every(graphs, edges, graph).join(g, list(graph), "left").withColumn("_e", F.coalesce("_e", F.array().cast(g.schema["_e"].dataType)))


def _stack(i: pd.Series, j: pd.Series, v: pd.Series | None, n: int) -> np.ndarray:
    """Symmetric matrices of all graphs of a batch, [graphs, n, n]."""
    out = np.zeros((len(i), n, n))
    which = np.repeat(np.arange(len(i)), [len(x) for x in i])
    if len(which):
        p, q = np.concatenate(i.to_list()).astype(int), np.concatenate(j.to_list()).astype(int)
        out[which, p, q] = out[which, q, p] = 1.0 if v is None else np.concatenate(v.to_list()).astype(float)
    return out


def symmetric_normalize(edges: DataFrame, *, nodes: DataFrame | None = None, self_loops: bool = True, abs_degree: bool = False, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA15: w / sqrt(d_i d_j) with self loops of 1 (also returned), degrees at least 1e-8; rows (graph.., i, j, w) both ways.

    ``nodes`` (graph.., node) gives loops to nodes without an edge too; without it only nodes with edges have one.
    """
    both = mirror(edges.select(*graph, "i", "j", w))
    if self_loops:
        own = both.select(*graph, "i") if nodes is None else nodes.select(*graph, F.col("node").alias("i"))
        both = both.unionByName(own.distinct().select(*graph, "i", F.col("i").alias("j"), F.lit(1.0).alias(w)))
    # row sums equal column sums, so each degree comes from a window over one graph's rows
    val = F.abs(w) if abs_degree else F.col(w)
    di = F.greatest(F.sum(val).over(over([*graph, "i"])), F.lit(EPS))
    dj = F.greatest(F.sum(val).over(over([*graph, "j"])), F.lit(EPS))
    return both.withColumn("_w", F.col(w) / F.sqrt(di * dj)).drop(w).withColumnRenamed("_w", w)


def node_theory(edges: DataFrame, n_nodes: int, graphs: DataFrame | None = None, graph: Sequence[str] = G, w: str = "w", iterations: int = 200, tol: float = 1e-6) -> DataFrame:
    """GRA16: strength, abs / positive / negative strength, mean abs edge, weighted clustering, eigenvector centrality of
    nodes 0 .. n_nodes - 1, those without an edge included; ``graphs`` adds graphs without edges.

    All graphs of a batch are worked together. ``iterations`` is the reference's bound on power steps.
    """

    @F.pandas_udf("array<array<double>>")
    def run(i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        a = _stack(i, j, v, n_nodes)
        m = np.abs(a)
        top = m.max(axis=(1, 2))
        scaled = m / np.where(top > 0, top, 1.0)[:, None, None]
        s = np.where((scaled > EPS) & (top >= EPS)[:, None, None], scaled, 0.0) if n_nodes >= 3 else np.zeros_like(m)
        deg, root = (s > 0).sum(2), np.cbrt(s)
        tri = np.einsum("gij,gji->gi", root @ root, root)
        clus = np.where(deg > 1, tri / np.maximum(deg * (deg - 1), 1), 0.0)
        vec = np.full((len(m), n_nodes), 1 / np.sqrt(n_nodes))
        open_ = np.arange(len(m))
        for _ in range(iterations):
            nxt = np.einsum("gij,gj->gi", m[open_], vec[open_])
            size = np.linalg.norm(nxt, axis=1)
            alive = size >= EPS
            nxt = np.where(alive[:, None], nxt / np.where(alive, size, 1.0)[:, None], 0.0)
            done = ~alive | (np.abs(nxt - vec[open_]).max(1) < tol)
            vec[open_] = nxt
            open_ = open_[~done]
            if not len(open_):
                break
        tot = vec.sum(1, keepdims=True)
        vec = np.where(tot > EPS, vec / np.where(tot > EPS, tot, 1.0), vec)
        out = np.stack([a.sum(2), m.sum(2), np.maximum(a, 0).sum(2), np.maximum(-a, 0).sum(2), m.sum(2) / max(n_nodes - 1, 1), clus, vec], axis=2)
        return pd.Series([list(g) for g in out])

    r = _packed(edges, graphs, graph, w).select(*graph, F.posexplode(run(F.col("_e.i"), F.col("_e.j"), F.col("_e.w"))).alias("node", "_r"))
    names = ["strength", "abs_strength", "pos_strength", "neg_strength", "mean_abs_edge", "weighted_clustering", "eigenvector_centrality"]
    return r.select(*graph, "node", *[F.element_at("_r", k + 1).alias(n) for k, n in enumerate(names)])


def edge_summary(edges: DataFrame, n_nodes: int, graphs: DataFrame | None = None, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA17: edge mean, std, min, max, nonzero share over all pairs of nodes; node strength and degree statistics over all
    nodes (population std). A pair without an edge counts as 0; ``graphs`` adds graphs without edges."""
    pairs = n_nodes * (n_nodes - 1) // 2

    def stats(total, square, n, prefix):
        mean = total / n
        return [mean.alias(f"{prefix}_mean"), F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))).alias(f"{prefix}_std")]

    def span(low, high, seen, n, prefix):
        return [F.when(seen < n, F.least(low, F.lit(0.0))).otherwise(low).alias(f"{prefix}_min"), F.when(seen < n, F.greatest(high, F.lit(0.0))).otherwise(high).alias(f"{prefix}_max")]

    big = F.when(F.abs(w) > EPS, 1).otherwise(0)
    e = edges.groupBy(*graph).agg(F.sum(w).alias("s"), F.sum(F.col(w) * F.col(w)).alias("q"), F.min(w).alias("lo"), F.max(w).alias("hi"), F.count("*").alias("k"), F.sum(big).alias("b"))
    d = mirror(edges.select(*graph, "i", "j", w)).groupBy(*graph, "i").agg(F.sum(w).alias("v"), F.sum(big).alias("d"))
    d = d.groupBy(*graph).agg(F.sum("v").alias("vs"), F.sum(F.col("v") * F.col("v")).alias("vq"), F.min("v").alias("vlo"), F.max("v").alias("vhi"), F.count("*").alias("vk"),
                              F.sum("d").alias("ds"), F.sum(F.col("d") * F.col("d")).alias("dq"))
    j = _every(graphs, edges, graph).join(e, list(graph), "left").join(d, list(graph), "left").fillna(0)
    at = F.col
    return j.select(*graph, *stats(at("s"), at("q"), pairs, "edge"), *span(at("lo"), at("hi"), at("k"), pairs, "edge"), (at("b") / pairs).alias("nonzero_ratio"),
                    *stats(at("vs"), at("vq"), n_nodes, "strength"), *span(at("vlo"), at("vhi"), at("vk"), n_nodes, "strength"), *stats(at("ds"), at("dq"), n_nodes, "degree"))


def feature_summary(nodes: DataFrame, graph: Sequence[str] = G) -> DataFrame:
    """GRA17: mean, std, min, max of each feature over nodes."""
    return nodes.groupBy(*graph, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def eigen_summary(edges: DataFrame, n_nodes: int, graphs: DataFrame | None = None, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA17: largest, second, mean, std and smallest eigenvalue of the adjacency of all nodes."""

    @F.pandas_udf("array<double>")
    def run(i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        e = np.linalg.eigvalsh(_stack(i, j, v, n_nodes))
        return pd.Series(list(np.stack([e[:, -1], e[:, -2] if n_nodes > 1 else e[:, -1], e.mean(1), e.std(1), e[:, 0]], axis=1)))

    r = _packed(edges, graphs, graph, w).select(*graph, run(F.col("_e.i"), F.col("_e.j"), F.col("_e.w")).alias("_v"))
    return r.select(*graph, *[F.element_at("_v", k + 1).alias(n) for k, n in enumerate(["eig_1", "eig_2", "eig_mean", "eig_std", "eig_min"])])


def summary_vector(nodes: DataFrame, edges: DataFrame, n_nodes: int, graph: Sequence[str] = G) -> DataFrame:
    """GRA17: the whole summary as one array, for every graph that has nodes."""
    f = feature_summary(nodes, graph).groupBy(*graph).agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std", "min", "max"))).alias("_f"))
    es, ei = edge_summary(edges, n_nodes, nodes, graph), eigen_summary(edges, n_nodes, nodes, graph)
    names = [k for k in es.columns if k not in graph] + [k for k in ei.columns if k not in graph]
    j = f.join(es, list(graph)).join(ei, list(graph))
    return j.select(*graph, F.concat("_f.mean", "_f.std", "_f.min", "_f.max", F.array(*names)).alias("summary"))


def path_metrics(edges: DataFrame, n_nodes: int, graph: Sequence[str] = G, graphs: DataFrame | None = None) -> DataFrame:
    """GRA18: global efficiency, mean shortest path (unweighted; null when disconnected) and density of an edge set.

    ``graphs`` adds graphs without edges (efficiency and density 0). All graphs of a batch advance together.
    """

    @F.pandas_udf("array<double>")
    def run(i: pd.Series, j: pd.Series) -> pd.Series:
        adj = _stack(i, j, None, n_nodes) > 0
        dist = np.where(np.eye(n_nodes, dtype=bool), 0.0, np.inf)[None].repeat(len(adj), 0)
        reach, step = np.eye(n_nodes)[None].repeat(len(adj), 0), 0
        while True:
            step += 1
            new = ((reach @ adj) > 0) & np.isinf(dist)
            if not new.any():
                break
            dist[new] = step
            reach = new.astype(float)
        off = dist[:, ~np.eye(n_nodes, dtype=bool)]
        mean, near = off.mean(1), (1 / off).mean(1)
        dense = adj.sum((1, 2)) / max(n_nodes * (n_nodes - 1), 1)
        return pd.Series([[float(e), None if np.isinf(m) else float(m), float(d)] for e, m, d in zip(near, mean, dense)])

    r = _packed(edges, graphs, graph, None).select(*graph, run(F.col("_e.i"), F.col("_e.j")).alias("_v"))
    return r.select(*graph, F.element_at("_v", 1).alias("efficiency"), F.element_at("_v", 2).alias("path_length"), F.element_at("_v", 3).alias("density"))


def backbone(edges: DataFrame, *, subject: Sequence[str] = ("subject_id",), order: str = "segment_id", w: str = "w") -> DataFrame:
    """GRA18: topology of the first segment with weights averaged over all segments of the subject."""
    first = edges.groupBy(*subject).agg(F.min(order).alias("_first"))
    topo = edges.join(first, list(subject)).filter(F.col(order) == F.col("_first")).select(*subject, "i", "j")
    mean = edges.groupBy(*subject, "i", "j").agg(F.avg(w).alias(w))
    return mean.join(topo, [*subject, "i", "j"], "left_semi")


def cross_region_count(edges: DataFrame, members: DataFrame, a, b, graph: Sequence[str] = G, graphs: DataFrame | None = None) -> DataFrame:
    """GRA18: number of edges from region a to region b; ``graphs`` adds graphs without edges."""
    ri, rj = F.broadcast(members.select(F.col("node").alias("i"), F.col("region").alias("_ri"))), F.broadcast(members.select(F.col("node").alias("j"), F.col("region").alias("_rj")))
    e = edges.join(ri, "i").join(rj, "j")
    hit = ((F.col("_ri") == a) & (F.col("_rj") == b)) | ((F.col("_ri") == b) & (F.col("_rj") == a))
    n = e.groupBy(*graph).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("n_cross"))
    return _every(graphs, edges, graph).join(n, list(graph), "left").fillna(0, ["n_cross"])


def edge_frequency(edges: DataFrame, graphs: DataFrame, label: str = "label", graph: str = "graph_id") -> DataFrame:
    """GRA19: share of a class's graphs that contain the edge."""
    size = graphs.groupBy(label).agg(F.count_distinct(graph).alias("_n"))
    e = edges.groupBy(label, "i", "j").agg(F.count_distinct(graph).alias("count"))
    return e.join(F.broadcast(size), label).withColumn("frequency", F.col("count") / F.col("_n")).drop("_n")


def subject_edge_stats(edges: DataFrame, graphs: DataFrame, *, subject: str = "subject_id", label: str = "label", w: str = "w") -> DataFrame:
    """GRA20: frequency, mean and population std of nonzero weights per subject and edge."""
    size = graphs.groupBy(subject).agg(F.count("*").alias("_t"))
    e = edges.filter(F.col(w) != 0).groupBy(label, subject, "i", "j").agg(F.count("*").alias("_c"), F.avg(w).alias("mu"), F.stddev_pop(w).alias("sd"))
    return e.join(size, subject).withColumn("freq", F.col("_c") / F.col("_t")).drop("_c", "_t")


def class_edge_stats(subject_stats: DataFrame, label: str = "label") -> DataFrame:
    return subject_stats.groupBy(label, "i", "j").agg(F.avg("freq").alias("freq"), F.avg("mu").alias("mu"), F.avg("sd").alias("sd"))


def rank_edges(class_stats: DataFrame, label: str = "label") -> DataFrame:
    """GRA20: for class pairs and common edges, |difference of means| / (sum of stds + 1e-8) x ln(1 + sum of frequencies), ranked."""
    k = [F.struct(F.col(label).alias("c"), "freq", "mu", "sd")]
    g = class_stats.groupBy("i", "j").agg(F.sort_array(F.collect_list(k[0])).alias("_g"))
    g = g.select("i", "j", "_g", F.posexplode("_g").alias("_p", "_a")).select("i", "j", "_a", F.explode(F.slice("_g", F.col("_p") + 2, F.size("_g"))).alias("_b"))
    score = F.abs(F.col("_a.mu") - F.col("_b.mu")) / (F.col("_a.sd") + F.col("_b.sd") + EPS) * F.log1p(F.col("_a.freq") + F.col("_b.freq"))
    r = g.select(F.col("_a.c").alias("class_a"), F.col("_b.c").alias("class_b"), "i", "j", score.alias("score"))
    # one row per edge of a montage and class pair: at most a few hundred rows per partition
    return r.withColumn("rank", F.row_number().over(over(["class_a", "class_b"], F.desc("score"), "i", "j")))


# ---- stability, scores, labels ------------------------------------------------------------------

def consecutive_stability(edges: DataFrame, *, segments: DataFrame | None = None, subject: str = "subject_id", segment: str = "segment_id", w: str = "w",
                          max_pairs: int | None = None) -> DataFrame:
    """GRA21: Jaccard of edge sets and correlation of weights between consecutive segments of a subject.

    Neighbours meet by an equi join on the segment's place in its subject. ``segments`` (subject, segment) keeps segments
    without an edge in their place: two empty neighbours have a Jaccard of 0. ``max_pairs`` keeps the first pairs of a subject.
    """
    g = _packed(edges, segments, [subject, segment], w)
    g = g.select(subject, segment, F.transform("_e", lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"))).alias("_s"), F.col("_e.w").alias("_w"))
    at = positions(g, [subject], [segment], "_n")
    nxt = at.select(subject, (F.col("_n") - 1).alias("_n"), F.col(segment).alias("next_segment"), F.col("_s").alias("_s2"), F.col("_w").alias("_w2"))
    p = at.join(nxt, [subject, "_n"])
    if max_pairs is not None:
        p = p.filter(F.col("_n") < max_pairs)
    jac = F.size(F.array_intersect("_s", "_s2")) / F.greatest(F.size(F.array_union("_s", "_s2")), F.lit(1))
    cov = a_dot("_w", "_w2") / F.size("_w") - a_mean("_w") * a_mean("_w2")
    var = lambda v: a_dot(v, v) / F.size(v) - a_mean(v) * a_mean(v)
    corr = F.when((F.size("_w") == F.size("_w2")) & (F.size("_w") > 1), F.try_divide(cov, F.sqrt(F.greatest(var("_w"), F.lit(0.0)) * F.greatest(var("_w2"), F.lit(0.0)))))
    return p.select(subject, segment, "next_segment", jac.alias("jaccard"), corr.alias("weight_corr"))


def stability_report(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("jaccard").alias("jaccard_mean"), F.stddev_pop("jaccard").alias("jaccard_std"), F.count("jaccard").alias("n_jaccard"),
                     F.avg("weight_corr").alias("corr_mean"), F.stddev_pop("weight_corr").alias("corr_std"), F.count("weight_corr").alias("n_corr"))


def hyper_scores(graphs: DataFrame, members: DataFrame, graph: Sequence[str] = G) -> DataFrame:
    """GRA22: per graph, weighted over regions: within cosine, 1 / (1 + spread), node-centroid cosine, ln(1 + between / within).

    ``members`` has (region, node, weight), a constant of the montage that travels as one row; a graph is scored from its own
    row, without a shuffle.
    """

    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), EPS)

    def mean(values, weights):
        return float(np.dot(values, weights) / max(np.sum(weights), EPS)) if len(values) else 0.0

    def one(x, region, node, weight):
        cen, spread, q, within, wq, cons, cq = [], [], [], [], [], [], []
        for r in np.unique(region):
            at = node[region == r]
            w = float(weight[region == r][0])
            v = x[at]
            mu = v.mean(0)
            cen.append(mu)
            spread.append(((v - mu) ** 2).sum(1).mean())
            q.append(w)
            u = unit(v)
            cons += (u @ unit(mu)).tolist()
            cq += [w] * len(at)
            if len(at) > 1:
                within.append((u @ u.T)[np.triu_indices(len(at), 1)].mean())
                wq.append(w)
        cen, spread, q = np.array(cen), np.array(spread), np.array(q)
        i, j = np.triu_indices(len(cen), 1)
        between = mean(((cen[i] - cen[j]) ** 2).sum(1), (q[i] + q[j]) / 2)
        contrast = np.log1p(between / (mean(spread, q) + EPS)) if len(cen) > 1 else 0.0
        return [mean(np.array(within), np.array(wq)), mean(1 / (1 + spread), q), mean(np.array(cons), np.array(cq)), float(contrast)]

    @F.pandas_udf("array<double>")
    def run(nodes: pd.Series, region: pd.Series, node: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series([one(K.matrix(m), np.asarray(r, int), np.asarray(n, int), np.asarray(w, float)) for m, r, n, w in zip(nodes, region, node, weight)])

    m = members.agg(F.sort_array(F.collect_list(F.struct(F.col("region").cast("int").alias("r"), F.col("node").cast("int").alias("n"), F.col("weight").cast("double").alias("w")))).alias("_m"))
    g = attach(graphs.select(*graph, "nodes"), m, []).withColumn("_s", run("nodes", F.col("_m.r"), F.col("_m.n"), F.col("_m.w")))
    return g.select(*graph, *[F.get("_s", k).alias(n) for k, n in enumerate(["within_similarity", "smoothness", "consistency", "contrast"])])


def pseudo_scores(edges: DataFrame, graphs: DataFrame, *, motif_k: int = 4, graph: str = "graph_id", w: str = "w") -> DataFrame:
    """GRA23: nonlinear edge coupling, Dirichlet contrast of feature halves, and the motif score of the k nodes of largest degree.

    A graph's edges are gathered once, meet its node features in one join, and are scored in place.
    """

    def one(x, i, j, v):
        n, f = x.shape
        a = np.zeros((n, n))
        a[i, j] = a[j, i] = v
        size = np.abs(a).sum() + EPS
        sim = x @ x.T / np.sqrt(f)
        d2 = lambda u: ((u[:, None] - u[None]) ** 2).sum(-1)
        mid = f // 2
        energy = lambda u: 0.5 * (a * d2(u)).sum() / size
        dirichlet = energy(x[:, :mid]) - energy(x[:, mid:]) if f >= 2 else energy(x)
        top = np.argsort(-a.sum(1), kind="stable")[:motif_k]
        rest = np.setdiff1d(np.arange(n), top)
        am = a[np.ix_(top, top)]
        inner = (am * np.tanh(sim[np.ix_(top, top)])).sum() / (np.abs(am).sum() + EPS)
        contrast = ((x[top].mean(0) - x[rest].mean(0)) ** 2).mean() if len(rest) else 0.0
        return [float((a / (1 + np.exp(-sim))).sum() / size), float(dirichlet), float(inner + 0.5 * contrast)]

    @F.pandas_udf("array<double>")
    def run(nodes: pd.Series, i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([one(K.matrix(m), np.asarray(a, int), np.asarray(b, int), np.asarray(d, float)) for m, a, b, d in zip(nodes, i, j, v)])

    e = edges.groupBy(graph).agg(F.collect_list(F.struct("i", "j", F.col(w).alias("w"))).alias("_e"))
    g = graphs.select(graph, "nodes").join(e, graph).withColumn("_s", run("nodes", F.col("_e.i"), F.col("_e.j"), F.col("_e.w")))
    return g.select(graph, *[F.get("_s", k).alias(n) for k, n in enumerate(["nonlinear", "dirichlet", "motif"])])


def subject_scores(scores: DataFrame, value: str, how: str = "mean", *, top_ratio: float = 0.3, subject: str = "subject_id") -> DataFrame:
    """GRA24: subject score: mean (also 'majority'), median, max, or the mean of the top share."""
    if how == "topk_mean":
        n = scores.groupBy(subject).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(top_ratio))).alias("_k"))
        return positions(scores.select(subject, value), [subject], [F.desc(value)], "_n").join(n, subject).filter("_n < _k").groupBy(subject).agg(F.avg(value).alias("score"))
    if how == "median":
        return quantiles(scores, [subject], value, {"score": 0.5})
    return scores.groupBy(subject).agg({"mean": F.avg, "majority": F.avg, "max": F.max}[how](value).alias("score"))


def quantile_labels(subjects: DataFrame, classes: int = 3, score: str = "score") -> DataFrame:
    """GRA24: two classes by > median, or three by < the exact 1/3 and 2/3 quantiles.

    Scores are written once: a sum of doubles computed again may differ in its last digit, and a quantile that is itself a score would miss it.
    """
    subjects = land(subjects)
    if classes == 2:
        q = quantiles(subjects, [], score, {"_q1": 0.5})
        return attach(subjects, q, []).withColumn("fake_label", F.when(F.col(score) > F.col("_q1"), 1).otherwise(0)).drop("_q1")
    if classes != 3:
        raise ValueError("two or three classes")
    q = quantiles(subjects, [], score, {"_q1": 1 / 3, "_q2": 2 / 3})
    return attach(subjects, q, []).withColumn("fake_label", F.when(F.col(score) < F.col("_q1"), 0).when(F.col(score) < F.col("_q2"), 1).otherwise(2)).drop("_q1", "_q2")


# ---- controls, conversion -----------------------------------------------------------------------

def shuffle_weights(edges: DataFrame, seed: int, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA26: the same edges with their weights shuffled among them (nonzero edges of one graph)."""
    e = edges.filter(F.col(w) != 0)
    g = e.groupBy(*graph).agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("_p"),
                              F.sort_array(F.collect_list(F.struct(random_hex(F.lit(seed), *graph, "i", "j").alias("h"), F.col(w).alias("v")))).alias("_v"))
    z = g.select(*graph, F.explode(F.arrays_zip("_p", F.col("_v.v").alias("v"))).alias("z"))
    return z.select(*graph, "z._p.i", "z._p.j", F.col("z.v").alias(w))


def node_permutation(graphs: DataFrame, seed: int, n_nodes: int, graph: Sequence[str] = G) -> DataFrame:
    """(graph.., node, new_node): a seeded permutation per graph."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda k: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(g).cast("string") for g in graph], k.cast("string"))).alias("h"), k.alias("k")))
    return graphs.select(*graph, F.posexplode(F.sort_array(nodes)).alias("new_node", "s")).select(*graph, F.col("s.k").alias("node"), "new_node")


def permute_edges(edges: DataFrame, perm: DataFrame, graph: Sequence[str] = G) -> DataFrame:
    """GRA26: relabel the ends of edges; with the same relabelling of features the graph is unchanged, alone it is a control."""
    p = perm.groupBy(*graph).agg(F.map_from_entries(F.collect_list(F.struct("node", "new_node"))).alias("_m"))
    e = edges.join(p, list(graph)).withColumn("_a", F.element_at("_m", F.col("i"))).withColumn("_b", F.element_at("_m", F.col("j")))
    return e.withColumn("i", F.least("_a", "_b")).withColumn("j", F.greatest("_a", "_b")).select(edges.columns)


def dense_to_edges(rows: DataFrame, graph: Sequence[str] = G, matrix: str = "matrix", eps: float = 1e-12) -> DataFrame:
    """GRA29: matrix rows to entries with |value| > eps."""
    r = rows.select(*graph, F.posexplode(matrix).alias("i", "_row"))
    return r.select(*graph, "i", F.posexplode("_row").alias("j", "w")).filter(F.abs("w") > eps)


def edges_to_dense(edges: DataFrame, n_nodes: int, graph: Sequence[str] = G, w: str = "w") -> DataFrame:
    """GRA29: entries to a matrix (array of rows) with zeros where there is no edge."""
    m = edges.groupBy(*graph).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * n_nodes + F.col("j")).cast("int").alias("k"), F.col(w).alias("v")))).alias("_m"))
    seq = F.sequence(F.lit(0), F.lit(n_nodes - 1))
    return m.select(*graph, F.transform(seq, lambda i: F.transform(seq, lambda j: F.coalesce(F.try_element_at("_m", (i * n_nodes + j).cast("int")), F.lit(0.0)))).alias("matrix"))


def density(edges: DataFrame, n_nodes: int, graph: Sequence[str] = G, graphs: DataFrame | None = None) -> DataFrame:
    """GRA29: nonzero entries (both directions), density and sparsity; ``graphs`` adds graphs without edges."""
    n = edges.groupBy(*graph).agg((2 * F.count("*")).alias("nnz"))
    return _every(graphs, edges, graph).join(n, list(graph), "left").fillna(0, ["nnz"]).withColumn("density", F.col("nnz") / (n_nodes * n_nodes)).withColumn(
        "sparsity", 1 - F.col("nnz") / (n_nodes * n_nodes))
