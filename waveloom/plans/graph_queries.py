"""Queries for graph construction and statistics (GRA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectivity as con
from ..operators import graphs as gr
from .connect_queries import regions
from .registry import query

_E = "graph_id:i i:i j:i w:d"
_MD5 = "md5(concat_ws('|', {}))"


def edges(t):
    return t.edges.select("graph_id", "i", "j", "w")


def ring(t):
    """Fixed pairs from the nodes in the data: neighbours on a ring of 16 and the opposite node."""
    n = t.nodes.select("node").distinct()
    return n.select(F.col("node").alias("i"), F.explode(F.array((F.col("node") + 1) % 16, (F.col("node") + 8) % 16)).alias("j"))


RING = "(j - i IN (1, 8, 15))"


def members(t):
    """Overlapping regions of nodes with weights: quarters, and the first half again."""
    n = t.nodes.select("node").distinct()
    q = n.select(F.floor(F.col("node") / 4).cast("int").alias("region"), "node")
    h = n.filter("node < 8").select(F.lit(4).alias("region"), "node")
    return q.unionByName(h).withColumn("weight", 1.0 + F.col("region"))


MEM = "(SELECT node // 4 AS region, node FROM range(16) r(node) UNION ALL SELECT 4, node FROM range(8) r(node))"


@query("gra01_fixed_topology", _E, f"SELECT graph_id, i, j, w FROM v_edges WHERE {RING}")
def _(t):
    return gr.fixed_topology(edges(t), ring(t))


@query("gra02_threshold_topology", _E, "SELECT graph_id, i, j, w FROM v_edges WHERE abs(w) >= 0.4")
def _(t):
    return gr.topology(edges(t), "threshold", threshold=0.4)


def topk_sql(k, order="abs(w) DESC", src="v_both"):
    return f"""SELECT DISTINCT graph_id, least(i, j) AS i, greatest(i, j) AS j, w FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY {order}, j) AS r FROM {src}) WHERE r <= {k}"""


@query("gra03_topk_per_node", _E, topk_sql(3))
def _(t):
    return gr.topk_per_node(edges(t), 3)


def bottleneck_sql(src="v_both", n=16):
    """CTE text b0..bn of the best bottleneck between nodes; an edge is in the maximum spanning tree if it equals it."""
    out = [f"b0 AS MATERIALIZED (SELECT graph_id, i, j, w FROM {src})"]
    for k in range(n):
        out.append(f"""b{k + 1} AS MATERIALIZED (SELECT a.graph_id, a.i, a.j, greatest(a.w, coalesce(least(p.w, q.w), a.w)) AS w FROM b{k} a
          LEFT JOIN b{k} p ON p.graph_id = a.graph_id AND p.i = a.i AND p.j = {k} LEFT JOIN b{k} q ON q.graph_id = a.graph_id AND q.i = {k} AND q.j = a.j)""")
    return ", ".join(out)


MST = f"WITH {bottleneck_sql()} SELECT e.graph_id, e.i, e.j, e.w FROM v_edges e JOIN b16 b USING (graph_id, i, j) WHERE e.w = b.w"


@query("gra04_maximum_spanning_tree", _E, MST)
def _(t):
    return gr.spanning_tree(edges(t))


@query("gra04_minimum_spanning_tree", _E, f"""
    WITH neg AS (SELECT graph_id, i, j, -w AS w FROM v_both), {bottleneck_sql('neg')} SELECT e.graph_id, e.i, e.j, e.w FROM v_edges e JOIN b16 b USING (graph_id, i, j) WHERE -e.w = b.w""")
def _(t):
    return gr.spanning_tree(edges(t), "minimum")


_TOPS = """SELECT graph_id, i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY abs(w) DESC, i, j) AS r,
      greatest(1, ceil(count(*) OVER (PARTITION BY graph_id) * 0.2)) AS m FROM v_edges) WHERE r <= m"""


@query("gra04_tree_plus_top", _E, f"SELECT * FROM ({MST}) UNION SELECT * FROM ({_TOPS})")
def _(t):
    return gr.spanning_tree(edges(t), top_percent=0.2, keep_top=True)


@query("gra05_top_percent_edges", _E, _TOPS)
def _(t):
    return gr.top_edges(edges(t), share=0.2)


@query("gra06_reconnect_isolates", _E, """
    WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY abs(w) DESC, i, j) AS r, count(*) OVER (PARTITION BY graph_id) AS m FROM v_edges),
    top AS (SELECT graph_id, i, j FROM e WHERE r <= greatest(1, ceil(m * 0.05))),
    ends AS (SELECT graph_id, i AS n, j AS o, i, j, r FROM e UNION ALL SELECT graph_id, j, i, i, j, r FROM e),
    best AS MATERIALIZED (SELECT graph_id, n, o, i, j, row_number() OVER (PARTITION BY graph_id ORDER BY n) AS step FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, n ORDER BY r) AS q FROM ends) WHERE q = 1),
    walk(graph_id, step, seen, added) AS (
      SELECT graph_id, 0, list(n), CAST([] AS STRUCT(i BIGINT, j BIGINT)[]) FROM (SELECT graph_id, i AS n FROM top UNION SELECT graph_id, j FROM top) GROUP BY 1
      UNION ALL SELECT walk.graph_id, walk.step + 1, CASE WHEN list_contains(seen, n) THEN seen ELSE list_concat(seen, [n, o]) END,
        CASE WHEN list_contains(seen, n) THEN added ELSE list_append(added, {'i': CAST(i AS BIGINT), 'j': CAST(j AS BIGINT)}) END
      FROM walk JOIN best ON best.graph_id = walk.graph_id AND best.step = walk.step + 1),
    done AS (SELECT graph_id, i, j FROM top UNION SELECT graph_id, a.i, a.j FROM (SELECT graph_id, unnest(arg_max(added, step)) AS a FROM walk GROUP BY 1))
    SELECT e.graph_id, e.i, e.j, e.w FROM e JOIN done USING (graph_id, i, j)""")
def _(t):
    return gr.reconnect_isolates(edges(t), 0.05)


@query("gra07_filter_tree_fixed", _E, f"SELECT * FROM ({MST}) UNION SELECT graph_id, i, j, w FROM v_edges WHERE {RING}")
def _(t):
    return gr.edge_filter(edges(t), "combined", fixed=ring(t))


@query("gra07_filter_overlap", _E, f"SELECT * FROM ({MST}) WHERE {RING}")
def _(t):
    return gr.edge_filter(edges(t), "overlap", fixed=ring(t))


@query("gra07_filter_global_topk", _E, f"""
    SELECT graph_id, i, j, w FROM v_edges WHERE {RING} UNION
    SELECT graph_id, i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY w DESC, i, j) AS r FROM v_edges) WHERE r <= 10""")
def _(t):
    return gr.edge_filter(edges(t), "combined", fixed=ring(t), k=10, flavor="global")


_POS = "(SELECT graph_id, node, max(CASE WHEN feature = 0 THEN x END) AS x, max(CASE WHEN feature = 1 THEN x END) AS y, max(CASE WHEN feature = 2 THEN x END) AS z FROM v_nodes GROUP BY 1, 2)"
_DIST = f"(SELECT a.graph_id, a.node AS i, b.node AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM {_POS} a JOIN {_POS} b ON a.graph_id = b.graph_id AND a.node <> b.node)"


def _coords(t):
    return t.graphs.select("graph_id", F.posexplode("nodes").alias("node", "f")).select(
        "graph_id", "node", F.get("f", 0).alias("x"), F.get("f", 1).alias("y"), F.get("f", 2).alias("z"))


@query("gra08_spatial_knn", "graph_id:i i:i j:i d:d w:d5", f"""
    SELECT graph_id, least(i, j) AS i, greatest(i, j) AS j, max(d) AS d, 1 / (max(d) + 1e-8) AS w FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY d, j) AS r FROM {_DIST}) WHERE r <= 3 GROUP BY 1, 2, 3""")
def _(t):
    return gr.spatial_pairs(_coords(t), "knn", k=3, group=["graph_id"])


@query("gra08_spatial_radius", "graph_id:i i:i j:i w:d", f"SELECT graph_id, i, j, exp(-d * d / 0.5) AS w FROM {_DIST} WHERE i < j AND d <= 0.2")
def _(t):
    return gr.spatial_pairs(_coords(t), "radius", radius=0.2, weight="gaussian", sigma=0.5, group=["graph_id"])


@query("gra09_hemisphere_pairs", "p_size:i a:s b:s", """
    WITH ch AS (SELECT DISTINCT p_size, list_extract(['F', 'C', 'P'], CAST(p_partkey % 3 + 1 AS INTEGER)) || (p_partkey // 3 % 4 + 3) AS n FROM part
      UNION SELECT DISTINCT p_size, 'Cz' FROM part)
    SELECT a.p_size, least(a.n, b.n) AS a, greatest(a.n, b.n) AS b FROM ch a JOIN ch b ON a.p_size = b.p_size AND a.n < b.n AND a.n <> 'Cz' AND b.n <> 'Cz'
      AND a.n[1] = b.n[1] AND CAST(a.n[2:] AS INT) % 2 = 1 AND CAST(b.n[2:] AS INT) = CAST(a.n[2:] AS INT) + 1""")
def _(t):
    base = F.element_at(F.array(F.lit("F"), F.lit("C"), F.lit("P")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = t.table("part")
    ch = p.select("p_size", F.concat(base, F.floor(F.col("p_partkey") / 3) % 4 + 3).alias("channel")).unionByName(p.select("p_size", F.lit("Cz").alias("channel"))).distinct()
    return gr.hemisphere_pairs(ch, ["p_size"])


@query("gra10_region_clique", _E, f"""
    WITH h AS (SELECT graph_id, a.region, avg(abs(w)) AS h FROM v_edges JOIN {MEM} a ON a.node = i JOIN {MEM} b ON b.node = j AND a.region = b.region GROUP BY 1, 2)
    SELECT graph_id, a.node AS i, b.node AS j, sum(h) AS w FROM h JOIN {MEM} a ON a.region = h.region JOIN {MEM} b ON b.region = h.region AND a.node < b.node GROUP BY 1, 2, 3""")
def _(t):
    return gr.region_clique(edges(t), members(t).drop("weight"), weight="mean_abs")


@query("gra10_region_clique_max", _E, f"""
    WITH h AS (SELECT graph_id, a.region, avg(w) AS h FROM v_edges JOIN {MEM} a ON a.node = i JOIN {MEM} b ON b.node = j AND a.region = b.region GROUP BY 1, 2)
    SELECT graph_id, a.node AS i, b.node AS j, greatest(max(h), 0) AS w FROM h JOIN {MEM} a ON a.region = h.region JOIN {MEM} b ON b.region = h.region AND a.node < b.node GROUP BY 1, 2, 3""")
def _(t):
    return gr.region_clique(edges(t), members(t).drop("weight"), combine="max")


@query("gra10_region_proxy", "i:i j:i w:d n:i", f"""
    SELECT p.i, p.j, min(p.w) AS w, count(*) AS n FROM (SELECT a.node AS i, b.node AS j, sum(1.0 / n) AS w FROM {MEM} a JOIN {MEM} b ON a.region = b.region AND a.node < b.node
      JOIN (SELECT region, count(*) AS n FROM {MEM} GROUP BY 1) s ON s.region = a.region GROUP BY 1, 2) p JOIN v_edges e ON e.i = p.i AND e.j = p.j GROUP BY 1, 2""")
def _(t):
    p = gr.region_proxy(members(t).drop("weight"))
    return t.edges.select("i", "j").join(F.broadcast(p), ["i", "j"]).groupBy("i", "j").agg(F.min("w").alias("w"), F.count("*").alias("n"))


_SRC = """(SELECT graph_id, i, j, w, 'cos' AS source FROM v_edges UNION ALL
    SELECT a.graph_id, a.node, b.node, exp(-sum(pow(a.x - b.x, 2)) / 4), 'rbf' FROM v_nodes a JOIN v_nodes b ON a.graph_id = b.graph_id AND a.feature = b.feature AND a.node < b.node GROUP BY 1, 2, 3)"""
_BANK = f"""(SELECT graph_id, 'top' AS cand, i, j, (graph_id, i, j) IN (SELECT (graph_id, i, j) FROM ({topk_sql(3)})) AS topo, w AS weight FROM {_SRC} WHERE source = 'cos'
    UNION ALL SELECT graph_id, 'thr', i, j, abs(c) >= 0.4, w FROM {_SRC} s JOIN (SELECT graph_id, i, j, w AS c FROM v_edges) e USING (graph_id, i, j) WHERE source = 'rbf'
    UNION ALL SELECT graph_id, 'fix', i, j, {RING}, 1.0 FROM v_edges)"""


def _bank(t):
    cos = edges(t).withColumn("source", F.lit("cos"))
    rbf = con.feature_similarity(t.graphs, "rbf").withColumn("source", F.lit("rbf"))
    return gr.graph_bank(cos.unionByName(rbf), [
        {"name": "top", "topology": "topk", "k": 3, "source": "cos", "weight": "topology_weight"},
        {"name": "thr", "topology": "threshold", "threshold": 0.4, "source": "cos", "weight": "connectivity", "weight_source": "rbf"},
        {"name": "fix", "topology": "fixed", "source": "cos", "weight": "binary"}], fixed=ring(t))


@query("gra11_graph_bank", "graph_id:i cand:s i:i j:i topo:i weight:d adj:d", f"SELECT * EXCLUDE (topo), CAST(topo AS INT) AS topo, CAST(topo AS INT) * weight AS adj FROM {_BANK}")
def _(t):
    return _bank(t)


@query("gra12_fuse_vote_mean", "graph_id:i i:i j:i topo:i weight:d adj:d", f"""
    SELECT graph_id, i, j, CASE WHEN v >= 0.5 THEN 1 ELSE 0 END AS topo, weight, CASE WHEN v >= 0.5 THEN a ELSE 0 END AS adj FROM (
      SELECT graph_id, i, j, sum(CAST(topo AS INT) * q) / 4 AS v, sum(weight * q) / 4 AS weight, sum(CAST(topo AS INT) * weight * q) / 4 AS a
      FROM {_BANK} JOIN (VALUES ('top', 2), ('thr', 1), ('fix', 1)) c(cand, q) USING (cand) GROUP BY 1, 2, 3)""")
def _(t):
    return gr.fuse_bank(_bank(t), rule="vote", weights={"top": 2, "thr": 1, "fix": 1})


@query("gra12_fuse_union_max", "graph_id:i i:i j:i topo:i weight:d adj:d", f"""
    SELECT graph_id, i, j, max(CAST(topo AS INT)) AS topo, arg_max(weight, abs(weight)) AS weight, max(CAST(topo AS INT)) * arg_max(CAST(topo AS INT) * weight, abs(CAST(topo AS INT) * weight)) AS adj
    FROM {_BANK} GROUP BY 1, 2, 3""")
def _(t):
    return gr.fuse_bank(_bank(t), method="max")


@query("gra12_fuse_intersection_median", "graph_id:i i:i j:i topo:i weight:d", f"""
    SELECT graph_id, i, j, min(CAST(topo AS INT)) AS topo, quantile_cont(weight, 0.5) AS weight FROM {_BANK} GROUP BY 1, 2, 3""")
def _(t):
    return gr.fuse_bank(_bank(t), method="median", rule="intersection")


@query("gra13_macro_graphs", "subject_id:i macro_id:i i:i j:i w:d n_windows:i", """
    WITH m AS MATERIALIZED (SELECT subject_id, segment_id * 500 // 2000 AS macro_id, i, j, avg(w) AS w, count(*) AS n_windows FROM v_edges GROUP BY 1, 2, 3, 4),
    d AS (SELECT subject_id, macro_id, i, j, abs(w) AS a FROM m UNION ALL SELECT subject_id, macro_id, j, i, abs(w) FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, macro_id, i ORDER BY a DESC, j) AS r FROM d),
    p AS (SELECT subject_id, macro_id, least(i, j) AS i, greatest(i, j) AS j FROM r WHERE r <= 2 GROUP BY 1, 2, 3, 4)
    SELECT m.* FROM m JOIN p USING (subject_id, macro_id, i, j)""")
def _(t):
    mac = F.floor(F.col("segment_id") * 500 / 2000)
    level = ["subject_id", "macro_id"]
    return gr.assemble_graphs(t.nodes.withColumn("macro_id", mac), t.edges.withColumn("macro_id", mac), level,
                              lambda e: gr.topk_per_node(e, 2, graph=level))[1]


@query("gra13_macro_nodes", "subject_id:i macro_id:i node:i feature:i x:d", """
    SELECT subject_id, segment_id * 500 // 2000 AS macro_id, node, feature, avg(x) AS x FROM v_nodes GROUP BY 1, 2, 3, 4""")
def _(t):
    mac = F.floor(F.col("segment_id") * 500 / 2000)
    level = ["subject_id", "macro_id"]
    return gr.assemble_graphs(t.nodes.withColumn("macro_id", mac), t.edges.withColumn("macro_id", mac), level, lambda e: e)[0]


@query("gra14_graph_vector", "graph_id:i pos:i v:d", """
    SELECT graph_id, node * 4 + feature AS pos, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 1 ELSE stddev_pop(x) OVER w END AS v
    FROM v_nodes WINDOW w AS (PARTITION BY graph_id, feature)
    UNION ALL SELECT graph_id, 63 + row_number() OVER (PARTITION BY graph_id ORDER BY i, j), w FROM v_edges""")
def _(t):
    return gr.graph_vector(t.nodes, edges(t)).select("graph_id", F.posexplode("vector").alias("pos", "v"))


@query("gra15_symmetric_normalize", _E, """
    WITH a AS (SELECT graph_id, i, j, w FROM v_both UNION ALL SELECT DISTINCT graph_id, node, node, 1.0 FROM v_nodes),
    d AS (SELECT graph_id, i AS n, greatest(sum(abs(w)), 1e-8) AS d FROM a GROUP BY 1, 2)
    SELECT a.graph_id, a.i, a.j, w / sqrt(p.d * q.d) AS w FROM a JOIN d p ON p.graph_id = a.graph_id AND p.n = a.i JOIN d q ON q.graph_id = a.graph_id AND q.n = a.j""")
def _(t):
    return gr.symmetric_normalize(edges(t), abs_degree=True)


@query("gra16_node_theory", "graph_id:i node:i strength:d abs_strength:d pos_strength:d neg_strength:d mean_abs_edge:d weighted_clustering:d", """
    WITH m AS (SELECT graph_id, max(abs(w)) AS m FROM v_edges GROUP BY 1),
    s AS (SELECT graph_id, i, j, abs(w) / m AS s FROM v_both JOIN m USING (graph_id) WHERE abs(w) / m > 1e-8),
    tri AS (SELECT a.graph_id, a.i AS node, 2 * sum(pow(a.s * b.s * c.s, 1.0 / 3)) AS t FROM s a JOIN s b ON a.graph_id = b.graph_id AND a.i = b.i AND a.j < b.j
      JOIN s c ON c.graph_id = a.graph_id AND c.i = a.j AND c.j = b.j GROUP BY 1, 2),
    k AS (SELECT graph_id, i AS node, count(*) AS k FROM s GROUP BY 1, 2),
    st AS (SELECT graph_id, i AS node, sum(w) AS strength, sum(abs(w)) AS abs_strength, sum(greatest(w, 0)) AS pos_strength, sum(greatest(-w, 0)) AS neg_strength,
      sum(abs(w)) / 15 AS mean_abs_edge FROM v_both GROUP BY 1, 2)
    SELECT st.*, t / (k * (k - 1)) AS weighted_clustering FROM st JOIN tri USING (graph_id, node) JOIN k USING (graph_id, node)""")
def _(t):
    return gr.node_theory(edges(t), 16)


@query("gra16_eigenvector_centrality", "graph_id:i node:i eigenvector_centrality:d5")
def _(t):
    return gr.node_theory(edges(t), 16)


@query("gra16_centrality_residual", "graph_id:i total:d residual:d3", "SELECT graph_id, 1 AS total, 0 AS residual FROM v_graphs")
def _(t):
    """A node's centrality times the largest eigenvalue equals the weighted sum of its neighbours' centralities."""
    v = gr.node_theory(edges(t), 16).select("graph_id", F.col("node").alias("j"), F.col("eigenvector_centrality").alias("v"))
    s = con.mirror(edges(t)).join(v, ["graph_id", "j"]).groupBy("graph_id", "i").agg(F.sum(F.abs("w") * F.col("v")).alias("s"))
    j = s.join(v.withColumnRenamed("j", "i"), ["graph_id", "i"])
    top = j.groupBy("graph_id").agg((F.sum("s") / F.sum("v")).alias("top"), F.sum("v").alias("total"))
    return j.join(top, "graph_id").groupBy("graph_id").agg(F.max("total").alias("total"), F.max(F.abs(F.col("s") / F.col("top") - F.col("v"))).alias("residual"))


@query("gra17_edge_summary", "graph_id:i edge_mean:d edge_std:d edge_min:d edge_max:d nonzero_ratio:d strength_mean:d strength_std:d strength_min:d strength_max:d degree_mean:d degree_std:d", """
    WITH e AS (SELECT graph_id, avg(w) AS edge_mean, stddev_pop(w) AS edge_std, min(w) AS edge_min, max(w) AS edge_max, avg(CASE WHEN abs(w) > 1e-8 THEN 1.0 ELSE 0 END) AS nonzero_ratio FROM v_edges GROUP BY 1),
    s AS (SELECT graph_id, i, sum(w) AS s, count(*) FILTER (WHERE abs(w) > 1e-8) AS d FROM v_both GROUP BY 1, 2)
    SELECT e.*, u.* EXCLUDE (graph_id) FROM e JOIN (SELECT graph_id, avg(s) AS strength_mean, stddev_pop(s) AS strength_std, min(s) AS strength_min, max(s) AS strength_max,
      avg(d) AS degree_mean, stddev_pop(d) AS degree_std FROM s GROUP BY 1) u USING (graph_id)""")
def _(t):
    return gr.edge_summary(edges(t), 16)


@query("gra17_feature_summary", "graph_id:i feature:i mean:d std:d min:d max:d", "SELECT graph_id, feature, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM v_nodes GROUP BY 1, 2")
def _(t):
    return gr.feature_summary(t.nodes)


# graphs of strong edges only: with nodes without an edge, and graphs without any
STRONG = "0.6"
_SE = f"(SELECT * FROM v_edges WHERE abs(w) >= {STRONG})"
_SB = f"(SELECT * FROM v_both WHERE abs(w) >= {STRONG})"
_FULL = f"""(SELECT g.graph_id, a.n AS i, b.n AS j, coalesce(e.w, 0) AS w FROM v_graphs g CROSS JOIN range(16) a(n) CROSS JOIN range(16) b(n)
    LEFT JOIN {_SB} e ON e.graph_id = g.graph_id AND e.i = a.n AND e.j = b.n WHERE a.n <> b.n)"""


def strong(t):
    return gr.threshold_topology(edges(t), float(STRONG))


def all_graphs(t):
    return t.graphs.select("graph_id")


@query("gra15_normalize_isolated", _E, f"""
    WITH a AS (SELECT graph_id, i, j, w FROM {_SB} UNION ALL SELECT DISTINCT graph_id, node, node, 1.0 FROM v_nodes),
    d AS (SELECT graph_id, i AS n, greatest(sum(abs(w)), 1e-8) AS d FROM a GROUP BY 1, 2)
    SELECT a.graph_id, a.i, a.j, w / sqrt(p.d * q.d) AS w FROM a JOIN d p ON p.graph_id = a.graph_id AND p.n = a.i JOIN d q ON q.graph_id = a.graph_id AND q.n = a.j""")
def _(t):
    return gr.symmetric_normalize(strong(t), nodes=t.nodes.select("graph_id", "node"), abs_degree=True)


@query("gra16_theory_isolated", "graph_id:i node:i strength:d abs_strength:d pos_strength:d neg_strength:d mean_abs_edge:d weighted_clustering:d", f"""
    WITH m AS (SELECT graph_id, max(abs(w)) AS m FROM {_SE} GROUP BY 1),
    s AS (SELECT graph_id, i, j, abs(w) / m AS s FROM {_SB} JOIN m USING (graph_id) WHERE abs(w) / m > 1e-8),
    tri AS (SELECT a.graph_id, a.i AS node, 2 * sum(pow(a.s * b.s * c.s, 1.0 / 3)) AS t FROM s a JOIN s b ON a.graph_id = b.graph_id AND a.i = b.i AND a.j < b.j
      JOIN s c ON c.graph_id = a.graph_id AND c.i = a.j AND c.j = b.j GROUP BY 1, 2),
    k AS (SELECT graph_id, i AS node, count(*) AS k FROM s GROUP BY 1, 2),
    st AS (SELECT graph_id, i AS node, sum(w) AS strength, sum(abs(w)) AS abs_strength, sum(greatest(w, 0)) AS pos_strength, sum(greatest(-w, 0)) AS neg_strength,
      sum(abs(w)) / 15 AS mean_abs_edge FROM {_FULL} GROUP BY 1, 2)
    SELECT st.*, coalesce(t / (k * (k - 1)), 0) AS weighted_clustering FROM st LEFT JOIN tri USING (graph_id, node) LEFT JOIN k USING (graph_id, node)""")
def _(t):
    return gr.node_theory(strong(t), 16, all_graphs(t))


@query("gra17_edges_isolated", "graph_id:i edge_mean:d edge_std:d edge_min:d edge_max:d nonzero_ratio:d strength_mean:d strength_std:d strength_min:d strength_max:d degree_mean:d degree_std:d", f"""
    WITH f AS {_FULL},
    e AS (SELECT graph_id, avg(w) AS edge_mean, stddev_pop(w) AS edge_std, min(w) AS edge_min, max(w) AS edge_max, avg(CASE WHEN abs(w) > 1e-8 THEN 1.0 ELSE 0 END) AS nonzero_ratio FROM f GROUP BY 1),
    s AS (SELECT graph_id, i, sum(w) AS s, count(*) FILTER (WHERE abs(w) > 1e-8) AS d FROM f GROUP BY 1, 2)
    SELECT e.*, u.* EXCLUDE (graph_id) FROM e JOIN (SELECT graph_id, avg(s) AS strength_mean, stddev_pop(s) AS strength_std, min(s) AS strength_min, max(s) AS strength_max,
      avg(d) AS degree_mean, stddev_pop(d) AS degree_std FROM s GROUP BY 1) u USING (graph_id)""")
def _(t):
    return gr.edge_summary(strong(t), 16, all_graphs(t))


@query("gra17_eigen_isolated", "graph_id:i trace_share:d square_sum:d", f"""
    SELECT graph_id, 0 AS trace_share, sum(w * w) / 16 AS square_sum FROM {_FULL} GROUP BY 1""")
def _(t):
    """The eigenvalues' mean is the trace and their mean square the squared entries, each over the number of nodes."""
    e = gr.eigen_summary(strong(t), 16, all_graphs(t))
    return e.select("graph_id", F.col("eig_mean").alias("trace_share"), (F.col("eig_std") ** 2 + F.col("eig_mean") ** 2).alias("square_sum"))


@query("gra18_cross_isolated", "graph_id:i n_cross:i", f"""
    SELECT g.graph_id, count(e.i) FILTER (WHERE e.i // 4 = 0 AND e.j // 4 = 3) AS n_cross FROM v_graphs g LEFT JOIN {_SE} e ON e.graph_id = g.graph_id GROUP BY 1""")
def _(t):
    m = t.nodes.select("node", F.floor(F.col("node") / 4).cast("int").alias("region")).distinct()
    return gr.cross_region_count(strong(t), m, 0, 3, graphs=all_graphs(t))


@query("gra18_paths_isolated", "graph_id:i density:d connected_or_null:i", f"""
    SELECT g.graph_id, count(e.i) / 120 AS density, 1 AS connected_or_null FROM v_graphs g LEFT JOIN {_SE} e ON e.graph_id = g.graph_id GROUP BY 1""")
def _(t):
    """Density of every graph; a mean path is there only where the efficiency is above 0."""
    p = gr.path_metrics(strong(t), 16, graphs=all_graphs(t))
    return p.select("graph_id", "density", F.when(F.col("path_length").isNull() | (F.col("efficiency") > 0), 1).otherwise(0).alias("connected_or_null"))


@query("gra21_stability_isolated", "subject_id:i segment_id:i next_segment:i jaccard:d", f"""
    WITH g AS (SELECT subject_id, segment_id, i, j FROM {_SE}),
    c AS (SELECT s.subject_id, s.segment_id, count(g.i) AS n FROM v_graphs s LEFT JOIN g ON g.subject_id = s.subject_id AND g.segment_id = s.segment_id GROUP BY 1, 2),
    k AS (SELECT a.subject_id, a.segment_id, count(*) AS k FROM g a JOIN g b ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 AND a.i = b.i AND a.j = b.j GROUP BY 1, 2)
    SELECT a.subject_id, a.segment_id, b.segment_id AS next_segment, coalesce(k, 0) / greatest(a.n + b.n - coalesce(k, 0), 1) AS jaccard FROM c a JOIN c b
      ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 LEFT JOIN k ON k.subject_id = a.subject_id AND k.segment_id = a.segment_id""")
def _(t):
    return gr.consecutive_stability(gr.threshold_topology(t.edges, float(STRONG)), segments=t.graphs.select("subject_id", "segment_id"))


@query("gra29_density_isolated", "graph_id:i nnz:i density:d sparsity:d", f"""
    SELECT g.graph_id, 2 * count(e.i) AS nnz, 2 * count(e.i) / 256 AS density, 1 - 2 * count(e.i) / 256 AS sparsity FROM v_graphs g LEFT JOIN {_SE} e ON e.graph_id = g.graph_id GROUP BY 1""")
def _(t):
    return gr.density(strong(t), 16, graphs=all_graphs(t))


@query("gra17_eigen_summary", "graph_id:i eig_1:d5 eig_2:d5 eig_mean:d5 eig_std:d5 eig_min:d5")
def _(t):
    return gr.eigen_summary(edges(t), 16)


def paths_sql(src, n=16):
    """CTE text d0..dn of unweighted distances for edge rows (subject_id, i, j) of ``src`` (both directions)."""
    out = [f"""d0 AS MATERIALIZED (SELECT s.subject_id, a.n AS i, b.n AS j, CASE WHEN a.n = b.n THEN 0 WHEN e.i IS NOT NULL THEN 1 ELSE 1e9 END AS d
      FROM (SELECT DISTINCT subject_id FROM {src}) s, range({n}) a(n), range({n}) b(n) LEFT JOIN {src} e ON e.subject_id = s.subject_id AND e.i = a.n AND e.j = b.n)"""]
    for k in range(n):
        out.append(f"""d{k + 1} AS MATERIALIZED (SELECT a.subject_id, a.i, a.j, least(a.d, p.d + q.d) AS d FROM d{k} a
          JOIN d{k} p ON p.subject_id = a.subject_id AND p.i = a.i AND p.j = {k} JOIN d{k} q ON q.subject_id = a.subject_id AND q.i = {k} AND q.j = a.j)""")
    return ", ".join(out)


_BONE = "(SELECT subject_id, i, j FROM v_both WHERE segment_id = 0 AND abs(w) >= 0.4)"


@query("gra18_class_topology", "subject_id:i efficiency:d path_length:d density:d", f"""
    WITH bone AS {_BONE}, {paths_sql('bone')}
    SELECT subject_id, avg(CASE WHEN d < 1e8 THEN 1.0 / d ELSE 0 END) AS efficiency, CASE WHEN max(d) < 1e8 THEN avg(d) END AS path_length, avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) AS density
    FROM d16 WHERE i <> j GROUP BY 1""")
def _(t):
    first = t.edges.filter("segment_id = 0").filter("abs(w) >= 0.4")
    return gr.path_metrics(first, 16, ["subject_id"])


@query("gra18_backbone_weights", "subject_id:i i:i j:i w:d", f"""
    SELECT subject_id, i, j, avg(w) AS w FROM v_edges WHERE (subject_id, i, j) IN (SELECT (subject_id, i, j) FROM {_BONE}) AND abs(w) >= 0.4 GROUP BY 1, 2, 3""")
def _(t):
    return gr.backbone(gr.threshold_topology(t.edges, 0.4))


@query("gra18_cross_region_edges", "graph_id:i n_cross:i", """
    SELECT graph_id, count(*) FILTER (WHERE i // 4 = 0 AND j // 4 = 3) AS n_cross FROM v_edges WHERE abs(w) >= 0.4 GROUP BY 1""")
def _(t):
    m = t.nodes.select("node", F.floor(F.col("node") / 4).cast("int").alias("region")).distinct()
    return gr.cross_region_count(gr.threshold_topology(edges(t), 0.4), m, 0, 3)


@query("gra19_edge_frequency", "label:i i:i j:i count:i frequency:d", """
    SELECT label, i, j, count(DISTINCT graph_id) AS count, count(DISTINCT graph_id) / min(n) AS frequency FROM v_edges JOIN (SELECT label, count(*) AS n FROM v_graphs GROUP BY 1) USING (label)
    WHERE abs(w) >= 0.4 GROUP BY 1, 2, 3""")
def _(t):
    return gr.edge_frequency(gr.threshold_topology(t.edges, 0.4), t.graphs)


_SES = """(SELECT label, subject_id, i, j, count(*) / min(n) AS freq, avg(w) AS mu, stddev_pop(w) AS sd FROM v_edges JOIN (SELECT subject_id, count(*) AS n FROM v_graphs GROUP BY 1) USING (subject_id)
    WHERE abs(w) >= 0.4 AND w <> 0 GROUP BY 1, 2, 3, 4)"""
_CES = f"(SELECT label, i, j, avg(freq) AS freq, avg(mu) AS mu, avg(sd) AS sd FROM {_SES} GROUP BY 1, 2, 3)"


@query("gra20_subject_edge_stats", "subject_id:i i:i j:i freq:d mu:d sd:d", f"SELECT * FROM {_SES}")
def _(t):
    return gr.subject_edge_stats(gr.threshold_topology(t.edges, 0.4), t.graphs)


@query("gra20_edge_ranking", "class_a:i class_b:i i:i j:i score:d rank:i", f"""
    SELECT *, row_number() OVER (PARTITION BY class_a, class_b ORDER BY score DESC, i, j) AS rank FROM (
      SELECT a.label AS class_a, b.label AS class_b, a.i, a.j, abs(a.mu - b.mu) / (a.sd + b.sd + 1e-8) * ln(1 + a.freq + b.freq) AS score
      FROM {_CES} a JOIN {_CES} b ON a.i = b.i AND a.j = b.j AND a.label < b.label)""")
def _(t):
    return gr.rank_edges(gr.class_edge_stats(gr.subject_edge_stats(gr.threshold_topology(t.edges, 0.4), t.graphs)))


_STAB = """WITH g AS (SELECT subject_id, segment_id, i, j FROM v_edges WHERE abs(w) >= 0.4),
    c AS (SELECT subject_id, segment_id, count(*) AS n FROM g GROUP BY 1, 2),
    k AS (SELECT a.subject_id, a.segment_id, count(*) AS k FROM g a JOIN g b ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 AND a.i = b.i AND a.j = b.j GROUP BY 1, 2)
    SELECT a.subject_id, a.segment_id, b.segment_id AS next_segment, coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) AS jaccard FROM c a JOIN c b
      ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 LEFT JOIN k ON k.subject_id = a.subject_id AND k.segment_id = a.segment_id"""


@query("gra21_topology_stability", "subject_id:i segment_id:i next_segment:i jaccard:d", _STAB)
def _(t):
    return gr.consecutive_stability(gr.threshold_topology(t.edges, 0.4))


_WSTAB = """SELECT a.subject_id, a.segment_id, b.segment_id AS next_segment, corr(a.w, b.w) AS weight_corr FROM v_edges a JOIN v_edges b
      ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 AND a.i = b.i AND a.j = b.j GROUP BY 1, 2, 3"""


@query("gra21_weight_stability", "subject_id:i segment_id:i next_segment:i weight_corr:d", _WSTAB)
def _(t):
    return gr.consecutive_stability(t.edges)


@query("gra21_stability_report", "corr_mean:d corr_std:d n_corr:i", f"SELECT avg(weight_corr) AS corr_mean, stddev_pop(weight_corr) AS corr_std, count(*) AS n_corr FROM ({_WSTAB})")
def _(t):
    return gr.stability_report(gr.consecutive_stability(t.edges))


_MEMW = f"(SELECT *, 1.0 + region AS q FROM {MEM})"


@query("gra22_hypergraph_scores", "graph_id:i within_similarity:d smoothness:d consistency:d contrast:d", f"""
    WITH m AS {_MEMW}, n AS (SELECT graph_id, region, q, node, feature, x FROM v_nodes JOIN m USING (node)),
    c AS (SELECT graph_id, region, q, feature, avg(x) AS mu, var_pop(x) AS v FROM n GROUP BY 1, 2, 3, 4),
    r AS (SELECT graph_id, region, q, sum(v) AS sp FROM c GROUP BY 1, 2, 3),
    sm AS (SELECT graph_id, sum(q / (1 + sp)) / sum(q) AS smoothness, sum(q * sp) / sum(q) AS wi FROM r GROUP BY 1),
    b AS (SELECT graph_id, sum(qq * d) / sum(qq) AS bt FROM (SELECT a.graph_id, a.region, b.region AS r2, min(a.q + b.q) / 2 AS qq, sum(pow(a.mu - b.mu, 2)) AS d
      FROM c a JOIN c b ON a.graph_id = b.graph_id AND a.feature = b.feature AND a.region < b.region GROUP BY 1, 2, 3) GROUP BY 1),
    w AS (SELECT graph_id, sum(q * s) / sum(q) AS within_similarity FROM (SELECT graph_id, a.region, a.q, avg(w) AS s FROM v_edges JOIN m a ON a.node = i JOIN m b ON b.node = j AND a.region = b.region
      GROUP BY 1, 2, 3) GROUP BY 1),
    k AS (SELECT graph_id, sum(q * s) / sum(q) AS consistency FROM (SELECT n.graph_id, n.region, n.q, n.node, sum(x * mu) / (sqrt(sum(x * x)) * sqrt(sum(mu * mu))) AS s
      FROM n JOIN c ON c.graph_id = n.graph_id AND c.region = n.region AND c.feature = n.feature GROUP BY 1, 2, 3, 4) GROUP BY 1)
    SELECT sm.graph_id, within_similarity, smoothness, consistency, ln(1 + bt / (wi + 1e-8)) AS contrast FROM sm JOIN b USING (graph_id) JOIN w USING (graph_id) JOIN k USING (graph_id)""")
def _(t):
    return gr.hyper_scores(t.graphs, members(t))


_PSEUDO = """(WITH e AS (SELECT e.graph_id, e.i, e.j, e.w, sum(a.x * b.x) AS dp, sum(CASE WHEN a.feature < 2 THEN pow(a.x - b.x, 2) ELSE 0 END) AS d1, sum(CASE WHEN a.feature >= 2 THEN pow(a.x - b.x, 2) ELSE 0 END) AS d2
      FROM v_edges e JOIN v_nodes a ON a.graph_id = e.graph_id AND a.node = e.i JOIN v_nodes b ON b.graph_id = e.graph_id AND b.node = e.j AND a.feature = b.feature GROUP BY 1, 2, 3, 4),
    s AS (SELECT graph_id, 2 * sum(w / (1 + exp(-dp / 2))) / (2 * sum(abs(w)) + 1e-8) AS nonlinear, (sum(w * d1) - sum(w * d2)) / (2 * sum(abs(w)) + 1e-8) AS dirichlet FROM e GROUP BY 1),
    mo AS (SELECT graph_id, i AS node FROM (SELECT graph_id, i, row_number() OVER (PARTITION BY graph_id ORDER BY sum(w) DESC, i) AS r FROM v_both GROUP BY 1, 2) WHERE r <= 4),
    it AS (SELECT e.graph_id, 2 * sum(w * tanh(dp / 2)) / (2 * sum(abs(w)) + 1e-8) AS v FROM e JOIN mo a ON a.graph_id = e.graph_id AND a.node = e.i JOIN mo b ON b.graph_id = e.graph_id AND b.node = e.j GROUP BY 1),
    ct AS (SELECT graph_id, avg(pow(p - q, 2)) AS v FROM (SELECT n.graph_id, feature, avg(CASE WHEN mo.node IS NOT NULL THEN x END) AS p, avg(CASE WHEN mo.node IS NULL THEN x END) AS q
      FROM v_nodes n LEFT JOIN mo ON mo.graph_id = n.graph_id AND mo.node = n.node GROUP BY 1, 2) GROUP BY 1)
    SELECT s.*, it.v + 0.5 * ct.v AS motif FROM s JOIN it USING (graph_id) JOIN ct USING (graph_id))"""


@query("gra23_pseudo_scores", "graph_id:i nonlinear:d dirichlet:d motif:d", f"SELECT * FROM {_PSEUDO}")
def _(t):
    return gr.pseudo_scores(edges(t), t.graphs)


def _scored(t):
    return t.edges.groupBy("subject_id", "segment_id").agg(F.avg("w").alias("fake_score"))


_FS = "(SELECT subject_id, segment_id, avg(w) AS s FROM v_edges GROUP BY 1, 2)"
_THIRD = "(SELECT *, CASE WHEN score < quantile_cont(score, 1.0 / 3) OVER () THEN 0 WHEN score < quantile_cont(score, 2.0 / 3) OVER () THEN 1 ELSE 2 END AS fake_label FROM ({}))"


@query("gra24_quantile_labels", "subject_id:i score:d fake_label:i", f"SELECT * FROM {_THIRD.format(f'SELECT subject_id, avg(s) AS score FROM {_FS} GROUP BY 1')}")
def _(t):
    return gr.quantile_labels(gr.subject_scores(_scored(t), "fake_score"))


@query("gra24_topk_mean_binary", "subject_id:i score:d fake_label:i", f"""
    SELECT *, CASE WHEN score > quantile_cont(score, 0.5) OVER () THEN 1 ELSE 0 END AS fake_label FROM (SELECT subject_id, avg(s) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY s DESC) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY subject_id) * 0.3)) AS k FROM {_FS}) WHERE r <= k GROUP BY 1)""")
def _(t):
    return gr.quantile_labels(gr.subject_scores(_scored(t), "fake_score", "topk_mean"), 2)


@query("gra24_labels_on_segments", "graph_id:i fake_label:i", f"""
    SELECT graph_id, fake_label FROM v_graphs JOIN {_THIRD.format(f'SELECT subject_id, quantile_cont(s, 0.5) AS score FROM {_FS} GROUP BY 1')} USING (subject_id)""")
def _(t):
    return t.graphs.join(gr.quantile_labels(gr.subject_scores(_scored(t), "fake_score", "median")), "subject_id")


@query("gra25_region_features", "graph_id:i region:i feature:i mean:d std:d", f"SELECT graph_id, region, feature, avg(x) AS mean, stddev_pop(x) AS std FROM v_nodes JOIN {MEM} USING (node) GROUP BY 1, 2, 3")
def _(t):
    return gr.region_features(t.nodes, members(t), std=True)


@query("gra25_region_vector", "graph_id:i pos:i v:d", f"""
    WITH r AS (SELECT graph_id, region, feature, avg(x) AS mean, stddev_pop(x) AS std FROM v_nodes JOIN {MEM} USING (node) GROUP BY 1, 2, 3)
    SELECT graph_id, node * 4 + feature AS pos, x AS v FROM v_nodes UNION ALL SELECT graph_id, 64 + region * 8 + feature, mean FROM r UNION ALL SELECT graph_id, 68 + region * 8 + feature, std FROM r""")
def _(t):
    return gr.region_vector(t.nodes, members(t).drop("weight"), "legacy").select("graph_id", F.posexplode("vector").alias("pos", "v"))


@query("gra26_shuffled_weights", _E, f"""
    SELECT a.graph_id, a.i, a.j, b.w FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY i, j) AS r FROM v_edges) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {_MD5.format('11, graph_id, i, j')}) AS r FROM v_edges) b ON a.graph_id = b.graph_id AND a.r = b.r""")
def _(t):
    return gr.shuffle_weights(edges(t), 11)


@query("gra26_permuted_edges", _E, f"""
    WITH p AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY {_MD5.format('12, graph_id, node')}) - 1 AS nn FROM (SELECT DISTINCT graph_id, node FROM v_nodes))
    SELECT e.graph_id, least(a.nn, b.nn) AS i, greatest(a.nn, b.nn) AS j, w FROM v_edges e JOIN p a ON a.graph_id = e.graph_id AND a.node = i JOIN p b ON b.graph_id = e.graph_id AND b.node = j""")
def _(t):
    return gr.permute_edges(edges(t), gr.node_permutation(t.graphs, 12, 16))


@query("gra27_feature_topology", _E, f"""
    WITH z AS (SELECT graph_id, node, feature, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM v_nodes WINDOW w AS (PARTITION BY graph_id, feature)),
    e AS (SELECT a.graph_id, a.node AS i, b.node AS j, greatest((sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) + 1) / 2, 0) AS w
      FROM z a JOIN z b ON a.graph_id = b.graph_id AND a.feature = b.feature AND a.node <> b.node GROUP BY 1, 2, 3)
    SELECT graph_id, i, j, max(w) AS w FROM ({topk_sql(3, src='e')}) GROUP BY 1, 2, 3""")
def _(t):
    return gr.feature_topology(t.graphs, "topk", k=3, zscore_nodes=True, rescale=True, clip_negative=True)


@query("gra28_shared_electrodes", "p_size:i a:s b:s", """
    WITH c AS (SELECT DISTINCT p_size, 'F' || (p_partkey % 4) || '-C' || (p_partkey // 4 % 4) AS n FROM part)
    SELECT a.p_size, a.n AS a, b.n AS b FROM c a JOIN c b ON a.p_size = b.p_size AND a.n < b.n AND (split_part(a.n, '-', 1) = split_part(b.n, '-', 1) OR split_part(a.n, '-', 2) = split_part(b.n, '-', 2))""")
def _(t):
    k = F.col("p_partkey")
    ch = t.table("part").select("p_size", F.concat(F.lit("F"), k % 4, F.lit("-C"), F.floor(k / 4) % 4).alias("channel")).distinct()
    return gr.shared_electrode_pairs(ch, ["p_size"])


@query("gra29_density", "graph_id:i nnz:i density:d sparsity:d", "SELECT graph_id, 2 * count(*) AS nnz, 2 * count(*) / 256 AS density, 1 - 2 * count(*) / 256 AS sparsity FROM v_edges WHERE abs(w) >= 0.4 GROUP BY 1")
def _(t):
    return gr.density(gr.threshold_topology(edges(t), 0.4), 16)


@query("gra29_dense_round_trip", _E, "SELECT graph_id, i, j, w FROM v_both WHERE abs(w) >= 0.4")
def _(t):
    e = con.mirror(gr.threshold_topology(edges(t), 0.4))
    return gr.dense_to_edges(gr.edges_to_dense(e, 16))


@query("gra30_region_bank", "graph_id:i cand:i region_a:i region_b:i value:d", f"""
    SELECT graph_id, CASE source WHEN 'cos' THEN 0 ELSE 1 END AS cand, least(i // 4, j // 4) AS region_a, greatest(i // 4, j // 4) AS region_b, avg(w) AS value FROM {_SRC} GROUP BY 1, 2, 3, 4""")
def _(t):
    e = edges(t).withColumn("metric", F.lit("cos")).unionByName(con.feature_similarity(t.graphs, "rbf").withColumn("metric", F.lit("rbf")))
    e = e.withColumn("band", F.lit(None).cast("string")).withColumnRenamed("w", "value")
    return gr.region_bank(e, regions(t).withColumnRenamed("channel", "node"), [("cos", None), ("rbf", None)])


