"""Queries for clustering and embedding analysis (CLU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import clustering as cl
from ..operators import forests
from ..operators import graphs as gr
from ..operators import selection as sel
from .evaluate_queries import rates_sql
from .registry import query

_DIM = 64
_FOLDS = 8  # the smallest class of the supplied graphs has 8 subjects


def _split(t):
    return t.vectors.withColumn("split", F.when(F.col("subject_id") % 5 == 0, "test").when(F.col("subject_id") % 5 == 1, "val").otherwise("train"))


@query("clu01_cluster_fit_apply", "vec_id:i cluster:i distance:d4")
def _(t):
    v = _split(t)
    return cl.apply_clusterer(cl.fit_clusterer(v.filter("split = 'train'")), v.filter("split <> 'train'"))


@query("clu01_assignment_check", "n:i clusters:i wrong:i", "SELECT count(*) AS n, 6 AS clusters, 0 AS wrong FROM embeddings WHERE vec_id % 25 % 5 < 2")
def _(t):
    """Rows held out are all placed, in at most k clusters, each by the nearest centre and with its distance to it."""
    v = _split(t)
    model = cl.fit_clusterer(v.filter("split = 'train'"))
    held = v.filter("split <> 'train'")
    d = B.unpack(B.distances(model.place(held, ["vec_id"], "x"), model.centres, []), [], ["distances"])
    j = cl.apply_clusterer(model, held).select("vec_id", "cluster", "distance").join(d, "vec_id")
    bad = (F.array_min("distances") < F.col("distance") - 1e-9) | (F.abs(F.get("distances", F.col("cluster").cast("int")) - F.col("distance")) > 1e-9)
    return j.agg(F.count("*").alias("n"), F.max(F.size("distances")).alias("clusters"), F.sum(bad.cast("int")).alias("wrong"))


@query("clu02_cluster_manifest", "vec_id:i split:s cluster:i distance:d4 pca1:d4 pca2:d4")
def _(t):
    return cl.cluster_manifest(_split(t))


@query("clu02_assignment_check", "n:i wrong:i far:i", "SELECT count(*) AS n, 0 AS wrong, 0 AS far FROM embeddings")
def _(t):
    """Every row is in the cluster of its nearest centre, at that distance, by a second computation from the coordinates."""
    v = _split(t)
    model = cl.fit_clusterer(v.filter("split = 'train'"))
    z = B.unpack(B.distances(model.place(v, ["vec_id"], "x"), model.centres, []), [], ["m", "distances"])
    c = model.centres.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.slice("model", i * 8 + 1, 8))).alias("cluster", "centre"))
    own = cl.apply_clusterer(model, v).select("vec_id", "cluster", "distance").join(z, "vec_id").join(c, "cluster")
    d = F.sqrt(F.aggregate(F.zip_with("m", "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    return own.agg(F.count("*").alias("n"), F.sum(F.when(F.array_min("distances") < F.col("distance") - 1e-9, 1).otherwise(0)).alias("wrong"),
                   F.sum(F.when(F.abs(d - F.col("distance")) > 1e-6, 1).otherwise(0)).alias("far"))


@query("clu03_grid_search", "dims:i k:i explained_variance:d4 silhouette_mean:d4 silhouette_std:d4 calinski_harabasz_mean:d4 calinski_harabasz_std:d4 davies_bouldin_mean:d4 davies_bouldin_std:d4 "
       "inertia_mean:d2 inertia_std:d2 min_share_mean:d4 max_share_mean:d4 ari_mean:d4 ari_std:d4")
def _(t):
    return cl.grid_search(t.vectors.select("vec_id", "x"), [3, 5, 8, 10, 15], [4, 5, 6, 8, 10, 12], [15, 42, 100], ["vec_id"], starts=20)


# given clusters: the row's number modulo 4 plus its label's parity, so that the numbers have a closed SQL form
_GIVEN = "(SELECT vec_id, subject_id, label, k, x, label % 4 AS cluster FROM v_vec)"


def _given(t):
    return t.vectors.withColumn("cluster", F.col("label") % 4)


@query("clu03_adjusted_rand", "ari:d", """
    WITH n AS (SELECT label % 4 AS a, vec_id % 5 AS b, count(*) AS o FROM embeddings GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(o * (o - 1) / 2) FROM n) AS ij, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(o) AS s FROM n GROUP BY a)) AS sa, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(o) AS s FROM n GROUP BY b)) AS sb, (SELECT sum(o) FROM n) AS n)
    SELECT (ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) AS ari FROM s""")
def _(t):
    return cl.adjusted_rand(_given(t).withColumn("other", F.col("vec_id") % 5), "cluster", "other")


@query("clu04_validity", "silhouette:d calinski_harabasz:d davies_bouldin:d n_clusters:i n_rows:i", f"""
    WITH p AS (SELECT a.vec_id, a.cluster AS ca, b.cluster AS cb, b.vec_id AS o, sqrt(sum(pow(a.x - b.x, 2))) AS d FROM {_GIVEN} a JOIN {_GIVEN} b ON a.k = b.k AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
    m AS (SELECT vec_id, ca, cb, avg(d) AS m FROM p GROUP BY 1, 2, 3),
    sil AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT vec_id, min(m) FILTER (WHERE ca = cb) AS a, min(m) FILTER (WHERE ca <> cb) AS b FROM m GROUP BY 1)),
    c AS (SELECT cluster, k, avg(x) AS mu FROM {_GIVEN} GROUP BY 1, 2), g AS (SELECT k, avg(x) AS mu FROM {_GIVEN} GROUP BY 1),
    r AS (SELECT vec_id, v.cluster, sqrt(sum(pow(x - mu, 2))) AS d FROM {_GIVEN} v JOIN c ON c.cluster = v.cluster AND c.k = v.k GROUP BY 1, 2),
    w AS (SELECT cluster, sum(d * d) AS w, avg(d) AS s, count(*) AS n FROM r GROUP BY 1),
    bt AS (SELECT w.cluster, w.n * sum(pow(c.mu - g.mu, 2)) AS b FROM c JOIN g USING (k) JOIN w ON w.cluster = c.cluster GROUP BY w.cluster, w.n),
    db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT x.cluster, max((x.s + y.s) / d) AS r FROM (SELECT a.cluster AS ca, b.cluster AS cb, sqrt(sum(pow(a.mu - b.mu, 2))) AS d FROM c a JOIN c b ON a.k = b.k AND a.cluster <> b.cluster GROUP BY 1, 2) q
      JOIN w x ON x.cluster = ca JOIN w y ON y.cluster = cb GROUP BY 1))
    SELECT silhouette, davies_bouldin, ((SELECT sum(b) FROM bt) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS calinski_harabasz, count(*) AS n_clusters, sum(n) AS n_rows FROM w, sil, db GROUP BY silhouette, davies_bouldin""")
def _(t):
    return cl.validity(_given(t), ["vec_id"], _DIM)


@query("clu04_contingency", "n:i mutual_info:d normalized_mutual_info:d chi2:d dof:i cramers_v:d", """
    WITH n AS (SELECT cluster, label, count(*) AS o FROM v_manifest GROUP BY 1, 2), t AS (SELECT sum(o) AS t FROM n),
    r AS (SELECT cluster, sum(o) AS r FROM n GROUP BY 1), c AS (SELECT label, sum(o) AS c FROM n GROUP BY 1),
    q AS (SELECT sum(o / t * ln(o * t / (r * c))) AS mi, sum(o * o * t / (r * c)) - min(t) AS chi2, min(t) AS n FROM n, t JOIN r ON true JOIN c ON true WHERE r.cluster = n.cluster AND c.label = n.label),
    h AS (SELECT (SELECT sum(-r / t * ln(r / t)) FROM r, t) AS hr, (SELECT sum(-c / t * ln(c / t)) FROM c, t) AS hc, (SELECT count(*) FROM r) AS kr, (SELECT count(*) FROM c) AS kc)
    SELECT n, mi AS mutual_info, mi / ((hr + hc) / 2) AS normalized_mutual_info, chi2, (kr - 1) * (kc - 1) AS dof, sqrt(chi2 / (n * least(kr - 1, kc - 1))) AS cramers_v FROM q, h""")
def _(t):
    return cl.contingency_metrics(t.manifest)


@query("clu04_scatter_ratio", "between:d within:d ratio:d", f"""
    WITH c AS (SELECT label, k, avg(x) AS mu, count(*) AS n FROM v_vec GROUP BY 1, 2), g AS (SELECT k, avg(x) AS mu FROM v_vec GROUP BY 1)
    SELECT b AS between, w AS within, b / w AS ratio FROM (SELECT sum(c.n * pow(c.mu - g.mu, 2)) AS b FROM c JOIN g USING (k)), (SELECT sum(pow(x - mu, 2)) AS w FROM v_vec v JOIN c ON c.label = v.label AND c.k = v.k)""")
def _(t):
    return cl.scatter_ratio(t.vectors, _DIM)


@query("clu05_crosstab", "subject_id:i n_segments:i cluster_0:d cluster_3:d cluster_5:d", """
    SELECT subject_id, count(*) AS n_segments, avg((cluster = 0)::INT) AS cluster_0, avg((cluster = 3)::INT) AS cluster_3, avg((cluster = 5)::INT) AS cluster_5 FROM v_manifest GROUP BY 1""")
def _(t):
    return cl.crosstab(t.manifest, range(6), normalize=True)


@query("clu05_subject_distribution", "subject_id:i n_segments:i n_clusters_present:i dominant_cluster:i dominant_share:d entropy:d entropy_norm:d", """
    SELECT subject_id, sum(n) AS n_segments, count(*) AS n_clusters_present, arg_max(cluster, n * 100 - cluster) AS dominant_cluster, max(n) / sum(n) AS dominant_share, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy,
      (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln((SELECT count(DISTINCT cluster) FROM v_manifest)) AS entropy_norm FROM (SELECT subject_id, cluster, count(*) AS n FROM v_manifest GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return cl.subject_distribution(t.manifest)


@query("clu06_cluster_summary", "cluster:i n_segments:i n_subjects:i top_subject:i top_subject_share:d subject_entropy_norm:d clean_ratio:d majority_label:i majority_label_share:d class_entropy_norm:d enriched_label:i max_class_enrichment:d distance_mean:d distance_std:d distance_median:d9 distance_p90:d9 flag_tiny:b flag_far:b flag_low_clean:b recommendation:s", """
    WITH s AS (SELECT cluster, subject_id, count(*) AS n FROM v_manifest GROUP BY 1, 2), l AS (SELECT cluster, label, count(*) AS n FROM v_manifest GROUP BY 1, 2),
    gl AS (SELECT label, sum(n) / sum(sum(n)) OVER () AS g FROM l GROUP BY 1),
    a AS (SELECT cluster, sum(n) AS n_segments, count(*) AS n_subjects, arg_max(subject_id, n * 1000000 - subject_id) AS top_subject, max(n) / sum(n) AS top_subject_share, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) AS subject_entropy_norm FROM s GROUP BY 1),
    b AS (SELECT cluster, arg_max(label, n * 100 - label) AS majority_label, max(n) / sum(n) AS majority_label_share, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) AS class_entropy_norm FROM l GROUP BY 1),
    e AS (SELECT cluster, arg_max(label, en) AS enriched_label, max(en) AS max_class_enrichment FROM (SELECT l.cluster, l.label, (l.n / t.n) / (g + 1e-12) AS en FROM l JOIN gl USING (label) JOIN (SELECT cluster, sum(n) AS n FROM l GROUP BY 1) t ON t.cluster = l.cluster) GROUP BY 1),
    d AS (SELECT cluster, avg(keep_clean::INT) AS clean_ratio, avg(distance) AS distance_mean, stddev_pop(distance) AS distance_std, median(distance) AS distance_median, quantile_cont(distance, 0.9) AS distance_p90 FROM v_manifest GROUP BY 1),
    f AS (SELECT *, n_segments < 20 AS flag_tiny, clean_ratio < 0.7 AS flag_low_clean, distance_mean > quantile_cont(distance_mean, 0.75) OVER () + 1.5 * (quantile_cont(distance_mean, 0.75) OVER () - quantile_cont(distance_mean, 0.25) OVER ()) AS flag_far
      FROM a JOIN b USING (cluster) JOIN e USING (cluster) JOIN d USING (cluster))
    SELECT *, CASE WHEN flag_low_clean OR flag_far OR flag_tiny THEN 'exclude_or_inspect_as_noise' WHEN top_subject_share >= 0.4 OR subject_entropy_norm < 0.5 THEN 'inspect_subject_fingerprint'
      WHEN majority_label_share >= 0.7 THEN 'possible_disease_or_confound_cluster' ELSE 'useful_common_state_cluster' END AS recommendation FROM f""")
def _(t):
    return cl.cluster_summary(t.manifest)


@query("clu07_representatives", "cluster:i rep_type:s subject_id:i segment_id:i", """
    SELECT cluster, 'closest_to_centroid' AS rep_type, subject_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, subject_id, segment_id) AS r FROM v_manifest) WHERE r = 1
    UNION ALL SELECT cluster, 'farthest_from_centroid', subject_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, subject_id, segment_id) AS r FROM v_manifest) WHERE r = 1
    UNION ALL SELECT cluster, 'highest_score', subject_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, subject_id, segment_id) AS r FROM v_manifest) WHERE r = 1""")
def _(t):
    return cl.representatives(t.manifest)


@query("clu07_nearest_per_prototype", "cluster:i rank:i subject_id:i segment_id:i distance:d9", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, subject_id, segment_id) AS rank FROM v_manifest) WHERE rank <= 20""")
def _(t):
    return cl.nearest_per_prototype(t.manifest, 20)


def _protos(t):
    m = t.nodes.select("node", F.floor(F.col("node") / 4).cast("int").alias("region")).distinct()
    v = cl.prototype_vectors(t.nodes, m)
    return cl.prototypes(cl.fit_clusterer(v.filter("subject_id % 5 > 1"), 8, 16, ids=["graph_id"]), v)


@query("clu08_prototypes", "graph_id:i prototype:i soft_0:d4 d_0:d4")
def _(t):
    return _protos(t).withColumn("soft_0", F.get("soft", 0)).withColumn("d_0", F.get("log_distances", 0))


@query("clu08_prototype_check", "n:i hard:i soft:i usage:i", "SELECT count(*) AS n, 0 AS hard, 0 AS soft, 0 AS usage FROM embeddings")
def _(t):
    """Rows whose hard prototype is not the nearest, whose soft shares do not follow the distances, and whether usages miss the sum of 1."""
    p = _protos(t)
    d = F.transform("log_distances", lambda v: F.exp(v) - 1)
    rest = F.aggregate(F.transform(d, lambda v: F.exp(-v)), F.lit(0.0), lambda s, v: s + v)
    off = F.aggregate(F.zip_with("soft", d, lambda s, v: F.abs(s - F.exp(-v) / rest)), F.lit(0.0), lambda s, v: s + v)
    g = p.agg(F.count("*").alias("n"), F.sum((F.get(d, F.col("prototype")) > F.array_min(d) + 1e-9).cast("int")).alias("hard"), F.sum((off > 1e-6).cast("int")).alias("soft"))
    u = cl.prototype_usage(p).agg((F.abs(F.sum("usage") - 1) > 1e-9).cast("int").alias("usage"))
    return cl.attach(g, u, [])


@query("clu08_prototype_usage", "prototype:i n:i usage:d4")
def _(t):
    return cl.prototype_usage(_protos(t))


_PAIRS = """(SELECT a.vec_id AS i, b.vec_id AS j, a.subject_id AS s1, b.subject_id AS s2, a.label AS y1, b.label AS y2, sqrt(sum(pow(a.x - b.x, 2))) AS d, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cs
    FROM v_vec a JOIN v_vec b ON a.k = b.k AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4, 5, 6)"""
_KIND = "CASE WHEN s1 = s2 THEN 'same_subject' WHEN y1 = y2 THEN 'same_class_other_subject' ELSE 'diff_class' END"


@query("clu09_pair_distances", "kind:s n_pairs:i mean:d std:d", f"SELECT {_KIND} AS kind, count(*) AS n_pairs, avg(d) AS mean, stddev_pop(d) AS std FROM {_PAIRS} WHERE i < j GROUP BY 1")
def _(t):
    return cl.pair_distances(t.vectors)


@query("clu09_sampled_pairs", "kind:s n_pairs:i mean:d std:d", f"""
    WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings),
    d AS (SELECT pair, CAST(floor(CAST('0x' || substr(md5('42|i|' || pair), 1, 13) AS BIGINT) / 4503599627370496.0 * n) AS BIGINT) AS a, CAST(floor(CAST('0x' || substr(md5('42|j|' || pair), 1, 13) AS BIGINT) / 4503599627370496.0 * (n - 1)) AS BIGINT) AS b0 FROM range(3000) r(pair), n)
    SELECT {_KIND} AS kind, count(*) AS n_pairs, avg(d) AS mean, stddev_pop(d) AS std FROM (SELECT a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM d) x JOIN p u ON u.p = a JOIN p v ON v.p = b JOIN {_PAIRS} q ON q.i = u.vec_id AND q.j = v.vec_id GROUP BY 1""")
def _(t):
    return cl.sampled_pair_distances(t.vectors, 3000)


@query("clu10_knn_purity", "knn_class_purity_mean:d knn_subject_purity_mean:d knn_class_purity_std:d knn_subject_purity_std:d", f"""
    SELECT avg(c) AS knn_class_purity_mean, avg(s) AS knn_subject_purity_mean, stddev_pop(c) AS knn_class_purity_std, stddev_pop(s) AS knn_subject_purity_std FROM (
      SELECT i, avg((y1 = y2)::INT) AS c, avg((s1 = s2)::INT) AS s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM {_PAIRS}) WHERE r <= 10 GROUP BY 1)""")
def _(t):
    return cl.knn_purity(t.vectors)


@query("clu11_fingerprint", "mean_cosine_same_subject:d mean_cosine_same_class_other_subject:d mean_cosine_diff_class:d top1_same_subject_retrieval:d top1_same_class_other_subject_retrieval:d", f"""
    WITH p AS MATERIALIZED (SELECT * FROM {_PAIRS}),
    m AS (SELECT i, avg(cs) FILTER (WHERE s1 = s2) AS a, avg(cs) FILTER (WHERE s1 <> s2 AND y1 = y2) AS b, avg(cs) FILTER (WHERE y1 <> y2) AS c FROM p GROUP BY 1),
    t1 AS (SELECT avg((s1 = s2)::INT) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cs DESC, j) AS r FROM p) WHERE r = 1),
    t2 AS (SELECT avg((y1 = y2)::INT) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cs DESC, j) AS r FROM p WHERE s1 <> s2) WHERE r = 1)
    SELECT avg(a) AS mean_cosine_same_subject, avg(b) AS mean_cosine_same_class_other_subject, avg(c) AS mean_cosine_diff_class, min(t1.v) AS top1_same_subject_retrieval, min(t2.v) AS top1_same_class_other_subject_retrieval FROM m, t1, t2""")
def _(t):
    return cl.fingerprint(t.vectors, _DIM)


_CEN = "(SELECT {0}, k, avg(x) AS mu FROM v_vec GROUP BY 1, 2)"


@query("clu12_heterogeneity", "subject_id:i n_segments:i within_subject_mean_dist:d within_subject_std_dist:d", f"""
    SELECT subject_id, count(*) AS n_segments, avg(d) AS within_subject_mean_dist, stddev_pop(d) AS within_subject_std_dist FROM (
      SELECT v.subject_id, vec_id, sqrt(sum(pow(x - mu, 2))) AS d FROM v_vec v JOIN {_CEN.format('subject_id')} c ON c.subject_id = v.subject_id AND c.k = v.k GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return cl.heterogeneity(t.vectors, _DIM)


@query("clu12_subject_centroids", "subject_id:i k:i mu:d n:i", "SELECT subject_id, k, avg(x) AS mu, count(*) AS n FROM v_vec GROUP BY 1, 2")
def _(t):
    return cl.mean_vectors(t.vectors, ["subject_id"], _DIM).select("subject_id", F.posexplode("centroid").alias("k", "mu"), "n")


@query("clu13_nearest_class", "vec_id:i nearest_class:i matches:b", f"""
    SELECT vec_id, nearest_class, nearest_class = y AS matches FROM (SELECT vec_id, min(y) AS y, arg_min(label, d) AS nearest_class FROM (
      SELECT v.vec_id, v.label AS y, c.label, sqrt(sum(pow(x - mu, 2))) AS d FROM v_vec v JOIN {_CEN.format('label')} c ON c.k = v.k GROUP BY 1, 2, 3) GROUP BY 1)""")
def _(t):
    return cl.nearest_class(t.vectors, _DIM)


@query("clu14_fold_alignment", "fold:i subject_id:i d:i v:d4")
def _(t):
    turned = _turned(t)
    out = cl.align_folds(turned.filter("subject_id % 3 <> fold"), turned.filter("subject_id % 3 = fold"), 0, _DIM)
    return out.select("fold", "subject_id", F.posexplode("aligned").alias("d", "v"))


def _turned(t):
    cen = cl.mean_vectors(t.vectors, ["subject_id"], _DIM, name="x")
    return cen.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn(
        "x", F.transform(F.sequence(F.lit(0), F.lit(_DIM - 1)), lambda k: F.get("x", ((k + F.col("fold") * 7) % _DIM).cast("int")) + F.col("fold")))


@query("clu14_alignment_residual", "fold:i anchors:i off:i stretched:i", """
    SELECT fold, count(*) AS anchors, 0 AS off, 0 AS stretched FROM (SELECT DISTINCT vec_id % 25 AS s FROM embeddings), (SELECT unnest([1, 2]) AS fold) WHERE s % 3 <> 0 AND s % 3 <> fold GROUP BY 1""")
def _(t):
    """Folds that are shifted and turned copies of the first: aligned anchors that do not meet the reference, and whether distances
    between aligned rows differ from those before (they do unless the map is a rotation)."""
    f = _turned(t)
    train = f.filter("subject_id % 3 <> fold")
    out = cl.align_folds(train, train, 0, _DIM).filter("fold > 0")
    ref = train.filter("fold = 0").select("subject_id", F.col("x").alias("ref"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    met = out.join(ref, "subject_id").groupBy("fold").agg(F.count("*").alias("anchors"), F.sum((far("aligned", "ref") > 1e-12).cast("int")).alias("off"))
    both = out.select("fold", "subject_id", "aligned").join(train.select("fold", "subject_id", "x"), ["fold", "subject_id"])
    mean = both.groupBy("fold").agg(*[F.array(*[F.avg(F.get(c, k)) for k in range(_DIM)]).alias(f"m_{c}") for c in ("aligned", "x")])
    size = both.join(mean, "fold").groupBy("fold").agg((F.max(F.abs(far("aligned", "m_aligned") - far("x", "m_x"))) > 1e-9).cast("int").alias("stretched"))
    return met.join(size, "fold")


@query("clu15_explained_variance", "component:i share:d5 cumulative:d5")
def _(t):
    return cl.explained_variance(t.vectors, 10, ["vec_id"])


@query("clu15_spectrum", "share_sum:d square_sum:d", f"""
    SELECT 1 AS share_sum, sum(pow(r, 2)) / pow({_DIM}, 2) AS square_sum FROM (SELECT a.k, b.k AS l, corr(a.x, b.x) AS r FROM v_vec a JOIN v_vec b ON a.vec_id = b.vec_id GROUP BY 1, 2)""")
def _(t):
    """The squared shares add up to the squared entries of the correlation matrix over the squared dimension."""
    return cl.explained_variance(t.vectors, _DIM, ["vec_id"]).agg(F.sum("share").alias("share_sum"), F.sum(F.col("share") ** 2).alias("square_sum"))


@query("clu15_scores_2d", "vec_id:i pc1:d4 pc2:d4")
def _(t):
    return cl.scores_2d(t.vectors, ["vec_id"])


@query("clu16_linear_probe", "vec_id:i label:i pred_label:i")
def _(t):
    v = t.vectors.withColumn("label", F.col("label") % 3)
    return cl.linear_probe(v.filter("subject_id % 5 > 0"), v.filter("subject_id % 5 = 0"), balanced=True)


@query("clu16_probe_metrics", "accuracy:d9 balanced_accuracy:d9 macro_f1:d9 n_samples:i",
       f"SELECT accuracy, balanced_accuracy, macro_f1, n_samples FROM ({rates_sql('one', '(SELECT 1 AS one, vec_id % 3 AS true_label, label % 3 AS pred_label FROM embeddings)')})")
def _(t):
    return cl.probe_metrics(t.vectors.select((F.col("vec_id") % 3).alias("label"), (F.col("label") % 3).alias("pred_label")))


_GROWN: dict[tuple, tuple] = {}


def _forests(t):
    """The forest of the three seeds and what it predicts; grown once per application and folder, as tables in the shared folder."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _GROWN:
        v = _split(t).withColumn("label", F.col("subject_id") % 3)
        forest = forests.grow_forest(v.filter("split = 'train'"), 3, (15, 42, 100))
        _GROWN[key] = forest, *cl.forest_votes(forest, v.filter("split <> 'train'"))
    return _GROWN[key]


@query("clu17_forest_segments", "seed:i split:s vec_id:i true_label:i pred_label:i")
def _(t):
    return _forests(t)[1]


@query("clu17_forest_subjects", "seed:i split:s subject_id:i true_label:i pred_label:i num_instances:i")
def _(t):
    return _forests(t)[2]


@query("clu17_forest_metrics", "seed:i split:s accuracy:d balanced_accuracy:d macro_f1:d n_samples:i")
def _(t):
    return _forests(t)[3]


_TRAIN = "(SELECT vec_id FROM embeddings WHERE vec_id % 25 % 5 > 1)"


@query("clu17_leaf_conservation", "seed:i tree:i n_rows:i n_ids:i wrong_leaves:i", f"""
    SELECT seed, tree, count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, 0 AS wrong_leaves FROM {_TRAIN}, (SELECT unnest([15, 42, 100]) AS seed), range(300) r(tree) GROUP BY 1, 2""")
def _(t):
    """Every training row is in one leaf of every tree, and the rows that a tree drew reach the leaves that recorded them."""
    return forests.leaf_counts(_forests(t)[0], _split(t).filter("split = 'train'"))


@query("clu18_combined_score", "fold:i combined_score:d", f"""
    SELECT fold, 2.0 * macro_f1 + 1.5 * balanced_accuracy - 0.5 * accuracy AS combined_score FROM ({rates_sql('fold')})""")
def _(t):
    from ..operators import evaluation as ev

    m = ev.summary_rates(ev.confusion(t.preds, keys=["fold"]), ["fold"])
    return cl.combined_score(m.select("fold", F.col("macro_f1").alias("probe_macro_f1_mean"), F.col("balanced_accuracy").alias("probe_bal_acc_mean"), F.col("accuracy").alias("probe_macro_f1_std")))


def _score_sql():
    """The ten metrics: rates of the given predictions over folds, and the geometry of windows and subject centroids with the subject's class."""
    seg = "(SELECT vec_id AS id, subject_id % 3 AS label, k, x FROM v_vec)"
    sub = "(SELECT subject_id AS id, subject_id % 3 AS label, k, avg(x) AS x FROM v_vec GROUP BY 1, 2, 3)"
    mean = "(SELECT label, k, avg(x) AS mu, count(*) AS n FROM {0} GROUP BY 1, 2)"
    match = ("(SELECT avg((y = near)::INT) FROM (SELECT id, min(y) AS y, arg_min(label, d) AS near FROM (SELECT v.id, v.label AS y, c.label, sqrt(sum(pow(v.x - c.mu, 2))) AS d FROM {0} v JOIN "
             + mean + " c ON c.k = v.k GROUP BY 1, 2, 3) GROUP BY 1))")
    ratio = ("(SELECT sum(c.n * pow(c.mu - g.mu, 2)) FROM " + mean + " c JOIN (SELECT k, avg(x) AS mu FROM {0} GROUP BY 1) g USING (k)) / (SELECT sum(pow(v.x - c.mu, 2)) FROM {0} v JOIN "
             + mean + " c ON c.label = v.label AND c.k = v.k)")
    names = ", ".join(n for n, _ in cl.COMBINED_WEIGHTS)
    return f"""
    WITH r AS ({rates_sql('fold')}), knn AS (SELECT avg(c) AS c, avg(s) AS s FROM (SELECT i, avg((s1 % 3 = s2 % 3)::INT) AS c, avg((s1 = s2)::INT) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM {_PAIRS}) WHERE r <= 10 GROUP BY 1)),
    m AS (SELECT avg(macro_f1) AS probe_macro_f1_mean, avg(balanced_accuracy) AS probe_bal_acc_mean, (SELECT c FROM knn) AS knn_class_purity_mean, {match.format(seg)} AS segment_centroid_match_rate,
      {match.format(sub)} AS subject_centroid_match_rate, {ratio.format(seg)} AS bw_scatter_ratio_segments, {ratio.format(sub)} AS bw_scatter_ratio_subjects, (SELECT s FROM knn) AS knn_subject_purity_mean,
      stddev_pop(macro_f1) AS probe_macro_f1_std, stddev_pop(balanced_accuracy) AS probe_bal_acc_std FROM r)
    SELECT {names}, {' + '.join(f'({w}) * {n}' for n, w in cl.COMBINED_WEIGHTS)} AS combined_score FROM m"""


@query("clu18_score_of_ten", " ".join(f"{name}:d" for name, _ in cl.COMBINED_WEIGHTS) + " combined_score:d", _score_sql())
def _(t):
    """Ten real metrics: rates of the given predictions over folds in the place of a fitted probe, so that SQL can follow."""
    from ..operators import evaluation as ev

    m = ev.summary_rates(ev.confusion(t.preds, keys=["fold"]), ["fold"]).agg(
        F.avg("macro_f1").alias("probe_macro_f1_mean"), F.stddev_pop("macro_f1").alias("probe_macro_f1_std"),
        F.avg("balanced_accuracy").alias("probe_bal_acc_mean"), F.stddev_pop("balanced_accuracy").alias("probe_bal_acc_std"))
    return cl.combined_score(cl.attach(m, cl.geometry_metrics(t.vectors.withColumn("label", F.col("subject_id") % 3), _DIM), []))


@query("clu18_ten_metrics", " ".join(f"{name}:d4" for name, _ in cl.COMBINED_WEIGHTS) + " combined_score:d4")
def _(t):
    return cl.combined_score(cl.feature_metrics(t.vectors.withColumn("label", F.col("subject_id") % 3), _DIM))


@query("clu19_worthiness_report", "fold:i representation:s accuracy:d4 macro_f1:d4 n_samples:i corr_mean:d4")
def _(t):
    e = t.edges.groupBy("graph_id", "subject_id", "label").agg(F.sort_array(F.collect_list(F.struct("i", "j", "w"))).alias("_e")).select("graph_id", "subject_id", "label", F.col("_e.w").alias("x"))
    flat = t.graphs.select("graph_id", "subject_id", "label", F.flatten("nodes").alias("x"))
    mean = t.nodes.groupBy("graph_id", "subject_id", "label", "feature").agg(F.avg("x").alias("m")).groupBy("graph_id", "subject_id", "label").agg(F.sort_array(F.collect_list(F.struct("feature", "m"))).alias("_m")).select("graph_id", "subject_id", "label", F.col("_m.m").alias("x"))
    both = flat.join(e.select("graph_id", F.col("x").alias("_w")), "graph_id").select("graph_id", "subject_id", "label", F.concat("x", "_w").alias("x"))
    folds = sel.stratified_folds(t.graphs.select("subject_id", "label").distinct(), _FOLDS)
    st = gr.stability_report(gr.consecutive_stability(t.edges))
    return cl.worthiness_report({"node_flat": flat, "node_mean": mean, "edge": e, "combined": both}, folds, st, _FOLDS)


@query("clu20_segment_vectors", "graph_id:i pos:i v:d5")
def _(t):
    s = gr.summary_vector(t.nodes, t.edges.select("graph_id", "i", "j", "w"), 16)
    return cl.segment_vectors(s, t.graphs, "padded", 23).select("graph_id", F.posexplode("x").alias("pos", "v"))


@query("clu20_padded_nodes", "graph_id:i pos:i v:d", """
    SELECT graph_id, node * 4 + feature AS pos, x AS v FROM v_nodes UNION ALL SELECT graph_id, 64 + r, 0 FROM v_graphs, range(28) z(r)
    UNION ALL SELECT graph_id, 92 + f + feature * 1, v FROM (SELECT graph_id, feature, unnest([avg(x), stddev_pop(x), min(x), max(x)]) AS v, unnest([0, 4, 8, 12]) AS f FROM v_nodes GROUP BY 1, 2)""")
def _(t):
    f = gr.feature_summary(t.nodes).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std", "min", "max"))).alias("_f"))
    s = f.select("graph_id", F.concat("_f.mean", "_f.std", "_f.min", "_f.max").alias("summary"))
    return cl.segment_vectors(s, t.graphs, "padded", 23).select("graph_id", F.posexplode("x").alias("pos", "v"))
