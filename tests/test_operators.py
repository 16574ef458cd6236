"""Closed forms, invariants and brute-force checks on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions import tails
from waveloom.operators import blocks as B
from waveloom.operators import clustering as cl
from waveloom.operators import connectivity as con
from waveloom.operators import evaluation as ev
from waveloom.operators import features as ft
from waveloom.operators import graphs as gr
from waveloom.operators import kernels as K
from waveloom.operators import ordered as od
from waveloom.operators import recordings as rec
from waveloom.operators import selection as sel
from waveloom.operators import stats as st
from waveloom.operators import windows as win
from waveloom.sources import store


def wave(spark, n, fs, freq, channels=(("a", 0.0), ("b", 0.5)), subject=1):
    rows = spark.range(n).select(F.lit(subject).cast("long").alias("subject_id"), F.col("id").alias("t"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.sin(2 * math.pi * freq * F.col("id") / fs + ph).alias("value")) for c, ph in channels])).alias("c"))
    return rows.select("subject_id", "t", "c.channel", "c.value").withColumn("n", F.lit(n).cast("long"))


# ---- ordered helpers: both forms against brute force --------------------------------------------

def heavy(spark):
    """One key holds most rows."""
    return spark.range(3000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"), "id", ((F.col("id") * 7919) % 401 / 4.0).alias("v"))


def brute(df):
    pdf = df.toPandas()
    return pdf, pdf.groupby("k")


def test_ordered(spark):
    df = heavy(spark)
    pdf, g = brute(df)
    q = {r["k"]: r for r in od.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k, part in g:
        assert q[k]["a"] == pytest.approx(np.percentile(part["v"], 50)) and q[k]["b"] == pytest.approx(np.percentile(part["v"], 95))
    pos = od.positions(df, ["k"], ["v", "id"], "p").toPandas().sort_values(["k", "v", "id"])
    assert (pos["p"].to_numpy() == pos.groupby("k").cumcount().to_numpy()).all()
    ties = od.tie_table(df, ["k"], "v", {"s": F.col("id")}).toPandas().sort_values(["k", "v"])
    ranks = pdf.assign(r=g["v"].rank()).groupby(["k", "v"])["r"].first().reset_index().sort_values(["k", "v"])
    assert np.allclose(ties["avg_rank"], ranks["r"]) and np.allclose(ties["cum_s"], pdf.groupby(["k", "v"])["id"].sum().groupby("k").cumsum())
    run = od.running(df.select("k", "id", "v"), ["k"], [F.desc("id")], {"lo": ("min", F.col("v"))}).toPandas().sort_values(["k", "id"], ascending=[True, False])
    assert np.allclose(run["lo"], run.groupby("k")["v"].cummin())


def test_no_partition_holds_a_heavy_key(spark):
    """One subject with 70 % of the rows is spread over the partitions that number them."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), F.xxhash64("id").alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many partitions as large data would have
    try:
        placed = od._spread(df, ["k"], ["v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = placed.filter("k = 0").groupBy("_pid").count().toPandas()["count"]
    assert len(parts) >= 4 and parts.max() <= 0.5 * parts.sum()


# ---- windows ------------------------------------------------------------------------------------

def test_segmentation_counts_and_padding(spark):
    s = wave(spark, 21, 8.0, 1.0)
    full = win.sliding_windows(s, length=8, step=4).filter("channel = 'a'").orderBy("segment_id").collect()
    assert [r["start_sample"] for r in full] == [0, 4, 8, 12] and all(len(r["x"]) == 8 for r in full)
    part = win.sliding_windows(s, length=8, step=4, keep_partial=True).filter("channel = 'a'").orderBy("segment_id").collect()
    assert part[-1]["start_sample"] == 16 and part[-1]["end_sample"] == 21 and len(part[-1]["x"]) == 8
    assert part[-1]["x"][4:] == [part[-1]["x"][4]] * 4
    with pytest.raises(ValueError):
        win.segment_signal(s, 8.0, window_sec=1.0, overlap=1.0)


# ---- kernels ------------------------------------------------------------------------------------

@pytest.mark.parametrize("low,high", [(1.0, 10.0), (None, 10.0), (5.0, None)])
def test_butterworth_response(low, high):
    fs, sos = 100.0, K.butter_sos(4, 100.0, low, high)

    def gain(f):
        z = np.exp(2j * np.pi * f / fs)
        return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (a0 + a1 / z + a2 / z**2) for b0, b1, b2, a0, a1, a2 in sos]))

    for edge in (low, high):
        if edge:
            assert gain(edge) == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    inside = math.sqrt(low * high) if low and high else 1e-6 if high else fs / 2 - 1e-6
    assert gain(inside) == pytest.approx(1.0, abs=5e-3)
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sos)


def test_notch_removes_its_frequency():
    fs, sos = 100.0, K.notch_sos(10.0, 100.0)
    t = np.arange(4000) / fs
    y = K.zero_phase(sos, np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 23 * t)]))
    assert np.abs(y[0, 1500:2500]).max() < 1e-3 and np.abs(y[1] - np.sin(2 * np.pi * 23 * t))[1500:2500].max() < 2e-2


def test_recording_filter_equals_one_pass(spark):
    rng = np.random.default_rng(3)
    n = 333
    x = rng.normal(size=(2, n))
    rows = [(s, "a", t, float(x[s, t])) for s in range(2) for t in range(n)]
    df = spark.createDataFrame(rows, "subject_id long, channel string, t long, value double")
    sos = K.butter_sos(4, 50.0, 1.0, 10.0)
    want = K.zero_phase(sos, x)
    for block in (40, 64, 1000):
        got = rec.filter_recording(df, sos, block=block).toPandas().sort_values(["subject_id", "t"])["value"].to_numpy().reshape(2, n)
        assert np.allclose(got, want, atol=1e-9), block
    short = df.filter("t < 20")
    kept = rec.filter_recording(short, sos, short="keep").toPandas().sort_values(["subject_id", "t"])["value"].to_numpy()
    assert np.allclose(kept, x[:, :20].ravel())
    with pytest.raises(Exception, match="longer than"):
        rec.filter_recording(short, sos).collect()


def test_spectrum_of_a_sine(spark):
    w = win.sliding_windows(wave(spark, 512, 64.0, 10.0), length=128, step=64)
    p = ft.welch_psd(w, 64.0, 64).select("psd", "df").first()
    assert int(np.argmax(p["psd"])) * p["df"] == pytest.approx(10.0)
    r = ft.band_power(ft.welch_psd(w, 64.0, "min256"), {"alpha": (8, 13), "beta": (13, 30)}).select("relative").first()[0]
    assert r[0] > 0.95 and sum(r) == pytest.approx(1.0)


def test_phase_of_shifted_sines(spark):
    w = win.sliding_windows(wave(spark, 256, 64.0, 8.0), length=256, step=256)
    value = lambda m: con.phase_measure(w, 64.0, m, {"raw": None}).first()["value"]
    assert value("plv") == pytest.approx(1.0) and value("phase_lag") == pytest.approx(0.5) and value("pli") == pytest.approx(1.0)
    same = win.sliding_windows(wave(spark, 256, 64.0, 8.0, (("a", 0.0), ("b", 0.0))), length=256, step=256)
    assert con.coherence(same, 64.0, {"alpha": (7, 9)}, nperseg=64).first()["value"] == pytest.approx(1.0)
    assert con.envelope_correlation(same, 64.0, {"alpha": (6, 10)}).first()["value"] == pytest.approx(1.0)
    assert con.wavelet_coherence(same, 64.0).first()["value"] == pytest.approx(1.0, abs=1e-6)


def test_wavelet_sub_bands():
    flat = K.wavelet_energies(np.full((1, 256), 3.0))
    assert np.allclose(flat[0, 1:], 0, atol=1e-12)
    x = np.random.default_rng(0).normal(size=(1, 4096))
    assert K.wavelet_energies(x).sum() == pytest.approx((x**2).sum(), rel=0.05)


def test_resampling_keeps_a_slow_sine():
    t = np.arange(200) / 100.0
    y = K.resample(np.sin(2 * np.pi * 3 * t)[None], 100.0, 150.0)
    assert y.shape == (1, 300) and np.abs(y[0] - np.sin(2 * np.pi * 3 * np.arange(300) / 150.0))[30:-30].max() < 0.02
    assert K.resample(np.ones((1, 100)), 100.0, 50.0) == pytest.approx(np.ones((1, 50)), abs=1e-6)


# ---- graphs -------------------------------------------------------------------------------------

def test_spanning_tree_and_isolates(spark):
    rows = [(0, 0, 1, 0.9), (0, 1, 2, 0.8), (0, 0, 2, 0.85), (0, 2, 3, 0.1), (0, 3, 4, -0.2), (0, 0, 4, 0.05)]
    e = spark.createDataFrame(rows, "graph_id int, i int, j int, w double")
    tree = {(r["i"], r["j"]) for r in gr.spanning_tree(e).collect()}
    assert tree == {(0, 1), (0, 2), (2, 3), (0, 4)}
    # the strongest third are the three edges among 0, 1, 2; joining 3 to 4 also serves 4
    kept = {(r["i"], r["j"]) for r in gr.reconnect_isolates(e, 0.5).collect()}
    assert kept == {(0, 1), (1, 2), (0, 2), (3, 4)}


def test_centrality_sums_to_one(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 0, 2, 1.0)], "graph_id int, i int, j int, w double")
    v = gr.node_theory(e, 3).collect()
    assert [r["eigenvector_centrality"] for r in v] == pytest.approx([1 / 3] * 3) and [r["weighted_clustering"] for r in v] == pytest.approx([1.0] * 3)
    s = gr.eigen_summary(e, 3).first()
    assert s["eig_1"] == pytest.approx(2.0) and s["eig_min"] == pytest.approx(-1.0)


def test_graphs_with_isolated_nodes_and_without_edges(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0)], "graph_id int, i int, j int, w double")
    g = spark.createDataFrame([(0,), (1,)], "graph_id int")
    s = {r["graph_id"]: r for r in gr.edge_summary(e, 4, g).collect()}
    assert s[0]["edge_mean"] == pytest.approx(1 / 6) and s[0]["nonzero_ratio"] == pytest.approx(1 / 6) and s[0]["edge_min"] == 0 and s[0]["strength_mean"] == 0.5
    assert s[1]["edge_mean"] == 0 and s[1]["edge_max"] == 0 and s[1]["degree_std"] == 0
    v = {(r["graph_id"], r["node"]): r for r in gr.node_theory(e, 4, g).collect()}
    assert len(v) == 8 and v[0, 0]["mean_abs_edge"] == pytest.approx(1 / 3) and v[0, 2]["strength"] == 0 and v[1, 0]["eigenvector_centrality"] == 0
    x = {r["graph_id"]: r for r in gr.eigen_summary(e, 4, g).collect()}
    assert x[0]["eig_2"] == pytest.approx(0) and x[0]["eig_min"] == pytest.approx(-1) and x[1]["eig_1"] == 0
    p = {r["graph_id"]: r for r in gr.path_metrics(e, 4, graphs=g).collect()}
    assert p[0]["efficiency"] == pytest.approx(1 / 6) and p[0]["path_length"] is None and p[1]["density"] == 0
    n = gr.symmetric_normalize(e, nodes=g.crossJoin(spark.range(4).withColumnRenamed("id", "node")))
    assert n.filter("i = j").count() == 8


def test_labels_of_both_data_sets(spark):
    from waveloom.operators import projections as prj

    d = spark.createDataFrame([("aheap", "fronto-temporal  dementia"), ("aheap", "c"), ("CAUEEG", "2.0"), ("caueeg", "normal")], "ds string, label string")
    got = [(r["class_name"], r["class_id"]) for r in prj.harmonize_labels(d, "label", "ds").collect()]
    assert sorted(got) == [("FTD", 2), ("HC", 0), ("Healthy", 0), ("MCI", 2)]
    with pytest.raises(Exception, match="unknown label"):
        prj.harmonize_labels(d.limit(1).withColumn("label", F.lit("zebra")), "label", "ds").collect()


def test_choices_are_limited_before_the_shuffle(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sel.cluster_balanced(manifest(spark), 5).explain("formatted")
    assert "WindowGroupLimit" in out.getvalue()


# ---- evaluation golden cases --------------------------------------------------------------------

def test_soft_vote_by_hand(spark):
    p = spark.createDataFrame([("S1", 0, [0.80, 0.15, 0.05]), ("S1", 0, [0.70, 0.20, 0.10]), ("S1", 0, [0.60, 0.30, 0.10])], "subject_id string, true_label int, prob array<double>")
    r = ev.soft_vote(p, 3, ["subject_id"]).first()
    assert r["prob"] == pytest.approx([0.7, 0.65 / 3, 0.25 / 3]) and r["pred_label"] == 0
    bad = p.union(spark.createDataFrame([("S1", 1, [0.1, 0.8, 0.1])], p.schema))
    with pytest.raises(Exception, match="mixed"):
        ev.soft_vote(bad, 3, ["subject_id"]).collect()


def test_average_precision_and_auc_by_hand(spark):
    rows = [(0, [0.9, 0.1]), (1, [0.6, 0.4]), (0, [0.65, 0.35]), (1, [0.2, 0.8])]
    t = ev.score_ties(spark.createDataFrame(rows, "true_label int, prob array<double>"))
    auc = {r["class"]: r["roc_auc"] for r in ev.roc_auc(t).collect()}
    ap = {r["class"]: r["pr_auc"] for r in ev.pr_auc(t).collect()}
    assert auc[1] == pytest.approx(1.0) and ap[1] == pytest.approx(1.0)
    one = ev.score_ties(spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.2, 0.8])], "true_label int, prob array<double>"))
    assert {r["class"]: r["roc_auc"] for r in ev.roc_auc(one).collect()} == {0: None, 1: None}


# ---- tails --------------------------------------------------------------------------------------

def test_tail_probabilities():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-10)
    assert tails.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-10)
    assert tails.chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    # F with (2, d) has the closed form (1 + 2 x / d) ** (-d / 2)
    for x, d in ((0.3, 5), (4.0, 10), (40.0, 97)):
        assert tails.f_tail(x, 2, d) == pytest.approx((1 + 2 * x / d) ** (-d / 2), rel=1e-10)
    # all 20 arrangements of 3 and 3: the extreme one has probability 1/20 per side
    assert tails.rank_sum_exact(9.0, 3, 3) == pytest.approx(0.1) and tails.rank_sum_exact(0.0, 3, 3) == pytest.approx(0.1)
    # against all arrangements of 3 among 7
    from itertools import combinations

    us = [sum(c) - 6 for c in combinations(range(1, 8), 3)]
    for u in range(13):
        assert tails.rank_sum_exact(u, 3, 4) == pytest.approx(min(1.0, 2 * sum(x <= min(u, 12 - u) for x in us) / len(us)))


# ---- selection ----------------------------------------------------------------------------------

def manifest(spark):
    """Subject 0 holds a third of 900 rows, subject 9 only three."""
    r = spark.range(900).withColumn("subject_id", F.when(F.col("id") < 300, 0).when(F.col("id") < 303, 9).otherwise(F.col("id") % 6 + 1))
    return r.select("subject_id", F.col("id").alias("segment_id"), (F.col("id") % 5 % 4).alias("cluster"), (F.col("id") % 7 != 0).alias("keep_clean"), ((F.col("id") % 11 + 1) / 11).alias("sampling_weight"),
                    ((F.col("id") * 37 % 101) / 101).alias("distance"), (F.col("id") % 13).alias("score"), (F.col("subject_id") % 3).alias("label"), F.lit("train").alias("split"))


@pytest.mark.parametrize("strategy", [s for s in sel.STRATEGIES if s != "keep_clean"])
def test_choices_have_k_rows_and_follow_keys(spark, strategy):
    m = manifest(spark)
    a = sel.select(m, strategy, 6, 3)
    n = {r["subject_id"]: r["count"] for r in a.groupBy("subject_id").count().collect()}
    assert all(v == 6 for s, v in n.items() if s != 9) and n[9] <= 6
    rows = lambda d: sorted((r["subject_id"], r["segment_id"]) for r in d.collect())
    assert rows(a) == rows(sel.select(m.repartition(7, "distance"), strategy, 6, 3))


def test_top_up_fills_short_subjects(spark):
    b = sel.bags(manifest(spark), 6, epochs=2)
    assert all(r["count"] == 6 for r in b.groupBy("epoch", "subject_id").count().collect())
    nine = b.filter("subject_id = 9 AND epoch = 0")
    assert nine.select("segment_id").distinct().count() == 3


def test_proportional_allocation_caps(spark):
    a = sel.allocate_clusters(manifest(spark), 10).toPandas()
    assert (a.groupby("subject_id")["allocated"].sum().drop(9) == 10).all() and a["allocated"].max() <= 6
    assert (a["allocated"] <= a["n"]).all()


def test_allocation_needs_no_group_per_subject(spark):
    """Subjects go through Arrow batches, not one Python group each; a cluster or subject without id keeps its slots."""
    m = manifest(spark).withColumn("cluster", F.when(F.col("cluster") > 0, F.col("cluster"))).withColumn("subject_id", F.when(F.col("subject_id") != 2, F.col("subject_id")))
    d = sel.allocate_clusters(m, 10)
    assert "InPandas" not in d._jdf.queryExecution().sparkPlan().toString()
    a = d.groupBy("subject_id").agg(F.sum("allocated").alias("a"), F.sum("n").alias("n")).collect()
    assert {r["subject_id"]: r["a"] for r in a} == {s: 3 if s == 9 else 10 for s in (0, None, 1, 3, 4, 5, 6, 9)} and sum(r["n"] for r in a) == 900


def test_pseudo_bags(spark):
    b = sel.pseudo_bags(manifest(spark), n_bags=30, k=10, subjects_per_bag=3).toPandas()
    assert (b.groupby("bag").size() == 10).all() and (b.groupby("bag")["slot"].nunique() == 10).all()
    assert (b["subject_id"] % 3 == b["label"]).all()


def test_folds_are_disjoint_and_balanced(spark):
    s = spark.range(103).select(F.col("id").alias("subject_id"), (F.col("id") % 3).alias("label"))
    f = sel.stratified_folds(s, 5).toPandas()
    assert (f.groupby(["fold", "subject_id"]).size() == 1).all() and (f[f.role == "test"].groupby("subject_id").size() == 1).all()
    per = f[f.role == "test"].groupby(["label", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()
    with pytest.raises(Exception, match="more folds"):
        sel.stratified_folds(s.limit(6), 5).collect()


# ---- models on blocks ---------------------------------------------------------------------------

def vectors(spark, n=600):
    rng = np.random.default_rng(1)
    centre = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0]])
    rows = [(k % 2, k, (centre[k % 3] + rng.normal(size=3)).tolist(), k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "subject_id long, segment_id long, x array<double>, y int")


def test_block_pca_matches_numpy(spark):
    v = vectors(spark)
    x = np.array(v.orderBy("segment_id").toPandas()["x"].tolist())
    z = (x - x.mean(0)) / x.std(0)
    val = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1]
    got = [r["share"] for r in B.explained(B.pca_models(B.pack(v, [], ["segment_id"], block=100), [], 3), [], 3).orderBy("component").collect()]
    assert got == pytest.approx((val / val.sum()).tolist())


def test_block_kmeans_finds_groups_per_key(spark):
    v = vectors(spark)
    out = B.unpack(B.kmeans(B.pack(v, ["subject_id"], ["segment_id"], block=64, extra=["y"]), ["subject_id"], 3, starts=4), ["subject_id"], ["cluster", "distance"]).toPandas()
    for _, g in out.groupby("subject_id"):
        assert len(g) == 300 and g.groupby("cluster")["y"].agg(lambda s: s.value_counts(normalize=True).max()).min() > 0.95


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 2))
    x[:5] += 8
    rows = [(1, k, x[k].tolist()) for k in range(700)]
    v = spark.createDataFrame(rows, "subject_id long, segment_id long, x array<double>")
    s = B.unpack(B.isolation_forest(B.pack(v, ["subject_id"], ["segment_id"], block=128), ["subject_id"], trees=100), ["subject_id"], ["iforest_score"]).orderBy("iforest_score").limit(5).collect()
    assert {r["segment_id"] for r in s} == {0, 1, 2, 3, 4}


def test_all_pair_products_match_brute_force(spark):
    v = vectors(spark, 150).withColumnRenamed("segment_id", "vec_id").withColumnRenamed("y", "label").withColumn("cluster", F.col("label"))
    pdf = v.orderBy("vec_id").toPandas()
    x = np.array(pdf["x"].tolist())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.triu_indices(150, 1)
    same = pdf["subject_id"].to_numpy()[i] == pdf["subject_id"].to_numpy()[j]
    got = {r["kind"]: r for r in cl.pair_distances(v, block=40).collect()}
    assert got["same_subject"]["n_pairs"] == same.sum() and got["same_subject"]["mean"] == pytest.approx(d[i, j][same].mean())
    np.fill_diagonal(d, np.inf)
    near = d.argsort(1)[:, :4]
    rows = cl.nearest(v, 4, block=40).toPandas()
    for k in (0, 77, 149):
        assert set(rows[rows["id"] == k]["o"]) == set(near[k])
    sil = cl.silhouette(v, ["vec_id"], block=40).first()[0]
    lab = pdf["label"].to_numpy()
    np.fill_diagonal(d, 0)
    a = np.array([d[k][(lab == lab[k])].sum() / ((lab == lab[k]).sum() - 1) for k in range(150)])
    b = np.array([min(d[k][lab == c].mean() for c in set(lab) if c != lab[k]) for k in range(150)])
    assert sil == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    some = cl.silhouette(v, ["vec_id"], block=40, sample=100).first()[0]
    assert some == cl.silhouette(v.repartition(5), ["vec_id"], block=17, sample=100).first()[0] or some == pytest.approx(cl.silhouette(v, ["vec_id"], block=17, sample=100).first()[0])
    assert abs(some - sil) < 0.05


def grouped(spark, n, groups, seed=3):
    """Vectors in tight groups, a tenth of them equal to one vector."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(groups, 6))[np.arange(n) % groups] * 50 + rng.normal(size=(n, 6)), 3)
    x[: n // 10] = x[0]
    return x, spark.createDataFrame([(k, k % 7, k % groups % 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, subject_id long, label long, x array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("other", [False, True])
def test_pruned_neighbours_equal_all_pairs(spark, metric, other):
    x, v = grouped(spark, 600, 12)
    u = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    d = -(u @ u.T) if metric == "cosine" else np.sqrt(np.maximum((u**2).sum(1)[:, None] + (u**2).sum(1) - 2 * u @ u.T, 0))
    s = np.arange(600) % 7
    d[(s[:, None] == s) if other else np.eye(600, dtype=bool)] = np.inf
    visits = []
    rows = cl.nearest(v, 5, block=32, metric=metric, other_subject=other, visits=visits).toPandas()
    assert len(rows) == 600 * 5 and (rows.groupby("id").size() == 5).all()
    far = np.round(np.sort(d, 1)[:, :5], 6)
    got = np.sort(d[rows["id"], rows["o"]].reshape(-1, 1), 1)
    rows["d"] = got
    for k, part in rows.groupby("id"):
        assert np.allclose(np.sort(part["d"]), far[k], atol=1e-5)
    assert visits[0][0] < 0.6 * visits[0][1]


def test_neighbours_of_equal_rows_go_to_smaller_ids(spark):
    v = spark.createDataFrame([(k, 0, 0, [1.0, 2.0]) for k in range(50)], "vec_id long, subject_id long, label long, x array<double>")
    rows = cl.nearest(v, 3, block=8).toPandas()
    for k, part in rows.groupby("id"):
        assert sorted(part["o"]) == [j for j in range(4) if j != k][:3]
    assert cl.nearest(v.limit(1), 3).count() == 0 and cl.nearest(v.limit(0), 3).count() == 0


def test_visits_grow_below_the_square(spark):
    share = []
    for n in (400, 1600):
        visits = []
        cl.nearest(grouped(spark, n, n // 40)[1].filter(F.col("vec_id") >= n // 10), 3, block=20, visits=visits).count()
        share.append(visits[0][0] / visits[0][1])
    assert share[1] < 0.6 * share[0]


def test_grid_search_equals_single_models(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 6))[np.arange(150) % 5] * 4 + rng.normal(size=(150, 6))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, x array<double>").repartition(3)
    rows = cl.grid_search(v, [2, 4], [3, 5], [1, 2], ["vec_id"], starts=4).toPandas()
    assert rows[["dims", "k"]].to_numpy().tolist() == [[2, 3], [2, 5], [4, 3], [4, 5]] and rows["ari_mean"].between(-1, 1).all()
    z = (x - x.mean(0)) / x.std(0)
    val, vec = np.linalg.eigh(z.T @ z / 150)
    assert np.allclose(rows["explained_variance"], [np.sort(val)[::-1][:d].sum() / val.sum() for d in (2, 2, 4, 4)])
    # the indices of one seed, from its labels by the operators for given clusters
    b = B.pack(v, [], ["vec_id"])
    p = B.project(b, B.pca_models(b, [], 4), [], 4)
    t = B.unpack(p, [], ["m"]).withColumnRenamed("m", "x").toPandas()
    one = cl.grid_search(v, [4], [5], [1], ["vec_id"], starts=4).toPandas().iloc[0]
    y = np.array(t["x"].tolist())
    pick = [cl.grids.fit_models(p, [(4, 5)], [y[k: k + 5]]) for k in (0, 20, 60, 90)]
    assert min(float(c[0]) for _, c in pick) >= one["inertia_mean"] - 1e-6 or one["inertia_mean"] <= min(float(c[0]) for _, c in pick) * 1.2
    models = cl.grids.Models([(4, 5)], pick[0][0])
    near = next(iter(models.labels(y)))[2]
    g = spark.createDataFrame([(int(i), int(n), r.tolist()) for i, n, r in zip(t["vec_id"], near, y)], "vec_id long, cluster int, x array<double>")
    want = cl.validity(g, ["vec_id"], 4).first()
    _, ((ch, db),), _ = cl.grids._spread(p, models, [])
    assert (ch, db) == (pytest.approx(want["calinski_harabasz"]), pytest.approx(want["davies_bouldin"]))
    assert cl.grids.silhouettes(g, models, ["vec_id"], block=40)[0] == pytest.approx(want["silhouette"])
    assert cl.grid_search(v.limit(2), [2], [3], [1], ["vec_id"]).count() == 0


def test_fold_alignment_undoes_a_rotation(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = rng.normal(size=(30, 4))
    rows = [(f, s, (x[s] if f == 0 else x[s] @ q + 2).tolist()) for f in range(2) for s in range(30)]
    df = spark.createDataFrame(rows, "fold int, subject_id long, x array<double>")
    out = cl.align_folds(df.filter("subject_id < 20"), df.filter("subject_id >= 20"), 0, 4).filter("fold = 1").orderBy("subject_id").collect()
    assert np.allclose(np.array([r["aligned"] for r in out]), x[20:], atol=1e-8)


# ---- store --------------------------------------------------------------------------------------

def test_store_skips_stored_subjects(spark, tmp_path):
    f = spark.createDataFrame([(s, 0, "a", fam, "v", float(s)) for s in range(4) for fam in ("p", "q")], "subject_id int, segment_id int, channel string, family string, feature string, value double")
    w = f.select("subject_id", "segment_id").distinct()
    p = str(tmp_path / "store")
    store.write_store(p, {"windows": w.filter("subject_id < 2"), "features": f.filter("subject_id < 2")})
    store.write_store(p, {"windows": w, "features": f.withColumn("value", F.col("value") + 100)})
    got = {r["subject_id"]: r["value"] for r in store.read_features(spark, p, ["p"]).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 102.0, 3: 103.0}
    e = spark.createDataFrame([(0, "pearson", "alpha")], "subject_id int, metric string, band string")
    assert store.choose_bands(e, "pearson", [0], ["alpha"]).count() == 1
    with pytest.raises(KeyError):
        store.choose_bands(e, "pearson", ["theta"], ["alpha"])


def test_store_survives_a_job_that_dies_at_any_step(spark, tmp_path, monkeypatch):
    """Every file system call and every table write in turn is the last one; after it, and after a repeat, all subjects are whole."""
    from pyspark.sql.readwriter import DataFrameWriter

    schema = "subject_id int, segment_id int, family string, value double"
    rows = lambda *s: spark.createDataFrame([(k, g, f, 1.0 * k) for k in s for g in range(3) for f in ("p", "q")], schema).coalesce(1)
    wins = lambda *s: spark.createDataFrame([(k, g) for k in s for g in range(3)], "subject_id int, segment_id int").coalesce(1)
    steps = []

    class Died(Exception):
        pass

    def dying(fn, before):
        def call(*a, **kw):
            if len(steps) == fatal and before:
                raise Died
            out = fn(*a, **kw)
            steps.append(fn.__name__)
            if len(steps) == fatal + 1 and not before:
                raise Died
            return out
        return call

    ended = 0
    for before in (True, False):
        for fatal in range(5):
            p = str(tmp_path / f"{before}{fatal}")
            store.write_store(p, {"windows": wins(1), "features": rows(1)})
            steps.clear()
            with monkeypatch.context() as m:
                m.setattr(DataFrameWriter, "parquet", dying(DataFrameWriter.parquet, before))
                m.setattr(store, "_commit", dying(store._commit, before))
                m.setattr(store, "_sweep", dying(store._sweep, before))
                try:
                    store.write_store(p, {"windows": wins(1, 2), "features": rows(1, 2)})
                except Died:
                    ended += 1
            seen = {(r["subject_id"], r["n"]) for r in store.read_features(spark, p, ["p", "q"]).groupBy("subject_id").agg(F.count("*").alias("n")).collect()}
            assert seen in ({(1, 6)}, {(1, 6), (2, 6)})
            assert {r[0] for r in store.stored_subjects(spark, p).collect()} == {s for s, _ in seen}
            store.write_store(p, {"windows": wins(1, 2), "features": rows(1, 2)})
            assert store.read_features(spark, p, ["p", "q"]).count() == 12 and store.read_table(spark, p, "windows").count() == 6
            live = {f for v in store.manifest(spark, p)[1].values() for f in v}
            assert {f"{d.parent.name}/{d.name}" for n in ("windows", "features") for d in (tmp_path / f"{before}{fatal}" / n).iterdir()} == live
    assert ended >= 9
    version, live = store.manifest(spark, p)
    with pytest.raises(RuntimeError):
        store._commit(spark, p, version, live)
    store.write_store(p, {"features": rows(7)}, overwrite=True)
    assert [r[0] for r in store.read_features(spark, p, ["p"]).select("subject_id").distinct().collect()] == [7] and store.read_table(spark, p, "windows").count() == 6


def test_stored_subject_is_spread_over_files(spark, tmp_path):
    w = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 5).alias("subject_id"), F.col("id").alias("segment_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_store(str(tmp_path / "s"), {"windows": w})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n = store.read_table(spark, str(tmp_path / "s"), "windows").filter("subject_id = 1").groupBy(F.input_file_name()).count().collect()
    assert len(n) >= 4 and max(r["count"] for r in n) < 5000


def test_registered_settings_are_the_references(monkeypatch):
    from types import SimpleNamespace

    from waveloom.plans import catalog

    seen = []
    monkeypatch.setattr(cl, "grid_search", lambda train, dims, ks, seeds, ids, **kw: seen.append((len(dims), len(ks), len(seeds), kw)))
    vectors = SimpleNamespace(select=lambda *a: None)
    catalog.QUERIES["clu03_grid_search"][0](SimpleNamespace(vectors=vectors))
    assert seen == [(5, 6, 3, {"starts": 20})]


@pytest.mark.parametrize("classes", [2, 3])
def test_probes_of_all_folds_equal_single_fits(spark, classes):
    """Every (set, fold) of one joint fit against a converged fit of the same rows alone."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(classes)
    y = np.arange(90) % 5 % classes
    sets = {"a": rng.normal(size=(90, 4)) * [1, 10, 0.1, 0] + y[:, None] * 0.4, "b": rng.normal(size=(90, 2)) - y[:, None]}
    rows = {n: spark.createDataFrame([(k, k % 3, sum(1 << f for f in range(3) if f != k % 3 and k % 7), int(y[k]), v.tolist()) for k, v in enumerate(x)],
                                     "vec_id long, fold long, train long, label long, x array<double>").repartition(3) for n, x in sets.items()}
    got = {(r["name"], r["vec_id"]): r for r in cl.probes.probe_folds(rows, 3, classes, ["vec_id"]).collect()}
    assert len(got) == 180
    for n, df in rows.items():
        for f in range(3):
            tr = cl.balanced_weights(df.filter(F.expr(f"train & {1 << f} <> 0"))).withColumn("features", array_to_vector("x")).withColumn("_y", F.col("label").cast("double"))
            m = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="weight", maxIter=2000, tol=1e-14, regParam=1e-3).fit(tr)
            for r in m.transform(df.filter(f"fold = {f}").withColumn("features", array_to_vector("x"))).select("vec_id", vector_to_array("probability").alias("p")).collect():
                assert np.allclose(got[(n, r["vec_id"])]["prob"], r["p"], atol=1e-6) and got[(n, r["vec_id"])]["fold"] == f
    with pytest.raises(RuntimeError):
        cl.probes.probe_folds(rows, 3, classes, ["vec_id"], most=2)


def test_forest_runs_and_probe_convergence(spark):
    rows = [(s, k, s % 3, "train" if s < 9 else "val" if s < 12 else "test", [float(s % 3) + 0.1 * k, float(k % 2)]) for s in range(15) for k in range(6) if s % 3 or s >= 9 or k < 2]
    v = spark.createDataFrame(rows, "subject_id long, vec_id long, label long, split string, x array<double>")
    windows, subjects, rates = cl.forest_runs(v.filter("split = 'train'"), v.filter("split <> 'train'"), 3, (15, 42), trees=8)
    got = {(r["seed"], r["split"]): (r["n_samples"], r["accuracy"]) for r in rates.collect()}
    assert {k: n for k, (n, _) in got.items()} == {(s, p): n for s in (15, 42) for p, n in (("val", 3), ("test", 3), ("val_segment", 18), ("test_segment", 18))}
    assert windows.count() == 72 and subjects.count() == 12 and got[(15, "test")][1] == 1.0
    with pytest.raises(RuntimeError):
        cl.linear_probe(v, v, max_iter=2, converge=True)


def test_contingency_of_counts_beyond_a_long(spark):
    """Products of three counts (here 1.35e19) leave the range of a long."""
    df = spark.range(6_000_000).select((F.col("id") % 2).alias("cluster"), (F.floor(F.col("id") / 2) % 2).alias("label"))
    r = cl.contingency_metrics(df).first()
    assert r["n"] == 6_000_000 and abs(r["chi2"]) < 1e-6 and abs(r["mutual_info"]) < 1e-12 and r["dof"] == 1


def test_positions_of_keys_that_span_partitions(spark):
    """Null and NaN keys, a heavy key over many partitions, and rows written once without the columns that only order them."""
    key = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 11 == 1, float("nan")).when(F.col("id") % 11 < 9, 1.0).otherwise(F.col("id").cast("double"))
    df = spark.range(20000).select(key.alias("k"), "id", (-F.col("id")).alias("o"))
    p = od.positions(df, ["k"], ["o"], "p", keep=["id"])
    assert p.columns == ["k", "id", "p"]
    got = {r["id"]: r["p"] for r in p.collect()}
    by = {}
    for i in range(19999, -1, -1):
        g = "null" if i % 11 == 0 else "nan" if i % 11 == 1 else "one" if i % 11 < 9 else i
        assert got[i] == by.get(g, 0)
        by[g] = by.get(g, 0) + 1
    assert "Exchange" not in od.positions(df, ["k"], ["o"], "p")._jdf.queryExecution().optimizedPlan().toString()
    assert p._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 0


def test_thinned_rows_hold_the_first_of_every_key(spark):
    df = spark.range(30000).select((F.col("id") % 7).alias("epoch"), F.when(F.col("id") % 13 > 0, F.col("id") % 13).alias("subject_id"), F.col("id").alias("segment_id"), F.md5(F.col("id").cast("string")).alias("_h"))
    thin = sel._thin(df, ["epoch", "subject_id"], ["_h", "segment_id"], 5)
    first = lambda d: {tuple(r) for r in sel.pick_first(d, ["epoch", "subject_id"], F.col("_h"), F.col("segment_id"), k=5).select("epoch", "subject_id", "segment_id").collect()}
    assert thin.count() < 30000 / 3
    assert first(thin) == first(df)


def test_thinning_follows_sparks_order_for_several_choices(spark):
    """Descending keys, nulls, NaN and both zeros lie as in Spark; the rows of two choices stay in one pass."""
    odd = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 17 == 0, float("nan")).when(F.col("id") % 5 == 0, -0.0).when(F.col("id") % 7 == 0, 0.0).otherwise((F.col("id") * 37 % 1009).cast("double"))
    df = spark.range(0, 24000, 1, 1).select((F.col("id") % 4).alias("subject_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("cluster"), F.col("id").alias("segment_id"), odd.alias("v"))
    thin = sel._thin(df, ["subject_id", "cluster"], ["-v", "segment_id"], 3, (["subject_id"], ["v", "segment_id"], 900))
    for keys, by, k in ((["subject_id", "cluster"], F.desc("v"), 3), (["subject_id"], F.col("v"), 900)):
        first = lambda d: {r["segment_id"] for r in sel.pick_first(d, keys, by, F.col("segment_id"), k=k).select("segment_id").collect()}  # noqa: E731, B023
        assert first(thin) == first(df)
    assert thin.count() < 20000


@pytest.mark.parametrize("strategy", [s for s in sel.STRATEGIES if s != "keep_clean"])
def test_choices_drop_rows_before_any_sort(spark, strategy):
    """A sort of whole subjects spills: between the manifest and the first ranking stands the thinning step (or a count)."""
    lines = sel.select(manifest(spark), strategy, 6, 3)._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    leaves = [i for i, x in enumerate(lines) if " Range " in f" {x.lstrip(' :+-*')} "]
    assert leaves
    for leaf in leaves:
        at, first = leaf, None
        for i in range(leaf - 1, -1, -1):
            if depth[i] < depth[at]:
                at = i
                first = first or next((w for w in ("MapInArrow", "WindowGroupLimit", "Window", "Aggregate") if w in lines[i].split("[")[0]), None)
        assert first in ("MapInArrow", "Aggregate"), lines


def test_nearest_moves_blocks_once_per_group(spark):
    """Rows without groups: what moves is far less than a pair of vectors per block pair; k per visit no longer return."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 6))
    v = spark.createDataFrame([(i, i % 5, i % 3, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, subject_id long, label long, x array<double>")
    n = cl.nearest(v, 4, block=30)
    got = {(r["id"], r["rank"]): r["o"] for r in n.collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k + 1] == o for i in range(1200) for k, o in enumerate(np.argsort(d[i], kind="stable")[:4]))
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Generate" not in plan


def test_bootstrap_draws_are_spread_over_tasks(spark, monkeypatch):
    """Draws grow with the input, so their tasks do; the widths do not depend on the number of tasks."""
    edges = spark.range(3000).select((F.col("id") % 3).alias("subject_id"), F.floor(F.col("id") / 3).alias("segment_id"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.randn(1).alias("w"))
    made = []
    kind, plain = type(edges), type(edges).repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: made.append(a) or plain(df, *a))
    want = {r["subject_id"]: r["ci_width"] for r in st.bootstrap_widths(edges, draws=20).collect()}
    monkeypatch.setattr(st, "PER_TASK", 2000)
    got = {r["subject_id"]: r["ci_width"] for r in st.bootstrap_widths(edges, draws=20).collect()}
    assert [a[0] for a in made] == [8, 31] and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_grid_sums_of_all_models_of_a_shape():
    """Models taken together by shape give the sums and counts of each model on its own; the first of equally near centres wins."""
    from waveloom.operators import grids

    rng = np.random.default_rng(3)
    specs = [(2, 3), (4, 5), (2, 3), (4, 2)]
    models = grids.Models(specs, [np.round(rng.standard_normal((k, d))) for d, k in specs])
    m = np.round(rng.standard_normal((300, 4)))
    got, want = ([np.zeros(k * (d + 1)) for d, k in specs] for _ in range(2))
    models.add_sums(m, got)
    for i, x, near, _ in models.labels(m):
        s = want[i].reshape(specs[i][1], -1)
        np.add.at(s[:, :-1], near, x)
        s[:, -1] += np.bincount(near, minlength=len(s))
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def test_quantile_labels_take_one_set_of_scores(spark):
    """Scores that come out a little lower each time they are computed: the 9th and 17th of 25 are the quantiles themselves and not below them."""
    import time

    later = F.udf(lambda k: float(k) - time.time() * 1e-6, "double").asNondeterministic()
    subjects = spark.range(25).select(F.col("id").alias("subject_id"), later("id").alias("score"))
    got = {r["subject_id"]: r["fake_label"] for r in gr.quantile_labels(subjects).collect()}
    assert got == {k: 0 if k < 8 else 1 if k < 16 else 2 for k in range(25)}
    got = {r["subject_id"]: r["fake_label"] for r in gr.quantile_labels(subjects, 2).collect()}
    assert got == {k: int(k > 12) for k in range(25)}


def test_silhouette_moves_a_block_once_per_group(spark):
    """Clusters without structure, where every block meets every block: what is shuffled grows with groups of blocks, not with pairs of blocks."""
    v = spark.range(2000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("cluster"), F.array(*[F.randn(k).cast("float").cast("double") for k in range(32)]).alias("x"))
    x = np.array([r[0] for r in v.orderBy("vec_id").select("x").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.arange(2000) % 3
    sums = np.stack([d[:, own == k].sum(1) for k in range(3)], 1)
    n = np.bincount(own)
    a = sums[np.arange(2000), own] / (n[own] - 1)
    mean = sums / n
    mean[np.arange(2000), own] = np.inf
    b = mean.min(1)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    got = cl.silhouette(v, ["vec_id"], block=20).first()[0]
    assert got == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()), abs=1e-9)
    many = spark.range(12000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("cluster"), F.array(*[F.randn(k).cast("float").cast("double") for k in range(32)]).alias("x"))
    before, small = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to be broadcast
    try:
        cl.silhouette(many, ["vec_id"], block=400).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    moved = shuffled() - before
    assert moved < 12000 * 32 * 8 * 12, moved  # 30 blocks or more: a block for each pair of blocks would be 30 times the rows
