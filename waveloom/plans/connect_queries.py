"""Queries for connectivity (CON)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectivity as con
from ..operators import windows as win
from .registry import query
from .signal_queries import dft_sql
from .views import FS

WK = "subject_id, segment_id"
# phase bands of the stand-in recordings: the unfiltered signal
RAW = {"raw": None}
COH = {"low": (0.0, 3.0), "high": (3.0, 5.0)}

_PAIR = """(SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, a.k, a.value AS u, b.value AS v FROM v_windows a JOIN v_windows b
   ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k AND a.channel < b.channel)"""
_EDGE = "subject_id:i segment_id:i i:s j:s value:d"


def corr_sql(u="u", v="v"):
    return f"coalesce(covar_pop({u}, {v}) / nullif(stddev_pop({u}) * stddev_pop({v}), 0), 0)"


_PEARSON = f"SELECT {WK}, i, j, {corr_sql()} AS value FROM {_PAIR} GROUP BY 1, 2, 3, 4"


@query("con01_pearson", _EDGE, _PEARSON)
def _(t):
    return con.pearson(t.windows)


_SPEARMAN = f"""SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, {corr_sql('a.r', 'b.r')} AS value FROM
      (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {WK}, channel, value) - 1) / 2 AS r FROM v_windows WINDOW w AS (PARTITION BY {WK}, channel ORDER BY value)) a
      JOIN (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {WK}, channel, value) - 1) / 2 AS r FROM v_windows WINDOW w AS (PARTITION BY {WK}, channel ORDER BY value)) b
      ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k AND a.channel < b.channel GROUP BY 1, 2, 3, 4"""


@query("con02_spearman", _EDGE, _SPEARMAN)
def _(t):
    return con.spearman(t.windows)


_COH = f"""
    WITH s AS ({dft_sql(4)}),
    x AS (SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, a.f, avg(a.re * b.re + a.im * b.im) AS cr, avg(a.im * b.re - a.re * b.im) AS ci,
        avg(a.re * a.re + a.im * a.im) AS pa, avg(b.re * b.re + b.im * b.im) AS pb
      FROM s a JOIN s b ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.fr = b.fr AND a.f = b.f AND a.channel < b.channel GROUP BY 1, 2, 3, 4, 5)
    SELECT {WK}, i, j, band, avg(coalesce((cr * cr + ci * ci) / nullif(pa * pb, 0), 0)) AS value
    FROM x, (VALUES ('low', 0, 3), ('high', 3, 5)) b(band, lo, hi) WHERE f * 2 >= lo AND f * 2 < hi GROUP BY ALL"""


@query("con03_coherence", "subject_id:i segment_id:i i:s j:s band:s value:d5", _COH)
def _(t):
    return con.coherence(t.windows, FS, COH, nperseg=4)


# analytic signal of 8 samples: the imaginary part is a circular convolution with (2 / 8) cot(pi d / 8) at odd lags
_PHASE = f"""(SELECT {WK}, channel, a AS k, atan2(sum(CASE WHEN (a - k) % 2 <> 0 THEN 0.25 / tan(pi() * (a - k) / 8) * value ELSE 0 END), max(CASE WHEN a = k THEN value END)) AS ph
    FROM v_windows, range(8) r(a) GROUP BY subject_id, segment_id, channel, a)"""
_DPH = f"""(SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, a.ph - b.ph AS d FROM {_PHASE} a JOIN {_PHASE} b
    ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k AND a.channel < b.channel)"""


@query("con04_pli", _EDGE, f"SELECT {WK}, i, j, abs(avg(sign(sin(d)))) AS value FROM {_DPH} GROUP BY 1, 2, 3, 4")
def _(t):
    return con.phase_measure(t.windows, FS, "pli", RAW)


@query("con04_wpli", _EDGE, f"SELECT {WK}, i, j, abs(avg(sin(d))) / greatest(avg(abs(sin(d))), 1e-8) AS value FROM {_DPH} GROUP BY 1, 2, 3, 4")
def _(t):
    return con.phase_measure(t.windows, FS, "wpli", RAW)


@query("con04_plv", _EDGE, f"SELECT {WK}, i, j, sqrt(pow(avg(cos(d)), 2) + pow(avg(sin(d)), 2)) AS value FROM {_DPH} GROUP BY 1, 2, 3, 4")
def _(t):
    return con.phase_measure(t.windows, FS, "plv", RAW)


@query("con04_band_wpli", "subject_id:i segment_id:i band:s i:s j:s value:d")
def _(t):
    w = win.sliding_windows(t.samples, length=32, step=16)
    return con.phase_measure(w, FS, "wpli", {"slow": (0.5, 2.0), "fast": (2.0, 3.5)})


@query("con05_phase_lag", _EDGE, f"SELECT {WK}, i, j, avg(abs(atan2(sin(d), cos(d)))) AS value FROM {_DPH} GROUP BY 1, 2, 3, 4")
def _(t):
    return con.phase_measure(t.windows, FS, "phase_lag", RAW)


@query("con06_envelope_correlation", "subject_id:i segment_id:i band:s i:s j:s value:d")
def _(t):
    w = win.sliding_windows(t.samples, length=32, step=16)
    return con.envelope_correlation(w, FS, {"slow": (0.5, 2.0), "fast": (2.0, 3.5)})


@query("con07_mutual_information", _EDGE, f"""
    WITH b AS (SELECT *, least(CAST(floor((value - lo) / (hi - lo) * 16) AS BIGINT), 15) AS bin FROM (
      SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v_windows WINDOW w AS (PARTITION BY {WK}, channel))),
    j AS (SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, a.bin AS p, b.bin AS q, count(*) / 8 AS pxy FROM b a JOIN b b
      ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k AND a.channel < b.channel GROUP BY 1, 2, 3, 4, 5, 6),
    m AS (SELECT {WK}, channel, bin, count(*) / 8 AS px FROM b GROUP BY 1, 2, 3, 4)
    SELECT j.subject_id, j.segment_id, i, j, sum(pxy * ln(pxy / (m1.px * m2.px))) AS value FROM j
    JOIN m m1 ON m1.subject_id = j.subject_id AND m1.segment_id = j.segment_id AND m1.channel = i AND m1.bin = p
    JOIN m m2 ON m2.subject_id = j.subject_id AND m2.segment_id = j.segment_id AND m2.channel = j AND m2.bin = q GROUP BY 1, 2, 3, 4""")
def _(t):
    return con.mutual_information(t.windows)


@query("con08_wavelet_coherence", _EDGE, f"""
    WITH d AS (SELECT {WK}, channel, m, sum(value * cos(2 * pi() * m * k / 8)) AS re, -sum(value * sin(2 * pi() * m * k / 8)) AS im FROM v_windows, range(1, 4) q(m) GROUP BY ALL),
    s AS (SELECT s, m, exp(-pow(sc * 2 * pi() * m - 6, 2)) AS p FROM (SELECT s, 0.25 / (4 * pi() / (6 + sqrt(38))) * pow(2, s / 12.0) AS sc FROM range(25) q(s)), range(1, 4) r(m)),
    x AS (SELECT {WK}, a.channel AS i, b.channel AS j, s, sum(p * (a.re * b.re + a.im * b.im)) AS cr, sum(p * (a.im * b.re - a.re * b.im)) AS ci,
      sum(p * (a.re * a.re + a.im * a.im)) AS pa, sum(p * (b.re * b.re + b.im * b.im)) AS pb FROM d a JOIN d b USING ({WK}, m) JOIN s USING (m) WHERE a.channel < b.channel GROUP BY ALL)
    SELECT {WK}, i, j, avg(CASE WHEN pa * pb > 0 THEN sqrt(cr * cr + ci * ci) / sqrt(pa * pb) ELSE 0 END) AS value FROM x GROUP BY ALL""")
def _(t):
    return con.wavelet_coherence(t.windows, FS)


_METRICS = f"""(SELECT {WK}, i, j, value, 'pearson' AS metric, band FROM ({_PEARSON}), (VALUES ('low'), ('high')) b(band)
    UNION ALL SELECT {WK}, i, j, value, 'spearman', band FROM ({_SPEARMAN}), (VALUES ('low'), ('high')) b(band)
    UNION ALL SELECT {WK}, i, j, value, 'coherence', band FROM ({_COH}))"""


def _metrics(t):
    con.register_metric("coherence4", lambda w, fs, b, k: con.coherence(w, fs, b, nperseg=4, keys=k).withColumn("metric", F.lit("coherence")))
    return con.compute_metrics(t.windows, ["corr", "spearman", "pearson", "coherence4"], FS, COH, stack_bands=True)


@query("con09_metric_dispatch", "subject_id:i segment_id:i metric:s band:s i:s j:s value:d5", f"SELECT * FROM {_METRICS}")
def _(t):
    return _metrics(t)


# a raw matrix with both directions unequal: w for (i, j), 0.8 w for (j, i), 1 on the diagonal
_FULL = """(SELECT graph_id, i, j, w AS value FROM v_edges UNION ALL SELECT graph_id, j, i, 0.8 * w FROM v_edges
    UNION ALL SELECT DISTINCT graph_id, node, node, 1.0 FROM v_nodes)"""


def _full(t):
    e = t.edges.select("graph_id", "i", "j", F.col("w").alias("value"))
    back = e.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"), (0.8 * F.col("value")).alias("value"))
    diag = t.graphs.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select("graph_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return e.unionByName(back).unionByName(diag)


_SYM = f"""(SELECT a.graph_id, a.i, a.j, CASE WHEN a.i = a.j THEN 0 WHEN abs((a.value + b.value) / 2) >= 0.3 THEN (a.value + b.value) / 2 ELSE 0 END AS v
    FROM {_FULL} a JOIN {_FULL} b ON a.graph_id = b.graph_id AND a.i = b.j AND a.j = b.i)"""


@query("con10_postprocess", "graph_id:i i:i j:i value:d", f"""
    SELECT graph_id, i, j, least(greatest((v - avg(v) OVER w) / stddev_pop(v) OVER w, -2), 2) AS value FROM {_SYM} WINDOW w AS (PARTITION BY graph_id)""")
def _(t):
    return con.postprocess(_full(t), ["graph_id"], threshold=0.3, normalize="zscore", clip=(-2, 2))


@query("con10_minmax_upper", "graph_id:i pos:i v:d", f"""
    SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY i, j) - 1 AS pos, v FROM (
      SELECT graph_id, i, j, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM {_SYM} WINDOW w AS (PARTITION BY graph_id)) WHERE i < j""")
def _(t):
    m = con.postprocess(_full(t), ["graph_id"], threshold=0.3, normalize="minmax")
    return con.upper_vector(m, ["graph_id"]).select("graph_id", F.posexplode("vector").alias("pos", "v"))


@query("con11_weight_normalization", "graph_id:i i:i j:i absmax:d minmax:d row_l1:d", """
    SELECT graph_id, i, j, w / max(abs(w)) OVER g AS absmax, (w - min(w) OVER g) / (max(w) OVER g - min(w) OVER g) AS minmax,
      w / sum(abs(w)) OVER (PARTITION BY graph_id, i) AS row_l1 FROM v_both WINDOW g AS (PARTITION BY graph_id)""")
def _(t):
    e = con.mirror(t.edges.select("graph_id", "i", "j", "w"))
    e = e.withColumn("absmax", F.col("w")).withColumn("minmax", F.col("w")).withColumn("row_l1", F.col("w"))
    for m in ("absmax", "minmax", "row_l1"):
        e = con.normalize_weights(e, ["graph_id"], m, m)
    return e


@query("con12_feature_similarity", "graph_id:i i:i j:i cosine:d rbf:d rbf_tau:d pearson:d", """
    SELECT graph_id, i, j, max(w) AS cosine, exp(-sum(pow(a.x - b.x, 2)) / 4) AS rbf, exp(-sum(pow(a.x - b.x, 2)) / 0.5) AS rbf_tau,
      covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) AS pearson
    FROM v_edges e JOIN v_nodes a ON a.graph_id = e.graph_id AND a.node = i JOIN v_nodes b ON b.graph_id = e.graph_id AND b.node = j AND a.feature = b.feature GROUP BY 1, 2, 3"""
    .replace("SELECT graph_id, i, j", "SELECT e.graph_id, i, j"))
def _(t):
    k = ["graph_id", "i", "j"]
    out = con.feature_similarity(t.graphs).withColumnRenamed("w", "cosine")
    for name, kw in (("rbf", {"metric": "rbf"}), ("rbf_tau", {"metric": "rbf", "tau": 0.5}), ("pearson", {"metric": "pearson"})):
        out = out.join(con.feature_similarity(t.graphs, **kw).withColumnRenamed("w", name), k)
    return out


@query("con13_fuse_sources", "subject_id:i segment_id:i i:s j:s value:d5", f"""
    WITH m AS (SELECT * FROM {_METRICS} WHERE metric = 'coherence' OR (metric = 'pearson' AND band = 'low'))
    SELECT {WK}, i, j, avg(v) AS value FROM (SELECT {WK}, i, j, metric, avg(value) AS v FROM m GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return con.fuse_sources(_metrics(t), [("pearson", "low"), ("coherence", None)], ["subject_id", "segment_id"])


_CLASS = """(SELECT label, i, j, avg(v) AS mean, count(*) AS n_subjects FROM (SELECT label, subject_id, i, j, avg(w) AS v FROM v_edges GROUP BY ALL) GROUP BY 1, 2, 3)"""


@query("con14_class_mean", "label:i i:i j:i mean:d n_subjects:i", f"SELECT * FROM {_CLASS}")
def _(t):
    return con.mean_by_class(t.edges, value="w", by=["i", "j"])


@query("con14_class_contrast", "class_a:i class_b:i i:i j:i difference:d", f"""
    SELECT a.label AS class_a, b.label AS class_b, a.i, a.j, a.mean - b.mean AS difference FROM {_CLASS} a JOIN {_CLASS} b ON a.i = b.i AND a.j = b.j AND a.label < b.label""")
def _(t):
    return con.class_contrast(con.mean_by_class(t.edges, value="w", by=["i", "j"]), by=["i", "j"])


@query("con15_subject_summary", "subject_id:i level:s channel:i value:d", """
    SELECT subject_id, CASE WHEN grouping(i) = 1 THEN 'global' ELSE 'channel' END AS level, i AS channel, avg(abs(w)) AS value
    FROM v_both GROUP BY GROUPING SETS ((subject_id), (subject_id, i))""")
def _(t):
    return con.subject_summary(t.edges, value="w", by=["subject_id"])


def regions(t):
    """Region of each node: node div 4."""
    return t.nodes.select(F.col("node").alias("channel"), F.floor(F.col("node") / 4).alias("region")).distinct()


@query("con16_region_matrix", "graph_id:i region_a:i region_b:i value:d n_edges:i",
       "SELECT graph_id, least(i // 4, j // 4) AS region_a, greatest(i // 4, j // 4) AS region_b, avg(w) AS value, count(*) AS n_edges FROM v_edges GROUP BY 1, 2, 3")
def _(t):
    return con.region_matrix(t.edges, regions(t), ["graph_id"])


@query("con17_within_between", "graph_id:i kind:s n:i mean:d", """
    SELECT graph_id, CASE WHEN i // 4 = j // 4 THEN 'within' ELSE 'between' END AS kind, count(*) AS n, avg(w) AS mean FROM v_edges GROUP BY 1, 2""")
def _(t):
    return con.within_between(t.edges, regions(t)).groupBy("graph_id", "kind").agg(F.count("*").alias("n"), F.avg("w").alias("mean"))
