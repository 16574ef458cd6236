"""Views over the supplied tables that stand for recordings, graphs, manifests and predictions.

Each view exists twice: as a Spark DataFrame (``Tables``) and as SQL text (``VIEW_SQL``). Sample
numbering, windows and graph edges are written once per session in the shared folder, as a store
would hold them, and every query reads that store.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import a_unit, argmax_first, share
from ..operators import windows as win
from ..operators.landing import land
from ..operators.ordered import positions

# layout of the stand-in recordings: 8 samples per second, one-second windows, half overlapping
FS, WIN_LEN, WIN_STEP = 8.0, 8, 4
# frequency bands that fit that rate, half open
BANDS8 = {"low": (0.0, 2.0), "mid": (1.0, 4.0), "high": (3.0, 5.0)}

CHANNELS = ("click", "error", "purchase", "signup", "view")

_STORE: dict[tuple, DataFrame] = {}


def forget_store() -> None:
    """Drop the handles of stored views so that the next query builds them again."""
    _STORE.clear()


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stored(self, name: str, build, written: bool = False) -> DataFrame:
        """``written``: what ``build`` returns reads a table that it has written itself."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORE:
            _STORE[key] = build() if written else land(build())
        return _STORE[key]

    # ---- recordings ----
    @property
    def samples(self) -> DataFrame:
        """subject_id, channel, t, value, n: every event of a subject, dealt to five channels in turn.

        The last row of channels is completed with a channel's last value, so recordings are rectangular.
        """

        def build():
            e = self.table("events").select((F.col("user_id") % 20).alias("subject_id"), "ts", "event_id", (F.col("value") - 50).alias("value"))
            size = e.groupBy("subject_id").agg(F.count("*").alias("k"))
            placed = positions(e, ["subject_id"], ["ts", "event_id"], "p").join(size, "subject_id")
            last = F.floor((F.col("k") - 1) / 5)
            # a channel's last event stands for the missing one too
            times = F.when((F.col("p") + 5 >= F.col("k")) & (F.floor(F.col("p") / 5) < last), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            name = F.element_at(F.array(*[F.lit(x) for x in CHANNELS]), (F.col("p") % 5 + 1).cast("int"))
            return placed.withColumn("later", F.explode(times)).select(
                "subject_id", name.alias("channel"), (F.floor(F.col("p") / 5) + F.col("later")).alias("t"), "value", (last + 1).alias("n"))

        return self._stored("samples", build)

    @property
    def windows(self) -> DataFrame:
        """subject_id, segment_id, channel, start_sample, end_sample, x (array of window samples)."""
        return self._stored("windows", lambda: win.sliding_windows(
            self.samples, length=WIN_LEN, step=WIN_STEP))

    @cached_property
    def window_index(self) -> DataFrame:
        """One row per (subject, window)."""
        return (self.windows.groupBy("subject_id", "segment_id")
                .agg(F.min("start_sample").alias("start_sample"), F.min("end_sample").alias("end_sample")))

    @cached_property
    def recordings(self) -> DataFrame:
        return (self.samples.groupBy("subject_id")
                .agg(F.sort_array(F.collect_set("channel")).alias("channels"), F.max("n").alias("n_samples"))
                .withColumn("label_id", F.col("subject_id") % 3)
                .withColumn("sfreq", F.lit(FS)))

    @cached_property
    def markers(self) -> DataFrame:
        """subject_id, sample, name: every event of a user as an open or closed marker."""
        e = self.table("events").select(
            F.col("user_id").alias("subject_id"), "ts", "event_id",
            F.when(F.col("event_type").isin("click", "purchase"), "eyes open").otherwise("eyes closed").alias("name"))
        return positions(e, ["subject_id"], ["ts", "event_id"], "sample").select("subject_id", "sample", "name")

    # ---- graphs ----
    @cached_property
    def graphs(self) -> DataFrame:
        """graph_id, subject_id, segment_id, label, start_sample, nodes (16 arrays of 4 features)."""
        x = F.transform("embedding", lambda v: v.cast("double"))
        return self.table("embeddings").select(
            F.col("vec_id").alias("graph_id"), (F.col("vec_id") % 25).alias("subject_id"),
            F.floor(F.col("vec_id") / 25).alias("segment_id"), (F.col("vec_id") % 25 % 3).alias("label"),
            (F.floor(F.col("vec_id") / 25) * 500).alias("start_sample"),
            F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(x, i * 4 + 1, 4)).alias("nodes"))

    @cached_property
    def nodes(self) -> DataFrame:
        """graph_id, subject_id, segment_id, label, node, feature, x."""
        g = self.graphs.select("graph_id", "subject_id", "segment_id", "label", F.posexplode("nodes").alias("node", "f"))
        return g.select("graph_id", "subject_id", "segment_id", "label", "node", F.posexplode("f").alias("feature", "x"))

    @property
    def edges(self) -> DataFrame:
        """graph_id, subject_id, segment_id, label, i < j, w: cosine of node features."""

        def build():
            u = F.transform("nodes", a_unit)
            g = self.graphs.select("graph_id", "subject_id", "segment_id", "label", u.alias("u"))
            g = g.select("*", F.posexplode("u").alias("i", "a"))
            rest = F.slice("u", F.col("i") + 2, 16)
            g = g.select("*", F.posexplode(rest).alias("o", "b"))
            dot = F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            return g.select("graph_id", "subject_id", "segment_id", "label", "i", (F.col("i") + 1 + F.col("o")).alias("j"),
                            dot.alias("w"))

        return self._stored("edges", build)

    @cached_property
    def vectors(self) -> DataFrame:
        """vec_id, subject_id, label, x (64 doubles)."""
        return self.table("embeddings").select(
            "vec_id", (F.col("vec_id") % 25).alias("subject_id"), "label",
            F.transform("embedding", lambda v: v.cast("double")).alias("x"))

    # ---- manifests and predictions ----
    @property
    def manifest(self) -> DataFrame:
        def build():
            li = self.table("lineitem")
            cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_shipdate"]
            kept = [F.pmod("l_partkey", F.lit(6)).alias("cluster"), (F.col("l_returnflag") != "R").alias("keep_clean"),
                    F.exp(-10 * F.col("l_discount")).alias("sampling_weight"), (F.col("l_extendedprice") / 1e5).alias("distance"),
                    (-F.col("l_tax")).alias("score")]
            m = positions(li.select("l_suppkey", *cols), ["l_suppkey"], cols, "segment_id", keep=kept)
            return m.select(
                F.col("l_suppkey").alias("subject_id"), "segment_id", "cluster", "keep_clean", "sampling_weight", "distance", "score",
                (F.col("l_suppkey") % 3).alias("label"),
                F.when(F.col("l_suppkey") % 5 == 0, "test").when(F.col("l_suppkey") % 5 == 1, "val")
                .otherwise("train").alias("split"))

        return self._stored("manifest", build, written=True)

    @cached_property
    def preds(self) -> DataFrame:
        """subject_id, instance_id, true_label, pred_label, split, fold, variant, prob, logit."""
        raw = F.array(*[(1 + (F.col("o_orderkey") * (7 + 4 * k) + F.col("o_custkey")) % 101).cast("double") for k in range(3)])
        return (self.table("orders")
                .select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("instance_id"),
                        (F.col("o_custkey") % 3).alias("true_label"), (F.col("o_custkey") % 5).alias("fold"),
                        F.col("o_orderpriority").alias("variant"), raw.alias("raw"))
                .withColumn("split", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train"))
                .withColumn("prob", share("raw"))
                .withColumn("logit", F.transform("raw", lambda v: F.ln(v)))
                .withColumn("pred_label", argmax_first("raw")).drop("raw"))


VIEW_SQL = {
    "v_placed": """
        SELECT user_id % 20 AS subject_id, value - 50 AS value, count(*) OVER (PARTITION BY user_id % 20) AS k,
               row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS p FROM events""",
    "v_samples": """
        SELECT subject_id, ['click', 'error', 'purchase', 'signup', 'view'][p % 5 + 1] AS channel, p // 5 AS t, value, (k - 1) // 5 + 1 AS n FROM v_placed
        UNION ALL
        SELECT subject_id, ['click', 'error', 'purchase', 'signup', 'view'][p % 5 + 1], p // 5 + 1, value, (k - 1) // 5 + 1 FROM v_placed
        WHERE p + 5 >= k AND p // 5 < (k - 1) // 5""",
    "v_windows": """
        SELECT s.subject_id, w.segment_id, s.channel, s.t - 4 * w.segment_id AS k, s.value,
               4 * w.segment_id AS start_sample, 4 * w.segment_id + 8 AS end_sample
        FROM v_samples s, LATERAL (SELECT unnest(range(greatest(0, s.t // 4 - 1), s.t // 4 + 1)) AS segment_id) w
        WHERE 4 * w.segment_id + 8 <= s.n""",
    "v_windex": "SELECT DISTINCT subject_id, segment_id, start_sample, end_sample FROM v_windows",
    "v_markers": """
        SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'eyes open' ELSE 'eyes closed' END AS name
        FROM events""",
    "v_nodes": """
        SELECT vec_id AS graph_id, vec_id % 25 AS subject_id, vec_id // 25 AS segment_id, vec_id % 25 % 3 AS label,
               k // 4 AS node, k % 4 AS feature, CAST(embedding[k + 1] AS DOUBLE) AS x
        FROM embeddings, range(64) r(k)""",
    "v_graphs": """
        SELECT vec_id AS graph_id, vec_id % 25 AS subject_id, vec_id // 25 AS segment_id, vec_id % 25 % 3 AS label,
               (vec_id // 25) * 500 AS start_sample FROM embeddings""",
    "v_edges": """
        SELECT a.graph_id, a.subject_id, a.segment_id, a.label, a.node AS i, b.node AS j,
               sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS w
        FROM v_nodes a JOIN v_nodes b ON a.graph_id = b.graph_id AND a.feature = b.feature AND a.node < b.node
        GROUP BY ALL""",
    "v_both": """
        SELECT graph_id, subject_id, segment_id, label, i, j, w FROM v_edges UNION ALL
        SELECT graph_id, subject_id, segment_id, label, j, i, w FROM v_edges""",
    "v_vec": """
        SELECT vec_id, vec_id % 25 AS subject_id, label, k, CAST(embedding[k + 1] AS DOUBLE) AS x
        FROM embeddings, range(64) r(k)""",
    "v_manifest": """
        SELECT l_suppkey AS subject_id,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                 l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS segment_id,
               l_partkey % 6 AS cluster, l_returnflag <> 'R' AS keep_clean, exp(-10 * l_discount) AS sampling_weight,
               l_extendedprice / 1e5 AS distance, -l_tax AS score, l_suppkey % 3 AS label,
               CASE l_suppkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split
        FROM lineitem""",
    "v_preds": """
        SELECT subject_id, instance_id, true_label, fold, variant,
               CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
               r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2,
               ln(r0) AS g0, ln(r1) AS g1, ln(r2) AS g2,
               CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS pred_label
        FROM (SELECT o_custkey AS subject_id, o_orderkey AS instance_id, o_custkey % 3 AS true_label,
                     o_custkey % 5 AS fold, o_orderpriority AS variant,
                     CAST(1 + (o_orderkey * 7 + o_custkey) % 101 AS DOUBLE) AS r0,
                     CAST(1 + (o_orderkey * 11 + o_custkey) % 101 AS DOUBLE) AS r1,
                     CAST(1 + (o_orderkey * 15 + o_custkey) % 101 AS DOUBLE) AS r2 FROM orders)""",
    # one row per (instance, class)
    "v_scores": """
        SELECT subject_id, instance_id, split, fold, variant, true_label, pred_label, k,
               CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM v_preds, range(3) r(k)""",
}
