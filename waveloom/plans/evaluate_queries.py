"""Queries for votes, metrics and reports (EVA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .registry import query

_P = [f"prob_{k}" for k in range(3)]


def wide(df, col="prob"):
    return df.select("*", *[F.get(col, k).alias(f"{col}_{k}") for k in range(3)])


def argmax_sql(a, b, c):
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


_VOTE = "(SELECT split, fold, subject_id, min(true_label) AS true_label, count(*) AS num_instances, avg(p0) AS prob_0, avg(p1) AS prob_1, avg(p2) AS prob_2 FROM v_preds GROUP BY 1, 2, 3)"
_VOTED = f"(SELECT *, {argmax_sql(*_P)} AS pred_label FROM {_VOTE})"
_VCOLS = "split:s fold:i subject_id:i true_label:i num_instances:i prob_0:d10 prob_1:d10 prob_2:d10 pred_label:i"


@query("eva01_soft_vote", _VCOLS, f"SELECT * FROM {_VOTED}")
def _(t):
    return wide(ev.soft_vote(t.preds, 3))


@query("eva02_mean_vote_logits", _VCOLS, f"""
    SELECT *, {argmax_sql('g0', 'g1', 'g2')} AS pred_label, exp(g0) / (exp(g0) + exp(g1) + exp(g2)) AS prob_0, exp(g1) / (exp(g0) + exp(g1) + exp(g2)) AS prob_1,
      exp(g2) / (exp(g0) + exp(g1) + exp(g2)) AS prob_2
    FROM (SELECT split, fold, subject_id, min(true_label) AS true_label, count(*) AS num_instances, avg(g0) AS g0, avg(g1) AS g1, avg(g2) AS g2 FROM v_preds GROUP BY 1, 2, 3)""")
def _(t):
    return wide(ev.mean_vote(t.preds, 3))


@query("eva03_identity_vote", "instance_id:i true_label:i num_instances:i prob_0:d10 prob_1:d10 prob_2:d10 pred_label:i",
       "SELECT instance_id, true_label, 1 AS num_instances, p0 AS prob_0, p1 AS prob_1, p2 AS prob_2, pred_label FROM v_preds")
def _(t):
    return wide(ev.aggregate_predictions(t.preds.drop("prob"), 3, "identity", ["instance_id"]))


@query("eva04_branch_vote", "instance_id:i prob_0:d11 prob_1:d11 prob_2:d11 pred_label:i num_branches:i", f"""
    SELECT *, {argmax_sql('round(prob_0, 12)', 'round(prob_1, 12)', 'round(prob_2, 12)')} AS pred_label, 2 AS num_branches FROM (
      SELECT instance_id, (p0 + 0.5 * p0 + 0.5 * p1) / 2 AS prob_0, (p1 + 0.5 * p1 + 0.5 * p2) / 2 AS prob_1, (p2 + 0.5 * p2 + 0.5 * p0) / 2 AS prob_2 FROM v_preds)""")
def _(t):
    p = t.preds.select("instance_id", "prob")
    turn = F.transform("prob", lambda v, k: 0.5 * v + 0.5 * F.get("prob", (k + 1) % 3))
    return wide(ev.branch_vote([p, p.withColumn("prob", turn)], 3, ["instance_id"]))


_ATT = "(SELECT vec_id, subject_id, label, k, x, CAST(vec_id % 7 AS DOUBLE) / 3 AS score, vec_id % 4 <> 0 AS live FROM v_vec)"


@query("eva05_attention_pooling", "subject_id:i dim:i attention:d mean:d max:d", f"""
    SELECT subject_id, k AS dim, sum(CASE WHEN live THEN exp(score) ELSE 0 END * x) / sum(CASE WHEN live THEN exp(score) ELSE 0 END) AS attention, avg(x) AS mean, max(x) AS max
    FROM {_ATT} GROUP BY 1, 2""")
def _(t):
    v = t.vectors.withColumn("score", (F.col("vec_id") % 7).cast("double") / 3).withColumn("live", F.col("vec_id") % 4 != 0)
    w = ev.attention_weights(v, ["subject_id"], mask="live")
    parts = {h: ev.pool_vectors(w, ["subject_id"], 64, h).withColumnRenamed("pooled", h) for h in ("attention", "mean", "max")}
    j = parts["attention"].join(parts["mean"], "subject_id").join(parts["max"], "subject_id")
    return j.select("subject_id", F.posexplode(F.arrays_zip("attention", "mean", "max")).alias("dim", "z")).select("subject_id", "dim", "z.*")


_AW = """(SELECT subject_id, sampling_weight / sum(sampling_weight) OVER (PARTITION BY subject_id) AS w, row_number() OVER (PARTITION BY subject_id ORDER BY sampling_weight DESC) AS r FROM v_manifest)"""


@query("eva06_attention_concentration", "subject_id:i bag_size:i top1_attention:d top3_attention:d effective_num_segments:d effective_fraction:d normalized_entropy:d", f"""
    SELECT subject_id, count(*) AS bag_size, max(w) AS top1_attention, sum(CASE WHEN r <= 3 THEN w END) AS top3_attention, 1 / sum(w * w) AS effective_num_segments,
      1 / sum(w * w) / count(*) AS effective_fraction, -sum(w * ln(w + 1e-12)) / ln(count(*)) AS normalized_entropy FROM {_AW} GROUP BY 1""")
def _(t):
    return ev.attention_concentration(t.manifest, ["subject_id"], "sampling_weight")


def _views(t):
    return ev.view_weights(wide(t.preds.select("subject_id", "instance_id", "prob")), _P, ["subject_id", "instance_id"])


@query("eva07_view_summary", "view_name:s mean_weight:d std_weight:d top1_frequency:d", """
    SELECT 'prob_' || k AS view_name, avg(p) AS mean_weight, stddev_pop(p) AS std_weight, avg(CASE WHEN pred_label = k THEN 1.0 ELSE 0 END) AS top1_frequency FROM v_scores GROUP BY k""")
def _(t):
    return ev.view_summary(_views(t))


@query("eva07_view_summary_by_subject", "subject_id:i view_name:s mean_weight:d std_weight:d top1_view_subject:s", """
    SELECT *, first(view_name) OVER (PARTITION BY subject_id ORDER BY mean_weight DESC, view_name) AS top1_view_subject FROM (
      SELECT subject_id, 'prob_' || k AS view_name, avg(p) AS mean_weight, stddev_pop(p) AS std_weight FROM v_scores GROUP BY 1, 2)""")
def _(t):
    return ev.view_summary_by_subject(_views(t))


_GRID = "(SELECT split, a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM v_preds p WHERE p.split = s.split AND p.true_label = a.l AND p.pred_label = b.l) AS count FROM (SELECT DISTINCT split FROM v_preds) s, range(4) a(l), range(4) b(l))"


@query("eva08_confusion_grid", "split:s true_label:i pred_label:i count:i", f"SELECT * FROM {_GRID}")
def _(t):
    return ev.confusion(t.preds, 4, ["split"])


@query("eva08_confusion_pivot", "true_label:i pred_0:i pred_1:i pred_2:i", """
    SELECT true_label, count(*) FILTER (WHERE pred_label = 0) AS pred_0, count(*) FILTER (WHERE pred_label = 1) AS pred_1, count(*) FILTER (WHERE pred_label = 2) AS pred_2 FROM v_preds GROUP BY 1""")
def _(t):
    return ev.confusion_wide(ev.confusion(t.preds), 3)


def counts_sql(keys, src="v_preds"):
    return f"""(SELECT *, sum(support) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, label, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
      SELECT {keys}, true_label AS label, CASE WHEN true_label = pred_label THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM {src}
      UNION ALL SELECT {keys}, pred_label, 0, 0, 1 FROM {src}) GROUP BY ALL))"""


def rates_sql(keys, src="v_preds"):
    return f"""SELECT {keys}, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN tp / support END) AS balanced_accuracy, avg(2 * tp / (support + predicted)) AS macro_f1,
      sum(support) AS n_samples FROM {counts_sql(keys, src)} GROUP BY {keys}"""


@query("eva09_summary_rates", "split:s fold:i accuracy:d balanced_accuracy:d macro_f1:d n_samples:i", rates_sql("split, fold"))
def _(t):
    return ev.summary_rates(ev.confusion(t.preds, keys=["split", "fold"]), ["split", "fold"])


@query("eva10_class_rates", "split:s label:i tp:i fn:i fp:i tn:i sensitivity:d specificity:d precision:d f1:d accuracy:d", f"""
    SELECT split, label, tp, support - tp AS fn, predicted - tp AS fp, total - support - predicted + tp AS tn, coalesce(tp / nullif(support, 0), 0) AS sensitivity,
      coalesce((total - support - predicted + tp) / nullif(total - support, 0), 0) AS specificity, coalesce(tp / nullif(predicted, 0), 0) AS precision, 2 * tp / (support + predicted) AS f1,
      (total - support - predicted + 2 * tp) / total AS accuracy FROM {counts_sql('split')}""")
def _(t):
    return ev.class_rates(ev.confusion(t.preds, keys=["split"]), ["split"])


_RANKED = """(SELECT split, k, p, CASE WHEN true_label = k THEN 1 ELSE 0 END AS pos, rank() OVER (PARTITION BY split, k ORDER BY p) + (count(*) OVER (PARTITION BY split, k, p) - 1) / 2 AS r FROM v_scores)"""
_AUC = f"""(SELECT split, k AS class, sum(pos) AS support, (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (count(*) - sum(pos)), 0) AS roc_auc FROM {_RANKED} GROUP BY 1, 2)"""


@query("eva11_roc_auc", "split:s class:i support:i roc_auc:d", f"SELECT * FROM {_AUC}")
def _(t):
    return ev.roc_auc(ev.score_ties(t.preds, ["split"]), ["split"])


@query("eva11_roc_auc_means", "split:s roc_auc_macro_ovr:d roc_auc_weighted_ovr:d roc_auc_valid_classes:i",
       f"SELECT split, avg(roc_auc) AS roc_auc_macro_ovr, sum(roc_auc * support) / sum(support) AS roc_auc_weighted_ovr, count(roc_auc) AS roc_auc_valid_classes FROM {_AUC} GROUP BY 1")
def _(t):
    return ev.over_classes(ev.roc_auc(ev.score_ties(t.preds, ["split"]), ["split"]), "roc_auc", ["split"])


_CURVE = """(SELECT split, k AS class, p AS threshold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS shown, sum(pos) OVER (PARTITION BY split, k) AS np, sum(n) OVER (PARTITION BY split, k) AS nn FROM (
      SELECT split, k, p, count(*) AS n, sum(CASE WHEN true_label = k THEN 1 ELSE 0 END) AS pos FROM v_scores GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY split, k ORDER BY p DESC))"""


@query("eva12_pr_auc", "split:s class:i support:i pr_auc:d", f"SELECT split, class, max(np) AS support, sum(pos / np * tp / shown) AS pr_auc FROM {_CURVE} GROUP BY 1, 2")
def _(t):
    return ev.pr_auc(ev.score_ties(t.preds, ["split"]), ["split"])


_BRIER = "avg(CASE WHEN true_label = 0 THEN pow(p0 - 1, 2) ELSE p0 * p0 END + CASE WHEN true_label = 1 THEN pow(p1 - 1, 2) ELSE p1 * p1 END + CASE WHEN true_label = 2 THEN pow(p2 - 1, 2) ELSE p2 * p2 END)"


@query("eva13_brier", "split:s brier_score:d", f"SELECT split, {_BRIER} AS brier_score FROM v_preds GROUP BY 1")
def _(t):
    return ev.brier(t.preds, ["split"])


@query("eva14_losses", "split:s ce:d weighted_ce:d focal:d smoothed:d", """
    SELECT split, avg(-ln(p)) AS ce, sum(-ln(p) * w) / sum(w) AS weighted_ce, avg(0.25 * pow(1 - p, 2) * -ln(p)) AS focal, avg(0.9 * -ln(p) + 0.1 / 3 * (-ln(p0) - ln(p1) - ln(p2))) AS smoothed
    FROM (SELECT *, CASE true_label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, CASE true_label WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END AS w FROM v_preds) GROUP BY 1""")
def _(t):
    return ev.mean_losses(ev.losses(t.preds, 3, class_weights=[1.0, 2.0, 0.5], alpha=0.25), ["split"])


@query("eva15_mixed_targets", "instance_id:i target_0:d11 target_1:d11 target_2:d11 loss:d9", """
    SELECT instance_id, t0 AS target_0, t1 AS target_1, t2 AS target_2, -(t0 * ln(p0) + t1 * ln(p1) + t2 * ln(p2)) AS loss FROM (
      SELECT *, 0.7 * (true_label = 0)::INT + 0.3 * p1 AS t0, 0.7 * (true_label = 1)::INT + 0.3 * p2 AS t1, 0.7 * (true_label = 2)::INT + 0.3 * p0 AS t2 FROM v_preds)""")
def _(t):
    p = t.preds.withColumn("soft", F.array(F.get("prob", 1), F.get("prob", 2), F.get("prob", 0)))
    m = ev.mix_targets(p, 3, "soft", 0.7)
    return wide(m.withColumn("loss", ev.soft_target_loss(m, "target")), "target")


@query("eva16_class_weights", "label:i n:i weight:d", """
    SELECT label, count(*) AS n, sum(count(*)) OVER () / (3 * count(*)) AS weight FROM (SELECT DISTINCT subject_id, true_label AS label FROM v_preds) GROUP BY 1""")
def _(t):
    return ev.class_weights(t.preds.select("subject_id", "true_label").distinct(), 3)


def _bundle_sql():
    sc = f"(SELECT split, subject_id, true_label, pred_label, k, round(CASE k WHEN 0 THEN prob_0 WHEN 1 THEN prob_1 ELSE prob_2 END, 12) AS p FROM {_VOTED}, range(3) r(k))"
    return f"""WITH r AS ({rates_sql('split', _VOTED)}),
    a AS (SELECT split, avg(auc) AS roc_auc_macro_ovr FROM (SELECT split, k, (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))) AS auc FROM (
      SELECT split, k, CASE WHEN true_label = k THEN 1 ELSE 0 END AS pos, rank() OVER (PARTITION BY split, k ORDER BY p) + (count(*) OVER (PARTITION BY split, k, p) - 1) / 2 AS r FROM {sc}) GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT split, {_BRIER.replace('p0', 'prob_0').replace('p1', 'prob_1').replace('p2', 'prob_2')} AS brier_score FROM {_VOTED} GROUP BY 1)
    SELECT r.*, roc_auc_macro_ovr, brier_score FROM r JOIN a USING (split) JOIN b USING (split)"""


@query("eva17_metric_bundle", "split:s accuracy:d9 balanced_accuracy:d9 macro_f1:d9 n_samples:i brier_score:d9 roc_auc_macro_ovr:d9", _bundle_sql())
def _(t):
    return ev.metric_bundle(t.preds, 3, ["split"], vote_keys=["split", "fold", "subject_id"])


def fold_metrics(t):
    k = ["split", "fold", "variant"]
    return ev.summary_rates(ev.confusion(t.preds, keys=k), k)


FOLDS = f"({rates_sql('split, fold, variant')})"


@query("eva18_cv_summary", "split:s metric:s mean:d std:d min:d max:d n:i", f"""
    SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) AS n
    FROM (UNPIVOT {FOLDS} ON accuracy, balanced_accuracy, macro_f1 INTO NAME metric VALUE value) GROUP BY GROUPING SETS ((split, metric), (metric))""")
def _(t):
    return ev.cv_summary(fold_metrics(t), ["accuracy", "balanced_accuracy", "macro_f1"])


@query("eva18_seed_means", "variant:s accuracy_mean:d accuracy_std:d macro_f1_mean:d macro_f1_std:d", f"""
    SELECT variant, avg(a) AS accuracy_mean, stddev_samp(a) AS accuracy_std, avg(m) AS macro_f1_mean, stddev_samp(m) AS macro_f1_std
    FROM (SELECT split, variant, avg(accuracy) AS a, avg(macro_f1) AS m FROM {FOLDS} GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return ev.seed_means(fold_metrics(t), ["accuracy", "macro_f1"], "split", "variant")


@query("eva19_variant_summary", "variant:s accuracy_mean:d accuracy_std:d accuracy_min:d accuracy_max:d accuracy_count:i accuracy_mean_std:s", f"""
    SELECT variant, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_std, min(accuracy) AS accuracy_min, max(accuracy) AS accuracy_max, count(accuracy) AS accuracy_count,
      printf('%.4f ± %.4f', avg(accuracy), stddev_samp(accuracy)) AS accuracy_mean_std FROM (SELECT *, '{{"name":"' || variant || '"}}' AS v FROM {FOLDS}) GROUP BY 1""".replace("SELECT variant,", "SELECT v AS variant,", 1).replace("GROUP BY 1", "GROUP BY v"))
def _(t):
    f = fold_metrics(t).withColumn("variant", F.struct(F.col("variant").alias("name")))
    return ev.variant_summary(f, ["variant"], ["accuracy"])


@query("eva19_confusion_over_runs", "true_label:i pred_label:i sum:i mean:d std:d num_runs:i", """
    SELECT true_label, pred_label, sum(n) AS sum, avg(n) AS mean, stddev_samp(n) AS std, count(*) AS num_runs FROM (
      SELECT v.variant, a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM v_preds p WHERE p.variant = v.variant AND p.true_label = a.l AND p.pred_label = b.l) AS n
      FROM (SELECT DISTINCT variant FROM v_preds) v, range(3) a(l), range(3) b(l)) GROUP BY 1, 2""")
def _(t):
    return ev.confusion_over_runs(ev.confusion(t.preds, 3, ["variant"]), ["variant"])


_ERR = """(SELECT subject_id, true_label, count(DISTINCT instance_id) AS num_seeds, count(*) AS num_runs, sum((true_label <> pred_label)::INT) AS wrong_count, avg((true_label <> pred_label)::INT) AS error_rate,
    CASE WHEN sum((pred_label = 0)::INT) >= greatest(sum((pred_label = 1)::INT), sum((pred_label = 2)::INT)) THEN 0 WHEN sum((pred_label = 1)::INT) >= sum((pred_label = 2)::INT) THEN 1 ELSE 2 END AS pred_mode,
    -(avg(p0) * log2(avg(p0)) + avg(p1) * log2(avg(p1)) + avg(p2) * log2(avg(p2))) AS mean_prob_entropy, greatest(avg(p0), avg(p1), avg(p2)) AS mean_confidence, coalesce(stddev_samp(p0), 0) AS std_prob_0,
    '[' || string_agg('{"seed":' || instance_id || ',"pred_label":' || pred_label || '}', ',' ORDER BY instance_id) || ']' AS pred_labels_by_seed FROM v_preds GROUP BY 1, 2)"""


@query("eva20_error_analysis", "subject_id:i true_label:i num_seeds:i num_runs:i wrong_count:i error_rate:d pred_mode:i mean_prob_entropy:d mean_confidence:d std_prob_0:d pred_labels_by_seed:s", f"SELECT * FROM {_ERR}")
def _(t):
    return wide(ev.error_analysis(t.preds, 3, "instance_id"), "std_prob")


@query("eva20_difficult_subjects", "subject_id:i wrong_count:i error_rate:d", f"SELECT * FROM {_ERR} WHERE wrong_count > 0")
def _(t):
    return ev.difficult_subjects(ev.error_analysis(t.preds, 3, "instance_id"))


@query("eva21_bucket_winners", "split:s fold:i variant:s accuracy:d rank:i", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY accuracy DESC NULLS LAST, macro_f1 DESC NULLS LAST, fold, variant) AS rank FROM {FOLDS}) WHERE rank <= 2""")
def _(t):
    return ev.bucket_winners(fold_metrics(t), ["split"], [("accuracy", True), ("macro_f1", True), ("fold", False), ("variant", False)], 2)


@query("eva21_leaderboard", "split:s fold:i variant:s accuracy:d", f"SELECT * FROM {FOLDS}")
def _(t):
    return ev.leaderboard(fold_metrics(t), [("accuracy", True), ("macro_f1", True), ("balanced_accuracy", True), ("n_samples", False)])


@query("eva22_curve_points", "split:s class:i threshold:d tpr:d fpr:d precision:d", f"SELECT split, class, threshold, tp / np AS tpr, (shown - tp) / (nn - np) AS fpr, tp / shown AS precision FROM {_CURVE}")
def _(t):
    return ev.curve_points(ev.score_ties(t.preds, ["split"]), ["split"])


@query("eva23_calibration_uniform", "class:i bin:i mean_predicted:d observed:d n:i", """
    SELECT k AS class, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e < p)) AS bin, avg(p) AS mean_predicted, avg((true_label = k)::INT) AS observed, count(*) AS n
    FROM v_scores GROUP BY 1, 2""")
def _(t):
    return ev.calibration(t.preds)


@query("eva23_calibration_quantile", "class:i bin:i mean_predicted:d observed:d n:i", """
    SELECT s.k AS class, len(list_filter(q, lambda e: e < p)) AS bin, avg(p) AS mean_predicted, avg((true_label = s.k)::INT) AS observed, count(*) AS n
    FROM v_scores s JOIN (SELECT k, quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM v_scores GROUP BY 1) q ON q.k = s.k GROUP BY 1, 2""")
def _(t):
    return ev.calibration(t.preds, 5, "quantile")


@query("eva24_correctness", "instance_id:i correct:b prob_true:d10 prob_max:d10",
       "SELECT instance_id, true_label = pred_label AS correct, CASE true_label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS prob_true, greatest(p0, p1, p2) AS prob_max FROM v_preds")
def _(t):
    return ev.correctness(t.preds)


@query("eva24_confusion_shares", "true_label:i pred_0:d pred_1:d pred_2:d", """
    SELECT true_label, avg((pred_label = 0)::INT) AS pred_0, avg((pred_label = 1)::INT) AS pred_1, avg((pred_label = 2)::INT) AS pred_2 FROM v_preds GROUP BY 1""")
def _(t):
    return ev.confusion_wide(ev.confusion(t.preds), 3, normalize=True)


@query("eva25_hard_vote", _VCOLS, f"""
    SELECT *, {argmax_sql(*_P)} AS pred_label FROM (SELECT split, fold, subject_id, min(true_label) AS true_label, count(*) AS num_instances, avg((pred_label = 0)::INT) AS prob_0,
      avg((pred_label = 1)::INT) AS prob_1, avg((pred_label = 2)::INT) AS prob_2 FROM v_preds GROUP BY 1, 2, 3)""")
def _(t):
    return wide(ev.hard_vote(t.preds, 3))


@query("eva25_fold_rollup", "variant:s num_folds:i accuracy:d accuracy_std_across_folds:d", f"""
    SELECT variant, count(*) AS num_folds, avg(accuracy) AS accuracy, coalesce(stddev_samp(accuracy), 0) AS accuracy_std_across_folds FROM {FOLDS} GROUP BY 1""")
def _(t):
    return ev.fold_rollup(fold_metrics(t), ["accuracy"], "variant")


@query("eva26_multicrop_vote", "block:i true_label:i prob_0:d prob_1:d prob_2:d pred_label:i", f"""
    SELECT *, {argmax_sql(*_P)} AS pred_label FROM (SELECT instance_id // 5 AS block, arg_min(true_label, instance_id) AS true_label, avg(p0) AS prob_0, avg(p1) AS prob_1, avg(p2) AS prob_2 FROM v_preds GROUP BY 1)""")
def _(t):
    return wide(ev.multicrop_vote(t.preds, 5, 3, "instance_id"))
