"""From window predictions to subject decisions, metrics and reports.

A prediction table has ids, true_label, pred_label and ``prob`` (array of class probabilities). Metrics work
on counts or on ties of scores, so nothing needs the rows of a group in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_sum, argmax_first, c, over, pick_first, softmax
from .ordered import attach, quantiles, tie_table

VOTE_KEYS = ("split", "fold", "subject_id")


# ---- voting -------------------------------------------------------------------------------------

def _normalized(arr: Column, floor: float) -> Column:
    """Clip at 0 (or at ``floor`` when it is a probability floor) and divide by the sum."""
    clipped = F.transform(arr, lambda v: F.greatest(v, F.lit(floor if floor > 1e-10 else 0.0)))
    total = F.greatest(a_sum(clipped), F.lit(1e-12))
    return F.element_at(F.transform(F.array(total), lambda s: F.transform(clipped, lambda v: v / s)), 1)


def _mean_array(col: str, n: int) -> Column:
    return F.array(*[F.avg(F.get(col, k)) for k in range(n)])


def _one_label(label: str) -> Column:
    """The label of a group; mixed labels raise."""
    return F.when(F.min(label) == F.max(label), F.min(label)).otherwise(F.raise_error(F.lit("mixed true labels in one group")))


def _voted(g: DataFrame, method: str) -> DataFrame:
    return g.withColumn("pred_label", argmax_first("prob")).withColumn("aggregation_method", F.lit(method))


def soft_vote(preds: DataFrame, n_classes: int, keys: Sequence[str] = VOTE_KEYS, floor: float = 1e-12) -> DataFrame:
    """EVA01: mean probability per group, clipped and renormalized; first class on ties; null keys form a group."""
    g = preds.groupBy(*keys).agg(_one_label("true_label").alias("true_label"), F.count("*").alias("num_instances"), _mean_array("prob", n_classes).alias("_p"))
    return _voted(g.withColumn("prob", _normalized(F.col("_p"), floor)).drop("_p"), "soft_vote")


def mean_vote(preds: DataFrame, n_classes: int, keys: Sequence[str] = VOTE_KEYS, score: str = "auto") -> DataFrame:
    """EVA02: softmax of mean logits when there are logits, else mean probabilities."""
    if score == "probs" or (score == "auto" and "logit" not in preds.columns):
        return soft_vote(preds, n_classes, keys).withColumn("aggregation_method", F.lit("mean_vote_probs"))
    g = preds.groupBy(*keys).agg(_one_label("true_label").alias("true_label"), F.count("*").alias("num_instances"), _mean_array("logit", n_classes).alias("logit"))
    return _voted(g.withColumn("prob", softmax("logit")), "mean_vote_logits")


def hard_vote(preds: DataFrame, n_classes: int, keys: Sequence[str] = VOTE_KEYS) -> DataFrame:
    """EVA25: share of window votes per class as probability."""
    g = preds.groupBy(*keys).agg(_one_label("true_label").alias("true_label"), F.count("*").alias("num_instances"),
                                 F.array(*[F.avg(F.when(F.col("pred_label") == k, 1.0).otherwise(0.0)) for k in range(n_classes)]).alias("prob"))
    return _voted(g, "hard_vote")


def with_probabilities(preds: DataFrame, n_classes: int) -> DataFrame:
    """Probabilities from what is there: given, from logits, or one-hot of the predicted label."""
    if "prob" in preds.columns:
        return preds
    if "logit" in preds.columns:
        return preds.withColumn("prob", softmax("logit"))
    return preds.withColumn("prob", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.when(F.col("pred_label") == k, 1.0).otherwise(0.0)))


def aggregate_predictions(preds: DataFrame, n_classes: int, method: str = "soft", keys: Sequence[str] = VOTE_KEYS) -> DataFrame:
    """EVA03: 'soft', 'mean', 'hard' or 'identity' (every group must be one row)."""
    p = with_probabilities(preds, n_classes)
    if method == "identity":
        one = F.when(F.count("*") == 1, F.first("prob")).otherwise(F.raise_error(F.lit("identity needs one row per group")))
        g = p.groupBy(*keys).agg(F.first("true_label").alias("true_label"), F.count("*").alias("num_instances"), one.alias("prob"))
        return _voted(g, "identity")
    return {"soft": soft_vote, "mean": mean_vote, "hard": hard_vote}[method](p, n_classes, keys)


def branch_vote(branches: Sequence[DataFrame], n_classes: int, keys: Sequence[str]) -> DataFrame:
    """EVA04: mean probability of B prediction tables with equal key sets; a missing or repeated key raises."""
    b = len(branches)
    u = None
    for k, d in enumerate(branches):
        d = d.select(*keys, "prob", F.lit(k).alias("_b"))
        u = d if u is None else u.unionByName(d)
    ok = (F.count("*") == b) & (F.count_distinct("_b") == b)
    g = u.groupBy(*keys).agg(F.when(ok, _mean_array("prob", n_classes)).otherwise(F.raise_error(F.lit("branch keys do not align"))).alias("_p"))
    return g.withColumn("prob", _normalized(F.col("_p"), EPS)).drop("_p").withColumn("pred_label", argmax_first("prob")).withColumn("num_branches", F.lit(b))


def multicrop_vote(preds: DataFrame, m: int, n_classes: int, row: str = "row") -> DataFrame:
    """EVA26: mean score over blocks of m consecutive crops, with the label of the first."""
    g = preds.groupBy(F.floor(F.col(row) / m).alias("block")).agg(_mean_array("prob", n_classes).alias("prob"), F.min_by("true_label", row).alias("true_label"))
    return g.withColumn("pred_label", argmax_first("prob"))


# ---- attention ----------------------------------------------------------------------------------

def attention_weights(items: DataFrame, bag: Sequence[str], score: str = "score", mask: str | None = None) -> DataFrame:
    """EVA05: softmax of scores inside a bag; masked items get weight 0. Bag totals are joined back, so a bag may be large."""
    live = F.col(mask) if mask else F.lit(True)
    top = items.groupBy(*bag).agg(F.max(F.when(live, F.col(score))).alias("_m"))
    e = items.join(top, list(bag)).withColumn("_e", F.when(live, F.exp(F.col(score) - F.col("_m"))).otherwise(0.0)).drop("_m")
    tot = e.groupBy(*bag).agg(F.sum("_e").alias("_t"))
    return e.join(tot, list(bag)).withColumn("attention", F.coalesce(F.try_divide("_e", "_t"), F.lit(0.0))).drop("_e", "_t")


def pool_vectors(items: DataFrame, bag: Sequence[str], dim: int, how: str = "attention", x: str = "x") -> DataFrame:
    """EVA05: one vector per bag: attention-weighted sum, mean, sum or max per dimension."""
    f = {"attention": lambda k: F.sum(F.col("attention") * F.get(x, k)), "mean": lambda k: F.avg(F.get(x, k)),
         "sum": lambda k: F.sum(F.get(x, k)), "max": lambda k: F.max(F.get(x, k))}[how]
    return items.groupBy(*bag).agg(F.array(*[f(k) for k in range(dim)]).alias("pooled"))


def attention_concentration(items: DataFrame, bag: Sequence[str], attention: str = "attention") -> DataFrame:
    """EVA06: top-1, top-3 sum, normalized entropy, effective number 1 / sum w2 and its share of the bag."""
    tot = items.groupBy(*bag).agg(F.sum(attention).alias("_t"))
    w = items.join(tot, list(bag)).withColumn("_w", F.when(F.col("_t") > 0, F.col(attention) / F.col("_t")).otherwise(F.col(attention)))
    s = w.groupBy(*bag).agg(F.count("*").alias("bag_size"), F.max("_w").alias("top1_attention"), (-F.sum(F.col("_w") * F.ln(F.col("_w") + 1e-12))).alias("_h"), F.sum(F.col("_w") * F.col("_w")).alias("_q"))
    top = pick_first(w.select(*bag, "_w"), list(bag), F.desc("_w"), k=3).groupBy(*bag).agg(F.sum("_w").alias("top3_attention"))
    n = F.col("bag_size").cast("double")
    return s.join(top, list(bag)).select(*bag, "bag_size", "top1_attention", "top3_attention", (1 / F.col("_q")).alias("effective_num_segments"),
                                         (1 / F.col("_q") / n).alias("effective_fraction"), F.when(n > 1, F.col("_h") / F.ln(n)).otherwise(0.0).alias("normalized_entropy"))


def view_weights(wide: DataFrame, views: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long (keys.., view_name, weight, top1) from one weight column per view; the first view wins ties."""
    arr = F.array(*[F.col(v) for v in views])
    w = wide.withColumn("_top", F.element_at(F.array(*[F.lit(v) for v in views]), (argmax_first(arr) + 1).cast("int")))
    return w.unpivot([*keys, "_top"], list(views), "view_name", "weight").withColumn("top1", F.col("_top") == F.col("view_name")).drop("_top")


def view_summary(long: DataFrame) -> DataFrame:
    """EVA07: mean, population std and top-1 frequency per view."""
    return long.groupBy("view_name").agg(F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight"), F.avg(F.col("top1").cast("double")).alias("top1_frequency"))


def view_summary_by_subject(long: DataFrame, subject: str = "subject_id") -> DataFrame:
    """EVA07: mean and std per subject and view, and the view of largest mean."""
    s = long.groupBy(subject, "view_name").agg(F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight"))
    return s.withColumn("top1_view_subject", F.first("view_name").over(over([subject], F.desc("mean_weight"), "view_name")))


# ---- counts and rates ---------------------------------------------------------------------------

def confusion(preds: DataFrame, n_classes: int | None = None, keys: Sequence[str] = (), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """EVA08: (keys.., true_label, pred_label, count); with ``n_classes`` the full grid including zeros."""
    cm = preds.groupBy(*keys, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("count"))
    if n_classes is None:
        return cm
    lab = F.sequence(F.lit(0), F.lit(n_classes - 1))
    cell = F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("true_label").cast("int").alias("t"), F.col("pred_label").cast("int").alias("p")), "count")))
    g = cm.groupBy(*keys).agg(cell.alias("_m"))
    g = g.select(*keys, "_m", F.explode(lab).alias("true_label")).select(*keys, "_m", "true_label", F.explode(lab).alias("pred_label"))
    return g.select(*keys, "true_label", "pred_label", F.coalesce(F.try_element_at("_m", F.struct(F.col("true_label").alias("t"), F.col("pred_label").alias("p"))), F.lit(0)).alias("count"))


def confusion_wide(cm: DataFrame, n_classes: int, keys: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """EVA08/EVA24: one row per true label with a column per predicted label, optionally as shares of the row."""
    g = cm.groupBy(*keys, "true_label").agg(*[F.sum(F.when(F.col("pred_label") == k, F.col("count")).otherwise(0)).alias(f"pred_{k}") for k in range(n_classes)], F.sum("count").alias("_n"))
    if normalize:
        for k in range(n_classes):
            g = g.withColumn(f"pred_{k}", F.col(f"pred_{k}") / F.greatest("_n", F.lit(1)))
    return g.drop("_n")


def class_counts(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, support, predicted and total per label, over labels that occur as truth or prediction."""
    same = F.col("true_label") == F.col("pred_label")
    ends = F.array(F.struct(F.col("true_label").alias("label"), F.col("count").alias("s"), F.lit(0).cast("long").alias("p"), F.when(same, F.col("count")).otherwise(0).alias("tp")),
                   F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("s"), F.col("count").alias("p"), F.lit(0).cast("long").alias("tp")))
    g = cm.filter("count > 0").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.label").agg(F.sum("e.tp").alias("tp"), F.sum("e.s").alias("support"), F.sum("e.p").alias("predicted"))
    # one row per label here, so a window over the key is as small as the number of classes
    return g.withColumn("total", F.sum("support").over(over(list(keys))))


def class_rates(cm: DataFrame, keys: Sequence[str] = (), undefined: float | None = 0.0, add: float = 0.0, digits: int | None = None) -> DataFrame:
    """EVA10: one-vs-rest rates per label; an empty divisor gives ``undefined`` (None for null), or ``add`` is added to it;
    ``digits`` rounds."""
    k = class_counts(cm, keys)
    tp, s, p, n = F.col("tp"), F.col("support"), F.col("predicted"), F.col("total")
    tn = n - s - p + tp

    def rate(a, b):
        v = a / (b + add) if add else F.try_divide(a, b)
        v = F.coalesce(v, F.lit(undefined)) if undefined is not None else v
        return F.round(v, digits) if digits is not None else v

    return k.select(*keys, "label", "tp", (s - tp).alias("fn"), (p - tp).alias("fp"), tn.alias("tn"), rate(tp, s).alias("sensitivity"), rate(tn, n - s).alias("specificity"),
                    rate(tp, p).alias("precision"), rate(2 * tp, s + p).alias("f1"), rate(tp + tn, n).alias("accuracy"))


def summary_rates(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA09: accuracy; balanced accuracy over labels present in the truth; macro F1 over true and predicted labels."""
    k = class_counts(cm, keys)
    return k.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.try_divide("tp", F.nullif("support", F.lit(0)))).alias("balanced_accuracy"),
                                F.avg(2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("macro_f1"), F.sum("support").alias("n_samples"))


# ---- scores -------------------------------------------------------------------------------------

def class_scores(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest rows (keys.., class, p, pos)."""
    s = preds.select(*keys, "true_label", F.posexplode("prob").alias("class", "p"))
    return s.select(*keys, "class", "p", F.when(F.col("true_label") == F.col("class"), 1).otherwise(0).alias("pos"))


def score_ties(preds: DataFrame, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Distinct scores per class with ties, positives, and counts below: the basis of AUC, AP and curves.

    ``digits`` rounds scores first, so that averages equal up to the order of summation count as ties.
    """
    k = [*keys, "class"]
    s = class_scores(preds, keys)
    if digits is not None:
        s = s.withColumn("p", F.round("p", digits))
    t = tie_table(s, k, "p", {"pos": F.col("pos")})
    n = t.groupBy(*k).agg(F.sum("ties").alias("_N"), F.sum("pos").alias("_P"))
    return attach(t, n, k)


def roc_auc(ties: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA11 per class: rank AUC with half for ties; null when only one class is present."""
    k = [*keys, "class"]
    g = ties.groupBy(*k).agg(F.sum(F.col("avg_rank") * F.col("pos")).alias("_r"), F.max("_P").alias("support"), F.max("_N").alias("_N"))
    p, n = F.col("support"), F.col("_N")
    return g.withColumn("roc_auc", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * (n - p))).select(*k, "support", "roc_auc")


def pr_auc(ties: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA12 per class: average precision over distinct thresholds; null without positives."""
    k = [*keys, "class"]
    tp = F.col("_P") - F.col("cum_pos") + F.col("pos")
    shown = F.col("_N") - F.col("before")
    return ties.groupBy(*k).agg(F.max("_P").alias("support"), F.sum(F.try_divide(F.col("pos"), F.col("_P")) * tp / shown).alias("pr_auc"))


def over_classes(per_class: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted mean of the defined classes."""
    ok = F.col(value).isNotNull()
    return per_class.groupBy(*keys).agg(F.avg(value).alias(f"{value}_macro_ovr"), F.try_divide(F.sum(F.when(ok, F.col(value) * F.col("support"))), F.sum(F.when(ok, F.col("support")))).alias(f"{value}_weighted_ovr"),
                                        F.count(value).alias(f"{value}_valid_classes"))


def curve_points(ties: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA22: ROC and precision-recall points at each distinct threshold per class."""
    tp = F.col("_P") - F.col("cum_pos") + F.col("pos")
    shown = F.col("_N") - F.col("before")
    return ties.select(*keys, "class", F.col("p").alias("threshold"), F.try_divide(tp, F.col("_P")).alias("tpr"), F.try_divide(shown - tp, F.col("_N") - F.col("_P")).alias("fpr"),
                       F.try_divide(tp, shown).alias("precision"))


def brier(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA13: mean over rows of the squared distance between probabilities and the one-hot truth."""
    idx = F.sequence(F.lit(0), F.size("prob") - 1)
    d = F.zip_with("prob", idx, lambda p, k: F.pow(p - F.when(k == F.col("true_label"), 1.0).otherwise(0.0), F.lit(2)))
    return preds.groupBy(*keys).agg(F.avg(a_sum(d)).alias("brier_score"))


def calibration(preds: DataFrame, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """EVA23: mean predicted and observed frequency per class and nonempty bin; a score on an edge falls into the lower bin."""
    s = class_scores(preds)
    if strategy == "uniform":
        edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    else:
        q = quantiles(s, ["class"], "p", {f"_e{k}": k / bins for k in range(1, bins)})
        s = s.join(F.broadcast(q), "class")
        edges = F.array(*[F.col(f"_e{k}") for k in range(1, bins)])
    s = s.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("p"))))
    return s.groupBy("class", "bin").agg(F.avg("p").alias("mean_predicted"), F.avg("pos").alias("observed"), F.count("*").alias("n"))


def correctness(preds: DataFrame) -> DataFrame:
    """EVA24: correct flag, probability of the true class, largest probability."""
    return preds.withColumn("correct", F.col("true_label") == F.col("pred_label")).withColumn("prob_true", F.get("prob", F.col("true_label").cast("int"))).withColumn("prob_max", F.array_max("prob"))


# ---- losses on scored tables --------------------------------------------------------------------

def _at_class(values: Sequence[float] | None, label) -> Column:
    return F.lit(1.0) if values is None else F.get(F.array(*[F.lit(float(v)) for v in values]), c(label).cast("int"))


def losses(preds: DataFrame, n_classes: int, *, class_weights: Sequence[float] | None = None, alpha: Sequence[float] | float | None = None, gamma: float = 2.0,
           smoothing: float = 0.1, floor: float = EPS) -> DataFrame:
    """EVA14: per row cross-entropy, weighted cross-entropy and its weight, focal and label-smoothed loss."""
    p = F.greatest(F.get("prob", F.col("true_label").cast("int")), F.lit(floor))
    w = _at_class(class_weights, "true_label")
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else _at_class(alpha, "true_label")
    every = a_sum(F.transform("prob", lambda v: -F.ln(F.greatest(v, F.lit(floor)))))
    return (preds.withColumn("ce", -F.ln(p)).withColumn("weight", w).withColumn("weighted_ce", F.col("ce") * w)
            .withColumn("focal", a * F.pow(1 - p, F.lit(gamma)) * F.col("ce"))
            .withColumn("smoothed", (1 - smoothing) * F.col("ce") + smoothing / n_classes * every))


def mean_losses(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EVA14: means; the weighted cross-entropy is divided by the sum of weights."""
    return scored.groupBy(*keys).agg(F.avg("ce").alias("ce"), (F.sum("weighted_ce") / F.sum("weight")).alias("weighted_ce"), F.avg("focal").alias("focal"), F.avg("smoothed").alias("smoothed"))


def soft_target_loss(preds: DataFrame, target: str, floor: float = EPS) -> Column:
    """EVA14: cross-entropy against a probability target."""
    return -a_sum(F.zip_with(target, "prob", lambda t, p: t * F.ln(F.greatest(p, F.lit(floor)))))


def mix_targets(preds: DataFrame, n_classes: int, soft: str, hard_weight: float = 0.5, label: str = "true_label") -> DataFrame:
    """EVA15: h x one-hot + (1 - h) x soft target, renormalized."""
    idx = F.sequence(F.lit(0), F.lit(n_classes - 1))
    m = F.zip_with(idx, soft, lambda k, s: hard_weight * F.when(k == F.col(label), 1.0).otherwise(0.0) + (1 - hard_weight) * s)
    return preds.withColumn("_m", m).withColumn("_t", F.greatest(a_sum("_m"), F.lit(EPS))).withColumn("target", F.transform("_m", lambda v: v / F.col("_t"))).drop("_m", "_t")


def class_weights(subjects: DataFrame, n_classes: int, label: str = "true_label") -> DataFrame:
    """EVA16: N / (C n_c) over subjects; no weights (null) if a class is empty."""
    n = subjects.agg(F.count("*").alias("_N"), *[F.sum(F.when(F.col(label) == k, 1).otherwise(0)).alias(f"_n{k}") for k in range(n_classes)])
    full = F.least(*[F.col(f"_n{k}") for k in range(n_classes)]) > 0
    return n.select(F.posexplode(F.array(*[F.struct(F.col(f"_n{k}").alias("n"), F.when(full, F.col("_N") / (n_classes * F.col(f"_n{k}"))).alias("w")) for k in range(n_classes)])).alias("label", "s")).select("label", F.col("s.n").alias("n"), F.col("s.w").alias("weight"))


# ---- bundles and summaries ----------------------------------------------------------------------

def metric_bundle(preds: DataFrame, n_classes: int, keys: Sequence[str] = (), *, vote_keys: Sequence[str] | None = None) -> DataFrame:
    """EVA17: accuracy, balanced accuracy, macro F1, Brier, ROC AUC and PR AUC in one row per group; with ``vote_keys`` rows are
    first voted to subjects."""
    p = soft_vote(preds, n_classes, vote_keys) if vote_keys else preds
    base = summary_rates(confusion(p, keys=keys), keys)
    t = score_ties(p, keys, 12 if vote_keys else None)
    parts = [brier(p, keys), over_classes(roc_auc(t, keys), "roc_auc", keys), over_classes(pr_auc(t, keys), "pr_auc", keys)]
    for d in parts:
        base = attach(base, d, keys)
    return base


def cv_summary(folds: DataFrame, metrics: Sequence[str], group: str = "split") -> DataFrame:
    """EVA18: mean, population std, min, max and count per metric, by group and overall (group ALL)."""
    long = folds.unpivot([group], list(metrics), "metric", "value").filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    g = long.groupingSets([[F.col(group), F.col("metric")], [F.col("metric")]], F.col(group), F.col("metric")).agg(
        F.grouping(group).alias("_all"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return g.withColumn(group, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(group).cast("string"))).drop("_all")


def seed_means(folds: DataFrame, metrics: Sequence[str], seed: str = "split_seed", group: str = "split") -> DataFrame:
    """EVA18: mean over folds within a seed, then mean and sample std over seeds."""
    s = folds.groupBy(seed, group).agg(*[F.avg(m).alias(m) for m in metrics])
    return s.groupBy(group).agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def fold_rollup(folds: DataFrame, metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """EVA25: seed means with the sample std over folds (0 for one fold)."""
    return folds.groupBy(seed).agg(F.count("*").alias("num_folds"), *[f for m in metrics for f in (F.avg(m).alias(m), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std_across_folds"))])


def variant_summary(runs: DataFrame, variant: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """EVA19: mean, sample std, min, max, count and a ``mean ± std`` text per variant; nested config values group as JSON text."""
    keyed = runs
    for v in variant:
        if dict(runs.dtypes)[v].startswith(("struct", "map", "array")):
            keyed = keyed.withColumn(v, F.to_json(v))
    aggs = [f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.count(m).alias(f"{m}_count"))]
    g = keyed.groupBy(*variant).agg(*aggs)
    for m in metrics:
        text = F.when(F.col(f"{m}_std").isNull(), F.format_string("%.4f ± NA", F.col(f"{m}_mean"))).otherwise(F.format_string("%.4f ± %.4f", F.col(f"{m}_mean"), F.col(f"{m}_std")))
        g = g.withColumn(f"{m}_mean_std", text)
    return g


def confusion_over_runs(cms: DataFrame, run: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """EVA19: cell-wise sum, mean and sample std of full confusion grids over runs (0 for one run)."""
    return cms.groupBy(*keys, "true_label", "pred_label").agg(F.sum("count").alias("sum"), F.avg("count").alias("mean"), F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("std"), F.count_distinct(*run).alias("num_runs"))


def error_analysis(runs: DataFrame, n_classes: int, seed: str = "seed") -> DataFrame:
    """EVA20: per subject and true label over runs: errors, error rate, most frequent prediction (smallest on ties), entropy and
    confidence of the mean probability, mean and sample std per class, predictions by seed as JSON."""
    k = ["subject_id", "true_label"]
    wrong = F.when(F.col("true_label") != F.col("pred_label"), 1).otherwise(0)
    mean, std = _mean_array("prob", n_classes), F.array(*[F.coalesce(F.stddev_samp(F.get("prob", i)), F.lit(0.0)) for i in range(n_classes)])
    # votes per class instead of a list of predictions
    votes = F.array(*[F.sum(F.when(F.col("pred_label") == i, 1).otherwise(0)) for i in range(n_classes)])
    by_seed = F.to_json(F.sort_array(F.collect_list(F.struct(F.col(seed).alias("seed"), "pred_label"))))
    g = runs.groupBy(*k).agg(F.count_distinct(seed).alias("num_seeds"), F.count("*").alias("num_runs"), F.sum(wrong).alias("wrong_count"), F.avg(wrong).alias("error_rate"),
                             votes.alias("_v"), mean.alias("mean_prob"), std.alias("std_prob"), by_seed.alias("pred_labels_by_seed"))
    ent = a_sum(F.transform("mean_prob", lambda p: -F.greatest(p, F.lit(1e-12)) * F.log2(F.greatest(p, F.lit(1e-12)))))
    return g.withColumn("pred_mode", argmax_first("_v")).withColumn("mean_prob_entropy", ent).withColumn("mean_confidence", F.array_max("mean_prob")).drop("_v")


def difficult_subjects(errors: DataFrame) -> DataFrame:
    """EVA20: subjects with any error, hardest first."""
    return errors.filter("wrong_count > 0").orderBy(F.desc("error_rate"), F.desc("wrong_count"), "mean_confidence", "subject_id")


def leaderboard(runs: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """EVA21: runs in order of (column, descending), nulls last."""
    return runs.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in order])


def bucket_winners(runs: DataFrame, bucket: Sequence[str], order: Sequence[tuple[str, bool]], k: int = 1) -> DataFrame:
    """EVA21: the best k runs of each bucket."""
    return pick_first(runs, list(bucket), *[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in order], k=k, rank="rank")
