"""Evaluation: confusion, ranking metrics, thresholds, calibration, resampling, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.sources.staging import staged


def confusion(scored: DataFrame, keys: list[str], label: str = "label", flag: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision and recall (1 where nothing was flagged or there was nothing to find)."""
    on = F.col("flagged") if flag is None else flag
    n = lambda a, b: F.sum(((F.col(label) == a) & (on == F.lit(b))).cast("long"))
    g = scored.groupBy(*keys) if keys else scored.groupBy()
    c = g.agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(1, False).alias("fn"), n(0, False).alias("tn"))
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    return c.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})


def by_score(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score", ranges: int = 256) -> DataFrame:
    """Counts of each different score with running totals from the highest, which AUC, AP and thresholds are read from.

    Scores are summed up first. Their span is cut into ``ranges`` of about as many scores each; a running total is that of
    the ranges above, of which there are few, and that inside the range, which is a window of its own. So no task sorts all
    scores, whether there are keys or not.
    """
    g = scored.groupBy(*keys, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    g = staged(g, "scores")  # rows are worked out once, and cuts are those of the different scores, which the windows sort
    cuts = g.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    g = g.withColumn("_range", F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>"), lambda x: x <= F.col("score"))))
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = g.groupBy(*keys, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    totals = totals.withColumns({"_tp": F.coalesce(F.sum("_pos").over(above), F.lit(0)), "_fp": F.coalesce(F.sum("_neg").over(above), F.lit(0))}).drop("_pos", "_neg")
    w = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*keys, "_range"]]
    both = g.alias("g").join(totals.alias("t"), on).select("g.*", "t._tp", "t._fp")
    return both.withColumns({"tp": F.col("_tp") + F.sum("pos").over(w), "fp": F.col("_fp") + F.sum("neg").over(w)}).drop("_range", "_tp", "_fp")


def ranking(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC (ties count half), average precision and Brier score."""
    s = by_score(scored, keys, label, score)
    g = s.groupBy(*keys) if keys else s.groupBy()
    out = g.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("pos") * (1 - F.col("score")) ** 2 + F.col("neg") * F.col("score") ** 2).alias("b"),
    )
    return out.select(*keys, "positives", "negatives", F.when(F.col("positives") * F.col("negatives") > 0, F.col("u") / (F.col("positives") * F.col("negatives"))).alias("roc_auc"), F.when(F.col("positives") > 0, F.col("ap") / F.col("positives")).alias("average_precision"), (F.col("b") / (F.col("positives") + F.col("negatives"))).alias("brier"))


def threshold_for_precision(scored: DataFrame, keys: list[str], target: float, least_flagged: int = 30) -> DataFrame:
    """The lowest score from which on precision reaches the target with enough rows flagged."""
    s = by_score(scored, keys).withColumn("flagged", F.col("tp") + F.col("fp"))
    ok = s.where((F.col("flagged") >= least_flagged) & (F.col("tp") / F.col("flagged") >= target))
    g = ok.groupBy(*keys) if keys else ok.groupBy()
    return g.agg(F.min("score").alias("threshold"), F.max("flagged").alias("flagged"))


def threshold_for_fpr(scored: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """The score that only ``rate`` of the negatives pass: an exact linear quantile (A14). Those of one score hold places
    that follow from the running totals, so the two places around the quantile are read off, not sorted out."""
    s = by_score(scored.where("label = 0"), keys)
    n = s.groupBy(*keys).agg(F.sum("neg").alias("negatives")) if keys else s.agg(F.sum("neg").alias("negatives"))
    at = n.withColumns({"_at": (F.col("negatives") - 1) * (1 - rate)}).withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    d = s.alias("s").join(F.broadcast(at.alias("n")), on) if keys else s.crossJoin(F.broadcast(at))  # one row, or one a key
    d = d.select(*[F.col(f"s.{k}") if keys else k for k in keys], "score", "neg", "fp", "negatives", "_at", "_low", "_high")
    first = F.col("negatives") - F.col("fp")
    holds = lambda place: F.col(place).between(first, first + F.col("neg") - 1)
    g = d.groupBy(*keys, "negatives", "_at", "_low")
    found = g.agg(F.max(F.when(holds("_low"), F.col("score"))).alias("_a"), F.max(F.when(holds("_high"), F.col("score"))).alias("_b"))
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_low"))).alias("threshold"), "negatives")


def class_weights(labels: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    c = labels.groupBy(label).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return c.join(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts of two classifiers and the exact two-sided probability, from log-binomials."""
    c = pairs.agg(F.sum((F.col("a_right") & ~F.col("b_right")).cast("long")).alias("a_only"), F.sum((~F.col("a_right") & F.col("b_right")).cast("long")).alias("b_only"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # ln C(n, i) by a running sum of logs, and the tail beside it; n is the number of disagreements.
    start = F.struct(F.lit(0.0).alias("log_c"), F.exp(-n * math.log(2)).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        grown = s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.when(i <= k, F.struct(grown.alias("log_c"), (s["tail"] + F.exp(grown - n * math.log(2))).alias("tail"))).otherwise(s)

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["tail"]
    return c.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def bootstrap(scored: DataFrame, id_col: str, rounds: int = 50) -> DataFrame:
    """Accuracy of each of two classifiers in every round of a Poisson bootstrap whose weights are hashed from (row, round),
    so that any partitioning gives the same rounds (A16)."""
    r = scored.select(id_col, "a_right", "b_right", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("round").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1e6
    w, p, total = F.lit(0), math.exp(-1), 0.0
    for k in range(6):  # Poisson(1) by its distribution function
        total += p
        w = w + (u >= total).cast("int")
        p /= k + 1
    weighted = r.withColumn("w", w)
    return weighted.groupBy("round").agg((F.sum(F.col("w") * F.col("a_right").cast("int")) / F.sum("w")).alias("a"), (F.sum(F.col("w") * F.col("b_right").cast("int")) / F.sum("w")).alias("b"))


def stratified_split(rows: DataFrame, id_col: str, label: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """A split by the order of hashes in each class (ML2). The place in that order is the rank of a hash bucket plus the rank
    inside it, so a class of most rows is ranked by many tasks."""
    h = F.sha2(F.col(id_col).cast("string"), 256)
    d = rows.withColumns({"_h": h, "_b": F.substring(h, 1, 3)})
    counts = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumns({"_before": F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), "_total": F.sum("_n").over(Window.partitionBy(label))}).drop("_n")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col)) + F.coalesce("_before", F.lit(0)) - 1
    split = F.when(F.col("_place") < F.floor(F.col("_total") * train), "train").when(F.col("_place") < F.floor(F.col("_total") * (train + valid)), "valid").otherwise("test")
    return d.join(before, [label, "_b"]).withColumn("_place", place).withColumn("split", split).drop("_h", "_b", "_before", "_total", "_place")


def retrain_gate(status: DataFrame, least_new: int = 50, least_total: int = 20, least_each: int = 5) -> DataFrame:
    """Whether labels suffice for a new training (ST6)."""
    n = lambda v: F.sum((F.col("label") == v).cast("long"))
    g = status.agg(F.count("*").alias("total"), n(1).alias("real"), n(0).alias("fake"), F.sum(F.col("is_new").cast("long")).alias("new"))
    return g.withColumn("retrain", (F.col("new") >= least_new) & (F.col("total") >= least_total) & (F.col("real") >= least_each) & (F.col("fake") >= least_each))


def promote(old_f1: float | None, new_f1: float, drop: float = 0.015) -> bool:
    """A new model may replace the old one unless its F1 fell by more than ``drop`` (ML6)."""
    return old_f1 is None or new_f1 + drop >= old_f1


def temperature(logits: list[float], labels: list[int]) -> float:
    """The temperature of least log loss on kept-aside logits (ML7's calibration)."""
    def loss(t: float) -> float:
        z = [(x / t) * (1 if y else -1) for x, y in zip(logits, labels, strict=True)]
        return sum(math.log1p(math.exp(-v)) if v > -30 else -v for v in z) / max(1, len(z))

    return min((0.25 * 1.1**k for k in range(50)), key=loss)
