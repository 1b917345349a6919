"""Evaluation of one score over pairs whose sources stay together: hard negatives, out-of-fold calibration, thresholds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.operators import metrics
from candor.sources.staging import staged


def with_hard_negatives(pairs: DataFrame, group: str, other: str, score: str, most: int = 10) -> DataFrame:
    """Adds ``hard``: the ``most`` negatives of each source that score highest, ties by ``other``."""
    negatives = pairs.where(F.col("label") == 0).select(group, F.col(score).alias("_s"), F.col(other).alias("_o"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_s"), "_o"))
    # Of each source only the last of its hard ones is sought: each task keeps its first few, and no task sorts all negatives.
    last = staged(negatives.withColumn("_r", place).where(F.col("_r") <= most).groupBy(F.col(group).alias("_g")).agg(F.max_by(F.struct("_s", "_o"), "_r").alias("_l")), "last")
    after = F.when(F.col("_l._s").isNull(), F.col(score).isNull() & (F.col(other) > F.col("_l._o"))).otherwise(F.col(score).isNull() | (F.col(score) < F.col("_l._s")) | ((F.col(score) == F.col("_l._s")) & (F.col(other) > F.col("_l._o"))))
    return pairs.join(last, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("hard", (F.col("label") == 0) & ~after).drop("_g", "_l")


def fits(pairs: DataFrame, fold: str, score: str, folds: int, strength: float = 100.0, steps: int = 12) -> list[tuple[float, float] | None]:
    """(slope, intercept) of a logistic curve of each fold, learned from the others with both classes weighing the same and
    the slope held by 1 / ``strength``: Newton steps, each one aggregation for all folds, of which only sums reach the
    driver. None where the others lack a class."""
    x, y, out = F.col(score), F.col("label"), [F.col(fold) != k for k in range(folds)]
    n = pairs.agg(*[F.count(F.when(o & (y == c), 1)) for o in out for c in (0, 1)]).first()
    curve = lambda k: 1 / (1 + F.exp(-(x * found[k][0] + found[k][1])))
    sizes = [(n[2 * k], n[2 * k + 1]) for k in range(folds)]
    found: list[tuple[float, float] | None] = [(0.0, 0.0) if a and b else None for a, b in sizes]
    open_ = [k for k in range(folds) if found[k]]
    for _ in range(steps if open_ else 0):
        sums = []
        for k in open_:
            (none, some), p = sizes[k], F.col(f"_p{k}")
            w = F.when(y == 1, (none + some) / (2.0 * some)).otherwise((none + some) / (2.0 * none))
            sums += [F.sum(v) for v in (w * (p - y) * x, w * (p - y), w * p * (1 - p) * x * x, w * p * (1 - p) * x, w * p * (1 - p))]
        made = pairs.withColumns({f"_p{k}": F.when(out[k], curve(k)) for k in open_}).agg(*sums).first()  # each curve once a row; null in its own fold
        for i, k in enumerate(open_):
            gx, g1, hxx, hx, h1 = made[5 * i : 5 * i + 5]
            b, a = found[k]
            gx, hxx = gx + b / strength, hxx + 1 / strength
            det = hxx * h1 - hx * hx
            if det > 0 and math.isfinite(det):
                found[k] = (b - (h1 * gx - hx * g1) / det, a - (hxx * g1 - hx * gx) / det)
    return found


def out_of_fold(pairs: DataFrame, fold: str, score: str, folds: int = 5, **how) -> DataFrame:
    """Pairs with ``probability`` by the curve that never saw their fold, six places; pairs without a score or label, or
    whose other folds lack a class, are left out."""
    known = pairs.where(F.col(score).isNotNull() & F.col("label").isNotNull())
    curves = fits(known, fold, score, folds, **how)
    p = F.lit(None).cast("double")
    for k, c in enumerate(curves):
        if c:
            p = F.when(F.col(fold) == k, F.round(1 / (1 + F.exp(-(F.col(score) * c[0] + c[1]))), 6)).otherwise(p)
    return known.withColumn("probability", p).where(F.col("probability").isNotNull())


def summary(scored: DataFrame, missed: float = 0.05, passed: float = 0.03) -> DataFrame:
    """One row: AUC against all and against hard negatives, ``same_at`` (reached by ``passed`` of the negatives),
    ``different_below`` (not passed by ``missed`` of the positives), and what the two thresholds do to each kind of pair."""
    s = scored.select("label", "hard", F.col("probability").alias("score"))
    auc = lambda rows, name: metrics.ranking(rows, []).select(F.round("roc_auc", 6).alias(name))
    same_at = metrics.threshold_for_fpr(s, [], passed).select(F.round("threshold", 8).alias("same_at"))
    turned = s.select((1 - F.col("label")).alias("label"), (-F.col("score")).alias("score"))
    below = metrics.threshold_for_fpr(turned, [], missed).select(F.round(-F.col("threshold"), 8).alias("different_below"))
    limits = auc(s, "auc").join(auc(s.where((F.col("label") == 1) | F.col("hard")), "auc_hard")).join(same_at).join(below)  # one row each
    rows = s.join(F.broadcast(limits))
    share = lambda of, on, name: F.round(F.avg(F.when(of, on.cast("double"))), 6).alias(name)
    yes, no = F.col("label") == 1, F.col("label") == 0
    high, low = F.col("score") >= F.col("same_at"), F.col("score") <= F.col("different_below")
    return rows.groupBy("auc", "auc_hard", "same_at", "different_below").agg(
        F.count("*").alias("pairs"), F.count(F.when(yes, 1)).alias("same"), F.count(F.when(F.col("hard"), 1)).alias("hard"),
        share(yes, high, "same_called_same"), share(no, high, "different_called_same"), share(yes, low, "same_called_different"), share(no, low, "different_called_different"), share(F.col("hard"), high, "hard_called_same"), share(F.col("hard"), low, "hard_called_different"),
    )
