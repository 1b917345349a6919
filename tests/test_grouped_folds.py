"""Out-of-fold curves and hard negatives against numpy."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from candor.operators import grouped_folds

KIND = "a long, b long, label int, x double, fold int"


def newton(x, y, strength=100.0):
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    t = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ t))
        t -= np.linalg.solve(m.T @ (m * (w * p * (1 - p))[:, None]) + np.diag([1 / strength, 0]), m.T @ (w * (p - y)) + np.array([t[0] / strength, 0]))
    return t


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    y = (r.random(600) < 0.2).astype(int)
    x = np.clip(r.normal(0.3 + 0.4 * y, 0.2), -1, 1).round(2)  # many ties
    return [(int(i % 12), int(i), int(y[i]), float(x[i]), int(i % 12 % 3)) for i in range(600)]


def test_curves_and_summary(spark, rows):
    d = grouped_folds.with_hard_negatives(spark.createDataFrame([*rows, (1, 9001, None, 0.5, 1), (1, 9002, 1, None, 1)], KIND), "a", "b", "x", 3)
    x, y, f = (np.array([r[i] for r in rows]) for i in (3, 2, 4))
    curves = [newton(x[f != k], y[f != k]) for k in range(3)]
    assert np.allclose(grouped_folds.fits(d.where("label IS NOT NULL AND x IS NOT NULL"), "fold", "x", 3), curves, atol=1e-6)
    p = np.array([1 / (1 + np.exp(-(v * curves[k][0] + curves[k][1]))) for v, k in zip(x, f, strict=True)]).round(6)
    hard = np.zeros(600, bool)
    for a in range(12):
        own = sorted((i for i, r in enumerate(rows) if r[0] == a and not r[2]), key=lambda i: (-x[i], i))
        hard[own[:3]] = True
    (s,) = grouped_folds.summary(grouped_folds.out_of_fold(d, "fold", "x", 3)).collect()
    auc = lambda n: np.mean([(u > v) + (u == v) / 2 for u in p[y == 1] for v in p[n]])
    assert (s["pairs"], s["same"], s["hard"]) == (600, y.sum(), 36)
    assert s["auc"] == pytest.approx(auc(y == 0), abs=1e-5) and s["auc_hard"] == pytest.approx(auc(hard), abs=1e-5)
    assert s["same_at"] == pytest.approx(np.quantile(p[y == 0], 0.97), abs=1e-5) and s["different_below"] == pytest.approx(np.quantile(p[y == 1], 0.05), abs=1e-5)
    assert s["same_called_same"] == pytest.approx(np.mean(p[y == 1] >= s["same_at"]), abs=1e-6)
    assert s["hard_called_same"] == pytest.approx(np.mean(p[hard] >= s["same_at"]), abs=1e-6)


def test_a_fold_whose_others_lack_a_class_is_left_out(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.9, 0), (1, 2, 0, 0.1, 0), (2, 3, 0, 0.2, 1), (2, 4, 0, 0.3, 1)], KIND)
    assert grouped_folds.fits(d, "fold", "x", 2)[0] is None
    assert sorted(r["b"] for r in grouped_folds.out_of_fold(d, "fold", "x", 2).collect()) == [3, 4]
    assert grouped_folds.out_of_fold(d.limit(0), "fold", "x", 2).collect() == []


def test_hard_negatives_are_the_first_of_a_window(spark):
    """Also with ties, scores that are missing, and fewer negatives than asked for."""
    import random

    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(g, o, rng.choice([0, 0, 1, None]), rng.choice([None, 0.25, 0.5, rng.random()])) for g in (1, 2, None) for o in range(40)] + [(3, 1, 0, None), (3, 2, 0, None), (4, 1, 1, 0.5)]
    d = spark.createDataFrame(rows, "g int, o int, label int, s double")
    for most in (1, 3, 25):
        place = F.row_number().over(Window.partitionBy("g", "label").orderBy(F.desc("s"), "o"))
        want = {(r["g"], r["o"]) for r in d.withColumn("r", place).where((F.col("label") == 0) & (F.col("r") <= most)).collect()}
        got = grouped_folds.with_hard_negatives(d, "g", "o", "s", most)
        assert {(r["g"], r["o"]) for r in got.where("hard").collect()} == want and got.count() == len(rows)


def test_cosines_of_blocks_are_those_of_pairs(spark):
    """Rows without a vector, with nulls, of another length or without a direction have none; each pair comes once, none with itself."""
    from candor.functions import similarity
    from candor.operators import visual

    rows = [(i, [float(i % 5 - 2), 0.1 * i, 1.0], i % 3) for i in range(30)] + [(30, None, 1), (31, [1.0, None, 2.0], 1), (32, [1.0, 2.0], 1), (33, [0.0, 0.0, 0.0], None), (34, [], 2), (35, [float("nan"), 1.0, 1.0], 2)]
    d = spark.createDataFrame(rows, "id int, v array<float>, l int")
    a, b = (d.select(*[F.col(k).alias(f"{x}_{n}") for k, n in (("id", "id"), ("v", "vec"), ("l", "label"))]) for x in "ab")
    key = lambda r: (r["a_id"], r["b_id"], r["label"], str(r["cosine"]))
    want = sorted(map(key, a.join(b, F.col("a_id") != F.col("b_id")).select("a_id", "b_id", (F.col("a_label") == F.col("b_label")).cast("int").alias("label"), similarity.cosine("a_vec", "b_vec").alias("cosine")).collect()), key=str)
    for block in (400, 7):
        got = visual.cosine_pairs(a.where("a_id % 2 = 1"), b, block).collect()
        assert sorted(map(key, got), key=str) == [w for w in want if w[0] % 2 == 1]
