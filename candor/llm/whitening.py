"""Embedding whitening: exact sums, one aggregation for the covariance, LAPACK for its components.

Entries become whole numbers (floor(scale * c) + shift), so counts and sums are exact whatever the partitions. One
aggregation sums the centred products of every pair of dimensions, the upper triangle, from generated expressions; the
d x d matrix, whose size doesn't depend on the rows, is decomposed by LAPACK on the driver, and the components go back as
literals. What is returned is measured: the covariance of the whitened rows is summed anew over all of them.

Defined results: rows whose vector is null, holds a null or non-finite entry, or one too large for an exact whole number
(2^50 and more after scaling) are left out; so are vectors of another length than most (ties: the longer). A component
without variance has a null ``whitened`` and an ``explained`` of 0 (null if nothing varies); identity_error is over the
others, null if there are none. Repeated rows and null ids are rows like any other; empty tables give no rows. A deviation
past the range of long is null, ``deviation_exact`` has it as a decimal. More than ``MAX_DIMS`` dimensions are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import spool

#: Dimensions up to which an aggregation with a sum for each is planned, and their square held by the driver.
MAX_DIMS = 1024
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whole_vectors(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that can take part, as arrays of long, of whatever length."""
    v = vectors.select(vectors[f"`{id_col}`"].alias("vec_id"), vectors[f"`{vector}`"].cast("array<double>").alias("v"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**50) / scale)
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def total(terms: list[Column]) -> Column:
    """The sum of ``terms`` as a shallow tree."""
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0]


def covariance(df: DataFrame, entries: list[Column], means: list[float], n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of ``entries``, centred before they are multiplied, in one aggregation: a group for
    each row of the upper triangle, with a generated sum for each column. (One group with a sum for every pair is the same
    work, but thousands of sums at once aren't compiled.)"""
    d = len(entries)
    centred = df.select(*[(e - F.lit(m)).alias(f"c{k}") for k, (e, m) in enumerate(zip(entries, means, strict=True))])
    rows = centred.select("*", F.posexplode(F.array(*[f"c{k}" for k in range(d)])).alias("i", "c"))
    sums = rows.groupBy("i").agg(*[F.sum(F.expr(f"CASE WHEN i <= {k} THEN c * c{k} END")).alias(f"s{k}") for k in range(d)])
    out = np.zeros((d, d))
    for row in sums.collect():  # d rows, however many vectors
        out[row["i"], row["i"] :] = row[1 + row["i"] :]
    out /= n
    return np.triu(out) + np.triu(out, 1).T


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; at most ``most``. Values within rounding of zero are zero."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values = values[order]
    values[values <= max(float(values[0]), 0.0) * len(cov) * np.finfo(float).eps * 8] = 0.0
    return values, vectors[:, order].T


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row for each vector and component: see ``RESULT``."""
    spark = vectors.sparkSession
    every = whole_vectors(vectors, scale, shift)
    # The commonest length, from counts of each, with the bounds of its entries.
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low"))
    head = lengths.agg(F.max(F.struct("n", "d", "high", "low"))).first()[0]
    if head is None:
        return spark.createDataFrame([], RESULT)
    n, d, high, low = head
    if d > MAX_DIMS:
        raise ValueError(f"{d} dimensions are more than {MAX_DIMS}")
    x = every.where(F.size("x") == d)
    # Exact sums: long where the measured bounds show that it's enough, else decimal.
    kind = "long" if max(abs(high), abs(low)) * n < 2**62 else "decimal(38,0)"
    sums = [int(s) for s in x.agg(*[F.sum(F.col("x")[k].cast(kind)) for k in range(d)]).first()]
    whole, rest = zip(*[divmod(s, n) for s in sums], strict=True)
    # x = whole + y exactly, so no digits are lost however large the shift: x - S/n is y - rest/n.
    y = x.select("vec_id", *[(F.col("x")[k] - F.lit(w)).alias(f"y{k}") for k, w in enumerate(whole)])
    offset, means = [F.col(f"y{k}").cast("double") for k in range(d)], [r / n for r in rest]
    cov = covariance(y, offset, means, n)
    trace = float(np.trace(cov))
    values, axes = components(cov, min(most, d))
    live = [k for k, e in enumerate(values) if e > 0]
    # The sum of (n*y - rest)^2 is (n*A - 2*B)*n + C, with A of y^2, B of rest*y and C of rest^2.
    reach = high - low + 1
    kind = "long" if d * reach * max(reach, n) < 2**62 else "decimal(38,0)"
    squares = total([F.col(f"y{k}").cast(kind) * F.col(f"y{k}").cast(kind) for k in range(d)])
    mixed = total([F.col(f"y{k}").cast(kind) * F.lit(r).cast(kind) for k, r in enumerate(rest)])
    whole_number = lambda c: (F.lit(str(c)) if isinstance(c, int) else c).cast("decimal(38,0)")
    inner = F.try_subtract(F.try_multiply(whole_number(squares), whole_number(n)), F.try_multiply(whole_number(mixed), whole_number(2)))
    deviation = F.try_add(F.try_multiply(inner, whole_number(n)), whole_number(sum(r * r for r in rest)))
    centred = y.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation_exact"), *[(o - F.lit(m)).alias(f"c{k}") for k, (o, m) in enumerate(zip(offset, means, strict=True))])
    along = [total([F.col(f"c{j}") * F.lit(float(a)) for j, a in enumerate(axes[k])]) / F.lit(float(np.sqrt(e))) if e > 0 else F.lit(None).cast("double") for k, e in enumerate(values)]
    scored = spool(centred.select("vec_id", "deviation_exact", *[w.alias(f"w{k}") for k, w in enumerate(along)]), "whitened")
    error = None
    if live:
        own = [F.col(f"w{k}") for k in live]
        middle = [float(m) for m in scored.agg(*[F.avg(w) for w in own]).first()]
        error = float(np.abs(covariance(scored, own, middle, n) - np.eye(len(live))).max())
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(e) / trace if trace > 0 else None).cast("double").alias("explained")) for k, e in enumerate(values)])
    return scored.select("vec_id", "deviation_exact", F.explode(each).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"), "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), "deviation_exact"
    )
