"""Linear and logistic fits as Spark aggregations.

A fit is three narrow passes: means, the k x k centred cross-products, and the
k x k residual "meat".  Only these k x k sums reach the driver, where the small
system is solved.  Fixed effects are absorbed by joining group means back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import discard, stage

RESULT = "term string, b double, se double, t double, n long, n_clusters long, r2 double"


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    return df


def demean(df: DataFrame, cols: Sequence[str], cell: str | Sequence[str]) -> DataFrame:
    """Subtract cell means (the within transform)."""
    cell = [cell] if isinstance(cell, str) else list(cell)
    means = df.groupBy(*cell).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols])
    j = df.join(means, cell)
    for c in cols:
        j = j.withColumn(c, F.col(c).cast("double") - F.col(f"_m_{c}"))
    return j.drop(*[f"_m_{c}" for c in cols])


def _cross(cols: Sequence[Column], weight: Column | None = None) -> list[Column]:
    out = []
    for i, a in enumerate(cols):
        for j in range(i + 1):
            p = a * cols[j]
            out.append(F.sum(p if weight is None else p * weight).alias(f"c{i}_{j}"))
    return out


def _matrix(row, k: int, start: int = 0) -> np.ndarray:
    m = np.zeros((k, k))
    pos = start
    for i in range(k):
        for j in range(i + 1):
            m[i, j] = m[j, i] = row[pos] or 0.0
            pos += 1
    return m


def fit(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    cluster: str | None = None,
    absorb: str | Sequence[str] | None = None,
    intercept_df: bool | None = None,
    absorbed: tuple[int, float] | None = None,
) -> DataFrame:
    """Least squares with HC1 or clustered errors; one row per regressor.

    With ``absorb`` the variables are demeaned by that cell first.  The small
    sample factor is n / (n - k), or (G / (G - 1)) ((n - 1) / (n - k)) when
    clustered; k counts the intercept only without absorption.  Without a spare row, or
    with a single cluster, the errors are NULL.  ``absorbed`` gives the parameters that an
    earlier step took out of all variables, and the total sum of squares that R2 refers to.
    """
    keys = [cluster] if cluster else []
    cells = [] if absorb is None else [absorb] if isinstance(absorb, str) else list(absorb)
    rows = complete(df.select(*dict.fromkeys([y, *xs, *keys, *cells])), [y, *xs])
    names = [y, *xs]
    rows = rows.select(
        *[F.col(c).cast("double").alias(c) for c in names],
        *[F.col(c).alias(f"_key_{i}") for i, c in enumerate([*keys, *cells])],
    )
    if cells:
        rows = demean(rows, names, [f"_key_{len(keys) + i}" for i in range(len(cells))])
    head = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()
    n, means = head[0], [0.0 if v is None else v for v in head[1:]]
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(names, means)]
    k = len(xs)
    s = _matrix(rows.agg(*_cross(centred)).first(), k + 1)
    xtx, xty, yy = s[1:, 1:], s[1:, 0], s[0, 0]
    inv = np.linalg.pinv(xtx)
    b = inv @ xty
    resid = centred[0]
    for i in range(k):
        resid = resid - F.lit(float(b[i])) * centred[i + 1]
    with_const = intercept_df if intercept_df is not None else not cells
    lost, total = absorbed or (0, yy)
    dof = n - k - (1 if with_const else 0) - lost
    scores = rows.select(
        *[(x * resid).alias(f"s{i}") for i, x in enumerate(centred[1:])],
        *([F.col("_key_0").alias("g")] if cluster else []),
    )
    cols = [F.col(f"s{i}") for i in range(k)]
    if cluster:
        scores = scores.groupBy("g").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)])
    row = scores.agg(F.count(F.lit(1)), *_cross(cols)).first()
    groups, meat = row[0], _matrix(row, k, 1)
    known = dof > 0 and (not cluster or groups > 1)
    adj = (groups / (groups - 1) * (n - 1) / dof if cluster else n / dof) if known else 0.0
    se = np.sqrt(np.maximum(np.diag(adj * inv @ meat @ inv), 0))
    r2 = float(1 - (yy - b @ xty) / total) if total > 0 else None
    out = []
    for i, x in enumerate(xs):
        bi, si = float(b[i]), float(se[i]) if known else None
        t = bi / si if si else None
        out.append((x, bi, si, t, int(n), int(groups) if cluster else None, r2))
    if with_const:
        const = float(means[0] - sum(bi * m for bi, m in zip(b, means[1:])))
        out.append(("intercept", const, None, None, int(n), int(groups) if cluster else None, r2))
    return df.sparkSession.createDataFrame(out, RESULT)


def dummies(df: DataFrame, column: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every value but the lowest (few distinct values, e.g. years)."""
    values = [v[0] for v in df.select(column).distinct().orderBy(column).collect()][1:]
    names = [f"{prefix}{v}" for v in values]
    flags = [(F.col(column) == v).cast("double").alias(nm) for nm, v in zip(names, values)]
    return df.select("*", *flags), names


def alternating(df: DataFrame, cols: Sequence[str], first: str, second: str, tolerance: float = 1e-10, rounds: int = 1_000) -> DataFrame:
    """The columns without the group means of two effects, by alternating projections.

    Each round subtracts the means of the second effect and then those of the first; it ends when
    no mean of the second effect exceeds ``tolerance`` standard deviations.  A plan holds one
    round, whatever the number of groups, and the driver sees one number a round.
    """
    sd = df.agg(*[F.stddev_pop(F.col(c).cast("double")) for c in cols]).first()
    now = stage(demean(df, cols, first), "projection")
    for _ in range(rounds):
        means = now.groupBy(second).agg(*[F.avg(c).alias(c) for c in cols])
        far = F.greatest(F.lit(0.0), *[F.abs(F.col(c)) / F.lit(float(s)) for c, s in zip(cols, sd) if s])
        if (means.agg(F.max(far)).first()[0] or 0.0) <= tolerance:
            break
        later = stage(demean(demean(now, cols, second), cols, first), "projection")
        discard(now)
        now = later
    return now


def two_way(
    df: DataFrame, y: str, xs: Sequence[str], entity: str, year: str = "year",
    cluster: str | None = None, most_dummies: int = 100,
) -> DataFrame:
    """Entity and year effects, clustered by entity.

    The entity is absorbed; up to ``most_dummies`` years are 0/1 columns, more of them are absorbed
    as well by :func:`alternating`.  Both give the same fit.
    """
    rows = complete(df, [y, *xs])
    n_years = rows.agg(F.count_distinct(year)).first()[0]
    if n_years <= most_dummies:
        wide, names = dummies(rows, year, "_y")
        res = fit(wide, y, [*xs, *names], cluster or entity, entity, intercept_df=False)
        return res.filter(F.col("term").isin(list(xs)))
    own = cluster or entity
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in (y, *xs)], F.col(entity).alias("_e"), F.col(year).alias("_t"), F.col(own).alias("_g"))
    total = demean(rows, [y], "_e").agg(F.sum(F.col(y) * F.col(y))).first()[0] or 0.0
    left = alternating(rows, [y, *xs], "_e", "_t")
    return fit(left, y, xs, "_g", intercept_df=False, absorbed=(n_years - 1, total))


def interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a).cast("double") * F.col(b).cast("double"))


def staged(
    df: DataFrame, stages: dict[str, tuple[str, str, tuple[int, int]]], xs: Sequence[str], cell: str, cluster: str
) -> DataFrame:
    """One specification on every stage of a funnel, each conditional on its
    prerequisite and bounded to the cohorts whose window has elapsed.

    ``stages``: name -> (condition, outcome, first and last cohort year).
    """
    out = None
    for name, (condition, y, (lo, hi)) in stages.items():
        rows = df.filter(F.expr(condition) & F.col("year").between(lo, hi))
        m = fit(rows, y, xs, cluster=cluster, absorb=cell).withColumn("stage", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def logit(df: DataFrame, y: str, xs: Sequence[str], label: str | None = None) -> DataFrame:
    """Binomial GLM with a logit link; coefficients, standard errors, pseudo R2."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = complete(df.select(F.col(y).cast("double").alias(y), *[F.col(x).cast("double") for x in xs]), [y, *xs])
    vec = VectorAssembler(inputCols=list(xs), outputCol="features").transform(rows)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=y, featuresCol="features", maxIter=50
    ).fit(vec)
    s = glm.summary
    coef = [*glm.coefficients.toArray().tolist(), glm.intercept]
    se = list(s.coefficientStandardErrors)
    pseudo = 1 - s.deviance / s.nullDeviance if s.nullDeviance else None
    out = [
        (label, t, float(c), float(e), float(c / e) if e else None, int(s.numInstances), pseudo)
        for t, c, e in zip([*xs, "intercept"], coef, se)
    ]
    schema = "model string, term string, b double, se double, t double, n long, pseudo_r2 double"
    return df.sparkSession.createDataFrame(out, schema)


def quadratic_logits(
    df: DataFrame, y: str, z: str, by: Sequence[str], min_rows: int = 100, iterations: int = 25
) -> DataFrame:
    """Logit of y on z and z^2 in every cell, all cells at once.

    Newton steps as grouped aggregations: each step sums the 3 x 3 information and the score
    per cell and solves them with the inverse written as expressions.  A cell of any size is
    only ever an aggregate, and the table of cells is staged step by step; the driver learns
    only whether a cell still moves.  Cells without an inverse (fewer than three values of z)
    have null coefficients and no shape but ``flat``.  Sign classes follow the curvature.
    """
    rows = complete(df.select(*by, F.col(y).cast("double").alias("_y"), F.col(z).cast("double").alias("_z")), ["_y", "_z"])
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_rate"))
    cells = cells.filter((F.col("n") >= min_rows) & F.col("_rate").between(0.001, 0.999))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    cells = stage(cells.select(
        *by, "n", F.log(F.col("_rate") / (1 - F.col("_rate"))).alias("_b0"), zero.alias("_b1"), zero.alias("_b2"), none.alias("_v"), F.lit(True).alias("_moves")
    ), "logit-cells")
    x = [F.lit(1.0), F.col("_z"), F.col("_z") * F.col("_z")]
    p = 1 / (1 + F.exp(-(F.col("_b0") + F.col("_b1") * x[1] + F.col("_b2") * x[2])))
    for _ in range(iterations):
        j = rows.join(cells.filter("_moves"), list(by))  # a row a cell: Spark broadcasts it by its size
        w = p * (1 - p)
        sums = j.groupBy(*by, "n", "_b0", "_b1", "_b2").agg(
            *[F.sum(w * x[1] ** i).alias(f"_w{i}") for i in range(5)], *[F.sum((F.col("_y") - p) * xi).alias(f"_g{i}") for i, xi in enumerate(x)]
        )
        # the information is a Hankel matrix: entry (i, j) is the sum of w z^(i + j)
        m, g = [F.col(f"_w{i}") for i in range(5)], [F.col(f"_g{i}") for i in range(3)]
        cof = {
            (0, 0): m[2] * m[4] - m[3] * m[3], (0, 1): m[2] * m[3] - m[1] * m[4], (0, 2): m[1] * m[3] - m[2] * m[2],
            (1, 1): m[0] * m[4] - m[2] * m[2], (1, 2): m[1] * m[2] - m[0] * m[3], (2, 2): m[0] * m[2] - m[1] * m[1],
        }
        det = m[0] * cof[0, 0] + m[1] * cof[0, 1] + m[2] * cof[0, 2]
        inverse = lambda i, j: F.when(F.abs(F.col("_det")) > 1e-12 * m[0] * m[2] * m[4], F.col(f"_c{min(i, j)}{max(i, j)}") / F.col("_det"))
        solved = sums.select("*", det.alias("_det"), *[c.alias(f"_c{i}{j}") for (i, j), c in cof.items()])
        delta = [sum((inverse(i, j) * g[j] for j in range(1, 3)), inverse(i, 0) * g[0]).alias(f"_d{i}") for i in range(3)]
        solved = solved.select(*by, "n", "_b0", "_b1", "_b2", *delta, inverse(2, 2).alias("_v"))
        far = F.greatest(*[F.abs(F.col(f"_d{i}")) for i in range(3)]) > 1e-8
        moved = solved.select(
            *by, "n", *[(F.col(f"_b{i}") + F.col(f"_d{i}")).alias(f"_b{i}") for i in range(3)], "_v", F.coalesce(far, F.lit(False)).alias("_moves")
        )
        renewed = stage(moved.unionByName(cells.filter(~F.col("_moves"))), "logit-cells")
        discard(cells)
        cells = renewed
        if cells.filter("_moves").isEmpty():
            break
    t2 = F.when(F.col("_v") > 0, F.col("_b2") / F.sqrt("_v"))
    shape = F.when(F.abs(t2) >= 1.96, F.when(t2 > 0, "U").otherwise("inverted")).otherwise("flat")
    return cells.select(*by, "n", F.col("_b1").alias("b1"), F.col("_b2").alias("b2"), shape.alias("shape"))
