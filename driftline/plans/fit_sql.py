"""Oracle SQL for fits: least squares by successive orthogonalisation, logits by Newton steps.

Both are computed another way than the operators: those solve normal equations on the
driver and fit a GLM; here regressors are orthogonalised one after the other with window
sums, and a recursive table carries the coefficients of 25 Newton steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from .registry import R

YEARS = range(1990, 2010)


def ols_term(
    source: str, y: str, term: tuple[str, str], others: Sequence[str], cell: str = "", cluster: str = "", years: str = "",
    const: bool | None = None, where: str = "true", name: str = "",
) -> str:
    """One row ``term, b, se, t, n, n_clusters, r2`` for ``term`` (label, expression) beside the
    regressors ``others``.  ``cell`` is absorbed; ``years`` names a column whose values but the
    lowest are dummies."""
    label, x = term
    years_in = [f"CAST({years} = {v} AND {years} > (SELECT min({years}) FROM s0) AS DOUBLE)" for v in YEARS] if years else []
    regressors = [*others, *years_in, x]
    k = len(regressors)
    complete = " AND ".join(f"({e}) IS NOT NULL" for e in [y, *others, x])
    values = ", ".join(f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate(regressors))
    centred = ", ".join(f"v{i} - avg(v{i}) OVER (PARTITION BY c) AS v{i}" for i in range(k))
    steps = [
        f"s0 AS (SELECT * FROM {source} WHERE {where} AND {complete})",
        f"s1 AS (SELECT {cluster or 'row_number() OVER ()'} AS gid, {cell or '0'} AS c, CAST({y} AS DOUBLE) AS y, {values} FROM s0)",
        f"s2 AS (SELECT gid, y - avg(y) OVER (PARTITION BY c) AS y, {centred} FROM s1)",
    ]
    last = "s2"
    for i in range(1, k):
        minus = "".join(
            f" - CASE WHEN sum(v{j} * v{j}) OVER () > 1e-9 THEN sum(v{i} * v{j}) OVER () / sum(v{j} * v{j}) OVER () ELSE 0 END * v{j}" for j in range(i)
        )
        steps.append(f"o{i} AS (SELECT * REPLACE (v{i}{minus} AS v{i}) FROM {last})")
        last = f"o{i}"
    fitted = "".join(
        f" - CASE WHEN sum(v{j} * v{j}) OVER () > 1e-9 THEN sum(y * v{j}) OVER () / sum(v{j} * v{j}) OVER () ELSE 0 END * v{j}" for j in range(k)
    )
    z = f"v{k - 1}"
    steps.append(f"e AS (SELECT gid, y, {z} AS z, y{fitted} AS e FROM {last})")
    steps.append("f AS (SELECT sum(y * z) / sum(z * z) AS b, sum(z * z) AS szz, count(*) AS n, 1 - sum(e * e) / sum(y * y) AS r2 FROM e)")
    steps.append("m AS (SELECT sum(q * q) AS meat, count(*) AS g FROM (SELECT sum(z * e) AS q FROM e GROUP BY gid))")
    counted = f"({len(others) + 1} + {f'(SELECT count(DISTINCT {years}) - 1 FROM s0)' if years else '0'} + {int(not cell if const is None else const)})"
    factor = f"(g / (g - 1.0)) * ((n - 1.0) / (n - {counted}))" if cluster else f"n / CAST(n - {counted} AS DOUBLE)"
    steps.append(f"r AS (SELECT b, sqrt({factor} * meat) / szz AS se, n, g, r2 FROM f, m)")
    more = f"{name}, " if name else ""
    return (
        f"(WITH {', '.join(steps)} SELECT {more}'{label}' AS term, {R('b', 5)} AS b, {R('se', 5)} AS se, {R('b / se', 5)} AS t, n, "
        f"{'g' if cluster else 'CAST(NULL AS BIGINT)'} AS n_clusters, {R('r2', 5)} AS r2 FROM r)"
    )


def ols(source: str, y: str, xs: dict[str, str], others: Sequence[str] = (), **more) -> str:
    """A row for each regressor of ``xs`` (label -> expression); ``others`` are controls."""
    return " UNION ALL ".join(
        "SELECT * FROM " + ols_term(source, y, (label, x), [*others, *[e for n, e in xs.items() if n != label]], **more)
        for label, x in xs.items()
    )


def two_way(source: str, y: str, xs: dict[str, str], entity: str, **more) -> str:
    """Entity effects absorbed, year dummies, errors clustered by entity."""
    return ols(source, y, xs, cell=entity, cluster=entity, years="year", const=False, **more)


def logit(source: str, y: str, xs: dict[str, str], label: str, where: str = "true", steps: int = 25) -> str:
    """Rows ``model, term, b, se, t, n, pseudo_r2`` of a logit with an intercept."""
    k = len(xs) + 1
    names = [*xs, "intercept"]
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate([*xs.values(), "1"]))
    complete = " AND ".join(f"({e}) IS NOT NULL" for e in [y, *xs.values()])
    eta = " + ".join(f"b{i} * x{i}" for i in range(k))
    sums = ", ".join(
        [f"sum(w * x{i} * x{j}) AS m{i}_{j}" for i in range(k) for j in range(k)] + [f"sum((y - p) * x{i}) AS m{i}_{k}" for i in range(k)]
        + [f"CAST({int(i == j)} AS DOUBLE) AS m{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    )
    beta = ", ".join(f"b{i}" for i in range(k))
    base = f"SELECT i, {beta}, {sums} FROM (SELECT *, p * (1 - p) AS w FROM (SELECT it.*, d.*, 1 / (1 + exp(-({eta}))) AS p FROM it, d)) GROUP BY i, {beta}"
    wide = 2 * k + 1
    solved = f"({base})"
    for c in range(k):  # Gauss-Jordan: one nested query a pivot
        out = [
            f"m{i}_{j} / m{c}_{c} AS m{i}_{j}" if i == c else f"m{i}_{j} - m{i}_{c} * m{c}_{j} / m{c}_{c} AS m{i}_{j}"
            for i in range(k) for j in range(wide)
        ]
        solved = f"(SELECT i, {beta}, {', '.join(out)} FROM {solved})"
    moved = ", ".join(f"b{i} + m{i}_{k}" for i in range(k))
    rows = " UNION ALL ".join(
        f"SELECT '{label}' AS model, '{t}' AS term, {R(f'b{i}', 4)} AS b, {R(f's{i}', 4)} AS se, {R(f'b{i} / s{i}', 4)} AS t, n, {R('pseudo', 4)} AS pseudo_r2 FROM z"
        for i, t in enumerate(names)
    )
    start = ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(k))
    errors = ", ".join(f"sqrt(m{i}_{k + 1 + i}) AS s{i}" for i in range(k))
    return f"""(WITH RECURSIVE d AS (SELECT CAST({y} AS DOUBLE) AS y, {cols} FROM {source} WHERE {where} AND {complete}),
    it AS (SELECT 0 AS i, {start} UNION ALL SELECT i + 1, {moved} FROM {solved} WHERE i < {steps}),
    last AS (SELECT * FROM it WHERE i = {steps}), fin AS (SELECT {beta}, {errors} FROM {solved.replace(' FROM it, d)', ' FROM last AS it, d)')}),
    dev AS (SELECT count(*) AS n, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, avg(y) AS r FROM (SELECT y, 1 / (1 + exp(-({eta}))) AS p FROM fin, d)),
    z AS (SELECT fin.*, n, 1 - ll / (n * (r * ln(r) + (1 - r) * ln(1 - r))) AS pseudo FROM fin, dev) {rows})"""


def cell_logits(source: str, y: str, x: str, cell: str, min_rows: int, steps: int = 25) -> str:
    """Rows ``cell, n, b1, b2, shape`` of a quadratic logit in every cell with enough rows of both outcomes."""
    k, beta = 3, "b0, b1, b2"
    sums = ", ".join(
        [f"sum(p * (1 - p) * x{i} * x{j}) AS m{i}_{j}" for i in range(k) for j in range(k)] + [f"sum((y - p) * x{i}) AS m{i}_{k}" for i in range(k)]
        + [f"CAST({int(i == j)} AS DOUBLE) AS m{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    )
    solved = f"(SELECT i, g, {beta}, {sums} FROM (SELECT it.*, d.* EXCLUDE (g), 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it JOIN d USING (g)) GROUP BY i, g, {beta})"
    for c in range(k):
        out = [
            f"m{i}_{j} / m{c}_{c} AS m{i}_{j}" if i == c else f"m{i}_{j} - m{i}_{c} * m{c}_{j} / m{c}_{c} AS m{i}_{j}"
            for i in range(k) for j in range(2 * k + 1)
        ]
        solved = f"(SELECT i, g, {beta}, {', '.join(out)} FROM {solved})"
    return f"""(WITH RECURSIVE a AS (SELECT {cell} AS g, CAST({y} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS x0, CAST({x} AS DOUBLE) AS x1 FROM {source} WHERE ({x}) IS NOT NULL),
    c AS (SELECT g, count(*) AS n, avg(y) AS r FROM a GROUP BY g HAVING count(*) >= {min_rows} AND avg(y) BETWEEN 0.001 AND 0.999),
    d AS (SELECT a.*, x1 * x1 AS x2 FROM a JOIN c USING (g)),
    it AS (SELECT 0 AS i, g, ln(r / (1 - r)) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM c
      UNION ALL SELECT i + 1, g, b0 + m0_3, b1 + m1_3, b2 + m2_3 FROM {solved} WHERE i < {steps}),
    last AS (SELECT * FROM it WHERE i = {steps})
    SELECT CAST(g AS VARCHAR) AS cell, n, {R('b1', 4)} AS b1, {R('b2', 4)} AS b2, CASE WHEN abs(b2 / sqrt(m2_6)) < 1.96 THEN 'flat' WHEN b2 > 0 THEN 'U' ELSE 'inverted' END AS shape
    FROM {solved.replace(' FROM it JOIN d', ' FROM last AS it JOIN d')} JOIN c USING (g))"""


def logits(models: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {m}" for m in models)
