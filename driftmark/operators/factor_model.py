"""Factor regression of book returns with autocorrelation-robust standard errors, from sums.

Books are joined to the factors by date. One aggregation per book gives the cross moments of factors and
return; the normal equations, at most seven by seven, are solved by sweeping them in array expressions.
A second aggregation sums the products of the residual scores with their weighted neighbours in time,
which is the whole Bartlett-weighted covariance at once. Nothing leaves the JVM, and no book's series is
gathered in one place; only the neighbours of a day are looked up along the series.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Factor names in report order, the least number of days, the year.
FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")
MIN_DAYS = 60
TRADING_DAYS = 252
# A factor of which less than this share is left beside the factors before it depends on them.
DEPENDENT = 1e-11


# Expressions are written as SQL text: put together from column objects they take the driver seconds.
_names = (f"v{i}" for i in count())


def _bound(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is worked out once."""
    name = next(_names)
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def _each(array: str, body: Callable[[str, str], str]) -> str:
    x, i = next(_names), next(_names)
    return f"transform({array}, ({x}, {i}) -> {body(x, i)})"


def _dot(a: str, b: str) -> str:
    x, y, s, z = (next(_names) for _ in range(4))
    return f"aggregate(zip_with({a}, {b}, ({x}, {y}) -> {x} * {y}), 0D, ({s}, {z}) -> {s} + {z})"


def _at(array: str, *places: str | int) -> str:
    for place in places:
        array = f"get({array}, {place})"
    return array


def _times(a: str, b: str) -> str:
    """Matrix product with a symmetric ``b``, whose rows are its columns."""
    return _bound(b, lambda m: _each(a, lambda row, _: _each(m, lambda column, _: _dot(row, column))))


def _swept(gram: str, k: int) -> str:
    """``(matrix, kept)``: the symmetric matrix after a sweep of every row that does not depend on those before it.

    Kept rows i, j hold minus the inverse; a row that was left out holds, under the kept ones, how it depends
    on them.
    """
    def step(g: str, s: str, p: str) -> str:
        def with_row(row: str) -> str:
            d = _at(row, p)
            free = f"{d} > {DEPENDENT!r}D * {_at(g, p, p)}"
            pivot = _each(row, lambda x, j: f"if({j} = {p}, -1 / {d}, {x} / {d})")
            others = _each(f"{s}.matrix", lambda r, i: f"if({i} = {p}, {pivot}, " + _each(
                r, lambda x, j: f"if({j} = {p}, {x} / {d}, {x} - {_at(r, p)} * {_at(row, j)} / {d})") + ")")
            return f"named_struct('matrix', if({free}, {others}, {s}.matrix), 'kept', concat({s}.kept, array({free})))"

        return _bound(_at(f"{s}.matrix", p), with_row)

    def run(g: str) -> str:
        s, p = next(_names), next(_names)
        return f"aggregate(sequence(0, {k - 1}), named_struct('matrix', {g}, 'kept', cast(array() AS array<boolean>)), ({s}, {p}) -> {step(g, s, p)})"

    return _bound(gram, run)


def _pseudo_inverse(gram: str, k: int) -> str:
    """The pseudo-inverse of a symmetric matrix without negative eigenvalues: dependent factors share their effect.

    With the independent rows I and the others as combinations C of them, the matrix is R' G_I R for R = [1 C],
    so its pseudo-inverse is R' (R R')^-1 G_I^-1 (R R')^-1 R.
    """
    def inverse(s: str) -> str:
        return _each(f"{s}.matrix", lambda row, i: _each(row, lambda x, j: f"if({_at(f'{s}.kept', i)} AND {_at(f'{s}.kept', j)}, -{x}, 0D)"))

    def combination(s: str) -> str:
        """R' as k rows: a kept factor is itself, another one its combination."""
        return _each(f"{s}.matrix", lambda row, j: _each(row, lambda x, i: f"CASE WHEN NOT {_at(f'{s}.kept', i)} THEN 0D "
                                                         f"WHEN NOT {_at(f'{s}.kept', j)} THEN {x} WHEN {i} = {j} THEN 1D ELSE 0D END"))

    def whole(s: str) -> str:
        def through(r: str) -> str:
            across = _each(f"sequence(0, {k - 1})", lambda i, _: _each(r, lambda row, _: _at(row, i)))
            square = _bound(across, lambda t: _each(t, lambda a, _: _each(t, lambda b, _: _dot(a, b))))
            left = _times(r, _bound(_swept(square, k), inverse))
            return _bound(left, lambda a: _bound(_times(a, inverse(s)), lambda b: _each(b, lambda x, _: _each(a, lambda y, _: _dot(x, y)))))

        return _bound(combination(s), through)

    return _bound(_swept(gram, k), whole)


def _symmetric(name: str, k: int) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{name}_{min(i, j)}_{max(i, j)}" for j in range(k)) + ")" for i in range(k)) + ")"


def factor_regression(daily: DataFrame, factors: DataFrame | None, keys: Sequence[str], ret: str = "ret",
                      lags: int = 5) -> DataFrame | None:
    """Alpha, betas, t statistics and R squared per book, for whichever factors exist.

    Books are joined to the factors by date; null rows are dropped; fewer than 60 days give no row.
    Collinear or constant factors share their effect as under the pseudo-inverse; a statistic without
    spread is null.
    """
    if factors is None:
        return None
    names = [f for f in FACTORS if f in factors.columns]
    keys, k = list(keys), len(names) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    joined = (daily.select(*keys, "date", F.col(ret).cast("double").alias("y"))
              .join(factors.select("date", *[F.col(f"`{f}`").cast("double").alias(f"x_{i}") for i, f in enumerate(names, 1)]), "date")
              .dropna().withColumn("x_0", F.lit(1.0)))
    moments = joined.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), *[F.expr(f"sum(x_{i} * x_{j}) AS g_{i}_{j}") for i, j in pairs],
        *[F.expr(f"sum(x_{i} * y) AS b_{i}") for i in range(k)]).filter(F.col("n") >= MIN_DAYS)
    right, every = (f"array({', '.join(f'{c}_{i}' for i in range(k))})" for c in "bx")
    plain = [f"`{c}`" for c in keys]
    solved = moments.selectExpr(*plain, "n", "mean", f"{_pseudo_inverse(_symmetric('g', k), k)} AS inverse", f"{right} AS right_side")
    solved = solved.selectExpr(*plain, "n", "mean", "inverse", f"{_each('inverse', lambda row, _: _dot(row, 'right_side'))} AS beta")
    rows = joined.join(solved.select(*keys, "mean", "beta"), keys)
    rows = rows.selectExpr(*plain, "date", "y", "mean", f"y - {_dot(every, 'beta')} AS u", f"{every} AS x")
    rows = rows.selectExpr(*plain, "date", "y", "mean", "u", f"{_each('x', lambda x, _: f'{x} * u')} AS score")
    along = f"OVER (PARTITION BY {', '.join(plain)} ORDER BY date)"
    near = [(f"near_{move}_{lag}", 1 - lag / (lags + 1), f"{move}(score, {lag}) {along}") for lag in range(1, lags + 1) for move in ("lag", "lead")]
    spread = rows.selectExpr(*plain, "y", "mean", "u", "score", *[f"{window} AS {name}" for name, _, window in near])
    around = [" + ".join([f"get(score, {i})", *[f"{w!r}D * coalesce(get({name}, {i}), 0D)" for name, w, _ in near]]) for i in range(k)]
    spread = spread.selectExpr(*plain, "y", "mean", "u", "score", f"array({', '.join(around)}) AS around")
    middle = spread.groupBy(*keys).agg(F.expr("sum(u * u) AS left_over"), F.expr("sum((y - mean) * (y - mean)) AS total"),
                                       *[F.expr(f"sum(get(score, {i}) * get(around, {j})) AS m_{i}_{j}") for i, j in pairs])
    middle = middle.selectExpr(*plain, "left_over", "total", f"{_symmetric('m', k)} AS middle")
    # the diagonal of inverse * middle * inverse
    variance = _each("inverse", lambda row, _: _dot(_each("middle", lambda m, _: _dot(row, m)), row))
    both = solved.join(middle, keys).selectExpr(*plain, "n", "beta", "left_over", "total", f"{_each(variance, lambda v, _: f'sqrt(greatest({v}, 0D))')} AS error")

    def t(i: int) -> str:
        return f"if(get(error, {i}) > 0, get(beta, {i}) / get(error, {i}), NULL)"

    columns = [f"get(beta, 0) * {TRADING_DAYS} AS alpha_ann", f"{t(0)} AS alpha_t", "if(total > 0, 1 - left_over / total, NULL) AS r2", "n"]
    for i, f in enumerate(names, 1):
        columns += [f"get(beta, {i}) AS `beta_{f}`", f"{t(i)} AS `t_{f}`"]
    return both.selectExpr(*plain, *columns)
