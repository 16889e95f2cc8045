"""SQL text pieces for the DuckDB twins of the queries.

The twins are written from the definitions of the statistics, not from the
Spark plans: a zero-filled grid is spelled out with an explicit cross
product of categories and periods, moments come from ``regr_*``. Literals
are typed DOUBLE so that both engines round the same constants.
"""

from __future__ import annotations

import math


def rnd(expr: str, digits: int = 8) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def rnd_sig(expr: str, sig: int = 10) -> str:
    """Round to ``sig`` significant digits with exact powers of ten."""
    x = f"({expr})"
    k = f"({sig - 1} - floor(log10(abs({x}))))"
    q = f"pow(10.0::DOUBLE, abs({k}))"
    return (f"((CASE WHEN {x} = 0 THEN 0.0::DOUBLE WHEN {k} >= 0 THEN round({x} * {q}, 0) / {q} "
            f"ELSE round({x} / {q}, 0) * {q} END) + 0.0)")


def month(expr: str) -> str:
    return f"CAST(date_trunc('month', {expr}) AS DATE)"


def moments(y: str, x: str) -> str:
    """Aggregates n, mean_x, mean_y, sxx, syy, sxy of (x, y)."""
    return (f"CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_avgx({y}, {x}) AS mean_x, "
            f"regr_avgy({y}, {x}) AS mean_y, regr_sxx({y}, {x}) AS sxx, "
            f"regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy")


def corr(sxx: str = "sxx", syy: str = "syy", sxy: str = "sxy") -> str:
    return f"(CASE WHEN {sxx} > 0 AND {syy} > 0 THEN {sxy} / sqrt({sxx} * {syy}) END)"


def _series(c2: str, m: str, odd: bool) -> str:
    step = "(i * 2) / (i * 2 + 1)" if odd else "(i * 2 - 1) / (i * 2)"
    return (f"(CASE WHEN {m} >= 1 THEN list_reduce(range(1, {m} + 1), "
            f"lambda s, i: {{'term': s.term * {c2} * {step}, "
            f"'acc': s.acc + s.term * {c2} * {step}}}, "
            f"{{'term': 1.0::DOUBLE, 'acc': 1.0::DOUBLE}}).acc ELSE 1.0::DOUBLE END)")


def t_mass(t: str, v: str) -> str:
    """P(|T| < |t|) with integer dof ``v`` (NULL when v < 1)."""
    t, v = f"({t})", f"({v})"
    at = f"abs({t})"
    den = f"({v} + {at} * {at})"
    sin_t = f"({at} / sqrt({den}))"
    c2 = f"({v} / {den})"
    theta = f"atan({at} / sqrt({v}::DOUBLE))"
    even = f"({sin_t} * {_series(c2, f'(floor({v} / 2)::BIGINT - 1)', False)})"
    odd = (f"({2.0 / math.pi!r}::DOUBLE * ({theta} + CASE WHEN {v} > 1 THEN "
           f"{sin_t} * sqrt({c2}) * {_series(c2, f'(floor(({v} - 3) / 2)::BIGINT)', True)} "
           f"ELSE 0.0::DOUBLE END))")
    return (f"(CASE WHEN {v} >= 1 AND {t} IS NOT NULL THEN "
            f"(CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END) END)")


def t_two_sided(t: str, v: str) -> str:
    m = t_mass(t, v)
    return f"(CASE WHEN {m} IS NOT NULL THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - {m}) END)"


def t_cdf(t: str, v: str) -> str:
    t = f"({t})"
    return f"(0.5::DOUBLE + 0.5::DOUBLE * sign({t}) * {t_mass(t, v)})"


def elastic_net(reg: float = 0.3, mix: float = 0.8) -> str:
    """SELECT-list additions on a moments row: slope, intercept, rss, rmse, r2
    (needs two nested projections; returns the inner one)."""
    r = "(sxy / sqrt(sxx * syy))"
    sy = "sqrt(syy / n)"
    sx = "sqrt(sxx / n)"
    e = f"({float(reg)!r}::DOUBLE / {sy})"
    slope = (f"CASE WHEN sxx > 0 AND syy > 0 THEN sign({r}) * greatest(abs({r}) - "
             f"{float(mix)!r}::DOUBLE * {e}, 0.0::DOUBLE) / (1.0::DOUBLE + (1.0::DOUBLE - "
             f"{float(mix)!r}::DOUBLE) * {e}) * {sy} / {sx} ELSE 0.0::DOUBLE END")
    return slope


def fit_select(reg: float = 0.3, mix: float = 0.8) -> str:
    """Wraps a moments relation ``mom`` into ``fit`` with the elastic-net columns."""
    return (f"fit0 AS (SELECT *, {elastic_net(reg, mix)} AS slope FROM mom), "
            "fit AS (SELECT *, mean_y - slope * mean_x AS intercept, "
            "CASE WHEN sxx IS NOT NULL AND syy IS NOT NULL THEN "
            "greatest(0.0::DOUBLE, syy - 2.0::DOUBLE * slope * sxy + slope * slope * sxx) END AS rss FROM fit0)")


def test_select(n_coeffs: int = 1, alpha: float = 0.05, damping: float = 0.0) -> str:
    """Wraps ``fit`` into ``tested`` with dof, t_stat, p_value, alpha, significant, verdict."""
    level = float(alpha) / n_coeffs
    se = (f"CASE WHEN n - {n_coeffs + 1} >= 1 AND (n - {n_coeffs + 1})::DOUBLE * (sxx + {float(damping)!r}::DOUBLE) <> 0 "
          f"THEN sqrt(greatest(0.0::DOUBLE, rss / ((n - {n_coeffs + 1})::DOUBLE * (sxx + {float(damping)!r}::DOUBLE)))) END")
    return (f"t0 AS (SELECT *, n - {n_coeffs + 1} AS dof, {se} AS std_err FROM fit), "
            "t1 AS (SELECT *, CASE WHEN std_err <> 0 THEN slope / std_err END AS t_stat FROM t0), "
            f"t2 AS (SELECT *, CASE WHEN std_err = 0 AND slope <> 0 THEN 0.0::DOUBLE "
            f"ELSE {t_two_sided('t_stat', 'dof')} END AS p_value FROM t1), "
            f"tested AS (SELECT *, {level!r}::DOUBLE AS alpha, "
            f"CASE WHEN p_value IS NOT NULL THEN p_value <= {level!r}::DOUBLE END AS significant, "
            f"CASE WHEN p_value IS NULL THEN 'not testable' WHEN p_value > {level!r}::DOUBLE "
            "THEN 'accept null' ELSE 'reject null' END AS verdict FROM t2)")


def solve_select(size: int, tolerance: float, keys: str) -> str:
    """Wraps a relation ``s0`` with ``m`` (rows of cross-products, the label's
    last), ``own`` (sums of squares) and ``free`` flags into ``solved`` with the
    coefficients ``b``: in each step the feature with the largest share of its
    own sum of squares left is swept out of the others."""
    ctes, n = [], size + 1
    for k in range(1, size + 1):
        ctes += [
            f"l{k} AS (SELECT *, list_transform(range(1, {n}), lambda i: CASE WHEN free[i] AND own[i] > 0 "
            f"THEN m[i][i] / own[i] ELSE -1.0::DOUBLE END) AS l FROM s{k - 1})",
            f"k{k} AS (SELECT *, list_max(l) AS best, list_position(l, list_max(l)) AS k FROM l{k})",
            f"p{k} AS (SELECT *, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM k{k})",
            f"s{k} AS (SELECT {keys}, own, CASE WHEN best > {tolerance!r}::DOUBLE THEN list_transform(m, lambda r, i: "
            f"CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END) ELSE m END AS m, "
            f"CASE WHEN best > {tolerance!r}::DOUBLE THEN list_transform(free, lambda f, i: f AND i <> k) ELSE free END AS free "
            f"FROM p{k})"]
    b = ", ".join(f"CASE WHEN free[{i}] THEN 0.0::DOUBLE ELSE m[{i}][{n}] END AS b{i}" for i in range(1, n))
    return ", ".join(ctes) + f", solved AS (SELECT {keys}, {b} FROM s{size})"


def haversine(lat: str, lon: str, clat: str, clon: str, rad: str = "0.017453292519943295::DOUBLE") -> str:
    return (f"12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(({clat} - {lat}) * {rad} / 2) * sin(({clat} - {lat}) * {rad} / 2) "
            f"+ cos({lat} * {rad}) * cos({clat} * {rad}) * sin(({clon} - {lon}) * {rad} / 2) * sin(({clon} - {lon}) * {rad} / 2))))")
