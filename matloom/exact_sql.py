"""SQL for factors of a square matrix ``src`` with rows (j, l, v): what the queries of the factorizations are held against.

Each function gives common table expressions for a ``WITH RECURSIVE`` list; they share no method with the operators."""

from __future__ import annotations


def rotated(name: str, src: str, n: int, sweeps: int = 10) -> str:
    """``name`` (k, v): all n (even) eigenvalues of a symmetric matrix, descending. In each round of a sweep n / 2 disjoint
    pairs of rows and columns are rotated at once; within n - 1 rounds each pair meets once."""
    last = n - 1
    partner = "CASE WHEN {0} = {1} THEN r WHEN {0} = r THEN {1} ELSE (2 * r - {0} + {2}) % {1} END"
    return (
        f"{name}_rounds AS (SELECT 0 AS t, j, l, v FROM {src} UNION ALL (WITH cur AS (SELECT t, t % {last} AS r, j, l, v FROM {name}_rounds WHERE t < {last * sweeps}), "
        f"met AS (SELECT j, l, v FROM cur WHERE l = {partner.format('j', last, 2 * last)}), diag AS (SELECT j, v FROM cur WHERE j = l), "
        "slack AS (SELECT e.j AS k, e.l AS m, e.v AS v, (b.v - a.v) / (2 * e.v) AS x FROM met e JOIN diag a ON a.j = e.j JOIN diag b ON b.j = e.l), "
        "tan AS (SELECT k, m, CASE WHEN v = 0 THEN 0 WHEN x = 0 THEN (CASE WHEN k < m THEN 1 ELSE -1 END) ELSE sign(x) / (abs(x) + sqrt(1 + x * x)) END AS x FROM slack), "
        "rot AS (SELECT k, m, 1 / sqrt(1 + x * x) AS c, -x / sqrt(1 + x * x) AS s FROM tan), "
        "half AS (SELECT a.t AS t, a.j AS j, a.l AS l, p.c * a.v + p.s * b.v AS v FROM cur a JOIN rot p ON p.k = a.j JOIN cur b ON b.j = p.m AND b.l = a.l) "
        "SELECT a.t + 1 AS t, a.j AS j, a.l AS l, p.c * a.v + p.s * b.v AS v FROM half a JOIN rot p ON p.k = a.l JOIN half b ON b.l = p.m AND b.j = a.j)), "
        f"{name} AS (SELECT row_number() OVER (ORDER BY v DESC) - 1 AS k, v FROM {name}_rounds WHERE j = l AND t = {last * sweeps})"
    )


def upper_factor(name: str, src: str, n: int) -> str:
    """``name`` (j, l, v): the upper factor with a positive diagonal of a positive definite matrix, row after row."""
    return (
        f"{name}_steps AS (SELECT 0 AS k, j, l, v FROM {src} UNION ALL (WITH cur AS (SELECT * FROM {name}_steps WHERE k < {n - 1}), top AS (SELECT l, v FROM cur WHERE j = k), lead_ AS (SELECT v FROM cur WHERE j = k AND l = k) "
        "SELECT c.k + 1 AS k, c.j AS j, c.l AS l, c.v - a.v * b.v / p.v AS v FROM cur c JOIN top a ON a.l = c.j JOIN top b ON b.l = c.l CROSS JOIN lead_ p WHERE c.j > c.k AND c.l > c.k)), "
        f"{name} AS (SELECT s.j AS j, s.l AS l, s.v / sqrt(d.v) AS v FROM {name}_steps s JOIN {name}_steps d ON d.k = s.k AND d.j = s.k AND d.l = s.k WHERE s.j = s.k)"
    )


def inverted(name: str, src: str, n: int) -> str:
    """``name`` (j, l, v): the inverse, by exchanging one row and column after the other; no pivoting."""
    return (
        f"{name}_steps AS (SELECT 0 AS k, j, l, v FROM {src} UNION ALL (WITH cur AS (SELECT * FROM {name}_steps WHERE k < {n}), "
        "lead_ AS (SELECT v FROM cur WHERE j = k AND l = k), row_ AS (SELECT l, v FROM cur WHERE j = k), col_ AS (SELECT j, v FROM cur WHERE l = k) "
        "SELECT c.k + 1 AS k, c.j AS j, c.l AS l, CASE WHEN c.j = c.k AND c.l = c.k THEN 1 / p.v WHEN c.j = c.k THEN c.v / p.v WHEN c.l = c.k THEN -c.v / p.v ELSE c.v - a.v * b.v / p.v END AS v "
        f"FROM cur c JOIN row_ b ON b.l = c.l JOIN col_ a ON a.j = c.j CROSS JOIN lead_ p)), {name} AS (SELECT j, l, v FROM {name}_steps WHERE k = {n})"
    )


def two_sided(t: str, n: str) -> str:
    """Two-sided p of the statistic ``t`` of a correlation of ``n`` observations: the closed sums of Student's t up to 100
    degrees of freedom, the series of the error function beyond."""
    df, x = f"({n} - 2)", f"least(greatest({t}, 1e-300), 40) / sqrt(2)"
    erf = (
        f"list_sum([exp(k * ln(2.0) + (2 * k + 1) * ln({x}) - ({x}) * ({x}) - ((k + 1) * ln(2.0) + lgamma(k + 1.5) - 0.5 * ln(pi()))) FOR k IN range(1200)]) * 2 / sqrt(pi())"
    )
    angle = f"atan({t} / sqrt({df}))"
    odd = f"(2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum([pow(cos({angle}), 2 * m - 1) * exp(lgamma(m) + lgamma(1.5) - lgamma(m + 0.5)) FOR m IN range(1, ({df} - 1) // 2 + 1)]), 0)))"
    even = f"(sin({angle}) * list_sum([pow(cos({angle}), 2 * m) * exp(lgamma(m + 0.5) - lgamma(0.5) - lgamma(m + 1.0)) FOR m IN range(0, {df} // 2)]))"
    return f"(1 - CASE WHEN {df} > 100 THEN {erf} WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"
