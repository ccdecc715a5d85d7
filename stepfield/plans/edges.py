"""Neighbouring cells tested by the points next to their common side."""

from __future__ import annotations

from stepfield.operators import edgetest
from stepfield.operators import graph as G
from stepfield.plans.common import CELL, EDGES, WALK, on_grid, r, rounded, walk
from stepfield.plans.registry import query

_HALF_PI = "1.5707963267948966e0"
_SIMPSON = "CASE WHEN k IN (0, 100) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * 2 * k * {h} * pow(sin(k * {h} * k * {h}), freedom - 1)"


@query(
    f"WITH {WALK}, {EDGES}, q AS (SELECT row_id, x, y, {CELL} AS cell FROM p), c AS (SELECT cell, avg(x) AS m_x, avg(y) AS m_y FROM q GROUP BY cell HAVING count(*) > 1), "
    "b AS (SELECT e.i, e.j, a.m_x, a.m_y, o.m_x - a.m_x AS u, o.m_y - a.m_y AS w FROM e JOIN c a ON a.cell = e.i JOIN c o ON o.cell = e.j WHERE e.i < e.j), "
    "s AS (SELECT i, j, 0 AS side, (x - m_x) * u + (y - m_y) * w AS v FROM b JOIN q ON q.cell = b.i QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY v DESC, row_id) <= 10 "
    "UNION ALL SELECT i, j, 1, (x - m_x) * u + (y - m_y) * w AS v FROM b JOIN q ON q.cell = b.j QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY v, row_id) <= 10), "
    "m AS (SELECT i, j, " + ", ".join(f"count(*) FILTER (side = {s}) AS n_{c}, avg(v) FILTER (side = {s}) AS a_{c}, var_samp(v) FILTER (side = {s}) / count(*) FILTER (side = {s}) AS e_{c}" for c, s in (("i", 0), ("j", 1))) + " FROM s GROUP BY i, j), "
    "d AS (SELECT *, (a_i - a_j) / sqrt(e_i + e_j) AS t, (e_i + e_j) ** 2 / (e_i ** 2 / (n_i - 1) + e_j ** 2 / (n_j - 1)) AS freedom FROM m), "
    f"h AS (SELECT *, sqrt(atan2(sqrt(freedom), abs(t))) / 100 AS h, sqrt({_HALF_PI}) / 100 AS h0 FROM d), "
    f"z AS (SELECT i, j, n_i, n_j, t, freedom, sum({_SIMPSON.format(h='h')}) * h / (sum({_SIMPSON.format(h='h0')}) * h0) AS p FROM h, range(101) n(k) GROUP BY i, j, n_i, n_j, t, freedom, h, h0) "
    f"SELECT i, j, n_i, n_j, {r('t')}, {r('freedom')}, {r('p')}, p > 1e-6 AS valid FROM z"
)
def edge_test(spark, sf):
    """Welch's test of neighbouring cells of the grid."""
    return rounded(edgetest.tested_edges(on_grid(walk(spark, sf)), G.grid_edges(spark, 10, 5), 1e-6))
