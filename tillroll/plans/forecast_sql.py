"""Oracle SQL of the forecast: the recurrence as a recursive CTE over all
candidate triples at once, the same search and compass fit, the same
floating-point steps."""

from __future__ import annotations

from tillroll.operators.forecast import BOUNDS, DIGITS, GRID, ROUNDS, STEPS, TOLERANCE


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _three(values) -> str:
    """Triples in the order of a product, numbered from 0."""
    n, listed = len(values), f"[{', '.join(map(_d, values))}]"
    return (f"SELECT p, {listed}[1 + p // {n * n}] AS a, {listed}[1 + p // {n} % {n}] AS b, {listed}[1 + p % {n}] AS g "
            f"FROM (SELECT unnest(range({n ** 3})) AS p)")


_LEVEL = "a * (y[i] - s[1]) + (CAST(1.0 AS DOUBLE) - a) * (l + t)"
_SLOPE = f"b * (({_LEVEL}) - l) + (CAST(1.0 AS DOUBLE) - b) * t"
_SEASON = "list_append(s[2:], g * (y[i] - (l + t)) + (CAST(1.0 AS DOUBLE) - g) * s[1])"
_MISS = "((l + t) + s[1] - y[i])"


def _run(name: str, triples: str) -> str:
    return f"""{name} AS (
  SELECT series_id, p, a, b, g, CAST(1 AS BIGINT) AS i, l0 AS l, t0 AS t, s0 AS s, CAST(0.0 AS DOUBLE) AS e FROM ini JOIN {triples}
  UNION ALL
  SELECT r.series_id, p, a, b, g, i + 1, {_LEVEL}, {_SLOPE}, {_SEASON}, e + {_MISS} * {_MISS}
  FROM {name} r JOIN ini ON ini.series_id = r.series_id WHERE i <= len(y))"""


def _pick(name: str, run: str) -> str:
    return f"""{name} AS (SELECT series_id, w.a AS a, w.b AS b, w.g AS g, w.e AS e FROM (
  SELECT series_id, list({{'e': e, 'p': p, 'a': a, 'b': b, 'g': g}} ORDER BY e, p)[1] AS w
  FROM {run} JOIN ini USING (series_id) WHERE i = len(y) + 1 GROUP BY series_id))"""


def _compass(best: str) -> str:
    """Six trials run over the series side by side; behind its last value the
    best one is taken or the step halved, and the next six begin."""
    def trials(a, b, g, step):
        listed = []
        for n, (k, sign) in enumerate((k, sign) for k in "abg" for sign in "+-"):
            at = {x: f"LEAST(GREATEST({v} {sign} {step}, {_d(BOUNDS[0])}), {_d(BOUNDS[1])})" if x == k else v for x, v in zip("abg", (a, b, g), strict=True)}
            listed.append(f"{{'p': {n}, 'a': {at['a']}, 'b': {at['b']}, 'g': {at['g']}, 'l': ini.l0, 't': ini.t0, 's': ini.s0, 'e': {_d(0.0)}}}")
        return f"[{', '.join(listed)}]"

    one = _d(1.0)
    level = f"(c.a * (y[i] - c.s[1]) + ({one} - c.a) * (c.l + c.t))"
    ahead = (f"list_transform(cs, lambda c: {{'p': c.p, 'a': c.a, 'b': c.b, 'g': c.g, 'l': {level}, 't': c.b * ({level} - c.l) + ({one} - c.b) * c.t, "
             f"'s': list_append(c.s[2:], c.g * (y[i] - (c.l + c.t)) + ({one} - c.g) * c.s[1]), 'e': c.e + (c.l + c.t + c.s[1] - y[i]) * (c.l + c.t + c.s[1] - y[i])}})")
    picked = "list_sort(list_transform(cs, lambda c: {'e': c.e, 'p': c.p, 'a': c.a, 'b': c.b, 'g': c.g}))[1]"
    return f"""fitting AS (
  SELECT ini.series_id, 1 AS round, CAST(1 AS BIGINT) AS i, {{'e': e, 'a': a, 'b': b, 'g': g, 'step': {_d(STEPS[-1])}}} AS now, {trials('a', 'b', 'g', _d(STEPS[-1]))} AS cs
  FROM ini JOIN {best} USING (series_id)
  UNION ALL
  SELECT series_id, CASE WHEN i <= n THEN round ELSE round + 1 END, CASE WHEN i <= n THEN i + 1 ELSE 1 END, nxt,
    CASE WHEN i <= n THEN moved ELSE {trials('nxt.a', 'nxt.b', 'nxt.g', 'nxt.step')} END
  FROM (SELECT f.series_id, round, i, n, moved, ini, CASE WHEN i <= n THEN now WHEN w.e < now.e THEN {{'e': w.e, 'a': w.a, 'b': w.b, 'g': w.g, 'step': now.step}}
      ELSE {{'e': now.e, 'a': now.a, 'b': now.b, 'g': now.g, 'step': now.step / CAST(2.0 AS DOUBLE)}} END AS nxt
    FROM (SELECT r.series_id, round, i, now, len(y) AS n, {{'l0': l0, 't0': t0, 's0': s0}} AS ini, CASE WHEN i <= len(y) THEN {ahead} ELSE cs END AS moved,
        CASE WHEN i > len(y) THEN {picked} END AS w
      FROM fitting r JOIN ini ON ini.series_id = r.series_id WHERE round <= {ROUNDS} AND now.step >= {_d(TOLERANCE)}) f)),
fitted AS (SELECT series_id, now.e AS e, now.a AS a, now.b AS b, now.g AS g FROM (
  SELECT series_id, list(now ORDER BY round DESC)[1] AS now FROM fitting WHERE i = 1 GROUP BY series_id))"""


def holt_winters_sql(series: str, m: int = 12, h: int = 6, min_points: int = 24) -> str:
    """``series``: a query of (series_id, period_month, value), without gaps."""
    parts = [f"""months AS ({series}),
ser AS (SELECT series_id, list(period_month ORDER BY period_month) AS mon, list(value ORDER BY period_month) AS y FROM months GROUP BY series_id),
mean AS (SELECT *, list_reduce(y[1:{m}], lambda x, z: x + z) / {_d(m)} AS m1, list_reduce(y[{m + 1}:{2 * m}], lambda x, z: x + z) / {_d(m)} AS m2
  FROM ser WHERE len(y) >= {max(min_points, 2 * m)}),
ini AS (SELECT series_id, mon, y, m1 AS l0, (m2 - m1) / {_d(m)} AS t0, list_transform(y[1:{m}], lambda v: v - m1) AS s0 FROM mean)""",
             _run("run0", f"({_three(GRID)}) ON true"), _pick("best0", "run0")]
    inside = lambda k: f"LEAST(GREATEST(best.{k} + d.{k}, {_d(BOUNDS[0])}), {_d(BOUNDS[1])}) AS {k}"
    for n, step in enumerate(STEPS, 1):
        near = f"(SELECT best.series_id AS sid, p, {inside('a')}, {inside('b')}, {inside('g')} FROM best{n - 1} best CROSS JOIN ({_three((-step, 0.0, step))}) d) ON sid = ini.series_id"
        parts += [_run(f"run{n}", near), _pick(f"best{n}", f"run{n}")]
    search = f"best{len(STEPS)}"
    parts.append(_compass(search))
    last = "fitted"
    parts.append(f"""path AS (
  SELECT ini.series_id, a, b, g, CAST(1 AS BIGINT) AS i, l0 AS l, t0 AS t, s0 AS s FROM ini JOIN {last} USING (series_id)
  UNION ALL
  SELECT r.series_id, a, b, g, i + 1, {_LEVEL}, {_SLOPE}, {_SEASON} FROM path r JOIN ini ON ini.series_id = r.series_id WHERE i <= len(y))""")
    r = lambda x: f"CAST(ROUND({x}, {DIGITS}) AS DOUBLE)"
    return f"""WITH RECURSIVE {', '.join(parts)}
SELECT series_id, period_month, kind, {r('value')} AS value, {r('a')} AS alpha, {r('b')} AS beta, {r('g')} AS gamma, {r('sqrt(e / n)')} AS rmse, {r('sqrt(sq / n)')} AS search_rmse FROM (
  SELECT series_id, period_month, 'actual' AS kind, value, a, b, g, e, n FROM months LEFT JOIN (SELECT *, len(y) AS n FROM {last} JOIN ini USING (series_id)) USING (series_id)
  UNION ALL SELECT path.series_id, mon[i], 'fitted', (l + t) + s[1], best.a, best.b, best.g, best.e, len(y)
    FROM path JOIN ini ON ini.series_id = path.series_id JOIN {last} best ON best.series_id = path.series_id WHERE i <= len(y)
  UNION ALL SELECT path.series_id, CAST(mon[-1] + to_months(CAST(k AS INTEGER)) AS DATE), 'forecast', l + k * t + s[(k - 1) % {m} + 1], best.a, best.b, best.g, best.e, len(y)
    FROM path JOIN ini ON ini.series_id = path.series_id JOIN {last} best ON best.series_id = path.series_id
    CROSS JOIN (SELECT unnest(range(1, {h + 1})) AS k) WHERE i = len(y) + 1
  UNION ALL SELECT series_id, mon[-1], 'insufficient_history', NULL, NULL, NULL, NULL, NULL, NULL FROM ser WHERE len(y) < {max(min_points, 2 * m)})
LEFT JOIN (SELECT series_id, e AS sq FROM {search}) USING (series_id)"""
