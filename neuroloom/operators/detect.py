"""Sharp peaks and intervals in cross-correlograms.

For a duration d the statistic at a lag is the sum of the d + 1 values from it on.  Mean and
deviation are over all lags; the extreme is sought in lags 0 to ``maxlag`` - d, the least on ties.
"""

from __future__ import annotations

from functools import cache

from .sql import SqlOperator, operator


@cache
def detectors(level: float = 2.5, maxlag: int = 12, max_duration: int = 6) -> dict[str, SqlOperator]:
    """All operators of this module for a level of Z, a greatest lag and a longest duration."""
    total = lambda xs, f="x": f"aggregate({xs}, CAST(0 AS DOUBLE), (a, x) -> a + {f})"
    # Each value used again is made once, by a generator: the optimiser would write a plain column's text into every place that reads it.
    once = lambda name, value: f"LATERAL VIEW explode(array({value})) {name}_ AS {name}"
    place = lambda far: f"CAST(array_position({far}, array_max({far})) AS INT)"
    # One row for a pair and duration, from one array for a pair: sums, mean, deviation, and the places of the first and second extreme.
    box = f"""l AS (SELECT src, dst, transform(array_sort(collect_list(struct(lag, value))), x -> x.value) AS c FROM {{ccg}} GROUP BY src, dst),
s AS (SELECT src, dst, CAST(d AS BIGINT) AS d, t, mu, sd FROM l LATERAL VIEW explode(sequence(0, least({max_duration}, size(c) - 1))) x AS d
  {once("t", f"transform(sequence(0, size(c) - 1 - d), k -> {total('slice(c, k + 1, d + 1)')})")} {once("mu", f"{total('t')} / size(t)")} {once("sd", f"sqrt({total('t', '(x - mu) * (x - mu)')} / size(t))")})"""
    extreme = f"""{box},
far AS (SELECT src, dst, d, t, mu, sd, size(far1) AS room, p1, p2 FROM s
  {once("far1", f"transform(slice(t, 1, CAST({maxlag} - d + 1 AS INT)), x -> round(abs(x - mu), 9))")} {once("p1", place("far1"))}
  {once("far2", "transform(far1, (x, k) -> CASE WHEN k + 1 = p1 THEN -1.0 ELSE x END)")} {once("p2", place("far2"))} WHERE sd > 0.000000000001 AND d <= {maxlag}),
e AS (SELECT src, dst, d, CAST(p1 - 1 AS BIGINT) AS lag1, t[p1 - 1] AS v1, (t[p1 - 1] - mu) / sd AS z1, CASE WHEN room > 1 THEN CAST(p2 - 1 AS BIGINT) END AS lag2, t[p2 - 1] AS v2, (t[p2 - 1] - mu) / sd AS z2 FROM far)"""
    peak = f"""{extreme},
g AS (SELECT * FROM e WHERE abs(z1) > {level}),
r AS (SELECT x.*, CASE WHEN x.lag1 = 0 AND y.lag1 = 0 AND sign(x.z1) = sign(y.z1) AND (x.z1 > 0 AND round(x.v2, 9) >= round(y.v2, 9) OR x.z1 < 0 AND round(x.v2, 9) <= round(y.v2, 9)) THEN 1 ELSE 0 END AS gone
  FROM g x LEFT JOIN g y ON y.src = x.dst AND y.dst = x.src AND y.d = x.d),
k AS (SELECT src, dst, d, CASE WHEN gone = 0 THEN lag1 ELSE lag2 END AS lag, CASE WHEN gone = 0 THEN v1 ELSE v2 END AS v, CASE WHEN gone = 0 THEN z1 ELSE z2 END AS z
  FROM r WHERE gone = 0 OR lag2 IS NOT NULL AND abs(z2) > {level} AND sign(z2) = sign(z1))"""
    first = "max_by(struct(d, lag{n}, v{n}, z{n}), struct(round(abs(z{n}), 9), d)) AS m"
    full = f"{extreme}, b AS (SELECT src, dst, {first.format(n=1)} FROM e GROUP BY src, dst), o AS (SELECT src, dst, m.d AS d, m.lag1 AS lag, m.v1 AS v, m.z1 AS z FROM b)"
    out = lambda n: f"round(v{n}, 6) AS value, round(z{n}, 6) AS z, lag{n} AS peak_offset"
    return {o.name: o for o in (
        operator("boxcar", f"WITH {box} SELECT src, dst, d AS duration, CAST(lag AS BIGINT) AS lag, round(v, 6) AS total, round(mu, 6) AS mean, round(sd, 6) AS deviation FROM s LATERAL VIEW posexplode(t) x AS lag, v"),
        operator("extreme_offset", f"WITH {extreme} SELECT src, dst, d AS duration, {out(1)} FROM e"),
        operator("second_extreme", f"WITH {extreme} SELECT src, dst, d AS duration, {out(2)} FROM e WHERE lag2 IS NOT NULL"),
        operator("second_peak", f"WITH {extreme} SELECT src, dst, d AS duration, {out(2)} FROM e WHERE lag2 IS NOT NULL AND abs(z2) > {level}"),
        operator("sharp_peak_d", f"WITH {peak} SELECT src, dst, d AS duration, {out('')} FROM k"),
        operator("significant_ccg", f"""WITH {peak},
f AS (SELECT src, dst, {first.format(n="")} FROM k GROUP BY src, dst)
SELECT x.src, x.dst, round(x.m.v, 6) AS weight, round(x.m.z, 6) AS confidence, x.m.lag AS edge_offset, x.m.d AS duration
FROM f x LEFT JOIN f y ON y.src = x.dst AND y.dst = x.src WHERE NOT (x.m.lag = 0 AND coalesce(y.m.lag, 1) = 0 AND x.m.d >= y.m.d)"""),
        operator("full_ccg", f"WITH {full} SELECT src, dst, d AS duration, {out('')} FROM o"),
        operator("ccg_zscore", f"WITH {full}, pair AS (SELECT src, dst FROM l) SELECT pair.src, pair.dst, round(coalesce(z, 0), 6) AS z, round(coalesce(v, 0), 6) AS value, coalesce(d, 0) AS duration FROM pair LEFT JOIN o ON pair.src = o.src AND pair.dst = o.dst"),
    )}


def detector(name: str, level: float = 2.5, maxlag: int = 12, max_duration: int = 6) -> SqlOperator:
    return detectors(level, maxlag, max_duration)[name]


boxcar, extreme_offset, second_extreme, second_peak, sharp_peak_d, significant_ccg, full_ccg, ccg_zscore = detectors().values()
