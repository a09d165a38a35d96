"""For each registered query that SQL can express, the same result in DuckDB's dialect."""

from __future__ import annotations

GEO = """
geo AS (
    SELECT c_custkey, r_name FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey)
"""
PANEL = f"""{GEO},
p0 AS (
    SELECT r_name AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
           CAST(count(*) AS DOUBLE) AS y
    FROM orders LEFT JOIN geo ON o_custkey = c_custkey
    WHERE o_orderdate < DATE '2001-08-01' AND r_name <> 'NA'
    GROUP BY 1, 2)
"""
SCOPES = f"""{PANEL},
scopes AS (
    SELECT series_id, ds, y FROM p0
    UNION ALL SELECT 'ALL', ds, sum(y) FROM p0 GROUP BY ds)
"""


def _split(source: str, name: str = "parts") -> str:
    return f"""
{name} AS (
    SELECT series_id, ds, y,
           CASE WHEN ds <= max(ds) OVER (PARTITION BY series_id) - INTERVAL 12 MONTH
                THEN 'training' ELSE 'testing' END AS split_key
    FROM {source})
"""


SPLIT = f"""{SCOPES}, {_split("scopes")},
train AS (SELECT series_id, ds, y FROM parts WHERE split_key = 'training'),
test AS (SELECT series_id, ds, y FROM parts WHERE split_key = 'testing')
"""
CUT_SPLIT = f"""{SCOPES},
train AS (SELECT * FROM scopes WHERE ds < DATE '2000-07-01'),
test AS (SELECT * FROM scopes WHERE ds >= DATE '2000-07-01')
"""


def _ordered(column: str, values: tuple) -> str:
    """A table of values with their position, as SQL."""
    rows = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS {column}_values({column}_at, {column})"


def calendar(source: str, tag: str) -> str:
    """Every month between the first and the last value of a series; missing ones have no ``y``."""
    return f"""
calendar_{tag} AS (
    SELECT series_id, ds, y
    FROM (SELECT series_id, CAST(unnest(generate_series(
                     min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS ds
          FROM {source} WHERE y IS NOT NULL GROUP BY series_id)
    LEFT JOIN {source} USING (series_id, ds))"""


def ets(source: str, tag: str) -> str:
    """Exponential smoothing as a recursion over months, one state per series and candidate."""
    return f"""
grid_{tag} AS (
    SELECT row_number() OVER (ORDER BY trend_at, season_at, alpha_at, beta_at, gamma_at, phi_at)
               AS grid_id,
           trend, season, alpha, alpha * beta AS beta, (1 - alpha) * gamma AS gamma, phi,
           3 + trend_size + CASE WHEN season = 'N' THEN 0 ELSE 12 END AS k
    FROM (VALUES (0, 'N', 0), (1, 'A', 2), (2, 'Ad', 3)) AS t(trend_at, trend, trend_size),
         (VALUES (0, 'N'), (1, 'A'), (2, 'M')) AS s(season_at, season),
         {_ordered("alpha", (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9))},
         {_ordered("beta", (0.0, 0.02, 0.1, 0.3))},
         {_ordered("gamma", (0.0, 0.05, 0.2, 0.5))},
         {_ordered("phi", (1.0, 0.85, 0.95))}
    WHERE (beta = 0) = (trend = 'N') AND (gamma = 0) = (season = 'N') AND (phi = 1) = (trend <> 'Ad')),
{calendar(source, tag)},
packed_{tag} AS (
    SELECT series_id, max(ds) AS last, list(y ORDER BY ds) AS ys, count(*) AS n, count(y) AS n_obs
    FROM calendar_{tag} GROUP BY series_id),
means_{tag} AS (
    SELECT *, list_avg(ys[1:12]) AS year1, list_avg(ys[13:24]) AS year2 FROM packed_{tag}),
lines_{tag} AS (
    SELECT m.series_id, last, ys, n, n_obs, start, year1, g.*,
           CASE WHEN trend = 'N' THEN 0.0::DOUBLE WHEN start = 12 THEN (year2 - year1) / 12
                ELSE coalesce(ys[2] - ys[1], 0) END AS b0
    FROM (SELECT *, CASE WHEN n >= 24 AND year1 IS NOT NULL AND year2 IS NOT NULL THEN 12 ELSE 1 END
                    AS start
          FROM means_{tag}) m, grid_{tag} g
    WHERE (season = 'N' OR start = 12) AND (season <> 'M' OR list_min(ys) > 0)),
fold_{tag} AS (
    SELECT series_id, last, ys, n, n_obs, start, grid_id, trend, season, alpha, beta, gamma, phi, k,
           start AS i, CASE WHEN start = 12 THEN year1 + 5.5 * b0 ELSE ys[1] END AS l, b0 AS b,
           list_transform(range(0, 12), lambda j:
               CASE season WHEN 'A' THEN coalesce(ys[j + 1] - (year1 + (j - 5.5) * b0),
                                                  ys[j + 13] - (year1 + (j + 6.5) * b0), 0)
                           WHEN 'M' THEN coalesce(ys[j + 1] / (year1 + (j - 5.5) * b0),
                                                  ys[j + 13] / (year1 + (j + 6.5) * b0), 1)
                           ELSE 0.0::DOUBLE END) AS s,
           0.0::DOUBLE AS sse
    FROM lines_{tag}
    UNION ALL
    SELECT series_id, last, ys, n, n_obs, start, grid_id, trend, season, alpha, beta, gamma, phi, k,
           i + 1,
           line + coalesce(alpha * pull, 0), phi * b + coalesce(beta * pull, 0),
           list_append(s[2:12], term + coalesce(
               gamma * CASE WHEN season = 'M' THEN error / line ELSE error END, 0)),
           sse + coalesce(error * error, 0)
    FROM (SELECT *, CASE WHEN season = 'M' THEN error / term ELSE error END AS pull
          FROM (SELECT *, ys[i + 1] - CASE WHEN season = 'M' THEN line * term ELSE line + term END
                          AS error
                FROM (SELECT *, l + phi * b AS line, s[1] AS term FROM fold_{tag} WHERE i < n)))),
scored_{tag} AS (
    SELECT *, CASE WHEN m - k - 1 > 0
                   THEN m * ln(greatest(sse, 1e-12) / m) + 2 * k + 2.0::DOUBLE * k * (k + 1) / (m - k - 1)
                   ELSE 'Infinity'::DOUBLE END AS aicc
    FROM (SELECT *, len(list_filter(ys[start + 1 :], lambda v: v IS NOT NULL)) AS m
          FROM fold_{tag} WHERE i = n)),
fit_{tag} AS (
    SELECT * FROM scored_{tag}
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aicc, grid_id) = 1)
"""


def ets_path(tag: str, horizon: int) -> str:
    """Forecast months 1 to ``horizon`` from the last states."""
    return f"""
path_{tag} AS (
    SELECT series_id, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ds,
           CASE WHEN season = 'M' THEN line * term ELSE line + term END AS value
    FROM (SELECT series_id, last, season, h, s[1 + (h - 1) % 12] AS term,
                 l + b * CASE WHEN phi = 1 THEN h ELSE phi * (1 - phi ** h) / (1 - phi) END AS line
          FROM fit_{tag}, range(1, {horizon + 1}) AS months(h)))
"""


def _solved(system: str) -> str:
    """Solution of rows ``[coefficients..., right side]`` by elimination, as a list of numbers.

    Each step divides the first row by its first number, removes that column everywhere and moves
    the row to the end; after one step per row, every row is its unknown.
    """
    return f"""
    flatten(list_reduce(
        list_transform(range(0, len({system})), lambda q: [[0.0::DOUBLE]]),
        lambda m, x: list_transform(
            [list_transform(m[1][2:], lambda v: v / m[1][1])],
            lambda head: list_append(
                list_transform(m[2:], lambda r: list_transform(r[2:], lambda v, j: v - r[1] * head[j])),
                head))[1],
        {system}))"""


_WAVE_TERMS = " UNION ALL ".join(
    f"SELECT {100 + 2 * k + j}, {f}(2 * pi() / 365.25 * epoch_days * {k})"
    for k in range(1, 11)
    for j, f in enumerate(("sin", "cos"))
)


def trend_terms(axis: str, dates: str, name: str) -> str:
    """Regressors of the trend and season model for rows ``(series_id, ds)``."""
    return f"""
{name} AS (
    SELECT series_id, ds, term, value
    FROM (SELECT series_id, ds, bends, (ds - first) / span AS t,
                 ds - DATE '1970-01-01' AS epoch_days
          FROM {dates} JOIN {axis} USING (series_id)),
         LATERAL (SELECT 0 AS term, 1.0::DOUBLE AS value UNION ALL SELECT 1, t
                  UNION ALL SELECT 1 + j, greatest(t - 0.8::DOUBLE * j / bends, 0)
                  FROM range(1, 26) AS steps(j) WHERE j <= bends
                  UNION ALL {_WAVE_TERMS}) AS terms)
"""


def trend(source: str, tag: str) -> str:
    """The trend and season model: slope changes enter and leave until none can improve the posterior."""
    return f"""
axis_{tag} AS (
    SELECT series_id, min(ds) AS first, greatest(max(ds) - min(ds), 1) AS span,
           max(abs(y)) AS scale, count(*) AS n,
           greatest(least(25, floor(count(*) * 0.8::DOUBLE) - 1), 0) AS bends
    FROM {source} GROUP BY series_id),
{trend_terms(f"axis_{tag}", source, f"terms_{tag}")},
columns_{tag} AS (
    SELECT * FROM terms_{tag}
    UNION ALL SELECT series_id, ds, 999, y / scale FROM {source} JOIN axis_{tag} USING (series_id)),
products_{tag} AS (
    SELECT a.series_id, a.term AS i, b.term AS j, sum(a.value * b.value) AS v
    FROM columns_{tag} a JOIN columns_{tag} b USING (series_id, ds) GROUP BY ALL),
matrices_{tag} AS (
    SELECT series_id, list(line ORDER BY i) AS zz
    FROM (SELECT series_id, i, list(v ORDER BY j) AS line FROM products_{tag} GROUP BY 1, 2)
    GROUP BY series_id),
mode_{tag} AS (
    SELECT series_id, zz, n, bends, len(zz) - 1 AS p, 0 AS step,
           list_transform(range(1, len(zz)), lambda i: 0.0::DOUBLE) AS u,
           list_transform(range(1, len(zz)), lambda i: 0) AS signs,
           list_transform(range(1, len(zz)), lambda i: CASE
               WHEN i <= 2 THEN 5.0::DOUBLE WHEN i <= 2 + bends THEN 0.05::DOUBLE ELSE 10.0::DOUBLE END) AS root,
           greatest(zz[len(zz)][len(zz)] / n, 1e-12) AS noise, false AS settled
    FROM matrices_{tag} JOIN axis_{tag} USING (series_id)
    UNION ALL
    -- A turned slope change leaves, else the largest pull enters, else the noise follows the residuals.
    SELECT series_id, zz, n, bends, p, step + 1, moved,
           CASE WHEN turns THEN list_transform(signs, lambda s, i: CASE WHEN i = leaves THEN 0 ELSE s END)
                WHEN strongest > 1 + 1e-9::DOUBLE
                THEN list_transform(signs, lambda s, i: CASE WHEN i = enters THEN sign(pull[i])::INTEGER ELSE s END)
                ELSE signs END,
           root,
           CASE WHEN turns OR strongest > 1 + 1e-9::DOUBLE THEN noise ELSE fresh_noise END,
           NOT turns AND strongest <= 1 + 1e-9::DOUBLE AND abs(fresh_noise - noise) <= 1e-9::DOUBLE * noise
    FROM (
        SELECT *, list_max(list_transform(pull, lambda v: abs(v))) AS strongest,
               list_position(list_transform(pull, lambda v: abs(v)), list_max(list_transform(pull, lambda v: abs(v)))) AS enters,
               greatest((sqrt(n * n + 16 * greatest(sse, 1e-12)) - n) / 8, 1e-12) AS fresh_noise
        FROM (
            SELECT *, list_transform(residual, lambda v, i:
                       CASE WHEN i > 2 AND i <= 2 + bends AND signs[i] = 0 THEN root[i] * v / noise ELSE 0 END) AS pull,
                   zz[p + 1][p + 1] - list_sum(list_transform(moved, lambda v, i:
                       v * root[i] * (zz[p + 1][i] + residual[i]))) AS sse
            FROM (
                SELECT *, list_transform(moved, lambda v, i: zz[p + 1][i] - list_sum(
                           list_transform(moved, lambda w, j: zz[i][j] * root[j] * w))) AS residual
                FROM (
                    SELECT *, CASE WHEN turns THEN list_transform(u, lambda v, i:
                               CASE WHEN i = leaves THEN 0 ELSE v + share[leaves] * (fresh[i] - v) END)
                           ELSE fresh END AS moved
                    FROM (
                        SELECT *, list_min(share) IS NOT NULL AS turns, list_position(share, list_min(share)) AS leaves
                        FROM (
                            SELECT *, list_transform(fresh, lambda v, i: CASE
                                       WHEN signs[i] <> 0 AND signs[i] * v <= 0 THEN u[i] / (u[i] - v) END) AS share
                            FROM (
                                SELECT *, {_solved("system")} AS fresh
                                FROM (
                                    SELECT *, list_transform(root, lambda a, i: list_append(
                                        list_transform(root, lambda b, j: CASE
                                            WHEN i > 2 AND i <= 2 + bends AND signs[i] = 0
                                                 OR j > 2 AND j <= 2 + bends AND signs[j] = 0
                                            THEN CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END
                                            ELSE a * zz[i][j] * b + CASE WHEN i <> j THEN 0
                                                 WHEN i > 2 AND i <= 2 + bends THEN 1e-6::DOUBLE * noise
                                                 ELSE noise END END),
                                        CASE WHEN i > 2 AND i <= 2 + bends AND signs[i] = 0 THEN 0
                                             ELSE a * zz[i][p + 1] - noise * signs[i] END)) AS system
                                    FROM mode_{tag} WHERE step < 1000 AND NOT settled))))))))),
ended_{tag} AS (
    SELECT series_id, zz, n, bends, step, settled, list_transform(u, lambda v, i: v * root[i]) AS beta, noise
    FROM mode_{tag} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY step DESC) = 1),
betas_{tag} AS (
    SELECT series_id, n, settled AS converged, unnest(beta) AS coefficient,
           generate_subscripts(beta, 1) - 1 AS place
    FROM ended_{tag})
"""


def trend_path(tag: str, dates: str, name: str) -> str:
    """Predictions of the trend and season model for rows ``(series_id, ds)``."""
    return f"""
{trend_terms(f"axis_{tag}", dates, f"ahead_terms_{tag}")},
{name} AS (
    SELECT series_id, ds, sum(t.value * coefficient) * any_value(scale) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ds ORDER BY term) - 1 AS place
          FROM ahead_terms_{tag}) t
    JOIN betas_{tag} USING (series_id, place) JOIN axis_{tag} USING (series_id)
    GROUP BY series_id, ds)
"""


def future(source: str, months: int) -> str:
    return f"""
    (SELECT series_id, CAST(max(ds) + to_months(CAST(h AS INTEGER)) AS DATE) AS ds
     FROM {source}, range(1, {months + 1}) AS months(h) GROUP BY series_id, h)"""


def differences(source: str, tag: str) -> str:
    """Differencing orders of each series, and its differenced values ``(i, w)``."""
    return f"""
{calendar(source, tag)},
trends_{tag} AS (
    SELECT series_id, ds, y, month(ds) AS month,
           CASE WHEN count(y) OVER (near ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
                THEN y - (avg(y) OVER (near ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
                    + avg(y) OVER (near ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2
           END AS around
    FROM calendar_{tag} WINDOW near AS (PARTITION BY series_id ORDER BY ds)),
strengths_{tag} AS (
    SELECT series_id, count(y) AS n, max(ds) AS last,
           greatest(1 - var_samp(rest) / var_samp(around), 0) AS strength
    FROM (SELECT *, around - avg(around) OVER (PARTITION BY series_id, month) AS rest
          FROM trends_{tag})
    GROUP BY series_id),
yearly_{tag} AS (
    SELECT *, CAST(strength > 0.64::DOUBLE AND n >= 36 AS INTEGER) AS seasonal_d
    FROM strengths_{tag}),
stable_{tag} AS (
    SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS i,
           count(v) OVER (PARTITION BY series_id) AS m,
           v - avg(v) OVER (PARTITION BY series_id) AS e
    FROM (SELECT series_id, ds, seasonal_d, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS place,
                 CASE WHEN seasonal_d = 0 THEN y
                 ELSE y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY ds) END AS v
          FROM calendar_{tag} JOIN yearly_{tag} USING (series_id))
    WHERE place > 12 * seasonal_d),
spans_{tag} AS (
    SELECT series_id, m, sum(walk * walk) FILTER (e IS NOT NULL) AS squares, sum(e * e) / m AS variance,
           CAST(floor(3 * sqrt(m) / 13) AS INTEGER) AS lags
    FROM (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS walk FROM stable_{tag})
    GROUP BY series_id, m),
covariances_{tag} AS (
    SELECT a.series_id, c.i - a.i AS j, sum(a.e * c.e) / any_value(a.m) AS covariance
    FROM stable_{tag} a JOIN stable_{tag} c ON c.series_id = a.series_id AND c.i > a.i
    JOIN spans_{tag} s ON s.series_id = a.series_id AND c.i - a.i <= s.lags
    GROUP BY 1, 2),
orders_{tag} AS (
    SELECT *, CAST(kpss > 0.463::DOUBLE AS INTEGER) AS d
    FROM (SELECT series_id, squares / (m * m * long_run) AS kpss
          FROM (SELECT series_id, m, squares, variance
                       + coalesce(sum(2 * (1 - j / (lags + 1)) * covariance), 0) AS long_run
                FROM spans_{tag} LEFT JOIN covariances_{tag} USING (series_id)
                GROUP BY series_id, m, squares, variance))
    JOIN yearly_{tag} USING (series_id)),
differenced_{tag} AS (
    SELECT series_id, w, row_number() OVER (PARTITION BY series_id ORDER BY i) AS i
    FROM (SELECT s.series_id, i, d, CASE WHEN d = 0 THEN v
                 ELSE v - lag(v) OVER (PARTITION BY s.series_id ORDER BY i) END AS w
          FROM stable_{tag} s JOIN orders_{tag} USING (series_id))
    WHERE d = 0 OR i > 1)
"""


def _systems(columns: str, name: str) -> str:
    """Normal equations ``[X'X, X'y]`` per series from rows ``(series_id, i, term, value)``.

    Terms are numbered from 1 without gaps; the target is the last one.
    """
    return f"""
{name} AS (
    SELECT series_id, list(line ORDER BY a) AS zz
    FROM (SELECT series_id, a, list(v ORDER BY b) AS line
          FROM (SELECT l.series_id, l.term AS a, r.term AS b, sum(l.value * r.value) AS v
                FROM {columns} l JOIN {columns} r USING (series_id, i) GROUP BY 1, 2, 3)
          GROUP BY 1, 2)
    GROUP BY series_id)
"""


def _dies_out(weights: str) -> str:
    """Whether ``x[t] = sum(weights[k] x[t - k])`` shrinks faster than 0.999 to the t.

    Steps the weights down to order one; every last weight on the way must be inside (-1, 1). The
    first number of the state tells whether that held so far.
    """
    scaled = f"list_transform({weights}, lambda v, k: v / 0.999::DOUBLE ** k)"
    return f"""
    (list_reduce(
        list_transform(range(0, len({weights})), lambda q: [0.0::DOUBLE]),
        lambda s, x: CASE
            WHEN s[1] = 0 OR abs(s[len(s)]) >= 1 THEN list_transform(s[1:len(s) - 1], lambda v: 0)
            ELSE list_prepend(1, list_transform(s[2:len(s) - 1],
                lambda v, k: (v + s[len(s)] * s[len(s) - k]) / (1 - s[len(s)] * s[len(s)])))
            END,
        list_prepend(1.0::DOUBLE, {scaled}))[1] = 1)"""


def arima(source: str, tag: str) -> str:
    """The autoregressive moving-average search: long autoregression, then every candidate."""
    return f"""
{differences(source, tag)},
sizes_{tag} AS (
    SELECT series_id, n, last, d, seasonal_d, m, order_long, longest_p,
           greatest(order_long + 2, 3, 12 * longest_p) AS start, d + seasonal_d < 2 AS constant,
           CASE WHEN d + seasonal_d < 2 THEN mean ELSE 0 END AS middle
    FROM (SELECT *, least(12, m // 5) AS order_long, CAST(m >= 36 AS INTEGER) AS longest_p
          FROM orders_{tag}
          JOIN (SELECT series_id, count(*) AS m, avg(w) AS mean FROM differenced_{tag} GROUP BY 1)
              USING (series_id))),
long_columns_{tag} AS (
    SELECT * FROM (
        SELECT series_id, i, 1 AS term, 1.0::DOUBLE AS value
        FROM differenced_{tag} JOIN sizes_{tag} USING (series_id) WHERE i > order_long
        UNION ALL
        SELECT t.series_id, t.i, CASE WHEN k = 0 THEN order_long + 2 ELSE k + 1 END, p.w - middle
        FROM differenced_{tag} t JOIN sizes_{tag} z USING (series_id),
             range(0, 13) AS lags(k), differenced_{tag} p
        WHERE t.i > order_long AND k <= order_long AND p.series_id = t.series_id AND p.i = t.i - k)
    QUALIFY bool_and(value IS NOT NULL) OVER (PARTITION BY series_id, i)),
{_systems(f"long_columns_{tag}", f"long_systems_{tag}")},
long_fits_{tag} AS (
    SELECT series_id, {_solved("aug")} AS beta
    FROM (SELECT series_id, zz[1:len(zz) - 1] AS aug FROM long_systems_{tag})),
shocks_{tag} AS (
    SELECT series_id, i, coalesce(e, 0) AS e
    FROM differenced_{tag} LEFT JOIN (
        SELECT series_id, i, sum(CASE WHEN term = order_long + 2 THEN value
                                      ELSE -value * beta[term] END) AS e
        FROM long_columns_{tag} JOIN long_fits_{tag} USING (series_id)
        JOIN sizes_{tag} USING (series_id) GROUP BY 1, 2) USING (series_id, i)),
columns_{tag} AS (
    SELECT * FROM (
    SELECT series_id, i, 1 AS term, 1.0::DOUBLE AS value
    FROM differenced_{tag} JOIN sizes_{tag} USING (series_id) WHERE i > start
    UNION ALL
    SELECT t.series_id, t.i, term, p.w - middle
    FROM differenced_{tag} t JOIN sizes_{tag} USING (series_id),
         (VALUES (2, 1), (3, 2), (4, 3), (5, 12), (8, 0)) AS lags(term, k), differenced_{tag} p
    WHERE t.i > start AND p.series_id = t.series_id AND p.i = t.i - k
    UNION ALL
    SELECT t.series_id, t.i, 5 + k, p.e
    FROM differenced_{tag} t JOIN sizes_{tag} USING (series_id),
         range(1, 3) AS lags(k), shocks_{tag} p
    WHERE t.i > start AND p.series_id = t.series_id AND p.i = t.i - k)
    QUALIFY bool_and(value IS NOT NULL) OVER (PARTITION BY series_id, i)),
{_systems(f"columns_{tag}", f"systems_{tag}")},
chosen_{tag} AS (
    SELECT series_id, n, last, d, seasonal_d, constant, middle, zz[1][1] AS rows, zz, p, q, sp,
           list_filter([CASE WHEN constant THEN 1 END, CASE WHEN p >= 1 THEN 2 END,
                        CASE WHEN p >= 2 THEN 3 END, CASE WHEN p >= 3 THEN 4 END,
                        CASE WHEN sp = 1 THEN 5 END, CASE WHEN q >= 1 THEN 6 END,
                        CASE WHEN q >= 2 THEN 7 END], lambda v: v IS NOT NULL) AS cols
    FROM sizes_{tag} JOIN systems_{tag} USING (series_id),
         range(0, 4) AS ps(p), range(0, 3) AS qs(q), range(0, 2) AS sps(sp)
    WHERE sp <= longest_p),
candidate_fits_{tag} AS (
    SELECT *, zz[8][8] - coalesce(list_sum(list_transform(beta, lambda v, i: v * zz[8][cols[i]])), 0)
              AS sse,
           len(cols) + 1 AS k,
           list_transform(range(1, 13), lambda a: CASE
               WHEN a <= p THEN beta[list_position(cols, a + 1)]
               WHEN a = 12 AND sp = 1 THEN beta[list_position(cols, 5)] ELSE 0 END) AS phi,
           list_transform(range(1, 3), lambda a: CASE
               WHEN a <= q THEN beta[list_position(cols, a + 5)] ELSE 0 END) AS theta
    FROM (SELECT *, {_solved("aug")} AS beta
          FROM (SELECT *, list_transform(cols, lambda a: list_append(
                    list_transform(cols, lambda b: zz[a][b]), zz[a][8])) AS aug
                FROM chosen_{tag}))),
arima_{tag} AS (
    SELECT *, CASE WHEN constant THEN beta[1] + middle * (1 - list_sum(phi)) ELSE 0 END AS "offset",
           rows * ln(greatest(sse, 1e-12) / rows) + 2 * k + 2.0::DOUBLE * k * (k + 1) / (rows - k - 1)
               AS aicc
    FROM candidate_fits_{tag}
    WHERE rows - k - 1 > 0 AND {_dies_out("phi")}
          AND {_dies_out("list_transform(theta, lambda v: -v)")}
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aicc, p, q, sp) = 1)
"""


def arima_path(source: str, tag: str, horizon: int) -> str:
    """Forecast months 1 to ``horizon``: the differenced recursion, summed back up."""
    return f"""
filled_{tag} AS (
    SELECT series_id, ds, coalesce(y, lag(y, 12) OVER months,
               last_value(y IGNORE NULLS) OVER (months ROWS UNBOUNDED PRECEDING)) AS y
    FROM calendar_{tag} WINDOW months AS (PARTITION BY series_id ORDER BY ds)),
recent_{tag} AS (
    SELECT series_id, list(w ORDER BY ds DESC) FILTER (w IS NOT NULL) AS ws, list(y ORDER BY ds DESC) AS ys
    FROM (SELECT *, v - CASE WHEN d = 1 THEN lag(v) OVER (PARTITION BY series_id ORDER BY ds) ELSE 0 END AS w
          FROM (SELECT f.series_id, ds, y, d, y - CASE WHEN seasonal_d = 1
                           THEN lag(y, 12) OVER (PARTITION BY f.series_id ORDER BY ds) ELSE 0 END AS v
                FROM filled_{tag} f JOIN orders_{tag} USING (series_id)))
    GROUP BY series_id),
walked_{tag} AS (
    SELECT series_id, last, d, seasonal_d, "offset", phi, theta, 0 AS h, ws, es, ys
    FROM arima_{tag}
    JOIN recent_{tag} USING (series_id)
    JOIN (SELECT series_id, list(e ORDER BY i DESC) AS es FROM shocks_{tag} GROUP BY 1)
        USING (series_id)
    UNION ALL
    SELECT series_id, last, d, seasonal_d, "offset", phi, theta, h + 1, list_prepend(fresh, ws), es,
           list_prepend(fresh + d * ys[1] + seasonal_d * ys[12] - d * seasonal_d * ys[13], ys)
    FROM (SELECT *, "offset" + list_dot_product(phi, ws[1:12])
                 + CASE h WHEN 0 THEN theta[1] * es[1] + theta[2] * es[2]
                          WHEN 1 THEN theta[2] * es[1] ELSE 0 END AS fresh
          FROM walked_{tag} WHERE h < {horizon})),
arima_path_{tag} AS (
    SELECT series_id, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ds, ys[1] AS value
    FROM walked_{tag} WHERE h > 0)
"""


CALIBRATED = f"""{SPLIT}, {ets("train", "a")}, {ets_path("a", 24)},
calibrated AS (
    SELECT series_id, 3 AS model_id, 'ETS' AS model_desc, ds, y AS actual, value AS prediction,
           y - value AS residual
    FROM path_a JOIN test USING (series_id, ds))
"""
ERRORS = """
errors AS (
    SELECT *, abs(residual) AS miss,
           abs(actual - lag(actual) OVER (PARTITION BY series_id, model_id ORDER BY ds)) AS change
    FROM calibrated),
scores AS (
    SELECT series_id, model_id, model_desc, round(avg(miss), 6) AS mae,
           round(100 * avg(miss / abs(actual)), 6) AS mape,
           round(avg(miss) / avg(change), 6) AS mase,
           round(100 * avg(miss / ((abs(actual) + abs(prediction)) / 2)), 6) AS smape,
           round(sqrt(avg(residual * residual)), 6) AS rmse,
           round(CASE WHEN var_pop(actual) * var_pop(prediction) > 0
                 THEN corr(actual, prediction) ** 2 END, 6) AS rsq
    FROM errors GROUP BY 1, 2, 3)
"""

def all_models(source: str, dates: str, tag: str, horizon: int) -> str:
    """The three models fitted to ``source`` and their predictions as ``predicted_{tag}``."""
    return f"""
{arima(source, f"arima{tag}")}, {arima_path(source, f"arima{tag}", horizon)},
{trend(source, f"trend{tag}")}, {trend_path(f"trend{tag}", dates, f"trend_path_{tag}")},
{ets(source, f"ets{tag}")}, {ets_path(f"ets{tag}", horizon)},
predicted_{tag} AS (
    SELECT series_id, 1 AS model_id, 'ARIMA' AS model_desc, ds, value FROM arima_path_arima{tag}
    UNION ALL SELECT series_id, 2, 'PROPHET', ds, value FROM trend_path_{tag}
    UNION ALL SELECT series_id, 3, 'ETS', ds, value FROM path_ets{tag})
"""


ALL_CALIBRATED = f"""{SPLIT}, {all_models("train", "test", "t", 24)},
calibrated AS (
    SELECT series_id, model_id, model_desc, ds, y AS actual, value AS prediction,
           y - value AS residual
    FROM predicted_t JOIN test USING (series_id, ds))
"""
ALL_REFIT = all_models("scopes", future("scopes", 42), "f", 42)
SPREADS = """
spreads AS (
    SELECT series_id, model_id, stddev_samp(residual) AS spread FROM calibrated GROUP BY 1, 2),
ranged AS (
    SELECT series_id, model_id, model_desc, 'prediction' AS key, ds AS index,
           round(value, 6) AS value,
           round(value - 1.959963984540054::DOUBLE * spread, 6) AS conf_lo,
           round(value + 1.959963984540054::DOUBLE * spread, 6) AS conf_hi
    FROM predicted_f LEFT JOIN spreads USING (series_id, model_id))
"""


def _times_difference(polynomial: str, lag: str) -> str:
    """Coefficients of a lag polynomial times ``1 - B^lag``; unchanged when ``lag`` is 0."""
    return f"""CASE WHEN {lag} = 0 THEN {polynomial} ELSE list_transform(
        range(1, len({polynomial}) + {lag} + 1), lambda i: coalesce({polynomial}[i], 0)
            - CASE WHEN i > {lag} THEN {polynomial}[i - {lag}] ELSE 0 END) END"""


def arima_spread(tag: str, horizon: int) -> str:
    """Standard deviations ahead: the response to one shock, squared and added up."""
    return f"""
levels_{tag} AS (
    SELECT series_id, last, theta, sse / rows AS variance, list_transform(twice[2:], lambda v: -v) AS weights
    FROM (SELECT *, {_times_difference("once", "(12 * seasonal_d)")} AS twice
          FROM (SELECT *, {_times_difference("ar", "d")} AS once
                FROM (SELECT *, list_prepend(1.0::DOUBLE, list_transform(phi, lambda v: -v)) AS ar
                      FROM arima_{tag})))),
responses_{tag} AS (
    SELECT series_id, last, theta, variance, weights, 1 AS h, [1.0::DOUBLE] AS psi FROM levels_{tag}
    UNION ALL
    SELECT series_id, last, theta, variance, weights, h + 1, list_prepend(
               coalesce(theta[h], 0) + list_sum(list_transform(psi, lambda v, k: v * coalesce(weights[k], 0))), psi)
    FROM responses_{tag} WHERE h < {horizon}),
spread_{tag} AS (
    SELECT series_id, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ds,
           sqrt(variance * list_sum(list_transform(psi, lambda v: v * v))) AS spread
    FROM responses_{tag})
"""


def ets_spread(tag: str, horizon: int) -> str:
    """Standard deviations ahead from the weights; none for the multiplicative season."""
    return f"""
spread_{tag} AS (
    SELECT series_id, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ds,
           CASE WHEN season <> 'M' THEN sqrt(sse / m * list_sum(list_transform(range(0, h), lambda j:
               CASE WHEN j = 0 THEN 1 ELSE (alpha + gamma * (j % 12 = 0)::INTEGER + beta
                   * CASE WHEN phi = 1 THEN j ELSE phi * (1 - phi ** j) / (1 - phi) END) ** 2 END))) END AS spread
    FROM fit_{tag}, range(1, {horizon + 1}) AS months(h))
"""


def trend_spread(tag: str, dates: str) -> str:
    """Standard deviations ahead: the noise, and slope changes as frequent and large as those before."""
    return f"""
spread_{tag} AS (
    SELECT series_id, ds, scale * sqrt(noise + e.bends * 2 * size ** 2
               * greatest((ds - first) / span - 1, 0) ** 3 / 3) AS spread
    FROM {dates} JOIN axis_{tag} USING (series_id) JOIN (
        SELECT series_id, noise, bends, CASE WHEN bends > 0 THEN list_sum(list_transform(
                   beta[3 : 2 + bends::INTEGER], lambda v: abs(v))) / bends ELSE 0 END AS size
        FROM ended_{tag}) e USING (series_id))
"""


REFIT = f"""{SCOPES}, {ets("scopes", "b")}, {ets_path("b", 42)}"""
REGION_REFIT = f"""{PANEL}, {ets("p0", "b")}, {ets_path("b", 42)}"""

REGION_TREND = f"""{PANEL}, {trend("p0", "b")}, {trend_path("b", future("p0", 42), "path_b")}"""

ROLLUPS = """
ahead AS (
    SELECT strftime(ds, '%Y-%m') AS mes_ano, CAST(year(ds) AS INTEGER) AS ano,
           round(sum(value), 6) AS total, 'previsto' AS tipo, series_id AS regiao
    FROM path_b GROUP BY 1, 2, 4, 5)
"""
OBSERVED = """
seen AS (
    SELECT strftime(ds, '%Y-%m') AS mes_ano, CAST(year(ds) AS INTEGER) AS ano,
           sum(y) AS total, 'atual' AS tipo, series_id AS regiao
    FROM p0 WHERE ds > DATE '1997-01-01' GROUP BY 1, 2, 4, 5)
"""

LINES = """
lines AS (
    SELECT r_name AS regiao, CAST(date_trunc('month', l_shipdate) AS DATE) AS data,
           l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS linhas,
           sum(l_quantity) AS quantidade
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3, 4)
"""


def _strict(aggregate: str, column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN {aggregate}({column}) END"


_CELLS = [(flag, level, status) for flag in "ANR" for level, status in ((1, "F"), (2, "O"))]
_MONTHLY = ", ".join(
    f"sum(quantidade) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}') / "
    f"sum(linhas) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}') AS \"{f},{v}\""
    for f, v, s in _CELLS
)
_MEANS = ", ".join(f'{_strict("avg", chr(34) + f"{f},{v}" + chr(34))} AS "{f},{v}"' for f, v, _ in _CELLS)
TIMES = f"""{LINES},
sheet AS (
    SELECT strftime(data, '%Y-%m') AS mes_ano, year(data) AS ano, regiao, {_MONTHLY}
    FROM lines GROUP BY 1, 2, 3),
means AS (SELECT regiao, {_MEANS} FROM sheet GROUP BY regiao),
times AS (
    SELECT regiao, split_part(k, ',', 1) AS procedimento, split_part(k, ',', 2) AS nivel_atencao,
           tempo, CAST(split_part(k, ',', 2) AS DOUBLE) AS nivel,
           CASE split_part(k, ',', 2) WHEN '1' THEN 'Primária' WHEN '2' THEN 'Especializada' END
               AS atencao
    FROM means UNPIVOT INCLUDE NULLS (tempo FOR k IN ("A,1", "A,2", "N,1", "N,2", "R,1", "R,2")))
"""

DEMAND = f"""{LINES},
demand AS (
    SELECT CAST(year(data) AS INTEGER) AS ano, regiao,
           coalesce(sum(quantidade) FILTER (l_returnflag = 'A'), 0) AS tempo_a,
           coalesce(sum(quantidade) FILTER (l_returnflag = 'N'), 0) AS tempo_n,
           coalesce(sum(quantidade) FILTER (l_returnflag = 'R'), 0) AS tempo_r,
           coalesce(sum(linhas) FILTER (l_returnflag = 'A'), 0) * 20.5::DOUBLE AS "A",
           coalesce(sum(linhas) FILTER (l_returnflag = 'N'), 0) * 20.5::DOUBLE AS "N",
           coalesce(sum(linhas) FILTER (l_returnflag = 'R'), 0) * 20.5::DOUBLE AS "R"
    FROM lines GROUP BY 1, 2)
"""
GAP = f"""{DEMAND},
scenarios(cenario, horas) AS (
    VALUES ('Oferta - Cenário 1 - constante', 20.0::DOUBLE),
           ('Oferta - Cenário 2 - aumento de 5% ao ano', 21.0::DOUBLE),
           ('Oferta - Cenário 3 - alteração para os níveis pré-pandemia (12/2019)', 19.0::DOUBLE)),
supply AS (
    SELECT CAST(year(data) AS INTEGER) AS ano, regiao, l_returnflag AS profissional,
           sum(linhas * horas) AS total, cenario
    FROM lines, scenarios WHERE year(data) > 1997
    GROUP BY ano, regiao, l_linestatus, l_returnflag, cenario),
demand_rows AS (
    SELECT ano, regiao, profissional, total, 'demanda' AS cenario
    FROM (SELECT ano, regiao, "A", "N", "R" FROM demand)
    UNPIVOT INCLUDE NULLS (total FOR profissional IN ("A", "N", "R"))),
both_sides AS (
    SELECT ano, regiao, profissional, total, cenario FROM supply
    UNION ALL SELECT ano, regiao, profissional, total, cenario FROM demand_rows),
wide AS (
    SELECT ano, regiao, profissional,
           sum(total) FILTER (cenario = 'demanda') AS demanda,
           sum(total) FILTER (cenario LIKE 'Oferta - Cenário 1%') AS oferta1,
           sum(total) FILTER (cenario LIKE 'Oferta - Cenário 2%') AS oferta2,
           sum(total) FILTER (cenario LIKE 'Oferta - Cenário 3%') AS oferta3
    FROM both_sides GROUP BY ALL)
"""
_WIDE_MEANS = ", ".join(
    f"{_strict('avg', c)} AS {c}" for c in ("demanda", "oferta1", "oferta2", "oferta3")
)
_RESULTS = ", ".join(f"round(oferta{i} - demanda, 6) AS resultado{i}" for i in (1, 2, 3))
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("demanda", "oferta1", "oferta2", "oferta3"))
MEAN_GAP = f"""{GAP},
mean_gap AS (
    SELECT regiao, profissional, avg(ano) AS ano, {_WIDE_MEANS} FROM wide GROUP BY 1, 2)
"""


def _extract(records: str, code: str, date: str, value: str) -> str:
    return f"""
    SELECT {code} AS code, strftime({date}, '%m%Y') AS mes_ano, count(*) AS total
    FROM {records} WHERE {code} = '{value}' GROUP BY 1, 2"""


EXTRACTS = f"""
extracts AS (
    SELECT code, CAST(strptime(mes_ano, '%m%Y') AS DATE) AS mes_ano, total FROM (
        {_extract("orders", "o_orderstatus", "o_orderdate", "F")}
        UNION ALL {_extract("lineitem", "l_returnflag", "l_shipdate", "R")}
        UNION ALL {_extract("events", "event_type", "ts", "click")}))
"""

_PROFILE = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS column_type, count(*) AS row_count, "
    f"count({c}) AS value_count FROM orders"
    for i, (c, t) in enumerate(
        [
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        ],
        start=1,
    )
)

_WAVES = " UNION ALL ".join(
    f"SELECT {2 + 25 + 2 * (k - 1) + j}, {f}(2 * pi() / 365.25 * epoch_days * {k}) "
    for k in range(1, 11)
    for j, f in enumerate(("sin", "cos"))
)

ORACLES: dict[str, str] = {
    "month_count_sql": _extract("orders", "o_orderpriority", "o_orderdate", "1-URGENT"),
    "priority_count_sql": """
        SELECT split_part(o_orderpriority, '-', 2) AS priority, CAST(year(o_orderdate) AS INTEGER) AS ano,
               count(*) AS total
        FROM orders WHERE o_orderpriority NOT LIKE '%NOT SPECIFIED' GROUP BY 1, 2""",
    "month_series_by_region": f"WITH {PANEL} SELECT series_id, ds, y, 'atual' AS status FROM p0",
    "month_series_from_text": """
        SELECT n_name AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
               CAST(count(*) AS DOUBLE) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON CAST(substring(format('{:06d}7', c_nationkey), 1, 6) AS DOUBLE) = n_nationkey
        WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2""",
    "code_prefix_join": """
        SELECT n_name, CAST(c_nationkey AS DOUBLE) AS codmunres6, count(*) AS n,
               round(sum(c_acctbal), 2) AS total
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "two_hop_join": """
        SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
               CAST(count(*) AS DOUBLE) AS total
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "distinct_periods": f"WITH {PANEL} SELECT DISTINCT ds FROM p0",
    "region_slice": f"WITH {PANEL} SELECT ds, y FROM p0 WHERE series_id = 'ASIA'",
    "union_extracts": f"WITH {EXTRACTS} SELECT * FROM extracts WHERE mes_ano < DATE '2001-10-01'",
    "first_months": f"WITH {EXTRACTS} SELECT * FROM extracts ORDER BY mes_ano, code LIMIT 5",
    "frame_profile": _PROFILE,
    "clean_names_scan": """
        SELECT c_custkey AS c_cust_key, c_nationkey AS nation_key, c_acctbal AS saldo_percent,
               c_mktsegment AS saldo_percent_2 FROM customer""",
    "category_codes": """
        SELECT o_orderpriority, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS id,
               count(*) AS n FROM orders GROUP BY 1, 2""",
    "complete_months": """
        WITH series AS (
            SELECT c_nationkey || '/' || o_orderpriority AS series_id,
                   CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, count(*) AS y
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        calendar AS (
            SELECT series_id,
                   unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 MONTH))
                       ::DATE AS ds
            FROM series GROUP BY series_id)
        SELECT series_id, ds, CAST(coalesce(y, 0) AS DOUBLE) AS y
        FROM calendar LEFT JOIN series USING (series_id, ds)""",
    "split_by_duration": f"WITH {PANEL}, {_split('p0')} SELECT * FROM parts",
    "split_by_date": f"""WITH {PANEL}
        SELECT *, CASE WHEN ds < DATE '2000-07-01' THEN 'training' ELSE 'testing' END AS split_key
        FROM p0""",
    "split_plan": f"""WITH {PANEL}, {_split('p0')}
        SELECT 'Slice1' AS id, split_key AS key, series_id, ds, y FROM parts""",
    "future_frame": f"""WITH {PANEL}
        SELECT series_id, CAST(max(ds) + to_months(CAST(h AS INTEGER)) AS DATE) AS ds
        FROM p0, range(1, 43) AS months(h) GROUP BY series_id, h""",
    "total_series": f"WITH {SCOPES} SELECT series_id, ds, y FROM scopes",
    "trend_season_design": f"""WITH {SCOPES},
        axis AS (
            SELECT series_id, min(ds) AS first, max(ds) - min(ds) AS span FROM scopes GROUP BY 1),
        rows AS (
            SELECT series_id, ds, (ds - first) / span AS t, ds - DATE '1970-01-01' AS epoch_days
            FROM scopes JOIN axis USING (series_id))
        SELECT series_id, ds, CAST(term AS INTEGER) AS term, round(value, 6) AS value
        FROM rows, LATERAL (
            SELECT 0 AS term, 1.0::DOUBLE AS value
            UNION ALL SELECT 1, t
            UNION ALL SELECT 1 + j, greatest(t - 0.8::DOUBLE * j / 25, 0) FROM range(1, 26) AS bends(j)
            UNION ALL {_WAVES}) AS terms""",
    "fit_trend_season": f"""WITH RECURSIVE {SPLIT}, {trend("train", "a")}
        SELECT series_id, CAST(n AS INTEGER) AS n_obs, converged, CAST(place AS INTEGER) AS term,
               round(coefficient, 6) AS value
        FROM betas_a""",
    "calibration_of": f"""WITH RECURSIVE {SPLIT}, {trend("train", "a")},
        {trend_path("a", "test", "path_a")}
        SELECT series_id, 2 AS model_id, 'PROPHET' AS model_desc, ds, y AS actual,
               round(value, 6) AS prediction, round(y - value, 6) AS residual
        FROM path_a JOIN test USING (series_id, ds)""",
    "in_sample_fit": f"""WITH RECURSIVE {CUT_SPLIT}, {trend("train", "a")},
        {trend_path("a", "train", "path_a")}
        SELECT series_id, ds, 2 AS model_id, 'PROPHET' AS model_desc, round(value, 6) AS value, y
        FROM path_a JOIN train USING (series_id, ds)""",
    "fitted_values": f"""WITH RECURSIVE {SPLIT}, {ets("train", "a")}, {arima("train", "c")},
        {trend("train", "b")}, {trend_path("b", "train", "path_b")},
        ets_fits AS (
            SELECT series_id, CAST(last - to_months(CAST(n - i - 1 AS INTEGER)) AS DATE) AS ds,
                   CASE WHEN season = 'M' THEN (l + phi * b) * s[1] ELSE l + phi * b + s[1] END AS value
            FROM fold_a JOIN (SELECT series_id, grid_id FROM fit_a) USING (series_id, grid_id) WHERE i < n),
        places AS (
            SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS place
            FROM calendar_c),
        arima_fits AS (
            SELECT series_id, ds, y - residual AS value
            FROM (SELECT series_id, i + any_value(d + 12 * seasonal_d) AS place,
                         sum(CASE WHEN term = 8 THEN value
                                  WHEN list_contains(cols, term) THEN -value * beta[list_position(cols, term)]
                                  ELSE 0 END) AS residual
                  FROM columns_c JOIN arima_c USING (series_id) GROUP BY series_id, i)
            JOIN places USING (series_id, place)),
        every AS (
            SELECT series_id, 1 AS model_id, 'ARIMA' AS model_desc, ds, value FROM arima_fits
            UNION ALL SELECT series_id, 2, 'PROPHET', ds, value FROM path_b
            UNION ALL SELECT series_id, 3, 'ETS', ds, value FROM ets_fits)
        SELECT series_id, ds, model_id, model_desc, round(value, 6) AS value, y
        FROM every JOIN train USING (series_id, ds)""",
    "model_intervals": f"""WITH RECURSIVE {SCOPES}, {ALL_REFIT}, {arima_spread("arimaf", 42)},
        {ets_spread("etsf", 42)}, {trend_spread("trendf", future("scopes", 42))},
        spreads AS (
            SELECT series_id, 1 AS model_id, ds, spread FROM spread_arimaf
            UNION ALL SELECT series_id, 2, ds, spread FROM spread_trendf
            UNION ALL SELECT series_id, 3, ds, spread FROM spread_etsf)
        SELECT series_id, model_id, model_desc, ds, round(value, 6) AS value,
               round(value - 1.959963984540054::DOUBLE * spread, 6) AS conf_lo,
               round(value + 1.959963984540054::DOUBLE * spread, 6) AS conf_hi, spread IS NOT NULL AS closed
        FROM predicted_f JOIN spreads USING (series_id, model_id, ds)""",
    "forecast_vs_observed": f"""WITH RECURSIVE {CUT_SPLIT}, {trend("train", "a")},
        {trend_path("a", future("train", 12), "path_a")}
        SELECT series_id, ds, round(value, 6) AS yhat, y
        FROM path_a LEFT JOIN test USING (series_id, ds)""",
    "mae_mape": f"""WITH RECURSIVE {CUT_SPLIT}, {trend("train", "a")},
        {trend_path("a", future("train", 12), "path_a")}
        SELECT series_id, round(avg(abs(y - value)), 6) AS mae,
               round(avg(abs(y - value) / greatest(abs(value), 2.220446049250313e-16)), 6) AS mape
        FROM path_a LEFT JOIN test USING (series_id, ds) GROUP BY series_id""",
    "forecast_rollup": f"WITH RECURSIVE {REGION_TREND}, {ROLLUPS} SELECT * FROM ahead",
    "forecast_combined": f"""WITH RECURSIVE {REGION_TREND}, {ROLLUPS}, {OBSERVED}
        SELECT *, CAST(strptime(mes_ano || '-01', '%Y-%m-%d') AS DATE) AS mes_ano_data
        FROM (SELECT * FROM seen UNION ALL SELECT * FROM ahead)""",
    "fit_arima": f"""WITH RECURSIVE {SPLIT}, {arima("train", "c")}
        SELECT series_id, CAST(n AS INTEGER) AS n_obs,
               printf('ARIMA(%d,%d,%d)(%d,%d,0)[12]', p, d, q, sp, seasonal_d) AS form,
               round("offset", 6) AS "offset", round(sse, 6) AS sse, round(aicc, 6) AS aicc
        FROM arima_c""",
    "fit_gapped": f"""WITH RECURSIVE gapped AS (
            SELECT c_nationkey || '/' || o_orderpriority AS series_id,
                   CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
                   CAST(count(*) AS DOUBLE) AS y
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        {ets("gapped", "g")}
        SELECT series_id, CAST(n_obs AS INTEGER) AS n_obs, CAST(grid_id AS INTEGER) AS grid_id,
               'ETS(A,' || trend || ',' || season || ')' AS form, round(l, 6) AS level,
               round(b, 6) AS slope, round(sse, 6) AS sse, round(aicc, 6) AS aicc
        FROM fit_g""",
    "fit_ets": f"""WITH RECURSIVE {SPLIT}, {ets("train", "a")}
        SELECT series_id, CAST(n_obs AS INTEGER) AS n_obs, CAST(grid_id AS INTEGER) AS grid_id,
               'ETS(A,' || trend || ',' || season || ')' AS form, round(l, 6) AS level,
               round(b, 6) AS slope, round(sse, 6) AS sse, round(aicc, 6) AS aicc
        FROM fit_a""",
    "model_table": f"""WITH RECURSIVE {ALL_CALIBRATED},
        forms AS (
            SELECT series_id, 1 AS model_id, 'ARIMA' AS model_desc, n,
                   printf('ARIMA(%d,%d,%d)(%d,%d,0)[12]', p, d, q, sp, seasonal_d) AS form,
                   list_concat(list_concat(["offset"],
                       list_transform(twice[2:], lambda v: -v)), theta) AS coefficients
            FROM (SELECT *, {_times_difference("once", "(12 * seasonal_d)")} AS twice
                  FROM (SELECT *, {_times_difference("ar", "d")} AS once
                        FROM (SELECT *, list_prepend(1.0::DOUBLE, list_transform(phi, lambda v: -v))
                                            AS ar
                              FROM arima_arimat)))
            UNION ALL
            SELECT series_id, 2, 'PROPHET', n,
                   printf('trend with %d changepoints and yearly season', CAST(bends AS INTEGER)),
                   beta
            FROM ended_trendt
            UNION ALL
            SELECT series_id, 3, 'ETS', n_obs, 'ETS(A,' || trend || ',' || season || ')',
                   list_concat([alpha, beta, gamma, phi, l, b], s)
            FROM fit_etst)
        SELECT series_id, model_id, model_desc, form, CAST(n AS INTEGER) AS n_obs,
               CAST(generate_subscripts(coefficients, 1) - 1 AS INTEGER) AS term,
               round(unnest(coefficients), 6) AS value
        FROM forms""",
    "calibrate": f"""WITH RECURSIVE {ALL_CALIBRATED}
        SELECT series_id, model_id, model_desc, ds, actual, round(prediction, 6) AS prediction,
               round(residual, 6) AS residual
        FROM calibrated""",
    "accuracy": f"""WITH RECURSIVE {ALL_CALIBRATED}, {ERRORS}
        SELECT * FROM scores""",
    "refit_forecast": f"""WITH RECURSIVE {SCOPES}, {ALL_REFIT}
        SELECT series_id, model_id, model_desc, ds, round(value, 6) AS value FROM predicted_f""",
    "forecast_with_actuals": f"""WITH RECURSIVE {ALL_CALIBRATED}, {ALL_REFIT}, {SPREADS}
        SELECT * FROM ranged
        UNION ALL SELECT series_id, NULL, 'ACTUAL', 'actual', ds, y, NULL, NULL FROM scopes""",
    "forecast_intervals": f"""WITH RECURSIVE {ALL_CALIBRATED}, {ALL_REFIT}, {SPREADS}
        SELECT * FROM ranged""",
    "holdout_forecast": f"""WITH RECURSIVE {ALL_CALIBRATED},
        spreads AS (
            SELECT series_id, model_id, stddev_samp(residual) AS spread FROM calibrated GROUP BY 1, 2)
        SELECT series_id, model_id, model_desc, 'prediction' AS key, ds AS index,
               round(prediction, 6) AS value,
               round(prediction - 1.959963984540054::DOUBLE * spread, 6) AS conf_lo,
               round(prediction + 1.959963984540054::DOUBLE * spread, 6) AS conf_hi
        FROM calibrated JOIN spreads USING (series_id, model_id)
        UNION ALL SELECT series_id, NULL, 'ACTUAL', 'actual', ds, y, NULL, NULL FROM scopes""",
    "forecast_frame_80": f"""WITH RECURSIVE {CUT_SPLIT}, {trend("train", "a")},
        {trend_path("a", "test", "path_t")},
        frame AS (
            SELECT series_id, ds FROM train
            UNION ALL SELECT series_id, CAST(max(ds) + to_months(CAST(h AS INTEGER)) AS DATE)
            FROM train, range(1, 13) AS months(h) GROUP BY series_id, h),
        {trend_terms("axis_a", "frame", "frame_terms")},
        framed AS (
            SELECT series_id, ds, sum(t.value * coefficient) * any_value(scale) AS value
            FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ds ORDER BY term) - 1 AS place
                  FROM frame_terms) t
            JOIN betas_a USING (series_id, place) JOIN axis_a USING (series_id)
            GROUP BY series_id, ds),
        spreads AS (
            SELECT series_id, 1.2815515655446004::DOUBLE * stddev_samp(y - value) AS half
            FROM path_t JOIN test USING (series_id, ds) GROUP BY 1)
        SELECT series_id, ds, round(value, 6) AS yhat, round(value - half, 6) AS yhat_lower,
               round(value + half, 6) AS yhat_upper
        FROM framed JOIN spreads USING (series_id)""",
    "observed_and_forecast": f"""WITH RECURSIVE {REGION_TREND},
        months AS (
            SELECT series_id, ds, value AS total, 'previsto' AS status FROM path_b
            UNION ALL SELECT series_id, ds, y, 'atual' FROM p0)
        SELECT CASE series_id WHEN 'MIDDLE EAST' THEN 'Middle-East'
               ELSE upper(series_id[1]) || lower(series_id[2:]) END AS macrorregiao,
               ds AS data, round(total, 6) AS total, status
        FROM months""",
    "calibrate_ets": f"""WITH RECURSIVE {CALIBRATED}
        SELECT series_id, model_id, model_desc, ds, actual, round(prediction, 6) AS prediction,
               round(residual, 6) AS residual
        FROM calibrated""",
    "accuracy_ets": f"""WITH RECURSIVE {CALIBRATED}, {ERRORS} SELECT * FROM scores""",
    "differencing_orders": f"""WITH {SCOPES}, {differences("scopes", "b")}
        SELECT series_id, CAST(n AS INTEGER) AS n_obs, round(strength, 6) AS strength,
               round(kpss, 6) AS kpss, d, seasonal_d
        FROM orders_b""",
    "refit_forecast_ets": f"""WITH RECURSIVE {REFIT}
        SELECT series_id, 3 AS model_id, 'ETS' AS model_desc, ds, round(value, 6) AS value
        FROM path_b""",
    "forecast_with_actuals_ets": f"""WITH RECURSIVE {CALIBRATED}, {ets("scopes", "b")},
        {ets_path("b", 42)},
        spreads AS (SELECT series_id, stddev_samp(residual) AS spread FROM calibrated GROUP BY 1)
        SELECT series_id, 3 AS model_id, 'ETS' AS model_desc, 'prediction' AS key, ds AS index,
               round(value, 6) AS value,
               round(value - 1.959963984540054::DOUBLE * spread, 6) AS conf_lo,
               round(value + 1.959963984540054::DOUBLE * spread, 6) AS conf_hi
        FROM path_b LEFT JOIN spreads USING (series_id)
        UNION ALL SELECT series_id, NULL, 'ACTUAL', 'actual', ds, y, NULL, NULL FROM scopes""",
    "actual_rows": f"""WITH {SCOPES}
        SELECT series_id, 'actual' AS key, ds AS index, y AS value FROM scopes
        WHERE ds > DATE '1999-01-01'""",
    "forecast_vs_observed_ets": f"""WITH RECURSIVE {CUT_SPLIT}, {ets("train", "a")},
        {ets_path("a", 12)}
        SELECT series_id, ds, round(value, 6) AS yhat, y
        FROM path_a LEFT JOIN test USING (series_id, ds)""",
    "mae_mape_ets": f"""WITH RECURSIVE {CUT_SPLIT}, {ets("train", "a")}, {ets_path("a", 12)}
        SELECT series_id, round(avg(abs(y - value)), 6) AS mae,
               round(avg(abs(y - value) / greatest(abs(value), 2.220446049250313e-16)), 6) AS mape
        FROM path_a LEFT JOIN test USING (series_id, ds) GROUP BY series_id""",
    "forecast_rollup_ets": f"WITH RECURSIVE {REGION_REFIT}, {ROLLUPS} SELECT * FROM ahead",
    "actual_rollup": f"WITH {PANEL}, {OBSERVED} SELECT * FROM seen",
    "forecast_combined_ets": f"""WITH RECURSIVE {REGION_REFIT}, {ROLLUPS}, {OBSERVED}
        SELECT *, CAST(strptime(mes_ano || '-01', '%Y-%m-%d') AS DATE) AS mes_ano_data
        FROM (SELECT * FROM seen UNION ALL SELECT * FROM ahead)""",
    "panel_row_counts": f"""WITH {PANEL}
        SELECT CASE series_id WHEN 'MIDDLE EAST' THEN 'Middle-East'
               ELSE upper(series_id[1]) || lower(series_id[2:]) END AS macrorregiao,
               42 + count(*) AS n
        FROM p0 GROUP BY 1""",
    "canonical_labels": f"""WITH {PANEL},
        spelled AS (
            SELECT y, CASE month(ds) % 4
                WHEN 0 THEN 'Macrorregião ' || CASE series_id WHEN 'MIDDLE EAST' THEN 'Middle East'
                    ELSE series_id[1] || lower(series_id[2:]) END
                WHEN 1 THEN replace(lower(series_id), ' ', '_')
                WHEN 2 THEN ' macrorregi?o ' || replace(series_id, ' ', '-')
                ELSE 'Norte ' || series_id END AS rotulo
            FROM p0),
        plain AS (
            SELECT y, rotulo, regexp_replace(regexp_replace(strip_accents(lower(trim(rotulo))),
                '[_-]', ' ', 'g'), '^macrorregi.o ', '') AS name
            FROM spelled)
        SELECT rotulo, CASE name WHEN 'africa' THEN 'Africa' WHEN 'america' THEN 'America'
               WHEN 'asia' THEN 'Asia' WHEN 'europe' THEN 'Europe'
               WHEN 'middle east' THEN 'Middle-East' END AS macrorregiao, sum(y) AS total
        FROM plain GROUP BY 1, 2""",
    "procedure_times": f"""WITH {TIMES}
        SELECT regiao, procedimento, nivel_atencao, round(tempo, 6) AS tempo, nivel, atencao
        FROM times""",
    "procedure_rank": f"""WITH {TIMES},
        medians AS (SELECT procedimento, median(tempo) AS mediana FROM times GROUP BY 1)
        SELECT procedimento, round(mediana, 6) AS mediana,
               CAST(row_number() OVER (ORDER BY mediana NULLS FIRST, procedimento) AS INTEGER)
                   AS posicao
        FROM medians""",
    "yearly_demand": f"WITH {DEMAND} SELECT * FROM demand",
    "demand_long": f"WITH {GAP} SELECT * FROM demand_rows",
    "supply_by_year": f"WITH {GAP} SELECT * FROM supply",
    "demand_supply": f"WITH {GAP} SELECT * FROM both_sides",
    "scenario_totals": f"""WITH {GAP}
        SELECT CASE WHEN cenario = 'demanda' THEN 'demanda'
                    ELSE 'oferta' || substring(cenario, 18, 1) END AS status,
               count(*) AS n, sum(total) AS total
        FROM both_sides GROUP BY 1""",
    "gap_labels": f"WITH {GAP} SELECT *, round_even(total, 0) AS rotulo FROM both_sides",
    "deficit": f"""WITH {MEAN_GAP}
        SELECT regiao, profissional, round(ano, 6) AS ano, {_ROUNDED}, {_RESULTS} FROM mean_gap""",
    "deficit_by_year": f"""WITH {GAP}
        SELECT regiao, profissional, ano, {_ROUNDED}, {_RESULTS} FROM wide""",
    "deficit_common_years": f"""WITH {GAP},
        mean_gap AS (
            SELECT regiao, profissional, avg(ano) AS ano, {_WIDE_MEANS} FROM wide
            WHERE ano IN (SELECT ano FROM supply) AND ano IN (SELECT ano FROM demand_rows)
            GROUP BY 1, 2)
        SELECT regiao, profissional, round(ano, 6) AS ano, {_ROUNDED}, {_RESULTS} FROM mean_gap""",
    "deficit_unique_keys": f"""WITH {GAP}
        SELECT regiao, profissional, ano, {_ROUNDED}, {_RESULTS} FROM wide
        WHERE ano IN (SELECT ano FROM supply) AND ano IN (SELECT ano FROM demand_rows)""",
    "deficit_long": f"""WITH {MEAN_GAP},
        results AS (SELECT round(ano, 6) AS ano, regiao, profissional, {_RESULTS} FROM mean_gap)
        SELECT ano, regiao, profissional, cenario, resultado FROM results
        UNPIVOT INCLUDE NULLS (resultado FOR cenario IN (resultado1, resultado2, resultado3))""",
    "workload": f"""WITH {DEMAND},
        shifts AS (
            SELECT ano, regiao, (0.5::DOUBLE * tempo_a + tempo_n) / 960 AS medico_ab,
                   tempo_r / 960 AS medico_esp, 0.5::DOUBLE * tempo_a / 960 AS enf_ab
            FROM demand)
        SELECT ano, regiao, profissional, round(total, 6) AS total FROM shifts
        UNPIVOT INCLUDE NULLS (total FOR profissional IN (medico_ab, medico_esp, enf_ab))""",
    "export_roundtrip": f"""WITH {PANEL}, {OBSERVED}
        SELECT row_number() OVER (ORDER BY regiao, mes_ano) AS row_id, *,
               CAST(strptime(mes_ano || '-01', '%Y-%m-%d') AS DATE) AS mes_ano_data
        FROM seen""",
    "export_without_numbers": f"""WITH {PANEL}, {OBSERVED}
        SELECT *, CAST(strptime(mes_ano || '-01', '%Y-%m-%d') AS DATE) AS mes_ano_data FROM seen""",
    "sheet_roundtrip": f"WITH {DEMAND} SELECT ano, regiao, tempo_a, tempo_n, tempo_r FROM demand",
}
