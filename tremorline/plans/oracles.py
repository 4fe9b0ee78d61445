"""SQL for DuckDB that gives the same rows as the queries of the registry.

Each text is self-contained: it starts from the driver's tables and spells out every
stage below it, so it shares no code with the operators.
"""

from __future__ import annotations

from ..model import FRACTAL_D, RadiusPolicy
from ..operators import mixture
from .fixture import BBOX, CATALOG, ETA0, MC, MIXTURE, SEED, THREE

US_YEAR = "31557600e0"


def f(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST('{x!r}' AS DOUBLE)"


CAT = f"cat AS ({CATALOG.format(events='events')})"
COMPLETE = f"{CAT}, complete AS (SELECT *, row_number() OVER (ORDER BY t_us, id) AS ord FROM cat WHERE round_even(mag / 0.1e0, 0) * 0.1e0 >= {f(MC)} - 0.025e0)"


def hav(a: str, b: str) -> str:
    return f"(12742e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2e0) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2e0))))))"


def pairs(policy: RadiusPolicy, source: str = "complete", by: str = "", name: str = "paired") -> str:
    """paired: the source's columns with the parent's."""
    if policy.mode == "gk":
        reach = f"WHERE dist <= {f(policy.k)} * pow(10e0, 0.1238e0 * pmag + 0.983e0)"
    else:
        reach = f"WHERE dist <= {f(policy.max_km)}" if policy.max_km else ""
    same = f" AND p.{by} = c.{by}" if by else ""
    key = f"{by}, " if by else ""
    return f"""{name}_all AS (
  SELECT {"c." + by + ", " if by else ""}c.ord AS c_ord, p.ord AS p_ord, p.id AS pid, p.mag AS pmag, (c.t_us - p.t_us) / 1e6 / {US_YEAR} AS dt, {hav("p", "c")} AS dist
  FROM {source} c JOIN {source} p ON p.t_us < c.t_us{same}
), {name}_best AS (
  SELECT {key}c_ord, min({{'eta': dt * pow(greatest(dist, 0.01e0), {f(FRACTAL_D)}) * pow(10e0, -1e0 * pmag), 'p_ord': p_ord, 't': dt, 'r': greatest(dist, 0.01e0), 'pid': pid, 'pmag': pmag}}) AS b
  FROM {name}_all {reach} GROUP BY {key}c_ord
), {name} AS (
  SELECT s.*, b.pid AS parent_id, b.pmag AS parent_mag, b.eta AS eta, CASE WHEN b.eta > 0 THEN log10(b.eta) END AS log10_eta, b.t AS t_years, b.r AS r_km, b.p_ord AS p_ord
  FROM {source} s LEFT JOIN {name}_best ON s.ord = c_ord{f" AND s.{by} = {name}_best.{by}" if by else ""}
)"""


def lcg(name: str, source: str, seed: str, salt: int) -> str:
    """name: source with the portable integer of each row as u."""
    step = lambda n: f"{name}_{n} AS (SELECT * EXCLUDE (u{n - 1}), ((u{n - 1} * u{n - 1}) // 32768 + u{n - 1} * 1103515245 + 12345) % 2147483648 AS u{n} FROM {name}_{n - 1})"
    return f"{name}_0 AS (SELECT *, (ord * 7919 + CAST({seed} AS BIGINT) * 104729 + {salt * 15485863}) % 2147483648 AS u0 FROM {source}), {step(1)}, {step(2)}, {step(3)}, {step(4)}, {name} AS (SELECT * EXCLUDE (u4), u4 AS u FROM {name}_4)"


def density(mu: float, sigma: float) -> str:
    return f"(exp(-0.5e0 * pow((log10_eta - {f(mu)}) / {f(sigma)}, 2e0)) / ({f(sigma)} * {f((2 * 3.141592653589793) ** 0.5)}))"


PA = f"({f(MIXTURE['weight_aftershocks'])} * {density(MIXTURE['mu_aftershocks'], MIXTURE['sigma_aftershocks'])})"
PB = f"({f(MIXTURE['weight_background'])} * {density(MIXTURE['mu_background'], MIXTURE['sigma_background'])})"
POSTERIOR = f"({PB} / greatest({PA} + {PB}, 1e-300))"

FREE = RadiusPolicy()
CAPPED = RadiusPolicy("fixed", 300.0)
PAIRED = f"{COMPLETE}, {pairs(FREE)}"
def _bell(x: str, mu: str, sigma: str) -> str:
    return f"(exp(-0.5e0 * pow(({x} - {mu}) / {sigma}, 2e0)) / ({sigma} * sqrt(2e0 * pi())))"


def _over(expression: str) -> str:
    """The expression at each place i of the list of values."""
    return f"list_transform(range(1, n + 1), lambda i: {expression})"


#: Expectation maximisation as a recursion over one row of numbers and the list of values.
FITTED = f"""{PAIRED}, vals AS (SELECT log10_eta AS x FROM paired WHERE log10_eta IS NOT NULL),
lists AS (SELECT list(x ORDER BY x) AS v, count(*) AS n FROM vals),
em AS (
  SELECT 0 AS step, 0.5e0 AS w0, 0.5e0 AS w1, quantile_cont(x, 0.25) AS mu0, quantile_cont(x, 0.75) AS mu1,
    greatest(stddev_pop(x) / 2, 1e-3) AS s0, greatest(stddev_pop(x) / 2, 1e-3) AS s1, CAST('-infinity' AS DOUBLE) AS ll, false AS done FROM vals
  UNION ALL
  SELECT step + 1, m0 / n, m1 / n, mu0, mu1,
    greatest(sqrt(list_sum({_over("q0[i] * pow(v[i] - mu0, 2e0)")}) / m0), {f(mixture.SIGMA_FLOOR)}), greatest(sqrt(list_sum({_over("q1[i] * pow(v[i] - mu1, 2e0)")}) / m1), {f(mixture.SIGMA_FLOOR)}),
    ll, abs(ll - last) < {f(mixture.TOLERANCE)}
  FROM (SELECT *, list_sum({_over("q0[i] * v[i]")}) / m0 AS mu0, list_sum({_over("q1[i] * v[i]")}) / m1 AS mu1 FROM (
    SELECT *, list_sum(q0) AS m0, list_sum(q1) AS m1 FROM (
      SELECT step, last, v, n, {_over("d0[i] / t[i]")} AS q0, {_over("d1[i] / t[i]")} AS q1, list_sum({_over("ln(t[i])")}) AS ll FROM (
        SELECT *, {_over(f"greatest(d0[i] + d1[i], {f(mixture.DENSITY_FLOOR)})")} AS t FROM (
          SELECT step, ll AS last, v, n, {_over("w0 * " + _bell("v[i]", "mu0", "s0"))} AS d0, {_over("w1 * " + _bell("v[i]", "mu1", "s1"))} AS d1 FROM em, lists WHERE NOT done AND step < {mixture.MOST_STEPS})))))
), last_step AS (SELECT * FROM em ORDER BY step DESC LIMIT 1
), mix AS (
  SELECT CASE WHEN mu0 <= mu1 THEN w0 ELSE w1 END AS wa, CASE WHEN mu0 <= mu1 THEN w1 ELSE w0 END AS wb, least(mu0, mu1) AS ma, greatest(mu0, mu1) AS mb,
    CASE WHEN mu0 <= mu1 THEN s0 ELSE s1 END AS sa, CASE WHEN mu0 <= mu1 THEN s1 ELSE s0 END AS sb FROM last_step
), points AS (
  SELECT i, x, wa * {_bell("x", "ma", "sa")} - wb * {_bell("x", "mb", "sb")} AS y FROM (SELECT *, ma + (mb - ma) * i / 20000e0 AS x FROM mix, range(0, 20001) AS r(i))
), turns AS (
  SELECT x + (nx - x) * y / (y - ny) AS crossed FROM (SELECT *, lead(x) OVER (ORDER BY i) AS nx, lead(y) OVER (ORDER BY i) AS ny FROM points) WHERE sign(y) <> sign(ny) ORDER BY i LIMIT 1
), cut AS (SELECT mix.*, coalesce((SELECT crossed FROM turns), (ma + mb) / 2) AS c FROM mix
), tails AS (
  SELECT any_value(c) AS c, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5e0 * pow((c - ma) / sa * k / 2000, 2e0))) * any_value((c - ma) / sa) / 6000 / sqrt(2e0 * pi()) AS above,
    sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5e0 * pow((c - mb) / sb * k / 2000, 2e0))) * any_value((c - mb) / sb) / 6000 / sqrt(2e0 * pi()) AS below
  FROM cut, range(0, 2001) AS r(k))"""
THINNED = f"""{PAIRED}, {lcg("drawn", "paired", str(SEED + 1), 3)}, thinned AS (
  SELECT *, CASE WHEN log10_eta IS NOT NULL THEN {POSTERIOR} ELSE 1e0 END AS p_background,
    log10_eta IS NOT NULL AND u / 2147483648e0 >= {POSTERIOR} AS is_aftershock, coalesce(log10_eta < {f(ETA0)}, false) AS is_aftershock_eta FROM drawn)"""
CLUSTERED = f"""{THINNED}, tree AS (
  SELECT id, id AS cluster_id, 0 AS generation FROM thinned WHERE NOT is_aftershock
  UNION ALL SELECT t.id, r.cluster_id, r.generation + 1 FROM thinned t JOIN tree r ON t.is_aftershock AND t.parent_id = r.id
), clustered AS (
  SELECT t.*, cluster_id, generation, row_number() OVER (PARTITION BY cluster_id ORDER BY t_us, ord) - 1 AS order_in_cluster,
    row_number() OVER (PARTITION BY cluster_id ORDER BY mag DESC, t_us, ord) = 1 AS is_mainshock
  FROM thinned t JOIN tree USING (id))"""
SUMMARY = f"""{CLUSTERED}, main AS (SELECT * FROM clustered WHERE is_mainshock), summary AS (
  SELECT m.cluster_id, m.id AS mainshock_id, m.mag AS mainshock_mag, m.t_us AS mainshock_us, m.latitude AS mainshock_lat, m.longitude AS mainshock_lon, m.depth AS mainshock_depth,
    CAST(count(*) AS INT) AS n_events, CAST(count(*) - 1 - count(*) FILTER (c.t_us < m.t_us) AS INT) AS n_aftershocks, CAST(count(*) FILTER (c.t_us < m.t_us) AS INT) AS n_foreshocks,
    (max(c.t_us) - min(c.t_us)) / 86400e6 AS duration_days, max({hav("c", "m")}) AS extent_km, max(c.generation) AS max_generation, m.cluster_id = m.id AS root_is_mainshock
  FROM clustered c JOIN main m USING (cluster_id) GROUP BY m.cluster_id, m.id, m.mag, m.t_us, m.latitude, m.longitude, m.depth)"""
START_US, END_US, DAY_US = 1451606400000000, 1767225600000000, 86400000000
PRIOR = f"""{SUMMARY}, around AS (
  SELECT s.cluster_id, c.mag, (s.mainshock_us / 1e6 - c.t_us / 1e6) / 86400e0 AS age
  FROM (SELECT *, mainshock_lat AS latitude, mainshock_lon AS longitude FROM summary) s JOIN complete c ON c.t_us < s.mainshock_us AND c.id <> s.mainshock_id
    AND abs(c.latitude - s.latitude) < 1.0e0
  WHERE {hav("c", "s")} <= 100e0 * (1 + 1e-9)
), prior AS (
  SELECT s.cluster_id, CAST(count(age) FILTER (age <= 2) AS INT) AS n_prior_2d, CAST(count(age) FILTER (age <= 30) AS INT) AS n_prior_30d, CAST(count(age) FILTER (age <= 365) AS INT) AS n_prior_365d,
    max(mag) FILTER (age <= 365) AS prior_max_mag_365d, min(age) AS days_since_prior, s.mainshock_us - 365 * {DAY_US} < {START_US} AS prior_window_truncated
  FROM summary s LEFT JOIN around a USING (cluster_id) GROUP BY s.cluster_id, s.mainshock_us)"""


def border(lat: str, lon: str) -> str:
    edges = [f"6371e0 * abs(radians({lat} - {f(e)}))" for e in BBOX[:2]] + [f"6371e0 * asin(least(1e0, abs(sin(radians({lon} - {f(e)})) * cos(radians({lat})))))" for e in BBOX[2:]]
    return f"least({', '.join(edges)})"


FEATURES = f"""{PRIOR}, features AS (
  SELECT s.*, p.* EXCLUDE (cluster_id), {f(MC)} AS region_mc, {f(ETA0)} AS region_log10_eta0, n_aftershocks > 0 AS has_aftershock, {border("mainshock_lat", "mainshock_lon")} AS dist_to_border_km
  FROM summary s JOIN prior p USING (cluster_id))"""
DELAYS = f"""{SUMMARY}, delays AS (
  SELECT c.cluster_id, c.mag, (c.t_us - s.mainshock_us) / 3600e6 AS delay_h FROM clustered c JOIN summary s USING (cluster_id) WHERE c.id <> s.mainshock_id AND c.t_us >= s.mainshock_us)"""
HORIZONS = f"""{DELAYS}, h AS (SELECT CAST(unnest([1, 6, 24, 72, 168]) AS INT) AS horizon_hours), horizons AS (
  SELECT s.cluster_id, horizon_hours, CAST(count(d.mag) FILTER (delay_h <= horizon_hours) AS INT) AS n_aft_until_t, max(d.mag) FILTER (delay_h <= horizon_hours) AS max_aft_mag,
    horizon_hours - coalesce(max(delay_h) FILTER (delay_h <= horizon_hours), 0e0) AS hours_since_last,
    CAST(count(d.mag) FILTER (delay_h <= 720) - count(d.mag) FILTER (delay_h <= horizon_hours) AS INT) AS y_aft,
    count(d.mag) FILTER (delay_h <= 720) > count(d.mag) FILTER (delay_h <= horizon_hours) AS y_has_aft, CAST(count(d.mag) FILTER (delay_h <= 720) AS INT) AS n_aft_until_window,
    mainshock_us + 30 * {DAY_US} > {END_US} AS censored_target, mainshock_us + CAST(horizon_hours AS BIGINT) * 3600000000 > {END_US} AS censored_feature
  FROM summary s CROSS JOIN h LEFT JOIN delays d USING (cluster_id) GROUP BY s.cluster_id, horizon_hours, mainshock_us)"""
RAW = f"""{CAT}, raw AS (
  SELECT id, k, copy, CASE WHEN k % 97 = 3 AND copy = 0 THEN NULL ELSE (t_us // 1000000) * 1000000 END AS t_us,
    CASE WHEN k % 11 = 0 AND copy = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2026-01-01 00:00:00') + copy * {DAY_US} END AS updated_us,
    CASE WHEN k % 89 = 5 THEN NULL ELSE latitude END AS latitude, longitude, CASE WHEN k % 7 = 0 THEN NULL ELSE depth END AS depth,
    CASE WHEN k % 83 = 7 AND copy = 1 THEN NULL ELSE mag + copy END AS mag, 'net' || CAST(k % 3 AS VARCHAR) AS net
  FROM cat CROSS JOIN (SELECT unnest([0, 1]) AS copy)
), clean AS (
  SELECT * FROM raw WHERE t_us IS NOT NULL AND latitude IS NOT NULL AND mag IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_us DESC NULLS FIRST) = 1)"""
def permuted(place: str, n: str, seed: str, salt: int) -> str:
    """The place that the keyed permutation of 1 to n gives: six rounds on a rectangle, again while it is outside."""
    a, key = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)", f"((CAST({seed} AS BIGINT) * 104729 + {salt * 15485863}) % 2147483648)"
    b = f"CAST(ceil({n} / {a}) AS BIGINT)"
    step = lambda x: f"list_reduce([({x}) % 2147483648, 0, 0], lambda u, unused: ((u * u) // 32768 + u * 1103515245 + 12345) % 2147483648)"
    turn = f"CASE WHEN i % 2 = 0 THEN ((x // {b} + {step(f'(x % {b}) * 7919 + {key} + i * 1000003')}) % {a}) * {b} + x % {b} ELSE (x // {b}) * {b} + (x % {b} + {step(f'(x // {b}) * 7919 + {key} + i * 1000003')}) % {b} END"
    once = lambda x: f"list_reduce(list_prepend({x}, CAST(range(0, 6) AS BIGINT[])), lambda x, i: {turn})"
    return f"list_reduce(list_prepend({once(f'CAST({place} AS BIGINT) - 1')}, CAST(range(0, 64) AS BIGINT[])), lambda y, unused: CASE WHEN y < {n} THEN y ELSE {once('y')} END) + 1"


_SEEDS = f"{SEED} + repetition * 1000003"
SHUFFLED = f"""{COMPLETE}, each AS (SELECT c.*, rep AS repetition, count(*) OVER (PARTITION BY rep) AS n FROM complete c CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS rep)),
places AS (SELECT *, {permuted("ord", "n", _SEEDS, 1)} AS a, {permuted("ord", "n", _SEEDS, 2)} AS b FROM each),
shuffled AS (SELECT e.repetition, e.id, t.t_us, m.mag, e.latitude, e.longitude, e.ord AS place FROM places e JOIN complete t ON e.a = t.ord JOIN complete m ON e.b = m.ord)"""
NULLS = f"""{SHUFFLED}, placed AS (SELECT *, row_number() OVER (PARTITION BY repetition ORDER BY t_us, id) AS ord FROM shuffled), {pairs(CAPPED, "placed", "repetition", "nulled")}"""


def select_pairs(name: str = "paired") -> str:
    return f"SELECT id, parent_id, parent_mag, round(log10_eta, 6) AS log10_eta, round(t_years, 6) AS t_years, round(r_km, 6) AS r_km FROM {name}"


def correlations(features: tuple, by: str = "", source: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {key}feature"
    rows = " UNION ALL ".join(f"SELECT {key}'{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST(n_aftershocks AS DOUBLE) AS y FROM kept" for c in features)
    return f"""kept AS ({source}), long AS ({rows}), ranked AS (
  SELECT *, rank() OVER ({part} ORDER BY x) + (count(*) OVER ({part}, x) - 1) / 2e0 AS rx, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({part}, y) - 1) / 2e0 AS ry FROM long WHERE x IS NOT NULL)
SELECT {key}feature, count(*) AS n, round(corr(x, y), 3) AS pearson, round(corr(rx, ry), 3) AS spearman, round((avg(x) FILTER (y > 0) - avg(x) FILTER (y <= 0)) / stddev_samp(x), 3) AS gap_std
FROM ranked GROUP BY {key}feature HAVING count(*) >= 3 AND stddev_samp(x) > 0"""


_BINS = f"""{SUMMARY}, ends AS (SELECT floor(min(mainshock_mag) / 0.5e0) * 0.5e0 AS lo, ceil(max(mainshock_mag) / 0.5e0) * 0.5e0 AS hi FROM summary), bins AS (
  SELECT lo + least(greatest(1, round((hi - lo) / 0.5e0)) - 1, floor((mainshock_mag - lo) / 0.5e0)) * 0.5e0 + 0.25e0 AS center, avg(n_aftershocks) AS mean_aftershocks, count(*) AS n_mainshocks
  FROM summary CROSS JOIN ends GROUP BY 1 HAVING count(*) >= 5 AND avg(n_aftershocks) > 0)"""
_PROFILED = ("cluster_id", "mainshock_id", "mainshock_mag", "n_aftershocks", "prior_max_mag_365d", "days_since_prior")
_EM = f"""{PAIRED}, parts AS (SELECT log10_eta AS x, {PA} AS a, {PB} AS b FROM paired WHERE log10_eta IS NOT NULL), shares AS (SELECT x, greatest(a + b, 1e-300) AS total, a / greatest(a + b, 1e-300) AS s0, b / greatest(a + b, 1e-300) AS s1 FROM parts),
means AS (SELECT sum(s0 * x) / sum(s0) AS mu0, sum(s1 * x) / sum(s1) AS mu1 FROM shares)"""

#: All regions at once: each with its own Mc, mixture and threshold.
_INSIDE = " ".join(f"WHEN latitude BETWEEN {f(r['minlatitude'])} AND {f(r['maxlatitude'])} AND longitude BETWEEN {f(r['minlongitude'])} AND {f(r['maxlongitude'])} AND mag >= {f(r['minmagnitude'])} THEN '{r['name']}'" for r in THREE)
_EDGES = ", ".join(f"('{r['name']}', {f(r['minlatitude'])}, {f(r['maxlatitude'])}, {f(r['minlongitude'])}, {f(r['maxlongitude'])})" for r in THREE)



def regional(clean: str) -> str:
    """All stages by region from a text that ends with the view clean."""
    return f"""{clean}, boxed AS (SELECT *, CASE {_INSIDE} END AS region FROM clean WHERE t_us BETWEEN {START_US} AND {END_US}),
binned AS (SELECT region, CAST(round_even(mag / 0.1e0, 0) AS BIGINT) AS bin, count(*) AS n FROM boxed WHERE region IS NOT NULL GROUP BY 1, 2),
known AS (SELECT region, round(bin * 0.1e0, 4) + 0.2e0 AS mc FROM binned QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, bin) = 1),
complete AS (SELECT boxed.*, row_number() OVER (PARTITION BY region ORDER BY t_us, id) AS ord FROM boxed JOIN known USING (region) WHERE round_even(mag / 0.1e0, 0) * 0.1e0 >= mc - 0.025e0),
{pairs(FREE, by="region")}, vals AS (SELECT region, log10_eta AS x FROM paired WHERE log10_eta IS NOT NULL),
lists AS (SELECT region, list(x ORDER BY x) AS v, count(*) AS n FROM vals GROUP BY region),
em AS (
  SELECT region, 0 AS step, 0.5e0 AS w0, 0.5e0 AS w1, quantile_cont(x, 0.25) AS mu0, quantile_cont(x, 0.75) AS mu1,
    greatest(stddev_pop(x) / 2, 1e-3) AS s0, greatest(stddev_pop(x) / 2, 1e-3) AS s1, CAST('-infinity' AS DOUBLE) AS ll, false AS done FROM vals GROUP BY region
  UNION ALL
  SELECT region, step + 1, m0 / n, m1 / n, mu0, mu1,
    greatest(sqrt(list_sum({_over("q0[i] * pow(v[i] - mu0, 2e0)")}) / m0), {f(mixture.SIGMA_FLOOR)}), greatest(sqrt(list_sum({_over("q1[i] * pow(v[i] - mu1, 2e0)")}) / m1), {f(mixture.SIGMA_FLOOR)}),
    ll, abs(ll - last) < {f(mixture.TOLERANCE)}
  FROM (SELECT *, list_sum({_over("q0[i] * v[i]")}) / m0 AS mu0, list_sum({_over("q1[i] * v[i]")}) / m1 AS mu1 FROM (
    SELECT *, list_sum(q0) AS m0, list_sum(q1) AS m1 FROM (
      SELECT region, step, last, v, n, {_over("d0[i] / t[i]")} AS q0, {_over("d1[i] / t[i]")} AS q1, list_sum({_over("ln(t[i])")}) AS ll FROM (
        SELECT *, {_over(f"greatest(d0[i] + d1[i], {f(mixture.DENSITY_FLOOR)})")} AS t FROM (
          SELECT region, step, ll AS last, v, n, {_over("w0 * " + _bell("v[i]", "mu0", "s0"))} AS d0, {_over("w1 * " + _bell("v[i]", "mu1", "s1"))} AS d1 FROM em JOIN lists USING (region) WHERE NOT done AND step < {mixture.MOST_STEPS})))))
), mix AS (
  SELECT region, CASE WHEN mu0 <= mu1 THEN w0 ELSE w1 END AS wa, CASE WHEN mu0 <= mu1 THEN w1 ELSE w0 END AS wb, least(mu0, mu1) AS ma, greatest(mu0, mu1) AS mb,
    CASE WHEN mu0 <= mu1 THEN s0 ELSE s1 END AS sa, CASE WHEN mu0 <= mu1 THEN s1 ELSE s0 END AS sb FROM em QUALIFY row_number() OVER (PARTITION BY region ORDER BY step DESC) = 1
), points AS (
  SELECT region, i, x, wa * {_bell("x", "ma", "sa")} - wb * {_bell("x", "mb", "sb")} AS y FROM (SELECT *, ma + (mb - ma) * i / 20000e0 AS x FROM mix, range(0, 20001) AS r(i))
), turns AS (
  SELECT region, x + (nx - x) * y / (y - ny) AS crossed FROM (SELECT *, lead(x) OVER (PARTITION BY region ORDER BY i) AS nx, lead(y) OVER (PARTITION BY region ORDER BY i) AS ny FROM points) WHERE sign(y) <> sign(ny) QUALIFY row_number() OVER (PARTITION BY region ORDER BY i) = 1
), cuts AS (SELECT mix.*, coalesce(crossed, (ma + mb) / 2) AS cut FROM mix LEFT JOIN turns USING (region)),
{lcg("drawn", "paired", str(SEED + 1), 3)}, thinned AS (
  SELECT drawn.*, log10_eta IS NOT NULL AND u / 2147483648e0 >= wb * {_bell("log10_eta", "mb", "sb")} / greatest(wa * {_bell("log10_eta", "ma", "sa")} + wb * {_bell("log10_eta", "mb", "sb")}, 1e-300) AS is_aftershock FROM drawn JOIN cuts USING (region)
), tree AS (
  SELECT region, id, id AS cluster_id, 0 AS generation FROM thinned WHERE NOT is_aftershock
  UNION ALL SELECT t.region, t.id, r.cluster_id, r.generation + 1 FROM thinned t JOIN tree r ON t.is_aftershock AND t.parent_id = r.id AND t.region = r.region
), clustered AS (
  SELECT t.*, cluster_id, generation, row_number() OVER (PARTITION BY t.region, cluster_id ORDER BY mag DESC, t_us, ord) = 1 AS is_mainshock FROM thinned t JOIN tree USING (region, id)
), main AS (SELECT * FROM clustered WHERE is_mainshock), summary AS (
  SELECT m.region, m.cluster_id, m.id AS mainshock_id, m.t_us AS mainshock_us, m.latitude, m.longitude, count(*) AS n_events, count(*) FILTER (c.t_us < m.t_us) AS n_foreshocks, max({hav("c", "m")}) AS extent_km
  FROM clustered c JOIN main m USING (region, cluster_id) GROUP BY ALL
), prior AS (
  SELECT s.region, s.cluster_id, count(c.id) FILTER (s.mainshock_us - c.t_us <= 365 * {DAY_US}) AS n_prior, min((s.mainshock_us / 1e6 - c.t_us / 1e6) / 86400e0) AS days
  FROM summary s LEFT JOIN complete c ON c.region = s.region AND c.t_us < s.mainshock_us AND c.id <> s.mainshock_id AND abs(c.latitude - s.latitude) < 1.0e0 AND {hav("c", "s")} <= 100e0 * (1 + 1e-9) GROUP BY 1, 2
), edges AS (SELECT * FROM (VALUES {_EDGES}) AS v(region, s, n, w, e))"""


REGIONAL = regional(RAW)

_BODY = {
    "regions_declustered": (
        REGIONAL,
        """SELECT s.region, s.cluster_id, mainshock_id, CAST(n_events AS INT) AS n_events, CAST(n_events - 1 - n_foreshocks AS INT) AS n_aftershocks, CAST(n_foreshocks AS INT) AS n_foreshocks, round(extent_km, 6) AS extent_km,
          CAST(n_prior AS INT) AS n_prior_365d, round(days, 9) AS days_since_prior, round(mc, 6) AS region_mc, round(cut, 4) AS region_log10_eta0,
          round(least(6371e0 * abs(radians(latitude - edges.s)), 6371e0 * abs(radians(latitude - edges.n)), 6371e0 * asin(least(1e0, abs(sin(radians(longitude - w)) * cos(radians(latitude))))), 6371e0 * asin(least(1e0, abs(sin(radians(longitude - e)) * cos(radians(latitude)))))), 6) AS dist_to_border_km
        FROM summary s JOIN prior USING (region, cluster_id) JOIN known USING (region) JOIN cuts USING (region) JOIN edges USING (region)""",
    ),
    "silver_refine": (RAW, "SELECT id, t_us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, depth, mag, net FROM clean"),
    "silver_dedup_latest": (RAW, "SELECT id, mag, coalesce(updated_us, -1) AS updated_us FROM clean"),
    "silver_order": (CAT, "SELECT id, row_number() OVER (ORDER BY t_us, id) AS ord FROM cat"),
    "fmd": (CAT + ", b AS (SELECT CAST(round_even(mag / 0.1e0, 0) AS BIGINT) AS bin, count(*) AS n FROM cat GROUP BY 1), d AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b))) AS bin), j AS (SELECT bin, coalesce(n, 0) AS n FROM d LEFT JOIN b USING (bin))", "SELECT bin, round(bin * 0.1e0, 4) AS center, n, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS n_cumulative FROM j"),
    "mc_maxc": (CAT + ", b AS (SELECT region, CAST(round_even(mag / 0.1e0, 0) AS BIGINT) AS bin, count(*) AS n FROM cat GROUP BY 1, 2)", "SELECT region, round(round(bin * 0.1e0, 4) + 0.2e0, 6) AS mc FROM b QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, bin) = 1"),
    "trim_to_mc": (COMPLETE, "SELECT id, mag FROM complete"),
    "estimate": (CAT + ", b AS (SELECT region, CAST(round_even(mag / 0.1e0, 0) AS BIGINT) AS bin, count(*) AS n FROM cat GROUP BY 1, 2), m AS (SELECT region, round(bin * 0.1e0, 4) + 0.2e0 AS mc FROM b QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, bin) = 1)", "SELECT region, round(mc, 6) AS mc, 1e0 AS b, 1.5e0 AS d, count(*) AS n_events_catalog, count(*) FILTER (round_even(mag / 0.1e0, 0) * 0.1e0 >= mc - 0.025e0) AS n_events_complete FROM cat JOIN m USING (region) GROUP BY region, mc"),
    "haversine": (CAT + f", o AS (SELECT {f(-33.45)} AS latitude, {f(-70.66)} AS longitude)", f"SELECT id, round({hav('cat', 'o')}, 6) AS km FROM cat CROSS JOIN o"),
    "border_distance": (CAT, f"SELECT id, round({border('latitude', 'longitude')}, 6) AS km FROM cat"),
    "gk_radius": (CAT, "SELECT DISTINCT mag, round(pow(10e0, 0.1238e0 * mag + 0.983e0), 6) AS km FROM cat"),
    "region_overlap": (
        SUMMARY + ", boxes AS (SELECT c.cluster_id, min(c.latitude) AS s, max(c.latitude) AS n, min(c.longitude) AS w, max(c.longitude) AS e FROM clustered c JOIN summary m USING (cluster_id) WHERE m.n_aftershocks > 0 OR order_in_cluster > 0 GROUP BY 1)",
        "SELECT a.cluster_id AS a, b.cluster_id AS b FROM boxes a JOIN boxes b ON a.cluster_id < b.cluster_id AND a.s < b.n AND b.s < a.n AND a.w < b.e AND b.w < a.e",
    ),
    "nn_uncapped": (PAIRED, select_pairs()),
    "nn_radius_fixed": (f"{COMPLETE}, {pairs(CAPPED)}", select_pairs()),
    "nn_radius_gk": (f"{COMPLETE}, {pairs(RadiusPolicy('gk', None, 3.0))}", select_pairs()),
    "nn_by_region": (f"{COMPLETE}, own AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY region ORDER BY t_us, id) AS ord FROM complete), {pairs(FREE, 'own', 'region')}", select_pairs()),
    "rescaled_tr": (PAIRED, "SELECT id, round(log10(t_years * pow(pow(10e0, -1e0 * parent_mag), 0.5e0)), 6) AS log10_t, round(log10(pow(r_km, 1.5e0) * pow(pow(10e0, -1e0 * parent_mag), 0.5e0)), 6) AS log10_r FROM paired"),
    "eta_quantiles": (PAIRED, "SELECT round(quantile_cont(log10_eta, 0.25), 6) AS p25, round(quantile_cont(log10_eta, 0.5), 6) AS p50, round(quantile_cont(log10_eta, 0.75), 6) AS p75 FROM paired"),
    "eta_histogram": (PAIRED + ", e AS (SELECT min(log10_eta) AS lo, max(log10_eta) AS hi FROM paired), c AS (SELECT CAST(least(60, floor((log10_eta - lo) / (hi - lo) * 60) + 1) AS INT) AS bin, count(*) AS n FROM paired CROSS JOIN e WHERE log10_eta IS NOT NULL GROUP BY 1)", "SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(1, 60)) AS b) LEFT JOIN c ON b = bin"),
    "fit_threshold": (
        FITTED,
        """SELECT round(cut.c, 4) AS log10_eta0, (SELECT n FROM lists) AS n_events, (SELECT count(*) FROM vals WHERE x < cut.c) AS n_below_threshold,
          round(wa * (0.5e0 - above) + wb * (0.5e0 + below), 6) AS expected_classification_error, round(wa, 4) AS weight_aftershocks, round(wb, 4) AS weight_background,
          round(ma, 4) AS mu_aftershocks, round(mb, 4) AS mu_background, round(sa, 4) AS sigma_aftershocks, round(sb, 4) AS sigma_background,
          round((mb - ma) / sqrt((sa * sa + sb * sb) / 2), 3) AS separation_sigmas
        FROM cut, tails""",
    ),
    "em_step": (_EM, "SELECT count(*) AS n, round(sum(ln(total)), 6) AS log_likelihood, round(sum(s0), 6) AS mass0, round(sum(s1), 6) AS mass1, round(any_value(mu0), 6) AS mu0, round(any_value(mu1), 6) AS mu1, round(sqrt(sum(s0 * pow(x - mu0, 2e0)) / sum(s0)), 6) AS sigma0, round(sqrt(sum(s1 * pow(x - mu1, 2e0)) / sum(s1)), 6) AS sigma1 FROM shares CROSS JOIN means"),
    "posterior_background": (PAIRED, f"SELECT id, round({POSTERIOR}, 6) AS p_background FROM paired WHERE log10_eta IS NOT NULL"),
    "hard_threshold": (THINNED, "SELECT id, is_aftershock_eta FROM thinned"),
    "shuffle_marginals": (SHUFFLED, "SELECT repetition, id, t_us, mag, round(latitude, 6) AS latitude FROM shuffled"),
    "null_distribution": (NULLS, "SELECT repetition, CAST(floor(log10_eta * 10) AS INT) AS tenth, count(*) AS n, round(sum(log10_eta), 6) AS total FROM nulled WHERE log10_eta IS NOT NULL GROUP BY 1, 2"),
    "null_contrast": (f"{NULLS}, {pairs(CAPPED, name='capped')}, o AS (SELECT avg(CAST(log10_eta < {f(ETA0)} AS DOUBLE)) AS a, quantile_cont(log10_eta, 0.5) AS m FROM capped WHERE log10_eta IS NOT NULL), n AS (SELECT avg(CAST(log10_eta < {f(ETA0)} AS DOUBLE)) AS a, quantile_cont(log10_eta, 0.5) AS m FROM nulled WHERE log10_eta IS NOT NULL)", "SELECT round(o.a, 6) AS fraction_below_threshold_observed, round(o.m, 6) AS median_observed, round(n.a, 6) AS fraction_below_threshold_null, round(n.m, 6) AS median_null, round(o.a - n.a, 6) AS excess_over_chance, CASE WHEN n.a > 0 THEN round(o.a / n.a, 6) END AS ratio_over_chance FROM o CROSS JOIN n"),
    "thinning": (THINNED, "SELECT id, round(p_background, 6) AS p_background, is_aftershock, is_aftershock_eta FROM thinned"),
    "thinning_diagnostics": (THINNED, f"SELECT CAST({SEED + 1} AS INT) AS seed, count(*) AS n_events, count(*) FILTER (is_aftershock) AS n_aftershocks, count(*) FILTER (is_aftershock_eta) AS n_aftershocks_by_threshold, count(*) FILTER (is_aftershock_eta AND NOT is_aftershock) AS n_returned_to_background, count(*) FILTER (is_aftershock AND NOT is_aftershock_eta) AS n_added_to_aftershocks, round(avg(CAST(is_aftershock AS DOUBLE)), 6) AS fraction_aftershocks FROM thinned"),
    "cluster_assignment": (CLUSTERED, "SELECT id, cluster_id, generation FROM clustered"),
    "order_in_cluster": (CLUSTERED, "SELECT id, cluster_id, CAST(order_in_cluster AS INT) AS order_in_cluster FROM clustered"),
    "mainshock_largest": (CLUSTERED, "SELECT cluster_id, id, mag FROM clustered WHERE is_mainshock"),
    "mainshock_root": (CLUSTERED, "SELECT cluster_id, id, mag FROM clustered WHERE generation = 0"),
    "cluster_summary": (SUMMARY, "SELECT cluster_id, mainshock_id, mainshock_mag, mainshock_us, round(mainshock_lat, 6) AS mainshock_lat, round(mainshock_lon, 6) AS mainshock_lon, mainshock_depth, n_events, n_aftershocks, n_foreshocks, round(duration_days, 9) AS duration_days, round(extent_km, 6) AS extent_km, max_generation, root_is_mainshock FROM summary"),
    "events_enriched": (SUMMARY, "SELECT c.id, c.cluster_id, is_mainshock, s.n_aftershocks AS n_aftershocks_sequence, CASE WHEN is_mainshock THEN s.n_aftershocks ELSE 0 END AS n_aftershocks FROM clustered c JOIN summary s USING (cluster_id)"),
    "implausible_clusters": (SUMMARY, "SELECT cluster_id, round(extent_km, 6) AS extent_km, max_generation FROM summary WHERE extent_km > 100e0"),
    "productivity_bins": (_BINS, "SELECT round(center, 6) AS center, round(mean_aftershocks, 6) AS mean_aftershocks, n_mainshocks FROM bins"),
    "productivity_fit": (_BINS, "SELECT round(regr_slope(log10(mean_aftershocks), center), 6) AS alpha, round(regr_intercept(log10(mean_aftershocks), center), 6) AS intercept, round(CASE WHEN var_pop(log10(mean_aftershocks)) > 0 THEN regr_r2(log10(mean_aftershocks), center) ELSE 0e0 END, 6) AS r2, count(*) AS n_bins, regr_slope(log10(mean_aftershocks), center) BETWEEN 0.5 AND 1.5 AS plausible FROM bins HAVING count(*) >= 3"),
    "prior_seismicity": (PRIOR, "SELECT cluster_id, n_prior_2d, n_prior_30d, n_prior_365d, prior_max_mag_365d, round(days_since_prior, 9) AS days_since_prior, prior_window_truncated FROM prior"),
    "features": (FEATURES, "SELECT cluster_id, n_aftershocks, n_prior_30d, region_mc, region_log10_eta0, has_aftershock, round(dist_to_border_km, 6) AS dist_to_border_km, dist_to_border_km < 100e0 AS near_border, prior_window_truncated FROM features"),
    "near_border": (FEATURES, "SELECT dist_to_border_km < 100e0 AS near_border, count(*) AS n, round(min(dist_to_border_km), 6) AS least_km FROM features GROUP BY 1"),
    "aftershock_delays": (DELAYS, "SELECT cluster_id, mag, round(delay_h, 6) AS delay_h FROM delays"),
    "horizons": (HORIZONS, "SELECT * REPLACE (round(hours_since_last, 6) AS hours_since_last) FROM horizons"),
    "positives_by_horizon": (HORIZONS, "SELECT horizon_hours, count(*) FILTER (y_has_aft) AS positives, count(*) AS n FROM horizons GROUP BY 1"),
    "horizon_monotonic": (HORIZONS + ", seen AS (SELECT h.*, n_aft_until_t < lag(n_aft_until_t) OVER (PARTITION BY cluster_id ORDER BY horizon_hours) AS back, n_aftershocks, duration_days FROM horizons h JOIN summary USING (cluster_id))", "SELECT count(*) FILTER (back) AS not_monotonic, count(*) FILTER (n_aft_until_t + y_aft <> n_aft_until_window) AS sums_differ, count(*) FILTER (y_aft < 0) AS negative_targets, count(*) FILTER (hours_since_last < 0 OR hours_since_last > horizon_hours) AS hours_outside, count(*) FILTER (duration_days <= 30 AND NOT censored_target AND n_aft_until_window <> n_aftershocks) AS totals_differ, count(*) FILTER (hours_since_last IS NULL OR y_aft IS NULL) AS unexpected_nulls, count(*) FILTER ((max_aft_mag IS NULL) <> (n_aft_until_t = 0)) AS null_magnitudes_differ FROM seen"),
    "uncensored": (SUMMARY, f"SELECT cluster_id, n_aftershocks FROM summary WHERE mainshock_us + 30 * {DAY_US} <= epoch_us(TIMESTAMP '2025-06-01 00:00:00')"),
    "quality_profile": (FEATURES, " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 4) AS null_share, count(*) AS n_rows, CAST({len(_PROFILED)} AS INT) AS n_columns, CAST(count(*) - count(DISTINCT cluster_id) AS BIGINT) AS repeated_keys FROM features' for c in _PROFILED)),
    "table_shape": (SUMMARY, "SELECT count(*) AS n_rows, round(avg(CAST(n_aftershocks > 0 AS DOUBLE)), 6) AS positive_share, round(avg(n_aftershocks), 6) AS mean, round(skewness(n_aftershocks), 6) AS skew FROM summary"),
    "repeated_keys": (SUMMARY + ", twice AS (SELECT cluster_id, mainshock_id FROM summary UNION ALL SELECT cluster_id, mainshock_id FROM summary WHERE cluster_id LIKE '%5'), long AS (SELECT 'cluster_id' AS key, cluster_id AS value FROM twice UNION ALL SELECT 'mainshock_id', mainshock_id FROM twice)", "SELECT key, value, count(*) AS n FROM long GROUP BY 1, 2 HAVING count(*) > 1"),
    "combine_regions": (SUMMARY, "SELECT cluster_id, mainshock_id, n_aftershocks, CASE CAST(substr(cluster_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'middle' ELSE 'south' END AS region FROM summary"),
    "feature_correlations": (FEATURES, ", " + correlations(("mainshock_mag", "mainshock_depth", "n_prior_365d", "dist_to_border_km"), source=f"SELECT * FROM features WHERE mainshock_us + 30 * {DAY_US} <= {END_US}")),
    "correlations_by_region": (FEATURES, ", " + correlations(("mainshock_mag", "mainshock_depth", "dist_to_border_km"), "region", "SELECT *, CAST(substr(cluster_id, 2) AS BIGINT) % 3 AS region FROM features")),
    "blocks_mc": (CAT + ", own AS (SELECT *, CAST(2013 + floor((year(make_timestamp(t_us)) - 2013) / 5) * 5 AS INT) AS start_year, CAST(round_even(mag / 0.1e0, 0) AS BIGINT) AS bin FROM cat WHERE year(make_timestamp(t_us)) >= 2013), b AS (SELECT start_year, bin, count(*) AS n FROM own WHERE bin BETWEEN 35 AND 60 GROUP BY 1, 2), m AS (SELECT start_year, round(bin * 0.1e0 + 0.2e0, 2) AS mc FROM b QUALIFY row_number() OVER (PARTITION BY start_year ORDER BY n DESC, bin) = 1), c AS (SELECT start_year, count(*) FILTER (mag >= 4.45e0) AS n_ge_45, count(*) FILTER (mag >= 6e0) AS n_ge_6 FROM own GROUP BY 1)", "SELECT start_year, mc, n_ge_45, n_ge_6 FROM c LEFT JOIN m USING (start_year)"),
    "density_strips": (CAT, "SELECT CAST(floor(latitude) AS INT) AS edge, count(*) AS n FROM cat WHERE mag >= 4.45e0 GROUP BY 1"),
    "mega_events": (CAT, "SELECT id, t_us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, mag FROM cat WHERE mag >= 6.5e0"),
}

ORACLES = {name: f"WITH RECURSIVE {ctes}\n{body}" for name, (ctes, body) in _BODY.items()}
