"""Nearest neighbours in time, space and magnitude: who triggered whom.

For an event j, the parent is the earlier event i (strictly earlier) with the least
``eta = dt * max(r, r_min)**d * 10**(-b * mag_i)``, dt in years and r in km; of equal
ones the first in the catalog.  With a radius policy only events within the parent's
radius (inclusive, before the floor) are candidates.

Physical forms of the same search:

* ``grid``: with a radius, an equi-join on cells of the sphere, then exact filters;
  parents go by classes of radius, so one huge radius doesn't widen everyone's cells;
  the children of crowded cells are dealt over several salts.
* ``blocks``: for catalogs whose columns are proven to fit a broadcast
  (``BROADCAST_EVENTS``): tiles of children and earlier events.  A lower bound of eta
  from products of unit vectors leaves few pairs to be computed exactly; a worker's
  memory doesn't depend on the catalog beyond the columns broadcast.
* ``tree``: for the same catalogs: a static tree of the broadcast events, searched by branch and
  bound, so a child computes some hundred distances and not one for each earlier event.
* ``curve``: with a radius: ranges of a space-filling curve, each with a halo of
  the parents that reach into it and a tree over them.
* ``slabs``: for larger catalogs, with a radius or without: parts of space, slabs of time, and those parts of
  space that can still hold a better parent, each with a tree.
* ``bounded``: without a radius, by equi-joins only: the grid search at a seed radius and
  the previous event give an upper bound of eta; a better parent outside that radius
  must then be so close in time that a join on time buckets finds it.

Of the forms that apply, the one with the least estimated work for its pairs is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import geo, stats
from . import curve, slabs, tree
from .silver import with_order

#: Events whose columns are broadcast: at most 80 MB, and 80 MB for a tree over them, whose leaves hold their columns again.
BROADCAST_EVENTS = 1_000_000
#: Radii beyond this (km) make cells too large to be of use.
GRID_KM = 3000.0
#: Events up to which the tree is taken without an estimate; nanoseconds of a core for a pair of the grid, and for a child by each halving of the tree's events, as measured.
FEW_EVENTS, GRID_NS, TREE_NS = 20_000, 1000.0, 10_000.0
#: Children of a cell that go together; those of more crowded cells are dealt over several salts.
CROWDED = 4096
SEED_KM = 300.0
#: Children and parents of a tile.
ROWS, TILE = 128, 4096

PAIR = "struct<eta:double,p_ord:bigint,t_years:double,r_km:double>"


def prepare(catalog: DataFrame, by: tuple = (), b: float = model.B_VALUE, policy: model.RadiusPolicy = model.RadiusPolicy()) -> DataFrame:
    """Adds ord, radians, years, the weight as a parent and the radius (null: none)."""
    out = with_order(catalog, by) if "ord" not in catalog.columns else catalog
    radius: Column = F.lit(None).cast("double")
    if policy.mode == "gk":
        radius = F.lit(float(policy.k)) * geo.gardner_knopoff_km(F.col("mag"))
        if policy.max_km is not None:
            radius = F.least(radius, F.lit(float(policy.max_km)))
    elif policy.max_km is not None:
        radius = F.lit(float(policy.max_km))
    return out.withColumns({"_lat": F.radians("latitude"), "_lon": F.radians("longitude"), "_t": F.unix_micros("time") / F.lit(1e6) / F.lit(model.SECONDS_PER_YEAR), "_us": F.unix_micros("time"), "_w": F.pow(F.lit(10.0), F.lit(-float(b)) * F.col("mag")), "_r": radius})


def _side(df: DataFrame, prefix: str, by: tuple, *more: str) -> DataFrame:
    """Columns behind a prefix, and the place as a unit vector."""
    lat, lon = F.col("_lat"), F.col("_lon")
    unit = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in (*by, "ord", "_lat", "_lon", "_us", "_w", "_r", *more)), *(v.alias(prefix + k) for k, v in unit.items()))


def _years(later: str, earlier: str) -> Column:
    return (F.col(later) - F.col(earlier)) / F.lit(1e6) / F.lit(model.SECONDS_PER_YEAR)


def power(r: Column, d: float) -> Column:
    """r**d; for the usual exponent by a root, which all engines round alike."""
    return r * F.sqrt(r) if d == 1.5 else F.pow(r, F.lit(float(d)))


def parts_for_pairs(df: DataFrame) -> int:
    """The work is in the pairs, not in the bytes: a number of parts that isn't reduced by size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def deal_crowded(children: DataFrame, parents: DataFrame, keys: tuple, number: str, left: str = "c_", right: str = "p_", most: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt, ``_salt`` behind their prefix: children of crowded keys are dealt by number, their parents go to every salt."""
    from ..storage import written

    sizes = children.groupBy(*(F.col(left + k).alias(f"_size {k}") for k in keys)).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    sizes = written(sizes.withColumn("_salts", F.ceil(F.col("_n") / most).cast("int")).drop("_n"), "crowded")  # a row for each ``most`` children at most
    if sizes.isEmpty():
        return children.withColumn(left + "_salt", F.lit(0)), parents.withColumn(right + "_salt", F.lit(0))

    def sized(side: DataFrame, prefix: str) -> DataFrame:
        return side.join(sizes, [F.col(prefix + k).eqNullSafe(F.col(f"_size {k}")) for k in keys], "left").drop(*(f"_size {k}" for k in keys))

    salts = F.coalesce("_salts", F.lit(1))
    dealt = sized(children, left).withColumn(left + "_salt", F.pmod(F.xxhash64(number), salts).cast("int")).drop("_salts")
    return dealt, sized(parents, right).withColumn(right + "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")


def _best(children: DataFrame, parents: DataFrame, on: list[Column], by: tuple, d: float, r_min: float, radius: bool) -> DataFrame:
    """(by, ord, best) from the sides c_ and p_.

    A minimum of structs would sort all pairs; so the pairs are met twice: once for the
    least eta of each child (a number, which hash aggregation keeps in place), once to
    pick the parents that reach it, of which the first is taken.  Both times the
    distance comes from the chord of unit vectors, to some nine digits; what decides,
    which are few pairs, is computed exactly.
    """
    keys = [f"c_{c}" for c in (*by, "ord")]
    exact = geo.haversine_km(F.col("p__lat"), F.col("p__lon"), F.col("c__lat"), F.col("c__lon"))
    dt = _years("c__us", "p__us")

    def eta(distance: Column) -> Column:
        return dt * power(F.greatest(distance, F.lit(float(r_min))), d) * F.col("p__w")

    def near(side: DataFrame) -> DataFrame:
        chord = F.sqrt(sum(((F.col(f"p_{x}") - F.col(f"c_{x}")) * (F.col(f"p_{x}") - F.col(f"c_{x}")) for x in ("_x", "_y", "_z")), F.lit(0.0)))
        found = side.join(parents, [*on, F.col("p__us") < F.col("c__us")])
        found = found.withColumn("_far", F.lit(2 * model.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), chord / 2)))
        if radius:
            r = F.col("p__r")
            found = found.where(F.when(F.col("_far") <= r * (1 - 1e-8), F.lit(True)).when(F.col("_far") > r * (1 + 1e-8) + 1e-6, F.lit(False)).otherwise(exact <= r))
        return found.withColumn("_about", eta(F.col("_far")))

    least = near(children).groupBy(*keys).agg(F.min("_about").alias("_least")).select(*(F.col(k).alias(f"l_{k}") for k in keys), "_least")
    again = children.join(least, [children[k].eqNullSafe(least[f"l_{k}"]) for k in keys])
    reached = near(again).where(F.col("_about") <= F.col("_least") * (1 + 1e-6)).select("*", exact.alias("_distance"), eta(exact).alias("_eta"), dt.alias("_dt")).withColumn("_r", F.greatest(F.col("_distance"), F.lit(float(r_min))))
    best = F.struct(F.col("_eta").alias("eta"), F.col("p_ord").alias("p_ord"), F.col("_dt").alias("t_years"), F.col("_r").alias("r_km"))
    return reached.groupBy(*(F.col(k).alias(c) for k, c in zip(keys, (*by, "ord"), strict=True))).agg(F.min(best).alias("best"))


def search_grid(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM) -> DataFrame:
    """(by, ord, best) within the parents' radii ``_r``."""
    radius_class = F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(1.0)))).cast("int")
    classes = sorted(r[0] for r in events.select(radius_class.alias("k")).distinct().collect())  # a dozen at most, as radii are
    largest = events.agg(F.max("_r")).first()[0]
    parts = parts_for_pairs(events)
    pairs = None
    for k in classes:
        within = min(float(2**k), largest)
        grid = geo.Grid(within)
        around = events.where(radius_class == k).withColumn("_at", F.explode(grid.around(F.col("latitude"), F.col("longitude"))))
        home = events.withColumn("_at", grid.cell(F.col("latitude"), F.col("longitude")))
        parents, children = (_side(x.withColumns({"_band": F.col("_at.band"), "_cell": F.col("_at.cell")}), side, by, "_band", "_cell") for x, side in ((around, "p_"), (home, "c_")))
        children, parents = deal_crowded(children, parents, (*by, "_band", "_cell"), "c_ord")
        keys = (*by, "_band", "_cell", "_salt")
        parents, children = (x.repartition(parts, *(f"{side}{c}" for c in keys)) for x, side in ((parents, "p_"), (children, "c_")))
        on = [F.col(f"p_{c}") == F.col(f"c_{c}") for c in keys]
        own = _best(children, parents, on, by, d, r_min, radius=True)
        pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is None:
        return events.select(*by, "ord").where("false").withColumn("best", F.lit(None).cast(PAIR))
    return pairs if len(classes) == 1 else pairs.groupBy(*by, "ord").agg(F.min("best").alias("best"))


def search_theta(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM, radius: bool = False) -> DataFrame:
    """The plain definition as an inequality join; for small catalogs and as the tests' yardstick."""
    children = _side(events, "c_", by).repartition(16)
    parents = _side(events, "p_", by)
    return _best(children, parents, [F.col(f"p_{c}") == F.col(f"c_{c}") for c in by], by, d, r_min, radius)


def grid_pairs(events: DataFrame, reach: float, by: tuple = ()) -> int:
    """Pairs that share a cell of the grid for one radius; an estimate for several."""
    grid = geo.Grid(reach)
    home = events.select(*by, grid.cell(F.col("latitude"), F.col("longitude")).alias("_at")).groupBy(*by, "_at").agg(F.count("*").alias("_h"))
    around = events.select(*by, F.explode(grid.around(F.col("latitude"), F.col("longitude"))).alias("_at")).groupBy(*by, "_at").agg(F.count("*").alias("_a"))
    return home.join(around, [*by, "_at"]).agg(F.coalesce(F.sum(F.col("_h").cast("double") * F.col("_a")), F.lit(0.0))).first()[0]


class Side:
    """A group's events in catalog order, as arrays."""

    def __init__(self, order, lat, lon, us, weight, reach):
        self.order, self.lat, self.lon, self.us, self.weight = order.astype(np.int64), lat, lon, us.astype(np.float64), weight
        self.cos = np.cos(lat)
        self.unit = np.stack([self.cos * np.cos(lon), self.cos * np.sin(lon), np.sin(lat)])
        reach = np.asarray(reach, dtype=float)
        self.reach = None if np.isnan(reach).all() else reach

    def exact(self, j: np.ndarray, i: np.ndarray, d: float, r_min: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """eta (infinite where i can't be j's parent), years and km of single pairs."""
        half = np.sin((self.lat[i] - self.lat[j]) / 2) ** 2 + self.cos[i] * self.cos[j] * np.sin((self.lon[i] - self.lon[j]) / 2) ** 2
        far = 2 * model.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
        gap = self.us[j] - self.us[i]
        allowed = gap > 0 if self.reach is None else (gap > 0) & (far <= self.reach[i])
        years, r = gap / 1e6 / model.SECONDS_PER_YEAR, np.maximum(far, r_min)
        return np.where(allowed, years * (r * np.sqrt(r) if d == 1.5 else r**d) * self.weight[i], np.inf), years, r


def best_parents(side: Side, at: np.ndarray, d: float, r_min: float, rows: int = ROWS, tile: int = TILE) -> tuple[np.ndarray, ...]:
    """(eta, parent's place, years, km) of the events at the ascending places ``at``; infinite without a parent.

    The squared chord of two unit vectors is 2 - 2 * their product and a chord is no longer
    than its arc, so both give a lower bound of eta, with a margin for what rounding
    takes away.  Exact are the pairs whose bound doesn't exceed the least eta known.
    """
    eta, place = np.full(len(at), np.inf), np.full(len(at), -1, dtype=np.int64)
    square, year = model.EARTH_RADIUS_KM**2, 1e6 * model.SECONDS_PER_YEAR
    for lo in range(0, len(at), rows):
        j = at[lo : lo + rows]
        least, parent = eta[lo : lo + rows], place[lo : lo + rows]  # views
        unit, us = side.unit[:, j].T * (-2 * square), side.us[j]
        for end in range(int(j.max()), 0, -tile):
            i = slice(max(0, end - tile), end)
            bound = unit @ side.unit[:, i]
            bound += 2 * square * (1 - 1e-14)
            np.maximum(bound, r_min * r_min, out=bound)
            beyond = None if side.reach is None else bound > (side.reach[i] * (1 + 1e-9)) ** 2
            if d == 1.5:
                np.sqrt(bound, out=bound)
                bound *= np.sqrt(bound)
            else:
                bound **= d / 2
            gap = us[:, None] - side.us[None, i]
            bound *= gap
            bound *= side.weight[i]
            if side.us[i.stop - 1] >= us.min():
                bound[gap <= 0] = np.inf
            if beyond is not None:
                bound[beyond] = np.inf
            first = bound.argmin(axis=1)
            some = np.flatnonzero(bound[np.arange(len(j)), first] <= least * year * (1 + 1e-9))
            if not len(some):
                continue
            reached = np.minimum(least[some], side.exact(j[some], i.start + first[some], d, r_min)[0])
            k, m = np.nonzero((bound[some] <= (reached * year * (1 + 1e-9))[:, None]) & (bound[some] < np.inf))
            if not len(k):
                continue
            child, found = some[k], i.start + m
            exact = side.exact(j[child], found, d, r_min)[0]
            order = np.lexsort((found, exact, child))
            child, found, exact = child[order], found[order], exact[order]
            head = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
            child, found, exact = child[head], found[head], exact[head]
            better = (exact < least[child]) | ((exact == least[child]) & np.isfinite(exact) & (found < parent[child]))
            least[child[better]], parent[child[better]] = exact[better], found[better]
    known = np.maximum(place, 0)
    return eta, place, *side.exact(at, known, d, r_min)[1:]


def gathered(events: DataFrame, by: tuple = ()) -> tuple[int, dict[str, Side]]:
    """The number of events and each group's arrays, for catalogs of a checked size."""
    columns = ("ord", "_lat", "_lon", "_us", "_w", "_r")
    if events.count() > BROADCAST_EVENTS:
        raise ValueError("the catalog is too large to be broadcast")
    table = events.select(group_name(by).alias("_g"), *columns).toArrow()
    sides: dict[str, Side] = {}
    names = np.array(table.column("_g").to_pylist(), dtype=object)
    plain = [table.column(c).to_numpy(zero_copy_only=False) for c in columns]
    for name in set(names.tolist()):
        picked = [c[names == name] for c in plain]
        order = np.argsort(picked[0], kind="stable")
        sides[name] = Side(*(c[order] for c in picked))
    return table.num_rows, sides


def group_name(by: tuple) -> Column:
    return F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by)) if by else F.lit("")


def search_shipped(events: DataFrame, by: tuple, n: int, shipped, find) -> DataFrame:
    """(by, ord, best): the children in tasks of few rows, each with what was broadcast for its group.

    ``find`` takes that and the ascending places of some children in their group.
    """
    spark = events.sparkSession
    schema = T.StructType([*(events.schema[c] for c in by), T.StructField("ord", T.LongType()), *(T.StructField(n, t) for n, t in (("eta", T.DoubleType()), ("p_ord", T.LongType()), ("t_years", T.DoubleType()), ("r_km", T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            groups = np.array(batch.column(len(by)).to_pylist(), dtype=object)
            places = batch.column(len(by) + 1).to_numpy()
            found = np.zeros(len(places), dtype=[("eta", "f8"), ("p", "i8"), ("t", "f8"), ("r", "f8")])
            for name in set(groups.tolist()):
                side = known[name][0]
                mine = np.flatnonzero(groups == name)
                at = np.searchsorted(side.order, places[mine])
                mine, at = mine[np.argsort(at, kind="stable")], np.sort(at)
                eta, place, years, r = find(*known[name], at)
                found["eta"][mine], found["t"][mine], found["r"][mine] = eta, years, r
                found["p"][mine] = np.where(place >= 0, side.order[np.maximum(place, 0)], 0)
            some = (found["p"] > 0) & np.isfinite(found["eta"])
            kept = batch.filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(by))), kept.column(len(by) + 1), *(pa.array(found[c][some]) for c in ("eta", "p", "t", "r"))], names=schema.names)

    tasks = max(1, min(int(spark.sparkContext.defaultParallelism) * 4, 1 + n // 512))
    children = events.select(*by, group_name(by).alias("_g"), "ord").repartition(tasks, F.xxhash64(*by, "ord"))
    return children.mapInArrow(run, schema).select(*by, "ord", F.struct("eta", "p_ord", "t_years", "r_km").alias("best"))


def search_blocks(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """(by, ord, best) over all earlier events in tiles, for catalogs of a checked size."""
    n, sides = gathered(events, by)
    shipped = events.sparkSession.sparkContext.broadcast({name: (side,) for name, side in sides.items()})
    return search_shipped(events, by, n, shipped, lambda side, at: best_parents(side, at, d, r_min, rows, tile))


def search_tree(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM) -> DataFrame:
    """(by, ord, best) by branch and bound, for catalogs of a checked size."""
    n, sides = gathered(events, by)
    shipped = events.sparkSession.sparkContext.broadcast({name: (side, tree.EventTree(side)) for name, side in sides.items()})
    return search_shipped(events, by, n, shipped, lambda side, nodes, at: tree.search(nodes, side, at, d, r_min))


def search_bounded(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM, seed_km: float = SEED_KM) -> DataFrame:
    """(by, ord, best) over all earlier events, by equi-joins only."""
    from ..storage import written

    near = search_grid(events.withColumn("_r", F.lit(float(seed_km))), by, d, r_min)
    order = Window.partitionBy(*by).orderBy("ord") if by else Window.partitionBy(F.floor(F.col("ord") / 100_000)).orderBy("ord")
    ago = F.lag(F.struct("_us", "_lat", "_lon", "_w")).over(order)
    some = written(events.select(*by, "ord", "_lat", "_lon", "_us", "_w", "_r", ago.alias("_before")).join(near, [*by, "ord"], "left"), "neighbor-seeds")
    before = F.col("_before")
    prior = F.when(before["_us"] < F.col("_us"), (F.col("_us") - before["_us"]) / 1e6 / model.SECONDS_PER_YEAR * power(F.greatest(geo.haversine_km(before["_lat"], before["_lon"], F.col("_lat"), F.col("_lon")), F.lit(r_min)), d) * before["_w"])
    bound = F.least(F.coalesce(F.col("best.eta"), F.lit(float("inf"))), F.coalesce(prior, F.lit(float("inf"))))
    lightest, first, last = some.agg(F.min("_w"), F.min("_us"), F.max("_us")).first()
    if lightest is None:
        return near
    # beyond the seed radius: dt * seed**d * lightest <= eta <= bound
    span_us = bound / F.lit(seed_km**d * lightest) * F.lit(model.SECONDS_PER_YEAR * 1e6) * (1 + 1e-9) + 1
    low = F.greatest(F.col("_us").cast("double") - span_us, F.lit(float(first)))
    # as wide as a quarter of the mean span: each child meets five buckets on average, however many events there are
    mean_us = some.agg(F.avg(F.col("_us").cast("double") - low)).first()[0]
    width = max(1, int(mean_us / 4) + 1)
    children = some.select(*by, "ord", "_lat", "_lon", "_us", "_w", "_r", low.cast("long").alias("_low")).withColumn("_b", F.explode(F.sequence(F.floor((F.col("_low") - first) / width), F.floor((F.col("_us") - first) / width))))
    parents = some.withColumn("_b", F.floor((F.col("_us") - first) / width))
    keys = (*by, "_b", "_salt")
    on = [F.col(f"p_{c}") == F.col(f"c_{c}") for c in keys] + [F.col("p__us") >= F.col("c__low")]
    sides = deal_crowded(_side(children, "c_", by, "_b", "_low"), _side(parents, "p_", by, "_b"), (*by, "_b"), "c_ord")
    far = _best(*(x.repartition(parts_for_pairs(events), *(f"{p}{c}" for c in keys)) for x, p in zip(sides, ("c_", "p_"), strict=True)), on, by, d, r_min, radius=False)
    return far.unionByName(some.where("best is not null").select(*by, "ord", "best")).groupBy(*by, "ord").agg(F.min("best").alias("best"))


def choose(events: DataFrame, n: int, reach: float | None, by: tuple = ()) -> str:
    """The form with the least work for its pairs, of those that the catalog's size and the largest radius allow."""
    if n > BROADCAST_EVENTS:
        return "bounded" if reach is None else "curve"
    if n <= FEW_EVENTS or reach is None or reach > GRID_KM:
        return "tree"
    return "grid" if grid_pairs(events, reach, by) * GRID_NS < n * math.log2(n) * TREE_NS else "tree"


def nearest_neighbor(catalog: DataFrame, mc: float | Column | None = None, by: tuple = (), b: float = model.B_VALUE, d: float = model.FRACTAL_D, p: float = 0.5, policy: model.RadiusPolicy = model.RadiusPolicy(), r_min: float = model.R_MIN_KM, strategy: str | None = None) -> DataFrame:
    """The complete events with parent_id, parent_mag, eta and its halves; nulls where there is no parent.

    ``mc`` None means that the catalog is complete already; ``strategy`` forces one of
    grid, blocks, tree, slabs, curve, bounded and theta.
    """
    from ..storage import written

    if not 0 <= p <= 1:
        raise ValueError(f"p must be between 0 and 1, not {p}")
    from .completeness import trim_to_mc

    events = written(prepare(trim_to_mc(catalog, mc) if mc is not None else catalog, by, b, policy), "events")
    n = events.count()
    if n < 2:
        raise ValueError(f"only {n} complete events: no pairs")
    if strategy is None:
        # pairs in reach grow with the square of a dense catalog, so the equi-joins and halos of the larger forms are only taken by name
        strategy = "slabs" if n > BROADCAST_EVENTS else choose(events, n, events.agg(F.max("_r")).first()[0], by)
    if strategy in ("bounded",) and policy.capped:
        raise ValueError("the bounded search has no radius")
    search = {"grid": search_grid, "blocks": search_blocks, "tree": search_tree, "slabs": slabs.search, "curve": curve.search, "bounded": search_bounded, "theta": lambda e, g, x, y: search_theta(e, g, x, y, policy.capped)}[strategy]
    best = search(events, by, d, r_min)
    parents = events.select(*by, F.col("ord").alias("p_ord"), F.col("id").alias("parent_id"), F.col("mag").alias("parent_mag"))
    joined = events.join(best.select(*by, "ord", "best.*"), [*by, "ord"], "left").join(parents, [*by, "p_ord"], "left")
    scale = F.pow(F.lit(10.0), F.lit(-float(b)) * F.col("parent_mag"))
    kept = [c for c in catalog.columns if c in model.NEIGHBOR_CARRIED and c not in by]
    return joined.select(
        *by,
        *kept,
        "ord",
        "parent_id",
        "parent_mag",
        "eta",
        stats.log10_or_null(F.col("eta")).alias("log10_eta"),
        "t_years",
        "r_km",
        stats.log10_or_null(F.col("t_years") * F.pow(scale, F.lit(1.0 - p))).alias("log10_T"),
        stats.log10_or_null(F.pow(F.col("r_km"), F.lit(float(d))) * F.pow(scale, F.lit(float(p)))).alias("log10_R"),
        "p_ord",
    )
