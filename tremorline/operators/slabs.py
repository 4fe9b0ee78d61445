"""The search for catalogs of any size, with a radius or without: first near in space, then near in time.

An event's best parent is near in space, near in time or large.  The first pass cuts the catalog into parts of
space; a part is one group with a tree over its events.  The second cuts it into slabs of time, each with
the events of the slab before, and looks only for parents that are as good as the known one.  A still better
parent is older than these two slabs and outside the part, so it must be large or just beyond the part's edge: boxes
of the parts, which are small and broadcast, say which parts can hold it, and the third pass visits those.

A part of space is bounded in its events however crowded a place is: where places are closer than ``CLOSE_KM``
the cuts go through time.  A part with many visitors becomes several groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..storage import written
from . import tree

#: Events of a part of space, and parts of that in a slab of time; sampled events of a part, which only place the cuts.
MOST, SLABS, SAMPLED = 50_000, 8, 200
#: Tasks for each part of space.
SPARE = 4
#: The whole span of time counts as so many km when a part of space is cut.
CLOSE_KM = 5.0
#: Boxes hold events whose weights lie within this factor.
WEIGHTS = 10.0**0.5
COLUMNS = ("ord", "_lat", "_lon", "_us", "_w", "_r")
PAIR = ("eta", "p_ord", "t_years", "r_km")


def place(lat: np.ndarray, lon: np.ndarray, us: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat), us.astype(np.float64)])


class Parts:
    """Cuts of one group's catalog at medians of a sample, in which each event stands for ``step``; a microsecond counts as ``pace`` km."""

    def __init__(self, at: np.ndarray, step: int, most: int, pace: float | None = None):
        self.began, span = at[3].min(), max(1.0, np.ptp(at[3]))
        self.scale = (CLOSE_KM / span if pace is None else pace) / model.EARTH_RADIUS_KM
        at = self._scaled(at)
        rows, nodes, i = [np.arange(at.shape[1])], [(-1, 0.0, 0)], 0
        while i < len(nodes):  # the two halves of a part stand behind it, next to each other
            own = at[:, rows[i]]
            axis = int(np.argmax(np.ptp(own, axis=1)))
            x = own[axis]
            if x.size * step > most and x.min() < x.max():
                cut = np.median(x)
                cut = cut if cut < x.max() else x[x < x.max()].max()
                nodes[i] = (axis, cut, len(nodes))
                nodes += [(-1, 0.0, 0)] * 2
                rows += [rows[i][x <= cut], rows[i][x > cut]]
            i += 1
        self.axis, self.cut, self.child = (np.array(c) for c in zip(*nodes, strict=True))

    def _scaled(self, at: np.ndarray) -> np.ndarray:
        return np.vstack([at[:3], (at[3:] - self.began) * self.scale])

    def of(self, at: np.ndarray) -> np.ndarray:
        """The number of each event's part."""
        at, node = self._scaled(at), np.zeros(at.shape[1], dtype=np.int64)
        while len(some := np.flatnonzero(self.axis[node] >= 0)):
            n = node[some]
            node[some] = self.child[n] + (at[self.axis[n], some] > self.cut[n])
        return node


def by_group(table: pa.Table, by: tuple) -> dict[tuple, pa.Table]:
    """A small table's rows by group."""
    keys = list(zip(*(table.column(c).to_pylist() for c in by), strict=True)) if by else [()] * table.num_rows
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    return {key: table.take(pa.array(own)) for key, own in rows.items()}


def plain(table: pa.Table | pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy(zero_copy_only=False) for c in columns]


def parted(events: DataFrame, by: tuple, most: int, where: tuple = ("_lat", "_lon", "_us"), number: str = "ord", pace: float | None = None) -> DataFrame:
    """The events' columns with the number of their part of space (with ``pace``: of space and time)."""
    step = max(1, most // SAMPLED)
    sample = events.where(F.pmod(F.xxhash64(number), F.lit(step)) == 0).select(*by, *where).toArrow()
    shipped = events.sparkSession.sparkContext.broadcast({key: Parts(place(*plain(own, *where)), step, most, pace) for key, own in by_group(sample, by).items()})
    names = [*by, *COLUMNS] if pace is None else events.columns

    def run(batches):
        known = shipped.value
        for batch in batches:
            at, part = place(*plain(batch, *where)), np.zeros(batch.num_rows, dtype=np.int64)
            if by:
                numbers: dict[tuple, int] = {}
                keys = np.array([numbers.setdefault(key, len(numbers)) for key in zip(*(batch.column(c).to_pylist() for c in by), strict=True)], dtype=np.int64)
            else:
                numbers, keys = {(): 0}, part
            for key, number in numbers.items():
                if key in known:  # a group without a sampled event is one part
                    own = np.flatnonzero(keys == number)
                    part[own] = known[key].of(at[:, own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*names, "part"])

    own = events.select(*names)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("part", T.LongType())]))


class Boxes:
    """The boxes of a group's parts by weight, and what they can hold for a child."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("part")
        part, *edges = plain(table, "part", "first", "last", "weight", "reach", *(f"{side}_{x}" for side in ("low", "high") for x in "xyz"))
        self.part, head = np.unique(part, return_index=True)
        self.start, self.size = head, np.diff([*head, len(part)])
        least = {0, 2, 4, 5, 6}  # first, weight and the lower edges
        self.fine = np.stack([e.astype(float) for e in edges])
        self.whole = np.stack([(np.minimum if i in least else np.maximum).reduceat(e, head) for i, e in enumerate(self.fine)])

    def visits(self, side, at: np.ndarray, home: np.ndarray, eta: np.ndarray, start: float, d: float, r_min: float) -> tuple[np.ndarray, np.ndarray]:
        """(child, part): where, but for its home, a parent before ``start`` can reach the eta that a child knows."""

        def may(boxes: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
            first, last, weight, reach, *edges = boxes
            far = np.zeros(np.broadcast_shapes(j.shape, first.shape))
            for axis in range(3):
                x = side.unit[axis, j]
                off = np.maximum(np.maximum(edges[axis] - x, x - edges[3 + axis]), 0)
                off *= off
                far += off
            np.sqrt(far, out=far)
            far *= model.EARTH_RADIUS_KM * tree.MARGIN
            gap = np.maximum(side.us[j] - np.minimum(last, start), 1.0)
            low = gap / tree.YEAR_US * tree.power(np.maximum(far, r_min), d) * weight * tree.MARGIN
            return (low <= known) & (far <= reach) & (first <= start)

        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(at), tree.TOGETHER):
            some = np.arange(lo, min(lo + tree.TOGETHER, len(at)))
            row, part = np.nonzero(may(self.whole, at[some][:, None], eta[some][:, None]))
            child = some[row]
            away = self.part[part] != home[child]
            child, part = child[away], part[away]
            sizes = self.size[part]
            box = np.repeat(self.start[part] + sizes - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            child, part = np.repeat(child, sizes), np.repeat(part, sizes)
            good = may(self.fine[:, box], at[child], eta[child])
            pairs.append(tuple(np.unique(np.stack([child[good], part[good]]), axis=1)))
        child, part = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return child, self.part[part]


def boxed(events: DataFrame, by: tuple) -> dict[tuple, Boxes]:
    """A few boxes for each part: places, times, least weight and largest radius of its events of about one weight."""
    lat, lon = F.col("_lat"), F.col("_lon")
    unit = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    kind = F.floor(F.log("_w") / F.lit(float(np.log(WEIGHTS))))
    edges = [f(v).alias(f"{name}_{x}") for x, v in unit.items() for name, f in (("low", F.min), ("high", F.max))]
    table = events.groupBy(*by, "part", kind.alias("kind")).agg(*edges, F.min("_us").alias("first"), F.max("_us").alias("last"), F.min("_w").alias("weight"), F.coalesce(F.max("_r"), F.lit(float("inf"))).alias("reach")).toArrow()
    return {key: Boxes(own) for key, own in by_group(table, by).items()}


def sides(table: pa.Table) -> tuple:
    """A group's events in catalog order, the places of its children, and these' rows; an event that is a child and a parent is one."""
    from .neighbors import Side

    child, number = plain(table, "child", "ord")
    order = np.lexsort((~child, number))
    order = order[np.flatnonzero(np.diff(number[order], prepend=-1))]
    at = np.flatnonzero(child[order])
    return Side(*(c[order] for c in plain(table, *COLUMNS))), at, table.take(pa.array(order[at]))


def best(side, at: np.ndarray, d: float, r_min: float, known: np.ndarray | None = None) -> dict[str, np.ndarray]:
    if not len(at):
        return {"eta": np.zeros(0), "p_ord": np.zeros(0, np.int64), "t_years": np.zeros(0), "r_km": np.zeros(0)}
    eta, found, years, r = tree.search(tree.EventTree(side), side, at, d, r_min, known=known)
    return {"eta": eta, "p_ord": np.where(found >= 0, side.order[np.maximum(found, 0)], 0), "t_years": years, "r_km": r}


def near_in_space(d: float, r_min: float, names: list[str]):
    """A part's events with the best parents in it; place 0 and an infinite eta without one."""

    def run(table: pa.Table) -> pa.Table:
        side, at, own = sides(table)
        found = best(side, at, d, r_min)
        return pa.Table.from_arrays([pa.array(found[c]) if c in found else own.column(c) for c in names], names=names)

    return run


def near_in_time(shipped, n_by: int, d: float, r_min: float, names: list[str]):
    """A slab's children with the better of what they know and the parents of two slabs, and the parts that can hold better ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, at, own = sides(table)
        known = dict(zip(PAIR, plain(own, *PAIR), strict=True))
        found = best(side, at, d, r_min, known["eta"])
        better = (found["p_ord"] > 0) & ((found["eta"] < known["eta"]) | (found["eta"] == known["eta"]) & (found["p_ord"] < known["p_ord"]))
        found = {c: np.where(better, found[c], known[c]).astype(found[c].dtype) for c in PAIR}
        child, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at) and key[n_by].as_py() >= 2:
            child, part = shipped.value[tuple(k.as_py() for k in key[:n_by])].visits(side, at, own.column("part").to_numpy(), found["eta"], side.us[0], d, r_min)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(at)))]).astype(np.int32)
        found["parts"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part))
        return pa.Table.from_arrays([pa.array(found[c]) if c in found else own.column(c) for c in names], names=names)

    return run


def large_or_beyond(d: float, r_min: float, names: list[str]):
    """Visitors of a part: parents that are as good as what they know or better."""

    def run(table: pa.Table) -> pa.Table:
        side, at, own = sides(table)
        found = best(side, at, d, r_min, own.column("eta").to_numpy())
        out = pa.Table.from_arrays([pa.array(found[c]) if c in found else own.column(c) for c in names], names=names)
        return out.filter(pa.array(found["p_ord"] > 0))

    return run


def tasks_for(groups: int, least: int) -> int:
    """So many that groups, which are few and take long, seldom share a task."""
    return max(least, SPARE * groups)


def search(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM, most: int = MOST) -> DataFrame:
    """(by, ord, best) of all earlier events, within the parents' radii ``_r`` where they have one."""
    from .neighbors import parts_for_pairs

    placed = written(parted(events.withColumn("ord", F.col("ord").cast("long")), by, most), "slabs-parts")
    boxes = boxed(placed, by)
    tasks = tasks_for(sum(len(own.part) for own in boxes.values()), parts_for_pairs(events))
    shipped = events.sparkSession.sparkContext.broadcast(boxes)
    columns = [*by, *COLUMNS, "part"]
    pair = [T.StructField(c, T.LongType() if c == "p_ord" else T.DoubleType()) for c in PAIR]
    fields = [placed.schema[c] for c in columns]

    keys = [*by, "part"]
    one = T.StructType([*fields, *pair])
    first = placed.withColumn("child", F.lit(True)).repartition(tasks, *keys).groupBy(*keys).applyInArrow(near_in_space(d, r_min, one.names), one)

    keys, size = [*by, "slab"], max(1, most // SLABS)
    slab = F.floor((F.col("ord") - 1) / size)
    both = first.withColumn("own", slab).withColumn("slab", F.explode(F.array("own", F.col("own") + 1))).withColumn("child", F.col("slab") == F.col("own"))
    both = both.select(*keys, *columns[len(by) :], "child", *(F.when(F.col("child"), F.col(c)).alias(c) for c in PAIR))
    two = T.StructType([*one.fields, T.StructField("parts", T.ArrayType(T.LongType()))])
    second = written(both.repartition(tasks, *keys).groupBy(*keys).applyInArrow(near_in_time(shipped, len(by), d, r_min, two.names), two), "slabs-second")

    visitors = second.where(F.size("parts") > 0).select(*by, *COLUMNS, "eta", F.explode("parts").alias("part"))
    groups = written(visitors.groupBy(*by, "part").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")), "slabs-visits")  # a row a part
    to = groups.select(*(F.col(c).alias(f"_to {c}") for c in (*by, "part")), "chunks")
    met = lambda df: df.join(to, [df[c].eqNullSafe(F.col(f"_to {c}")) for c in (*by, "part")])
    keys = [*by, "part", "chunk"]
    visiting = met(visitors).select(*columns, "eta", F.pmod(F.xxhash64("ord"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("child"))
    hosts = met(placed).select(*columns, F.lit(None).cast("double").alias("eta"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("child"))
    three = T.StructType([*fields[: len(by) + 1], *pair])
    third = visiting.unionByName(hosts).repartition(tasks, *keys).groupBy(*keys).applyInArrow(large_or_beyond(d, r_min, three.names), three)
    least = F.struct(*PAIR)
    better = written(third.groupBy(*by, "ord").agg(F.min(least).alias("_better")), "slabs-third")  # few rows, so the others needn't be shuffled to meet them
    both = second.join(better, [*by, "ord"], "left").select(*by, "ord", F.least(F.when(F.col("p_ord") > 0, least), F.col("_better")).alias("best"))
    return both.where("best is not null")
