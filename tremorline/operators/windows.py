"""What had happened within a radius of a place in the windows of time before a moment: how often, how large, how lately.

Pairs of an event and what lies around it grow with the square of a dense catalog, so they aren't met. The catalog is
cut into parts of space and time, each with a tree whose nodes know the box, the number, the largest magnitude and the last
moment of their events. A node wholly inside the radius and each window (or outside of one) is counted as it is; only the
leaves that an edge crosses are looked at event by event. The parts' own boxes are small and broadcast, and are counted in
the same way, so a child visits only the parts that an edge crosses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..storage import written
from .slabs import MOST, by_group, parted, plain

#: Events of a leaf; children that are searched together; leaves that are looked at together.
LEAF, TOGETHER, LEAVES = 16, 512, 65_536
DAY_US = 86_400_000_000
#: Microseconds and unit vectors' lengths within which an edge is decided event by event.
SLACK_US, SLACK = 1000, 1e-12
PLACE = ("lat", "lon", "us")
NONE = np.iinfo(np.int64).min


def units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


class Query:
    """The radius and the windows, and what is inside."""

    def __init__(self, reach_km: float, days: tuple):
        self.reach_km, self.days, self.longest = reach_km, days, max(days)
        self.chord = 2 * np.sin(min(reach_km / model.EARTH_RADIUS_KM / 2, np.pi / 2))
        self.high = self.longest * DAY_US + SLACK_US

    def meet(self, boxes, unit: np.ndarray, us: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of single pairs of a child and a box: may it hold something, and can it be counted as it is?"""
        near, far = np.zeros(len(at)), np.zeros(len(at))
        for axis in range(3):
            below, above = boxes.low[axis][at] - unit[axis], unit[axis] - boxes.high[axis][at]
            off = np.maximum(np.maximum(below, above), 0)
            near += off * off
            off = np.maximum(-below, -above)  # to the farther side
            far += off * off
        newest, oldest = us - boxes.last[at], us - boxes.first[at]
        some = (near <= (self.chord + SLACK) ** 2) & (oldest > 0) & (newest <= self.high)
        whole = some & (newest > 0) & (oldest <= self.longest * DAY_US - SLACK_US)
        whole &= far < max(0.0, self.chord - SLACK) ** 2 if self.chord < 2 else True
        for d in self.days:
            whole &= (oldest <= d * DAY_US - SLACK_US) | (newest > d * DAY_US + SLACK_US)
        return some, whole


class Found:
    """For each child the numbers by window, the largest magnitude and the last moment."""

    def __init__(self, n: int, query: Query):
        self.query, self.counts = query, np.zeros((len(query.days), n), dtype=np.int64)
        self.largest, self.last = np.full(n, -np.inf), np.full(n, NONE)

    def add_boxes(self, child: np.ndarray, boxes, at: np.ndarray, us: np.ndarray) -> None:
        """Boxes that lie on one side of every edge."""
        oldest = us - boxes.first[at]
        for count, d in zip(self.counts, self.query.days, strict=True):
            np.add.at(count, child, np.where(oldest <= d * DAY_US, boxes.count[at], 0))
        np.maximum.at(self.largest, child, boxes.largest[at])
        np.maximum.at(self.last, child, boxes.last[at])

    def add_events(self, child: np.ndarray, us: np.ndarray, earlier: np.ndarray, mag: np.ndarray) -> None:
        """Events within the radius and the longest window; ages in days, as doubles, decide on the others."""
        age = (us / 1e6 - earlier / 1e6) / 86400.0
        for count, d in zip(self.counts, self.query.days, strict=True):
            np.add.at(count, child[age <= d], 1)
        some = age <= self.query.longest
        np.maximum.at(self.largest, child[some], mag[some])
        np.maximum.at(self.last, child, earlier)

    def columns(self) -> list[pa.Array]:
        return [*(pa.array(c) for c in self.counts), pa.array(self.largest, mask=np.isneginf(self.largest)), pa.array(self.last, mask=self.last == NONE)]


class Totals:
    """The tree over a part's events."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, us: np.ndarray, mag: np.ndarray, pace: float, leaf: int = LEAF):
        unit, n = units(lat, lon), len(us)
        place = np.vstack([unit, (us - us.min()) * (pace / model.EARTH_RADIUS_KM)])
        order, spans, child, i = np.arange(n), [(0, n)], [], 0
        while i < len(spans):  # a node's children stand behind it, next to each other
            a, b = spans[i]
            if b - a > leaf:
                own = order[a:b]
                around = place[:, own]
                axis, middle = int(np.argmax(around.max(axis=1) - around.min(axis=1))), (b - a) // 2
                order[a:b] = own[np.argpartition(around[axis], middle)]
                child.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            else:
                child.append(-1)
            i += 1
        self.child = np.array(child, dtype=np.int64)
        self.start, self.end = np.array(spans, dtype=np.int64).T
        self.count = self.end - self.start
        self.lat, self.lon, self.unit, self.us, self.mag = lat[order], lon[order], unit[:, order], us[order], mag[order]
        leaves = np.flatnonzero(self.child < 0)
        leaves = leaves[np.argsort(self.start[leaves])]
        cuts = self.start[leaves]

        def summary(values: np.ndarray, f) -> np.ndarray:
            out = np.empty(len(spans), dtype=values.dtype)
            out[leaves] = f.reduceat(values, cuts)
            for k in range(len(spans) - 1, -1, -1):
                if (c := child[k]) >= 0:
                    out[k] = f(out[c], out[c + 1])
            return out

        self.low = np.stack([summary(x, np.minimum) for x in self.unit])
        self.high = np.stack([summary(x, np.maximum) for x in self.unit])
        self.first, self.last, self.largest = summary(self.us, np.minimum), summary(self.us, np.maximum), summary(self.mag, np.maximum)

    def search(self, lat: np.ndarray, lon: np.ndarray, us: np.ndarray, query: Query, seen: list[int] | None = None) -> Found:
        """What is found for children at these places and moments; ``seen`` gets the numbers of events looked at."""
        found, unit = Found(len(us), query), units(lat, lon)
        for lo in range(0, len(us), TOGETHER):
            child = np.arange(lo, min(lo + TOGETHER, len(us)))
            nodes, leaves = np.zeros(len(child), dtype=np.int64), []
            while len(child):
                some, whole = query.meet(self, unit[:, child], us[child], nodes)
                found.add_boxes(child[whole], self, nodes[whole], us[child[whole]])
                rest = some & ~whole
                child, nodes = child[rest], nodes[rest]
                ends = self.child[nodes] < 0
                leaves.append((child[ends], nodes[ends]))
                child, nodes = np.repeat(child[~ends], 2), (self.child[nodes[~ends]][:, None] + np.arange(2)).ravel()
            child, nodes = (np.concatenate(x) for x in zip(*leaves, strict=True))
            for k in range(0, len(child), LEAVES):
                self._look(child[k : k + LEAVES], nodes[k : k + LEAVES], lat, lon, unit, us, found, seen)
        return found

    def _look(self, child, nodes, lat, lon, unit, us, found: Found, seen: list[int] | None) -> None:
        sizes, query = self.count[nodes], found.query
        event = np.repeat(self.start[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        child = np.repeat(child, sizes)
        if seen is not None:
            seen.append(len(child))
        gap = us[child] - self.us[event]
        some = (gap > 0) & (gap <= query.high)
        child, event = child[some], event[some]
        far = np.zeros(len(child))
        for axis in range(3):
            off = unit[axis][child] - self.unit[axis][event]
            far += off * off
        far = np.sqrt(far)
        inside = far <= query.chord - SLACK
        edge = np.flatnonzero(~inside & (far <= query.chord + SLACK))
        c, e = child[edge], event[edge]
        half = np.sin((self.lat[e] - lat[c]) / 2) ** 2 + np.cos(lat[c]) * np.cos(self.lat[e]) * np.sin((self.lon[e] - lon[c]) / 2) ** 2
        inside[edge] = 2 * model.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1))) <= query.reach_km
        child, event = child[inside], event[inside]
        found.add_events(child, us[child], self.us[event], self.mag[event])


class Boxes:
    """The boxes of a group's parts."""

    def __init__(self, table: pa.Table):
        self.part, self.first, self.last, self.count, self.largest = plain(table, "part", "first", "last", "count", "largest")
        self.low, self.high = (np.stack(plain(table, *(f"{side}_{x}" for x in "xyz"))) for side in ("low", "high"))


def boxed(placed: DataFrame, by: tuple) -> dict[tuple, Boxes]:
    """A row a part, of some hundred thousand events each."""
    lat, lon = F.col("lat"), F.col("lon")
    unit = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    edges = [f(v + slack).alias(f"{name}_{x}") for x, v in unit.items() for name, f, slack in (("low", F.min, -1e-15), ("high", F.max, 1e-15))]
    table = placed.groupBy(*by, "part").agg(*edges, F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("count"), F.max("mag").alias("largest")).toArrow()
    return {key: Boxes(own) for key, own in by_group(table, by).items()}


def before(children: DataFrame, events: DataFrame, reach_km: float, days: tuple, by: tuple = (), key: str = "key", most: int = MOST) -> DataFrame:
    """(by, key, n_<days>, largest, last): of the events within ``reach_km`` and strictly before each child.

    Both have ``by``, lat and lon in radians and us, children a key and events a magnitude. ``last`` is the latest moment within
    the longest window and ``SLACK_US``. Children without an event there may have a row with zeros or none.
    """
    from .neighbors import parts_for_pairs

    query, pace = Query(reach_km, days), reach_km / (max(days) * DAY_US)
    known = lambda df: df.where(F.col("us").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    plain_events = known(events).select(*by, *PLACE, F.coalesce("mag", F.lit(float("-inf"))).alias("mag"), F.xxhash64(*PLACE, "mag").alias("dealt"))
    placed = written(parted(plain_events, by, most, PLACE, "dealt", pace), "windows-parts")
    shipped = placed.sparkSession.sparkContext.broadcast(boxed(placed, by))
    own = known(children).select(*by, key, *PLACE)
    totals = [*(T.StructField(f"n_{d}", T.LongType()) for d in days), T.StructField("largest", T.DoubleType()), T.StructField("last", T.LongType())]
    head = [own.schema[c] for c in (*by, key)]
    one = T.StructType([*own.schema.fields, *totals, T.StructField("parts", T.ArrayType(T.LongType()))])

    def count_parts(batches):
        for batch in batches:
            lat, lon, us = plain(batch, *PLACE)
            unit, found = units(lat, lon), Found(len(us), query)
            groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(us)
            rows: dict[tuple, list[int]] = {}
            for i, group in enumerate(groups):
                rows.setdefault(group, []).append(i)
            met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for group, places in rows.items():
                boxes = shipped.value.get(group)
                for lo in range(0, len(places) if boxes else 0, 1024):
                    some = np.array(places[lo : lo + 1024])
                    child, at = np.repeat(some, len(boxes.part)), np.tile(np.arange(len(boxes.part)), len(some))
                    may, whole = query.meet(boxes, unit[:, child], us[child], at)
                    found.add_boxes(child[whole], boxes, at[whole], us[child[whole]])
                    visit = may & ~whole
                    met.append((child[visit], boxes.part[at[visit]]))
            child, part = (np.concatenate(x) for x in zip(*met, strict=True))
            order = np.argsort(child, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(us)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part[order]))], names=one.names)

    first = written(own.mapInArrow(count_parts, one), "windows-boxes")
    visitors = first.select(*by, key, *PLACE, F.explode("parts").alias("part"))
    to = written(visitors.groupBy(*by, "part").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")), "windows-visits")  # a row a part
    named = to.select(*(F.col(c).alias(f"_to {c}") for c in (*by, "part")), "chunks")
    met = lambda df: df.join(named, [df[c].eqNullSafe(F.col(f"_to {c}")) for c in (*by, "part")])
    keys, tasks = [*by, "part", "chunk"], parts_for_pairs(children)
    left = met(visitors).select(*by, key, *PLACE, "part", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int").alias("chunk"))
    right = met(placed).select(*by, *PLACE, "mag", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    two = T.StructType([*head, *totals])

    def count_events(visiting: pa.Table, hosts: pa.Table) -> pa.Table:
        if not visiting.num_rows or not hosts.num_rows:
            return two_empty.slice(0, 0)
        found = Totals(*plain(hosts, *PLACE, "mag"), pace).search(*plain(visiting, *PLACE), query)
        return pa.Table.from_arrays([*(visiting.column(f.name) for f in head), *found.columns()], names=two.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    two_empty = to_arrow_schema(two).empty_table()
    sides = (x.repartition(tasks, *keys).groupBy(*keys) for x in (left, right))
    visited = next(sides).cogroup(next(sides)).applyInArrow(count_events, two)
    sums = [F.sum(f"n_{d}").alias(f"n_{d}") for d in days]
    return first.select(two.names).unionByName(visited).groupBy(*by, key).agg(*sums, F.max("largest").alias("largest"), F.max("last").alias("last"))
