"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EARTH_RADIUS_KM, GK_INTERCEPT, GK_SLOPE


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in radians."""
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def gardner_knopoff_km(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(GK_SLOPE) * mag + F.lit(GK_INTERCEPT))


def border_distance_km(lat: Column, lon: Column, bbox: tuple) -> Column:
    """Distance in km of a point in degrees to the nearest edge of (min lat, max lat, min lon, max lon), numbers or columns."""
    south, north, west, east = (e if isinstance(e, Column) else F.lit(float(e)) for e in bbox)

    def parallel(edge: Column) -> Column:
        return F.lit(EARTH_RADIUS_KM) * F.abs(F.radians(lat - edge))

    def meridian(edge: Column) -> Column:
        return F.lit(EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.abs(F.sin(F.radians(lon - edge)) * F.cos(F.radians(lat)))))

    return F.least(parallel(south), parallel(north), meridian(west), meridian(east))


class Grid:
    """Cells of a sphere such that points within ``radius_km`` are in neighbouring cells.

    Bands of latitude are one radius high; each band is cut into as many cells as keep
    the longitude difference of two such points within one cell's width, so cells
    widen towards the poles (down to one cell) and wrap around the antimeridian.
    """

    def __init__(self, radius_km: float):
        angle = radius_km / EARTH_RADIUS_KM * (1 + 1e-6)
        self.whole = angle >= math.pi / 2
        self.height = math.degrees(angle)
        self.half_sine = math.sin(min(angle, math.pi / 2) / 2)

    def band(self, lat: Column) -> Column:
        if self.whole:
            return F.lit(0).cast("long")
        return F.floor((lat + 90.0) / self.height)

    def _cells(self, band: Column) -> Column:
        """Cells of a band, from the least cosine in it and its two neighbours."""
        far = F.greatest(F.abs((band - 1) * self.height - 90.0), F.abs((band + 2) * self.height - 90.0))
        ratio = F.lit(self.half_sine) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(1e-12))
        return F.when(ratio >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(math.pi) / F.asin(F.least(ratio, F.lit(1.0))) * (1 - 1e-9)))).cast("long")

    def cell(self, lat: Column, lon: Column) -> Column:
        if self.whole:
            return F.struct(F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("cell"))
        band = self.band(lat)
        n = self._cells(band)
        return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180.0) / 360.0 * n), n).alias("cell"))

    def around(self, lat: Column, lon: Column) -> Column:
        """The distinct cells that can hold a point within the radius."""
        if self.whole:
            return F.array(self.cell(lat, lon))
        cells = []
        for up in (-1, 0, 1):
            band = self.band(lat) + up
            n = self._cells(band)
            own = F.floor((lon + 180.0) / 360.0 * n)
            cells += [F.struct(band.alias("band"), F.pmod(own + side, n).alias("cell")) for side in (-1, 0, 1)]
        return F.array_distinct(F.array(*cells))
