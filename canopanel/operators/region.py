"""Select cells, periods and members."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import small_side
from canopanel.functions.calendar import in_period
from canopanel.functions.labels import longitude_360


@dataclass(frozen=True)
class Box:
    """A lon/lat rectangle, all bounds inclusive; without latitudes it is a band.

    With ``lon_min`` over ``lon_max`` it lies across the meridian where longitudes start again.
    """

    lon_min: float
    lon_max: float
    lat_min: float | None = None
    lat_max: float | None = None

    def contains(self, lon, lat=None):
        if self.lon_min <= self.lon_max:
            inside = lon.between(self.lon_min, self.lon_max)
        else:
            inside = (lon >= self.lon_min) | (lon <= self.lon_max)
        if self.lat_min is not None:
            inside = inside & lat.between(self.lat_min, self.lat_max)
        return inside


# The contiguous-US box in degrees east / north.
CONUS = Box(235.0, 294.0, 24.5, 49.5)

# Named regions as (lon_min, lon_max, lat_min, lat_max), longitudes -180..180.
NAMED_REGIONS = {
    "Pacific Northwest": (-125, -115, 42, 50),
    "Great Basin": (-115, -105, 36, 50),
    "Northern Rockies": (-115, -105, 45, 50),
    "Southern Rockies": (-115, -105, 36, 45),
    "Prairie": (-105, -95, 36, 50),
    "Central Plains": (-95, -85, 36, 50),
    "Deep South": (-85, -75, 36, 50),
    "Appalachia": (-85, -75, 25, 36),
    "Mid-Atlantic": (-75, -65, 25, 50),
}


def box_cells(grid: DataFrame, box: Box, cell: str = "gridcell",
              lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Ids of the cells inside a box or band."""
    return grid.where(box.contains(F.col(lon), F.col(lat))).select(cell)


def select_cells(panel: DataFrame, cells: DataFrame, cell: str = "gridcell",
                 strict: bool = False) -> DataFrame:
    """Rows of the panel whose cell is listed.

    ``strict`` raises ``KeyError`` when a listed cell is not in the panel (one extra pass
    over the cell column).
    """
    ids = small_side(cells.select(cell).distinct())
    if strict:
        unknown = ids.join(panel.select(cell).distinct(), cell, "left_anti").limit(5).collect()
        if unknown:
            raise KeyError(f"cells not in the panel: {sorted(r[0] for r in unknown)}")
    return panel.join(ids, cell, "left_semi")


def flag_cells(panel: DataFrame, cells: DataFrame, flag: str = "in_region",
               cell: str = "gridcell") -> DataFrame:
    """Mark instead of select, so that one pass serves the region and the whole."""
    marked = small_side(cells.select(cell).distinct().withColumn(flag, F.lit(True)))
    return panel.join(marked, cell, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def slice_time(table: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Inclusive slice by partial dates (``"1901"``, ``"2014-12"``, ``"2014-12-31"``)."""
    return table.where(in_period(F.col(time), start, end))


def slice_box(table: DataFrame, box: Box, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rectangular slice of a regular grid, whatever the order of its labels."""
    return table.where(box.contains(F.col(lon), F.col(lat)))


def normalise_longitude(table: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitudes in [0, 360).  Sort the result only where an order is shown."""
    return table.withColumn(lon, longitude_360(F.col(lon)))


def members_between(table: DataFrame, first: int, last: int, member: str = "member") -> DataFrame:
    """Members ``first`` to ``last``, both inclusive."""
    return table.where(F.col(member).between(first, last))


def member_series(panel: DataFrame, member_value, member: str = "member",
                  time: str = "time") -> DataFrame:
    """The series of one member, in time order."""
    return panel.where(F.col(member) == member_value).orderBy(time)


def assign_regions(
    cells: DataFrame, regions: Mapping[str, tuple] | None = None, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """One row per (cell, region) with the cell inside the region, edges included.

    Overlapping regions give several rows.  The few rectangles are literals in the plan, so
    no join takes place.
    """
    inside = []
    for name, (lon_min, lon_max, lat_min, lat_max) in (regions or NAMED_REGIONS).items():
        # A region of 360 degrees or more is the whole circle.
        west, east = (0, 360) if lon_max - lon_min >= 360 else (lon_min % 360, lon_max % 360)
        hit = Box(west, east, lat_min, lat_max).contains(longitude_360(F.col(lon)), F.col(lat))
        inside.append(F.when(hit, F.lit(name)))
    return cells.withColumn("region", F.explode(F.array_compact(F.array(*inside))))


TILE = 10.0  # degrees; tiles of longitudes close the circle


def assign_many_regions(
    cells: DataFrame, regions: DataFrame, region: str = "region", lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """As :func:`assign_regions` for a table of regions (region, lon_min, lon_max, lat_min, lat_max).

    Rectangles are listed under the tiles of ``TILE`` degrees that they touch.  Cells meet only those
    of their own tile, by an equi-join, and are then tested exactly; the plan is the same for any
    number of regions.  A region of 360 degrees or more is the whole circle.
    """
    around = int(360 / TILE)
    whole = F.col("lon_max") - F.col("lon_min") >= 360
    sides = regions.select(
        region, F.when(whole, 0.0).otherwise(longitude_360(F.col("lon_min"))).alias("_west"),
        F.when(whole, 360.0).otherwise(longitude_360(F.col("lon_max"))).alias("_east"),
        F.col("lat_min").cast("double").alias("_south"), F.col("lat_max").cast("double").alias("_north"))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    last = F.least(tile("_east"), F.lit(around - 1))
    turns = F.when(F.col("_west") <= F.col("_east"), F.sequence(tile("_west"), last)).otherwise(
        F.concat(F.sequence(tile("_west"), F.lit(around - 1)), F.sequence(F.lit(0), last)))
    listed = sides.where("_south <= _north").withColumn("_x", F.explode(F.array_distinct(turns))).withColumn(
        "_y", F.explode(F.sequence(tile("_south"), tile("_north"))))
    placed = cells.withColumn("_lon", longitude_360(F.col(lon)).cast("double")).withColumns({
        "_x": F.least(tile("_lon"), F.lit(around - 1)), "_y": tile(lat)})
    x = F.col("_lon")
    across = F.when(F.col("_west") <= F.col("_east"), x.between(F.col("_west"), F.col("_east"))).otherwise(
        (x >= F.col("_west")) | (x <= F.col("_east")))
    met = placed.join(listed, ["_x", "_y"]).where(across & F.col(lat).between(F.col("_south"), F.col("_north")))
    return met.select(*cells.columns, region)
