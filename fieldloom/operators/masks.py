"""Regions of a grid: overlapping masks, disjoint cell classes, and the roll-up between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Region names, latitude limits, surface and height classes.
REGIONS = ("global", "land", "ocean", "elevation_gt_1000m", "elevation_le_1000m", "tropics", "midlat_north", "midlat_south", "highlat_north", "highlat_south", "arctic_gt_80N", "antarctic_lt_80S")
DERIVED = ("coastal_mixed", "elevation_gt_2000m")
SURFACES = ("ocean_open", "ocean_coastal", "land_coastal", "land_interior")
HEIGHTS = ("le1000", "1000_2000", "gt2000")
#: A belt of latitudes that excludes the rows next to the poles.
BELT = 48.796875

#: Predicates over lat, lsm and oro_m, which both engines read alike.
PREDICATES = {
    "global": "true",
    "land": "lsm >= 0.5",
    "ocean": "lsm < 0.5",
    "elevation_gt_1000m": "oro_m > 1000",
    "elevation_le_1000m": "oro_m <= 1000",
    "tropics": "abs(lat) < 23.5",
    "midlat_north": "lat >= 23.5 AND lat < 60",
    "midlat_south": "lat <= -23.5 AND lat > -60",
    "highlat_north": "lat >= 60 AND lat < 80",
    "highlat_south": "lat <= -60 AND lat > -80",
    "arctic_gt_80N": "lat >= 80",
    "antarctic_lt_80S": "lat <= -80",
    "coastal_mixed": "lsm > 0.05 AND lsm < 0.95",
    "elevation_gt_2000m": "oro_m > 2000",
}


def mask(region: str, land_inclusive: bool = True) -> Column:
    """Whether a cell is in the region. Without land_inclusive a cell of exactly half land is in neither land nor ocean."""
    if region == "land" and not land_inclusive:
        return F.col("lsm") > 0.5
    return F.expr(PREDICATES[region])


def region_array(regions: tuple[str, ...] = REGIONS, land_inclusive: bool = True) -> Column:
    """The names of all regions a cell is in: explode() of it is the bridge between cells and overlapping regions."""
    return F.array_compact(F.array(*[F.when(mask(r, land_inclusive), F.lit(r)) for r in regions]))


def band_index(lat: str = "lat") -> Column:
    x = F.col(lat)
    return (
        F.when(F.abs(x) < 23.5, 0)
        .when((x >= 23.5) & (x < 60), 1)
        .when((x <= -23.5) & (x > -60), 2)
        .when((x >= 60) & (x < 80), 3)
        .when((x <= -60) & (x > -80), 4)
        .when(x >= 80, 5)
        .when(x <= -80, 6)
    )


def cell_class() -> Column:
    """One of the 84 disjoint classes of band, surface and height; null for a cell that none takes in."""
    lsm, oro = F.col("lsm"), F.col("oro_m")
    surface = F.when(lsm <= 0.05, 0).when(lsm < 0.5, 1).when(lsm < 0.95, 2).when(lsm >= 0.95, 3)
    height = F.when(oro > 2000, 2).when(oro > 1000, 1).otherwise(0)
    return (band_index() * len(SURFACES) + surface) * len(HEIGHTS) + height


def class_regions(spark: SparkSession) -> DataFrame:
    """The bridge (region, cell_class) from the 84 classes to the 14 regions.

    One cell of each class stands for it: the classes are fine enough that all its cells are in the same regions.
    """
    lats, lsms, heights = (0.0, 50.0, -50.0, 70.0, -70.0, 85.0, -85.0), (0.0, 0.25, 0.75, 1.0), (500.0, 1500.0, 2500.0)
    cells = spark.range(1)
    for name, values in (("lat", lats), ("lsm", lsms), ("oro_m", heights)):
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return by_region(cells.select(cell_class().alias("cell_class"), "lat", "lsm", "oro_m"), REGIONS + DERIVED).select("region", "cell_class")


def by_region(df: DataFrame, regions: tuple[str, ...] = REGIONS, land_inclusive: bool = True) -> DataFrame:
    """df with a row for each region its cell is in."""
    return df.withColumn("region", F.explode(region_array(regions, land_inclusive)))


def regions_sql(source: str, regions: tuple[str, ...] = REGIONS, land_inclusive: bool = True) -> str:
    """The SQL twin of by_region."""
    predicate = lambda r: "lsm > 0.5" if r == "land" and not land_inclusive else PREDICATES[r]
    return " UNION ALL ".join(f"SELECT *, '{r}' AS region FROM {source} WHERE {predicate(r)}" for r in regions)
