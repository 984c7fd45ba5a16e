"""Points within a radius of centres, by grid cells instead of all pairs.

The globe is cut into bands of latitude about as high as the radius, and each band into as many
cells as are about as wide. A point lies in one cell; a centre is sent to the few cells that its
circle can touch, over the poles and across 180 degrees too, so each pair is looked at once at
most and the great-circle distance decides. Cells with very many points are split by a hash of
the point, and their centres sent to every part.

Latitudes beyond 90 degrees and coordinates that are null or not numbers take no part; longitudes
count modulo 360 degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

EARTH_KM = 6371.0088
#: Points of a cell from which on it is split, and rows of split cells up to which they are broadcast.
HOT, MOST_HOT = 65_536, 100_000


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance, by the haversine of angles in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("lat").between(-90, 90) & F.col("lng").isNotNull() & ~F.isnan("lng") & (F.abs("lng") < 1e9))


def _columns(band: Column, step: float) -> Column:
    """How many cells a band has: as its longer edge is long."""
    low = band * step - 90
    widest = F.when((low <= 0) & (low + step >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + step)))
    return F.greatest(F.lit(1), F.floor(360 / step * F.cos(F.radians(widest)))).cast("int")


def _turn(lng: Column) -> Column:
    """Longitude as a share of the full circle, from 0 up to 1."""
    return F.pmod(lng + 180, F.lit(360.0)) / 360


def within(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(centre_id, point_id, km) of points (point_id, lat, lng) and centres (centre_id, lat, lng) at most ``km`` apart."""
    reach = km / EARTH_KM  # in radians
    step = max(180 / 4096, min(60.0, reach * 180 / 3.141592653589793))
    last = int(180 / step)

    placed = _valid(points.select("point_id", F.col("lat").cast("double"), F.col("lng").cast("double")))
    placed = placed.withColumn("band", F.least(F.lit(last), F.floor((F.col("lat") + 90) / step)).cast("int"))
    placed = placed.withColumn("cell", F.least(F.floor(_turn(F.col("lng")) * _columns(F.col("band"), step)).cast("int"), _columns(F.col("band"), step) - 1))

    degrees = reach * 180 / 3.141592653589793 * (1 + 1e-9) + 1e-9
    asked = _valid(centres.select("centre_id", F.col("lat").cast("double"), F.col("lng").cast("double")))
    low, high = F.col("lat") - degrees, F.col("lat") + degrees
    near = lambda lat: F.least(F.lit(last), F.greatest(F.lit(0), F.floor((lat + 90) / step))).cast("int")
    # How far the circle reaches east and west; over a pole it goes all around.
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(reach * (1 + 1e-9), 1.5707963))) / F.cos(F.radians("lat"))))) + 1e-9
    around = (low <= -90) | (high >= 90) | F.lit(reach >= 1.5707963)
    asked = asked.withColumn("side", F.when(around, F.lit(180.0)).otherwise(side)).withColumn("band", F.explode(F.sequence(near(low), near(high))))
    count = _columns(F.col("band"), step)
    first, final = F.floor((F.col("lng") - F.col("side") + 180) / 360 * count), F.floor((F.col("lng") + F.col("side") + 180) / 360 * count)
    cells = F.when((F.col("side") >= 180) | (final - first + 1 >= count), F.sequence(F.lit(0), count - 1)).otherwise(F.transform(F.sequence(first, final), lambda c: F.pmod(c, count).cast("int")))
    asked = asked.withColumn("cell", F.explode(cells))

    hot = cut(placed.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT).select("band", "cell", F.ceil(F.col("held") / HOT).cast("int").alias("parts")))
    hot = F.broadcast(hot) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else hot
    parts = F.coalesce("parts", F.lit(1))
    right = placed.join(hot, ["band", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("point_id"), parts).cast("int")).drop("parts")
    left = asked.join(hot, ["band", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("band", "cell", "part", "centre_id", F.col("lat").alias("lat_"), F.col("lng").alias("lng_"))
    apart = distance_km(F.col("lat_"), F.col("lng_"), F.col("lat"), F.col("lng"))
    return left.join(right, ["band", "cell", "part"]).select("centre_id", "point_id", apart.alias("km")).where(F.col("km") <= km)


def merged(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(point_id, centre_id, km, centres, places): each point that any centre reaches once, with its nearest centre, ties by id, how many reach it, and their different names in order.

    centres (centre_id, lat, lng, name). Names are joined before points come together, so no list is longer than there are names.
    """
    found = within(points, centres, km).join(centres.select("centre_id", "name"), "centre_id")
    nearest = F.min(F.struct(F.round("km", 6).alias("km"), "centre_id")).alias("n")
    out = found.groupBy("point_id").agg(nearest, F.count(F.lit(1)).alias("centres"), F.sort_array(F.collect_set("name")).alias("places"))
    return out.select("point_id", "n.centre_id", "n.km", "centres", "places")
