"""Distances, local planes, the British National Grid and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basics import ColumnLike, clamp, col, steps

# The two sphere radii in use (routing and proximity; footprint and field work).
ROUTE_RADIUS_M = 6_371_000.0
MEAN_RADIUS_M = 6_371_008.8

# Published ellipsoids, Transverse Mercator constants and the
# seven-parameter shift of EPSG:27700.
WGS84_A, WGS84_B = 6_378_137.0, 6_356_752.314245179
AIRY_A, AIRY_B = 6_377_563.396, 6_356_256.909237285
TM_SCALE, TM_LAT0, TM_LON0 = 0.9996012717, 49.0, -2.0
TM_FALSE_E, TM_FALSE_N = 400_000.0, -100_000.0
SHIFT_M = (446.448, -125.157, 542.06)
SHIFT_ARCSEC = (0.1502, 0.247, 0.8421)
SHIFT_PPM = -20.4894


def haversine_m(
    lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike,
    radius_m: float = ROUTE_RADIUS_M, form: str = "asin",
) -> Column:
    """Great-circle metres; ``form`` picks the asin or the atan2 closing step."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lon = F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lon * half_lon
    if form == "atan2":
        return F.lit(radius_m * 2) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
    return F.lit(2 * radius_m) * F.asin(F.sqrt(clamp(h, 0.0, 1.0)))


def local_xy(lat: ColumnLike, lon: ColumnLike, lat0: ColumnLike, lon0: ColumnLike) -> tuple[Column, Column]:
    """Equirectangular metres around an origin; the longitude step wraps at +-180 degrees."""
    delta = F.radians(col(lon) - col(lon0))
    turn = F.lit(2 * math.pi)
    wrapped = F.when(delta > math.pi, delta - turn).when(delta < -math.pi, delta + turn).otherwise(delta)
    x = F.lit(MEAN_RADIUS_M) * wrapped * F.cos(F.radians(col(lat0)))
    y = F.lit(MEAN_RADIUS_M) * F.radians(col(lat) - col(lat0))
    return x, y


def local_lat_lon(x: ColumnLike, y: ColumnLike, lat0: ColumnLike, lon0: ColumnLike) -> tuple[Column, Column]:
    """Inverse of :func:`local_xy`; null at a pole, where longitude is undefined."""
    shrink = F.cos(F.radians(col(lat0)))
    lat = col(lat0) + F.degrees(col(y) / F.lit(MEAN_RADIUS_M))
    lon = F.when(F.abs(shrink) >= 1e-12, col(lon0) + F.degrees(col(x) / (F.lit(MEAN_RADIUS_M) * shrink)))
    return lat, lon


def _to_cartesian(df: DataFrame, lon: str, lat: str, a: float, b: float) -> DataFrame:
    e2 = (a * a - b * b) / (a * a)
    return steps(
        df,
        {"_phi": F.radians(lat), "_lam": F.radians(lon)},
        {"_nu": F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin("_phi") * F.sin("_phi"))},
        {
            "_cx": F.col("_nu") * F.cos("_phi") * F.cos("_lam"),
            "_cy": F.col("_nu") * F.cos("_phi") * F.sin("_lam"),
            "_cz": F.lit(1 - e2) * F.col("_nu") * F.sin("_phi"),
        },
    )


def _to_geodetic(df: DataFrame, a: float, b: float, rounds: int = 5) -> DataFrame:
    """Latitude by a fixed number of fixed-point rounds (error far below a micrometre)."""
    e2 = (a * a - b * b) / (a * a)
    df = steps(
        df,
        {"_p": F.sqrt(F.col("_cx") * F.col("_cx") + F.col("_cy") * F.col("_cy"))},
        {"_phi": F.atan2(F.col("_cz"), F.col("_p") * F.lit(1 - e2)), "_lam": F.atan2(F.col("_cy"), F.col("_cx"))},
    )
    for _ in range(rounds):
        df = steps(
            df,
            {"_nu": F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin("_phi") * F.sin("_phi"))},
            {"_phi": F.atan2(F.col("_cz") + F.lit(e2) * F.col("_nu") * F.sin("_phi"), F.col("_p"))},
        )
    return df


def _shift(df: DataFrame, to_wgs84: bool) -> DataFrame:
    rx, ry, rz = (math.radians(s / 3600) for s in SHIFT_ARCSEC)
    dx, dy, dz = SHIFT_M
    m = 1 + SHIFT_PPM / 1e6
    x, y, z = F.col("_cx"), F.col("_cy"), F.col("_cz")
    if to_wgs84:
        return df.withColumns({
            "_cx": m * (x - rz * y + ry * z) + dx,
            "_cy": m * (rz * x + y - rx * z) + dy,
            "_cz": m * (-ry * x + rx * y + z) + dz,
        })
    df = df.withColumns({"_cx": (x - dx) / m, "_cy": (y - dy) / m, "_cz": (z - dz) / m})
    return df.withColumns({
        "_cx": x + rz * y - ry * z,
        "_cy": -rz * x + y + rx * z,
        "_cz": ry * x - rx * y + z,
    })


def _meridian_arc(phi: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    d, s = phi - math.radians(TM_LAT0), phi + math.radians(TM_LAT0)
    c0 = 1 + n + 5 / 4 * n**2 + 5 / 4 * n**3
    c1 = 3 * n + 3 * n**2 + 21 / 8 * n**3
    c2 = 15 / 8 * (n**2 + n**3)
    c3 = 35 / 24 * n**3
    return F.lit(AIRY_B * TM_SCALE) * (
        c0 * d - c1 * F.sin(d) * F.cos(s) + c2 * F.sin(2 * d) * F.cos(2 * s) - c3 * F.sin(3 * d) * F.cos(3 * s)
    )


_TEMPS = ["_phi", "_lam", "_nu", "_cx", "_cy", "_cz", "_p", "_rho", "_eta", "_t", "_c", "_d", "_m"]


def with_bng(df: DataFrame, lon: str = "lon", lat: str = "lat",
             easting: str = "easting", northing: str = "northing") -> DataFrame:
    """WGS84 degrees to national-grid metres (datum shift, then the projection series)."""
    e2 = (AIRY_A**2 - AIRY_B**2) / AIRY_A**2
    df = _to_geodetic(_shift(_to_cartesian(df, lon, lat, WGS84_A, WGS84_B), False), AIRY_A, AIRY_B)
    nu, t, d, c = F.col("_nu"), F.col("_t"), F.col("_d"), F.col("_c")
    ratio = F.col("_nu") / F.col("_rho")
    df = steps(
        df,
        {"_t": F.tan("_phi") * F.tan("_phi"), "_c": F.cos("_phi"), "_d": F.col("_lam") - math.radians(TM_LON0)},
        {
            "_nu": F.lit(AIRY_A * TM_SCALE) / F.sqrt(1 - e2 * F.sin("_phi") * F.sin("_phi")),
            "_rho": F.lit(AIRY_A * TM_SCALE * (1 - e2)) / F.pow(1 - e2 * F.sin("_phi") * F.sin("_phi"), F.lit(1.5)),
            "_m": _meridian_arc(F.col("_phi")),
        },
        {"_eta": ratio - 1},
    )
    eta = F.col("_eta")
    d2 = d * d
    return steps(df, {
        easting: TM_FALSE_E + nu * c * d * (
            1 + d2 * (c * c / 6 * (ratio - t) + d2 * F.pow(c, F.lit(4.0)) / 120 * (5 - 18 * t + t * t + 14 * eta - 58 * t * eta))),
        northing: TM_FALSE_N + F.col("_m") + nu * F.sin("_phi") * c * d2 * (
            0.5 + d2 * (c * c / 24 * (5 - t + 9 * eta) + d2 * F.pow(c, F.lit(4.0)) / 720 * (61 - 58 * t + t * t))),
    }).drop(*_TEMPS)


def with_lon_lat(df: DataFrame, easting: str = "easting", northing: str = "northing",
                 lon: str = "lon", lat: str = "lat", rounds: int = 6) -> DataFrame:
    """National-grid metres to WGS84 degrees; the footpoint latitude uses fixed rounds."""
    e2 = (AIRY_A**2 - AIRY_B**2) / AIRY_A**2
    df = df.withColumn("_phi", F.lit(math.radians(TM_LAT0)) + (F.col(northing) - TM_FALSE_N) / (AIRY_A * TM_SCALE))
    for _ in range(rounds):
        df = df.withColumn("_phi", F.col("_phi") + (F.col(northing) - TM_FALSE_N - _meridian_arc(F.col("_phi"))) / (AIRY_A * TM_SCALE))
    df = steps(
        df,
        {
            "_t": F.tan("_phi"), "_c": F.cos("_phi"), "_d": F.col(easting) - TM_FALSE_E,
            "_nu": F.lit(AIRY_A * TM_SCALE) / F.sqrt(1 - e2 * F.sin("_phi") * F.sin("_phi")),
            "_rho": F.lit(AIRY_A * TM_SCALE * (1 - e2)) / F.pow(1 - e2 * F.sin("_phi") * F.sin("_phi"), F.lit(1.5)),
        },
        {"_eta": F.col("_nu") / F.col("_rho") - 1},
    )
    t, nu, rho, eta, d = (F.col(n) for n in ("_t", "_nu", "_rho", "_eta", "_d"))
    t2, u = t * t, F.col("_d") / F.col("_nu")
    u2 = u * u
    df = steps(df, {
        "_p": F.col("_phi") - t * nu / rho * u2 * (
            0.5 - u2 / 24 * (5 + 3 * t2 + eta - 9 * t2 * eta) + u2 * u2 / 720 * (61 + 90 * t2 + 45 * t2 * t2)),
        "_lam": F.lit(math.radians(TM_LON0)) + u / F.col("_c") * (
            1 - u2 / 6 * (nu / rho + 2 * t2) + u2 * u2 / 120 * (5 + 28 * t2 + 24 * t2 * t2)),
    })
    df = df.withColumns({lat: F.degrees("_p"), lon: F.degrees("_lam")})
    df = _to_geodetic(_shift(_to_cartesian(df, lon, lat, AIRY_A, AIRY_B), True), WGS84_A, WGS84_B)
    return df.withColumns({lon: F.degrees("_lam"), lat: F.degrees("_phi")}).drop(*_TEMPS)


def with_cell_index(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Grid column, row and packed number; all null outside the grid.

    Expects the grid's ``west``, ``north``, ``res_m``, ``width`` and ``height``
    on each row.  Rows count southwards from the north edge.
    """
    x = F.floor((F.col(easting) - F.col("west")) / F.col("res_m"))
    y = F.floor((F.col("north") - F.col(northing)) / F.col("res_m"))
    inside = (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))
    return df.withColumns({"x": F.when(inside, x).cast("int"), "y": F.when(inside, y).cast("int")}).withColumn(
        "cell_no", F.col("y").cast("bigint") * F.col("width") + F.col("x"))


def with_grid_corners(grids: DataFrame) -> DataFrame:
    """Lon/lat of the four grid corners, as nw, ne, se and sw column pairs."""
    corners = {"nw": ("west", "north"), "ne": ("east", "north"), "se": ("east", "south"), "sw": ("west", "south")}
    df = grids.withColumns({
        "east": F.col("west") + F.col("width") * F.col("res_m"),
        "south": F.col("north") - F.col("height") * F.col("res_m"),
    })
    for name, (e, n) in corners.items():
        df = with_lon_lat(df, e, n, f"{name}_lon", f"{name}_lat")
    return df


def buffered_bbox(west: ColumnLike, south: ColumnLike, east: ColumnLike, north: ColumnLike,
                  metres: float) -> tuple[Column, Column, Column, Column]:
    """Grow a lon/lat box by metres, allowing for latitude; metres must lie in 0-1,000."""
    if not 0 <= metres <= 1_000:
        raise ValueError("buffer must lie between 0 and 1,000 metres")
    mid = F.radians((col(south) + col(north)) / 2)
    dlat = F.lit(metres / 111_320)
    dlon = F.lit(float(metres)) / (F.lit(111_320.0) * F.greatest(F.lit(0.1), F.cos(mid)))
    return col(west) - dlon, col(south) - dlat, col(east) + dlon, col(north) + dlat


def compass_point(azimuth_deg: ColumnLike) -> Column:
    """Nearest of eight compass points."""
    # Names clockwise from north.
    names = ["north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west"]
    turn = F.pmod(col(azimuth_deg), F.lit(360.0))
    slot = F.pmod(F.floor(turn / 45 + 0.5), F.lit(8))
    return F.element_at(F.array(*[F.lit(n) for n in names]), (slot + 1).cast("int"))
