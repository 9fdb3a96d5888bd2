"""A small synthetic elevation pack on the national grid."""

from umbraline.functions.geo import with_lon_lat

WEST, NORTH, SIDE = 530_000.0, 180_400.0, 75


def flat_pack(spark, wall_row: int):
    """(cells, grids, function from metres east of west and south of north to lon/lat): flat ground, one 40 m wall."""
    rows = []
    for y in range(SIDE):
        for x in range(SIDE):
            top = 40.0 if y in (wall_row + 3, wall_row + 4) else 0.0
            rows.append(("g", x, y, y * SIDE + x, 0, 255, 0.0, top, top))
    cells = spark.createDataFrame(rows, "area_id string, x int, y int, cell_no int, height_steps int, validity int, terrain double, surf_min double, surf_max double")
    grids = spark.createDataFrame([("g", SIDE, SIDE, WEST, NORTH, 4.0, 0.5, 40.0)],
                                  "area_id string, width int, height int, west double, north double, res_m double, step_m double, max_surface_m double")

    def lonlat(east, south):
        p = with_lon_lat(spark.createDataFrame([(WEST + east, NORTH - south)], "easting double, northing double")).first()
        return p.lon, p.lat

    return cells, grids, lonlat
