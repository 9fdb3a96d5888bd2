import datetime as dt

import pytest
from pyspark.sql import functions as F

from umbraline.functions import civil, geo, heights, lookups, solar, text
from umbraline.functions.basics import half_up


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_half_up_moves_halves_up(spark):
    row = one(spark, a=half_up(F.lit(-2.5)), b=half_up(F.lit(2.5)), c=half_up(F.lit(1.2345), 3))
    assert (row.a, row.b, row.c) == (-2, 3, 1.235)


def test_exceedance_and_required_height(spark):
    f = lambda r: heights.triangular_exceedance(F.lit(float(r)), F.lit(6.0), F.lit(10.0), F.lit(14.0))
    row = one(spark, a=f(8), b=f(10), c=f(12), d=f(6), e=f(14), need=heights.required_height(F.lit(10.0), F.lit(45.0)))
    assert [row.a, row.b, row.c, row.d, row.e] == pytest.approx([0.875, 0.5, 0.125, 1, 0])
    assert row.need == pytest.approx(11.5)


@pytest.mark.parametrize("tag, metres", [("12", 12), ("12.5 m", 12.5), ("10 Metres", 10), ("40ft", 12.19), ("6'", 1.83), ("6' 6\"", 1.98),
                                         ("6' 12\"", None), ("-3", None), ("0", None), ("1001", None), ("tall", None), ("", None)])
def test_height_tags(spark, tag, metres):
    assert one(spark, h=heights.parsed_height_m(F.lit(tag))).h == metres


def test_midsummer_sun_over_london(spark):
    ms = int(dt.datetime(2026, 6, 21, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)
    row = solar.with_solar_position(spark.range(1).select(F.lit(ms).alias("epoch_ms"), F.lit(-0.12).alias("lon"), F.lit(51.505).alias("lat"))).first()
    assert 60 < row.altitude_deg < 63 and 175 < row.azimuth_deg < 190 and row.daylight
    night = solar.with_solar_position(spark.range(1).select(F.lit(ms - 12 * 3_600_000).alias("epoch_ms"), F.lit(-0.12).alias("lon"), F.lit(51.505).alias("lat"))).first()
    assert not night.daylight


def test_national_grid_control_point_and_round_trip(spark):
    # Published control point (Caister water tower); the seven-parameter shift is good to about five metres.
    df = spark.createDataFrame([(1.716073973, 52.658007833), (-0.12326, 51.53046), (-3.2, 55.95)], "lon double, lat double")
    placed = geo.with_bng(df)
    first = placed.first()
    assert abs(first.easting - 651409.8) < 5 and abs(first.northing - 313177.4) < 5
    back = geo.with_lon_lat(placed.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}))
    for row in back.collect():
        assert abs(row.lon - row.lon0) < 1e-7 and abs(row.lat - row.lat0) < 1e-7


def test_haversine_forms_agree_and_null_stays_null(spark):
    row = one(spark, a=geo.haversine_m(F.lit(51.5), F.lit(-0.12), F.lit(51.51), F.lit(-0.1)),
              b=geo.haversine_m(F.lit(51.5), F.lit(-0.12), F.lit(51.51), F.lit(-0.1), form="atan2"),
              n=geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert row.a == pytest.approx(row.b) and 1700 < row.a < 1900 and row.n is None


def test_local_plane_wraps_and_stops_at_poles(spark):
    x, y = geo.local_xy(F.lit(10.0), F.lit(-179.9), F.lit(10.0), F.lit(179.9))
    lat, lon = geo.local_lat_lon(F.lit(5.0), F.lit(5.0), F.lit(90.0), F.lit(0.0))
    row = one(spark, x=x, y=y, lon=lon)
    assert 21_000 < row.x < 22_500 and row.y == 0 and row.lon is None


def test_cell_index_borders(spark):
    grid = {"west": 0.0, "north": 40.0, "res_m": 4.0, "width": 10, "height": 10}
    df = spark.createDataFrame([(0.0, 40.0), (4.0, 36.0), (40.0, 20.0), (-0.001, 20.0), (5.0, 40.001)], "easting double, northing double")
    rows = geo.with_cell_index(df.withColumns({k: F.lit(v) for k, v in grid.items()})).collect()
    assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 1), (None, None), (None, None), (None, None)]
    assert [r.cell_no for r in rows] == [0, 11, None, None, None]


def test_buffer_limits():
    with pytest.raises(ValueError):
        geo.buffered_bbox("a", "b", "c", "d", 1_001)


@pytest.mark.parametrize("degrees, name", [(0, "north"), (22.4, "north"), (22.5, "north-east"), (180, "south"), (359, "north"), (-90, "west")])
def test_compass(spark, degrees, name):
    assert one(spark, c=geo.compass_point(F.lit(float(degrees)))).c == name


@pytest.mark.parametrize("local, utc", [("2026-01-15T12:00", "2026-01-15 12:00"), ("2026-07-15T12:00", "2026-07-15 11:00"), ("2026-03-29T01:30", None),
                                        ("2026-10-25T01:30", "2026-10-25 00:30"), ("2026-02-30T12:00", None), ("2026-1-15T12:00", None)])
def test_local_time(spark, local, utc):
    row = one(spark, t=F.date_format(civil.instant_from_local(F.lit(local)), "yyyy-MM-dd HH:mm"))
    assert row.t == utc


def test_default_departure(spark):
    f = lambda s: civil.default_departure(F.lit(s).cast("timestamp"))
    row = one(spark, a=f("2026-07-01 08:07:00"), b=f("2026-07-01 03:00:00"), c=f("2026-01-01 18:59:00"), d=f("2026-01-01 10:45:00"))
    assert [row.a, row.b, row.c, row.d] == ["2026-07-01T09:15", "2026-07-01T14:30", "2026-01-01T19:00", "2026-01-01T10:45"]


def test_minutes_of_day(spark):
    f = civil.minutes_of_day
    row = one(spark, a=f(F.lit("2026-01-01T10:30")), b=f(F.lit("2026-01-01T10:30:15.5")), c=f(F.lit("2026-02-30T10:30")), d=f(F.lit("2026-01-01T24:00")),
              e=civil.local_at_minutes(F.lit("2026-01-01"), F.lit(5000)), g=civil.local_at_minutes(F.lit("2026-01-01"), F.lit(-4)))
    assert [row.a, row.b, row.c, row.d, row.e, row.g] == [630, 630, None, None, "2026-01-01T23:45", "2026-01-01T00:00"]


def test_text(spark):
    row = one(spark, a=text.place_query(F.lit("  Ｋing’s ‮ cross ")), b=text.place_query(F.lit("ab")), c=text.kind_title(F.lit("bus_stop"), "x"),
              d=text.kind_title(F.lit(""), "Named place"), e=text.usable_name(F.lit("Unknown"), F.lit(" Oak  tree ")), f=text.spreadsheet_safe(F.lit(" =1+1")),
              g=text.opaque_id("os", F.lit("abc")), h=text.bounded_text(F.lit("a\u0001b   c")))
    assert row.a == "King’s cross" and row.b is None and row.c == "Bus Stop" and row.d == "Named place" and row.e == "Oak tree" and row.f == "' =1+1"
    assert row.h == "a b c"
    value = 2166136261
    for ch in "abc":
        value = ((value ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while value:
        value, d = divmod(value, 36)
        out = digits[d] + out
    assert row.g == "os-" + out


def test_lookups(spark):
    kind, shown = lookups.extra_time_kind(F.lit(659.0), F.lit(600.0))
    row = one(spark, p=lookups.pace_duration(F.lit(100.0), F.lit("slow")), q=lookups.pace_duration(F.lit(100.0), F.lit("crawl")), k=kind, s=shown,
              b=lookups.duration_bucket(F.lit(3999.9)), c=lookups.duration_bucket(F.lit(-1)), r=lookups.reported_state(F.lit("predicted-correct"), F.lit("uncertain")))
    assert (row.p, row.q, row.k, row.s, row.b, row.c, row.r) == (150.0, 100.0, "minutes", 1, "1_to_3_999_s", None, "not-recorded")
