"""Solar position from the published low-precision NOAA equations, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .basics import clamp, steps


def with_solar_position(df: DataFrame, epoch_ms: str = "epoch_ms", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``azimuth_deg`` (clockwise from north), ``altitude_deg`` and ``daylight``."""
    ms, lng, lt = F.col(epoch_ms).cast("double"), F.col(lon), F.col(lat)
    t = F.col("_t")
    df = steps(
        df,
        {"_t": (ms / 86_400_000 + 2_440_587.5 - 2_451_545) / 36_525},
        {
            "_l0": F.pmod(280.46646 + t * (36_000.76983 + t * 0.0003032), F.lit(360.0)),
            "_m": F.radians(357.52911 + t * (35_999.05029 - 0.0001537 * t)),
            "_e": 0.016708634 - t * (0.000042037 + 0.0000001267 * t),
            "_om": F.radians(125.04 - 1934.136 * t),
            "_ob": 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60,
        },
        {
            "_ctr": F.sin("_m") * (1.914602 - t * (0.004817 + 0.000014 * t))
            + F.sin(2 * F.col("_m")) * (0.019993 - 0.000101 * t) + F.sin(3 * F.col("_m")) * 0.000289,
            "_obr": F.radians(F.col("_ob") + 0.00256 * F.cos("_om")),
            "_l0r": F.radians("_l0"),
        },
        {
            "_dec": F.asin(F.sin("_obr") * F.sin(F.radians(F.col("_l0") + F.col("_ctr") - 0.00569 - 0.00478 * F.sin("_om")))),
            "_y": F.tan(F.col("_obr") / 2) * F.tan(F.col("_obr") / 2),
        },
        {
            "_eot": 4 * F.degrees(
                F.col("_y") * F.sin(2 * F.col("_l0r")) - 2 * F.col("_e") * F.sin("_m")
                + 4 * F.col("_e") * F.col("_y") * F.sin("_m") * F.cos(2 * F.col("_l0r"))
                - 0.5 * F.col("_y") * F.col("_y") * F.sin(4 * F.col("_l0r"))
                - 1.25 * F.col("_e") * F.col("_e") * F.sin(2 * F.col("_m"))),
        },
        # Minutes of the UTC day come straight from the instant.
        {"_ha": F.pmod(F.pmod(ms, F.lit(86_400_000.0)) / 60_000 + F.col("_eot") + 4 * lng, F.lit(1440.0)) / 4 - 180},
        {"_ha": F.radians(F.when(F.col("_ha") < -180, F.col("_ha") + 360).otherwise(F.col("_ha"))), "_lat": F.radians(lt)},
        {
            "altitude_deg": F.degrees(F.asin(clamp(
                F.sin("_lat") * F.sin("_dec") + F.cos("_lat") * F.cos("_dec") * F.cos("_ha"), -1.0, 1.0))),
            "azimuth_deg": F.pmod(F.degrees(F.atan2(
                F.sin("_ha"), F.cos("_ha") * F.sin("_lat") - F.tan("_dec") * F.cos("_lat"))) + 180, F.lit(360.0)),
        },
        {"daylight": F.col("altitude_deg") > 0},
    )
    return df.drop("_t", "_l0", "_m", "_e", "_om", "_ob", "_ctr", "_obr", "_l0r", "_dec", "_y", "_eot", "_ha", "_lat")
