"""Which settings of a table of streams break their rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a setting is where none is given; fixed values.
DEFAULTS = {
    "primary": "webrtc", "fallback": "mjpeg", "codec": "h264", "bitrate_kbps": 2500, "keyframe_interval_frames": 30, "max_peers_per_stream": 2, "ice_gathering_timeout_ms": 2000, "session_idle_timeout_s": 30,
}


def rules() -> dict[str, Column]:
    """By setting, whether it holds."""
    of = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    return {
        "primary": of["primary"].isin("webrtc", "mjpeg"), "fallback": of["fallback"].isin("mjpeg", "none"), "codec": of["codec"] == "h264",
        **{c: of[c] > 0 for c in ("bitrate_kbps", "keyframe_interval_frames", "max_peers_per_stream", "session_idle_timeout_s")},
        "ice_gathering_timeout_ms": of["ice_gathering_timeout_ms"].between(250, 10_000),
        # a stream by network needs an address, and one with profiles of output a rate
        "url": (F.coalesce(F.col("type"), F.lit("")) != "rtsp") | (F.coalesce(F.col("url"), F.lit("")) != ""), "fps": (F.coalesce(F.col("n_profiles"), F.lit(0)) == 0) | (F.coalesce(F.col("fps"), F.lit(0)) > 0),
    }


def with_problems(streams: DataFrame) -> DataFrame:
    """Adds problems, the names of the settings that break their rule, and valid; a setting that isn't given has its default."""
    found = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules().items()]))
    return streams.withColumn("problems", found).withColumn("valid", F.size("problems") == 0)
