"""Plans for audio streams: file extensions, layouts and encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extension of each codec.
EXTENSIONS = {
    "aac": ".aac", "ac3": ".ac3", "eac3": ".eac3", "dts": ".dts", "mp3": ".mp3", "flac": ".flac", "truehd": ".truehd", "mlp": ".mlp",
    "vorbis": ".ogg", "opus": ".opus", "pcm_s16le": ".wav", "pcm_s24le": ".wav", "pcm_s32le": ".wav", "wmav2": ".wma",
}
#: Encoder of each codec.
ENCODERS = {
    "aac": "aac", "ac3": "ac3", "eac3": "eac3", "dts": "dca", "mp3": "libmp3lame", "flac": "flac", "vorbis": "libvorbis", "opus": "libopus",
    "wmav2": "wmav2", "pcm_s16le": "pcm_s16le", "pcm_s24le": "pcm_s16le", "pcm_s32le": "pcm_s16le",
}
#: Bits per second of each encoder where the stream names none.
BITRATES = {"aac": 192_000, "ac3": 448_000, "eac3": 448_000, "dca": 1_509_000, "libmp3lame": 320_000, "libvorbis": 192_000, "libopus": 128_000, "wmav2": 192_000}
#: Layout by number of channels.
LAYOUTS = {1: "mono", 2: "stereo", 6: "5.1", 8: "7.1"}
FALLBACK, FALLBACK_MOST, DEFAULT_RATE, DEFAULT_BITRATE = "ac3", 640_000, 44_100, 192_000
NO_ENCODER = ("truehd", "mlp")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def codec_ext(codec: Column) -> Column:
    """File extension of a codec, ``.codec`` for others."""
    return F.coalesce(_lookup(EXTENSIONS, codec), F.concat(F.lit("."), codec))


def layout_default(streams: DataFrame) -> DataFrame:
    """channels (absent or 0: 2), channel_layout (absent or unknown: by channels, else stereo) and
    sample_rate (absent: 44100) filled in."""
    filled = streams.withColumn("channels", F.coalesce(F.nullif(F.col("channels"), F.lit(0)), F.lit(2)))
    layout = F.when(F.lower("channel_layout") == "unknown", None).otherwise(F.nullif(F.col("channel_layout"), F.lit("")))
    filled = filled.withColumn("channel_layout", F.coalesce(layout, _lookup(LAYOUTS, F.col("channels")), F.lit("stereo")))
    return filled.withColumn("sample_rate", F.coalesce(F.nullif(F.col("sample_rate"), F.lit(0)), F.lit(DEFAULT_RATE)))


def encoder_plan(streams: DataFrame) -> DataFrame:
    """encoder, bitrate and fallback_reason for streams (codec, profile, bit_rate as text)."""
    from ..functions.text import safe_int

    codec = F.lower(F.coalesce("codec", F.lit("unknown")))
    profile = F.coalesce("profile", F.lit(""))
    rate = F.nullif(safe_int(F.col("bit_rate")), F.lit(0).cast("long"))
    lossless_only = codec.isin(*NO_ENCODER) | ((codec == "dts") & F.contains(F.lower(profile), F.lit("ma")))
    encoder = _lookup(ENCODERS, codec)
    capped = F.least(F.coalesce(rate, F.lit(FALLBACK_MOST).cast("long")), F.lit(FALLBACK_MOST).cast("long"))
    named = F.concat(codec, F.when(profile != "", F.concat(F.lit(" ("), profile, F.lit(")"))).otherwise(F.lit("")))
    reason = F.when(lossless_only, F.concat(named, F.lit(": no encoder keeps it lossless"))).when(encoder.isNull(), F.concat(F.lit("unknown codec: "), codec))
    fallback = lossless_only | encoder.isNull()
    plain = F.when((encoder == "flac") | F.startswith(encoder, F.lit("pcm_")), F.lit(0).cast("long")).otherwise(F.coalesce(rate, _lookup(BITRATES, encoder).cast("long"), F.lit(DEFAULT_BITRATE).cast("long")))
    return streams.withColumns({"encoder": F.when(fallback, F.lit(FALLBACK)).otherwise(encoder), "bitrate": F.when(fallback, capped).otherwise(plain), "fallback_reason": reason})
