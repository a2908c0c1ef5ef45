"""Scalar text functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation  # ASCII only: curly quotes and dashes stay
WORD_SPLIT = r"[ \t\r\n\f\x0B]+"


def strip_punct(word: Column) -> Column:
    """Strip ASCII punctuation from both ends; inner punctuation stays."""
    return F.btrim(word, F.lit(PUNCTUATION))


def split_words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def fmt_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB (base 1024); bytes without decimals, the rest with one,
    ties to even."""
    out = F.format_string("%.1f TB", F.bround(n / float(1024**4), 1))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def fmt_dir(host: Column, container: Column) -> Column:
    """The host's path or else the container's, with exactly one slash at its end."""
    return F.concat(F.rtrim(F.coalesce(host, container), F.lit("/")), F.lit("/"))


def job_id(path: Column, mtime: Column) -> Column:
    """First 12 hex digits of the SHA-256 of ``path:mtime``; independent of content."""
    return F.substring(F.sha2(F.concat_ws(":", path, mtime), 256), 1, 12)


def slug(stem: Column) -> Column:
    """Lower case with ``-`` between runs of letters and digits; beyond 32 characters the first 33 are cut
    at their last ``-`` (33 characters without one stay)."""
    plain = F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.substring(plain, 1, 33)
    cut = F.regexp_extract(head, "^(.*)-", 1)
    return F.when(F.length(plain) <= 32, plain).otherwise(F.when(F.instr(head, "-") > 0, cut).otherwise(head))


def edition_name(stem: Column, style: Column, edition: Column, suffix: Column, ext: Column) -> Column:
    """Output name: ``plex_edition`` puts `` {edition-X}`` after the first ``(YYYY)``, or at the end;
    ``suffix`` appends the suffix. Any other style is an error."""
    tag = F.concat(F.lit(" {edition-"), edition, F.lit("}"))
    year = r"^(.*?\(\d{4}\))(.*)$"
    plex = F.when(stem.rlike(year), F.concat(F.regexp_extract(stem, year, 1), tag, F.regexp_extract(stem, year, 2))).otherwise(F.concat(stem, tag))
    name = F.when(F.lower(style) == "plex_edition", plex).when(F.lower(style) == "suffix", F.concat(stem, suffix))
    return F.concat(name.otherwise(F.raise_error(F.concat(F.lit("unknown naming style: "), style)).cast("string")), F.lit("."), ext)


def safe_int(text: Column) -> Column:
    """Text as a long, null if it isn't one."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text)).try_cast("long")
