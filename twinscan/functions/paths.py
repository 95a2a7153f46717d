"""Scalar functions on paths, sizes and times."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import AUDIO_IN_VIDEO, KINDS, Settings


def suffix(path: Column) -> Column:
    """Lower-case text behind the path's last dot, null without one; a folder's dot counts too."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))


def is_kind(path: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the suffix is one of ``suffixes``."""
    return F.coalesce(suffix(path).isin(*suffixes), F.lit(False)) if suffixes else F.lit(False)


def kinds(path: Column, settings: Settings) -> Column:
    """All enabled kinds of a path, array<string>; area 5 lists videos as audio as well."""
    found = []
    for kind in KINDS:
        test = is_kind(path, settings.suffixes(kind)) if settings.enabled(kind) else F.lit(False)
        if kind == "audio" and settings.area == AUDIO_IN_VIDEO and settings.enabled("audio"):
            test = test | is_kind(path, settings.video_suffixes)
        found.append(F.when(test, F.lit(kind)))
    return F.array_compact(F.array(*found))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """What stands before the last slash; "." without one, "/" for files of the root."""
    n = F.length(path) - F.length(base_name(path)) - 1
    return F.when(~F.contains(path, F.lit("/")), ".").when(n == 0, "/").otherwise(F.substring(path, F.lit(1), n))


def _tenths(size: Column, power: int) -> Column:
    """Tenths of size / 1000**power, rounded as a double is printed with one place.

    Whole numbers decide unless the quotient lies half way. Then the nearest double may be above or
    below, which twice its high and low halves tell exactly; a double that is half way goes to even.
    """
    unit = 1000**power
    tenths = F.call_function("div", size, F.lit(unit // 10))
    rest = (size % (unit // 10)) * 20
    x = size.cast("double") / F.lit(float(unit))
    high = x.cast("float").cast("double")
    off = (high * 20 - (tenths * 2 + 1).cast("double")) + (x - high) * 20
    half = F.when(off > 0, 1).when(off < 0, 0).otherwise(tenths % 2)
    return tenths + F.when(rest > unit, 1).when(rest < unit, 0).otherwise(half)


def human_size(size: Column) -> Column:
    """Bytes in decimal units with one place, rounded: ``1 byte``, ``12 bytes``, ``1.5 kB``, ``2.0 MB``."""
    out = F.when(size == 1, "1 byte").when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
    units = ("kB", "MB", "GB", "TB", "PB", "EB")
    for power, unit in enumerate(units, 1):
        tenths = _tenths(size, power)
        text = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(size < F.lit(1000 ** (power + 1)), text) if power < len(units) else out.otherwise(text)
    return out


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def real_path(path: str) -> str:
    """A source path as an absolute one; ``~`` is the home folder. URIs stay."""
    return path if "://" in path else os.path.realpath(os.path.expanduser(path))
