"""Settings of a scan, with their defaults, read from and written to key files.

A stored similarity is a rate from 1 to 10; the distance is 10 less the rate.
"""

from __future__ import annotations

import configparser
from dataclasses import dataclass, replace

# Suffixes by kind.
IMAGE_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "jpe", "png", "pcx", "pnm", "tif", "tga", "xpm", "ico", "cur", "ani")
VIDEO_SUFFIXES = ("avi", "mp4", "mpg", "rmvb", "rm", "mov", "mkv", "m4v", "mpeg", "vob", "asf", "wmv", "3gp", "flv", "mod", "swf", "mts", "m2ts", "ts")
AUDIO_SUFFIXES = ("mp3", "wma", "wav", "ogg", "amr", "m4a", "mka", "aac")
EBOOK_SUFFIXES = ("pdf", "epub")
# Fixed values: (least, greatest duration in seconds, offset from the ends at which frames are taken).
DURATION_BANDS = ((10, 120, 4), (60, 600, 25), (300, 3000, 120), (1500, 28800, 600))
# Share of peaks (percent) that must agree, by audio distance 0 to 9.
PEAK_RATES = (100, 90, 80, 50, 20, 10, 5, 2, 1, 0)
# Longest to shortest duration allowed, by filter mode 0 to 5.
RATIO_MODES = (0, 1, 2, 10, 20, 100)
# Bits of the hash that each compare area looks at; None compares all 64.
AREA_MASKS = (None, 0xFFFFFF00, 0x00FFFFFF, 0xFCFCFCFC, 0x3F3F3F3F, None)
KINDS = {"image": 1, "video": 2, "audio": 3, "ebook": 4}
AUDIO_IN_VIDEO = 5


@dataclass(frozen=True)
class Settings:
    """What a scan looks for. ``area`` 5 also listens to the sound of videos."""

    proc_image: bool = False
    proc_video: bool = True
    proc_audio: bool = True
    proc_ebook: bool = False
    image_suffixes: tuple[str, ...] = IMAGE_SUFFIXES
    video_suffixes: tuple[str, ...] = VIDEO_SUFFIXES
    audio_suffixes: tuple[str, ...] = AUDIO_SUFFIXES
    ebook_suffixes: tuple[str, ...] = EBOOK_SUFFIXES
    area: int = 0
    ratio_mode: int = 0
    frames: int = 4
    image_distance: int = 6
    video_distance: int = 8
    audio_distance: int = 2
    bands: tuple[tuple[int, int, int], ...] = DURATION_BANDS
    directories: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 0 <= self.audio_distance < len(PEAK_RATES):
            raise ValueError(f"audio_distance must be 0 to {len(PEAK_RATES) - 1}")
        if not 0 <= self.area < len(AREA_MASKS):
            raise ValueError(f"area must be 0 to {len(AREA_MASKS) - 1}")
        if not 0 <= self.ratio_mode < len(RATIO_MODES):
            raise ValueError(f"ratio_mode must be 0 to {len(RATIO_MODES) - 1}")

    @property
    def mask(self) -> int | None:
        return AREA_MASKS[self.area]

    def suffixes(self, kind: str) -> tuple[str, ...]:
        return getattr(self, f"{kind}_suffixes")

    def enabled(self, kind: str) -> bool:
        return getattr(self, f"proc_{kind}")


# Names of the keys in the file, group "_".
_FLAGS = ("proc_image", "proc_video", "proc_audio", "proc_ebook")
_RATES = {"same_image_rate": "image_distance", "same_video_rate": "video_distance", "same_audio_rate": "audio_distance"}
_NUMBERS = {"compare_area": "area", "filter_time_rate": "ratio_mode", "compare_count": "frames"}
_LISTS = {"image_ext": "image_suffixes", "video_ext": "video_suffixes", "audio_ext": "audio_suffixes", "ebook_ext": "ebook_suffixes"}
_DIRECTORIES = "directories"


def load(path: str, base: Settings | None = None) -> Settings:
    """Settings from a key file; what it lacks keeps the default, a missing file all.

    Suffixes are divided by commas, folders by semicolons. A key for a number of threads is
    ignored: Spark's tasks take its place.
    """
    parser = configparser.ConfigParser(interpolation=None)
    parser.read(path)
    found = base or Settings()
    if not parser.has_section("_"):
        return found
    group = parser["_"]
    change: dict = {n: group.getboolean(n) for n in _FLAGS if n in group}
    change |= {field: tuple(x for x in group[n].split(",") if x) for n, field in _LISTS.items() if n in group}
    change |= {field: group.getint(n) for n, field in _NUMBERS.items() if n in group}
    change |= {field: 10 - group.getint(n) for n, field in _RATES.items() if n in group}
    if _DIRECTORIES in group:
        change["directories"] = tuple(x for x in group[_DIRECTORIES].split(";") if x)
    return replace(found, **change)


def save(settings: Settings, path: str) -> None:
    parser = configparser.ConfigParser(interpolation=None)
    parser["_"] = (
        {n: str(getattr(settings, n)).lower() for n in _FLAGS}
        | {n: ",".join(getattr(settings, field)) for n, field in _LISTS.items()}
        | {n: str(getattr(settings, field)) for n, field in _NUMBERS.items()}
        | {n: str(10 - getattr(settings, field)) for n, field in _RATES.items()}
        | {_DIRECTORIES: ";".join(settings.directories)}
    )
    with open(path, "w") as out:
        parser.write(out)
