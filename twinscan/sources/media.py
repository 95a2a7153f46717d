"""From files to hash rows: decoding in Arrow batches, one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import SIDE, average_hash, dct_hashes
from ..settings import AUDIO_IN_VIDEO, Settings
from . import ebooks, sound
from .decoders import JPEG, Decoders, grays, image_suffix, read_png

PROBE = "path string, kind string, size long, width int, height int, length double, format string, grid array<int>, grid_tail array<array<int>>, peaks array<struct<f:int,t:int>>, ph long, ph_tail array<long>"
#: Suffixes that Spark's image source decodes.
IN_JVM = ("bmp", "gif", "jpeg", "jpg", "jpe", "png", "tif")


def jvm_suffixes(settings: Settings, decoders: Decoders) -> tuple[str, ...]:
    """Image suffixes that are decoded in the JVM: those for which the caller gave no decoder of their own."""
    own = {s for s, read in decoders.image.items() if read is not read_png}
    own |= set(JPEG) if own & set(JPEG) else set()
    return tuple(s for s in settings.image_suffixes if s in IN_JVM and s not in own) if settings.proc_image else ()


def _dct(px: np.ndarray) -> int:
    return int(dct_hashes(np.array(grays(px, SIDE), float).reshape(1, SIDE, SIDE))[0])


def with_books(decoders: Decoders | None = None) -> Decoders:
    found = decoders or Decoders()
    found.ebook = {**ebooks.BOOKS, **found.ebook}
    return found


def probe(files: DataFrame, settings: Settings, decoders: Decoders | None = None) -> DataFrame:
    """Decode ``path, kind, size, content``: size, duration, format and what hashes are made of.

    grid: 64 grays of an image, a cover, or (per band, in ``grid_tail`` as head, tail pairs) of video
    frames; ph, ph_tail: their DCT hashes, of 32 x 32 grays; peaks: of sound. A file that no decoder reads
    has nulls, so it never matches.
    """
    known, bands = with_books(decoders), settings.bands

    def image(data: bytes, path: str) -> tuple | None:
        read = known.of("image", path)
        px = read(data) if read else None
        return None if px is None else (px.shape[1], px.shape[0], grays(px, 8), _dct(px))

    def one(path: str, kind: str, size: int, content: bytes) -> tuple:
        row = {"width": None, "height": None, "length": None, "format": path.rpartition(".")[2].lower(), "grid": None, "grid_tail": None, "peaks": None, "ph": None, "ph_tail": None}
        if kind == "image":
            if got := image(content, path):
                row["width"], row["height"], row["grid"], row["ph"] = got
        elif kind == "ebook":
            read = known.of("ebook", path)
            cover = read(content) if read else None
            if cover and (got := image(cover, f"cover.{image_suffix(cover)}")):
                row["grid"], row["ph"] = got[2:]
        elif kind == "video" and settings.area != AUDIO_IN_VIDEO:
            read = known.of("video", path)
            if read and (v := read(content)):
                row |= {"length": float(int(v.length)), "width": v.width, "height": v.height, "format": v.format}
                frames, hashed = [], []
                for lo, hi, seek in bands:
                    if lo <= int(v.length) <= hi:
                        for at in (seek, int(v.length) - seek):
                            px = v.frame(at)
                            frames.append(None if px is None else grays(px, 8))
                            hashed.append(None if px is None else _dct(px))
                    else:
                        frames += [None, None]
                        hashed += [None, None]
                row["grid_tail"], row["ph_tail"] = frames, hashed
        elif kind in ("audio", "video"):
            # with area 5 videos are compared by their sound, and have no frames
            read = known.of("audio", path)
            if read and (s := read(content)):
                row["length"] = s.length
                row["peaks"] = [{"f": f, "t": t} for f, t in sound.peaks(sound.spectrum(s.samples), s.length)] if s.length > 0.1 else None
        return (path, kind, size, *row.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "size", "width", "height", "length", "format", "grid", "grid_tail", "peaks", "ph", "ph_tail"]
        for pdf in batches:
            rows = [one(*r) for r in pdf[["path", "kind", "size", "content"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32", "ph": "Int64"})

    # files are large: few in a batch
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return files.select("path", "kind", "size", "content").mapInPandas(run, PROBE)


def picture_rows(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same as ``probe`` for images that the JVM has decoded. sizes: ``path, size, kind`` of all images;
    those without pixels have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, w, h, n, data in pdf.itertuples(index=False):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                px = px[:, :, 2::-1] if n >= 3 else np.repeat(px[:, :, :1], 3, 2)
                rows.append((path, w, h, grays(px, 8), _dct(px)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "grid", "ph"])

    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    read = found.mapInPandas(run, "path string, width int, height int, grid array<int>, ph long")
    name = F.lower(F.substring_index("path", ".", -1)).alias("format")
    held = sizes.join(read, "path", "left").select("path", "kind", "size", "width", "height", F.lit(None).cast("double").alias("length"), name, "grid", "ph")
    rest = [c.strip() for c in ("grid_tail array<array<int>>", "peaks array<struct<f:int,t:int>>", "ph_tail array<long>")]
    nulls = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in rest]
    return held.select("*", *nulls).select("path", "kind", "size", "width", "height", "length", "format", "grid", "grid_tail", "peaks", "ph", "ph_tail")


def hashes(probed: DataFrame) -> DataFrame:
    """Adds ``h``, the average hash of the grid, and ``ends``: (band, head, tail) hashes of frames."""
    ends = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("grid_tail") / 2).cast("int") - 1),
        lambda i: F.struct(i.alias("band"), average_hash(F.get("grid_tail", 2 * i)).alias("head"), average_hash(F.get("grid_tail", 2 * i + 1)).alias("tail")),
    )
    return probed.withColumn("h", average_hash(F.col("grid"))).withColumn("ends", F.when(F.col("grid_tail").isNotNull(), ends))
