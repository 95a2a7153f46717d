"""Whole scans: from source folders to pairs and groups, one plan per kind of file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups
from ..operators.pairs import hamming_pairs, head_tail_pairs
from ..operators.peaks import audio_pairs, constellation_of
from ..settings import AUDIO_IN_VIDEO, KINDS, Settings
from ..sources.cache import AUDIO_HASH, IMAGE_HASH, Cache
from ..sources.decoders import Decoders
from ..sources.files import classify, listing, numbered, pictures
from ..sources.media import PROBE, hashes, jvm_suffixes, picture_rows, probe, with_books
from ..storage import materialize


@dataclass
class Scan:
    """pairs: ``kind, type, a, b`` (paths); groups: ``kind, first_pair, member_ord, path``; probed: all files."""

    pairs: DataFrame
    groups: DataFrame
    probed: DataFrame


def find_images(rows: DataFrame, settings: Settings) -> DataFrame:
    return hamming_pairs(rows, settings.image_distance, settings.mask).select(F.lit("IMAGE").alias("type"), "id_a", "id_b")


def find_ebooks(rows: DataFrame, settings: Settings) -> DataFrame:
    """Covers are compared as images are, with the image distance."""
    return hamming_pairs(rows, settings.image_distance, settings.mask).select(F.lit("EBOOK").alias("type"), "id_a", "id_b")


def find_videos(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows: ``id, ord, ends``; a pair counts once, by its first band."""
    ends = rows.select("id", "ord", F.inline("ends")).where("head is not null or tail is not null")
    pairs = head_tail_pairs(ends, settings.video_distance, settings.mask)
    return pairs.groupBy("id_a", "id_b").agg(F.min_by("kind", "band").alias("kind")).select(F.concat(F.lit("VIDEO_"), "kind").alias("type"), "id_a", "id_b")


def find_audios(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows: ``id, ord, length, peaks`` in time order."""
    heard = rows.where("length > 0.1")
    hashed = heard.select("id", "ord", F.explode(constellation_of(F.col("peaks"))).alias("hash"))
    folded = materialize(hashed.groupBy("id", "ord", "hash").agg(F.count(F.lit(1)).alias("n")), "peaks")
    pairs = audio_pairs(folded, settings.audio_distance, heard.select("id", "length"), settings.ratio_mode)
    return pairs.select(F.lit("AUDIO_HEAD").alias("type"), "id_a", "id_b")


FINDERS = {"image": find_images, "video": find_videos, "audio": find_audios, "ebook": find_ebooks}


def _sound(kind: str, settings: Settings) -> bool:
    return kind == "audio" or (kind == "video" and settings.area == AUDIO_IN_VIDEO)


def gather(spark: SparkSession, roots: list[str], settings: Settings, decoders: Decoders | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Decoded files below ``roots`` with their hashes; wanted: ``path, kind`` to which they are limited.

    Images of formats that Spark's image source knows are decoded by it, all others by decoders of bytes; each
    file is read by one of them. What is not wanted is left out before it is decoded.
    """
    known = with_books(decoders)
    inside = jvm_suffixes(settings, known)
    others = tuple({s for k in KINDS for s in settings.suffixes(k) if settings.enabled(k)} - set(inside))
    if settings.area == AUDIO_IN_VIDEO and settings.proc_audio:
        others = tuple({*others, *settings.video_suffixes})
    limit = lambda df, on: df if wanted is None else df.join(wanted, on, "left_semi")
    rows = None
    if others:
        files = limit(classify(listing(spark, roots, content=True, suffixes=others), settings), ["path", "kind"])
        rows = probe(files, settings, known)
    if inside:
        sizes = limit(classify(listing(spark, roots, suffixes=inside), settings).select("path", "size", "kind"), ["path", "kind"])
        found = picture_rows(limit(pictures(spark, roots, inside), ["path"]), sizes)
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = spark.createDataFrame([], PROBE)
    return hashes(rows)


def _times(settings: Settings) -> Column:
    """(band, head, tail) seconds of the frames of a video of ``length``; null where it is not in the band."""
    whole = F.col("length").cast("int")
    parts = []
    for i, (lo, hi, seek) in enumerate(settings.bands):
        inside = whole.between(lo, hi)
        parts.append(F.struct(F.lit(i).alias("band"), F.when(inside, F.lit(float(seek))).alias("head"), F.when(inside, (whole - seek).cast("double")).alias("tail")))
    return F.array(*parts)


def cached(cache: Cache, listed: DataFrame, settings: Settings) -> DataFrame:
    """Rows as of ``gather`` for listed files (``path, size, mtime, kind``) whose hashes the cache holds whole."""
    numbers = F.lit(IMAGE_HASH)
    for kind in KINDS:
        if _sound(kind, settings):
            numbers = F.when(F.col("kind") == kind, AUDIO_HASH).otherwise(numbers)
    valid = listed.withColumn("alg", numbers).join(cache.media, ["path", "size", "mtime"])
    held = cache.hashes.groupBy("path", "alg").agg(
        F.min(F.when(F.col("at") == 0, F.col("h"))).alias("h"),
        F.collect_set(F.struct("at", "h")).alias("frames"),
        F.sort_array(F.collect_set(F.struct("t", "f"))).alias("heard"),
    )
    at = lambda when: F.get(F.filter("frames", lambda x: x["at"] == when), 0)["h"]
    has = lambda when: when.isNull() | F.exists("frames", lambda x: x["at"] == when)
    video = (F.col("kind") == "video") & (F.col("alg") == IMAGE_HASH)
    ends = F.transform(_times(settings), lambda x: F.struct(x["band"].alias("band"), at(x["head"]).alias("head"), at(x["tail"]).alias("tail")))
    whole = ~video | F.forall(_times(settings), lambda x: has(x["head"]) & has(x["tail"]))
    heard = F.transform("heard", lambda x: F.struct(x["f"].alias("f"), x["t"].alias("t")))
    return valid.join(held, ["path", "alg"]).where(whole).select(
        "path", "kind", "size", "width", "height", "length", "format",
        F.when(video | (F.col("alg") == AUDIO_HASH), None).otherwise(F.col("h")).alias("h"),
        F.when(video, ends).alias("ends"),
        F.when(F.col("alg") == AUDIO_HASH, heard).alias("peaks"),
    )


def to_cache(found: DataFrame, listed: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Media and hash rows of gathered files, as the cache holds them."""
    dated = found.join(listed.select("path", "mtime").distinct(), "path")
    media = dated.groupBy("path", "size", "mtime").agg(*[F.max(c).alias(c) for c in ("width", "height", "length", "format")])
    still = found.where("kind in ('image', 'ebook') and h is not null").select("path", F.lit(0.0).alias("at"), "h")
    frames = found.where("kind = 'video' and ends is not null").select("path", F.explode(F.arrays_zip(_times(settings).alias("w"), F.col("ends").alias("e"))).alias("x"))
    both = F.explode(F.array(F.struct(F.col("x.w.head").alias("at"), F.col("x.e.head").alias("h")), F.struct(F.col("x.w.tail").alias("at"), F.col("x.e.tail").alias("h"))))
    moving = frames.select("path", both.alias("y")).select("path", "y.*").where("at is not null")
    sounds = found.where("peaks is not null").select("path", F.inline("peaks")).distinct()
    seen = still.unionByName(moving).withColumn("alg", F.lit(IMAGE_HASH)).distinct()
    none = [F.lit(None).cast("int").alias(c) for c in ("f", "t")]
    return media, seen.select("path", "at", "h", *none, "alg").unionByName(sounds.select("path", F.col("t").cast("double").alias("at"), F.lit(None).cast("long").alias("h"), "f", "t", F.lit(AUDIO_HASH).alias("alg")))


def scan(spark: SparkSession, roots: list[str], settings: Settings | None = None, decoders: Decoders | None = None, cache: Cache | None = None) -> Scan:
    """Find near duplicates below ``roots``. Files are decoded once; only hashes are kept.

    cache: files that it holds unchanged are not decoded, and the others' hashes go into it (an unreadable
    file has none, and is tried again). With area 5 videos are compared by their sound instead of their
    frames, and once more together with the audio files if these are looked for; decoders under the videos'
    suffixes in ``decoders.audio`` read it.
    """
    settings = settings or Settings()
    columns = ["path", "kind", "size", "width", "height", "length", "format", "h", "ends", "peaks"]
    if cache is None:
        probed = materialize(gather(spark, roots, settings, decoders), "probed")
    else:
        listed = materialize(classify(listing(spark, roots), settings), "listed")
        hits = materialize(cached(cache, listed, settings), "hits")
        wanted = materialize(listed.join(hits, ["path", "kind"], "left_anti").select("path", "kind"), "misses")
        new = materialize(gather(spark, roots, settings, decoders, wanted).select(*columns), "decoded")
        probed = materialize(hits.unionByName(new), "probed")
        # a file's other kinds are written again with the new ones
        cache.replace(*to_cache(probed.join(wanted.select("path").distinct(), "path", "left_semi"), listed, settings))
    rows = materialize(numbered(probed).withColumn("id", F.xxhash64("kind", "path")), "numbered")
    found = None
    for i, (kind, finder) in enumerate(FINDERS.items()):
        if not settings.enabled(kind):
            continue
        if kind == "video" and settings.area == AUDIO_IN_VIDEO:
            finder = find_audios
        pairs = finder(rows.where(F.col("kind") == kind), settings).withColumn("kind", F.lit(kind)).withColumn("pass", F.lit(i))
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = spark.createDataFrame([], "type string, id_a long, id_b long, kind string, pass int")
    names = rows.select("id", "path", "ord")
    a = names.select(F.col("id").alias("id_a"), F.col("path").alias("a"), F.col("ord").alias("ord_a"))
    b = names.select(F.col("id").alias("id_b"), F.col("path").alias("b"), F.col("ord").alias("ord_b"))
    pairs = materialize(found.join(a, "id_a").join(b, "id_b"), "pairs")
    grouped = groups.greedy_groups(pairs, ["pass", "ord_a", "ord_b"]).join(names.select("id", "path"), "id")
    return Scan(pairs.select("kind", "type", "a", "b"), grouped.select("kind", "first_pair", "member_ord", "path"), probed)
