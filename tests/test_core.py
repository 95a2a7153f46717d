"""The core engine: kernels against plain versions, property tests, synthetic media end to end."""

import io
import itertools
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscan import settings as S
from twinscan.functions import hashes, markup, paths
from twinscan.operators import blocks, curate, groups, pairs, peaks
from twinscan.operators.components import components
from twinscan.plans import catalog, jobs
from twinscan.sources import cache, decoders, ebooks, files, sound

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["scan_classify", "path_parts", "luminance_ahash", "hash_popcount", "hamming_pairs_all", "hamming_pairs_top", "head_tail_pairs", "duration_bands", "constellation", "audio_pairs", "audio_pairs_ratio", "dup_components", "select_big_area", "group_shrink", "sampling_plan", "cache_lookup_miss", "peak_need", "result_rows", "peak_hits", "cover_id", "isbn_extract", "xml_metadata"])
def test_oracle(spark, tiny, oracle, name):
    got = catalog.QUERIES[name](spark, tiny)
    columns = sorted(got.columns)
    mine = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    sql = oracle.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    assert mine == sorted(map(repr, sql.project(",".join(f'"{c}"' for c in columns)).fetchall()))
    assert mine


# ------------------------------------------------------------------ kernels


def plain_hash(g):
    mean = sum(g) // len(g)
    h = sum(1 << i for i, x in enumerate(g) if x >= mean)
    return h - (1 << 64) if h >> 63 else h


def test_average_hash(spark):
    r = random.Random(1)
    grids = [[7] * 64, list(range(64)), *[[r.randrange(256) for _ in range(64)] for _ in range(20)]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)] + [(99, [1, 2]), (98, None)], "id int, g array<int>")
    got = {x.id: x.h for x in df.select("id", hashes.average_hash(F.col("g")).alias("h")).collect()}
    assert [got[i] for i in range(len(grids))] == [plain_hash(g) for g in grids]
    assert got[99] is None and got[98] is None and got[0] == -1


def test_sql_functions(spark):
    hashes.register(spark)
    g = list(range(64))
    row = spark.sql(f"select ahash(array({','.join(map(str, g))})) a, hamming(1L, -1L) d, hamming(null, 1L) n, peak_hash(1, 2, 3) p").first()
    assert row.a == plain_hash(g) and (row.d, row.n, len(row.p)) == (63, 64, 10)


def test_dct_hash(spark):
    r = np.random.default_rng(1)
    g = r.integers(0, 256, (3, 32, 32)).astype(float)
    low = []
    for x in g:
        c = [[sum((1 / 32**0.5 if u == 0 else (2 / 32) ** 0.5 * np.cos(u * np.pi * (i + 0.5) / 32)) * x[i] for i in range(32)) for u in range(8)]]
        m = np.array(c[0])
        d = np.array([[sum((1 / 32**0.5 if v == 0 else (2 / 32) ** 0.5 * np.cos(v * np.pi * (j + 0.5) / 32)) * m[u][j] for j in range(32)) for v in range(8)] for u in range(8)])
        b = (np.trunc(d).astype(int) & 255).reshape(-1)
        h = sum(1 << i for i in range(64) if b[i] >= b.sum() // 64)
        low.append(h - (1 << 64) if h >> 63 else h)
    assert hashes.dct_hashes(g).tolist() == low


@pytest.mark.parametrize("mask", [None, *S.AREA_MASKS[1:5]])
@pytest.mark.parametrize("limit", [0, 1, 4, 6, 10])
def test_banded_join_equals_theta(spark, mask, limit):
    r = random.Random(limit)
    rows = []
    for i in range(60):
        h = r.getrandbits(64)
        for _ in range(3):
            x = h
            for _ in range(r.randint(0, 10)):
                x ^= 1 << r.randrange(64)
            rows.append((len(rows), len(rows), x - (1 << 64) if x >> 63 else x))
    rows.append((len(rows), len(rows), None))
    got = {(x.id_a, x.id_b, x.distance) for x in pairs.hamming_pairs(spark.createDataFrame(rows, "id long, ord long, h long"), limit, mask).collect()}
    full = (1 << 64) - 1 if mask is None else mask
    want = {(a[0], b[0], bin((a[2] ^ b[2]) & full).count("1")) for a, b in itertools.combinations(rows[:-1], 2)}
    want = {x for x in want if x[2] < limit}
    assert got == want and (want or limit < 2)


@pytest.mark.parametrize("n", [10, 10**5, 10**9])
@pytest.mark.parametrize("limit, mask", [(20, None), (6, S.AREA_MASKS[1]), (8, 0xFFFFFFFF), (1, None), (2, 0b101)])
def test_pigeonhole_join_for_any_number_of_bands(spark, limit, mask, n):
    r = random.Random(limit)
    rows = [(i, r.getrandbits(64)) for i in range(40)]
    rows += [(100 + i, h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 21)))) for i, h in rows]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in rows]
    seen = spark.createDataFrame(signed, "id long, h long").select("h").distinct()
    got = {(x.ha, x.hb) for x in pairs.hash_pairs(seen, limit, mask, [], n).collect()}
    full = (1 << 64) - 1 if mask is None else mask
    held = sorted({h for _, h in signed})
    assert got == {(a, b) for i, a in enumerate(held) for b in held[i:] if bin((a ^ b) & full).count("1") < limit}
    bands = pairs.bands_of(limit, mask, pairs.band_count(n, limit, mask))
    assert all(bands) and sum(bands) == full
    with pytest.raises(ValueError):
        pairs.hash_pairs(seen, 4, 0b101, [], 10)


@pytest.mark.parametrize("limit, mask", [(4, None), (6, S.AREA_MASKS[1]), (20, None)])
def test_hashes_with_their_bands_are_not_broadcast(spark, limit, mask):
    seen = spark.range(200).select(F.xxhash64("id").alias("h"))
    assert pairs.in_blocks(10**5, limit, mask) == (limit != 4)
    for other in (None, seen.limit(50)):
        found = pairs.hash_pairs(seen, limit, mask, [], 10**5, other)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("mask", [None, S.AREA_MASKS[2]])
def test_blocks_of_hashes_meet_once(spark, monkeypatch, mask):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    r = random.Random(5)
    held, known = ([r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (100, 40))
    seen, other = (spark.createDataFrame([(h,) for h in x], "h long") for x in (held, known))
    near = lambda a, b: bin((a ^ b) & ((1 << 64) - 1 if mask is None else mask)).count("1") < 22 - 14 * bool(mask)
    own = pairs._blocks(seen, 22 - 14 * bool(mask), mask, 100, None).collect()
    assert sorted(map(tuple, own)) == sorted((min(a, b), max(a, b)) for a, b in [*itertools.combinations(held, 2), *zip(held, held, strict=True)] if near(a, b))
    cross = pairs._blocks(seen, 22 - 14 * bool(mask), mask, 100, other).collect()
    assert sorted(map(tuple, cross)) == sorted((a, b) for a in held for b in known if near(a, b)) and cross


def test_links_connect_what_pairs_do(spark):
    r = random.Random(11)
    base = [r.getrandbits(63) for _ in range(12)]
    rows = [(i, i, r.choice(base) ^ (1 << r.randrange(63) if r.random() < 0.3 else 0)) for i in range(90)] + [(500, 500, None)]
    df = spark.createDataFrame(rows, "id long, ord long, h long")
    links = pairs.hamming_links(df, 3)
    whole = components(pairs.hamming_pairs(df, 3), "id_a", "id_b")
    assert sorted(components(links, "id_a", "id_b").collect()) == sorted(whole.collect())
    assert links.count() < pairs.hamming_pairs(df, 3).count()
    assert pairs.hamming_links(df, 0).count() == 0


def test_numbering_by_ranges(spark):
    r = random.Random(12)
    rows = [(r.choice("ab"), f"{r.randrange(10**6):06d}") for _ in range(300)]
    got = files.range_numbered(spark.createDataFrame(rows, "kind string, path string"), ["kind"], "path", "ord").collect()
    for kind in "ab":
        mine = sorted((x.ord, x.path) for x in got if x.kind == kind)
        assert [o for o, _ in mine] == list(range(1, len(mine) + 1))
        assert [p for _, p in mine] == sorted(p for k, p in rows if k == kind)


def test_frequent_hashes_are_split(spark, monkeypatch):
    r = random.Random(13)
    rows = [(i, i, h, r.randint(1, 3)) for i in range(40) for h in ("hot", *r.sample("abcdef", 2))]
    df = spark.createDataFrame(rows, "id long, ord long, hash string, n long")
    want = sorted(peaks.shared_peaks(df).collect())
    monkeypatch.setattr(peaks, "SPLIT", 7)
    assert sorted(peaks.shared_peaks(df).collect()) == want and len(want) == 40 * 39 // 2


def test_bands_and_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 9.0, 10.0, 60.0, 120.0, 121.0, 300.0, 600.0, 1500.0, 3000.0, 28800.0, 28801.0)], "length double")
    got = {}
    for r in pairs.duration_bands(df).collect():
        got.setdefault(r.length, []).append(r.band)
    assert {k: sorted(v) for k, v in got.items()} == {10: [0], 60: [0, 1], 120: [0, 1], 121: [1], 300: [1, 2], 600: [1, 2], 1500: [2, 3], 3000: [2, 3], 28800: [3]}


def test_constellations_agree(spark):
    r = random.Random(3)
    seqs = [sorted((r.randrange(0, 400), r.randrange(50)) for _ in range(n)) for n in (0, 1, 4, 40)]
    rows = [(i, f, t) for i, s in enumerate(seqs) for t, f in s]
    by_window = peaks.constellation(spark.createDataFrame(rows, "id int, f int, t int")).collect()
    arrays = spark.createDataFrame([(i, [{"f": f, "t": t} for t, f in s]) for i, s in enumerate(seqs)], "id int, p array<struct<f:int,t:int>>")
    by_array = arrays.select("id", F.explode(peaks.constellation_of(F.col("p"))).alias("hash")).collect()
    assert sorted((x.id, x.hash) for x in by_window) == sorted((x.id, x.hash) for x in by_array)
    assert by_window


def test_shared_peaks_are_not_symmetric(spark):
    df = spark.createDataFrame([(0, 0, "x", 3), (0, 0, "y", 1), (1, 1, "x", 1), (1, 1, "z", 5)], "id long, ord long, hash string, n long")
    [r] = peaks.shared_peaks(df).collect()
    assert (r.id_a, r.id_b, r.hits) == (0, 1, 3)
    with pytest.raises(ValueError):
        peaks.audio_pairs(df, 10)


def plain_fold(found):
    out = []
    for a, b in found:
        for g in out:
            if a in g or b in g:
                for x in (a, b):
                    if x not in g:
                        g.append(x)
                break
        else:
            out.append([a, b])
    return out


def test_fold_in_order_without_merging(spark):
    assert [m for _, m in groups.fold_pairs([(0, 0, 3), (1, 1, 2), (2, 2, 3)])] == [[0, 3, 2], [1, 2]]
    r = random.Random(5)
    for _ in range(300):
        found = sorted({tuple(sorted(r.sample(range(12), 2))) for _ in range(r.randint(1, 15))})
        assert [m for _, m in groups.fold_pairs([(i, *p) for i, p in enumerate(found)])] == plain_fold(found)
    found = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(30)})
    df = spark.createDataFrame([("image", a, b) for a, b in found], "kind string, id_a long, id_b long")
    got = {}
    for x in groups.greedy_groups(df, ["id_a", "id_b"]).collect():
        got.setdefault(x.first_pair, {})[x.member_ord] = x.id
    assert sorted([m[i] for i in range(len(m))] for m in got.values()) == sorted(plain_fold(found))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.id, r.component) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(chain.limit(0)).count() == 0


# ------------------------------------------------------------------ curation, paths, settings


def test_selection_ties_and_shrinking(spark):
    df = spark.createDataFrame([(1, 1, "/a", 5, 1, 1, 1.0), (1, 2, "/b", 5, 2, 2, 2.0), (2, 1, "/c", None, 1, 1, 1.0), (2, 2, "/d", 9, 3, 3, 0.5), (2, 3, "/it's", 3, 3, 3, 9.0)], "group_id int, member_ord int, path string, size long, width long, height long, length double")
    picked = lambda rule: {r.path for r in curate.select(df, rule).where("selected").collect()}
    assert picked("small_file") == {"/a", "/it's"} and picked("big_file") == {"/a", "/d"}
    assert picked("small_area") == {"/a", "/c"} and picked("big_area") == {"/b", "/d"}
    assert picked("short") == {"/a", "/d"} and picked("long") == {"/b", "/it's"} and picked("manual") == set()
    plan = curate.delete_plan(curate.select(df, "small_file"))
    assert {r.path for r in curate.shrink(df, plan).collect()} == {"/c", "/d"}
    assert {r.path for r in curate.filter_groups(df, "it's").collect()} == {"/c", "/d", "/it's"}
    assert curate.filter_groups(df, None).count() == 5


def test_paths(spark):
    names = ["a.JPG", "noext", "dir.png/file", "x.tar.mp4", ".hidden", "é.mp3", "it's.pdf", "/a", "/d/e.ts"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r.k for r in df.select("p", paths.kinds(F.col("p"), S.Settings(proc_image=True, proc_ebook=True)).alias("k")).collect()}
    assert got == {"a.JPG": ["image"], "noext": [], "dir.png/file": [], "x.tar.mp4": ["video"], ".hidden": [], "é.mp3": ["audio"], "it's.pdf": ["ebook"], "/a": [], "/d/e.ts": ["video"]}


def test_sizes_are_printed_as_a_double_with_one_place(spark):
    r = random.Random(9)
    sizes = [0, 1, 2, 999, 1000, 1050, 1250, 1350, 1450, 1650, 1750, 999_949, 999_950, 999_999, 1_999_999, 5_000_000_000, 9_223_372_036_854_775_807]
    sizes += [100 * r.randrange(10, 10_000) + 50 for _ in range(400)] + [50_000 * (2 * r.randrange(10, 10_000) + 1) for _ in range(400)] + [r.randrange(10**15) for _ in range(200)]

    def plain(size):
        if size < 1000:
            return f"{size} byte" + "s" * (size != 1)
        power = max(p for p in range(1, 7) if size >= 1000**p)
        return f"{size / 1000.0**power:.1f} {['kB', 'MB', 'GB', 'TB', 'PB', 'EB'][power - 1]}"

    df = spark.createDataFrame([(x,) for x in sizes], "s long").select("s", paths.human_size(F.col("s")).alias("h"))
    assert {r.s: r.h for r in df.collect()} == {x: plain(x) for x in sizes}


def test_settings_round_trip(tmp_path):
    path = str(tmp_path / "rc")
    mine = S.Settings(proc_image=True, image_distance=3, directories=("/a", "/b c"), area=2)
    S.save(mine, path)
    assert S.load(path) == mine and S.load(str(tmp_path / "none")) == S.Settings()
    with pytest.raises(ValueError):
        S.Settings(audio_distance=10)


def test_markup(spark):
    df = spark.createDataFrame([('<a class="x" href="u">', "cover:#img1")], "h string, c string")
    row = df.select(markup.attribute(F.col("h"), "a", "href").alias("a"), markup.cover_id(F.col("c")).alias("c")).first()
    assert (row.a, row.c) == ("u", "img1")
    names = {"cover: a:b": "a:b", "COVER:x": "x", "title:x": None, "cover": None, "x": None, "cover2:x": None, "cover:": "", ":x": None}
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert {r.c: r.i for r in df.select("c", markup.cover_id(F.col("c")).alias("i")).collect()} == names
    numbers = {"isbn (UID:12) x": "12", "uuid (uuid_id:1) ISBN (uid:2)": "2", "ISBN (uid:12": "", f"ISBN (uid:{'9' * 128})": "", f"ISBN (uid:{'9' * 127})": "9" * 127, "other (1)": "", "x:urn:uuid:a-b)": "a-b"}
    df = spark.createDataFrame([(n,) for n in numbers], "t string")
    assert {r.t: r.i for r in df.select("t", markup.isbn(F.col("t")).alias("i")).collect()} == numbers


# ------------------------------------------------------------------ media


def picture(seed, h=40, w=60):
    r = np.random.default_rng(seed)
    coarse = r.integers(0, 256, (8, 8, 3))
    return np.repeat(np.repeat(coarse, h // 8 + 1, 0)[:h], w // 8 + 1, 1)[:, :w].astype(np.uint8)


def tune(seed, seconds=8, rate=22050):
    r = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    x = np.zeros(len(t))
    for i in range(int(seconds * 4)):
        part = slice(int(i * rate / 4), int((i + 1) * rate / 4))
        x[part] = np.sin(2 * np.pi * r.uniform(200, 5000) * t[part])
    return (12000 * x).astype(np.int16)


def test_covers_go_to_their_own_decoder(spark):
    from twinscan.settings import Settings
    from twinscan.sources.media import probe

    px = np.zeros((8, 8, 3), np.uint8)
    px[:4] = 200
    jpeg = b"\xff\xd8\xff\xe0 as a jpeg"
    rows = [("/j.epub", "ebook", 1, bytearray(epub(jpeg))), ("/p.epub", "ebook", 1, bytearray(epub(decoders.write_png(px)))), ("/g.epub", "ebook", 1, bytearray(epub(b"GIF89a")))]
    files = spark.createDataFrame(rows, "path string, kind string, size long, content binary")
    for suffix in ("jpg", "jpeg"):
        known = decoders.Decoders()
        known.image[suffix] = lambda data: px if data == jpeg else None
        got = {r.path: r.grid for r in probe(files, Settings(), known).collect()}
        assert got["/j.epub"] == got["/p.epub"] is not None and got["/g.epub"] is None


def epub(cover):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", '<package xmlns="urn:o"><metadata><meta name="cover" content="#Img"/></metadata><manifest><item id="img" href="c.png"/></manifest></package>')
        if cover is not None:
            z.writestr("OPS/c.png", cover)
    return out.getvalue()


def test_codecs():
    px = picture(1)
    assert (decoders.read_png(decoders.write_png(px)) == px).all()
    assert decoders.read_png(b"nothing") is None and decoders.read_wav(b"RIFFxxxx") is None
    x = tune(1, 1)
    got = decoders.read_wav(decoders.write_wav(x))
    assert (got.samples == x).all() and got.length == 1
    assert ebooks.epub_cover(epub(b"img")) == b"img" and ebooks.epub_cover(epub(None)) is None and ebooks.epub_cover(b"x") is None
    assert sound.peaks(sound.spectrum(np.zeros(100, np.int16)), 0.0) == []
    assert decoders.shrink(px, 8, 8).shape == (8, 8, 3)


def plain_peaks(db, seconds):
    """Local maxima by a loop over the diamond around every cell; thresholds until hashes exceed a fourth of the seconds."""
    def reach(x, worst, pick):
        h, w = x.shape
        out = np.empty_like(x)
        wide = np.full((h + 40, w + 40), worst, x.dtype)
        wide[20:-20, 20:-20] = x
        parts = [wide[20 + a : 20 + a + h, 20 + b : 20 + b + w] for a in range(-20, 21) for b in range(-20 + abs(a), 21 - abs(a))]
        out[:] = parts[0]
        for part in parts:
            pick(out, part, out=out)
        return out

    top = (reach(db, -np.inf, np.maximum) == db) & ~reach(db == 0, True, np.logical_and)
    for amplitude in range(50, 0, -5):
        found = sorted(((t, f) for f, t in zip(*np.nonzero(top & (db > amplitude)), strict=True)))
        n = sum(found[j][0] - found[i][0] <= 200 for i in range(len(found)) for j in range(i + 1, min(i + 5, len(found))))
        if n > int(seconds) // 4:
            break
    return [(int(f), int(t)) for t, f in found]


def test_peaks_stop_when_hashes_exceed_a_fourth_of_the_seconds():
    t = np.arange(22050 * 12) / 22050
    tone = (9000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    chirp = (6000 * np.sin(2 * np.pi * (200 + 150 * t) * t)).astype(np.int16)
    noise = np.random.default_rng(3).normal(0, 40, len(t)).astype(np.int16)
    for x in (tone, chirp, noise, tune(4, 12), np.zeros(22050 * 3, np.int16)):
        db = sound.spectrum(x)
        assert sound.peaks(db, len(x) / 22050) == plain_peaks(db, len(x) / 22050)
    both = sound.spectrum(chirp + 3 * noise)
    assert len(sound.peaks(both, 12)) < len(sound.peaks(both, 4000))  # more seconds ask for more hashes


def test_area_5_hears_videos_instead_of_watching_them(spark, tmp_path):
    for name, x in (("a.mp4", tune(5)), ("b.mp4", (tune(5) * 0.6).astype(np.int16)), ("c.mp4", tune(6)), ("d.wav", tune(5))):
        (tmp_path / name).write_bytes(decoders.write_wav(x))

    def pairs_of(**change):
        known = decoders.Decoders()
        known.audio["mp4"] = decoders.read_wav
        known.video["mp4"] = lambda data: decoders.Video(100.0, 8, 8, "mp4", lambda at: np.zeros((8, 8, 3), np.uint8))
        found = jobs.scan(spark, [str(tmp_path)], S.Settings(**change), known)
        return {(r.kind, r.a.rpartition("/")[2], r.b.rpartition("/")[2]) for r in found.pairs.collect()}

    heard = {("video", "a.mp4", "b.mp4")}
    assert pairs_of(area=5, proc_audio=False) == heard
    assert pairs_of(area=5) == heard | {("audio", "a.mp4", "b.mp4"), ("audio", "a.mp4", "d.wav"), ("audio", "b.mp4", "d.wav")}
    # otherwise their frames are compared: all alike here
    assert pairs_of(proc_audio=False) == {("video", x, y) for x, y in itertools.combinations(("a.mp4", "b.mp4", "c.mp4"), 2)}


@pytest.fixture(scope="module")
def media(tmp_path_factory):
    top = tmp_path_factory.mktemp("media")
    (top / "sub").mkdir()
    one, two = picture(1), picture(2)
    (top / "a.png").write_bytes(decoders.write_png(one))
    (top / "sub" / "b.PNG").write_bytes(decoders.write_png(np.repeat(np.repeat(one, 2, 0), 2, 1)))
    (top / "c.png").write_bytes(decoders.write_png(two))
    (top / "broken.png").write_bytes(b"not a picture")
    (top / "x.wav").write_bytes(decoders.write_wav(tune(5)))
    (top / "y.wav").write_bytes(decoders.write_wav((tune(5) * 0.6).astype(np.int16)))
    (top / "z.wav").write_bytes(decoders.write_wav(tune(6)))
    (top / "e.epub").write_bytes(epub(decoders.write_png(one)))
    (top / "f.epub").write_bytes(epub(decoders.write_png(one)))
    (top / "notes.txt").write_text("none of these")
    return top


def test_scan(spark, media):
    found = jobs.scan(spark, [str(media), str(media / "sub")], S.Settings(proc_image=True, proc_ebook=True))
    short = {(r.kind, r.a.rpartition("/")[2], r.b.rpartition("/")[2]) for r in found.pairs.collect()}
    assert short == {("image", "a.png", "b.PNG"), ("audio", "x.wav", "y.wav"), ("ebook", "e.epub", "f.epub")}
    assert found.groups.count() == 6
    assert {r.kind for r in found.probed.where("h is null and peaks is null").collect()} == {"image"}


def test_images_of_the_jvm(spark, tmp_path):
    px = picture(4)
    (tmp_path / "a.PNG").write_bytes(decoders.write_png(px))
    (tmp_path / "broken.jpg").write_bytes(b"not a picture")
    jvm = spark._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.PNG")))
    for kind in ("jpg", "gif", "bmp", "tif"):
        assert jvm.javax.imageio.ImageIO.write(read, kind, jvm.java.io.File(str(tmp_path / f"b.{kind}")))
    (tmp_path / "c.xpm").write_bytes(decoders.write_png(px))
    found = jobs.scan(spark, [str(tmp_path)], S.Settings(proc_image=True, proc_video=False, proc_audio=False))
    rows = {r.path.rpartition("/")[2]: r for r in found.probed.collect()}
    assert rows.keys() == {"a.PNG", "b.jpg", "b.gif", "b.bmp", "b.tif", "broken.jpg", "c.xpm"}
    assert rows["broken.jpg"].h is None and rows["broken.jpg"].size == 13 and rows["c.xpm"].h is None
    assert rows["a.PNG"].grid == rows["b.bmp"].grid == decoders.grays(px, 8) and (rows["b.tif"].width, rows["b.tif"].height, rows["b.tif"].format) == (60, 40, "tif")
    assert rows["a.PNG"].ph == hashes.dct_hashes(np.array(decoders.grays(px, 32), float).reshape(1, 32, 32))[0]
    names = {frozenset((r.a.rpartition("/")[2], r.b.rpartition("/")[2])) for r in found.pairs.collect()}
    assert frozenset(("a.PNG", "b.jpg")) in names and not any("broken.jpg" in n or "c.xpm" in n for n in names)
    # a decoder of the caller's own comes first
    known = decoders.Decoders()
    known.image |= {"gif": lambda data: None, "xpm": decoders.read_png}
    rows = {r.path.rpartition("/")[2]: r for r in jobs.scan(spark, [str(tmp_path)], S.Settings(proc_image=True, proc_video=False, proc_audio=False), known).probed.collect()}
    assert rows["b.gif"].h is None and rows["c.xpm"].h == rows["a.PNG"].h


def test_scan_with_a_cache(spark, media, tmp_path):
    held = cache.Cache(spark, str(tmp_path / "cache"))
    mine = S.Settings(proc_image=True, proc_ebook=True)
    video = tmp_path / "films"
    video.mkdir()
    for name in ("one.mp4", "two.mp4"):
        (video / name).write_bytes(name.encode())
    known = decoders.Decoders()
    known.video["mp4"] = lambda data: decoders.Video(400.0, 8, 8, "mp4", lambda at: picture(at) if at < 375 else None)
    roots = [str(media), str(video)]
    plain = jobs.scan(spark, roots, mine, known)
    want = sorted(map(tuple, plain.pairs.collect()))
    assert len(want) == 4 and any(r[0] == "video" for r in want)
    first = jobs.scan(spark, roots, mine, known, held)
    assert sorted(map(tuple, first.pairs.collect())) == want
    # now nothing but unreadable files is decoded
    blind = decoders.Decoders()
    blind.image = {x: (lambda data: None) for x in ("png", "jpg")}
    blind.audio, blind.video = {"wav": lambda data: None}, {"mp4": lambda data: None}
    again = jobs.scan(spark, roots, mine, blind, held)
    assert sorted(map(tuple, again.pairs.collect())) == want
    keep = ("path", "kind", "size", "width", "height", "length", "format", "h", "ends")
    rows = lambda s: sorted(repr(tuple(r)) for r in s.probed.where("kind != 'image' or h is not null").select(*keep).collect())
    assert rows(again) == rows(plain)
    # a changed file is decoded anew, one that is gone has no pairs
    (video / "two.mp4").write_bytes(b"another film")
    assert sorted(map(tuple, jobs.scan(spark, roots, mine, blind, held).pairs.collect())) == [r for r in want if r[0] != "video"]


def test_listing_reads_no_content(spark, media):
    listed = files.listing(spark, [str(media)])
    assert listed.count() == 10 and "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_cache(spark, tmp_path):
    held = cache.Cache(spark, str(tmp_path / "cache"))
    listing = spark.sql("select * from values ('/a', 1L, timestamp'2020-01-01'), ('/b', 2L, timestamp'2020-01-01') t(path, size, mtime)")
    assert held.lookup(listing, 0)[1].count() == 2
    held.add(listing, spark.sql("select '/a' path, 0D at, 5L h, 0 alg union all select '/b', 0D, 6L, 0"))
    hits, misses = held.lookup(listing, cache.IMAGE_HASH)
    assert {(r.path, r.h) for r in hits.collect()} == {("/a", 5), ("/b", 6)} and misses.count() == 0
    changed = listing.withColumn("size", F.col("size") + F.when(F.col("path") == "/a", 1).otherwise(0))
    assert [r.path for r in held.lookup(changed, 0)[1].collect()] == ["/a"]
    held.remove(listing.where("path = '/a'"))
    assert [r.path for r in held.media.collect()] == ["/b"] and held.hashes.count() == 1
    held.vacuum(listing.limit(0))
    assert held.media.count() == 0 and held.hashes.count() == 0


def test_watch(spark, media, tmp_path):
    from twinscan.streaming.watch import watch_images

    held, seen = cache.Cache(spark, str(tmp_path / "cache")), []
    take = lambda df: seen.extend((r.id_a.rpartition("/")[2], r.id_b.rpartition("/")[2]) for r in df.collect())
    watch_images(spark, str(media), held, str(tmp_path / "log"), take).awaitTermination()
    assert seen == [("a.png", "b.PNG")] and held.media.count() == 4
    watch_images(spark, str(media), held, str(tmp_path / "log2"), take).awaitTermination()
    assert held.media.count() == 4
    # new files meet those before them, which don't meet each other again
    later = tmp_path / "later"
    later.mkdir()
    for name in ("d.png", "e.png"):
        (later / name).write_bytes(decoders.write_png(picture(2)))
    seen.clear()
    watch_images(spark, str(later), held, str(tmp_path / "log3"), take).awaitTermination()
    assert sorted(map(sorted, seen)) == [["c.png", "d.png"], ["c.png", "e.png"], ["d.png", "e.png"]]


def test_entry_without_llm(monkeypatch):
    import importlib
    import importlib.util as util

    real = util.find_spec
    monkeypatch.setattr(util, "find_spec", lambda n, *a: None if n in ("twinscan.llm", "corpus_pipeline") else real(n, *a))
    import __spark_entry__

    found = importlib.reload(__spark_entry__)
    assert found.queries().keys() == catalog.QUERIES.keys() and found.oracle_sql().keys() <= found.queries().keys()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def plain_hits(files):
    """Hits of each lower file in each higher one, from (id, f, t) by id."""
    folded = {}
    for i, peaks_ in files.items():
        peaks_ = sorted(peaks_, key=lambda p: (p[1], p[0]))
        near = [(p, q) for n, p in enumerate(peaks_) for q in peaks_[n + 1 : n + 5] if q[1] - p[1] <= 200]
        kinds = [(p[0], q[0], q[1] - p[1]) for p, q in near]
        folded[i] = {k: kinds.count(k) for k in kinds}
    return {(a, b): h for a in files for b in files if a < b and (h := sum(n for k, n in folded[a].items() if k in folded[b]))}, {i: sum(x.values()) for i, x in folded.items()}


@pytest.mark.parametrize("products", [0, 40, 1 << 40])
def test_products_of_blocks_equal_plain_hits(products):
    """By adding up alone, by both ways, and by dense products alone; times apart, alike and of repeated ids."""
    rng = random.Random(3)
    rows = [(i, [rng.randint(1, 3) ** 2 for _ in range(n)], sorted(rng.randint(0, 150 * n) // 7 for _ in range(n))) for i in range(-9, 16) for n in (rng.randint(0, 30),)]
    rows += [(4, [1, 4, 1], [0, 1, 2]), (15, [9] * 40, list(range(40)))]
    files = {i: [p for j, f, t in rows if j == i for p in zip(f, t, strict=True)] for i in {r[0] for r in rows}}
    want, sizes = plain_hits(files)
    a, b = (blocks.block_of(np.array([r[0] for r in part]), [np.array(r[1]) for r in part], [np.array(r[2]) for r in part]) for part in ([r for r in rows if r[0] < 3], [r for r in rows if r[0] >= 3]))
    assert {int(i): int(n) for x in (a, b) for i, n in zip(x["ids"], x["sizes"], strict=True)} == sizes
    got = {}
    for x, y in ((a, a), (a, b), (b, b)):
        hits = blocks.shared_in(x, y, products)
        got |= {(int(x["ids"][i]), int(y["ids"][j])): int(hits[i, j]) for i, j in zip(*np.nonzero(hits), strict=True) if x["ids"][i] < y["ids"][j]}
    assert got == want and want


def test_peak_queries_join_no_rows_per_shared_hash(spark, tiny):
    """A hash of many files must not be a row for each pair of them; odd rows, several blocks."""
    rows = [(i, [7] * 12, None) for i in range(300)] + [(None, [7] * 12, None), (400, None, None), (401, [], None), (402, [7], None), (403, [7, 8], [0, 201])]
    df = spark.createDataFrame(rows, "id long, f array<int>, t array<int>")
    got = blocks.audio_pairs(df, 2, files=64)
    assert got.count() == got.distinct().count() == 300 * 299 // 2
    assert {tuple(r) for r in got.select("hits", "need").distinct().collect()} == {(38, 30)}
    [r] = blocks.peak_hits(df, files=64).where("id = 10").collect()
    assert tuple(r) == (10, 289, 289 * 38, 38)
    assert not blocks.audio_pairs(df.where("id is null"), 2).collect()
    for name in ("audio_pairs", "audio_pairs_ratio", "audio_in_video_union", "peak_hits"):
        plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "hash" not in plan.replace("hashpartitioning", "").replace("Hash", "")
    with pytest.raises(ValueError, match="distance"):
        blocks.audio_pairs(df, 10)


def test_equal_files_meet_once_whatever_their_ids(spark, monkeypatch):
    """Copies are one file of a block; their ids may lie on both sides of another file's."""
    monkeypatch.setattr(blocks, "COPIES", 3)
    rng = random.Random(5)
    kinds = [[rng.randint(1, 3) for _ in range(rng.randint(2, 25))] for _ in range(12)] + [[1]]
    files = {i: rng.choice(kinds) for i in rng.sample(range(-40, 900), 90)}
    want, sizes = plain_hits({i: [(f, t) for t, f in enumerate(x)] for i, x in files.items()})
    df = spark.createDataFrame([(i, x, None) for i, x in files.items()], "id long, f array<int>, t array<int>")
    held = blocks._blocks(df, 8, 1 << 21).collect()
    counts = [list(files.values()).count(x) for x in kinds]
    assert len(held) > 1 and sum(len(r.sizes) // 8 for r in held) == sum(-(-n // 3) for n in counts)
    got = {(r.id_a, r.id_b): (r.hits, r.need) for r in blocks.audio_pairs(df, 2, files=8).collect()}
    need = {(a, b): max(1, min(sizes[a], sizes[b]) * 80 // 100) for a, b in want}
    assert got == {p: (h, need[p]) for p, h in want.items() if h >= need[p]}
    of = {i: [h for (a, _), h in want.items() if a == i] for i in files}
    got = sorted(tuple(r) for r in blocks.peak_hits(df, files=8).collect())
    assert got == sorted((i, len(h), sum(h), max(h)) for i, h in of.items() if h)


def test_durations_are_compared_before_pairs_are_listed(spark, tmp_path):
    """Pairs too far apart by duration are not written to a table first; an id's several durations all count."""
    rows = [(i, [7] * 12, None, x) for i, x in enumerate((5.0, 10.0, 20.0, 20.0, None))] + [(5, [7] * 6, None, 10.0), (5, None, None, 40.0)]
    df = spark.createDataFrame(rows, "id long, f array<int>, t array<int>, length double")
    got = sorted((r.id_a, r.id_b) for r in blocks.audio_pairs(df, 2, ratio_mode=1).collect())
    assert got == [(0, 1), (0, 5), (1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (2, 5), (3, 5), (3, 5)]
    spark.createDataFrame([(i, "a b c d", 8 + i) for i in range(30)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["audio_pairs_ratio"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().replace("CartesianProduct", "").replace("BroadcastNestedLoopJoin", "") and found.count() > 0


def test_benchmark_items_fold_with_equal_documents(spark, tmp_path, monkeypatch):
    """Of a text in both corpora one file meets the others, and all pairs of its ids are found."""
    spark.createDataFrame([(i, "a bb ccc dd e") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "a bb ccc dd e") for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, build = [], blocks._blocks
    monkeypatch.setattr(blocks, "_blocks", lambda *a: held.append(build(*a)) or held[-1])
    found = {(r.id_a, r.id_b) for r in catalog.QUERIES["audio_in_video_union"](spark, str(tmp_path)).collect()}
    ids = [*range(20), *range(1000000000, 1000000005)]
    assert found == {(a, b) for a in ids for b in ids if a < b}
    assert [len(r.sizes) // 8 for r in held[0].collect()] == [1]
