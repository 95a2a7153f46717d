"""All registered queries of the core engine and their DuckDB oracles.

The driver's tables stand in for media: an embedding is an 8x8 grid of grays, a document a sequence
of peaks (a word is a peak at its position), a document's length a duration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import markup, paths
from ..operators import blocks, curate, groups, pairs, peaks
from ..operators.components import components
from ..settings import AREA_MASKS, Settings
from ..sources import cache
from ..sources.files import range_numbered
from ..storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Distance of unmasked and of masked hash queries (the data has no unmasked pairs below 20).
FAR, NEAR = 20, 6


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- paths

_SUFFIX = "element_at(array('JPG','mp4','mp3','pdf','txt'), cast(doc_id % 5 + 1 as int))"
_PATHS = """paths AS (
    SELECT '/' || source || '/' || doc_id || '.' || ['JPG','mp4','mp3','pdf','txt'][CAST(doc_id % 5 + 1 AS INT)] AS path FROM documents
    UNION ALL SELECT url FROM pages)"""
_ALL = Settings(proc_image=True, proc_ebook=True, area=5)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.expr(f"concat('/', source, '/', doc_id, '.', {_SUFFIX})").alias("path"))
    return docs.unionByName(_read(spark, sf_dir, "pages").select(F.col("url").alias("path")))


def _sql_list(values: tuple[str, ...]) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


_SFX = "CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '[^.]*$')) END"


@query(f"""WITH {_PATHS}, s AS (SELECT path, {_SFX} AS x FROM paths)
    SELECT path, 'image' AS kind FROM s WHERE x IN {_sql_list(_ALL.image_suffixes)}
    UNION ALL SELECT path, 'video' FROM s WHERE x IN {_sql_list(_ALL.video_suffixes)}
    UNION ALL SELECT path, 'audio' FROM s WHERE x IN {_sql_list(_ALL.audio_suffixes)} OR x IN {_sql_list(_ALL.video_suffixes)}
    UNION ALL SELECT path, 'ebook' FROM s WHERE x IN {_sql_list(_ALL.ebook_suffixes)}""")
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path once per kind of its suffix; area 5 hears videos as well."""
    return _paths(spark, sf_dir).select("path", F.explode(paths.kinds(F.col("path"), _ALL)).alias("kind"))


@query(f"""WITH {_PATHS} SELECT path, regexp_extract(path, '[^/]*$') AS name,
    CASE WHEN NOT contains(path, '/') THEN '.' WHEN regexp_matches(path, '^/[^/]*$') THEN '/'
         ELSE regexp_replace(path, '/[^/]*$', '') END AS dir, {_SFX} AS suffix FROM paths""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", paths.base_name(p).alias("name"), paths.dir_name(p).alias("dir"), paths.suffix(p).alias("suffix"))


# ---------------------------------------------------------------- hashes

_GRIDS = "grids AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 100) AS BIGINT)) AS g FROM embeddings)"
_HASHED = f"""{_GRIDS}, cells AS (SELECT vec_id, unnest(g) AS v, unnest(range(64)) AS i, list_sum(g) // len(g) AS m FROM grids),
    packed AS (SELECT vec_id, sum(CASE WHEN v >= m THEN 1::HUGEINT << CAST(i AS INT)::HUGEINT ELSE 0::HUGEINT END)::HUGEINT AS u FROM cells GROUP BY vec_id),
    hashed AS (SELECT vec_id AS id, vec_id AS ord, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS h FROM packed)"""


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 100).cast("int"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), H.average_hash(F.col("g")).alias("h"))


@query(f"""WITH {_HASHED}, l AS (SELECT vec_id AS id, list_transform(range(64), lambda i: (30 * g[i + 1] + 59 * g[(i + 1) % 64 + 1] + 11 * g[(i + 2) % 64 + 1]) // 100) AS y FROM grids)
    SELECT id, CAST(list_sum(y) // 64 AS BIGINT) AS mean_luminance, h FROM hashed JOIN l USING (id)""")
def luminance_ahash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean brightness of a grid read as RGB (a cell with its two next), and the grid's average hash."""
    g = F.col("g")
    y = F.transform(g, lambda v, i: H.luminance(v, F.get(g, (i + 1) % 64), F.get(g, (i + 2) % 64)))
    return _grids(spark, sf_dir).select(F.col("vec_id").alias("id"), H.mean_gray(y).alias("mean_luminance"), H.average_hash(g).alias("h"))


@query(f"WITH {_HASHED} SELECT id, h, CAST(bit_count(h) AS INTEGER) AS bits FROM hashed")
def hash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("id", "h", H.popcount(F.col("h")).cast("int").alias("bits"))


def _theta(limit: int, mask: int | None, source: str = _HASHED) -> str:
    diff = "xor(a.h, b.h)" if mask is None else f"xor(a.h, b.h) & {mask}::BIGINT"
    return f"""WITH {source} SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count({diff}) AS INTEGER) AS distance
        FROM hashed a JOIN hashed b ON a.ord < b.ord WHERE bit_count({diff}) < {limit}"""


def _hamming_query(limit: int, mask: int | None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs.hamming_pairs(materialize(_hashed(spark, sf_dir), "hashes"), limit, mask)

    return run


for _name, _limit, _mask in (
    ("hamming_pairs_all", FAR, None),
    ("hamming_pairs_top", NEAR, AREA_MASKS[1]),
    ("hamming_pairs_bottom", NEAR, AREA_MASKS[2]),
    ("hamming_pairs_left", NEAR, AREA_MASKS[3]),
    ("hamming_pairs_right", NEAR, AREA_MASKS[4]),
):
    query(_theta(_limit, _mask), _name)(_hamming_query(_limit, _mask))


@query()
def dct_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCT hash of each grid blown up to 32x32; float arithmetic, so without an oracle."""
    big = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.get("g", (F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int")))
    return _grids(spark, sf_dir).select(F.col("vec_id").alias("id"), H.phash(big).alias("ph"))


# ---------------------------------------------------------------- durations

_LENGTHS = "lengths AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS length FROM documents)"
_BANDS = "bands(band, lo, hi, seek) AS (VALUES (0, 10, 120, 4), (1, 60, 600, 25), (2, 300, 3000, 120), (3, 1500, 28800, 600))"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("length"))


@query(f"WITH {_LENGTHS}, {_BANDS} SELECT id, length, band, seek, length - seek AS tail_at FROM lengths JOIN bands ON length BETWEEN lo AND hi")
def duration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.duration_bands(_lengths(spark, sf_dir).where("length > 0"), length=F.col("length"))


_ENDS = f"""{_HASHED}, {_LENGTHS}, {_BANDS}, ends AS (
    SELECT id, ord, band, h & 4294967295::BIGINT AS head, (h >> 32) & 4294967295::BIGINT AS tail
    FROM hashed JOIN lengths USING (id) JOIN bands ON length BETWEEN lo AND hi WHERE length > 0)"""


@query(f"""WITH {_ENDS} SELECT a.band, a.id AS id_a, b.id AS id_b,
    CASE WHEN bit_count(xor(a.head, b.head)) < 8 THEN 'HEAD' ELSE 'TAIL' END AS kind
    FROM ends a JOIN ends b ON a.band = b.band AND a.ord < b.ord
    WHERE bit_count(xor(a.head, b.head)) < 8 OR bit_count(xor(a.tail, b.tail)) < 8""")
def head_tail_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in a duration band alike at the head or else at the tail: the hash's halves."""
    h = F.col("h")
    rows = _hashed(spark, sf_dir).join(_lengths(spark, sf_dir).where("length > 0"), "id")
    held = rows.select("id", "ord", "length", h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("head"), F.shiftrightunsigned(h, 32).alias("tail"))
    return pairs.head_tail_pairs(materialize(pairs.duration_bands(held), "ends"), 8, 0xFFFFFFFF)


# ---------------------------------------------------------------- peaks

_PEAKS = """words AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS t FROM documents),
    peaks AS (SELECT id, CAST(CASE WHEN w = '' THEN 0 ELSE unicode(w) END * 100 + length(w) AS INTEGER) AS f, CAST(t AS INTEGER) AS t FROM words)"""
_CONST = f"""{_PEAKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, f) AS rn FROM peaks),
    const AS (SELECT a.id, substr(sha1(a.f || '|' || b.f || '|' || (b.t - a.t)), 1, 10) AS hash, a.t
        FROM ranked a JOIN ranked b ON a.id = b.id AND b.rn BETWEEN a.rn + 1 AND a.rn + 4 WHERE b.t - a.t BETWEEN 0 AND 200)"""
_FOLDED = f"{_CONST}, folded AS (SELECT id, id AS ord, hash, count(*) AS n FROM const GROUP BY id, hash), sizes AS (SELECT id, CAST(sum(n) AS BIGINT) AS size FROM folded GROUP BY id)"
_HITS = "hits AS (SELECT a.id AS id_a, b.id AS id_b, CAST(sum(a.n) AS BIGINT) AS hits FROM folded a JOIN folded b ON a.hash = b.hash AND a.ord < b.ord GROUP BY ALL)"
_NEED = "greatest(1, least(x.size, y.size) * 80 // 100)"
_FOUND = f"""found AS (SELECT id_a, id_b, hits, {_NEED} AS need FROM hits JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE hits >= {_NEED})"""


def _peaks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    word = F.posexplode(F.split("text", " ", -1)).alias("t", "w")
    return docs.select(F.col(key).alias("id"), word).select("id", (F.ascii("w") * 100 + F.length("w")).cast("int").alias("f"), "t")


def _hashes_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``id, hash, t`` of documents, made inside the row that holds the words.

    A file of few row groups is read by few tasks; its rows are then dealt to all cores beforehand.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(key, "text")
    docs = docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)
    found = F.transform(F.split("text", " ", -1), lambda w, i: F.struct((F.ascii(w) * 100 + F.length(w)).cast("int").alias("f"), i.alias("t")))
    return docs.select(F.col(key).alias("id"), F.inline(peaks.constellation_of(found, timed=True)))


def _folded(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return peaks.fold(_hashes_of(docs, key)).withColumn("ord", F.col("id"))


def _peak_rows(docs: DataFrame, length: Column | None = None) -> DataFrame:
    """``id, f, t`` of documents: peaks as an array, at 0, 1, 2... (t null). With a length, that too."""
    f = F.transform(F.split("text", " ", -1), lambda w: (F.ascii(w) * 100 + F.length(w)).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), f.alias("f"), F.lit(None).cast("array<int>").alias("t"), *([] if length is None else [length.alias("length")]))


@query(f"WITH {_PEAKS} SELECT id, count(*) AS n, CAST(sum(f) AS BIGINT) AS sum_f, max(t) AS last_t, CAST(sum(f * (t % 97)) AS BIGINT) AS check_ft FROM peaks GROUP BY id")
def peak_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every document, summed up per document."""
    found = _peaks(_read(spark, sf_dir, "documents"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("sum_f"), F.max("t").alias("last_t"), F.sum((F.col("f") * (F.col("t") % 97)).cast("long")).alias("check_ft"))


@query(f"WITH {_CONST} SELECT id, count(*) AS n, count(DISTINCT hash) AS kinds, min(hash) AS least, max(hash) AS most, CAST(sum(t) AS BIGINT) AS sum_t FROM const GROUP BY id")
def constellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak hashes of every document, summed up per document."""
    found = _hashes_of(_read(spark, sf_dir, "documents"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("kinds"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.sum("t").alias("sum_t"))


@query(f"WITH {_FOLDED}, {_HITS} SELECT id_a AS id, count(*) AS partners, CAST(sum(hits) AS BIGINT) AS hits, max(hits) AS most FROM hits GROUP BY id_a")
def peak_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared peaks of all pairs, summed up per lower document."""
    return blocks.peak_hits(_peak_rows(_read(spark, sf_dir, "documents")))


@query(f"WITH {_FOLDED}, p AS (SELECT id, size, lead(size) OVER (ORDER BY id) AS next_size FROM sizes) SELECT id, size, next_size, CAST(greatest(1, least(size, next_size) * 80 // 100) AS BIGINT) AS need FROM p WHERE next_size IS NOT NULL")
def peak_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared peaks that each document and its next would need."""
    size = range_numbered(peaks.sizes(_folded(_read(spark, sf_dir, "documents"))), [], "id", "at")
    after = size.select((F.col("at") - 1).alias("at"), F.col("size").alias("next_size"))
    beside = size.join(after, "at")
    return beside.select("id", "size", "next_size", peaks.required(F.col("size"), F.col("next_size"), 2).alias("need"))


@query(f"WITH {_FOLDED}, {_HITS}, {_FOUND} SELECT * FROM found")
def audio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents that share enough of their peaks."""
    return blocks.audio_pairs(_peak_rows(_read(spark, sf_dir, "documents")), 2)


@query(f"WITH {_FOLDED}, {_HITS}, {_FOUND}, {_LENGTHS} SELECT f.* FROM found f JOIN lengths a ON a.id = id_a JOIN lengths b ON b.id = id_b WHERE least(a.length, b.length) * 2 >= greatest(a.length, b.length)")
def audio_pairs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with durations at most twice each other."""
    docs = _read(spark, sf_dir, "documents")
    return blocks.audio_pairs(_peak_rows(docs, F.col("n_chars").cast("double")), 2, ratio_mode=1)


@query(f"""WITH both_(doc_id, text) AS (SELECT doc_id, text FROM documents UNION ALL SELECT item_id + 1000000000, text FROM benchmark),
    {_FOLDED.replace('FROM documents', 'FROM both_')}, {_HITS}, {_FOUND} SELECT * FROM found""")
def audio_in_video_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of a second corpus joined in: documents and benchmark items together."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    items = _read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text")
    return blocks.audio_pairs(_peak_rows(docs.unionByName(items)), 2)


# ---------------------------------------------------------------- groups

_LINKS = f"""{_HASHED}, links AS (SELECT a.id AS id_a, b.id AS id_b FROM hashed a JOIN hashed b ON a.ord < b.ord WHERE bit_count(xor(a.h, b.h)) < {FAR}),
    edges AS (SELECT id_a AS u, id_b AS v FROM links UNION SELECT id_b, id_a FROM links),
    reach(id, root) AS (SELECT u, u FROM edges UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.id),
    comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""
_MEMBERS = f"""{_LINKS}, members AS (
    SELECT c.component AS group_id, CAST(row_number() OVER (PARTITION BY c.component ORDER BY c.id) AS INTEGER) AS member_ord,
        '/' || d.source || '/' || c.id || '.' || d.lang AS path, d.n_chars AS size,
        CAST(e.label + 1 AS BIGINT) AS width, CAST(c.id % 7 + 1 AS BIGINT) AS height, CAST(d.n_chars AS DOUBLE) / 8 AS length, d.lang AS kind
    FROM comp c JOIN documents d ON d.doc_id = c.id JOIN embeddings e ON e.vec_id = c.id)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(pairs.hamming_pairs(materialize(_hashed(spark, sf_dir), "hashes"), FAR), "links")


@query(f"WITH RECURSIVE {_LINKS} SELECT id, component FROM comp")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = pairs.hamming_links(materialize(_hashed(spark, sf_dir), "hashes"), FAR)
    return groups.component_groups(links)


@query()
def dup_groups_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order in which their pairs are found; tested against a plain fold."""
    found = _links(spark, sf_dir).withColumn("kind", F.lit("image"))
    return groups.greedy_groups(found.select("kind", "id_a", "id_b"), ["id_a", "id_b"])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = components(pairs.hamming_links(materialize(_hashed(spark, sf_dir), "hashes"), FAR), "id_a", "id_b")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    labels = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    at = Window.partitionBy("component").orderBy("id")
    return comp.join(docs, "id").join(labels, "id").select(
        F.col("component").alias("group_id"),
        F.row_number().over(at).cast("int").alias("member_ord"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("id").cast("string"), F.lit("."), "lang").alias("path"),
        F.col("n_chars").alias("size"),
        (F.col("label") + 1).cast("long").alias("width"),
        (F.col("id") % 7 + 1).alias("height"),
        (F.col("n_chars").cast("double") / 8).alias("length"),
        F.col("lang").alias("kind"),
    )


_PICKED = "group_id, member_ord, path"
for _rule, (_value, _least) in curate.RULES.items():
    _sql = f"""WITH RECURSIVE {_MEMBERS} SELECT {_PICKED}, row_number() OVER (PARTITION BY group_id ORDER BY {_value} {"ASC" if _least else "DESC"} NULLS LAST, member_ord) = 1 AS selected FROM members"""

    @query(_sql, f"select_{_rule}")
    def _select(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        return curate.select(_members(spark, sf_dir), rule).select("group_id", "member_ord", "path", "selected")


_SMALL = f"{_MEMBERS}, chosen AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size, member_ord) = 1 AS selected FROM members)"


@query(f"WITH RECURSIVE {_SMALL} SELECT {_PICKED}, NOT selected AS selected FROM chosen")
def select_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the smallest file of each group."""
    small = curate.select(_members(spark, sf_dir), "small_file")
    return curate.select(small, "others").select("group_id", "member_ord", "path", "selected")


@query(f"WITH RECURSIVE {_MEMBERS} SELECT {_PICKED} FROM members WHERE group_id IN (SELECT group_id FROM members WHERE contains(path, '/src1'))")
def group_filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.filter_groups(materialize(_members(spark, sf_dir), "members"), "/src1").select("group_id", "member_ord", "path")


@query(f"WITH RECURSIVE {_SMALL} SELECT DISTINCT path FROM chosen WHERE selected")
def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.delete_plan(curate.select(_members(spark, sf_dir), "small_file"))


@query(f"WITH RECURSIVE {_SMALL}, rest AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS c FROM chosen WHERE NOT selected) SELECT {_PICKED} FROM rest WHERE c > 1")
def group_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after their smallest files are gone."""
    members = materialize(_members(spark, sf_dir), "members")
    gone = curate.delete_plan(curate.select(members, "small_file"))
    return curate.shrink(members, gone).select("group_id", "member_ord", "path")


@query(f"WITH RECURSIVE {_MEMBERS} SELECT kind, count(DISTINCT group_id) AS n_groups, count(*) AS n_members FROM members GROUP BY kind")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.counts(_members(spark, sf_dir))


@query(f"""WITH {_HASHED}, {_LENGTHS}, links AS (SELECT a.id AS id_a, b.id AS id_b FROM hashed a JOIN hashed b ON a.ord < b.ord WHERE bit_count(xor(a.h, b.h)) < {FAR}),
    p AS (SELECT id_a, id_b, x.length AS length_a, y.length AS length_b, CAST(floor(least(x.length, y.length) / 5) AS INTEGER) AS rate FROM links JOIN lengths x ON x.id = id_a JOIN lengths y ON y.id = id_b)
    SELECT id_a, id_b, CAST(k AS INTEGER) AS k, CAST(rate * k AS INTEGER) AS from_head, CAST(floor(length_a - rate * k) AS INTEGER) AS tail_a, CAST(floor(length_b - rate * k) AS INTEGER) AS tail_b FROM p, range(1, 5) t(k)""")
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at which to compare the pairs."""
    size = materialize(_lengths(spark, sf_dir), "lengths")
    found = _links(spark, sf_dir).select("id_a", "id_b").join(size.select(F.col("id").alias("id_a"), F.col("length").alias("length_a")), "id_a").join(size.select(F.col("id").alias("id_b"), F.col("length").alias("length_b")), "id_b")
    return curate.sampling_plan(found, 4).select("id_a", "id_b", "k", "from_head", "tail_a", "tail_b")


@query(f"""WITH RECURSIVE {_MEMBERS} SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dir, width || ':' || height AS dimension,
    CASE WHEN size = 1 THEN '1 byte' WHEN size < 1000 THEN size || ' bytes' WHEN size < 1000000 THEN format('{{:.1f}} kB', size / 1000.0::DOUBLE) ELSE format('{{:.1f}} MB', size / 1000000.0::DOUBLE) END AS human_size,
    format('{{:f}}', length) AS length_text, kind AS format FROM members""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the result list as text."""
    c = F.col
    return _members(spark, sf_dir).select(*curate.describe(c("path"), c("size"), c("width"), c("height"), c("length"), c("kind")))


# ---------------------------------------------------------------- cache

_CACHED = """files AS (SELECT '/' || source || '/' || doc_id AS path, n_chars AS size, doc_id FROM documents),
    media AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size FROM files WHERE doc_id % 3 <> 0)"""


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listed files, the cache's media (two thirds of them, some changed since) and hashes."""
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("timestamp").alias("mtime"), "doc_id")
    media = docs.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    held = docs.where("doc_id % 3 <> 0").select("path", F.lit(0.0).alias("at"), F.col("doc_id").alias("h"), F.lit(cache.IMAGE_HASH).alias("alg"))
    return docs, media, held


@query(f"WITH {_CACHED} SELECT path, size FROM files WHERE (path, size) NOT IN (SELECT (path, size) FROM media)")
def cache_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to be hashed: not cached, or changed since."""
    files, media, held = _cached(spark, sf_dir)
    return cache.lookup(files, media, held, cache.IMAGE_HASH)[1].select("path", "size")


@query(f"WITH {_CACHED} SELECT f.path, f.doc_id AS h FROM files f JOIN media m ON f.path = m.path AND f.size = m.size")
def cache_lookup_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, media, held = _cached(spark, sf_dir)
    return cache.lookup(files, media, held, cache.IMAGE_HASH)[0].select("path", "h")


@query(f"WITH {_CACHED}, left_ AS (SELECT path FROM files WHERE doc_id % 2 = 0) SELECT m.path, m.size FROM media m WHERE path IN (SELECT path FROM left_)")
def cache_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache without files that are gone (every second one here)."""
    files, media, _ = _cached(spark, sf_dir)
    return cache.vacuum(media, files.where("doc_id % 2 = 0")).select("path", "size")


# ---------------------------------------------------------------- markup


@query("""SELECT page_id, regexp_extract(html, '<html\\s[^>]*?lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS href FROM pages""")
def markup_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of pages' markup."""
    html = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", markup.attribute(html, "html", "lang").alias("lang"), markup.attribute(html, "a", "href").alias("href"))


_META = "CASE doc_id % 5 WHEN 0 THEN concat('cover:#', source) WHEN 1 THEN concat('Cover: ..', source, ':', lang) WHEN 2 THEN concat('title:', lang) WHEN 3 THEN lang ELSE concat('COVER:', source) END"


@query(f"""WITH m AS (SELECT doc_id, {_META} AS meta FROM documents)
    SELECT doc_id, CASE WHEN contains(meta, ':') AND lower(split_part(meta, ':', 1)) = 'cover'
        THEN ltrim(substr(meta, strpos(meta, ':') + 1), ' .#') END AS cover FROM m""")
def cover_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover ids behind the word "cover" alone; marks in front of an id are left out, colons inside stay."""
    return _read(spark, sf_dir, "documents").select("doc_id", markup.cover_id(F.expr(_META)).alias("cover"))


_BOOK = """CASE doc_id % 6 WHEN 0 THEN concat('ISBN (uid:', 97800000 + doc_id, ') ', lang) WHEN 1 THEN concat('CALIBRE (unspecified:', 97800000 + doc_id, ')')
    WHEN 2 THEN concat('other (', doc_id, ')') WHEN 3 THEN concat('uuid (uuid_id:', doc_id, ') isbn (uid:', 97800000 + doc_id, ')')
    WHEN 4 THEN concat('ISBN (uid:', doc_id) ELSE concat('duokan-book-id (uuid_id:', doc_id, ') duokan-book-id:', 97800000 + doc_id, ')') END"""
# the table's first prefix that occurs decides, wherever it is
_FIRST = "CASE " + " ".join(f"WHEN strpos(lower(t), lower('{p}')) > 0 THEN substr(t, strpos(lower(t), lower('{p}')) + {len(p)})" for p in markup.IDENTIFIER_PREFIXES) + " END"


@query(f"""WITH m AS (SELECT doc_id, {_BOOK} AS t FROM documents), r AS (SELECT doc_id, {_FIRST} AS rest FROM m)
    SELECT doc_id, CASE WHEN strpos(rest, ')') > 0 THEN substr(rest, 1, strpos(rest, ')') - 1) ELSE '' END AS isbn FROM r""")
def isbn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", markup.isbn(F.expr(_BOOK)).alias("isbn"))


@query("""SELECT doc_id, lang AS title, source AS author FROM documents""")
def xml_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a namespaced package document, by local names."""
    xml = F.expr("concat('<p:package xmlns:p=\"urn:p\"><p:metadata><title>', lang, '</title><p:creator by=\"', source, '\"/></p:metadata></p:package>')")
    docs = _read(spark, sf_dir, "documents").select("doc_id", xml.alias("x"))
    return docs.select(
        "doc_id",
        markup.xml_value(F.col("x"), "package", "metadata", "title").alias("title"),
        markup.xml_attribute(F.col("x"), "by", "package", "metadata", "creator").alias("author"),
    )
