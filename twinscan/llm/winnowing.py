"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003), in expressions only.

Tokens are words cut at 16 characters; characters of scripts without spaces are tokens alone. Every
run of ``K`` tokens has a cyclic-polynomial rolling hash; from every window of ``W`` consecutive
hashes the least is marked, the rightmost of equal ones, with its position. So two texts that share
``W + K - 1`` tokens in a row always share a mark, and nothing shorter than ``K`` tokens matches.
A text of fewer tokens has one hash of all of them; a text without tokens has no marks.

A mark is one long: the upper 34 bits of the hash, then the position counted down from 2**30 - 1,
so that the least long is the least hash at the rightmost position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_by, id_bounds

K, W = 4, 6
PLACE_BITS = 30
_PLACES = (1 << PLACE_BITS) - 1
_ALONE = r"぀-ヿ㐀-鿿가-힯"
#: All but blanks and ``_ALONE``, as ranges, the commonest first: a negated class with ``\s`` took most of the time.
_WORD = "!-〿㄀-㏿ꀀ-꯿ힰ-\U0010ffff\\x00-\\x08\\x0e-\\x1f"
TOKEN = rf"[{_WORD}]{{1,16}}+|[{_ALONE}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def marks(text: Column, k: int = K, w: int = W) -> Column:
    """The marks of a text, array<long>, in order of their windows."""
    none = F.array().cast("array<long>")

    def ahead(held: Column, at: Column, j: int) -> Column:
        return F.coalesce(F.get(held, at + j), F.lit(0).cast("long"))

    def rolled(tokens: Column, n: int, then: Callable[[Column], Column]) -> Column:
        """``then`` of the hashes of ``n`` tokens from each one on, by those of half as many."""
        if n == 1:
            return then(tokens)
        half = n // 2 if n % 2 == 0 else n - 1
        joined = lambda part: F.transform(part, lambda x, i: _rotated(x, n - half).bitwiseXOR(ahead(part if n % 2 == 0 else tokens, i, half)))
        return rolled(tokens, half, lambda part: _let(joined(part), then))

    def coded(tokens: Column) -> Column:
        runs = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(1)))
        place = lambda x, i: x.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.lit(_PLACES) - i.cast("long"))
        return rolled(tokens, k, lambda held: F.transform(runs(held), place))

    def least(found: Column) -> Column:
        """Minima of windows, by those of pairs; there is null behind the last one, which no minimum is."""
        step = 2 if w % 2 == 0 else 1
        windows = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - w + 1, F.lit(1)))

        def over(held: Column) -> Column:
            if w <= step:
                return windows(held)
            return F.transform(windows(held), lambda x, i: F.least(x, *[F.get(held, i + j) for j in range(step, w, step)]))

        pairs = F.transform(found, lambda x, i: F.least(x, F.get(found, i + 1))) if step == 2 else found
        return F.array_distinct(_let(pairs, over))

    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))
    return _let(tokens, lambda t: F.when(F.size(t) == 0, none).otherwise(_let(coded(t), least)))


def mark_hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, PLACE_BITS)))


def mark_positions(found: Column) -> Column:
    """Token position of each mark."""
    return F.transform(found, lambda x: (F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``key, marks, hashes, positions`` of every whole text; null counts as empty."""
    found = docs.select(F.col(key), marks(F.coalesce(F.col(text), F.lit("")), k, w).alias("marks"))
    return found.select(key, "marks", mark_hashes(F.col("marks")).alias("hashes"), mark_positions(F.col("marks")).alias("positions"))


def with_next(docs: DataFrame, key: str, columns: list[str], order: list[str], rows: int = 1000, most: int = 20_000) -> DataFrame:
    """Add ``next_<column>`` of the following row in ascending ``key``; after the last, the first.

    Keys are cut into ranges that start at keys which occur. A range's first row also closes the
    range before it, so each range is a task of its own and no window spans all rows. Rows without
    a key come before all others. Repeated keys are ordered by ``order``.
    """
    ids = docs.select(key)
    n = ids.count()
    bounds = id_bounds(ids, key, max(rows, n // most)) or [0]
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    at = bucket_by(F.col(key), bounds, held)
    opens = F.get(held, at) == F.col(key)
    before = F.pmod(at - 1, F.lit(len(bounds)))
    places = F.when(opens, F.array(F.struct(at.alias("b"), F.lit(0).alias("tail")), F.struct(before.alias("b"), F.lit(1).alias("tail")))).otherwise(
        F.array(F.struct(at.alias("b"), F.lit(0).alias("tail")))
    )
    dealt = docs.select("*", F.explode(places).alias("_p")).select("*", F.col("_p.b").alias("_b"), F.col("_p.tail").alias("_tail")).drop("_p")
    beside = Window.partitionBy("_b").orderBy("_tail", key, *order)
    return (
        dealt.select("*", *[F.lead(c).over(beside).alias(f"next_{c}") for c in columns])
        .where("_tail = 0")
        .drop("_b", "_tail")
    )


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts and of the next documents.

    The edited text: the last quarter (floor of code points) replaced by as many of the next
    document's first. Returns ``key, n_chars, marks, hashes, edited_text, edited_marks,
    edited_hashes, next_hashes``. A document alone is its own next. A null text counts as empty.
    Repeated rows and rows of one key are neighbours of each other, in the order of their texts; rows without
    a key come first. Long texts are read whole. No rows give no rows; other columns don't matter.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    first = rows.select(key, "_t", marks(F.col("_t")).alias("marks"))
    lined = with_next(first, key, ["_t", "marks"], ["_t"])
    n = F.length("_t")
    cut = F.floor(n / 4).cast("int")
    text2 = F.concat(
        F.substring(F.col("_t"), F.lit(1), n - cut),
        F.substring(F.coalesce(F.col("next__t"), F.lit("")), F.lit(1), cut),
    )
    none = F.array().cast("array<long>")
    both = lined.select(
        key,
        n.cast("long").alias("n_chars"),
        "marks",
        mark_hashes(F.col("marks")).alias("hashes"),
        text2.alias("edited_text"),
        mark_hashes(F.coalesce(F.col("next_marks"), none)).alias("next_hashes"),
    )
    return both.withColumn("edited_marks", marks(F.col("edited_text"))).withColumn("edited_hashes", mark_hashes(F.col("edited_marks")))


def digest(found: Column) -> Column:
    return F.sha2(F.array_join(found.cast("array<string>"), ","), 256)
