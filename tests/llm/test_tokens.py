"""Operators 5, 6 and 7: exact round trips, optimal packing on small cases, odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from twinscan.llm import packing, pieces, queries, token_files
from twinscan.llm.tokens import WordTokenizer, default_path
from twinscan.llm.wordgrid import buffers

from .helpers import ODD, no_docs, odd_docs

STRANGE = ["", None, "İstanbul ΑΣ ΑΣ. don't 'tis it's", "b\x1cc <|endoftext|> <|ENDOFTEXT|>", "12ab 3.14 ... !!??", "ạ́ ́x é", "ſtraße ǅ K", "a b　c d", "### $$$ *** x### y,", "漢字 かな"]


@pytest.fixture(scope="module")
def tok():
    return WordTokenizer(default_path(), memo=50)


def test_ids_equal_the_library(tok, spark, tiny):
    texts = STRANGE + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert list(tok.ids(texts, characters=5000)) == tok.whole([t or "" for t in texts])


# ------------------------------------------------------------------ pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(pieces.default_path())


def sample(model, texts, keys, seed=0):
    raw, at = buffers(pa.array(texts, pa.string()))
    ids, count = model.sample(raw, at, np.array(keys), seed)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_decoding_is_lossless(model):
    texts = [t or "" for t in STRANGE] + ["▁ ▁▁ a▁b", "  two  spaces ", "x" * 1000, "\n\t\r", "\x00\x01"]
    for text, ids in zip(texts, sample(model, texts, range(len(texts))), strict=True):
        assert model.decode(np.array(ids, int)).decode() == text


def test_sampling_depends_on_key_and_seed_alone(model):
    texts = ["the weather is nice today and warm"] * 3 + ["other words come first here"]
    a = sample(model, texts, [5, 6, 5, 9])
    assert a[0] == a[2] and a[0] != a[1]
    assert sample(model, texts[:1], [5])[0] == a[0]
    assert sample(model, ["zz yy", texts[0]], [1, 5])[1] == a[0]
    assert any(sample(model, texts[:1], [k], 1)[0] != sample(model, texts[:1], [k], 0)[0] for k in range(5))


def test_exact_posterior(model):
    word, n = b" then", 20000
    weight = {model.bytes_of[i]: (model.weight[k], int(i)) for k, i in enumerate(model.ids)}
    expected = Counter()
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[i:j] for i, j in itertools.pairwise(at)]
        options = [([weight[p]] if p in weight else []) + ([(model.byte_weight, int(model.byte_id[p[0]]))] if len(p) == 1 else []) for p in parts]
        for chosen in itertools.product(*options):
            expected[tuple(c[1] for c in chosen)] += math.exp(sum(c[0] for c in chosen))
    total = sum(expected.values())
    got = Counter(tuple(x) for x in sample(model, [word.decode()] * n, range(n)))
    for ids, value in expected.items():
        p = value / total
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def edge_shares(model, text):
    """Posterior share of every edge (start, piece id), by plain sums over all segmentations."""
    weight = {}
    for k, i in enumerate(model.ids):
        weight.setdefault(model.bytes_of[i], []).append((math.exp(model.weight[k]), int(i)))
    edges = [(a, a + 1, math.exp(model.byte_weight), int(model.byte_id[text[a]])) for a in range(len(text))]
    edges += [(a, b, w, i) for a in range(len(text)) for b in range(a + 1, min(len(text), a + model.longest) + 1) for w, i in weight.get(text[a:b], ())]
    ahead, back = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    for a, b, w, _ in sorted(edges, key=lambda e: e[1]):
        ahead[b] += ahead[a] * w
    for a, b, w, _ in sorted(edges, key=lambda e: -e[0]):
        back[a] += back[b] * w
    return {(a, i): ahead[a] * w * back[b] / back[0] for a, b, w, i in edges}


UNSPACED = ["中国人民大学的学生在日本东京学习国际关系和世界历史文化", "thequickbrownfoxjumpsoverthelazydogandrunsawayfromtheinternationalgovernment/index.html"]


@pytest.mark.parametrize("text", UNSPACED)
@pytest.mark.parametrize("segment", [1 << 16, 23])
def test_posterior_of_unspaced_texts(model, monkeypatch, text, segment):
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    raw, n = text.encode(), 4000 if segment > 64 else 400
    assert len(raw) > 70
    got, over = Counter(), 0
    for ids in sample(model, [text] * n, range(n)):
        at = 0
        for i in ids:
            got[at, i] += 1
            over += at < 64 < at + len(model.bytes_of[i])
            at += len(model.bytes_of[i])
        assert at == len(raw)
    assert over > 0.3 * n  # pieces across byte 64
    for edge, p in edge_shares(model, raw).items():
        assert abs(got[edge] / n - p) < 6 * math.sqrt(p / n) + 6 / n


def test_segments_do_not_change_samples(model, monkeypatch):
    texts = ["".join(UNSPACED) * 3, " and then " + UNSPACED[1] * 2 + " \U0001f600", "a" * 300]
    whole = sample(model, texts, range(3))
    for segment in (5, 64, 100):
        monkeypatch.setattr(pieces, "SEGMENT", segment)
        assert sample(model, texts, range(3)) == whole


def test_pieces_of_odd_rows(spark):
    got = pieces.encode(odd_docs(spark), seed=3)
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    texts = {k: t or "" for k, t, *_ in ODD}
    assert all(r.text == texts[r.doc_id] for r in pieces.decode(got).collect())
    assert pieces.encode(no_docs(spark)).count() == 0
    assert all(r.lossless for r in queries.op5_pieces(spark, "/root/testdata/sf0.001").collect())


def test_documents_come_back_from_the_query(spark, tiny):
    got = queries.op5_pieces(spark, tiny)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    back = pieces.decode(got).collect()
    assert len(back) == len(texts) and all(r.text == texts[r.doc_id] for r in back)
    assert all(r.lossless and len(r.ids) == r.n_pieces for r in got.collect())


# ------------------------------------------------------------------ packing


def fewest(lengths, limit):
    """Least number of bins by trying all."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= limit:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def check(bins, histogram, limit):
    held = Counter()
    for b in bins:
        assert sum(b.lengths) <= limit
        for x in b.lengths:
            held[x] += b.times
    assert held == Counter(histogram)
    return sum(b.times for b in bins)


def test_completion_is_best_on_small_cases():
    r = random.Random(1)
    for _ in range(60):
        lengths = sorted((r.randint(10, 60) for _ in range(r.randint(1, 9))), reverse=True)
        found, bound = packing.complete(Counter(lengths), 100, None)
        n = check(found, Counter(lengths), 100)
        assert bound <= n <= check(packing.best_fit(Counter(lengths), 100), Counter(lengths), 100)
        assert n == fewest(lengths, 100) == bound


def test_options_made_again_continue_where_they_were(monkeypatch):
    monkeypatch.setattr(packing, "HELD", 1)
    r = random.Random(9)
    for _ in range(40):
        lengths = sorted((r.randint(8, 45) for _ in range(r.randint(5, 9))), reverse=True)
        found, bound = packing.complete(Counter(lengths), 100, None)
        assert check(found, Counter(lengths), 100) == fewest(lengths, 100) == bound


def test_completion_beats_best_fit():
    r = random.Random(4)
    lengths = Counter(r.choice([1300, 1400, 1500, 2100, 1366]) for _ in range(2000))
    found, _ = packing.complete(lengths, 4096)
    assert check(found, lengths, 4096) < check(packing.best_fit(lengths, 4096), lengths, 4096)


def plainly_dominated(filling, room, others):
    slack = room - sum(filling)
    for n in range(1, len(filling) + 1):
        for part in itertools.combinations(filling, n):
            for x in others:
                if sum(part) <= x <= sum(part) + slack and not (n == 1 and part[0] == x):
                    return True
    return False


def test_fillings_are_all_undominated_ones():
    r = random.Random(6)
    for _ in range(150):
        room = r.randint(5, 40)
        counts = Counter(r.randint(1, 30) for _ in range(r.randint(1, 9)))
        counts.pop(room, None)
        least = r.randint(0, room)
        want = set()
        for taken in itertools.product(*[range(n + 1) for n in counts.values()]):
            filling = tuple(sorted((s for s, n in zip(counts, taken, strict=True) for _ in range(n)), reverse=True))
            others = [s for s, n in zip(counts, taken, strict=True) if counts[s] > n]
            if least <= sum(filling) <= room and not plainly_dominated(filling, room, others) and not any(s <= room - sum(filling) for s in others):
                want.add(filling)
        got = list(packing.fillings(counts, sorted(counts), room, least))
        assert len(set(got)) == len(got) and set(got) == want
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_lower_bound_counts_lengths_that_cannot_share():
    assert packing.lower_bound({60: 7, 30: 1}, 100) == 7
    r = random.Random(7)
    for _ in range(60):
        lengths = [r.randint(1, 70) for _ in range(r.randint(1, 8))]
        assert packing.lower_bound(Counter(lengths), 100) <= fewest(sorted(lengths, reverse=True), 100)
    found, bound = packing.complete({60: 7, 45: 5}, 100, None)
    assert sum(b.times for b in found) == bound == 10


def test_packing_of_odd_rows(spark, tok):
    rows = packing.pack(odd_docs(spark), limit=512).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    ids = [np.frombuffer(x, "<u4").tolist() + [1] for x in tok.ids([t for _, t, *_ in ODD])]
    want = Counter()
    for (k, *_), x in zip(ODD, ids, strict=True):
        for i in range(0, len(x), 512):
            want[k, i // 512, i, len(x[i : i + 512]), zlib.crc32(np.array(x[i : i + 512], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(no_docs(spark)).count() == 0


def test_places_keep_columns_of_any_name(spark):
    cut = spark.createDataFrame([(1, 0, 5, "a", 1), (2, 0, 5, "b", 2), (3, 0, 3, "c", 3), (3, 0, 3, "c", 3)], "doc_id long, piece int, length long, _at string, _BUCKET int")
    got = packing.place(cut, 8).collect()
    assert [(r.doc_id, r._at, r._BUCKET) for r in sorted(got)] == [(1, "a", 1), (2, "b", 2), (3, "c", 3), (3, "c", 3)]
    assert sorted((r.sequence_id, r.offset, r.length) for r in got) == [(0, 0, 5), (0, 5, 3), (1, 0, 5), (1, 5, 3)]


# ------------------------------------------------------------------ shards of ids


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(0, 5, n), 2).astype("<u4") for n in (0, 1, 50, 4000)] + [np.array([7] * 101 + [2], "<u4"), np.array([2, 2, 2], "<u4")]
    blob = token_files.encode(list(range(len(docs))), docs, 2)
    shard = token_files.Shard(blob)
    whole = np.concatenate(docs)
    assert (shard.all() == whole).all() and len(shard.sequence) < len(whole) / 2
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
    for _ in range(200):
        a, b = sorted(r.integers(0, len(whole), 2))
        if a < b:
            assert (shard.ids(a, b) == whole[a:b]).all()
    assert shard.lengths.tolist() == [len(token_files.expand(np.array([shard.first + i], "<u4"), shard.rules, shard.first)) for i in range(len(shard.rules))]


def test_shards_of_odd_rows(spark, tok):
    rows = [*ODD, (None, "no key", None, None, None)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    got = sorted(token_files.read_shards(token_files.write_shards(docs, shard_ids=200)).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r, (_, text, *_rest) in zip(got, order, strict=True):
        [ids] = list(tok.ids([text]))
        ids += (2).to_bytes(4, "little")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_files.read_shards(token_files.write_shards(no_docs(spark))).count() == 0


def apart(sequence, barrier):
    """How often each pair can be replaced without overlaps."""
    count, last = Counter(), {}
    for i, pair in enumerate(itertools.pairwise(sequence)):
        if barrier not in pair and last.get(pair, -2) < i - 1:
            count[pair] += 1
            last[pair] = i
    return count


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(2)
    phrase = r.integers(0, 50, 700)  # more than 2**6 ids that repeat: rounds go on
    cases = [r.integers(0, 6, 3000), np.concatenate([phrase] * 9), np.zeros(1000, int), np.array([1, 1, 1, 1, 1, 2, 1, 1, 1]), np.zeros(0, int), np.array([3]), r.integers(0, 300, 5000)]
    for ids in cases:
        ids = ids.astype("<u4")
        sequence, rules, lengths = token_files.compress(ids, 1001, 1000)
        assert (token_files.expand(sequence, rules, 1001) == ids).all()
        assert max(apart(sequence.tolist(), 1000).values(), default=0) < 4
        assert len({tuple(x) for x in rules.tolist()}) == len(rules)
    sequence, _, lengths = token_files.compress(cases[1].astype("<u4"), 1001, 1000)
    assert lengths.max() >= 700 and len(sequence) < 40


def test_pairs_found_by_several_tables():
    r = np.random.default_rng(3)
    pair = r.integers(0, 1 << 40, 4000).astype(np.uint64)
    kinds = r.permutation(np.unique(pair))[:3000]
    place = {k: i for i, k in enumerate(kinds.tolist())}
    assert token_files._ranks(pair, kinds).tolist() == [place.get(p, token_files._FAR) for p in pair.tolist()]


def test_a_hot_key_and_extreme_keys(spark):
    rows = [(None, f"no key {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (0, "zero")]
    shards = token_files.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), shard_ids=20)
    assert shards.groupBy("first_key").count().where("first_key = 7").first()[1] > 3
    got = sorted(token_files.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [k for k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
