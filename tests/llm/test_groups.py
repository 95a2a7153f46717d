"""Operators 8, 9 and 10 against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinscan.llm import chat, jaccard, queries, sharding
from twinscan.llm.wordgrid import words

from .helpers import LONG, ODD, no_docs, odd_docs

# ------------------------------------------------------------------ sharding


def test_tree_against_a_list():
    r, tree, held = random.Random(2), sharding.CapacityTree(), []
    for i in range(600):
        if held and r.random() < 0.4:
            key = held.pop(r.randrange(len(held)))
            tree.remove(key)
        else:
            key = (r.randrange(50), i)
            held.append(key)
            tree.insert(key)
        size = r.randrange(55)
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [(rest, i) for i, rest in enumerate(bins) if rest >= s]
        if fits:
            bins[min(fits)[1]] -= s
        else:
            bins.append(max(0, capacity - s))
    return len(bins), sorted(bins)


def test_runs_equal_single_best_fit():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.choice((1, 2, 3, 5, 8, 13, 21, 40)) for _ in range(r.randint(1, 80))]
        plan = sharding.best_fit_decreasing(Counter(sizes), 40)
        load, seen = Counter(), Counter()
        for size, lo, hi, first, per in plan.runs:
            for rank in range(lo, hi):
                load[first + (rank - lo) // per] += size
                seen[size] += 1
        assert seen == Counter(sizes)
        n, rest = plain_best_fit(sizes, 40)
        assert plan.bins == n and sorted(40 - load[i] for i in range(n)) == rest


def test_shards(spark, small):
    rows = queries.op8_sharding(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    assert len(rows) == len(docs)
    text = docs.loc[rows.doc_id].text.to_numpy()
    assert (rows["size"].to_numpy() == [len(t.encode()) + 1 for t in text]).all()
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.01 * sums.mean()
    where = defaultdict(set)
    for t, s in zip(text, rows.shard, strict=True):
        where[t].add(s)
    assert all(len(s) == 1 for s in where.values())
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards_beside_a_group_of_a_third(spark):
    rng = random.Random(5)
    rows = [(i, "x" * 299) for i in range(100)] + [(1000 + i, f"{i} " + "y" * rng.randint(20, 170)) for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), bins=8).toPandas()
    assert len(got) == len(rows) and 0.3 < 30000 / got["size"].sum() < 0.4
    hot = set(got[got.doc_id < 1000].shard)
    others = got[got.doc_id >= 1000].groupby("shard")["size"].sum()
    assert len(hot) == 1 and len(others) == 7 and not hot & set(others.index)
    assert others.max() - others.min() < 0.02 * others.mean()


def test_groups_above_a_fair_share_lie_alone():
    r = random.Random(4)
    for _ in range(200):
        bins = r.randint(1, 9)
        sizes = [r.choice((1, 2, 3, 5, 8)) for _ in range(r.randint(0, 60))] + [r.choice((40, 90, 90, 400)) for _ in range(r.randint(1, 6))]
        plan = sharding.fit_into(Counter(sizes), bins)
        seen, held = Counter(), defaultdict(list)
        for size, lo, hi, first, per in plan.runs:
            for rank in range(lo, hi):
                seen[size, rank] += 1
                held[first + (rank - lo) // per].append(size)
        assert seen == Counter((s, k) for s, n in Counter(sizes).items() for k in range(n))
        assert len(held) == plan.bins <= bins and set(held) == set(range(plan.bins))
        left, total = bins, sum(sizes)
        for size in sorted(sizes, reverse=True):
            if size * left <= total:
                break
            assert [size] in held.values()
            left, total = left - 1, total - size


def test_shards_of_odd_rows(spark):
    rows = sharding.shard(odd_docs(spark), bins=3).collect()
    assert len(rows) == len(ODD)
    assert len({r.shard for r in rows if r.doc_id in (1, 5)}) == 1
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert sharding.shard(no_docs(spark)).count() == 0
    fixed = sharding.shard(odd_docs(spark), bins=None, capacity=200).collect()
    load = Counter()
    for r in fixed:
        load[r.shard] += r.size
    # the long text, the long word and the three copies are each above the capacity, and so alone
    assert sorted(v for v in load.values() if v > 200) == sorted([len(LONG) + 1, 5001, *([3 * 58] if 3 * 58 > 200 else [])])
    alone = {r.shard for r in fixed if r.doc_id in (6, 9)}
    assert len(alone) == 2 and all(r.shard not in alone for r in fixed if r.doc_id not in (6, 9))


# ------------------------------------------------------------------ near duplicates


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc -> (class, links) over all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    up, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if (not a and not b) or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, least[find(i)], links[i]) for i, (k, _) in enumerate(sets))


def found(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(n for _, _, n in want)
    assert found(jaccard.near_duplicates(docs)) == want


@pytest.mark.parametrize("large", [1 << 15, 100])
def test_large_group_of_near_copies(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "BLOCK", 30)
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    common = "this passage is shared by many documents that are otherwise not alike at all " * 1
    rows += [(1000 + i, common + " ".join(f"y{r.random()}" for _ in range(40))) for i in range(100)]
    rows += [(2000 + i, " ".join(base)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.near_duplicates(df)) == brute(rows)


def edited_copies(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append(" ".join(w))
    return out


def test_chosen_paths_lose_no_linked_pair(monkeypatch):
    """Every pair at the threshold meets in a candidate component, in dense and in sparse buckets."""
    monkeypatch.setattr(jaccard, "LEAF", 16)
    r = random.Random(2)
    texts = []
    for n, most in ((150, 2), (150, 6), (100, 14)):
        texts += edited_copies(r, [f"w{r.random()}" for _ in range(150)], n, most)
    texts += [" ".join([f"common{i}" for i in range(12)] + [f"y{r.random()}" for _ in range(60)]) for _ in range(200)]
    [chunk] = list(words(pa.array(texts), 1 << 62))
    gram, at = jaccard.shingle_sets(chunk)
    sketch = (jaccard.minhashes(gram, at) & np.uint32(255)).astype(np.uint8)
    sets = np.split(gram, at[1:-1])
    both = jaccard.intersections(sets)
    size = np.diff(at)
    link = 10 * both >= 8 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, True)
    up = np.arange(len(texts))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for seed in range(2):
        for i, j in jaccard.chosen_paths(seed, sketch, size, 0.8):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                up[find(a)] = find(b)
    root = np.array([find(i) for i in range(len(texts))])
    i, j = np.nonzero(np.triu(link, 1))
    assert len(i) > 2000 and (root[i] == root[j]).all()
    assert len(set(root.tolist())) > 150  # unlike texts stay apart


def test_spread():
    r = np.random.default_rng(3)
    linked = r.random((60, 60)) < 0.015
    linked |= linked.T
    np.fill_diagonal(linked, True)
    want = np.arange(60)
    for _ in range(60):
        want = np.where(linked, want[None, :], 60).min(1)
    assert (jaccard.spread(linked) == want).all()


def test_runs_meet_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        runs = jaccard.runs_for(recall, 0.8)
        lost = 0.0
        for _ in range(300):
            lost = (0.2 + 0.8 * lost) ** jaccard.FAN
        assert lost**runs <= 1 - recall < lost ** (runs - 1)


def test_intersections():
    r = np.random.default_rng(4)
    a, b = ([np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 50)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard.intersections(a, b).tolist() == want
    sets = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in r.integers(0, 60, 80)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert jaccard.intersections(sets).tolist() == want
    assert jaccard.intersections(sets[:30], sets[30:]).tolist() == [w[30:] for w in want[:30]]
    assert jaccard.intersections([]).shape == (0, 0)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(k, t) for k, t, *_ in ODD]
    assert found(jaccard.near_duplicates(odd_docs(spark))) == brute(rows)
    assert jaccard.near_duplicates(no_docs(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_links for r in jaccard.near_duplicates(nulls).collect()) == [0, 2, 2, 2]
    kept = jaccard.keep_one(odd_docs(spark)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 6, 7, 8, 9]
    assert jaccard.keep_one(nulls).count() == 2
    assert jaccard.keep_one(no_docs(spark)).count() == 0


def test_keep_one_of_clashing_names_and_repeated_keys(spark):
    rows = [(1, "a b c d e f", 777, "u", 7), (1, "quite another text of that key", 778, "v", 8), (2, "a b c d e f", 779, "w", 9), (1, "a b c d e f", 777, "u", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _row string, _HASH int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[1]]


# ------------------------------------------------------------------ chat

NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] <\\s>", "[", "<", "[/INST", "<<SYS>>", "a<</SYS>>b", "[:]x[ROLE]", "", "\n", "<s></s>", "\\", "$1 \\$2", "[INST][/INST]" * 3, "<<s>", "[[/INST]"]


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(5)
    rows = []
    for c in range(80):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", "[:]", "", None]), "".join(r.choice(NASTY) for _ in range(r.randint(0, 3)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    source = defaultdict(list)
    for c, _, role, text in rows:
        source[c].append((role or "", text))
    assert all(x.round_trip for x in got.values())
    for c, turns in source.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
    assert any(x.escaped for x in got.values()) and not all(x.escaped for x in got.values())


def test_digests(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append((r.role, r.text or ""))
    by[-1] = [("user", NASTY[0]), ("assistant", NASTY[0])]
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, tiny).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        if c != -1:
            n = {"user": 13, "assistant": 7, "system": 15}
            assert got[c].formatted_chars == sum(n[a] + len(b) for a, b in turns)


def test_chat_odd_rows(spark):
    rows = [(1, None, "user", "x", 1), (1, 1, None, None, 1), (1, 1, None, None, 1), (None, 0, "assistant", "y" * 200000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(got[1].turns) == 3 and got[None].round_trip and got[1].turns[0].text == "x"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_native_plan(spark, tiny):
    for name in ("op3_winnowing", "op10_chat_format"):
        plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
