"""Operator 2 against brute force."""

import numpy as np

from twinscan.llm import covertree


def brute(queries, ids, x, k):
    out = set()
    for q in queries:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out |= {(int(q), n + 1, int(ids[i]), int(score[i])) for n, i in enumerate(order)}
    return out


def run(spark, rows, k=5, block=64, every=7):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    return covertree.top_k(df, F.col("vec_id") % every == 0, k=k, block=block, query_block=8)


def test_brute_force_with_ties_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 6)).astype(np.float32)
    x[100:180] = x[100]  # one vector many times: ties
    x[200:230] = x[200] + rng.normal(0, 0.001, (30, 6))
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).collect()}
    whole = np.floor(1024 * x.astype(float))
    assert got == brute(range(0, 300, 7), np.arange(300), whole, 5)


def plain_rows(ids, x, k, every):
    """Each query id's k best rows of other ids, a row by its best score over the id's vectors."""
    out = []
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        score = (x @ x[ids == q].T).max(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out += [(q, n + 1, int(ids[i]), int(score[i])) for n, i in enumerate(order)]
    return out


def test_repeated_query_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (260, 6)).astype(np.float32)
    ids = np.arange(260)
    ids[100:140], x[100:140] = 7, x[7] * 3  # a hot query id, equal vectors but one
    ids[140:142], x[140:142] = 14, x[14]
    ids[142:145] = 21  # different vectors
    ids[145:147], x[145:147] = 5, x[5]  # repeated candidates
    got = run(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_rows(ids, np.floor(1024 * x.astype(float)), 5, 7)


def test_own_rows_do_not_prune_others():
    rng = np.random.default_rng(5)
    near = rng.normal(0, 1, (400, 4)).round(1) * 100
    own = np.repeat([[900.0, 900, 900, 900]], 30, axis=0)  # far above all others
    x = np.concatenate([own, near])
    ids = np.array([1] * 30 + list(range(2, 402)))
    q, c, score = covertree.best(own[:1], np.array([1]), x, ids, 5)
    want = np.sort(near @ own[0])[::-1][:5]
    assert q.tolist() == [1] * 5 and sorted(score.tolist(), reverse=True) == want.astype(int).tolist()


def test_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 3)), np.zeros((40, 3))])

    def walk(node):
        assert (np.linalg.norm(x[node.rows] - x[node.centre], axis=1) <= node.radius + 1e-6).all()
        held = [*(c.rows.tolist() for c in node.children), node.single.tolist()]
        assert sorted(i for h in held for i in h) == sorted(node.rows.tolist())
        if node.children:
            centres = x[[c.centre for c in node.children]]
            gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
            assert (gap[~np.eye(len(gap), dtype=bool)] > node.radius / 2 - 1e-6).all()
        for child in node.children:
            assert child.radius <= node.radius / 2 + 1e-6
            walk(child)

    root = covertree.cover_tree(x)
    assert sorted(root.rows.tolist()) == list(range(len(x))) and root.children
    walk(root)


def clusters(rng, wide):
    centres = rng.normal(0, 100, (8, 4))
    return np.floor(np.concatenate([c + rng.normal(0, wide, (100, 4)) for c in centres]))


def test_pruned_pairs_are_never_multiplied():
    rng = np.random.default_rng(3)
    x = clusters(rng, 0.8)
    walk = covertree.Search(x[::4], x, 3, np.arange(0, 800, 4), np.arange(800))
    walk.run()
    assert walk.products < 0.4 * 200 * len(x)


def test_walk_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    for leaf, row, seed in ((24, 512, 64), (2, 3, 1)):
        for name, value in (("LEAF", leaf), ("ROW", row), ("SEED", seed)):
            monkeypatch.setattr(covertree, name, value)
        for wide in (0.8, 30):
            x = clusters(rng, wide)
            x[50:90] = x[50]
            ids = rng.permutation(800)
            q = ids % 9 == 0
            a, b, score = covertree.best(x[q], ids[q], x, ids, 4)
            want = sorted((i, j, s) for i, _, j, s in plain_rows(ids, x, 4, 9))
            assert sorted(zip(a.tolist(), b.tolist(), score.tolist(), strict=True)) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (7, None, 1), (1, [None, 1.0], 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 0.0], 1), (4, [0.5, 0.5], 1), (5, [0.5], 1), (None, [1.0, 1.0], 1), (6, [0.5, 0.5], 1), (6, [0.5, 0.5], 1)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, rows).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 524288), (0, 2, 5, 524288), (0, 3, 6, 524288), (0, 4, 6, 524288)]
    assert run(spark, []).count() == 0
    assert run(spark, [(7, [1.0], 0)]).count() == 0
