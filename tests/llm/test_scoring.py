"""Operators 1 and 4: held-out accuracy, pieces against plain versions, odd rows."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from twinscan.llm import labelled, quality, queries, toxicity
from twinscan.llm.common import table
from twinscan.llm.wordgrid import grams, words

from .helpers import odd_docs, no_docs

LABELS = "doc_id long, quality int, toxic int"


def accuracy(spark, name, label, sf_dir):
    got = queries.queries()[name](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    return (got["predicted"] == got[label]).mean(), len(got)


def test_quality_holds_out(spark, small):
    right, n = accuracy(spark, "op1_quality", "quality", small)
    assert n > 50 and right > 0.9


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.sign(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60))
    rows, values = [np.arange(5)] * 60, list(x)
    w, b = quality.dual_coordinate_descent(rows, values, y, np.ones(60), 500, 1)

    def loss(v, c):
        return 0.5 * (v @ v + c * c) + np.maximum(0, 1 - y * (x @ v + c)).sum()

    best = loss(w[:5], b)
    for _ in range(300):
        assert loss(w[:5] + 0.05 * rng.normal(size=5), b + 0.05 * rng.normal()) >= best - 1e-3


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c a b", "", "Hello!! WORLD", "x " * 300]
    together = [quality.features(c) for c in words(pa.array(texts))]
    for i, text in enumerate(texts):
        [one] = [quality.features(c)[0] for c in words(pa.array([text]))]
        assert (together[0][0][together[0][1] == i] == one).all()


def test_grams_of_short_texts():
    [chunk] = list(words(pa.array(["a b", "", "a b c d e f", "A  B"])))
    gram, at = grams(chunk, 5)
    assert np.diff(at).tolist() == [1, 0, 2, 1]
    assert gram[0] == gram[-1]


def planted(n=240):
    rng = np.random.default_rng(5)
    calm = [f"wort{i}" for i in range(80)]
    out = []
    for i in range(n):
        body = rng.choice(calm, 60).tolist()
        if i % 3 == 0:
            body[int(rng.integers(0, 60))] = rng.choice(["vile", "rotten", f"badw{i % 7}x"])
        out.append((" ".join(body), int(i % 3 == 0)))
    return out


def test_toxicity_finds_planted_words_anywhere():
    rows = planted()
    net = toxicity.fit([t for t, _ in rows[:180]], [y for _, y in rows[:180]], {0: 120, 1: 60})
    [chunk] = list(words(pa.array([t for t, _ in rows[180:]])))
    right = (net.scores(chunk) >= 0.3) == np.array([y for _, y in rows[180:]])
    assert right.mean() > 0.9


def test_gradients_of_the_network():
    [chunk] = list(words(pa.array(["one two three four", "two five vile"])))
    lex, index = toxicity.lexicon(chunk)
    first, length, _ = toxicity.windows(chunk.at)
    seats = toxicity._seats(first, length, index)
    net = toxicity.Network.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"] += np.random.default_rng(2).normal(0, 0.3, net.p["word"].shape)
    tape = {}
    net.forward(net.embed(lex), seats, length, tape)
    weight = np.array([1.0, -2.0])
    grads = net.backward(tape, weight, lex)
    rng = np.random.default_rng(3)
    for name in ("xf", "ub", "uf", "a", "av", "o", "bf"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            was, step = flat[i], 1e-2
            flat[i] = was + step
            up = float(weight @ net.forward(net.embed(lex), seats, length))
            flat[i] = was - step
            down = float(weight @ net.forward(net.embed(lex), seats, length))
            flat[i] = was
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 500):
        first, length, text = toxicity.windows(np.array([0, n]))
        seen = {i for f, k in zip(first, length, strict=True) for i in range(f, f + k)}
        assert seen == set(range(n))


def test_every_window_start_is_scored():
    sizes = [0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 3, 70]
    at = np.concatenate([[0], np.cumsum(sizes)])
    first, length, text = toxicity.windows(at)
    want = [(at[i] + k, min(n, toxicity.WINDOW), i) for i, n in enumerate(sizes) for k in range(max(n - toxicity.WINDOW + 1, min(n, 1)))]
    assert list(zip(first, length, text, strict=True)) == want


def test_texts_score_as_their_worst_window(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"wort{i}" for i in range(50)], n)) for n in (0, 100, 24, 1, 23, 25, 61)]
    [chunk] = list(words(pa.array(texts)))
    net = toxicity.Network.new(1)
    net.p["word"] = rng.normal(0, 0.5, net.p["word"].shape).astype(np.float32)
    lex, index = toxicity.lexicon(chunk)
    got = net.logits(chunk)
    for i, (a, b) in enumerate(zip(chunk.at, chunk.at[1:])):
        starts = np.arange(a, max(b - toxicity.WINDOW, a) + 1)
        size = np.full(len(starts), min(b - a, toxicity.WINDOW))
        want = net.forward(net.embed(lex), toxicity._seats(starts, size, index), size).max() if b > a else np.nan
        assert got[i] == pytest.approx(want, abs=1e-5, nan_ok=True)


def test_a_passage_counts_wherever_it_starts():
    rng = np.random.default_rng(7)
    passage = rng.choice([f"schimpf{i}" for i in range(30)], toxicity.WINDOW).tolist()
    net = toxicity.Network.new(1)
    net.p["word"] = rng.normal(0, 0.5, net.p["word"].shape).astype(np.float32)
    [alone] = net.logits(next(words(pa.array([" ".join(passage)]))))
    texts = [" ".join(["ruhig"] * k + passage + ["ruhig"] * 60) for k in range(40)]
    assert (net.logits(next(words(pa.array(texts)))) >= alone - 1e-5).all()


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_odd_rows(spark, name):
    learn, score = (quality.learn, quality.score) if name == "quality" else (toxicity.learn, toxicity.score)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], LABELS)
    model = learn(odd_docs(spark), labels, name)
    got = score(odd_docs(spark), model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (1, 5)]
    assert max(same) - min(same) < 1e-5  # single precision
    assert score(no_docs(spark), model).count() == 0
    nothing = learn(no_docs(spark), labels.limit(0), name)
    same = [r.score for r in score(odd_docs(spark), nothing).collect() if r.doc_id in (1, 5, 7)]
    assert max(same) - min(same) < 1e-5


def test_held_out_rows_are_never_learned(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], LABELS)
    chosen, counts = labelled.sample(labels, "quality", 1000)
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in chosen.collect())
    assert sum(counts.values()) == chosen.count()


def labelled_texts(spark, sf_dir, label):
    """Texts and labels that may be learned from, in the order in which the operators learn, and class counts."""
    labels = {}
    for r in table(spark, sf_dir, "labels").collect():
        if r[label] in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            labels[r.doc_id] = max(r[label], labels.get(r.doc_id, 0))
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    chosen = sorted((str(k), k) for k in labels if k in texts)
    return [texts[k] for _, k in chosen], [labels[k] for _, k in chosen], dict(Counter(labels.values())), texts


def plain_features(text):
    [chunk] = list(words(pa.array([text]), 1 << 62))
    return sorted(set(quality.features(chunk)[0].tolist()))


def plain_support_vectors(rows, y, cost, seed):
    """Naive Bayes support vectors with dictionaries: log-count ratios, unit rows, dual coordinate descent."""
    n = [Counter(), Counter()]
    for x, label in zip(rows, y, strict=True):
        n[label].update(x)
    total = [sum(c.values()) + (1 << quality.BITS) for c in n]
    ratio = {f: math.log((n[1][f] + 1) / total[1]) - math.log((n[0][f] + 1) / total[0]) for f in n[0].keys() | n[1].keys() if n[0][f] + n[1][f] > 1}

    def unit(x):
        v = {f: ratio.get(f, 0.0) for f in x}
        size = max(1e-6, math.sqrt(sum(a * a for a in v.values())))
        return {f: a / size for f, a in v.items() if a}

    values = [unit(x) for x in rows]
    weight, bias, alpha = defaultdict(float), 0.0, [0.0] * len(rows)
    square = [sum(a * a for a in v.values()) + 1 for v in values]
    share = [len(y) / 2 / max(1, y.count(c)) for c in (0, 1)]
    rng = np.random.default_rng(seed)
    for _ in range(10):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            sign = 1 if y[i] else -1
            gradient = sign * (sum(weight[f] * a for f, a in values[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost * share[y[i]])
            if new != alpha[i]:
                step, moved = (new - alpha[i]) * sign, max(moved, abs(new - alpha[i]))
                alpha[i] = new
                bias += step
                for f, a in values[i].items():
                    weight[f] += step * a
        if moved < 1e-3:
            break
    return lambda x: sum(weight[f] * a for f, a in unit(x).items()) + bias


def test_quality_equals_a_plain_version(spark, tiny):
    texts, y, counts, documents = labelled_texts(spark, tiny, "quality")
    rows = [plain_features(t) for t in texts]
    fold = np.random.default_rng(7).permutation(len(rows)) % 3
    margin = [0.0] * len(rows)
    for k in range(3):
        inside = [i for i in range(len(rows)) if fold[i] != k]
        model = plain_support_vectors([rows[i] for i in inside], [y[i] for i in inside], 1.0, 7)
        for i in range(len(rows)):
            if fold[i] == k:
                margin[i] = model(rows[i])
    weigh = np.array([counts[c] / y.count(c) for c in y])
    slope, shift = quality._logistic(np.array(margin), np.array(y, float), weigh / weigh.mean())
    model = plain_support_vectors(rows, y, 1.0, 7)
    got = queries.op1_quality(spark, tiny).collect()
    assert {r.doc_id for r in got} == documents.keys() and len(set(y)) == 2
    for r in got:
        want = 1 / (1 + math.exp(-(slope * model(plain_features(documents[r.doc_id])) + shift)))
        assert r.score == pytest.approx(want, abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)


def plain_logit(net, x):
    """One window, word by word, in double precision."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    soft = lambda v: v / (1 + abs(v))
    ways = []
    for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), [None] * len(x)
        for t in order:
            drive, u = x[t] @ p[f"x{way}"] + p[f"b{way}"], p[f"u{way}"]
            gates = (1 + soft(drive[: 2 * h] + state @ u[:, : 2 * h])) / 2
            z, r = gates[:h], gates[h:]
            state = (1 - z) * state + z * soft(drive[2 * h :] + (r * state) @ u[:, 2 * h :])
            out[t] = state
        ways.append(out)
    states = [np.concatenate([f, b]) for f, b in zip(*ways, strict=True)]
    e = np.exp([soft(s @ p["a"] + p["ab"]) @ p["av"] for s in states])
    return float(sum(w * s for w, s in zip(e / e.sum(), states, strict=True)) @ p["o"] + p["ob"][0])


def test_toxicity_equals_a_plain_forward_pass(spark, tiny):
    """Every window of every document of at most 160 words, by loops."""
    net = toxicity.learn(table(spark, tiny, "documents"), table(spark, tiny, "labels"))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, tiny).collect()}
    documents = {r.doc_id: r.text or "" for r in table(spark, tiny, "documents").collect()}
    assert got.keys() == documents.keys()
    seen = 0
    for k, text in documents.items():
        [chunk] = list(words(pa.array([text]), 1 << 62))
        n = len(chunk.starts)
        if n > 160:
            continue
        lex, index = toxicity.lexicon(chunk)
        x = net.embed(lex)[index].astype(float) if n else None
        logits = [plain_logit(net, x[i : i + toxicity.WINDOW]) for i in range(max(1, n - toxicity.WINDOW + 1))] if n else []
        want = 1 / (1 + math.exp(-(net.slope * max(logits) + net.shift))) if n else net.empty
        r = got[k]
        assert r.score == pytest.approx(want, abs=2e-4)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        seen += 1
    assert seen > 40


def test_toxicity_of_held_out_documents():
    """The table of 10,000 documents: what is learned from its labels holds for those held out."""
    import duckdb

    sf = os.path.join(os.environ.get("TEST_DATA", "/root/testdata"), "sf0.1")
    found = duckdb.sql(f"select doc_id, text, toxic from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) where toxic is not null").fetchall()
    found.sort(key=lambda r: str(r[0]))
    out = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in found]
    held, known = ([r for r, o in zip(found, out, strict=True) if o == side] for side in (True, False))
    counts = Counter(r[2] for r in known)
    learn = [r for c in (0, 1) for r in [x for x in known if x[2] == c][:1500]]
    net = toxicity.fit([r[1] or "" for r in learn], [r[2] for r in learn], dict(counts))
    score = np.concatenate([net.scores(c) for c in words(pa.array([r[1] for r in held]))])
    toxic, said = np.array([r[2] == 1 for r in held]), score >= 0.3
    assert (toxic & said).sum() / toxic.sum() > 0.8 and (toxic & said).sum() / said.sum() > 0.8
    assert (~toxic & said).sum() / (~toxic).sum() < 0.03
