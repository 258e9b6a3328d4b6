import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from trellis.llm import ngram_join, vectors
from trellis.llm.common import Sets, components


def brute_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    own = Sets(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                own.join(i, j)
    return [(len(s), own.find(i)) for i, s in enumerate(sets)]


def corpus(rng):
    words = ["".join(rng.choice(list("abcdeÉß"), rng.integers(1, 6))) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one\ttwo", "one two three", "two one three"]
    common = " ".join(rng.choice(words, 12))
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(4, 150)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 8)):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            texts.append("  ".join(copy))
    texts += [common + " " + " ".join(rng.choice(words, 20)) for _ in range(40)] + [texts[-1]] * 3
    base = list(rng.choice(words, 100))
    for i in range(60):  # a group of near copies over several blocks
        copy = list(base)
        copy[(i * 7) % 100] = f"w{i}"
        texts.append(" ".join(copy))
    return texts


def test_ngram_join_equals_brute_force(spark):
    for seed, n, percent, rounds in ((1, 4, 85, 3), (2, 5, 80, 1), (3, 2, 60, 0)):
        texts = corpus(np.random.default_rng(seed))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, n=n, percent=percent, block=16, few=8, rounds=rounds).collect()}
        assert [got[i] for i in range(len(texts))] == brute_classes(texts, n, percent)


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (2, "other words stand in here now", None), (2, "a b c d e f", None), (None, "nobody has this text at all", None)]
    rows += [(None, " ".join(f"w{i}" for i in range(60)), None), (3, " ".join(f"w{i}" for i in range(61)), None)]  # a set that only a row without an id has
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string"), n=4).collect()
    assert sorted((r.id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (0, 3), (1, 1), (1, 1), (2, 1), (2, 2), (3, 3)]
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(20)) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    rounds = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), task_edges=1).collect()}
    assert rounds == got


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    near = [v / np.linalg.norm(v) + rng.standard_normal(16) * 0.09 for v in x[:150]]
    group = [x[0] / np.linalg.norm(x[0]) + rng.standard_normal(16) * 0.02 for _ in range(200)]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *group, x[3], x[3]])]
    y = np.array([v for _, v in rows], np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T >= 0.9
    np.fill_diagonal(s, False)
    own = Sets(len(y))
    for a, b in np.argwhere(s).tolist():
        own.join(a, b)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash")).repartition(4)
    got = {r.vec_id: r for r in vectors.near_vectors(df, passes=1, window=2, block=64, tile=16).collect()}
    want, have = int(s.sum()), sum(got[i].n_links for i in range(len(y)))
    assert have == want
    assert all(got[i].n_links == s[i].sum() for i in range(len(y)))
    assert all(got[i].component_id == own.find(i) for i in range(len(y)))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(2000, 2006)] == [(0, i, True) for i in range(2000, 2006)]
    assert (got[2006].n_links, got[2007].component_id, got[2007].kept) == (1, 2006, False)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_vector_passes_go_on_until_recall_is_met(spark):
    rng = np.random.default_rng(6)
    cone = rng.standard_normal(32)
    x = rng.standard_normal((900, 32))
    x[:600] = 1.5 * cone / np.linalg.norm(cone) + x[:600] / np.linalg.norm(x[:600], axis=1, keepdims=True)  # cosines about 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    twins = x[:500] + rng.standard_normal((500, 32)) * 0.45 / 32**0.5
    y = np.vstack([x, twins]).astype(np.float32)
    z = y.astype(np.float64) / np.linalg.norm(y.astype(np.float64), axis=1, keepdims=True)
    s = z @ z.T >= 0.9
    np.fill_diagonal(s, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<float>").repartition(3)
    for more in ({}, {"probes": 100}):
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, complete=False, passes=2, window=8, block=64, **more).collect()}
        assert s.sum() > 200 and sum(got.values()) >= 0.95 * s.sum() and all(got[i] <= s[i].sum() for i in got)


def test_pipeline_judges_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, c), (4, c + " more"), (4, c), (5, ""), (5, ""), (None, "alone")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    texts = [(r.doc_id or 0, r.text) for r in got]
    assert sorted(t for t in texts if t[0] != 4) == [(0, "alone"), (1, a), (2, b), (5, "")]
    assert [t for t in texts if t[0] == 4] in ([(4, c)], [(4, c + " more")])
