"""The lexicon matcher, the linear classifier and the trained tagger against plain Python."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.functions import lexical
from corpusweave.operators import lexicon, linear, tagger

# --- lexicon


def features_of(tokens):
    out = []
    for kind, skip, offsets in lexical.FEATURES:
        for i in range(len(tokens) - max(offsets, default=0)):
            out.append((kind, skip, "\t".join([tokens[i], *(tokens[i + o] for o in offsets)])))
    return out


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d2", "가나", "zz"]
    return [None, "", "a", "A b", "--"] + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]


def some_terms(texts, seed=2):
    every = sorted({f for t in texts for f in features_of((t or "").lower().split())})
    rng = random.Random(seed)
    terms = [(*f, rng.choice([0.05, 0.5, 2.0])) for f in rng.sample(every, 40)]
    return terms + terms[:3] + [("unigram", 0, "not\tone", 1.0), ("bigram", 2, "a\tb", 1.0), ("unigram", 0, "absent", 1.0)]


@pytest.mark.parametrize("most", [10**6, 5])
def test_density(spark, most):
    """Shipped and joined lexicons give the same rows."""
    texts = some_texts()
    terms = some_terms(texts)
    weights = Counter()
    for kind, skip, key, w in terms:
        weights[kind, skip, key] += w
    want = {}
    for k, t in enumerate(texts):
        f = features_of((t or "").replace("-", "").lower().split())
        hits = [weights[x] for x in f if x in weights]
        if hits:
            want[k] = 1000.0 * sum(hits) / len(f)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = lexicon.density(rows, ["k"], spark.createDataFrame(terms, "kind string, skip int, key string, weight double"), most)
    got = {r["k"]: r["anti_slop_density"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_density_without_terms(spark):
    rows = spark.createDataFrame([(1, "a b")], "k long, text string")
    assert lexicon.density(rows, ["k"], spark.createDataFrame([], "kind string, skip int, key string, weight double")).count() == 0


def test_feature_counts(spark, monkeypatch):
    texts = [(k % 3 or None, t) for k, t in enumerate(some_texts(5))]
    want = Counter((g, *f) for g, t in texts for f in features_of((t or "").replace("-", "").lower().split()))
    rows = spark.createDataFrame(texts, "g int, text string").repartition(2)
    got = lexicon.feature_counts(rows, ["g"]).groupBy("g", "kind", "skip", "key").agg(F.sum("n").alias("n")).collect()
    assert Counter({tuple(r)[:4]: r["n"] for r in got}) == want
    got = lexicon.feature_counts(rows, []).groupBy("kind", "skip", "key").agg(F.sum("n")).count()
    assert got == len({f[1:] for f in want})


def test_codes_of_wide_columns():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (4, 500))
    a[:, ::2] += 1 << 20
    codes = lexicon._codes(list(a))
    assert len({*map(tuple, a.T.tolist())}) == len(np.unique(codes)) == len({(c, *x) for c, x in zip(codes.tolist(), a.T.tolist(), strict=True)})


# --- linear classifier


def plain_features(text, forms, tags, bits):
    """Hashed features by loops over the text's characters and tokens."""
    one = lambda xs, n: linear._runs(np.zeros(len(xs), np.int64), np.array(xs, np.uint64), n)[1].tolist()
    chars = [h for n in linear.CHARS for k in range(len(text) - n + 1) for h in one([ord(c) for c in text[k : k + n]], n)]
    out = {0: 1.0}
    sequence = []
    if forms is not None:
        hashed = lambda w: int(linear._hashes(pa.array([w]))[0])
        for f, t in zip(forms, tags, strict=True):
            sequence += [int(linear._mixed(np.array([hashed(f)], np.uint64) * linear._ODD + np.uint64(hashed(t)))[0]), hashed(t)]
    pairs = [h ^ int(linear._ODD) for n in (1, 2) for k in range(len(sequence) - n + 1) for h in one(sequence[k : k + n], n)]
    for part in (chars, pairs):
        places = Counter(1 + int(linear._mixed(np.array([h], np.uint64))[0]) % ((1 << bits) - 1) for h in part)
        length = math.sqrt(sum((1 + math.log(n)) ** 2 for n in places.values()))
        for p, n in places.items():
            out[p] = out.get(p, 0) + (1 + math.log(n)) / length
    return out


TAGGED = [("The cat sat.", ["The", "cat", "sat", "."], ["MM", "NNG", "VV", "SF"]), ("", [], []), ("é", ["é"], ["NNG"]), ("aaaaaaa aaaaaaa", ["aaaaaaa", "aaaaaaa"], ["NNG", "NNG"])]


@pytest.mark.parametrize("bits", [18, 5])
def test_features_and_decisions(spark, bits):
    weights = np.random.default_rng(3).normal(size=1 << bits)
    want = [sum(weights[p] * v for p, v in plain_features(*row, bits).items()) for row in TAGGED]
    forms, tags = (pa.array([r[k] for r in TAGGED], pa.list_(pa.string())) for k in (1, 2))
    np.testing.assert_allclose(linear.decide(weights, [r[0] for r in TAGGED], forms, tags), want)
    rows = spark.createDataFrame([*TAGGED, (None, [], [])], "text string, forms array<string>, tags array<string>")
    got = [r[0] for r in rows.select(linear.decision(weights, F.col("text"), F.col("forms"), F.col("tags"))).collect()]
    np.testing.assert_allclose(got[:-1], want)
    assert got[-1] is None
    plain = [sum(weights[p] * v for p, v in plain_features(r[0], None, None, bits).items()) for r in TAGGED]
    np.testing.assert_allclose([r[0] for r in rows.limit(4).select(linear.decision(weights, F.col("text"))).collect()], plain)


def test_descend_equals_plain_steps():
    rng = np.random.default_rng(4)
    rows = [(float(rng.choice([-1.0, 1.0])), np.unique(rng.integers(0, 50, 8)).astype("<u4"), None) for _ in range(300)]
    rows = [(y, p, rng.random(len(p))) for y, p, _ in rows]
    cost, penalty = {1.0: 0.7, -1.0: 2.0}, 0.01
    w = np.zeros(50)
    for k, (y, p, v) in enumerate(rows, 1):
        rate = 1 / (penalty * k + 1)
        margin = y * sum(w[i] * x for i, x in zip(p, v, strict=True))
        w *= 1 - rate * penalty
        if margin < 1:
            for i, x in zip(p, v, strict=True):
                w[i] += rate * cost[y] * y * x
    np.testing.assert_allclose(linear.descend(rows, np.zeros(50), 0, penalty, cost), w)


def test_fit_separates(spark):
    rng = random.Random(6)
    good, bad = ["river", "stone", "meadow", "lantern"], ["click", "offer", "cheap", "subscribe"]
    rows = [(" ".join(rng.choices((good if k % 4 else bad) + ["the", "and", "with"], k=30)), bool(k % 4)) for k in range(300)]
    df = spark.createDataFrame([*rows[:240], ("no label", None), (None, True)], "text string, label boolean").repartition(4)
    weights = linear.fit(df, rounds=6)
    found = linear.decide(weights, [t for t, _ in rows[240:]])
    assert np.mean((found > 0) == np.array([y for _, y in rows[240:]])) > 0.95
    assert not linear.fit(df.where("label"), rounds=2).any()


# --- tagger


def small_model(seed=7):
    rng = random.Random(seed)
    counts = [("follows", b, a, rng.randrange(1, 50)) for a in tagger.TAGS for b in tagger.TAGS]
    features = {f for w in WORDS for first in (True, False) for f in tagger.word_features(w, first)}
    return tagger.Model(counts + [("emits", t, f, rng.randrange(1, 20)) for t in tagger.OPEN for f in sorted(features) if rng.random() < 0.8])


WORDS = ["Running", "dog", "Dog", "quickly", "nice", "LOUD", "가다", "x1", "walked"]
CLOSED = ["the", ".", ",", "12", "very", "is"]


def best_path(model, forms):
    """The likeliest tags among all paths."""
    choices, first = [], [k == 0 or tagger.closed_tag(forms[k - 1]) == tagger.EDGE for k in range(len(forms))]
    for f in forms:
        closed = tagger.closed_tag(f)
        choices.append([closed] if closed else list(tagger.OPEN))
    at = tagger.TAGS.index
    best = None
    for path in itertools.product(*choices):
        p = sum(model.between[at(a), at(b)] for a, b in zip(["SF", *path], [*path, "SF"], strict=True))
        p += sum(model.emission(f, first[k])[tagger.OPEN.index(t)] for k, (f, t) in enumerate(zip(forms, path, strict=True)) if not tagger.closed_tag(f))
        best = max(best or (p, path), (p, path), key=lambda x: x[0])
    return best


def test_viterbi_finds_the_best_path():
    rng = random.Random(8)
    model = small_model()
    texts = [[], ["dog"], ["."], *([rng.choice(WORDS + CLOSED) for _ in range(rng.randrange(1, 7))] for _ in range(60))]
    got = model.tags(pa.array(texts, pa.list_(pa.string()))).to_pylist()
    at = tagger.TAGS.index
    for forms, tags in zip(texts, got, strict=True):
        want, _ = best_path(model, forms)
        first = [k == 0 or tagger.closed_tag(forms[k - 1]) == "SF" for k in range(len(forms))]
        p = sum(model.between[at(a), at(b)] for a, b in zip(["SF", *tags], [*tags, "SF"], strict=True))
        p += sum(model.emission(f, first[k])[tagger.OPEN.index(t)] for k, (f, t) in enumerate(zip(forms, tags, strict=True)) if not tagger.closed_tag(f))
        assert math.isclose(p, want, abs_tol=1e-9)


def test_seed_is_the_list_tagger(spark):
    from corpusweave.functions import tagging

    text = "The Dog quickly walked; it's running, 12 très Élan. wonderful 가다 매우 x ÉCOLE"
    rows = spark.createDataFrame([(text,)], "text string").select(tagging.tagged(F.col("text")).alias("t")).first()["t"]
    assert [tagger.seed_tag(r["form"]) for r in rows] == [r["tag"] for r in rows]


def test_counts_of_the_seeds(spark):
    texts = ["The dog walked. Running dog", "", None, "the nice Dog"]
    words = [["The", "dog", "walked", ".", "Running", "dog"], ["the", "nice", "Dog"]]
    want = Counter()
    for forms in words:
        tags = [tagger.seed_tag(f) for f in forms]
        for a, b in zip(["SF", *tags], [*tags, "SF"], strict=True):
            want["follows", b, a] += 1
        for k, f in enumerate(forms):
            if not tagger.closed_tag(f):
                for feature in dict.fromkeys(tagger.word_features(f, k == 0 or forms[k - 1] == ".")):
                    want["emits", tags[k], feature] += 1
    got = tagger.counted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)).collect()
    assert Counter({tuple(r)[:3]: r["n"] for r in got}) == want


def test_trained_tags(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = tagger.train(docs)
    rows = docs.select("text", model.tagged(F.col("text")).alias("t")).collect()
    for r in rows:
        assert [x["form"] for x in r["t"]] == __import__("re").findall(tagger.TOKEN, r["text"] or "")
        assert all(x["tag"] == (tagger.closed_tag(x["form"]) or x["tag"]) and (tagger.closed_tag(x["form"]) or x["tag"] in tagger.OPEN) for x in r["t"])
    seeds = [(tagger.seed_tag(x["form"]), x["tag"]) for r in rows for x in r["t"]]
    assert 0.7 < np.mean([a == b for a, b in seeds]) < 1.0
