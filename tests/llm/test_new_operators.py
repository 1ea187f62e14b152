"""Divergence of sources, reassembly of turns and language-model scores against plain Python, and their
handling of nulls, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.llm import divergence, lm, packed, reassembly

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["part", "uid", "prefix", "value", "rank", "block", "length", "range", "n", "v", "h", "x", "of", "own", "again", "first", "batch", "at", "payload", "event", "all", "item"]


def clashing(df, keep):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in keep))


# --- whole numbers as bytes


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_pack(xs):
    a = np.array(xs, np.uint64)
    assert packed.unpack(packed.pack(a), np.uint64).tolist() == xs
    assert packed.unpack_sorted(packed.pack_sorted(np.sort(a))).tolist() == sorted(xs)


@given(st.lists(st.integers(0, 2**50)))
def test_pack_counts(xs):
    data = packed.pack_counts(np.array(xs, np.int64))
    assert packed.unpack_counts(packed.unsqueezed(packed.squeezed(data))).tolist() == xs


# --- divergence


@given(st.lists(st.binary(max_size=6)))
def test_trie_walks_in_byte_order(terms):
    trie = divergence.RadixTrie()
    for t in terms:
        node = trie.node(t)
        node[2] = (node[2] or 0) + 1
    assert list(trie.walk()) == sorted(Counter(terms).items())


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def audit_by_force(rows, least, best):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        g = (lang or "", source or "")
        groups.add(g)
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    differ = lambda p, q: (p - q) ** 2 // (p + q)
    total = {g: sum(counts[g][t] for t in kept[g[0]]) for g in groups}
    out = []
    for g in groups:
        lang, terms = g[0], kept[g[0]]
        v, mates = len(terms), [h for h in groups if h[0] == g[0]]
        pairs = [(h[1], sum(differ(share(counts[g][t], total[g], v), share(counts[h][t], total[h], v)) for t in terms)) for h in mates if h != g]
        whole, best_terms = sum(total[h] for h in mates), []
        for t in terms:
            if counts[g][t]:
                p, q = share(counts[g][t], total[g], v), share(sum(counts[h][t] for h in mates), whole, v)
                if p > q:
                    best_terms.append((t, differ(p, q)))
        for part, found in (("pair", pairs), ("term", best_terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, item, value, k) for k, (item, value) in enumerate(ranked[: best if part == "term" else None], 1)]
    return sorted(out)


def random_docs(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "Ab", "abc", "é", "ÉCOLE", "日本語", "日本", "x" * 300, "İ", "zz"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = [None, "", "  1 2 3", "don't stop-me [now]"] + [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(n)]
    langs, sources = ["en", "en", "de", None, ""], ["s0", "s0", "s0", "s1", "S1", None, "é"]
    return [(k % 50 or None, t, rng.choice(langs), rng.choice(sources), 0) for k, t in enumerate(texts)] + [(1, None, "fr", "only", 0), (2, "few terms here", "it", "a", 0), (3, "others there", "it", "b", 0)]


@pytest.mark.parametrize(("seed", "least", "task_terms"), [(1, 10, 1 << 20), (2, 1, 500), (3, 1000, 1 << 20)])
def test_audit(spark, seed, least, task_terms):
    rows = random_docs(seed)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4), DOCS)
    got = divergence.audit(df, least, 10, task_terms)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == audit_by_force([r[1:4] for r in rows], least, 10)


def test_audit_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.audit(docs).collect())) == audit_by_force(rows, 10, 10)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_beyond_64_bits():
    counts, total = np.array([0, 5, 10**13]), np.array([3 * 10**13] * 3)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // (3 * 10**13) for c in counts]


# --- reassembly


def sha(x):
    return hashlib.sha256(x).hexdigest()


def reassembled_by_force(rows, batches=10):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if t is not None]
    first, arriving = {}, defaultdict(dict)
    for c, t, r, x in rows:
        first[c] = min(first.get(c, t), t)
    for c, t, r, x in rows:
        h = int(sha(f"{'' if c is None else c}:{t}".encode())[:8], 16)
        for b, role in [(h % 10, r), *([((h + 5) % 10, "user")] if h % 7 < 2 else [])]:
            new = (f"{role}|{x}".encode(), role)
            arriving[b][c, t] = min(arriving[b].get((c, t), new), new)
    out, open_, closed = [], {}, set()

    def close(c, b):
        s = open_.pop(c)
        closed.add(c)
        kept = s["kept"]
        left = sorted(t for t in kept if t >= s["next"])
        out.append(("close", sha(",".join(map(str, left)).encode()), c, -1, b, max(kept) - first[c] + 1 - len(kept), sum(t - 1 in kept and kept[t][1] == kept[t - 1][1] for t in kept)))

    for b in range(batches):
        for (c, t), new in arriving[b].items():
            if c in closed:
                out.append(("reject", sha(new[0]), c, t, b, None, None))
                continue
            s = open_.setdefault(c, {"kept": {}, "next": first[c]})
            s["last"] = b
            s["kept"].setdefault(t, new)
        for c, s in open_.items():
            while s["next"] in s["kept"]:
                out.append(("release", sha(s["kept"][s["next"]][0]), c, s["next"], b, None, None))
                s["next"] += 1
        for c in [c for c, s in open_.items() if b - s["last"] >= 2]:
            close(c, b)
    for c in list(open_):
        close(c, batches)
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


def test_reassembly(spark):
    from corpusweave.llm.queries import op12_reassembly

    rng = random.Random(5)
    rows = [(c, t + c % 3 - 1, rng.choice(["user", "assistant", "a|b", None]), rng.choice(["x", "é", "", None, f"text {t}"])) for c in range(40) for t in range(rng.choice([1, 2, 3, 30])) if rng.random() < 0.9]
    rows += rows[:30] + [(c, t, "a", "b|c") for c, t, _, _ in rows[:10]] + [(None, 1, "user", "x"), (None, 3, "user", "y"), (7, None, "user", "gone"), (900, -(10**12), "user", "z"), (900, 10**12, "user", "z")]
    df = clashing(spark.createDataFrame(rows, TURNS), TURNS)
    op12 = op12_reassembly.__globals__
    before, op12["table"] = op12["table"], lambda *_: df
    try:
        got = op12_reassembly(spark, "")
    finally:
        op12["table"] = before
    assert dict(got.dtypes) == {"event": "string", "sha256": "string", "conv_id": "bigint", "turn": "bigint", "batch": "bigint", "n_missing": "bigint", "n_breaks": "bigint"}
    assert Counter(map(tuple, got.collect())) == reassembled_by_force(rows)


def test_reassembly_closes_and_reopens_nothing(spark):
    """Silence of two batches closes, silence of one doesn't; an empty batch counts; the payloads are whole."""
    arriving = [(1, 0, 0), (1, 1, 2), (1, 2, 5), (2, 0, 3), (3, 2, 0), (3, 1, 0), (3, 0, 1)]
    rows = spark.createDataFrame([(c, t, "user", f"user|{c}-{t}", 0, b) for c, t, b in arriving], "conv_id long, turn long, role string, payload string, first long, batch int")
    got = {(r.event, r.conv_id, r.turn, r.payload, r.batch, r.n_missing, r.n_breaks) for r in reassembly.reassemble(rows, 6).collect()}
    released = {("release", c, t, f"user|{c}-{t}", b, None, None) for c, t, b in [(1, 0, 0), (1, 1, 2), (2, 0, 3), (3, 0, 1), (3, 1, 1), (3, 2, 1)]}
    assert got == released | {("close", 1, -1, None, 4, 0, 1), ("reject", 1, 2, "user|1-2", 5, None, None), ("close", 2, -1, None, 5, 0, 0), ("close", 3, -1, None, 3, 0, 2)}


def test_reassembly_of_nothing(spark):
    assert reassembly.reassemble(reassembly.arrivals(spark.createDataFrame([], TURNS)), 2).collect() == []


def test_reassembly_of_many_partitions_writes_few_files(spark, monkeypatch):
    """Small parts asked for by the session don't multiply a batch's files, and a local folder's checkpoint files need no process each."""
    rows = spark.range(20_000).selectExpr("id % 50 conv_id", "id div 50 turn", "'user' role", "concat('user|', sha2(string(id), 256)) payload", "0L first", "int(id % 2) batch")
    manager, small = "spark.sql.streaming.checkpointFileManagerClass", {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before, seen, events, path = {k: spark.conf.get(k) for k in small}, [], reassembly.events, reassembly.table_path
    tops = []
    monkeypatch.setattr(reassembly, "table_path", lambda *a: tops.append(path(*a)) or tops[-1])

    def watched(*a):
        files = Path(tops[0].removeprefix("file:")).glob("fed/part=*/*.parquet")
        seen.append((len(list(files)), spark.conf.get(manager, "").rpartition(".")[2]))
        return events(*a)

    monkeypatch.setattr(reassembly, "events", watched)
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = Counter(r.event for r in reassembly.reassemble(rows, 2).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out == {"release": 20_000, "close": 50}
    assert {x for _, x in seen} == {"FileSystemBasedCheckpointFileManager"} and spark.conf.get(manager, None) is None
    assert len(seen) == 3 and seen[-1][0] <= 2 * 4 + 1


# --- language model


def part_by_force(doc_id):
    crc = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    return lm.HELD_OUT if crc % 7 == 2 else lm.LEFT_OUT if crc % 28 == 3 else lm.KEPT


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + ["\nend"]


def counts_of(texts):
    grams = [Counter(), Counter(), Counter()]
    for text in texts:
        w = ["\nstart", "\nstart", *words_of(text)]
        for k in range(3):
            grams[k].update(tuple(w[i - k : i + 1]) for i in range(2, len(w)))
    return grams


def estimates(text, grams, n_docs):
    """(bucket, f0, f1, f2, f3) at each token."""
    n, v = sum(grams[0].values()), len(grams[0])
    w = ["\nstart", "\nstart", *words_of(text)]
    for i in range(2, len(w)):
        start1, start2 = w[i - 1] == "\nstart", w[i - 1] == w[i - 2] == "\nstart"
        x1 = n_docs if start1 else grams[0][w[i - 1],]
        x2 = n_docs if start2 else grams[1][w[i - 2], w[i - 1]]
        b = 128 + int(math.log2(x2)) if x2 else 64 + int(math.log2(x1)) if x1 else 0
        yield b, 1 / (v + 1), grams[0][w[i],] / max(1, n), grams[1][w[i - 1], w[i]] / x1 if x1 else 0, grams[2][tuple(w[i - 2 : i + 1])] / x2 if x2 else 0


def weights_by_force(rows):
    grams = counts_of([t for i, t in rows if part_by_force(i) == lm.KEPT])
    n_docs = sum(part_by_force(i) == lm.KEPT for i, _ in rows)
    seen = [x for i, t in rows if part_by_force(i) == lm.LEFT_OUT for x in estimates(t, grams, n_docs)]
    allowed = np.array([[1, 1, b >= 64, b >= 128] for b in range(192)], float)
    weights, before = allowed / allowed.sum(1, keepdims=True), -np.inf
    for _ in range(lm.ROUNDS):
        sums, gain = np.zeros((192, 4)), 0.0
        for b, *f in seen:
            s = weights[b] * f
            sums[b] += s / s.sum()
            gain += math.log(s.sum())
        weights = allowed * (sums + lm.PRIOR)
        weights /= weights.sum(1, keepdims=True)
        if not seen or gain - before < lm.LEAST_GAIN * len(seen):
            break
        before = gain
    met = {b for b, *_ in seen}
    for b in range(192):
        if b not in met and b % 64:
            weights[b] = weights[b - 1]
    return weights


def scores_by_force(rows):
    weights = weights_by_force(rows)
    training = [t for i, t in rows if part_by_force(i) != lm.HELD_OUT]
    grams = counts_of(training)
    n, v = sum(grams[0].values()), len(grams[0])
    for i, t in rows:
        w = [(x,) for x in words_of(t)]
        base = sum(math.log10((grams[0][x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(np.dot(weights[b], f)) for b, *f in estimates(t, grams, len(training)))
        yield i, part_by_force(i) == lm.HELD_OUT, len(w), sum(grams[0][x] > 0 for x in w), n, base, score


def test_scores(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["É", "X\x00", "x\x00", "Straße", "don't"]
    rows = [(k, rng.choice([None, "", "\n\t ", "Rare" + str(k)]) if k % 9 == 0 else " ".join(rng.choices(words[: 3 + k % 45], k=rng.randrange(80)))) for k in range(400)]
    rows += rows[:40] + [(None, "w1 w2 nowhere"), (None, None), (5, " ".join(rng.choices(words, k=3000)))]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id", "text"])
    want = sorted(scores_by_force(rows), key=str)
    for size in (1 << 20, 200):
        got = lm.score_texts(df, block_tokens=size, range_bytes=1000)
        assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
        found = sorted(map(tuple, got.collect()), key=lambda r: (str(r[0]), r[1:5], r[5]))
        want.sort(key=lambda r: (str(r[0]), r[1:5], r[5]))
        assert [r[:5] for r in found] == [r[:5] for r in want]
        np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9)


def test_scores_of_long_texts_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(500)) + "  \n" + "y" * 500
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(lm, "PIECE_BYTES", size)
        parts = list(lm._pieces(text.encode()))
        assert sum((p for p, _ in parts), []) == text.encode().split()
        assert [last for _, last in parts] == [False] * (len(parts) - 1) + [True]


def test_probabilities_add_up_to_one():
    """Over all known words and one place for all others, in any context."""
    texts = ["a b c a", "b b c", "", "c a"]
    grams, weights = counts_of(texts), np.random.default_rng(1).dirichlet(np.ones(4), 192)
    weights[:128, 3] = 0
    weights[:64, 2] = 0
    weights /= weights.sum(1, keepdims=True)
    words = [w for (w,) in grams[0]]
    for u, v in [("\nstart", "\nstart"), ("\nstart", "a"), ("a", "b"), ("c", "c"), ("q", "a"), ("a", "q")]:
        x1 = len(texts) if v == "\nstart" else grams[0][v,]
        x2 = len(texts) if u == v == "\nstart" else grams[1][u, v]
        b = int(lm._bucket(np.array([x2]), np.array([x1]))[0])
        p = sum(weights[b] @ [1 / (len(words) + 1), grams[0][w,] / sum(grams[0].values()), grams[1][v, w] / x1 if x1 else 0, grams[2][u, v, w] / x2 if x2 else 0] for w in words)
        assert math.isclose(p + weights[b, 0] / (len(words) + 1), 1)


def test_model_beats_words_alone(spark):
    got = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.05 * got[2]


def test_scores_of_nothing(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
