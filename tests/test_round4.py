"""Steps that the fourth round of findings replaced, against plain Python and their former forms."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusweave.functions import style_arrays, tagging, text, text_arrays
from corpusweave.llm import line_rules, repeats
from corpusweave.operators import scorer, tagger


def test_training_reads_texts_once_a_round(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(k, "The cat walked slowly. A dog ran.") for k in range(7)], "doc_id long, text string")
    tagger.train(docs.select("doc_id", F.udf(counted, "string")("text").alias("text")), rounds=2)
    assert seen.value == 2 * 7


def test_style_arrays_by_hand():
    texts = [["The", "cat", ",", "quickly", "ran", "."] * 60, [], None, ["an", ",", "odd", ",", "thing"], ["!"] * 90]
    sentences = [[["The", "cat", ",", "ran", "."], ["."], ["A", "dog"]] * 12, [], None, [["an", "odd", "thing"]], [["!"]] * 90]
    a, b = pa.array(texts, pa.list_(pa.string())), pa.array(sentences, pa.list_(pa.list_(pa.string())))
    got = style_arrays.measured(a, tagging.tags_of(a), b, tagging.tags_of(b.flatten())).to_pylist()
    for text, parts, m in zip(texts, sentences, got, strict=True):
        tags = [tagging.word_tag(w) for w in text or []]
        plain = [t for t in tags if not t.startswith("S")]
        near = collections.Counter(tags[j] for i, w in enumerate(text or []) if w == "," for j in range(max(0, i - 3), min(len(tags), i + 4)) if j != i and not tags[j].startswith("S"))
        n = sum(near.values())
        assert m["morph_count"] == len(tags) and m["pos_token_count"] == len(plain)
        assert m["comma_context_pos_entropy"] == pytest.approx(-sum(c / n * math.log(c / n) for c in near.values()) if n else 0.0)
        grams = collections.Counter(tuple(plain[i : i + 3]) for i in range(len(plain) - 2))
        want = sum(c for c in grams.values() if c > 1) / sum(grams.values()) if grams else None
        assert m["pos_3gram_repeat_rate"] == (pytest.approx(want) if grams else None)
        starts = range(0, len(plain) - 199, 100) if len(plain) >= 200 else [0] if len(plain) >= 80 else []
        shares = []
        for s in starts:
            c = collections.Counter(tuple(plain[s : s + 200][i : i + 2]) for i in range(len(plain[s : s + 200]) - 1))
            shares.append(sum(x for x in c.values() if x > 1) / sum(c.values()))
        assert m["pos_2gram_window_recurrence"] == pytest.approx(np.mean(shares) if shares else 0.0)
        lengths = [len([w for w in s if not tagging.word_tag(w).startswith("S")]) for s in parts or []]
        assert m["sentence_length_mean_morphs"] == (pytest.approx(np.mean(lengths)) if lengths else None)
        assert m["sentence_length_cv"] == (pytest.approx(np.std(lengths) / np.mean(lengths)) if sum(lengths) else None)
        assert m["sentence_length_median_morphs"] == pytest.approx(np.median(lengths) if lengths else 0.0)


def test_cycles_and_bursts_by_hand():
    rng = random.Random(3)
    texts = ["", "x" * 19 + "가" * 9, "!" * 20, "ab" * 6, "ab" * 5 + "a", "xabcabcabcabcabcabc", "y" + "0123456789abcdefghijklmnopqrst" * 6, "z" + "0123456789abcdefghijklmnopqrstu" * 6]
    texts += ["".join("".join(rng.choice("ab\n") for _ in range(rng.randrange(1, 7))) * rng.randrange(1, 8) for _ in range(4)) for _ in range(300)]
    want = [bool(re.search(r"(?s)(.{2,30})\1{5,}|([가-힣A-Za-z])\2{9}|(.)\3{19}", t)) for t in texts]
    assert text_arrays.cycling(pa.array(texts)).tolist() == want and any(want[8:]) and not all(want[8:])

    def burst(words):
        def top(part):
            return max(collections.Counter(part).values(), default=0)

        short = [w for w in words if len(w) <= 2]
        if len(words) < 60:
            return False
        parts = [[w for w in words[k : k + 90] if len(w) <= 2] for k in range(0, max(1, len(words) - 89), 15)]
        return (len(short) >= 40 and top(short) >= 0.28 * len(short)) or any(len(p) >= 25 and top(p) >= 14 for p in parts)

    lists = [[rng.choice(["a", "b", "c", "d", "long", "words"] + ["other"] * k) for _ in range(n)] for k in (0, 3, 9) for n in (10, 59, 60, 89, 90, 200, 400)]
    assert text_arrays.bursting(pa.array(lists)).tolist() == [burst(x) for x in lists]


def test_a_contract_is_judged_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(text.collapse_reason(F.col("t")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("post_result_text") == 1 and "{2,30}" not in plan


def test_parts_of_basic_metrics_are_computed_once(spark):
    df, metrics = scorer.basic_metrics(spark.createDataFrame([("한같은 x. 같은 b같은c같은 너듯한", ["한같은 x.", "같은 b같은c같은 너듯한"])], "t string, s array<string>"), "t", "s")
    df = df.select(*[c.alias(k) for k, c in metrics.items()])
    row = df.first()
    assert row["simile_marker_count"] == sum(len(re.findall(p, "한같은 x. 같은 b같은c같은 너듯한")) for p in text.SIMILES) == 3 and row["simile_sentence_rate"] == 1.0
    assert df._jdf.queryExecution().optimizedPlan().toString().count("{2,}") == 1


def test_lines_at_the_limits_of_their_counts(spark):
    cases = [("ABCDEFGHIJ abcdefghi.", True), ("ABCDEFGHI abcdefgh.", False), ("ABCDEFGHIJ abcdefghij.", False), ("a" * 8 + "#.", False), ("a" * 7 + "#.", True), ("a | b | c | d end of it.", True), ("a | b | " + "c" * 60 + ".", False), (("a " * 10 + "a.").strip(), False), ("a a a a a a a a a a a.a a a a a a a a a a a a a.", True), ("a b c d e f g h i j.", False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    df = df.select("k", line_rules.line_fails(F.col("t")).alias("x"))
    got = {r["k"]: r["x"] for r in df.collect()}

    def plain(t):
        count = lambda chars: sum(c in chars for c in t)
        upper, lower, bars, words = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t), count(line_rules.SEPARATORS), t.split()
        return count(line_rules.SYMBOLS) * 10 > len(t) or (bars >= 3 and bars * 20 > len(t)) or (upper >= 10 and upper > lower) or (len(words) >= 10 and len(set(words)) * 10 < len(words))

    assert got == {k: plain(t) for k, (t, _) in enumerate(cases)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "{9}" in plan, "letters are counted in every line"


def test_blocks_are_packed_more_than_at_the_first_level():
    raw = "".join(t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()).encode()
    empty = {c: np.zeros(0, t) for c, t in repeats.SPANS[repeats.COVERED]}
    first = zstandard.ZstdCompressor(level=1).compress((0).to_bytes(8, "little") + raw)
    packed = repeats._pack(repeats.COVERED, empty, raw)
    assert len(packed) < 0.9 * len(first) and repeats._unpack(repeats.COVERED, [packed])[1].tobytes() == raw
