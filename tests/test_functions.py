"""Column functions and sources against plain Python."""

import json
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusweave.functions import arrays, stats, text
from corpusweave.operators import chat, chunking, rewards, rows
from corpusweave.sources import files


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], schema).select(expr.alias("x")).first()["x"]


ITEMS = [[], ["a"], ["a", "a"], ["a", "b", "a", "c"], list("mississippi")]


@pytest.mark.parametrize("items", ITEMS)
def test_counts_and_rates(spark, items):
    c, n = Counter(items), len(items)
    col = F.col("i")
    got = one(spark, F.struct(arrays.repeated_occurrence_rate(col).alias("r"), arrays.repetition_mass(col).alias("m"), arrays.shannon_entropy(col).alias("e"), arrays.diversity(col).alias("d"), F.size(arrays.ngrams(col, 3)).alias("g")), i=("array<string>", items))
    assert math.isclose(got["r"], sum(v for v in c.values() if v > 1) / n if n else 0)
    assert math.isclose(got["m"], sum(v - 1 for v in c.values()) / n if n else 0)
    assert math.isclose(got["e"], -sum(v / n * math.log(v / n) for v in c.values()) if n else 0, abs_tol=1e-12)
    assert math.isclose(got["d"], len(c) / n if n else 0)
    assert got["g"] == max(0, n - 2)


@pytest.mark.parametrize(
    "value,reason",
    [
        ("plain", "missing_result_tags"),
        ("<result>" + "x " * 30, "missing_result_close"),
        ("x </result>", "missing_result_open"),
        ("<result><result>" + "y" * 50 + "</result>", "multiple_result_open"),
        ("<result>" + "y" * 50 + "</result> tail", "post_result_text"),
        ("<result>" + "y" * 50 + "</result></result>", "multiple_result_close"),
        ("<result>short</result>", "empty_or_short_result"),
        ("<result>thought: " + "y" * 50 + "</result>", "thought_leak"),
        ("  <result>" + "y" * 50 + "</result>\n", None),
    ],
)
def test_contract(spark, value, reason):
    assert one(spark, text.result_contract(F.col("t"))["reason"], t=("string", value)) == reason


@pytest.mark.parametrize(
    "value,reason",
    [
        ("", "empty"),
        ("abc", "too_short"),
        ("word and more " * 4 + "<|im|>" + "other things follow here " * 4, "special_token_leak"),
        ("Some quite ordinary words stand here, " * 3 + "п" + " and they go on for a while.", "foreign_script_leak"),
        ("Some quite ordinary words stand here, " * 1 + "%%%%$$$$####@@@@" + " and they go on for a while, so that it is long enough to be judged at all.", "symbol_noise"),
        ("Some quite ordinary words stand here, and then aaaaaaaaaaaaaa follows, and they go on for a while, so that it is long enough to be judged at all.", "char_run_repeat"),
    ],
)
def test_collapse(spark, value, reason):
    assert one(spark, text.collapse_reason(F.col("t")), t=("string", value)) == reason


def test_stop_and_tail(spark):
    got = one(spark, text.stop_trimmed(F.col("t")), t=("string", "ab<end_of_turn>c<turn|>d"))
    assert (got["kept"], got["hit"], got["rest"]) == ("ab", "<end_of_turn>", "c<turn|>d")
    assert one(spark, text.tail_context(F.col("t"), 10, 5), t=("string", "0123456789ab\n\nxyz6")) == "xyz6"


def test_band_scores(spark):
    q = [F.lit(v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 2.0)]
    for x, want in ((3.0, 1.0), (1.5, 0.5), (1.0, 0.0), (0.5, -0.5), (-9.0, -1.0), (4.5, 0.5), (6.0, -1.0)):
        assert math.isclose(one(spark, stats.band_score(F.col("x"), *q), x=("double", x)), want, abs_tol=1e-9)
    assert math.isclose(one(spark, stats.banded_reward(F.col("x"), *q), x=("double", 3.0)), 0.22)
    assert math.isclose(one(spark, stats.banded_reward(F.col("x"), *q), x=("double", -5.0)), -1.0)
    assert one(spark, stats.finite(F.col("x"), 7.0), x=("string", "not a number")) == 7.0


def test_update_gate(spark):
    none = F.lit(None).cast("double")
    for std, want in ((0.02, "skip"), (0.08, "downweight"), (0.3, "use"), (0.9, "downweight")):
        assert one(spark, rewards.gate_decision(rewards.update_gate(F.col("s"), none, none, none, none)), s=("double", std)) == want


def test_decorate_and_trim(spark):
    kind = "array<struct<role:string,content:string>>"
    got = one(spark, chat.decorate_last_user(F.col("m"), "RULE"), m=(kind, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]))
    assert [x["content"] for x in got] == ["a", "b", "c\n\nRULE", "d"]
    assert [x["role"] for x in one(spark, chat.decorate_last_user(F.col("m"), "RULE"), m=(kind, [("assistant", "b")]))] == ["assistant", "user"]
    assert [x["content"] for x in one(spark, chat.trim_messages(F.col("m"), 3), m=(kind, [("user", "abc"), ("assistant", "de")]))] == ["c", "de"]


def training_by_rule(text, target, most, least):
    """The first chunker's rules, paragraph by paragraph, in terms of sizes alone."""
    out, sizes, held = [], 0, []
    for p in (x.strip() for x in re.split("\\n\\n+", text)):
        if not p:
            continue
        if len(p) > most:
            out += ["\n\n".join(held)] if held and sizes >= least else []
            held, sizes, rest = [], 0, p
            while rest:
                n = target if len(rest) > target else len(rest)
                if n < len(rest):
                    marks = [m.start() for m in re.finditer(r"(?=다\.|요\.|\n|\. )", rest[:n]) if any(rest[m.start() : n].startswith(e) for e in ("다.", "요.", "\n", ". "))]
                    if marks and marks[-1] > least:
                        n = marks[-1] + 2
                out += [rest[:n].strip()] if len(rest[:n].strip()) >= least else []
                rest = rest[n:]
            continue
        if held and sizes + len(p) + 2 > most:
            out += ["\n\n".join(held)] if sizes >= least else []
            held, sizes = [], 0
        held.append(p)
        sizes += len(p) + 2
        if sizes >= target:
            out.append("\n\n".join(held))
            held, sizes = [], 0
    return out + (["\n\n".join(held)] if held and sizes >= least else [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab다요. \n", max_size=70), max_size=9), st.integers(8, 25))
def test_training_chunks_follow_the_rules(parts, least):
    text = "\n\n".join(parts)
    assert list(chunking.training_chunks(text, 40, 60, least)) == training_by_rule(text, 40, 60, least)


def test_chunks():
    parts = ["p" * 50, "q" * 90, "r" * 450, "s" * 10]
    assert list(chunking.training_chunks("\n\n".join(parts), 130, 200, 40)) == ["p" * 50 + "\n\n" + "q" * 90, "r" * 130, "r" * 130, "r" * 130, "r" * 60]
    assert list(chunking.training_chunks("", 100, 200, 10)) == []
    # The second one cuts at the best mark within the largest size, and drops what is too short.
    long = "w" * 210 + ". " + "x" * 100 + "\n" + "y" * 400
    assert list(chunking.evaluation_chunks(long, 150, 400, 50)) == ["w" * 210 + ". " + "x" * 100, "y" * 150, "y" * 150, "y" * 100]
    assert list(chunking.evaluation_chunks("a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30, 60, 100, 50)) == ["a" * 30 + "\n\n" + "b" * 30]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="한글 abc", max_size=30), st.sampled_from(["utf-8", "utf-8-sig", "cp949", "utf-16", "utf-32"]))
def test_decode(value, encoding):
    assert files.decode(value.encode(encoding)) == value


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("글".encode("cp949"))
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()] == ["글"]
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double")
    files.write_jsonl(df, str(tmp_path / "j"))
    back = files.read_jsonl(spark, str(tmp_path / "j"), "id int, x double")
    assert sorted((r["id"], r["x"]) for r in back.collect()) == [(1, None), (2, 0.5)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id int", missing_ok=True).count() == 0
    with pytest.raises(AnalysisException):
        files.read_jsonl(spark, str(tmp_path / "none"), "id int")
    files.write_ragged_csv([df.select("id"), df], str(tmp_path / "c"))
    assert set(files.read_csv(spark, str(tmp_path / "c")).columns) == {"id", "x"}


def test_file_choice(spark, tmp_path):
    for name in ("b.md", "b.TXT", "d/c.md", "all_stories.txt", "x.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda *a, **k: sorted(r["text"] for r in files.read_texts(spark, str(tmp_path), *a, **k).collect())
    assert names() == ["all_stories.txt", "b.TXT"] and names((".txt", ".md")) == ["b.TXT", "d/c.md"] and names(limit=1) == ["all_stories.txt"]
    f = files.fingerprints(files.text_files(spark, str(tmp_path), (".md",))).collect()
    assert all(len(r["sha256"]) == 64 and r["id"] == max(1, int(r["sha256"][:8], 16) % (2**31 - 1)) for r in f) and len(f) == 2


@pytest.mark.parametrize("data,codec", [("ab각낙cd".encode("utf-16-le"), "utf-16-le"), ("abcd".encode("utf-16-be"), "utf-16-be"), ("글".encode("cp949"), "cp949"), ("글".encode(), "utf-8-sig"), (b"abc", "utf-8-sig"), (b"\xff\xfea\x00", "utf-16-le")])
def test_likeliest_codec(data, codec):
    assert files.likeliest_codec(data) == codec


def test_zero_bytes_choose_wide_codecs():
    assert files.codec_of("abcd".encode("utf-16-le")) == ("utf-16", "strict") and files.codec_of(b"a\xff\xffb") == ("utf-8", "replace")


def test_lexicon_and_reference_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"terms": [{"parts": ["a", "b"], "weight": 2}, {"term": " c "}, {"term": ""}, {"kind": "skip_bigram", "skip": 2, "parts": ["x", "y"], "weight": 0.01}]}))
    got = sorted((r["kind"], r["skip"], r["key"], r["weight"]) for r in files.read_lexicon(spark, str(tmp_path / "l.json")).collect())
    assert got == [("bigram", 0, "a\tb", 2.0), ("skip_bigram", 2, "x\ty", 0.05), ("unigram", 0, "c", 1.0)]
    assert files.read_lexicon(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"metrics": {"m": {"human_q50": 1.0}, "anti_slop_density": {"human_mean": 9}}, "anti_slop": {"human_mean": 2, "weight": 0.5}, "pos_ngram_usage": {"1": {"human_distribution": {"N": 1.0}, "ai_distribution": {"V": 0.25}}}}))
    metrics, usage = files.read_style_reference(spark, str(tmp_path / "r.json"))
    assert {r["metric"]: (r["human_q50"], r["human_mean"], r["weight"]) for r in metrics.collect()} == {"m": (1.0, None, None), "anti_slop_density": (None, 2.0, 0.5)}
    assert sorted(tuple(r) for r in usage.collect()) == [("1", "N", 1.0, 0.0, 0.5), ("1", "V", 0.0, 0.25, 0.5)]


def test_manifests_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    noted = files.write_eval_folder(spark, str(tmp_path / "e"), {"a": df, "b": df.limit(0)}, "stage", {"k": 1})
    assert noted["counts"] == {"a": 1, "b": 0} and noted["packages"]["pyspark"] and noted["spark"] == spark.version
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "e/manifest")).collect()))["counts"] == noted["counts"]
    tests = spark.createDataFrame([("t", "m1", "a", "b", 0.1), ("t", "m2", "a", "b", -0.9), ("t", "m3", "a", "b", None)], "eval_task string, metric string, left_group string, right_group string, cliffs_delta double")
    samples = spark.createDataFrame([("t", "g", "1", "abcdef")], "eval_task string, group string, id string, text string")
    report = files.write_report(spark, str(tmp_path / "r"), tests, ["t"], samples, top=2, chars=3)
    assert report.index("m2") < report.index("m1") and "m3" not in report and "abc [...]" in report


def test_numbered_is_a_total_order(spark):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    got = rows.numbered(spark.createDataFrame([(i,) for i in ids], "v int"), "k", "v").collect()
    assert sorted((r["v"], r["k"]) for r in got) == [(i, i) for i in range(500)]


def test_stream_equals_batch(spark, tmp_path):
    from corpusweave.streaming.events import append_by_batch, read_events, windowed_counts

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_events(spark, str(tmp_path / "in"), src.schema)
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT window_start, event_type, n FROM counts").collect()} == {tuple(r)[:3] for r in windowed_counts(src).collect()}
    q = append_by_batch(stream, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t=("string", " One.  Two! three\nfour? ")) == ["One.", "Two!", "three four?"]
    assert re.fullmatch("[0-9a-f]{16}", one(spark, text.fingerprint(F.col("t")), t=("string", "a b")))


def test_lexical_and_rewrites(spark):
    from difflib import SequenceMatcher

    from corpusweave.functions import lexical
    from corpusweave.operators import rewrite

    tokens = ["a", "b", "a", "c"] * 10
    assert one(spark, lexical.mtld(F.col("t")), t=("array<string>", tokens)) == lexical.mtld_values([tokens])[0]
    assert lexical.mtld_values([["a"] * 19, [str(k) for k in range(30)], None]) == [None, 30.0, None]
    rng = random.Random(4)
    texts = [[rng.choice("abcdefghij" * 3 + "klmnopqrstuvwxyz") for _ in range(n)] for n in (20, 25, 400, 3000)]

    def stretches(t):  # by the definition: the shortest stretch whose types are at most 0.72 of its tokens
        n, i = 0.0, 0
        while i < len(t):
            stop = next((k for k in range(i + 1, len(t) + 1) if len(set(t[i:k])) <= 0.72 * (k - i)), None)
            if stop is None:
                return n + (1 - len(set(t[i:])) / len(t[i:])) / 0.28
            n, i = n + 1, stop
        return n

    want = [sum(len(t) / stretches(x) for x in (t, t[::-1])) / 2 for t in texts]
    assert lexical.mtld_values(texts) == pytest.approx(want)
    assert one(spark, lexical.normalized(F.col("t")), t=("string", "ＡＢ　c​\r\n-----\n see https://x.y\n\n\n\n\nd ")) == "AB c\n\n\nd"
    got = one(spark, lexical.skip_features(F.col("t")), t=("array<string>", ["x", "y", "z"]))
    assert [(r["kind"], r["skip"], r["key"]) for r in got] == [("unigram", 0, "x"), ("unigram", 0, "y"), ("unigram", 0, "z"), ("bigram", 0, "x\ty"), ("bigram", 0, "y\tz"), ("skip_bigram", 1, "x\tz")]
    got = one(spark, lexical.skip_features(F.col("t")), t=("array<string>", list("vwxyz")))
    assert [r["key"] for r in got if r["kind"] == "skip_trigram"] == ["v\tw\ty", "w\tx\tz", "v\tx\ty", "w\ty\tz", "v\tx\tz"]
    pairs = spark.createDataFrame([("one two two three", "two three four"), ("", "x y")], "s string, r string")
    rows = {r["s"]: r for r in rewrite.rewrite_metrics(pairs, "s", "r").collect()}
    r = rows["one two two three"]
    assert (r["jaccard"], r["containment"]) == (2 / 5, 2 / 3) and math.isclose(r["char_ratio"], SequenceMatcher(None, "one two two three", "two three four").ratio())
    assert rows[""]["jaccard"] == 0.0


def test_measures_of_nothing(spark):
    assert one(spark, arrays.measures(F.col("i")), i=("array<string>", [])) is None
    assert one(spark, arrays.coverage(F.col("i"), 3), i=("array<string>", [])) == 0.0
    assert one(spark, arrays.windows(F.col("i"), 3, 2, 2), i=("array<string>", list("ab"))) == [["a", "b"]]
    assert one(spark, arrays.windows(F.col("i"), 3, 2), i=("array<string>", list("abcdef"))) == [["a", "b", "c"], ["c", "d", "e"]]
