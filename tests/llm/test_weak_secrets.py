"""Weak parts link by their distance, wherever in the text they stand."""

import random

import pytest
from pyspark.sql import functions as F

from corpusweave.llm import secrets

ID, SECRET, ENDPOINT = "user: bob", "pwd=hi", "https://x.example.com/a"


def found(spark, texts):
    df = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    return {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in df.collect()}


@pytest.mark.parametrize("gap,links", [(300, True), (400, True), (511, True), (512, False)])
def test_a_block_links_at_every_offset(spark, gap, links):
    block = ID + " " * gap + SECRET
    got = found(spark, [(k, " " * k + block) for k in range(600)])
    want = [(0, 4, 9), (9 + gap, 3, 15 + gap)] if links else []
    assert got == {k: [(a + k, kind, b + k) for a, kind, b in want] for k in range(600)}


def test_an_endpoint_links_at_every_offset(spark):
    block = ID + " " * 200 + ENDPOINT + " " * 200 + SECRET
    got = found(spark, [(k, "é😀"[k % 2] * k + " " + block) for k in range(600)])
    assert all([kind for _, kind, _ in v] == [4, 5, 3] for v in got.values())


def test_redacted_at_every_offset(spark):
    docs = spark.createDataFrame([(k, "." * k + " " + ID + " " * 400 + SECRET) for k in range(300)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.without_secrets(docs).collect()}
    assert got == {k: "." * k + " <secret>" + " " * 400 + "<secret>" for k in range(300)}


@pytest.mark.parametrize("scope", [16, 64])
def test_distances_against_brute_force(spark, scope):
    rng = random.Random(scope)
    kinds = ["assign", "access", "hex", "weak"]
    rows = []
    for i in range(300):
        spans = {k: [] for k in kinds}
        for _ in range(rng.randint(0, 7)):
            kind, a = rng.randrange(6), rng.randrange(400)
            spans[kinds[min(kind, 3)]].append((a, kind, a + rng.choice([1, 5, 30, 150])))
        rows.append((i if i % 9 else None, i, *[spans[k] for k in kinds]))
    df = spark.createDataFrame(rows, "doc_id long, key long, " + ", ".join(f"{k} {secrets.SPAN}" for k in kinds))
    got = {r["key"]: [tuple(s) for s in r["added"]] for r in secrets.linked(df, scope).select("key", "added").collect()}

    want = {}
    for _, i, *spans in rows:
        parts = [s for k in spans for s in k]

        def near(w, kinds, parts=parts):
            return any(max(a - w[2], w[0] - b) < scope for a, kind, b in parts if kind in kinds)

        ident, secret = (1, 4), (0, 2, 3)
        mine = {w for w in spans[3] if (w[1] == 4 or near(w, ident)) and (w[1] == 3 or near(w, secret))}
        if mine:
            want[i] = sorted(mine)
    assert got == want and len(want) > 50


def test_many_matches_in_one_text(spark):
    import time

    n = 100_000
    part = "password=abcdefgh12 é "
    df = spark.createDataFrame([(1, part * n + "tail"), (2, "x" * 9000 + part + "y" * 9000)], "doc_id long, text string")
    warm = secrets.without_secrets(df.where("doc_id = 2")).first()
    assert warm["text"] == "x" * 9000 + "<secret> é " + "y" * 9000
    began = time.time()
    got = secrets.scan(df).select("doc_id", "assign").where("doc_id = 1").first()["assign"]
    assert [(s["start"], s["end"]) for s in (got[0], got[1], got[-1])] == [(0, 19), (22, 41), (22 * (n - 1), 22 * (n - 1) + 19)] and len(got) == n
    assert time.time() - began < 20
    assert secrets.without_secrets(df).where("doc_id = 1").first()["text"] == "<secret> é " * n + "tail"


def test_redaction_of_overlapping_spans(spark):

    rng = random.Random(2)
    rows = []
    for _ in range(60):
        text = "".join(rng.choices("abé😀\n", k=rng.randint(0, 9000)))
        spans = sorted((a, 0, min(len(text), a + rng.randint(1, 300))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 40)))) if text else []
        rows.append((text, spans))
    df = spark.createDataFrame(rows, f"text string, spans {secrets.SPAN}")
    for (text, spans), got in zip(rows, df.select(secrets.redact(F.col("text"), F.col("spans")).alias("r")).collect(), strict=True):
        at, want = 0, ""
        for a, _, b in spans:
            if a >= at:
                want += text[at:a] + "<secret>"
            at = max(at, b)
        assert got["r"] == want + text[at:]


def test_sql_links_weak_parts_by_distance(spark):
    """The registered SQL and the query agree on texts with weak parts at all offsets."""
    import duckdb
    import pandas as pd

    from corpusweave.llm import queries

    rng = random.Random(12)
    parts = [ID, SECRET, ENDPOINT, "password=abcdefgh12", "token: x1", "AKIA" + "A1" * 8, "ab" * 20, "account=é login:me"]
    texts = ["." * k + " " + ID + " " * gap + SECRET for gap in (300, 511, 512) for k in range(0, 600, 7)]
    texts += ["é" * k + " " + ENDPOINT + " " * 250 + SECRET + " " * 250 + ID for k in range(0, 600, 11)]
    texts += [" ".join(rng.choice([p, "." * rng.randrange(400)]) for p in rng.choices(parts, k=rng.randrange(9))) for _ in range(200)]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.execute(queries.SQL["op10_secrets"]).df()
    op10 = queries.op10_secrets.__globals__
    before, op10["table"] = op10["table"], lambda *_: spark.createDataFrame(rows)
    try:
        got = queries.op10_secrets(spark, "").toPandas()
    finally:
        op10["table"] = before
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].astype(str).values.tolist())) == sorted(map(tuple, want[key].astype(str).values.tolist()))
    assert got["spans"].str.contains("weak_").sum() > 200
