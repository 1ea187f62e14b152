"""The queries with SQL give DuckDB's rows; line rules and chat formatting against plain Python."""

import hashlib
import random
import re

import duckdb
import pytest

from corpusweave.llm import line_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(df):
        return sorted(tuple(str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    assert rows(got) == rows(want) and len(got) > 0


SPACE = "\x20\x09-\x0d"


def fails(line):
    words = re.findall(f"[^{SPACE}]+", line)
    count = lambda chars: sum(c in chars for c in line)
    upper, lower = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
    bars = count(line_rules.SEPARATORS)
    tail = line.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    quotes = "\"')]}”’»"
    ended = bool(tail) and tail[-1] in ":;" + quotes
    for k, c in enumerate(line):
        if c in line_rules.MARKS:
            rest = line[k + 1 :].lstrip(quotes)
            ended = ended or not rest or rest[0] in " \t\n\x0b\x0c\r"
    edge = lambda c: not (c.isalpha() or c.isnumeric() or c == "_")
    low = line.lower()
    phrase = any((m.start() == 0 or edge(low[m.start() - 1])) and (m.end() == len(low) or edge(low[m.end()])) for p in line_rules.PHRASES for k in range(len(low)) for m in [re.compile(p).match(low, k)] if m)
    few = len(words) >= 10 and len(set(words)) * 10 < len(words)
    return not ended or count(line_rules.SYMBOLS) * 10 > len(line) or (bars >= 3 and bars * 20 > len(line)) or (upper >= 10 and upper > lower) or few or phrase


def by_hand(text):
    words = re.findall(f"[^{SPACE}]+", text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    again = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    lost = sum(len(x) for x in lines if fails(x))
    base = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in line_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(again), base, not base and lost * 2 <= len(text)


LINES = [
    "The catalog in the library is big and well kept.", "A blog in the city, design up to date.", "He ate a cookie and went home.", "Please log in to continue.", "We use cookies.", "Home | About | News | Contact",
    "यह एक वाक्य है।", "هذا سؤال؟", "SHOUTING ALL THE TIME IS BAD.", "no end here", "He said: (yes)", "Alle Rechte vorbehalten.", "Tous droits réservés.", "a a a a a a a a a a a a.", "$$ ** $$ **.", "", "  \t", "She left… \"and came back.\" Then", "x" * 300 + ".",
]


def test_line_rules_by_hand(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choices(LINES, k=rng.randint(0, 14))) for _ in range(150)] + LINES
    texts += [" ".join(rng.choices(["one", "two.", "three"], k=rng.randint(0, 60))) for _ in range(60)]
    out = line_rules.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == by_hand(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["cleaned"] == "\n".join(x for x in texts[r["doc_id"]].split("\n") if not re.search(f"[^{SPACE}]", x) or not fails(x))
    assert [fails(x) for x in LINES[:8]] == [False, False, False, True, True, True, False, False]


def test_chats_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    chats = {-7: [("user", queries._LOOKALIKE), ("assistant", queries._LOOKALIKE)]}
    for r in rows:
        chats.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    for r in queries.op7_reply_trees(spark, SF).collect():
        turns = chats.pop(r["conv_id"])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert not chats
