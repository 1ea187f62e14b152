"""Toxic passages by maximum-scoring segments over token log-odds.

Units are a text's words (lower case, split at white space, outer punctuation stripped) and their
first four, five and six characters; fit and score share one tokenizer. Over the labelled training
rows, the documents that hold a unit are counted by label, and a unit's log-odds between the classes
is smoothed with an informative Dirichlet prior, `prior` documents (a twentieth of the training
rows, if fewer) distributed as in both classes together; a unit enters the lexicon when (its toxic
documents counted at most once for each distinct word before it, so that near copies of one text
weigh little) its log-odds is `z` standard deviations above 0 and at least 1.5. A word scores the
log-odds of its longest unit in the lexicon; all other words share a small negative score, the
log-odds of a word outside the lexicon. One linear scan over a text finds all its maximal scoring
segments, and the segments' scores follow an extreme-value law under the clean class, whose rate
solves sum(p * exp(rate * score)) = 1. A document's evidence is rate * (its best segment's score
plus what the other significant ones add) - log(words); a logistic curve, fitted on training rows
that its lexicon hasn't seen, turns it into a probability. The curve's prior has slope 1 and starts
at the share of toxic rows, below the cut; it weighs like one row, so it decides where few rows
were judged. Labels are read from training rows alone: rows whose crc32(doc_id as text) mod 4 is 2
are held out.

The fit takes at most about `train_rows` labelled rows, chosen by a hash of doc_id, which bounds its
lexicon and so the model that is sent to the executors; only significant units, sums and a histogram
of the evidence reach the driver. Defined cases: null and empty texts have no words and get the
score of no evidence; several labels of one doc_id count as their largest; without toxic or without
clean training rows the lexicon is empty and every score is near 1 or 0, as their labels say (0
without rows). Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.store import bounded_batches, written

PREFIXES = (6, 5, 4)
TRAIN_ROWS = 200_000
#: Different units that a task counts before it sends them.
HELD_UNITS = 200_000
#: Evidence is fitted on a grid of this many steps to 1.
STEPS = 64
PRIOR, PRIOR_SHARE = 1000.0, 0.05
Z, LEAST_ODDS = 2.5, 1.5
CUT = 0.3
STRIPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    rate: float = 1.0
    slope: float = 0.0
    intercept: float = -20.0

    def __post_init__(self) -> None:
        self.heads = {u[:4] for u in [*self.words, *self.prefixes]}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """The places and scores of the words that the lexicon knows."""
        heads, out = self.heads, []
        # Where punctuation is among the first four characters, the stripped word may begin otherwise.
        for k in [k for k, w in enumerate(words) if w[:4] in heads or not w[:4].isalnum()]:
            known = (self.words.get(u) if n is None else self.prefixes.get(u) for u, n in units(words[k].strip(STRIPPED)))
            s = next((s for s in known if s is not None), None)
            if s is not None:
                out.append((k, s))
        return out

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        null = math.log(max(n, 1))
        best = sorted((self.rate * s for _, _, s in found), reverse=True)
        return -null + sum(best[:1]) + sum(max(0.0, x - null) for x in best[1:])

    def probability(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * x + self.intercept))))


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text whose words score `other`
    except for its hits, in time linear in the hits (the algorithm of Ruzzo and Tompa)."""
    out: list[list] = []  # first word, end, sum before, sum after
    total, at = 0.0, 0
    for k, s in hits:
        total += other * (k - at)
        at = k + 1
        if s <= 0:
            total += s
            continue
        new = [k, k + 1, total, total + s]
        total += s
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
        out.append(new)
    return [(a, b, after - before) for a, b, before, after in out]


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be read; a row without an id has none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def split(text: str | None) -> list[str]:
    """The words of a text, with their outer punctuation."""
    return (text or "").lower().split()


def units(word: str) -> list[tuple[str, int | None]]:
    """A stripped word's units, longest first: itself, and its first characters with their number."""
    return [(word, None), *((word[:n], n) for n in PREFIXES if len(word) >= n)] if word else []


def _name(unit: str, n: int | None) -> str:
    """How a unit is written in tables: first characters end in a blank."""
    return unit if n is None else unit + " "


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each unit, by label, and among those that aren't judged later."""
    counts: dict[str, list[int]] = {}

    def sent() -> pa.RecordBatch:
        names, sums = list(counts), np.array(list(counts.values()), np.int64).reshape(-1, 4)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(sums[:, k]) for k in range(4))], names=["unit", "t", "c", "t_part", "c_part"])

    for batch in batches:
        for text, toxic, third in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "third")), strict=True):
            for name in {_name(u, n) for w in {w.strip(STRIPPED) for w in split(text)} for u, n in units(w)}:
                sums = counts.setdefault(name, [0, 0, 0, 0])
                sums[0 if toxic else 1] += 1
                if not third:
                    sums[2 if toxic else 3] += 1
            if len(counts) >= HELD_UNITS:
                yield sent()
    yield sent()


def _lexicon(rows: list, toxic: str, clean: str, n_toxic: int, n_clean: int, prior: float, z: float) -> tuple[dict, dict]:
    words, prefixes = {}, {}
    for r in rows:
        t, c = r[toxic], r[clean]
        if not t:
            continue
        a = prior * (t + c) / (n_toxic + n_clean)
        s = math.log((t + a) / (n_toxic + prior)) - math.log((c + a) / (n_clean + prior))
        if s >= LEAST_ODDS and s >= z * math.sqrt(1 / (t + a) + 1 / (c + a)):
            if r["unit"].endswith(" "):
                prefixes[r["unit"][:-1]] = s
            else:
                words[r["unit"]] = s
    return words, prefixes


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, prior: float = PRIOR, z: float = Z) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    share = min(1.0, train_rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3
    train = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "toxic", third.alias("third"))  # at most about train_rows pairs
    train = written(train, "train")
    size = {(r["toxic"], r["third"]): r["n"] for r in train.groupBy("toxic", "third").agg(F.count("*").alias("n")).collect()}
    n = {(k, part): sum(v for (t, third), v in size.items() if t == (k == "t") and (part == "all" or not third)) for k in "tc" for part in ("all", "part")}
    if not n["t", "all"] or not n["c", "all"]:
        rows = n["t", "all"] + n["c", "all"]
        return Model(intercept=20.0 if rows and n["t", "all"] else -20.0)

    prior = min(prior, PRIOR_SHARE * (n["t", "all"] + n["c", "all"]))
    counts = train.mapInArrow(_counted, "unit string, t long, c long, t_part long, c_part long").groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("t", "c", "t_part", "c_part")])
    # Only units that can be significant: their share among toxic rows is larger.
    bound = counts.where(f"t >= 2 AND t * {n['c', 'all']} > c * {n['t', 'all']}")
    a = prior * (F.col("t") + F.col("c")) / (n["t", "all"] + n["c", "all"])
    odds = F.ln((F.col("t") + a) / (n["t", "all"] + prior)) - F.ln((F.col("c") + a) / (n["c", "all"] + prior))
    rows = bound.where(odds / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a)) >= z * 0.6).collect()  # of train_rows texts

    # Near copies of one toxic text repeat all its words in the same places, so a unit's toxic
    # documents count at most once for each distinct word before it.
    names = [r["unit"] for r in rows]
    seen = train.where("toxic").select("text", "third").mapInArrow(_contexts({u: k for k, u in enumerate(names)}), "unit int, before long, third boolean")
    seen = seen.groupBy("unit", "before").agg(F.bool_and("third").alias("third")).groupBy("unit").agg(F.count("*").alias("n"), F.count_if(~F.col("third")).alias("n_part")).collect()
    places = {names[r["unit"]]: (r["n"], r["n_part"]) for r in seen}
    rows = [r.asDict() | {"t": min(r["t"], places.get(r["unit"], (0, 0))[0]), "t_part": min(r["t_part"], places.get(r["unit"], (0, 0))[1])} for r in rows]

    model = Model(*_lexicon(rows, "t", "c", n["t", "all"], n["c", "all"], prior, z))
    sums = train.select("text", "toxic").mapInArrow(_sums(model), "toxic boolean, words long, hits long, weight double")
    model.other, model.rate = _scale({r["toxic"]: r for r in sums.groupBy("toxic").agg(*[F.sum(c).alias(c) for c in ("words", "hits", "weight")]).collect()})
    partial = Model(*_lexicon(rows, "t_part", "c_part", n["t", "part"] or 1, n["c", "part"] or 1, prior, z), other=model.other, rate=model.rate)
    judged = train.where("third").select("text", "toxic").mapInArrow(_evidence(partial), "toxic boolean, step long").groupBy("step", "toxic").agg(F.count("*").alias("n")).collect()
    x, y, w = (np.array([r[c] for r in judged], float) for c in ("step", "toxic", "n"))
    share = (n["t", "all"] + 0.5) / (n["t", "all"] + n["c", "all"] + 1)
    model.slope, model.intercept = _logistic(x / STEPS, y, w, (1.0, min(-1.0, math.log(share / (1 - share)))))
    return model


def _contexts(known: dict[str, int]):
    """For each place of a unit: the unit and a hash of the word before it."""
    heads = {u[:4] for u in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, before, third = [], [], []
            for text, mine in zip(batch.column("text").to_pylist(), batch.column("third").to_pylist(), strict=True):
                last = ""
                for raw in split(text):
                    w = raw.strip(STRIPPED)
                    if w[:4] in heads:
                        for u, n in units(w):
                            if (k := known.get(_name(u, n))) is not None:
                                found.append(k)
                                before.append(zlib.crc32(last.encode()))
                                third.append(mine)
                    last = w
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(before, pa.int64()), pa.array(third, pa.bool_())], names=["unit", "before", "third"])

    return run


def _sums(model: Model):
    """A batch's words, and its hits with their scores, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {True: [0, 0, 0.0], False: [0, 0, 0.0]}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = split(text)
                hits = model.hits(words)
                for k, v in enumerate((len(words), len(hits), sum(s for _, s in hits))):
                    sums[toxic][k] += v
            rows = [(k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["toxic", "words", "hits", "weight"])

    return run


def _scale(sums: dict) -> tuple[float, float]:
    """The score of a word outside the lexicon, and the rate of the extreme-value law."""
    in_toxic, in_clean = ((sums[k]["hits"] + 0.5) / (sums[k]["words"] + 1) for k in (True, False))
    other = min(-1e-4, math.log1p(-min(0.9, in_toxic)) - math.log1p(-min(0.9, in_clean)))
    mean = sum(r["weight"] for r in sums.values()) / max(1, sum(r["hits"] for r in sums.values())) or 1.0
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if math.log(in_clean) + mid * mean > math.log(max(1e-300, 1 - (1 - in_clean) * math.exp(mid * other))):
            high = mid
        else:
            low = mid
    return other, (low + high) / 2


def _evidence(model: Model):
    """The evidence of each text, on the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = split(text)
                out.append(round(STEPS * model.evidence(len(words), segments(model.hits(words), model.other))))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.int64())], names=["toxic", "step"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: tuple[float, float]) -> tuple[float, float]:
    """The curve (slope, intercept) of y by x, with a normal prior that weighs like one row."""
    a, w, start = np.stack([x, np.ones_like(x)], 1), np.array(prior), np.array(prior)

    def loss(v: np.ndarray) -> float:
        t = a @ v
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + ((v - start) ** 2).sum() / 2)

    for _ in range(200):  # Newton's steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (weight * (p - y)) + (w - start)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(2), slope)
        now = loss(w)
        while abs(step).max() > 1e-12 and loss(w - step) > now:
            step /= 2
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def _score(model: Model, text: str | None) -> tuple[float, list[dict]]:
    words = split(text)
    found = segments(model.hits(words), model.other)
    null = math.log(max(len(words), 1))
    passages = [{"first_word": a, "end_word": b, "score": s, "evidence": model.rate * s - null} for a, b, s in found if model.rate * s > null]
    return model.probability(model.evidence(len(words), found)), passages


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) as doc_id, score and passages: the significant segments by words."""
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_score(model, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<first_word:long,end_word:long,score:double,evidence:double>>")


def without_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose score is under `cut`."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # any names of docs, dotted ones too
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_score(model, t.as_py())[0] < cut for t in batch.column(text)], pa.bool_()))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
