"""A deterministic tagger of words by regular expressions, and metrics of tags.

It stands in for a morphological analyser: closed classes by word lists, open ones by endings. Tags
follow the scheme that the metrics expect: S for marks and numbers, MA and MM for modifiers, N for
nouns, V for verbs and adjectives, J for particles. Patterns are portable, so SQL can tag as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.arrays import counts, diversity, let, repeated_occurrence_rate, repetition_mass

TOKEN = r"[가-힣]+|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^\x20\x09-\x0D]"
#: Tag, whether its pattern reads the word as it is written (else in lower case), pattern. The first that fits decides.
RULES = (
    ("SF", False, r"^[.!?。！？…]$"),
    ("SP", False, r"^[,，:;/]$"),
    ("SN", False, r"^[0-9]+$"),
    ("SW", False, r"^[^가-힣a-zà-öø-ÿ]$"),
    ("MM", False, r"^(the|an?|this|that|these|those|each|every|some|any|no|all|les?|la|une?|des|de[rnm]|das|die|eine?[nrms]?|el|los|las|unas?|unos)$"),
    ("MAJ", False, r"^(and|or|but|nor|so|yet|et|ou|mais|donc|und|oder|aber|denn|y|o|pero|sino|그리고|그러나|하지만|그래서)$"),
    ("MAG", False, r"^(very|not|also|just|only|too|then|now|here|there|never|always|often|sehr|nicht|auch|nur|très|pas|aussi|muy|también|매우|아주|정말|너무|더|잘)$"),
    ("NP", False, r"^(i|you|he|she|it|we|they|me|him|her|us|them|je|tu|il|elle|nous|vous|ils|elles|ich|du|er|sie|wir|ihr|yo|él|ella|nosotros|ellos)$"),
    ("JKB", False, r"^(of|in|to|for|with|on|at|from|by|about|into|over|à|de|dans|pour|avec|sur|mit|von|zu|auf|für|bei|en|con|por|para|sobre)$"),
    ("VX", False, r"^(is|are|was|were|be|been|am|has|have|had|do|does|did|will|would|can|could|may|might|shall|should|must|est|sont|ist|sind|war|es|son|era)$"),
    ("NNP", True, r"^[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+$"),
    ("MAG", False, r"^[a-zà-öø-ÿ]{2,}(ly|ment|mente)$"),
    ("VV", False, r"^([a-zà-öø-ÿ]{3,}(ing|ed|ize|ise|ify)|[가-힣]+(다|요))$"),
    ("VA", False, r"^[a-zà-öø-ÿ]{3,}(ous|ful|ive|able|ible|al|ic|less)$"),
)
OTHER = "NNG"
#: First letters of the tags of marks, modifiers and content words, and the groups of content words.
MARK, MODIFIERS, CONTENT = "S", ("MAG", "MAJ", "MM"), ("N", "V", "M")
CONTENT_GROUPS = {"content_noun": "N", "content_predicate": "V", "content_modifier": "M", "content_root": "XR"}


def sql_tag(form: str) -> str:
    """The tag of a word as a SQL expression."""
    quoted = [(tag, form if written else f"lower({form})", p.replace("'", "''")) for tag, written, p in RULES]
    return "CASE " + " ".join(f"WHEN regexp_matches({what}, '{p}') THEN '{tag}'" for tag, what, p in quoted) + f" ELSE '{OTHER}' END"


#: The rules of closed classes come first; from this one on they are about endings.
_FIRST_OPEN = next(k for k, (name, written, _) in enumerate(RULES) if written)
_CLOSED = re.compile("|".join(f"(?P<r{k}>{p})" for k, (_, _, p) in enumerate(RULES[:_FIRST_OPEN])))
_ENDING = [(name, written, re.compile(p)) for name, written, p in RULES[_FIRST_OPEN:]]
TAGGED = "array<struct<form:string,tag:string>>"


@lru_cache(maxsize=1 << 18)
def closed_tag(form: str) -> str | None:
    """The tag of a word that can have only one."""
    found = _CLOSED.match(form.lower())
    return RULES[int(found.lastgroup[1:])][0] if found else None


@lru_cache(maxsize=1 << 18)
def word_tag(form: str) -> str:
    low = form.lower()
    return closed_tag(form) or next((name for name, written, p in _ENDING if p.match(form if written else low)), OTHER)


def words(text: Column) -> Column:
    """The words and marks of a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def form_tags(forms: pa.Array) -> pa.Array:
    """The tag of each word; equal words of a batch are looked up once."""
    coded = forms.dictionary_encode()
    return pa.array([word_tag(f) for f in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def tags_of(tokens: pa.ListArray) -> pa.ListArray:
    """The tags of arrays of words."""
    return relisted(tokens, form_tags(tokens.flatten()))


def relisted(lists: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """New values in lists of the same lengths."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def paired(tokens: pa.ListArray, tags: pa.Array) -> pa.ListArray:
    """Lists of struct(form, tag)."""
    return relisted(tokens, pa.StructArray.from_arrays([tokens.flatten(), tags], ["form", "tag"]))


def tagged(text: Column) -> Column:
    """The words and marks of a text as an array of struct(form, tag)."""

    def of(tokens: pa.Array) -> pa.Array:
        return paired(tokens, form_tags(tokens.flatten()))

    return F.arrow_udf(of, TAGGED)(words(text))


def tagged_sentences(sentences: Column) -> Column:
    """The words and marks of each sentence, as arrays of struct(form, tag)."""

    def of(sentences: pa.Array) -> pa.Array:
        tokens = sentences.flatten()
        return relisted(sentences, paired(tokens, form_tags(tokens.flatten())))

    return F.arrow_udf(of, f"array<{TAGGED}>")(F.transform(sentences, words))


def unmarked(tokens: Column) -> Column:
    """The tokens that aren't marks or numbers."""
    return F.filter(tokens, lambda t: ~t["tag"].startswith(MARK))


def tags(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["tag"])


def named(tokens: Column) -> Column:
    """form/tag of each token."""
    return F.transform(tokens, lambda t: F.concat(t["form"], F.lit("/"), t["tag"]))


def _any_start(tag: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | tag.startswith(s)
    return out


def modifiers(tokens: Column) -> Column:
    return named(F.filter(tokens, lambda t: _any_start(t["tag"], MODIFIERS)))


def content(tokens: Column, names: bool = False, starts: tuple[str, ...] = (*CONTENT, "XR")) -> Column:
    """Content words as form/tag, without proper names unless `names`."""
    return named(F.filter(tokens, lambda t: _any_start(t["tag"], starts) & (F.lit(names) | (t["tag"] != "NNP"))))


def burst_mass(items: Column, tau: float = 20.0) -> Column:
    """The mean over all items of exp(-gap / tau), gap being the way back to the same item."""

    def of(a: Column) -> Column:
        place = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        gaps = let(place, lambda p: F.transform(p, lambda x, k: F.when((k > 0) & (F.get(p, k - 1)["x"] == x["x"]), F.exp((F.get(p, k - 1)["i"] - x["i"]) / F.lit(tau))).otherwise(0.0)))
        return F.when(F.size(a) > 0, F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / F.size(a)).otherwise(0.0)

    return let(items, of)


def edge_rates(sentences: Column) -> Column:
    """struct(initial, final): how often the first and the last two tags of sentences repeat, of
    arrays of tags."""
    long = F.filter(sentences, lambda t: F.size(t) >= 2)
    first = F.transform(long, lambda t: F.concat_ws("/", F.get(t, 0), F.get(t, 1)))
    last = F.transform(long, lambda t: F.concat_ws("/", F.element_at(t, -2), F.element_at(t, -1)))
    return F.struct(repeated_occurrence_rate(first).alias("initial"), repeated_occurrence_rate(last).alias("final"))


def _gram_rates(tags: Column, n: Column) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tags) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tags, i, n), "/"))
    return let(F.when(F.size(tags) >= n, made).otherwise(F.array().cast("array<string>")), lambda g: F.struct(diversity(g).alias("diversity"), repeated_occurrence_rate(g).alias("rate")))


def tag_measures(tokens: Column, most: int = 6) -> Column:
    """struct of counts, modifier repetition and, for n-grams of tags up to `most`, diversity and
    repeats; named() columns come from tag_metrics()."""

    def of(t: Column) -> Column:
        own = modifiers(t)
        rates = let(tags(unmarked(t)), lambda g: F.struct(F.size(g).cast("long").alias("n"), F.transform(F.array(*[F.lit(n) for n in range(1, most + 1)]), lambda n: _gram_rates(g, n)).alias("grams")))
        mass = let(own, lambda m: F.struct(repetition_mass(m).alias("mass"), burst_mass(m).alias("burst")))
        return F.struct(F.size(t).cast("long").alias("morphs"), rates.alias("tags"), mass.alias("modifiers"))

    return let(tokens, of)


def tag_metrics(measures: str, most: int = 6) -> dict[str, Column]:
    """The metrics of a column of tag_measures()."""
    m = F.col(measures)
    out = {"morph_count": m["morphs"], "pos_token_count": m["tags"]["n"], "modifier_repetition_mass": m["modifiers"]["mass"], "modifier_repeat_burst_mass": m["modifiers"]["burst"]}
    for n in range(1, most + 1):
        g = F.get(m["tags"]["grams"], n - 1)
        out |= {f"pos_{n}gram_diversity": g["diversity"], f"pos_{n}gram_repeat_rate": g["rate"]}
    return out


def _frequency(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(items, lambda a: F.when(F.size(a) > 0, let(counts(a), lambda c: body(c, F.size(a).cast("double")))))


def distribution_metrics(items: Column) -> Column:
    """struct of the eight measures of how often items occur; null without items."""

    def total(c: Column, body: Callable[[Column], Column]) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + body(x).cast("double"))

    def top(c: Column, k: int) -> Column:
        return total(F.slice(F.sort_array(c, asc=False), 1, k), lambda x: x)

    def of(c: Column, n: Column) -> Column:
        squares = total(c, lambda x: x * x)
        weighted = let(F.array_sort(c), lambda s: total(F.transform(s, lambda x, i: x * (i + 1)), lambda x: x))
        return F.struct(
            (total(c, lambda x: F.when(x > 1, x).otherwise(0)) / n).alias("repeat_occurrence_rate"),
            (total(c, lambda x: F.when(x == 1, 1).otherwise(0)) / F.size(c)).alias("hapax_rate"),
            (top(c, 10) / n).alias("top_10_coverage"),
            (top(c, 20) / n).alias("top_20_coverage"),
            (F.array_max(c) / n).alias("max_frequency_rate"),
            (squares / (n * n)).alias("simpson_concentration"),
            (2 * weighted / (F.size(c) * n) - (F.size(c) + 1) / F.size(c)).alias("gini_frequency"),
            (F.lit(10000.0) * (squares - n) / (n * n)).alias("yule_k"),
        )

    return _frequency(items, of)
