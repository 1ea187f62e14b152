"""String functions over one text column. Lengths are code points; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions import text_arrays
from corpusweave.functions.arrays import let, repeat_share

#: Tags, stop strings, patterns and script ranges of the output checks.
RESULT_OPEN, RESULT_CLOSE = "<result>", "</result>"
STOP_TEXTS = ("<turn|>", "<end_of_turn>", "<|end_of_turn|>")
THOUGHT_LEAK = r"(?i)(<\/?think\b|<\|/?thought|(?:^|\n)\s*(?:thought|analysis|reasoning)\s*:|\[System instruction\]|<start_of_turn>|<end_of_turn>|<\|end_of_turn\|>)"
SPECIAL_LEAK = r"(?i)(<\|[^>]{1,80}\|>|<start_of_turn>|<end_of_turn>|<bos>|<eos>|<pad>|<unused\d+>|<image>|<video>)"
SCRIPTS = {
    "arabic": r"[؀-ۿ]",
    "cyrillic": r"[Ѐ-ӿ]",
    "devanagari": r"[ऀ-ॿ]",
    "kana": r"[぀-ヿ]",
    "thai": r"[฀-๿]",
    "hangul_jamo": r"[㄰-㆏]",
    "replacement": r"�",
    "private_use": r"[-]",
}
ALLOWED_SYMBOLS = ".,!?;:()[]{}'\"“”‘’…-—·（），<>/"
SIMILES = ("마치", "처럼", "같이", "듯이", "마냥", "[가-힣A-Za-z0-9]+같은", "[가-힣A-Za-z0-9]+듯한")
#: A mark of SIMILES in a text; a word before the last two is looked back at, not walked through.
ANY_SIMILE = "|".join((*SIMILES[:5], "(?<=[가-힣A-Za-z0-9])(?:같은|듯한)"))
HANGUL = "[가-힣]"
SPACE = r"(?U)\s"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, SPACE, "")


def compact_length(text: Column) -> Column:
    return F.char_length(compact(text))


def fingerprint(text: Column, window: int = 1800, digits: int = 16) -> Column:
    """The first digits of the SHA-1 of the first `window` characters without white space."""
    return F.substring(F.sha1(F.substring(compact(text), 1, window).cast("binary")), 1, digits)


def class_ratio(text: Column, pattern: str = HANGUL, of: str = "nonspace") -> Column:
    """Characters of a class among all that aren't white space, all, or all letters of it and a-z."""
    total = {"nonspace": compact_length(text), "all": F.char_length(text), "letters": count_of(text, f"[{pattern[1:-1]}A-Za-z]")}[of]
    return F.when(~F.rlike(text, F.lit(pattern)), 0.0).otherwise(count_of(text, pattern) / F.greatest(total, F.lit(1)))  # nothing is counted without any


def bad_char_ratio(text: Column, controls: bool = False) -> Column:
    """Replacement characters (and control characters, for which an empty text counts as bad)."""
    if not controls:
        return count_of(text, "�") / F.greatest(F.char_length(text), F.lit(1))
    return F.when(F.char_length(text) > 0, count_of(text, "[�\\x00-\\x1f]") / F.char_length(text)).otherwise(1.0)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")


def sentences(text: Column) -> Column:
    """Trimmed sentences: after a closing mark and white space, or at line ends."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?。！？…])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def lexical_tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[가-힣a-z0-9]+"), F.lit(0)), lambda t: F.char_length(t) >= least)


def commas(text: Column) -> Column:
    return occurrences(text, ",") + occurrences(text, "，")


def per_1k(n: Column, text: Column) -> Column:
    return F.lit(1000.0) * n / F.greatest(F.char_length(text), F.lit(1))


def parenthesis_pairs(text: Column) -> Column:
    return F.least(count_of(text, "[(（]"), count_of(text, "[)）]"))


def simile_markers(text: Column) -> Column:
    """How often the patterns of SIMILES are found. Those with a word before them are searched where
    their last two characters are, as a long word is walked through from each of its characters."""
    out = F.lit(0)
    for p in SIMILES:
        word, _, end = p.rpartition("+")
        out = out + (F.when(F.contains(text, F.lit(end)), F.regexp_count(text, F.lit(f"(?<={word}){end}(?!{word}*{end})"))).otherwise(0) if word else occurrences(text, end))
    return out


def clean_markup(text: Column) -> Column:
    """Without code fences, heading marks and URLs; blanks and blank lines squeezed."""
    for pattern, to in ((r"(?s)```.*?```", " "), (r"(?m)^#{1,6}\s*", ""), (r"https?://\S+", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


#: Characters that end a sentence; marks before visible reasoning.
SENTENCE_ENDS = ".!?。！？…"
VISIBLE_REASONING = r"(?i)^(---\nthought\n|thought\n)"


def clean_source(text: Column) -> Column:
    """A short source without marks of order and width; line ends, blanks and blank lines unified."""
    for pattern, to in (("[\ufeff\u200b\u200c\u200d\u2060]", ""), ("\r\n?", "\n"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def paragraph_sentences(text: Column) -> Column:
    """The sentences of a cleaned text: they end with a mark before white space or the paragraph's
    end; the last one of each paragraph but the last carries the blank line."""
    parts = F.filter(F.transform(F.split(clean_source(text), "\n{2,}"), lambda p: strip(p)), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.filter(F.transform(F.split(p, rf"(?U)(?<=[{SENTENCE_ENDS}])(?=\s)"), lambda s: strip(s)), lambda s: s != ""))
    return let(cut, lambda c: F.flatten(F.transform(c, lambda p, i: F.transform(p, lambda s, k: F.when((k == F.size(p) - 1) & (i < F.size(c) - 1), F.concat(s, F.lit("\n\n"))).otherwise(s)))))


def budget_trimmed(text: Column, most: int, least: int) -> Column:
    """The leading sentences of a cleaned text whose tokens (here: characters, the stand-in codec)
    fit into `most`; the first `most` tokens where that leaves fewer than `least`."""

    def kept(sentences: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            joined = let(F.concat(acc["raw"], s), lambda raw: F.struct(raw.alias("raw"), clean_source(raw).alias("kept")))
            return F.when(acc["open"], let(joined, lambda x: F.when(F.char_length(x["kept"]) <= most, F.struct(x["raw"].alias("raw"), x["kept"].alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(acc["raw"].alias("raw"), acc["kept"].alias("kept"), F.lit(False).alias("open"))))).otherwise(acc)

        start = F.struct(F.lit("").alias("raw"), F.lit("").alias("kept"), F.lit(True).alias("open"))
        return F.aggregate(sentences, start, step, lambda acc: acc["kept"])

    def leading(t: Column) -> Column:
        """Sentences of the text's start, if those before the last one, which may be cut, are more than fit."""
        start = paragraph_sentences(F.substring(t, 1, 2 * most + 2))
        size = lambda s: F.aggregate(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + F.char_length(x))
        return let(start, lambda s: F.when(size(s) > most + 2, s).otherwise(paragraph_sentences(t)))  # joined, they lose two line ends at most

    def of(t: Column) -> Column:
        cut = lambda: let(kept(leading(t)), lambda k: F.when(F.char_length(k) >= least, k).otherwise(clean_source(F.substring(t, 1, most))))
        return F.when(F.char_length(t) <= most, t).otherwise(cut())

    return let(clean_source(text), of)


def reasoning(text: Column, opening: str, closing: str) -> Column:
    """struct(present, closed, chars, text) of what stands between the reasoning tags; without the
    closing one, or after a visible mark at the start, up to the result's tag or the end."""

    def until_result(t: Column, start: Column) -> Column:
        end = _locate_from(t, RESULT_OPEN, start)
        return F.when(end > 0, F.substring(t, start, end - start)).otherwise(F.substring(t, start, F.char_length(t)))

    def of(t: Column) -> Column:
        at = F.instr(t, opening)
        after = at + len(opening)
        end = _locate_from(t, closing, after)
        lead = F.char_length(t) - F.char_length(F.regexp_replace(t, r"(?U)^\s+", ""))
        mark = F.regexp_extract(F.regexp_replace(t, r"(?U)^\s+", ""), VISIBLE_REASONING, 0)
        tagged, shown = at > 0, mark != ""
        body = F.when(tagged & (end > 0), F.substring(t, after, end - after)).when(tagged, until_result(t, after)).when(shown, until_result(t, lead + F.char_length(mark) + 1)).otherwise("")
        return let(strip(body), lambda b: F.struct((tagged | shown).alias("present"), (tagged & (end > 0)).alias("closed"), F.char_length(b).alias("chars"), b.alias("text")))

    return let(text, of)


def foreign_counts(text: Column) -> Column:
    """How many characters of each watched script a text has, as a struct."""
    return F.struct(*[count_of(text, p).alias(name) for name, p in SCRIPTS.items()])


def simile_share(sentences: Column) -> Column:
    """The share of sentences with a simile's mark; 0 without sentences."""
    return let(sentences, lambda s: F.size(F.filter(s, lambda x: F.rlike(x, F.lit("|".join(SIMILES))))) / F.greatest(F.size(s), F.lit(1)))


def first_distinct(items: Column) -> Column:
    """The items that aren't blank, each at its first place."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def formatted(value: Column, digits: int = 4) -> Column:
    """A number with fixed digits, or NA where it isn't finite."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "NA").otherwise(F.format_string(f"%.{digits}f", value))


def overrides(text: Column) -> Column:
    """'name:factor,...' as a map; an item without a number fails."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: strip(x)), lambda x: x != "")

    def pair(x: Column) -> Column:
        number = F.substring_index(x, ":", -1).try_cast("double")
        name = strip(F.substring(x, F.lit(1), F.char_length(x) - F.char_length(F.substring_index(x, ":", -1)) - 1))
        good = F.contains(x, F.lit(":")) & number.isNotNull() & (name != "")
        return F.when(good, F.struct(name.alias("name"), number.alias("factor"))).otherwise(F.raise_error(F.concat(F.lit("not name:factor: "), x)).cast("struct<name:string,factor:double>"))

    return F.map_from_entries(F.transform(parts, pair))


def tail_context(text: Column, most: int = 3200, within: int = 600) -> Column:
    """The last `most` characters, from after their first blank line if that is near."""
    tail = F.when(F.char_length(text) > most, F.substring(text, F.char_length(text) - most + 1, F.lit(most))).otherwise(text)
    return let(tail, lambda t: F.when((F.char_length(text) > most) & F.instr(t, "\n\n").between(1, within), F.substring(t, F.instr(t, "\n\n") + 2, F.char_length(t))).otherwise(t))


def stop_trimmed(text: Column, stops: tuple[str, ...] = STOP_TEXTS) -> Column:
    """struct(kept, hit, rest): the text before its earliest stop string, that string, the rest."""
    at = F.array_min(F.filter(F.array(*[F.struct(F.instr(text, s).alias("at"), F.lit(s).alias("stop")) for s in stops]), lambda x: x["at"] > 0))
    return let(
        at,
        lambda a: F.when(a.isNull(), F.struct(text.alias("kept"), F.lit("").alias("hit"), F.lit("").alias("rest"))).otherwise(
            F.struct(F.substring(text, F.lit(1), a["at"] - 1).alias("kept"), a["stop"].alias("hit"), F.substring(text, a["at"] + F.char_length(a["stop"]), F.char_length(text)).alias("rest"))
        ),
    )


def result_contract(text: Column, required: bool = True, least: int = 40) -> Column:
    """struct(result, rest, opens, closes, reason): what stands between the result tags, and the
    first rule that the text breaks (null if none)."""

    def of(t: Column) -> Column:
        start = F.instr(t, RESULT_OPEN)
        after = start + len(RESULT_OPEN)
        end = F.when(start > 0, _locate_from(t, RESULT_CLOSE, after)).otherwise(F.instr(t, RESULT_CLOSE))
        return F.struct(t.alias("t"), start.alias("start"), end.alias("end"))

    def parts(x: Column) -> Column:
        t, start, end = x["t"], x["start"], x["end"]
        opened, closed = start > 0, end > 0
        first = start + len(RESULT_OPEN)
        result = F.when(opened & closed, F.substring(t, first, end - first)).when(opened, F.substring(t, first, F.char_length(t))).otherwise(t)
        rest = F.when(opened & closed, F.substring(t, end + len(RESULT_CLOSE), F.char_length(t))).otherwise("")
        opens, closes = occurrences(t, RESULT_OPEN), occurrences(t, RESULT_CLOSE)
        return F.struct(result.alias("result"), rest.alias("rest"), opened.alias("opened"), closed.alias("closed"), opens.alias("opens"), closes.alias("closes"))

    def judged(x: Column) -> Column:
        reason = (
            F.when(F.lit(required) & ~x["opened"] & ~x["closed"], "missing_result_tags")
            .when(~x["opened"] & x["closed"], "missing_result_open")
            .when(x["opened"] & ~x["closed"], "missing_result_close")
            .when(x["opens"] > 1, "multiple_result_open")
            .when(x["closes"] > 1, "multiple_result_close")
            .when(strip(x["rest"]) != "", "post_result_text")
            .when(F.lit(required) & (F.char_length(strip(x["result"])) < least), "empty_or_short_result")
            .when((F.contains(x["result"], F.lit("<")) | F.contains(x["result"], F.lit(":")) | F.contains(x["result"], F.lit("["))) & F.rlike(x["result"], F.lit(THOUGHT_LEAK)), "thought_leak")  # each of its forms has one of these
        )
        return F.struct(x["result"].alias("result"), x["rest"].alias("rest"), x["opens"].alias("opens"), x["closes"].alias("closes"), reason.alias("reason"))

    return let(strip(text), lambda t: let(of(t), lambda x: let(parts(x), judged)))


def _locate_from(text: Column, what: str, start: Column) -> Column:
    """The place of `what` at or after `start`, or 0."""
    tail = F.instr(F.substring(text, start, F.char_length(text)), what)
    return F.when(tail > 0, tail + start - 1).otherwise(0)


def occurrences(text: Column, what: str) -> Column:
    """How often a literal string occurs, without overlaps."""
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def symbol_noise(text: Column) -> Column:
    kept = "".join("\\" + c for c in ALLOWED_SYMBOLS)
    return count_of(text, r"(?U)[^\p{L}\p{N}\s" + kept + "]") / F.greatest(F.char_length(text), F.lit(1))


def repeated_line_rate(text: Column, least: int = 12) -> Column:
    return repeat_share(F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: F.char_length(x) >= least))


def repeated_ngram_rate(text: Column, n: int = 8) -> Column:
    return text_arrays.gram_repeat_share(text, n)


def longest_run(text: Column, chars: str = r"[\s\S]") -> Column:
    """The longest run of one character of a class."""
    found = F.regexp_extract_all(text, F.lit(f"({chars})\\1++"), F.lit(0))  # of two or more
    one = F.rlike(text, F.lit(chars)).cast("int")
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.char_length(x))), one)


def short_token_burst(text: Column) -> Column:
    """Whether a few short tokens fill the text or one of its windows."""
    return text_arrays.has_burst(text)


def mixed_latin_noise(text: Column) -> Column:
    def of(latin: Column) -> Column:
        share = F.size(F.filter(latin, lambda t: F.char_length(t) <= 4)) / F.greatest(F.size(latin), F.lit(1))
        return (F.size(latin) >= 12) & (count_of(text, r"([가-힣]{1,3})\1{2,}") >= 2) & (share >= 0.55)

    words = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Za-z]{1,12}\b"), F.lit(0))
    return F.when(count_of(text, HANGUL) >= 200, let(words, of)).otherwise(False)


def collapse_reason(text: Column, required: bool = False) -> Column:
    """The first sign of a collapsed output (null if none)."""
    # Python takes columns, not what lies within a lambda; the contract is judged once.
    judged = let(result_contract(text, required), lambda c: F.struct(strip(c["result"]).alias("result"), c["reason"].alias("reason")))

    def of(x: Column) -> Column:
        return let(
            x["result"],
            lambda r: F.when(x["reason"].isNotNull() & (x["reason"] != "empty_or_short_result"), x["reason"])
            .when(r == "", "empty")
            .when(F.char_length(r) < text_arrays.LEAST_CHARS, "too_short")
            .when(F.contains(r, F.lit("<")) & F.rlike(r, F.lit(SPECIAL_LEAK)), "special_token_leak")
            .when(F.rlike(r, F.lit("|".join(SCRIPTS[k] for k in ("replacement", "private_use", "hangul_jamo")))), "corrupt_character")
            .when(F.rlike(r, F.lit("|".join(SCRIPTS[k] for k in ("arabic", "cyrillic", "devanagari", "kana", "thai")))), "foreign_script_leak")
            .when(symbol_noise(r) > 0.08, "symbol_noise")
            .when(x["cycle"] | F.rlike(r, F.lit(r"(\p{Nd})\1{11}")), "char_run_repeat")
            .when(x["burst"], "short_token_burst")
            .when(mixed_latin_noise(r), "mixed_latin_noise")
            .when(repeated_line_rate(r) > 0.25, "line_repeat")
            .when(x["ngrams"] > 0.20, "ngram_repeat"),
        )

    return let(text_arrays.collapse_signs(judged), of)
