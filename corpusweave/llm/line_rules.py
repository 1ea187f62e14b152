"""Line-first cleaning in DataFrame functions only.

Every line of a text that holds a word is judged by itself: it fails without a sentence's end
in it or closing punctuation after it, as navigation (separators between few words), as symbols, as shouting, as the same few words again
and again, or by a boilerplate phrase. Failing lines are removed, and a document is rejected if that
takes more than `most_lost` of its characters. Base measures of the whole text (repeats, short
texts) reject a document before.

A text is one row throughout, so no row depends on another and nothing is shuffled. Defined cases:
a null or empty text has no words and is rejected; repeated rows are judged one by one; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.native import GAP_CHARS, chars_of, let, words

SYMBOLS = "#*$%&|<>"
#: Portable regular expressions: they mean the same to Java and RE2.
MARKS = ".!?…。！？।॥؟۔։።"
CLOSED = f"[{MARKS}][\"')\\]}}”’»]*([\\x20\\x09-\\x0D]|$)|[:;\"')\\]}}”’»][\\x20\\x09-\\x0D]*$"
#: Phrases of notices, forms and licences in lower case; a phrase begins and ends at a word's edge.
PHRASES = (
    # English
    "cookie (policy|settings|notice|consent)|(use|uses|using|accept|accepts|our|these) cookies|enable javascript|javascript is (disabled|required)|all rights reserved|"
    "terms of (use|service)|privacy policy|licen[sc]ed under|released under|general public license|lorem ipsum|copyright|subscribe to (our|the|this)|"
    "sign up (for|to|now|here|today)|(log|sign) in (to|with|here|now)|(please|must|to) (log|sign) in",
    # French
    "tous droits réservés|politique de confidentialité|conditions (générales )?d['’]utilisation|(utilise|utilisons|acceptez) (des|les|nos) cookies|sous licence|abonnez-vous|connectez-vous",
    # German
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|(verwendet|verwenden|nutzt|nutzen) cookies|lizenziert unter|unter der lizenz|jetzt (anmelden|registrieren|abonnieren)",
    # Spanish
    "todos los derechos reservados|política de (privacidad|cookies)|(condiciones|términos) de (uso|servicio)|(utiliza|utilizamos|usamos) cookies|bajo (la )?licencia|suscríbete|inicia sesión",
)
BOILERPLATE = f"(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(PHRASES)})([^\\p{{L}}\\p{{N}}_]|$)"
SEPARATORS = "|»›•·"
MOST_LOST = 0.5


def repeated_words(ws: Column, size: int) -> Column:
    """The words that lie in a window of `size` words which is found twice or more."""

    def of(hashes: Column) -> Column:
        def covered(found: Column) -> Column:
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(found, start, lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

        def places(pairs: Column) -> Column:
            same = F.transform(F.sequence(F.lit(1), F.size(pairs) - 1), lambda i: F.get(pairs, i)["h"] == F.get(pairs, i - 1)["h"])
            return let(same, lambda s: F.sort_array(F.transform(F.filter(pairs, lambda _, i: F.coalesce(F.get(s, i), F.lit(False)) | F.coalesce(F.get(s, i - 1), F.lit(False))), lambda x: x["at"])))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, lambda p: covered(places(p)))).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (size - 1)), lambda i: F.xxhash64(F.slice(ws, i, size)))
    return F.when(F.size(ws) > size, let(windows, of)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Whether a line that holds a word is to be removed."""
    holds = lambda chars: F.rlike(line, F.lit(f"[{chars}]"))
    # Characters are counted only in lines that can fail by their number.
    shouting = lambda: let(F.struct(chars_of(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("u"), chars_of(line, "abcdefghijklmnopqrstuvwxyz").alias("l")), lambda x: (x["u"] >= 10) & (x["u"] > x["l"]))
    return (
        ~F.rlike(line, F.lit(CLOSED))
        | (holds(SYMBOLS) & (chars_of(line, SYMBOLS) * 10 > F.char_length(line)))
        | (holds(SEPARATORS) & let(chars_of(line, SEPARATORS), lambda n: (n >= 3) & (n * 20 > F.char_length(line))))
        | (F.rlike(line, F.lit("[A-Z](?:[^A-Z]*+[A-Z]){9}")) & shouting())
        | ((F.char_length(line) >= 19) & let(words(line), lambda w: (F.size(w) >= 10) & (F.size(F.array_distinct(w)) * 10 < F.size(w))))
        | F.rlike(F.lower(line), F.lit(BOILERPLATE))
    )


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines (with a word), n_failed_lines, lost_chars, kept and cleaned (the text
    without its failing lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.select(
        "doc_id",
        text.alias("text"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, 8).alias("again"))).alias("w"),
        F.transform(F.split(text, "\n"), lambda x: let(F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")), lambda has: F.struct(x.alias("line"), has.alias("has"), F.when(has, line_fails(x)).otherwise(False).alias("fails")))).alias("lines"),
    )
    worded = F.transform(F.filter("lines", lambda x: x["has"]), lambda x: x["line"])
    measured = judged.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.char_length(F.translate("text", GAP_CHARS, "")).cast("long").alias("word_chars"),
        chars_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.col("w.again").alias("n_repeat_words"),
        let(worded, lambda x: F.size(x).cast("long")).alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], F.char_length(x["line"])).otherwise(0)).alias("lost_chars"),
        F.char_length("text").cast("long").alias("chars"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(most_lost) * F.col("chars"))).drop("chars")
