"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found in every text by themselves: assignments to a secret's name, access
identifiers, and long hexadecimal strings. Weak candidates are parts that say little alone: short
values of a secret's name, values of an account's or key's identifier, and endpoints. They are
reported only if complementary parts lie near: a weak secret needs an identifier, a weak identifier
a secret, an endpoint both, each with fewer than `scope` code points between the two parts, wherever
in the text they stand. Parts are intervals of code points; each cell of `scope` code points notes
where the first and the last code point of each class lie in it, and a weak candidate joins the
notes of the cells that it reaches and tests the true distance. So the join grows with the parts
and never with their pairs, and a text full of candidates is spread over its cells.

The scan reads each text once and leaves a small table, which is written to the shared folder.
Defined cases: null is empty; rows with equal doc_id are kept apart by a hash of the text, and
repeated rows each get the same result; a null doc_id is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.native import cut, let, pieces, running
from corpusweave.llm.store import written

#: The base kinds' patterns and least lengths, in the order of ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "weak_endpoint")
#: Weak candidates.
WEAK_SECRET = r"""(?i)\b(passphrase|pwd|pass|private_?key|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WEAK_ID = r"""(?i)\b(access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
WEAK_ENDPOINT = r"""(?i)\b(https?|ftp|ssh|s3|jdbc:[a-z0-9]+|amqp|redis|mongodb)://[^\x20\x09-\x0D"'<>]+"""
SCOPE = 512
SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: int, hint: Column, keep=None, value: int = 0) -> Column:
    """The spans (start, kind, end; code points) of a pattern's leftmost non-overlapping matches,
    for rows where hint holds; keep(span, value) says which stay, value being the numbered group."""

    def spans(x: Column) -> Column:
        both = F.transform(F.sequence(F.lit(0), F.size(x["hits"]) - 1), lambda i: F.struct(F.char_length(F.get(x["gaps"], i)).alias("gap"), F.char_length(F.get(x["hits"], i)).alias("hit")))

        def placed(sizes: Column) -> Column:
            before = running(F.transform(sizes, lambda s: s["gap"] + s["hit"]), lambda a, b: a + b, F.lit(0))
            return F.zip_with(before, sizes, lambda at, s: F.struct((at + s["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + s["gap"] + s["hit"]).alias("end")))

        out = let(both, placed)
        return F.when(F.size(x["hits"]) > 0, out if keep is None else F.filter(out, lambda s, i: keep(s, F.get(x["values"], i)))).otherwise(F.array().cast(SPAN))

    p = F.lit(pattern)
    parts = [F.regexp_extract_all(text, p, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(value)).alias("values")]
    return F.when(hint, let(F.struct(*parts), spans)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, key (a hash of the text), and the spans of the base kinds
    (assign, access, hex) and of the candidates (weak)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = F.rlike(low, F.lit("passw|secret|token|api_?key"))
    part = F.rlike(low, F.lit("pass|pwd|private_?key|credential"))
    ident = F.rlike(low, F.lit("key_?id|client_?id|account|user|login"))
    long_value = lambda s, v: F.char_length(v) >= ASSIGN_LEAST
    short_value = lambda s, v: F.char_length(v) < ASSIGN_LEAST
    return docs.select(
        "doc_id",
        F.xxhash64(text, F.lit(3)).alias("key"),
        matches(text, ASSIGN, 0, named, long_value, 2).alias("assign"),
        matches(text, ACCESS, 1, F.contains(text, F.lit("AKIA")), lambda s, _: s["end"] - s["start"] >= ACCESS_LEAST).alias("access"),
        matches(text, HEX, 2, F.rlike(text, F.lit(HEX))).alias("hex"),
        F.concat(
            matches(text, ASSIGN, 3, named, short_value, 2),
            matches(text, WEAK_SECRET, 3, part),
            matches(text, WEAK_ID, 4, ident),
            matches(text, WEAK_ENDPOINT, 5, F.contains(text, F.lit("://"))),
        ).alias("weak"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of scan()'s weak candidates, those that have their complementary parts fewer than `scope`
    code points away, as doc_id, key and added (an array of spans)."""
    # Without a strong or weak part besides, nothing can be linked.
    some = found.where(F.size("weak") > 0).where(F.size("weak") + F.size("assign") + F.size("access") + F.size("hex") > 1)
    start, end, kind, cell = F.col("s.start"), F.col("s.end"), F.col("s.kind"), F.col("cell")

    def dealt(spans: Column, reach: int) -> DataFrame:
        """One row for each cell within `reach` of a span."""
        rows = some.select("doc_id", "key", F.explode(spans).alias("s"))
        return rows.select("doc_id", "key", "s", F.explode(F.sequence(F.floor(F.greatest(start - reach, F.lit(0)) / scope), F.floor((end - 1 + reach) / scope))).alias("cell"))

    # The first and last code point of a class in a cell decide, as what a candidate reaches covers
    # each cell from its begin, to its end, or whole.
    first, last = F.greatest(start, cell * scope), F.least(end, (cell + 1) * scope) - 1
    classes = {"secret": kind.isin(0, 2, 3), "ident": kind.isin(1, 4)}
    bounds = [f(F.when(held, at)).alias(f"{name}_{side}") for name, held in classes.items() for side, f, at in (("first", F.min, first), ("last", F.max, last))]
    there = dealt(F.concat("assign", "access", "hex", "weak"), 0).groupBy("doc_id", "key", "cell").agg(*bounds)
    weak = dealt(F.col("weak"), scope).where(kind >= 3).distinct()
    both = weak.alias("w").join(there.alias("t"), F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.key") == F.col("t.key")) & (F.col("w.cell") == F.col("t.cell")))
    near = [F.coalesce(F.bool_or((F.col(f"t.{name}_first") < F.col("w.s.end") + scope) & (F.col(f"t.{name}_last") >= F.col("w.s.start") - scope)), F.lit(False)).alias(name) for name in classes]
    seen = both.groupBy("w.doc_id", "w.key", "w.s").agg(*near)
    needs = F.when(kind == 3, F.col("ident")).when(kind == 4, F.col("secret")).otherwise(F.col("ident") & F.col("secret"))
    return seen.where(needs).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("s")).alias("added"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs(doc_id, text) as doc_id, key, assign, access, hex, base and spans: arrays of spans
    (start, kind, end) by start, then kind; kinds are places in KINDS."""
    found = written(scan(docs), "secrets")
    added = linked(found, scope).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "added")
    base = F.sort_array(F.concat("assign", "access", "hex"))
    out = found.join(added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return out.select("doc_id", "key", "assign", "access", "hex", base.alias("base"), F.sort_array(F.concat(base, F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every maximal run of overlapping spans replaced by a mark."""

    def of(x: Column) -> Column:
        """The text before each span that starts behind all earlier ones, and what is left."""
        parts, reach = x["parts"], x["reach"]
        kept = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(parts, F.get(reach, i), s["start"]), F.lit(mark))).otherwise(""))
        last = F.greatest(F.element_at(reach, -1), F.element_at(x["spans"], -1)["end"])
        return F.concat(F.array_join(kept, ""), cut(parts, last, F.char_length(text)))

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(pieces(text).alias("parts"), spans.alias("spans"), reach.alias("reach")), of)).otherwise(text)


def without_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of docs, all columns, with secrets redacted; n_chars, if there, follows the text.
    Rows without a finding don't take part in the join."""
    found = find_secrets(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("doc"), "key", "spans").distinct()
    # The row as a struct, so that no column of docs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(3)).alias("row_key"))
    out = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.col("row_key") == F.col("key")), "left")
    hit, text = F.col("spans").isNotNull(), F.col("row.text")
    clean = F.when(hit, redact(text, F.col("spans"))).otherwise(text)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cols["text"] = clean
    if "n_chars" in cols:
        cols["n_chars"] = F.when(hit, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return out.select(*[v.alias(c) for c, v in cols.items()])
