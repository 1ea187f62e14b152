"""Rows for training and evaluation: reshaped texts, continuations, chats, prompts and controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text
from corpusweave.functions.arrays import let
from corpusweave.operators.chat import messages_text, split_of
from corpusweave.operators.rows import hash_order, numbered

#: What tells a table of contents and front matter, and how much of a text is looked at.
CHAPTER = r"^(?:제\s*)?\d{1,4}\s*[장화](?:[.\s].*)?$"
CONTENTS = "목차"
FRONT_MATTER = (
    r"(?i)(작품\s*소개|저자\s*소개|장편소설|텍본|스캔본|다운로드|원본\s*링크|https?://|"
    r"무단\s*전재|무단\s*복제|ISBN|[ⓒ©]|"
    r"(?:^|\n)\s*(?:판권|지은이|발행처|출판사|전자책|정가|펴낸곳|펴낸이|등록번호)\s*[:：])"
)
TRAINING_HEAD, FORMAT_HEAD = 3000, 4000
#: Sizes of continuations, and tasks whose results are always tagged.
CONTEXT, COMPLETION, MORE, LEAST_CONTEXT, LEAST_COMPLETION = 1600, 2600, 600, 400, 500
TAGGED_TASKS = ("format_stop", "continuation")
SOURCE_MARK = "원문:\n"
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def artifact_reason(column: Column, head: int | None = TRAINING_HEAD) -> Column:
    """Why a text isn't prose, or null: contents with two or more chapter lines, or front matter, in
    its first `head` characters (all, if None)."""

    def of(t: Column) -> Column:
        chapters = F.filter(F.transform(text.lines(t), lambda x: text.strip(x)), lambda x: F.rlike(x, F.lit(CHAPTER)))
        return F.when(F.contains(t, F.lit(CONTENTS)) & (F.size(chapters) >= 2), "table_of_contents").when(F.rlike(t, F.lit(FRONT_MATTER)), "front_matter_or_metadata")

    return let(column if head is None else F.substring(column, 1, head), of)


def raw_rows(docs: DataFrame) -> DataFrame:
    """docs(id, text, source_file) with a text as raw training rows."""
    return docs.where(text.strip(F.coalesce("text", F.lit(""))) != "").select(F.lit("raw_lm").alias("row_type"), "id", "text", "source_file", F.col("id").alias("source_row_id"))


def continuation_rows(docs: DataFrame, system: str, user: str, context: int = CONTEXT, completion: int = COMPLETION) -> DataFrame:
    """docs(id, text, source_file) as three messages: system, user (with {context}) and the tagged
    completion. Short texts and completions that aren't prose are left out."""
    t = docs.select("id", "source_file", text.strip(F.coalesce("text", F.lit(""))).alias("t")).where(F.char_length("t") >= context + MORE)
    t = t.select("id", "source_file", text.strip(F.substring("t", 1, context)).alias("c"), text.strip(F.substring("t", context + 1, completion)).alias("a"))
    t = t.where((F.char_length("c") >= LEAST_CONTEXT) & (F.char_length("a") >= LEAST_COMPLETION) & artifact_reason(F.col("a"), FORMAT_HEAD).isNull())
    before, after = user.split("{context}")
    m = F.array(message("system", system), message("user", F.concat(F.lit(before), "c", F.lit(after))), message("assistant", F.concat(F.lit("<result>\n"), "a", F.lit("\n</result>"))))
    return t.select(F.lit("continuation_sft").alias("row_type"), F.concat(F.lit("cont-"), F.col("id").cast("string")).alias("id"), m.alias("messages"), F.col("id").alias("source_row_id"), "source_file", F.char_length("c").alias("context_chars"), F.char_length("a").alias("completion_chars"))


def result_wrapped(content: Column) -> Column:
    """A stripped text between result tags, unless it has both."""
    return let(text.strip(content), lambda t: F.when(F.contains(t, F.lit(text.RESULT_OPEN)) & F.contains(t, F.lit(text.RESULT_CLOSE)), t).otherwise(F.concat(F.lit("<result>\n"), t, F.lit("\n</result>"))))


def assistant_text(messages: Column, joiner: str = "\n\n") -> Column:
    """The assistant's texts that aren't blank."""
    own = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.filter(own, lambda x: text.strip(x) != ""), joiner)


def format_rows(rows: DataFrame, most: int = 0, wrap: bool = True, artifacts: bool = True) -> tuple[DataFrame, DataFrame]:
    """rows(id, messages, source) with an assistant's text as format rows, results tagged, the first
    `most` by id (0: all); and the count of rows dropped by reason."""
    held = rows.where(text.strip(assistant_text(F.col("messages"))) != "").withColumn("reason", artifact_reason(assistant_text(F.col("messages")), FORMAT_HEAD) if artifacts else F.lit(None).cast("string"))
    kept = held.where("reason IS NULL")
    kept = kept.orderBy("id").limit(most) if most > 0 else kept
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", result_wrapped(F.coalesce(x["content"], F.lit("")))).otherwise(x["content"]).alias("content")))
    out = kept.select(F.lit("format_sft").alias("row_type"), F.concat(F.lit("format-"), F.col("id").cast("string")).alias("id"), (m if wrap else F.col("messages")).alias("messages"), F.coalesce("source", F.lit("")).alias("source"), F.col("id").alias("source_row_id"))
    return out, held.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def routed(rows: DataFrame) -> DataFrame:
    """Preference rows (bucket, kept) once under their split and once under curated_mix."""
    some = rows.where("kept").withColumn("curated", F.lit(True))
    return some.withColumn("split", F.explode(F.array(split_of(F.col("bucket")), F.lit("curated_mix"))))


def selected(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, task: str | None = None, order: str | None = None, limit: int = 0) -> DataFrame:
    """Rows of the row types to include but those to exclude, of a task (task or else grpo_task;
    'mixed' takes all), the first `limit` by `order`."""
    out = rows
    if include:
        out = out.where(F.col("row_type").isin(include))
    if exclude:
        out = out.where(~F.col("row_type").isin(exclude))
    if task and task != "mixed":
        out = out.where(F.coalesce(F.nullif("task", F.lit("")), "grpo_task") == task)
    return out.orderBy(order).limit(limit) if limit else out


def has_hangul(prompt: Column) -> Column:
    """Whether a Hangul syllable stands anywhere in a nested prompt."""
    return F.rlike(F.to_json(prompt), F.lit(text.HANGUL))


def controls(rows: DataFrame, group: str, count: int, order: str) -> DataFrame:
    """The first `count` rows as controls, numbered group-0000 on; fewer rows fail."""
    top = numbered(rows.orderBy(order).limit(count), "_i", order)
    if top.count() < count:
        raise ValueError(f"{group}: fewer than {count} rows")
    return top.select(_number(group, F.col("_i")).alias("id"), F.lit(group).alias("group"), *[c for c in rows.columns if c not in ("id", "group")])


def _number(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(i.cast("string"), F.greatest(F.lit(4), F.char_length(i.cast("string"))), F.lit("0")))


def prompt_rows(rows: DataFrame, prefix: str, order: str) -> DataFrame:
    """id as prefix-number-id, task, prompt, and of the optional columns those that rows has."""
    some = [c for c in ("source_text", "reference_text", "max_output_chars") if c in rows.columns]
    n = numbered(rows, "_i", order)
    return n.select(F.concat(_number(prefix, F.col("_i")), F.lit("-"), F.col("id").cast("string")).alias("id"), "task", "prompt", *some)


def analysis_rows(parts: list[tuple[str, str, DataFrame, str, bool]]) -> DataFrame:
    """Parts (task, group, rows, text column, tags required) as one table of (id, eval_task, group,
    source_file, chunk_id, raw_text, analysis_text, contract_reason); blank analysis texts go. Rows
    bring id, source_file and chunk_id."""
    out = []
    for task, group, rows, column, required in parts:
        t = rows.select("id", F.lit(task).alias("eval_task"), F.lit(group).alias("group"), "source_file", "chunk_id", F.coalesce(column, F.lit("")).alias("raw_text"))
        c = text.result_contract(F.col("raw_text"), required)
        t = t.withColumn("_c", c).select(*t.columns, text.strip(F.col("_c.result")).alias("analysis_text"), F.coalesce("_c.reason", F.lit("")).alias("contract_reason"))
        out.append(t.where(F.col("analysis_text") != ""))
    return reduce(DataFrame.unionByName, out)


#: Columns that no report shows.
HIDDEN = r"^(sampled_offset|contract_.*|composite_.*_metric_count)$"


def reportable(values: DataFrame, first: list[str] | None = None) -> DataFrame:
    """The metrics of values(metric, value) with a finite value, but hidden ones: place, metric; the
    names of `first` lead in their order, the others follow by name."""
    finite = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & ~F.rlike("metric", F.lit(HIDDEN)))
    names = finite.select("metric").distinct()
    lead = F.array(*[F.lit(x) for x in first or [""]])
    at = F.array_position(lead, F.col("metric"))
    return numbered(names.withColumn("_at", F.when(at > 0, at).otherwise(len(first or []) + 1)), "place", "_at", "metric").select("place", "metric")


def dotted(df: DataFrame, *structs: str) -> DataFrame:
    """The fields of struct columns as dotted columns, the other columns as they are."""
    out = []
    for c in df.columns:
        fields = df.schema[c].dataType.names if c in structs else None
        out += [F.col(f"`{c}`")] if fields is None else [F.col(f"`{c}`.`{f}`").alias(f"{c}.{f}") for f in fields]
    return df.select(*out)


def tags_required(task: Column, prompt: Column, policy: str = "auto", legacy: bool = True) -> Column:
    """Whether a row's result must be tagged: always, never, or by its task and prompt messages."""
    if policy != "auto":
        return F.lit(policy == "always")
    shown = messages_text(prompt)
    return F.lit(legacy) & (task.isin(*TAGGED_TASKS) | F.contains(shown, F.lit(text.RESULT_OPEN)) | F.contains(shown, F.lit(text.RESULT_CLOSE)))


def row_key(chunk: Column, own: Column, index: Column) -> Column:
    """The first of chunk id, own id and index:0000 that isn't empty."""
    padded = F.lpad(index.cast("string"), F.greatest(F.lit(4), F.char_length(index.cast("string"))), F.lit("0"))
    return F.coalesce(F.nullif(chunk, F.lit("")), F.nullif(own, F.lit("")), F.concat(F.lit("index:"), padded))


def first_text(*candidates: Column) -> Column:
    """The first candidate that isn't null: a string, or messages joined by line ends."""
    return F.coalesce(*candidates)


def at_position(values: Column, index: Column, default: Column) -> Column:
    """The value at a place of an array, else the default."""
    return F.coalesce(F.get(values, index), default)


def topped_up(df: DataFrame, count: int, key: str, seed: int) -> DataFrame:
    """`count` rows in a hashed order: without repeats if there are enough, else all rows and as many
    repeats of hashed choice as are missing."""
    n = df.count()
    if n >= count or n == 0:
        return hash_order(df, F.col(key), seed).limit(count)
    spread = F.sequence(F.lit(0), F.lit(-(-count // n) - 1))
    again = df.withColumn("_copy", F.explode(spread))
    ordered = again.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "_copy", F.col(key).cast("string")), 256))
    return ordered.orderBy(F.least("_copy", F.lit(1)), "_copy", "_h").limit(count).drop("_copy", "_h")


def variant(variants: list[str], *key: Column, seed: int = 0) -> Column:
    """One of some texts, by a salted hash of a key."""
    return F.get(F.array(*[F.lit(v) for v in variants]), F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(len(variants))).cast("int"))


def first_per_file(rows: DataFrame, file: str, order: str, most: int) -> DataFrame:
    """The first rows of each file; the rank limit is applied before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order))).where(F.col("_n") <= most).drop("_n")


# Prompts.


def on_last_user(messages: Column, change, otherwise: Column | None = None) -> Column:
    """Messages with the last user message's content changed; with `otherwise`, such a message is
    added where there is none."""
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    changed = lambda last: F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, change(F.coalesce(m["content"], F.lit("")))).otherwise(m["content"]).alias("content")))
    none = messages if otherwise is None else F.concat(messages, F.array(message("user", otherwise)))
    return let(F.coalesce(F.array_max(users), F.lit(-1)), lambda last: F.when(last < 0, none).otherwise(changed(last)))


def source_of_prompt(content: Column) -> Column:
    """What follows the last source mark, else the whole content."""
    at_line, anywhere = F.lit("\n" + SOURCE_MARK), F.lit(SOURCE_MARK)
    tail = F.when(F.contains(content, at_line), F.substring_index(content, "\n" + SOURCE_MARK, -1)).when(F.contains(content, anywhere), F.substring_index(content, SOURCE_MARK, -1)).otherwise(content)
    return text.strip(tail)


def rebuilt_prompt(messages: Column, opening: str, contract: str, guidance: str) -> Column:
    """Rewrite prompts with the last user message made anew of an opening, the contract, the guidance
    and the source that it held."""
    made = lambda source: text.strip(F.concat(F.lit(f"{opening}\n\n{contract}\n\n{guidance}\n\n{SOURCE_MARK}"), source))
    return on_last_user(messages, lambda c: made(source_of_prompt(c)), made(F.lit("")))


#: An old length line, a length bullet, the header it follows and its wording.
OLD_LENGTH = r"\n\n분량 조건(?:\([^)]*\))?:[^\n]+"
LENGTH_BULLET = r"(?m)^- .*?(?:\d[\d,]*\s*자|최소\s*\d[\d,]*|최종 본문).*?(?:작성하세요|마무리하세요|쓰되).*$"
REQUIREMENTS = "요구사항:\n"


def length_line(least: int, most: int) -> str:
    bounds = [f"{n:,}자 {word}" for n, word in ((least, "이상"), (most, "이내")) if n > 0]
    return f"- 최종 본문은 {', '.join(bounds)}로 작성하세요." if bounds else ""


def with_length(content: Column, least: int, most: int) -> Column:
    """A prompt with its length instruction put right: the old line goes, the first length bullet is
    replaced, or a new one follows the requirements' header, or header and bullet end the prompt."""
    line = length_line(least, most)

    def of(t: Column) -> Column:
        # Only the first match: the text is cut around it.
        found = F.regexp_extract(t, LENGTH_BULLET, 0)
        at = F.instr(t, found)
        replaced = F.concat(F.substring(t, F.lit(1), at - 1), F.lit(line), F.substring(t, at + F.char_length(found), F.char_length(t)))
        head = F.instr(t, REQUIREMENTS)
        behind = head + len(REQUIREMENTS)
        inserted = F.concat(F.substring(t, F.lit(1), behind - 1), F.lit(line + "\n"), F.substring(t, behind, F.char_length(t)))
        plain = F.when(F.contains(t, F.lit(REQUIREMENTS.strip())), t).otherwise(F.concat(t, F.lit("\n\n" + REQUIREMENTS + line)))
        return F.when(found != "", replaced).when(head > 0, inserted).otherwise(plain)

    trimmed = F.regexp_replace(F.regexp_replace(content, r"(?U)\s+$", ""), OLD_LENGTH, "")
    return let(trimmed, of) if line else trimmed


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template whose {names} are replaced by columns; null fields are empty."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def source_replaced(prompt: Column, old: Column, new: Column, least: int = 300) -> Column:
    """Messages with the old source replaced once by the new one; a message that lacks it gets the
    new one for what follows its last blank line, if that is longer than `least`."""

    def content(c: Column) -> Column:
        at = F.instr(c, old)
        last = F.substring_index(c, "\n\n", -1)
        once = F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.char_length(old), F.char_length(c)))
        head = F.regexp_replace(F.substring(c, F.lit(1), F.char_length(c) - F.char_length(last) - 2), r"(?U)\s+$", "")
        return F.when((old != "") & (at > 0), once).when(F.contains(c, F.lit("\n\n")) & (F.char_length(last) > least), F.concat(head, F.lit("\n\n"), new)).otherwise(c)

    return F.transform(prompt, lambda m: F.struct(m["role"].alias("role"), content(F.coalesce(m["content"], F.lit(""))).alias("content")))
