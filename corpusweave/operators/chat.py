"""Message arrays, preference rows and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.arrays import let
from corpusweave.functions.text import bad_char_ratio, class_ratio, compact_length


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id with messages (role, content) in turn order."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return rows.groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def trim_messages(messages: Column, most: int) -> Column:
    """From the last message backwards, at most `most` characters; the message that crosses the
    limit keeps its tail."""

    def step(acc: Column, m: Column) -> Column:
        take = F.least(acc["left"], F.char_length(m["content"]))
        kept = F.struct(m["role"].alias("role"), F.substring(m["content"], F.char_length(m["content"]) - take + 1, take).alias("content"))
        return F.when(acc["left"] > 0, F.struct((acc["left"] - take).alias("left"), F.concat(F.array(kept), acc["out"]).alias("out"))).otherwise(acc)

    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.aggregate(F.reverse(messages), F.struct(F.lit(most).alias("left"), empty.alias("out")), step, lambda a: a["out"])


def messages_text(messages: Column, joiner: str = "\n") -> Column:
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda x: x != ""), joiner)


def preference_reason(chosen: Column, rejected: Column, script: str, least: int = 800, least_ratio: float = 0.55, most_bad: float = 0.01, shorter: float = 0.45, longer: float = 1.80) -> Column:
    """Why a preference row is dropped, by the first rule that applies, or 'kept'."""
    ratio = F.char_length(chosen) / F.greatest(F.char_length(rejected), F.lit(1))
    blank = compact_length(rejected) == 0
    return (
        F.when(compact_length(chosen) < least, "chosen_too_short")
        .when(class_ratio(chosen, script) < least_ratio, "chosen_low_hangul")
        .when(bad_char_ratio(chosen, controls=True) > most_bad, "chosen_bad_chars")
        .when(~blank & (ratio < shorter), "chosen_much_shorter")
        .when(~blank & (ratio > longer), "chosen_much_longer")
        .otherwise("kept")
    )


def split_of(bucket: Column) -> Column:
    return F.when(bucket == "generate_human_vs_ai", "01").when(bucket == "nochange_rejected", "02").otherwise("03")


def decorate_last_user(messages: Column, text: str) -> Column:
    """The text appended to the last user message unless a message holds it; a user message of its
    own where there is none."""
    has = F.exists(messages, lambda m: F.contains(m["content"], F.lit(text)))
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    return F.when(has, messages).otherwise(
        let(
            F.coalesce(F.array_max(users), F.lit(-1)),
            lambda last: F.when(last < 0, F.concat(messages, F.array(F.struct(F.lit("user").alias("role"), F.lit(text).alias("content"))))).otherwise(
                F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(m["content"], F.lit("\n\n" + text))).otherwise(m["content"]).alias("content")))
            ),
        )
    )


def char_ids(text: Column) -> Column:
    """Code points plus 3, the codec of a tokenizer stand-in."""
    return F.when(F.char_length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c) + 3)).otherwise(F.array().cast("array<int>"))


def loss_labels(prompt: Column, answer: Column, most: int) -> Column:
    """struct(input_ids, labels): the ids of prompt and answer, at most `most`, with the prompt's
    labels -100."""
    ids = F.slice(F.concat(char_ids(prompt), char_ids(answer)), 1, most)
    return let(ids, lambda x: F.struct(x.alias("input_ids"), F.transform(x, lambda v, i: F.when(i < F.char_length(prompt), F.lit(-100)).otherwise(v)).alias("labels")))


def padded(values: Column, to: int, fill: int) -> Column:
    """The array filled up to a multiple of `to`."""
    n = F.pmod(-F.size(values), F.lit(to)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(fill), n))


def without_terminal(ids: Column, special: list[int]) -> Column:
    """The ids without the special ones at their end."""
    own = F.filter(F.transform(ids, lambda v, i: F.when(~v.isin(special), i + 1)), lambda i: i.isNotNull())
    return F.slice(ids, 1, F.coalesce(F.array_max(own), F.lit(0)))


def mask_checks(prompt: Column, answer: Column, most: int = 1 << 20) -> Column:
    """struct of checks of loss_labels(): the prompt is masked, the answer isn't, both result tags are
    seen, and nothing follows the closing one."""

    def of(m: Column) -> Column:
        n = F.char_length(prompt)
        seen = F.array_join(F.transform(F.filter(m["labels"], lambda v: v != -100), lambda v: F.chr(v - 3)), "")
        return F.struct(
            F.forall(F.slice(m["labels"], 1, n), lambda v: v == -100).alias("prompt_masked"),
            F.exists(F.slice(m["labels"], n + 1, most), lambda v: v != -100).alias("answer_seen"),
            F.contains(seen, F.lit("<result>")).alias("open_seen"),
            F.contains(seen, F.lit("</result>")).alias("close_seen"),
            F.endswith(seen, F.lit("</result>")).alias("nothing_after"),
        )

    return let(loss_labels(prompt, answer, most), of)


def checked_messages(messages: Column) -> Column:
    """The messages, failing where a role is missing or a content isn't text."""
    bad = F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    return F.when(bad, F.raise_error(F.lit("a message without role or content"))).otherwise(messages)


def as_messages(text: Column) -> Column:
    """A text as one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
