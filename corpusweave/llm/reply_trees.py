"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins by pointer doubling find, for every
message, the root above it and what its path there scores (as many rounds as the depth has binary
digits); branches, the root-to-leaf paths, are ranked by the mean score of their messages; and the
messages of the chosen branches are enumerated by joining each leaf's growing path with the jump
tables of the same rounds. Joins are by message, so a conversation with many messages is spread over
tasks until its branches are written out, one row each; only chains() sorts a conversation's rows in
one task, as they end as one branch and so as one row.

The template marks a turn as `### role: text</turn>` and a line end. Inside texts and roles, a
control string gets a backslash after its first part (`### ` becomes `###\\ `, `</turn>` becomes
`<\\/turn>`), and one that has backslashes there already gets one more, so reading back is exact.

Defined cases: a null text or role is empty; a message whose parent doesn't exist is a root;
messages on a cycle reach no root and are in no branch; repeated (conv_id, id) rows count as one
message, the least by (parent, role, text); a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.store import written

#: The template's control strings.
HEAD, COLON, END = "### ", ": ", "</turn>"
ESCAPES = ((r"###(\\*) ", r"###$1\\ "), (r"<(\\*)/turn>", r"<$1\\/turn>"))
UNESCAPES = ((r"###\\(\\*) ", r"###$1 "), (r"<\\(\\*)/turn>", r"<$1/turn>"))
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for pattern, to in ESCAPES + ((r":(\\*) ", r":$1\\ "),) * role:
        text = F.regexp_replace(text, pattern, to)
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for pattern, to in UNESCAPES + ((r":\\(\\*) ", r":$1 "),) * role:
        text = F.regexp_replace(text, pattern, to)
    return text


def chains(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages in which each turn replies to the one before;
    rows of one turn follow each other by role and text."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", order.alias("id"), F.nullif(order - 1, F.lit(0).cast("long")).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, best: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen branches (conv, leaf, branch_score, rank) and their messages (conv, leaf, back:
    replies between the message and the leaf, id)."""
    links = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = links.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = links.join(there, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent")))
    active = written(links.select("conv", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), "score"), "replies")
    total, jumps, done = active.count(), [], []
    while True:  # messages that have met their root leave the rounds
        done.append(active.where("up IS NULL"))
        rest = active.where("up IS NOT NULL")
        if rest.isEmpty() or (1 << len(jumps)) > 2 * total:
            break
        jumps.append(rest.select("conv", "id", "up"))
        known = done[0]
        for part in done[1:]:
            known = known.unionByName(part)
        above = known.unionByName(rest).select("conv", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("score").alias("score2"))
        active = written(rest.join(above, ["conv", "up"]).select("conv", "id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("score") + F.col("score2")).alias("score")), "replies")
    state = done[0]
    for part in done[1:]:
        state = state.unionByName(part)
    leaves = state.join(jumps[0].select("conv", F.col("up").alias("id")).distinct(), ["conv", "id"], "left_anti") if jumps else state
    ranked = leaves.select("conv", F.col("id").alias("leaf"), (F.col("score") / F.col("n")).alias("branch_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf")))
    chosen = written(ranked if best is None else ranked.where(F.col("rank") <= best), "branches")
    path = chosen.select("conv", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps):
        path = path.unionByName(path.join(jump, ["conv", "id"]).select("conv", "leaf", F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back")))
        if k % 4 == 3:
            path = written(path, "paths")
    return chosen, path


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages(conv_id, id, parent, role, text, score) as one row per chosen branch (all, or the
    `best` of each conversation): conv_id, leaf, rank, branch_score, n_turns, formatted, and loss:
    the spans (start, end; code points) of the assistant's texts in it."""
    # The conversation as a struct, which joins null to null.
    messages = messages.select(F.struct("conv_id").alias("conv"), "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    once = messages.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    messages = once.select("conv", "id", "m.*")
    chosen, path = branches(messages, best)
    lead = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(COLON))
    body = escape(F.col("text"))
    turns = path.join(messages, ["conv", "id"]).select("conv", "leaf", "back", F.concat(lead, body, F.lit(END + "\n")).alias("turn"), F.char_length(lead).alias("lead"), F.char_length(body).alias("size"), (F.col("role") == ASSISTANT).alias("learn"))
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.col("lead"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "turn", "start", "size", "learn")))
    out = turns.groupBy("conv", "leaf").agg(parts.alias("p")).join(chosen, ["conv", "leaf"])
    return out.select(
        F.col("conv.conv_id").alias("conv_id"),
        "leaf",
        "rank",
        "branch_score",
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["start"].cast("int").alias("start"), (x["start"] + x["size"]).cast("int").alias("end"))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END + "\n"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(HEAD) + 1, F.char_length(piece))
        at = F.instr(rest, COLON)
        return F.struct(unescape(F.substring(rest, F.lit(1), at - 1), role=True).alias("role"), unescape(F.substring(rest, at + len(COLON), F.char_length(rest))).alias("text"))

    return F.transform(pieces, turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
