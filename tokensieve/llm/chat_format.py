"""Conversations out of reply trees, formatted as one string with a loss mask.

Messages point at the message that they answer. Iterative self-joins, each
doubling the distance, give every message its ancestors and the summed score of the
way to its root; the best ``top`` leaves of a tree are chosen, and the same
jump tables, from the longest jump down, list every message on the chosen
paths once. Each path becomes one conversation.

Template: ``<|im_start|>role LF text <|im_end|> LF`` for each turn. Inside
texts and roles ``<``, any backslashes and ``|`` gain one backslash, so no
control string can occur there and taking one away restores the text; roles
also escape backslash and line feed.

Defined results: null texts and roles are empty; rows that agree in tree and
message id count as different messages only if the caller numbers them apart;
a parent that is null or missing makes a root; messages on a reply
cycle have no root and are in no path; equal scores rank by leaf id; an empty
table gives no rows. Only the columns named are read. Built-in expressions,
joins and windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, path_rank, id, depth) of every message on the ``top`` best
    root-to-leaf paths of each tree; depth counts from the leaf. ``messages``
    has tree, id, parent and score, none but parent null."""
    nodes = messages.select("tree", "id", "parent", "score")
    known = nodes.select(F.col("tree").alias("_t"), F.col("id").alias("_i"))
    jump = nodes.join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_i")), "left").select(
        "tree", "id", F.col("_i").alias("up"), F.col("score").cast("double").alias("total"))
    jump = written(jump, "jump")
    n = jump.count()
    answered = jump.where("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_i")).distinct()
    leaves = jump.join(answered, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_i")), "left_anti").select("tree", F.col("id").alias("leaf"))
    leaves = written(leaves, "leaves")
    # messages that have reached their root leave the joins
    rooted, jump = jump.where("up is null"), jump.where("up is not null")
    jumps = [jump]
    while len(jumps) <= n.bit_length() and not jump.isEmpty():
        far = jump.unionByName(rooted).select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        step = written(jump.join(far, (F.col("tree") == F.col("_t")) & (F.col("up") == F.col("_i"))).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total")), "jump")
        rooted, jump = rooted.unionByName(step.where("up is null")), step.where("up is not null")
        jumps.append(jump)
    rooted = rooted.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "total")
    ranked = leaves.join(rooted, (F.col("tree") == F.col("_t")) & (F.col("leaf") == F.col("_i"))).select(
        "tree", "leaf", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")).alias("path_rank")).where(F.col("path_rank") <= top)
    paths = written(ranked.select("*", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k].select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "up")
        more = paths.join(far, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_i"))).select(
            "tree", "leaf", "path_rank", F.col("up").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        paths = written(paths.unionByName(more), "paths")
    return paths


def format_trees(messages: DataFrame, top: int = 1, learn_from: str = "assistant") -> DataFrame:
    """tree, leaf, path_rank, n_turns, formatted, loss_spans (start and length
    in code points of each text of role ``learn_from``). ``messages`` has
    tree, id, parent, score, role and text."""
    paths = best_paths(messages, top)
    said = messages.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_i")))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", "path_rank", "depth", (F.col("role") == learn_from).alias("learn"), head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("learn"), F.length("body").alias("length"), F.col("turn"))))
    out = turns.groupBy("tree", "leaf", "path_rank").agg(rows.alias("rows"))
    return out.select(
        "tree", "leaf", "path_rank", F.size("rows").cast("long").alias("n_turns"), F.array_join("rows.turn", "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r.learn), lambda r: F.struct(r.at.alias("start"), r.length.alias("length"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s.start.cast("int") + 1, s.length))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the one before
    it, by (turn, role, text)."""
    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tree = F.when(F.col("conv_id").isNull(), F.lit("none")).otherwise(F.col("conv_id").cast("string"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return filled.select(tree.alias("tree"), number.cast("long").alias("id"), F.lit(0.0).alias("score"), "role", "text") \
        .withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))


def digests(conversations: DataFrame) -> DataFrame:
    """What a reader finds in the formatted conversations: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    out = format_trees(written(chains(conversations), "chains"))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    kind = conversations.schema["conv_id"].dataType
    return out.select(
        F.when(F.col("tree") != "none", F.col("tree").cast(kind)).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts are control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def with_control(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


#: DuckDB's form of the query.
SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as body,
  regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') as name from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(name) + length(body) + 24) as bigint) as formatted_chars
from e group by conv_id
"""
