"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins double each message's jump to an ancestor until all have met their root, which
gives every leaf its root, depth and path score; the best leaves of each root are chosen, the stored jumps enumerate their
paths in as many joins, and each path becomes one conversation text with a loss mask over the assistant's texts.

Template: ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|`` (in roles a
newline becomes ``\\n``), so a control string only ever is one and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    back = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), back), "\\")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of plain turn lists (conv_id, turn, role, text): each row replies to the one before it.

    Rows go by turn, null turns first; equal turns by role and text, so repeated rows stay, one after the other. Rows with a null
    conv_id form one conversation. Null roles and texts are empty.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    rows = rows.withColumn("_n", at)
    return rows.select("conv_id", name(F.col("_n")).alias("msg_id"), F.when(F.col("_n") > 1, name(F.col("_n") - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(msg_id, root, depth, total) of all messages under a root, and for each round (msg_id, up): the 2**round-th ancestor."""
    m = messages.where("msg_id IS NOT NULL").dropDuplicates(["msg_id"]).select("msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select(F.col("msg_id").alias("parent_id"), F.lit(True).alias("_known"))
    m = m.join(known, "parent_id", "left")  # a parent that isn't there makes a root
    state = cut_lineage(m.select("msg_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"), F.col("msg_id").alias("top"), F.lit(1).alias("depth"), F.col("score").alias("total")))
    n, rounds = state.count(), []
    while True:
        open_ = state.where("up IS NOT NULL")
        rounds.append(open_.select("msg_id", "up"))
        if (1 << (len(rounds) - 1)) > n or open_.limit(1).count() == 0:  # a jump longer than all messages goes round a circle
            break
        above = state.select(F.col("msg_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        moved = open_.join(above, "up").select("msg_id", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        state = cut_lineage(moved.unionByName(state.where("up IS NULL")))  # messages that have met their root rest
    done = state.where("up IS NULL")
    return done.select("msg_id", F.col("top").alias("root"), "depth", "total"), rounds


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(path_id, rank, place, msg_id): the ``paths`` best root-to-leaf paths of every root, by mean score along the path, then length,
    then the leaf's id. Several equal ids count once; a missing parent makes a root; messages in a circle have no root and
    are left out."""
    known, rounds = _jumps(messages)
    known = cut_lineage(known)
    parents = messages.select(F.col("parent_id").alias("msg_id")).where("msg_id IS NOT NULL").distinct()
    leaves = known.join(parents, "msg_id", "left_anti").select("root", F.struct((-F.col("total") / F.col("depth")).alias("s"), (-F.col("depth")).alias("d"), F.col("msg_id").alias("leaf")).alias("_r"))
    if paths == 1:
        best = leaves.groupBy("root").agg(F.min("_r").alias("_r")).select(F.col("_r.leaf").alias("leaf"), F.lit(1).alias("rank"))
    else:
        order = F.row_number().over(Window.partitionBy("root").orderBy("_r"))
        best = leaves.withColumn("rank", order).where(F.col("rank") <= paths).select(F.col("_r.leaf").alias("leaf"), "rank")
    on = best.select(F.col("leaf").alias("path_id"), "rank", F.col("leaf").alias("msg_id"))
    for jump in reversed(rounds):  # every distance from the leaf is a sum of different powers of two
        on = cut_lineage(on.unionByName(on.join(jump, "msg_id").select("path_id", "rank", F.col("up").alias("msg_id"))))
    return on.join(known.select("msg_id", F.col("depth").alias("place")), "msg_id").select("path_id", "rank", "place", "msg_id")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(text, loss spans) of an array of structs with role and text; a span is a start in code points, from 0, and a length."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")
    sizes = F.transform(turns, lambda t: F.struct(
        (F.length(escape_role(t["role"])) + len(START) + 1).alias("before"), F.length(escape(t["text"])).alias("size"), (t["role"] == TRAINED).alias("on")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["before"] + x["size"] + len(END)).alias("at"),
        F.when(x["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["before"]).alias("start"), x["size"].alias("size"))))).otherwise(a["spans"]).alias("spans"))
    return text, F.aggregate(sizes, zero, step)["spans"]


def format_conversations(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(conv_id, path_id, rank, formatted, loss_spans), one row for each chosen path of each root.

    A conversation is collected into one row because that is the output; nothing else is.
    """
    texts = messages.where("msg_id IS NOT NULL").groupBy("msg_id").agg(F.min(F.struct("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    on = best_paths(messages, paths).join(texts, "msg_id")
    rows = on.groupBy("path_id", "rank").agg(F.first("m.conv_id", ignorenulls=True).alias("conv_id"), F.array_sort(F.collect_list(F.struct("place", F.col("m.role").alias("role"), F.col("m.text").alias("text")))).alias("_turns"))
    text, spans = format_turns(F.col("_turns"))
    return rows.select("conv_id", "path_id", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")
    body = lambda p: F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The trained texts, one after the other, without escapes."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["size"]))), "")
