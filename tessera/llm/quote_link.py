r"""Quotation linking and reply-ordered conversations, in DataFrame operations only.

A line that starts with ``>`` marks is quoted; the number of marks is its level.
Consecutive lines of one level are a passage.  Passages are normalised (lower
case, white space collapsed) and hashed, and so are the bodies of all messages
(a message without its quotes) and their parts: each line, and each paragraph
(lines up to a blank one) as one text, however it is wrapped.  A passage links
to the first earlier message of its conversation that has its hash, else to the
first message of any other conversation that has it.  Where the whole passage is
found nowhere, each of its parts is looked up in the same way, and the passage
links to the message that holds most of its lines (then one of its own
conversation, then the first).  In other conversations a line or paragraph must
have ``MIN_LINE`` characters to be evidence; within a conversation any counts.
Originals are reduced to one message a hash (and conversation) before the joins,
so a passage that a third of all messages share costs one row.

A message replies to the target of its first linked level-1 passage.
Conversations that quote each other are one thread (connected components);
``level`` is the number of conversations between a message and the start of its
thread, and (thread, level, conv_id, turn) is the reply order.

Null text is an empty message (body null); messages of null conv_id or turn keep
their body but neither link nor are linked to.  Repeated rows give one result
each, with equal links.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

MIN_LINE = 20
MARK = r"^[ \t]*>"
MARKS = r"^[ \t>]*"
SAID = r"^On .* wrote:[ \t]*$"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """messages with ``body`` (without quotes and the line that introduces one) and
    ``passages``: array of (level, lines)."""
    def level(line: Column) -> Column:
        return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))

    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(
        level(x).alias("v"), F.when(level(x) > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("x")))
    df = messages.withColumn("_l", F.when(F.col("text").rlike(r"(?m)" + MARK), lines))
    at = lambda i: F.element_at("_l", i)
    n = F.size("_l")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (at(i)["v"] != at(F.greatest(i - 1, F.lit(1)))["v"]))
    df = df.withColumn("_s", F.when(F.col("_l").isNotNull(), starts))
    runs = F.transform("_s", lambda s, i: F.struct(
        at(s)["v"].alias("v"),
        F.transform(F.slice("_l", s, F.coalesce(F.get("_s", i + 1), n + 1) - s), lambda x: x["x"]).alias("lines")))
    plain = F.filter("_l", lambda x, i: (x["v"] == 0) & ~(x["x"].rlike(SAID) & (F.coalesce(F.get("_l", i + 1)["v"], F.lit(0)) > 0)))
    body = F.regexp_replace(F.array_join(F.transform(plain, lambda x: x["x"]), "\n"), r"^\s+|\s+$", "")
    none = F.array().cast("array<struct<v:int,lines:array<string>>>")
    return (df.withColumn("body", F.when(F.col("_l").isNull(), F.col("text")).otherwise(body))
            .withColumn("passages", F.when(F.col("_l").isNull(), none).otherwise(F.filter(runs, lambda r: r["v"] > 0)))
            .drop("_l", "_s"))


def _parts(lines: Column) -> Column:
    """Distinct (t, n): the normalised lines (n = 1) and the paragraphs of n lines."""
    lines = F.transform(lines, _norm)
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n{2,}"), lambda x: F.trim(x, F.lit("\n")))
    one = F.transform(lines, lambda x: F.struct(x.alias("t"), F.lit(1).alias("n")))
    more = F.transform(F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(
        F.translate(x, "\n", " ").alias("t"), F.size(F.split(x, "\n")).alias("n")))
    return F.filter(F.array_distinct(F.concat(one, more)), lambda x: x["t"] != "")


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, own, no, level, to_conv, to_turn) of the passages that link;
    own signs the text of the message, as two may share conv_id and turn; no is the
    place of the passage in its message."""
    known = (parsed.filter("conv_id is not null and turn is not null")
             .select("conv_id", "turn", "body", "passages", F.xxhash64("text").alias("own")))
    # rank 0: the whole passage, 1: a part of it; far: evidence in other conversations too
    whole = F.struct(F.lit(0).alias("rank"), _norm(F.array_join("q.lines", " ")).alias("t"), F.lit(1).alias("n"))
    parts = F.transform(_parts(F.col("q.lines")), lambda x: F.struct(F.lit(1).alias("rank"), x["t"].alias("t"), x["n"].alias("n")))
    quotes = (known.select("conv_id", "turn", "own", F.posexplode("passages").alias("no", "q"))
              .select("conv_id", "turn", "own", "no", F.col("q.v").alias("level"), F.explode(F.concat(F.array(whole), parts)).alias("k"))
              .filter("k.t != ''")
              .select("conv_id", "turn", "own", "no", "level", F.col("k.rank").alias("rank"), F.col("k.n").alias("n"),
                      ((F.col("k.rank") == 0) | (F.length("k.t") >= MIN_LINE)).alias("far"), _hash(F.col("k.t")).alias("h"))
              .distinct())
    quotes = keep(quotes)
    wanted = quotes.select("h").distinct()
    body = _norm(F.col("body"))
    texts = F.array_union(F.array(body), F.transform(_parts(F.split("body", "\n")), lambda x: x["t"]))
    originals = (known.select("conv_id", "turn", body.alias("body"), F.explode(texts).alias("t")).filter("t != ''")
                 .select("conv_id", F.col("turn").alias("near"), _hash(F.col("t")).alias("h"),
                         F.when((F.col("t") == F.col("body")) | (F.length("t") >= MIN_LINE), F.col("turn")).alias("far"))
                 .join(wanted, "h", "left_semi"))
    first_turn = originals.groupBy("h", "conv_id").agg(F.min("near").alias("near"), F.min("far").alias("far"))
    near = first_turn.select("h", "conv_id", "near")
    abroad = first_turn.filter("far is not null").select("h", "conv_id", F.col("far").alias("near"))
    first = abroad.groupBy("h").agg(F.min(F.struct("conv_id", "near")).alias("a"))
    # the first message of any other conversation: of the two least conversations, the one that isn't one's own
    second = (abroad.join(first, "h").filter(F.col("conv_id") != F.col("a.conv_id"))
              .groupBy("h").agg(F.min(F.struct("conv_id", "near")).alias("b")))
    other = first.join(second, "h", "left")
    found = (quotes.join(near, ["h", "conv_id"], "left").join(other, "h", "left")
             .withColumn("near", F.when(F.col("near") < F.col("turn"), F.col("near")))
             .withColumn("away", F.when(F.col("far"), F.when(F.col("a.conv_id") != F.col("conv_id"), F.col("a")).otherwise(F.col("b"))))
             .withColumn("to", F.when(F.col("near").isNotNull(), F.struct("conv_id", "near")).otherwise(F.col("away")))
             .filter("to is not null"))
    votes = found.groupBy("conv_id", "turn", "own", "no", "rank", "to").agg(F.sum("n").alias("n"), F.min("level").alias("level"))
    best = F.min(F.struct("rank", (-F.col("n")).alias("n"), (F.col("to.conv_id") != F.col("conv_id")).alias("away"), "to", "level"))
    return (votes.groupBy("conv_id", "turn", "own", "no").agg(best.alias("m"))
            .select("conv_id", "turn", "own", "no", F.col("m.level").alias("level"), F.col("m.to.conv_id").alias("to_conv"),
                    F.col("m.to.near").alias("to_turn")))


def levels(cross: DataFrame) -> DataFrame:
    """(conv, level) of conversations in the forest of (conv, parent) links; those
    on a cycle, which no start reaches, count from the reached ones' end."""
    cross = keep(cross.distinct())
    children = cross.select("conv").distinct()
    reached = (cross.select(F.col("parent").alias("conv")).distinct().join(children, "conv", "left_anti")
               .withColumn("level", F.lit(0)))
    front, depth = reached, 0
    left = children
    while True:
        front = keep(left.join(cross.join(front.select(F.col("conv").alias("parent")), "parent", "left_semi"), "conv", "left_semi")
                     .withColumn("level", F.lit(depth + 1)))
        if front.isEmpty():
            break
        depth += 1
        reached = reached.union(front)
        left = left.join(front, "conv", "left_anti")
    return reached.union(left.withColumn("level", F.lit(depth + 1)))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_passages, max_level, n_linked, reply_conv,
    reply_turn, thread and level of every message."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    found = keep(links(parsed))
    own = found.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("own").alias("_o")).agg(
        F.count("*").alias("n_linked"),
        F.min(F.when(F.col("level") == 1, F.struct("no", "to_conv", "to_turn"))).alias("r"))
    across = found.filter("conv_id != to_conv").select(F.col("conv_id").alias("conv"), F.col("to_conv").alias("parent"))
    roots = components(across, "conv", "parent")
    place = roots.join(levels(across).withColumnRenamed("conv", "node"), "node", "left").select(
        F.col("node").alias("_n"), "root", "level")
    out = (parsed.join(own, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))
                       & (F.xxhash64("text") == F.col("_o")), "left")
           .join(place, F.col("conv_id") == F.col("_n"), "left"))
    return out.select(
        "conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("passages", lambda q: q["v"])), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("r.to_conv").alias("reply_conv"),
        F.col("r.to_turn").alias("reply_turn"), F.coalesce("root", "conv_id").alias("thread"),
        F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def op5(messages: DataFrame) -> DataFrame:
    return conversations(messages)
