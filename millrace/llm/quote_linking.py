"""Quotation linking for conversations.

Lines that start with ``>`` quote, one level a sign. Runs of lines of one level are passages;
passages and their longer lines are normalised and hashed, and so are the unquoted passages of
every message. A quoted hash is joined to the latest earlier message of its conversation that
wrote it, else to the first message of any conversation that did. Messages then stand in reply
order, without their quotes: by the message that opens the thread, then by turn.

The join inside a conversation is one ordered pass over (conversation, hash) and the other one
meets a single row a hash, so a passage that everyone quotes makes no pairs. Threads are found
by pointer jumping, which takes the logarithm of the longest reply chain in rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.staging import stage

#: A single line is linked by itself only if it has so many words.
LINE_WORDS = 4
MARKS = "^((?:>[ \\t]?)*)"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    """array<struct(level, body)>: the lines with their quote marks counted and taken off."""
    marks = lambda line: F.regexp_extract(line, MARKS, 1)
    quoted = lambda line: line.startswith(">")
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.struct(F.when(quoted(line), F.length(F.regexp_replace(marks(line), "[^>]", ""))).otherwise(0).alias("level"), F.when(quoted(line), F.substring(line, F.length(marks(line)) + 1, F.length(line))).otherwise(line).alias("body")))


def _passages(lines: Column) -> Column:
    """array<struct(level, lines)>: maximal runs of lines of one level, blank lines left out."""

    def cut(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda _, i: i), lambda i: F.coalesce(F.get(x, i)["level"] != F.get(x, i - 1)["level"], F.lit(True)))
        return _let(starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(x, at)["level"].alias("level"), F.transform(F.slice(x, at + 1, F.coalesce(F.get(s, j + 1), F.size(x)) - at), lambda line: line["body"]).alias("lines"))))

    return _let(F.filter(lines, lambda line: F.trim(line["body"]) != ""), cut)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[\\s\\p{Punct}]+", " "))


def _hashes(passage: Column) -> Column:
    """Hashes of the passage as a whole and of its longer lines, the whole first."""
    long_lines = F.filter(F.transform(passage, normalised), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS)
    return F.transform(F.filter(F.array_distinct(F.concat(F.array(normalised(F.array_join(passage, " "))), long_lines)), lambda x: x != ""), F.md5)


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to_turn, other_conv_id, other_turn, thread_turn, depth.

    reply_to_turn: the latest message of the conversation that this one quotes; other_*: the
    first message elsewhere, where only that has the passage. Rows without conv_id or turn link
    nothing; rows that repeat both share their links, and messages of one turn do not quote each
    other. A null or empty text quotes nothing, a text of any length is read whole, a passage that
    one message quotes several times counts once a level. Other columns of messages are left out.
    An empty table gives no rows. Reply order is conv_id, thread_turn, turn.
    """
    parsed = messages.select("conv_id", "turn", "role", _lines(F.col("text")).alias("lines"), F.col("text").isNull().alias("bare"))
    parsed = parsed.select("conv_id", "turn", "role", "bare", F.rtrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")).alias("text"), _passages(F.col("lines")).alias("passages"))
    parsed = stage(parsed, "messages")
    placed = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p"))
    hashed = placed.select("conv_id", "turn", "p.level", F.explode(_hashes(F.col("p.lines"))).alias("hash"))
    hashed = stage(hashed, "hashes").distinct()
    quotes, originals = hashed.where("level > 0"), hashed.where("level = 0").select("conv_id", "turn", "hash").distinct()

    both = originals.select("conv_id", "hash", "turn", F.col("turn").alias("wrote"), F.lit(None).cast("int").alias("level")).unionByName(quotes.select("conv_id", "hash", "turn", F.lit(None).cast(dict(messages.dtypes)["turn"]).alias("wrote"), "level"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("source", F.max("wrote").over(earlier)).where("level is not null").drop("wrote")
    first = originals.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("other"))
    found = inside.join(first, "hash", "left").withColumn("other", F.when(F.col("source").isNull() & (F.col("other.conv_id") != F.col("conv_id")), F.col("other")))
    links = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count_if(F.col("source").isNotNull() | F.col("other").isNotNull()).alias("n_linked"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), F.col("source")))).alias("reply_to_turn"), F.min("other").alias("other"),
    )
    links = stage(links, "links")
    threads = _threads(links.where("reply_to_turn is not null").select("conv_id", "turn", "reply_to_turn"))
    out = parsed.join(links, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", F.when(~F.col("bare"), F.col("text")).alias("text"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "reply_to_turn",
        F.col("other.conv_id").alias("other_conv_id"), F.col("other.turn").alias("other_turn"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", zero).alias("depth"),
    )


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of the messages that reply, by pointer jumping."""
    now = stage(replies.select("conv_id", "turn", F.col("reply_to_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(60):
        if now.isEmpty():
            break
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        met = now.join(above, ["conv_id", "up"], "left")
        now = stage(met.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
