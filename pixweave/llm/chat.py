"""Chat formatting: quotes in messages are linked to the messages they come from, and taken out.

A line's quote level is the number of ">" it starts with. Runs of lines of one level are passages. Passages, their
paragraphs and their lines of at least three words, lower-cased with white space squeezed, are hashed; a quoted unit
links to the original, the earliest message of the conversation that has it unquoted at a lower turn. A message
replies to the latest original among its quotes of the lowest level that links. Pointer doubling over these links
gives every message its thread's root and its depth, and along a walk around the thread's tree its position: first a
message, then each reply to it by turn, each followed by its own replies. Sorted by (conv_id, thread_root, position) a
conversation is in reply order, without quotes. A conversation is never gathered into one row or task, however many
turns it has or replies a message gets.

Only DataFrame functions are used. Edge cases: a null text is an empty message; messages without a conversation or
turn stay, without links; rows that repeat a (conv_id, turn) share one place in the thread; a quote without an
original stays unlinked but is still taken out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, written

#: Turns of replies to one message that are put in order by one task.
SPAN = 1024
MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: The line that mail programs put before a quote (fixed wordings in four languages).
ATTRIBUTION = r"^[ \t]*(?:On .* wrote|Am .* schrieb.*|Le .* a écrit|El .* escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _passages(text: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one quote level, without marks and attribution lines."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.substring(x, F.length(marks) + 1, F.length(x)).alias("text"))

    def is_attribution(lines: Column, i: Column) -> Column:
        return (F.get(lines, i)["level"] < F.get(lines, i + 1)["level"]) & F.get(lines, i)["text"].rlike(ATTRIBUTION)

    def drop_attribution(lines: Column) -> Column:
        return F.filter(lines, lambda x, i: ~F.coalesce(is_attribution(lines, i), F.lit(False)))

    def runs(lines: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

        def run(starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                part = F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)
                return F.struct(F.get(lines, s)["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["text"]), "\n").alias("text"))

            return F.transform(starts, one)

        return _once(first, run)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)
    return _once(_once(lines, drop_attribution), runs)


def _units(passage: Column) -> Column:
    """Hashes of a passage, its paragraphs and its longer lines."""
    parts = F.concat(F.array(passage), F.split(passage, r"\n[ \t]*\n"), F.filter(F.split(passage, "\n"), lambda x: F.regexp_count(x, F.lit(r"\S+")) >= 3))
    clean = F.filter(F.transform(parts, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(clean, lambda x: F.md5(x)))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with passages (level, text) and ``own``: the text without quotes."""
    x = messages.withColumn("passages", _passages(F.col("text")))
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    return x.withColumn("own", F.btrim(own, F.lit(" \t\r\n")))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked): a row per message with a quote that has an original."""
    x = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p"))
    quoted = x.filter("p.level > 0").select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_units(F.col("p.text"))).alias("unit"))
    quoted = written(quoted.distinct(), "chat-quoted")
    asked = quoted.select("conv_id", "unit").distinct()
    own = x.filter("p.level = 0").select("conv_id", "turn", F.explode(_units(F.col("p.text"))).alias("unit"))
    # The originals: one row per conversation and unit, whatever the number of messages that hold it.
    originals = own.groupBy("conv_id", "unit").agg(F.min("turn").alias("original")).join(asked, ["conv_id", "unit"], "left_semi")
    linked = quoted.join(originals, ["conv_id", "unit"]).filter("original < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "original"))["original"]
    return linked.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.countDistinct("original").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_root, reply_depth) of every message that replies, by pointer doubling."""
    state = written(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("steps")), "chat-threads")
    while True:
        there = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        new = written(state.join(there, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved")), "chat-threads", F.col("moved"))
        if not new.counted:
            return new.select("conv_id", "turn", F.col("up").alias("thread_root"), F.col("steps").alias("reply_depth"))
        freed(state)
        state = new.drop("moved")
        state.scratch = new.scratch


def _next_reply(links: DataFrame) -> DataFrame:
    """(conv_id, turn, sibling): of each reply the next one, by turn, to the same message; null for the last.

    Replies are put in order SPAN turns at a time, and then the spans, so that no task holds all replies to one message.
    """
    x = links.select("conv_id", "reply_to", "turn", F.floor(F.col("turn") / SPAN).alias("span"))
    inside = Window.partitionBy("conv_id", "reply_to", "span").orderBy("turn")
    spans = x.groupBy("conv_id", "reply_to", "span").agg(F.min("turn").alias("first"))
    after = spans.withColumn("after", F.lead("first").over(Window.partitionBy("conv_id", "reply_to").orderBy("span"))).drop("first")
    x = written(x.withColumn("sibling", F.lead("turn").over(inside)), "chat-replies")
    x = x.join(written(after, "chat-spans"), ["conv_id", "reply_to", "span"])
    return x.select("conv_id", "turn", F.coalesce("sibling", "after").alias("sibling"))


def positions(links: DataFrame) -> DataFrame:
    """(conv_id, turn, to_end): of every message with a link the messages of its thread from it on, in reply order.

    The walk around a tree enters and leaves each message once: from entering to its first reply's entering, or its own
    leaving; from leaving to its next sibling's entering, or its parent's leaving. Pointer doubling along the walk sums
    the messages that are still to be entered.
    """
    first = links.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = links.select("conv_id", "turn", F.col("reply_to").alias("parent")).join(_next_reply(links), ["conv_id", "turn"])
    nodes = written(nodes.join(first, ["conv_id", "turn"], "full"), "chat-nodes")
    enter = F.when(F.col("child").isNotNull(), F.struct(F.col("child").alias("turn"), F.lit(False).alias("leaving"))).otherwise(F.struct("turn", F.lit(True).alias("leaving")))
    leave = F.when(F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("turn"), F.lit(False).alias("leaving"))).when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("turn"), F.lit(True).alias("leaving")))
    steps = F.array(F.struct(F.lit(False).alias("leaving"), enter.alias("to"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(True).alias("leaving"), leave.alias("to"), F.lit(0).cast("long").alias("n")))
    state = written(nodes.select("conv_id", "turn", F.explode(steps).alias("s")).select("conv_id", "turn", "s.*"), "chat-walk")
    while True:
        there = state.select(F.col("conv_id").alias("_conv"), F.struct("turn", "leaving").alias("_at"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        x = state.join(there, (F.col("conv_id") == F.col("_conv")) & (F.col("to") == F.col("_at")), "left")
        new = written(x.select("conv_id", "turn", "leaving", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "chat-walk", F.col("to").isNotNull())
        freed(state)
        state = new
        if not new.counted:
            return new.filter("not leaving").select("conv_id", "turn", F.col("n").alias("to_end"))


def conversations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, text (without quotes), formatted, n_quotes, quote_depth, n_linked, reply_to,
    thread_root, reply_depth, position."""
    x = written(parsed(messages.select("conv_id", "turn", "role", "text")), "chat-parsed")
    links = written(replies(x), "chat-links")
    tree = links.join(threads(links), ["conv_id", "turn"])
    place = written(positions(links), "chat-positions")
    # A thread's root is entered first: what comes before a message is what the root has to the end, less what it has itself.
    tree = written(tree.join(place, ["conv_id", "turn"]).join(place.select("conv_id", F.col("turn").alias("thread_root"), F.col("to_end").alias("all")), ["conv_id", "thread_root"]), "chat-tree")
    y = x.join(tree, ["conv_id", "turn"], "left")
    quotes = F.filter("passages", lambda p: p["level"] > 0)
    zero = F.lit(0).cast("long")
    return y.select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"), F.lit("<|end|>\n")).alias("formatted"),
        F.size(quotes).cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("quote_depth"),
        F.coalesce("n_linked", zero).alias("n_linked"), "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("reply_depth", zero).alias("reply_depth"),
        F.coalesce(F.col("all") - F.col("to_end"), zero).alias("position"),
    )
