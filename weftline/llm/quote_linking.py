"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` that it starts with (spaces between them don't count); a
passage is a run of lines of one level, ended by another level or an empty line. Lines and passages
are normalised (marks off, white space collapsed, lower case) and hashed. What a message quotes at
level 1 is looked up among the own (level 0) lines and passages of earlier messages of its
conversation, what it quotes at level n among their lines of level n - 1; the message answers the one
that its outermost quotes lead to, on ties the one that most of these do, then the latest. Replies stand
below what they answer, in the order of their turns, and the text of a message that answers one is its own lines without
quotes and without the lines that announce one: an own line right above a quote that ends in a colon, in whatever language.
Where quotes lead nowhere, they may be anything (code, a prompt): the text stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Quoted lines of fewer words link only as part of their passage.
LEAST_WORDS = 3
#: Turns that a running sum takes together before the sums of such groups are added up.
TURNS = 10_000
MAX_ROUNDS = 64
#: A line that announces the quote right below it.
ANNOUNCED = r"(?m)^[^\n>]*:[ \t]*\n(?=\s*>)"
_MARKS = r"^(\s*>)+\s?"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"\s", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(text: Column) -> Column:
    """A text's lines without quotes and their announcements; blank lines at its ends and repeated blank lines go if it had quotes."""
    bare = F.regexp_replace(text, ANNOUNCED, "")
    own = F.array_join(F.filter(F.split(bare, "\n"), lambda x: level(x) == 0), "\n")
    tidy = F.regexp_replace(F.regexp_replace(own, r"\n\s*\n(\s*\n)+", "\n\n"), r"^\s+|\s+$", "")
    return F.when(text.rlike(r"(?m)^\s*>"), tidy).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, unit, words, whole``: hashes of all lines and passages; several lines make a whole passage."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    lines = lines.select("conv_id", "turn", "no", level(F.col("raw")).alias("level"), normal(F.regexp_replace("raw", _MARKS, "")).alias("line"))
    # passages of one line are lines: only messages with a quote or a run of lines need the walk over lines
    order = Window.partitionBy("conv_id", "turn").orderBy("no")
    new = (F.lag("level").over(order) != F.col("level")) | (F.lag("line").over(order) == "")
    runs = lines.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order)).where("line != ''")
    whole = runs.groupBy("conv_id", "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("lines"))
    whole = whole.select("conv_id", "turn", "run", "level", F.array_join(F.col("lines.line"), " ").alias("line"), F.lit(True).alias("whole"))
    both = whole.unionByName(runs.select("conv_id", "turn", "run", "level", "line", F.lit(False).alias("whole")))
    return both.select("conv_id", "turn", "run", "level", F.xxhash64("line").alias("unit"), F.md5("line").alias("check"), F.size(F.split("line", " ")).alias("words"), "whole")


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, passages``: the turn that each quoting message answers."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^\s*>")).select("conv_id").distinct()
    # conversations without a quote have no links
    units = stored(passages(messages.join(quoting, "conv_id", "left_semi")), "passages")
    said = units.groupBy("conv_id", "unit", "check", F.col("level").alias("depth"), "turn").agg(F.lit(0).alias("kind"), F.lit(-1).alias("run"), F.lit(-1).alias("level"))
    asked = units.where("level > 0").where(F.col("whole") | (F.col("words") >= LEAST_WORDS)).select("conv_id", "unit", "check", (F.col("level") - 1).alias("depth"), "turn", F.lit(1).alias("kind"), "run", "level").distinct()
    # the latest turn before the quoting one that said it, without pairing all sayings with all quotes
    before = Window.partitionBy("conv_id", "unit", "check", "depth").orderBy("turn", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = said.unionByName(asked.select(*said.columns))
    found = both.withColumn("source", F.last(F.when(F.col("kind") == 0, F.col("turn")), ignorenulls=True).over(before)).where("kind = 1 and source is not null and source < turn")
    # outer quotes count first: a quote of a quote also stands in the message that is answered
    per = found.groupBy("conv_id", "turn", "source").agg(F.min("level").alias("level"), F.countDistinct("run").alias("passages"))
    best = per.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "passages", "source")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.source").alias("reply_to"), F.col("best.passages").alias("passages"))


def _before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier turns of the same keys, by blocks of turns."""
    rows = rows.withColumn("_block", F.floor(F.col("turn") / F.lit(TURNS)))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    sums = sums.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnRenamed("_block", "_b")
    inside = Window.partitionBy(*keys, "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(sums, same)
    return out.withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_block", "_b", "_inside", "_earlier", *(f"_k{i}" for i in range(len(keys))))


def reply_order(nodes: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, depth, position`` of distinct ``conv_id, turn, reply_to``, replies below what they answer.

    Sizes of subtrees, then depths and positions, by pointer doubling: as many rounds as the depth's logarithm.
    """
    tree = nodes.where("reply_to is not null").select("conv_id", "turn")
    if tree.isEmpty():  # nothing is answered: the order of turns
        out = _before(nodes.withColumn("_one", F.lit(1)), ["conv_id"], "_one")
        return out.select("conv_id", "turn", "reply_to", F.lit(0).cast("long").alias("depth"), F.col("before").alias("position"))
    state = stored(nodes.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("size")), "tree")
    for _ in range(MAX_ROUNDS):
        below = state.where("up is not null")
        if below.isEmpty():
            break
        add = below.groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more"))
        jump = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        state = state.join(jump, ["conv_id", "up"], "left").join(add, ["conv_id", "turn"], "left")
        state = stored(state.select("conv_id", "turn", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "tree")
    sized = nodes.join(state.select("conv_id", "turn", "size"), ["conv_id", "turn"])
    placed = _before(sized, ["conv_id", "reply_to"], "size")
    step = F.col("before") + F.col("reply_to").isNotNull().cast("long")
    state = stored(placed.select("conv_id", "turn", F.col("reply_to").alias("up"), step.alias("position"), F.col("reply_to").isNotNull().cast("long").alias("depth")), "places")
    for _ in range(MAX_ROUNDS):
        if state.where("up is not null").isEmpty():
            break
        jump = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("position").alias("p"), F.col("depth").alias("d"))
        state = state.join(jump, ["conv_id", "up"], "left")
        state = stored(state.select("conv_id", "turn", F.col("next").alias("up"), (F.col("position") + F.coalesce("p", F.lit(0))).alias("position"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")), "places")
    return nodes.join(state.drop("up"), ["conv_id", "turn"]).select("conv_id", "turn", "reply_to", "depth", "position")


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, text, reply_to, depth, n_quoted``, a row for each row of ``messages``.

    Ordered by position, a conversation's replies follow what they answer; the text of an answer has no quotes, and
    n_quoted counts the quoted passages that led to the answered turn. ``messages`` needs conv_id, turn, role and text; other
    columns are ignored. A message without quotes, or whose quotes lead nowhere, answers none
    (reply_to null, depth 0) and keeps its text as it is; a null text stays null. Rows that repeat conv_id and turn are one
    message with several texts: they share a position. Where conv_id or turn is null, there
    is no order: reply_to and position are null. An empty table gives no rows.
    """
    messages = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    known = messages.where("conv_id is not null and turn is not null")
    found = stored(links(known.where("text is not null")), "replies")
    nodes = stored(known.select("conv_id", "turn").distinct().join(found, ["conv_id", "turn"], "left"), "nodes")
    order = reply_order(nodes.select("conv_id", "turn", "reply_to"))
    order = order.join(nodes.select("conv_id", "turn", "passages"), ["conv_id", "turn"])
    out = messages.join(order, ["conv_id", "turn"], "left")
    return out.select("conv_id", "position", "turn", "role", F.when(F.col("reply_to").isNotNull(), own_text(F.col("text"))).otherwise(F.col("text")).alias("text"), "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("passages", F.lit(0)).cast("long").alias("n_quoted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all messages without their quotes, in reply order."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op8_quotation_linking": query}
