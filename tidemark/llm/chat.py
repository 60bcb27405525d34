"""Chat formatting by quotation linking, in DataFrame functions only.

Messages quote others in lines that begin with one or more ">". Quoted passages are
normalised and hashed, and joined to what messages of the same conversation said
before: a message answers the one whose words it quotes, or the one before it. Quotes
are taken out, and the messages put in the order of replies: each follows what it
answers, the first answer's thread before the second's.

Conversations may be of any length. Whatever looks back in one does so in blocks of
turns, with a value carried from block to block, so no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.operators.rows import with_index

# Quote marks, lines that announce a quote, and the frame of a message.
MARK = r"^(?:[ \t]*>)+"
QUOTED = r"(?m)^[ \t]*>"
ANNOUNCED = r"(?i)^\s*(?:on .+ wrote|le .+ a écrit|am .+ schrieb.*|el .+ escribió|-+ ?original message ?-+)\s*:?\s*$"
START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 4096


def normalised(text: Column) -> Column:
    """Letters and digits in lower case, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def latest(rows: DataFrame, keys: list[str], value: Column, name: str, before: bool, block: int = BLOCK) -> DataFrame:
    """``rows`` with the largest ``value`` among rows of equal ``keys`` and lower turn (or
    also of equal turn, unless ``before``). Turns are cut into blocks; each block looks
    into itself, and gets the largest value of the blocks before it."""
    d = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col("turn") / block))
    inside = Window.partitionBy(*keys, "_b").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    blocks = d.groupBy(*keys, "_b").agg(F.max("_v").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_b", F.max("_m").over(earlier).alias("_c")).where("_c is not null")
    d = d.withColumn("_i", F.max("_v").over(inside)).join(blocks, [*keys, "_b"], "left")
    return d.withColumn(name, F.greatest("_i", "_c")).drop("_v", "_b", "_i", "_c")


def spread(rows: DataFrame, facts: DataFrame, keys: list[str], how: str, at: str = "turn", block: int = BLOCK) -> DataFrame:
    """``rows`` joined with ``facts``, of which there is one a key: first the blocks of
    ``rows`` are, then the rows of each block, so that no task holds all rows of a key."""
    d = rows.withColumn("_b", F.floor(F.col(at) / block))
    near = d.select(*keys, "_b").distinct().join(facts, keys)
    return d.join(near, [*keys, "_b"], how).drop("_b")


def links(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, reply_to) of messages whose quotes are words of an earlier message
    of the conversation: the one with most characters quoted at the outermost level that
    links to any; of equals, the latest. Passages, their paragraphs and their lines are
    looked up among whole messages, their paragraphs, their parts between quotes and
    their lines, so what was folded anew in quoting is found, too."""
    quoting = messages.where(F.col("text").rlike(QUOTED))
    lines = quoting.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARK, 0), "[^>]", ""))
    lines = lines.withColumn("level", level).where("level > 0").withColumn("line", F.regexp_replace("line", MARK, ""))

    def together(some: DataFrame) -> DataFrame:
        # Lines of one level that follow each other; a message's lines only.
        run = F.col("at") - F.row_number().over(Window.partitionBy("conv_id", "turn", "level").orderBy("at"))
        runs = some.withColumn("run", run).groupBy("conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
        return runs.select("conv_id", "turn", "level", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("unit"))

    units = together(lines).union(together(lines.where(normalised(F.col("line")) != ""))).union(lines.select("conv_id", "turn", "level", "line"))
    asked = units.select("conv_id", "turn", "level", normalised(F.col("unit")).alias("unit")).where("unit <> ''")
    asked = asked.groupBy("conv_id", "turn", "level", F.xxhash64("unit").alias("hash")).agg(F.max(F.length("unit")).alias("chars"))
    told = spread(messages, quoting.select("conv_id").distinct(), ["conv_id"], "left_semi", block=block)
    # Quotes are as good as empty lines between paragraphs.
    own = F.transform(F.split("text", "\n"), lambda x: F.when(~x.rlike(MARK) & ~x.rlike(ANNOUNCED), x).otherwise(""))
    told = told.select("conv_id", "turn", body(F.col("text")).alias("body"), F.split(F.array_join(own, "\n"), r"\n\s*\n").alias("parts"))
    told = told.select("conv_id", "turn", F.explode(F.concat(F.split("body", "\n"), "parts", F.array("body"))).alias("unit"))
    told = told.select("conv_id", "turn", normalised(F.col("unit")).alias("unit")).where("unit <> ''")
    told = told.select("conv_id", "turn", F.xxhash64("unit").alias("hash")).distinct()
    none = F.lit(None)
    both = asked.withColumn("told", none.cast("long")).unionByName(told.withColumns({"level": none.cast("int"), "chars": none.cast("int"), "told": F.col("turn")}))
    found = latest(both, ["conv_id", "hash"], F.col("told"), "reply_to", before=True, block=block).where("level is not null and reply_to is not null")
    scored = found.groupBy("conv_id", "turn", "level", "reply_to").agg(F.sum("chars").alias("chars"))
    best = F.max_by("reply_to", F.struct(-F.col("level"), "chars", "reply_to"))
    return scored.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def body(text: Column) -> Column:
    """A message without quoted lines and the lines that announce them."""
    lines = F.split(text, "\n")
    own = F.filter(lines, lambda x: ~x.rlike(MARK) & ~x.rlike(ANNOUNCED))
    return F.when(text.rlike(QUOTED), F.trim(F.array_join(own, "\n"))).otherwise(text)


def reply_order(messages: DataFrame, block: int = BLOCK, most_rounds: int = 60) -> DataFrame:
    """(conv_id, turn, reply_to, place) of all turns: what each turn answers, and a number by
    which, and then by turn, the turns of a conversation are in the order of replies.

    The first answer to a turn goes on with its thread, others begin one of their own.
    Turns that just go on from the one before form runs, and only runs, of which there
    are few, are put in order: their places come from a walk around the tree of runs,
    in which each run is entered and left, by pointers that double in each round. Depth
    and breadth of the tree cost rounds by their logarithm only.
    """
    turns = messages.select("conv_id", "turn").distinct()
    turns = latest(turns, ["conv_id"], F.col("turn"), "previous", before=True, block=block)
    turns = turns.join(links(messages, block), ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("reply_to", "previous"))
    firsts = turns.where("reply_to is not null").groupBy("conv_id", "reply_to").agg(F.min("turn").alias("turn"))
    turns = turns.join(firsts.select("conv_id", "turn", F.lit(True).alias("_first")), ["conv_id", "turn"], "left")
    simple = F.coalesce(F.col("_first"), F.lit(False)) & (F.col("reply_to") == F.col("previous"))
    turns = latest(turns, ["conv_id"], F.when(~simple, F.col("turn")), "run", before=False, block=block)
    turns = written(turns.select("conv_id", "turn", "reply_to", "run"), "turns")
    answers = turns.where("turn = run and reply_to is not null").select("conv_id", "run", "reply_to")
    into = turns.select("conv_id", F.col("turn").alias("reply_to"), F.col("run").alias("parent"))
    # Runs after the one that they leave, those first that leave it last.
    tree = written(spread(answers, into, ["conv_id", "reply_to"], "inner", "run", block).withColumn("_back", -F.col("reply_to")), "tree")
    if not tree.limit(1).count():
        return turns.select("conv_id", "turn", "reply_to", F.lit(0).cast("long").alias("place"))
    tree = written(with_index(tree, "conv_id", "parent", "_back", "run", name="i").select("conv_id", "run", "parent", "i"), "tree")
    own = tree.groupBy("conv_id", "parent").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    own = written(own.join(tree.select("conv_id", F.col("run").alias("parent"), F.col("i").alias("up")), ["conv_id", "parent"], "left"), "children")
    # What comes before a run is entered (2 i) and before it is left (2 i + 1).
    walk = tree.select("i").join(own.select(F.col("first").alias("i"), "up", F.lit(True).alias("_first")), "i", "left")
    walk = walk.join(own.where("up is not null").select(F.col("up").alias("i"), "last"), "i", "left")
    enter = F.struct((2 * F.col("i")).alias("at"), F.when(F.col("_first"), 2 * F.col("up")).otherwise(2 * F.col("i") - 1).alias("before"), F.lit(1).cast("long").alias("n"))
    leave = F.struct((2 * F.col("i") + 1).alias("at"), F.coalesce(2 * F.col("last") + 1, 2 * F.col("i")).alias("before"), F.lit(0).cast("long").alias("n"))
    walk = written(walk.select(F.inline(F.array(enter, leave))), "walk")
    for _ in range(most_rounds):
        open_ends = walk.where("before is not null")
        if not open_ends.limit(1).count():
            break
        ahead = walk.select(F.col("at").alias("before"), F.col("before").alias("_before"), F.col("n").alias("_n"))
        further = open_ends.join(ahead, "before").select("at", F.col("_before").alias("before"), (F.col("n") + F.col("_n")).alias("n"))
        walk = written(further.union(walk.where("before is null")), "walk")
    else:
        raise RuntimeError("a walk has no beginning")
    places = tree.join(walk.where("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("i"), F.col("n").alias("place")), "i").select("conv_id", "run", "place")
    placed = spread(turns, places, ["conv_id", "run"], "left", block=block)
    return placed.select("conv_id", "turn", "reply_to", F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def chat_format(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per message (conv_id, turn, role, text; turns are whole numbers): conv_id,
    turn, role, reply_to (the turn it answers, null for the first), place (sort by it and
    turn for the order of replies), quote_levels (of the deepest quote), body (the text
    without quotes), formatted (role and body in the frame of a chat template, in which
    the frame's own signs are taken apart).

    A null text is an empty one and a null role is "user". Rows without conv_id or turn
    stand alone: reply_to and place are null. Rows that repeat a turn are kept, with
    equal places. A quote of nothing that was said before has no link, and a turn never
    answers a later one. Quotes and threads may be nested to any depth. Further columns
    are ignored, and an empty table gives an empty one.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = m.where("conv_id is not null and turn is not null")
    alone = m.where("conv_id is null or turn is null").withColumns({"reply_to": F.lit(None).cast("long"), "place": F.lit(None).cast("long")})
    d = placed.join(reply_order(placed, block), ["conv_id", "turn"], "left").unionByName(alone)
    marks = F.transform(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")))
    levels = F.when(F.col("text").rlike(QUOTED), F.array_max(marks)).otherwise(0)
    safe = F.replace("body", F.lit("<|"), F.lit("< |"))
    return (
        d.withColumn("quote_levels", levels.cast("int"))
        .withColumn("body", body(F.col("text")))
        .withColumn("formatted", F.concat(F.lit(START), F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("\n"), safe, F.lit(END)))
        .select("conv_id", "turn", "role", "reply_to", "place", "quote_levels", "body", "formatted")
    )
