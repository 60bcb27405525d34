"""Line-first cleaning and document quality rules, in DataFrame functions only.

Each line of a document is judged by itself: punctuation, navigation and boilerplate
rules. Lines that fail are removed, and a document that loses too much of its text
that way is rejected, as is one with few words or with mostly repeated passages.

Everything is computed inside a row with array functions: no shuffle, no join, and a
document of any length is one row's work in n log n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of this module.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
CLOSERS = "\"'”’»)]}* \t\r"
TERMINALS = ".!?…:;。！？．"
SENTENCE = r"[.!?…。！？][\"'”’»)\]]* +[^ ]"
MARKS = r"[#*$%&|<>!~=_^+]{2,}|[|»›·•]"
ANY_MARK = r"[#*$%&|<>!~=_^+»›·•]"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|copyright (?:\(c\)|©|[0-9])|cookies? (?:policy|settings)|we use cookies|accept (?:all )?cookies|"
    r"privacy policy|terms of (?:use|service)|terms (?:and|&) conditions|enable javascript|requires javascript|"
    r"subscribe to our|sign up for our|share this (?:on|via)|follow us on|powered by|click here to|"
    r"skip to (?:main )?content|back to top|read more|todos los derechos reservados|tous droits réservés|"
    r"alle rechte vorbehalten|lorem ipsum)\b"
)
# In lower case, something of every match of the above: texts without any have no boilerplate.
STEMS = (
    "rights reserved", "copyright", "cookie", "privacy policy", "terms ", "javascript", "subscribe to our", "sign up for our", "share this", "follow us on",
    "powered by", "click here to", "skip to", "back to top", "read more", "todos los derechos reservados", "tous droits r", "alle rechte vorbehalten", "lorem ipsum",
)
NAVIGATION = r"(?i)^(?:home|menu|search|log ?in|sign in|sign up|register|next|previous|contact(?: us)?|about(?: us)?|faq|help|sitemap)(?: *[|>»›·•/-].*)?$"

MENU_WORDS = 13  # of a navigation entry, at most


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t\\n\\v\\f\\r; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _spaces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))


def _twice(pairs: Column) -> Column:
    """Positions ``i`` of those sorted structs (x, i) whose x occurs twice or more."""
    equal = F.filter(pairs, lambda p, k: (p["x"] == F.get(pairs, k - 1)["x"]) | (p["x"] == F.get(pairs, k + 1)["x"]))
    return F.transform(equal, lambda p: p["i"])


def may_hold_boilerplate(text: Column) -> Column:
    """False only where no line of a text can be boilerplate: a plain search, much cheaper
    than the pattern."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in STEMS])


def line_passes(line: Column, boilerplate: Column | None = None, menu_words: int = MENU_WORDS) -> Column:
    """Whether a line stays: it is blank, or it ends as a sentence does (but for
    closing signs) or has one that ends before another, isn't mostly symbols or separators as in a menu, and is neither
    a lone navigation entry nor boilerplate. A navigation entry has at most ``menu_words``
    words: what starts like one and goes on for longer is a sentence. ``boilerplate``, if
    given, is false where the line is known not to be any."""
    end = F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1))
    gaps = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    punctuated = ((end != "") & (F.instr(F.lit(TERMINALS), end) > 0)) | line.rlike(SENTENCE)
    # One look at each character before the alternatives.
    marked = F.regexp_count(line, F.lit(f"(?={ANY_MARK})(?:{MARKS})")) * 4 > gaps + 1
    unsure = F.lit(True) if boilerplate is None else boilerplate
    navigation = (gaps < menu_words) & F.trim(line).rlike(NAVIGATION)
    return ~line.rlike(NOT_SPACE) | (punctuated & ~marked & ~navigation & ~(unsure & line.rlike(BOILERPLATE)))


def quality_rules(
    docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_lost: float = 0.5, menu_words: int = MENU_WORDS
) -> DataFrame:
    """``docs`` with the measures and verdicts of the rules added.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, n_lines, n_lines_kept (long), clean_text (the lines that stay, in
    order), lost (share of word characters in the removed lines), kept.

    A line that starts like a navigation entry is one up to ``menu_words`` words.

    A null or empty text has no words: it fails, with lost 0 and an empty clean_text.
    Rows are independent, so repeated rows and ids give repeated results; an empty
    table gives an empty one. Columns of ``docs`` stay, but for those named as an added
    one, which are replaced.
    """
    added = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines n_lines_kept clean_text lost kept".split()
    own = [c for c in docs.columns if c not in added]
    carried = F.struct(*own).alias("_row")
    whole = F.coalesce(docs[text], F.lit(""))
    # Each step that is used inside a later array function is a column of its own, for
    # it to be computed once a row.
    d = docs.select(carried, whole.alias("_t"), words_of(docs[text]).alias("_w"), F.split(whole, "\n").alias("_lines"), may_hold_boilerplate(whole).alias("_unsure"))
    d = d.select(
        "*",
        F.when(
            F.size("_w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
        F.filter("_lines", lambda x: x.rlike(NOT_SPACE)).alias("_full"),
        F.filter("_lines", lambda x: line_passes(x, F.col("_unsure"), menu_words)).alias("_stay"),
    )
    # Equal hashes only nominate windows; the windows themselves decide.
    d = d.select(
        "_row", "_t", "_w", "_lines", "_full", "_stay",
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.array().cast("array<struct<x:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
        .alias("_s"),
    )
    d = d.select("*", _twice(F.col("_s")).alias("_p")).drop("_s")
    d = d.select(
        "*",
        F.sort_array(
            F.transform(
                "_p",
                lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("x"), i.alias("i")),
            )
        ).alias("_g"),
    ).drop("_p")
    d = d.select("*", _twice(F.col("_g")).alias("_q"), F.array_join("_stay", "\n").alias("clean_text")).drop("_g")
    d = d.select(
        "_row",
        "clean_text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_q", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_stay").cast("long").alias("n_lines_kept"),
        (F.length("clean_text") - _spaces(F.col("clean_text"))).alias("_left"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.when(F.col("word_chars") == 0, 0.0).otherwise(F.lit(1.0) - F.try_divide(F.col("_left"), F.col("word_chars")))
    d = d.withColumn("base_failed", failed).withColumn("lost", lost)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    # A filter on the verdicts would be moved below the steps above, and each of its
    # columns be computed anew there for each use; it isn't moved below a generator.
    d = d.select("_row", F.inline(F.array(F.struct(*added))))
    return d.select(*[F.col("_row")[c].alias(c) for c in own], *added)
