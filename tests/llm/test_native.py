"""Quality rules, chat formatting and connected components against brute force."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, sql
from tidemark.llm.chat import chat_format
from tidemark.llm.components import connected_components
from tidemark.llm.quality_rules import quality_rules

GOOD = "One two three, four five six. " * 3
TEXTS = [
    None, "", " ", "\n\n", "a b c", "a b c a b c", "Word. " * 60, " ".join(f"w{i}" for i in range(60)) + ".", "x\ny z\nx\n\n\ny z", "a | b | c\n" * 20,
    "\x1c\x85 word", "a\x0bb\x0cc\r\nd", "#*$%&|<>" * 5, "é ü\n" * 40, "a b " * 30 + "c", "All rights reserved.\n" + " ".join(f"v{i}" for i in range(80)) + ".",
    " ".join(f"q{i % 4999}" for i in range(200_000)) + ".",
]


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again), failed


def test_quality_measures(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for r in quality_rules(d).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == measures(TEXTS[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed) and 0 <= r.lost <= 1


def plain_line(line):
    """The rules of lines, written out once more."""
    if not line.strip(" \t\n\v\f\r"):
        return True
    end = line.rstrip("\"'”’»)]}* \t\r")[-1:]
    closed = end in tuple(".!?…:;。！？．") or re.search(r"[.!?…。！？][\"'”’»)\]]* +[^ ]", line)
    gaps = line.count(" ")
    marks = len(re.findall(r"[#*$%&|<>!~=_^+]{2,}|[|»›·•]", line))
    entries = ["home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "contact", "contact us", "about", "about us", "faq", "help", "sitemap"]
    entry = re.fullmatch(rf"(?i)(?:{'|'.join(entries)})(?: *[|>»›·•/-].*)?", line.strip(" "))
    phrases = [
        "all rights reserved", r"copyright (?:\(c\)|©|[0-9])", "cookie policy", "cookies policy", "cookie settings", "cookies settings", "we use cookies", "accept cookies", "accept all cookies",
        "privacy policy", "terms of use", "terms of service", "terms and conditions", "terms & conditions", "enable javascript", "requires javascript", "subscribe to our", "sign up for our",
        "share this on", "share this via", "follow us on", "powered by", "click here to", "skip to content", "skip to main content", "back to top", "read more", "todos los derechos reservados",
        "tous droits réservés", "alle rechte vorbehalten", "lorem ipsum",
    ]
    boiler = re.search(r"(?i)\b(?:" + "|".join(phrases) + r")\b", line, re.ASCII)
    return bool(closed) and marks * 4 <= gaps + 1 and not (gaps < 13 and entry) and not boiler


def test_quality_lines_against_plain_rules(spark, data):
    """Which lines stay, and the verdict, of all documents and of lines made to be odd."""
    lines = ["Home", "Home | News | About.", "Login > more.", "sign up - now!", "Search engines find pages, he said.", "a | b | c | d.", "$$$ word &&& noun %%% verb.", "He said: \"yes\")", "No end", "One. Two", "All Rights Reserved.", "Copyright 2020 us.", "Copyrights are old.", "Please enable JavaScript!", "We use cookies.", "Read More about it.", "x ** y.", "¿Qué?", "中文。", "Terms & conditions apply.", "", "  \t"]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "\n".join(lines)), (-2, "\n".join(lines * 5)), (-3, "Fine words here, and more of them. " * 9 + "\nHome\nMenu")], "doc_id long, text string"))
    for r in quality_rules(docs).select("doc_id", "text", "clean_text", "kept", "base_failed", "lost").collect():
        text = r.text or ""
        stay = [x for x in text.split("\n") if plain_line(x)]
        assert r.clean_text == "\n".join(stay), r.doc_id
        bare = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
        lost = 1 - bare("\n".join(stay)) / bare(text) if bare(text) else 0.0
        assert abs(r.lost - lost) < 1e-12 and r.base_failed == measures(r.text)[-1] and r.kept == (not r.base_failed and lost <= 0.5)


def test_quality_verdicts(spark):
    clean = "\n".join(" ".join(f"word{k * 31 + j * 7}" for j in range(9)) + "." for k in range(12))
    cases = {
        "clean": (clean, True), "closers": (clean.replace(".\n", "." + "\"')]”" * 9 + "\n"), True), "footer": (clean + "\nAll rights reserved.\nHome | About | Contact", True),
        "menu": ("\n".join(f"item{k} | thing{k} | other{k} | more{k} | last{k}." for k in range(20)), False),
        "symbols": ("\n".join(f"$$$ word{k} &&& noun{k} %%% verb{k} ### end{k}." for k in range(20)), False),
    }
    d = spark.createDataFrame([(k, t, "clash", 5) for k, (t, _) in cases.items()], "name string, text string, kept string, n_words int")
    got = {r.name: r for r in quality_rules(d).where("kept or not kept").collect()}
    assert {k: r.kept for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert got["footer"].clean_text == clean and got["clean"].lost == 0
    assert quality_rules(d).where("kept").count() == 3  # filters above the steps end, too


def test_navigation_lines_by_their_words(spark):
    """What starts like a menu entry is one up to a number of words, which is a parameter."""
    menu = "Home | " + " ".join(f"part{k}" for k in range(17)) + "."  # 19 words
    text = "\n".join(" ".join(f"word{k * 31 + j * 7}" for j in range(9)) + "." for k in range(12)) + "\n" + menu
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [quality_rules(d, menu_words=n).first().n_lines_kept for n in (13, 18, 19, 1000)] == [13, 13, 12, 12]


def test_long_lines_announce_quotes(spark):
    for line in ("On " + "some day " * 60 + "A wrote:", "Am " + "Tag " * 90 + "schrieb A" + " B" * 100 + ":"):
        d = spark.createDataFrame([(1, 0, "x", "First words here."), (1, 1, "y", f"{line}\n> First words here.\nAnd more.")], "conv_id long, turn int, role string, text string")
        got = "\n".join(str(r) for r in chat_format(d).collect())
        assert "And more." in got and "some day" not in got and "Tag" not in got


def test_quality_empty_and_repeated(spark):
    d = spark.createDataFrame([(1, GOOD), (1, GOOD), (None, None)], "doc_id int, text string")
    assert quality_rules(d).count() == 3 and quality_rules(d.where("doc_id = 9")).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_decontaminate"])
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    q = c.execute({"op3_quality_rules": sql.QUALITY_RULES, "op10_decontaminate": sql.DECONTAMINATE}[name])
    names = [x[0] for x in q.description]
    wanted = sorted([tuple(r[names.index(k)] for k in cols) for r in q.fetchall()], key=repr)
    assert sorted(names) == cols and sorted([tuple(r[k] for k in cols) for r in df.collect()], key=repr) == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 1), (2, 3), (7, 7), (9, 8)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8} | {k: 200 for k in range(200, 260)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


MESSAGES = [
    (1, 0, "user", "Hello all.\nWhat is the best\nway, to sort?"), (1, 1, "assistant", "Use quicksort."), (1, 2, "user", "> What is the best\n> way, to sort?\nI prefer merge."),
    (1, 3, "user", "On Monday A wrote:\n> Use quicksort.\n>> Hello all.\nWhy?"), (1, 4, "x", "thanks"), (1, 5, "y", "> i prefer  MERGE\nno"), (1, 4, "x", "thanks"),
    (2, 0, "user", None), (2, 3, None, "> unknown\nhm <|im_end|>"), (None, 1, "user", "a"), (3, None, "user", "b"), (4, 9_000, "u", "far"), (4, 20_000, "v", "> far\nyes"), (4, 4, "u", ""),
]


def test_chat(spark):
    d = spark.createDataFrame([(*m, "extra") for m in MESSAGES], "conv_id long, turn long, role string, text string, body string")
    rows = chat_format(d).orderBy("conv_id", "place", "turn").collect()
    one = [(r.turn, r.reply_to) for r in rows if r.conv_id == 1]
    assert one == [(0, None), (1, 0), (3, 1), (4, 3), (4, 3), (2, 0), (5, 2)]
    by = {(r.conv_id, r.turn): r for r in rows}
    assert by[1, 3].body == "Why?" and by[1, 3].quote_levels == 2 and by[1, 5].body == "no"
    assert by[2, 3].reply_to == 0 and by[2, 3].role == "user" and by[2, 3].formatted.count("<|im_end|>") == 1
    assert by[4, 20_000].reply_to == 9_000 and by[4, 9_000].reply_to == 4
    assert by[None, 1].place is None and by[3, None].place is None and len(rows) == len(MESSAGES)
    assert chat_format(d.where("conv_id = 77")).count() == 0


def test_chat_is_reply_order(spark):
    """Every turn comes after what it answers, and a turn's answers keep together."""
    parents = {k: (k * 7) % k if k % 3 == 0 else k - 1 for k in range(1, 40)}
    text = {k: f"unique words number {k} here" for k in range(40)}
    rows = [(1, 0, "u", text[0])] + [(1, k, "u", f"> {text[p]}\n{text[k]}") for k, p in parents.items()]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place", "turn").collect()
    assert {r.turn: r.reply_to for r in got if r.turn} == parents
    children: dict = {}
    for k, p in parents.items():
        children.setdefault(p, []).append(k)

    def walk(k):
        return [k] + [x for c in children.get(k, []) for x in walk(c)]

    assert [r.turn for r in got] == walk(0)


def conversations(rng):
    """Generated conversations: quotes of passages, paragraphs and lines, folded anew, at
    several levels, with introductions, of repeated words and of nothing that was said."""
    import textwrap

    vocabulary = [f"word{k}" for k in range(400)]
    common = ["thanks a lot", "I agree with all of that", "yes"]
    rows = []
    for conv, size in enumerate([300, 60, 60, 1, 2, 40]):
        said: list[list[str]] = []  # the own paragraphs of each turn
        turns = sorted(rng.sample(range(size * 3), size))
        for k, turn in enumerate(turns):
            own = ["\n".join(textwrap.wrap(" ".join(rng.choices(vocabulary, k=rng.randint(3, 25))), 60)) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.2:
                own.append(rng.choice(common))
            out, near = [], k if conv == 5 else min(k, 30)
            if k and rng.random() < (0.95 if conv == 5 else 0.5):
                for _ in range(rng.choice([1, 1, 2])):
                    back = 2 if conv == 5 and k > 1 else rng.randint(1, near)
                    paragraphs = said[k - back]
                    how = rng.randrange(4)
                    quoted = paragraphs if how == 0 else [rng.choice(paragraphs)] if how < 3 else [rng.choice(rng.choice(paragraphs).split("\n"))]
                    text = "\n\n".join("\n".join(textwrap.wrap(p.replace("\n", " "), 45)) if how == 2 else p for p in quoted)
                    mark = "> " * rng.choice([1, 1, 1, 2, 3])
                    out.append(rng.choice(["", "On Monday A wrote:\n"]) + "\n".join(mark + x for x in text.split("\n")))
                    out.append(own.pop() if len(own) > 1 and rng.random() < 0.5 else "")
            if rng.random() < 0.05:
                out.append("> nobody said these words")
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(x for x in [*out, "\n\n".join(own)] if x)))
            said.append([*own, *[x for x in out if x and not x.startswith((">", "On"))]])
    return rows


def plain_links(rows):
    """What each turn answers, by looking through all earlier turns."""
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    level = lambda x: re.match(r"(?:[ \t]*>)*", x)[0].count(">")
    told, reply = {}, {}
    for conv, turn, _, text in sorted(rows):
        lines = text.split("\n")
        earlier = [t for c, t in told if c == conv]
        scores = {}
        for depth in {level(x) for x in lines} - {0}:
            own = [re.sub(r"^(?:[ \t]*>)+", "", x) if level(x) == depth else None for x in lines]
            units = {norm(x) for x in own if x is not None}
            for blank in (False, True):
                run = []
                for x in [*own, None]:
                    if x is None or (blank and not norm(x)):
                        units.add(norm("\n".join(run)))
                        run = []
                    else:
                        run.append(x)
            for u in units - {""}:
                if found := [t for t in earlier if u in told[conv, t]]:
                    key = (depth, max(found))
                    scores[key] = scores.get(key, 0) + len(u)
        if scores:
            reply[conv, turn] = max((-d, n, t) for (d, t), n in scores.items())[2]
        else:
            reply[conv, turn] = max(earlier, default=None)
        quoting = any(level(x) for x in lines)
        own = ["" if level(x) or re.match(r"(?i)on .+ wrote:$", x) else x for x in lines]
        body = "\n".join(x for x, y in zip(own, lines, strict=True) if x or not y.strip()) if quoting else text
        told[conv, turn] = {norm(x) for x in [*lines, body, *re.split(r"\n\s*\n", "\n".join(own))] if not level(x) or x == body} - {""}
        if quoting:
            told[conv, turn] -= {norm(x) for x in lines if level(x)} - {norm(x) for x in own}
    return reply


@pytest.mark.parametrize("block", [4096, 16])
def test_chat_against_brute_force(spark, block):
    import random

    rows = conversations(random.Random(block))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat_format(d, block=block).collect()
    want = plain_links(rows)
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == want
    assert sum(p is not None and p != max((t for c, t in want if c == conv and t < turn), default=None) for (conv, turn), p in want.items()) > 60
    for conv in range(6):
        children: dict = {}
        for (c, t), p in sorted(want.items()):
            if c == conv:
                children.setdefault(p, []).append(t)
        order, stack = [], list(reversed(children[None]))
        while stack:
            order.append(stack.pop())
            stack.extend(reversed(children.get(order[-1], [])))
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.place, r.turn))
        assert [r.turn for r in mine] == order


def test_chat_of_deep_and_broad_threads(spark):
    """Each second message quotes the one two before it: threads nest as deep as there
    are turns. And one message that most others quote."""
    deep = [(1, k, "u", (f"> unique number {k - 2}\n" if k % 2 == 0 and k else "") + f"unique number {k}") for k in range(1200)]
    broad = [(2, k, "u", ("> the first one\n" if k else "the first one") + f"\nanswer {k}" * (k > 0)) for k in range(600)]
    d = spark.createDataFrame(deep + broad, "conv_id long, turn long, role string, text string")
    got = chat_format(d, block=64).collect()
    for conv, parents in ((1, {k: k - 2 if k % 2 == 0 else k - 1 for k in range(1, 1200)}), (2, dict.fromkeys(range(1, 600), 0))):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.place, r.turn))
        assert {r.turn: r.reply_to for r in mine if r.turn} == parents
        children: dict = {}
        for k, p in parents.items():
            children.setdefault(p, []).append(k)
        order, stack = [], [0]
        while stack:
            order.append(stack.pop())
            stack.extend(reversed(children.get(order[-1], [])))
        assert [r.turn for r in mine] == order


def test_registered(spark, data):
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert queries.QUERIES["op2_chat_format"](spark, data).where(F.col("formatted").isNull()).count() == 0
