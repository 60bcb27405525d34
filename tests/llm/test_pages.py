"""Pages of many layouts, with the texts of their articles written by hand."""

from __future__ import annotations

import time

import pytest

from tidemark.llm import html_text as H

A = "The river rose in the night, and by the morning, when the first carts came down, the lower road was under water."
B = "Nobody had seen it so high since the old bridge went, they said, and some of them went up to look at the weir."
C = "In the afternoon, as the rain stopped, the miller counted his sacks, found two missing, and sent for the boatman."
LONG = "This is a long remark that goes on for a while, with commas, and with much to say of many things. " * 4

LAYOUTS = {
    "news": (
        f"<body><header><h1>The Daily</h1><nav><a href=/>Home</a> <a href=/x>World</a></nav></header><main><article class='story has-comments'><header><h1>Flood</h1><div class=byline>By A</div></header><p>{A}</p><p>{B}</p><div class='ad-slot-3'><p>{LONG}</p></div><p>{C}</p>"
        f"</article><section id=comments><h2>Comments</h2><article><p>{LONG}</p></article><article><p>{LONG}</p></article></section></main><footer>© 2020</footer></body>",
        ["Flood", A, B, C],
    ),
    "blog": (f"<body class='single comments-open'><div id=wrapper><div class='post hentry'><h2>Flood</h2><div class=entry-content><p>{A}</p><p>{B}</p><p>{C}</p></div></div><ol class='commentlist'><li><p>{LONG}</p></li><li><p>{LONG}</p></li></ol></div></body>", ["Flood", A, B, C]),
    "table": (f"<table width=100%><tr><td class=nav><a href=a>One</a><br><a href=b>Two</a></td><td><p>{A}<p>{B}<p>{C}</td></tr></table>", [A, B, C]),
    "divs": (f"<div class=page><div class=topbar><a href=x>Log in</a></div><div class=content><div>{A}</div><div>{B}</div><div>{C}</div></div><div class=sidebar><p>{LONG}</p></div></div>", [A, B, C]),
    "form around all": (f"<form action=/><div id=main><p>{A}</p><p>{B}</p><p>{C}</p></div><input name=q></form>", [A, B, C]),
    "docs": (
        f"<main><h1>Floods</h1><p>{A}</p><section id=side-effects><h2>Side effects</h2><p>{B}</p></section><section id=cookie-law><h2>Cookie Law</h2><p>{C}</p></section><div class='cookie-notice'><p>{LONG}</p></div></main>",
        ["Floods", A, "Side effects", B, "Cookie Law", C],
    ),
    "disqus": (f"<article><p>{A}</p><p>{B}</p><p>{C}</p><div id=disqus_thread><article><p>{LONG}</p></article></div><div class=related><p>{LONG}</p></div></article>", [A, B, C]),
    "answers": (f"<div class=question><p>{A}</p><p>{B}</p><p>{C}</p></div><ol class=thread><li>{LONG}</li><li>{LONG}</li></ol>", [A, B, C]),
    "notices": (f"<div class='site-notice'><p>{LONG}</p></div><article><div class=notice><p>{LONG}</p></div><p>{A}</p><div class='userComments'><p>{LONG}</p></div><p>{B}</p><aside><p>{LONG}</p></aside><p>{C}</p></article>", [A, B, C]),
    "references": (f"<article><p>{A[:-1]} &amp;\n\t caf&eacute;.</p><pre>x &lt; y</pre><script>if (a < b) {{ '</p>' }}</script><style>p {{}}</style><p>{B}</p></article>", [A[:-1] + " & café.", "x < y", B]),
    "one wrapper named so": (f"<body><div class='no-ads'><p>{A}</p><p>{B}</p><p>{C}</p></div></body>", [A, B, C]),
    "all in a wrapper of ads": (f"<body><div class='ads'><p>{A}</p><p>{B}</p><p>{C}</p></div></body>", [A, B, C]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert H.main_text(page).split("\n") == want


def test_names_that_are_certain():
    for name in ("comments", "user-comments-list", "ad-slot-12", "site-notice", "notice", "advert", "x disqus", "cookieNotice", "sponsor_box", "b-ads__item"):
        assert H.certain(name), name
    for name in ("no-comments", "has-ads", "adopt", "download", "comment-free" * 0, "commentary", "noticeboard", "headline", "side-effects", "shadow"):
        assert not H.certain(name), name


@pytest.mark.parametrize("part", ["<a", "x<", "<a '\"", "<p>", "<a b=c ", "<!--", "<div class=", "text without tags, ", "<b>", "</p>", "&amp", "<li>"])
def test_time_grows_with_the_page_only(part):
    H.main_text(part * 100)
    start = time.process_time()
    H.main_text(part * (200_000 // len(part)))
    assert time.process_time() - start < 8


def test_very_long_names_and_pages(spark):
    start = time.process_time()
    assert H.main_text("x<" + "a" * 200_000) in ("x", "")
    assert time.process_time() - start < 2
    long = "word, " * 500_000
    d = spark.createDataFrame([(1, "u", long, 1), (2, None, None, 2), (None, "v", "<p>" + long, 3), (3, "w", "", 4)], "page_id long, url string, html string, n int")
    got = {r.url: r for r in H.extract_text(d).collect()}
    assert got["u"].text == long.strip() and got["v"].n_chars == len(long) - 1 and got[None].text == got["w"].text == ""
