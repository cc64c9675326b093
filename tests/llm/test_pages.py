"""Page operators: extraction on pages with known articles, archives against what was put in."""

import gzip
import hashlib
import random

from pulsegrid.llm import warc
from pulsegrid.llm.html_paths import main_text, main_texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav></header><div class="cookie-notice">We use cookies, you know.</div>
<!-- ad --><div class="ad">Buy now, buy cheap, buy often, buy here!</div>{body}<aside>Other, things, to read.</aside>
<section id="comments"><p>What a fine article, I say, and I say it at length, as readers do, in many words, without an end.</p></section>
<form><label>Mail</label><input></form><footer>&copy; x &middot; y</footer>"""


def test_articles_without_what_is_around_them():
    inner = "<h1>A &amp; B</h1><p><b>First  one, of\nsome length, with marks.<br><p>Short.<div class='ad-slot'>Buy!</div><p>1 &lt; 2 &#233;"
    want = "A & B\nFirst one, of some length, with marks.\nShort.\n1 < 2 é"
    assert main_text(PAGE.format(body=f"<article>{inner}</article>")) == want
    assert main_text(PAGE.format(body=f"<div class='post'>{inner}</div>")) == want
    assert main_text(PAGE.format(body=f"<main><div><div>{inner}</div></div></main>")) == want


def test_no_selected_text_is_lost_without_an_article():
    lead, body = "A lead, of some words. " * 30, "A body, of more words. " * 350
    for inner in (f"<div class='lead'>{lead}</div><div class='body'>{body}</div>", f"<div class='body'>{body}</div><div class='end'>{lead}</div>"):
        got = main_text(f"<html><body><nav>Home</nav><div><h1>Title</h1>{inner}</div><footer>x</footer></body></html>")
        assert got.startswith("Title\n") and sorted(got.split("\n")[1:]) == sorted([lead.strip(), body.strip()])


def test_parts_of_an_article_are_not_dropped_for_a_name():
    """What path ratios tell apart: long prose under a class that pages also use for their frame, and a line of links under the same."""
    prose = "Earlier authors, as is known, found the same, in a larger set. " * 4
    for part in ('<div class="related-work"><p>{}</p></div>', '<section id="legal"><p>{}</p><p>{}</p></section>', '<div class="search-results">{}</div>'):
        inner = part.replace("{}", prose)
        got = main_text(PAGE.format(body=f"<article><h1>Title</h1><p>{prose}</p>{inner}<p>{prose}</p></article>"))
        assert got.split("\n") == ["Title", *[prose.strip()] * (2 + max(1, inner.count("<p>")))]
        links = part.replace("{}", "<a href='/x'>More</a>")
        assert main_text(PAGE.format(body=f"<article><p>{prose}</p>{links}<p>{prose}</p></article>")) == "\n".join([prose.strip()] * 2)


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "<p>", "<", "plain text", "a<b", "<script>x")] == ["", "", "", "<", "plain text", "a", ""]
    assert main_text("<div>" * 3000 + "deep, deep text") == "deep, deep text"
    assert len(main_text("<p>word, word " * 5000).split("\n")) == 5000


def test_pages_as_rows(spark):
    rows = [(1, "u", PAGE.format(body="<article><p>One.</p></article>"), 5), (1, None, None, 6), (None, "v", "", 7)]
    got = main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "", 0), (1, "One.", 4)]


def test_archives_give_back_every_payload(spark, folder):
    draw = random.Random(1)
    payloads = ["", "short", "short", "é" * 49 + "x", "WARC/1.1\r\n\r\n\r\n" * 20, "line\r\n" * 50, "\n" * 120, "x" * 100_000] + ["copy " * 40] * 9
    payloads += ["".join(draw.choices("ab\r\n\x00é", k=draw.randint(0, 300))) for _ in range(60)]
    rows = [(i, f"http://x/{i}\nbad", p) for i, p in enumerate(payloads)] + [(900, None, None), (901, "u", "copy " * 40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.roundtrip(pages, folder).collect()}
    first = {}
    for i, _, p in sorted(rows):
        raw = (p or "").encode()
        same = first.setdefault(raw, i)
        revisit = len(raw) >= 100 and same != i
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", same if revisit else None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert len(got) == len(rows)
    index = spark.read.parquet(f"{folder}/records/index").collect()
    for row in random.Random(2).sample(index, 10):
        with open(f"{folder}/records/members/{row.archive}", "rb") as file:
            file.seek(row.offset)
            assert row.record_id.encode() in gzip.decompress(file.read(row.length))


def test_no_pages_and_repeated_ids(spark, folder):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.roundtrip(none, f"{folder}/none").count() == 0
    rows = [(1, "u", "p" * 200), (1, "u", "p" * 200), (None, "u", "p" * 200)]
    got = warc.roundtrip(spark.createDataFrame(rows, none.schema), f"{folder}/same").collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_archives_of_text_ids(spark, folder):
    rows = [("b", "u", "copy " * 40), ("a", "u", "copy " * 40), ("c", "u", None)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.roundtrip(spark.createDataFrame(rows, "page_id string, url string, html string"), folder).collect()}
    assert got == {"a": ("response", None), "b": ("revisit", "a"), "c": ("response", None)}
