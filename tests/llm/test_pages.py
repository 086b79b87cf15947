"""Main text of pages, and WARC round trips."""

import base64
import gzip
import hashlib
import json
import math
import random
import statistics
import time
import zlib

import pytest

from sourcemark.llm import html_extract, warc
from sourcemark.llm.html_extract import extract_main_text, main_blocks

LONG = "A paragraph with a fair amount of plain text, as the body of an article has, and then some more of it."
DIVS = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1><ul class="menu"><li>Home</li></ul></header>
<div id="cookie-notice">{LONG}</div>
<div class="wrap"><div class="post"><h1>Title</h1><p>{LONG}</p><p>Short.</p><div class="advert">Buy {LONG}</div>
<p>Second &amp; <b>bold</b>&nbsp;text &lt;b&gt;<br>next</p><ul><li>one<li>two</ul><script>var a = "<p>no</p>"</script></div>
<div class="sidebar"><p>Popular</p></div><div id="comments"><p>{LONG}</p></div></div>
<form><p>Search all</p></form><footer>(c)</footer></body></html>"""


def test_divisions_are_told_apart_by_names_and_ratios():
    assert main_blocks(DIVS) == ["Title", LONG, "Short.", "Second & bold text <b> next", "one", "two"]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        (None, []),
        ("", []),
        ("<p></p>", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<nav>Menu one two</nav>", []),
        (f"<article><header><h2>Head</h2><p>by me</p></header><p>{LONG}<p>x</article><p>{LONG}", ["Head", LONG, "x"]),
        (f"<main><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></main>", [LONG]),
        (f"<article><p>a <aside>{LONG}</aside> b</p></article>", ["a", "b"]),
        ("<article><p>cut &am", ["cut &am"]),
        ("<article><h1>One</h1><p>Two.<br></article></article></p><footer>f", ["One", "Two."]),
        (f"<div><p>{LONG}</p><span class='ad'>ad</span> tail</div>", [LONG, "tail"]),
    ],
)
def test_blocks(html, blocks):
    assert main_blocks(html) == blocks


@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_titles_and_last_words_beside_an_inner_body_stay(mark):
    body = f"<div class=body><p>{LONG}</p><p>{LONG}</p></div>"
    menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in "abcdef")
    page = f"<body><div><ul>{menu}</ul></div><{mark}><h1><a href=/t>Title</a></h1><p>Intro.</p>{body}<p>Last words</p></{mark}></body>"
    assert main_blocks(page) == ["Title", "Intro.", LONG, LONG, "Last words"]
    long = f"<section><h2>Middle</h2>{f'<p>{LONG * 9}</p>' * 9}</section>"
    page = f"<body><{mark}><section><h2>One</h2><p>In short.</p></section>{long}<section><h2>End</h2><p>{LONG}</p></section></{mark}></body>"
    assert main_blocks(page) == ["One", "In short.", "Middle", *[LONG * 9] * 9, "End", LONG]


@pytest.mark.parametrize("wrap", ["wrap has-sidebar", "layout no-sidebar", "content share-enabled", "widget", "modal overlay"])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_wrappers_named_like_parts_stay(wrap, mark):
    parts = f"<div class='sidebar-left'><p>{LONG}</p></div><div id=comments><p>{LONG * 9}</p></div><div class='wp-ad-box'>{LONG}</div>"
    page = f"<div class='{wrap}'><{mark}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></{mark}>{parts}</div>"
    assert main_blocks(f"<body>{page}<div class='main-menu'><p>Menu</p></div></body>") == ["Title", LONG, LONG, LONG]
    assert main_blocks(f"<form id=aspnet>{page}</form>") == ["Title", LONG, LONG, LONG]


def test_sections_and_headings_of_an_article_are_not_named_by_subjects():
    page = f"""<article><h2 id="related-work">Related</h2><p>{LONG}</p><h2 id="search">Search</h2><p class="notice">Note.</p>
<section id="discussion"><p>{LONG}</p></section><section id="comments"><p>{LONG}</p></section><p class="ad">Buy</p></article>"""
    assert main_blocks(page) == ["Related", LONG, "Search", "Note.", LONG]


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "advert", "related"])
def test_comments_notices_and_adverts_never_stay(name):
    assert main_blocks(f"<div><p>{LONG}</p></div><div class='{name}'><p>{LONG * 20}</p></div>") == [LONG]


@pytest.mark.parametrize("mark", ["main", "article", "div"])
@pytest.mark.parametrize(
    "name",
    "reader-comments user-comments comment-body privacy-notice cookie-policy google-ads sponsored-content email-signup left-hand-menu".split(),
)
def test_a_naming_word_anywhere_in_a_class_leaves_out(mark, name):
    page = f"<{mark}><p>{LONG}</p><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p class='has-{name}'>{LONG}</p></{mark}>"
    assert main_blocks(page) == [LONG] * 3
    # A wrapper is told by what it holds, but a box of comments never is one.
    wrapped = main_blocks(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p>")
    assert wrapped == [LONG] * (1 if "comment" in name else 4)


def test_excluded_elements_inside_a_block_leave_it_whole():
    inner = ["<script>x()</script>", "<svg><text>x</text></svg>", "<button>b<div>c</div></button>", "<label>l</label>", "<span class='ad'>a</span>"]
    for element in inner:
        assert main_blocks(f"<p>one {element}two</p>") == ["one two"]
    assert main_blocks("<p>one <label>never <b>closed</p><p>two</p>") == ["one", "two"]
    assert main_blocks("<p>one <label>never closed<p>two</p>") == ["one", "two"]


def test_links_alone_at_the_edges_of_the_region_go():
    links = "<ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul>"
    after = "<p><a href=/n>Next</a></p><p><a href=/u>Up</a></p>"
    page = f"{links}<p>{LONG}</p><p><a href=/m>More</a></p><p>x</p><p>{LONG}</p>{after}"
    assert main_blocks(page) == [LONG, "More", "x", LONG]
    assert main_blocks(links) == ["Home", "Blog"]


def test_ratios_choose_among_marked_parts():
    teaser = "<article><p><a href=/t>One</a></p><p><a href=/t>Two</a></p></article>"
    rows = "".join(f"<tr><td><a href=/{k}><b><i>{k}</i></b></a></td></tr>" for k in range(9))
    page = f"<article><table>{rows}</table></article><article><h1>Title</h1><p>{LONG * 3}</p><p>Short.</p></article>{teaser * 3}"
    assert main_blocks(f"<body>{page}</body>") == ["Title", LONG * 3, "Short."]


@pytest.mark.parametrize("tag", ["<div class=nav>", "<div>", "<form>", "<span class=menu>", "<article>"])
def test_hostile_nesting_takes_linear_time(tag):
    started = time.monotonic()
    main_blocks(tag * 5000 + LONG)
    main_blocks("".join(tag + LONG for _ in range(5000)))
    assert time.monotonic() - started < 2


def plain_selection(html):
    """The selection as its definition reads, every step over all lines and all ancestors."""
    page = html_extract._Lines()
    page.feed(html)
    lines = page.finish()
    out = html_extract._outside(page)

    def ancestors(line):
        at, found = line.element, [0]
        while at:
            found.append(at)
            at = page.parent[at]
        return set(found)

    marked = any(line.part and not gone for line, gone in zip(lines, out))
    able = [not gone and bool(line.part or not marked) for line, gone in zip(lines, out)]
    ratios = [len(line.text) / max(1, line.tags) * ok for line, ok in zip(lines, able)]
    if not any(ratios):
        return []
    smooth = []
    for i in range(len(lines)):
        weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(lines)) if abs(i - j) <= 3}
        smooth.append(sum(w * ratios[j] for j, w in weights.items()) / sum(weights.values()))
    limit = statistics.pstdev(smooth)
    reach = {i for i, r in enumerate(ratios) if r and max(r, smooth[i]) >= limit * (1 - 1e-12)}
    content = {i for i in reach if not lines[i].links} or reach
    beside = set()
    for k, line in enumerate(lines):
        for i in content:
            between = range(min(i, k) + (k > i), max(i, k) + (k > i))
            if 0 < abs(i - k) <= 3 and k not in content and all(able[n] and not lines[n].links and n not in content for n in between):
                beside.add(k)
    content |= beside
    if marked:
        return [x.text for x, ok in zip(lines, able) if ok and x.part in {lines[i].part for i in content}]
    common = set.intersection(*(ancestors(lines[i]) for i in content))
    region = max(common)
    held = lambda e: [i for i, x in enumerate(lines) if able[i] and e in ancestors(x)]
    if len(held(region)) == 1:
        wider = [e for e in sorted(ancestors(lines[min(content)]), reverse=True) if e < region and len(held(e)) > 1]
        region = wider[0] if wider else region
    inside = held(region)
    while inside and lines[inside[0]].links and any(not lines[i].links for i in inside):
        inside.pop(0)
    while inside and lines[inside[-1]].links and any(not lines[i].links for i in inside):
        inside.pop()
    return [lines[i].text for i in inside]


def test_selection_equals_its_definition():
    draw = random.Random(7)
    pieces = [
        "<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "<a href=/>link</a>", "<a href=/>", "</a>", "<nav>menu</nav>", "<article>",
        "</article>", "<main>", "<div class=menu>", "<div class='x-ads'>", "<form>", "</form>", "<h2>", "</h2>", "<b>", "</b>", "<br>",
        "word ", LONG, LONG * 3, "<script>s</script>", "<header>", "</header>", "<span class=ad>", "</span>",
    ]
    for _ in range(3000):
        html = "".join(draw.choices(pieces, k=draw.randint(1, 40)))
        assert main_blocks(html) == plain_selection(html), html


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", DIVS, "x"), (1, "u", DIVS, "x"), (2, None, None, None), (None, "", "", None), (3, "v", f"<p>{LONG * 5000}", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(extract_main_text(pages).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    want = "\n\n".join(main_blocks(DIVS))
    assert [(r.page_id, r.url, r.text) for r in got] == [
        (None, "", ""), (1, "u", want), (1, "u", want), (2, None, ""), (3, "v", LONG * 5000)
    ]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(pages.limit(0)).count() == 0


def pages(spark):
    rows = [
        (5, "http://a/ä?x=1\r\nWARC-Type: evil", "same"),
        (3, None, "same"),
        (9, "http://b", "same"),
        (3, "http://c", "same"),
        (1, "http://d", None),
        (2, "http://e", ""),
        (7, "http://f", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n\x00ü"),
        (None, "http://g", "lone"),
        (None, "http://g", "lone"),
        (8, "http://h", "z" * 3_000_000),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)


@pytest.mark.parametrize("limit", [warc.ARCHIVE_BYTES, 300])
def test_archives_come_back_whole(spark, tmp_path, limit):
    folder = f"file://{tmp_path}/warc"
    got = warc.round_trip(pages(spark), folder, limit=limit).collect()

    def row(page_id, html, first=None):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return (page_id, len(payload), digest, "response" if first is None else "revisit", first)

    first = {"same": 3, "": 1}
    want = [row(r.page_id, r.html, f if (f := first.get(r.html or "")) != r.page_id else None) for r in pages(spark).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    small = warc.round_trip(pages(spark), f"file://{tmp_path}/small", least=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in small} == {"response"}


def test_members_stand_where_the_index_says(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(pages(spark), folder)
    files = warc.normalise(archives, folder).collect()
    whole = b"".join(sorted(
        data for a in archives.collect() for _, data in warc.records(iter([gzip.open(a.archive.removeprefix("file:")).read()]))
    ))
    found = []
    for f in files:
        packed = open(f.file.removeprefix("file:"), "rb").read()
        entries = [json.loads(line) for line in open(f["index"].removeprefix("file:"))]
        assert sum(e["length"] for e in entries) == len(packed)
        for e in entries:
            one = zlib.decompressobj(31)
            found.append(one.decompress(packed[e["offset"] : e["offset"] + e["length"]]))
            assert one.eof and not one.unused_data
    assert b"".join(sorted(found)) == whole


def test_cut_archives_are_refused():
    data = warc.record(1, "u", b"payload" * 100, None)
    packed = gzip.compress(data)
    for cut in (packed[:-20], gzip.compress(data[:-10])):
        with pytest.raises(EOFError):
            list(warc.records(warc.inflated(warc._reader(cut))))


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(pages(spark).limit(0), f"file://{tmp_path}/none").count() == 0
