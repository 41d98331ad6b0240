import random

from heddle.llm import html_text
from heddle.llm.html_text import aligned, extract_text, lines_of, nearest


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in "ab")
        for find in (aligned, lambda a, b: html_text._aligned(a, b, 8)):
            places = find(a, b)
            rest = iter(b)
            assert places == sorted(set(places)) and len(places) == longest(a, b)
            assert all(a[i] in rest for i in places)
    many = list(range(30_000))
    assert len(aligned(many, many[5:] + many[:5])) == len(many) - 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="page header-on"><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>A &amp; B</h1></header><p>One<br>two&nbsp; <b>three</b><p>Four &lt;x&gt;
<script>var t="</p>";</script><div class="ad">Buy</div><form><input>Name</form><section id="comments"><p>Nice!</p></section><p>a < b</article>
<aside>Side</aside><footer>&copy; Us</footer></body></html>"""


def text_of(page):
    return html_text.main_text(lines_of(page), [], None)


def test_marked_article():
    assert text_of(PAGE) == "A & B\n\nOne two three\n\nFour <x>\n\na < b"
    assert text_of("") == "" and text_of("plain  words") == "plain words"
    assert text_of("<nav>never closed<article><p>in</article>") == "in"
    assert text_of("<main><p>x</main><p>out") == "x"
    assert text_of("<article><aside>never closed<p>y</article><p>out<article>z</article>") == "z"
    assert text_of("<p>cut off <b") == "cut off"
    assert text_of("<p class=comment>no</p><p hidden>no</p><p style='display: none'>no</p><p class='content'>yes") == "yes"


def test_silent_elements_end():
    page = "<article><p>a</p>{}<p>b</p></article>"
    for inner in ("<svg-icon></svg-icon>", "<video-js></video-js>", "<title-bar>", "<svg viewBox='0 0 1 1'/>", '<svg aria-label="x > y" />', "<video src=v>", "<object data=o/>", "<iframe src='f' />"):
        assert text_of(page.format(inner)) == "a\n\nb", inner
    for inner in ("<svg><svg><text>x</text></svg><svg/><title>y</title></svg>", "<object>x<object>y</object>z</object>", "<title>x <title> y</title>", "<SCRIPT/>x</SCRIPT>", "<template>x</template >"):
        assert text_of(page.format(inner)) == "a\n\nb", inner
    assert text_of("<p>a <svg/>b <svg>x</svg>c <svg><svg>x</svg>d") == "a b c d"
    assert text_of("<p>a<script>x<p>b") == "a"
    formula = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x+1</annotation></semantics></math>"
    assert text_of(f"<article><p>Let {formula} be") == "Let x+1 be"
    assert len(lines_of("<video><p>x" * 50_000)) == 50_000 and len(lines_of("<svg><svg></svg><p>x" * 50_000)) == 50_000


def test_names_and_ends_of_frames():
    for inner in (
        '<a href="/hidden/gems">x</a>', '<b title="Hidden costs">x</b>', '<a href="/p.php?id=search">x</a>', "<b data-x='a class=ad b'>x</b>", '<b aria-hidden="false">x</b>', '<b data-class="ad">x</b>'
    ):
        for page in ("<article><p>a {} b</article>", "<p>a {} b"):
            assert text_of(page.format(inner)) == "a x b", inner
    for mark in ('section id="related-work"', 'h2 id="search"', 'h2 id="comments"', 'div class="no-sidebar"', 'div id="with-navbar"', 'div class="entry-header"', 'section id="cookies"'):
        assert text_of(f"<article><p>a</p><{mark}>b</{mark.split()[0]}></article>") == "a\n\nb", mark
    for mark in ('section id="related-work"', 'h2 id="search"', 'div class="no-sidebar"', 'div class="page has-sidebar"'):
        assert text_of(f"<{mark}>b</{mark.split()[0]}>") == "b", mark
    for mark in ('div id="site-footer"', 'div id="search"', 'div id="cookie-notice"', 'div class="x main-nav"', "div class=ad", 'div role="search"', "div hidden"):
        assert text_of(f"<p>a</p><{mark}>b</div>c") == "a\n\nc", mark
    left_open = {
        '<article><p class="ad">Buy<p>a</article>': "a",
        '<article><ul><li class="share">x<li>a<ul><li>b</ul><li class="share">y</ul><p>c</article>': "a\n\nb\n\nc",
        "<table><tr><td class=ad>x<td>a<tr class=ad><td>y<tr><td>b</table><p>c": "a\n\nb\n\nc",
        "<article><dl><dt class=ad>x<p>y<dd>a</dl><section><div class=ad><div>z</div></section>b</article>": "a\n\nb",
        "<section><span class=ad>x</section>a<ul><li class=ad>y<ul><li>z</li><li>z</ul>z<li>b</ul>": "a\n\nb",
        "<div class=ad>x<table><tr><td>y</div>y</table>y</div><p>a": "a",
    }
    for page, text in left_open.items():
        assert text_of(page) == text, page
    assert len(lines_of("<div>x" * 50_000 + "<li>x</p>" * 50_000)) == 100_000


def test_marks_that_hold_little():
    body = "".join(f"<p>passage {i} of a long body</p>" for i in range(30))
    text = "\n\n".join(f"passage {i} of a long body" for i in range(30))
    comments = "".join(f'<article class="{c}"><p>{"me too " * 400}</p></article>' for c in ("comment", "comment-body", "reply odd"))
    assert text_of(f"<div>{body}</div>{comments}") == text
    assert text_of(f"<div>{body}</div><section class=comments>{comments}<p>Your reply</section>") == text
    assert text_of(f"<article class='post comments-open'>{body}{comments}</article><p>out") == text
    cards = "<article><h3>Card</h3></article><article class='no-comments'>More</article>"
    assert text_of(f"<div>{body}</div>{cards}") == text + "\n\nCard\n\nMore"
    page = lines_of(f"<div>Site</div><div>{body}</div>{cards}")
    assert html_text.main_text(page, [hash(x) for _, x in page], [hash(x) for x in ("Site", "other", "Card", "More")]) == text
    assert text_of(f"<main>{cards}</main><div>{body}</div>") == f"Card\n\nMore\n\n{text}"
    assert text_of(f"<main>{body}</main><div>{body}</div>") == text
    assert text_of(f"<article><p>short</p><aside>{body}</aside></article><p>out") == "short"


def test_pairs_and_shared_lines(spark):
    frame = "<div>Site name</div>{}<div>All about us</div>"
    rows = [
        (1, "http://a.org/x/1", frame.format("<p>first</p><p>same</p>")),
        (2, "https://A.org/x/2?q", frame.format("<p>second</p>")),
        (3, "http://a.org/y", "<p>third</p><p>same</p>"),
        (4, "http://b.org/x/1", frame.format("<p>alone</p>")),
        (5, None, "<p>no url</p>"),
        (None, "http://a.org/z", None),
        (6, "not a url", "<p>x</p>"),
        (6, "not a url", "<p>x</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as PLACE", "3 as text")
    pairs = {r.page_id: r.other_id for r in nearest(pages).collect()}
    assert pairs == {1: 2, 2: 1, 3: 2, None: 3}
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert extract_text(pages).count() == len(rows) and extract_text(pages.limit(0)).count() == 0
    assert [got[k[:2]][0] for k in rows] == ["first\n\nsame", "second", "third\n\nsame", "Site name\n\nalone\n\nAll about us", "no url", "", "x", "x"]
    assert all(len(t) == n for t, n in got.values())


def test_mirrored_articles_stay(spark):
    page = "<div>Frame</div><article><p>Body</article>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extract_text(pages).collect()} == {"Body"}
    long = "<article>" + "<p>word word</p>" * 20_000
    pages = spark.createDataFrame([(i, f"http://h/{i}", long) for i in range(2)], "page_id long, url string, html string")
    assert {r.n_chars for r in extract_text(pages).collect()} == {20_000 * 9 + 19_999 * 2}


def test_references_are_decoded_in_their_own_text_and_copies_stay(spark):
    page = "<body><div>AT&<b>amp;</b> T</div><div>a &lt<i>; b</i> &amp;amp; &#x41;</div></body>"
    rows = [(1, "http://h.org/a/1", page), (2, "http://h.org/a/2", page), (3, "http://other.org/x", "<p>R&amp;D &eacute;</p>")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "AT&amp; T\n\na <; b &amp; A"
    assert {r.page_id: r.text for r in found} == {1: text, 2: text, 3: "R&D é"}
