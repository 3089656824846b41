import html
import random
import time

import pytest

from plumbline.llm import dom, site_style as S


def text_of(markup):
    return " ".join(dom.blocks(dom.read(markup)))


def test_boilerplate_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>no</header>
    <nav><ul><li>no</nav><div class="cookie-notice">no</div><div class="ad">no</div><aside>no</aside>
    <article><header><h1>A &amp; B&nbsp;&#233;</h1></header><p>one<b> two</b><br>three
      four<p>five <a href="x>y">six</a><ul><li>seven<li>eight</ul><div class="share">no</div><form>no</form>
    <script>if (a < b) "</p>"</script><!-- no --></article><div id="comments">no</div><footer>no"""
    assert text_of(page) == "A & B é one two three four five six seven eight"


def test_broken_and_odd_markup_never_fails():
    random.seed(2)
    pieces = ["<", ">", "</", "p", "div", "<p>", "</p>", "<li>", "<!--", "-->", "'", '"', "=", "&amp", "&#xZ;", " a ", "<script>", "é", "<br/>"]
    for _ in range(2000):
        text_of("".join(random.choice(pieces) for _ in range(random.randrange(30))))
    assert text_of("") == "" and text_of("2 < 3 and 5 > 4") == "2 < 3 and 5 > 4"
    assert text_of("<p>" + "<b>" * 3000 + "deep") == "deep"
    assert len(text_of("<p>long " * 20_000)) == 20_000 * 5 - 1


def site(i, words):
    body = html.escape(" ".join(words))
    return f"""<body><div class="xq"><p>All rights belong to this site</p><a href="/">Home of it</a></div>
    <div class="zz"><h2>Head {i}</h2><p>{body}</p></div></body>"""


def test_repeated_branches_are_removed_by_entropy(spark):
    random.seed(3)
    rows = [(i, f"http://one.example/{i}?q", site(i, [f"w{random.random()}" for _ in range(9)])) for i in range(20)]
    rows += [(100 + i, f"https://user@two.example:80/{i}", site(i, ["alone", str(i)])) for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in S.main_text(frame, ["page_id"]).collect()}
    for i in range(20):
        assert found[i].startswith(f"Head {i} w") and "rights" not in found[i]
    assert found[100].startswith("All rights belong")


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = "<body><div class='zz'><h2>Same</h2><p>text of a page that has many copies</p></div></body>"
    rows = [(i, "http://one.example/", page) for i in range(50)]
    found = S.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert {r.text for r in found} == {"Same text of a page that has many copies"} and len(found) == 50


def test_odd_rows(spark, clashing):
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = S.main_text(clashing(frame), ["page_id", "url"]).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == sorted(
        [("1", "", 0), ("2", "", 0), ("None", "x", 1), ("3", "x", 1), ("3", "x", 1)]
    )
    assert S.main_text(frame.filter("page_id < 0"), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    "broken",
    ["<a " + "'\"" * 10_000, "<a '\"'" * 5_000, "<a " * 100_000, "<a x='" * 20_000, '<p "' * 20_001, "<!-" * 50_000, "</" * 50_000 + "<a '", "<a/" * 50_000],
)
def test_broken_tags_take_linear_time(broken):
    started = time.perf_counter()
    dom.read("<p>before</p>" + broken)
    dom.read("<p>before</p>" + broken + "<p>after</p>")
    assert time.perf_counter() - started < 10
