import html
import re

import pytest

from tallyforge.llm import htmlmain

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


def run(spark, rows):
    return {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmlmain.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [html.unescape(x) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner).replace("<br>", " "))]
        want = " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a &lt;b&gt; &amp;amp; &eacute;&#233;<b>x</b>y\n\n z</p><p>c", "a <b> &amp; ééxy z c"),
        ("<body><header>top</header><nav>menu</nav><div class='content has-sidebar'><p>one<p>two</div><aside>side</aside><form>f</form><footer>end", "one two"),
        ("<main><h1>T</h1><div class=ad>buy</div><p>x</p><div id='comments'><article class='comment'>c</article></div></main><p>no", "T x"),
        ("<article><header><h1>H</h1></header><p>b</p><footer>f</footer></article>", "H b"),
        ("<script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><div hidden>no</div><div style='display: none'>no</div>", "yes"),
        ("<head><title>t</title><body><p>no end of head", "no end of head"),
        ("<p title='a>b'>q</p></div></p><p>r", "q r"),
        ("<ul><li>one<li>two</ul><table><tr><td>3<td>4</table>", "one two 3 4"),
        ("<p>unclosed <b>bold<p>next<!-- to the end", "unclosed bold next"),
    ],
)
def test_rules(page, want):
    assert htmlmain.main_text(page) == want


def test_template_text_goes_where_no_element_tells(spark):
    def page(i, body):
        return f"<div><p>Our site</p><p>Pay us</p></div><div>{body}</div><div><p>All rights</p></div>"

    rows = [(i, f"http://h.org/{i}", page(i, f"<p>story {i}</p><p>same line</p>" if i % 2 else f"<p>story {i}</p>")) for i in range(12)]
    rows += [(20, "http://alone.org/", page(20, "<p>x</p>")), (21, None, page(21, "<p>y</p>")), (22, "http://h.org/22", None), (23, "nonsense", "")]
    got = run(spark, rows + [rows[0]])
    assert got[0] == "story 0" and got[2] == "story 2"
    # half of the pages have it: a template needs the same order, and one class of its own is in order
    assert got[1] in ("story 1", "story 1 same line")
    assert got[20] == "Our site Pay us x All rights" and got[21] == "Our site Pay us y All rights" and got[22] == "" and got[23] == ""


def test_one_article_on_all_pages_of_a_small_host_stays(spark):
    rows = [(i, f"http://h.org/{i}", "<nav>m</nav><article><p>the same story</p></article>") for i in range(6)]
    assert set(run(spark, rows).values()) == {"the same story"}


@pytest.mark.parametrize("copies", [3, 20])
@pytest.mark.parametrize("frame", ["<div>{}</div>", "<nav>m</nav><article>{}</article>"])
def test_copies_of_a_page_are_no_template(spark, copies, frame):
    page = frame.format("<p>the same story</p><p>told twice</p>")
    rows = [(i, f"http://only.org/{i}", page) for i in range(copies)]
    rows += [(100 + i, f"http://most.org/{i}", page) for i in range(copies)]
    rows += [(200 + i, f"http://most.org/other{i}", frame.format(f"<p>story {i}</p>")) for i in range(copies // 9 + 1)]
    got = run(spark, rows)
    assert {got[i] for i in got if i < 200} == {"the same story told twice"}
    assert all(got[i] == f"story {i - 200}" for i in got if i >= 200)


def test_template_counts_each_different_page_once(spark):
    rows = [(i, f"http://h.org/{i}", f"<div><p>Our site</p></div><div><p>story {i}</p></div>") for i in range(5)]
    got = run(spark, rows + [(10 + i, f"http://h.org/c{i}", rows[0][2]) for i in range(20)])
    assert got == {**{i: f"story {i}" for i in range(5)}, **{10 + i: "story 0" for i in range(20)}}


def test_classes_need_one_order():
    class T:
        def __init__(self, key):
            self.key = key

    seq = [T(k) for k in (1, 5, 6, 2, 5, 6, 3)]
    assert htmlmain.valid_classes(seq, {10: [1, 2, 3], 11: [5, 6]}) == {1, 2, 3, 5, 6}
    # 6 before 5 in one round, or a round that straddles a token of the outer class
    assert htmlmain.valid_classes([T(k) for k in (1, 5, 6, 2, 6, 5, 3)], {10: [1, 2, 3], 11: [5, 6]}) == {1, 2, 3}
    assert htmlmain.valid_classes([T(k) for k in (1, 5, 6, 5, 2, 6, 3)], {10: [1, 2, 3], 11: [5, 6]}) == {1, 2, 3}


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == {}
    d = spark.createDataFrame([(1, "http://a.b/", "<p>x", "t", 7)], SCHEMA + ", text string, host int")
    assert htmlmain.extract(d).first().text == "x"


def test_formulas_and_elements_with_similar_names_stay():
    assert htmlmain.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>") == "Let x=2 be"
    assert htmlmain.main_text("<article><object-view>kept</object-view><style-guide>too</style-guide><style>not</style></article>") == "kept too"


def test_very_long_page():
    body = "".join(f"<p>part {i}</p>" for i in range(40_000))
    assert len(htmlmain.main_text(f"<nav>x</nav><article>{body}</article>").split()) == 80_000
