"""Page cleaning and rendering: golden cases."""

from pagemill.functions.text import prefix_title, reported_title, tidy_markdown
from pagemill.options import CorpusOptions
from pagemill.plans.convert import to_markdown
from pyspark.sql import functions as F

URL = "https://h.com/d/p"


def body(inner, head=""):
    return f"<html><head>{head}</head><body>{inner}</body></html>"


def art(inner):
    return body(f"<article>{inner}</article>", "<title>A</title>")


T = "# A\n\n"
CASES = [
    (body("<main><header><h1>T</h1></header><p>x</p></main>"), "# T\n\nx"),
    (body("<h1>Hello <b>World</b></h1><p>x</p>"), "# Hello **World**\n\nx"),
    (body("<h1></h1><p>x</p>", "<title>A</title>"), "# \n\nx"),
    (body("<p>x</p>"), "# Untitled\n\nx"),
    (body("<article>one</article><article>two</article>"), "# Untitled\n\none"),
    (body("<div class='content'>c</div><article>a</article>"), "# Untitled\n\na"),
    (body("<main><!-- c --></main><article>a</article>"), "# Untitled\n\na"),
    (body("<form><main>x</main></form>"), "# Untitled\n\n*No content extracted*"),
    (art("<p>&nbsp;</p><p><img src='i.png' alt='A'></p>"), T + "![A](https://h.com/d/i.png)"),
    (art("<nav-x class='navx'>k</nav-x><p class='nav'>d</p>"), T + "k"),
    (art("<p class='x nav y'>d</p><p class='navy'>k</p>"), T + "k"),
    (art("<p role='navigation'>d</p><p aria-label='breadcrumb'>d</p><p id='nav'>d</p>k"), T + "k"),
    (art("<p><b>t.<br><p>u</p>"), T + "**t.**\n\nu"),
    (art("<h2>S</h2><p>x</p>"), "## S\n\nx"),
    (art("<table><tr><th>a</th><th>b</th></tr><tr><td></td><td>1</td></tr></table>"),
     T + "| a | b |\n| --- | --- |\n| 1 |"),
    (art("<a href='q'> T </a>"), T + "[T](https://h.com/d/q)"),
    (art("<a href='#s'>T</a>"), T + "[T](#s)"),
    (art("<a href='q' title='x'>T</a>"), T + '[T](https://h.com/d/q "x")'),
    (art("<a href=''>T</a>"), T + "T"),
    (art("x<img alt='A'>"), T + "x"),
    (art("<img src='data:x' alt='A'>"), T + "![A](data:x)"),
    (art("<p>a <b> bold </b>c <i>it</i> <code>x_y*</code> <del>no</del></p>"), T + "a **bold** c *it* `x_y*` ~~no~~"),
    (art("<p>snake_case * star</p>"), T + r"snake\_case \* star"),
    (art("<pre class='highlight'>a_b\n  c</pre>"), T + "```highlight\na_b\n c\n```"),
    (art("<pre><code class='language-py'>x</code></pre>"), T + "```\nx\n```"),
    (art("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"), T + "- a\n- b\n - c"),
    (art("<ol start='4'><li>a</li><li>b</li></ol>"), T + "4. a\n5. b"),
    (art("<ul><li>a</li></ul>tail"), T + "- a\n\ntail"),
    (art("<blockquote><p>a</p><p>b</p></blockquote>x"), T + "> a\n>\n> b\n\nx"),
    (art("a<hr>b"), T + "a\n\n---\n\nb"),
    (art("line<br>next"), T + "line\nnext"),
    (art("<h2>a <i>b</i>\n c</h2>"), "## a *b* c"),
    (art("<dl><dt>t</dt><dd>d</dd></dl>"), T + "t\n: d"),
    (art("<table><tr><td colspan='2'>w</td></tr><tr><td>l\nm</td><td>r</td></tr></table>"),
     T + "| | |\n| --- | --- |\n| w | |\n| l m | r |"),
    (art("<table><thead><tr><th>k</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>"),
     T + "| k |\n| --- |\n| v |"),
    (art("<div><p>a</p> <p>b</p></div>"), T + "a\n\nb"),
    (art("<p>x<script>if (a < b) { '</p>' }</script>y</p>"), T + "xy"),
    (body("<p>a</body></html><p>b"), "# Untitled\n\na\n\nb"),
    ("plain text", "# Untitled\n\nplain text"),
    ("", "# Untitled\n\n*No content extracted*"),
    (art("<P CLASS=AD>d</P><p data-x>Grüße &lt;3 &amp; más</p>"), T + "d\n\nGrüße <3 & más"),
    (art("<p>a<span/>b</p>"), T + "ab"),
]


def test_golden_pages(spark):
    pages = spark.createDataFrame([(i, URL, h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = {r.page_id: r.markdown for r in to_markdown(pages).collect()}
    wrong = [(CASES[i][0], got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


def test_title_is_taken_before_cleaning(spark):
    pages = spark.createDataFrame(
        [(0, URL, body("<h1>Hello <b>World</b></h1>")), (1, URL, body("<h1></h1>x", "<title>A</title>")),
         (2, URL, body("x", "<title> A  b </title>")), (3, URL, body("x"))],
        "page_id long, url string, html string",
    )
    got = [r.title for r in to_markdown(pages).orderBy("page_id").collect()]
    assert got == ["HelloWorld", "", "A  b", "Untitled"]


def test_own_selectors(spark):
    pages = spark.createDataFrame([(URL, body("<nav>n</nav><p class='x'>d</p><div id='c'>k</div>"))], "url string, html string")
    options = CorpusOptions(boilerplate=(".x",), content=("nav",))
    assert to_markdown(pages, options).first().markdown == "# Untitled\n\nn"


def test_own_tag_rule(spark):
    pages = spark.createDataFrame([(URL, art("<mark>m</mark><b>b</b>"))], "url string, html string")
    options = CorpusOptions(tag_rules=(("mark", lambda node, text: F.concat(F.lit("=="), text, F.lit("=="))),))
    assert to_markdown(pages, options).first().markdown == T + "==m==**b**"


TIDY = [
    ("a\n\n\n\nb", "a\n\nb"), ("a  \nb", "a\nb"), ("[t]( ) ![i]()", "t !i"), ("x\n\n-\n\ny", "x\n\ny"),
    ("a\n\n# H\n\nb", "a\n\n\n# H\n\nb"), ("- a\n    - b", "- a\n - b"),
    ("```\n    y\n# c\n```", "```\n y\n\n# c\n```"), ("a\xa0 \nb\x1c", "a\nb"), (" \n x \n ", "x"),
]


def test_tidy(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(TIDY)], "i int, md string")
    got = [r.x for r in df.select("i", tidy_markdown(F.col("md")).alias("x")).orderBy("i").collect()]
    assert got == [b for _, b in TIDY]


def test_titles_of_markdown(spark):
    df = spark.createDataFrame([(0, "x\n#  T \n# U"), (1, "## no"), (2, "# a"), (3, "x # y")], "i int, md string")
    got = df.select(reported_title(F.col("md")).alias("t"), prefix_title(F.col("md"), F.lit("P")).alias("p"), "i")
    rows = got.orderBy("i").collect()
    assert [r.t for r in rows] == ["T", None, "a", None]
    assert [r.p for r in rows] == ["# P\n\nx\n#  T \n# U", "## no", "# a", "# P\n\nx # y"]
