import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import html_text, topk
from labelloom.llm.html_text import render


def brute(rows, k):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out.update({(i, r): (j, -s) for r, (s, j) in enumerate(scored, 1)})
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_bytes": 300, "run_rows": 16, "step_rows": 5}])
def test_top_k(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 7)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(500, [1.0, 2.0]), (520, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, 20, **options).collect()
    expected = brute([r for r in rows if r[0] != 500], 20)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == expected


@pytest.mark.parametrize("run_rows", [64, 5000])
def test_pairs_below_the_bound_are_not_scored(run_rows):
    rng = np.random.default_rng(4)
    c = np.floor(64 * rng.normal(size=(4000, 32)) * 0.8 ** np.arange(32) * rng.uniform(0.7, 1.3, size=(4000, 1)))
    ids, q = np.arange(4000), c[::40]
    turn = np.linalg.svd(c.T @ c)[0]
    products = q @ c.T

    def expected(i):
        return sorted((-int(products[i, j]), j) for j in range(4000) if j != 40 * i)[:20]

    def check(floor):
        got_q, got_i, got_s, scored = topk.search(ids[::40], q, floor, ids, c, 20, turn, run_rows, 30)
        for i in range(100):
            at = got_q == 40 * i
            assert list(zip(-got_s[at], got_i[at], strict=True)) == expected(i)
        return scored

    blind = check(np.full(100, -np.inf))
    known = check(np.array([-expected(i)[-1][0] for i in range(100)], float))
    assert known < 0.05 * 400_000  # floors from other shards
    assert known <= blind <= 400_000 and (run_rows > 4000 or blind < 0.3 * 400_000)


def test_top_k_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert topk.top_k(one, F.lit(True)).count() == 0
    assert topk.top_k(one.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, None)], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    two = one.unionAll(spark.createDataFrame([(1, [2.0, 0.0])], one.schema))
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_top_k_of_every_length(spark):
    rows = [(i, []) for i in range(50)] + [(100 + i, [float(i), 1.0]) for i in range(6)] + [(200 + i, [1.0, float(-i), 2.0]) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, 3).collect()
    expected = brute([r for r in rows if len(r[1]) == 2], 3) | brute([r for r in rows if len(r[1]) == 3], 3)
    assert len(expected) == 6
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == expected


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("x <b> y</b>  z\n\tw", "x y z w"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=4><li>a</li><li>b</ol>", "4. a\n5. b"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("<table><tr><th colspan=2>wide head<th>x<tr><td>a<td>b<td>c</table>", "wide head  x\na  b       c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<td>loose</td> cell", "loose cell"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<head><title>t</title><script>s</script>body", "body"),
    ("<style>.h,#i{display:none}</style><p class='g h'>no<p id=i>no<p>yes", "yes"),
    ("<style>@media print{p{display:none}} @media (max-width:600px){p{display:none}}</style><p>yes", "yes"),
    ("<style>@media screen and (min-width: 40em){.a{display:none}} @media not print{.b{display:none}}</style><p class=a>no<p class=b>no<p>yes", "yes"),
    ("<style>@media (prefers-color-scheme: dark), print{p{display:none}}</style><p>yes", "yes"),
    ("<style media=print>p{display:none}</style><p>yes", "yes"),
    ("<noscript><style>p{display:none}</style></noscript><p>yes", "yes"),
    ("<style>.b{display:none}.b{display:block}</style><p class=b>yes", "yes"),
    ("<style>.b{display:none !important}.b{display:block}</style><p class=b style='display:block'>no<p>yes", "yes"),
    ("<style>p.b{display:none}.b{display:block}</style><p class=b>no<div class=b>yes</div>", "yes"),
    ("<style>#i{display:block}.b.c{display:none}</style><p class='b c'>no<p class=b>yes<p id=i class='b c'>too", "yes\n\ntoo"),
    ("<style>.b{display:none}</style><p class=b style='display:block'>yes", "yes"),
    ("<style>.a .b{display:none}</style><div class=a><p><span class=b>no</span>yes</div><span class=b>too</span>", "yes\n\ntoo"),
    ("<style>.a>.b{display:none}</style><div class=a><b class=b>no</b><i><b class=b>yes</b></i></div>", "yes"),
    ("<style>.x .a>b{display:none}</style><div class=x><u class=a><u class=c><b>yes</b></u><b>no</b></u></div>", "yes"),
    ("<body class=w><style>body.w p, html body .q{display:none}</style><p>no</p><i class=q>no</i>yes", "yes"),
    ("<style>p:hover,a[href],p+p,li::before{display:none}</style><p>yes<p>too", "yes\n\ntoo"),
    ("<style>@font-face{font-family:x;src:url(a)}@import 'x';@keyframes k{from{display:none}p{display:none}}i{display:none}</style><p>yes<i>no</i>", "yes"),
    ("<style>p::after{content:'}p{display:none}'}</style><p>yes", "yes"),
    ("<style>*{display:none}p{display:block}</style><div>no</div><p>yes", "yes"),
    ("<p style='--x-display:none'>yes", "yes"),
    ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no", "yes"),
    ("a<span style='visibility:hidden'>no</span>b", "a b"),
    ("<style>.m{visibility:hidden}.n{visibility:visible}</style><div class=m><p>no<p class=n>yes</div>z", "yes\n\nz"),
    ("<div style='display:none'><p style='display:block;visibility:visible'>no</div>yes", "yes"),
    ("<p hidden style='display:block'>yes", "yes"),
    ("<style>p{display:none", ""),
    ("<style>}}p{display:none}</style><p>no</p>yes", "yes"),
    ("<p hidden>no</p><p style='DISPLAY : none'>no</p><template>no</template>yes", "yes"),
    ("<details>no<summary>S</summary>no</details><details open><summary>T</summary>in</details>", "S\nT\nin"),
    ("<a href='x>y' title=\"</p>\">l</a><!-- <p>no -->&amp;&lt;&nbsp;&#233;", "l&<\xa0é"),
    ("<script>if (a < b) '</p>'</script>x<SCRIPT >no</SCRIPT >y", "xy"),
    ("a </nope> b </p> c", "a b c"),
    ("<h1>H</h1>t<hr>u", "H\n\nt\n\nu"),
    ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("cut <b", "cut"),
    ("1 < 2 <3", "1 < 2 <3"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_render(source, text):
    assert render(source) == text


def test_deep_and_broken_pages_end():
    for source in ("<b>" * 50_000 + "x", "<div>" * 20_000 + "x", "<table><tr><td>" * 2000 + "x", "<a b='" * 9000, "<!--" * 9000, "<" * 9000):
        render(source)
    assert render("<div>" * 3000 + "x" + "</div>" * 3000 + "y") == "x\ny"


@pytest.mark.parametrize("opened", ["<div>", "<b>", "<div><i>", "<blockquote>"])
def test_pages_are_laid_out_at_any_depth(opened):
    for source, text in [
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>ccc</td><td>d</td></tr></table>", "a    b\nccc  d"),
        ("<ul><li>one</li><li>two<ol><li>x</li></ol></li></ul>", "- one\n- two\n  1. x"),
        ("<div hidden><div>x</div>secret</div>seen", "seen"),
        ("<section>a<div>b</div>c</section>d", "a\nb\nc\nd"),
    ]:
        assert render(source) == text
        assert render(opened * 300 + source) == text
    assert render("<ul><li>" * 300 + "x") == "- " * 300 + "x"
    assert render("<ul><li>a" * 300).split("\n") == ["  " * i + "- a" for i in range(300)]
    assert render("<table><tr><td>a" * 300 + "<td>b") == "a\n\n" * 299 + "a  b"


def test_deep_lists_and_tables_end():
    assert render("<ul><li>" * 20_000 + "x") == "- " * 20_000 + "x"
    assert render("<table><tr><td>a" * 20_000).count("a") == 20_000
    assert render("<p>a" + "<ul><li>b</ul>" * 20_000).count("b") == 20_000
    assert render("<span>" * 20_000 + "<p>a<a>b<td>c</i>" * 20_000).count("a") == 20_000


def test_extract_text(spark, sf_dir):
    rows = [(i, s, "clash") for i, (s, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract_text(pages.limit(0)).count() == 0
    whole = html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert whole.where("text like '%track(%' or text like '%margin:0%' or text = ''").count() == 0
