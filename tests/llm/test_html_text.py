import numpy as np

from estatelake.llm.html_text import blocks, extract, repeated_tokens


def text(page):
    return "\n".join(blocks(page)[0])


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
      <article><header><h1>The   title</h1></header><p>One &amp; <b>two</b>&nbsp;three<p>Next<br>line <!-- note --> here
      <div class="ad">Buy</div><aside>See also</aside><form><input value="x">Send</form><ul><li>first<li>second</ul>
      <section id="comments"><article><p>A reader says</p></article></section></article>
      <div class="sidebar"><p>Other</p></div><footer>&copy; 2020</footer></body></html>"""
    assert text(page) == "The title\nOne & two three\nNext line here\nfirst\nsecond"


def test_malformed_pages():
    assert text("<article><p>cut in the mid") == "cut in the mid"
    assert text("<article><p>cut in a tag <b clas") == "cut in a tag"
    assert text("<article><p>cut in a mark &am") == "cut in a mark &am"
    assert text("<nav><li>menu <article><p>a < b and c > d</p></article>") == "a < b and c > d"
    assert text("<article><a title='x > y'>link</a> <script>if (a</b) x()") == "link"
    assert text("<main><div class='menu'>m</div><p>body</main><p>after") == "body"


def test_repeated_runs_equal_a_plain_count():
    rng = np.random.default_rng(0)
    page = np.sort(rng.integers(0, 12, 400))
    tokens = rng.integers(0, 3, 400)
    for run in (1, 3, 5, 8):
        where: dict = {}
        for i in range(400 - run + 1):
            if page[i] == page[i + run - 1]:
                where.setdefault(tuple(tokens[i: i + run]), []).append(i)
        want = np.zeros(400, bool)
        for starts in where.values():
            if len({page[i] for i in starts}) >= 2:
                for i in starts:
                    want[i: i + run] = True
        assert (repeated_tokens(tokens, page, run) == want).all()


def test_unmarked_pages_keep_what_only_they_have(spark):
    menu = "Home page of this site and its very long menu of links and things to read"
    rows = [(i, f"http://h.example.com/{i}", f"<body><div>{menu}</div><div>{' '.join(f'word{i}x{k}' for k in range(12))}</div><p>Short note</p><div>{menu} more</div></body>") for i in range(5)]
    rows += [(3, *rows[3][1:]), (9, None, None), (10, "x", ""), (11, "http://z.com/a", "<p>only &lt;one&gt; page")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, host int")).collect()}
    for i in range(5):
        assert got[i]["text"] == " ".join(f"word{i}x{k}" for k in range(12))
    assert got[11]["text"] == "only <one> page" and got[9]["n_chars"] == got[10]["n_chars"] == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(empty).count() == 0


def test_articles_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in pages:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<[^>]*\Z", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_marks_guard_prose_and_repetition_decides_the_rest(spark):
    menu = "Home page of this site and its very long menu of links and things to read"
    teaser = "Get our best stories by mail every single morning before your coffee is ready"
    shared = "A passage of prose that two articles of this host share and that must stay in both"
    page = lambda i: f"<div>{menu}</div><article><p>{shared}</p><div class='zq9'><p>{teaser}</p><p>More</p><p>Own words {i}</p></div><div class='zq8'><div class='entry-content'>{shared}</div></div></article>"
    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(3)]
    rows += [(7, "http://h.example.com/7", f"<body><div>{menu}</div><p>{shared}</p><p>more of {teaser} too</p></body>"), (8, "http://other.example.com/", page(8))]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i] == f"{shared}\nOwn words {i}\n{shared}"
    assert got[7] == f"{shared}\nmore of too"
    assert got[8] == f"{shared}\n{teaser}\nMore\nOwn words 8\n{shared}"


def test_shards_of_a_host_give_what_one_shard_gives(spark, monkeypatch):
    passage = "these eleven words stand on just two pages of the host"
    rows = [(i, f"http://h.com/{i}", f"<div>{' '.join(f'w{i}x{k}' for k in range(20))}</div><div>{passage if i in (4, 31) else f'single {i}'}</div><div>Short note {i // 2}</div>") for i in range(40)]
    rows += [(100 + i, u, h) for i, u, h in rows[:20]]  # fetched twice
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {r["page_id"]: r["text"] for r in extract(df).collect()}
    monkeypatch.setattr("estatelake.llm.html_text.SHARD_CHARS", 150)
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == one
    assert passage not in one[4] and passage not in one[31] and one[3] == one[103] and one[3].startswith("w3x0") and "single 3" in one[3] and "Short" not in one[3]
