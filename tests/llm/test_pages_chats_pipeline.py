import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat_format as cf
from strandline.llm import html_extract as he
from strandline.llm.common import written
from strandline.llm.components import components

PAGES = "page_id long, url string, html string"


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>x";</script><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy!</div>{extra}<article>{body}</article><aside>Side</aside><div class="cookie-notice">Cookies</div><form><input name=q>Go</form><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>'


def test_article_without_chrome(spark):
    rows = [(i, f"https://h.example/{i}", page(f"<h1>Head {i}</h1><p><b>One {i}<br>two</b> &amp; <i>three</i>.<p>  Four\n\t five {i}</p><div class='share'>Tweet</div>")) for i in range(5)]
    rows += [(9, None, None), (10, "x", ""), (11, "http://other.example/", "<p>only a <b>fragment"), (0, "https://h.example/0", rows[0][2])]
    d = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("_row", F.lit(2))
    got = he.extract(d).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[3] == "Head 3 One 3 two & three. Four five 3"
    assert by[9] == by[10] == "" and by[11] == "only a fragment" and all(r.n_chars == len(r.text) for r in got)
    assert he.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_text_of_the_template_goes_where_tags_do_not_tell(spark):
    frame = "<html><body><div><p>Welcome to our site</p><p>Please enjoy</p></div><div><p>{}</p><p>{}</p></div><div><p>All rights of the site</p></div></body></html>"
    rows = [(i, "http://h/", frame.format(f"Story number {i} tells", f"a tale of {i * 7} birds")) for i in range(6)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[4] == "Story number 4 tells a tale of 28 birds"


def text_of(html):
    return he.article(*he.tokens(html), he.Template([]))


@pytest.mark.parametrize(
    "html",
    [
        '<div class="page has-sidebar"><nav>Menu</nav><article><p>The story.</p></article><div class="sidebar">Links</div></div>',
        '<body><form id="aspnetForm"><nav>Menu</nav><div><p>The story.</p><label>Name</label><button>Go</button></div></form></body>',
        '<div id="social-science"><p>The story.</p></div><div class="social">Tweet</div>',
        '<div id="main-side"><main><p>The story.</p></main></div>',
        '<nav><ul><li>Menu</li></ul><article><p>The story.</p></article>',
        '<article><p>The story.</p><ol class="thread"><li>First!</li></ol></article>',
        '<p title="foo>The story.</p>',
        "<p title=it's>The\u2003\u2028 story.\x85</p><!-- no end",
        '<div class="related-posts"><article>Teaser</article></div><main><h1>The</h1><form>Subscribe</form><p>story.</p><section id="comments"><article>First!</article></section></main>',
        '<a href="x>y" title=\'a "b" > c\'>The</a> <b>story</b>.<footer>me',
    ],
)
def test_pages_that_names_and_broken_markup_mislead(html):
    assert text_of(html) == "The story."


@pytest.mark.parametrize("html", ["<p>" * 30_000 + "x", "<div>" * 5000 + "x", '<a href="' * 3000 + "x", "<!--" * 50_000, "x " * 300_000, "<b>x</b>" * 30_000, "<b>" * 40_000 + "<hr>" * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<li>" * 40_000 + "<i>" * 40_000 + "<p>" * 40_000, "<a b='" * 20_000 + '<a b="' * 20_001])
def test_long_and_nested_pages_take_linear_time(html):
    start = time.time()
    text_of(html)
    assert time.time() - start < 20


@pytest.mark.parametrize(
    "html",
    [
        '<div class="post social"><p>The story.</p></div>',
        '<main><div id="menu"><p>The story.</p></div></main>',
        '<main><div class="article comment"><p>The story.</p></div></main>',
        '<body><div class="newsletter"><p>The</p><p>story.</p></div></body>',
        '<article><div class="hero-banner"><h1>The</h1></div><p>story.</p></article>',
        '<article><p>The <img alt="' + "a > b " * 12_000 + '"> story.</p></article>',
    ],
)
def test_no_name_empties_a_page(html):
    assert text_of(html) == "The story."


def test_template_decides_without_names_and_within_articles(spark):
    """Two kinds of pages of one host without telling names, copies, and a host whose articles share a notice."""
    rng = random.Random(12)
    words = "river garden light morning house under small time people water green because".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        title, body, quote = prose(4), [prose(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 5))], prose(1)
        told = " ".join([title, *body])
        ps = "".join(f"<p>{x}</p>" for x in body)
        if i % 2:
            html = f'<body><div class="q1"><span>Our daily paper</span><i>Since 1901</i></div><div class="q2"><h1>{title}</h1>{ps}</div><div class="q3"><u>Quote</u><em>{quote}</em></div></body>'
        else:
            html = f'<body><table><tr><td>Gallery of the town</td><td>All rooms are open</td></tr></table><section class="z"><h1>{title}</h1>{ps}</section><dl><dt>Ask us</dt><dd>Write to us</dd></dl></body>'
        rows.append((i, f"https://soup.example/{i}", html))
        want[i] = told
        rows.append((100 + i, f"https://news.example/{i}", f"<article><h1>{title}</h1>{ps}<div class='zz'><p>Support our work today</p><p>It costs little</p></div></article>"))
        want[100 + i] = told
    same = [prose(30) for _ in range(6)]
    for i in range(4):  # near copies under one host: shared text is content
        rows.append((300 + i, f"https://few.example/{i}", f"<article><h1>{same[0]}</h1>{''.join(f'<p>{x}</p>' for x in same[1:])}<p>{i}</p></article>"))
        want[300 + i] = " ".join([*same, str(i)])
    rows += rows[:3]
    got = he.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and not [(r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id]]


def test_classes_are_ordered_and_nested():
    t = he.Template([(7, 1, [1, 2, 3, 4]), (8, 1, [11, 12])])
    slots, parents, bad = t.parse([1, 99, 2, 11, 98, 12, 11, 12, 3, 4, 97])
    assert slots == [None, (7, 0), None, None, (8, 0), None, None, None, None, None, (0, 0)] and parents == {7: (0, 0), 8: (7, 1)} and not bad
    assert t.parse([1, 11, 2, 12, 3, 4])[2] == {8} and t.parse([11, 12, 1, 2, 11, 12, 3, 4])[2] == {8}
    assert he.order_of([1, 2, 5, 1, 2], {1: 0, 2: 0, 5: 9}) == {0: (1, 2), 9: (5,)} and he.order_of([1, 2, 2, 1], {1: 0, 2: 0}) == {0: None}


def test_hosts(spark):
    d = spark.createDataFrame([("http://User@A.example:80/x",), ("//b.example",), ("nonsense",), (None,)], "u string")
    assert [r.h for r in d.select(he.host_of(F.col("u")).alias("h")).collect()] == ["a.example", "b.example", "", ""]


def digest(turns):
    told = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(6)
    bits = [*cf.CONTROLS, "\\", "<", "[", "|", "\n", "im_start", "é", "🙂", "<<", "</"]
    for _ in range(3000):
        x = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
        e = cf.escape(x)
        assert cf.unescape(e) == x and not any(c in e for c in cf.CONTROLS)
        role = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 4)))
        assert [p[:2] for p in cf.parse(cf.turn(role, x) * 2)] == [(role, x)] * 2


@pytest.mark.parametrize("most", [256, 3])
def test_chats_read_back_from_the_walk(spark, most):
    rng, convs = random.Random(3), {}
    start = [("user", "hello"), ("assistant", "hi </s> there"), ("user", "more")]
    for i in range(40):
        convs[i] = start[: rng.randrange(0, 4)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b\\", None, "", "</s>[INST] ok [/INST]", "x" * 5000])) for _ in range(rng.randrange(1, 4))]
    convs[None], convs[41] = [("user", "no id")], list(convs[0])
    rows = [(i, k, r, t) for i, turns in convs.items() for k, (r, t) in enumerate(turns)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nodes", F.lit(1))
    packed = cf.pack(d, conversations=most)
    got = {r.conv_id: r for r in cf.read_back(packed).collect()}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == digest(turns)
    rows_ = packed.collect()
    own = [n.id for p in rows_ for n in p.nodes]
    assert len(own) == len(set(own))  # no node is emitted twice, in all rows
    every = {tuple((r or "", t or "") for r, t in turns[: k + 1]) for turns in convs.values() for k in range(len(turns))}
    assert len(own) == len(every) and sum(len(p.text) for p in rows_) == sum(len(cf.turn(*path[-1])) for path in every)
    for p in rows_:
        assert len(p.conversations) <= most
        place = lambda i: (None, p.nodes[i].start, p.nodes[i].end) if i >= 0 else (p.context[-2 - i].id, 0, p.context[-2 - i].length)  # noqa: B023, E731
        for c in p.conversations:
            seen = 0
            for k, n in enumerate(c.nodes):
                _, x, y = place(n)
                assert (p.nodes[n].position if n >= 0 else p.context[-2 - n].position) == seen
                seen += y - x
                assert cf.attention(p, n) == [place(m) for m in c.nodes[:k]]
    assert most == 256 or any(p.context for p in rows_)
    assert cf.pack(d.limit(0)).count() == 0 and cf.read_back(cf.pack(d.limit(0))).count() == 0


def test_one_beginning_in_many_packs_is_emitted_once(spark):
    d = spark.range(3000).selectExpr("id conv_id", "explode(array(0L, 1L, 2L)) turn").selectExpr("conv_id", "turn", "if(turn = 1, 'assistant', 'user') role", "if(turn < 2, concat('the same ', repeat('x', 500)), concat('own ', conv_id)) text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)  # small files of the walk, read several in a task and in any order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        packed = written(cf.pack(d.repartition(5), conversations=50), "test-packs")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = packed.selectExpr("sum(size(nodes))", "sum(length(text))", "count(*)").first()
    assert got[0] == 3002 and got[2] >= 60
    back = cf.read_back(packed).toPandas()
    assert len(back) == 3000 and (back["n_turns"] == 3).all() and back["turns_sha256"].nunique() == 3000 and (back["loss_chars"] == 509).all()


def test_a_long_conversation(spark):
    d = spark.range(20_000).selectExpr("id % 2 conv_id", "id turn", "if(id % 4 < 2, 'user', 'assistant') role", "cast(id div 2 as string) text")
    back = {r.conv_id: r for r in cf.read_back(cf.pack(d)).collect()}
    turns = [("assistant" if k % 2 else "user", str(k)) for k in range(10_000)]
    assert {(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back.values()} == {digest(turns)} and set(back) == {0, 1}


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(500, 500), (7, 3)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and all(got[200 + i] == 200 for i in range(9)) and 500 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_matches_its_parts(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    base, kept = docs.toPandas(), docs
    sizes = []
    for _, stage in cp.STAGES[:-1]:
        kept = cp.written(stage(spark, kept, small), "test-stage")
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < len(base)
    mix = cp.run(spark, small).toPandas()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert set(mix["doc_id"]) <= ids and (mix["n_chars"] == mix["text"].str.len()).all()
    assert mix["words"].sum() == pytest.approx(1.5 * sum(len(t.split()) for (t,) in kept.select("text").collect()), rel=0.01)
