from epigrain.llm import html_text as ht


def text(source):
    return " ".join(ht.parse(source))


def test_structure():
    assert text("<p>a <b>b</b>c&amp;d&nbsp; e<br>f") == "a bc&d e f"
    assert text("<nav>m</nav><header>h</header><main><header><h1>T</h1></header><p>x</main><aside>s</aside><footer>f</footer>") == "T x"
    assert text("<div>outside</div><article><p>in<p>side<div class='post-comments'>no</div></article>") == "in side"
    assert text('<div class="cookie-notice">c</div><div id="ad-1">a</div><p hidden>h</p><p>ok</p><form>f</form>') == "ok"
    assert text("<script>var a='<p>x</p>';</script><style>p{}</style><!-- <p>c</p> --><p>y") == "y"
    assert text('<p title="a > b">q</p><p class=\'x>y\'>r') == "q r"
    assert text(None) == text("") == ""
    assert text("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>") == "one two a b"
    assert text("1 < 2 and <3") == "1 < 2 and <3"
    assert len(text("<p>" + "long " * 100_000)) == 5 * 100_000 - 1


def test_wrappers_are_no_side_matter():
    story = " ".join(f"told{i}" for i in range(60))
    for name in ('class="layout with-sidebar"', 'class="no-banner"', 'class="long-form"', 'id="form"'):
        assert text(f'<div {name}><p>{story}</p><div class="sidebar">aside</div></div><footer>f</footer>') == story
        assert text(f'<div {name}><article><p>short</p></article></div><p class="ad">{story}</p><nav>m</nav>') == "short"
    assert text(f'<form id="aspnetForm"><nav>{story}</nav><div><p>{story}</p></div></form>') == story
    assert text(f'<main><p>{story}</p><article class="card">A teaser</article></main><p>out</p>') == f"{story} A teaser"
    assert text(f'<main><p>{story}</p></main><div class="related"><article>A teaser</article></div>') == story
    assert text("".join(f'<div class="elementor-widget"><p>{story} {i}</p></div>' for i in range(9))).count("told0") == 9
    assert text('<p>foo<b>bar</b> baz<span class="share">x</span>qux ' + story) == "foobar bazqux " + story


def test_what_is_never_closed_takes_no_text_along():
    for tag in ht.FILLED:
        assert text(f"<article><p>before</p><{tag} src=x><p>after</p></article>") == "before after"
        assert text(f"<article><p>before</p><{tag}>fallback</{tag}><p>after</p></article>") == "before after"
        assert text(f"<article><{tag} a><p>one</p><{tag}>fallback</{tag}><p>two</p></article>") == "one two"
    assert text("<p>a<script>x") == "a" and text("<p>a<!-- x <b>") == "a" and text("a <b c") == "a <b c"


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    start = time.perf_counter()
    assert text('<div class="a">word ' * 30_000).count("word") == 30_000
    assert text('<div class="ad"><p>word ' * 5_000).strip() is not None
    assert text('<a b="' * 100_000) is not None and text("<video>x<p>" * 30_000) and text("</x>" * 50_000 + "<b>" * 20_000 + "y") == "y"
    assert time.perf_counter() - start < 30


def test_subtrees_are_told_by_their_text():
    _, one = ht.marked("<div><p>a</p><p>b</p></div>")
    _, two = ht.marked("<div>\n<p>x</p><div><p>a</p> <p></p><p>b</p></div></div>")
    _, other = ht.marked("<div><p>ab</p></div><div><p>b</p><p>a</p></div><ul><p>a</p><p>b</p></ul>")
    div = {h for h, _, _, a, b in one if b - a == 2}
    assert div & {h for h, *_ in two} and not (div - {one[0][0]}) & {h for h, *_ in other}


def site(n, host):
    return [
        (i, f"http://{host}/p{i}", f"<body><div><p>Our site says hello</p><p>Find us there</p></div><div><p>Story {i} of {host}, told once.</p><p>Shared by two: {i // 2}.</p></div></body>")
        for i in range(n)
    ]


def test_templates_go_by_host(spark, monkeypatch):
    rows = site(12, "a.example") + [(100 + i, "http://b.example/", h) for i, _, h in site(2, "b.example")]
    rows += [(200 + i, "http://c.example/", "<p>One page copied many times</p>") for i in range(20)]
    rows += [(300, None, None), (301, "http://a.example/", ""), (5, "http://a.example/x", "<p>same id again</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    shared = ht.extract(pages)
    monkeypatch.setattr(ht.with_cuts, "__defaults__", (0,))
    joined = ht.extract(pages)
    got = sorted((tuple(r) for r in shared.collect()), key=repr)
    assert got == sorted((tuple(r) for r in joined.collect()), key=repr)
    texts = {(r[0], r[1]): r[2] for r in got}
    assert texts[3, "http://a.example/p3"] == "Story 3 of a.example, told once. Shared by two: 1."
    assert texts[100, "http://b.example/"].startswith("Our site says hello Find us there Story")
    assert texts[200, "http://c.example/"] == "One page copied many times"
    assert texts[300, None] == texts[301, "http://a.example/"] == "" and texts[5, "http://a.example/x"] == "same id again"
    assert all(r[3] == len(r[2]) for r in got) and len(got) == len(rows)
    assert ht.extract(pages.limit(0)).count() == 0


def test_templates_of_a_layout_and_near_copies(spark):
    def page(i, layout, extra=""):
        return f'<div class="{layout}"><div class="about">Text of layout {layout} here.</div>{extra}<p>Entry {i} of {layout} is told in these words.</p></div>'

    rows = [(i, page(i, "wiki")) for i in range(60)] + [(100 + i, page(i, "shop")) for i in range(6)]
    links = '<ul><li><a href="/a">All offers of the day</a></li></ul> Now: '
    rows += [(200 + i, page(i, "wiki", links + str(i)).replace("of wiki is", "linked")) for i in range(6)]
    copy = "<article><p>One story that many pages of this host tell again and again, word for word, whatever the counter below says of its readers.</p><p>seen {} times</p></article>"
    rows += [(300 + i, copy.format(i)) for i in range(8)]
    pages = spark.createDataFrame([(i, "http://a.example/", h) for i, h in rows], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert texts[3] == "Entry 3 of wiki is told in these words."
    assert texts[103] == "Entry 3 of shop is told in these words."
    assert texts[203] == "Now: 3 Entry 3 linked told in these words."
    assert texts[303].startswith("One story")


def test_templates_match_a_recount_by_hand(spark):
    """Blocks that a recount of all subtrees of all pages finds under templates are those that go."""
    from collections import defaultdict

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()] + [(10**6 + i, u, h) for i, u, h in site(12, "a.example")]
    found = {i: (ht.host_of(u), *ht.marked(h)) for i, u, h in rows}
    of, on, sides, at, having = (defaultdict(set) for _ in range(5))
    read, rows_of = set(), defaultdict(int)
    for host, blocks, marks in found.values():
        page = ht.same_page(blocks)
        of[host].add(page)
        for h, place, side, a, b in marks:
            rows_of[host, h] += 1
            on[host, h].add(page)
            at[host, h, place].add(page)
            having[host, place].add(page)
            if side:
                sides[host, h].add(page)
            if a < b:
                read.add((host, h))
    cut = {k for k in read if len(on[k]) >= ht.TEMPLATE_PAGES and (len(on[k]) >= ht.TEMPLATE_SHARE * len(of[k[0]]) or 2 * len(sides[k]) > len(on[k]))}
    cut |= {(g, h) for (g, h, p), seen in at.items() if (g, h) in read and len(seen) >= ht.TEMPLATE_PAGES and len(seen) >= ht.TEMPLATE_SHARE * len(having[g, p])}
    want = {}
    for i, (host, blocks, marks) in found.items():
        gone = {k for h, _, _, a, b in marks if (host, h) in cut for k in range(a, b)}
        want[i] = " ".join(t for k, t in enumerate(blocks) if k not in gone)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(frame).collect()} == want and cut
