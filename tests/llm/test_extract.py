import random

from hypothesis import given, settings
from hypothesis import strategies as st

from casegraph.llm.extract import blocks, common_lines, decided, extract_text, main_text


def text(page, near=None):
    return main_text(decided(page), decided(near) if near else None)


def test_article_without_the_rest():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy</div><header>Site</header>
    <article><h1>Head  line</h1><p>One &amp; two<br>three<p>Four <b>bold</b> &eacute;<form><input>Mail?</form>
    <div class="comments"><p>Nice!</p></div></article><aside>More</aside><footer>&copy; x</footer>"""
    assert text(page) == "Head line\nOne & two three\nFour bold é"


def test_unclosed_menu_ends_at_the_article():
    assert text("<nav><a>x</a><article><p>Body</article>") == "Body"


def test_comment_articles_are_no_text():
    assert text("<main><p>A</p><section id='comments'><article class='comment'><p>B</p></article></section></main>") == "A"


def test_lines_of_the_nearest_page_go_where_no_article_is_marked():
    page = "<body><div>Site name</div><div>Own words</div><div>All rights</div>"
    near = "<body><div>Site name</div><div>Other words</div><div>All rights</div>"
    assert text(page, near) == "Own words"
    assert text(page) == "Site name\nOwn words\nAll rights"


def test_empty():
    assert text("") == "" and text("<p> &nbsp; </p>") == ""


def test_common_lines():
    assert common_lines(list("xaby"), list("aqby")) == {1, 2, 3}
    assert common_lines([], ["a"]) == set()
    assert len(common_lines(list("abab" * 5), list("baba" * 5))) == 19


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = common_lines(a, b)
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(a[i] in rest for i in sorted(found))


def test_labelled_pages(spark):
    """Pages without article elements, whose own lines are known: the lines of the site go, and only they."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, expected = [], {}
    for host in range(6):
        head, foot = [" ".join(word() for _ in range(3)) for _ in range(4)], [" ".join(word() for _ in range(4)) for _ in range(3)]
        for n in range(9):
            own = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 8))]
            between = f"<div>{foot[0]}</div>" if n % 2 else ""  # a line of the site in another place
            html = "".join(f"<div>{x}</div>" for x in head) + "".join(f"<p>{x}</p>" for x in own) + between + "".join(f"<p>{x}</p>" for x in foot[1:]) + "<script>x()</script><nav>Menu</nav>"
            rows.append((host * 100 + n, f"https://h{host}.example/{'news' if n < 5 else 'about'}/{n:02d}", html))
            expected[host * 100 + n] = own + ([foot[0]] if n % 2 and n not in (3, 5, 7) else [])
    got = {r["page_id"]: r["text"].split("\n") for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), part_rows=7).collect()}
    order = {r[0]: r for r in sorted(rows, key=lambda r: r[1])}
    ids = list(order)
    for at, i in enumerate(ids):  # the plain version: the neighbour by URL, and its lines by the same longest common subsequence
        near = [ids[k] for k in (at - 1, at + 1) if 0 <= k < len(ids) and ids[k] // 100 == i // 100]
        start = lambda k: next((n for n, (x, y) in enumerate(zip(order[k][1], order[i][1], strict=False)) if x != y), 0)  # noqa: B023, E731
        best = max(near, key=start)
        lines, other = [[t for t, r in blocks(order[k][2]) if r != "aside"] for k in (i, best)]
        shared = common_lines(lines, other)
        assert got[i] == [x for k, x in enumerate(lines) if k not in shared]
        assert [x for x in got[i] if len(x.split()) == 12] == [x for x in expected[i] if len(x.split()) == 12]


def test_copies_get_one_text(spark):
    """Runs of copies and copies at far URLs of a host, over many partitions: all have the text that their first URL has."""
    site, body = "<div>Site name</div>", lambda i: f"<p>Words of page {i}</p><script>x = {i}</script>"
    rows = [(n, f"https://a.example/x/{n:02d}", site + "<p>Copied words</p>" + f"<script>n = {n}</script>") for n in range(20)]
    rows += [(20, "https://a.example/x/20", site + body(20)), (21, "https://a.example/z/1", site + "<p>Copied words</p>")]
    rows += [(22, "https://b.example/1", site + "<p>Copied words</p>"), (23, "https://b.example/2", site + "<p>Copied words</p>")]  # no other page
    rows += [(24, "https://c.example/1", site + "<p>Own</p>"), (25, "https://c.example/2", f"<div>Site name</div><article>{body(25)}</article>")]
    rows += [(26, None, site + "<p>Copied words</p>"), (None, "", site), (28, "https://a.example/x/03", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for part_rows in (1, 3, 100):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(pages, part_rows=part_rows).collect()}
        text = {i: t for i, (t, _) in got.items()}
        assert len(got) == len(rows) and all(n == len(t) for t, n in got.values())
        assert {text[n] for n in [*range(20), 21]} == {"Copied words"} and text[20] == "Words of page 20"
        assert text[22] == text[23] == text[26] == "Site name\nCopied words"
        assert text[24] == "Own" and text[25] == "Words of page 25" and text[None] == "Site name" and text[28] == ""


CARD = "<article class=card><h2>Most read</h2><p>Ten tips</p></article>"


def test_the_difference_decides_articles_that_are_marked():
    page = f"<main><p>Home of news</p><article><h1>Own head</h1><p>Shared words</p><p>Own words, many of them</p></article><p>Own note</p><p>Write to us</p>{CARD}</main>"
    near = f"<main><p>Home of news</p><article><h1>Other head</h1><p>Shared words</p><p>Other words</p></article><p>Write to us</p>{CARD}</main>"
    assert text(page, near) == "Own head\nShared words\nOwn words, many of them\nOwn note"  # an article is whole or gone
    assert text(page) == "Home of news\nOwn head\nShared words\nOwn words, many of them\nOwn note\nWrite to us\nMost read\nTen tips"
    assert text("<p>Site</p><main><h1>Head</h1><p>Shared</p><p>Own words</p></main>", "<main><p>Shared</p></main>") == "Head\nShared\nOwn words"


def test_versions_of_an_article_stay_whole():
    page = "<main><article><p>First part, which both have</p></article><article><p>Added</p></article></main>"
    assert text(page, "<article><p>First part, which both have</p></article>") == "First part, which both have\nAdded"
    assert text("<article><p>A</p></article>", "<article><p>A</p></article><p>More</p>") == "A"


def test_articles_of_a_page():
    regions, lines = decided("<p>o</p><main><p>m</p><article><p>1</p><nav>x</nav><article>1</article><p>1</p></article><article><main>2</main><p>2</p></article><p>m</p></main>")
    assert (regions, lines.split("\n")) == ("omAaaAam", ["o", "m", "1", "1", "1", "2", "2", "m"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(0, 30))
def test_common_lines_in_halves_are_as_many(a, b, matches):
    found, whole = common_lines(a, b, matches), common_lines(a, b)
    rest = iter(b)
    assert len(found) == len(whole) and all(a[i] in rest for i in sorted(found))


def test_common_lines_of_large_tables():
    rng = random.Random(3)
    a, b = (["x", *(rng.choice("01") for _ in range(20_000)), f"end {i}"] for i in range(2))  # 200 million matching pairs
    found = common_lines(a, b)
    rest = iter(b)
    assert 0.75 * 20_000 < len(found) < 20_000 and all(a[i] in rest for i in sorted(found))


def test_marked_pages_meet_their_nearest_page(spark):
    """Each page's text is the plain version's: its neighbour by host and path, in Python."""
    rng = random.Random(5)
    rows = []
    for host in range(4):
        cards = [f"<article class=card><h2>Card {host}.{k}</h2></article>" for k in range(3)]
        for n in range(12):
            own = f"<h1>Head {host}.{n}</h1><p>Common words</p>" + "".join(f"<p>Own words {rng.random()} of page {n}</p>" for _ in range(rng.randint(1, 4)))
            body = {0: f"<main><p>Site {host}</p><article>{own}</article>{cards[n % 3]}{cards[0]}</main>", 1: f"<main>{own}</main>", 2: f"<div>Site {host}</div>{own}<p>Ten tips</p>", 3: f"<div>Site {host}</div><article>{own}</article>{cards[0]}"}[rng.choice([0, 0, 1, 2, 3])]
            rows.append((host * 100 + n, f"https://h{host}.example/{'ab'[n % 2]}/{n:02d}", f"<nav>Menu {n}</nav>{body}<footer>End</footer>"))
    start = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), 0)
    order = sorted(rows, key=lambda r: r[1])
    expected = {}
    for at, (i, url, html) in enumerate(order):
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0] // 100 == i // 100]
        expected[i] = text(html, max(near, key=lambda r: start(r[1], url))[2])  # noqa: B023
    assert sum(expected[i] != text(html) for i, _, html in rows) > 20
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for part_rows in (1, 5, 100):
        assert {r["page_id"]: r["text"] for r in extract_text(pages, part_rows=part_rows).collect()} == expected
