from ledgerlens.llm.dom import align, parse
from ledgerlens.llm.extract import extract_text

SCHEMA = "page_id long, url string, html string"


def page(n, body):
    return (
        f"<html><head><title>T {n}</title><script>var x='<p>no</p>';</script></head><body class='page has-sidebar'>"
        f"<header><a href='/'>Site</a></header><div class='wrap'><div class='col'>{body}</div>"
        f"<div class='meta'>Posted under things</div></div><footer>&copy; all</footer></body></html>"
    )


def texts(spark, rows, columns=SCHEMA):
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, columns)).collect()}


def test_article_roles_references_and_white_space(spark):
    html = (
        "<!DOCTYPE html><body><nav><li>menu</nav><div class='ad'>buy</div><article><header><h1>A &amp; B</h1></header>"
        "<p>first <b>bold\n  text<br><p>x &lt; y&nbsp;z</p><!-- no --><aside>side</aside><form>f</form>"
        "<style>p{}</style><div id='comments'><p>reader</p></div></article><footer>foot</footer>"
    )
    assert texts(spark, [(1, "http://h.example/1", html)]) == {1: "A & B\nfirst bold text\nx < y z"}


def test_constant_slots_become_template_without_article(spark):
    rows = [
        (n, f"https://h.example/{n}", page(n, f"<p>Story {n} told once</p><p>Read more stories here</p><p>End {n}</p>"))
        for n in range(8)
    ]
    assert texts(spark, rows) == {n: f"Story {n} told once\nEnd {n}" for n in range(8)}


def test_copies_of_an_article_stay(spark):
    rows = [(n, "http://h.example/a", "<body><article><p>same text</p></article></body>") for n in range(6)]
    assert set(texts(spark, rows).values()) == {"same text"}


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, None, "<p>no url</p>", "e"),
        (2, "http://h.example/", None, "e"),
        (3, "http://h.example/", "", "e"),
        (4, "nonsense", "<p>unclosed <b>tag", "e"),
        (None, "http://h.example/", "<p>no id</p>", "e"),
        (5, "http://x.example/", deep, "e"),
        (6, "http://x.example/", "a < b <p>" + "long " * 50_000, "e"),
        (6, "http://x.example/", "a < b <p>" + "long " * 50_000, "e"),
    ]
    out = extract_text(spark.createDataFrame(rows, SCHEMA + ", text string")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    assert got[1]["text"] == "no url" and got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "unclosed tag"
    assert got[None]["text"] == "no id" and got[5]["text"] == "deep"
    assert got[6]["n_chars"] == len("a < b\n" + "long " * 50_000) - 1
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simple_tree_matching_skips_an_inserted_subtree():
    seed, _ = parse("<div><ul><li>a<li>b</ul><section><p>x</p></section><p>y</p></div>")
    other, _ = parse("<div><ul><li>a</ul><table><tr><td>q</td></tr></table><section><p>x</p><p>z</p></section><p>y</p></div>")
    found = align(other, seed)
    tags = {}

    def walk(node, into):
        into[node.number] = node.tag
        for kid in node.kids:
            walk(kid, into)

    walk(other, tags)
    seeds = {}
    walk(seed, seeds)
    assert all(tags[a] == seeds[b] for a, b in found.items())
    assert sorted(tags[a] for a in found) == sorted(["", "div", "ul", "li", "section", "p", "p"])


def test_elements_deeper_than_the_aligned_tree(spark):
    down, up = "<div>" * 200, "</div>" * 200
    rows = [
        (1, None, f"<div><article><p>first</p>{down}deep{up}<p>rest</p></article></div><p>outside</p>"),
        (2, None, f"{down}<nav>menu</nav><div class='comments'><p>reader</p></div><p>story</p>{up}<p>end</p>"),
        (3, None, f"{down}<article><p>told</p></article><p>views</p>{up}"),
    ]
    rows += [(n, "http://d.example/", f"{down}<article><p>Told only once {n}</p></article><p>{n}</p>{up}") for n in range(10, 15)]
    expected = {1: "first\ndeep\nrest", 2: "story\nend", 3: "told"} | {n: f"Told only once {n}" for n in range(10, 15)}
    assert texts(spark, rows) == expected


def test_a_text_repeated_on_one_page_is_no_template(spark):
    body = "<p>Story {0} told once</p><p>End {0}</p>"
    cells = "<table><tr>" + "<td>Yes</td>" * 6 + "</tr></table>"
    rows = [(n, f"http://t.example/{n}", page(n, body.format(n) + (cells if n == 7 else ""))) for n in range(10)]
    got = texts(spark, rows)
    assert got[7] == "\n".join(["Story 7 told once", "End 7", *["Yes"] * 6])
    assert got[3] == "Story 3 told once\nEnd 3"


def test_odd_quotes_take_linear_time():
    import time

    from ledgerlens.llm.dom import parse

    for page in ('<a "' * 250_000, "<a <b" * 200_000, "<!" * 500_000, '<p x="' * 150_000 + ">", "<p>kept</p>" + "<b '" * 250_000):
        start = time.perf_counter()
        parse(page)
        assert time.perf_counter() - start < 4
    _, blocks = parse("<article><p title='x>one</p><p>two \" three</p></article>")
    assert "three" in " ".join(b.text for b in blocks)


def test_ids_and_compound_classes_inside_an_article_keep_their_text():
    from ledgerlens.llm.dom import parse

    page = (
        '<article><h2 id="Social_structure">Social structure</h2><p class="notice-period">A notice period.</p>'
        '<section id="search-methods"><p>Searching.</p></section><div class="related-links">gone</div>'
        '<div class="comment-list"><p>gone</p></div><div class="newsletter-signup">gone</div></article>'
    )
    kept = [b.text for b in parse(page)[1] if not b.node.boilerplate]
    assert kept == ["Social structure", "A notice period.", "Searching."]
