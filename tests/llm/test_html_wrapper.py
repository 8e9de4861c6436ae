import random
import resource
import time

from panelforge.llm import html_wrapper
from tests.llm import edge

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>
<script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>
<div class="cookie-notice">Cookies!</div><div class="ad">Buy</div><form><p>Search</p></form>
<article><h1>Head &amp; {k}</h1><p>One <b>bold</b>{k}<br>next<p>Two &eacute;\n  three
<div id="comments"><p>reader says</p></div></article>
<aside>Related</aside><footer>&copy; us</footer></body></html>"""


def test_article_without_boilerplate(spark):
    rows = [(k, "http://h.example/x", PAGE.format(k=k)) for k in range(300)]
    rows += [(300, None, None), (301, "http://h.example/e", ""), (302, "x", "<p>a<p>b")]
    pages = edge.clash(spark.createDataFrame(rows, edge.PAGES), "text", "n_chars")
    found = html_wrapper.extract(pages, group=50)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == 303
    for k in range(300):
        assert got[k].text == f"Head & {k}\nOne bold{k} next\nTwo é three"
        assert got[k].n_chars == len(got[k].text)
    assert got[300].text == got[301].text == "" and got[302].text == "a\nb"
    assert html_wrapper.extract(pages.limit(0)).count() == 0


def test_constant_nodes_are_template_and_varying_slots_content():
    pages = [
        f"<body><div>Welcome here</div><div><p>story {k}</p><p>more {k * k}</p></div>"
        f"<div>All rights kept</div></body>"
        for k in range(9)
    ]
    assert html_wrapper.extract_group(pages)[3] == "story 3\nmore 9"
    # too few different pages give no evidence, copies count once
    assert html_wrapper.extract_group([pages[3]] * 9)[0].startswith("Welcome here")


def numbered(*pages):
    forest = html_wrapper.Forest()
    trees = [html_wrapper.parse(p) for p in pages]
    for tree in trees:
        forest.add(tree)
    return forest, trees


def test_simple_tree_matching_by_example():
    forest, (a, b) = numbered(
        "<div><p>1</p><ul><li>x</ul><p>2</p></div>",
        "<div><ul><li>x<li>y</ul><h1>0</h1><p>2</p></div>",
    )
    pairs = forest.pairs(a, b)
    assert sorted(x.tag for x, _ in pairs) == ["#root", "div", "li", "p", "ul"]
    assert all(x.tag == y.tag for x, y in pairs)


def plain_weight(a, b):
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.below) + 1) for _ in range(len(a.below) + 1)]
    for i, x in enumerate(a.below):
        for j, y in enumerate(b.below):
            both = table[i][j] + plain_weight(x, y)
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], both)
    return 1 + table[-1][-1]


def random_page(rng, depth=4):
    tag = rng.choice(["div", "section", "h2"])
    below = "".join(random_page(rng, depth - 1) for _ in range(rng.randint(0, depth)))
    return f"<{tag}>{rng.choice('ab')}{below}</{tag}>"


def test_matching_equals_the_plain_recursion():
    rng = random.Random(3)
    for _ in range(300):
        pages = ["".join(random_page(rng) for _ in range(rng.randint(1, 5))) for _ in range(2)]
        forest, (a, b) = numbered(*pages)
        pairs = forest.pairs(a, b)
        assert len(pairs) == plain_weight(a, b) == forest.weight(a.shape, b.shape)
        where = {id(n): k for k, n in enumerate(forest.add(a))}
        after = {id(n): k for k, n in enumerate(forest.add(b))}
        places = sorted((where[id(x)], after[id(y)]) for x, y in pairs)
        assert len({x for x, _ in places}) == len({y for _, y in places}) == len(places)
        assert places == sorted(places, key=lambda p: p[1])
        matched = {(id(x), id(y)) for x, y in pairs}
        for x, y in pairs:  # parents of matched nodes are matched
            assert x is a or (id(x.parent), id(y.parent)) in matched


def table_page(rows, columns, rng=None):
    cells = ("a", "<p>b</p>", "<ul><li>c</ul>")
    body = "".join(
        "<tr>" + "".join(f"<td>{rng.choice(cells) if rng else k * j}" for j in range(columns))
        for k in range(rows)
    )
    return f"<body><table>{body}</table><p>{rows}</p>"


def test_wide_tables_take_seconds_and_little_memory():
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    rng = random.Random(4)
    pages = [table_page(100 + k, 100) for k in range(6)]
    pages += [table_page(45, 45, rng) for _ in range(3)]
    found = html_wrapper.extract_group(pages)
    assert all(text.count("\n") >= 45 * 45 for text in found)
    assert time.monotonic() - start < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


ARTICLE = """<body><article><header><h1>Story {k}</h1></header><div>Sign the petition</div>
<p>{text}</p><p>{more}</p><div>Read on in our shop</div></article></body>"""


def words(rng, count):
    return " ".join(f"w{rng.randint(0, 999)}" for _ in range(count))


def test_constant_nodes_inside_articles_are_template():
    rng = random.Random(5)
    told = [(k, words(rng, 30), words(rng, 20)) for k in range(8)]
    pages = [ARTICLE.format(k=k, text=t, more=m) for k, t, m in told]
    found = html_wrapper.extract_group(pages)
    assert found == [f"Story {k}\n{t}\n{m}" for k, t, m in told]


def test_copied_articles_are_no_template():
    rng = random.Random(6)
    text, more = words(rng, 30), words(rng, 20)
    # copies and near copies of one article on pages that differ around it
    pages = [
        f"<body><div>{words(rng, 9)}</div>" + ARTICLE.format(k=k, text=text, more=more)
        for k in range(8)
    ]
    for k, found in enumerate(html_wrapper.extract_group(pages)):
        lines = found.split("\n")
        assert lines == [f"Story {k}", "Sign the petition", text, more, "Read on in our shop"]


def test_names_mark_boilerplate_only_as_a_whole():
    page = """<title>T</title><body><article><h1 class="entry-header">Head</h1>
<p class="ad-hoc">one</p><p id="share-prices">two</p><p class="related-work">three</p>
<p><math>x</math></p><div class="post-header">four</div><div class="ad-slot-2">Buy</div>
<div class="cookie-notice">Eat</div><div class="lead user-comments">First!</div>
</article><div class="site-header">Menu</div>"""
    assert html_wrapper.extract_group([page]) == ["Head\none\ntwo\nthree\nx\nfour"]


def test_groups_by_bytes_and_null_ids(spark):
    rows = [(k if k % 3 else None, "http://h.example/", f"<p>{k} " + "x" * 999) for k in range(60)]
    pages = spark.createDataFrame(rows, edge.PAGES)
    found = html_wrapper.extract(pages, group_bytes=5000).collect()
    assert sorted(r.text for r in found) == sorted(r[2][3:] for r in rows)


def test_long_child_lists_and_deep_trees():
    long = "<body>" + "".join(f"<p>{k}</p>" for k in range(3000)) + "</body>"
    deep = "<body>" + "<div>" * 400 + "in" + "</div>" * 400 + "</body>"
    found = html_wrapper.extract_group([long, long + "x", deep, "<p>a", "<p>b", "<p>c"])
    assert found[0].count("\n") == 2999 and found[2] == "in"


def test_trees_of_any_depth():
    depth = 5000
    blocks = ["<body>" + "<div>" * depth + f"in {k}" + "</div>" * depth for k in range(3)]
    inline = ["<body><p>" + "<b>" * depth + f"bold {k}" for k in range(3)]
    article = ["<body>" + "<section>" * depth + f"<article>a {k}</article>" for k in range(2)]
    found = html_wrapper.extract_group(blocks + inline + article)
    assert found == [*(f"in {k}" for k in range(3)), *(f"bold {k}" for k in range(3)), "a 0", "a 1"]
