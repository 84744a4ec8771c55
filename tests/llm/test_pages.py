"""Extraction of pages by their hosts' templates."""

import html
import random
import re

import pytest

from lectorium.llm import wrapper


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<div id=main><p>a &lt;b&gt;<p>c</div><div class='comments'><p>no</p></div>", "a <b> c"),
        ("<article><header><h1>T</h1></header><p>one<br>two</p><footer>f</footer><section id='comments'><p>c</p></section><form>q</form></article><p>no</p>", "T one two"),
        ("<body><ul class='menu'><li>no</ul><table><tr><td>1<td>2</table><!-- x -->\n<p>q  r\n s</p><script>if(a<b){'</p>'}</script>after", "1 2 q r s after"),
        ("<article><p><b>un closed<br><p>next</article>", "un closed next"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>x</p></article><p>no</p>", "deep x"),
        ("<article><p>a<!-- never closed", "a"),
        ("<article><p>x <em>y</em>z&nbsp;w</p></article>", "x yz w"),
        ("<div class='content with-sidebar'><article class=post><div class=post-header><h1>T</h1></div><p>x</p></article><div class=sidebar>no</div></div>", "T x"),
        ("<article><p>x</p><div class='cookie-notice'>no</div><div class='ad-slot'>no</div></article><div class=sidebar><article>teaser</article></div>", "x"),
        ("<div role=navigation>no</div><div hidden>no</div><p>yes</p><aside>no</aside>", "yes"),
    ],
)
def test_pages(page, expected):
    assert wrapper.extract(page, None) == expected


def tree(k, *children, text=""):
    return [k, 1, text, [], 0, 0, list(children)]


def test_simple_tree_matching():
    a = tree("a", tree("b"), tree("c", tree("e"), tree("f")), tree("d"))
    b = tree("a", tree("c", tree("f")), tree("b"), tree("d"))
    assert wrapper.matching(a, b) == 4  # a, c, f, d
    assert wrapper.align(a[wrapper.C], b[wrapper.C]) == [(1, 0), (2, 2)]
    assert wrapper.matching(tree("x"), a) == 0


def brute(x, y):
    """The best of all order-keeping mappings, by trying them."""
    if x[0] != y[0]:
        return 0

    def lists(a, b):
        if not a or not b:
            return 0
        return max(lists(a[1:], b), lists(a, b[1:]), (brute(a[0], b[0]) + lists(a[1:], b[1:])) if a[0][0] == b[0][0] else 0)

    return 1 + (x[2] == y[2] != "") + lists(x[6], y[6])


def grown(r, depth):
    return tree(r.choice("aab"), *(grown(r, depth - 1) for _ in range(r.randint(0, 4 if depth else 0))), text=r.choice(["", "t", "u", "v"]))


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_the_best_of_all_mappings(seed):
    r = random.Random(seed)
    x, y = grown(r, 2), grown(r, 2)
    y[0] = x[0]
    assert wrapper.matching(x, y) == brute(x, y)
    pairs = wrapper.align(x[6], y[6])
    assert all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))
    assert wrapper.matching(x, y) == 1 + (x[2] == y[2] != "") + sum(brute(x[6][i], y[6][j]) for i, j in pairs)


def test_long_lists_are_aligned_by_their_equal_texts(monkeypatch):
    r = random.Random(3)
    a = [tree(r.choice("pq"), text=f"x{i}") for i in range(300)]
    b = [x for x in a if r.random() < 0.8]
    monkeypatch.setattr(wrapper, "CELLS", 100)
    pairs = wrapper.align([tree("h"), *a], [tree("h"), tree("h"), *b])
    assert len(pairs) == len(b) + 1 and all(a[i - 1] is b[j - 2] for i, j in pairs[1:])


WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper larch maple oak pine rowan spruce".split()


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def host_pages(build, n=8, seed=1):
    """(page, its expected text) of n pages of a host; and the template of all."""
    r = random.Random(seed)
    made = [build(r, i) for i in range(n)]
    template = None
    for page, _ in made:
        one = wrapper.shape(wrapper.parse(page))
        template = one if template is None else wrapper.fold(template, one)
    return made, template


def bare(r, i):
    title, body = f"{words(r, 4)} {i}", [words(r, r.randint(8, 60)) for _ in range(r.randint(2, 7))]
    links = "".join(f"<li><a href=/>{words(r, 1)}</a>" for _ in range(5))
    page = f"<body><div><ul>{links}</ul></div><div>{words(r, 6)}</div><div><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>&copy; {words(r, 3)}</div></body>"
    return page, " ".join([title, *body])


def with_siblings(r, i):
    body = [f"{words(r, r.randint(5, 30))} {i}" for _ in range(r.randint(2, 5))]
    return f"<article><p>Share this story</p>{''.join(f'<p>{b}</p>' for b in body)}<p>Follow us for more</p></article>", " ".join(body)


def long_boilerplate(r, i):
    body = f"{words(r, 12)} {i}"
    return f"<body><div><p>{'All rights are reserved by the owners of this site. ' * 20}</p></div><div><p>{body}</p><p>{i} {words(r, 5)}</p></div></body>", None


@pytest.mark.parametrize("build", [bare, with_siblings])
def test_the_template_decides(build):
    """Varying menus, adverts and footers without tags or names that say so, and constant siblings of the text."""
    made, template = host_pages(build)
    for page, expected in made:
        assert wrapper.extract(page, template) == expected
        assert wrapper.extract(page, None) != expected


def test_boilerplate_that_is_the_longest_text():
    made, template = host_pages(long_boilerplate)
    for page, _ in made:
        got = wrapper.extract(page, template)
        assert "reserved" in wrapper.extract(page, None) and "reserved" not in got and got in " ".join(re.sub("<[^>]+>", " ", page).split())


def paper(r, i):
    parts = [("Introduction", words(r, 30)), ("Discussion", words(r, 40)), ("Related work", words(r, 20))]
    page = (
        f"<article><h1>{words(r, 3)} {i}</h1><h2>Introduction</h2><p>{parts[0][1]}</p><section class='discussion'><h2 id='discussion'>Discussion</h2><p>{parts[1][1]}</p></section>"
        f"<section class='related-work'><h2>Related work</h2><p>{parts[2][1]}</p></section><div class='form-factor'><p>Form {i}</p></div>"
        f"<section class='related'><h2>Related</h2><ul><li><a href=/>{words(r, 5)}</a><li><a href=/>{words(r, 5)}</a></ul></section><section class='comments'><h2>Comments</h2><p>{words(r, 50)}</p></section></article>"
    )
    title = re.search("<h1>(.*?)</h1>", page)[1]
    return page, " ".join([title, *(f"{h} {t}" for h, t in parts), f"Form {i}"])


def test_names_that_articles_use_too_need_the_template():
    made, template = host_pages(paper)
    for page, expected in made:
        assert wrapper.extract(page, template) == expected
    assert wrapper.extract("<body><div class='post-form'><p>only this</p></div></body>", None) == "only this"


@pytest.mark.parametrize("name", ["search", "pagination", "navigation", "login", "sharing", "menu", "social", "modal", "overlay"])
def test_topics_of_articles(name):
    """A section of an article that a host's pages fill each in its own way stays, whatever it is called; comments, adverts and forms go, and so does a box that is the same everywhere."""
    prose = lambda i, what: f"About {what} {i}: " + " ".join(f"w{i * 31 + k}" for k in range(20)) + "."
    page = lambda i: (
        f"<html><body><div class=menu><a href=x>Home</a></div><article><h1>Title {i}</h1><p>{prose(i, 'it')}</p><section id={name}><p>{prose(i, name)}</p></section>"
        f"<div class=comments><p>{prose(i, 'what I think')}</p></div><div class=ad>{prose(i, 'a sale')}</div><form>{i} mail</form></article><div class={name}>{prose(i, 'outside')}</div></body></html>"
    )
    template = None
    for i in range(10):
        one = wrapper.shape(wrapper.parse(page(i)))
        template = one if template is None else wrapper.pruned(wrapper.fold(template, one))
    for i in range(10):
        assert wrapper.extract(page(i), template) == f"Title {i} {prose(i, 'it')} {prose(i, name)}"
    boxed = [page(i).replace(prose(i, name), "The same words on every page of this host.") for i in range(10)]
    template = None
    for text in boxed:
        one = wrapper.shape(wrapper.parse(text))
        template = one if template is None else wrapper.pruned(wrapper.fold(template, one))
    assert wrapper.extract(boxed[3], template) == f"Title 3 {prose(3, 'it')}"


@pytest.mark.parametrize(("attribute", "stays"), [('title="a hidden gem"', True), ('data-note="not hidden at all"', True), ("data-hidden", True), ("hidden", False), ('hidden=""', False), ("class=x hidden/", False), ('HIDDEN title="x"', False)])
def test_hidden_is_an_attribute(attribute, stays):
    assert wrapper.extract(f"<article><p>one</p><p {attribute}>two</p></article>", None) == ("one two" if stays else "one")


def test_copies_are_no_template():
    """Pages of a host that are near copies keep their text."""
    r = random.Random(2)
    body = [words(r, 40) for _ in range(6)]
    pages = ["<article>" + "".join(f"<p>{b}{f' {i}' if n < 3 else ''}</p>" for n, b in enumerate(body)) + "</article>" for i in range(5)]
    template = None
    for page in pages:
        one = wrapper.shape(wrapper.parse(page))
        template = one if template is None else wrapper.fold(template, one)
    assert [len(wrapper.extract(p, template)) for p in pages] == [len(" ".join(body)) + 6] * 5


def test_templates_are_bounded():
    page = "<body>" + "".join(f"<div><p>a{i}</p><p>same</p></div>" for i in range(2000)) + "</body>"
    template = wrapper.pruned(wrapper.fold(wrapper.shape(wrapper.parse(page)), wrapper.shape(wrapper.parse(page.replace("a1", "b1")))))
    count = lambda t: 1 + sum(map(count, t[wrapper.C]))
    assert 1 < count(template) <= wrapper.NODES
    assert len(wrapper.extract(page, template).split()) == 4000


def test_templates_beyond_a_broadcast(spark):
    """Grouped with their host's pages, the largest host over several groups, templates give the same."""
    made, _ = host_pages(bare, 40)
    rows = [(i, f"https://h{i % 7 and 1}.example/{i}", page) for i, (page, _) in enumerate(made)] + [(99, None, None), (99, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert sorted(wrapper.main_text(pages, most=0, group=4000).collect()) == sorted(wrapper.main_text(pages).collect())
    assert wrapper.main_text(pages.limit(0), most=-1).count() == 0


def test_constant_nodes_become_template(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div class=top><p>Welcome here</p></div><div class=body><h2>Title {i}</h2><p>Text number {i} of many words {'x' * i}</p></div><div class=end>All rights</div></body>") for i in range(6)]
    rows += [(9, "https://alone.example/", rows[0][2]), (10, None, None), (11, "not a url", "<p>x</p>")]
    rows += [(20 + i, "https://same.example/", "<p>one text</p>") for i in range(5)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string").withColumnRenamed("host", "template").repartition(3)
    found = {r["page_id"]: r for r in wrapper.main_text(pages).collect()}
    assert len(found) == len(rows)
    assert [found[i]["text"] for i in range(6)] == [f"Title {i} Text number {i} of many words {'x' * i}".strip() for i in range(6)]
    assert found[9]["text"].startswith("Welcome here Title 0") and found[9]["text"].endswith("All rights")
    assert (found[10]["text"], found[10]["n_chars"], found[11]["text"]) == ("", 0, "x")
    assert found[22]["text"] == "one text"  # copies are no evidence of a template
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_fold_is_the_same_in_any_grouping():
    pages = [wrapper.shape(wrapper.parse(f"<div><p>same</p><p class=a>{i}</p></div><ul><li>m{i % 2}</ul>")) for i in range(4)]
    a, b, c, d = pages
    assert wrapper.fold(wrapper.fold(wrapper.fold(a, b), c), d) == wrapper.fold(wrapper.fold(a, b), wrapper.fold(c, d))


def test_articles_of_the_tables(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[r["page_id"]] == " ".join(b for b in blocks if b)
