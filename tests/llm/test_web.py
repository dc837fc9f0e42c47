"""URL filters and main texts."""

import math
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import html, urls
from tidemark.llm.common import read

PAGE = """<!doctype html><html><head><title>x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, many, many.</div>
<div id="wrap"><div class="post"><h2>Title &amp; more</h2><p>First, with <b>bold<br>words</b>, commas, and   space.<p>Second &eacute;, unclosed.
<div class="share">Share this</div><aside>Side, bar, text, here.</aside><ul><li>One item, said.<li>Two</ul></div>
<section class="comments"><article class="comment"><p>Great, post, really, very, nice, thanks, a lot, friend.</p></article></section></div>
<form><p>Mail</p><input></form><footer>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html.main_text(PAGE) == "Title & more\nFirst, with bold words, commas, and space.\nSecond é, unclosed.\nOne item, said.\nTwo"


def test_heading_of_the_article_stays():
    body = "<p>Long, text, with, commas, and more of it.</p>" * 30
    page = f"<article><header><h1>Head</h1></header><div class='body'>{body}</div><div class='related'><p>More, here.</p></div></article>"
    assert html.main_text(page).split("\n")[:2] == ["Head", "Long, text, with, commas, and more of it."]
    assert "More, here" not in html.main_text(page)


LONG = "<p>Long, text, with, commas, and more of it, on one thing.</p>" * 8


@pytest.mark.parametrize(
    "part, text",
    [
        ('<h2 id="discussion">Discussion</h2>', "Discussion"),
        ('<section id="discussion"><h2>Discussion</h2><p>We found little.</p></section>', "We found little."),
        ('<div class="related-work"><p>Others did much.</p></div>', "Others did much."),
        ('<ol class="references"><li><a href="/1">Doe 2001</a></li><li><a href="/2">Roe 2002</a></li></ol>', "Doe 2001"),
        ('<ul><li><a href="/1">Source one</a></li></ul>', "Source one"),
        ('<figure><figcaption><label>Figure 1</label> A tide.</figcaption></figure>', "Figure 1 A tide."),
        ('<div class="share-price"><p>Shares fell.</p></div>', "Shares fell."),
        ('<div><div><div><div><div><div><div><p>Very deep text.</p></div></div></div></div></div></div></div>', "Very deep text."),
        ("<blockquote>Short, quoted.</blockquote>", "Short, quoted."),
        ("<table><tr><td>One</td><td>1</td></tr></table>", "One"),
        ('<p title="The hidden valley">A valley.</p>', "A valley."),
        ("<p title='hidden'>A valley.</p>", "A valley."),
        ('<p data-hidden="no" class=hidden-gem>A gem.</p>', "A gem."),
        ('<div class="social"><p>Society, mostly.</p></div>', "Society, mostly."),
        ('<div class="widget"><h3>A widget</h3><p>How it works.</p></div>', "How it works."),
        ('<div class="banner"><h2>Banners of war</h2></div>', "Banners of war"),
        ('<section id="promotion"><p>Pawns may become queens.</p></section>', "Pawns may become queens."),
        ('<div class="ad-hoc"><p>For this.</p></div>', "For this."),
        ('<div class="menu-planning"><p>Eat well.</p></div>', "Eat well."),
        ('<div class="alert">The river rose.</div>', "The river rose."),
    ],
)
@pytest.mark.parametrize("page", ["<main><article>{}{}</article></main>", "<body><nav>Home</nav><div><article><div>{}{}</div></article></div></body>"])
def test_parts_of_an_article_stay(page, part, text):
    assert text in html.main_text(page.format(LONG, part)).split("\n")


@pytest.mark.parametrize(
    "part",
    [
        '<div class="comments"><p>Nice, post, this, is, really.</p></div>',
        '<section id="discussion"><div class="comment"><p>Nice, post, this.</p></div></section>',
        '<section id="replies"><p>Say, something, nice.</p><form><input></form></section>',
        '<div class="related-posts"><p>Nice, post, this.</p></div>',
        '<div class="ad-slot"><p>Buy, nice, things.</p></div>',
        '<div class="newsletter signup"><p>A nice, letter.</p></div>',
        '<ul class="menu"><li><a href="/">Nice</a></li></ul>',
        '<ul role="navigation"><li><a href="/">Nice</a></li></ul>',
        '<div class="cookie-notice">Nice cookies.</div>',
        "<aside>Nice side.</aside>",
        '<p hidden>Nice.</p>',
        '<p HIDDEN="">Nice.</p>',
        '<p class=x hidden>Nice.</p>',
        '<div class="user-comment"><p>Nice, post, this.</p></div>',
        '<div class="comment-body"><p>Nice, post, this.</p></div>',
        '<div class="sponsored-content"><h3>Buy</h3><p>Nice, things, these.</p></div>',
        '<div class="ad-large"><p>Nice, things.</p></div>',
        '<div class="related-content"><h3>More</h3><p>Nice, too.</p></div>',
        '<div class="subscribe-now"><p>Nice, letters.</p></div>',
        '<div class="social"><a href="/f">Nice</a> <a href="/t">Nicer</a></div>',
        '<div class="widget"><h3>Nice</h3><ul><li><a href="/a">Nice one, really, this</a></ul></div>',
        '<div class="share">Share this</div>',
        '<p class="copyright">© 2020 Nice.</p>',
        '<div class="discussion"><div><span class="author">Nice</span><time>1 May</time><p>I, too, think so.</p></div></div>',
    ],
)
def test_surroundings_within_an_article_go(part):
    assert html.main_text(f"<article>{LONG}{part}</article>") == html.main_text(f"<article>{LONG}</article>") != ""


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_names_in_quoted_values_hide_nothing(tag):
    assert html.main_text(f'<body><{tag} title="The hidden valley">{LONG}</{tag}></body>') == html.main_text(f"<body><{tag}>{LONG}</{tag}></body>") != ""


def test_short_last_parts_stay():
    for last in ("<section><p>That, in short, is all.</p></section>", "<div>That, in short, is all.</div>", "<div><div><p>That, in short, is all.</p></div></div>"):
        assert html.main_text(f"<body><nav>Home</nav><div>{LONG}</div>{last}</body>").split("\n")[-1] == "That, in short, is all."
    for last in ("<div>Imprint</div>", "<div>© 2020 us. All rights reserved.</div>", '<div><a href="/">Top of the page.</a></div>'):
        assert html.main_text(f"<body><div>{LONG}</div>{last}</body>") == html.main_text(f"<body><div>{LONG}</div></body>")


def plain_scores(tree):
    """(score, tag) of all containers, each by summing over all paragraphs below it; tree: (tag, children or text)."""
    def text(x):
        return x[1] if isinstance(x[1], str) else "".join(map(text, x[1]))

    def linked(x):
        return len(text(x)) if x[0] == "a" else 0 if isinstance(x[1], str) else sum(map(linked, x[1]))

    def density(x):
        return linked(x) / max(len(text(x)), 1)

    def paragraphs(x, depth):
        if x[0] == "p":
            own = "".join(text(c) for c in x[1] if c[0] != "a")
            yield (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - density(x)) if own else 0.0, depth
        elif x[0] != "a" and not isinstance(x[1], str):
            for c in x[1]:
                yield from paragraphs(c, depth + 1)

    def containers(x):
        if x[0] in ("div", "section", "main"):
            yield x
            for c in x[1]:
                yield from containers(c)

    shares = lambda d: 1.0 if d == 1 else 0.5 / 3 ** (d - 2)
    bonus = {"div": 3, "section": 3, "main": 10}
    return [(bonus[x[0]] + sum(p * shares(d) for p, d in paragraphs(x, 0))) * (1 - density(x)) for x in containers(tree) if any(p for p, _ in paragraphs(x, 0))]


def test_scores_equal_the_plain_sum():
    draw = random.Random(9)

    def some(depth):
        kind = draw.choice(["p", "p", "p", "div", "section", "main"]) if depth < 6 else "p"
        if kind == "p":
            parts = [(draw.choice(["#", "#", "a"]), "w" + draw.choice(["", ",", "x, y"]) * draw.randrange(30)) for _ in range(draw.randrange(1, 4))]
            return kind, parts
        return kind, [some(depth + 1) for _ in range(draw.randrange(1, 5))]

    def markup(x):
        if isinstance(x[1], str):
            return f"<a href='/'>{x[1]}</a>" if x[0] == "a" else f"<i>{x[1]}</i>"
        return f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"

    for _ in range(200):
        tree = "div", [some(0) for _ in range(draw.randrange(1, 5))]
        best, scores = html.best_container(html.parse(markup(tree))), plain_scores(tree)
        assert (best is None) == (not scores)
        if scores:
            assert best.score == pytest.approx(max(scores))


def test_siblings_of_a_container_stay():
    page = f"<body><ul><li><a href=/>Menu</a></ul><h1>Head</h1><div class='story'>{LONG}</div><blockquote>Short quote.</blockquote><table><tr><td>Cell</table><h2>Sources</h2><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div class=footer>Imprint</div></body>"
    found = html.main_text(page).split("\n")
    assert [found[0], *found[9:]] == ["Head", "Short quote.", "Cell", "Sources"]
    # a heading or a colon introduces a list of links as part of the text
    page = f"<body><ul><li><a href='/'>Menu</a></ul><div class='story'>{LONG}<h2>Sources</h2><ul><li><a href='/a'>One</a></ul><ul><li><a href='/b'>Two</a></ul></div></body>"
    assert html.main_text(page).split("\n")[8:] == ["Sources", "One"]


def test_both_articles_of_a_page_stay():
    found = html.main_text(f"<main><article><h2>First</h2>{LONG}</article><article><h2>Second</h2>{LONG}</article><article><a href=/>More</a></article></main>")
    assert "First" in found and "Second" in found and "More" not in found


def test_nested_names_are_linear():
    html.main_text("<article>" + '<div class="discussion">' * 30_000 + "x</article>")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<!-- open", "<script>never closed", "<nav><a>only menus</a></nav>"])
def test_nothing_to_extract(page):
    assert html.main_text(page) in ("", "<", "<p")


def test_broken_and_long_markup():
    assert html.main_text("just text & more") == "just text & more"
    for page in ("<div>" * 50_000 + "x", "<a " * 50_000, '<a "' * 20_000 + ">", "<p>x" * 20_000, "<b><i>" * 20_000 + "</p>" * 20_000):
        html.main_text(page)
    assert html.main_text("<article>" + "<p>word, word.</p>" * 5_000 + "</article>").count("\n") == 4_999


def test_html_query(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.op6_html(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], "page_id long, url string, html string").selectExpr("*", "1 text")
    assert sorted(r["n_chars"] for r in html.extract(odd).collect()) == [0, 0, 0] and html.extract(odd.limit(0)).isEmpty()


def split(url):
    i = (url or "").find("://")
    if i < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[i + 3 :], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def fitting(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_query(spark, sf_dir):
    source = {r["page_id"]: r["url"] for r in read(spark, sf_dir, "pages").collect()}
    rows = urls.op2_urls(spark, sf_dir).collect()
    assert len(rows) == len(source)
    for r in rows:
        host, path = split(source[r["page_id"]])
        rule = fitting(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["purity"] < urls.PURITY else "allow")


def test_tree_separates_bad_branches(spark):
    rows = [(i, f"http://site.net/{'bad' if i % 3 == 0 else 'good'}/{i}.html") for i in range(300)]
    rows += [(1000 + i, u) for i, u in enumerate([None, "", "no scheme", "http://", "HTTP://Site.NET?q=/bad/", "http://ÄB.Com/fr/x", "http://site.net/bad/999/", "http://xorg/"])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' host", "'y' template", "1 bad")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(None, 1), (5, None)], "id long, bad int")
    found = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert len(found) == len(rows)
    assert {found[i]["verdict"] for i in range(0, 300, 3)} == {"block"} and {found[i]["verdict"] for i in range(1, 300, 3)} == {"allow"}
    assert found[3]["template"] == "/bad/<number>.html" and found[1006]["template"].startswith("/bad/")
    assert (found[1000]["host"], found[1004]["host"], found[1004]["path"], found[1005]["host"]) == ("", "site.net", "", "Äb.com")
    assert found[1005]["rule"] == "com/fr/" and found[1007]["rule"] is None
    assert {r["verdict"] for r in urls.judge(pages, labels.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), labels).isEmpty()


def test_small_bad_section_of_a_large_host(spark):
    """200 sections of 0.5 % of their host each, one of them bad."""
    rows = [(i, f"http://hot.net/s{'abcdefghij'[i // 10 % 10]}{'abcdefghijklmnopqrst'[i // 100 % 20]}/{i}") for i in range(200 * 40)]
    bad = {i for i, u in rows if "/sab/" in u}
    assert 20 <= len(bad) < 0.01 * len(rows)
    labels = spark.createDataFrame([(i, int(i in bad)) for i, _ in rows], "id long, bad int")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert {i for i, v in found.items() if v == "block"} == bad


def test_deep_bad_branch(spark):
    """Urls that differ from the sixth segment on."""
    rows = [(i, f"http://deep.net/a/b/c/d/e/{'good' if i % 2 else 'bad'}/x/y/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "id long, bad int")
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert {i for i, r in found.items() if r["verdict"] == "block"} == set(range(0, 400, 2))
    assert found[2]["template"].startswith("/a/b/c/d/e/bad/")


def plain_shape(s):
    stem, ending = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s, re.S).groups()
    kind = "number" if re.fullmatch("[0-9]+", stem) else "hex" if re.fullmatch("[0-9A-Fa-f]{8,}", stem) else "mixed" if re.search("[0-9]", stem) else "words" if re.search("[-_+%]", stem) else "word"
    return f"<{kind}>{(ending or '').lower()}"


def plain_tree(rows):
    """The tree by recursion over lists: rows are (host, path, bad or None); returns template and purity of each."""
    templates, purity = [None] * len(rows), [None] * len(rows)
    split = [[s for s in path.split("/") if s] for _, path, _ in rows]

    def count(some):
        known = [rows[i][2] for i in some if rows[i][2] is not None]
        return len(some), len(known), sum(known)

    def grow(some, template, level):
        inner = [i for i in some if len(split[i]) > level]
        n, known, wrong = count(inner)
        if n < urls.MIN_ROWS or not 0 < wrong < known:
            for i in some:
                templates[i] = template + "".join("/" + plain_shape(s) for s in split[i][level:])
            return
        for i in set(some) - set(inner):
            templates[i] = template
        by_segment, by_shape = defaultdict(list), defaultdict(list)
        for i in inner:
            by_segment[split[i][level]].append(i)
            by_shape[plain_shape(split[i][level])].append(i)
        bands = defaultdict(list)
        for s, own in by_segment.items():
            a, b = count(own), count(by_shape[plain_shape(s)])
            if a[0] < urls.MIN_ROWS:
                continue
            rest = b[1] - a[1]
            differs = False
            if a[1] and rest:
                pooled = b[2] / b[1]
                differs = abs(a[2] / a[1] - (b[2] - a[2]) / rest) > urls.DISTINCT * math.sqrt(pooled * (1 - pooled) * (1 / a[1] + 1 / rest))
            if a[0] >= urls.ALONE * b[0]:
                bands["=" + s].append(s)
            elif differs:
                shrunk = (a[2] + urls.WEIGHT * (wrong + 1) / (known + 2)) / (a[1] + urls.WEIGHT)
                bands[min(int(math.asin(math.sqrt(shrunk)) * 2 / math.pi * urls.BANDS), urls.BANDS - 1)].append(s)
        part = {s: s if len(alike) == 1 else f"<like {min(alike)}>" for alike in bands.values() for s in alike}
        groups = defaultdict(list)
        for i in inner:
            groups[part.get(split[i][level], plain_shape(split[i][level]))].append(i)
        for p, own in groups.items():
            grow(own, f"{template}/{p}", level + 1)

    hosts = defaultdict(list)
    for i, (host, _, _) in enumerate(rows):
        hosts[host].append(i)
    _, known, wrong = count(range(len(rows)))
    rate = wrong / known if known else 0.0
    for own in hosts.values():
        grow(own, "", 0)
        _, known, wrong = count(own)
        host_rate = (wrong + urls.WEIGHT * rate) / (known + urls.WEIGHT)
        leaves = defaultdict(list)
        for i in own:
            templates[i] += "/" if rows[i][1].endswith("/") else ""
            leaves[templates[i]].append(i)
        for some in leaves.values():
            _, known, wrong = count(some)
            for i in some:
                purity[i] = 1 - (wrong + urls.WEIGHT * host_rate) / (known + urls.WEIGHT)
    return templates, purity


def test_tree_is_that_of_brute_force(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4_000):
        host, section = rng.choice(["a.net", "a.net", "b.net", "c.info"]), rng.choice("news blog bad worse shop forum x-y spam".split())
        bad = rng.random() < {"bad": 0.95, "worse": 0.9, "spam": 0.5, "forum": 0.3}.get(section, 0.05)
        deep = rng.choice(["", "/2020/01", f"/user{rng.randrange(5)}/posts", "/archive/old/older/oldest/page"])
        rows.append((i, f"http://{host}/{section}{deep}/{i}{rng.choice(['', '.html', '/'])}"))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    rows += [(5_000 + i, u) for i, u in enumerate([None, "", "http://a.net", "http://a.net/", "http://a.net/bad", "http://new.net/x/1"])]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad int")).collect()}
    known, plain = dict(labels), []
    for i, u in rows:
        host, path = split(u)
        m = re.search(r"/([0-9]{1,18})([.][A-Za-z]+)?/?$", path)
        plain.append((host, path, known.get(int(m[1])) if m else None))
    templates, purity = plain_tree(plain)
    assert len({t for t in templates if "<like" in t}) > 0
    for (i, _), (host, path, _), template, p in zip(rows, plain, templates, purity):
        r, rule = found[i], fitting(host, path)
        assert (r["template"], r["purity"]) == (template, pytest.approx(p))
        assert r["verdict"] == (rule.verdict if rule else "block" if p < urls.PURITY else "allow")
    assert sum(r["verdict"] == "block" for r in found.values()) > 500
