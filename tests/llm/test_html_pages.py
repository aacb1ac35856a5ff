"""Pages whose marks must not swallow the article."""

import pytest

from transcript_jobs.llm import html_text as H

TREE = H.Tree()
P1, P2 = "one " * 30, "two " * 30
BOTH = f"{P1.strip()}\n{P2.strip()}"


@pytest.mark.parametrize(
    "between",
    [
        '<svg class="i"/>',
        "<math/>",
        "<SVG viewBox='0 0 1 1' />",
        '<svg><title/><path d="M0"/><text>x</text></svg>',
        "<svg><svg>inner</svg>tail</svg>",
        "<svg><svg/>tail</svg>",
        "<object>a<object>b</object>c</object>",
        '<video-js id="v"></video-js>',
        "<audio-player></audio-player>",
        "<title-bar></title-bar>",
        "<video src='a'>",
        "<noscript><iframe src='a'></iframe></noscript>",
        "<script>if (a < b) { '<svg>' }</script>",
        "<!-- <svg> -->",
        '<img alt="<script>">',
        "<template><p>none</p><audio></template>",
    ],
)
def test_nothing_swallowed(between):
    assert H.main_text(f"<article><p>{P1}</p>{between}<p>{P2}</p></article>", TREE) == BOTH


def test_raw_to_the_end():
    for tag in H.RAW_TAGS:
        assert H.main_text(f"<article><p>{P1}</p><{tag}><p>{P2}</p></article>", TREE) == P1.strip()


@pytest.mark.parametrize(
    "start",
    [
        '<div class="layout has-sidebar"><article>',
        '<div class="layout sidebar-left"><article class="post">',
        '<div id="page-with-comments"><div class="entry-content">',
        '<article class="post comments-open">',
        '<article class="post type-post related">',
        '<div class="sidebar-right"><main>',
        '<main class="search-page">',
    ],
)
def test_wrappers(start):
    aside = '<aside class="sidebar"><p>more of this kind of thing, every day of the week</p></aside>'
    comments = f'<div id="comments"><p>{"well said " * 20}</p></div>'
    assert H.main_text(f"<body>{start}<p>{P1}</p><p>{P2}</p>{comments}{aside}</body>", TREE) == BOTH


@pytest.mark.parametrize(
    "start",
    [
        '<p id="form-of-government">',
        '<p class="notice-period">',
        '<p class="text-search">',
        "<p id=discussion>",
        '<p data-class="ad" data-id=comments>',
        "<p data-x=it's>",
        '<p title="a > b" class=lead>',
        "<p class=cookie-recipe>",
        '<p class="social-contract alert-level-study">',
        "<p id='subscription-model'>",
    ],
)
def test_names_of_paragraphs(start):
    """A word of a longer name, or the name of a place, is no verdict; an apostrophe in a value opens nothing."""
    assert H.main_text(f"<article><p>{P1}</p>{start}I don't mind {P2}</p><p>{P1}</p></article>", TREE) == f"{P1.strip()}\nI don't mind {P2.strip()}\n{P1.strip()}"


@pytest.mark.parametrize("tag", ["h2", "h3", "section", "div"])
@pytest.mark.parametrize("name", ["form-of-government", "recommended-dosage", "search-algorithms", "banner-years"])
def test_names_of_headings_and_sections(tag, name):
    page = f'<article><h1>Title</h1><p>{P1}</p><{tag} id="{name}">A heading</{tag}><p>{P2}</p></article>'
    assert H.main_text(page, TREE) == f"Title\n{P1.strip()}\nA heading\n{P2.strip()}"


def test_heading_ids_made_of_its_text():
    for name in ("discussion", "related", "comments", "form", "header"):
        page = f'<main><h1>Title</h1><p>{P1}</p><h2 id="{name}">A heading</h2><p>{P2}</p></main>'
        assert H.main_text(page, TREE) == f"Title\n{P1.strip()}\nA heading\n{P2.strip()}"


@pytest.mark.parametrize(
    "aside",
    [
        '<div class="ad">{}</div>',
        '<div class="ad-slot">{}</div>',
        '<div id="cookie-notice"><p>{}</p></div>',
        '<section id="comments"><h2>Comments</h2><p>{}</p></section>',
        '<ul class="comment-list"><li>{}</li></ul>',
        '<div class="related-posts"><h3>More</h3><p>{}</p></div>',
        '<div class="newsletterSignup"><p>{}</p></div>',
        '<p class="disclaimer">{}</p>',
        '<p class="sponsored notice">{}</p>',
        '<div role="alert">{}</div>',
        "<aside>{}</aside>",
        "<form><p>{}</p></form>",
        "<div hidden><p>{}</p></div>",
        "<div style='display: none'><p>{}</p></div>",
        "<footer><p>{}</p></footer>",
        "<nav><p>{}</p></nav>",
    ],
)
@pytest.mark.parametrize("words", [3, 30, 120])
def test_asides(aside, words):
    aside = aside.format("other " * words)
    for page in (f"<article><p>{P1}</p>{aside}<p>{P2}</p></article>", f"<article><p>{P1}</p><p>{P2}</p></article>{aside}", f"<body>{aside}<div><p>{P1}</p><p>{P2}</p></div></body>"):
        assert H.main_text(page, TREE) == BOTH


@pytest.mark.parametrize(
    "page",
    [
        "<script" * 20_000,
        "<b" + "x" * 200_000,
        "<b " + "x=' " * 50_000,
        '<b x="' * 30_000,
        "<a =" * 50_000,
        "<div>" * 30_000 + "</p>" * 30_000,
        "<div id='" + "a b " * 50_000 + "'>",
        "<p class=" * 30_000,
        "<!--" * 50_000,
        "</" * 80_000,
        "&#" * 80_000,
    ],
)
def test_no_page_takes_long(page):
    import time

    began = time.time()
    H.main_text(page, TREE)
    assert time.time() - began < 3


def test_still_aside():
    article = f"<article><p>{P1}</p><p>{P2}</p></article>"
    other = "other words " * 20
    for around in (
        f'<div class="comments"><article class="comment-body"><p>{other}</p></article></div>',
        f'<article class="comment"><p>{other}</p></article>',
        f'<div class="related-posts"><article class="post"><p>{other}</p></article></div>',
        f'<div class="sidebar"><p>{other}</p></div>',
        f'<form><article><p>{other}</p></article></form>',
    ):
        assert H.main_text(f"<body>{article}{around}</body>", TREE) == BOTH


def test_many_open_elements():
    page = f"<article><p>{P1}</p>" + "<svg><audio>" * 20_000 + f"<p>{P2}</p></article>"
    assert H.main_text(page, TREE) == BOTH


MENU_NAMES = (
    "main-nav main-menu main-navigation main-header main-footer main-sidebar main-search mainNav story-nav site-nav post-navigation main_nav mainMenu "
    "content-nav article-nav entry-footer main-banner main-topbar post-related story-comments"
).split()
ITEMS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "About us", "Contact"))
PROSE_MENU = "<ul><li>Read all of <a href='/a'>our news of today</a> and of the week</li><li>Talk to <a href='/b'>the people behind it</a> any time</li></ul>"


@pytest.mark.parametrize("name", MENU_NAMES)
@pytest.mark.parametrize("attr", ["id", "class", "role"])
@pytest.mark.parametrize("body", ['<div class="page">{}</div>', "<div><div>{}</div></div>", "<main>{}</main>", "<article>{}</article>", '<div class="post-content">{}</div>'])
def test_menus_of_any_name(name, attr, body):
    """The article stays, and the menu goes, whatever the menu is called and wherever it stands."""
    four = [P1.strip(), P2.strip(), "three " * 29 + "three", "four " * 29 + "four"]
    article = body.format("<h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in four))
    for items in (f"<ul>{ITEMS}</ul>", PROSE_MENU):
        menu = f'<div {attr}="{name}">{items}</div>'
        for page in (f"<body>{menu}{article}</body>", f"<body>{article}{menu}</body>"):
            assert H.main_text(page, TREE) == "\n".join(["Title", *four]), page


@pytest.mark.parametrize("name", ["story", "post", "content", "entry", "main", "article"])
@pytest.mark.parametrize("card", ["<p>In short.</p>", '<p><a href="/x">Another story</a></p>', "<p>Three little words</p><p>and three more</p>"])
def test_short_element_of_a_main_name(name, card):
    """A card with a name of the article's kind does not make the page's text something else."""
    page = f'<body><div class="{name}">{card}</div><div><h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p><p>{P2}</p></div></body>'
    assert H.main_text(page, TREE).endswith("\n".join(["Title", *[P1.strip(), P2.strip()] * 2]))


@pytest.mark.parametrize("head", ["entry-header", "article-header", "post-header", "story-header"])
def test_head_of_the_article(head):
    page = f'<body><div class="post"><div class="{head}"><h1>The title of it</h1></div><p>{P1}</p><p>{P2}</p></div><div id="main-footer"><p>{"legal words " * 20}</p></div></body>'
    assert H.main_text(page, TREE) == f"The title of it\n{BOTH}"


@pytest.mark.parametrize("name", ["post", "main", "maincontent", "articleBody", "main-content", "main has-sidebar", "entry-content"])
def test_named_article_among_others(name):
    """A name makes the zone where the named element holds the page's text."""
    other = "<div><p>Some words of the house, every page has them, nobody reads them twice</p></div>"
    page = f'<body>{other}<div class="{name}"><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>{other}</body>'
    assert H.main_text(page, TREE) == f"Title\n{BOTH}"
