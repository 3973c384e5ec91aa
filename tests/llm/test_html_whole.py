"""The whole main text of pages without an article, and of pages with teaser articles."""

import pytest

from veilmark.llm.html_extract import blocks_of, container, extract_text, scores_of, text_of

STORY = "story of the day " * 40


def page_text(page):
    blocks = blocks_of(page)
    return text_of(blocks, container(scores_of(blocks)))


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=post><h1>Title</h1><p>Lead</p><div class=body>{}</div></div></body>",
        "<body><h1>Title</h1><p>Lead</p><div class=body>{}</div></body>",
        "<body><div><ul class=top><li><a href=x>Home</a></ul><h1>Title</h1><p>Lead</p>"
        "<div class=links><a href=x>this is a long list of links</a></div><div>{}</div></div></body>",
    ],
)
def test_heading_and_lead_beside_the_text(page):
    story = STORY.strip()
    assert page_text(page.format(f"<p>{story}</p><p>{story}</p>")) == f"Title\nLead\n{story}\n{story}"


@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><div class=body>{}</div></body>", "{}"])
def test_lists_quotes_and_code_beside_paragraphs(around):
    parts = (
        f"<div class=para1>{STORY}</div><h2>Sub</h2><ul><li>one</li></ul>"
        f"<blockquote><p>quote</p></blockquote><pre>code</pre><div class=para2>{STORY}</div>"
    )
    story = STORY.strip()
    assert page_text(around.format(parts)) == f"{story}\nSub\none\nquote\ncode\n{story}"


def test_teaser_articles_do_not_replace_the_text():
    cards = "".join(f"<article class=card><p>teaser {k} {'x ' * 60}</p></article>" for k in range(9))
    text = page_text(f"<body><div class=text><p>{STORY}</p></div><div class=more>{cards}</div></body>")
    assert STORY.strip() in text
    most = page_text(f"<body><article><p>{STORY}</p></article><div>{'note ' * 50}</div></body>")
    assert most == STORY.strip()


def test_roots_side_by_side_all_count():
    text = page_text(f"<div class=a>{STORY}</div><div class=b>{STORY}</div>")
    assert text == f"{STORY.strip()}\n{STORY.strip()}"


def test_templates_of_a_host_have_paths_of_their_own(spark):
    box = "<div class=box><p>see also the shop</p></div>"
    one = "<body><div class=box><p>{0}</p></div></body>".format(STORY)
    other = f"<body><div class=forum><p>{STORY}</p></div>{box}</body>"
    rows = [(k, f"http://h.example/{k}", one) for k in range(5)] + [(9, "http://h.example/f", other)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in extract_text(frame).collect()}
    assert set(texts.values()) == {STORY.strip()} and len(texts) == 6


@pytest.mark.parametrize(
    "attributes",
    ["style='overflow:hidden'", "aria-hidden='false'", "data-class='ad'", "class='layout has-sidebar'",
     "class='post category-social'", "id='page-with-nav'", "class=main-header-less id=share-box",
     "title='class=ad hidden'", "data-hidden"],
)
def test_attributes_that_only_mention_a_barred_word(attributes):
    page = f"<body><nav>menu</nav><div {attributes}><h1>Title</h1><p>{STORY}</p></div></body>"
    assert page_text(page) == f"Title\n{STORY.strip()}"


@pytest.mark.parametrize(
    "attributes",
    ["class='x ad'", "hidden", "HIDDEN", "aria-hidden=true", "class=comment-list", "id='site-footer'",
     "class='cookie-banner'", "role=navigation", "class=user_comments"],
)
def test_barred_elements_go(attributes):
    page = f"<body><div class=text><p>{STORY}</p></div><div {attributes}><p>not this</p></div></body>"
    assert page_text(page) == STORY.strip()


def test_a_form_around_the_page_and_forms_in_it():
    form = "<form class=login><label>Name</label><p>Sign in here</p></form>"
    page = f"<body><form id=aspnet><div class=text><p>{STORY}</p>{form}</div></form></body>"
    assert page_text(page) == STORY.strip()


def test_comments_longer_than_the_article():
    notes = "".join(f"<p>comment {k} {'x ' * 50}</p>" for k in range(50))
    page = f"<body><div class=text><p>{STORY}</p></div><div class=comments-area>{notes}</div></body>"
    assert page_text(page) == STORY.strip()


def test_headlines_in_an_articles_header():
    page = f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{STORY}</p><footer>by me</footer></article></body>"
    assert page_text(page) == f"Title\n{STORY.strip()}"


def test_raw_elements_that_are_not_closed():
    assert page_text(f"<head><title>never closed<body><div><p>{STORY}</p></div></body>") == STORY.strip()
    assert page_text(f"<body><div><p>{STORY}</p></div><script>var x = '<p>no</p>'") == STORY.strip()
