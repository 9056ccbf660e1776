"""Pages whose article is easily taken for something else."""

import pytest

from scriptoria.llm import wrappers

MENU = "<ul class='main-menu'><li>Home<li>About</ul>"
SIDE = "<div class='widget'>Weather</div><div id=related-posts>Other posts</div><div class='comment-list'><p>Nice post</div>"


def article(k):
    return f"<h1>Title {k}</h1><p>Some long text number {k} that goes on for a while</p><p>And more of {k} in the end</p>"


def together(pages):
    """Main texts of the pages of one host."""
    tree = wrappers.blank()
    for page in pages:
        wrappers.fold(tree, wrappers.parse(page))
    return [wrappers.main_text(page, wrappers.built(tree)) for page in pages]


@pytest.mark.parametrize("form", [
    "<html class='no-sidebar'><body class='has-sidebar single-post'>{}</body></html>", "<body class='sidebar'><div>{}</div></body>", "<body><main class='content with-comments'>{}</main></body>",
    "<body><article class='post social'>{}</article></body>", "<body><div id='page' class='sidebar-right'>{}</div></body>", "<body><div class='social'><div>{}</div></div></body>",
])
def test_names_of_containers_exclude_no_article(form):
    want = [f"Title {k}\n\nSome long text number {k} that goes on for a while\n\nAnd more of {k} in the end" for k in range(4)]
    for pages in ([form.format(MENU + article(k) + SIDE) for k in range(4)], [form.format(article(0))]):
        assert together(pages) == want[: len(pages)]
        assert [wrappers.main_text(p, None) for p in pages] == want[: len(pages)]


def test_texts_of_some_pages_stay():
    box = "<body><div class=site>{}</div></body>"
    extra = "<h2>Ingredients</h2><blockquote>The same words</blockquote>"
    foot = "<div class=tell>Tell your friends</div>"
    texts = together([box.format(f"<div class=story>{article(k)}{extra if k < 3 else ''}{foot}</div>") for k in range(8)])
    assert all(("Ingredients\n\nThe same words" in t) == (k < 3) for k, t in enumerate(texts))
    assert not any("friends" in t for t in texts)  # the same on all pages


def test_nothing_within_an_article_is_fixed():
    texts = together([f"<body><article>{article(k)}<h2>Ingredients</h2></article></body>" for k in range(4)])
    assert all(t.endswith("Ingredients") for t in texts)


@pytest.mark.parametrize("icon", ["<svg class='i' />", "<svg viewBox='0 0 1 1'/>", "<math/>", "<svg>", "<svg><path d='M0'/></svg>"])
def test_foreign_elements_take_no_text(icon):
    page = f"<body><article><h1>Title</h1><p>Before {icon} after the icon</p><p>More text to the end</p></article></body>"
    assert wrappers.main_text(page, None) == "Title\n\nBefore after the icon\n\nMore text to the end"
    two = page.replace("</article>", "<p><svg>no<path></svg> last</p></article>")
    assert icon in ("<svg>",) or wrappers.main_text(two, None).endswith("More text to the end\n\nlast")
