"""Names of elements that hold the main text."""

import pytest

from plumbline.llm import dom

BODY = "<h1>Head</h1><p>one two three four five six seven eight nine ten eleven twelve</p>"
TEXT = "Head one two three four five six seven eight nine ten eleven twelve"


def text_of(markup):
    return " ".join(dom.blocks(dom.read(markup)))


@pytest.mark.parametrize(
    "page",
    [
        f"<article class='post has-comments'>{BODY}</article>",
        f"<main class='has-sidebar'>{BODY}</main>",
        f"<main class='sidebar'>{BODY}</main>",
        f"<main><article class='post category-social'>{BODY}</article></main>",
        f"<article class='share'>{BODY}</article>",
        f"<div id='content' class='no-sidebar'>{BODY}</div>",
        f"<div class='sidebar-right'><article>{BODY}</article></div>",
        f"<div class='widget'><div>{BODY}</div></div>",
        f"<div class='banner'><main>{BODY}</main><p>no</p></div>",
        f"<main><div class='share-wrap'>{BODY}</div></main>",
        f"<article><h1>Head</h1><div class='widget'>{BODY.split('</h1>')[1]}</div></article>",
        f"<form id='aspnetForm'><div class='ad'>no</div><div>{BODY}</div></form>",
        f"<form><article>{BODY}</article><fieldset>no</fieldset></form>",
    ],
)
def test_main_text_wins_over_names(page):
    assert text_of(f"<body><nav>no</nav>{page}<div class='sidebar'>no</div></body>") == TEXT


def test_boilerplate_beside_the_main_text_still_goes():
    long = "<p>" + "no " * 200 + "</p>"
    for other in (
        f"<div id='comments' class='comments-area'><article class='comment'>{long}</article></div>",
        f"<div class='related'><article>{long}</article></div>",
        f"<div class='comment-list'>{long}</div>",
        "<form>no</form>",
        "<article class='comment'>no</article>",
    ):
        assert text_of(f"<body><main><article>{BODY}</article>{other}</main></body>") == TEXT
    assert text_of(f"<body><article>{BODY}<div class='comments'>{long}</div></article></body>") == TEXT
    content = f"<div id='content'>{BODY}</div>"
    assert text_of(f"<body>{content}<div class='related'><article>no</article></div></body>") == TEXT


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closing_drawings_are_empty(tag):
    assert text_of(f"<p>a<{tag}/>b <{tag} class='x'/> c<{tag}><text>no</text></{tag}> d</p>") == "ab c d"
    assert text_of(f"<p>a</p><{tag} width='1' /><p>b</p>") == "a b"
