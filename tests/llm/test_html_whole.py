"""Pages of which all of the article has to come out."""

import pytest

from loomgraph.llm import html_density

SAID = "Of the river and the town beside it there is much to tell, and most of it is true."
MORE = "The mill stood for two hundred years, until a flood took its wheel, its door and its miller."


@pytest.mark.parametrize("named", ["layout has-sidebar", "no-sidebar", "content-with-sidebar", "ad-free", "social-science", "sidebar", "widget page"])
def test_wrappers(named):
    """A wrapper's class or id does not take the article with it, nor most of the text."""
    body = f"<p>{SAID}</p><p>{MORE}</p>"
    for key in ("class", "id"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            page = f'<body><div class="ad">Buy it now</div><div {key}="{named}">{inner}</div><div class="cookie-notice">We use cookies</div></body>'
            assert html_density.main_text(page) == f"{SAID} {MORE}"


def test_declared_parts_go():
    page = f'<article><p>{SAID} <span class="share">share it</span></p><div id="related-widget">Read on</div><p>{MORE}</p></article>'
    assert html_density.main_text(page) == f"{SAID} {MORE}"


def test_inline_stays():
    assert html_density.main_text(f'<p>So: <span class="overlay">{SAID}</span> The end.</p>') == f"So: {SAID} The end."


def test_lists_of_links():
    """References and tables of linked entries are part of the article; its menu is not."""
    linked = ["The river and its mills", "Floods of the valley", "A miller's diary"]
    items = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(linked))
    rows = "".join(f'<tr><td><a href="/{i}">{t}</a></td></tr>' for i, t in enumerate(linked))
    for tag in ("article", "div"):
        page = f'<{tag}><p>{SAID}</p><p>{MORE}</p><ul>{items}</ul><table>{rows}</table><nav><ul>{items}</ul></nav></{tag}>'
        assert html_density.main_text(page) == " ".join([SAID, MORE, *linked, *linked])


#: Six paragraphs of an article, and other blocks that make the body less dense.
LONGER = [f"{MORE} {SAID}", SAID, MORE] * 2
AROUND = "".join(f'<div><a href="/{i}">Page {i}</a></div>' for i in range(6))


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_second_article():
    """One a little less dense than the first."""
    page = f"<div><article>{paragraphs(*LONGER)}</article><article>{paragraphs(MORE, SAID, MORE)}</article></div>{AROUND}"
    assert html_density.main_text(page) == " ".join([*LONGER, MORE, SAID, MORE])


def test_beside_the_article():
    """A lead and a section in main, next to the article."""
    page = f"<main>{paragraphs(f'{SAID} {MORE}')}<article>{paragraphs(*LONGER)}</article><section>{paragraphs(MORE, SAID)}</section></main>{AROUND}<footer>{SAID}</footer>"
    assert html_density.main_text(page) == " ".join([SAID, MORE, *LONGER, MORE, SAID])


def test_pages_of_blocks():
    """No article element: density, links and order decide; headings stay."""
    body = f"<h1>The river</h1><div><span>By someone</span></div><p>{SAID}</p><h2>The mill</h2><p>{MORE}</p><p>{SAID}</p>"
    for wrapped in (body, f"<section>{body}</section>", f"<table><tr><td>{body}</td></tr></table>"):
        page = f"<body><div>{AROUND}</div><div>{wrapped}</div><footer>{SAID}</footer></body>"
        assert html_density.main_text(page) == f"The river By someone {SAID} The mill {MORE} {SAID}"


def test_best_block_is_not_the_article():
    """The largest sum is a block inside the article: its lead, heading and list of
    references come out too, as most of the article is content."""
    refs = "".join(f'<li><a href="/{i}">Source number {i}</a></li>' for i in range(3))
    page = f"<article><header><h1>The river</h1></header><p>{SAID}</p><div>{paragraphs(*LONGER)}</div><ul>{refs}</ul></article>{AROUND}"
    assert html_density.main_text(page) == " ".join(["The river", SAID, *LONGER, *[f"Source number {i}" for i in range(3)]])


def test_form_around_the_page():
    page = f"<form><div>{paragraphs(SAID, MORE)}</div></form>"
    assert html_density.main_text(page) == f"{SAID} {MORE}"
    assert html_density.main_text(f"<div>{paragraphs(SAID, MORE)}<form>Your name <input> and mail</form></div>") == f"{SAID} {MORE}"


def test_deep_pages():
    page = "<div>" * 5000 + paragraphs(SAID, MORE) + "</div>" * 5000
    assert html_density.main_text(page) == f"{SAID} {MORE}"
    assert html_density.main_text("<div>" * 5000 + SAID) == SAID


def test_teasers_aside():
    """Article elements in a sidebar do not keep it."""
    teaser = "".join(f"<article><p>Read about topic {i}</p></article>" for i in range(3))
    page = f'<main><article>{paragraphs(*LONGER)}</article></main><div class="sidebar">{teaser}</div><aside>{teaser}</aside>'
    assert html_density.main_text(page) == " ".join(LONGER)
