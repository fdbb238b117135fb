"""Pages whose markup misleads: their text must stay."""

import pytest

from logweir.llm.html_extraction import content, meant


def text(page):
    return content(page, {}, set())


@pytest.mark.parametrize(
    "page",
    [
        "<svg/><article><p>kept</p></article>",
        "<svg viewBox='0 0 1 1' /><article><p>kept</p></article>",
        "<button>unclosed<article><p>kept</p></article>",
        "<object><article><p>kept</p></article>",
        "<body><form action='/'><p>kept</p></form></body>",
        "<article><section class='social-science'><p>kept</p></section></article>",
        "<article><div class='related-work'><p>kept</p></div></article>",
        "<article><div id='share-price'><p>kept</p></div></article>",
        "<article><section class='notice-period'><p>kept</p></section></article>",
    ],
)
def test_text_stays(page):
    assert "kept" in text(page)


@pytest.mark.parametrize("name", ["ad", "site-footer", "main-nav", "comment-list", "ad-slot", "share-buttons", "cookie-banner", "sidebar-left", "nav-links wide", "Ad-7"])
def test_boilerplate_names_still_count(name):
    assert text(f"<body><div class='{name}'>gone</div><article><p>kept</p></article></body>") == ["kept"]
    assert text(f"<article><div class='{name}'>gone</div><p>kept</p></article>") == ["kept"]


def test_raw_elements():
    assert text("<article><p>a<svg><text>no</text></svg>b</p><select><option>no</option></select></article>") == ["ab"]
    assert text("<article><p>a</p></article><script>no <p>no</p>") == ["a"]
    assert text("<form><label>no</label></form><article><p>a</p></article>") == ["a"]
    assert meant("list") == "list" and meant("comment-list") == "comment"
