"""HTML extraction: wrappers, denied words and states, both passes against a plain form, time."""

import random
import time

import pytest

pytest.importorskip("bidloom.llm")

from bidloom.llm import html_text  # noqa: E402

WORDS = frozenset(html_text.STOP_WORDS)
LONG = "The quick brown fox jumps over the lazy dog and it was not for the first time that they had seen it in the wood, as he said to us when we came back from there on that day. It is so and was so."
ARTICLE = f"<article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article>"
TEXT = f"A title\n{LONG}\nShort."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar">{}</div>',
        '<main class="no-sidebar">{}</main>',
        '<div class="layout no-sidebar">{}</div>',
        '<div class="page-with-comments">{}<div id="comments"><p>Nice.</p></div></div>',
        '<div class="modal-open site">{}</div>',
        '<div class="elementor-widget-container">{}</div>',
        '<section id="copyright-reform">{}</section>',
        '<form id="aspnetForm"><nav>x</nav>{}<input></form>',
        '<div class="modal"><div class="sidebar">{}</div></div>',
        '<header class="site-header"><p>Site</p></header>{}<footer>&copy;</footer>',
        '{}<div class="sidebar"><p>Bad</p></div><div id="site-footer">Bad</div><div class="comments-area"><article><p>Bad</p></article></div>',
        '<div class="ad-slot-1">Bad</div><div class="cookie-notice">Bad</div><form>Bad</form>{}<div class="td-footer-wrapper">Bad</div>',
        '<noscript>Bad</noscript><svg><text>Bad</text></svg><iframe>Bad{}'.replace("<iframe>Bad", ""),
    ],
)
def test_what_stands_around(page):
    assert html_text.main_text(f"<!DOCTYPE html><html><body>{page.format(ARTICLE)}</body></html>", WORDS) == TEXT


@pytest.mark.parametrize(
    ("part", "wanted"),
    [
        ('<p class="related-work">See also.</p>', "See also."),
        ("<p>See <a href=x>the long report of the year</a></p>", "See the long report of the year"),
        ('<ul class="related"><li><a href=x>Other</a></li></ul><p>Short.</p>', "Short."),
        ('<div class="share"><a href=x>Share</a></div><p>Short.</p>', "Short."),
    ],
)
def test_in_an_article(part, wanted):
    assert html_text.main_text(ARTICLE.replace("<p>Short.</p>", part), WORDS) == f"A title\n{LONG}\n{wanted}"


def test_headings_of_an_article_stay():
    page = ARTICLE.replace("<h1>A title</h1>", "<header><h1>A title</h1><p>by me</p></header>")
    assert html_text.main_text(page, WORDS) == TEXT


def test_comments_that_hold_most_text_go():
    page = f"<div><h1>A title</h1><p>{LONG} {LONG}</p></div><div id='comments'>{f'<p>{LONG}</p>' * 9}</div>"
    assert html_text.main_text(page, WORDS) == f"A title\n{LONG} {LONG}"


def plain(found):
    """Both passes with a search to either side for each block, and no memory."""
    kinds = []
    for b in found:
        words = html_text._WORDS.findall(b.text.lower())
        stop = sum(w in WORDS for w in words) / len(words) if words else 0.0
        density = b.linked / max(len(b.text), 1)
        linked = density > 0.2
        high, low = (0.16, 0.15) if b.content else (0.32, 0.3)
        if b.boilerplate or density > (0.9 if b.content else 0.2):
            kinds.append("bad")
        elif b.hint:
            kinds.append("good" if len(b.text) > 200 and stop >= 0.32 else "bad")
        elif len(b.text) < 70 or linked:
            kinds.append("short")
        elif stop >= high and len(b.text) > 200:
            kinds.append("good")
        elif stop >= low:
            kinds.append("near")
        else:
            kinds.append("short" if b.content else "dull")

    def nearest(i, step):
        j = i
        while 0 <= j + step < len(found):
            b = found[j + step]
            if b.content != found[i].content:
                return ("good" if found[i].content else "bad"), abs(j + step - i)
            j += step
            aside = b.content and (b.boilerplate or b.hint and kinds[j] == "bad")
            if kinds[j] in ("good", "bad", "dull") and not aside:
                return ("good" if kinds[j] == "good" else "bad"), abs(j - i)
        return ("good" if found[i].content else "bad"), abs(j + step - i)

    out = []
    for i, kind in enumerate(kinds):
        (a, da), (c, dc) = nearest(i, -1), nearest(i, 1)
        if kind in ("good", "bad", "dull"):
            out.append(kind == "good")
        elif a == c:
            out.append(a == "good")
        else:
            out.append(kind == "near" or (c if found[i].heading or dc < da else a) == "good")
    for left in (("near",), ("short", "dull")):
        out = out if any(out) else [k in left for k in kinds]
    return out


def test_passes_equal_the_plain_form():
    rng, seen = random.Random(4), set()
    dull, near = "kelp mast brig yawl ketch sloop schooner " * 3, "kelp the mast of brig and yawl to ketch sloop in schooner a " * 2
    pieces = [f"<p>{LONG}</p>", "<p>Short one.</p>", f"<p>{dull}</p>", f"<p>{near}</p>", "<h2>Head</h2>", "<p><a href=x>only a link</a></p>", "<p>in part <a href=x>a link</a></p>", "<nav>menu</nav>", '<div class="ad">buy</div>', f'<div class="related">{LONG}</div>', "<div class='search'>find</div>"]
    for _ in range(400):
        inner = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
        page = inner(5) + (f"<article>{inner(7)}</article>" if rng.random() < 0.6 else "") + inner(5)
        found = html_text.blocks(page)
        labels = html_text.classify(found, WORDS)
        assert labels == plain(found), page
        seen |= {(b.content, good) for b, good in zip(found, labels, strict=True)}
    assert len(seen) == 4


@pytest.mark.parametrize("page", ["<noscript>", "<svg>", "<!x", "<a<a ", "<form>", '<div class="modal">x', "<", "</x", "<script>", "<!--", "<svg></svg>", "<div><header>", "<p>x<a href='y", "<noscript><svg>x</svg>"])
def test_time_grows_with_the_page(page):
    began = time.perf_counter()
    html_text.main_text(page * 20_000, WORDS)
    assert time.perf_counter() - began < 3
