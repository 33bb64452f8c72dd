"""Block rules: omitted end tags, names as evidence, scripts without blanks, and pages that mark nothing."""

import re

import pytest

from millrace.llm import html_text
from tests.llm.conftest import sentence

LONG = ("It was the best of the times and it was the worst of the times for all of us in the town that we had known. " * 3).strip()
ZH = "我们在城里的时候，他们说这个地方是最好的，也是最坏的，因为人们来到这里都是为了看一看大地和天空。" * 5
JA = "私たちがこの町に住んでいたときは、それが一番よい時であり、また一番わるい時でもありました。" * 5


def kept(page):
    text = html_text.main_text(page)
    return text.split("\n\n") if text else []


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body><p>{LONG}</p><p>{LONG}</p>",
        f"<html><head><title>T</title>{LONG}<p>{LONG}</p>",
        f"<body><div><p class=notice>We use cookies.<p>{LONG}<p>{LONG}</div></body>",
        f"<body><ul><li class=share>Share this<li>that</ul><p>{LONG}</p><p>{LONG}</p></body>",
        f"<body><datalist id=x><option value=a>A<option>B</datalist><p>{LONG}</p><p>{LONG}</p></body>",
        f"<p>{LONG}<select><option>a<option>b</select><p>{LONG}",
        f"<table><tr><td class=sidebar>menu<td><p>{LONG}<p>{LONG}<tr><td class=ads>buy</table>",
        f"<dl><dt class=promo>new<dd>{LONG}<dt class=promo>old<dd>{LONG}</dl>",
        f"<div><span><p>{LONG}</span></p><p>{LONG}</p></div>",
        f"<nav><ul><li>home<li>more<article><p>{LONG}<p>{LONG}</article>",
    ],
)
def test_omitted_ends_lose_nothing(page):
    assert kept(page) == [LONG, LONG]


@pytest.mark.parametrize("name", ["social-science-story", "related-work", "search-engines", "noticeTheBirds", "sidebar", "post comments"])
def test_names_do_not_outweigh_the_page_text(name):
    assert kept(f'<div class="{name}"><p>{LONG}</p><p>{LONG}</p></div>') == [LONG, LONG]
    assert kept(f'<article class="{name}"><p>{LONG}</p></article>') == [LONG]
    assert kept(f"<form id={name.split()[0]}><p>{LONG}</p></form>") == [LONG]


@pytest.mark.parametrize("name", ["related", "social", "sidebar", "comments", "ad", "cookie-consent", "newsletter-signup"])
def test_names_speak_against_what_is_beside_the_text(name):
    assert kept(f'<body><div><p>{LONG}</p><p>{LONG}</p></div><div class="{name}"><p>{LONG}</p></div></body>') == [LONG, LONG]
    many = f"<p>{LONG}</p>" * 9
    assert (kept(f'<body><p>{LONG}</p><div class="{name}">{many}</div></body>') == [LONG]) == (name not in ("related", "social"))  # strong names stand however much there is


NEAR = "It was the best of the times and it was the worst of the times for all of us, and the town that we had known was gone to the dogs by then, as it was."


def test_a_page_inside_a_form_is_a_page():
    assert len(NEAR) < 200
    assert kept("<form>" + f"<p>{NEAR}</p>" * 6 + "</form>") == [NEAR] * 6
    assert kept(f"<p>{NEAR}</p><p>{NEAR}</p><form><p>Name of you and of the town: in the box.</p></form>") == [NEAR, NEAR]


@pytest.mark.parametrize("tag", ["nav", "aside", "menu"])
def test_boilerplate_that_is_never_closed_ends_at_the_text(tag):
    menu = "<a href=/a>home</a> <a href=/b>more</a>"
    assert kept(f"<body><{tag}>{menu}<div>{LONG}</div><div>Brief.</div><div>{LONG}</div></body>") == [LONG, "Brief.", LONG]
    assert kept(f"<body><{tag}>{menu}<div>{LONG}</div><footer>{LONG}</footer></body>") == [LONG]
    assert kept(f"<body><{tag}>{menu}<div>{LONG}</div></{tag}><div>{LONG}</div></body>") == [LONG]


def test_signs_and_links_inside_an_article():
    sign, link = "All of it is © of the town and of us, as it was and as it will be for you.", "It was the best of the times and it was the worst of the times for us all."
    assert kept(f"<article><p>{LONG}</p><p>{sign}</p><p>{LONG}</p></article>") == [LONG, sign, LONG]
    assert kept(f"<div><p>{LONG}</p><p>{LONG}</p></div><div>{sign}</div>") == [LONG, LONG]
    assert kept(f"<article><p>{LONG}</p><p><a href=/x>{link}</a></p><p>{LONG}</p></article>") == [LONG, link, LONG]
    assert kept(f"<article><p>{LONG}</p><ul><li><a href=/x>More of it</a></ul></article>") == [LONG]


@pytest.mark.parametrize("name", ["comments", "disqus_thread", "replies"])
def test_comments_go_also_beside_a_brief_article(name):
    for text in (NEAR, "We saw it on the hill in the rain."):
        assert kept(f"<div><h1>Title</h1><p>{text}</p></div><div class={name}><p>{LONG}</p><p>{LONG}</p></div>")[-1] == text
    assert kept(f"<div class={name}><p>{LONG}</p></div>") == [LONG]


def test_the_passes_decide_pages_without_marks():
    """No article, nav or footer: what the rules keep differs from all that is shown."""
    for k in range(40):
        paragraphs = [sentence(k + 7 * i, 24 + (k * 13 + i * 29) % 40) + "." for i in range(2 + k % 4)]
        links = "".join(f"<div><a href=/{i}>{sentence(i, 3)}</a></div>" for i in range(6))
        page = f"<body><div>{links}</div><div><h2>{sentence(k, 5)}</h2>" + "".join(f"<div>{p}</div>" for p in paragraphs) + f"</div><div>{links}</div><div>&copy; me</div></body>"
        assert kept(page) == [sentence(k, 5), *paragraphs]
        blocks, _ = html_text.blocks_of(page)
        assert len(blocks) == 14 + len(paragraphs) and {html_text.first_pass(b) for b in blocks} >= {"bad", "short"}  # headings and links


def test_elements_and_roles_are_verdicts():
    for tag in ("nav", "aside", "footer", "dialog", "menu"):
        assert kept(f"<p>{LONG}</p><{tag}><p>{LONG}</p><p>{LONG}</p></{tag}>") == [LONG]
    for role in ("navigation", "complementary", "contentinfo", "search"):
        assert kept(f"<p>{LONG}</p><div role={role}><p>{LONG}</p><p>{LONG}</p></div>") == [LONG]
    assert kept(f"<p>{LONG}</p><div hidden><p>{LONG}</p></div><div aria-hidden=true><p>{LONG}</p></div>") == [LONG]


@pytest.mark.parametrize("text", [ZH, JA])
def test_scripts_without_blanks(text):
    assert kept(f"<body><nav><a href=/>家</a></nav><div><p>{text}</p><p>{text}</p></div><footer>町</footer></body>") == [text, text]


def test_undecided_blocks_follow_their_neighbours():
    bad = "<p><a href=/x>" + "link text and more " * 8 + "</a></p>"
    assert kept(f"<p>{LONG}</p><p>Brief.</p><p>{LONG}</p>") == [LONG, "Brief.", LONG]
    assert kept(f"{bad}<p>Brief.</p>{bad}<p>{LONG}</p>") == [LONG]
    assert kept(f"{bad}<h2>Heading</h2><p>Brief one.</p><p>{LONG}</p>") == ["Heading", "Brief one.", LONG]
    code = "x1 = y2 + z3; q4 = r5 * s6; " * 6
    assert kept(f"<p>{LONG}</p><pre>{code}</pre><p>{LONG}</p>") == [LONG, code.strip(), LONG]  # few function words decide nothing alone
    assert kept(f"{bad}<pre>{code}</pre>{bad}<p>{LONG}</p>") == [LONG]


def test_pages_that_mark_no_article_give_it_all_the_same():
    same = lost = total = 0
    for k in range(120):
        paragraphs = [sentence(k + 7 * i, 4 + (k * 13 + i * 29) % 60) + "." for i in range(1 + k % 6)]
        inner = f"<h1>{sentence(k, 6)}</h1>" + "".join(f"<p>{p}{'</p>' * (k % 2)}" for p in paragraphs)
        page = f"<html><head><title>x</title></head><body><nav><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul></nav><div class=ad>Buy the best of all for you now.</div><article>{inner}</article><footer>&copy; me, all of it</footer></body></html>"
        want = html_text.main_text(page)
        assert want == "\n\n".join([sentence(k, 6), *paragraphs])
        got = html_text.main_text(re.sub("<(/?)article>", r"<\1div>", page))
        same, total, lost = same + (got == want), total + len(want), lost + sum(len(b) for b in want.split("\n\n") if b not in got.split("\n\n"))
    assert same >= 0.8 * 120 and lost <= 0.02 * total
