"""Main text of pages without article and main, names inside an article, and the scoring restated plainly."""

import random

import pytest

from gradeline.llm import html_extract as H

SENTENCE = "The harbour lay quiet, as it does in winter, and no boat had left, "


def para(n):
    return f"<p>{(SENTENCE * 9)[:n]}</p>"


def plain(text):
    return " ".join(text.split())


def test_a_weak_sibling_stays():
    page = f"<body><nav><a>Home</a></nav><div>{para(300)}</div><div><p>Short, but text, of two hundred characters at most.</p></div></body>"
    assert H.main_text(page) == plain((SENTENCE * 9)[:300] + " Short, but text, of two hundred characters at most.")


def test_headings_bare_text_and_short_paragraphs_beside_the_container_stay():
    page = f"<body><h1>Title</h1>bare words<h4>Part</h4><p>Tiny.</p><div>{para(400)}</div><ul><li><a>x</a><li><a>y</a></ul><p><a>more</a></p></body>"
    assert H.main_text(page) == plain("Title bare words Part Tiny. " + (SENTENCE * 9)[:400])


@pytest.mark.parametrize("name", ["share-price", "story-related", "ad-hoc", "login-stories", "social-history", "menu_of_the_day"])
def test_names_inside_an_article_count_as_a_whole(name):
    page = f"<article>{para(300)}<div class='{name}'>kept words</div><div class='share'>not these</div></article><div class='{name}'>{para(90)}</div>"
    assert H.main_text(page) == plain((SENTENCE * 9)[:300] + " kept words")


@pytest.mark.parametrize("box", ['ol class="commentlist"', 'div id="respond"', 'div class="comments-area"', 'section class="comment_thread"', 'div id="disqus_thread"'])
@pytest.mark.parametrize("inside", [True, False])
def test_reader_comments_go(box, inside):
    comments = f"<{box}>{para(250)}</{box.split()[0]}>"
    page = f"<article>{para(500)}{comments}</article>" if inside else f"<body><div>{para(500)}</div>{comments}</body>"
    assert H.main_text(page) == plain((SENTENCE * 9)[:500])


def random_page(rng):
    def block(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.45:
            text = (SENTENCE * 9)[: rng.randrange(0, 420)]
            link = f"<a href='#'>{'link ' * rng.randrange(1, 30)}</a>" if rng.random() < 0.35 else ""
            return f"<p>{text}{link}</p>" if rng.random() < 0.8 else f"<div>{text}{link}</div>"
        if kind < 0.5:
            return f"<nav>{para(200)}</nav>"
        name = rng.choice(["", "", " class='post'", " id='sidebar'", " class='content'", " class='x-menu'"])
        tag = rng.choice(["div", "section", "div", "blockquote"])
        return f"<{tag}{name}>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def plain_kept(root):
    """Every element asks all paragraphs below it, instead of paragraphs telling their ancestors."""
    def inside(e):
        return [e] + [x for item in e.items if isinstance(item, H.Element) and not item.dropped for x in inside(item)]

    def text(e, linked=False):
        """(characters, characters in links, commas)"""
        total = [0, 0, 0]
        for item in e.items:
            if isinstance(item, str):
                part = (len(item.strip()), len(item.strip()) if linked else 0, sum(item.count(c) for c in ",，、"))
            elif item.dropped:
                continue
            else:
                part = text(item, linked or item.tag == "a")
            total = [a + b for a, b in zip(total, part)]
        return total

    def unlinked(e):
        length, links, _ = text(e)
        return 1 - links / length if length else 0.0

    def is_paragraph(e):
        bare = e.tag == "div" and not any(isinstance(x, H.Element) and x.tag in H.BLOCKS for x in e.items)
        return (e.tag in H.PARAGRAPHS or bare) and text(e)[0] >= 25

    def points(e):
        total = 0
        for p in inside(e)[1:]:
            if is_paragraph(p):
                steps, up = 0, p.parent
                while up is not e:
                    steps, up = steps + 1, up.parent
                length, _, commas = text(p)
                total += (1 + commas + min(length / 100, 3)) * unlinked(p) / (1, 2)[steps] if steps < 2 else (
                    (1 + commas + min(length / 100, 3)) * unlinked(p) / (3 * steps))
        return total

    every = inside(root)
    scored = [(points(e), e) for e in every]
    best = max((x for x in scored if x[0] > 0), key=lambda x: (x[0] + x[1].weight) * unlinked(x[1]), default=None)
    if best is None or best[1].parent is None:
        return None
    best = best[1]
    return [x for x in best.parent.items if isinstance(x, str) or x is best or not x.dropped and unlinked(x) > 0.5]


@pytest.mark.parametrize("seed", range(60))
def test_scoring_equals_a_plain_restatement(seed):
    page = random_page(random.Random(seed))
    want = plain_kept(H.parse(page))
    if want is not None:
        text = " ".join("".join(t for kept in want for t in H._texts(kept)).split())
        assert H.main_text(page) == text
