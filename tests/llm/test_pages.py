"""Pages whose main text is known because they are put together from parts."""

import random

import pytest

from tidewatch.llm.html_text import main_blocks

WORDS = "tide harbour lantern meadow copper window river station garden letter morning engine paper valley market winter".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("times", [1, 10, 100])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_comments_that_outweigh_the_article(times, inside, tag):
    rng = random.Random(times)
    own = [sentence(rng, 20), sentence(rng, 15)]
    article = "".join(f"<p>{x}</p>" for x in own)
    comments = '<div class="comments">' + "".join(f'<div class="comment"><p>{sentence(rng, 20)}</p><p>{sentence(rng, 15)}</p></div>' for _ in range(times)) + "</div>"
    body = f"<{tag}>{article}{comments}</{tag}>" if inside else f"<{tag}>{article}</{tag}>{comments}"
    assert main_blocks(f"<body><nav><a>Home</a></nav>{body}<footer>end</footer></body>") == own


def test_a_long_form_beside_one_short_paragraph():
    rng = random.Random(3)
    fields = "".join(f"<p>{sentence(rng, 25)}</p><label>{sentence(rng, 8)}</label><input>" for _ in range(30))
    assert main_blocks(f"<body><div><p>Short and whole.</p></div><form>{fields}<button>Send</button></form></body>") == ["Short and whole."]
    assert main_blocks(f"<body><h2>Sign up</h2><img src=a><form>{fields}</form></body>") == ["Sign up"]
    assert main_blocks(f'<body><article><h1>Title here</h1><p>{sentence(rng, 6)}</p><div class="signup"><form>{fields}</form></div></article></body>')[0] == "Title here"


def test_a_wrapper_of_the_whole_page_and_comments_in_it():
    rng = random.Random(4)
    own = [sentence(rng, 20) for _ in range(6)]
    p = "".join(f"<p>{x}</p>" for x in own)
    noise = "".join(f"<p>{sentence(rng, 30)}</p>" for _ in range(40))
    for outer in ('<form action="x">', '<div class="sidebar">', '<div class="comments"><div class="menu">'):
        assert main_blocks(f"<body>{outer}<h1>Head</h1>{p}</body>") == ["Head", *own], outer
        assert main_blocks(f'<body>{outer}<h1>Head</h1>{p}<div class="comments">{noise}</div></body>') == ["Head", *own], outer


def built_page(rng):
    """A page of random parts, and the blocks of its article. Every part is written beside what it adds to the text."""
    own, parts = [], []
    title = sentence(rng, 5)
    for _ in range(rng.randint(3, 12)):
        text = sentence(rng, rng.randint(12, 60))
        kind = rng.randrange(5)
        if kind == 0:
            a, b = text.split(" ", 1)
            parts.append(f'<p>{a} <a href="/x"><b>{b}</b></a></p>')
        elif kind == 1:
            parts.append("<p>" + text.replace(" ", " \n\t ", 2).replace("e", "&#101;", 1) + "</p>")
        elif kind == 2:
            items = [sentence(rng, 6) for _ in range(3)]
            own.extend(items[:-1])
            text = items[-1]
            parts.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
        elif kind == 3:
            parts.append(f"<blockquote>{text}</blockquote><!-- {sentence(rng, 9)} -->")
        else:
            parts.append(f"<p>{text}")
        own.append(text)
    junk = [
        f'<div class="ad-box"><p>{sentence(rng, 30)}</p></div>', f"<script>var a = '<p>{sentence(rng, 9)}</p>';</script>", f"<aside><p>{sentence(rng, 40)}</p></aside>",
        f'<div class="share-buttons"><a>Tell</a> <a>Send</a></div>', f'<form><label>{sentence(rng, 12)}</label><input></form>', f"<style>p {{ color: red }}</style>",
        '<div id="cookie-banner"><p>' + sentence(rng, 25) + "</p></div>",
    ]
    for x in rng.sample(junk, rng.randint(0, len(junk))):
        parts.insert(rng.randint(0, len(parts)), f"{x}")
    comments = "".join(f"<p>{sentence(rng, rng.randint(5, 60))}</p>" for _ in range(rng.choice([0, 1, 5, 60])))
    comments = f'<section id="comments">{comments}</section>' if comments else ""
    holder = rng.choice(["<article>{}</article>", '<div class="post">{}</div>', "<main><div>{}</div></main>", '<table><tr><td class="content">{}</td></tr></table>'])
    head = f"<header><h1>{sentence(rng, 3)}</h1></header><nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a>' for w in WORDS) + "</ul></nav>"
    inside = rng.random() < 0.5
    article = holder.format(f"<h1>{title}</h1>" + "".join(parts) + (comments if inside else ""))
    tail = "<footer><p>" + sentence(rng, 30) + "</p></footer>"
    return f"<html><head><title>t</title></head><body>{head}{article}{'' if inside else comments}{tail}</body></html>", [title, *own]


def test_random_pages_give_what_they_were_built_from():
    rng = random.Random(11)
    wrong = []
    for k in range(400):
        page, own = built_page(rng)
        got = main_blocks(page)
        if got != own:
            wrong.append((k, set(own) - set(got), set(got) - set(own)))
    assert not wrong, (len(wrong), wrong[:3])
