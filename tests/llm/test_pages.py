"""Main text of made pages whose content is known: wrapped in forms, in several articles, without article elements."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tessaline.llm import html_text
from tessaline.llm.html_text import main_text

LONG = "A paragraph of some length, which a reader would read as content of the page it stands on. " * 3


def test_a_form_around_the_page():
    assert main_text(f"<form><div><h1>T</h1><p>{LONG}</p><p>Short one.</p></div></form>") == f"T {LONG.strip()} Short one."
    page = f'<body><form id="aspnet"><div class="nav"><a href=x>Home</a></div><div><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div><fieldset><legend>Mail</legend><label>Your mail</label><input><button>Send</button></fieldset></form></body>'
    assert main_text(page) == f"T {LONG.strip()} {LONG.strip()}"
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><form><p>Write to us</p><label>Name</label><textarea>x</textarea></form>") == f"{LONG.strip()} {LONG.strip()}"


def test_several_articles():
    three = "".join(f"<article><h2>T{i}</h2><p>Text {i}. {LONG}</p></article>" for i in range(3))
    want = " ".join(f"T{i} Text {i}. {LONG.strip()}" for i in range(3))
    assert main_text(f"<nav>Menu</nav><main>{three}</main><footer>f</footer>") == want
    assert main_text(f"<body><nav>Menu</nav><div>{three}</div><aside>More</aside></body>") == want
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Read this too.</p></article>" for i in range(4))
    assert main_text(f"<main><article><h1>T</h1><p>{LONG}</p></article>{teasers}</main>") == f"T {LONG.strip()}"


def test_listed_classes_within_an_article():
    inner = '<p>We saw <span class="alert">a red flag</span> here</p><p class="notice">The council met.</p><blockquote class="comment">No comment, they said.</blockquote>'
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p>{inner}</article>") == f"T {LONG.strip()} We saw a red flag here The council met. No comment, they said."
    gone = '<div class="ad">Buy.</div><p class="sponsored">Buy more.</p><section class="comments"><p>A reader says so.</p></section><ol><li class="comment">Another one.</li></ol>'
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p>{gone}</article>") == f"T {LONG.strip()}"


def test_a_header_within_main():
    assert main_text(f"<header><h1>Site</h1></header><main><header><h1>Title</h1><p>By someone</p></header><p>{LONG}</p></main>") == f"Title By someone {LONG.strip()}"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def made(rng):
    """(page, its text): content in plain containers; menus, boxes and footers around it, half of them without a telling name."""
    blocks = [("h1", words(rng, rng.randrange(3, 9)))]
    for _ in range(rng.randrange(4, 14)):
        kind = rng.choice(["p", "p", "p", "p", "h2", "li", "short"])
        blocks.append(("p" if kind == "short" else kind, words(rng, {"p": rng.randrange(30, 120), "h2": 4, "li": rng.randrange(5, 20), "short": rng.randrange(2, 8)}[kind]) + "."))
    blocks.append(("p", words(rng, rng.randrange(4, 40)) + "."))
    content = "".join(f"<ul><li>{t}</li></ul>" if k == "li" else f"<{k}>{t}</{k}>" for k, t in blocks)
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{words(rng, rng.randrange(1, 4))}</a></li>" for i in range(rng.randrange(4, 12))) + "</ul>"
    side = f"<h3>{words(rng, 2)}</h3>" + "".join(f"<p><a href=/s{i}>{words(rng, rng.randrange(3, 9))}</a></p>" for i in range(rng.randrange(3, 8)))
    foot = f"<p>{words(rng, rng.randrange(4, 12))}</p><p><a href=/a>{words(rng, 1)}</a> <a href=/b>{words(rng, 2)}</a></p>"
    named = rng.random() < 0.5
    div = lambda name, inner: f'<div class="{name}">{inner}</div>' if named else f"<div>{inner}</div>"
    body = rng.choice(["<div>{}</div>", "<section>{}</section>", '<div class="post-body"><div>{}</div></div>', "<table><tr><td>{}</td></tr></table>", "{}"]).format(content)
    page = div("top-nav", menu) + body + div("sidebar", side) + div("footer", foot)
    return f"<html><body>{rng.choice(['{}', '<div>{}</div>', '<form><div>{}</div></form>']).format(page)}</body></html>", " ".join(t for _, t in blocks)


def scores(pages):
    got = want = both = 0
    for page, text in pages:
        a, b = Counter(main_text(page).split()), Counter(text.split())
        got, want, both = got + a.total(), want + b.total(), both + (a & b).total()
    return both / got, both / want


def test_precision_and_recall_without_article_elements():
    rng = random.Random(11)
    precision, recall = scores([made(rng) for _ in range(400)])
    assert precision >= 0.97 and recall >= 0.99, (precision, recall)


def test_the_clusters_decide(monkeypatch):
    """With all blocks in the upper cluster, menus and footers of unmarked containers come in."""
    pages = [made(random.Random(i)) for i in range(150)]
    own = [main_text(p) for p, _ in pages]
    precision, _ = scores(pages)
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    other = [main_text(p) for p, _ in pages]
    assert np.mean([a != b for a, b in zip(own, other, strict=True)]) > 0.05
    assert scores(pages)[0] < precision - 0.005


def test_the_border_selects_the_region():
    """A long list of short lines has more characters than the article, but lies in the lower cluster."""
    lines = "".join(f"<tr><td><b>row</b></td><td><i>{i}</i></td><td>value {i * 37}</td></tr>" for i in range(120))
    page = f"<body><div><table>{lines}</table></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></body>"
    assert main_text(page) == f"T {LONG.strip()} {LONG.strip()} End."
