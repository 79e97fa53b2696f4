"""Pieces, token counts, page text and quality against libraries and plain Python."""

from __future__ import annotations

import html
import random
import re
import time
import zlib

import numpy as np
import pytest

from tessaline.llm import html_text, pieces, quality, token_counts

ODD = [None, "", " ", "  ", "   a", "a  b\n\tc   ", "\x00", "🙂🙂 naïve", "▁ mark", " " * 40 + "x" + " " * 33, "tokenization" * 50, "日本語のテキスト", "<0x0A> <s> </s>", "é" * 500, "the the the", "x" * 3000]


def random_texts(n=400):
    rng = random.Random(5)
    letters = "etaoinshrdlu ETAB  .,!?0123\n\té🙂中"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_pieces_equal_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ODD + random_texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = pieces.Pieces(pieces.default_model())
    for text, ids in zip(texts, model.encode([t or "" for t in texts])):
        assert ids.tolist() == library.encode(text or ""), repr(text)
        assert model.decode(ids) == (text or "").replace("▁", " ")


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_pieces int")
    encoded = pieces.encode(docs, pieces.default_model())
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in encoded.collect())
    back = {r.doc_id: r.text for r in pieces.decode(encoded, pieces.default_model()).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)}
    assert pieces.encode(docs.limit(0), pieces.default_model()).collect() == []


def test_pieces_of_repeated_rows_and_portions(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    texts = [*ODD, *ODD, "word " * 50_000]
    model = pieces.Pieces(pieces.default_model())
    whole = pieces.Pieces(pieces.default_model()).encode([t or "" for t in texts])
    assert [model.encode([t or ""])[0].tolist() for t in texts] == [i.tolist() for i in whole]
    docs = spark.createDataFrame([(i % 16, t, [1], True) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>, round_trip boolean")
    got = sorted((r.doc_id, r.ids) for r in pieces.encode(docs, pieces.default_model()).collect())
    assert got == sorted((i % 16, ids.tolist()) for i, ids in enumerate(whole))


def test_unigram_viterbi_is_best():
    model = pieces.Pieces(pieces.default_model(), "unigram")

    def best(word):
        table = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                piece = word[start:end]
                score = model.scores.get(piece, model.lowest if end - start == 1 else None)
                if score is not None:
                    table[end] = max(table[end], table[start] + score)
        return table[-1]

    rng = random.Random(6)
    words = {"▁there", "▁therefore", "▁the", "▁theatre", "abc", "▁中🙂x", *(w for t in random_texts(200) for w in t.replace(" ", " ▁").split() if w)}
    words |= {"▁" + "".join(rng.choice("theraion") for _ in range(rng.randrange(1, 30))) for _ in range(500)}
    for word, ids in model.encode_words(list(words)).items():
        assert b"".join(model.bytes_of[i] for i in ids).decode() == word.replace("▁", " ")
        score, at = 0.0, 0
        while at < len(ids):  # a character's byte pieces count once, as the lowest score
            if ids[at] in model.names:
                score, at = score + model.scores[model.names[ids[at]]], at + 1
            else:
                lead = model.bytes_of[ids[at]][0]
                score, at = score + model.lowest, at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        assert score == pytest.approx(best(word)), word


def test_section_tokens_sum_and_spans(spark):
    path, pattern = token_counts.default_vocabulary()
    encoder, lengths = token_counts.encoding(path, pattern)
    texts = ODD + random_texts(100) + ["a\n\n\n  b\n", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_counts.section_tokens(docs, path, pattern).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        text = text or ""
        tokens = encoder.encode_ordinary(text)
        assert sum(r.n_tokens for r in own) == len(tokens) == own[0].doc_tokens
        assert "".join(text[r.start_char : r.end_char] for r in own) == text
        assert len(own) == text.count("\n") + 1
        expected, at, data = [0] * len(own), 0, text.encode()
        for t in tokens:
            expected[data[:at].count(b"\n")] += 1
            at += lengths[t]
        assert [r.n_tokens for r in own] == expected


def test_section_tokens_of_odd_tables(spark):
    path, pattern = token_counts.default_vocabulary()
    texts = ["a\nb", "a\nb", "line of words\n" * 30_000]
    docs = spark.createDataFrame([(i % 2, t, 5, 6, 7) for i, t in enumerate(texts)], "doc_id int, text string, section int, n_tokens int, doc_tokens int")
    rows = [tuple(r) for r in token_counts.section_tokens(docs, path, pattern).collect()]
    one = [r for r in rows if r[0] == 1]
    assert sorted(r for r in rows if r[0] == 0 and r[-1] == one[0][-1]) == [(0, *r[1:]) for r in one] and len(rows) == 4 + 30_001
    assert token_counts.section_tokens(docs.limit(0), path, pattern).collect() == []


def test_most_rule():
    section, crosses = token_counts.attribute(np.array([4, 10, 12]), np.array([6, 11]), "most")
    assert section.tolist() == [0, 1, 1] and crosses.tolist() == [False, True, True]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept all of them now.</div><header><h1>Site</h1></header>
<article><h1>Head &amp; line</h1><p>First   paragraph,&nbsp;long enough to be read as content.<p>Second <b>bo</b>ld one<br>broken.
<div class="ad">Buy this thing now for a very low price of nothing.</div><p>Tiny.</p>
<section id="comments"><p>A reader's long comment that says a lot about nothing.</p></section></article>
<aside>Other stories that you may like to read</aside><form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    text = "Head & line First paragraph, long enough to be read as content. Second bold one broken. Tiny."
    assert html_text.main_text(PAGE) == text
    assert html_text.main_text(PAGE.replace("<article>", '<div class="story">').replace("</article>", "</div>")).startswith("Head & line First")
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "v", "<p>cut off <b", "x"), (5, "w", "<script>var a='<p>'", "x"), (6, "long", "<article>" + "<p>word word</p>" * 20000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[1].text == text and out[1].n_chars == len(text)
    assert [out[i].text for i in (2, 3, 4, 5)] == ["", "", "cut off", ""]
    assert out[6].n_chars == 20000 * 10 - 1
    assert html_text.extract(pages.limit(0)).collect() == []


def test_main_text_without_article_is_whole():
    text = "Head & line First paragraph, long enough to be read as content. Second bold one broken. Tiny."
    assert html_text.main_text(PAGE.replace("<article>", '<div class="story">').replace("</article>", "</div>")) == text
    long, short = "long words " * 90 + "end", "short words " * 16 + "end"
    for page in ("<h1>T</h1><p>{}</p><p>{}</p>", "<h1>T</h1><blockquote><p>{}</p></blockquote><p>{}</p>", "<h1>T</h1><div><p>{}</p></div><div><p>{}</p></div>", "<div><h1>T</h1><p>{}<p>{}</div>"):
        assert html_text.main_text("<body><nav>Home</nav>" + page.format(long, short) + "</body>") == f"T {long} {short}", page
    story = "<div><p>Opening.</p><ul><li>Point.</li></ul>" + f"<p>{long}</p>" * 3 + "<p>Closing.</p></div><p>Elsewhere.</p>"
    assert html_text.main_text(story) == f"Opening. Point. {long} {long} {long} Closing."


def test_main_text_of_the_pages(spark):
    """Every page of the table, against its article read with plain patterns."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        blocks = re.split(r"</?(?:p|h1|article)>", article.group(1))
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group() == "<br>" else "", b)).split()) for b in blocks]
        assert html_text.main_text(r.html) == " ".join(b for b in plain if b), r.page_id


def test_main_text_keeps_named_parts_of_the_article():
    page = '<body class="has-sidebar"><div id="page" class="with-comments">{}</div><div class="sidebar-widget">Read this next, it is about something else.</div></body>'
    article = '<article class="post category-social"><h1>T</h1><p>A paragraph of some length.</p><div class="related-work"><p>Work by others.</p></div><p class="share-price">Price 7.</p>{}</article>'
    extra = '<ul class="share-links"><li><a>x</a></li></ul><section id="reader-comments"><article class="comment"><p>A comment that is as long as all of the article, or longer even.</p></article></section>'
    assert html_text.main_text(page.format(article.format(extra))) == "T A paragraph of some length. Work by others. Price 7."
    assert html_text.main_text('<div class="header"><h1>Site</h1></div><div class="content"><h1>T</h1><p>A paragraph of some length.</p><p>Short.</p></div><div class="cookie-notice">We use cookies.</div>') == "T A paragraph of some length. Short."
    assert html_text.main_text('<div class="comment">Only text.</div>') == "Only text."
    menu = "<ul>" + "<li><a href=x>Go</a></li>" * 5 + "</ul>"
    body = "<p>A paragraph with a <a>link</a> inside.</p>" * 3 + "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>" + "<p>A paragraph to end with.</p>"
    assert html_text.main_text(f"<body><div>{menu}{body}</div></body>") == "A paragraph with a link inside. " * 3 + "One Two Three A paragraph to end with."


def test_main_text_of_malformed_pages():
    assert html_text.main_text("<p>x</p><![foo]>y") == "x y"
    assert html_text.main_text("<p>x</p><![CDATA[z]]>y<![if IE]>w<![endif]>v<!-- c -->u<!foo>t<?php x ?>s") == "x ywvuts"
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<!", "<![", "]]>", "<!--", "-->", "<div class='ad'>", "</div>", "text ", "&amp;", "&#x", '<a href="', "'>", "<br>", "<script>", "</script>", "<article>", "</article>", '"', "<?", "<![CDATA[", "<li>", "<td>", "<table>", "<![if", "]>", "é", "\x00", "</", "<", "=", "<textarea>", "<title>", "<svg>"]
    for _ in range(5000):
        assert isinstance(html_text.main_text("".join(rng.choice(parts) for _ in range(rng.randrange(40)))), str)


@pytest.mark.parametrize("page", ["<ul>" + "<li>x " * 100_000, "<div>x " * 100_000, "<table>" + "<tr><td>x " * 50_000, "<div>" * 50_000 + "</p></x>" * 50_000, "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<!--" * 50_000, "<![CDATA[" * 50_000, "<a b='" * 50_000, "<a b='" * 50_001 + ">", "<span class=ad>x" * 50_000])
def test_main_text_is_linear(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "text without id"), (-3, "word " * 100_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = quality.classify(rows.selectExpr("*", "0 AS score"), labels.unionByName(labels)).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert {r.score for r in quality.classify(rows, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(rows.limit(0), labels).collect() == []


def test_quality_of_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plain = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    clashing = labels.selectExpr("*", "'x' AS text", "1 AS role", "0.5 AS score", "2 AS predicted", "3 AS `scored text`")
    odd = docs.unionByName(docs).unionByName(docs).selectExpr("*", "7 AS role", "8 AS `scored text`", "9 AS quality", "1 AS `a.b`")
    got = quality.classify(odd, clashing).collect()
    assert len(got) == 3 * len(plain)
    assert all(r.score == pytest.approx(plain[r.doc_id]) and r.role == 7 and r["scored text"] == 8 for r in got)


def test_quality_gradient_and_risk():
    rng = np.random.default_rng(3)
    for prior, best in ((0.5, False), (0.95, True)):  # the second part positive, and negative
        x = rng.standard_normal((60, 4))
        model = quality.Model(np.zeros(4), np.ones(4), rng.standard_normal((4, quality.HIDDEN)) * 0.5, rng.standard_normal(quality.HIDDEN) * 0.1, rng.standard_normal(quality.HIDDEN) * 0.5, 0.3)
        p = x[np.argsort(-model.score(x))[:20]] if best else rng.standard_normal((30, 4))
        as_one, as_zero = quality.risk(model, x, p, prior)
        assert (as_zero < 0) == best
        whole = lambda: sum(quality.risk(model, x, p, prior)) if as_zero >= 0 else -quality.risk(model, x, p, prior)[1]  # noqa: E731, B023
        grads = quality.gradient(model, x, p, prior)
        for name in ("w1", "b1", "w2"):
            flat = getattr(model, name).reshape(-1)
            for at in range(0, flat.size, 7):
                old = flat[at]
                flat[at] = old + 1e-6
                up = whole()
                flat[at] = old - 1e-6
                down = whole()
                flat[at] = old
                assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_quality_learns_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(4)
    one, zero = rng.standard_normal((600, 5)) + 1.5, rng.standard_normal((600, 5)) - 1.5
    model = quality.fit(one[:200], np.concatenate([one[200:], zero[:400]]), 0.5)
    assert (model.score(one) > 0.5).mean() > 0.97 and (model.score(zero) < 0.5).mean() > 0.97
    as_one, as_zero = quality.risk(model, np.concatenate([one[200:], zero[:400]]), one[:200], 0.5)
    assert as_one + max(0, as_zero) < 0.2


def plain_features(text):
    """The surface statistics by loops over bytes, words and lines."""
    text = text or ""
    data = text.encode()
    n = max(len(data), 1)

    def kind(b):
        c = chr(b) if b < 128 else ""
        return 8 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c == "\n" else 6 if c in ".," else 7 if c in "!?;:'\"-()" else 0

    marks, pairs = [0] * 94, [0] * 81
    for b in data:
        if 33 <= b < 127:
            marks[b - 33] += 1
    for a, b in zip(data, data[1:]):
        pairs[9 * kind(a) + kind(b)] += 1
    words, lines = text.split(), text.split("\n")
    w, sizes = max(len(words), 1), [len(x) for x in words] or [0]
    mean = sum(sizes) / len(sizes)
    shape = [
        np.log(1 + len(data)), np.log(1 + len(words)), len(set(words)) / w, max((words.count(x) for x in set(words)), default=0) / w if len(words) < 400 else max(np.unique(words, return_counts=True)[1]) / w, len({(a, b) for a, b in zip(words, words[1:])}) / w,
        mean, (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5, sum(s <= 3 for s in sizes) / len(sizes), sum(s > 20 for s in sizes) / len(sizes), len(set(lines)) / len(lines), np.log(1 + len(lines)), np.log(1 + len(words) / len(lines)),
        sum(x.isupper() for x in words) / w, sum(not x[-1].isalnum() for x in words) / w, sum(not x.isalnum() for x in words) / w,
    ]
    return np.array([(m / n) ** 0.5 for m in marks] + [(p / n) ** 0.5 for p in pairs] + shape, dtype=np.float32)


def test_quality_scores_of_a_whole_table_by_a_plain_fit_and_scorer(spark):
    """Rows to learn from chosen, measured, fitted and every row scored without Spark."""
    import xxhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    learns = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    least = lambda ids, most: sorted(ids, key=lambda i: ((xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64, i))[:most]
    texts, x = dict(docs), {i: plain_features(t) for i, t in docs}
    marked = {i: q for i, q in labels if q is not None and learns(i)}
    for limits in ((8_000, 16_000), (60, 200)):
        prior = min(0.99, max(0.01, sum(marked.values()) / len(marked)))
        positive = [i for i in least([i for i, q in marked.items() if q == 1], limits[0]) if i in texts]
        unlabelled = least([i for i in texts if learns(i)], limits[1])
        ordered = [np.array([x[i] for i in sorted(ids, key=str)]) for ids in (positive, unlabelled)]
        model = quality.fit(*ordered, prior)
        z = np.clip((np.array([x[i] for i, _ in docs]) - model.mean) / model.scale, -6, 6)
        want = 1 / (1 + np.exp(-(np.tanh(z @ model.w1 + model.b1) @ model.w2 + model.b2)))
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        found, known = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"), *limits)
        got = {r.doc_id: (r.score, r.predicted) for r in quality.score(frame, found, known).collect()}
        assert known == pytest.approx(prior)
        assert max(abs(got[i][0] - s) for (i, _), s in zip(docs, want, strict=True)) < 1e-4
        assert all(got[i][1] == (got[i][0] >= 0.7) for i, _ in docs)
