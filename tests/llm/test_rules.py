"""Quality rules against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from tessaline.llm import quality_rules
from tessaline.llm.quality_rules import RULES, STOP_WORDS, Rule


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(text, rules=RULES):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    letters = re.split(r"[\W\d_]+", lower(text))
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words), "n_stop_words": sum(w in STOP_WORDS for w in letters),
        "n_bullet_lines": sum(x.strip(" \t\x0b\x0c\r")[:1] in "-*•" for x in lines), "n_cut_lines": sum(x.strip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines),
    }
    base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    failed = [r.name for r in rules if (r.least is not None and r.least * m[r.whole] > 100 * m[r.part]) or (r.most is not None and 100 * m[r.part] > r.most * m[r.whole])]
    return (*m.values(), base, "" if base else ",".join(failed), not base and not failed)


def judged(spark, rows, rules=RULES):
    docs = spark.createDataFrame([(a, b, 7, "x", True) for a, b in rows], "doc_id long, text string, n_words int, words string, kept boolean")
    out = quality_rules.judge(docs, rules)
    assert len(out.columns) == len(set(out.columns))
    return sorted(((r.doc_id, *[r[m] for m in quality_rules.MEASURES], r.base_failed, r.failed_rules, r.kept) for r in out.collect()), key=repr)


PROSE = "The house is old and it was built by the people of the town with stones from here. " * 1
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one two three four"), (5, PROSE), (5, PROSE), (None, PROSE),
    (6, "a a a a a a a a a a a a"), (7, "a b c d e x a b c d e f g h i j k l m n o p q r s t u v"),
    (8, "a b c d e a b c d e a b c d e " + " ".join(f"word{i}" for i in range(80))),
    (9, "the #tag is ### and $$$ of <b> a | pipe & more % * words for you are these"),
    (10, "- the one item\n* two of it\n  • three is\n- and four\n- it is five with the last"),
    (11, "the start of it is...\nand the end was…  \nthis is a whole line with an end.\x0b"),
    (12, "same line of the text\n" * 9 + " same line of the text\n\n\n"), (13, "1 2 3 4 5 6 7 8 9 10 11 12 the 13"),
    (14, "É Ünï là è ß 漢字 the 𝄞𝄞 of x\x00y a b c d is  and\u0085 one\r\nto two"),
    (15, " ".join(f"w{i % 4001} the" for i in range(30000))), (16, "x" * 300000), (17, " ".join(["the"] * 20000)),
    (18, "supercalifragilistic " * 3 + "extraordinarily unquestionably the internationalisation of representativeness characteristically"),
]


def test_rules_equal_plain_python(spark):
    rng = random.Random(4)
    made = [(100 + i, "".join(rng.choice(["the ", "of ", "a ", "b", "-", "\n", "... ", "# ", "9 ", "word ", "É ", "\n- "]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows = ODD + made
    assert judged(spark, rows) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    kept = {r[0]: r[-1] for r in judged(spark, ODD)}
    assert kept[5] and kept[None] and not kept[9] and not kept[12]


def test_the_table_decides(spark):
    rules = (Rule("few_words", "n_words", "n_lines", 1000, 2000), Rule("symbols", "n_symbols", "n_words", None, 0))
    assert judged(spark, ODD, rules) == sorted(((i, *plain(t, rules)) for i, t in ODD), key=repr)
    assert judged(spark, ODD, ()) == sorted(((i, *plain(t, ())) for i, t in ODD), key=repr)


def test_shares_at_the_bound_pass(spark):
    ten = " ".join(["the", "house", "is", "old", "and", "it", "was", "built", "long", "ago"])
    got = {r[0]: r[-2] for r in judged(spark, [(1, ten + " #"), (2, " ".join([ten, "here", "by", "men", "of", "old", "who", "are", "gone", "from", "us"]) + "##")])}
    assert got == {1: "", 2: ""}  # 1 of 11 words, 2 of 20


def test_empty_table_and_no_user_functions(spark):
    assert judged(spark, []) == []
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    plan = quality_rules.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("rule", RULES)
def test_names_are_measures(rule):
    assert {rule.part, rule.whole} <= set(quality_rules.MEASURES)
