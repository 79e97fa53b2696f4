"""Quality rules: a table of thresholds compiled into one projection.

Every document is measured by built-in functions only (sizes of texts, word lists and line lists);
``compile_rules`` turns the table RULES into the columns of one select: the names of the rules that fail and
the verdict. A rule bounds the share part / whole, in hundredths and in whole numbers, so that no
rounding decides: ``least * whole <= 100 * part <= most * whole``.

Repeated words are those in five-word windows that occur twice or more in the text. Windows are
compared by 64-bit hashes made from hashes of 1, 2 and 4 words; texts in which no hash repeats end
there, in the others the hashes are sorted with their positions (n log n, whatever the repeats).

The stop words are frequent function words of six languages, and a text needs few of them; texts
without spaces between words, as in Chinese, need other rules and other words (parameters).

Defined results: a null text has no words and no lines, so base_failed is true and kept false, as for an empty one or one of
white space only; a text that fails the base test names no further rules; very long texts are measured whole;
a share with nothing to share (no lines, no words) passes its rule; a share that equals its bound passes; every row is
measured by itself, so that repeated rows and ids, null ids included, get a row each; other columns pass through, and those
with the names of results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import ASCII_SPACE, lower_ascii
from tessaline.llm.decontaminate import grams, with_hashes

WINDOW = 5  # words
LEAST_WORDS, MOST_REPEATED = 10, 20  # the base test: words, and hundredths of them in repeated windows
SPACE = r"[\x20\x09-\x0D]"


class Rule(NamedTuple):
    """least and most are hundredths of the whole; None is no bound."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The usual published bounds for web text.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("words_with_letters", "n_letter_words", "n_words", 80, None),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)

#: Frequent function words, A-Z in lower case.
STOP_WORDS = tuple(
    sorted(
        set(
            "the be to of and that have with in is it for on as are was this by from "
            "le la les de des du et un une que qui dans en est pour pas sur par avec "
            "der die das und ist nicht ein eine zu den von mit im für auf dem des sich "
            "el los las y un una que en es por con para del se no al lo "
            "il di che e per non sono della con si "
            "o os as do da em não uma com".split()
        )
    )
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), "")


def _lines_like(pattern: str) -> Column:
    return F.size(F.filter("_lines", lambda line: line.rlike(pattern)))


def _covered(positions: Column) -> Column:
    """Words covered by windows at these sorted positions."""
    last = F.size(positions) - 1
    steps = F.zip_with(F.slice(positions, 1, last), F.slice(positions, 2, last), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows with n_repeat_words, from the column words."""
    rows = with_hashes(rows, "_h").withColumn("_w", grams("_h", WINDOW))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    rows = rows.withColumn("_s", F.when(some, F.sort_array(F.transform("_w", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))).otherwise(none))
    near = lambda x, i: F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", near), lambda x: x["at"])))
    return rows.withColumn("n_repeat_words", F.when(F.size("_p") > 0, _covered(F.col("_p"))).otherwise(0))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_stop_words", "n_bullet_lines", "n_cut_lines")


def measure(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with the columns of MEASURES, as long. n_lines counts the lines that have a word."""
    rest = [c for c in docs.columns if c not in MEASURES]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumn("words", words_of(F.col("_text")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: F.trim(line, F.lit(ASCII_SPACE)) != ""))
    letters = F.split(lower_ascii(F.col("_text")), r"[^\p{L}]+", -1)
    measures = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.char_length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_lines": F.size("_lines"),
        "n_letter_words": F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.filter(letters, lambda w: w.isin(*stop_words))),
        "n_bullet_lines": _lines_like(rf"^{SPACE}*[-*•]"),
        "n_cut_lines": _lines_like(rf"(\.\.\.|…){SPACE}*\z"),
    }
    rows = _with_repeats(rows).select("_rest", *[measures[m].cast("long").alias(m) for m in MEASURES])
    return rows.select(*[F.col("_rest").getField(c).alias(c) for c in rest], *MEASURES)


def passes(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    bounds = [whole * rule.least <= part] * (rule.least is not None) + [part <= whole * rule.most] * (rule.most is not None)
    out = F.lit(True)
    for bound in bounds:
        out = out & bound
    return out


def compile_rules(rules: Sequence[Rule] = RULES) -> list[Column]:
    """The columns base_failed, failed_rules (names in the order of the table, comma-joined) and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    names = F.concat_ws(",", *[F.when(~passes(rule), F.lit(rule.name)) for rule in rules])
    return [base.alias("base_failed"), F.when(base, F.lit("")).otherwise(names).alias("failed_rules"), (~base & verdict).alias("kept")]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with MEASURES, base_failed, failed_rules and kept."""
    return measure(docs.drop("base_failed", "failed_rules", "kept"), stop_words).select("*", *compile_rules(rules))
