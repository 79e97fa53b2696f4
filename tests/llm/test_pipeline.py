"""The pipeline's stages against plain Python on the same rows."""

from __future__ import annotations

import sentencepiece
from test_groups import plain_groups
from test_native import plain_decontaminate, plain_line_dedup

import corpus_pipeline
from tessaline.llm import pieces, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] == 1]
    rows = [(i, kept) for i, _, _, kept in plain_line_dedup(rows)]
    least = plain_groups(rows, 5, 6)
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in plain_decontaminate(rows, items) if not r[5]}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {i: library.encode(t) for i, t in rows if i in clean}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == want


CLASHES = "_doc _rid _dropped _lines _gone _runs _hit _items score predicted n_lines n_dropped keep_runs kept_text n_words n_hit items contaminated fp component gone rest role _role _text h1 `a.b`".split()


def test_stages_keep_columns_and_odd_rows(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(6)
    line = "A line that is repeated in several documents."
    odd = [(None, "a text without an id", "en", "s", 1), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "", "en", "s", 0)]
    odd += [(-10 - i, f"{line}\nown text {i}", "en", "s", 7) for i in range(4)] + [(-13, f"{line}\nown text 3", "en", "s", 7)]
    odd += [(-20, "long words here " * 40_000, "en", "s", None), (-21, "long words here " * 40_000, "en", "s", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").unionByName(good)
    docs = docs.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(CLASHES)])
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        if name == "pieces":
            assert len(rows) == docs.count() and all(r.round_trip for r in rows)
            continue
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes, name
        assert all(r[c.strip("`")] == k for r in rows for k, c in enumerate(CLASHES)), name
        kept = {r.doc_id for r in rows}
        if name == "line_dedup":
            text = {r.doc_id: (r.text, r.n_chars) for r in rows}
            assert kept == ids and text[-1] == (None, None) and text[-11] == ("own text 1", 10) and text[-10] == (f"{line}\nown text 0", 7)
        elif name == "simhash":
            assert {None, -3, -21, -13} <= kept and not {-1, -2, -20} & kept
            assert sum(r.doc_id == -13 for r in rows) == 2
        elif name == "decontaminate":
            assert {None, -1, -2, -3, -20, -21} <= kept


def test_stages_without_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "doc_id").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == ["text", "doc_id"], name
        stage(spark, docs, SF).collect()
