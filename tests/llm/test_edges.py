"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every corpus operator."""

from __future__ import annotations

from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lumengrid.llm import decontamination, embedding_dedup, jaccard_join, language_id, licenses, mixing, preferences, quality, token_counts, toxicity

LONG = "word and other words of a long text. " * 9000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, quality string, lm string, items string, y int, rated_id long, trusted_id long, gone_id long, lm_a long, text_1 long, kept boolean, id long, component string"


@lru_cache
def docs(spark):
    rows = [
        (1, "The cat sat on the mat and looked at the moon tonight.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "   \n\t ", "en", None), (5, LONG, "en", "a"),
        (6, "Le chat est assis sur le tapis et regarde la lune ce soir.", "fr", "b"), (6, "Le chat est assis sur le tapis et regarde la lune ce soir.", "fr", "b"), (None, "A text without an id.", "en", "a"), (7, "!!! ??? 12", "en", None), (8, "\x00 ퟿ é 語", None, "a"),
    ]
    return spark.createDataFrame([(*r, 0, 0.0, "x", "y", "z", 1, 2, 3, 4, 5, 6, True, 7, "c") for r in rows], DOCS)


@lru_cache
def empty(spark):
    return spark.createDataFrame([], DOCS)


@lru_cache
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (5, None, None), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")


def test_language_id(spark):
    d = docs(spark)
    model = language_id.train(d)
    got = {r["doc_id"]: (r["p"]["lang_pred"], r["p"]["score"]) for r in d.select("doc_id", language_id.predict(d, model).alias("p")).collect()}
    assert got[2] == got[3] == got[4] == got[7] == ("und", 0.0)
    assert got[1][0] == "en" and got[6][0] == "fr" and got[5][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language_id.train(empty(spark))
    assert {r["p"]["lang_pred"] for r in d.select(language_id.predict(d, none).alias("p")).collect()} == {"und"}
    assert empty(spark).select(language_id.predict(empty(spark), model)).count() == 0


def test_mixing(spark):
    got = mixing.mix(docs(spark), ratings=spark.createDataFrame([(1, 0.3), (1, None), (6, -1.0), (None, 1.0)], "doc_id long, quality double")).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"] and (r["doc_id"] != 2 or r["size"] == 0)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    assert abs(sum(rows[0]["target"] for rows in by.values()) - sum(r["size"] for r in got)) < 1e-3
    assert mixing.mix(empty(spark)).count() == 0


def test_decontamination(spark):
    d = docs(spark)
    bench = spark.createDataFrame([(1, "the CAT sat"), (1, "the CAT sat"), (2, None), (3, ""), (None, "moon"), (4, "le tapis et")], "item_id long, text string")
    got = {r["doc_id"]: r["f"] for r in d.select("doc_id", decontamination.occurrences(d, bench).alias("f")).collect()}
    assert got[1]["n_hit"] == 3 and got[1]["items"] == ["1"] and [tuple(s) for s in got[1]["spans"]] == [(0, 3)]
    assert got[6]["items"] == ["4"] and got[2]["n_words"] == got[3]["n_words"] == got[4]["n_words"] == 0
    assert got[5]["n_words"] == 8 * 9000 and got[5]["n_hit"] == 0
    nothing = d.select(decontamination.occurrences(d, bench.limit(0)).alias("f")).collect()
    assert all(r["f"]["n_hit"] == 0 for r in nothing)
    assert empty(spark).select(decontamination.occurrences(empty(spark), bench)).count() == 0


def test_decontamination_in_blocks(spark):
    d = docs(spark)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat sat", "sat on the mat", "looked at", "le tapis et", "words of a long"])], "item_id long, text string")
    rows = [[(r["doc_id"], r["f"]["n_hit"], r["f"]["items"], r["f"]["spans"]) for r in d.select("doc_id", decontamination.occurrences(d, bench, block_bytes=b).alias("f")).collect()] for b in (1 << 20, 12)]
    assert rows[0] == rows[1]


def test_jaccard_join(spark):
    d = docs(spark)
    got = sorted(jaccard_join.links(d).collect(), key=lambda r: (r["doc_id"] or -1))
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_links"] == 1 and by[6]["component_id"] == 6 and by[6]["kept"]
    assert by[2]["n_links"] == by[3]["n_links"] == by[4]["n_links"] == 0 and by[2]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert jaccard_join.links(empty(spark)).count() == 0


def test_embedding_dedup(spark):
    e = [0.6, 0.8, 0.0]
    rows = [(1, e, 1), (2, e, 1), (3, [1.2, 1.6, 0.0], 1), (4, e, 2), (5, e, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [None, 1.0, 0.0], 1), (10, [], 1), (11, [0.6, 0.8], 1), (None, e, 1), (12, [float("inf"), 1.0, 0.0], 1)]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(d).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and got[None] == (0, None, True)
    assert embedding_dedup.links(d.limit(0)).count() == 0


def test_quality(spark):
    d = docs(spark)
    rows = quality.classify(d, labels(spark)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[2]["kept"] and by[2]["perplexity"] is None and by[3]["perplexity"] is None
    assert by[1]["perplexity"] > 0 and sum(r["doc_id"] == 6 for r in rows) == 2
    assert quality.classify(d, labels(spark).limit(0)).where("kept").count() == 10
    assert quality.classify(empty(spark), labels(spark)).count() == 0


def test_toxicity(spark):
    d = docs(spark)
    rows = toxicity.sample(d, labels(spark), F.lit(True), toxicity.Settings())
    assert len(rows) == 2  # equal rows once, no null id
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.predict(d, model).alias("s")).collect()}
    assert got[2] == got[3] == got[4] == toxicity.EMPTY
    assert all(0 <= s <= 1 for s in got.values())
    assert empty(spark).select(toxicity.predict(empty(spark), toxicity.fit([], []))).count() == 0


def test_licenses(spark):
    d = docs(spark)
    model = licenses.train(d)
    got = d.select("doc_id", licenses.licences(d, model).alias("f")).collect()
    assert all(r["f"] == [] for r in got)
    assert empty(spark).select(licenses.licences(empty(spark), licenses.train(empty(spark)))).count() == 0


def test_token_counts(spark):
    d = docs(spark)
    got = {r["doc_id"]: r["t"] for r in d.select("doc_id", token_counts.counts(d).alias("t")).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 0
    assert got[5]["n_words"] == 8 * 9000 <= got[5]["n_tokens"]
    assert empty(spark).select(token_counts.counts(empty(spark))).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_preferences(spark, limit):
    rows = [
        (0, 0, "user", "Hi"), (0, 1, "assistant", "Yes"), (1, 0, "user", "Hi"), (1, 1, "assistant", "No"), (2, 0, "user", "Alone"), (4, 0, None, None), (5, 0, None, None), (6, None, "user", "<|end|>"), (6, 1, "assistant", "a"), (6, 1, "assistant", "a"), (7, 0, "user", "x"), (None, 0, "user", "no id"),
    ]
    t = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n int")
    t = t if limit is None else t.limit(limit)
    got = {r["pair_id"]: r for r in preferences.pairs(t, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 1).collect()}
    if limit == 0:
        assert not got
        return
    assert set(got) == {0, 2, 3}
    assert got[0]["n_prompt"] == 1 and got[0]["prompt"] == "<|user|>\nHi<|end|>\n" and got[0]["chosen"] == "<|assistant|>\nYes<|end|>\n"
    (span,) = got[0]["chosen_mask"]
    assert got[0]["chosen"][span["start"] : span["stop"]] == "Yes<|end|>"
    assert got[2]["n_prompt"] == 1 and got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt"] == "<|unknown|>\n<|end|>\n"
    assert got[3]["n_prompt"] == 0 and got[3]["chosen"].count("<|assistant|>") == 2 and "< |end|>" in got[3]["chosen"]
