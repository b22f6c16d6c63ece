"""The pipeline: every stage's decisions take effect, on rows of its own."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(6)
    en, fr = ["the", "moon", "over", "water", "light", "under", "stone", "bird", "song", "night", "wind", "tree"], ["le", "ciel", "avec", "pluie", "sous", "pierre", "oiseau", "chanson", "nuit", "vent", "arbre", "pour"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(k, text(en if k % 2 else fr, rng.randint(40, 120)), "en" if k % 2 else "fr", f"s{k % 3}") for k in range(120)]
    secret = " ".join(rng.choice(en) + str(k) for k in range(20))
    rows += [(200, "12 34 !!", "en", "s0"), (201, "&&% $$# @@! ^^* ~~` }}{ ][ " * 30 + " a", "en", "s0"), (202, rows[5][1], "en", "s1"), (203, rows[6][1] + " le", "fr", "s1"), (204, secret, "en", "s2"), (205, None, "en", "s2"), (7, rows[7][1], "en", "s1"), (None, text(en, 50), "en", None)]
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, docs, world)
        assert left.columns == docs.columns
        before, after = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in left.collect()]
        gone[name] = sorted(set(before) - set(after), key=str)
        docs = spark.createDataFrame(left.collect(), docs.schema)
    assert {200, 205} <= set(gone["language_id"]) <= {200, 201, 205}
    assert 201 in gone["quality"] + gone["language_id"] and len(gone["quality"]) <= 4
    assert {202, 203} <= set(gone["near_duplicates"]) and docs.where("doc_id = 7").count() == 1
    assert gone["decontamination"] == [204] or 204 in gone["quality"]
    assert docs.where("doc_id IS NULL").count() == 1
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, world)
    assert 0 < mixed.count() <= docs.count() and mixed.where("taken <= 0 OR taken > 3 * size").count() == 0


def test_near_duplicates_go_by_row(spark, world):
    """Rows of one id are judged each by its own text; of equal rows one stays; columns of any name may be there."""
    t, u, v = ("words of a text that stands on several rows " * 3, "another text of that id which nothing else resembles at all " * 2, "a text without an id that is there on two rows of other sources")
    rows = [(1, t, "a"), (2, t, "a"), (2, u, "a"), (3, u + " more", "b"), (4, "a b", "a"), (4, "a b", "a"), (None, v, "a"), (None, v, "b"), (5, None, "a"), (6, "", "a")]
    schema = "doc_id long, text string, source string, gone_id long, row_digest string, row_number int, n long, id long, component string"
    docs = spark.createDataFrame([(*r, 0, "x", 1, 2, 3, "y") for r in rows], schema)
    left = corpus_pipeline.by_near_duplicates(spark, docs, world)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(1, t), (2, u), (4, "a b"), (None, v), (5, None), (6, "")], key=str)


def test_stages_equal_brute_force(spark, world):
    """Decontamination and near duplicates of a whole table against sets of words in Python, the mix against SQL."""
    import duckdb

    from lumengrid.llm import mixing
    from lumengrid.llm.common import words_of

    docs = spark.read.parquet(f"{world}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    item = words_of(spark.read.parquet(f"{world}/benchmark.parquet").first()["text"])
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

    def hit(text):
        w = words_of(text)
        places = {p for i in range(len(w)) if tuple(w[i : i + 13]) in windows for p in range(i, i + 13)}
        return bool(places) and 20 * len(places) >= len(w)

    clean = corpus_pipeline.by_benchmark(spark, docs, world)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in rows if not hit(r[1])), key=str)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    kept: list[int] = []
    for k in order:  # here groups are pairs, so the first of a group is what a row resembles
        if not any(sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in kept):
            kept.append(k)
    left = corpus_pipeline.by_near_duplicates(spark, docs, world)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted((rows[k] for k in kept), key=str)
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).toPandas()
    duck = duckdb.connect()
    duck.register("documents", once)
    duck.register("labels", spark.read.parquet(f"{world}/labels.parquet").toPandas())
    want = sorted((r[0], r[4]) for r in duck.sql(mixing.ORACLE).fetchall() if r[4] > 0)
    mixed = corpus_pipeline.by_mix(spark, spark.createDataFrame(once, docs.schema), world)
    assert sorted((r["doc_id"], r["taken"]) for r in mixed.collect()) == want


def test_run(spark, world):
    rows = corpus_pipeline.run(spark, world).collect()
    assert rows and {r["doc_id"] for r in rows}.isdisjoint({200, 201, 202, 203, 205})


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
