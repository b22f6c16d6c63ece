"""Each method against a brute-force version, and classifiers on held-out rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengrid.llm import components, decontamination, embedding_dedup, jaccard_join, language_id, licenses, quality, registry, token_counts, toxicity
from lumengrid.llm.common import words_of

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same):
    same(registry.queries()[name], ORACLES[name])


# --- automaton -------------------------------------------------------------------------------------------------------
def greedy(word: bytes, begin: set[bytes], follow: set[bytes]) -> int:
    at, n = 0, 0
    while at < len(word):
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in (begin if at == 0 else follow)), None)
        if stop is None:
            return 1
        at, n = stop, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.text("abc", max_size=12))
def test_automaton_counts_as_greedy_matching(begin, follow, word):
    begin, follow = {b.encode() for b in begin}, {f.encode() for f in follow}
    assert token_counts.Automaton(begin, follow).count(word.encode()) == greedy(word.encode(), begin, follow)


def test_automaton_on_public_vocabulary():
    begin, follow = token_counts.read_vocabulary()
    automaton, b, f = token_counts.Automaton(begin, follow), set(begin), set(follow)
    for word in "internationalisation é über 語 (hello), x==1 aaaaaaaaaaaaaaaaaaaaaaab Ñandú 12345".split():
        assert automaton.count(word.encode()) == greedy(word.encode(), b, f)


# --- FM-index --------------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(symbols, phrases):
    """Symbol 3 is foreign."""
    s = np.array(symbols)
    if not (s < 3).any():
        return
    index = decontamination.FMIndex(s, 3)
    for phrase in phrases:
        which, low, high = index.search(np.array([phrase]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
        assert got == [i for i in range(len(symbols) - len(phrase) + 1) if symbols[i : i + len(phrase)] == phrase]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=300), st.integers(0, 9))
def test_wavelet_ranks(symbols, symbol):
    s = np.array(symbols)
    at = np.arange(len(s) + 1)
    assert decontamination.WaveletMatrix(s, 10).rank(np.full(len(at), symbol), at).tolist() == [symbols[:i].count(symbol) for i in at]


def test_scan_equals_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    items = [(str(k), " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 9)))) for k in range(12)]
    block = decontamination.phrases(items, 4)
    results = [decontamination.Scanner(block, words).scan(texts) for words in (1 << 18, 50, 7)]
    assert results[0] == results[1] == results[2]  # also where a text is many shards
    for text, (n, n_hit, found, spans) in zip(texts, results[0], strict=True):
        words, hit, held = text.split(), set(), set()
        for item, phrase in items:
            p = phrase.split()
            m = min(4, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == p[i : i + m]:
                        hit |= set(range(at, at + m))
                        held.add(item)
        assert (n, n_hit, found) == (len(words), len(hit), sorted(held))
        assert {i for a, b in spans for i in range(a, b)} == hit and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


# --- similarity joins ------------------------------------------------------------------------------------------------
def test_shared_counts_equal_brute_force():
    rng = np.random.default_rng(2)
    for n, m, most, size in ((5, 7, 40, 12), (70, 50, 300, 60), (200, 200, 30, 9)):
        sets = [np.unique(rng.integers(0, most, size).astype(np.uint64)) for _ in range(n + m)]
        exact = np.array([[len(np.intersect1d(a, b)) for b in sets[n:]] for a in sets[:n]])
        assert np.array_equal(jaccard_join.shared_counts(sets[:n], sets[n:]), exact)
        own = jaccard_join.shared_counts(sets[:n], None)
        off = ~np.eye(n, dtype=bool)
        assert np.array_equal(own[off], np.array([[len(np.intersect1d(a, b)) for b in sets[:n]] for a in sets[:n]])[off])


def near_copies(seed: int = 5) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 25 + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base)))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that groups are cut."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    linked = {k: {j for j in sets if j != k and Fraction(len(sets[k] & sets[j]), len(sets[k] | sets[j])) >= Fraction(4, 5)} for k in sets}
    got = {r["doc_id"]: r for r in jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in sets:
        reach, todo = {k}, [k]
        while todo:
            new = linked[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[k]["n_links"], got[k]["component_id"]) == (len(linked[k]), min(reach))
    assert sum(map(len, linked.values())) > 20


def test_shortest_prefix_reaches_recall():
    k = jaccard_join.shortest(0.8)
    assert jaccard_join.chance(0.8, k) >= jaccard_join.RECALL > jaccard_join.chance(0.8, k + 1)


def prefixes(row: np.ndarray, k: int) -> list[bytes]:
    return [int(x).to_bytes(8, "big")[:k] for x in row]


def test_meeting_equals_prefixes():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 3, (n, 6, 8)).astype(np.uint64) for n in (9, 7))
    pack = lambda x: sum(x[:, :, i] << np.uint64(8 * (7 - i)) for i in range(8))
    a, b = pack(a), pack(b)
    for k in (1, 2, 3, 8):
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                same = [p == q for p, q in zip(prefixes(x, k), prefixes(y, k), strict=True)]
                deeper = k < 8 and any(p == q for p, q in zip(prefixes(x, k + 1), prefixes(y, k + 1), strict=True))
                assert jaccard_join.meeting(a, b, k)[i, j] == (any(same) and not deeper)
                for tree in range(6):
                    assert jaccard_join.meeting(a, b, k, tree)[i, j] == (any(same) and not deeper and same.index(True) == tree)


def test_recall_of_the_forest(spark):
    """Links found, as prefixes are shortened, against all pairs; and the recall that the forest measures itself."""
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(9000)}" for _ in range(100)]
        for _ in range(3):
            text = list(base)
            for at in rng.sample(range(100), rng.randint(0, 3)):
                text[at] = f"w{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(text)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(96)} for k, t in rows}
    exact = {k: sum(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(k - k % 3, k - k % 3 + 3) if j != k) for k in sets}
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(exact.values()) > 300 and all(got[k] <= exact[k] for k in sets)
    assert sum(got.values()) >= 0.9 * sum(exact.values())


def test_links_by_trie_node(spark, monkeypatch):
    """A chain of texts, each like the next alone, is dealt by trie node; the links are those of whole groups."""
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 300])) for k in range(150)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    linked = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    found = []
    units = jaccard_join._units
    monkeypatch.setattr(jaccard_join, "_units", lambda *a: found.append(units(*a)) or found[-1])
    got = sorted(jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    assert [r["n_links"] for r in got] == linked and {r["component_id"] for r in got} == {0}
    assert any(u.where("tree >= 0").count() for u in found)


def test_lookup_of_hot_keys(spark, monkeypatch):
    from lumengrid.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k % 4 if k % 9 else None, k) for k in range(60)] + [(9, 100)], "k int, v int")
    found = rows.where("k IS NOT NULL AND k < 9").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    got = {(r["k"], r["v"], r["least"]) for r in common.lookup(rows, found, ["k"], "n").collect()}
    least = {k: min(v for v in range(60) if v % 9 and v % 4 == k) for k in range(4)}
    assert got == {(r["k"], r["v"], least.get(r["k"])) for r in rows.collect()}


def test_prefix_meets_as_often_as_similarity_says():
    rng, forest = np.random.default_rng(8), jaccard_join.Forest()
    met = tried = 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2))
        same = forest.strings(a).view(np.uint64) >> np.uint64(56) == forest.strings(b).view(np.uint64) >> np.uint64(56)
        met, tried = met + same.sum(), tried + len(same)
    assert abs(met / tried - 0.8) < 0.04


def vectors(seed: int = 1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(30):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist(), label))
    return rows


@pytest.mark.parametrize("block", [3000, 20])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that labels are cut into cells and pairs of blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", block)
    rows = vectors()
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    hit = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    least = components.spanning(len(rows), np.argwhere(hit))
    got = {r["vec_id"]: r for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[k]["n_links"] for k in range(len(rows))] == hit.sum(1).tolist()
    assert [got[k]["component_id"] for k in range(len(rows))] == least.tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.integers(0, 10**6))
def test_cover_tree_covers_and_joins(n, m, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.normal(size=(k, 4)) for k in (n, m))
    a[: n // 2] = a[0] + rng.normal(size=(n // 2, 4)) * 0.05
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    tree = embedding_dedup.CoverTree(a)
    for level, (centres, starts, radius) in enumerate(zip(tree.centres, tree.starts, tree.radius, strict=True)):
        assert sorted(tree.order.tolist()) == list(range(n)) and (radius <= 2.0 ** (1 - level) + 1e-9).all() or level == 0 or (np.diff(starts) <= tree.FEW).any()
        assert len(centres) == len(starts) - 1
    ones = np.ones(n, np.int64), np.ones(m, np.int64)
    got = embedding_dedup.Joined(a, b, ones, 0.9, False)
    assert np.array_equal(got.links_a, (a @ b.T >= 0.9).sum(1)) and np.array_equal(got.links_b, (a @ b.T >= 0.9).sum(0))
    own = a @ a.T >= 0.9
    np.fill_diagonal(own, False)
    self_join = embedding_dedup.Joined(a, a, (ones[0], ones[0]), 0.9, True)
    assert np.array_equal(self_join.links_a + self_join.links_b, own.sum(1))


@pytest.mark.parametrize("bound", [0, 1000])
def test_components(spark, monkeypatch, bound):
    """By steps over all edges, and in one task."""
    monkeypatch.setattr(components, "ONE_TASK", bound)
    edges = [(5, 4), (4, 3), (3, 2), (10, 11), (12, 11), (7, 7), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 20)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 10: 10, 11: 10, 12: 10, **{k: 20 for k in range(20, 26)}}


# --- language model --------------------------------------------------------------------------------------------------
def kneser_ney(texts: list[str]):
    """log P of a character after its context, by the textbook; digits are one character, blanks another."""
    plain = lambda t: ["^"] * 4 + ["0" if c in "0123456789" else " " if c in "\t\n\r" else c for c in t]
    counts = [None, *[Counter() for _ in range(5)]]
    for t in texts:
        s = plain(t)
        for i in range(4, len(s)):
            counts[5][tuple(s[i - 4 : i + 1])] += 1
    for k in range(4, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    stats = [None]
    for k in range(1, 6):
        t = [sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            d = [min(float(i), max(0.05, i - (i + 1) * y * t[i] / t[i - 1])) for i in (1, 2, 3)]
        else:
            d = [0.5] * 3
        total, left = defaultdict(float), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        stats.append((d, total, left))

    def p(g: tuple, k: int) -> float:
        d, total, left = stats[k]
        h = g[:-1]
        if k == 1:
            base = left[h] / total[h] / (len(counts[1]) + 1)
        else:
            base = p(g[1:], k - 1)
            if h not in total:
                return base
            base *= left[h] / total[h]
        c = counts[k].get(g, 0)
        return (max(0, c - d[min(c, 3) - 1]) / total[h] if c else 0) + base

    def score(text: str) -> float:
        s = plain(text)
        return sum(math.log(p(tuple(s[i - 4 : i + 1]), 5)) for i in range(4, len(s)))

    return score


@pytest.mark.parametrize("batch", [10**9, 40])
def test_language_model_equals_brute_force(spark, monkeypatch, batch):
    """Also in many batches, and where texts are cut into pieces; of CJK letters every one is told apart."""
    monkeypatch.setattr(quality, "LEAST_BATCH_BYTES", batch)
    monkeypatch.setattr(quality, "PIECE", min(batch, 1000))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd  e12\n漢字語😀") for _ in range(rng.randint(0, 60))) for _ in range(25)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    score = kneser_ney(texts)
    asked = [*texts[:6], "zzz new ab", "", "a", "譽" * 9, texts[1], None]
    docs = spark.createDataFrame([(t,) for t in asked], "text string")
    scores = quality.scored(docs, model, batch_bytes=batch)
    got = {r["text"]: r for r in docs.select("text", *quality.digest("text")).join(scores, ["text_1", "text_2"]).collect()}
    assert set(got) == {t for t in asked if t}
    for t in got:
        assert got[t]["chars"] == len(t) and got[t]["logp"] == pytest.approx(score(t), rel=1e-9, abs=1e-9)
        assert got[t]["copies"] == asked.count(t)


def test_thresholds_equal_brute_force(spark, sf_dir):
    """The whole query on a whole table against the textbook model and quantiles of the texts that it didn't count."""
    got = {r["doc_id"]: r for r in registry.op6_quality_classifier(spark, sf_dir).collect()}
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", "lang", *quality.digest("text"), F.pmod(F.xxhash64("text"), F.lit(quality.HELD_OUT)).alias("fold")).collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    trusted = [r for r in rows if r["doc_id"] in good and r["text"]]
    score = kneser_ney([r["text"] for r in trusted if r["fold"]])
    nll = {t: -score(t) / len(t) for t in {r["text"] for r in rows if r["text"]}}
    middle = lambda x: (math.floor(x / quality.BIN) + 0.5) * quality.BIN
    at = lambda v, q: middle(sorted(v)[max(0, math.ceil(q * len(v) - 1e-9) - 1)])
    held = defaultdict(dict)
    for r in trusted:
        if not r["fold"]:
            held[r["lang"] or ""][r["text"], r["lang"]] = nll[r["text"]]
    every = [x for v in held.values() for x in v.values()]
    spread = lambda v: max(at(v, 0.9) - at(v, 0.5), 4 * quality.BIN)
    wide, top = spread(every), at(every, 0.5) + quality.REACH * spread(every)
    limits = {}
    for lang, v in held.items():
        v = list(v.values())
        own = spread(v) if len(v) >= quality.LEAST_TRUSTED else max(spread(v), wide)
        limit = at(v, 0.5) + quality.REACH * own
        limits[lang] = at(v, 0.5), limit if len(v) >= quality.LEAST_TRUSTED else max(limit, top)
    for r in rows:
        x, limit = got[r["doc_id"]], limits.get(r["lang"] or "")
        if not r["text"]:
            assert x["kept"] and x["perplexity"] is None
            continue
        n = len(r["text"])
        drawn = (nll[r["text"]] * n + 100 * limit[0]) / (n + 100) if limit else nll[r["text"]]
        assert x["nll"] == pytest.approx(drawn, rel=1e-9) and x["perplexity"] == pytest.approx(math.exp(nll[r["text"]]), rel=1e-9)
        assert x["threshold"] == (pytest.approx(limit[1]) if limit else None)
        assert x["kept"] == (limit is None or drawn <= limit[1])


@pytest.mark.parametrize("trusted", [8, 40])
def test_unseen_texts_of_a_small_language_are_kept(spark, trusted):
    """The thresholds come from texts that the model did not count, also where the language has few."""
    rng = random.Random(4)
    tongue = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("x", "abcdefgh"), ("y", "mnopqrst"))}
    text = lambda lang: " ".join(rng.choice(tongue[lang]) for _ in range(rng.randint(30, 60)))
    rows = [(k, text("x"), "x") for k in range(200)] + [(1000 + k, text("y"), "y") for k in range(trusted + 40)]
    junk = [(2000 + k, "".join(rng.choice("0#%&$@!uvw") for _ in range(200)), "x") for k in range(10)]
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(160), *range(1000, 1000 + trusted)]], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string"), labels).where("NOT kept")
    gone = {r["doc_id"] for r in got.collect()}
    assert {2000 + k for k in range(10)} <= gone and len(gone) <= 12


def test_long_texts_are_scored_in_pieces():
    texts = ["abc" * 50, None, "xy", "hello world " * 30]

    def every(size):
        found = []
        for piece, which, lengths, _ in quality.pieces(texts, size):
            g = quality.Grams(piece, lengths)
            found += zip(np.repeat(which, lengths).tolist(), g.high[g.index].tolist(), g.low[g.index].tolist(), strict=True)
        return sorted(found)

    assert every(10**6) == every(17)


# --- classifiers -----------------------------------------------------------------------------------------------------
def letter_grams(text: str) -> set[tuple[str, ...]]:
    """The distinct n-grams, by Python sets; a run of anything but letters is one blank."""
    s = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    s = re.sub(" +", " ", s)
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} if len(s) > 1 else set()


def kernel_ridge(texts, languages, settings):
    """Nyström kernel ridge regression from kernel values of sets."""
    sets = [letter_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    names = sorted(set(languages))
    each = max(1, min(settings.landmarks_per_language, settings.max_landmarks // len(names)))
    marks = [sets[i] for n in names for i in [j for j, x in enumerate(languages) if x == n and sets[j]][:each]]
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    rows = [i for i in range(len(texts)) if sets[i]]
    phi = np.array([[kernel(sets[i], m) for m in marks] for i in rows]) @ root
    y = np.array([[float(languages[i] == n) for n in names] for i in rows])
    w = np.array([len(rows) / len(names) / max(1, y[:, j].sum()) for j in y.argmax(1)])[:, None]
    beta = np.linalg.solve(phi.T @ (phi * w) + settings.ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ (y * w))

    def predict(text):
        s = letter_grams(text or "")
        if not s:
            return "und", 0.0
        margin = np.array([kernel(s, m) for m in marks]) @ root @ beta
        return names[int(margin.argmax())], float(np.clip(margin.max(), 0, 1))

    return predict


def test_language_query_equals_brute_force(spark, sf_dir):
    """The whole query against kernel ridge regression by Python sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.sample(docs.where(registry.fold(3) != 1), "text", "lang", language_id.Settings())
    predict = kernel_ridge([t for t, _ in rows], [x for _, x in rows], language_id.Settings())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = registry.op1_language_id(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        name, score = predict(texts[r["doc_id"]])
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=2e-3)


def test_languages_of_many_letters():
    """Chinese and Japanese share most of their letters and have thousands; none is folded into another."""
    rng = random.Random(3)
    han, kana = [chr(0x4E00 + k) for k in range(6000)], [chr(0x3042 + k) for k in range(60)]
    tongue = {"zh": [rng.choice(han) + rng.choice(han) for _ in range(2500)], "ja": [rng.choice(han) + rng.choice(kana) + rng.choice(kana) for _ in range(2500)]}
    text = lambda lang: "".join(rng.choice(tongue[lang]) for _ in range(80))
    rows = [(text(lang), lang) for _ in range(60) for lang in ("zh", "ja")]
    scorer = language_id.Scorer(language_id.fit([t for t, _ in rows[:80]], [x for _, x in rows[:80]]))
    assert scorer.predict([t for t, _ in rows[80:]])[0] == [x for _, x in rows[80:]]
    assert len({int(language_id.Grams((1,)).symbols(c)[1]) for c in han}) == 6000


def test_distinct_grams_equal_sets(monkeypatch):
    grams = language_id.Grams((1, 2, 3))
    texts = ["The cat sat.", "Le chat noir", "Ça va très bien", "zebra CAT", "", "x", "漢字 かな", "some words of a text " * 40]
    whole = [sorted(grams.distinct(t).tolist()) for t in texts]
    assert [len(x) for x in whole] == [len(letter_grams(t)) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", 13)
    assert whole == [sorted(grams.distinct(t).tolist()) for t in texts]


@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.01"


def test_held_out_language(spark, larger):
    got = registry.op1_language_id(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_toxicity_gradients():
    s = toxicity.Settings(hidden=3, attention=2, embedding=2, characters=2)
    rng = np.random.default_rng(0)
    p = {k: np.asarray(v, np.float64) for k, v in toxicity._start(s, rng).items() if k not in toxicity.TABLES}
    x = rng.normal(size=(5, 4, toxicity.FEATURES + 4))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y = np.array([1.0, 0, 1, 0])
    _, g = toxicity.gradients(p, x, mask, y, 3)
    for name in ("xf", "ub", "cf", "wa", "va", "wo", "bo", "in"):
        flat = (x if name == "in" else p[name]).reshape(-1)
        for i in rng.integers(0, len(flat), 3):
            flat[i] += 1e-5
            up = toxicity.gradients(p, x, mask, y, 3)[0]
            flat[i] -= 2e-5
            down = toxicity.gradients(p, x, mask, y, 3)[0]
            flat[i] += 1e-5
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def network(model, words: list[bytes]) -> float:
    """The logit of one window, a word at a time, by the equations."""
    p, h = model.weights, model.hidden
    inputs = []
    for w in words:
        b = toxicity.word_bucket(w)
        marked = b"<" + w + b">"
        tables, best, mean = [], [], 0.0
        for k, n in enumerate(toxicity.GRAMS):
            codes = toxicity.gram_buckets([w])[k][0]
            assert len(codes) == max(1, len(marked) - n + 1)
            odds = [float(model.odds.gram[c + k * toxicity.BUCKETS]) if c else 0.0 for c in codes]
            best.append(max(odds))
            mean += sum(odds) / len(odds) / 4
            tables += [p["chars"][(c & (toxicity.CHARACTERS - 1)) + k * toxicity.CHARACTERS] for c in codes if c]
        inputs.append(np.concatenate([[model.odds.word[b]], best, [mean], p["emb"][b], np.mean(tables, 0)]))
    sigma = lambda z: 1 / (1 + np.exp(-z))
    sides = []
    for side, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        state, states = np.zeros(h), {}
        for t in order:
            gx, gh = inputs[t] @ p["x" + side] + p["c" + side], state @ p["u" + side]
            r, z = sigma(gx[:h] + gh[:h]), sigma(gx[h : 2 * h] + gh[h : 2 * h])
            n = np.tanh(gx[2 * h :] + r * gh[2 * h :])
            state = (1 - z) * n + z * state
            states[t] = state
        sides.append([states[t] for t in range(len(words))])
    both = np.array([np.concatenate(x) for x in zip(*sides, strict=True)])
    a = np.exp(np.tanh(both @ p["wa"] + p["ba"]) @ p["va"])
    return float((a / a.sum()) @ both @ p["wo"] + p["bo"][0])


def test_toxicity_equals_brute_force(spark, sf_dir, monkeypatch):
    """The whole query against the network run a window and a word at a time over every window of every text."""
    made = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    got = {r["doc_id"]: r["score"] for r in registry.op7_toxicity(spark, sf_dir).collect()}
    model, docs = made[0], spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    for doc, text in sorted(texts.items(), key=lambda x: len(x[1] or ""))[::9]:
        words = words_of(text)
        if len(words) > 700:
            continue
        if not words:
            assert got[doc] == toxicity.EMPTY
            continue
        each = [network(model, words[at : at + 32]) for at in range(0, len(words), 16) if at == 0 or at + 16 < len(words)]
        top = int(np.argmax(each))
        apart = [x for k, x in enumerate(each) if abs(k - top) > 1]
        second = max(apart) if apart else min(each[top], model.alone)
        a, b, c = model.scale
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-(a * each[top] + b * second + c))), abs=2e-3)


def test_segments_have_the_windows_of_the_whole(monkeypatch):
    for n in (0, 1, 16, 17, 40, 100, 129, 144, 145, 500):
        text = " ".join(f"w{k}" for k in range(n))
        words = words_of(text)
        whole = [words[at : at + 32] for at in toxicity.windows(n)] if n else []
        monkeypatch.setattr(toxicity, "SEGMENT", 64)
        assert [s[at : at + 32] for s in toxicity.segments(text) for at in toxicity.windows(len(s))] == whole


def toxic_corpus(n: int, seed: int):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        if k % 5 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), "vilx" + rng.choice(["ing", "ed", "", "er"]))
        texts.append(" ".join(text))
        labels.append(int(k % 5 == 0))
    return texts, labels


def test_toxicity_on_held_out_texts():
    texts, labels = toxic_corpus(600, 1)
    model = toxicity.fit(texts[:450], labels[:450])
    scores = toxicity.Scorer(model).scores(texts[450:])
    hit = scores >= 0.3
    y = np.array(labels[450:]) == 1
    assert (hit & y).sum() >= 0.9 * y.sum() and (hit & ~y).sum() <= 0.05 * (~y).sum()


def test_toxicity_reads_to_the_last_word():
    texts, labels = toxic_corpus(400, 2)
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    plain = " ".join(texts[1].split()[:20])
    late = (plain + " ") * 60 + " vilxing vilxed"
    assert scorer.scores([late])[0] > 0.5 > scorer.scores([(plain + " ") * 60])[0]
    assert np.allclose(scorer.scores([late, plain, None]), [scorer.scores([t])[0] for t in (late, plain, None)], atol=1e-5)


def licence_probability(model, words: list[bytes]) -> tuple[str, float]:
    """Family and calibrated probability from sets of n-grams, a dictionary and sums in Python."""
    w = [b"0" if x.isdigit() else x for x in words]
    sets = {(x,) for x in w if x not in licenses.PLAIN} | {tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
    mask = (1 << 64) - 1

    def code(gram):
        h = [licenses.xxhash.xxh3_64_intdigest(x) for x in gram]
        out = h[0]
        for x in h[1:]:
            out = ((out * 0x9E3779B97F4A7C15 + x) & mask) ^ (out >> 29)
        return out

    index = {int(f): k for k, f in enumerate(model.features)}
    hit = [index[c] for c in map(code, sets) if c in index]
    value = 1 / math.sqrt(max(1, len(sets)))
    z = model.weights[-1] + (1 - len(hit) / max(1, len(sets))) * value * model.weights[-2] + sum((model.weights[k] * value for k in hit), np.zeros(len(model.families) + 1))
    m = math.log(sum(math.exp(x) for x in z[:-1])) - z[-1]
    return model.families[int(np.argmax(z[:-1]))], 1 / (1 + math.exp(-(model.calibration[0] * m + model.calibration[1])))


def test_licence_query_equals_brute_force(spark, sf_dir):
    """The whole query, each paragraph by itself, without blocks, hashes in arrays or a sparse matrix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = licenses.train(docs)
    got = {r["doc_id"]: r for r in registry.op3_license_scan(spark, sf_dir).collect()}
    for r in docs.collect():
        found = []
        for words in licenses.paragraphs(r["text"]):
            family, p = licence_probability(model, words)
            if p >= model.threshold:
                found.append((family, p, max(licenses.likeness(words, licenses.pairs_of(licenses.words_in(n))) for n in licenses.NOTICES[family]) >= licenses.CONFIRMED))
        x, sure = got[r["doc_id"]], [f for f in found if f[2]]
        assert (x["n_paragraphs"], x["n_confirmed"], x["families"]) == (len(found), len(sure), ",".join(sorted({f for f, *_ in sure})))
        assert x["score"] == pytest.approx(max((p for _, p, _ in sure), default=0.0), abs=1e-9)


def scanned(model, *texts):
    return model.scan(texts, licenses.Numbers())


def test_licences():
    model = licenses.fit([words_of("some text of the corpus about the moon and the sea")] * 30)
    asked = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under CC BY-SA 3.0.": "CC-BY-SA", "This work is licensed under the GNU General Public License, version 2.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache", "All rights reserved.": "proprietary"}
    for text, family in asked.items():
        assert [(f, sure) for f, _, _, sure in scanned(model, f"A line before.\n{text}\nAnd after.")[0]] == [(family, True)], text
    for found in scanned(model, *licenses.EVERYDAY, "She got a license to drive in the park.", "", None):
        assert not any(x[3] for x in found)
    assert scanned(model, "word " * 500 + "released under the MIT License and no other " + "word " * 500)[0]


def test_licence_paragraphs_of_other_authors():
    """Notices that the model never saw, and sentences on licences that grant nothing."""
    model = licenses.fit([words_of("some text of the corpus about the moon and the sea")] * 30)
    notices = {"This repository is distributed under the terms of the MIT License, see LICENSE.": "MIT", "You may use this file under the Apache License version 2.0 only.": "Apache", "Distributed under the GNU General Public License version 3 or later.": "GPL", "Content is available under a Creative Commons Attribution 4.0 International License.": "CC-BY", "Subject to the terms of the Mozilla Public License, v. 2.0.": "MPL"}
    assert [[f for f, *_, sure in found if sure] for found in scanned(model, *notices)] == [[f] for f in notices.values()]
    plain = ["Dogs need a licence in this town.", "The restaurant lost its liquor license in May.", "He is free to redistribute the chairs.", "The MIT campus lies by the river.", "The general read the public notice.", "All the rights of way are reserved for cyclists on Sundays."]
    assert not any(sure for found in scanned(model, *plain) for *_, sure in found)


def test_unknown_paragraphs_come_from_all_places(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(licenses, "fit", lambda unknown, apart=(): drawn.extend([*unknown, *apart]))
    long = "\n".join(f"late{i} of text" for i in range(9000))
    licenses.train(spark.createDataFrame([(k, "\n".join(f"line{i} of text" for i in range(12))) for k in range(9)] + [(99, long)], "doc_id long, text string"), rows=10**6)
    assert {p[0] for p in drawn} == {b"line%d" % i for i in range(12)} | {b"late%d" % i for i in range(9000)}


def test_notices_among_the_unknown_are_dropped():
    model = licenses.fit([words_of(f"some text of the moon and the sea {k}") for k in range(60)] + [words_of("All rights reserved.")] * 60)
    assert [f[0] for f in scanned(model, "All rights reserved.")[0] if f[3]] == ["proprietary"]
