"""The pipeline's language model against one that is worked out in Python from every labelled text."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lumengrid.llm import language_id


def test_weights_and_floors_are_of_all_labelled_texts(spark):
    rng = random.Random(8)
    words = {"en": ["moon", "over", "water", "light"], "fr": ["ciel", "avec", "pluie", "sous"]}
    rows = [(" ".join(rng.choice(words[x]) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(rng.randint(5, 60))), x) for _ in range(150) for x in words]
    docs = spark.createDataFrame([*rows, (None, "en"), ("no label", None)], "text string, lang string").repartition(3)
    settings = language_id.Settings(rows_per_language=8, rows=16, landmarks_per_language=4)
    model = language_id.train_with_floors(docs, settings=settings)

    apart = F.pmod(F.xxhash64("text", F.lit(settings.seed + 1)), F.lit(language_id.HELD_OUT)) == 0
    dealt = [(r["text"], r["lang"], r["apart"]) for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("apart", apart).collect()]
    learned, held = [(t, x) for t, x, a in dealt if not a], [(t, x) for t, x, a in dealt if a]
    marks = language_id.sample(docs.where(~apart), "text", "lang", settings)
    other, root = language_id.basis([t for t, _ in marks], [x for _, x in marks], ["en", "fr"], settings)
    assert np.array_equal(other.codes, model.codes) and len(marks) < 40 < len(held)
    scorer = language_id.Scorer(other)
    phi = scorer.kernel([scorer.grams.distinct(t) for t, _ in learned]).astype(float) @ root
    y = np.array([[x == "en", x == "fr"] for _, x in learned], float)
    weight = (len(learned) / 2 / y.sum(0))[y.argmax(1)][:, None]
    weights = root @ np.linalg.solve((phi * weight).T @ phi + settings.ridge * len(learned) * np.eye(phi.shape[1]), (phi * weight).T @ y)
    assert np.allclose(weights, model.weights, rtol=1e-3, atol=1e-4)

    names, scores = language_id.Scorer(model).predict([t for t, _ in held])
    of = np.searchsorted(language_id.CLASSES, [len(t) for t, _ in held], side="right")
    right = np.array([n == x for n, (_, x) in zip(names, held, strict=True)])
    for c in range(3):
        mine = np.sort(scores[right & (of == c)] if (right & (of == c)).sum() >= language_id.LEAST_HELD else scores[right])
        at = mine[int(np.ceil(language_id.MISSED * len(mine))) - 1]
        assert abs(model.floors[c] - language_id.OF_LEAST * at) <= 2 * language_id.BIN
