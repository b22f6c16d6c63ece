"""The licence model against one that is fitted on every distinct paragraph, listed in Python."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from lumengrid.llm import licenses


def listed(docs, draft) -> tuple[list, list]:
    """The distinct paragraphs of docs that resemble no notice: those that train, and those apart."""
    every = sorted({b" ".join(p) for r in docs.collect() for p in licenses.paragraphs(r["text"])})
    every = [p for p in every if not licenses.resembling(p.split(), draft.known, draft.content)]
    apart = [int(np.uint64(xxhash.xxh3_64_intdigest(p, 17)).view(np.int64)) % licenses.HELD_OUT == 0 for p in every]
    return [p.split() for p, x in zip(every, apart, strict=True) if not x], [p.split() for p, x in zip(every, apart, strict=True) if x]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    words = "free software moon file warranty use work permission sea public copy zug blim the of version".split()
    texts = ["\n".join(" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(30)) for _ in range(60)]
    return spark.createDataFrame([(t,) for t in [*texts, *texts[:9], "Released under the MIT License.", "", None]], "text string").repartition(3)


def test_weights_and_threshold_are_of_all_paragraphs(docs):
    model, draft = licenses.train(docs), licenses.Draft([b"w%d" % k for k in range(5000)])
    learned, apart = listed(docs, draft)
    assert len(learned) > 1000 and len(apart) > 200
    other = draft.fitted(draft.points(learned), draft.points(apart))
    assert np.allclose(other.weights, model.weights, atol=1e-9)
    assert np.allclose(other.calibration, model.calibration) and other.threshold == pytest.approx(model.threshold, abs=1e-9)


def test_views_that_stay_on_the_executors_give_the_same(docs):
    draft, far = licenses.Draft([b"w1"]), licenses.Draft([b"w1"])
    learned, apart = listed(docs, draft)
    found = licenses.seen(docs, far)
    parts = [licenses.FarPoints(found.where(f"apart = {x}").select("size", "features", "times")) for x in (False, True)]
    assert [p.total for p in parts] == [len(learned), len(apart)]
    other, model = draft.fitted(draft.points(learned), draft.points(apart), 3), far.fitted(*parts, 3)
    assert np.allclose(other.weights, model.weights, atol=1e-9)
    assert other.threshold == pytest.approx(model.threshold, abs=1e-3)
