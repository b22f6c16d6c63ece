"""What workers hold while they work, and after."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lumengrid.llm import common, decontamination, jaccard_join, quality


def test_questions_hold_little_more_than_their_result():
    s = np.random.default_rng(1).integers(98, 120, (5, 50_000)).astype(np.uint64)
    high, low = s[0] << np.uint64(21) | s[1], s[2] << np.uint64(42) | s[3] << np.uint64(21) | s[4]
    tracemalloc.start()
    got = quality.asked(high, low)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(high)
    grams = {tuple(g) for g in s.T.tolist()}
    wanted = {g[-k:] for g in grams for k in range(1, 6)} | {g[-k:-1] for g in grams for k in range(2, 6)}
    symbols = lambda h, l: tuple(x for x in (h >> 21, h & 0x1FFFFF, l >> 42, l >> 21 & 0x1FFFFF, l & 0x1FFFFF) if x)
    assert sorted(map(symbols, *(x.tolist() for x in got))) == sorted(wanted)


def test_shared_counts_list_few_pairs_at_once():
    sets = [np.unique(np.append(np.arange(k % 40 * 20, k % 40 * 20 + 90, dtype=np.uint64), np.uint64(10_000 + k))) for k in range(2000)]
    tracemalloc.start()
    jaccard_join.shared_counts(sets, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20


def test_workers_release_memory_at_the_end(monkeypatch):
    times = []
    monkeypatch.setattr(common, "release", lambda: times.append(1))
    assert list(common.released(lambda b: (2 * x for x in b))(iter([1, 2]))) == [2, 4] and len(times) == 1
    some = common.released(lambda b: (2 * x for x in b))(iter([1, 2]))
    next(some)
    some.close()
    assert len(times) == 2


def test_word_hashes_hold_nothing():
    hashes = common.WordHashes()
    tracemalloc.start()
    for k in range(20):
        hashes.array([b"w%d" % i for i in range(k * 10_000, (k + 1) * 10_000)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20


def test_scans_of_the_pipeline_release_memory(spark, monkeypatch):
    times = []
    monkeypatch.setattr(common, "release", lambda: times.append(1))
    find = decontamination._finder(SimpleNamespace(value=decontamination.phrases([("1", "one two three")])))
    assert [len(x) for x in find.func(iter([pa.array(["a one two three", None])]))] == [2] and times == [1]


def test_driver_collects_its_garbage_while_tables_are_stored(spark):
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep")]
    whole = lambda: sum(b.getCollectionCount() for b in beans)
    before = whole()
    for _ in range(8):
        common.discard(common.stored(spark.range(3), "test"))
    assert whole() >= before + 2
