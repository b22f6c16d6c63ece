"""Benchmark decontamination with an FM-index for every shard of the training texts.

A shard is a run of documents of one Arrow batch, or a stretch of a long one; stretches overlap by the words that a phrase
may reach beyond its first. Its words become symbols of the benchmark's vocabulary; every other word, and the gap between
two documents, is a symbol of its own that no phrase holds, larger than the vocabulary and ordered by position. On that
string stand the suffix order, the Burrows-Wheeler transform in a wavelet matrix of packed bits, and sampled suffix
positions (every eighth, and where the walk back would meet a foreign symbol). All test phrases go through one vectorised
backward search; occurrences are located by walking to the next sample and merged into spans.

A phrase is a window of 13 consecutive words of a benchmark item, or the whole item where it is shorter. The benchmark
goes to the tasks as arrays of word numbers, in blocks of BLOCK_BYTES of text; a larger one goes in several passes, whose
spans are merged.

Defined results: null, empty and word-less texts have no words and no hits; items without words, and items whose id is
null, give no phrase; repeated items count once by id; repeated documents each get their row. Texts are read whole. Empty
tables give an empty result, or no hits. Outputs come as one struct, so other columns keep their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bucket, released, sliced, struct_array, word_blocks

WINDOW = 13
#: Words of a shard at most, about.
SHARD_WORDS = 1 << 18
SAMPLE = 8
#: Phrases that are searched for at once.
PHRASES = 1 << 16
#: Bytes of benchmark text that go to the tasks at once, as numbers of words.
BLOCK_BYTES = 4 << 20
OUTPUT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,stop:long>>>"


class WaveletMatrix:
    """Ranks over symbols 0 to size - 1, many at a time; a level is one bit a symbol and a count for each 64 of them."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for k in range(self.levels - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for level, zeros in enumerate(self.zeros):
            right = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, at)
            low, at = np.where(right, zeros + a, low - a), np.where(right, zeros + b, at - b)
        return at - low


def suffix_order(symbols: np.ndarray, foreign: int) -> np.ndarray:
    """The places of vocabulary symbols in the order of their suffixes; each foreign symbol differs from every other."""
    n, take = len(symbols), max(1, 60 // max(1, int(foreign).bit_length()))
    take = min(take, 8)
    own = np.flatnonzero(symbols < foreign)
    padded = np.concatenate([symbols, np.full(take, foreign, symbols.dtype)])
    key, open_ = np.zeros(len(own), np.int64), np.ones(len(own), bool)
    for i in range(take):
        s = padded[own + i]
        open_ &= s < foreign
        key = key * (foreign + 1) + np.where(open_, s, foreign)
    order = np.argsort(key, kind="stable")  # places rise inside equal keys, as foreign symbols do
    key, tied = key[order], open_[order]
    first = np.ones(len(own), bool)
    first[1:] = (key[1:] != key[:-1]) | ~tied[1:]
    places = own[order]
    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    rank = np.arange(n + 1, dtype=np.int64) + len(own)
    rank[places] = start
    h = take
    while True:
        alone = first & np.append(first[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return places
        p = places[rows]
        pair = rank[p] * (len(own) + n + 1) + rank[np.minimum(p + h, n)]
        by = np.argsort(pair, kind="stable")
        places[rows], pair = p[by], pair[by]
        new = np.ones(len(rows), bool)
        new[1:] = pair[1:] != pair[:-1]
        first[rows] = new
        rank[places[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
        h *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, foreign: int):
        places = suffix_order(symbols, foreign)
        previous = np.where(places > 0, symbols[places - 1], foreign)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols[places], minlength=foreign))])
        self.transform = previous.astype(np.int32)
        self.matrix = WaveletMatrix(previous, foreign + 1)
        sampled = (places % SAMPLE == 0) | (previous == foreign)
        self.sampled, self.sample_at = sampled, np.cumsum(sampled) - 1
        self.samples = places[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length, those that occur, and their row intervals."""
        which = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.starts[last], self.starts[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = high > low
            which, low, high = which[live], low[live], high[live]
            if not len(which):
                break
            c = phrases[which, k]
            both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.starts[c] + both[: len(c)], self.starts[c] + both[len(c) :]
        live = high > low
        return which[live], low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            c = self.transform[at[walking]].astype(np.int64)
            at[walking] = self.starts[c] + self.matrix.rank(c, at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.sample_at[at]] + steps


@dataclass
class Phrases:
    """A block of the benchmark: hashes of its words, sorted; the items' words by their place among them, one item after
    the other; and, by length, the items of that length of phrase with where each begins and how many phrases it has."""

    vocabulary: np.ndarray
    words: np.ndarray
    items: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def parts(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, item of each), some thousands at a time."""
        item, begin, count = self.by_length[length]
        last = np.cumsum(count)
        for at in range(0, int(last[-1]), PHRASES):
            k = np.arange(at, min(at + PHRASES, int(last[-1])))
            of = np.searchsorted(last, k, side="right")
            start = begin[of] + k - (last[of] - count[of])
            yield self.words[start[:, None] + np.arange(length)], item[of]


def phrases(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    hashes, names, texts, lengths = WordHashes(), [], [], []
    for item, text in items:
        words = [hashes.array(block) for block in word_blocks(text)]
        if words:
            names.append(item)
            texts.append(np.concatenate(words))
            lengths.append(len(texts[-1]))
    every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    vocabulary, words = np.unique(every, return_inverse=True)
    size = np.array(lengths, np.int64)
    begin, m = np.cumsum(size) - size, np.minimum(size, window)
    by_length = {int(n): (np.flatnonzero(m == n), begin[m == n], (size - m + 1)[m == n]) for n in np.unique(m[m > 0])}
    return Phrases(vocabulary, words.astype(np.int32), names, by_length)


def scan_shard(texts: list[np.ndarray], block: Phrases) -> list[tuple[set[str], list[tuple[int, int]]]]:
    """For each document, given as word numbers: items that occur, merged spans of words [start, stop)."""
    foreign = len(block.vocabulary)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + 1) - lengths - 1
    gap = np.array([foreign])
    symbols = np.concatenate([x for t in texts for x in (t, gap)])
    out: list[tuple[set[str], list[tuple[int, int]]]] = [(set(), []) for _ in texts]
    if not foreign or not (symbols < foreign).any():
        return out
    index = FMIndex(symbols, foreign)
    edge = np.zeros(len(symbols) + 1, np.int64)
    for m in block.by_length:
        for table, items in block.parts(m):
            which, low, high = index.search(table)
            if not len(which):
                continue
            count = high - low
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at, item = index.locate(rows), items[np.repeat(which, count)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
            doc = np.searchsorted(begins, at, side="right") - 1
            for pair in np.unique(doc * len(block.items) + item):
                out[int(pair) // len(block.items)][0].add(block.items[int(pair) % len(block.items)])
    hit = np.cumsum(edge) > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    owner = np.searchsorted(begins, start, side="right") - 1
    for d, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
        out[d][1].append((a - int(begins[d]), b - int(begins[d])))
    return out


class Scanner:
    """Scans texts for a block's phrases, shard by shard."""

    def __init__(self, block: Phrases, shard_words: int = SHARD_WORDS):
        self.block, self.shard_words, self.hashes = block, shard_words, WordHashes()
        self.vocabulary = pa.array(block.vocabulary)
        self.reach = max(block.by_length, default=1) - 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        found = pc.index_in(pa.array(self.hashes.array(words)), value_set=self.vocabulary)
        return pc.fill_null(found, len(self.block.vocabulary)).to_numpy().astype(np.int64)

    def _stretches(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, word numbers) of stretches of at most about a shard, overlapping by the reach of a phrase."""
        held, at = np.zeros(0, np.int64), 0
        for words in word_blocks(text):
            held = np.concatenate([held, self._numbers(words)])
            while len(held) > self.shard_words + self.reach:
                yield at, held[: self.shard_words + self.reach]
                held, at = held[self.shard_words :], at + self.shard_words
        if len(held):
            yield at, held

    def scan(self, texts: Iterable[str | None]) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """(words, words hit, items, spans) of each text."""
        n_words: list[int] = []
        found: list[list[tuple[set[str], list[tuple[int, int]]]]] = []
        shard: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            for (d, first, _), (items, spans) in zip(shard, scan_shard([s for *_, s in shard], self.block), strict=True):
                if spans:
                    found[d].append((items, [(a + first, b + first) for a, b in spans]))

        for d, text in enumerate(texts):
            n_words.append(0)
            found.append([])
            for first, numbers in self._stretches(text):
                if shard and held + len(numbers) > self.shard_words:
                    flush()
                    shard, held = [], 0
                shard.append((d, first, numbers))
                held += len(numbers)
                n_words[d] = first + len(numbers)
        if shard:
            flush()
        return [(n, *united(parts)) for n, parts in zip(n_words, found, strict=True)]


def united(parts: list[tuple[Iterable[str], list[tuple[int, int]]]]) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Words hit, items and merged spans of several finds in one text."""
    spans: list[list[int]] = []
    for a, b in sorted(s for _, each in parts for s in each):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return sum(b - a for a, b in spans), sorted({i for items, _ in parts for i in items}), [(a, b) for a, b in spans]


def _packed(found: list[tuple[int, int, list[str], list[tuple[int, int]]]]) -> pa.StructArray:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return struct_array({
        "n_words": pa.array([x[0] for x in found], pa.int64()),
        "n_hit": pa.array([x[1] for x in found], pa.int64()),
        "items": pa.array([x[2] for x in found], pa.list_(pa.string())),
        "spans": pa.array([[{"start": a, "stop": b} for a, b in x[3]] for x in found], kind),
    })


def _merger():
    @F.arrow_udf(OUTPUT)
    def merge(*blocks: pa.Array) -> pa.Array:
        rows = zip(*(b.to_pylist() for b in blocks), strict=True)
        return _packed([(parts[0]["n_words"], *united([(p["items"], [(s["start"], s["stop"]) for s in p["spans"]]) for p in parts])) for parts in rows])

    return merge


def _finder(shared):
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(shared.value)
        for batch in sliced(batches):
            yield _packed(scanner.scan(t.as_py() for t in batch))

    @F.arrow_udf(OUTPUT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(scanned)(batches)

    return find


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", phrase_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """A struct column of docs: n_words, n_hit, items (ids as sorted strings), spans (words, merged)."""
    tests = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(phrase_text).alias("t"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + size // block_bytes
    columns = []
    for b in range(blocks):
        mine = tests if blocks == 1 else tests.where(bucket("i", "t", buckets=blocks) == b)
        block = phrases(((r["i"], r["t"]) for r in mine.toLocalIterator()), window)
        columns.append(_finder(docs.sparkSession.sparkContext.broadcast(block))(docs[text]))
    return columns[0] if blocks == 1 else _merger()(*columns)


def contaminated(found: Column) -> Column:
    """A document is contaminated if at least a twentieth of its words, and one word, are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[k:k + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS k FROM i)),
dw AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS phrase
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i) WHERE len(ws) >= m)),
o AS (SELECT doc_id, item_id, m, k FROM dw JOIN iw USING (m, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM o) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
