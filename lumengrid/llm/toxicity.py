"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words go through the network in windows of 32 words that overlap by half, all of them, to the last word. Each
word comes in by its word input (a learned embedding of its bucket and the bucket's log odds of toxic documents) and by
its character inputs (the mean of learned embeddings of its character n-grams, of three to six bytes with word marks, and
these n-grams' log odds: the largest by length, and the mean). The two directions' states are pooled by attention to one logit a window. A logistic fit, on
documents kept out of training, makes a probability of a document's largest window logit and the largest of the windows
that do not overlap that one.

Training: from a bounded sample of labelled documents (see Settings) come the document counts of words and n-grams, in
two halves so that a document's windows never see odds that its own label made; the windows that its odds rank highest,
and one at random, train the network.

Defined results: texts without a word, empty and null texts score EMPTY; without both labels in the sample the score is
the share of toxic labels; null labels and labels of null ids are left out; of rows of one id with different texts each
text is learned from, of equal ones one; repeated rows are scored alike. Long texts are scored in segments that share the
windows' overlap, so memory is bounded. The output is one column; other columns may have any name. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, sliced, struct_array, word_blocks, words_of

WINDOW, STRIDE = 32, 16
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
EMPTY = 0.0
REMEMBERED = 120_000
BLOCK = 2048
#: Rows of the character n-grams' embeddings, for each length; words of a segment and of what is scored at once.
CHARACTERS = 1 << 15
SEGMENT, WORDS = 1 << 15, 1 << 16


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample, by the hash of the id: toxic and other documents, and the longest text among them."""

    toxic_rows: int = 1500
    other_rows: int = 3000
    max_fit_chars: int = 40_000
    embedding: int = 4
    characters: int = 4
    hidden: int = 12
    attention: int = 8
    epochs: int = 5
    least_steps: int = 300
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


def word_bucket(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) & (BUCKETS - 1)


def gram_buckets(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length (buckets of all n-grams in order, first n-gram of each word); words shorter have one, of zeros."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(sizes) - sizes
    out = []
    for n in GRAMS:
        count = np.maximum(sizes - n + 1, 1)
        first = np.cumsum(count) - count
        at = np.repeat(begin - first, count) + np.arange(count.sum())
        code = np.full(len(at), n, np.uint32)
        for i in range(n):
            code = (code ^ flat[np.minimum(at + i, len(flat) - 1)]) * np.uint32(16777619)
        code ^= code >> np.uint32(15)
        code = (code * np.uint32(0x85EBCA6B)) >> np.uint32(14)
        short = np.repeat(sizes < n, count)
        out.append((np.where(short, 0, code & np.uint32(BUCKETS - 1)).astype(np.int64), first))
    return out


def character_rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """From gram_buckets() of words: rows of the embeddings of all their n-grams, word by word, and how many each has."""
    counts, rows, owner = [], [], []
    for k, (b, first) in enumerate(parts):
        sizes = np.diff(np.append(first, len(b)))
        of = np.repeat(np.arange(len(first)), sizes)
        rows.append((b & (CHARACTERS - 1))[b > 0] + k * CHARACTERS)
        owner.append(of[b > 0])
        counts.append(np.bincount(of[b > 0], minlength=len(first)))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    return rows[np.argsort(owner, kind="stable")], np.sum(counts, 0)


def pooled_characters(table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean embedding of each word's n-grams; zeros where it has none."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        begin = np.cumsum(counts) - counts
        out[some] = np.add.reduceat(table[rows], begin[some]) / counts[some][:, None]
    return out


@dataclass
class Odds:
    """Log odds, drawn to 0, of toxic documents for buckets of words and of character n-grams."""

    word: np.ndarray
    gram: np.ndarray

    @staticmethod
    def of(docs: list[list[bytes]], labels: np.ndarray) -> Odds:
        tables = []
        counted = [np.zeros((2, width), np.float32) for width in (BUCKETS, BUCKETS * len(GRAMS))]
        for words, y in zip(docs, labels, strict=True):  # one document's n-grams at a time
            own = list(set(words))
            if own:
                counted[0][int(y)][np.unique([word_bucket(w) for w in own])] += 1
                counted[1][int(y)][np.unique(np.concatenate([b + k * BUCKETS for k, (b, _) in enumerate(gram_buckets(own))]))] += 1
        for counts in counted:
            toxic, other = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
            odds = np.log((counts[1] + 0.5) / (toxic + 1)) - np.log((counts[0] + 0.5) / (other + 1))
            trust = counts.sum(0) / (counts.sum(0) + 4)
            tables.append(np.where(counts.sum(0) >= 3, odds * trust, 0).astype(np.float32))
        return Odds(*tables)

    def features(self, words: list[bytes], buckets: np.ndarray, parts: list | None = None) -> np.ndarray:
        """Of each word: its own odds, the largest of its n-grams by length, their mean."""
        cols, mean = [self.word[buckets]], np.zeros(len(words), np.float32)
        for k, (b, first) in enumerate(parts or gram_buckets(words)):
            v = np.where(b > 0, self.gram[b + k * BUCKETS], np.float32(0))
            cols.append(np.maximum.reduceat(v, first))
            mean += np.add.reduceat(v, first) / np.diff(np.append(first, len(v)))
        return np.stack([*cols, mean / len(GRAMS)], 1).astype(np.float32)


FEATURES = 2 + len(GRAMS)


def windows(n: int) -> np.ndarray:
    """Where the windows of n words begin: every STRIDE words until one reaches the end."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def segments(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in segments whose windows, one segment's after the other's, are those of the whole."""
    held: list[bytes] = []
    more = False
    for words in word_blocks(text):
        held += words
        while len(held) > SEGMENT + STRIDE:
            yield held[: SEGMENT + STRIDE]
            held, more = held[SEGMENT:], True
    if held and not (more and len(held) <= STRIDE):
        yield held


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _start(s: Settings, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = FEATURES + s.embedding + s.characters, s.hidden
    p = {"emb": np.zeros((BUCKETS, s.embedding), np.float32), "chars": np.zeros((CHARACTERS * len(GRAMS), s.characters), np.float32)}
    for side in "fb":
        p["x" + side] = rng.normal(0, 0.3, (d, 3 * h))
        p["u" + side] = rng.normal(0, 0.3, (h, 3 * h))
        p["c" + side] = np.zeros(3 * h)
    return p | {"wa": rng.normal(0, 0.3, (2 * h, s.attention)), "ba": np.zeros(s.attention), "va": rng.normal(0, 0.3, s.attention), "wo": rng.normal(0, 0.3, 2 * h), "bo": np.zeros(1)}


def _cell(gx, h, u, size):
    hu = h @ u
    rz = sigmoid(gx[:, : 2 * size] + hu[:, : 2 * size])
    r, z = rz[:, :size], rz[:, size:]
    hn = hu[:, 2 * size :]
    n = np.tanh(gx[:, 2 * size :] + r * hn)
    return r, z, hn, n, n + z * (h - n)


TABLES = ("emb", "chars")


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, size: int) -> tuple[float, dict]:
    """Loss and gradients of a batch, that of the inputs x (time, batch, inputs) among them as "in"; mask (time, batch)."""
    t_max, b = mask.shape
    states, kept = np.zeros((t_max, b, 2 * size)), {}
    for k, side in enumerate("fb"):
        gx, h = x @ p["x" + side] + p["c" + side], np.zeros((b, size))
        for t in range(t_max) if side == "f" else range(t_max - 1, -1, -1):
            r, z, hn, n, new = _cell(gx[t], h, p["u" + side], size)
            kept[side, t] = h, r, z, hn, n
            h = np.where(mask[t][:, None], new, h)
            states[t, :, k * size : (k + 1) * size] = h
    u = np.tanh(states @ p["wa"] + p["ba"])
    s = np.where(mask, u @ p["va"], -1e9)
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    prob = 1 / (1 + np.exp(-(pooled @ p["wo"] + p["bo"])))
    loss = -np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))
    g = {k: np.zeros_like(v, np.float64) for k, v in p.items() if k not in TABLES}
    dl = (prob - labels) / b
    g["wo"], g["bo"] = pooled.T @ dl, np.array([dl.sum()])
    dp = dl[:, None] * p["wo"]
    da = (states * dp).sum(2)
    ds = a * (da - (a * da).sum(0))
    du = ds[:, :, None] * p["va"] * (1 - u * u)
    g["va"], g["wa"], g["ba"] = np.einsum("tb,tba->a", ds, u), np.einsum("tbh,tba->ha", states, du), du.sum((0, 1))
    dstates = a[:, :, None] * dp + du @ p["wa"].T
    dx = np.zeros_like(x)
    for k, side in enumerate("fb"):
        dh, dgx = np.zeros((b, size)), np.zeros((t_max, b, 3 * size))
        for t in range(t_max - 1, -1, -1) if side == "f" else range(t_max):
            h, r, z, hn, n = kept[side, t]
            d = dh + dstates[t, :, k * size : (k + 1) * size]
            m = mask[t][:, None]
            dh, d = np.where(m, 0, d), np.where(m, d, 0)
            dan = d * (1 - z) * (1 - n * n)
            daz, dar = d * (h - n) * z * (1 - z), dan * hn * r * (1 - r)
            dhu = np.concatenate([dar, daz, dan * r], 1)
            g["u" + side] += h.T @ dhu
            dh = dh + d * z + dhu @ p["u" + side].T
            dgx[t] = np.concatenate([dar, daz, dan], 1)
        g["x" + side] += np.einsum("tbd,tbg->dg", x, dgx)
        g["c" + side] += dgx.sum((0, 1))
        dx += dgx @ p["x" + side].T
    g["in"] = dx
    return loss, g


@dataclass
class Model:
    """The trained network; without one, `prior` is every score."""

    prior: float
    odds: Odds | None = None
    weights: dict | None = None
    hidden: int = 8
    #: Weights of the two window logits and the offset; what stands for the second where there is no other window.
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    alone: float = 0.0


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """A model from labelled texts, all of which are used, in the order given."""
    same: dict[bytes, bytes] = {}  # equal words are held once
    docs, y = [[same.setdefault(w, w) for w in words_of(t)] for t in texts], np.array(labels, np.float64)
    keep = [i for i, d in enumerate(docs) if d]
    docs, y = [docs[i] for i in keep], y[keep]
    prior = float(np.mean(labels)) if len(labels) else 0.0
    if y.sum() < 4 or (1 - y).sum() < 4:
        return Model(prior)
    rng = np.random.default_rng(settings.seed)
    part = np.zeros(len(y), np.int64)  # 0 and 1: the halves of training; 2: for the logistic fit
    for label in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == label))
        part[mine] = np.minimum(np.arange(len(mine)) % 5 // 2, 2)
    odds = [Odds.of([docs[i] for i in np.flatnonzero(part == k)], y[part == k]) for k in (0, 1)]
    both = Odds.of([docs[i] for i in np.flatnonzero(part < 2)], y[part < 2])
    vocabulary: dict[bytes, int] = {}
    rows = []
    for i in np.flatnonzero(part < 2):
        words = docs[i]
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        f = odds[1 - part[i]].features(words, np.array([word_bucket(w) for w in words]))
        starts = windows(len(words))
        strength = f[:, 0] + f[:, 1:-1].max(1)
        rank = np.argsort([-np.sort(strength[s : s + WINDOW])[-3:].sum() for s in starts], kind="stable")
        chosen = {int(r) for r in rank[:1]} | (set() if y[i] else {int(r) for r in rank[1:2]} | {int(rng.integers(len(starts)))})
        rows += [(f[starts[r] : starts[r] + WINDOW], ids[starts[r] : starts[r] + WINDOW], y[i]) for r in sorted(chosen)]
    features, words_at, mask = np.zeros((WINDOW, len(rows), FEATURES), np.float32), np.zeros((WINDOW, len(rows)), np.int64), np.zeros((WINDOW, len(rows)), bool)
    for k, (f, ids, _) in enumerate(rows):
        features[: len(f), k], words_at[: len(ids), k], mask[: len(ids), k] = f, ids, True
    target = np.array([r[2] for r in rows])
    spelled = list(vocabulary)
    bucket_of, (gram_rows, gram_counts) = np.array([word_bucket(w) for w in spelled]), character_rows(gram_buckets(spelled))
    gram_begin = np.cumsum(gram_counts) - gram_counts
    p = _start(settings, rng)
    first, second = ({k: np.zeros_like(v, np.float64) for k, v in p.items() if k not in TABLES} for _ in range(2))
    step, epochs = 0, max(settings.epochs, -(-settings.least_steps * settings.batch // len(rows)))
    few_rows = min(1.0, len(rows) / 3000)  # of few windows little is learned by heart
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = settings.rate * (1 - epoch / (epochs + 1))
        for at in range(0, len(order), settings.batch):
            i = order[at : at + settings.batch]
            here, place = np.unique(words_at[:, i], return_inverse=True)
            place, counts = place.reshape(WINDOW, len(i)), gram_counts[here]
            own = gram_rows[np.repeat(gram_begin[here] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            x = np.concatenate([features[:, i], p["emb"][bucket_of[here]][place], pooled_characters(p["chars"], own, counts)[place]], 2)
            _, g = gradients(p, x, mask[:, i], target[i], settings.hidden)
            step += 1
            of_words = np.zeros((len(here), settings.embedding + settings.characters))
            np.add.at(of_words, place[mask[:, i]], g.pop("in")[:, :, FEATURES:][mask[:, i]])
            np.add.at(p["emb"], bucket_of[here], (-rate * 5 * few_rows * of_words[:, : settings.embedding]).astype(np.float32))
            spread = of_words[:, settings.embedding :] / np.maximum(1, counts)[:, None]
            np.add.at(p["chars"], own, (-rate * 20 * few_rows * np.repeat(spread, counts, 0)).astype(np.float32))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                p[k] = p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    model = Model(prior, both, {k: v.astype(np.float32) for k, v in p.items()}, settings.hidden)
    held = np.flatnonzero(part == 2)
    x, label = Scorer(model).logits([texts[keep[i]] for i in held]), y[held]
    more = np.isfinite(x[:, 1])
    halves = [np.median(x[more & (label == k), 1]) for k in (0, 1) if (more & (label == k)).any()]
    model.alone = float(np.mean(halves)) if halves else 0.0
    model.scale = _logistic(model_input(model, x), label)
    return model


def model_input(model: Model, x: np.ndarray) -> np.ndarray:
    """The two logits of each document, the second filled in where there is none."""
    return np.stack([x[:, 0], np.where(np.isfinite(x[:, 1]), x[:, 1], np.minimum(x[:, 0], model.alone))], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights, which are drawn to one half and never negative, and offset of a logistic fit."""
    x, w, prior = np.column_stack([x, np.ones(len(x))]), np.array([0.5, 0.5, 0.0]), np.array([0.5, 0.5, 0.0])
    pull = np.array([1.0, 1.0, 0.01])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, x.T @ (p - y) + pull * (w - prior))
        w = w - move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
    return float(max(w[0], 0.05)), float(max(w[1], 0.0)), float(w[2])


class _Rows(dict):
    """Word -> row of the remembered input projections; new words wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self) + 1
        self.fresh.append(word)
        return row


class Scorer:
    """Runs a model; remembers the input projections of words up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        """Row 0 is the filler after a text's end: it keeps the state as it is."""
        self.rows, h = _Rows(), self.model.hidden
        self.table = np.zeros((1024, 6 * h), np.float32)
        for side in (0, 3 * h):
            self.table[0, side + h : side + 2 * h] = 60

    def _project(self) -> None:
        fresh, p = self.rows.fresh, self.model.weights
        if not fresh:
            return
        if len(self.rows) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(self.rows) + 1), self.table.shape[1]), np.float32)])
        buckets = np.array([word_bucket(w) for w in fresh])
        parts = gram_buckets(fresh)
        x = np.concatenate([self.model.odds.features(fresh, buckets, parts), p["emb"][buckets], pooled_characters(p["chars"], *character_rows(parts))], 1)
        last = len(self.rows) + 1
        self.table[last - len(fresh) : last] = np.concatenate([x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"]], 1)
        self.rows.fresh = []

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the largest window logit and the largest that does not overlap it; -inf where there is none."""
        every: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for d, text in enumerate(texts):
            for words in segments(text):
                held.append((d, words))
                size += len(words)
                if size >= WORDS:
                    self._windows(held, every)
                    held, size = [], 0
        if held:
            self._windows(held, every)
        out = np.full((len(texts), 2), -np.inf)
        for d, parts in enumerate(every):
            if parts:
                mine = np.concatenate(parts)
                top = int(mine.argmax())
                apart = np.concatenate([mine[: max(0, top - WINDOW // STRIDE + 1)], mine[top + WINDOW // STRIDE :]])
                out[d] = mine[top], apart.max(initial=-np.inf)
        return out

    def _windows(self, held: list[tuple[int, list[bytes]]], every: list[list[np.ndarray]]) -> None:
        """Adds the logits of all windows of the held segments to their texts'."""
        if len(self.rows) > REMEMBERED:
            self._forget()
        ids = [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for _, words in held]
        self._project()
        sizes = np.array([len(x) for x in ids])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        begin = np.cumsum(sizes) - sizes
        starts = [windows(n) for n in sizes]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        at = np.concatenate([s + b for s, b in zip(starts, begin, strict=True)])
        stop = (begin + sizes)[owner]
        steps = np.arange(WINDOW)[:, None]
        found = np.zeros(len(at))
        for k in range(0, len(at), BLOCK):
            place = steps + at[k : k + BLOCK]
            inside = place < stop[k : k + BLOCK]
            found[k : k + BLOCK] = self._forward(np.where(inside, flat[np.minimum(place, len(flat) - 1)], 0), inside)
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
        for k, (d, _) in enumerate(held):
            every[d].append(found[cuts[k] : cuts[k + 1]])

    def _forward(self, words: np.ndarray, inside: np.ndarray) -> np.ndarray:
        p, size = self.model.weights, self.model.hidden
        t_max, b = words.shape
        states = np.empty((t_max, b, 2 * size), np.float32)
        for k, side in enumerate("fb"):
            h, u, table = np.zeros((b, size), np.float32), p["u" + side], self.table[:, k * 3 * size : (k + 1) * 3 * size]
            for t in range(t_max) if side == "f" else range(t_max - 1, -1, -1):
                h = _cell(table[words[t]], h, u, size)[-1]
                states[t, :, k * size : (k + 1) * size] = h
        s = np.tanh(states @ p["wa"] + p["ba"]) @ p["va"]
        s[~inside] = -1e9
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        return np.einsum("tb,tbh->bh", a, states) @ p["wo"] + p["bo"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.weights is None:
            return np.where([any(word_blocks(t)) for t in texts], self.model.prior, EMPTY)
        a, second, b = self.model.scale
        x = self.logits(texts)
        there = np.isfinite(x[:, 0])
        z = model_input(self.model, np.where(there[:, None], x, 0)) @ np.array([a, second]) + b
        return np.where(there, 1 / (1 + np.exp(-np.clip(z, -30, 30))), EMPTY)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of labelled documents: by the hash of the id, about the set number of each label, whole texts."""
    rated = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("rated_id")).agg(F.max("toxic").alias("y")).where(learn)
    n = {r["y"]: r["n"] for r in rated.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") > 0, min(1.0, settings.toxic_rows / max(1, n.get(1, 0)))).otherwise(min(1.0, settings.other_rows / max(1, n.get(0, 0))))
    drawn = rated.where(F.pmod(F.xxhash64(F.col("rated_id").cast("string"), F.lit(settings.seed)), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(key).alias("rated_id"), F.col(text).alias("t")).where(F.length("t") <= settings.max_fit_chars)
    got = texts.join(few(drawn), "rated_id").select("rated_id", "t", (F.col("y") > 0).cast("int").alias("y")).distinct().collect()
    return [(r["t"], r["y"]) for r in sorted(got, key=lambda r: (str(r["rated_id"]), r["t"]))]


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The column of scores, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Scorer] = []

    @F.arrow_udf("struct<score:double>")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not kept:
            kept.append(Scorer(shared.value))
        for batch in sliced(batches):
            yield struct_array({"score": pa.array(kept[0].scores(batch.to_pylist()))})

    return toxicity(docs[text])["score"]
