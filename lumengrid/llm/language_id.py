"""Language identification with a blended-spectrum presence kernel.

A text is the set of its distinct letter n-grams (n = 1 to 3, over all letters, runs of anything else being one symbol);
the kernel of two texts is the size of the intersection of their sets over the geometric mean of the sets' sizes. A few
training texts are landmarks (Nyström); one-versus-rest kernel ridge regression is fitted in the landmark space, and texts
are scored in batches by two matrix products: presence matrix x landmark matrix, then kernel block x weights.

Defined results: null texts and texts without a letter give `und` and score 0; without any labelled row every text gives
`und`. Null labels are not learned, nor is a language whose labelled texts are all longer than the bound of Settings. Ids
may be null or repeated; equal texts of a language are drawn once. Texts are read whole, in pieces if they are long;
columns of the same name as an output are not touched, as outputs come as one struct. Repeated rows are scored alike;
ties between languages go to the first in code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, released, sliced, struct_array

UND = "und"
OUTPUT = "struct<lang_pred:string,score:double>"
PIECE = 1 << 18
#: Cells of a presence matrix at most, about.
CELLS = 1 << 24
_BITS = np.uint64(21)


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: labelled rows drawn for each language and in all, about, their longest text, landmarks."""

    rows_per_language: int = 300
    rows: int = 8_000
    max_fit_chars: int = 40_000
    landmarks_per_language: int = 12
    max_landmarks: int = 192
    orders: tuple[int, ...] = (1, 2, 3)
    ridge: float = 1e-2
    seed: int = 11


@dataclass
class Model:
    """codes: the sorted n-grams of the landmarks; floors: the least score to be believed, by length class."""

    languages: list[str]
    orders: tuple[int, ...]
    codes: np.ndarray | None = None
    landmarks: np.ndarray | None = None
    weights: np.ndarray | None = None
    floors: tuple[float, ...] = (0.0, 0.0, 0.0)


_SYMBOLS: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Code point -> symbol: 1 for what is no letter, else the code point and two; worked out once in a process."""
    if not _SYMBOLS:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _SYMBOLS.append(np.where(letter, np.arange(2, 0x110002), 1).astype(np.uint64))
    return _SYMBOLS[0]


class Grams:
    """Distinct n-grams of texts as 63-bit codes, 21 bits a symbol, so that all letters of all scripts are told apart."""

    def __init__(self, orders: tuple[int, ...]):
        self.orders = orders
        self.stamp = np.zeros(1 << 16, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        found = symbol_table()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 1) | (found[:-1] != 1)
        return found[keep]

    def _unique(self, code: np.ndarray) -> np.ndarray:
        """The distinct codes: of those of one slot the last one's equals are found at once, the rest by sorting."""
        here = np.arange(len(code), dtype=np.int32)
        slot = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
        self.stamp[slot] = here
        last = self.stamp[slot]
        rest = code[code[last] != code]
        return np.concatenate([code[last == here], np.unique(rest)]) if len(rest) else code[last == here]

    def distinct(self, text: str) -> np.ndarray:
        """The distinct codes of all orders, in no set order; none at all without a letter."""
        s = self.symbols(text)
        if len(s) < 2:
            return np.zeros(0, np.uint64)
        most, parts = max(self.orders), []
        for at in range(0, len(s), PIECE):
            code, piece = np.zeros(0, np.uint64), s[at : at + PIECE + most - 1]
            for n in range(1, most + 1):
                own = min(PIECE, len(piece) - n + 1)
                if own <= 0:
                    break
                code = piece[:own].copy() if n == 1 else code[:own] << _BITS | piece[n - 1 : n - 1 + own]
                if n in self.orders:
                    parts.append(self._unique(code))
        found = np.concatenate(parts)
        return found if len(s) <= PIECE else np.unique(found)


def basis(texts: list[str], languages: list[str], names: list[str], settings: Settings) -> tuple[Model, np.ndarray] | None:
    """A model of the landmarks, the first texts of each language, without weights yet, and the matrix that takes kernel
    rows to the landmark space; nothing without a letter in any text."""
    grams = Grams(settings.orders)
    sets = [grams.distinct(t) for t in texts]
    each = max(1, min(settings.landmarks_per_language, settings.max_landmarks // max(1, len(names))))
    chosen = [i for name in names for i in [j for j, x in enumerate(languages) if x == name and len(sets[j])][:each]]
    if not chosen:
        return None
    model = Model(names, settings.orders, np.unique(np.concatenate([sets[i] for i in chosen])))
    scorer = Scorer(model)
    marks, sizes = scorer.presence([sets[i] for i in chosen])
    model.landmarks = (marks / np.sqrt(np.maximum(sizes, 1))[:, None]).T.astype(np.float32)
    kernel = scorer.kernel([sets[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    return model, vectors[:, good] / np.sqrt(values[good])


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model:
    """Landmarks and ridge weights from labelled texts; all of them are used, in the order given."""
    names = sorted(set(languages))
    found = basis(texts, languages, names, settings)
    if not found:
        return Model([], settings.orders)
    model, root = found
    scorer, grams = Scorer(model), Grams(settings.orders)
    sets = [grams.distinct(t) for t in texts]
    rows = [i for i in range(len(texts)) if len(sets[i])]
    phi = np.concatenate([scorer.kernel([sets[i] for i in rows[at : at + 256]]) for at in range(0, len(rows), 256)]).astype(np.float64) @ root
    target = np.array([[float(languages[i] == name) for name in names] for i in rows])
    balance = np.sqrt(len(rows) / len(names) / np.maximum(target.sum(0), 1))[target.argmax(1)][:, None]
    gram = (phi * balance).T @ (phi * balance) + settings.ridge * len(rows) * np.eye(phi.shape[1])
    model.weights = (root @ np.linalg.solve(gram, (phi * balance).T @ (target * balance))).astype(np.float32)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.grams = Grams(model.orders)
        self.codes = pa.array(model.codes) if model.codes is not None else None
        self.block = max(8, min(256, CELLS // max(1, len(model.codes) if model.codes is not None else 1)))

    def presence(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One row for each text over the landmarks' n-grams, and the size of each text's own set."""
        matrix, sizes = np.zeros((len(sets), len(self.codes)), np.float32), np.array([len(s) for s in sets])
        found = pc.fill_null(pc.index_in(pa.array(np.concatenate(sets)), value_set=self.codes), -1).to_numpy()
        row = np.repeat(np.arange(len(sets)), sizes)
        matrix[row[found >= 0], found[found >= 0]] = 1
        return matrix, sizes.astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        matrix, sizes = self.presence(sets)
        return (matrix @ self.model.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        for at in range(0, len(texts), self.block):
            if self.model.weights is None:
                names += [UND] * len(texts[at : at + self.block])
                continue
            sets = [self.grams.distinct(t or "") for t in texts[at : at + self.block]]
            margin = self.kernel(sets) @ self.model.weights
            best = margin.argmax(1)
            known = np.array([len(s) > 0 for s in sets])
            names += [self.model.languages[b] if k else UND for b, k in zip(best, known, strict=True)]
            scores[at : at + self.block] = np.where(known, np.clip(margin[np.arange(len(best)), best], 0, 1), 0)
        return names, scores


def sample(labelled: DataFrame, text: str, lang: str, settings: Settings) -> list[tuple[str, str]]:
    """A bounded labelled sample: by the hash of the text, about as many distinct texts of each language, whole."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= settings.max_fit_chars))
    counts = rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).collect()
    if not counts:
        return []
    each = min(settings.rows_per_language, max(4, settings.rows // len(counts)))
    shares = rows.sparkSession.createDataFrame([(r["l"], min(1.0, each / max(1, r["n"]))) for r in counts], "l string, share double")
    draw = F.pmod(F.xxhash64("t", F.lit(settings.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.join(few(shares), "l").where(draw < F.col("share")).select("t", "l", F.xxhash64("t", F.lit(settings.seed)).alias("h")).distinct().collect()
    return [(r["t"], r["l"]) for r in sorted(got, key=lambda r: (r["h"], r["t"], r["l"]))]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    rows = sample(labelled, text, lang, settings)
    return fit([t for t, _ in rows], [x for _, x in rows], settings)


#: Ends of the length classes, in characters, and the held-out texts that a class needs for a floor of its own.
CLASSES, LEAST_HELD = (100, 1000), 20
#: One labelled text in so many, by hash, is held out for the floors, of languages that have LEAST_HELD texts.
HELD_OUT = 5
#: A text is believed to be of a known language at this part of the score that all held-out texts but this share reach.
OF_LEAST, MISSED = 0.8, 0.01
BIN = 0.001


def _class(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < CLASSES[0], 0).when(n < CLASSES[1], 1).otherwise(2)


def _sums(learned: DataFrame, model: Model, root: np.ndarray, weight: dict[str, float]) -> np.ndarray:
    """phi' W phi and phi' W y, side by side, over all rows (t, l): phi the landmark space, W the weight of a language's
    rows, y its column. One row of the matrices at a time is added up, in the order of tasks, so that reruns agree."""
    shared = learned.sparkSession.sparkContext.broadcast((model, root, weight))
    place = {name: k for k, name in enumerate(model.languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, root, weight = shared.value
        scorer = Scorer(model)
        total = np.zeros((root.shape[1], root.shape[1] + len(place)))
        for batch in sliced(batches, scorer.block):
            sets = [scorer.grams.distinct(t) for t in batch.column(0).to_pylist()]
            rows = [(s, x) for s, x in zip(sets, batch.column(1).to_pylist(), strict=True) if len(s)]
            if not rows:
                continue
            phi = scorer.kernel([s for s, _ in rows]).astype(np.float64) @ root
            y = np.zeros((len(rows), len(place)))
            y[np.arange(len(rows)), [place[x] for _, x in rows]] = 1
            total += (phi * np.array([weight[x] for _, x in rows])[:, None]).T @ np.concatenate([phi, y], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), TaskContext.get().partitionId())), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "task", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                total[i] = total.get(i, 0.0) + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["i", "v"])

    parts = learned.select("t", "l").mapInArrow(released(add), "i long, task long, v array<double>")
    rows = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(join, "i long, v array<double>").collect()
    out = np.zeros((root.shape[1], root.shape[1] + len(place)))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _floors(held: DataFrame, model: Model) -> tuple[float, ...]:
    """By length class, and of all where a class has few, OF_LEAST of the score that all rows (t, l) but MISSED reach, of
    those that are predicted right."""
    # Who is right is filtered here: a filter in Spark would run the prediction once more, in workers of its own.
    scored = held.select("l", _class(F.col("t")).alias("class"), predict(held, model, "t").alias("p"))
    bins = scored.groupBy("class", (F.col("p")["lang_pred"] == F.col("l")).alias("right"), F.floor(F.col("p")["score"] / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    bins = [r for r in bins if r["right"]]

    def floor(of: list) -> float:
        at, n = np.array(sorted((r["bin"], r["n"]) for r in of)).T
        return OF_LEAST * BIN * float(at[np.searchsorted(np.cumsum(n), MISSED * n.sum())])

    every = floor(bins) if bins else 0.0
    by = [[r for r in bins if r["class"] == c] for c in range(len(CLASSES) + 1)]
    return tuple(floor(of) if sum(r["n"] for r in of) >= LEAST_HELD else every for of in by)


def train_with_floors(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """A model with floors, by length class, from all labelled texts: one in HELD_OUT, by hash, sets the floors, and the
    ridge weights are of all others. Only the landmarks are a few of these; a language is learned if any has a landmark."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    drawn = F.pmod(F.xxhash64("t", F.lit(settings.seed + 1)), F.lit(HELD_OUT)) == 0
    counts = {r["l"]: (r["n"], r["held"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if(drawn).alias("held")).collect()}
    often = [x for x, (n, h) in counts.items() if n >= LEAST_HELD and h < n]
    held = drawn & F.col("l").isin(often)
    n = {x: c - (h if x in often else 0) for x, (c, h) in counts.items()}
    marks = sample(rows.where(~held), "t", "l", settings)
    found = basis([t for t, _ in marks], [x for _, x in marks], sorted(n), settings)
    if not found:
        return Model([], settings.orders)
    model, root = found
    every = sum(n.values())
    sums = _sums(rows.where(~held), model, root, {x: every / len(n) / k for x, k in n.items()})
    m = root.shape[1]
    model.weights = (root @ np.linalg.solve(sums[:, :m] + settings.ridge * every * np.eye(m), sums[:, m:])).astype(np.float32)
    model.floors = _floors(rows.where(held), model)
    return model


def believed(found: Column, text: Column, model: Model) -> Column:
    """Whether a prediction, the struct of predict(), reaches the model's floor for the text's length."""
    floor = F.element_at(F.array(*map(F.lit, model.floors)), _class(text) + 1)
    return F.coalesce((found["lang_pred"] != UND) & (found["score"] >= floor), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column lang_pred, score for each row of docs; the model has a few MB at most, by its settings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            names, scores = scorer.predict(batch.to_pylist())
            yield struct_array({"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    @F.arrow_udf(OUTPUT)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(scored)(batches)

    return language(docs[text])
