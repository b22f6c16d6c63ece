"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order five; all code points are told apart, but that digits count as one character and
blanks as another. An n-gram is a pair of longs, 21 bits a character, so that its suffix and its context are masks and
shifts. Trusted texts are counted piece by piece into distinct five-grams, which are summed in Spark; continuation counts
of the lower orders, context totals, the three discounts of each order and the interpolated probabilities follow by
grouping and joins on n-grams and their contexts, from the lowest order up. The finished model is a table from n-grams to
log probability (as n-gram) and log back-off weight (as context), which never leaves the executors.

Documents are scored by joins with that table, dealt by n-gram. Texts are packed into compressed pieces and dealt to
batches of some tens of MB; a batch asks once for each distinct n-gram and context of its texts, the answers come back to
the batch by the join, and meet its pieces there. So rows grow with the distinct n-grams of batches, far fewer than the
positions, and neither the model nor the counts are ever in one place.

A part of the trusted texts, by digest, is not counted: their scores set the thresholds, so these come from texts that
are as new to the model as those to be judged. A document is judged by its mean negative log probability a character,
drawn to its language's median as if it had SHORT_CHARS more characters, against the language's threshold: the median of
held-out trusted documents plus REACH times the distance from the median to their 0.9 quantile. Languages with few have
their own median and at least the spread and the threshold of all.

Defined results: null and empty texts have perplexity null and are kept (language identification rejects them); null
languages are a language of their own; documents of a language without a held-out trusted document can't be judged and
are kept, as are all without trusted text; equal texts of one language are judged alike; ids may be null or repeated, as
documents are told by their text. Texts are read whole, in pieces. Other columns of any name are not touched. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, lookup, release, released, sliced, stored

ORDER, BITS = 5, 21
#: Characters of a piece, and bytes of text that a batch has about, or at least where there are fewer batches than cores.
PIECE = 1 << 18
BATCH_BYTES, LEAST_BATCH_BYTES = 64 << 20, 4 << 20
#: Numbers tried for each partition, to find one that Spark's hash sends there.
TRIED = 64
BIN = 0.005
SHORT_CHARS = 100
REACH = 3.0
LEAST_TRUSTED = 30
#: One trusted text in so many, by digest, is kept out of the counts for the thresholds.
HELD_OUT = 5
BOS = "\x00"
_ONE = np.uint64((1 << BITS) - 1)
_B = np.uint64(BITS)


def symbols(text: str) -> np.ndarray:
    """Code points plus one as 64-bit numbers (0 is no character), digits and blanks one each."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    s[(s >= 48) & (s < 58)] = 48
    s[(s == 9) | (s == 10) | (s == 13)] = 32
    return s + np.uint64(1)


def pieces(texts: Iterator[str | None], size: int) -> Iterator[tuple[str, list[int], list[int], list[int]]]:
    """Strings of about `size` characters with, for each text in one, its number, its characters there and whether it
    begins there. Before each stand the ORDER - 1 characters that come first: marks of a beginning, or those of the piece before."""
    held, which, lengths, begins, total = [], [], [], [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        text = text.replace(BOS, "\x01")
        for at in range(0, len(text), size):
            part = text[at : at + size]
            held.append((text[max(0, at - ORDER + 1) : at].rjust(ORDER - 1, BOS) if at else BOS * (ORDER - 1)) + part)
            which.append(number)
            lengths.append(len(part))
            begins.append(int(at == 0))
            total += len(part)
            if total >= size:
                yield "".join(held), which, lengths, begins
                held, which, lengths, begins, total = [], [], [], [], 0
    if held:
        yield "".join(held), which, lengths, begins


class Grams:
    """The distinct five-grams of a piece, as pairs (high, low), and for each position the number of its own."""

    def __init__(self, text: str, lengths: list[int]):
        s = symbols(text)
        n = np.array(lengths, np.int64)
        begin = np.cumsum(n + ORDER - 1) - n
        self.starts = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(begin - self.starts, n)
        at -= ORDER - 1
        w = [s[i : len(s) - ORDER + 1 + i] for i in range(ORDER)]
        high = w[0] << _B | w[1]
        low = w[2] << np.uint64(2 * BITS) | w[3] << _B | w[4]
        high, low = high[at], low[at]
        code = pa.array(mixed(high, low)).dictionary_encode()
        self.index = code.indices.to_numpy()
        first = np.empty(len(code.dictionary), np.int64)
        first[self.index[::-1]] = np.arange(len(at) - 1, -1, -1)
        self.high, self.low = high[first], low[first]


def mixed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One 64-bit number for a pair, to tell the n-grams of a batch apart."""
    x = (high * np.uint64(0x9E3779B97F4A7C15)) ^ low
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32)) ^ high


def shortened(high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k characters of n-grams."""
    mask = lambda n: np.uint64((1 << BITS * n) - 1)
    return high & mask(max(0, k - 3)), low & mask(min(k, 3))


def context(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams without their last character."""
    return high >> _B, low >> _B | (high & _ONE) << np.uint64(2 * BITS)


def _shortened(k: int) -> list[Column]:
    """As shortened(), of the columns high and low."""
    mask = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long"))
    return [mask("high", max(0, k - 3)), mask("low", min(k, 3))]


def _context() -> list[Column]:
    return [F.shiftright("high", BITS), F.shiftright("low", BITS).bitwiseOR(F.shiftleft(F.col("high").bitwiseAND(F.lit((1 << BITS) - 1).cast("long")), 2 * BITS))]


@dataclass
class Model:
    """entries: (high, low, logp, weight), either null where the n-gram isn't one, or no context; unknown: log
    probability of a new character."""

    entries: DataFrame
    unknown: float


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    t = list(counts.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first())
    if not all(t):
        return 0.5, 0.5, 0.5
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(float(i), max(0.05, i - (i + 1) * y * t[i] / t[i - 1])) for i in (1, 2, 3))


def train(trusted: DataFrame, text: str = "text") -> Model:
    """The model of all texts of trusted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for piece, _, lengths, _ in pieces(batch.column(0).to_pylist(), PIECE):
                grams = Grams(piece, lengths)
                yield pa.RecordBatch.from_arrays([_long(grams.high), _long(grams.low), pa.array(np.bincount(grams.index, minlength=len(grams.high)))], names=["high", "low", "c"])

    counted = trusted.select(text).mapInArrow(released(count), "high long, low long, c long").groupBy("high", "low").agg(F.sum("c").alias("c"))
    tables = {ORDER: stored(counted, "grams5")}
    for k in range(ORDER - 1, 0, -1):
        high, low = _shortened(k)
        tables[k] = stored(tables[k + 1].groupBy(high.alias("high"), low.alias("low")).agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
    rows, lower, unknown = [], None, 0.0
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = tables[k].withColumns(dict(zip(("ctx_high", "ctx_low"), _context(), strict=True)))
        contexts = t.groupBy("ctx_high", "ctx_low").agg(F.sum("c").alias("total"), F.sum(cut).alias("left")).withColumn("gamma", F.col("left") / F.col("total"))
        if k == 1:  # one context, the empty one
            row, n = contexts.first(), tables[1].count()
            unknown = row["gamma"] / (n + 1) if row else 1.0
            p = t.select("high", "low", ((F.col("c") - cut) / (row["total"] if row else 1) + unknown).alias("p"))
        else:
            high, low = _shortened(k - 1)
            p = t.join(contexts, ["ctx_high", "ctx_low"]).withColumns({"s_high": high, "s_low": low})
            p = p.join(lower.select(F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("q")), ["s_high", "s_low"])
            p = p.select("high", "low", ((F.col("c") - cut) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
            rows.append(contexts.select(F.col("ctx_high").alias("high"), F.col("ctx_low").alias("low"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("weight")))
        lower = stored(p, f"probability{k}")
        rows.append(lower.select("high", "low", F.log("p").alias("logp"), F.lit(None).cast("double").alias("weight")))
    entries = rows[0]
    for r in rows[1:]:
        entries = entries.unionAll(r)
    return Model(stored(entries.groupBy("high", "low").agg(F.max("logp").alias("logp"), F.max("weight").alias("weight")), "model"), float(np.log(unknown)))


def digest(text: str) -> list[Column]:
    """Two longs that tell texts apart."""
    return [F.xxhash64(text).alias("text_1"), F.crc32(F.encode(text, "UTF-8")).alias("text_2")]


def _even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """One number for each of n partitions that Spark's hash sends there: two longs a batch of texts come to the driver."""
    part = F.pmod(F.hash("id"), F.lit(n))
    rows = spark.range(TRIED * n).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    return np.sort(np.array([r["id"] for r in rows], np.int64))


def _packed(docs: DataFrame, text: str, batches: int) -> DataFrame:
    """Pieces of the texts, compressed, each with its batch. Which batch a piece goes to follows from its first text."""
    keys = _even_keys(docs.sparkSession, batches)

    def pack(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            one, two = (batch.column(c).to_numpy() for c in (1, 2))
            texts = (t for part in sliced([batch.column(0)]) for t in part.to_pylist())
            for at, (piece, which, lengths, begins) in enumerate(pieces(texts, PIECE)):
                raw = piece.encode("utf-8", "surrogatepass")
                columns = {
                    "batch": pa.array([keys[(int(one[which[0]]) + at) % len(keys)]], pa.int64()), "text_1": pa.array([one[which]], pa.list_(pa.int64())), "text_2": pa.array([two[which]], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())), "begins": pa.array([begins], pa.list_(pa.int64())), "size": pa.array([len(raw)], pa.int64()), "piece": pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.where(F.length(text) > 0).select(text, *digest(text))
    schema = "batch long, text_1 array<long>, text_2 array<long>, lengths array<long>, begins array<long>, size long, piece binary"
    return rows.mapInArrow(released(pack), schema).repartition(batches, "batch")


def _grams_of(piece: bytes, size: int, lengths) -> Grams:
    return Grams(pa.decompress(piece, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass"), lengths)


def asked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams and contexts that the probabilities of these five-grams may need, each once. Each length is made of
    the distinct n-grams of the next, and is told apart by itself, so that little more than the result is held."""
    every = []
    asked_for = high[:0], low[:0]
    for k in range(ORDER, 0, -1):
        high, low = _distinct(*shortened(high, low, k))
        every.append(_distinct(*(np.concatenate([x, y]) for x, y in zip((high, low), asked_for, strict=True))))
        asked_for = context(high, low)
    return tuple(np.concatenate([e[i] for e in every]) for i in (0, 1))


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.unique(mixed(high, low), return_index=True)[1]
    return high[first], low[first]


def _questions(packed: DataFrame) -> DataFrame:
    """(batch, high, low): what each batch asks for, once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for rows in sliced(batches, 1):
            for b, piece, size, lengths in zip(*(rows.column(c).to_pylist() for c in ("batch", "piece", "size", "lengths")), strict=True):
                grams = _grams_of(piece, size, lengths)
                key, high, low = mixed(grams.high, grams.low), grams.high, grams.low
                if b in seen:
                    key, high, low = (np.concatenate([x, y]) for x, y in zip(seen[b], (key, high, low), strict=True))
                    key, first = np.unique(key, return_index=True)
                    high, low = high[first], low[first]
                seen[b] = key, high, low
        for b in sorted(seen):
            high, low = asked(*seen.pop(b)[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), b)), _long(high), _long(low)], names=["batch", "high", "low"])

    # All columns, so that the pieces are dealt once for questions and scores.
    return packed.mapInArrow(released(ask), "batch long, high long, low long")


class Answers:
    """What a batch was told of its n-grams, found again by sorted keys."""

    def __init__(self, found: pa.Table, unknown: float):
        keys = mixed(*(found[c].to_numpy().view(np.uint64) for c in ("high", "low")))
        by = np.argsort(keys)
        self.keys, self.unknown = keys[by], unknown
        self.logp = np.append(found["logp"].to_numpy()[by], np.nan)
        self.weight = np.nan_to_num(np.append(found["weight"].to_numpy()[by], 0.0))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return np.where(there, at, len(self.keys))

    def log_probabilities(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Natural log probability of the last character of each five-gram after the first four."""
        total, rest = np.zeros(len(high)), np.arange(len(high))
        for k in range(ORDER, 0, -1):
            h, l = shortened(high[rest], low[rest], k)  # noqa: E741
            p = self.logp[self._find(mixed(h, l))]
            there = ~np.isnan(p)
            total[rest[there]] += p[there]
            rest = rest[~there]
            if k == 1:
                total[rest] += self.unknown
            elif len(rest):
                total[rest] += self.weight[self._find(mixed(*context(h[~there], l[~there])))]
        return total


def scored(docs: DataFrame, model: Model, text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(text_1, text_2, logp, chars, copies) of each distinct text of docs: sums over its characters, and its rows."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    batches = max(1 + size // batch_bytes, min(docs.sparkSession.sparkContext.defaultParallelism, 1 + size // LEAST_BATCH_BYTES))
    packed, unknown = _packed(docs, text, int(batches)), model.unknown
    answers = _questions(packed).join(model.entries, ["high", "low"])

    def score(held: pa.Table, found: pa.Table) -> pa.Table:
        parts, told = [], Answers(found, unknown)
        for piece, n, lengths, begins, one, two in zip(*(held[c].to_pylist() for c in ("piece", "size", "lengths", "begins", "text_1", "text_2")), strict=True):
            grams = _grams_of(piece, n, lengths)
            each = told.log_probabilities(grams.high, grams.low)[grams.index]
            parts.append([np.array(one), np.array(two), np.add.reduceat(each, grams.starts), np.array(lengths), np.array(begins)])
        names = ["text_1", "text_2", "logp", "chars", "copies"]
        del told
        release()
        return pa.table([pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0), pa.float64() if i == 2 else pa.int64()) for i in range(5)], names=names)

    schema = "text_1 long, text_2 long, logp double, chars long, copies long"
    sums = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)
    sums = sums.groupBy("text_1", "text_2").agg(*[F.sum(c).alias(c) for c in ("logp", "chars", "copies")])
    return sums.select("text_1", "text_2", (F.col("logp") / F.col("copies")).alias("logp"), (F.col("chars") / F.col("copies")).cast("long").alias("chars"), "copies")


def thresholds(scores: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang_key, median, threshold) of scored held-out trusted documents; the row of null lang_key is that of all."""
    x = scores.where("chars > 0").select(F.coalesce(F.col(lang), F.lit("")).alias("lang_key"), F.floor(-F.col("logp") / F.col("chars") / BIN).alias("bin"))
    bins = stored(x.groupBy("lang_key", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lang_key", F.lit(None).cast("string")))
    run = Window.partitionBy("lang_key").orderBy("bin")
    bins = bins.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy("lang_key"))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) * BIN))
    found = stored(bins.groupBy("lang_key").agg(at(0.5).alias("median"), at(0.9).alias("high"), F.first("total").alias("total")), "quantiles")
    found = found.withColumn("spread", F.greatest(F.col("high") - F.col("median"), F.lit(4 * BIN)))
    every = found.where("lang_key IS NULL").select(F.col("spread").alias("all_spread"), (F.col("median") + REACH * F.col("spread")).alias("all_threshold"))
    few_rows = F.col("lang_key").isNotNull() & (F.col("total") < LEAST_TRUSTED)
    spread = F.when(few_rows, F.greatest("spread", "all_spread")).otherwise(F.col("spread"))
    own = F.col("median") + REACH * spread
    return found.join(F.broadcast(every), F.lit(True)).select("lang_key", "median", F.when(few_rows, F.greatest(own, "all_threshold")).otherwise(own).alias("threshold"))


def trusted_docs(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that labels rate good."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return docs.join(few(good), key, "left_semi")


def held_out() -> Column:
    """Whether a trusted text, by its digest, is kept out of the counts."""
    return F.pmod("text_1", F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document: doc_id, lang, text_1, text_2 (the digest of its text), nll, perplexity, threshold, kept;
    by a model and thresholds of the trusted part of docs."""
    trusted = trusted_docs(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")), labels)
    trusted = trusted.where(F.length("text") > 0).select("text", "lang", *digest("text"))
    model = train(trusted.where(~held_out()))
    scores = stored(scored(docs, model, text), "scores")
    apart = trusted.where(held_out()).groupBy("text_1", "text_2", "lang").agg(F.count(F.lit(1)).alias("n"))
    limits = few(stored(thresholds(apart.join(scores, ["text_1", "text_2"])).where("lang_key IS NOT NULL"), "thresholds"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), *[F.when(F.length(text) > 0, c).alias(n) for c, n in zip(digest(text), ("text_1", "text_2"), strict=True)])
    rows = lookup(rows, scores, ["text_1", "text_2"], "copies").withColumn("lang_key", F.coalesce("lang", F.lit(""))).join(limits, "lang_key", "left")
    there = F.col("chars") > 0
    nll = F.when(there, (-F.col("logp") + SHORT_CHARS * F.coalesce("median", -F.col("logp") / F.col("chars"))) / (F.col("chars") + SHORT_CHARS))
    return rows.select("doc_id", "lang", "text_1", "text_2", nll.alias("nll"), F.exp(F.when(there, -F.col("logp") / F.col("chars"))).alias("perplexity"), "threshold", F.coalesce(nll <= F.col("threshold"), F.lit(True)).alias("kept"))
