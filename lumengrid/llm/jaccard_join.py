"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its five-word shingles. Each tree of the forest orders the texts by a string of min-hashes, kept in
one long integer, most significant byte first: a node of the sorted prefix trie is a range of longs, and a shorter prefix
is a shift. Matching begins at the whole strings. Pairs that share a prefix of the current length in some tree, and none
longer, are verified exactly; then the prefixes are shortened by one, where only trie nodes with several children bring
new pairs. From the similarity s of every link found its chance to be found by then, 1 - (1 - s^k)^trees, is known, so
the links found tell the recall (each stands for 1 / chance links). Shortening ends when that measured recall reaches
the target, or at the length at which links of the threshold similarity themselves reach it.

Texts of equal shingle sets are one class with a count, so copies are never expanded into pairs. The classes that meet in
new nodes lie in one connected group of the trie's shortest prefixes; a group larger than a block is cut into blocks, and each pair of blocks is
a task. Where that would move and compare more than dealing a large group by its trie nodes does, as in chains of texts,
it is dealt by node, and a pair belongs to the first tree in which it meets. Only sets of hashes of those classes move,
never texts. Links are counted in the task and never listed.

Defined results: null texts and texts without a word have no shingle and link with nothing; texts of one to four words
are one shingle; rows with a null id link with nothing and have a null class; repeated rows link with one another, each
gets its row; rows of one id with different texts are linked each by its own text. Texts are read whole. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bucket, few, lookup, released, runs, sliced, stored, word_blocks
from .components import components, spanning

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
TREES, LONGEST = 24, 8
#: Target share of links found, and the links that are enough to measure it.
RECALL, MEASURED = 0.9999, 100
#: Classes of a block; a task verifies the pairs of two blocks.
BLOCK = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of `size` words."""
    parts = [hashes.array(words) for words in word_blocks(text)]
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = h * _MIX + w[i : len(w) - size + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Forest:
    """The min-hash strings of shingle sets, one long for each tree."""

    def __init__(self, trees: int = TREES, longest: int = LONGEST, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.trees, self.longest = trees, longest
        self.factor = draw.integers(0, 1 << 63, trees * longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, trees * longest, dtype=np.uint64)

    def strings(self, sets: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(sets), 512):
            part = (sets[at : at + 512, None] * self.factor + self.shift).min(0)
            least = part if least is None else np.minimum(least, part)
        least = least.copy()
        least ^= least >> np.uint64(31)
        byte = (least * _MIX >> np.uint64(56)).reshape(self.trees, self.longest)
        key = np.zeros(self.trees, np.uint64)
        for k in range(self.longest):
            key |= byte[:, k] << np.uint64(8 * (7 - k))
        return key.view(np.int64)


def chance(similarity, k: int, trees: int = TREES):
    """The chance that two texts share a prefix of k min-hashes in some tree."""
    return 1 - (1 - similarity**k) ** trees


def shortest(similarity: float, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix by which texts of this very similarity meet with the target recall, or 1."""
    return next((k for k in range(longest, 1, -1) if chance(similarity, k, trees) >= recall), 1)


def signed(docs: DataFrame, key: str, text: str, size: int, carry: dict[str, str]) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, strings) and carried columns: h1 and h2 are the digest of the shingle set, null where
    it is empty."""
    kept = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(n) for n, c in carry.items()])
    of = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, forest = WordHashes(), Forest()
        for batch in sliced(batches):
            n, h1, h2, strings = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, hashes, size)
                n.append(len(s))
                digest = digest_of(s) if len(s) else (None, None)
                h1.append(digest[0])
                h2.append(digest[1])
                strings.append(forest.strings(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(strings, pa.list_(pa.int64())), *(batch.column(c) for c in carry)], names=["doc_id", "n_shingles", "h1", "h2", "strings", *carry])

    return kept.mapInArrow(released(sign), ", ".join(["doc_id long, n_shingles long, h1 long, h2 long, strings array<long>", *(f"`{n}` {of[n]}" for n in carry)]))


def digest_of(found: np.ndarray) -> tuple[int, int]:
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(h1), int(h2)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of left shares with each set of right, or of left; frequent shingles go through matrix
    products, the others through their lists of texts."""
    sets = left + (right or [])
    n, m = len(left), len(right if right is not None else left)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(ids, kind="stable")
    ids, owner = ids[by], owner[by]
    if right is None:
        a_ids, a, b_ids, b = ids, owner, ids, owner
    else:
        mine = owner < n
        a_ids, a, b_ids, b = ids[mine], owner[mine], ids[~mine], owner[~mine] - n
    width = int(ids[-1]) + 1
    da, db = np.bincount(a_ids, minlength=width), np.bincount(b_ids, minlength=width)
    pairs = da * db
    useful = pairs > (0 if right is not None else 1)
    frequent = np.flatnonzero(useful & (pairs * 64 >= n * m) & (pairs > 16))
    total = np.zeros((n, m), np.float32)
    column = np.full(width, -1)
    column[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 2048):
        wide = min(2048, len(frequent) - at)
        x, y = np.zeros((n, wide), np.float32), np.zeros((m, wide), np.float32)
        for matrix, which, rows in ((x, column[a_ids] - at, a), (y, column[b_ids] - at, b)):
            here = (which >= 0) & (which < wide)
            matrix[rows[here], which[here]] = 1
        total += x @ y.T
    rare = np.flatnonzero(useful & (column < 0))
    sa, sb = np.cumsum(da) - da, np.cumsum(db) - db
    cuts = np.unique(np.append(np.searchsorted(np.cumsum(pairs[rare]), np.arange(0, pairs[rare].sum(), 1 << 20)), len(rare)))
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        r = rare[begin:end]
        left_of = np.repeat(r, da[r])
        i = a[np.repeat(sa[r] - np.cumsum(da[r]) + da[r], da[r]) + np.arange(da[r].sum())]
        count = db[left_of]
        j = b[np.repeat(sb[left_of] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        total += np.bincount(np.repeat(i, count) * m + j, minlength=n * m).reshape(n, m).astype(np.float32)
    return total


def meeting(a: np.ndarray, b: np.ndarray, k: int, tree: int = -1, longest: int = LONGEST) -> np.ndarray:
    """Which pairs of string rows share a prefix of k min-hashes in some tree and none of k + 1; of these, those whose
    first such tree is `tree`, if one is given."""
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 21) // max(1, b.size))
    cut = lambda x, n: x >> np.uint64(64 - 8 * n)
    for at in range(0, len(a), step):
        x = a[at : at + step, None, :]
        same = cut(x, k) == cut(b, k)[None]
        here = same.any(2)
        if tree >= 0:
            here &= same.argmax(2) == tree
        if k < longest:
            here &= ~(cut(x, k + 1) == cut(b, k + 1)[None]).any(2)
        out[at : at + step] = here
    return out


def _sets(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """wanted (id, rep, h1, h2, ...) with the shingle set of each as bytes of 64-bit hashes; one row an id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, 256):
            found = [shingles(t, hashes, size) for t in batch.column("text").to_pylist()]
            mine = [len(s) > 0 and digest_of(s) == (a, b) for s, a, b in zip(found, batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)]
            keep = pa.array(mine, pa.bool_())
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("copies"), pa.array([s.tobytes() for s, m in zip(found, mine, strict=True) if m], pa.binary())], names=["id", "copies", "hashes"])

    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    # Only numbers are sent to the texts; the strings meet the sets where these are dealt by id already.
    rows = texts.join(few(wanted.drop("strings")), "rep").select("id", "h1", "h2", "copies", "text")
    return rows.mapInArrow(released(build), "id long, copies long, hashes binary").dropDuplicates(["id"]).join(wanted.select("id", "strings"), "id")


def _met(forest: DataFrame, k: int, new: bool) -> tuple[DataFrame, DataFrame]:
    """The trie nodes of prefix length k that hold several classes, (tree, node, least, n), and (id, tree, node, least, n)
    of those classes. With `new`, only nodes of several children, where pairs meet that met at no longer prefix."""
    child = F.shiftrightunsigned("s", 64 - 8 * min(k + 1, LONGEST))
    nodes = forest.select("id", "tree", F.shiftrightunsigned("s", 64 - 8 * k).alias("node"), child.alias("child"))
    shared = nodes.groupBy("tree", "node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("child").alias("low"), F.max("child").alias("high"))
    shared = stored(shared.where(F.col("low") < F.col("high") if new else F.col("n") > 1).drop("low", "high"), "nodes")
    return shared, stored(lookup(nodes.drop("child"), shared, ["tree", "node"], "n").where("least IS NOT NULL"), "met")


def _units(forest: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(id, component, tree, node, m): where each class is to be verified at prefix length k; tree -1 for whole groups."""
    shared, met = _met(forest, k, k < LONGEST)
    here = met.select("id").distinct().join(groups, "id")
    sizes = stored(here.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "sizes")
    placed = lookup(here, sizes, ["component"], "m")
    whole = placed.select("id", "component", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("node"), "m")
    large = sizes.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return whole
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK))
    within = placed.where(F.col("m") > BLOCK).select(F.col("id").alias("least"), "component", "m")
    by_node = shared.join(within, "least").groupBy("component", "m").agg(F.sum(F.col("n") * blocks("n")).alias("cost"))
    by_node = stored(by_node.where(F.col("cost") < F.col("m") * blocks("m")).select("component"), "by-node")
    apart = met.join(groups.join(by_node, "component"), "id").select("id", "component", "tree", "node", F.col("n").alias("m"))
    return whole.join(by_node, "component", "left_anti").select(*apart.columns).unionByName(apart)


def _verified(sets: DataFrame, units: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """(id, links, root, pairs, missed) of the pairs that meet at prefix length k and no longer one: links counts rows,
    pairs counts classes, once a pair; missed[j] is how many links each of these pairs stands for beside itself at j."""
    members = units.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("block", (bucket("id", buckets=1 << 20) % F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("id", "component", "tree", "node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    keys = ["component", "tree", "node", "x", "y"]
    dealt = sets.join(members, "id").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    p, q = similarity.numerator, similarity.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, tree, _, x, y), group in runs(batches, keys):
            side = group["side"].to_numpy()
            left, total = int((side == 0).sum()), len(side)
            if not left or (left == total if x != y else total < 2):
                continue
            strings = np.array(group["strings"].combine_chunks().flatten()).view(np.uint64).reshape(total, -1)
            own = x == y
            mask = meeting(strings, strings, k, tree) if own else meeting(strings[:left], strings[left:], k, tree)
            if own:
                mask &= np.tri(total, k=-1, dtype=bool).T
            if not mask.any():
                continue
            sets_ = [np.frombuffer(b, np.uint64) for b in group["hashes"].to_pylist()]
            sizes = np.array([len(s) for s in sets_])
            i, j = np.nonzero(mask)
            if 16 * len(i) < mask.size:  # few pairs: each by itself
                shared = np.array([len(np.intersect1d(sets_[a], sets_[b if own else b + left], assume_unique=True)) for a, b in zip(i, j, strict=True)])
            else:
                shared = shared_counts(sets_, None)[i, j] if own else shared_counts(sets_[:left], sets_[left:])[i, j]
            if not own:
                j = j + left
            shared = shared.astype(np.int64)
            hit = shared * (p + q) >= p * (sizes[i] + sizes[j])
            if not hit.any():
                continue
            i, j, shared = i[hit], j[hit], shared[hit]
            alike = shared / (sizes[i] + sizes[j] - shared)
            ids, n = group["id"].to_numpy(), group["copies"].to_numpy()
            links = np.bincount(i, n[j], total) + np.bincount(j, n[i], total)
            root = spanning(total, np.stack([i, j], 1))
            pairs = np.bincount(i, minlength=total)
            missed = np.stack([np.bincount(i, 1 / chance(alike, at) - 1, total) for at in range(1, LONGEST + 1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root]), pa.array(pairs.astype(np.int64)), pa.array(list(missed), pa.list_(pa.float64()))], names=["id", "links", "root", "pairs", "missed"])

    return dealt.mapInArrow(released(verify), "id long, links long, root long, pairs long, missed array<double>").where("links > 0")


def forest_links(sets: DataFrame, forest: DataFrame, groups: DataFrame, similarity: Fraction, recall: float) -> tuple[list[DataFrame], int, float]:
    """The links by level, the prefix length reached, and the recall measured there."""
    found: list[DataFrame] = []
    last, pairs, missed = shortest(float(similarity), recall), 0, np.zeros(LONGEST)
    for k in range(LONGEST, last - 1, -1):
        level = stored(_verified(sets, _units(forest, groups, k), k, similarity), "links")
        seen = level.agg(F.coalesce(F.sum("pairs"), F.lit(0)), *[F.coalesce(F.sum(F.col("missed")[at]), F.lit(0.0)) for at in range(LONGEST)]).first()
        pairs, missed = pairs + seen[0], missed + np.array(seen[1:])
        found.append(level)
        measured = pairs / (pairs + missed[k - 1]) if pairs else 1.0
        if pairs >= MEASURED and measured >= recall:
            break
    return found, k, float(measured)


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY, size: int = SHINGLE_WORDS, recall: float = RECALL, carry: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_size, n_links, component_id, kept, and carried columns, by
    their new names.

    n_links counts the other documents with at least the similarity; component_id is the smallest id reachable by links.
    """
    carry = carry or {}
    rows = stored(signed(docs, key, text, size, carry), "shingles")
    classes = rows.where("doc_id IS NOT NULL AND h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("strings").alias("strings"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    trees = classes.select("id", F.posexplode("strings").alias("tree", "s"))
    # What shares no prefix of the shortest length with another meets none at any level; groups of that length hold all.
    _, met = _met(trees, shortest(float(similarity), recall), False)
    groups = stored(components(met, "id", "least"), "groups")
    forest = stored(trees.join(groups.select("id"), "id", "left_semi"), "forest")
    sets = stored(_sets(docs, key, text, size, classes.join(groups.select("id"), "id", "left_semi")), "sets")
    found, _, _ = forest_links(sets, forest, groups, similarity, recall)
    known = classes.drop("strings")
    counted = found[0]
    for level in found[1:]:
        counted = counted.unionAll(level)
    degree = counted.groupBy("id").agg(F.sum("links").alias("links"))
    parts = known.select("id", "rep").join(components(counted, "id", "root"), "id")
    least = parts.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    placed = lookup(parts.drop("rep"), stored(least, "components"), ["component"], "members").select("id", "component_id")
    known = known.join(degree, "id", "left").join(placed, "id", "left")
    known = stored(known.select("h1", "h2", "rep", "copies", "links", "component_id"), "known")
    out = lookup(rows.drop("strings"), known, ["h1", "h2"], "copies").withColumn("own", F.col("rep").isNotNull() & F.col("doc_id").isNotNull())
    component = F.when(F.col("own"), F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("own"), F.col("copies")).otherwise(F.lit(1)).cast("long").alias("class_size"), F.when(F.col("own"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *carry)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM (
      SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS k FROM d WHERE len(ws) > 0))),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 9 * count(*) >= 4 * (min(a.n) + min(b.n))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT doc_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n ON n.a = doc_id LEFT JOIN c ON c.a = doc_id
"""
