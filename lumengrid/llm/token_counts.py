"""Token counts by a linear longest-match automaton.

Word pieces are counted as greedy longest-match-first would cut a word, without cutting it: a trie of the vocabulary,
with a failure link for every node and the number of pieces that following it has settled, reads each byte once. A word
that cannot be cut is one unknown token. A text's tokens are the sum over its words, the runs of anything but blank and
the ASCII controls 9 to 13.

The vocabulary is read from a file, whose path is a parameter, on the driver: pieces with a blank before them begin words, the
others continue them. Only the compiled automaton, whose size follows the vocabulary, goes to the tasks.

Defined results: null texts have no words and no tokens; so have empty texts; texts are read whole; repeated rows are
counted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, struct_array

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of words that a worker remembers, what an entry takes beside its word, and the longest word remembered.
REMEMBERED, ENTRY, LONG_WORD = 64 << 20, 150, 1000
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
BEGIN, CONTINUE = 0, 1


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that continue one) of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    blank = bytes(range(9, 14)) + b" "
    first = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    return [p for p in first if not any(b in blank for b in p)], [p for p in pieces if p and not any(b in blank for b in p)]


class Automaton:
    """goto: node and byte to node; fail: where to go on when there is none, -1 for nowhere; popped: pieces settled by it."""

    def __init__(self, begin: Iterable[bytes], follow: Iterable[bytes]):
        goto: dict[int, int] = {}
        whole, children = [False, False], [[], []]
        for root, pieces in ((BEGIN, begin), (CONTINUE, follow)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = goto.get(node << 8 | byte)
                    if nxt is None:
                        nxt = goto[node << 8 | byte] = len(whole)
                        whole.append(False)
                        children.append([])
                        children[node].append((byte, nxt))
                    node = nxt
                whole[node] = True
        fail, popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([BEGIN, CONTINUE])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                queue.append(child)
                if whole[child]:
                    fail[child], popped[child] = CONTINUE, 1
                    continue
                at, settled = fail[node], popped[node]
                while at >= 0 and (at << 8 | byte) not in goto:
                    settled += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[child], popped[child] = goto[at << 8 | byte], settled
        self.goto, self.fail, self.popped = goto, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 where it can't be cut, 0 for none."""
        node, total, goto, fail, popped = BEGIN, 0, self.goto, self.fail, self.popped
        if not word:
            return 0
        for byte in word:
            while (nxt := goto.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = nxt
        while node != CONTINUE:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


class WordCounts(dict):
    """Word -> its count, remembered up to a bound of bytes; words that are long by themselves are not."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.held = automaton, 0

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(word)
        if len(word) <= LONG_WORD:
            if self.held >= REMEMBERED:
                self.clear()
                self.held = 0
            self[word] = value
            self.held += ENTRY + len(word)
        return value


def blank_blocks(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text between blanks, in lists of about `size` bytes."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_BLANKS), 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> Column:
    """A struct column: n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*read_vocabulary(vocabulary)))
    kept: list[WordCounts] = []

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not kept:
            kept.append(WordCounts(shared.value))
        of = kept[0].__getitem__
        for batch in sliced(batches):
            n_words, n_tokens = [], []
            for t in batch.to_pylist():
                words = tokens_ = 0
                for block in blank_blocks(t):
                    words += len(block)
                    tokens_ += sum(map(of, block))
                n_words.append(words)
                n_tokens.append(tokens_)
            yield struct_array({"n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return tokens(docs[text])


#: Token counts by DuckDB: the distinct words are cut piece by piece, the longest first, in hexadecimal digits.
ORACLE = rf"""
WITH RECURSIVE v AS (SELECT hex(from_base64(split_part(line, ' ', 1))) AS h FROM read_csv('{VOCABULARY}', header = false, columns = {{'line': 'VARCHAR'}}, delim = '\t', quote = '', escape = '')),
blank AS (SELECT h, regexp_matches(h, '^(..)*(09|0A|0B|0C|0D|20)') AS has, regexp_matches(substr(h, 3), '^(..)*(09|0A|0B|0C|0D|20)') AS later FROM v),
p AS (SELECT DISTINCT 0 AS kind, substr(h, 3) AS piece FROM blank WHERE h LIKE '20%' AND len(h) > 2 AND NOT later
      UNION ALL SELECT DISTINCT 1, h FROM blank WHERE len(h) > 0 AND NOT has),
longest AS (SELECT max(len(piece)) // 2 AS most FROM p),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ 	-]+')) AS word FROM documents),
w AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM d)),
cut AS (SELECT word, h AS rest, 0 AS n FROM w
        UNION ALL
        SELECT word, substr(rest, 1 + max(len(piece))), n + 1
        FROM (SELECT word, rest, n, unnest(range(1, 1 + least(len(rest) // 2, (SELECT most FROM longest)))) AS k FROM cut WHERE rest <> '') c
        JOIN p ON p.kind = least(n, 1) AND p.piece = substr(rest, 1, 2 * k) GROUP BY word, rest, n),
counted AS (SELECT word, coalesce(max(n) FILTER (rest = ''), 1) AS n FROM cut GROUP BY word),
t AS (SELECT doc_id, count(*) AS n_words, sum(n) AS n_tokens FROM d JOIN counted USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM documents LEFT JOIN t USING (doc_id)
"""
