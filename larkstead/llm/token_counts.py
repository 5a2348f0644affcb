"""Token counts by a unigram model over a public vocabulary, through a shared trie.

Words ``[^\\x20\\x09-\\x0D]+`` are cut into pre-tokens: runs of letters, of digits, of anything else;
a word's first has the vocabulary's word mark U+2581 in front. A piece of id i scores
``-log(1 + i)`` (vocabularies list pieces by rank); a character that is no piece falls back to its
UTF-8 bytes, one token each, at a score below any piece. A pre-token's count is the number of
tokens of its best-scoring segmentation, ties to fewer tokens. Distinct pre-tokens go into a trie:
the forward score of a prefix is computed once and shared by all pre-tokens that start with it,
and the node where one ends holds its count. Beyond SHARED characters a pre-token's prefixes are
hardly shared: they are scored on, in a window as long as the longest piece, without nodes.

Each task needs only its own rows: no shuffle. Null and empty texts have 0 tokens; repeated rows
and repeated ids give a row each; only the id and text columns are read, whatever others hold.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, map_batches, slices, texts_of

#: Trie nodes a worker keeps before it starts a new trie (results don't depend on it).
MAX_NODES = 600_000
#: Characters of a pre-token that get nodes.
SHARED = 64
#: Score of one fallback byte.
BYTE_SCORE = -30.0
MARK = "▁"
PRE_TOKENS = regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+")


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> dict[str, float]:
    """Piece -> score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return {model.id_to_piece(i): -math.log(1 + i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)}


class Trie:
    """Prefixes of pre-tokens; a node is [best forward score, tokens, children or None]."""

    def __init__(self, pieces: dict[str, float]):
        #: Every ending of a piece, with the piece's score, or None for an ending that is no piece.
        self.longest = max(map(len, pieces), default=1)
        self.endings = {piece[k:]: None for piece in pieces for k in range(len(piece))} | pieces
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [0.0, 0, None], 1

    def count(self, token: str) -> int:
        """Tokens of the best segmentation; the trie grows by the prefixes it lacks."""
        if self.nodes > MAX_NODES:
            self.clear()
        node = self.root
        path = [node]
        for i, char in enumerate(token[:SHARED], 1):
            if node[2] is None:
                node[2] = {}
            after = node[2].get(char)
            if after is None:
                after = node[2][char] = self._forward(token, i, path)
                self.nodes += 1
            path.append(after)
            node = after
        for i in range(SHARED + 1, len(token) + 1):
            gone = max(0, len(path) - self.longest - 1)
            start = i - len(path) + gone
            del path[:gone]
            node = self._forward(token[start:i], i - start, path)
            path.append(node)
        return node[1]

    def _forward(self, token: str, i: int, path: list) -> list:
        """The node of the first i characters; path has those of 0 to i - 1."""
        best, tokens = -math.inf, 0
        for start in range(i - 1, -1, -1):
            piece = token[start:i]
            if piece not in self.endings:
                break
            score = self.endings[piece]
            if score is not None:
                before = path[start]
                score += before[0]
                if score > best or score == best and before[1] + 1 < tokens:
                    best, tokens = score, before[1] + 1
        char = token[i - 1]
        if self.endings.get(char) is None:
            n = len(char.encode("utf-8", "surrogatepass"))
            score, count = path[i - 1][0] + n * BYTE_SCORE, path[i - 1][1] + n
            if score > best or score == best and count < tokens:
                best, tokens = score, count
        return [best, tokens, None]


def word_count(trie: Trie, word: bytes) -> int:
    """Tokens of a word: of its marked first pre-token and of the others."""
    first, *others = PRE_TOKENS.findall(word.decode("utf-8", "replace"))
    return trie.count(MARK + first) + sum(map(trie.count, others))


@lru_cache(maxsize=2)
def _counter(model_file: str) -> Memo:
    trie = Trie(vocabulary(model_file))
    return Memo(lambda word: word_count(trie, word))


def token_counts(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for each row."""
    kept = docs.select(F.col(id_column), F.col(text_column))
    schema = T.StructType([kept.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        memo = _counter(model_file)
        for batch in batches:
            texts, words, tokens = texts_of(batch.column(1)), [], []
            for a, b in slices([len(x) for x in texts]):
                for text in texts[a:b]:
                    own = text.split()
                    words.append(len(own))
                    tokens.append(sum(memo.many(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[f.name for f in schema])

    return map_batches(kept, count, schema)
