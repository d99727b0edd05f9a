"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A document's pre-tokens are its words (``WORD``), each with the vocabulary's word mark in front. A
task puts every distinct pre-token it meets into one trie. The forward score of a trie node - the
best score of any segmentation of the prefix it stands for, and how many tokens that has - depends on
the prefix alone, so it is computed when the node is made and shared by all words below it. The
terminal node's count is remembered for the word. Documents are sums of those counts, so the operator
is one pass without a shuffle.

Scores: the vocabulary file lists pieces by rank; piece r has the log probability of Zipf's law,
-log((r + 2) * norm). A character that no piece covers is spelt in bytes: as many tokens as it has
UTF-8 bytes, at ``UNKNOWN`` below the worst piece. Equal scores: fewer tokens.

Cases: null and empty texts count 0 words and 0 tokens; repeated rows are counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import texts_of

WORD_MARK = "▁"
UNKNOWN = 10.0
#: Nodes of a worker's trie; it starts anew beyond this number.
TRIE_NODES = 1_500_000
COUNTS = "doc_id long, n_words long, n_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece, by its rank in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = sum(1 / (r + 2) for r in range(len(pieces)))
    return {p: -math.log((r + 2) * norm) for r, p in enumerate(pieces)}


class PrefixTrie:
    """Words share the forward scores of their common prefixes."""

    def __init__(self, scores: dict[str, float], most_nodes: int = TRIE_NODES):
        self.scores, self.most_nodes = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.forget()

    def forget(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of tokens of ``word``."""
        text = WORD_MARK + word
        node, path = 0, [0]
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        for at, char in enumerate(text):
            below = child.get((node, char))
            if below is None:
                end = at + 1
                top, count = best[node] + self.unknown, tokens[node] + len(char.encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - self.longest), end):
                    score = scores.get(text[start:end])
                    if score is not None:
                        score += best[path[start]]
                        n = tokens[path[start]] + 1
                        if score > top or (score == top and n < count):
                            top, count = score, n
                below = len(best)
                best.append(top)
                tokens.append(count)
                child[node, char] = below
            node = below
            path.append(node)
        self.terminal[word] = tokens[node]
        return tokens[node]

    def count(self, words: list[str]) -> int:
        known = self.terminal
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(self.best) > self.most_nodes:
                self.forget()
                known = self.terminal
            for w in sorted(set(words).difference(known)):
                self.insert(w)
            return sum(map(known.__getitem__, words))


@functools.lru_cache(maxsize=1)
def _trie(path: str) -> PrefixTrie:
    return PrefixTrie(read_pieces(path))


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    path = vocabulary or default_vocabulary()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path)
        for batch in batches:
            out = []
            for doc, text in texts_of(batch):
                words = words_of(text) if text else []
                out.append((doc, len(words), trie.count(words)))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counts, COUNTS)
