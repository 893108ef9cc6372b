"""Token counts by unigram segmentation over a trie of distinct pre-tokens."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes that one worker holds before it starts a new trie, and terminals it remembers for each of them; results do not depend on either.
MAX_NODES, TERMINALS = 400_000, 1.5

RESULT = "n_words long, n_tokens long, log_prob double"


class TokenTrie:
    """Trie over pre-tokens. A node stands for a prefix and holds the forward score of its best segmentation,
    computed once from the nodes above it, and the number of tokens of that segmentation.

    score(prefix) = max over vocabulary pieces that end the prefix of score(prefix without piece) + log p(piece). Equal
    scores take the longer last piece. A character that no piece covers falls back to its UTF-8 bytes."""

    def __init__(self, log_p: dict[str, float], byte_log_p: float, max_nodes: int = MAX_NODES):
        self.log_p, self.byte_log_p, self.max_nodes = log_p, byte_log_p, max_nodes
        self.longest = max(map(len, log_p), default=1)
        self.terminal: dict[str, tuple[int, float]] = {}
        self.clear()

    def clear(self) -> None:
        """Starts a new trie; what terminals hold stays known."""
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]

    def insert(self, word: str) -> tuple[int, float]:
        """Token count and score of a pre-token, stored at its terminal node."""
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            below = self.children[node].get(char)
            if below is None:
                below = self._add(node, char, word, end, path)
            node = below
            path.append(node)
        found = (self.tokens[node], self.score[node])
        self.terminal[word] = found
        return found

    def _add(self, parent: int, char: str, word: str, end: int, path: list[int]) -> int:
        best, count = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            p = self.log_p.get(word[start:end])
            if p is not None and self.score[path[start]] + p > best:
                best, count = self.score[path[start]] + p, self.tokens[path[start]] + 1
        if char not in self.log_p:
            n = len(char.encode("utf-8", "surrogatepass"))
            if self.score[path[end - 1]] + n * self.byte_log_p > best:
                best, count = self.score[path[end - 1]] + n * self.byte_log_p, self.tokens[path[end - 1]] + n
        self.children.append({})
        self.score.append(best)
        self.tokens.append(count)
        self.children[parent][char] = len(self.score) - 1
        return len(self.score) - 1

    def count(self, words: list[str]) -> tuple[int, float]:
        """Tokens and score of a list of pre-tokens."""
        known, total, score = self.terminal, 0, 0.0
        for w in words:
            got = known.get(w)
            if got is None:
                if len(self.score) > self.max_nodes:
                    self.clear()
                if len(known) > TERMINALS * self.max_nodes:
                    known.clear()
                got = self.insert(w)
            total += got[0]
            score += got[1]
        return total, score


@functools.cache
def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """Unigram log-probabilities of the pieces of a SentencePiece model by their rank r in it: p ~ 1 / (r + 2)
    (Zipf's law), so nothing is trained. Byte pieces share the probability of the last rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    usable.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / (r + 2) for r in range(len(usable) + 256)))
    scores = {model.id_to_piece(i): -math.log(r + 2) - norm for r, i in enumerate(usable)}
    return scores, -math.log(len(usable) + 257) - norm


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", max_nodes: int = MAX_NODES) -> DataFrame:
    """key, n_words, n_tokens, log_prob for each row: pre-tokens are the maximal runs without ASCII white space, each with
    the word mark in front, and a document's counts are the sums of those of its pre-tokens.

    Nothing is shuffled: each task grows a trie from the distinct pre-tokens of its own rows, in bounded memory,
    and looks repeated ones up at their terminal. Null and blank texts have no tokens; a null key stays null, repeated
    rows are each counted, other columns are ignored and an empty table gives no rows.
    ``vocabulary`` is the path of a SentencePiece model that every worker can read."""
    narrow = docs.select(docs[key].alias("k"), docs[text].cast("binary").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(*zipf_scores(vocabulary), max_nodes)
        for b in batches:
            words, tokens, scores = [], [], []
            for t in b.column(1):
                own = ["▁" + w.decode("utf-8", "surrogateescape") for w in (t.as_py() or b"").split()]
                n, s = trie.count(own)
                words.append(len(own)), tokens.append(n), scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["k", "n_words", "n_tokens", "log_prob"])

    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, {RESULT}").withColumnRenamed("k", key)


def query(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
