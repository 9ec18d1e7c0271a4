"""Token counts by a linear longest-match automaton.

Greedy word-piece lengths of a text without building the pieces: a trie of the vocabulary,
failure links, and for each trie node the number of tokens popped when its link is followed.
Every character is then read once (linear longest match).

A word is the start mark plus the characters between ASCII white space. A character that no
piece starts with counts as one token for each of its UTF-8 bytes (byte fallback) and the
match goes on after it. The vocabulary (a list of pieces) is read on the driver from a path
and broadcast; its length is checked against max_pieces (a million pieces take some 400 MB in a
Python worker; a caller with more memory may raise it).

The automaton is built once in each Python worker. Distinct words are matched once there and
remembered up to CACHE_WORDS words (then the memory is emptied); words over CACHE_CHARS characters
are matched each time.

Defined results: null, empty and blank texts have no words and no tokens. Repeated rows get
equal counts. Whole texts are counted, whatever their length. An empty table gives an empty table. A
column named __tokens is replaced, others come through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_PIECES, CACHE_WORDS, CACHE_CHARS = 1_000_000, 300_000, 64


class Automaton:
    """children[node]: char to node; link[node]: where to go on when no child fits;
    pops[node]: tokens counted on that way."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        weight: list[int | None] = [None]  # tokens that a node's string counts as, if it is a piece
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    weight.append(None)
                node = self.children[node][c]
            if node:
                weight[node] = 1
        for c, node in self.children[0].items():  # a first character always matches something
            weight[node] = weight[node] or len(c.encode("utf-8", "surrogatepass"))
        self.link, self.pops = [0] * len(weight), [0] * len(weight)
        queue = deque([(0, c, v) for c, v in self.children[0].items()])
        while queue:
            parent, c, node = queue.popleft()
            if weight[node] is not None:
                self.link[node], self.pops[node] = 0, weight[node]
            else:
                at, pops = self.link[parent], self.pops[parent]
                while at and c not in self.children[at]:
                    pops += self.pops[at]
                    at = self.link[at]
                # at the root a character without child is a token of the fallback
                child = self.children[at].get(c)
                if child is None:
                    pops += len(c.encode("utf-8", "surrogatepass"))
                self.link[node], self.pops[node] = child or 0, pops
            queue.extend((node, d, v) for d, v in self.children[node].items())

    def count(self, text: str) -> int:
        children, link, pops = self.children, self.link, self.pops
        node = total = 0
        for c in text:
            while c not in children[node]:
                if not node:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    break
                total += pops[node]
                node = link[node]
            else:
                node = children[node][c]
        while node:
            total += pops[node]
            node = link[node]
        return total


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in usual]


def worker_automaton(shared) -> tuple[Automaton, dict[bytes, int]]:
    """(automaton, counts of words met) of a broadcast {"pieces": list}. They are kept in the broadcast's
    value, which a Python worker holds as long as it lives: one is built a worker, not a task."""
    held = shared.value
    if "automaton" not in held:
        held["automaton"], held["known"] = Automaton(held["pieces"]), {}
    return held["automaton"], held["known"]


def count_tokens(docs: DataFrame, pieces: list[str], text: Column, max_pieces: int = MAX_PIECES) -> DataFrame:
    """docs with a struct __tokens (n_words, n_tokens)."""
    if len(pieces) > max_pieces:
        raise ValueError(f"a vocabulary of over {max_pieces} pieces")
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces})

    def count(column: pa.Array) -> pa.Array:
        automaton, known = worker_automaton(shared)
        n_words, n_tokens = [], []
        for text in column:
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            total = 0
            for w in words:
                n = known.get(w)
                if n is None:
                    n = automaton.count(MARK + w.decode("utf-8", "surrogatepass"))
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    if len(w) <= CACHE_CHARS:
                        known[w] = n
                total += n
            n_words.append(len(words))
            n_tokens.append(total)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["n_words", "n_tokens"])

    return docs.withColumn("__tokens", F.arrow_udf(count, "n_words long, n_tokens long")(text))
