"""Token counts of a unigram language model by dynamic programming over a trie.

A text's pre-tokens are its words with the word mark before each. A pre-token's tokens are its best
segmentation into pieces, by the sum of the pieces' log-probabilities. The best (forward) score of a
prefix depends on the prefix alone, so the distinct pre-tokens of a batch are inserted in a trie and each
node is computed once from its ancestors, however many words share it; where a pre-token ends, its token
count is kept. The trie is laid out by depth: all nodes of one depth are computed together, one array
operation for each piece length, with pieces looked up by a rolling 64-bit hash. A text's count is the sum
of its words' kept counts, so no row per word is ever shuffled.

The pieces are a public tokenizer file's; their log-probabilities are fitted to the documents by hard
expectation-maximisation: pieces start with 1 / (rank + 10), all documents are segmented, and the pieces
used are counted (one partial sum a piece and task, so the driver gets the vocabulary at most). A character
in no piece costs one token, and the fitted share of such, for each of its bytes. Ties prefer fewer
tokens. A task keeps the counts of ``max_words`` words of at most 64 characters and drops them at its
end; longer words are segmented one by one, in memory that grows with the word.

Defined results: a null or empty text, and one of white space only, has no words and no tokens; repeated
rows get equal counts; an empty table fits the starting scores; extra columns are carried, but columns
named n_words and n_tokens are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import sliced

MARK = "▁"
BYTE = -1  # stands for a byte of a character in no piece
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
LONGEST_KEPT = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class UnigramModel:
    """Pieces, their log-probabilities, and that of a byte of a character in no piece."""

    pieces: list[str]
    scores: np.ndarray
    byte_score: float

    def as_dict(self) -> dict[str, float]:
        return dict(zip(self.pieces, self.scores.tolist(), strict=True))


def ranked_model(model_path: str) -> UnigramModel:
    """The pieces of a sentencepiece file with 1 / (rank + 10) over its sum, where fitting starts."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    ids.sort(key=lambda i: (-p.get_score(i), i))
    weights = 1 / (np.arange(len(ids)) + 10)
    return UnigramModel([p.id_to_piece(i) for i in ids], np.log(weights / weights.sum()), -30.0)


class Segmenter:
    """Best segmentations of words: token counts, and how often each piece is used."""

    def __init__(self, model: UnigramModel):
        self.model, self.score_of = model, model.as_dict()
        self.number_of = {p: i for i, p in enumerate(model.pieces)}
        self.longest = max(map(len, model.pieces), default=1)
        self.computed = 0
        hashes = np.array([self._hash(p) for p in model.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._spot(hashes)] = True
        self.powers = np.array([pow(int(BASE), n, 1 << 64) for n in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _spot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in mixed(np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)).tolist():
            h = (h * int(BASE) + c) % (1 << 64)
        return h

    def segment(self, word: str, count: int = 0, used: np.ndarray | None = None) -> int:
        """Tokens of one word by itself; adds ``count`` to the pieces it uses."""
        word = MARK + word
        best, tokens, back = [0.0], [0], [(0, BYTE, 0)]
        for end, ch in enumerate(word, 1):
            size = len(ch.encode("utf-8", "surrogatepass"))
            top, n, via = best[-1] + self.model.byte_score * size, tokens[-1] + size, (end - 1, BYTE, size)
            for start in range(max(0, end - self.longest), end):
                s = self.score_of.get(word[start:end])
                if s is not None:
                    s, m = s + best[start], tokens[start] + 1
                    if s > top or (s == top and m < n):
                        top, n, via = s, m, (start, self.number_of[word[start:end]], 1)
            best.append(top)
            tokens.append(n)
            back.append(via)
        at = len(word)
        while used is not None and at:
            at, piece, size = back[at]
            used[piece] += count * size
        return tokens[-1]

    def segment_all(self, words: Sequence[str], counts: np.ndarray | None = None, used: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each of the distinct words, over their common trie; adds ``counts`` to the pieces used."""
        out = np.zeros(len(words), np.int64)
        if not len(words):
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        active = np.argsort(-lengths, kind="stable")  # the words that reach a depth are a prefix of this order
        reach = np.searchsorted(-lengths[active], -np.arange(1, lengths.max() + 1), side="right")
        # By depth: hash, best score and tokens of every node, its parent, and the piece that ends there and its length.
        levels = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), None, None)]
        node = np.zeros(len(words), np.int64)
        for depth, n in enumerate(reach.tolist(), 1):
            active = active[:n]
            ch = chars[starts[active] + depth - 1]
            edges, node = np.unique((node[:n].astype(np.uint64) << np.uint64(21)) | ch, return_inverse=True)
            parent, ch = (edges >> np.uint64(21)).astype(np.int64), edges & np.uint64((1 << 21) - 1)
            levels.append(self._level(levels, parent, ch))
            self.computed += len(parent)
            ends = np.flatnonzero(lengths[active] == depth)
            out[active[ends]] = levels[-1][2][node[ends]]
            if used is not None and len(ends):
                self._walk_back(levels, node[ends], counts[active[ends]], used)
            if used is None and depth > self.longest:
                levels[depth - self.longest] = None
        return out

    def _level(self, levels: list, parent: np.ndarray, ch: np.ndarray) -> tuple:
        h = levels[-1][0][parent] * BASE + mixed(ch + np.uint64(1))
        size = 1 + (ch > 0x7F).astype(np.int64) + (ch > 0x7FF) + (ch > 0xFFFF)
        best, tokens = levels[-1][1][parent] + self.model.byte_score * size, levels[-1][2][parent] + size
        piece, length = -size, np.ones(len(ch), np.int64)  # minus the bytes: no piece
        start = parent
        for n in range(1, min(self.longest, len(levels)) + 1):
            above = levels[-n]
            if n > 1:
                start = levels[-n + 1][3][start]
            own = h - above[0][start] * self.powers[n]
            hit = np.flatnonzero(self.filter[self._spot(own)])
            if not len(hit):
                continue
            at = np.minimum(np.searchsorted(self.hashes, own[hit]), len(self.hashes) - 1)
            same = self.hashes[at] == own[hit]
            hit, number = hit[same], self.numbers[at[same]]
            s, m = above[1][start[hit]] + self.model.scores[number], above[2][start[hit]] + 1
            better = (s > best[hit]) | ((s == best[hit]) & (m < tokens[hit]))
            hit = hit[better]
            best[hit], tokens[hit], piece[hit], length[hit] = s[better], m[better], number[better], n
        return h, best, tokens, parent, piece, length

    @staticmethod
    def _walk_back(levels: list, node: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        """Adds counts to the pieces on the best paths to nodes of the last level, by ascending through the levels."""
        waiting = {len(levels) - 1: [(node, counts)]}
        for depth in range(len(levels) - 1, 0, -1):
            if depth not in waiting:
                continue
            node, counts = (np.concatenate(x) for x in zip(*waiting.pop(depth), strict=True))
            _, _, _, parent, piece, length = levels[depth]
            whole = piece[node] >= 0
            np.add.at(used, piece[node[whole]], counts[whole])
            used[BYTE] += (counts[~whole] * -piece[node[~whole]]).sum()
            up, left = node, length[node]
            for above in range(depth, 0, -1):
                if not len(up):
                    break
                up = levels[above][3][up]
                left = left - 1
                done = left == 0
                if done.any():
                    waiting.setdefault(above - 1, []).append((up[done], counts[done]))
                    up, left, counts = up[~done], left[~done], counts[~done]


class WordCounts:
    """Token counts of words, kept while they are few."""

    def __init__(self, model: UnigramModel, max_words: int = 400_000):
        self.segmenter, self.max_words, self.known = Segmenter(model), max_words, {}

    def count(self, texts: Sequence[Sequence[str]]) -> list[int]:
        """Tokens of each text's words together."""
        new = set().union(*texts).difference(self.known)
        long = {w: self.segmenter.segment(w) for w in new if len(w) > LONGEST_KEPT}
        short = [w for w in new if w not in long] if long else list(new)
        self.known.update(zip(short, self.segmenter.segment_all(short).tolist(), strict=True))
        self.known.update(long)
        counts = [sum(map(self.known.__getitem__, words)) for words in texts]
        for w in long:
            del self.known[w]
        if len(self.known) > self.max_words:
            self.known.clear()
        return counts


def _words(batches: Iterator, column: int, rows: int = 2048) -> Iterator[tuple]:
    for batch in sliced(batches, rows):
        yield batch, [(t or "").split() for t in batch.column(column).to_pylist()]


def fit(docs: DataFrame, start: UnigramModel, text_col: str = "text", rounds: int = 1, flush_words: int = 200_000) -> UnigramModel:
    """Log-probabilities of the pieces that the best segmentations of all documents use, one more than counted."""
    model = start
    for _ in range(rounds):

        def run(batches: Iterator, model: UnigramModel = model) -> Iterator:
            import pyarrow as pa

            segmenter, words = Segmenter(model), Counter()
            used = np.zeros(len(model.pieces) + 1, np.int64)  # the last place is for bytes

            def flush() -> None:
                short = []
                for w in words:
                    if len(w) > LONGEST_KEPT:
                        segmenter.segment(w, words[w], used)
                    else:
                        short.append(w)
                segmenter.segment_all(short, np.array([words[w] for w in short], np.int64), used)
                words.clear()

            for _, texts in _words(batches, 0, 256):
                for text in texts:
                    words.update(text)
                if len(words) > flush_words:
                    flush()
            flush()
            pieces = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(used[pieces], pa.int64())], ["piece", "n"])

        found = docs.select(text_col).mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        used = np.zeros(len(start.pieces) + 1)
        used[found["piece"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        if not used.sum():
            return model
        used += 1
        scores = np.log(used / used.sum())
        model = UnigramModel(start.pieces, scores[:-1], float(scores[-1]) - math.log(256))
    return model


def count_tokens(docs: DataFrame, model: UnigramModel, text_col: str = "text", max_words: int = 400_000) -> DataFrame:
    """docs with n_words and n_tokens."""
    added = ("n_words", "n_tokens")
    kept = [c for c in docs.columns if c not in (*added, text_col)]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_words", T.LongType()).add("n_tokens", T.LongType())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = WordCounts(model, max_words)
        for batch, texts in _words(batches, len(kept)):
            new = [pa.array([len(w) for w in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], [*kept, *added])

    return docs.select(*kept, text_col).mapInArrow(run, schema)
