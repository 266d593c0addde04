"""Packing documents into fixed windows by online sum-of-squares bin packing.

A window's level is the number of its filled places. The packer keeps, in an array, how many open
windows stand at each level, and puts the next document into the level (or a new window) that gives
the smallest sum of the squares of these numbers; a window that fills up leaves the array. Documents
longer than a window first give up whole windows; what is left is placed.

Every input partition is packed by itself, in one pass and without a shuffle; sequence ids carry the
partition's number. When a partition ends, or when more than ``max_open`` windows are open, the open
windows are cut anew: their pieces fill whole windows, and the rest becomes windows whose lengths are
powers of two. So padding is none, and memory holds ``max_open`` windows at most.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed as
separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import lean, sliced, small_batches

PARTITION_SHIFT = 33


def byte_alphabet() -> str:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b if b in printable else 256 + others.index(b)) for b in range(256))


class WordIds(dict):
    """Word to the bytes of its ids; a word not seen before is tokenized when it is looked up.

    With ``lowered`` words (lower case, nothing beyond Latin), words of letters go straight to the
    vocabulary's merges, after the byte alphabet that the tokenizer's pattern step would give them.
    Letters with punctuation behind them are two pieces to that pattern, whatever the punctuation.
    Everything else takes the tokenizer's own way. Words of over ``longest`` characters aren't kept.
    """

    def __init__(self, tokenizer, kind: str, lowered: bool, longest: int = 64):
        self.tokenizer, self.kind, self.lowered, self.longest = tokenizer, kind, lowered, longest
        self.merge, self.alphabet = tokenizer.model.tokenize, byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        bare = word.rstrip(string.punctuation)
        if not self.lowered or not bare.isalpha():
            ids = array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif len(bare) < len(word):
            ids = self[bare] + self[word[len(bare) :]]
        else:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = array(self.kind, [t.id for t in self.merge(mapped)]).tobytes()
        if len(word) <= self.longest:
            self[word] = ids
        return ids


class WordCachedTokenizer:
    """Ids of a `tokenizers` file, with the ids of each word kept.

    The word-end vocabulary drops white space, and neither its pattern nor its normaliser joins
    characters across it, so a text's ids are its words' ids in order. Texts that hold a special
    token's string, or a separator that Python and the tokenizer see differently, go to the
    tokenizer whole. At most ``max_words`` words of at most 64 characters are kept.
    """

    _ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    _BEYOND_LATIN = re.compile("[^\x00-ɏ]|İ|ŉ|ǰ")

    def __init__(self, path: str, end_id: int, max_words: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # the dictionaries are the cache
        wide = self.tokenizer.get_vocab_size() >= 65536
        self.dtype, self.max_words = np.dtype("<u4" if wide else "<u2"), max_words
        self.lowered, self.verbatim = (WordIds(self.tokenizer, "I" if wide else "H", x) for x in (True, False))
        self.end = np.array([end_id], self.dtype).tobytes()

    def _ids(self, text: str) -> bytes:
        """Python lowers a text where its rule is the tokenizer's: nothing is beyond Latin."""
        if any(mark in text for mark in self._ODD):
            return array(self.lowered.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")  # a copy of bytes, where there is nothing beyond
        except UnicodeEncodeError:
            if self._BEYOND_LATIN.search(text):
                return b"".join(map(self.verbatim.__getitem__, text.split()))
        return b"".join(map(self.lowered.__getitem__, text.lower().split()))

    def __call__(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Each text's ids and the end id, as unsigned 32-bit numbers."""
        for text in texts:
            ids = self._ids(text or "")
            if len(self.lowered) + len(self.verbatim) > self.max_words:
                self.clear()
            yield np.frombuffer(ids + self.end, self.dtype).astype("<u4")

    def clear(self) -> None:
        self.lowered.clear()
        self.verbatim.clear()


class SumOfSquaresPacker:
    """Pieces are (doc number, start, ids); a closed window comes out as a list of pieces."""

    def __init__(self, capacity: int = 4096, max_open: int = 2048):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, np.int64)  # open windows at each level; 0 and capacity stay at 0
        self.open: list[list[list]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def best_level(self, size: int) -> int:
        """The level that size goes to: 0 is a new window. Of equal levels the fullest wins."""
        levels = np.flatnonzero(self.count[: self.capacity - size + 1])
        # A level that loses a window changes the sum by 1 - 2 n, one that gains one by 1 + 2 n.
        gain = lambda to: np.where(to == self.capacity, 0, 1 + 2 * self.count[to])
        fresh = int(gain(np.array([size]))[0])
        if not len(levels):
            return 0
        change = 1 - 2 * self.count[levels] + gain(levels + size)
        at = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[at]) if change[at] <= fresh else 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(doc, at, ids[at : at + self.capacity])]
        size = len(ids) - whole
        if not size:
            return
        level = self.best_level(size)
        window = self.open[level].pop() if level else []
        window.append((doc, whole, ids[whole:].copy() if whole else ids))  # a view would hold a long document while its end waits
        if level:
            self.count[level] -= 1
            self.n_open -= 1
        if level + size == self.capacity:
            yield window
        else:
            self.open[level + size].append(window)
            self.count[level + size] += 1
            self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.cut_anew()

    def cut_anew(self, last: bool = False) -> Iterator[list]:
        """Pieces of the open windows, fullest first, fill whole windows; at the end also powers of two."""
        pieces = [p for windows in reversed(self.open) for w in windows for p in w]
        self.count[:] = 0
        self.open = [[] for _ in range(self.capacity)]
        self.n_open = 0
        left = sum(len(p[2]) for p in pieces)
        at, used = 0, 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if last else left
            window, free = [], room
            while free:
                doc, start, ids = pieces[at]
                take = min(free, len(ids) - used)
                window.append((doc, start + used, ids[used : used + take]))
                free, used = free - take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            left -= room
            if room == self.capacity or last:
                yield window
            else:
                self.open[room].append(window)
                self.count[room] += 1
                self.n_open += 1


_TOKENIZERS: dict[tuple, WordCachedTokenizer] = {}

PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    max_open: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids themselves."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for name in PIECE:
        schema = schema.add(name, T.LongType())
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    arrow_id = pa.int64() if isinstance(schema[0].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (tokenizer_path, end_id)
        tokenizer = _TOKENIZERS.get(key) or _TOKENIZERS.setdefault(key, WordCachedTokenizer(tokenizer_path, end_id))
        packer, names, totals = SumOfSquaresPacker(capacity, max_open), {}, {}
        sequence = TaskContext.get().partitionId() << PARTITION_SHIFT
        rows: list[tuple] = []

        def close(windows: Iterator[list]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, ids in window:
                    row = (names[doc], start, len(ids), zlib.crc32(ids.tobytes()), totals[doc][0], sequence, offset)
                    rows.append((*row, ids.astype(np.int64)) if with_ids else row)
                    offset += len(ids)
                    totals[doc][1] -= len(ids)
                    if not totals[doc][1]:
                        del totals[doc], names[doc]
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            arrays = [pa.array(columns[0], arrow_id), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[7:])]
            return pa.RecordBatch.from_arrays(arrays, [id_col, *PIECE, *["ids"] * with_ids])

        n = 0
        for batch in sliced(batches):
            for name, ids in zip(batch.column(0).to_pylist(), tokenizer(batch.column(1).to_pylist()), strict=True):
                names[n], totals[n] = name, [len(ids), len(ids)]
                close(packer.add(n, ids))
                n += 1
                if len(rows) > 20_000:
                    yield out()
                    rows.clear()
        tokenizer.clear()
        close(packer.cut_anew(last=True))
        if rows:
            yield out()

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(run), schema)
