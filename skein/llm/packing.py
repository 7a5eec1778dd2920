"""Sequence packing: combinations of lengths weighted by non-negative least squares."""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, CLASSES, DEPTH = 4096, 32, 4
#: A plan covers so many remainders or tokens of a task, whichever comes first.
PLAN_DOCS, PLAN_TOKENS = 8192, 4_000_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class WordIds(dict):
    """Token ids of the parts of words, as little-endian 32-bit bytes, by a tokenizer file.

    The vocabulary drops white space and splits words at fixed places, so a text's ids are its
    parts' ids one after another. Texts of Latin-1 characters are split here and each part is
    given to the tokenizer's model once; words with other characters go through the whole
    tokenizer. Two generations of ``size`` parts bound the memory.
    """

    # fixed values: the tokenizer's own splitting pattern, over Latin-1
    PART = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+"
    )
    #: Separators that Python takes for white space and the pattern does not; special tokens.
    SPECIAL = re.compile(r"[\x1c-\x1f]|<\|")

    def __init__(self, path: str, size: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.size = self.tokenizer.model, size
        self.old: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            spelled = "".join([self.byte_chars[b] for b in part.encode()])
            found = pack_ids([t.id for t in self.model.tokenize(spelled)])
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not self.SPECIAL.search(text)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.__getitem__, self.PART.findall(text.lower())))
        words = text.replace("\n", " ").split(" ")
        if len(words) > 1:
            return b"".join(map(self.encode, words))
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def word_ids(path: str) -> WordIds:
    """One table of words for all tasks that a worker process runs."""
    return WordIds(path)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """min |ax - b| over x >= 0, by an active set that grows by the steepest column."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = 0
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * (1 + np.abs(b).max()):
            break
        active[best] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                x = z
                break
            low = active & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            x[low & (x <= 1e-12)] = 0
            active &= x > 0
            if not active.any():
                return x
    return x


def combinations_filling(classes: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` length classes that fill a window, one a column."""
    sets = [
        np.bincount(c, minlength=classes + 1)[1:]
        for k in range(1, depth + 1)
        for c in combinations_with_replacement(range(1, classes + 1), k)
        if sum(c) == classes
    ]
    return np.array(sets, float).T


class Packer:
    """Cuts and places the documents of one task. Memory is bounded by one plan's tokens."""

    def __init__(self, window: int, first_id: int, classes: int = CLASSES, depth: int = DEPTH):
        self.window, self.next_id, self.classes = window, first_id, classes
        self.step = window // classes
        self.combos = combinations_filling(classes, depth)
        self.waiting: list[tuple] = []  # (doc, start, ids, doc_tokens) of under a window
        self.loose: deque = deque()  # residuals, to be cut freely
        self.tokens = self.loose_tokens = 0
        self.out: list[tuple] = []

    def place(self, piece: tuple, sequence: int, offset: int, length: int) -> tuple:
        """Puts the first ``length`` ids of a piece; returns what is left of it."""
        doc, start, ids, doc_tokens = piece
        self.out.append(
            (doc, start, length, zlib.crc32(ids[:length]), doc_tokens, sequence, offset)
        )
        return doc, start + length, ids[length:], doc_tokens

    def new_sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc, ids: np.ndarray) -> None:
        piece, left = (doc, 0, ids, len(ids)), len(ids)
        while left >= self.window:
            piece = self.place(piece, self.new_sequence(), 0, self.window)
            left -= self.window
        if left:
            self.waiting.append(piece)
            self.tokens += left
        if len(self.waiting) >= PLAN_DOCS or self.tokens >= PLAN_TOKENS:
            self.plan()

    def fill(self, sequence: int, offset: int, upto: int) -> None:
        """Tops a sequence up with residuals, cutting the last."""
        while offset < upto and self.loose:
            piece = self.loose.popleft()
            length = min(len(piece[2]), upto - offset)
            rest = self.place(piece, sequence, offset, length)
            if len(rest[2]):
                self.loose.appendleft(rest)
            offset += length
            self.loose_tokens -= length

    def loosen(self, pieces: list) -> None:
        self.loose.extend(pieces)
        self.loose_tokens += sum(len(p[2]) for p in pieces)

    def plan(self) -> None:
        """Repeat counts of the combinations from the histogram, then greedy residuals."""
        by_class: list[list] = [[] for _ in range(self.classes)]
        for piece in self.waiting:
            by_class[(len(piece[2]) - 1) // self.step].append(piece)
        self.waiting, self.tokens = [], 0
        counts = np.array([len(x) for x in by_class], float)
        repeats = np.floor(nnls(self.combos, counts) + 1e-9).astype(int)
        filled: list[list] = []
        for c in np.flatnonzero(repeats):
            need = [(m, int(self.combos[m, c])) for m in np.flatnonzero(self.combos[:, c])]
            for _ in range(repeats[c]):
                if any(len(by_class[m]) < n for m, n in need):
                    break  # the fit's error may ask for more than there is
                filled.append([by_class[m].pop() for m, n in need for _ in range(n)])
        self.loosen([p for x in reversed(by_class) for p in x])
        gaps = [self.window - sum(len(p[2]) for p in x) for x in filled]
        short = sum(gaps) - self.loose_tokens
        while short > 0:  # too few residuals to close the gaps: give up combinations
            short -= self.window
            gaps.pop()
            self.loosen(filled.pop())
        for pieces, gap in zip(filled, gaps, strict=True):
            sequence, offset = self.new_sequence(), 0
            for piece in pieces:
                self.place(piece, sequence, offset, len(piece[2]))
                offset += len(piece[2])
            self.fill(sequence, offset, offset + gap)
        while self.loose_tokens >= self.window:
            self.fill(self.new_sequence(), 0, self.window)

    def finish(self) -> None:
        """The last ids go into sequences of powers of two, which need no padding."""
        self.plan()
        while self.loose_tokens:
            self.fill(self.new_sequence(), 0, 1 << (self.loose_tokens.bit_length() - 1))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 2,
) -> DataFrame:
    """One row per piece of a document: where its ids start and where they are placed.

    A document is its ids by the tokenizer, then ``end_id``. Whole windows of a long document are
    sequences of their own. Of the remainders, combinations of at most DEPTH length classes that
    fill a window are enumerated; their repeat counts are the non-negative least squares fit to
    the histogram of classes, rounded down; remainders that no repeat uses are packed greedily
    into the gaps and into sequences of their own, cut where a window ends. What a task has left at
    its end (under a window) becomes sequences of powers of two. So every sequence holds
    ``window`` ids or a power of two, and none is padded. ``window`` must be a multiple of CLASSES.

    Each task plans for itself, PLAN_DOCS remainders at a time: no shuffle, bounded memory, and a
    lost task repeats the same sequences. sequence_id is the task's number, then a count.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed each. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(",")]
        schema = pa.schema([(n, pa.int64()) for n in names])

        def emit() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(doc, np.frombuffer(words.encode(text or "") + end, "<u4"))
            yield emit()
        packer.finish()
        yield emit()

    return rows.mapInArrow(run, PIECES)
