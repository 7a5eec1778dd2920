"""Byte-level BPE by replaying all merges over a block's distinct words, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block of texts is replayed when it has so many characters; a longer text is a block alone.
BLOCK_CHARS = 4_000_000
#: Encoded words that a worker keeps from block to block, in two generations.
KEPT_WORDS = 300_000
#: Characters of a very long text that are split into words at a time.
SLICE = 1_000_000
#: In the flat array: the end of a word, and a part that was merged into the one before.
END, GONE = -1, -2
#: A pair of ids is the first times SHIFT plus the second.
SHIFT = 1 << 32
#: No word depends on more characters behind its end than this.
AHEAD = 4


class PairRanks(dict):
    """The rank of two neighbouring tokens, or -1; a pair is looked up by its bytes once."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        left, right = divmod(pair, SHIFT)
        rank = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        self[pair] = rank
        return rank


class MergeReplay:
    """Encodes a set of words by a table of ranks; a token's rank is its id.

    All parts of all words lie in one flat array with links to their neighbours. An inverted index
    lists, for each rank, the places at which two neighbours together are the token of that rank.
    The ranks are taken in order, the lowest with places left first, and a merge at a place looks
    at its two new pairs alone. A pair that a merge makes may have a lower rank than the merge
    itself; then the rest of that word waits until the lower rank is done, so that each word is
    merged in the order in which it would be alone: lowest rank first, of equals the leftmost.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pairs = PairRanks(ranks, self.tokens)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def laid_out(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all bytes, an END before the first word and after each, and the words' starts."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate(([1], np.cumsum(lengths + 1)[:-1] + 1)) if len(words) else np.zeros(0, np.int64)
        flat = self.bytes[np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)]
        flat[0] = END
        flat[starts + lengths] = END
        return flat, starts

    def first_index(self, flat: np.ndarray) -> dict[int, list[int]]:
        """For each rank the places, in order, of the pairs of bytes that have it."""
        places = np.flatnonzero((flat[:-1] != END) & (flat[1:] != END))
        codes, which = np.unique(flat[places] * SHIFT + flat[places + 1], return_inverse=True)
        ranks = np.array([self.pairs[c] for c in codes.tolist()], np.int64)[which]
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        found, first = np.unique(ranks, return_index=True)
        return {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, first[1:]), strict=True)} if len(found) else {}

    def encode(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each word. A word that is a token itself is that token."""
        done: dict[bytes, list[int]] = {}
        open_words = []
        for word in words:
            whole = self.ranks.get(word)
            if whole is not None:
                done[word] = [whole]
            elif word:
                open_words.append(word)
            else:
                done[word] = []
        flat, starts = self.laid_out(open_words)
        index = self.first_index(flat)
        part = flat.tolist()
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        self.merge(part, after, before, index)
        for word, at in zip(open_words, starts.tolist(), strict=True):
            ids = done[word] = []
            while (found := part[at]) != END:
                ids.append(found)
                at = after[at]
        return done

    def merge(self, part: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> None:
        pairs = self.pairs
        waiting = list(index)
        heapify(waiting)
        while waiting:
            rank = heappop(waiting)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            stop = -1  # the end of a word that waits for a lower rank
            for at in places:
                if at < stop:
                    if rank not in index:
                        heappush(waiting, rank)
                        index[rank] = []
                    index[rank].append(at)
                    continue
                left, behind = part[at], after[at]
                right = part[behind]
                if left < 0 or right < 0 or pairs[left * SHIFT + right] != rank:
                    continue  # the pair has gone meanwhile
                part[at], part[behind] = rank, GONE
                following = after[behind]
                after[at], before[following] = following, at
                lower = False
                right = part[following]
                if right >= 0:
                    new = pairs[rank * SHIFT + right]
                    if new >= 0:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(waiting, new)
                        lower = new < rank
                previous = before[at]
                left = part[previous]
                if left >= 0:
                    new = pairs[left * SHIFT + rank]
                    if new >= 0:
                        if new in index:
                            index[new].append(previous)
                        else:
                            index[new] = [previous]
                            heappush(waiting, new)
                        lower = lower or new < rank
                if lower:
                    stop = following
                    while part[stop] != END:
                        stop = after[stop]


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines: a token in base 64, then its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class Codec:
    """Texts to ids and back, with the words of earlier blocks kept in two generations."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay = MergeReplay(read_ranks(path))
        self.tokens = self.replay.tokens
        self.pattern = regex.compile(pattern)
        # the same pattern where all characters are ASCII: its letters, numbers and white space
        inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern)
        plain = inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii_pattern = re.compile(plain, re.ASCII)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, which leave nothing out, in lists of bounded size."""
        find = (self.ascii_pattern if text.isascii() else self.pattern).findall
        if len(text) <= SLICE:
            yield find(text)
            return
        at, size = 0, SLICE
        while at < len(text):
            piece = text[at : at + size]
            found = find(piece)
            if at + size < len(text):
                # what is near the cut may go on behind it and is found again
                near = 0
                while found and near < AHEAD:
                    near += len(found.pop())
                if not found:
                    size *= 2
                    continue
                at += len(piece) - near
            else:
                at = len(text)
            size = SLICE
            yield found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return [b"".join(b"".join(self.look_up([w])[0]) for w in self.words(texts[0]))]
        found = [next(self.words(t)) for t in texts]
        return [b"".join(ids) for ids in self.look_up(found)]

    def look_up(self, lists: list[list[str]]) -> list[Iterable[bytes]]:
        """The ids of each word of a block; the words not known yet are replayed together."""
        new, old = self.new, self.old
        if len(new) > KEPT_WORDS:
            old = self.old = new
            new = self.new = {}
        wanted = set()
        for words in lists:
            wanted.update(words)
        wanted.difference_update(new)
        for word in [w for w in wanted if w in old]:
            new[word] = old[word]
            wanted.discard(word)
        spelled = {w.encode(): w for w in wanted}
        for word, ids in self.replay.encode(spelled).items():
            new[spelled[word]] = np.array(ids, "<u4").tobytes()
        return [map(new.__getitem__, words) for words in lists]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks that a worker process runs."""
    return Codec(path, pattern)


def blocks(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """Texts in lists of about ``size`` characters; a text longer than SLICE is a list alone."""
    held: list[str] = []
    chars = 0
    for text in texts:
        if held and (chars + len(text) > size or len(text) > SLICE):
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
        if len(text) > SLICE:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens): each text's token ids, little-endian unsigned 32-bit, one after another.

    A text is split into words by ``pattern``; a word that is a token is that token, others are
    merged by rank. The corpus is taken in blocks of texts where they lie, and the merges are
    replayed over the distinct words of a block that no block before it had (``MergeReplay``): every
    merge in rank order, found through an index from pair to places. Words depend on nothing but
    the ranks, so blocks give what the whole corpus would, and nothing is shuffled or broadcast.
    Memory holds a block, its distinct words and two generations of known words.

    Null and empty texts have no tokens. Repeated rows come out alike; an id may be null. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = rows.select("id").schema.add("ids", "binary").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column("text").to_pylist(), BLOCK_CHARS):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=["id", "ids", "n_tokens"],
                )
                at += len(texts)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_bytes(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the tokens of ``ids``; null ids give null. An id that the ranks
    do not have is an error."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(found, pa.binary()))

    return encoded.mapInArrow(run, schema)
