"""Benchmark decontamination by a generalised suffix automaton of the items' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh_name, put_back, set_aside
from skein.session import cut_lineage

WINDOW = 13
#: Words of benchmark items in one automaton; about 0.4 GB a worker. More items: more automata.
SHARD_WORDS = 250_000

# Bytes of UTF-8: digits, a-z and all of non-ASCII are word bytes, A-Z are lower-cased.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, tracking the longest match of a stream.

    State 0 is the root. ``links`` are the suffix links, ``lengths`` the longest length of each
    state. An item of at least ``window`` words is hit wherever ``window`` of its words in a row
    occur; a shorter one where it occurs whole.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.links, self.lengths = [-1], [0]
        self.items = [item for item, words in items if words]
        ends: list[tuple[int, int]] = []
        whole: dict[int, int] = {}
        self.shortest = window
        for number, (_, words) in enumerate(x for x in items if x[1]):
            last = 0
            for word in words:
                last = self.extend(last, self.ids.setdefault(word, len(self.ids) + 1))
                ends.append((last, number))
            if len(words) < window:
                whole[last] = len(words)
                self.shortest = min(self.shortest, len(words))
        # the items that end at a state or below it, for states that stand for whole windows
        self.owners: list[set[int]] = [set() for _ in self.links]
        for state, number in ends:
            self.owners[state].add(number)
        for state in sorted(range(1, len(self.links)), key=self.lengths.__getitem__, reverse=True):
            link = self.links[state]
            if self.lengths[link] >= window:
                self.owners[link] |= self.owners[state]
        # short whole items that are suffixes of a state's strings, the longest first
        self.short: list[tuple[int, ...]] = [()] * len(self.links)
        self.size_of = whole
        for state in sorted(range(1, len(self.links)), key=self.lengths.__getitem__):
            above = self.short[self.links[state]]
            self.short[state] = (state, *above) if state in whole else above
        self.short_items: dict[int, set[int]] = {}
        for number, (_, words) in enumerate(x for x in items if x[1]):
            if len(words) < window:
                self.short_items.setdefault(self.walk(words), set()).add(number)

    def walk(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][self.ids[word]]
        return state

    def extend(self, last: int, c: int) -> int:
        """Adds ``c`` after state ``last``; returns the state of the longer sequence."""
        known = self.next[last].get(c)
        if known is not None and self.lengths[known] == self.lengths[last] + 1:
            return known
        if known is not None:
            return self.split(last, c, known)
        state = self.state({}, self.lengths[last] + 1, 0)
        at = last
        while at != -1 and c not in self.next[at]:
            self.next[at][c] = state
            at = self.links[at]
        if at != -1:
            target = self.next[at][c]
            if self.lengths[target] != self.lengths[at] + 1:
                target = self.split(at, c, target)
            self.links[state] = target
        return state

    def split(self, at: int, c: int, target: int) -> int:
        """A copy of ``target`` for its strings that may end ``at`` and ``c``."""
        copy = self.state(dict(self.next[target]), self.lengths[at] + 1, self.links[target])
        self.links[target] = copy
        while at != -1 and self.next[at].get(c) == target:
            self.next[at][c] = copy
            at = self.links[at]
        return copy

    def state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.lengths.append(length)
        self.links.append(link)
        return len(self.links) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words (start, end) in order, merged; numbers of the items that occur.

        Words outside the items' vocabulary reset the automaton, so only runs of known words of
        at least the shortest window are streamed through it.
        """
        get = self.ids.get
        codes = np.array([get(w, 0) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes != 0, [0])).astype(np.int8)))
        ranges: list[list[int]] = []
        found: set[int] = set()
        for start, end in edges.reshape(-1, 2):
            if end - start >= self.shortest:
                self.scan_run(codes[start:end].tolist(), int(start), ranges, found)
        return [(s, e) for s, e in ranges], found

    def scan_run(self, codes: list[int], at: int, ranges: list[list[int]], found: set[int]) -> None:
        moves, links, lengths, window = self.next, self.links, self.lengths, self.window
        state = length = 0
        seen: set[int] = set()
        for position, c in enumerate(codes, at + 1):
            while state and c not in moves[state]:
                state = links[state]
                length = lengths[state]
            state = moves[state].get(c, 0)
            length = length + 1 if state else 0
            covered = 0
            if length >= window:
                covered = length
                owner = state
                while lengths[links[owner]] >= window:
                    owner = links[owner]
                if owner not in seen:
                    seen.add(owner)
                    found |= self.owners[owner]
            for short in self.short[state]:
                if self.size_of[short] <= length:
                    covered = max(covered, self.size_of[short])
                    found |= self.short_items[short]
            if covered:
                start = position - covered
                while ranges and ranges[-1][0] >= start:
                    ranges.pop()
                if ranges and ranges[-1][1] >= start:
                    ranges[-1][1] = position
                else:
                    ranges.append([start, position])


def item_automata(
    items: DataFrame, item_id: str, item_text: str, window: int, shard_words: int
) -> Iterator:
    """Their number, then automata of at most about ``shard_words`` words; an item is whole in one of them."""
    rows = items.select(
        F.col(item_id).cast("string").alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).alias("text"),
    )
    spaces = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = rows.agg(F.coalesce(F.sum(spaces), F.lit(0)).alias("n")).first().n
    shards = -(-int(total) // shard_words) or 1
    yield shards
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).collect()
        yield Automaton([(r.item, words_of(r.text)) for r in part], window)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage_divisor: int = 20,
    shard_words: int = SHARD_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with their columns (or those in ``keep``), and what of each occurs in
    the items: n_words, n_hit (words inside an occurrence of a window), hit_spans (array of word
    ranges, end exclusive), hit_items (array of item ids as strings, sorted, distinct),
    contaminated (n_hit > 0 and n_hit * coverage_divisor >= n_words). These names replace columns
    of ``docs`` that have them.

    Words are runs of digits, a-z after lower-casing A-Z, and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or a whole shorter item. The automaton of the items
    is broadcast; their size is checked first, and items of more than ``shard_words`` words are
    dealt to several automata that pass over the documents in turn, through the checkpoint folder.

    Null and empty texts have no words and no hits. Items without words never occur; equal items
    all count. Repeated rows are judged each. Documents stream through in batches, whole.
    """
    spark = docs.sparkSession
    plain = [c for c in (keep if keep is not None else docs.columns) if c not in NAMES]
    automata = item_automata(items, item_id, item_text, window, shard_words)
    carried = list(dict.fromkeys([*plain, text_col]))
    hits, found_items, size = added = [fresh_name(docs, x) for x in ("_hits", "_items", "_n")]
    state, shards = docs.select(*[F.col(f"`{c}`") for c in carried]), next(automata)
    for number in range(shards):
        shared = spark.sparkContext.broadcast(next(automata))
        last = number == shards - 1
        out = plain if last else carried
        fields = [f for f in state.schema.fields if f.name in out]
        fields.sort(key=lambda f: out.index(f.name))
        schema = T.StructType(fields + [T.StructField(*f) for f in zip(added, ADDED, strict=True)])

        def run(batches, shared=shared, out=out):
            automaton = shared.value
            for batch in batches:
                rows = [judge(automaton, t) for t in batch[text_col].to_pylist()]
                if hits in batch.schema.names:
                    before = zip(batch[hits].to_pylist(), batch[found_items].to_pylist(), strict=True)
                    rows = [join_hits(r, b) for r, b in zip(rows, before, strict=True)]
                arrays = [batch[c] for c in out]
                for k, kind in enumerate(ARROW_ADDED):
                    arrays.append(pa.array([r[k] for r in rows], kind))
                yield pa.RecordBatch.from_arrays(arrays, [*out, *added])

        state = state.mapInArrow(run, schema)
        if not last:
            state = cut_lineage(state)
    n_hit = F.aggregate(
        hits, F.lit(0).cast("long"), lambda total, r: total + (r["e"] - r["s"]).cast("long")
    )
    return state.select(
        *[F.col(f"`{c}`") for c in plain],
        F.col(size).alias("n_words"),
        n_hit.alias("n_hit"),
        F.col(hits).alias("hit_spans"),
        F.col(found_items).alias("hit_items"),
        ((n_hit > 0) & (n_hit * coverage_divisor >= F.col(size))).alias("contaminated"),
    )


NAMES = ("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
RANGE = T.StructType().add("s", "integer").add("e", "integer")
ADDED = (T.ArrayType(RANGE), T.ArrayType(T.StringType()), T.LongType())
ARROW_ADDED = (
    pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])),
    pa.list_(pa.string()),
    pa.int64(),
)


def judge(automaton: Automaton, text: str | None) -> tuple[list, list, int]:
    words = words_of(text)
    ranges, found = automaton.scan(words) if automaton.items else ([], set())
    return (
        [{"s": s, "e": e} for s, e in ranges],
        sorted({automaton.items[i] for i in found}),
        len(words),
    )


def join_hits(now: tuple[list, list, int], before: tuple[list, list]) -> tuple[list, list, int]:
    """The hits of two automata over one document."""
    ranges: list[dict] = []
    for r in sorted(now[0] + before[0], key=lambda r: (r["s"], r["e"])):
        if ranges and r["s"] <= ranges[-1]["e"]:
            ranges[-1]["e"] = max(ranges[-1]["e"], r["e"])
        else:
            ranges.append(dict(r))
    return ranges, sorted({*now[1], *before[1]}), now[2]


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns and values, whatever
    they are called. Null and empty texts stay; without items all rows stay."""
    renamed, called = set_aside(docs, list(NAMES))
    options["text_col"] = called[options.get("text_col", "text")]
    judged = decontaminate(renamed, items, **options)
    return put_back(judged.where(~F.col("contaminated")), called)
