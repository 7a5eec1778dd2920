"""Repeated byte strings across a corpus, removed by suffix arrays over anchored shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.suffix_array import ENDS, LONGEST, repeated_starts, symbol_ends
from skein.session import cut_lineage

WINDOW, GRAM = 400, 32
#: Bytes of one shard's contexts; a suffix array of about 50,000 symbols.
SHARD_BYTES = 2_000_000
#: Anchors that a task holds at once.
UNITS = 100_000
#: Contexts around one anchor beyond which its windows are compared by count, not in one shard.
HOT_ANCHOR = 4096


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, first start, last start, position) of every anchor of a text.

    Each window has one anchor: the byte gram within it of least hash, the rightmost of equals. So
    equal windows have the same anchor at the same place, and the windows of one anchor are
    consecutive. ``gram`` is a power of two.
    """
    n, grams = len(data), window - gram + 1
    if n < window:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    h, m = data.astype(np.uint64) + np.uint64(1), 1
    while m < gram:
        h = h[:-m] * np.uint64(0x9FB21C651E98DF25) ^ h[m:] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        m *= 2
    count, starts = len(h), n - window + 1
    low = np.uint64((1 << 30) - 1)  # a text may have as many bytes
    value = (h * np.uint64(0x9E3779B97F4A7C15)) & ~low
    value |= np.uint64(count - 1) - np.arange(count, dtype=np.uint64)
    padded = np.concatenate((value, np.full(-count % grams, 2**64 - 1, np.uint64))).reshape(-1, grams)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:starts], ahead[grams - 1 : grams - 1 + starts])
    place = count - 1 - (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [starts - 1]))
    return h[place[first]], first, last, place[first]


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode()


def row_key(id_col: str, text_col: str) -> Column:
    """A document's key: its id and its text. Repeated rows share it, and have equal results."""
    return F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))


def find_units(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, anchor, unit, first, last): a unit is an anchor with all windows that have it; its
    identity ``unit`` is the hash of its bytes and the anchor's place in them."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            size = 0
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text_bytes(text)
                if len(data) < window:
                    continue
                view = memoryview(data)
                found = anchors(np.frombuffer(data, np.uint8), window, gram)
                # a text of equal bytes has an anchor a byte
                for at in range(0, len(found[0]), UNITS):
                    h, first, last, place = (v[at : at + UNITS] for v in found)
                    units = [
                        xxhash.xxh3_64_intdigest(view[a : b + window], seed=p - a)
                        for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)
                    ]
                    columns = (np.full(len(h), key, np.int64), as_long(h), as_long(np.array(units, np.uint64)), first, last)
                    for column, part in zip(out, columns, strict=True):
                        column.append(part)
                    size += len(h)
                    if size >= UNITS:
                        yield packed_units(out)
                        out, size = [[] for _ in range(5)], 0
            yield packed_units(out)

    return keyed.mapInArrow(run, "key long, anchor long, unit long, first int, last int")


def packed_units(out: list[list]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2
    arrays = [pa.array(c.astype(np.int64), pa.int64()).cast(k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "anchor", "unit", "first", "last"])


def joined_ranges(ranges: DataFrame, stretch: int = 4096) -> DataFrame:
    """(key, spans) of (key, first, last): a text's ranges, sorted. Those that touch are joined,
    stretch by stretch of their starts, before the rest of a text meets in one row: it has at most
    as many ranges as it has gaps between them, and one a stretch."""
    kind = "array<struct<first:int,last:int>>"

    def join(done: Column, r: Column) -> Column:
        end = F.element_at(done, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], r["last"]).alias("last"))
        touches = (F.size(done) > 0) & (r["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    sorted_ranges = F.array_sort(F.collect_set(F.struct("first", "last")))
    parts = ranges.groupBy("key", F.floor(F.col("first") / stretch).alias("stretch")).agg(sorted_ranges.alias("r"))
    joined = parts.select("key", F.aggregate("r", F.array().cast(kind), join).alias("r"))
    return joined.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("spans"))


def repeated_ranges(
    keyed: DataFrame, window: int, gram: int, shard_bytes: int, hot_anchor: int
) -> DataFrame:
    """(key, first, last): ranges of starts of windows that start anywhere else too."""
    units = cut_lineage(find_units(keyed, window, gram))
    # Equal units meet as counts; one stands for all of them.
    distinct = units.groupBy("anchor", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("one")
    )
    distinct = cut_lineage(distinct)
    repeated = distinct.where("n > 1").select("anchor", "unit")
    whole = units.join(repeated, ["anchor", "unit"]).select("key", "first", "last")
    # Anchors with several units: their windows are equal in part, if at all.
    several = (
        distinct.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("units"), F.sum(F.when(F.col("n") == 1, 1)).alias("open"))
        .where("units > 1 AND open > 0")
    )
    # A hot anchor's units are spread by the join: they are split by AQE, its row is one.
    mixed = distinct.join(several, "anchor").select(
        "anchor",
        F.col("one.key").alias("key"),
        F.col("one.first").alias("first"),
        F.col("one.last").alias("last"),
        F.when(F.col("n") > 1, F.lit(2)).otherwise(F.lit(1)).alias("weight"),
        (F.col("units") > hot_anchor).alias("hot"),
    )
    mixed = cut_lineage(mixed)
    size = mixed.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + window), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_bytes))
    wanted = mixed.groupBy("key").agg(
        F.collect_list(F.struct("anchor", "first", "last", "weight", "hot")).alias("units")
    )
    texts = keyed.join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "units")

    def cut(batches):
        """The bytes of each wanted unit; of hot anchors each window's hash."""
        for batch in batches:
            rows = []
            for key, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text_bytes(text)
                for u in items:
                    a, b = u["first"], u["last"]
                    if u["hot"]:
                        for s in range(a, b + 1):
                            h = xxhash.xxh3_128_digest(data[s : s + window])
                            rows.append((-1, 0, key, s, u["weight"], h))
                    else:
                        shard = u["anchor"] % shards
                        rows.append((shard, u["anchor"], key, a, u["weight"], data[a : b + window]))
                if sum(len(r[5]) for r in rows[-len(items) :]) and len(rows) > 2000:
                    yield unit_batch(rows)
                    rows = []
            yield unit_batch(rows)

    pieces = texts.mapInArrow(cut, UNIT_SCHEMA)
    pieces = cut_lineage(pieces)

    def solve(table: pa.Table) -> pa.Table:
        return solve_shard(table, window)

    solved = pieces.where("shard >= 0").groupBy("shard").applyInArrow(solve, RANGE_SCHEMA)
    windows = pieces.where("shard < 0")
    more = (
        windows.groupBy("data").agg(F.sum("weight").alias("total")).where("total > 1").select("data")
    )
    hot = windows.where("weight = 1").join(more, "data").select(
        "key", F.col("first").alias("first"), F.col("first").alias("last")
    )
    return whole.unionByName(solved).unionByName(hot)


UNIT_SCHEMA = "shard long, anchor long, key long, first int, weight int, data binary"
RANGE_SCHEMA = "key long, first int, last int"


def unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["shard", "anchor", "key", "first", "weight", "data"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def coarseness(data: bytes) -> int:
    """The first choice of symbol ends under which a unit's symbols are short enough."""
    array = np.frombuffer(data, np.uint8)
    for k, ends in enumerate(ENDS):
        cuts = symbol_ends(array, ends)
        if np.diff(cuts, prepend=0, append=len(array)).max(initial=0) < LONGEST:
            return k
    return len(ENDS) - 1


def solve_shard(table: pa.Table, window: int) -> pa.Table:
    """Ranges of repeated starts of a shard's units.

    Units of one anchor are compared under one choice of symbols, the finest that any of them
    needs, and units of the same choice in one suffix array: equal windows have equal anchors.
    """
    anchor, key, first, weight, data = (
        table[c].to_pylist() for c in ("anchor", "key", "first", "weight", "data")
    )
    level: dict[int, int] = {}
    for a, d in zip(anchor, data, strict=True):
        level[a] = max(level.get(a, 0), coarseness(d))
    out: list[tuple[int, int, int]] = []
    for k in range(len(ENDS)):
        own = [i for i, a in enumerate(anchor) if level[a] == k]
        for i, starts in zip(own, repeated_starts([data[i] for i in own], window), strict=True):
            if weight[i] == 1 and len(starts):  # a repeated unit is known whole already
                cuts = np.flatnonzero(np.diff(starts) > 1)
                lows = starts[np.concatenate(([0], cuts + 1))] + first[i]
                highs = starts[np.concatenate((cuts, [len(starts) - 1]))] + first[i]
                out += [(key[i], a, b) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    kinds = [pa.int64(), pa.int32(), pa.int32()]
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "first", "last"]
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    hot_anchor: int = HOT_ANCHOR,
    with_bytes: bool = False,
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``with_bytes`` the
    remaining bytes as kept (binary: a cut may fall within a character).

    Every byte is removed that a string of ``window`` bytes covers which also starts anywhere
    else, in the same text or another, overlaps included; all copies go. Texts are taken as UTF-8.

    Every window has an anchor that depends on its bytes alone, so equal windows meet under their
    anchor. Units (an anchor with its windows) that are equal as a whole are known to repeat by
    their counts. Units that share their anchor with different ones go to a shard by the anchor,
    one of each kind, where a suffix array finds the repeated windows. Under an anchor of more
    than ``hot_anchor`` different units, windows are counted by 128-bit hash instead, spread over
    all tasks. ``gram`` is a power of two, at most half the window; ``window`` is over LONGEST.

    Null texts are empty. Repeated rows repeat each other. Other columns are ignored. Runs jobs
    when called; what it keeps between them lies in the checkpoint folder.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(keyed, window, gram, shard_bytes, hot_anchor)
    spans = cut_lineage(joined_ranges(ranges))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")
    ).join(spans, "key", "left")

    def clear(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data, kept, end, removed, runs = text_bytes(text), [], 0, 0, 0
                for s in sorted(found or [], key=lambda s: s["first"]):
                    start, stop = s["first"], s["last"] + window
                    if start > end or not runs:
                        kept.append(data[end:start])
                        runs += 1
                        removed += stop - start
                        end = stop
                    elif stop > end:
                        removed += stop - end
                        end = stop
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            arrays = [batch["_id"]]
            for c, kind in zip(list(zip(*out, strict=True)) or [[]] * 5, CLEARED, strict=True):
                arrays.append(pa.array(c, kind))
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for name, kind in zip(names[1:], ("long", "long", "long", "string", "binary"), strict=False):
        schema = schema.add(name, kind)
    return rows.select("_id", "text", "spans").mapInArrow(clear, schema)


CLEARED = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
