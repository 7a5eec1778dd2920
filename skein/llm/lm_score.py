"""Stupid-backoff language-model scores from count tables partitioned by hash."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.decontaminate import words_of
from skein.session import cut_lineage

#: Bigrams of these most frequent words are counted in a broadcast table, so no bigram that is
#: exchanged has more than 1 / HOT of all.
HOT = 512
#: Words up to which two ids share 64 bits; of more, each id travels in its own.
NARROW = 1 << 32
#: Bigrams of one partition of the count table.
PARTITION = 2_000_000
COUNTER_SIZE = 400_000


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, summed in the tasks first."""

    def run(batches):
        counter: Counter = Counter()

        def emit():
            batch = pa.RecordBatch.from_pydict(
                {"word": pa.array([w.decode() for w in counter], pa.string()), "n": pa.array(counter.values(), pa.int64())}
            )
            counter.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counter.update(words_of(text))
                if len(counter) > COUNTER_SIZE:
                    yield emit()
        yield emit()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def ranked_words(counts: DataFrame, parts: int) -> DataFrame:
    """(part, word, rank) of all words: ranks from 0 in descending order of count, then by word."""
    ordered = cut_lineage(counts.orderBy(F.desc("n"), "word").select("word"))
    sizes = ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()
    before, offsets = 0, {}
    for p, size in sorted((r["p"], r["count"]) for r in sizes):
        offsets[p] = before
        before += size

    def run(batches):
        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            part = [zlib.crc32(w.encode()) % parts for w in batch.column(0).to_pylist()]
            ranks = np.arange(at, at + len(part))
            at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch.column(0), pa.array(ranks)], ["part", "word", "rank"])

    return ordered.mapInArrow(run, "part long, word string, rank long")


class Unigrams:
    """Counts of words by rank: words that occur equally often have adjacent ranks, so the table
    has a row a count. There are fewer than sqrt(2 * all words) different counts."""

    def __init__(self, counts: list[int], words: list[int]):
        self.starts = np.cumsum([0, *words])[:-1]
        self.logs = np.log(np.array(counts, np.float64))

    def log(self, ranks: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.starts, ranks, "right") - 1]


def word_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """(number of words by text, all words as numbers, the number of each different word)."""
    numbers: dict[bytes, int] = {}
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    found = np.array([numbers.setdefault(w, len(numbers)) for x in words for w in x], np.uint32)
    return sizes, found, numbers


def followers(sizes: np.ndarray) -> np.ndarray:
    """Which words have one before them in their text."""
    follows = np.ones(int(sizes.sum()), bool)
    follows[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    return follows


def score_lm(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_count: int = 2,
    backoff: float = 0.4,
    hot: int = HOT,
    partition: int = PARTITION,
    narrow: int = NARROW,
) -> DataFrame:
    """id, n_words, log_score (sum over the words, natural logarithm) and mean_log_score.

    The model is counted over all texts of ``docs``: words are runs of digits, a-z after
    lower-casing A-Z, and non-ASCII characters, each of them a word of the model. A word scores
    count(previous, word) / count(previous) if that bigram occurs at least ``min_count`` times,
    else ``backoff`` * count(word) / all words; a text's first word scores count(word) / all words.

    Words are ranked by count, so that a rank tells the count. Each batch of texts asks for its
    different words by hash; the ranks come back to where the batch's words wait. Its bigrams are
    then dealt as pairs of ranks, exactly. Each partition builds its part of the count table,
    joins it to the bigrams it got and sums by document; the partial sums go back, packed, to
    where a batch's documents meet. The numbers of partitions follow the number of words.
    Broadcast are the ranks of the ``hot`` most frequent words and their table of bigrams, of
    fixed size, and the different counts (see Unigrams).

    Null and empty texts have no words, log_score 0 and a null mean. Repeated rows are counted and
    scored each. Other columns are ignored. Runs jobs when called.
    """
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs, text_col))
    classes = sorted(((r.n, r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)
    total = sum(n * words for n, words in classes)
    wide = sum(words for _, words in classes) > narrow
    log_total = float(np.log(max(total, 1)))
    top = counts.orderBy(F.desc("n"), "word").limit(hot).collect()
    shared = spark.sparkContext.broadcast(
        ({r.word.encode(): i for i, r in enumerate(top)}, Unigrams([c[0] for c in classes], [c[1] for c in classes]))
    )
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def hot_cells(ranks: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the second words of bigrams of hot words, their cells in the hot table)."""
        is_hot = ranks < hot
        at = np.flatnonzero(follows[1:] & is_hot[1:] & is_hot[:-1]) + 1
        return at, ranks[at - 1] * hot + ranks[at]

    def count_hot(batches):
        get = shared.value[0].get
        table = np.zeros(hot**2, np.int64)
        for batch in batches:
            words = [words_of(t) for t in batch["_text"].to_pylist()]
            ranks = np.array([get(w, hot) for x in words for w in x], np.int64)
            follows = followers(np.array([len(w) for w in words], np.int64))
            table += np.bincount(hot_cells(ranks, follows)[1], minlength=len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": table[cells]})

    cells = (
        source.select("_text")
        .mapInArrow(count_hot, "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.zeros(hot * hot, np.int64)
    table[cells["cell"]] = cells["n"]
    hot_table = spark.sparkContext.broadcast(table)
    parts = max(1, -(-total // partition))
    # a batch asks for a word once, so words need fewer partitions than bigrams
    word_parts = max(1, -(-parts // 4))

    def scores(before: np.ndarray, after: np.ndarray, pair_counts: np.ndarray) -> np.ndarray:
        log = shared.value[1].log
        known = np.log(np.maximum(pair_counts, 1)) - log(before)
        return np.where(pair_counts >= min_count, known, np.log(backoff) + log(after) - log_total)

    id_type = docs.schema[id_col].dataType
    sums_schema = (
        T.StructType()
        .add("batch", "long")
        .add("ids", T.ArrayType(id_type))
        .add("rows", T.ArrayType(T.IntegerType()))
        .add("sizes", T.ArrayType(T.LongType()))
        .add("sums", T.ArrayType(T.DoubleType()))
    )
    packed = T.StructType([*sums_schema.fields]).add("part", "long").add("codes", T.BinaryType())
    asked_schema = (
        T.StructType()
        .add("part", "long")
        .add("batch", "long")
        .add("ids", T.ArrayType(id_type))
        .add("sizes", T.ArrayType(T.LongType()))
        .add("numbers", T.BinaryType())
        .add("start", "long")
        .add("words", T.BinaryType())
    )
    told_schema = T.StructType([f for f in asked_schema if f.name not in ("part", "words")]).add("ranks", T.BinaryType())

    def kinds(id_kind: pa.DataType) -> list[pa.DataType]:
        values = [id_kind, pa.int32(), pa.int64(), pa.float64()]
        return [pa.int64(), *map(pa.list_, values), pa.int64(), pa.binary()]

    def ask(batches):
        """For each batch a row of its words as numbers, and for each part a row of its different
        words there; words are numbered by part."""
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, found, numbers = word_numbers(batch["_text"].to_pylist())
            part = np.array([zlib.crc32(w) % word_parts for w in numbers], np.int64)
            names = sorted(numbers)
            order = np.array([numbers[w] for w in names], np.int64)  # sorted words squeeze better
            order = order[np.argsort(part[order], kind="stable")]
            place = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
            place[order] = np.arange(len(order))
            waiting = squeezed(place[found].tobytes())
            made = [(number % word_parts, number, batch["_id"].to_pylist(), sizes, waiting, None, None)]
            names = list(numbers)
            start = 0
            for p, share in zip(*split_by(part[order], order), strict=True):
                made.append((p, number, None, None, None, start, squeezed(b" ".join(names[i] for i in share))))
                start += len(share)
            number += 1
            of = [pa.int64(), pa.int64(), pa.list_(batch["_id"].type), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary()]
            columns = zip(zip(*made, strict=True), of, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], asked_schema.names)

    def tell(asked: pa.Table, ranked: pa.Table) -> pa.Table:
        """The ranks of the words of each row."""
        ranks = [None] * len(asked)
        rows = np.flatnonzero(pa.compute.is_valid(asked["words"]).to_numpy())
        if len(rows):
            lists = [unsqueezed(w).decode().split(" ") for w in asked["words"].drop_null().to_pylist()]
            words = pa.array([w for x in lists for w in x], pa.string())
            at = pa.compute.index_in(words, ranked["word"].combine_chunks())
            found = ranked["rank"].to_numpy()[at.to_numpy()].astype(np.int64 if wide else np.uint32)
            for row, share in zip(rows, np.split(found, np.cumsum([len(x) for x in lists])[:-1]), strict=True):
                ranks[row] = share.tobytes()
        return asked.select(told_schema.names[:-1]).append_column("ranks", pa.array(ranks, pa.binary()))

    def explode(group: pa.Table) -> pa.Table:
        """Of a batch a row of what is known at once, and a row of bigrams for each part."""
        waiting = group.filter(pa.compute.is_valid(group["ids"]))
        told = group.filter(pa.compute.is_null(group["ids"])).sort_by("start")
        rank = np.frombuffer(b"".join(told["ranks"].to_pylist()), np.int64 if wide else np.uint32)
        numbers = unsqueezed(waiting["numbers"][0].as_py())
        numbers = np.frombuffer(numbers, np.uint16 if len(rank) <= 1 << 16 else np.uint32)
        sizes, number = waiting["sizes"][0].values.to_numpy(), waiting["batch"][0].as_py()
        ranks = rank.astype(np.int64)[numbers]
        follows = followers(sizes)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        sums = np.zeros(len(ranks))
        first = np.flatnonzero(~follows)
        sums[first] = shared.value[1].log(ranks[first]) - log_total
        at, cells = hot_cells(ranks, follows)
        sums[at] = scores(ranks[at - 1], ranks[at], hot_table.value[cells])
        rest = follows
        rest[at] = False
        known = np.bincount(of, sums, len(sizes))
        id_kind = group["ids"].type.value_type
        made = [(number, waiting["ids"][0].values, None, sizes, known, number % parts, None)]
        rest = np.flatnonzero(rest)
        before, after = ranks[rest - 1].astype(np.uint64), ranks[rest].astype(np.uint64)
        mixed = (before * np.uint64(0xD6E8FEB86659FD93) ^ after) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for p, share in zip(*split_by(part[order], order), strict=True):
            rows, n = np.unique(of[rest[share]], return_counts=True)
            pairs = np.stack([before[share], after[share]], 1) if wide else before[share] << np.uint64(32) | after[share]
            made.append((number, None, rows, n, None, p, squeezed(pairs.tobytes())))
        columns = zip(zip(*made, strict=True), kinds(id_kind), strict=True)
        return pa.table([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in c], k) for c, k in columns], packed.names)

    def join_counts(group: pa.Table) -> pa.Table:
        """Joins a partition's count table to its bigrams; each row comes back with sums."""
        waiting = group.filter(pa.compute.is_valid(group["codes"]))
        sums = []
        if len(waiting):
            codes = np.frombuffer(b"".join(map(unsqueezed, waiting["codes"].to_pylist())), np.uint64)
            if wide:
                pairs, index, count = np.unique(codes.reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
                before, after = pairs[:, 0], pairs[:, 1]
            else:
                pairs, index, count = np.unique(codes, return_inverse=True, return_counts=True)
                before, after = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
            each = scores(before.astype(np.int64), after.astype(np.int64), count)[index.reshape(-1)]
            sizes = np.concatenate([c.values.to_numpy() for c in waiting["sizes"]])
            by_text = np.add.reduceat(each, np.cumsum(sizes) - sizes)
            edges = np.cumsum([len(r.values) for r in waiting["rows"]])[:-1]
            sums = np.split(by_text, edges)
        done = group.filter(pa.compute.is_null(group["codes"]))
        waiting = waiting.select(sums_schema.names)
        # sizes have done their part and do not travel back
        waiting = waiting.set_column(3, "sizes", pa.nulls(len(waiting), pa.list_(pa.int64())))
        waiting = waiting.set_column(4, "sums", pa.array(sums, pa.list_(pa.float64())))
        return pa.concat_tables([waiting, done.select(sums_schema.names)]).cast(
            pa.schema(list(zip(sums_schema.names, kinds(group["ids"].type.value_type), strict=False)))
        )

    out = (
        T.StructType()
        .add(id_col, id_type)
        .add("n_words", "long")
        .add("log_score", "double")
        .add("mean_log_score", "double")
    )

    def finish(group: pa.Table) -> pa.Table:
        """Sums the parts of one batch's documents."""
        known = group.filter(pa.compute.is_valid(group["ids"]))
        sizes, sums = known["sizes"][0].values.to_numpy(), known["sums"][0].values.to_numpy().copy()
        for r in zip(group["ids"], group["rows"], group["sums"], strict=True):
            if not r[0].is_valid:
                sums[r[1].values.to_numpy()] += r[2].values.to_numpy()
        mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
        columns = [known["ids"][0].values, sizes, np.round(sums, 6), pa.compute.round(mean, 6)]
        return pa.table(dict(zip(out.names, columns, strict=True)))

    asked = source.mapInArrow(ask, asked_schema)
    told = asked.groupBy("part").cogroup(ranked_words(counts, word_parts).groupBy("part")).applyInArrow(tell, told_schema)
    dealt = told.groupBy("batch").applyInArrow(explode, packed)
    joined = dealt.groupBy("part").applyInArrow(join_counts, sums_schema)
    return joined.groupBy("batch").applyInArrow(finish, out)


CODEC = "zstd"


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, CODEC, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), CODEC, asbytes=True)


def split_by(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different sorted keys, and the values of each."""
    if not len(keys):
        return [], []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts].tolist(), np.split(values, starts[1:])
