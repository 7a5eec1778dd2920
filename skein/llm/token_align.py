"""Alignment of two tokenizers' tokens over a corpus, each distinct segment aligned once."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.components import SHARE, lookup
from skein.session import ensure_checkpoint_dir

#: A block of documents ends at so many characters or different segments, and at a document's end.
BLOCK_CHARS, BLOCK_SEGMENTS = 24_000_000, 1_000_000
#: Pairs of ids whose counts are sent to all tasks; where there are more, they are joined.
MOST_PAIRS = 3_000_000
#: Segments that are tokenised, or handed on, at once.
STEP = 20_000
# fixed values: the characters with the Unicode property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
SPACE_SIGN = "▁"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def splitting_characters(pieces: list[str]) -> str:
    """The white space before which a text may be cut, as no piece crosses the cut.

    ``pieces`` have plain spaces. A cut lies between a character that is no white space and one
    that is. A piece that could cross it holds such a place inside. Where the cut's white space is
    not a space, the piece tokenizer puts a space before the segment; it stays a token of its own
    if no piece begins with a space and that character.
    """
    inner = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if b in WHITE and a not in WHITE}
    begun = {p[1] for p in pieces if len(p) > 1 and p[0] == " " and p[1] != " "}
    return "".join(c for c in WHITE if c not in inner | begun)


def segment_pattern(cuts: str) -> re.Pattern:
    """Segments of a text: white space, then all up to white space that begins with one of ``cuts``."""
    white = re.escape(WHITE)
    kept = re.escape("".join(c for c in WHITE if c not in cuts))
    more = f"(?:[{kept}][{white}]*[^{white}]*)*" if kept else ""
    return re.compile(f"[{white}]*[^{white}]+{more}|[{white}]+")


class TokenizerPair:
    """A: byte-level BPE (a tokenizers file). B: a piece model (sentencepiece) that adds a space."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        with open(bytes_path, encoding="utf-8") as file:
            told = json.load(file)
        before = told["pre_tokenizer"]
        if told["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            # the byte-level pattern ends every match between other characters and white space
            raise ValueError("the first tokenizer must split by the byte-level pattern alone")
        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        known = byte_characters()
        self.a_bytes = {
            i: bytes(known[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in known for c in t)
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i).replace(SPACE_SIGN, " ") for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.space = pieces.index(" ")
        cuts = splitting_characters([p for i, p in enumerate(pieces) if not self.b.is_byte(i)])
        if " " not in cuts:
            raise ValueError("pieces of the second tokenizer cross spaces")
        self.segments = segment_pattern(cuts)
        self.a_sizes = {i: len(x) for i, x in self.a_bytes.items()}
        self.b_sizes = [len(x) for x in self.b_bytes]

    def kept_whole(self, text: str) -> bool:
        """Whether B's pieces, joined, give the text back: it holds no space sign of its own and B's
        normaliser does nothing but mark spaces. A gives every text back."""
        return SPACE_SIGN not in text and self.b.normalize(text) == SPACE_SIGN + text.replace(" ", SPACE_SIGN)

    def split(self, text: str) -> list[str]:
        return self.segments.findall(" " + text)

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of A and B of each segment. B adds a space in front: it is the segment's own first
        one, or a token that is taken off. Joined bytes that differ from the segment are an error."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a_lists = [e.ids for e in encode(segments, add_special_tokens=False)]
        b_lists = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for segment, a, b in zip(segments, a_lists, b_lists, strict=True):
            if segment == " ":
                b = [self.space]  # without more text B adds nothing
            elif segment[0] != " ":
                if b[0] != self.space:
                    raise ValueError(f"the second tokenizer joins a space with {segment[:20]!r}")
                b = b[1:]
            whole = segment.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                raise ValueError(f"a tokenizer does not give {segment[:20]!r} back")
            yield a, b

    def align(self, a: list[int], b: list[int]) -> tuple[str, int, list[int]]:
        """The groups as text, their number, and the links: A's id times 2**32 plus B's id of each pair
        of tokens whose bytes overlap. The token that ends first makes way for the next one."""
        links, groups = [], []
        i = j = i0 = j0 = 0
        a_end, b_end = self.a_sizes[a[0]], self.b_sizes[b[0]]
        while True:
            links.append(a[i] << 32 | b[j])
            if a_end == b_end:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                if i == len(a):
                    return ";".join(groups), len(groups), links
                i0, j0 = i, j
                a_end, b_end = a_end + self.a_sizes[a[i]], b_end + self.b_sizes[b[j]]
            elif a_end < b_end:
                i += 1
                a_end += self.a_sizes[a[i]]
            else:
                j += 1
                b_end += self.b_sizes[b[j]]


@cache
def tokenizer_pair(bytes_path: str, pieces_path: str) -> TokenizerPair:
    """One pair for all tasks that a worker process runs."""
    return TokenizerPair(bytes_path, pieces_path)


class Places(dict):
    """Segments numbered in the order in which they are asked for."""

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        return number


def cut_documents(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Of each block of documents (id, text) where it lies: a row (block, place, segment, n) for each
    different segment and a row (block, id, places) for each document. ``places`` are unsigned
    32-bit numbers, compressed; a document without tokens has none."""
    schema = T.StructType().add("block", "long").add("place", "integer").add("segment", "string").add("n", "long")
    schema = schema.add("id", docs.schema["id"].dataType).add("places", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(bytes_path, pieces_path)
        press = zstandard.ZstdCompressor(level=1).compress
        block = TaskContext.get().partitionId() << 33
        places, used, chars = Places(), [], 0

        def filled(names: dict, size: int, like: pa.RecordBatch) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "place": pa.int32(), "segment": pa.string(), "n": pa.int64(), "places": pa.binary()}
            kinds["id"] = like.schema.field("id").type
            own = [names[f] if f in names else pa.nulls(size, kinds[f]) for f in schema.names]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[f]) for f, x in zip(schema.names, own, strict=True)], names=schema.names)

        def segment_rows(like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(places), np.int64)
            for part in used:
                counts += np.bincount(part, minlength=len(places))
            names = list(places)
            for at in range(0, len(names), STEP):
                few = names[at : at + STEP]
                own = {"block": [block] * len(few), "place": range(at, at + len(few)), "segment": few, "n": counts[at : at + STEP]}
                yield filled(own, len(few), like)

        for batch in batches:
            first, lists = 0, []

            def document_rows(upto: int, batch=batch) -> pa.RecordBatch:
                ids = batch.column("id").slice(first, upto - first)
                return filled({"block": [block] * len(ids), "id": ids, "places": lists}, len(ids), batch)

            for row, text in enumerate(batch.column("text").to_pylist()):
                if text and pair.kept_whole(text):
                    found = pair.split(text)
                    numbers = np.fromiter(map(places.__getitem__, found), np.uint32, len(found))
                    used.append(numbers)
                    lists.append(press(numbers.tobytes()))
                    chars += len(text)
                else:
                    lists.append(b"")
                if chars >= BLOCK_CHARS or len(places) >= BLOCK_SEGMENTS:
                    yield document_rows(row + 1)
                    yield from segment_rows(batch)
                    first, lists = row + 1, []
                    places, used, chars, block = Places(), [], 0, block + 1
            if lists:
                yield document_rows(batch.num_rows)
        if places:
            yield from segment_rows(batch)

    return docs.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, pa.Table]]:
    """Rows (segment, ...) sorted by segment in tables of about STEP rows or more: the different
    segments, where the rows of each begin, and the table. A segment's rows are in one table, but
    for one with more than STEP rows."""
    held: list[pa.Table] = []
    size = 0

    def cut(whole: pa.Table, last: bool) -> tuple[list[str], np.ndarray, pa.Table]:
        names = whole["segment"].to_pylist()
        starts = [i for i, x in enumerate(names) if not i or x != names[i - 1]]
        if not last and len(starts) > 1:
            whole, starts = whole.slice(0, starts[-1]), starts[:-1]
        return [names[i] for i in starts], np.array(starts, np.int64), whole

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= STEP:
            whole = pa.concat_tables(held)
            found = cut(whole, False)
            yield found
            held = [whole.slice(found[2].num_rows)]
            size = held[0].num_rows
    if size:
        yield cut(pa.concat_tables(held), True)


ALIGNED = (
    "n long, n_a integer, n_b integer, n_groups integer, groups string, links array<long>, "
    "blocks array<long>, places array<integer>"
)


def align_segments(rows: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Alignments of the segments of rows (segment, block, place, n) sorted by segment: a row for each
    different one, with the sum of n and the blocks and places that have it; a segment of over STEP
    rows may have several. Columns as in ALIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(bytes_path, pieces_path)
        for names, starts, table in runs(batches):
            found = [(len(a), len(b), *pair.align(a, b)) for a, b in pair.encode(names)]
            n_a, n_b, groups, n_groups, links = zip(*found, strict=True)
            ends = np.append(starts, table.num_rows).astype(np.int32)
            sizes = np.cumsum([0, *map(len, links)])
            flat = np.fromiter((x for own in links for x in own), np.int64, sizes[-1])
            lists = [pa.ListArray.from_arrays(pa.array(ends), table[c].combine_chunks()) for c in ("block", "place")]
            columns = {
                "n": np.add.reduceat(table["n"].to_numpy(), starts),
                "n_a": pa.array(n_a, pa.int32()),
                "n_b": pa.array(n_b, pa.int32()),
                "n_groups": pa.array(n_groups, pa.int32()),
                "groups": pa.array(groups, pa.string()),
                "links": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)),
                "blocks": lists[0],
                "places": lists[1],
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, rows, best) of each pair of ids that a link holds: how many links of the corpus
    hold it, how many of those of aligned segments, and whether no pair of its B id has more."""
    links = aligned.select("n", F.explode("links").alias("pair"))
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows"))
    # at most as many rows of one B id as A has ids
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.withColumn("best", F.col("count") == most)


def joined_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum, by a join of its links with the pairs' counts. Pairs that
    a large share of all links hold are looked up by broadcast, fewer than SHARE."""
    rows = stored(aligned.withColumn("number", F.monotonically_increasing_id()), "numbered")
    links = rows.select("number", F.explode("links").alias("pair"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = counts.where(F.col("rows") * SHARE > total).select("pair")
    told = lookup(links, counts.select("pair", "count", "best"), "pair", hot)
    scores = told.groupBy("number").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    return rows.drop("links").join(scores, "number").drop("number")


def placed_scores(aligned: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(block, packed): for each block what its places need to know, see ``pack_places``.

    Up to ``most`` pairs, 17 bytes each, are sent to the tasks; more are joined.
    """
    spark = aligned.sparkSession
    size = counts.count()
    if size > most:
        rows, shared = joined_scores(aligned, counts), None
    else:
        table = counts.select("pair", "count", "best").toArrow()
        order = np.argsort(table["pair"].to_numpy())
        shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "count", "best")))
        rows = aligned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if shared is None:
                best, sums = (batch.column(c).to_numpy() for c in ("n_best", "count_sum"))
            else:
                pairs, n, is_best = shared.value
                links = batch.column("links")
                at = np.searchsorted(pairs, links.flatten().to_numpy())
                starts = links.offsets.to_numpy()[:-1] - links.offsets[0].as_py()
                best, sums = np.add.reduceat(is_best[at].astype(np.int64), starts), np.add.reduceat(n[at], starts)
            yield from pack_places(batch, best, sums)

    return rows.mapInArrow(run, "block long, packed binary")


#: What a place holds, besides its groups.
PLACE = np.dtype([("place", "<u4"), ("n_a", "<u4"), ("n_b", "<u4"), ("n_groups", "<u4"), ("n_best", "<u4"), ("count_sum", "<u8")])


def pack_places(batch: pa.RecordBatch, best: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block that has some of the segments: the fields of PLACE one after another, then
    the groups in lines, compressed together, as most of their bytes repeat."""
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = batch.column("blocks").flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), batch.column("blocks").value_lengths().to_numpy())
    order = np.argsort(blocks, kind="stable")
    blocks, row = blocks[order], row[order]
    fields = {c: batch.column(c).to_numpy()[row] for c in ("n_a", "n_b", "n_groups")}
    fields |= {"place": batch.column("places").flatten().to_numpy()[order], "n_best": best[row], "count_sum": sums[row]}
    groups = batch.column("groups").to_pylist()
    starts = np.flatnonzero(np.diff(blocks, prepend=-1))
    packed = []
    for at, end in zip(starts, np.append(starts[1:], len(blocks)), strict=True):
        own = [fields[c][at:end].astype(PLACE[c]).tobytes() for c in PLACE.names]
        lines = "\n".join([groups[i] for i in row[at:end].tolist()]).encode()
        packed.append(int(end - at).to_bytes(8, "little") + press(b"".join([*own, lines])))
    yield pa.RecordBatch.from_arrays([pa.array(blocks[starts]), pa.array(packed, pa.binary())], names=["block", "packed"])


def unpack_places(packed: list[bytes]) -> tuple[dict[str, np.ndarray], list[str]]:
    """The fields and groups of a block's places in their order."""
    unpress = zstandard.ZstdDecompressor().decompress
    fields: dict[str, list] = {c: [] for c in PLACE.names}
    groups: list[str] = []
    for x in packed:
        size, raw, at = int.from_bytes(x[:8], "little"), unpress(x[8:]), 0
        for c in PLACE.names:
            fields[c].append(np.frombuffer(raw, PLACE[c], size, at))
            at += size * PLACE[c].itemsize
        groups.extend(raw[at:].decode().split("\n"))
    whole = {c: np.concatenate(x).astype(np.int64) for c, x in fields.items()}
    order = np.argsort(whole.pop("place"))
    return {c: x[order] for c, x in whole.items()}, [groups[i] for i in order.tolist()]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared checkpoint folder, compressed, and read from there."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/align-{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_tokenizers(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs``.

    A encodes a space and the text, B the text, to which it adds the space. Places where tokens of
    both end cut them into groups, ``a1,a2|b1;a3|b2,b3``. A link is a pair of an A and a B token
    whose bytes overlap; an id pair's count is the number of links of the corpus that hold it;
    n_best counts the links whose count is the highest of their B id, count_sum adds counts up.

    Texts are split before white space, where neither vocabulary can join tokens (checked when
    the vocabularies are read). Documents are taken in blocks where they lie: a block names its
    different segments once and its documents become lists of their numbers. The corpus's distinct
    segments are dealt by segment, tokenised and aligned once, the counts of pairs are added up over
    them, and a segment's alignment goes back to each block that has it; blocks put their documents
    together. Blocks are bounded, so no segment is in more rows than there are blocks. Up to
    ``most_pairs`` counts are broadcast, more are joined.

    Null and empty texts, and those that B does not give back, have zeros and '' and count for
    nothing. Repeated rows count each; ids may be null. Other columns are ignored. An empty table
    gives no rows. Runs jobs when called, and writes blocks, alignments and pairs to the
    checkpoint folder.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = stored(cut_documents(rows, bytes_path, pieces_path), "blocks")
    places = blocks.where("place IS NOT NULL").select("segment", "block", "place", "n")
    dealt = places.repartition("segment").sortWithinPartitions("segment")
    aligned = stored(align_segments(dealt, bytes_path, pieces_path), "segments")
    counts = stored(pair_counts(aligned), "pairs")
    placed = placed_scores(aligned, counts, most_pairs)
    texts = blocks.where("place IS NULL").select(F.col("block").alias("home"), "id", "places")
    schema = rows.select("id").schema
    for name in SUMS:
        schema.add(name, "long")
    schema.add("groups", "string")

    def compose(documents: pa.Table, packed: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        known = {c: np.zeros(0, np.int64) for c in SUMS}
        groups: list[str] = []
        if packed.num_rows:
            known, groups = unpack_places(packed["packed"].to_pylist())
            # within a group each token but the first two adds a link
            known["n_links"] = known["n_a"] + known["n_b"] - known["n_groups"]
        found = [np.frombuffer(unpress(x) if x else b"", np.uint32) for x in documents["places"].to_pylist()]
        columns = [documents["id"], *(pa.array([int(known[c][x].sum()) for x in found], pa.int64()) for c in SUMS)]
        columns.append(pa.array([";".join(map(groups.__getitem__, x.tolist())) for x in found], pa.string()))
        return pa.table(columns, names=schema.names)

    composed = texts.groupBy("home").cogroup(placed.groupBy("block")).applyInArrow(compose, schema)
    return composed.withColumnRenamed("id", id_col)
