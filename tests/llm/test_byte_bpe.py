import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skein.llm import byte_bpe
from skein.llm.byte_bpe import Codec, MergeReplay, decode_bytes, encode_bytes, read_ranks
from skein.llm.queries import RANKS, op12_byte_bpe
from tests.conftest import SMALL

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def odd_texts():
    draw = random.Random(3)
    signs = "aabbcc  \n\t'strexyz01é漢ひ😀́\xa0　 .,!-\x1c\x85ÀßΩж\x00"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(60)] + [" " * n + "x" for n in range(60)] + ["é" * n for n in range(30)]
    return ["", *texts, "<|endoftext|>", "don't we'RE I'll"]


def test_codec_equals_the_library(library):
    texts = odd_texts()
    own = Codec(PATH, PATTERN)
    found = own.encode(texts)
    assert found == [packed(x) for x in library.encode_ordinary_batch(texts, num_threads=1)]
    assert [own.decode(x) for x in found] == [t.encode() for t in texts]


def test_long_texts_are_split_at_any_place(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 13)
    own = Codec(PATH, PATTERN)
    for text in [*odd_texts()[:300], " " * 40 + "b" * 60 + "'re" * 20, "  x" * 30]:
        assert own.encode([text])[0] == packed(library.encode_ordinary(text)), text


def alone(ranks, word):
    """One word merged by itself: the lowest rank first, of equals the leftmost."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_that_fall_after_a_merge():
    """Made tables in which a merge opens a pair of lower rank than its own."""
    draw = random.Random(5)
    for _ in range(200):
        tokens = {bytes(draw.choice(b"ab c") for _ in range(draw.randint(2, 5))) for _ in range(25)}
        order = [*[bytes([i]) for i in range(256)], *draw.sample(sorted(tokens), len(tokens))]
        ranks = {t: i for i, t in enumerate(order)}
        words = {bytes(draw.choice(b"ab c") for _ in range(draw.randint(1, 24))) for _ in range(40)}
        assert MergeReplay(ranks).encode(words) == {w: alone(ranks, w) for w in words}


def test_known_words_are_kept_in_two_generations(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 50)
    own = Codec(PATH, PATTERN)
    texts = odd_texts()[:600]
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert own.encode(part) == [packed(library.encode_ordinary(t)) for t in part]
    assert len(own.old) < 600


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_extra_columns_and_empty_tables(spark, library):
    long = "aé " * 700_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "y"), (3, "a b", "y"), (4, long, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = encode_bytes(frame, PATH, PATTERN)
    assert found.columns == ["doc_id", "ids", "n_tokens"]
    by_text = sorted((r.n_tokens, bytes(r.ids)) for r in found.collect())
    assert by_text == sorted((len(x), packed(x)) for x in (library.encode_ordinary(t or "") for _, t, _ in rows))
    back = decode_bytes(found, PATH, PATTERN).where("doc_id = 4").first()
    assert bytes(back.decoded).decode() == long
    assert encode_bytes(frame.limit(0), PATH, PATTERN).collect() == []
