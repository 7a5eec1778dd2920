import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from skein.llm import token_align
from skein.llm.queries import ALIGNED, op13_token_align
from skein.llm.token_align import SUMS, TokenizerPair, align_tokenizers, segment_pattern, splitting_characters
from tests.conftest import SMALL

PATHS = tuple(map(public_tokenizers.path, ALIGNED))


@pytest.fixture(scope="module")
def pair():
    return TokenizerPair(*PATHS)


def whole(pair, text):
    """A's and B's ids of a text, each taken as a whole; None where B does not give it back."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    want = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
        return None
    return a, b


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + sizes[i], i))
        at += sizes[i]
    return out


def brute(pair, rows):
    """By the definitions: overlaps by comparing byte ranges, groups by common ends."""
    told, counts = [], Counter()
    for key, text in rows:
        found = whole(pair, text)
        if found is None:
            told.append((key, None))
            continue
        a, b = spans(found[0], pair.a_sizes), spans(found[1], pair.b_sizes)
        links, low = [], 0
        for s, e, i in a:
            while b[low][1] <= s:
                low += 1
            at = low
            while at < len(b) and b[at][0] < e:
                links.append((i, b[at][2]))
                at += 1
        counts.update(links)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in x if start <= s and e <= end) for x in (a, b)) if len(text) < 3000 else "")
            start = end
        told.append((key, (len(a), len(b), len(ends), links, ";".join(groups))))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, found in told:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = found
        ns = [counts[x] for x in links]
        out.append((key, n_a, n_b, n_groups, len(links), sum(n == best[x[1]] for x, n in zip(links, ns, strict=True)), sum(ns), groups))
    return out


def odd_texts():
    draw = random.Random(9)
    signs = "ab  \n\t\r's1é漢\U0001f600\xa0　.,\x85\x1c▁\x00<s>"
    return ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)]


def test_segments_give_the_tokens_of_the_whole(pair):
    for text in [*odd_texts(), "<s> </s> <unk> <0x41>", "<|endoftext|> x<|endoftext|>", "a" * 500, " " * 300]:
        found = whole(pair, text)
        assert pair.kept_whole(text) == (found is not None), text
        assert "".join(pair.split(text)) == " " + text
        if found:
            parts = list(pair.encode(pair.split(text)))
            assert ([i for a, _ in parts for i in a], [i for _, b in parts for i in b]) == found, text


def test_cuts_are_only_where_no_piece_crosses():
    assert " " in splitting_characters([" a", "b", "  "])
    assert " " not in splitting_characters(["a b"])
    assert "\n" not in splitting_characters([";\n"]) and "\t" not in splitting_characters([" \t"])
    assert segment_pattern(" ").findall(" a\nb  c \n d ") == [" a\nb", "  c", " \n d", " "]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = align_tokenizers(frame.repartition(3), *PATHS, **options).collect()
    return sorted((tuple(r[c] for c in ("doc_id", *SUMS, "groups")) for r in found), key=repr)


@pytest.mark.parametrize("chars", [24_000_000, 300])
def test_operator_equals_brute_force(spark, pair, monkeypatch, chars):
    """Also with blocks of a few documents, many to a partition, so that segments meet across them."""
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (7, None), (8, ""), (9, "twice"), (9, "twice")]
    monkeypatch.setattr(token_align, "BLOCK_CHARS", chars)
    assert run(spark, rows) == sorted(brute(pair, rows), key=repr)


def test_more_pairs_than_are_broadcast_are_joined(spark, pair, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(token_align, "STEP", 7)
    rows = list(enumerate(odd_texts()[:400]))
    want = sorted(brute(pair, rows), key=repr)
    assert run(spark, rows, most_pairs=10) == want == run(spark, rows)


def test_query_equals_brute_force(spark, pair):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {r[0]: r for r in brute(pair, docs)}
    found = op13_token_align(spark, SMALL).collect()
    assert len(found) == len(docs) and any(r.n_groups < r.n_a for r in found)
    texts = dict(docs)
    for r in found:
        assert tuple(r[c] for c in ("doc_id", *SUMS)) == want[r.doc_id][:-1]
        if len(texts[r.doc_id] or "") < 3000:
            groups = want[r.doc_id][-1]
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if r.n_a else "")


def test_empty_tables_long_words_and_clashing_columns(spark, pair):
    assert run(spark, []) == []
    rows = [(1, "x" * 20_000 + " " + "é" * 2000), (2, None)]
    found = run(spark, rows)
    assert [r[:-1] for r in found] == [r[:-1] for r in brute(pair, rows)]
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, block int, places string")
    row = align_tokenizers(clash, *PATHS).first()
    assert row.groups == brute(pair, [(1, "a b")])[0][-1]
