"""The numbered queries against brute force on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from skein.llm import queries
from tests.conftest import SMALL, rows_of

ASCII = {c: c + 32 for c in range(65, 91)}


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def test_packing_is_a_whole_cut_of_every_document(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append(r)
    docs = documents(spark)
    assert set(pieces) == {d.doc_id for d in docs}
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rows in used.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert padding == 0


def test_language_is_right_on_held_out_documents(spark):
    truth = {d.doc_id: d for d in documents(spark)}
    found = queries.op3_language_id(spark, SMALL).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    assert right / len(held) > 0.97


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_contamination(docs, items, window=13):
    wanted = defaultdict(set)
    for item in items:
        w = words(item.text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[i : i + n])].add(str(item.item_id))
    sizes = {len(k) for k in wanted}
    out = {}
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (owners := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        flagged = bool(hit) and 20 * len(hit) >= len(w)
        out[d.doc_id] = (len(w), len(hit), len(found), digest, flagged)
    return out


def test_decontamination_equals_window_search(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = brute_contamination(documents(spark), items)
    got = {r[0]: tuple(r[1:]) for r in queries.op4_decontamination(spark, SMALL).collect()}
    assert got == want
    assert any(v[4] for v in want.values())


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in prints}


def test_simhash_components_equal_all_pairs(spark):
    prints = {d.doc_id: brute_fingerprint(d.text) for d in documents(spark)}
    want = brute_components(prints)
    got = {r.doc_id: r for r in queries.op6_simhash(spark, SMALL).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_exact_groups_equal_sha_groups(spark):
    groups = defaultdict(list)
    for d in documents(spark):
        groups[hashlib.sha256((d.text or "").translate(ASCII).encode()).hexdigest()].append(d.doc_id)
    want = sorted(
        (d, max(ids), len(ids), d == max(ids), sha) for sha, ids in groups.items() for d in ids
    )
    assert rows_of(queries.op9_exact_dedup(spark, SMALL)) == sorted(want, key=repr)
