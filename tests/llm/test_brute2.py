"""More of the numbered queries against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import queries
from skein.llm.language import BUCKETS, grams
from skein.llm.near_dedup import near_duplicates, plant
from skein.llm.pii import luhn
from tests.conftest import SMALL, rows_of
from tests.llm.test_brute import (
    ASCII,
    brute_components,
    brute_contamination,
    brute_fingerprint,
    documents,
    words,
)


def brute_removed(texts, window):
    """(removed bytes, runs, remaining bytes) of each text, by counting windows."""
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        last = 0
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                for k in range(max(i, last), i + window):
                    gone[k] = True
                last = i + window
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def test_suffix_dedup_equals_window_counts(spark):
    docs = documents(spark)
    texts = [(d.text or "").encode() for d in docs]
    want = {
        d.doc_id: (len(t), n, runs, hashlib.sha256(rest).hexdigest())
        for d, t, (n, runs, rest) in zip(docs, texts, brute_removed(texts, 400), strict=True)
    }
    got = {r[0]: tuple(r[1:]) for r in queries.op8_suffix_dedup(spark, SMALL).collect()}
    assert got == want
    assert any(w[1] for w in want.values())


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_keeps_the_base_spans(spark):
    found = {r.doc_id: r for r in queries.op2_pii(spark, SMALL).collect()}
    for d in documents(spark):
        want, r = plain_spans(d.text), found[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(w.startswith(kind) for w in want)


def test_html_text_is_the_article(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op7_html_text(spark, SMALL).collect()}
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", p.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", inner))
        want = " ".join(" ".join(unescape(x).split()) for x in inner.split("\n") if x.strip())
        assert found[p.page_id].text == want
        assert found[p.page_id].n_chars == len(want)


def test_lm_scores_equal_counting(spark):
    docs = documents(spark)
    ones, twos = Counter(), Counter()
    for d in docs:
        w = words(d.text)
        ones.update(w)
        twos.update(zip(w, w[1:], strict=False))
    total = sum(ones.values())
    found = {r.doc_id: r for r in queries.op5_lm_score(spark, SMALL).collect()}
    for d in docs:
        w, score = words(d.text), 0.0
        for i, x in enumerate(w):
            if i and twos[w[i - 1], x] >= 2:
                score += math.log(twos[w[i - 1], x] / ones[w[i - 1]])
            else:
                score += math.log((0.4 if i else 1.0) * ones[x] / total)
        r = found[d.doc_id]
        assert r.n_words == len(w) and abs(r.log_score - score) < 1e-4 * (1 + abs(score))


RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def test_url_rules(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op10_url_filter(spark, SMALL).collect()}
    assert len(found) == len(pages)
    for p in pages:
        rest = p.url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].translate(ASCII)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [
            r for r in RULES if ("." + host).endswith("." + r[0]) and path.startswith(r[1])
        ]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        r = found[p.page_id]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best and best[0] + best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def plain_bayes(docs):
    """Language and posterior of each text with a letter, by dictionaries of bucket counts."""
    counts, sizes = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for d in docs:
        if remainder(d.doc_id) != 1 and d.lang is not None and d.text is not None:
            sizes[d.lang] += 1
            for buckets in grams(d.text):
                for b in buckets.tolist():
                    counts[d.lang][b] += 1
    totals = {x: sum(counts[x].values()) + 0.1 * BUCKETS for x in sizes}
    found = {}
    for d in docs:
        if not any(map(str.isalpha, d.text or "")):
            found[d.doc_id] = ("und", 0.0)
            continue
        logs = {x: math.log(sizes[x] / sum(sizes.values())) for x in sizes}
        for buckets in grams(d.text):
            for b, n in Counter(buckets.tolist()).items():
                for x in logs:
                    logs[x] += n * math.log((counts[x].get(b, 0) + 0.1) / totals[x])
        best = max(sorted(logs), key=logs.get)
        found[d.doc_id] = best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())
    return found


def known_language(docs):
    """All but a thousandth of the held-out rows told right, here all of them, pass the least score."""
    found = plain_bayes(docs)
    held = [found[d.doc_id][1] for d in docs if remainder(d.doc_id) == 1 and d.lang is not None and d.text is not None and found[d.doc_id][0] == d.lang]
    least = min(0.5, min(held))
    return [d for d in docs if found[d.doc_id][0] != "und" and found[d.doc_id][1] >= least - 1e-6]


def test_language_equals_plain_bayes(spark):
    docs = documents(spark)
    want = plain_bayes(docs)
    rows = queries.op3_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (remainder(r.doc_id) == 1)
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


def test_pipeline_equals_its_stages_by_brute_force(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    docs = known_language(documents(spark))
    groups = defaultdict(list)
    for d in docs:
        groups[(d.text or "").translate(ASCII)].append(d.doc_id)
    last = {max(ids) for ids in groups.values()}
    docs = [d for d in docs if d.doc_id in last]
    heads = brute_components({d.doc_id: brute_fingerprint(d.text) for d in docs})
    docs = [d for d in docs if heads[d.doc_id] == d.doc_id]
    flags = brute_contamination(docs, items)
    docs = {d.doc_id: d for d in docs if not flags[d.doc_id][4]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for key, rows in pieces.items():
        ids, at = tokenizer.encode(docs[key].text, add_special_tokens=False).ids + [2], 0
        for r in sorted(rows, key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.length, r.doc_tokens) == (at, len(part), len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


@pytest.mark.parametrize("blocks, radius, depth", [(3, 4, 6), (2, 4, 5), (1, 4, 4), (3, 4, 13)])
def test_trees_prune_no_link(blocks, radius, depth):
    """Every pair within the radius meets: one of them at home where the other comes."""
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(radius):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    forest = plant(base, (1 << 64) - 1, blocks, radius, depth)
    met = np.zeros(len(base), bool)
    for tree in forest:
        rows, leaf = tree.visit(near)
        met[rows[leaf == tree.home(base)[rows]]] = True
        assert depth < 5 or len(rows) < len(base) << depth
    assert met.all()


def test_one_tree_over_all_bits_finds_the_same_components(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = near_duplicates(docs)
    for blocks, shard in ((1, 8192), (2, 8192), (3, 20), (5, 20)):
        assert rows_of(near_duplicates(docs, blocks=blocks, shard=shard)) == rows_of(a)
