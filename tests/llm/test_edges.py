"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.decontaminate import Automaton, decontaminate, words_of
from skein.llm.exact_dedup import drop_exact_copies, exact_dedup
from skein.llm.html_text import extract_text, main_text
from skein.llm.language import fit_language_model, identify_language
from skein.llm.lm_score import score_lm
from skein.llm.near_dedup import drop_near_copies, near_duplicates
from skein.llm.packing import Packer, WordIds, nnls, pack
from skein.llm.pii import base_spans, find_pii, fit_pii_model
from skein.llm.suffix_array import group_suffixes, repeated_starts
from skein.llm.suffix_dedup import remove_repeats
from skein.llm.url_filter import judge_urls
from tests.conftest import rows_of
from tests.llm.test_brute2 import brute_removed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use or add.
CLASHING = ["_n", "_hits", "_items", "_rows", "_keep", "_sha", "_text_sha", "_text_key", "_text_size", "n_hit", "contaminated"]
CLASHING += ["component_id", "fingerprint", "_id", "keep_id", "text_sha256", "fp", "key", "kept", "score", "lang_pred", "n_words", "units", "_text", "n_bytes", "hash"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30_000))
    texts = [None, "", " \n", "Same text here.", "SAME TEXT HERE.", "Same text here.", "ünï 123 !", "9" * 5000, long]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def clashing(odd):
    for name in CLASHING:
        odd = odd.withColumn(name, F.lit("clash"))
    return odd


def items_of(spark):
    return spark.createDataFrame([(1, "same text here"), (2, None), (3, "!!")], "item_id long, text string")


def operators(spark, docs):
    model = fit_language_model(docs)
    return {
        "pack": pack(docs, TOKENIZER),
        "pii": find_pii(docs, fit_pii_model(docs, examples=600)),
        "language": identify_language(docs, model),
        "decontaminate": decontaminate(docs, items_of(spark)),
        "lm": score_lm(docs),
        "near": near_duplicates(docs),
        "suffix": remove_repeats(docs),
        "exact": exact_dedup(docs),
    }


def test_odd_rows_survive_every_operator(spark, odd, clashing):
    for docs in (odd, clashing):
        for name, frame in operators(spark, docs).items():
            rows = frame.collect()
            assert len(rows) >= docs.count(), name


def test_empty_tables_give_no_rows(spark, odd):
    empty = odd.limit(0)
    for name, frame in operators(spark, empty).items():
        assert frame.isEmpty(), name
    no_items = items_of(spark).limit(0)
    assert not decontaminate(odd, no_items).where("contaminated").count()


def test_exact_ties_nulls_and_repeats(spark, odd):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect()]
    assert got.count((3, 5, 4, False)) == 2 and (5, 5, 4, True) in got
    assert (0, 1, 2, False) in got and (1, 1, 2, True) in got  # null and empty texts are equal
    assert (None, None, 1, True) in got
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 5, 6, 7, 8, None]))


def test_exact_groups_do_not_depend_on_the_hash(spark, odd):
    def weak(column):
        return F.length(column).cast("long")

    assert rows_of(exact_dedup(odd, chunk_hash=weak)) == rows_of(exact_dedup(odd))
    assert rows_of(exact_dedup(odd, min_chunk=4, max_chunk=16)) == rows_of(exact_dedup(odd))


def test_many_clashing_hashes_are_joined(spark, odd, monkeypatch):
    from skein.llm import exact_dedup as module

    want = rows_of(exact_dedup(odd))
    monkeypatch.setattr(module, "MOST_CLASHES", 0)
    assert rows_of(exact_dedup(odd, chunk_hash=lambda c: F.length(c).cast("long"))) == want


def test_near_ties(spark, odd):
    got = {(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)} <= got
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 3, None}


def test_stages_give_back_the_input_values(spark, odd, clashing, tmp_path):
    items_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    numbered = clashing.select(*[F.concat(F.lit(f"{c} "), "doc_id").alias(c) if c in CLASHING else c for c in clashing.columns])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, numbered, str(tmp_path))
        assert kept.columns == numbered.columns
        got, want = rows_of(kept), rows_of(numbered)
        assert got and set(got) <= set(want)


def test_rows_of_one_id_and_different_texts_are_judged_apart(spark):
    rows = [(1, "some text here now"), (2, "some text here now"), (2, "quite another one it is, of other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(drop_near_copies(docs)) == sorted([rows[0], rows[2], rows[3]], key=repr)


def test_without_labels_no_document_goes(spark, odd):
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, blank, "").count() == odd.count()


def test_long_texts_are_scored_in_stretches(monkeypatch, spark, odd):
    from skein.llm import language

    model = fit_language_model(odd)
    texts = [r.text for r in odd.collect()] + ["ab " * 5000]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "CELLS", 7)
    parts = model.predict(texts)
    assert [w[0] for w in whole] == [p[0] for p in parts]
    assert all(abs(w[1] - p[1]) < 1e-9 for w, p in zip(whole, parts, strict=True))


def test_contamination_of_short_items(spark, odd):
    got = {r.doc_id: r for r in decontaminate(odd, items_of(spark)).collect()}
    assert got[4].contaminated and got[4].hit_items == ["1"] and got[4].n_hit == 3
    assert got[0].n_words == 0 and not got[0].contaminated


def test_automata_in_shards_agree(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(rng.randrange(1, 9))) for i in range(30)]
    docs = [(i, make(rng.randrange(0, 60)), None, None, None) for i in range(40)]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate(docs, items, window=4)
    parts = decontaminate(docs, items, window=4, shard_words=40)
    assert rows_of(whole) == rows_of(parts)


@pytest.mark.parametrize("window", [1, 3, 13])
def test_automaton_equals_window_search(window):
    rng = random.Random(window)
    for _ in range(200):
        letters = "abc"[: rng.randrange(1, 4)]
        make = lambda n: [rng.choice(letters).encode() for _ in range(n)]
        items = [(i, make(rng.randrange(0, 20))) for i in range(rng.randrange(1, 5))]
        text = make(rng.randrange(0, 40))
        hit, found = set(), set()
        for number, (_, w) in enumerate(x for x in items if x[1]):
            n = min(window, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            for i in range(len(text) - n + 1):
                if tuple(text[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(number)
        ranges, got = Automaton(items, window).scan(text)
        assert {k for a, b in ranges for k in range(a, b)} == hit and got == found


def test_words_of_keeps_non_ascii():
    assert words_of("Ab1é, x_y\tÀ") == ["ab1é".encode(), b"x", b"y", "À".encode()]


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(1, 50))]
        assert group_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert group_suffixes([]) == [] and repeated_starts([], 5) == []


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_on_repetitive_texts(spark, hot):
    rng = random.Random(hot)
    base = "".join(rng.choice("abcd .,") for _ in range(1500))
    texts = [base[: rng.randrange(1500)] + rng.choice(["", "x", base[200:900]]) for _ in range(25)]
    texts += ["z" * 1300, "z" * 700 + "y" + "z" * 300, "ab" * 600, None, "", base, base]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, hot_anchor=hot, shard_bytes=5000).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (removed, runs, rest) in enumerate(brute_removed(data, 400)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data[i]), removed, runs)
        assert r.kept_sha256 == hashlib.sha256(rest).hexdigest()


def test_nnls_is_not_negative_and_fits():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.random((8, 20))
        x = np.maximum(rng.normal(size=20), 0)
        got = nnls(a, a @ x)
        assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def test_packer_places_everything_without_padding():
    import numpy as np

    rng = np.random.default_rng(2)
    packer, total = Packer(4096, 0), 0
    for doc in range(3000):
        ids = np.arange(int(rng.choice([1, 7, 300, 1500, 4095, 4096, 9000])), dtype="<u4")
        packer.add(doc, ids)
        total += len(ids)
    packer.finish()
    sums = {}
    for _, _, length, _, _, sequence, _ in packer.out:
        sums[sequence] = sums.get(sequence, 0) + length
    assert sum(sums.values()) == total
    assert all(n == 4096 or n & (n - 1) == 0 for n in sums.values())


def test_word_ids_equal_the_tokenizer():
    words = WordIds(TOKENIZER, size=50)
    texts = [
        "Hello, it's O'Neill's 3²½ µm ÀÉÎ ß ÿ", "a\u0301 ﬁne\u2003x\x85y\x1cz", "<|endoftext|> x<|startoftext|>y", "日本語 テスト",
        "İstanbul ΣΑΣ", "tab\tand\r\nlines  double", "", "don't we'll 'S'D", "x\xa0y", "!!!??", "naïve—dash",
    ]
    import numpy as np

    for text in texts * 2:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want, text


def test_base_spans_of_long_runs_end_soon():
    for text in ("a" * 200_000, "1." * 100_000, "9" * 200_000, "+1" * 100_000, "a@" * 100_000):
        base_spans(text)


PAGE = """<html><head><title>T</title></head><body class="has-sidebar">
<header class="site-header"><a href="/">Site name</a> Welcome to the site.</header>
<div class="cookie-notice">We use cookies, and more cookies. Accept all of them, please.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph, with <i>inline</i> text.<p>Second one.
<script>var x = "<p>no</p>";</script><ul><li>An item</ul></article>
<section id="comments"><p>I think that this is a long comment, with commas, and more.</p></section></main>
<aside>Side, bar. Text, text, and text.</aside><form><p>Your name, please.</p></form>
<div style="display: none">Hidden, text.</div><footer>&copy; 2024 All rights.</footer></body></html>"""


def test_main_text_leaves_furniture_out():
    want = "Title & more First paragraph, with inline text. Second one. An item"
    assert main_text(PAGE) == want
    assert main_text(PAGE[: PAGE.index("<section")]) == want
    for odd_page in (None, "", "<", "plain", "<p", "<!-- x", "<p>a<p>b", "<<<>>>", "</p></div>", "<div " * 3000):
        main_text(odd_page)
    assert main_text("plain &lt;text&gt;") == "plain <text>"


def test_pages_of_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert rows_of(extract_text(pages).select("page_id", "text", "n_chars")) == [(1, "", 0), (1, "x", 1)]
    assert extract_text(pages.limit(0)).isEmpty()


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/es/x?y", "ftp://a.com#f", "x://h?q://z/", "http://EXAMPLE.org/en/17"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert [got[i].host for i in range(8)] == ["", "", "", "", "example.org", "a.com", "h", "example.org"]
    assert [got[i].path for i in range(8)] == ["", "", "", "", "/es/x", "", "", "/en/17"]
    assert (got[4].rule, got[4].verdict) == ("example.org/es/", "block")
    assert (got[7].rule, got[7].verdict) == ("example.org/en/1", "block")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert judge_urls(pages.limit(0)).isEmpty()


def test_language_without_labels_is_unknown(spark, odd):
    blank = fit_language_model(odd.where("lang IS NULL"))
    assert {r.lang_pred for r in identify_language(odd, blank).collect()} == {"und"}
    got = {r.doc_id: r for r in identify_language(odd, fit_language_model(odd)).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[7].lang_pred == "und" and got[0].score == 0
    assert got[6].lang_pred == "en"


def test_lm_of_empty_texts(spark, odd):
    got = {r.doc_id: r for r in score_lm(odd).collect()}
    assert got[0].n_words == 0 and got[0].log_score == 0 and got[0].mean_log_score is None
    small = rows_of(score_lm(odd, partition=100, hot=4))
    assert [r[:2] for r in small] == [r[:2] for r in rows_of(score_lm(odd))]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(small, rows_of(score_lm(odd)), strict=True))


def test_pipeline_stages_keep_the_columns(spark, odd, tmp_path):
    items_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, odd.limit(0), str(tmp_path)).isEmpty()


def test_language_counts_come_from_all_rows(spark):
    model = fit_language_model(spark.range(12_000).select(F.lit("q").alias("text"), F.lit("xx").alias("lang")))
    weights = model.weights[:, 0].astype(float)
    # an n-gram that each text has once, over one that none has: (n + 0.1) / 0.1
    seen = sorted({round(0.1 * (math.exp(w - weights.min()) - 1)) for w in weights})
    assert seen[0] == 0 and abs(seen[1] - 12_000) < 20
