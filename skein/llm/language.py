"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name, put_back, set_aside

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: Languages a model may have: with BUCKETS it bounds the broadcast matrix (4 bytes a cell).
MAX_LANGUAGES = 256
UNKNOWN = "und"


#: Weights that scoring gathers at once.
CELLS = 1 << 18
#: Characters of one slice of a text; slices overlap, so that no n-gram is lost between them.
SLICE = 1 << 20


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of the lower-cased words, with their edges.

    Everything but letters counts as a space, spaces in a row as one. Orders are hashed apart.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    codes = np.where(letter, codes, 32)[keep]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    for n in ORDERS:
        for start in range(0, len(codes) - n + 1, SLICE):
            part = codes[start : start + SLICE + n - 1]
            h = np.full(len(part) - n + 1, n * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(29)
            yield ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class LanguageModel:
    """``weights``: log P(bucket | language), BUCKETS x languages, float32; ``priors``: log P."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.weights, self.priors = languages, weights, priors

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior) of each text; (und, 0) of texts without a letter.

        Whole texts are scored, as a sparse batch: a text is a sparse row of n-gram counts, whose
        product with the weights is the sum of the rows that its n-grams gather. Stretches of
        n-grams of several texts are gathered together, at most CELLS cells of weights at once.
        """
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, text in enumerate(texts) if has_letter(text)] if self.languages else []
        scores = np.tile(self.priors, (len(texts), 1))
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        room = most = max(1, CELLS // max(1, len(self.languages)))

        def gather() -> None:
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            rows = self.weights[np.concatenate(waiting)]
            np.add.at(scores, owners, np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
            waiting.clear()
            owners.clear()

        for i in known:
            for buckets in grams(texts[i]):
                at = 0
                while at < len(buckets):
                    part = buckets[at : at + room]
                    waiting.append(part)
                    owners.append(i)
                    at += len(part)
                    room -= len(part)
                    if not room:
                        gather()
                        room = most
        if waiting:
            gather()
        for i in known:
            best = int(scores[i].argmax())
            out[i] = (self.languages[best], float(1 / np.exp(scores[i] - scores[i][best]).sum()))
        return out


def fit_language_model(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    smoothing: float = 0.1,
) -> LanguageModel:
    """Naive Bayes counts of the rows with a text and a language.

    All of them count. Counts are summed per task, then by language and bucket; the driver gets
    at most BUCKETS cells a language. Over MAX_LANGUAGES languages are an error. No usable row
    gives a model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))

    def count(batches):
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for buckets in grams(text):
                    totals[index[lang]] += np.bincount(buckets, minlength=BUCKETS)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict(
            {"lang": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": totals[lang, bucket]}
        )

    cells = (
        rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .mapInArrow(count, "lang int, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.full((BUCKETS, len(languages)), smoothing)
    counts[cells["bucket"], cells["lang"]] += cells["n"]
    weights = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    share = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, weights, np.log(share / share.sum()))


def identify_language(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with their columns (or those in ``keep``), lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0; so is everything under a model
    without languages. The score is the posterior of the predicted language. Columns of ``docs``
    named like the added ones are replaced. The broadcast model is at most
    MAX_LANGUAGES * BUCKETS * 4 bytes.
    """
    plain = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in plain], F.col(f"`{text_col}`").alias(name))

    def run(batches):
        for batch in batches:
            predicted = shared.value.predict(batch[name].to_pylist())
            arrays = [batch[c] for c in plain]
            arrays.append(pa.array([p[0] for p in predicted], pa.string()))
            arrays.append(pa.array([p[1] for p in predicted], pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, [*plain, "lang_pred", "score"])

    schema = docs.select(*[F.col(f"`{c}`") for c in plain]).schema
    return source.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that a model may learn from: crc32 of the id as text, mod 3, is not 1."""
    return docs.where(F.crc32(F.col(id_col).cast("string")) % 3 != 1)


def calibration_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled documents that no model learns from."""
    return docs.where((F.crc32(F.col(id_col).cast("string")) % 3 == 1) & F.col("lang").isNotNull())


#: Of the labelled rows that a model gets right, the share that its least score may refuse.
REFUSED = 0.001
#: The highest least score: a language with more than half of the posterior is known.
SURE = 0.5


def least_score(labelled: DataFrame, model: LanguageModel, refused: float = REFUSED, text_col: str = "text", lang_col: str = "lang") -> float:
    """The score that all but ``refused`` of the labelled rows reach whose language the model gets
    right, at most SURE; 0 where it gets none right. All rows given are scored, one quantile of
    their scores is taken (``approx_percentile``, bounded memory)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    scored = identify_language(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), model, keep=["lang"])
    right = scored.where("lang = lang_pred")
    found = right.agg(F.percentile_approx("score", refused, 100_000)).first()[0]
    return 0.0 if found is None else min(SURE, float(found))


def keep_known_language(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """The rows whose language is known with a posterior of at least ``min_score``, with their own
    columns and values, whatever they are called.

    By default the least score is calibrated (``least_score``) on labelled rows that the model has
    not learned from, those that ``training_rows`` leaves out. Null texts and texts without a letter
    have no known language and go. Where no training row has a language there is no model to
    reject by: every row stays. Repeated rows are judged each; an empty table stays empty.
    """
    model = fit_language_model(training_rows(docs))
    if not model.languages:
        return docs
    if min_score is None:
        min_score = least_score(calibration_rows(docs), model)
    renamed, called = set_aside(docs, ["lang_pred", "score"])
    judged = identify_language(renamed, model)
    return put_back(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), called)
