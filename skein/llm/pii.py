"""Personal data: candidate spans, judged by gradient-boosted trees with calibrated thresholds."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.boosting import BoostedTrees
from skein.llm.common import fresh_name

KINDS = ("email", "ip", "card", "phone")
#: Rows that the driver gets to take contexts from, and the characters around a place in them.
SAMPLE_ROWS, CONTEXT = 256, 24
#: Share of right spans among those selected on held-out examples, at each kind's threshold.
PRECISION = 0.995

# fixed values: the base formats
LOCAL, DOMAIN = "A-Za-z0-9._%+-", re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(f"[{LOCAL}]+\\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGIT = re.compile(r"[0-9]")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the checksum of payment cards."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[Span]:
    """Leftmost matches: each has one ``@``, so the ``@`` are looked up and extended both ways."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at and (found := DOMAIN.match(text, at + 1)):
            end = found.end()
            out.append(("email", begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The base formats, leftmost and non-overlapping within a kind; failing matches are dropped."""
    out = emails(text)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".") if len(p) < 10) and not any(
            len(p.lstrip("0")) > 3 for p in m.group().split(".")
        ):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# High recall: forms that people write besides the base ones, and much that is none.
CANDIDATES = (
    (
        "email",
        re.compile(
            rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\s?(?:@|[(\[{{<]\s?(?:at|AT|@)\s?[)\]}}>])\s?[A-Za-z0-9-]{{1,63}}+"
            r"(?:\s?(?:\.|[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>])\s?[A-Za-z0-9-]{1,63}+)+"
        ),
    ),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}+){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[\x20.·_/-]?){3}[0-9]{4}(?:[0-9]{1,3})?(?![0-9])")),
    (
        "phone",
        re.compile(
            r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,5}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])"
            r"|(?<![0-9.+(])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3,5}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9.])"
        ),
    ),
)
#: Runs of digits of a length that candidates have, and what marks an address.
CANDIDATE_MARKS = re.compile(r"[0-9][0-9 ().+-]{6,}[0-9]|\S*@\S*")
MARKED = re.compile(r"@|[(\[{<]\s?(?:at|AT)\b")
CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write|mailto|correo|schreib"),
    "ip": re.compile(r"(?i)\bip\b|addr|host|server|client|login"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|tarjeta|karte|carte|pay"),
    "phone": re.compile(r"(?i)phone|\btel|call|fax|mobile|cell|movil|handy|whatsapp"),
}
COUNTER = re.compile(r"(?i)version|\bv\.?$|order|invoice|isbn|serial|\bid\b|section|chapter|\bno\b|date|page")


def candidates(text: str) -> list[Span]:
    """Overlapping candidate spans of every generator; texts without digits or ``@`` are skipped."""
    written = MARKED.search(text) is not None
    numbers = DIGIT.search(text) is not None
    return [
        (kind, *m.span())
        for kind, pattern in CANDIDATES
        if (written if kind == "email" else numbers)
        for m in pattern.finditer(text)
    ]


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and what stands around it."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, groups = digits_of(body), [len(g) for g in re.findall(r"[0-9]+", body)]
    parts = [int(g) for g in re.findall(r"[0-9]+", body) if len(g) < 5]
    return [
        *[float(kind == k) for k in KINDS],
        len(body),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        max(parts, default=0),
        float(len(digits) > 1 and luhn(digits)),
        body.count(" "),
        body.count("-"),
        body.count("."),
        float("(" in body),
        float("[" in body),
        float(body[:1] == "+" or body[:2] == "00"),
        float("@" in body),
        len(body) - body.rfind(".") - 1 if "." in body else 99,
        len(set(digits)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in ("$", "€", "#", "/", "=")),
        float(bool(CUES[kind].search(before))),
        float(bool(COUNTER.search(before))),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
    ]


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind as listed, then start.

        Added spans reach their kind's threshold; of overlapping ones the most probable stays,
        and none overlaps a base span.
        """
        text = text or ""
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        proposed = [c for c in candidates(text) if free(c, taken)]
        chosen: list[Span] = []
        if proposed:
            scores = self.trees.predict(np.array([features(text, c) for c in proposed]))
            for i in np.argsort(-scores, kind="stable"):
                kind, start, end = proposed[i]
                if scores[i] >= self.thresholds[kind] and free(proposed[i], taken):
                    chosen.append(proposed[i])
                    taken.insert(bisect_left(taken, (start, end)), (start, end))
        order = {k: i for i, k in enumerate(KINDS)}
        key = lambda s: (order[s[0]], s[1])
        return sorted(base, key=key), sorted(base + chosen, key=key)


def free(span: Span, taken: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps none of the sorted, disjoint ones."""
    at = bisect_left(taken, (span[1], span[2]))
    return (at == len(taken) or taken[at][0] >= span[2]) and (at == 0 or taken[at - 1][1] <= span[1])


class Examples:
    """Labelled examples: written forms of each kind and look-alikes, in contexts from the corpus."""

    def __init__(self, contexts: list[str], seed: int = 7):
        self.rng = np.random.default_rng(seed)
        # what a text holds itself would be labelled wrong: its own candidates are cut out
        cleared = [CANDIDATE_MARKS.sub(" ", c) for c in contexts]
        self.contexts = [c for c in cleared if c.strip()] or ["plain words stand around it here"]

    def number(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def pick(self, *choices: str) -> str:
        return choices[int(self.rng.integers(len(choices)))]

    def card(self, valid: bool, n: int = 16) -> str:
        head = self.pick("4", "5", "37", "6011", "35", "9", "7")
        body = (head + self.number(n))[: n - 1]
        check = next(str(d) for d in range(10) if luhn(body + str(d)))
        last = check if valid else str((int(check) + int(self.rng.integers(1, 10))) % 10)
        digits = body + last
        gap = self.pick(".", "_", "/", " ", "-", "")
        return gap.join(digits[i : i + 4] for i in range(0, n, 4))

    def word(self) -> str:
        context = self.contexts[int(self.rng.integers(len(self.contexts)))]
        return self.pick(*(re.findall(r"[a-z]{2,9}", context) or ["word"]))

    def positive(self, kind: str) -> str:
        if kind == "email":
            at = self.pick(" (at) ", "[at]", " [at] ", "(at)", "@", " @ ")
            dot = self.pick(" (dot) ", "[dot]", ".", " [dot] ")
            return self.word() + self.pick(".", "_", "") + self.word() + at + self.word() + dot + self.pick("com", "org", "net", "de", "io")
        if kind == "ip":
            dot = self.pick("[.]", "(.)", ".", " . ")
            return dot.join(str(x) for x in self.rng.integers(0, 256, 4))
        if kind == "card":
            return self.card(True, int(self.rng.choice([16, 16, 16, 19])))
        a, b, c = self.number(3), self.number(3), self.number(4)
        gap = self.pick("-", ".", " ")
        return self.pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{self.number(2)} {a} {b} {c}", f"+{self.number(2)} ({a}) {b}-{c} {self.number(3)}", f"{a}{gap}{b}{gap}{c}")

    def negative(self, kind: str) -> str:
        if kind == "email":
            return self.pick("", "go ") + self.word() + self.pick(" @ ", "@", " [at] ") + self.number(2) + "." + self.number(2)
        if kind == "ip":
            parts = self.rng.integers(0, 999, 4)
            parts[int(self.rng.integers(4))] = self.rng.integers(256, 1000)
            return ".".join(map(str, parts))
        if kind == "card":
            return self.card(False, int(self.rng.choice([16, 16, 17, 19])))
        a, b = self.number(4), self.number(3)
        return self.pick(f"{a} {b} {self.number(3)}", f"{self.number(5)}.{b}.{self.number(3)}", f"{a}/{b} {a}", f"{a}. {b} {self.number(4)}")

    def sample(self, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        while len(y) < n:
            kind, good = self.pick(*KINDS), bool(self.rng.integers(2))
            body = self.positive(kind) if good else self.negative(kind)
            context = self.contexts[int(self.rng.integers(len(self.contexts)))]
            at = int(self.rng.integers(len(context)))
            cue = self.pick("", "", "", "Tel: ", "mail ", "IP ", "card ", "phone ") if good else self.pick("", "", "", "version ", "order ", "id ", "No ")
            text = f"{context[:at]} {cue}{body}{self.pick(' ', '.', ',', ' ')} {context[at:]}"
            start = at + 1 + len(cue)
            for span in candidates(text):
                if span[1] < start + len(body) and span[2] > start:
                    whole = span[2] - start - len(body)  # a number may follow a written-out one
                    right = good and span[0] == kind and abs(span[1] - start) <= 1
                    right = right and (abs(whole) <= 1 or (body[0] == "+" and whole == -4))
                    x.append(features(text, span))
                    y.append(right)
                    kinds.append(span[0])
        return np.array(x), np.array(y, float), kinds


def fit_pii_model(docs: DataFrame, text_col: str = "text", examples: int = 6000) -> PiiModel:
    """Trees fitted to generated examples in contexts of at most SAMPLE_ROWS different texts of
    ``docs``, the least by hash, each from a place in the text that its hash chooses.

    Each kind's threshold is the lowest at which held-out examples reach PRECISION; a kind that
    never does selects nothing. Same rows, same model.
    """
    text = F.col(text_col)
    h = F.xxhash64(text)
    room = F.greatest(F.length(text) - 4 * CONTEXT, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64(text, F.lit(1)), room) + 1).cast("int")
    rows = (
        docs.where(text.isNotNull())
        .select(h.alias("h"), F.substr(text, place, F.lit(4 * CONTEXT)).alias("t"))
        .distinct()  # copies of a text count once
        .orderBy("h", "t")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    maker = Examples([r.t for r in rows])
    x, y, _ = maker.sample(examples)
    trees = BoostedTrees().fit(x, y)
    held_x, held_y, kinds = maker.sample(examples // 2)
    scores, of = trees.predict(held_x), np.array(kinds)
    thresholds = {}
    for kind in KINDS:
        own = np.flatnonzero(of == kind)
        order = own[np.argsort(-scores[own], kind="stable")]
        precision = np.cumsum(held_y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        thresholds[kind] = float(max(0.5, scores[order[good[-1]]])) if len(good) else 2.0
    return PiiModel(trees, thresholds)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
SPANS_SQL = "array<struct<kind:string,s:int,e:int>>"


def find_pii(
    docs: DataFrame,
    model: PiiModel,
    text_col: str = "text",
    redact: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with their columns (or those in ``keep``), base_spans and pii_spans
    (kind, start, end in code points, end exclusive; by kind as listed, then start), and with
    ``redact`` the text with every span replaced by its kind in brackets, as redacted.

    Null and empty texts have no spans. Texts are searched whole, repeated rows each. Columns
    named like the added ones are replaced.
    """
    added = ["base_spans", "pii_spans", *(["redacted"] if redact else [])]
    plain = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in plain], F.col(f"`{text_col}`").alias(name))

    def run(batches):
        for batch in batches:
            texts = batch[name].to_pylist()
            found = [shared.value.spans(t) for t in texts]
            arrays = [batch[c] for c in plain]
            for k in (0, 1):
                rows = [[{"kind": a, "s": s, "e": e} for a, s, e in f[k]] for f in found]
                arrays.append(pa.array(rows, SPANS))
            if redact:
                cut = [redacted(t, f[1]) for t, f in zip(texts, found, strict=True)]
                arrays.append(pa.array(cut, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*plain, *added])

    fields = [f for c in plain for f in docs.schema.fields if f.name == c]
    kinds = [SPANS_SQL, SPANS_SQL, "string"]
    schema = T.StructType(fields)
    for column, kind in zip(added, kinds, strict=False):
        schema = schema.add(column, T.DataType.fromDDL(kind))
    return source.mapInArrow(run, schema)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with its spans replaced; where spans of two kinds overlap the first stands."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
