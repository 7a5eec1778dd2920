"""Spans that the trees add or refuse, on forms written by hand and not by the examples' generator."""

import pytest

from skein.llm.pii import base_spans, fit_pii_model, redacted
from tests.conftest import SMALL

PLANTED = {
    "email": [
        ("write to john.doe (at) mail (dot) org today", "john.doe (at) mail (dot) org"),
        ("contact: ana_b [at] firma.de", "ana_b [at] firma.de"),
        ("reach me at kim {at} uni {dot} edu, thanks", "kim {at} uni {dot} edu"),
        ("peter@ example.com", "peter@ example.com"),
        ("sue <at> shop <dot> net", "sue <at> shop <dot> net"),
    ],
    "ip": [
        ("host 10[.]0[.]0[.]17 was down", "10[.]0[.]0[.]17"),
        ("server at 192(.)168(.)1(.)44", "192(.)168(.)1(.)44"),
        ("from 172 .16 .254 .1 came", "172 .16 .254 .1"),
        ("blocked 8[.]8[.]4[.]4.", "8[.]8[.]4[.]4"),
    ],
    "card": [
        ("paid with 4111.1111.1111.1111 on", "4111.1111.1111.1111"),
        ("card 5500/0000/0000/0004 used", "5500/0000/0000/0004"),
        ("visa 4012_8888_8888_1881 ok", "4012_8888_8888_1881"),
        ("karte: 4111·1111·1111·1111", "4111·1111·1111·1111"),
    ],
    "phone": [
        ("call (212) 555-0187 now", "(212) 555-0187"),
        ("tel 0049 171 555 0123", "0049 171 555 0123"),
        ("phone: 415-555-0132.", "415-555-0132"),
        ("reach us at 030/555 0199", "030/555 0199"),
        ("fax 212.555.0187 please", "212.555.0187"),
    ],
}
REFUSED = [
    "version 1.2.3.400 of it", "id 4111.1111.1111.1112 only", "order 1234 567 890 came", "see section 10.2.300.4",
    "go team @ 12.30", "ISBN 978-3-16-148410-0", "in 2019 10 000 people", "the ratio 3.14.15.9265", "page 123-456, 2019",
    "between 1990-2000 and 2001", "price 1.250.000 euro", "a (at) the door",
]


@pytest.fixture(scope="module")
def model(spark):
    return fit_pii_model(spark.read.parquet(f"{SMALL}/documents.parquet"))


@pytest.mark.parametrize("kind", sorted(PLANTED))
def test_recall_of_planted_forms(model, kind):
    """At least three of a kind's four or five, and none of them is a base span."""
    found = 0
    for text, form in PLANTED[kind]:
        assert not base_spans(text)
        start = text.index(form)
        found += any(k == kind and abs(s - start) <= 1 and abs(e - start - len(form)) <= 1 for k, s, e in model.spans(text)[1])
    assert found >= 3


def test_look_alikes_are_refused(model):
    added = [t for t in REFUSED if model.spans(t)[1]]
    assert len(added) <= 1


def test_added_spans_are_redacted(model):
    text = "Mail a.b@c.org or john.doe (at) mail (dot) org."
    base, spans = model.spans(text)
    assert [s[0] for s in base] == ["email"] and len(spans) == 2
    assert redacted(text, spans) == "Mail [EMAIL] or [EMAIL]."
