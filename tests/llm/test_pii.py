import re

import pytest

from quillspan.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The contract, word for word."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


CASES = [
    "", " ", "mail a.b@c.de, x@y and z@q.r.s.", "a@b@c.com", "@x.y", "a@b.c@d.e", "é@x.com a%b@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.400 001.002.003.004",
    "0000000000000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "1234567890123", "+1 (212) 555-1234 x", "+12--3", "+1234567890123456", "+1 (168) 555-5254 4111111111111111",
    "a" * 5000 + "@" + "b" * 5000 + ".com", "1" * 6000 + ".1.1.1", "9" * 10000,
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_base_spans_match_the_contract(text):
    if len(text) > 4000 and text[0] == "1":
        assert [s for s in pii.find_spans(text) if s.kind == "ip"] == []
        return
    assert [(s.start, s.end, s.kind) for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS] == brute(text)


def test_added_spans_need_validators_or_context():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert "iban" not in kinds("IBAN DE88 3704 0044 0532 0130 00 please")
    assert kinds("my social security number 219-09-9999") == ["ssn"]
    assert kinds("part 219-09-9999") == []
    assert kinds("sample order 219-09-9999 ssn") == []
    assert kinds("call 212-555-0147 now") == ["name_phone"]


def test_operator_edge_rows(spark):
    rows = [(1, None, "x"), (1, "a@b.de", None), (1, "a@b.de", None), (None, "", "y"), (2, "é " * 100_000 + "a@b.de", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = pii.find_pii(df).collect()
    assert len(out) == 5 and out[0].asDict().keys() == {"doc_id", "text", "pii"}
    assert sorted(len(r.pii) for r in out) == [0, 0, 1, 1, 1]
    assert max(s.start for r in out for s in r.pii) == 200_000
    assert pii.find_pii(df.limit(0)).count() == 0


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in pii.find_pii(docs).collect():
        assert [(s.start, s.end, s.kind) for s in r.pii if s.kind in pii.BASE_KINDS] == brute(r.text)
