from __future__ import annotations

import hashlib
import random
import re

from clientlens.llm import pii


def plain(text):
    """Base spans by regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def base(spans):
    return [s for s in spans if s[0] in pii.BASE_KINDS]


BITS = ["a", "@", ".", "1", "25", "0", "+", "-", " ", "(", "é", "b.c", "4111 1111 1111 1111", "4539-5787-6362-1486", "@x.y", "+1 (", "192.168", "_", "300"]


def test_base_spans_equal_regular_expressions():
    rng, anchors = random.Random(5), pii.automaton()
    for _ in range(20_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))
        assert base(pii.scan(text, anchors)) == plain(text), text


def test_more_spans():
    text = 'see https://a.b/c?d. password=b7db7aa4a5fcc78305, IBAN: DE89370400440532013000 or account no'
    found = {(k, text[a:b]) for k, a, b in pii.scan(text, pii.automaton())}
    assert {("url", "https://a.b/c?d"), ("secret", "b7db7aa4a5fcc78305"), ("account", "DE89370400440532013000")} <= found
    assert not {k for k, _ in found} - {"url", "secret", "account", "card"}


def test_awkward_rows(table, awkward, empty):
    rows = [(1, "x a@b.co 😀 +1 (425) 555-0735"), (2, None), (3, "1.2.3.4 " * 20_000)]
    for docs in (table("doc_id long, text string", rows, ("personal", "spans")), awkward):
        for r in pii.find_personal_data(docs).select("text", "personal.*").collect():
            want = plain(r.text or "")
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
    assert pii.find_personal_data(empty).collect() == []


def test_usual_spellings_of_accounts_and_secrets():
    for text, kind, value in (
        ("Account number: 12345678", "account", "12345678"),
        ("account no. 12345678 is closed", "account", "12345678"),
        ("IBAN: DE89 3704 0044 0532 0130 00, please", "account", "DE89 3704 0044 0532 0130 00"),
        ("IBAN is GB82 WEST 1234 5698 7654 32 and more", "account", "GB82 WEST 1234 5698 7654 32"),
        ("API key: a8f5f167f44f4964e6c9", "secret", "a8f5f167f44f4964e6c9"),
        ("password is b7db7aa4a5fcc78305", "secret", "b7db7aa4a5fcc78305"),
        ("password: correcthorsebattery", "secret", "correcthorsebattery"),
    ):
        found = [(k, text[a:b]) for k, a, b in pii.scan(text, pii.automaton()) if k in ("account", "secret")]
        assert found == [(kind, value)], text
    for text in ("IBAN: DE88 3704 0044 0532 0130 00", "the secret organisation", "account no", "account number"):
        assert not [k for k, *_ in pii.scan(text, pii.automaton()) if k in ("account", "secret")], text


def test_counts_are_those_of_the_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in pii.find_personal_data(docs).select("personal.*").collect():
        kinds = [x.split(":")[0] for x in r.spans.split(",")] if r.spans else []
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS] and r.n_spans == len(kinds)


def test_a_column_of_the_results_name_is_replaced(spark):
    docs = spark.createDataFrame([("a@b.co", "mine")], "text string, personal string")
    assert pii.find_personal_data(docs).select("personal.n_email").first()[0] == 1
    assert tuple(pii.find_personal_data(docs, as_col="found").select("personal", "found.n_email").first()) == ("mine", 1)
