"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and identifier cues. From each
anchor a small deterministic parser expands to both sides and validates what it got. No text is searched by any other means.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import in_small_batches, pieces, valid

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")  # of an e-mail address, before the sign
LABEL = LETTERS | DIGITS | frozenset("-")  # of a domain name
PHONE = DIGITS | frozenset(" ().-")
SCHEME = LETTERS | DIGITS | frozenset("+.-")
URL_END = frozenset(" \t\r\n\v\f<>\"'`{}|\\^")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret", "url")

# Words before which an account number or a secret is likely.
CUES = {
    "account": ("account", "acct", "iban", "passport", "ssn"),
    "secret": ("api_key", "api-key", "api key", "apikey", "password", "secret", "token"),
}
GAP = frozenset(" \t:=#\"'.")  # between a cue and its value
GAP_MOST = 6
JOINING = frozenset(("number", "no", "nr", "num", "is", "key"))  # words that may stand there, too
JOINING_MOST = 3
IBAN_LENGTHS = range(15, 35)
VALUE = LETTERS | DIGITS | frozenset("-_")
ACCOUNT_DIGITS, SECRET_LENGTH = 6, 12  # a value with fewer is none

RESULT = f"struct<{','.join(f'n_{kind}:long' for kind in KINDS)},n_spans:long,base_sha256:string,spans:string>"


def run(text: str, at: int, allowed: frozenset) -> int:
    """The end of the characters from `at` on that are all allowed."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the sign at `at`; nothing before `floor` belongs to it."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (next_end := run(text, end + 1, LABEL)) > end + 1:
        end, labels = next_end, labels + 1
    return (start, end) if labels > 1 else None


def address(text: str, at: int) -> tuple[int, bool]:
    """The end of four dotted numbers from `at` on and whether there are four; else the end of the first number."""
    first = end = run(text, at, DIGITS)
    for _ in range(3):
        if not (end < len(text) and text[end] == "." and (next_end := run(text, end + 1, DIGITS)) > end + 1):
            return first, False
        end = next_end
    return end, True


def is_address(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in value.split("."))


def digit_chain(text: str, at: int) -> int:
    """The end of digits from `at` on with at most one space or hyphen between two."""
    n = len(text)
    while True:
        at += 1
        if at < n and text[at] in DIGITS:
            continue
        if at + 1 < n and text[at] in " -" and text[at + 1] in DIGITS:
            at += 1
            continue
        return at


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def phone(text: str, at: int) -> int | None:
    """The end of what can be a phone number from the plus sign at `at` on."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def url(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the `://` at `at`."""
    start = at
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    end, n = at + 3, len(text)
    while end < n and text[end] not in URL_END:
        end += 1
    while end > at + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end) if start < at and end > at + 3 else None


def value_after(text: str, at: int) -> tuple[int, int]:
    """The value that follows a cue which ends before `at`, behind words that join the two."""
    for joining in range(JOINING_MOST + 1):
        start = at
        while start < min(len(text), at + GAP_MOST) and text[start] in GAP:
            start += 1
        if start == at:
            return at, at
        at = run(text, start, LETTERS)
        if joining == JOINING_MOST or text[start:at].lower() not in JOINING or text[at : at + 1] not in GAP:
            break
    return start, run(text, start, VALUE)


def iban(text: str, start: int) -> int | None:
    """The end of the longest valid IBAN from `start` on, with at most one space between two characters."""
    if not (text[start : start + 2].isalpha() and set(text[start + 2 : start + 4]) <= DIGITS):
        return None
    at, found, chars = start, None, ""
    while at < len(text) and len(chars) < IBAN_LENGTHS[-1]:
        if text[at] == " " and text[at - 1] != " ":
            at += 1
            continue
        if text[at] not in LETTERS and text[at] not in DIGITS:
            break
        chars, at = chars + text[at].upper(), at + 1
        if len(chars) in IBAN_LENGTHS and text[at : at + 1] not in VALUE:
            if int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
                found = at
    return found


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for key, kind in (("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in sorted(DIGITS))):
        a.add_word(key, (kind, len(key)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper(), cue.replace("api", "API")}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def scan(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text, by kind and start. Spans of one kind do not overlap."""
    text = text or ""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the search of each kind goes on
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= past["card"]:
                end = digit_chain(text, at)
                past["card"] = end
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append((at, end))
            if at >= past["ip"]:
                past["ip"], whole = address(text, at)
                if whole and is_address(text[at : past["ip"]]):
                    spans["ip"].append((at, past["ip"]))
        elif kind == "at":
            if found := email(text, at, past["email"]):
                spans["email"].append(found)
                past["email"] = found[1]
        elif kind == "plus":
            if at >= past["phone"] and (end := phone(text, at)):
                past["phone"] = end
                if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    spans["phone"].append((at, end))
        elif kind == "scheme":
            if at >= past["url"] and (found := url(text, at, past["url"])):
                spans["url"].append(found)
                past["url"] = found[1]
        else:
            start, end = value_after(text, last + 1)
            if start < past[kind]:
                continue
            value = text[start:end]
            if kind == "account":
                whole = iban(text, start)
                end = whole or end
                # What is called an IBAN must be one.
                valid = whole or (text[at : last + 1].lower() != "iban" and sum(c in DIGITS for c in value) >= ACCOUNT_DIGITS)
            else:
                told = any(c in ":=" for c in text[last + 1 : start])
                valid = len(value) >= SECRET_LENGTH and (told or any(c in DIGITS for c in value))
            if valid:
                spans[kind].append((start, end))
                past[kind] = end
    return [(kind, *span) for kind in KINDS for span in spans[kind]]


def find_personal_data(docs: DataFrame, text_col: str = "text", as_col: str = "personal") -> DataFrame:
    """The documents with one more column, `as_col`, of type `RESULT`.

    n_email, n_ip, n_card, n_phone, n_account, n_secret, n_url: how many of each, n_spans of all. spans: all, as kind:start:end by kind,
    then start, joined by commas; positions count code points, ends are exclusive. base_sha256: of the same string of the first four kinds alone.
    Beyond these the method marks account numbers and secrets after their cues, and URLs. A null text is an empty one. Texts of any length are
    scanned whole, each row by itself, repeated ones too; malformed UTF-8 is read with replacement characters. An empty table gives no rows. A column that is called `as_col` is replaced.
    """
    kind = pa.struct([(f"n_{k}", pa.int64()) for k in (*KINDS, "spans")] + [("base_sha256", pa.string()), ("spans", pa.string())])

    def row(text: str | None, anchors: ahocorasick.Automaton) -> dict:
        spans = scan(text, anchors)
        base = [s for s in spans if s[0] in BASE_KINDS]
        joined = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
        return {f"n_{k}": sum(s[0] == k for s in spans) for k in KINDS} | {
            "n_spans": len(spans),
            "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
            "spans": joined(spans),
        }

    @F.arrow_udf(RESULT)
    def personal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        for batch in batches:
            yield pa.array([row(text, anchors) for texts in pieces(batch) for text in texts], kind)

    return in_small_batches(docs).withColumn(as_col, personal(valid(F.col(text_col))))
