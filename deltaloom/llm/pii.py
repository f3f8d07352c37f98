"""Personal data replaced by format-preserving pseudonyms from keyed Feistel permutations.

Numbers and dates that pass their check - Luhn for cards, mod 97 for IBANs, octets for IP addresses, the
numbering plan for telephone numbers, area rules for social security numbers, the calendar for dates - are
permuted within their format under a key: digits stay digits, separators stay where they are, the checks
hold again, and a number's kind can still be told. Mail addresses are permuted letter for letter class by
class. The permutation depends on the key and the kind alone, so equal values stay equal, and linked, in all
documents, and the key's holder can undo it.

A permutation of n values is a balanced Feistel network over the next square of two powers, walked along its
cycle until it is below n. Rounds are keyed BLAKE2b.

Defined results: a null text stays null; numbers that fail their check, or have other than ASCII digits, stay as they are; where kinds
overlap the earlier one of KINDS wins; repeated rows stay rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import heapq
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import map_rows

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 8


@functools.lru_cache(maxsize=65_536)
def _round(key: bytes, tag: str, i: int, half: int, bits: int) -> int:
    data = f"{tag}|{i}|{bits}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=32).digest(), "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, tag: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 (its inverse with back)."""
    if size < 2:
        return value
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    tag = f"{tag}/{size}"
    while True:
        left, right = value >> bits, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _round(key, tag, i, left, bits), left
            else:
                left, right = right, left ^ _round(key, tag, i, right, bits)
        value = left << bits | right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _refill(shape: str, chars: str) -> str:
    """The shape with its letters and digits replaced, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(text: str, key: bytes, back: bool) -> str | None:
    """The leading digit, which tells the network, and the length stay; the check digit is computed."""
    digits = "".join(c for c in text if c.isdigit())
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    inner = len(digits) - 2
    body = permute(int(digits[1:-1]), 10**inner, key, f"card{digits[0]}", back)
    head = f"{digits[0]}{body:0{inner}d}"
    return _refill(text, head + next(str(d) for d in range(10) if luhn(head + str(d))))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    sizes = [10 if c.isdigit() else 26 for c in body]
    new = _digits_in(body, sizes, key, f"iban{plain[:2]}", back)
    check = 98 - number(new + plain[:2] + "00") % 97
    return _refill(text, f"{plain[:2]}{check:02d}{new}")


def _digits_in(body: str, sizes: list[int], key: bytes, tag: str, back: bool) -> str:
    """Letters (either case) and digits permuted together, each within its class."""
    value, total = 0, 1
    for c, n in zip(body, sizes, strict=True):
        value, total = value * n + (int(c) if n == 10 else ord(c.lower()) - 97), total * n
    classes = "".join("9" if n == 10 else "A" if c.isupper() else "a" for c, n in zip(body, sizes, strict=True))
    value = permute(value, total, key, f"{tag}{classes}", back)
    out = []
    for c, n in zip(reversed(body), reversed(sizes), strict=True):
        value, d = divmod(value, n)
        out.append(str(d) if n == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """Area code [2-9]dd, exchange [2-9]dd, four digits; other digits are a number only after a country code,
    which stays, and are permuted among themselves."""
    digits = "".join(c for c in text if c.isdigit())
    own = digits[-10:]
    if len(digits) not in (10, 11) or len(digits) == 11 and digits[0] != "1":
        return None
    planned = lambda d: d[0] not in "01" and d[3] not in "01"
    if planned(own):
        value = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 8_000_000 + (int(own[3]) - 2) * 1_000_000 + int(own[4:])
        a, b = divmod(permute(value, 800 * 8_000_000, key, "phone", back), 8_000_000)
        return _refill(text, f"{digits[:-10]}{a + 200}{b + 2_000_000}")
    if not text.startswith("+"):
        return None
    while True:
        own = f"{permute(int(own), 10**10, key, 'phone-other', back):010d}"
        if not planned(own):
            return _refill(text, digits[:-10] + own)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = area - 1 - (area > 666)
    rest, s = divmod(permute((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back), 9999)
    a, g = divmod(rest, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


#: What an octet can be, by how it is written: its width and whether zeros lead.
OCTETS = {(1, False): (0, 10), (2, False): (10, 90), (3, False): (100, 156), (2, True): (0, 10), (3, True): (0, 100)}


def _ip(text: str, key: bytes, back: bool) -> str | None:
    """Each octet keeps its width and its leading zeros or their absence, so the dots stay where they are;
    all four are permuted together among the addresses written alike."""
    parts = text.split(".")
    if any(int(p) > 255 for p in parts):
        return None
    shape = [(len(p), len(p) > 1 and p[0] == "0") for p in parts]
    value, total = 0, 1
    for p, s in zip(parts, shape, strict=True):
        low, n = OCTETS[s]
        value, total = value * n + int(p) - low, total * n
    value = permute(value, total, key, "ip" + "".join(f"{w}{'z' * zeros}" for w, zeros in shape), back)
    out = []
    for s in reversed(shape):
        low, n = OCTETS[s]
        value, d = divmod(value, n)
        out.append(f"{d + low:0{s[0]}d}")
    return ".".join(reversed(out))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Days from 1900 to 2099, written in the order the text has: year first, or day or month first as the
    value allows (day first where both do)."""
    sep = next(c for c in text if not c.isdigit())
    a, b, c = text.split(sep)
    order = "ymd" if len(a) == 4 else "dmy" if int(b) <= 12 else "mdy"
    y, m, d = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order]
    if not 1900 <= int(y) <= 2099 or not 1 <= int(m) <= 12 or not 1 <= int(d) <= calendar.monthrange(int(y), int(m))[1]:
        return None
    size = LAST_DAY - FIRST_DAY + 1
    day = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    if order == "ymd":
        new = datetime.date.fromordinal(permute(day, size, key, "date", back) + FIRST_DAY)
        return f"{new:%Y}{sep}{new:%m}{sep}{new:%d}"
    # The order of day and month must be read back alike: month-first dates are those with days over 12.
    while True:
        day = permute(day, size, key, "date", back)
        new = datetime.date.fromordinal(day + FIRST_DAY)
        if order == "dmy" or new.day > 12:
            break
    y, m, d = f"{new:%Y}", f"{new:%m}", f"{new:%d}"
    return sep.join((d, m, y) if order == "dmy" else (m, d, y))


def _email(text: str, key: bytes, back: bool) -> str | None:
    """Letters and digits before the top-level domain are permuted within their classes."""
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    out = []
    for tag, part in (("local", local), ("domain", name)):
        own = "".join(c for c in part if c.isascii() and c.isalnum())
        new = iter(_digits_in(own, [10 if c.isdigit() else 26 for c in own], key, f"email-{tag}", back) if own else "")
        out.append("".join(next(new) if c.isascii() and c.isalnum() else c for c in part))
    return f"{out[0]}@{out[1]}.{top}"


WORK: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}
#: Each kind's shape; what must hold beyond it is checked by its function.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9(+])(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
}
#: Every shape has an @ or a digit: texts without either are passed over.
HINTS = "0123456789@"
EMAIL = regex.compile(SHAPES["email"])
NUMERIC = [(k, regex.compile(SHAPES[k])) for k in KINDS if k != "email"]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what passes its check, in order, without overlaps."""
    spans: list[tuple[int, int, str]] = []
    patterns = [("email", EMAIL)] * ("@" in text) + NUMERIC
    for kind, pattern in patterns:
        own = []
        at = 0  # the first span that ends after the match begins; both go through the text in order
        for m in pattern.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if (at == len(spans) or m.end() <= spans[at][0]) and WORK[kind](m.group(), b"check", False) is not None:
                own.append((m.start(), m.end(), kind))
        spans = list(heapq.merge(spans, own))
    return spans


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms (values again with back), and the spans in it that were replaced."""
    if not any(c in text for c in HINTS):
        return text, []
    out, spans, at = [], find(text), 0
    for s, e, kind in spans:
        out += [text[at:s], WORK[kind](text[s:e], key, back)]
        at = e
    return "".join([*out, text[at:]]), spans


def pseudonymize_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, text, n_<kind>...): whole texts with pseudonyms and how many of each kind they have."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], {k: [] for k in KINDS}
        for text in batch.column(1).to_pylist():
            new, spans = pseudonymize(text, key, back) if text else (text, [])
            texts.append(new)
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in spans))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int32()) for c in counts.values())], ["id", "text", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
