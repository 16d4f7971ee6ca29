"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their checks (card numbers by their check digit, bank accounts by
their remainder, calendar dates in digits or words, addresses of both versions, phone numbers by
their country code) are permuted within their format by a keyed
Feistel network, so a pseudonym passes the same checks and equal values stay equal in all
documents. Values whose permutation isn't valid are permuted again until it is, which keeps the
mapping one to one. Names of mail addresses and secrets are permuted in the same way over their
letters and digits.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
import string
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import sliced

ROUNDS = 8


def feistel(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of the numbers below ``left * right``.

    The halves are added to in turn, modulo their own sizes, by a hash of the other half; every
    round can be undone, so the whole is one to one.
    """
    a, b = divmod(value, right)
    for i in range(ROUNDS):
        x = _hash(b"%d|%d|%d|%d|" % (i, left, right, a if i % 2 else b) + tweak, key, left * right)
        if i % 2 == 0:
            a = (a + x) % left
        else:
            b = (b + x) % right
    return a * right + b


def _hash(data: bytes, key: bytes, bound: int) -> int:
    """A number with 64 bits more than the bound has."""
    size, out = bound.bit_length() // 8 + 9, b""
    while len(out) < size:
        out += blake2b(data + out[-64:], key=key).digest()
    return int.from_bytes(out[:size], "big")


def permuted(value: int, left: int, right: int, key: bytes, tweak: bytes, valid=None) -> int:
    """``feistel`` walked on until the result is valid; the first value must be."""
    while True:
        value = feistel(value, left, right, key, tweak)
        if valid is None or valid(value):
            return value


ASCII = {"0": string.digits, "a": string.ascii_lowercase, "A": string.ascii_uppercase}
# and the accented letters of western Europe, U+00C0 to U+00FF without the two signs among them
LATIN = ASCII | {"\u00e0": "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
                 "\u00c0": "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)}


def permuted_chars(text: str, key: bytes, tweak: bytes, alphabets: dict[str, str] = ASCII) -> str:
    """Letters stay letters of their case and digits stay digits; what is in no alphabet stays."""
    kinds = [next((k for k in alphabets.values() if c in k), "") for c in text]
    places = [i for i, k in enumerate(kinds) if k]
    if not places:
        return text
    sizes = [len(kinds[i]) for i in places]
    middle = len(places) // 2
    value, left, right = 0, 1, 1
    for n, (i, size) in enumerate(zip(places, sizes)):
        value = value * size + kinds[i].index(text[i])
        left, right = (left * size, right) if n < middle else (left, right * size)
    marks = {k: mark for mark, k in alphabets.items()}
    shape = "".join(marks.get(k, c) for k, c in zip(kinds, text))
    value = feistel(value, left, right, key, tweak + shape.encode())
    out = list(text)
    for i, size in zip(reversed(places), reversed(sizes)):
        value, d = divmod(value, size)
        out[i] = kinds[i][d]
    return "".join(out)


def _like(digits: str, shape: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> bool:
    return not sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or not d.strip("0"):
        return None
    n = len(d) - 1

    def checked(v: int) -> str:
        body = f"{v:0{n}d}"
        return next(body + c for c in string.digits if luhn(body + c))

    half = n // 2
    v = permuted(int(d[:-1]), 10 ** half, 10 ** (n - half), key, b"card", lambda v: v > 0)
    return _like(checked(v), text)


# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                   "81 82 84 86 90 91 92 93 94 95 98").split()


def phone(text: str, key: bytes, trunk: bool = False) -> str | None:
    """National digits, of which the first isn't 0: ten after an optional 1; or 6 to 12 after + and
    a country code, at most 15 in all; or, with ``trunk``, 9 to 10 after the prefix 0. The same
    national digits have one pseudonym in all these forms."""
    d = _digits(text)
    if text.startswith("+") and d[0] != "1":
        cut = 1 if d[0] == "7" else 2 if d[:2] in TWO_DIGIT_CODES else 3
        cut += d[cut:cut + 1] == "0" and "(0)" in text  # a trunk prefix in brackets
        least, most = 6, min(12, 15 - cut)
    elif trunk:
        cut, least, most = 1, 9, 10
    else:
        cut, least, most = int(len(d) == 11 and d[0] == "1"), 10, 10
    head, d = d[:cut], d[cut:]
    n = len(d)
    if not least <= n <= most or d[0] == "0":
        return None
    tweak = b"phone" if n == 10 else b"phone%d" % n
    v = permuted(int(d), 10 ** (n // 2), 10 ** (n - n // 2), key, tweak, lambda v: v >= 10 ** (n - 1))
    return _like(f"{head}{v}", text)


def trunk_phone(text: str, key: bytes) -> str | None:
    return phone(text, key, trunk=True)


def social(text: str, key: bytes) -> str | None:
    ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    d = _digits(text)
    if not ok(d):
        return None
    return _like(f"{permuted(int(d), 10 ** 4, 10 ** 5, key, b'social', lambda v: ok(f'{v:09d}')):09d}", text)


def address(text: str, key: bytes) -> str | None:
    p = text.split(".")
    if any(len(x) > 1 and x[0] == "0" or int(x) > 255 for x in p):
        return None
    v = permuted(int.from_bytes(bytes(map(int, p)), "big"), 1 << 16, 1 << 16, key, b"address")
    return ".".join(map(str, v.to_bytes(4, "big")))


def long_address(text: str, key: bytes) -> str | None:
    """Addresses of 128 bits of which at least three groups aren't zero, in any spelling; the
    pseudonym is in the shortest one."""
    def ok(v: int) -> bool:
        groups = sum(v >> s & 0xFFFF > 0 for s in range(0, 128, 16))
        return groups > 2 and any(c.isdigit() for c in str(ipaddress.IPv6Address(v)))

    try:
        v = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permuted(v, 1 << 64, 1 << 64, key, b"long address", ok))) if ok(v) else None


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    """Calendar dates of 1900 to 2099: year first, or else day and month by what is valid, the
    month first if both are."""
    a, b, c = re.split(r"[-/.]", text)
    orders = [(a, b, c, "{y:04d}{s}{m:02d}{s}{d:02d}")] if len(a) == 4 else [
        (c, a, b, "{m:02d}{s}{d:02d}{s}{y:04d}"), (c, b, a, "{d:02d}{s}{m:02d}{s}{y:04d}")]
    for y, m, d, shape in orders:
        try:
            n = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if FIRST <= n <= LAST:
            # days of the same reading only, so that the pseudonym is read in the same order
            same = lambda v, s=shape: v <= LAST - FIRST and (not s.startswith("{d") or datetime.date.fromordinal(FIRST + v).day > 12)
            new = datetime.date.fromordinal(FIRST + permuted(n - FIRST, 272, 272, key, b"date" + shape[:2].encode(), same))
            return shape.format(y=new.year, m=new.month, d=new.day, s=re.search(r"[-/.]", text)[0])
    return None


# The months in English, German, French and Spanish.
MONTHS = [names.split() for names in (
    "january february march april may june july august september october november december",
    "januar februar m\u00e4rz april mai juni juli august september oktober november dezember",
    "janvier f\u00e9vrier mars avril mai juin juillet ao\u00fbt septembre octobre novembre d\u00e9cembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre")]
_MONTH = "(?i:" + "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m))) + ")"


def spoken_date(text: str, key: bytes) -> str | None:
    """Days with the month in words, the day before or after it. They are permuted like dates with the
    year first, so both spellings of a day stay linked; a month stays in its language (the first that
    has the word) and case."""
    word = re.search(_MONTH, text)[0]
    names = next(x for x in MONTHS if word.lower() in x)
    day, year = re.findall(r"\d+", text)
    try:
        n = datetime.date(int(year), names.index(word.lower()) + 1, int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST <= n <= LAST:
        return None
    new = datetime.date.fromordinal(FIRST + permuted(n - FIRST, 272, 272, key, b"date{y", lambda v: v <= LAST - FIRST))
    name = names[new.month - 1]
    name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name
    d = f"{new.day:02d}" if len(day) == 2 and day[0] == "0" else str(new.day)
    parts = iter([name, d, str(new.year)] if text.startswith(word) else [d, name, str(new.year)])
    return re.sub(rf"{_MONTH}|\d+", lambda _: next(parts), text)


def account(text: str, key: bytes) -> str | None:
    """Bank account numbers whose letters and digits leave the remainder 1 by 97."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permuted_chars(plain[4:], key, b"account" + plain[:2].encode())
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def mail(text: str, key: bytes) -> str | None:
    name, at, host = text.partition("@")
    return permuted_chars(name, key, b"mail" + host.lower().encode(), LATIN) + at + host


def secret(text: str, key: bytes) -> str | None:
    if re.fullmatch("[0-9a-f]+", text):
        n = len(text)
        return f"{permuted(int(text, 16), 16 ** (n // 2), 16 ** (n - n // 2), key, b'hex'):0{n}x}"
    return permuted_chars(text, key, b"secret")


_ACCENTED = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"

# In the order of trial at one place. Group 1, if any, is the part that is permuted.
KINDS = (
    ("mail", mail, rf"[A-Za-z0-9._%+\-{_ACCENTED}]{{1,64}}@[A-Za-z0-9\-{_ACCENTED}]{{1,63}}(?:\.[A-Za-z0-9\-{_ACCENTED}]{{1,63}})*\.[A-Za-z]{{2,24}}"),
    ("account", account, r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", secret, r"(?<![A-Za-z0-9])AKIA([0-9A-Z]{16})(?![A-Za-z0-9])"),
    ("secret", secret, r"(?i:password|passwd|secret|token|api_?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9+/_\-]{8,128})"),
    ("secret", secret, r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,63}\d)(?=[0-9a-f]{0,63}[a-f])([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])"),
    ("date", date, r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d\-/]|\.\d)"),
    ("date", spoken_date, rf"(?<![\d.,\-/])\d{{1,2}}(?:\.|st|nd|rd|th)? (?:of |de )?{_MONTH} (?:de )?\d{{4}}(?![\d\-/])"),
    ("date", spoken_date, rf"(?<![A-Za-z{_ACCENTED}]){_MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?![\d\-/])"),
    ("address", address, r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"),
    ("address", long_address, r"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{5,38}[0-9A-Fa-f](?![A-Za-z0-9]|:[0-9A-Fa-f:])"),
    ("social", social, r"(?<![A-Za-z])(?i:ssn|social security (?:number|no\.?))(?: is)?[ :#]{1,3}(\d{9}|\d{3}-\d{2}-\d{4})(?![\d\-])"),
    ("social", social, r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", card, r"(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-]?\d)"),
    ("phone", phone, r"(?<![\d\-])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])"),
    ("phone", phone, r"(?<![A-Za-z0-9+])\+[1-9]\d{0,3}+(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-]?\d{1,4}+){2,6}+(?![\d\-])"),
    ("phone", trunk_phone, r"(?<![\d.,\-+])(?<!\d )(?:0\d{1,4} \d{3,4} \d{3,4}|0\d{2,4} \d{6,8}|\(0\d{1,4}\) ?\d{3,4} ?\d{3,4}|0\d(?:[ .]\d{2}){4})(?![ .]?\d|-)"),
)
_ANY = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, _, p) in enumerate(KINDS)), re.A)
_SOME = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|key)", re.A)


@lru_cache(maxsize=100_000)
def pseudonym(kind: int, value: str, key: bytes) -> str | None:
    """The pseudonym of a value of ``KINDS[kind]``; null if it doesn't pass the kind's checks."""
    return KINDS[kind][1](value, key)


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end of each in it. What fails the checks of
    one kind is tried as the next ones."""
    if not _SOME.search(text):
        return text, []
    out, spans, done, at, size = [], [], 0, 0, 0
    while m := _ANY.search(text, at):
        first = int(m.lastgroup[1:]) if m.lastgroup else 0
        for kind in range(first, len(KINDS)):
            own = m if kind == first else _EACH[kind].match(text, m.start())
            if own is None:
                continue
            a, b = _part(own, kind, kind == first)
            new = pseudonym(kind, text[a:b], key)
            if new is not None:
                out += [text[done:a], new]
                size += a - done
                spans.append((KINDS[kind][0], size, size + len(new)))
                size += len(new)
                done = at = b
                break
        else:
            at = m.start() + 1
            # a longer run of digits that fails must not be read again from its middle
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():
                at += 1
    return "".join([*out, text[done:]]), spans


_EACH = [re.compile(p, re.A) for _, _, p in KINDS]


def _part(m: re.Match, kind: int, joint: bool) -> tuple[int, int]:
    """Start and end of the permuted part of a match of the joint or the kind's own expression."""
    if not _EACH[kind].groups:
        return (m.start(f"k{kind}"), m.end(f"k{kind}")) if joint else m.span()
    return m.span(_ANY.groupindex[f"k{kind}"] + 1 if joint else 1)


SCHEMA = "doc_id long, text string, n_values long, kinds string, spans array<struct<kind: string, start: int, end: int>>"


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, the ``text`` with pseudonyms, ``n_values`` of them, their
    distinct ``kinds`` (sorted, comma-joined) and their ``spans`` in the new text.

    A null text stays null, with no values; repeated rows and null ids come out as they come in;
    an empty table gives an empty result; further columns are ignored. The key decides on the
    pseudonyms: who holds it can link them, so it is given and never stored; an empty one is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    names = ("doc_id", "text", "n_values", "kinds", "spans")
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    def run(batches):
        for b in sliced(batches, 1):
            cols: list[list] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                new, spans = (None, []) if t is None else pseudonymised(t, key)
                row = (new, len(spans), ",".join(sorted({k for k, _, _ in spans})),
                       [{"kind": k, "start": s, "end": e} for k, s, e in spans])
                for col, v in zip(cols, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types[1:])]], names=list(names))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)
