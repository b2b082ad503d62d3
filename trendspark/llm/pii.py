"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import table

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Key of the registered query only; who has it can undo the pseudonyms. A real run gives its own secret.
QUERY_KEY = b"pseudonym key of the tests"

_CLASSES = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
]
_CLASS_OF = {c: k for k in _CLASSES for c in k}


@lru_cache(4096)
def _class_of(c: str) -> str:
    """The characters that c may become: its class above, or letters and digits of its kind in its block of 256 code points."""
    if c in _CLASS_OF or not c.isalnum():
        return _CLASS_OF.get(c, "")
    kind, block = unicodedata.category(c), ord(c) & ~255
    return "".join(x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and x.isalnum() and x not in _CLASS_OF)


_HEX = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF"}

# One alternative a kind; word characters around a number are no boundary.
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?P<secret>(?<![\w])(?i:token|secret|password|api[_-]?key|key)[ \t]*[=:][ \t]*["']?(?P<hex>[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\w]))
    |(?P<iban>(?<![\w])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![\w]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w])(?!\.[0-9]))
    |(?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))
    |(?P<day>(?<![\w./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![\w/]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<phone>(?<![\w])\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ -]?[0-9]{2,4}){2,4}(?![\w])
        |(?<![\w])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![\w])|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w]))""",
    re.VERBOSE,
)
_ANY = re.compile("[0-9@]")  # every value has a digit or an @, and none spans lines
KINDS = ("email", "secret", "iban", "ip", "iso", "day", "ssn", "phone", "card")


def _round(key: bytes, tweak: bytes, i: int, x: int, size: int) -> int:
    data = tweak + bytes([0, i]) + x.to_bytes((x.bit_length() + 7) // 8, "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big") % size


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False, allowed=None) -> int:
    """Keyed permutation of range(size), or of those of its numbers that `allowed` accepts (x must be one).

    A Feistel network with alternating moduli over an a * b grid that holds the range; numbers
    outside are walked on to the next, which keeps it one to one.
    """
    a = max(1, int(size**0.5))
    while a * a < size:
        a += 1
    b = -(-size // a)
    t = tweak.encode()
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, t, i, right, a)) % a
            else:
                right = (right + sign * _round(key, t, i, left, b)) % b
        x = left * b + right
        if x < size and (allowed is None or allowed(x)):
            return x


def permute_characters(text: str, key: bytes, tweak: str, inverse: bool = False, alphabet: str | None = None) -> str:
    """Each letter or digit changes within its class (digits, letters by case and script); others stay. One or two characters are few values: such a permutation is a short table."""
    classes = [alphabet or _class_of(c) for c in text]
    size, x = 1, 0
    for c, k in zip(text, classes):
        if k:
            x = x * len(k) + k.index(c)
            size *= len(k)
    if size == 1:
        return text
    x = permute(x, size, key, f"{tweak}:{size}", inverse)
    out = []
    for c, k in zip(reversed(text), reversed(classes)):
        if k:
            x, d = divmod(x, len(k))
            c = k[d]
        out.append(c)
    return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    """Put digits in the places of the digits of shape."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _card(v, key, inverse):
    d = re.sub(r"[ -]", "", v)
    if luhn_digit(d[:-1]) != d[-1]:
        return None
    body = permute_characters(d[:-1], key, "card", inverse)
    return _fill(v, body + luhn_digit(body))


def _ip(v, key, inverse):
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(v, key, inverse):
    area, group, serial = map(int, v.split("-"))
    valid = lambda a, g, s: 0 < a < 900 and a != 666 and g > 0 and s > 0
    if not valid(area, group, serial):
        return None
    split = lambda x: (x // 1_000_000, x // 10_000 % 100, x % 10_000)
    x = permute(area * 1_000_000 + group * 10_000 + serial, 900_000_000, key, "ssn", inverse, lambda y: valid(*split(y)))
    return "{:03d}-{:02d}-{:04d}".format(*split(x))


def _permute_date(day: dt.date, key, inverse, allowed=None) -> dt.date:
    fits = (lambda x: allowed(dt.date.fromordinal(x + FIRST_DAY))) if allowed else None
    return dt.date.fromordinal(permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", inverse, fits) + FIRST_DAY)


def _date(year, month, day):
    try:
        d = dt.date(year, month, day)
    except ValueError:
        return None
    return d if FIRST_DAY <= d.toordinal() <= LAST_DAY else None


def _iso(v, key, inverse):
    d = _date(*map(int, v.split("-")))
    return d and _permute_date(d, key, inverse).isoformat()


def _day(v, key, inverse):
    """Day first with dots; with slashes month first, or day first where the first number is over 12. Widths stay."""
    sep = "." if "." in v else "/"
    a, b, y = v.split(sep)
    day_first = sep == "." or int(a) > 12
    d = _date(int(y), int(b), int(a)) if day_first else _date(int(y), int(a), int(b))
    if not d:
        return None
    order = lambda x: (x.day, x.month) if day_first else (x.month, x.day)
    zero = a[0] == "0" or b[0] == "0"
    if zero and not len(a) == len(b) == 2:
        return None
    # the result must show the same way of padding as the input
    same = lambda x: min(order(x)) < 10 if zero else all(len(str(n)) == len(t) for t, n in zip((a, b), order(x)))
    fits = lambda x: (sep == "." or not day_first or x.day > 12) and same(x)
    new = _permute_date(d, key, inverse, fits)
    p, q = order(new)
    return f"{p:0{len(a)}d}{sep}{q:0{len(b)}d}{sep}{new.year:04d}"


def _iban(v, key, inverse):
    c = v.replace(" ", "")
    if not 15 <= len(c) <= 34 or _iban_check(c[:2], c[4:]) != c[2:4]:
        return None
    body = permute_characters(c[4:], key, f"iban{c[:2]}", inverse)
    it = iter(c[:2] + _iban_check(c[:2], body) + body)
    return "".join(x if x == " " else next(it) for x in v)


def _phone(v, key, inverse):
    """The country code after + stays."""
    head = re.match(r"\+[0-9]{1,3}(?=[ (-])", v)
    n = head.end() if head else 0
    if not 7 <= sum(c.isdigit() for c in v[n:]) <= 15:
        return None
    return v[:n] + permute_characters(v[n:], key, "phone", inverse)


def _email(v, key, inverse):
    """The domain stays; a local part without letters and digits is no value."""
    local, at, domain = v.rpartition("@")
    if not any(map(_class_of, local)):
        return None
    return permute_characters(local, key, "email", inverse) + at + domain


RULES = {"email": _email, "iban": _iban, "ip": _ip, "iso": _iso, "day": _day, "ssn": _ssn, "phone": _phone, "card": _card}


def _spans(kind: str, m: re.Match):
    """Parts of a match that may be the value: the whole, then runs of its groups; cards of 16 digits go first, then longer ones."""
    yield m.span()
    groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9A-Z]+", m[0])]
    starts = groups if kind == "card" else groups[:1]
    runs = [(a, b, sum(y - x for x, y in groups if a <= x and y <= b)) for a, _ in starts for _, b in groups if b > a and (a, b) != m.span()]
    low, high = (13, 19) if kind == "card" else (15, 34)
    for a, b, _ in sorted((r for r in runs if low <= r[2] <= high), key=lambda r: (kind == "card" and r[2] != 16, -r[2], r[0])):
        yield a, b


def _find(line: str, pos: int, key: bytes, inverse: bool):
    """(kind, start, end, new, doubtful) of the first value from pos, or None; doubtful: another reading was tried before."""
    doubtful = False
    while m := _PATTERN.search(line, pos):
        kind = m.lastgroup if m.lastgroup in RULES else next(k for k in KINDS if m[k] is not None)
        if kind == "secret":
            h = m["hex"]
            return kind, *m.span("hex"), permute_characters(h, key, "secret", inverse, _HEX["lower" if h == h.lower() else "upper"]), False
        split = kind in ("card", "iban")
        for a, b in _spans(kind, m) if split else [m.span()]:
            if new := _cached(kind, line[a:b], key, inverse):
                return kind, a, b, new, doubtful
            doubtful = True
        # a number that fails may hide one that starts at a later group
        pos = m.start() + len(re.match("[0-9A-Z]+", m[0])[0]) if split else m.end()
    return None


def _replace_line(line: str, key: bytes, inverse: bool, counts: dict[str, int]) -> str:
    pos, out = 0, []
    while found := _find(line, pos, key, inverse):
        kind, a, b, new, doubtful = found
        if doubtful and kind in ("card", "iban"):
            # on to the next pseudonym until the text is read as before, so that the way back finds the same value
            while _find(line[:a] + new + line[b:], pos, key, inverse)[:3] != found[:3]:
                new = _cached(kind, new, key, inverse)
        out += [line[pos:a], new]
        counts[kind] = counts.get(kind, 0) + 1
        pos = b
    return "".join([*out, line[pos:]])


def replace_values(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and the number of values of each kind."""
    counts: dict[str, int] = {}
    return "\n".join(_replace_line(line, key, inverse, counts) if _ANY.search(line) else line for line in text.split("\n")), counts


@lru_cache(100_000)
def _cached(kind: str, value: str, key: bytes, inverse: bool) -> str | None:
    return RULES[kind](value, key, inverse)


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False, text_col: str = "text") -> DataFrame:
    """All columns of docs with values in the text replaced, and n_<kind> for each kind (columns of docs with such names are replaced).

    Card numbers must pass Luhn's check, account numbers theirs, dates and network addresses must
    exist; what fails stays as it is, but for a card or account number among its groups. A pseudonym has the format of its value and passes the same
    check, equal values have equal pseudonyms in all documents (but for a card or account number
    beside other groups whose pseudonym would make these a number too: it takes the next one), and inverse=True with the key
    gives the texts back. Null texts stay null; empty, very long and repeated texts need nothing
    special; an empty table stays empty.
    """
    names = [f"n_{k}" for k in KINDS]
    plain = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", " + ", ".join(f"{n} int" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [replace_values(t, key, inverse) if isinstance(t, str) else (None, {}) for t in b[text_col]]
            counts = {f"n_{k}": [c.get(k, 0) for _, c in out] for k in KINDS}
            yield b.assign(**{text_col: [t for t, _ in out]}, **counts)

    return plain.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
