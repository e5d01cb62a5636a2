"""Private values replaced by format-preserving Feistel pseudonyms.

Numbers and dates that pass their validity check are permuted by a keyed Feistel network inside their own format (cycle
walking keeps results in the domain): a card number becomes another number with a valid check digit, a date another date
in the same notation. The permutation depends on key, kind and value alone, so equal values stay linked across documents
and tasks without any shared table, and whoever holds the key can invert it.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

ROUNDS = 8
#: Dates of these years are permuted among themselves, so that a pseudonym is as likely a date; those of all other years of the calendar too.
NEAR_YEARS, LAST_YEAR = (1900, 2100), 9999

#: Calling codes of two digits, and the first two digits of those of three. Codes of one digit are 1 and 7.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
THREE_DIGIT_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: What makes four numbers with dots a place in a text and not an address.
NUMBERED = re.compile(r"(?:chapter|section|version|release|clause|part|figure|table|kapitel|abschnitt|chapitre|capítulo|§|\bv)[ .]?$", re.I)

_KINDS = r"""
    (?P<email>[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24})
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<hex>\b(?=[0-9a-f]{0,31}[0-9])(?=[0-9a-f]{0,31}[a-f])[0-9a-f]{32,64}\b)
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
  | (?P<ymd>(?<![\d-])\d{4}([-/.])\d{1,2}\6\d{1,2}(?![\d-]))
  | (?P<dmy>(?<![\d/.-])\d{1,2}([-/.])\d{1,2}\8\d{4}(?![\d-]))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))
  | (?P<phone>(?<![\w.+-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,6}|(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4}|0[1-9](?:[ .-]\d{2}){4}|0[1-9]\d{1,3}/\d{5,8})(?!\w))
    """
PATTERN = re.compile(_KINDS, re.X | re.ASCII)


@lru_cache(16)
def secret(key: bytes) -> bytes:
    """The key as the hash takes it: longer ones than 64 bytes are hashed as a whole. An empty key is refused."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return key if len(key) < 64 else hashlib.blake2b(key, digest_size=64).digest()


def feistel(value: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 ... size-1."""
    key = secret(key)
    if size < 2:
        return value
    half = (max((size - 1).bit_length(), 2) + 1) // 2
    mask, n = (1 << half) - 1, (half + 7) // 8 + 1
    while True:
        a, b = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            seen = a if inverse else b
            mixed = hashlib.blake2b(b"%d|%d|%d|" % (r, size, seen) + kind.encode(), key=key, digest_size=min(n, 64)).digest()
            f = int.from_bytes(mixed, "big") & mask
            a, b = (b ^ f, a) if inverse else (b, a ^ f)
        value = a << half | b
        if value < size:
            return value


def _digits(text: str, new: str) -> str:
    """text with its digits replaced by those of new, in order."""
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), text)


def _permute_digits(digits: str, key: bytes, kind: str, inverse: bool) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}", inverse)).zfill(len(digits)) if digits else ""


def luhn(digits: str) -> int:
    """0 for a number whose last digit is its check digit."""
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for k, d in enumerate(reversed(digits))) % 10


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if luhn(d) or len(set(d)) < 2:
        return None
    body = d[0] + _permute_digits(d[1:-1], key, "card" + d[0], inverse)
    return _digits(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    s = text.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    rest = s[4:]
    rest = _digits(rest, _permute_digits(re.sub(r"\D", "", rest), key, "iban" + s[:2], inverse))
    out = iter(f"{s[:2]}{98 - number(rest + s[:2] + '00') % 97:02d}{rest}")
    return "".join(c if c == " " else next(out) for c in text)


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", inverse)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _written(part: str) -> str:
    """How a month or day is written: with one digit, with a zero before it, or with two digits that both count."""
    return "1" if len(part) == 1 else "0" if part[0] == "0" else "2"


@lru_cache(64)
def _fitting(late: bool, month: str, day: str, leap: bool) -> list[tuple[int, int]]:
    """Days (month, day) of one year, after the 12th of their month or not, that are written so; any way for "*"."""
    fits = lambda v, how: how == "*" or (v > 9) == (how == "2")
    length = lambda m: calendar.monthrange(4 if leap else 1, m)[1]
    return [(m, d) for m in range(1, 13) if fits(m, month) for d in range(1, length(m) + 1) if (d > 12) == late and fits(d, day)]


def _before(year: int, how: tuple[bool, str, str]) -> int:
    """Number of fitting days of the years from 1 up to that one."""
    y, common = year - 1, len(_fitting(*how, False))
    return y * common + (y // 4 - y // 100 + y // 400) * (len(_fitting(*how, True)) - common)


def day_number(date: dt.date, how: tuple[bool, str, str]) -> int:
    """Place of a fitting date among all fitting dates of the calendar, from 0."""
    return _before(date.year, how) + bisect_left(_fitting(*how, calendar.isleap(date.year)), (date.month, date.day))


def numbered_day(n: int, how: tuple[bool, str, str]) -> dt.date:
    """The date with that place."""
    year = bisect_right(range(1, LAST_YEAR + 1), n, key=lambda y: _before(y, how))
    return dt.date(year, *_fitting(*how, calendar.isleap(year))[n - _before(year, how)])


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    """Year first, or day first, or month first where the day can't be first; any date of the years 1 to 9999.

    Days after the 12th are permuted among themselves, and so are the others, so that a pseudonym reads in the notation
    of its date and no two dates share one. With two digits each for month and day a date has one pseudonym in all
    notations; other ways of writing keep their number of digits and are permuted apart. Dates from 1900 to 2099 stay
    within these years, others outside them.
    """
    sep, p = re.search(r"[-/.]", text).group(), re.split(r"[-/.]", text)
    for y, m, d in ((0, 1, 2),) if len(p[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            date = dt.date(int(p[y]), int(p[m]), int(p[d]))
        except ValueError:
            continue
        written = ("*", "*") if len(p[m]) == len(p[d]) == 2 else (_written(p[m]), _written(p[d]))
        how, kind = (date.day > 12, *written), f"date{date.day > 12}{written[0]}{written[1]}"
        at, first, end = day_number(date, how), _before(NEAR_YEARS[0], how), _before(NEAR_YEARS[1], how)
        near = end - first
        if first <= at < end:
            n = first + feistel(at - first, near, key, kind, inverse)
        else:
            n = feistel(at if at < first else at - near, _before(LAST_YEAR + 1, how) - near, key, kind + "far", inverse)
            n = n if n < first else n + near
        new = numbered_day(n, how)
        out = {y: f"{new.year:04d}", m: str(new.month).zfill(len(p[m])), d: str(new.day).zfill(len(p[d]))}
        return sep.join(out[k] for k in range(3))
    return None


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    n = feistel(n, len(areas) * 99 * 9999, key, "ssn", inverse)
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def country_code(digits: str) -> str | None:
    """The calling code that a number in international form begins with, by the plan of its first digits."""
    if digits[0] in "17":
        return digits[0]
    if digits[:2] in TWO_DIGIT_CODES:
        return digits[:2]
    return digits[:3] if digits[:2] in THREE_DIGIT_CODES and len(digits) > 3 else None


def _plan(text: str) -> tuple[str, str] | None:
    """(plan, digits that stay) of a phone number, None for what no plan has.

    With +1: ten digits as 3-3-4. With another calling code: 8 to 15 digits in all. Without a code: 3-3-4 digits as in
    North America, with brackets or signs other than spaces; ten digits in pairs as in France; an area, a slash and a
    number as in Germany.
    """
    d = re.sub(r"\D", "", text)
    if text[0] == "+":
        code = country_code(d)
        return ("+" + code, code) if code and 8 <= len(d) <= 15 else None
    return ("0", "0") if d[0] == "0" else ("national", "")


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    if not (plan := _plan(text)):
        return None
    name, stays = plan
    digits, new = re.sub(r"\D", "", text)[len(stays) :], text
    while True:  # walk until the plan's own pattern has the new number too
        digits = _permute_digits(digits, key, "phone" + name, inverse)
        new = _digits(text, stays + digits)
        if ALONE["phone"].fullmatch(new) and _plan(new) == plan:
            return new


def _mixed(text: str, key: bytes, kind: str, inverse: bool) -> str:
    """Letters stay letters of their case and digits digits; other characters stay."""
    value, size, radix = 0, 1, []
    for c in text:
        r = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
        radix.append(r)
        value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)
        size *= r
    value = feistel(value, size, key, kind + ",".join(map(str, radix)), inverse)
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        value, x = divmod(value, r)
        new = str(x) if r == 10 else chr(97 + x)
        out.append(c if r == 1 else new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _email(text: str, key: bytes, inverse: bool) -> str | None:
    local, _, host = text.rpartition("@")
    return f"{_mixed(local, key, 'email' + host.lower(), inverse)}@{host}" if ".." not in text else None


def _hex(text: str, key: bytes, inverse: bool) -> str | None:
    return f"{feistel(int(text, 16), 16 ** len(text), key, f'hex{len(text)}', inverse):0{len(text)}x}"


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email, "iban": _iban, "hex": _hex, "ip": _ip, "ymd": _date, "dmy": _date, "ssn": _ssn, "card": _card, "phone": _phone,
}
#: Each kind's own pattern, with the groups of separators counted anew.
ALONE = {m.group(1): re.compile(re.sub(r"\\[68]", r"\\2", line), re.X | re.ASCII) for line in re.split(r"^  \| ", _KINDS.strip(), flags=re.M) if (m := re.match(r"\(\?P<(\w+)>", line))}
#: Kinds whose values may be followed by more of the same signs.
GROUPED = frozenset({"iban", "card", "phone"})
_ANY = re.compile(r"[0-9@]")


def pseudonymize(text: str, key: bytes, memory: dict | None = None, inverse: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(new text, replaced spans as (kind, start, end, pseudonym) in code points of the old text)."""
    if not _ANY.search(text):
        return text, []
    parts, spans, at, start = [], [], 0, 0
    memory = {} if memory is None else memory
    while m := PATTERN.search(text, start):
        for kind, end in _readings(text, m):
            if kind == "ip" and NUMBERED.search(text, max(0, m.start() - 12), m.start()):
                continue
            found = text[m.start() : end]
            new = memory.get((kind, found), "")
            if new == "":
                if len(memory) > 100_000:
                    memory.clear()
                new = memory[kind, found] = KINDS[kind](found, key, inverse)
            if new is not None:
                parts += [text[at : m.start()], new]
                spans.append((kind, m.start(), end, new))
                at = start = end
                break
        else:  # not valid as any kind; try places from its next word on
            start = _next_try(text, m)
    return ("".join([*parts, text[at:]]), spans) if spans else (text, [])


def _readings(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """(kind, end) of the values that may stand where m does: its own, then by kinds the longest first.

    Shorter ones end where a group of digits or letters does, so that a number's neighbour is not read as part of it. One
    in ten numbers passes its check digit together with digits after it by chance, and is then read as the longer one.
    """
    own = next(k for k, v in m.groupdict().items() if v is not None)
    yield own, m.end()
    names = list(KINDS)
    for kind in names[names.index(own) :]:
        end = m.end() if kind == own else None
        if end is None:
            if not (x := ALONE[kind].match(text, m.start())):
                continue
            end = x.end()
            yield kind, end
        if kind not in GROUPED:
            continue
        for k in range(end - 1, m.start(), -1):
            if not text[k].isalnum() and text[k - 1].isalnum() and ALONE[kind].fullmatch(text, m.start(), k):
                yield kind, k


def _next_try(text: str, m: re.Match) -> int:
    """Past the digits or letters with which the refused match begins."""
    k = m.start() + 1
    while k < m.end() and text[k].isalnum():
        k += 1
    return k


def pseudonymize_texts(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text, spans (kind, start, end, pseudonym).

    A null text stays null, without spans. Numbers that fail their check (check digit, calendar, octets, numbering plan)
    are left alone, and so are section numbers. Whole texts are read; only the two named columns are. An empty key raises.
    """
    secret(key)
    kind = docs.schema[id_col].dataType.simpleString()
    memory: dict = {}
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [(t, []) if t is None else pseudonymize(t, key, memory) for t in b.column(1).to_pylist()]
        spans = [[{"kind": k, "start": s, "end": e, "pseudonym": p} for k, s, e, p in g[1]] for g in got]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(spans, span)], [id_col, "text", "spans"])

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).alias("_text")), one, f"{id_col} {kind}, text string, spans array<struct<kind:string,start:int,end:int,pseudonym:string>>", batch_bytes=8 << 20)
