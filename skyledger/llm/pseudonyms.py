"""PII: format-preserving Feistel pseudonyms.

E-mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn), social-security
numbers, IBANs (mod 97) and calendar dates are found by pattern and *validated*; each valid
value is then mapped to another valid value of the same format by a keyed permutation.  The
permutation is a Feistel network over the values of the format; a result outside the format
is permuted again (cycle walking) until it is inside.  It is a bijection, so equal values get
equal pseudonyms in all documents and different values never collide.  Only a holder of
the key can undo it.  The key is the ``spark.skyledger.pseudonyms.secret`` of the session; where that is
unset, one is drawn for the session, so nobody else can undo its pseudonyms (nor link them to
those of another session).

Defined cases: null text stays null with zero counts; empty text stays empty; values that
fail validation (a wrong check digit, 31 February) stay as they are; separators, letter case
and lengths are kept; extra columns pass through unless they have the name of a count.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices

ROUNDS = 8
#: Spark hides settings with this word in its logs and pages.
SETTING = "spark.skyledger.pseudonyms.secret"
KINDS = ("email", "phone", "ipv4", "card", "ssn", "iban", "date")

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
NUMBER = re.compile(
    r"(?<![0-9A-Za-z])(?:"
    r"(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|\+[0-9]{1,4}(?:[ .-]?\(?[0-9]{1,4}\)?){1,5})"
    r"|(?P<ipv4>(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r")(?:(?![0-9A-Za-z])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2})(?=[Tt][0-9]{2}:))"  # a date may have a time behind it
)
#: Country codes of one and of two digits; all others have three.
SHORT_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
HAS_DIGIT = re.compile(r"[0-9]")
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Permutation:
    """A keyed bijection of the integers below ``size``, one for each ``tweak``."""

    def __init__(self, key: str, tweak: str, size: int) -> None:
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.bytes = (self.half + 7) // 8
        self.keys = [hashlib.blake2b(f"{tweak}|{size}|{i}".encode(), key=hashlib.sha256(key.encode()).digest()).digest() for i in range(ROUNDS)]

    def _mix(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(self.bytes, "big"), key=self.keys[i], digest_size=self.bytes).digest(), "big") & self.mask

    def _once(self, x: int, order) -> int:
        left, right = x >> self.half, x & self.mask
        for i in order:
            left, right = right, left ^ self._mix(i, right)
        return right << self.half | left

    def _walk(self, x: int, order) -> int:
        while True:
            x = self._once(x, order)
            if x < self.size:
                return x

    def forward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def back(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_ok(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


class Pseudonyms:
    """Replaces values in texts.  ``back=True`` undoes it."""

    def __init__(self, key: str, *, back: bool = False) -> None:
        self.key, self.way = key, "back" if back else "forward"
        self.permutation = lru_cache(maxsize=4096)(lambda tweak, size: Permutation(key, tweak, size))

    def number(self, tweak: str, value: int, size: int, ok=None) -> int:
        """The pseudonym of ``value`` among the integers below ``size`` that are ``ok``."""
        step = getattr(self.permutation(tweak, size), self.way)
        value = step(value)
        while ok and not ok(value):
            value = step(value)
        return value

    @staticmethod
    def refill(shape: str, digits: str) -> str:
        given = iter(digits)
        return "".join(next(given) if c.isdigit() else c for c in shape)

    def letters(self, tweak: str, text: str) -> str:
        """Digits become digits, letters letters of the same case, the rest stays; case doesn't change which."""
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
        value, size = 0, 1
        for c, r in zip(text, radix, strict=True):
            value = value * r + (0 if r == 1 else int(c) if r == 10 else ord(c.lower()) - 97)
            size *= r
        if size == 1:
            return text
        shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in text)
        value = self.number(f"{tweak}|{shape}", value, size)
        out = []
        for c, r in zip(reversed(text), reversed(radix), strict=True):
            value, d = divmod(value, r)
            out.append(c if r == 1 else str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
        return "".join(reversed(out))

    def email(self, m: re.Match) -> str | None:
        return f"{self.letters(f'email|{m[2].lower()}', m[1])}@{m[2]}"

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        code = (m[0] if (m := SHORT_CODES.match(digits)) else digits[:3]) if s[0] == "+" else digits[:-10]
        own = digits[len(code) :]
        if not 6 <= len(own) <= 12:
            return None
        return self.refill(s, f"{code}{self.number(f'phone|{code}', int(own), 10 ** len(own)):0{len(own)}d}")

    def ipv4(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.number("ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        payload = digits[:-1]
        if not 13 <= len(digits) <= 19 or luhn_digit(payload) != int(digits[-1]):
            return None
        new = f"{self.number('card', int(payload), 10 ** len(payload)):0{len(payload)}d}"
        return self.refill(s, f"{new}{luhn_digit(new)}")

    def ssn(self, s: str) -> str | None:
        ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
        x = int(s.replace("-", ""))
        return self.refill(s, f"{self.number('ssn', x, 10**9, ok):09d}") if ok(x) else None

    def iban(self, s: str) -> str | None:
        if not iban_ok(s):
            return None
        bban = self.letters(f"iban|{s[:2]}", s[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in bban + s[:2] + "00")) % 97
        return f"{s[:2]}{check:02d}{bban}"

    def date(self, s: str) -> str | None:
        sep = s[4] if s[4] in "-" else s[2]
        parts = [int(p) for p in s.split(sep)]

        def ordinal(y, m, d):
            try:
                n = datetime.date(y, m, d).toordinal() - FIRST_DAY
            except ValueError:
                return None
            return n if 0 <= n < DAYS else None

        day = lambda n: datetime.date.fromordinal(n + FIRST_DAY)
        if sep == "-":
            n = ordinal(*parts)
            return None if n is None else day(self.number("date", n, DAYS)).isoformat()
        n = ordinal(parts[2], parts[1], parts[0])  # day first
        if n is not None:
            x = day(self.number("date", n, DAYS))
            return f"{x.day:02d}{sep}{x.month:02d}{sep}{x.year:04d}"
        n = ordinal(parts[2], parts[0], parts[1])  # month first, known by its day over 12
        if n is None:
            return None
        x = day(self.number("date", n, DAYS, lambda n: day(n).day > 12))
        return f"{x.month:02d}{sep}{x.day:02d}{sep}{x.year:04d}"

    def replace(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each kind it has."""
        count = dict.fromkeys(KINDS, 0)

        def put(kind, old, new):
            if new is None:
                return old
            count[kind] += 1
            return new

        if "@" in text:
            text = EMAIL.sub(lambda m: put("email", m[0], self.email(m)), text)
        if HAS_DIGIT.search(text):
            text = IBAN.sub(lambda m: put("iban", m[0], self.iban(m[0])), text)
            text = NUMBER.sub(lambda m: put(m.lastgroup, m[0], getattr(self, m.lastgroup)(m[0])), text)
        return text, [count[k] for k in KINDS]


def session_key(spark: SparkSession) -> str:
    """The session's key; drawn where it has none."""
    if not spark.conf.get(SETTING, None):
        spark.conf.set(SETTING, secrets.token_hex(32))
    return spark.conf.get(SETTING)


def pseudonymize(docs: DataFrame, *, key: str | None = None, back: bool = False, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``, and ``n_<kind>`` counts of what was replaced.

    One pass without a shuffle.  ``back=True`` with the same key restores the texts.
    """
    key = key or session_key(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in counts])
    names = docs.columns

    def run(batches):
        replace = Pseudonyms(key, back=back).replace
        for part in slices(batches):
            done = [(None, [0] * len(KINDS)) if t is None else replace(t) for t in part.column(names.index(column)).to_pylist()]
            columns = [pa.array([d[0] for d in done], pa.string()) if n == column else part.column(i) for i, n in enumerate(names)]
            columns += [pa.array([d[1][k] for d in done], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *counts])

    return docs.mapInArrow(run, schema)
