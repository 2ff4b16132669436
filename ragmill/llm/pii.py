"""Pseudonyms for personal data that keep the format: a keyed permutation of each format's valid values.

A format turns a valid value into its number among the format's N valid values and back. A Feistel network,
walked along its cycle until it lands below N, permutes those numbers with a key; the pseudonym of x is
decrypt(encrypt(x) + 1 mod N), which is a permutation too and leaves no value as it is. Equal values so get
equal pseudonyms in every document, different values different ones, and a card number stays a number that
passes its check, a date a date.

Formats: payment cards (13 to 19 digits, Luhn check), IBANs (mod 97), US social security numbers, phone
numbers (E.164 with +, or North American groups), IPv4 addresses, dates (ISO, or day and month with . or /),
the local part of e-mail addresses, and secret hexadecimal strings of 32 digits or more. What fails its check
is left alone.

Defined cases: null stays null and has 0 values, an empty text stays empty; equal rows give equal rows; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

ROUNDS = 8


class Permutation:
    """A keyed permutation of range(size) without fixed points; size is at least 2."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size = size
        self.left = math.isqrt(size - 1) + 1
        self.right = -(-size // self.left)
        self.seed = hashlib.blake2b(f"{label}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, half: int, modulus: int) -> int:
        width = modulus.bit_length() // 8 + 9
        data = half.to_bytes(max(1, (half.bit_length() + 7) // 8), "big")
        out = b"".join(
            hashlib.blake2b(data, key=self.seed, salt=bytes([i, part % 256]), digest_size=64).digest()
            for part in range(-(-width // 64))
        )
        return int.from_bytes(out[:width], "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(i, a, self.right)) % self.right
            else:
                a = (a + sign * self._round(i, b, self.left)) % self.left
        return a * self.right + b

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.size, True)

    def inverse(self, x: int) -> int:
        return self._walk((self._walk(x, False) - 1) % self.size, True)


def luhn_digit(digits: str) -> int:
    """The check digit that makes digits + check pass."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 2 - i % 2
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(template: str, fresh: str, pattern: str) -> str:
    """template with the characters that match pattern replaced, in order, by those of fresh."""
    supply = iter(fresh)
    return re.sub(pattern, lambda _: next(supply), template)


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        self.key = key
        self.permutations: dict[tuple[str, int], Permutation] = {}

    def permuted(self, label: str, size: int, x: int) -> int:
        found = self.permutations.get((label, size))
        if found is None:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            found = self.permutations[label, size] = Permutation(self.key, label, size)
        return found(x)

    def radix(self, label: str, value: str, alphabets: list[str]) -> str:
        """A value whose characters come from one alphabet each, as a number of mixed radix."""
        size, x = 1, 0
        for c, a in zip(value, alphabets, strict=True):
            size, x = size * len(a), x * len(a) + a.index(c)
        x = self.permuted(label, size, x)
        out = []
        for a in reversed(alphabets):
            x, c = divmod(x, len(a))
            out.append(a[c])
        return "".join(reversed(out))

    # Each takes a match and gives the replacement, or None if the value isn't valid.

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        body = self.radix("card", digits[:-1], ["0123456789"] * (len(digits) - 1))
        return _refill(m[0], body + str(luhn_digit(body)), r"\d")

    def iban(self, m: re.Match) -> str | None:
        value = m[0].replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
            return None
        body = self.radix("iban " + value[:2], value[4:], [_class(c) for c in value[4:]])
        check = 98 - number(body + value[:2] + "00") % 97
        return _refill(m[0], f"{value[:2]}{check:02d}{body}", "[0-9A-Z]")

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = int(m[1]), int(m[2]), int(m[3])
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        x = self.permuted("ssn", len(areas) * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 10 <= len(digits) <= 15 or not m[0].startswith("+") and len(digits) != 10:
            return None
        keep = 1 if len(digits) in (10, 11) and digits.startswith("1") else 0 if len(digits) == 10 else 2
        rest = digits[keep:]
        alphabets = ["123456789" if c != "0" and i == 0 else "0123456789" for i, c in enumerate(rest)]
        return _refill(m[0], digits[:keep] + self.radix("phone", rest, alphabets), r"\d")

    def ip(self, m: re.Match) -> str | None:
        octets = [int(x) for x in m[0].split(".")]
        if max(octets) > 255:
            return None
        x = self.permuted("ip", 2**32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, m: re.Match) -> str | None:
        """Within the years 1900 to 2099, in the order and with the widths found."""
        text = m[0]
        parts = re.findall(r"\d+", text)
        orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if "/" in text else ("dmy",)
        for order in orders:
            value = dict(zip(order, map(int, parts), strict=True))
            try:
                day = datetime.date(value["y"], value["m"], value["d"])
            except ValueError:
                continue
            if not 1900 <= day.year <= 2099:
                continue
            first = datetime.date(1900, 1, 1).toordinal()
            size = datetime.date(2099, 12, 31).toordinal() - first + 1
            fresh = datetime.date.fromordinal(first + self.permuted("date", size, day.toordinal() - first))
            padded = any(len(p) == 2 and p[0] == "0" for p in parts) or "-" in text or all(len(p) > 1 for p in parts)
            named = {"y": f"{fresh.year:04d}", "m": f"{fresh.month:0{2 if padded else 1}d}", "d": f"{fresh.day:0{2 if padded else 1}d}"}
            supply = iter(order)
            return re.sub(r"\d+", lambda _: named[next(supply)], text)  # noqa: B023
        return None

    def email(self, m: re.Match) -> str | None:
        local, host = m[0].split("@")
        alphabets = [_class(c) for c in local]
        if math.prod(map(len, alphabets)) < 2:
            return None
        return self.radix("email " + host.lower(), local, alphabets) + "@" + host

    def secret(self, m: re.Match) -> str | None:
        if not re.search("[0-9]", m[0]) or not re.search("[a-fA-F]", m[0]):
            return None
        digits = "0123456789ABCDEF" if re.search("[A-F]", m[0]) else "0123456789abcdef"
        if any(c not in digits for c in m[0]):
            return None
        return self.radix("secret", m[0], [digits] * len(m[0]))

    def replace(self, text: str) -> tuple[str, int]:
        """The text with its values replaced, and their number. A stretch belongs to the first format that it is valid in."""
        found: list[tuple[int, int, str]] = []
        if "@" in text:
            self._find(text, EMAIL, self.email, found)
        if _DIGIT.search(text):
            for pattern, kind in NUMBERS:
                self._find(text, pattern, getattr(self, kind), found)
        if not found:
            return text, 0
        found.sort()
        out, at = [], 0
        for start, end, fresh in found:
            out += [text[at:start], fresh]
            at = end
        return "".join([*out, text[at:]]), len(found)

    @staticmethod
    def _find(text: str, pattern: re.Pattern, make: Callable[[re.Match], str | None], found: list[tuple[int, int, str]]) -> None:
        taken = sorted(found)
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _ in taken) and (fresh := make(m)) is not None:
                found.append((m.start(), m.end(), fresh))


def _class(c: str) -> str:
    for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in alphabet:
            return alphabet
    return c


_DIGIT = re.compile("[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+\-]*[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,}")
_EDGE, _STOP = r"(?<![\w.+\-])", r"(?![\w])(?!-\d)"
NUMBERS = (
    (re.compile(r"(?<!\w)(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"), "secret"),
    (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)"), "iban"),
    (re.compile(r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})(?!\w)"), "card"),
    (re.compile(r"(?<![\w\-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w\-])"), "ssn"),
    (re.compile(r"(?<![\w.\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"), "date"),
    (re.compile(r"(?<![\w./\-])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9/])(?!\w)"), "date"),
    (re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])"), "ip"),
    (re.compile(r"(?<!\w)\+[0-9](?:[ .\-]?\(?[0-9]\)?){8,14}(?![0-9])"), "phone"),
    (re.compile(r"(?<![\w+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?!\w)"), "phone"),
)


@functools.cache
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_values. The key decides the permutation; keep it secret and the same across tables."""
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches):
            done = [(None, 0) if t is None else pseudonyms(key).replace(t) for t in group.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [group.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                names=["doc_id", "text", "n_values"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, text string, n_values long")
