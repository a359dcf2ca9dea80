"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's check (check digit, octets, calendar, prefix) and mail
addresses are permuted inside their format by a keyed Feistel network, so a pseudonym has the shape
of its value, and equal values, in whatever document, get equal pseudonyms. Nothing is looked up or
exchanged: the job is map-only. What fails its check is left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import chunks, free_name, table

ROUNDS = 10
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Kinds in order of precedence where matches begin at the same place.
KINDS = ("email", "ip", "date", "iban", "card", "ssn", "phone", "secret")

#: Each branch is bounded and begins where a token may begin, so a scan is linear in the text.
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?P<_a>[ -])[0-9]{4}(?P=_a)[0-9]{4}(?P=_a)[0-9]{1,7}|[0-9]{4}(?P<_b>[ -])[0-9]{6}(?P=_b)[0-9]{5})(?![0-9A-Za-z]|-[0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<phone>(?<![0-9A-Za-z+.-])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\+[0-9](?:[ .-]?[0-9]){7,13}|[0-9]{3}(?P<_c>[ .-])[0-9]{3}(?P=_c)[0-9]{4})(?![0-9A-Za-z]|[.-][0-9]))"
    r"|(?P<secret>(?<![0-9A-Za-z_])(?:api[_-]?key|token|secret|password|passwd|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_-]{16,512})",
    re.IGNORECASE,
)
#: A text in which this finds nothing holds none of the kinds.
_MAY = re.compile("[0-9@]")
_RUN = re.compile("[0-9A-Za-z]+|.", re.DOTALL)
#: Dates are permuted among the days of these years.
DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())


#: How long the IBANs of countries are.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in countries.split()}


class Feistel:
    """A keyed permutation of the strings of one shape: alternating modular additions to two halves."""

    def __init__(self, key: bytes):
        self.key = key

    def numbers(self, left: int, right: int, size_left: int, size_right: int, tweak: str) -> tuple[int, int]:
        for r in range(ROUNDS):
            other = left if r % 2 else right
            f = hashlib.blake2b(f"{tweak}|{size_left}|{size_right}|{r}|{other}".encode(), key=self.key, digest_size=max(16, size_left.bit_length() // 8 + 9, size_right.bit_length() // 8 + 9) if max(size_left, size_right).bit_length() < 440 else 64).digest()
            if r % 2:
                right = (right + int.from_bytes(f)) % size_right
            else:
                left = (left + int.from_bytes(f)) % size_left
        return left, right

    def string(self, text: str, alphabets: list[str], tweak: str) -> str:
        """Permute ``text``, whose k-th sign is one of ``alphabets[k]``, among all such strings.
        Longer strings are cut in runs of up to 64 signs, each with all before it as its tweak."""
        if len(text) > 64:
            head = self.string(text[:64], alphabets[:64], tweak)
            return head + self.string(text[64:], alphabets[64:], f"{tweak}|{text[:64]}")
        mid = len(text) // 2
        sizes, values = [1, 1], [0, 0]
        for k, (c, alphabet) in enumerate(zip(text, alphabets, strict=True)):
            side = k >= mid
            sizes[side] *= len(alphabet)
            values[side] = values[side] * len(alphabet) + alphabet.index(c)
        values = list(self.numbers(*values, *sizes, tweak))
        out = []
        for k in range(len(text) - 1, -1, -1):
            values[k >= mid], d = divmod(values[k >= mid], len(alphabets[k]))
            out.append(alphabets[k][d])
        return "".join(reversed(out))

    def within(self, value: int, size: int, tweak: str) -> int:
        """Permute 0..size-1: walk the cycle of a larger square until it comes back inside."""
        root = int(size**0.5) + 1
        while True:
            left, right = self.numbers(value // root, value % root, root, root, tweak)
            value = left * root + right
            if value < size:
                return value


def _alphabet(c: str) -> str | None:
    return DIGITS if "0" <= c <= "9" else LOWER if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else None


def _signs(f: Feistel, text: str, tweak: str, skip: Callable[[int, str], bool] = lambda k, c: False, alphabet: Callable[[str], str | None] = _alphabet) -> str:
    """Permute the letters and digits of ``text``, each among its like, and leave the rest where it is."""
    at = [k for k, c in enumerate(text) if alphabet(c) and not skip(k, c)]
    new = f.string("".join(text[k] for k in at), [alphabet(text[k]) for k in at], tweak)
    out = list(text)
    for k, c in zip(at, new, strict=True):
        out[k] = c
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (k + 1) % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _card(f: Feistel, text: str) -> str | None:
    digits = re.sub("[ -]", "", text)
    if len(set(digits)) == 1 or int(digits[-1]) != _luhn(digits[:-1]):
        return None
    body = f.string(digits[1:-1], [DIGITS] * (len(digits) - 2), f"card{len(digits)}{digits[0]}")
    new = iter(digits[0] + body + str(_luhn(digits[0] + body)))
    return "".join(next(new) if "0" <= c <= "9" else c for c in text)


def _iban(f: Feistel, text: str) -> str | None:
    if text == text.lower():  # the same number in lower case has the same pseudonym in lower case
        new = _iban(f, text.upper()) if text.isascii() else None
        return new and new.lower()
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or plain != plain.upper() or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _signs(f, plain[4:], f"iban{plain[:2]}")
    new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _ends(text: str) -> list[str]:
    """``text`` and its beginnings that end before a blank, the longest first: the words behind an IBAN match, too.
    Where all of it is as long as its country's IBANs, digits at its end are no such words."""
    ends = [text, *(text[:k] for k in range(len(text) - 1, 14, -1) if text[k] == " ")]
    whole = len(text.replace(" ", "")) == IBAN_LENGTHS.get(text[:2].upper())
    return [e for e in ends if e == text or not whole or not text[len(e) :].replace(" ", "").isdigit()]


def _date(f: Feistel, text: str) -> str | None:
    cut = re.split("[./-]", text)
    try:
        for y, m, d in ((cut, cut[::-1]) if len(cut[0]) == 4 else (cut[::-1], [cut[2], cut[0], cut[1]])):
            with_order = (y, m, d) == tuple(cut[::-1])
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                continue
            if not DAYS[0] <= day <= DAYS[1]:
                return None
            new = datetime.date.fromordinal(DAYS[0] + f.within(day - DAYS[0], DAYS[1] - DAYS[0] + 1, "date"))
            if len(cut[0]) == 4:
                return f"{new:%Y-%m-%d}"
            sep = text[2]
            return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}" if with_order else f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year}"
    except IndexError:
        pass
    return None


def _ip(f: Feistel, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    a, b = f.numbers(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "ip")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def _ssn(f: Feistel, text: str) -> str | None:
    a, b, c = text.split("-")
    if a in ("000", "666") or a >= "900" or b == "00" or c == "0000":
        return None
    areas = [x for x in range(1, 900) if x != 666]
    n = f.within((areas.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1, len(areas) * 99 * 9999, "ssn")
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def _phone(f: Feistel, text: str) -> str | None:
    n = sum("0" <= c <= "9" for c in text)
    if not 8 <= n <= 15 or (text[0] != "+" and n < 9):
        return None
    code = re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+[0-9]|", text).end()  # the country code stays
    return text[:code] + _signs(f, text[code:], f"phone{text[:code]}")


def _email(f: Feistel, text: str) -> str | None:
    local, _, host = text.partition("@")
    name, dot, top = host.rpartition(".")
    return _signs(f, local, "local") + "@" + _signs(f, name, "host") + dot + top


def _secret(f: Feistel, text: str) -> str | None:
    at = re.search(r"[A-Za-z0-9+/_-]+\Z", text).start()
    value = text[at:]
    kind = (lambda c: HEX if c in HEX else None) if re.fullmatch("[0-9a-f]+", value) else _alphabet
    return text[:at] + _signs(f, value, "secret", alphabet=kind) if re.search("[0-9]", value) else None


_CHANGE = {"email": _email, "ip": _ip, "date": _date, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "secret": _secret}


def pseudonymise(text: str | None, feistel: Feistel, seen: dict[tuple[str, str], str | None]) -> tuple[str | None, list[int]]:
    """The text with its personal data replaced, and how many values of each kind that were."""
    counts = [0] * len(KINDS)
    if not text or not _MAY.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while m := _FIND.search(text, at):
        kind, value = m.lastgroup, m[0]
        for value in _ends(value) if kind == "iban" else (value,):
            if (kind, value) not in seen:
                seen[kind, value] = _CHANGE[kind](feistel, value)
            new = seen[kind, value]
            if new is not None:
                break
        if new is None:  # no valid value starts here
            at = _RUN.match(text, m.start()).end()
            continue
        out += [text[done : m.start()], new]
        counts[KINDS.index(kind)] += 1
        done = at = m.start() + len(value)
    return ("".join([*out, text[done:]]) if out else text), counts


def mask(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; with ``counts_col``, also an array of the
    counts by kind, in the order of ``KINDS``.

    Null stays null, an empty text empty. Whole texts are read, however long. Ids (null ones, too), ties and other
    columns don't matter; repeated rows give repeated results, an empty table an empty one. If the name of the counts is
    taken, it gets underscores until it is free.
    """
    names = docs.columns
    counts_col = counts_col and free_name(counts_col, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel, seen = Feistel(key.encode()), {}
        for batch in chunks(batches, text_col):
            done = [pseudonymise(x, feistel, seen) for x in batch[text_col].to_pylist()]
            if len(seen) > 200_000:
                seen.clear()
            cols = [pa.array([t for t, _ in done], pa.string()) if n == text_col else batch[n] for n in names]
            if counts_col:
                cols.append(pa.array([c for _, c in done], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [*names, *([counts_col] if counts_col else [])])

    extra = [T.StructField(counts_col, T.ArrayType(T.IntegerType()))] if counts_col else []
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def op3(spark: SparkSession, sf_dir: str, key: str = "public-test-key") -> DataFrame:
    docs = mask(table(spark, sf_dir, "documents").select("doc_id", "text"), key, counts_col="found")
    return docs.selectExpr("doc_id", "aggregate(found, 0L, (a, x) -> a + x) AS n_private", *(f"found[{k}] AS n_{kind}" for k, kind in enumerate(KINDS)), "text", "sha2(text, 256) AS text_sha256")
