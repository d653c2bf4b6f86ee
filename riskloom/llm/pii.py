"""Operator 8: format-preserving pseudonyms of personal data.

Numbers and dates that stand the checks of their kind are replaced by a keyed permutation of their
kind's values: a Feistel network over the value's range, walked until the result stands the same
checks. A permutation keeps different values apart and, as it depends on key and kind alone, equal
values stay linked across documents, however they are spaced; with the key it can be undone.

Kinds: card (13 to 19 digits, Luhn; the check digit is made anew), account (13 to 19 digits that are
not a card), iban (mod 97; check digits made anew), ssn, phone ('+', an assigned country code, which
stays, and 7 to 14 digits in groups; or the national 3-3-4 groups, taken for numbers of country 1 and so
linked to them; of ten digits without separators none is a phone), ip (four octets), date (calendar dates of 1900 to 2099 as year-month-day, day.month.year or
month/day/year: equal dates stay linked across these), email (the local part's letters and digits; the
domain stays). Separators and case stay where they are.

A find may be longer than its value. An IBAN ends at its country's length, where that stands the check;
of groups of digits the fewest that make a card are one, and the groups behind it in the same find (13
to 19 digits in all) are replaced on their own, as kind rest, where no other find begins. Which beginnings of a number stand Luhn is
kept by the permutation, so pseudonyms are cut like their values.

Defined results: null text stays null, with no replacements; overlapping finds go to the earliest, then
to other kinds than card and account, then to the longest, and the text behind each is searched anew; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, table

ROUNDS = 8
KEY = b"replace me outside of tests"
DAY_ZERO, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """Keyed permutations of 0..size-1 that stay within the values for which ``valid`` holds."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, half: int, side: int) -> int:
        data = f"{tweak}|{i}|{half}|{side}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big") % side

    def _walk(self, x: int, size: int, tweak: str, valid: Callable[[int], bool], back: bool) -> int:
        if size < 2:
            return x
        side = isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, side)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(tweak, i, left, side)) % side, left
                else:
                    left, right = right, (left + self._round(tweak, i, right, side)) % side
            x = left * side + right
            if x < size and valid(x):
                return x

    def forth(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        return self._walk(x, size, tweak, valid, False)

    def back(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        return self._walk(x, size, tweak, valid, True)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _digits(move, value: str, tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    n = len(value)
    return f"{move(int(value), 10 ** n, f'{tweak}{n}', lambda x: valid(f'{x:0{n}d}')):0{n}d}" if n else value


def _filled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in shape)


def _checked(move, digits: str) -> str:
    """Permuted among the numbers of which the same beginnings of 13 digits and more stand Luhn: 12 digits
    are free, each further one is its check digit or one of the nine others."""
    x, size, stands = int(digits[:12]), 10 ** 12, ""
    for k in range(12, len(digits)):
        off = (int(digits[k]) - luhn_digit(digits[:k])) % 10
        stands += "0" if off else "1"
        if off:
            x, size = x * 9 + off - 1, size * 9
    x, offs = move(x, size, "number" + stands), []
    for s in reversed(stands):
        x, off = divmod(x, 9) if s == "0" else (x, -1)
        offs.append(off + 1)
    out = f"{x:012d}"
    for off in reversed(offs):
        out += str((luhn_digit(out) + off) % 10)
    return out


def _number(move, found: str) -> tuple[str, str] | None:
    """The card of the fewest groups, or else all groups as an account."""
    for end in reversed(_ends(found)):
        digits = re.sub(r"\D", "", found[:end])
        if len(digits) >= 13 and luhn(digits):
            return "card", _filled(found[:end], _checked(move, digits))
    return "account", _filled(found, _checked(move, digits))


def _rest(move, found: str) -> tuple[str, str]:
    return "rest", _filled(found, _digits(move, re.sub(r"\D", "", found), "rest"))


def _iban(move, found: str) -> tuple[str, str] | None:
    plain = found.replace(" ", "")
    length = IBAN_LENGTHS.get(plain[:2], 0)
    short = lambda iban: 0 < length < len(iban) and iban_rest(iban[:length]) == 1
    if short(plain):
        end = [i for i, c in enumerate(found) if c != " "][length - 1] + 1
        if found[end] == " ":
            found, plain = found[:end], plain[:length]
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    places = [i for i in range(4, len(plain)) if plain[i].isdigit()]

    def made(digits: str) -> str:
        body = list(plain)
        for i, d in zip(places, digits):
            body[i] = d
        body[2:4] = "00"
        body[2:4] = f"{98 - iban_rest(''.join(body)):02d}"
        return "".join(body)

    given = iter(made(_digits(move, "".join(plain[i] for i in places), "iban" + "".join(c for c in plain[4:] if not c.isdigit()) + plain[:2],
                              lambda digits: short(made(digits)) == short(plain))))
    return "iban", "".join(c if c == " " else next(given) for c in found)


def _ssn(move, found: str) -> tuple[str, str] | None:
    digits = found.replace("-", "")
    return ("ssn", _filled(found, _digits(move, digits, "ssn", valid_ssn))) if valid_ssn(digits) else None


def _ends(found: str) -> list[int]:
    """Where the groups of digits of a find end, the last first."""
    return [m.end() for m in re.finditer(r"[0-9]+", found)][::-1]


def _phone(move, found: str) -> tuple[str, str] | None:
    """The longest groups with a possible count of digits; for country 1, those of ten digits first."""
    country = COUNTRY.match(re.sub(r"\D", "", found))[0]
    fit = []
    for end in _ends(found):
        digits = re.sub(r"\D", "", found[:end])[len(country):]
        if 7 <= len(digits) <= 14 and found.count("(", 0, end) <= found.count(")", 0, end):
            fit.append((country == "1" and len(digits) == 10, end, digits))
    if not fit or country[0] == "0" and "(" not in found:
        return None
    _, end, digits = max(fit)
    return "phone", _filled(found[:end], country + _digits(move, digits, "phone+" + country))


def _national(move, found: str) -> tuple[str, str] | None:
    digits = re.sub(r"\D", "", found)
    return "phone", _filled(found, digits[:-10] + _digits(move, digits[-10:], "phone+1"))


def _ip(move, found: str) -> tuple[str, str] | None:
    octets = found.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    x = move(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
    return "ip", ".".join(map(str, x.to_bytes(4, "big")))


def _date(move, found: str) -> tuple[str, str] | None:
    a, mark, b, c = re.fullmatch(r"(\d+)([-./])(\d+)\2(\d+)", found).groups()
    order = {"-": (a, b, c), ".": (c, b, a), "/": (c, a, b)}[mark]
    try:
        day = (datetime.date(*map(int, order)) - DAY_ZERO).days
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    d = DAY_ZERO + datetime.timedelta(days=move(day, DAYS, "date"))
    y, m, d = f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}"
    return "date", mark.join({"-": (y, m, d), ".": (d, m, y), "/": (m, d, y)}[mark])


def _email(move, found: str) -> tuple[str, str] | None:
    local, _, domain = found.partition("@")
    shape = "".join("0" if c.isdigit() else "a" if c in LETTERS else "A" if c.lower() in LETTERS else c for c in local)
    if not re.search("[0aA]", shape):
        return None
    size, x = 1, 0
    for c, s in zip(local, shape):
        if s in "0aA":
            x, size = (x * 10 + int(c), size * 10) if s == "0" else (x * 26 + LETTERS.index(c.lower()), size * 26)
    x, out = move(x, size, f"email{shape}@{domain.lower()}"), []
    for s in reversed(shape):
        if s == "0":
            x, d = divmod(x, 10)
            out.append(str(d))
        elif s in "aA":
            x, d = divmod(x, 26)
            out.append(LETTERS[d] if s == "a" else LETTERS[d].upper())
        else:
            out.append(s)
    return "email", "".join(reversed(out)) + "@" + domain


#: Country codes of ITU-T E.164: none begins another, so the digits alone tell where the country ends.
COUNTRY = re.compile(r"0*(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|)")
#: The registered length of each country's IBANs.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU"}.items() for country in countries.split()}
#: An address or a date with dots or slashes, which is no further group of a number.
OTHER = r"(?!(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![A-Za-z0-9/]))"
#: Where kinds may stand; the function checks a find and gives its kind and replacement, which may be
#: that of the find's first groups only.
FINDERS = (
    (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII), _iban),
    (re.compile(r"\+\(?[0-9](?:(?:\.|[ -]" + OTHER + r"|[ .-]?\(|\)[ .-]?)?[0-9]){7,14}(?![0-9])", re.ASCII), _phone),
    (re.compile(r"(?<![A-Za-z0-9+])(?<![0-9][.-])(?:1(?:[ .-]|(?=\()))?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?|[0-9]{3}(?:[.-][0-9]{3}[ .-]| [0-9]{3}[.-]))"
                r"[0-9]{4}(?![0-9]|[.-][0-9])", re.ASCII), _national),
    (re.compile(r"(?<![A-Za-z0-9.+-])(?<![0-9] )(?:1 )?[0-9]{3} [0-9]{3} [0-9]{4}(?![A-Za-z0-9]|[ .-]" + OTHER + "[0-9])", re.ASCII), _national),
    (re.compile(r"(?<![A-Za-z0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt][0-9]{2}|(?![A-Za-z0-9-]))", re.ASCII), _date),
    (re.compile(r"(?<![A-Za-z0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![A-Za-z0-9/])", re.ASCII), _date),
    (re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])", re.ASCII), _ip),
    (re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", re.ASCII), _ssn),
    (re.compile(r"(?<![A-Za-z0-9.+-])[0-9](?:(?:[ -]" + OTHER + r")?[0-9]){12,18}(?![A-Za-z0-9-])", re.ASCII), _number),
)
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]{1,64}$", re.ASCII), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
DIGIT, ANY = re.compile("[0-9]"), re.compile("[0-9@]")


def _next(finder: tuple, text: str, at: int, move) -> list[tuple[int, int, str, str]]:
    """The first find of one finder from ``at`` on, with the rest that goes with it."""
    pattern, check = finder
    begin = at
    while m := pattern.search(text, at):
        if check is _email:
            before = LOCAL.search(text[max(begin, m.start() - 64):m.start()])
            if before and (new := _email(move, before[0] + m[0])):
                return [(m.start() - len(before[0]), m.end(), *new)]
        elif new := check(move, m[0]):
            end = m.end() if check is _ip else m.start() + len(new[1])
            rest = [(end + 1, m.end(), *_rest(move, text[end + 1:m.end()]))] if check is _number and end < m.end() else []
            return [(m.start(), end, *new), *rest]
        at = m.start() + 1
    return []


def finds(text: str, move) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, replacement) of all finds, none overlapping."""
    if not ANY.search(text):
        return []
    finders = ([(DOMAIN, _email)] if "@" in text else []) + (list(FINDERS) if DIGIT.search(text) else [])
    out, first = [], [_next(f, text, 0, move) for f in finders]
    while any(first):
        best = min(filter(None, first), key=lambda f: (f[0][0], f[0][2] in ("card", "account"), -f[0][1]))
        end = best[0][1]
        first = [n if not n or n[0][0] >= end else _next(f, text, end, move) for f, n in zip(finders, first)]
        # groups behind a card may be the beginning of another find
        out += [b for b in best if b is best[0] or not any(n and n[0][0] < b[1] for n in first)]
    return out


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join(parts) + text[at:] if found else text


def pseudonymise(docs: DataFrame, key: bytes = KEY, doc_id: str = "doc_id", text: str = "text", undo: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_replaced, spans`` (kind:start:end in the given text),
    ``pseudonyms`` (kind=value) and the ``text`` with the replacements; ``undo`` takes them back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Feistel(key)
        move = network.back if undo else network.forth
        for b in batches:
            n, spans, names, texts = [], [], [], []
            for t in b.column(1).to_pylist():
                found = finds(t, move) if t is not None else []
                n.append(len(found))
                spans.append(",".join(f"{k}:{x}:{y}" for x, y, k, _ in found))
                names.append([f"{k}={v}" for *_, k, v in found])
                texts.append(replaced(t, found) if t is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.string()), pa.array(names, pa.list_(pa.string())),
                                              pa.array(texts, pa.string())], ["doc_id", "n_replaced", "spans", "pseudonyms", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_replaced long, spans string, pseudonyms array<string>, text string")


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"))
    return out.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
