"""Format-preserving pseudonyms for personal data.

Numbers and dates (and the letters and digits of addresses and keys) that pass their format's validation become numbers in
mixed radix, are permuted by a keyed Feistel network over exactly that domain, and are written back in the same layout: a
card number stays a valid card number, a date stays a date. Equal values get equal pseudonyms in every document, and the
key's holder can invert them; without the key they tell no more than their length, layout and what names their kind.

Kinds: email addresses, payment cards (issuer and Luhn), IBANs (mod 97), phone numbers, IPv4 and IPv6 addresses, US social
security numbers, dates (year first, or day and month with dots or slashes), access keys, signed tokens and assigned secrets.

Values of more than CHUNK characters are permuted in chunks, from the first to the last and back again; each chunk's
permutation is tweaked by all that the pass has already turned, so that every character of a pseudonym depends on the whole value.
Time is linear in the length of texts and values.

Digits of other scripts count by their value and are written back in their script. Dates from 1900 to 2099 stay among
themselves, and so do all other valid ones. Dates with slashes are read day first where that is a date, else month first; month-first
ones stay among those that can be read in no other way. Four numbers of one digit (a section's number as often as
an address) and shortened IPv6 addresses of fewer than three groups stay. Octets with leading zeros lose them.

Cases: null and empty texts stay as they are; numbers that fail validation (a wrong check digit, a 31st of April) stay.
Rows may repeat; other columns pass through untouched, whatever their names. A session without a key fails: see session_key.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache
from math import isqrt, prod

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of a value that are permuted together.
CHUNK = 20
#: Values of at most so many characters are remembered by a task.
REMEMBERED = 128
#: For demonstrations on made-up data only: anyone can invert what a public key turned. See session_key.
DEMO_KEY = b"quire demonstration key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
USUAL_DAYS, ALL_DAYS = LAST_DAY - FIRST_DAY + 1, datetime.date.max.toordinal()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

_KEY_NAME = r"(?:api|access|secret|private|auth|client|encryption|signing)[_-]?(?:key|secret|token)|password|passwd|passphrase|pwd|secret|token"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<access>\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[opsru]_[A-Za-z0-9]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}))"
    rf"|(?P<secret>(?<![A-Za-z0-9])(?i:{_KEY_NAME})\b[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<value>[A-Za-z0-9_+/.~-]{{6,}}))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]{0,37}::)[0-9A-Fa-f:]{6,39})(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d])\d(?:[ -]?\d){12,18}(?![\d]))"
    r"|(?P<phone>(?<![\d.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d))"
)
#: What stays of an access key: the name of its kind.
_ACCESS_NAME = re.compile(r"AKIA|ASIA|gh[opsru]_|[rs]k_(?:live|test)_|xox[abprs]-|eyJ")
_SIGN = re.compile(rf"[\d@=:]|{_ACCESS_NAME.pattern}")
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def permuted(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over pairs, walked until the value is in the range again."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def turn(k: int, half: int, m: int) -> int:
        own = hashlib.blake2b(f"{tweak}|{size}|{k}|{half}".encode(), key=key[:64], digest_size=16).digest()
        return int.from_bytes(own, "big") % m

    while True:
        left, right = divmod(x, b)
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if k % 2 == 0:
                left = (left - turn(k, right, a)) % a if back else (left + turn(k, right, a)) % a
            else:
                right = (right - turn(k, left, b)) % b if back else (right + turn(k, left, b)) % b
        x = left * b + right
        if x < size:
            return x


def slots(values: list[int], radices: list[int], key: bytes, tweak: str, valid: Callable[[list[int]], bool] | None, back: bool) -> list[int]:
    """The values of a mixed-radix number permuted among those that are valid."""
    x = 0
    for v, r in zip(values, radices):
        x = x * r + v
    while True:
        x = permuted(x, prod(radices), key, tweak, back)
        out, rest = [], x
        for r in reversed(radices):
            rest, v = divmod(rest, r)
            out.append(v)
        if valid is None or valid(out[::-1]):
            return out[::-1]


def spelled(text: str, alphabets: list[str | None], key: bytes, tweak: str, back: bool, valid: Callable[[list[int]], bool] | None = None) -> str:
    """text with each character that has an alphabet permuted within it. `valid` is for values of one chunk."""
    at = [k for k, a in enumerate(alphabets) if a]
    out = list(text)
    parts = [at[k : k + CHUNK] for k in range(0, len(at), CHUNK)]

    def turned(part: list[int], own: str) -> None:
        values = slots([alphabets[k].index(out[k]) for k in part], [len(alphabets[k]) for k in part], key, own, valid, back)
        for k, v in zip(part, values):
            out[k] = alphabets[k][v]

    if len(parts) < 2:
        turned(at, tweak)
        return "".join(out)
    for way in (1, 0) if back else (0, 1):
        seen = hashlib.blake2b(f"{tweak}|{way}|{len(at)}".encode(), key=key[:64], digest_size=16).digest()
        for part in parts[::-1] if way else parts:
            new = "".join(out[k] for k in part) if back else ""
            turned(part, f"{tweak}|{seen.hex()}")
            new = new or "".join(out[k] for k in part)
            seen = hashlib.blake2b(seen + new.encode(), key=key[:64], digest_size=16).digest()
    return "".join(out)


def by_class(text: str) -> list[str | None]:
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def laid_out(template: str, chars: str) -> str:
    """chars in the places of the letters and digits of template."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in template)


def may_match(text: str) -> bool:
    """Whether text holds what every match of PATTERN needs: a digit, a sign, or the start of an access key."""
    return _SIGN.search(text) is not None


def ascii_digits(text: str) -> str:
    """text with the digits of all scripts as ASCII digits, character by character."""
    return _OTHER_DIGIT.sub(lambda m: str(int(m[0])), text)


def in_scripts(template: str, text: str) -> str:
    """text with its digits in the scripts of template's: by place, or by a number's first digit where lengths differ."""

    def like(old: str, digit: str) -> str:
        return chr(ord(old) - int(old) + int(digit)) if old.isdecimal() and digit.isdecimal() else digit

    if len(template) == len(text):
        return "".join(map(like, template, text))
    numbers = iter(re.findall(r"\d+", template))

    def number(m: re.Match) -> str:
        old = next(numbers)
        return "".join(map(like, old if len(old) == len(m[0]) else old[0] * len(m[0]), m[0]))

    return re.sub(r"\d+", number, text)


def _email(t: str, key: bytes, back: bool) -> str:
    name, _, host = t.rpartition("@")
    labels, _, last = host.rpartition(".")
    return spelled(f"{name}@{labels}", by_class(f"{name}@{labels}"), key, "email", back) + "." + last


def _issued(digits: list[int] | str) -> bool:
    """Whether a card's first digits are those of a payment network: 2221 to 2720, 30, 34 to 38, 4, 5 or 6."""
    first = int("".join(map(str, digits[:4])))
    return 2221 <= first <= 2720 or 3000 <= first < 3100 or 3400 <= first < 3900 or 4000 <= first < 7000


def _card(t: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", t)
    if not 13 <= len(d) <= 19 or not luhn(d) or not _issued(d):
        return None
    shorter = [n for n in (len(re.sub(r"\D", "", x)) for x in beginnings(t)) if n >= 13]

    def valid(v: list[int]) -> bool:
        own = str(v[0] + 2) + "".join(map(str, v[1:]))
        return _issued(own) and not any(luhn(own[:n]) for n in shorter)  # no shorter card is read where this one is

    body = spelled(d[:-1], ["23456", *[DIGITS] * (len(d) - 2)], key, "card", back, valid)
    return laid_out(t, body + next(c for c in DIGITS if luhn(body + c)))


def beginnings(t: str) -> list[str]:
    """What precedes each separator of t, the longest first."""
    return [t[:k] for k in range(len(t) - 1, 0, -1) if t[k] in " .-" and t[k - 1].isalnum()]


def _iban(t: str, key: bytes, back: bool) -> str | None:
    own = t.replace(" ", "")
    if not 15 <= len(own) <= 34 or iban_remainder(own) != 1:
        return None
    body = spelled(own[4:], by_class(own[4:]), key, "iban" + own[:2], back)
    return laid_out(t, f"{own[:2]}{98 - iban_remainder(own[:2] + '00' + body):02d}{body}")


def _date(t: str, key: bytes, back: bool) -> str | None:
    parts = re.findall(r"\d+", t)
    year_first = len(parts[0]) == 4
    y, m, d = map(int, parts if year_first else parts[::-1])
    month_first = not year_first and "/" in t and m > 12  # 12/31/1999
    if month_first:
        m, d = d, m
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    wide = len(parts[0]) + len(parts[1])
    # one- and two-digit days are told apart by the layout alone, so both spell all days
    while True:
        day = _turned_day(day, key, back)
        new = datetime.date.fromordinal(day)
        if new.day > 12 or not month_first:
            break
    if year_first:
        return new.isoformat()
    sep = "." if "." in t else "/"
    own = (new.month, new.day) if month_first else (new.day, new.month)
    return sep.join([*(f"{x:02d}" if wide == 4 else str(x) for x in own), f"{new.year:04d}"])


def _turned_day(day: int, key: bytes, back: bool) -> int:
    if FIRST_DAY <= day <= LAST_DAY:
        return FIRST_DAY + permuted(day - FIRST_DAY, USUAL_DAYS, key, "date", back)
    rest = permuted(day - 1 if day < FIRST_DAY else day - 1 - USUAL_DAYS, ALL_DAYS - USUAL_DAYS, key, "far date", back) + 1
    return rest if rest < FIRST_DAY else rest + USUAL_DAYS


def _ip(t: str, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in t.split(".")]
    return ".".join(map(str, slots(octets, [256] * 4, key, "ip", _long_octet, back))) if max(octets) < 256 and _long_octet(octets) else None


def _long_octet(octets: list[int]) -> bool:
    return max(octets) > 9


def _ipv6(t: str, key: bytes, back: bool) -> str | None:
    try:
        ipaddress.IPv6Address(t)
    except ValueError:
        return None
    if len([x for x in t.split(":") if x]) < 3:
        return None
    return spelled(t, [next((a for a in (DIGITS, LOWER[:6], UPPER[:6]) if c in a), None) for c in t], key, "ipv6", back)


def _ssn_valid(v: list[int]) -> bool:
    area = v[0] * 100 + v[1] * 10 + v[2]
    return area not in (0, 666) and area < 900 and any(v[3:5]) and any(v[5:])


def _ssn(t: str, key: bytes, back: bool) -> str | None:
    if not _ssn_valid([int(c) for c in t if c != "-"]):
        return None
    return spelled(t, by_class(t), key, "ssn", back, _ssn_valid)


def _phone(t: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", t)
    code = len(re.match(r"\+?(\d*)", t)[1]) if t[0] == "+" else 0
    if code > 3:  # nothing between the country's code and the number: one digit for 1 and 7, else taken as two
        code = 1 if d[0] in "17" else 2
    if not 7 <= len(d) - code <= 14 or len(d) > 15 or d[:code] == "1" and len(d) != 11:
        return None
    national = d[code:]
    high = "23456789"
    north = len(national) == 10 and national[0] in high and national[3] in high and d[:code] in ("", "1")
    own = spelled(national, [high if north and k in (0, 3) else DIGITS for k in range(len(national))], key, "phone" + d[:code], back)
    return laid_out(t, d[:code] + own)


def _access(t: str, key: bytes, back: bool) -> str:
    own = _ACCESS_NAME.match(t)[0]
    upper = own in ("AKIA", "ASIA")
    return own + spelled(t[len(own) :], [DIGITS + UPPER] * (len(t) - 4) if upper else by_class(t[len(own) :]), key, "access", back)


def _secret(t: str, key: bytes, back: bool) -> str:
    hexes = not set(t) - set(HEX)
    return spelled(t, [HEX] * len(t) if hexes else by_class(t), key, "hex" if hexes else "secret", back)


KINDS = {"email": _email, "access": _access, "iban": _iban, "date": _date, "ip": _ip, "ipv6": _ipv6, "ssn": _ssn, "card": _card, "phone": _phone}


def rewriter(key: bytes, back: bool = False) -> Callable[[str | None], tuple[str | None, list[str]]]:
    """A function text -> (text with pseudonyms, the kinds replaced in order). back=True inverts it."""

    def turned(kind: str, t: str) -> str | None:
        plain = ascii_digits(t)
        if plain != t and kind in ("access", "secret"):  # digits stay digits, so that their script stays
            own = len(_ACCESS_NAME.match(plain)[0]) if kind == "access" else 0
            new = plain[:own] + spelled(plain[own:], by_class(plain[own:]), key, kind, back)
        else:
            new = _secret(plain, key, back) if kind == "secret" else KINDS[kind](plain, key, back)
        return new if new is None or plain == t else in_scripts(t, new)

    remembered = lru_cache(maxsize=20_000)(turned)

    def one(kind: str, t: str) -> str | None:
        return remembered(kind, t) if len(t) <= REMEMBERED else turned(kind, t)

    def accepted(kind: str, t: str) -> tuple[str, str] | None:
        """The beginning of t that is valid, and its pseudonym: a number may run into the next one."""
        tries = [t]
        if kind in ("card", "iban", "phone"):
            tries += beginnings(t)
        for own in reversed(tries) if kind == "card" else tries:
            new = one(kind, own)
            if new is not None:
                return own, new
        return None

    def replaced(line: str, kinds: list[str]) -> str:
        plain = line if line.isascii() else ascii_digits(line)  # the same places
        out, done, at = [], 0, 0
        while m := PATTERN.search(plain, at):
            if m["secret"] is not None:
                kind, start, own = "secret", m.start("value"), line[m.start("value") : m.end("value")]
            else:
                kind, start, own = m.lastgroup, m.start(), line[m.start() : m.end()]
            found = accepted(kind, own)
            if found is None:  # what follows the first run of letters and digits may still be something
                at = start + next((k for k, c in enumerate(own) if k and not c.isalnum()), len(own))
                continue
            out += line[done:start], found[1]
            done = at = start + len(found[0])
            kinds.append(kind)
        return "".join([*out, line[done:]]) if done else line

    def rewrite(text: str | None) -> tuple[str | None, list[str]]:
        kinds: list[str] = []
        if not text or not may_match(text):
            return text, kinds
        lines = [replaced(line, kinds) if may_match(line) else line for line in text.split("\n")]
        return "\n".join(lines), kinds

    return rewrite


def session_key(spark: SparkSession, demonstration: bool = False) -> bytes:
    """The key that spark.quire.pseudonym.key names. Without one this fails, unless the caller asks for a demonstration."""
    own = spark.conf.get("spark.quire.pseudonym.key", None)
    if own:
        return own.encode()
    if not demonstration:
        raise ValueError("set spark.quire.pseudonym.key: pseudonyms under a public key can be inverted by anyone")
    return DEMO_KEY


def pseudonymised(docs: DataFrame, key: bytes | None = None, back: bool = False, column: str = "text") -> DataFrame:
    """docs with personal data in `column` replaced; all columns stay."""
    key = key or session_key(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        rewrite = rewriter(key, back)
        return texts.map(lambda t: rewrite(t)[0])

    return docs.withColumn(column, run(column))


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text (with pseudonyms), n_values, kinds (the distinct kinds, sorted)."""
    key = key or session_key(docs.sparkSession)

    @F.pandas_udf("text string, n_values long, kinds array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rewrite = rewriter(key)
        rows = [rewrite(t) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in rows], "n_values": [len(k) for _, k in rows], "kinds": [sorted({*k}) for _, k in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("r")).select("doc_id", "r.text", "r.n_values", "r.kinds")
