"""Format-preserving pseudonyms for personal data.

Every value found is validated (Luhn for cards, the calendar for dates, mod 97 for IBANs, ranges for
addresses and social security numbers) and then permuted within its format by a keyed Feistel
network with cycle walking, so that equal values get equal pseudonyms in every document, different
values different ones, and lengths, separators and check digits stay valid. What fails validation
is left as it is.

Kinds: card, iban, ssn, phone, ipv4, date, email (its local part), secret (keys and tokens).
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import columns_of, free_name, quoted

#: Public, so good for tests and demonstrations only: whoever has it can undo pseudonyms. Operators take a key and have no default.
DEMO_KEY = b"demonstration key, not a secret"
ROUNDS = 8
#: Characters of a secret or name that are permuted as one number (its halves are narrower than the round function's 512 bits); longer ones as characters.
WIDE = 128
KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email", "secret")
DAY_ONE, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # up to 2099-12-31


def permute(key: bytes, tweak: str, value: int, size: int, fits: Callable[[int], bool] = lambda x: True) -> int:
    """A keyed permutation of those of 0..size-1 that fit; value must be one of them.

    Balanced Feistel over the least even number of bits that holds size, walked along its cycle
    until the value fits again, which keeps it a permutation of the fitting values.
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, salt, width = (1 << half) - 1, tweak.encode(), (half + 7) // 8
    if width + 8 > 64:
        raise ValueError("too wide for one round function")
    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(b.to_bytes(width, "big") + bytes([r]) + salt, key=key, digest_size=width + 8).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        value = (a << half) | b
        if value < size and fits(value):
            return value


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced, in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda m: next(it), text)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _card(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(permute(key, f"card{len(d)}", int(d[:-1]), 10 ** (len(d) - 1), lambda x: len(set(f"{x:0{len(d) - 1}}")) > 1)).zfill(len(d) - 1)
    return _refill(text, body + luhn_digit(body))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(key: bytes, text: str) -> str | None:
    flat = text.replace(" ", "").upper()
    if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
        return None
    body = flat[4:]
    digits = _digits(body)
    new = _refill(body, str(permute(key, "iban" + flat[:2] + re.sub(r"\d", "0", body), int(digits or 0), 10 ** len(digits))).zfill(len(digits)) if digits else "")
    whole = iter(flat[:2] + f"{98 - _mod97(flat[:2] + '00' + new):02}" + new)
    return re.sub(r"[A-Za-z0-9]", lambda m: next(whole), text)


def _ssn_fits(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(key: bytes, text: str) -> str | None:
    x = int(_digits(text))
    return _refill(text, f"{permute(key, 'ssn', x, 10**9, _ssn_fits):09}") if _ssn_fits(x) else None


def _phone(key: bytes, text: str) -> str | None:
    """+1 or a bare number of the same plan: ten digits are permuted; else all after the + but two."""
    d = _digits(text)
    if text[0] == "+" and d[0] != "1":
        if not 8 <= len(d) <= 15:
            return None
        return _refill(text, d[:2] + str(permute(key, f"phone{d[:2]}-{len(d)}", int(d[2:]), 10 ** (len(d) - 2))).zfill(len(d) - 2))
    if len(d) not in (10, 11) or len(d) == 11 and d[0] != "1":
        return None
    return _refill(text, d[:-10] + f"{permute(key, 'phone1', int(d[-10:]), 10**10):010}")


def _ipv4(key: bytes, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = permute(key, "ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _reading(a: int, b: int, y: int) -> tuple[str, datetime.date] | None:
    """How a/b/y reads as a date: month first if it can, else day first."""
    for how, m, d in (("mdy", a, b), ("dmy", b, a)):
        try:
            return how, datetime.date(y, m, d)
        except ValueError:
            continue
    return None


def _date(key: bytes, text: str) -> str | None:
    parts = re.split(r"(\D)", text)
    n = [int(x) for x in parts[::2]]
    try:
        if len(parts[0]) == 4:
            how, day = "ymd", datetime.date(*n)
        elif parts[1] == ".":
            how, day = "dmy.", datetime.date(n[2], n[1], n[0])
        else:
            how, day = _reading(*n) or ("", None)
    except ValueError:
        return None
    if day is None or not 0 <= day.toordinal() - DAY_ONE < DAYS:
        return None
    # a date that only reads day first keeps doing so, and one without leading zeros has none to lose
    plain = len(parts[0]) == 1 or len(parts[2]) == 1

    def fits(x: int) -> bool:
        d = datetime.date.fromordinal(x + DAY_ONE)
        return (how != "dmy" or d.day > 12) and (not plain or d.day < 10 or d.month < 10)

    # one day is one pseudonym in every notation but those that not all days have
    form = f"{how}{plain:d}" if plain or how == "dmy" else ""
    new = datetime.date.fromordinal(permute(key, f"date{form}", day.toordinal() - DAY_ONE, DAYS, fits) + DAY_ONE)
    field = {"y": f"{new.year:04}", "m": str(new.month) if plain else f"{new.month:02}", "d": str(new.day) if plain else f"{new.day:02}"}
    return field[how[0]] + parts[1] + field[how[1]] + parts[3] + field[how[2]]


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _wide(key: bytes, tweak: str, text: str, own: list[str]) -> str:
    """A Feistel network over the characters themselves, for texts too long for one number.

    Each round adds a keyed stream of the other half, a value a character, to one half's places in
    their sets. Every character depends on all others; time is linear.
    """
    at = [i for i, s in enumerate(own) if s]
    halves = [at[: len(at) // 2], at[len(at) // 2 :]]
    out, salt = list(text), b"%d,%d," % (len(key), len(tweak)) + key + hashlib.sha256(tweak.encode()).digest()
    for r in range(ROUNDS):
        to, of = halves[r % 2], halves[1 - r % 2]
        stream = hashlib.shake_256(salt + bytes([r]) + "".join(out[i] for i in of).encode()).digest(8 * len(to))
        for n, i in enumerate(to):
            out[i] = own[i][(own[i].index(out[i]) + int.from_bytes(stream[8 * n : 8 * n + 8], "big")) % len(own[i])]
    return "".join(out)


def _mixed(key: bytes, tweak: str, text: str, sets: tuple[str, ...] = _SETS) -> str:
    """Each character permuted within its set (all together); others stay."""
    own = [next((s for s in sets if c in s), "") for c in text]
    tweak += "".join(str(len(s)) if s else c for c, s in zip(text, own, strict=True))
    if sum(map(bool, own)) > WIDE:
        return _wide(key, tweak, text, own)
    value, size = 0, 1
    for c, s in zip(text, own, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    if size == 1:
        return text
    value, out = permute(key, tweak, value, size), []
    for c, s in zip(reversed(text), reversed(own), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _email(key: bytes, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return _mixed(key, "email@" + domain.lower(), local) + "@" + domain


def _secret(key: bytes, text: str) -> str | None:
    lower, upper = "0123456789abcdef", "0123456789ABCDEF"
    if len(text) >= 16 and not set(text) - set(lower):
        return _mixed(key, "hex", text, (lower,))
    if len(text) >= 16 and not set(text) - set(upper):
        return _mixed(key, "HEX", text, (upper,))
    if re.match(r"AKIA|ASIA", text):
        return text[:4] + _mixed(key, "secret", text[4:])
    m = re.match(r"(?:gh[pousr]_|sk-|xox[a-z]-)?", text)
    return m[0] + _mixed(key, "secret", text[m.end() :])


_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key")


def _after(*separators: str) -> str:
    """Right behind one of the names and one of the separators."""
    return "(?i:" + "|".join(rf"(?<=\b{n}{s})" for n in _NAMES for s in separators) + ")"


#: What is assigned to a name: anything in quotes; else a word of eight characters and more with a digit among its first 256.
_QUOTED = r"(?<=\")" + _after('="', '= "', ' = "', ':"', ': "') + r"[^\s\"]{8,}(?=\")"
_BARE = "(?:(?<=[=:])" + _after("=", ":", " =", " :") + "|(?<=[=:] )" + _after("= ", ": ", " = ") + r")(?=[^\s\"]{0,255}\d)[A-Za-z0-9][A-Za-z0-9+/_=~.-]{6,}[A-Za-z0-9]"

#: Tried at each place in this order; where no reading validates, the search goes on at the next place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": rf"{_QUOTED}|{_BARE}|" + r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-])(?!\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?<!\d[.-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}(?:[ .-]\d(?=[ .-]))?(?:[ .-]?(?:\(\d{1,4}\)|\d{2,5})){2,5}|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d.])(?<!\d-)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
}
#: What a text must contain to hold a value of a kind; every match of PATTERNS has it.
NEEDS = {k: "[0-9]" for k in PATTERNS} | {"email": "@", "secret": f"(?i:{'|'.join(_NAMES)}) ?[=:]|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-"}
_WORK = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date, "email": _email, "secret": _secret}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
_BY_KIND = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}


#: Where a reading may be cut short: before the separators of its groups.
_CUT = re.compile(r"(?<=[A-Za-z0-9)])(?=[ .(-])")


def _readings(text: str, kind: str, at: int) -> Iterator[re.Match]:
    """How text reads as this kind at a place: the whole match, then without its last groups, one by one."""
    if own := _BY_KIND[kind].match(text, at):
        yield own
        if kind in ("iban", "phone"):  # the only ones of open length that can fail
            for cut in reversed([c.start() for c in _CUT.finditer(text, at, own.end()) if c.start() < own.end()]):
                if less := _BY_KIND[kind].fullmatch(text, at, cut):
                    yield less


def _cuts_into(text: str, own: re.Match, key: bytes) -> bool:
    """Does a reading end inside a valid value of fixed form that begins in it?"""
    for c in _CUT.finditer(text, own.start(), own.end()):
        for kind in ("ipv4", "date", "ssn", "card"):
            other = _BY_KIND[kind].match(text, c.start() + 1)
            if other and c.start() + 1 < own.end() < other.end() and _WORK[kind](key, other[0]) is not None:
                return True
    return False


def _value(text: str, kind: str, at: int, key: bytes) -> tuple[re.Match, str] | None:
    """The longest valid reading that cuts into no other value, else the longest valid one; and its pseudonym."""
    first = None
    for own in _readings(text, kind, at):
        if (new := _WORK[kind](key, own[0])) is not None:
            if kind not in ("iban", "phone") or not _cuts_into(text, own, key):
                return own, new
            first = first or (own, new)
    return first


def pseudonymise(text: str, key: bytes, kinds: tuple[str, ...] = KINDS) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and its finds (kind, place and length in the text as given)."""
    out, done, finds = [], 0, []
    at, order = 0, sorted(PATTERNS, key=lambda k: k not in kinds)
    while m := _ANY.search(text, at):
        # the first kind in order that validates here wins; a valid value of a kind not asked for is passed over
        for kind in order:
            if got := _value(text, kind, m.start(), key):
                own, new = got
                at = own.end()
                if kind in kinds:
                    out += [text[done : own.start()], new]
                    done = at
                    finds.append({"kind": kind, "at": own.start(), "n": len(own[0])})
                break
        else:
            at = m.start() + 1  # a value may begin inside what did not validate
    return "".join([*out, text[done:]]), finds


def key_of(spark: SparkSession) -> bytes:
    """The key that a session names in spark.stackwright.pii.key; the demonstration key, with a warning, where it names none."""
    if key := spark.conf.get("spark.stackwright.pii.key", None):
        return key.encode()
    warnings.warn("spark.stackwright.pii.key is not set: pseudonyms with the demonstration key can be undone by anyone", stacklevel=2)
    return DEMO_KEY


def scrub(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = KINDS, column: str = "text", finds: str = "pii") -> DataFrame:
    """docs with column pseudonymised and an array of finds (kind, at, n) beside it.

    key is the caller's secret: with it, pseudonyms can be made and undone. Null and empty texts
    stay as they are, with no finds; a text of any length is read whole; repeated rows give repeated
    results; an empty table gives none. Where values overlap, the one that begins first wins, of
    those at one place the first kind of PATTERNS that validates. A column named like finds is
    replaced; all others stay, whatever their names. Only texts that have what NEEDS lists go to
    Python; nothing is shuffled.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")

    @F.pandas_udf("text string, finds array<struct<kind: string, at: int, n: int>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            got = [pseudonymise(t, key, kinds) if t else (None, []) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in got], "finds": [f for _, f in got]})

    kept, made = columns_of(docs, finds), free_name(docs, "_pii")
    text = F.col(quoted(column))
    some = F.when(text.rlike("|".join(dict.fromkeys(NEEDS.values()))), text)
    rows = docs.select(*kept, of(some).alias(made))
    return rows.withColumns({column: F.coalesce(F.col(f"{made}.text"), text), finds: F.col(f"{made}.finds")}).drop(made)
