"""Pseudonyms for personal data: validated values are permuted, by a keyed Feistel network, within their format.

What is permuted is the value, not the way it is written: a date, a phone number, an account number or an address
gets one pseudonym, which is written in the form of each place. Equal values thus stay linked across documents, and
different values get different ones. No value is its own pseudonym: the network and its inverse stand around a step
to the next value. What only looks like personal data (a number whose check digit is wrong, an octet over 255)
stays. Only DataFrame functions run here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SV": 28, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_DIGIT = r"(?<![0-9])"
_END = r"(?![0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    forms = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{forms})(?![A-Za-z0-9])"


#: What may be personal data, by kind, in order of precedence. Runs of any length are possessive and start at their
#: first character, so that time is linear and the matcher's stack doesn't grow with the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:\b(?:token|secret|api_?key|password)\b[ ]?[=:][ ]?\"[A-Za-z0-9_/+-]{16,}+\")",
    "iban": _iban_pattern(),
    "phone": "|".join([
        r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,5})){2,5}+" + _END,
        r"(?<![0-9+])\([0-9]{2,4}\) ?[0-9]{3,4}[- .][0-9]{3,4}" + _END,
        r"(?<![0-9.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})(?![0-9]|[.-][0-9])",
    ]),
    "ssn": _DIGIT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _DIGIT + r"(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19})" + _END,
    "ip": r"(?<![0-9.])(?<![vV])(?<!(?i:version|release|revision|build|firmware)[ :=])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]{{0,3}}[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "date": _DIGIT + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Forms of dates by how they look; of several forms that look alike the first that names a real day holds.
DATE_FORMS = (
    (r"....-..-..", "yyyy-MM-dd"), (r"..../../..", "yyyy/MM/dd"), (r"..\...\.....", "dd.MM.yyyy"), (r"../../....", "MM/dd/yyyy"), (r"../../....", "dd/MM/yyyy"),
    (r"..?\...?\.....", "d.M.yyyy"), (r"..?/..?/....", "M/d/yyyy"), (r"..?/..?/....", "d/M/yyyy"),
)
#: Letters that stand for hex digits while these are permuted.
_HEX_DIGITS, HEX_LETTERS = "0123456789abcdef", "".join(map(chr, range(224, 240)))
#: Dates are permuted among 319 * 229 days: two centuries, 1900-01-01 to 2100-01-02.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229
#: Country codes of phone numbers by their first digits (others have three), and issuers' prefixes of cards with their lengths.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[0-9]{15}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6[0-9]{15,18})$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _shifted(text: Column, by: Column, sign: int = 1) -> Column:
    """Each digit and Latin letter of text, and each of HEX_LETTERS, moved on, or back, within its kind by 4 hex digits of ``by``."""

    def move(c: Column, k: Column) -> Column:
        code, n = F.ascii(c), _number(F.substring(by, (F.pmod(k, F.lit(32)) * 4 + 1).cast("int"), F.lit(4))) * sign

        def within(low: int, size: int) -> Column:
            return F.char(F.lit(low) + F.pmod(code - low + n, F.lit(size)))

        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).when(code.between(224, 239), within(224, 16)).otherwise(c)

    return F.array_join(F.transform(_chars(text), move), "")


def _feistel(left: Column, right: Column, change: Callable[[Column, Column, Column, int], Column], back: bool = False) -> Column:
    """Struct (l, r) after all rounds, or with all rounds undone; change(half, other half, round, sign) is undone by the other sign."""
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(change(s["l"], s["r"], i, sign).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), change(s["r"], s["l"], i, sign).alias("r")))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(left.alias("l"), right.alias("r")), step)


def _moved(left: Column, right: Column, change: Callable[[Column, Column, Column, int], Column], next_one: Callable[[Column], Column]) -> Column:
    """Struct (l, r): the network, a step to another value, and the network undone. Nothing stays where it is."""
    return _let(_let(_feistel(left, right, change), next_one), lambda s: _feistel(s["l"], s["r"], change, back=True))


def _keyed(key: str, kind: Column | str, i: Column, rest: Column) -> Column:
    return F.concat(F.lit(f"{key}|"), kind if isinstance(kind, Column) else F.lit(kind), F.lit("|"), i.cast("string"), F.lit("|"), rest)


def permute_text(text: Column, key: str, kind: Column | str) -> Column:
    """A bijection without fixed points among texts of text's format: digits and letters change within their kind, the rest stays.

    The 16 letters of HEX_LETTERS are a kind too. A text without digits and letters is the only one of its format and stays.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    one = F.lit("0001" * 32)

    def change(x: Column, y: Column, i: Column, sign: int) -> Column:
        return _let(F.sha2(_keyed(key, kind, i, y), 512), lambda h: _shifted(x, h, sign))

    def next_one(s: Column) -> Column:
        return F.struct(_shifted(s["l"], one).alias("l"), _shifted(s["r"], one).alias("r"))

    return _let(_moved(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), change, next_one), lambda s: F.concat(s["l"], s["r"]))


def permute_pair(left: Column, right: Column, sizes: tuple[Column | int, Column | int], key: str, kind: Column | str) -> Column:
    """Struct (l, r): a bijection without fixed points among pairs of numbers below sizes; the second size is two at least."""
    low, high = (s if isinstance(s, Column) else F.lit(s) for s in sizes)

    def change(x: Column, y: Column, i: Column, sign: int) -> Column:
        size = F.when(i % 2 == 1, low).otherwise(high)
        return F.pmod(x + sign * _number(F.substring(F.sha2(_keyed(key, kind, i, y.cast("string")), 256), 1, 12)), size).cast("long")

    def next_one(s: Column) -> Column:
        return F.struct(s["l"].alias("l"), F.pmod(s["r"] + 1, high).cast("long").alias("r"))

    return _moved(left.cast("long"), right.cast("long"), change, next_one)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last of which counts once."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, k: F.when(k % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _filled(form: Column, value: Column, slots: str = "[0-9]") -> Column:
    """form with the characters that are slots replaced by value's, in order."""

    def place(c: Column, k: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(form, F.lit(1), (k + 1).cast("int")), f"[^{slots[1:]}", ""))
        return F.when(c.rlike(slots), F.substring(value, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(form), place), "")


def _mod97(text: Column) -> Column:
    digits = F.array_join(F.transform(_chars(text), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(_chars(digits), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))


# --- reading: a match's value as a struct, null if it isn't valid ----------------------------------------------
# kind, note (what writing needs besides), and one of: text, digits (1 to 18), or l and r below a and b.

_FIELDS = {"kind": "string", "note": "string", "text": "string", "digits": "string", "l": "long", "r": "long", "a": "long", "b": "long"}


def _value(kind: str, **fields: Column) -> Column:
    own = {"kind": F.lit(kind), **fields}
    return F.struct(*[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()])


def _read_email(m: Column) -> Column:
    """All but the last part of the domain, whatever its case."""
    return _value("email", text=F.lower(F.substring(m, F.lit(1), F.length(m) - F.length(F.substring_index(m, ".", -1)) - 1)))


def _read_secret(m: Column) -> Column:
    """What stands between the quotes."""
    return _value("secret", text=F.substring(m, F.instr(m, '"') + 1, F.length(m)))


def _read_iban(m: Column) -> Column:
    """An account number, with or without spaces, whose remainder by 97 is right: what follows its check digits."""

    def plain(x: Column) -> Column:
        rest = F.substring(x, F.lit(5), F.length(x))
        return F.when(_mod97(F.concat(rest, F.substring(x, 1, 4))) == 1, _value("iban", text=rest, note=F.substring(x, 1, 2)))

    return _let(F.regexp_replace(m, " ", ""), plain)


def _read_phone(m: Column) -> Column:
    """The country code, if any, is the note; the other digits, 7 to 14 of them, are one number."""

    def coded(code: Column) -> Column:
        return _let(_digits(F.substring(m, F.length(code) + 1, F.length(m))), lambda d: F.when(F.length(d).between(7, 14), _value("phone", digits=d, note=code)))

    known = F.regexp_extract(m, COUNTRY_CODE, 0)
    return _let(F.when(known != "", known).otherwise(F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)), coded)


def _read_card(m: Column) -> Column:
    """A number with an issuer's prefix and a right Luhn digit: all between the first two digits, which are the note, and the last."""
    return _let(_digits(m), lambda d: F.when(d.rlike(CARD) & (F.pmod(luhn_sum(d), F.lit(10)) == 0), _value("card", digits=F.substring(d, F.lit(3), F.length(d) - 3), note=F.substring(d, 1, 2))))


def _read_ssn(m: Column) -> Column:
    """Area not 000, 666 or 9xx, group and serial not 0: one of 898 areas, and one of 99 * 9999 groups with serials."""
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(ok, _value("ssn", l=F.when(area > 666, area - 2).otherwise(area - 1), r=(group - 1) * 9999 + serial - 1, a=F.lit(898), b=F.lit(99 * 9999)))


def _read_ip(m: Column) -> Column:
    """Four octets up to 255, without leading zeros."""

    def pair(o: Column) -> Column:
        at = [F.element_at(o, k).cast("long") for k in (1, 2, 3, 4)]
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x))
        return F.when(valid, _value("ip", l=at[0] * 256 + at[1], r=at[2] * 256 + at[3], a=F.lit(65536), b=F.lit(65536)))

    return _let(F.split(m, r"\."), pair)


def _read_ipv6(m: Column) -> Column:
    """Eight groups of 16 bits, zeros left out or not; more than eight aren't valid."""

    def whole(sides: Column) -> Column:
        named = F.aggregate(sides, F.lit(0), lambda a, s: a + F.size(s))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - named, F.lit(0)))
        groups = F.when(F.size(sides) == 2, F.concat(F.element_at(sides, 1), zeros, F.try_element_at(sides, F.lit(2)))).otherwise(F.element_at(sides, 1))
        return F.when(named <= 8, _value("ipv6", text=F.translate(F.lower(F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")), _HEX_DIGITS, HEX_LETTERS)))

    return _let(F.transform(F.split(m, "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != "")), whole)


def _read_date(m: Column) -> Column:
    """A real day in one of DATE_FORMS, the form as the note; with slashes, month/day/year comes first."""
    first = F.lit(FIRST_DAY).cast("date")
    days = [F.when(m.rlike(rf"\A{look}\z"), F.struct(F.lit(form).alias("form"), F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first).cast("long").alias("n"))) for look, form in DATE_FORMS]
    real = F.filter(F.array(*days), lambda d: d["n"].between(0, DAYS_A * DAYS_B - 1))
    return _let(F.try_element_at(real, F.lit(1)), lambda d: F.when(d.isNotNull(), _value("date", note=d["form"], l=F.floor(d["n"] / DAYS_B), r=F.pmod(d["n"], F.lit(DAYS_B)), a=F.lit(DAYS_A), b=F.lit(DAYS_B))))


# --- writing: the pseudonym of value v, as struct p (text, digits, l, r), in the form of match m ----------------


def _write_email(m: Column, v: Column, p: Column) -> Column:
    """In the case of the place, and with the domain's last part."""
    n = F.length(v["text"])
    cased = F.zip_with(_chars(F.substring(m, F.lit(1), n)), _chars(p["text"]), lambda o, x: F.when(F.ascii(o).between(65, 90), F.upper(x)).otherwise(x))
    return F.concat(F.array_join(cased, ""), F.substring(m, n + 1, F.length(m)))


def _write_secret(m: Column, v: Column, p: Column) -> Column:
    return F.concat(F.substring(m, F.lit(1), F.instr(m, '"')), p["text"])


def _write_iban(m: Column, v: Column, p: Column) -> Column:
    """With right check digits, and m's spaces."""
    check = F.lpad((98 - _mod97(F.concat(p["text"], v["note"], F.lit("00")))).cast("string"), 2, "0")
    return _let(F.concat(v["note"], check, p["text"]), lambda x: _filled(m, x, "[A-Z0-9]"))


def _write_phone(m: Column, v: Column, p: Column) -> Column:
    return F.concat(v["note"], _filled(F.substring(m, F.length(v["note"]) + 1, F.length(m)), p["digits"]))


def _write_card(m: Column, v: Column, p: Column) -> Column:
    """With a right Luhn digit."""
    return _let(F.concat(v["note"], p["digits"]), lambda q: _filled(m, F.concat(q, F.pmod(-luhn_sum(F.concat(q, F.lit("0"))), F.lit(10)).cast("string"))))


def _write_ssn(m: Column, v: Column, p: Column) -> Column:
    area = F.when(p["l"] + 1 >= 666, p["l"] + 2).otherwise(p["l"] + 1)
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(p["r"], F.lit(9999)) + 1).cast("string"), 4, "0"))


def _write_ip(m: Column, v: Column, p: Column) -> Column:
    return F.concat_ws(".", *[x.cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), F.pmod(h, F.lit(256)))])


def _write_ipv6(m: Column, v: Column, p: Column) -> Column:
    """All eight groups."""
    hexes = F.translate(p["text"], HEX_LETTERS, _HEX_DIGITS)
    return F.concat_ws(":", *[F.regexp_replace(F.substring(hexes, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)])


def _write_date(m: Column, v: Column, p: Column) -> Column:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int"))
    out = F.lit(None).cast("string")
    for form in {form for _, form in DATE_FORMS}:
        out = F.when(v["note"] == form, F.date_format(day, form)).otherwise(out)
    return out


READ = {"email": _read_email, "secret": _read_secret, "iban": _read_iban, "phone": _read_phone, "ssn": _read_ssn, "card": _read_card, "ip": _read_ip, "ipv6": _read_ipv6, "date": _read_date}
WRITE = {"email": _write_email, "secret": _write_secret, "iban": _write_iban, "phone": _write_phone, "ssn": _write_ssn, "card": _write_card, "ip": _write_ip, "ipv6": _write_ipv6, "date": _write_date}


def _permuted(v: Column, key: str) -> Column:
    """Struct (text, digits, l, r): the pseudonym of value v."""
    n = F.length(v["digits"])
    half = F.floor(n / 2).cast("int")

    def tens(k: Column) -> Column:
        return F.pow(F.lit(10.0), k).cast("long")

    left = F.coalesce(v["l"], F.substring(v["digits"], F.lit(1), half).try_cast("long"), F.lit(0).cast("long"))
    right = F.coalesce(v["r"], F.substring(v["digits"], half + 1, n).cast("long"))
    pair = F.when(v["text"].isNull(), permute_pair(left, right, (F.coalesce(v["a"], tens(half)), F.coalesce(v["b"], tens(n - half))), key, v["kind"]))
    text = F.when(v["text"].isNotNull(), permute_text(v["text"], key, v["kind"]))

    def named(p: Column) -> Column:
        digits = F.concat(F.when(half > 0, F.lpad(p["l"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(p["r"].cast("string"), n - half, F.lit("0")))
        return F.struct(text.alias("text"), digits.alias("digits"), p["l"].alias("l"), p["r"].alias("r"))

    return _let(pair, named)


def pseudonym(m: Column, secret_key: str) -> Column:
    """Struct (kind, value) of a match: the kind is null where the value isn't valid and so stays."""
    key = hashlib.sha256(secret_key.encode()).hexdigest()

    def written(v: Column, p: Column) -> Column:
        out = m
        for name in reversed(PATTERNS):
            out = F.when(v["kind"] == name, WRITE[name](m, v, p)).otherwise(out)
        return F.struct(v["kind"].alias("kind"), out.alias("value"))

    found = F.lit(None)
    for name in reversed(PATTERNS):
        found = F.when(m.rlike(rf"\A(?:{PATTERNS[name]})\z"), READ[name](m)).otherwise(found)
    return _let(found, lambda v: F.when(v.isNull(), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))).otherwise(_let(_permuted(v, key), lambda p: written(v, p))))


def pseudonymised(docs: DataFrame, secret_key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the personal data in ``text`` replaced, and in ``found``, if named, the array of kinds replaced.

    Whole texts are searched, however long. Null stays null and an empty text empty (no kinds), rows keep their number and
    repeated rows stay alike, an empty table gives an empty one; other columns keep their values, whatever their names, but for one
    that is named as ``found``, whose place it takes.
    """
    # ``split`` gives what lies between the matches that ``regexp_extract_all`` gives.
    column, own = F.col(f"`{text}`"), fresh(docs, "__pii__")
    matches = F.transform(F.regexp_extract_all(column, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, secret_key))
    gaps = F.split(column, ANY, -1)
    done = docs.select("*", F.when(column.rlike(ANY), F.struct(gaps.alias("gaps"), matches.alias("new"))).alias(own))
    replaced = F.array_join(F.zip_with(F.col(f"{own}.gaps"), F.col(f"{own}.new"), lambda g, m: F.concat(g, F.coalesce(m["value"], F.lit("")))), "")
    columns = [(F.when(F.col(own).isNull(), column).otherwise(replaced).alias(text) if c == text else F.col(f"`{c}`")) for c in docs.columns if c != found]
    if found:
        columns.append(F.coalesce(F.filter(F.transform(F.col(f"{own}.new"), lambda m: m["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")).alias(found))
    return done.select(*columns)
