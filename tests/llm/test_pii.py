"""Pseudonyms against a version in plain Python, and what has to hold for each kind."""

import datetime
import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from framesieve.llm import pii, queries

SECRET = "k"
KEY = hashlib.sha256(SECRET.encode()).hexdigest()


# --- a plain version: the same network, written over Python's numbers and strings ---------------------------


def network(left, right, change, next_one):
    for i in range(1, pii.ROUNDS + 1):
        left, right = (change(left, right, i, 1), right) if i % 2 else (left, change(right, left, i, 1))
    left, right = next_one(left, right)
    for i in range(pii.ROUNDS, 0, -1):
        left, right = (change(left, right, i, -1), right) if i % 2 else (left, change(right, left, i, -1))
    return left, right


def shift(text, by):
    out = ""
    for k, c in enumerate(text):
        low, size = next(((ord(a), n) for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)) if a <= c <= z), (0, 0))
        out += chr(low + (ord(c) - low + by(k)) % size) if size else c
    return out


def text_of(text, key, kind):
    def change(x, y, i, sign):
        d = hashlib.sha512(f"{key}|{kind}|{i}|{y}".encode()).hexdigest()
        return shift(x, lambda k: sign * int(d[k % 32 * 4 : k % 32 * 4 + 4], 16))

    half = len(text) // 2
    return "".join(network(text[:half], text[half:], change, lambda a, b: (shift(a, lambda k: 1), shift(b, lambda k: 1))))


def pair_of(left, right, sizes, key, kind):
    def change(x, y, i, sign):
        return (x + sign * int(hashlib.sha256(f"{key}|{kind}|{i}|{y}".encode()).hexdigest()[:12], 16)) % sizes[(i + 1) % 2]

    return network(left, right, change, lambda a, b: (a, (b + 1) % sizes[1]))


def digits_of(digits, key, kind):
    half = len(digits) // 2
    a, b = pair_of(int(digits[:half] or 0), int(digits[half:]), (10**half, 10 ** (len(digits) - half)), key, kind)
    return (f"{a:0{half}}" if half else "") + f"{b:0{len(digits) - half}}"


def fill(form, value, slots):
    rest = iter(value)
    return "".join(next(rest) if regex.match(slots, c) else c for c in form)


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def plain(kind, m, key):
    d = regex.sub("[^0-9]", "", m)
    if kind == "email":
        end = m.rindex(".")
        return "".join(n.upper() if o.isupper() else n for o, n in zip(m[:end], text_of(m[:end].lower(), key, kind), strict=True)) + m[end:]
    if kind == "secret":
        at = m.index('"') + 1
        return m[:at] + text_of(m[at:], key, kind)
    if kind == "iban":
        x = m.replace(" ", "")
        if mod97(x[4:] + x[:4]) != 1:
            return m
        b = text_of(x[4:], key, kind)
        return fill(m, f"{x[:2]}{98 - mod97(b + x[:2] + '00'):02}{b}", "[A-Z0-9]")
    if kind == "phone":
        code = (regex.match(pii.COUNTRY_CODE, m) or regex.match(r"^\+[0-9]{1,3}", m) or regex.match("", m))[0]
        d = regex.sub("[^0-9]", "", m[len(code) :])
        return code + fill(m[len(code) :], digits_of(d, key, kind), "[0-9]") if 7 <= len(d) <= 14 else m
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        a, r = pair_of(a - 2 if a > 666 else a - 1, (g - 1) * 9999 + s - 1, (898, 99 * 9999), key, kind)
        return f"{a + 2 if a + 1 >= 666 else a + 1:03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"
    if kind == "card":
        if not regex.match(pii.CARD, d) or luhn(d):
            return m
        q = d[:2] + digits_of(d[2:-1], key, kind)
        return fill(m, q + str(-luhn(q + "0") % 10), "[0-9]")
    if kind == "ip":
        o = m.split(".")
        if any(int(x) > 255 or str(int(x)) != x for x in o):
            return m
        a, b, c, e = map(int, o)
        x, y = pair_of(a * 256 + b, c * 256 + e, (65536, 65536), key, kind)
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "date":
        for look, form in pii.DATE_FORMS:
            if not regex.match(rf"\A{look}\z", m):
                continue
            order = [c for c in regex.sub("[^yMd]", "", form) if c]
            parts = dict(zip(dict.fromkeys(order), map(int, regex.split("[^0-9]", m)), strict=True))
            try:
                day = datetime.date(parts["y"], parts["M"], parts["d"])
            except ValueError:
                continue
            n = (day - datetime.date(1900, 1, 1)).days
            if not 0 <= n < 319 * 229:
                continue
            a, b = pair_of(n // 229, n % 229, (319, 229), key, kind)
            new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 229 + b)
            pad = "02" if "MM" in form else "0"
            return regex.sub("y+|M+|d+", lambda x: f"{new.year:04}" if x[0][0] == "y" else format(new.month if x[0][0] == "M" else new.day, pad), form)
        return m
    raise AssertionError(kind)


def replaced(text, key):
    kinds = []

    def one(m):
        kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m[0]))
        new = plain(kind, m[0], key)
        kinds.extend([kind] * (new != m[0]))
        return new

    return None if text is None else regex.sub(pii.ANY, one, text), kinds


def run(spark, texts):
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, gaps string")
    out = pii.pseudonymised(docs, SECRET, found="kinds")
    assert out.columns == ["doc_id", "text", "gaps", "kinds"]
    return [(r["text"], r["kinds"]) for r in out.orderBy("doc_id").collect()]


GOOD = {
    "email": ["of.55@mail9.example.com", "a@x.com", "A.b+C@Host-1.example.org"], "phone": ["+1 (017) 555-7713", "(415) 555-2671", "415-555-2671", "415.555.2671", "+44 20 7946 0958", "+442079460958", "+49 30 1234567"],
    "secret": ['token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'], "card": ["4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "4845168114407329"], "ssn": ["123-45-6789"],
    "ip": ["192.168.0.1"], "iban": ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    "date": ["2024-02-29", "31.12.1999", "12/25/2020", "25/12/2020", "2024/02/29", "3/4/2021", "3.4.2021"],
}
BAD = [
    "4111-1111-1111-1112", "000-12-3456", "666-12-3456", "900-12-3456", "300.1.1.1", "1.2.3.04", "GB83WEST12345698765432", "2023-02-29", "13/13/2020", "1899-12-31", "12345678901234567890", "x@y", "1.2.3.4.5",
    "0" * 13, "0" * 16, "version 1.2.3.4", "v1.2.3.4", "dead::beef", "12:30:45", "std::vector", "aa:bb:cc:dd:ee:ff",
]


def test_every_kind_equals_the_plain_version(spark):
    flat = [(k, v) for k, vs in GOOD.items() for v in vs]
    for (kind, value), (new, kinds) in zip(flat, run(spark, [v for _, v in flat]), strict=True):
        assert (new, kinds) == (plain(kind, value, KEY), [kind]) and new != value, value
        assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind in ("ip", "date"), value
    assert [t for t, _ in run(spark, BAD)] == BAD


def test_equal_values_stay_linked_in_any_form(spark):
    day = [datetime.datetime.strptime(t, f).date() for (t, _), f in zip(run(spark, ["2024-02-29", "29.02.2024", "02/29/2024", "29/02/2024", "2/29/2024"]), ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"), strict=False)]
    assert len(set(day)) == 1
    phones = [regex.sub("[^0-9]", "", t) for t, _ in run(spark, ["(415) 555-2671", "415-555-2671", "415.555.2671", "415 555 2671"])]
    assert len(set(phones)) == 1 and run(spark, ["+1 (415) 555-2671"])[0][0].startswith("+1 (") and regex.sub("[^0-9]", "", run(spark, ["+14155552671"])[0][0]) == "1" + phones[0]
    assert len({t.replace(" ", "") for t, _ in run(spark, GOOD["iban"][1:])}) == 1 and len({t.lower() for t, _ in run(spark, ["Ann@Ex.com", "ann@ex.COM", "ANN@EX.com"])}) == 1
    assert len({t.replace("-", "") for t, _ in run(spark, GOOD["card"][:2])}) == 1
    six = [t for t, _ in run(spark, ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "at 2001:db8::1."])]
    assert six[0] == six[1] and six[2] == f"at {six[0]}." and len(six[0].split(":")) == 8 and six[0] != "2001:db8:0:0:0:0:0:1"


def test_check_digits_are_right(spark):
    new = [t for t, _ in run(spark, [*GOOD["card"], *GOOD["iban"]])]
    assert all(luhn(regex.sub("[^0-9]", "", t)) == 0 for t in new[:4])
    assert all(mod97((x := t.replace(" ", ""))[4:] + x[:4]) == 1 for t in new[4:])


@pytest.mark.parametrize("sizes", [(3, 7), (16, 16), (1, 10)])
def test_pairs_are_permuted_without_fixed_points(spark, sizes):
    cells = spark.range(sizes[0] * sizes[1]).select(pii.permute_pair(F.floor(F.col("id") / sizes[1]), F.col("id") % sizes[1], sizes, KEY, "t").alias("p"), F.col("id"))
    got = [((r["p"]["l"], r["p"]["r"]), divmod(r["id"], sizes[1])) for r in cells.collect()]
    assert {a for a, _ in got} == {(a, b) for a in range(sizes[0]) for b in range(sizes[1])} and all(a != b for a, b in got)


def test_texts_and_digits_are_permuted_without_fixed_points(spark):
    rows = spark.createDataFrame([(f"{k:03}", f"{c}{k % 10}-") for k in range(1000) for c in "xY"], "s string, t string").distinct()
    out = rows.select("s", "t", pii.permute_text(F.col("s"), KEY, "t").alias("p"), pii.permute_text(F.col("t"), KEY, "t").alias("q")).collect()
    assert {r["p"] for r in out} == {f"{k:03}" for k in range(1000)}
    assert all(r["p"] != r["s"] and r["q"] != r["t"] for r in out)


def test_long_texts_of_any_repeated_form(spark):
    n = 200_000
    parts = ["a@" + "b." * n + "c", "a@" + "b." * n, "." * n + "@x.y", 'token = "' + "Ab1" * n + '"', "DE89 " + "3704 " * n, "+1" + " 23" * n, "+1" * n, "(12" * n, "415-" * n, "1234 " * n, "1" * n, "1." * n, "ab1:" * n, "1::" * n, "12/" * n, "12." * n, "2024-" * n, "A1 " * n]
    got = run(spark, parts)
    assert got[0][1] == ["email"] and len(got[0][0]) == len(parts[0]) and got[3][1] == ["secret"] and got[3][0] != parts[3]
    assert all(len(t) == len(p) for p, (t, _) in zip(parts, got, strict=True))
    long = "word " * 40_000 + "mail a.1@b.com, a.1@b.com!" + " x" * 1000 + "y" * 50_000
    got = run(spark, [long, "a.1@b.com", None, "", "no data", "a.1@b.com a.1@b.com"])
    alias = got[1][0]
    assert got[0][0] == long.replace("a.1@b.com", alias) and got[0][1] == ["email"] * 2
    assert [g for g, _ in got[2:]] == [None, "", "no data", f"{alias} {alias}"] and got[2][1] == []


def test_clashing_names_no_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.com", "x", 5, ["k"])] * 2 + [(2, None, None, None, None)], "doc_id long, `te.xt` string, __pii__ string, `__PII___` int, kinds array<string>")
    out = pii.pseudonymised(docs, SECRET, text="te.xt").collect()
    assert out[0] == out[1] and out[0][2:] == ("x", 5, ["k"]) and out[0][1] == plain("email", "a@b.com", KEY) and out[2] == (2, None, None, None, None)
    assert [r["kinds"] for r in pii.pseudonymised(docs, SECRET, text="te.xt", found="kinds").collect()] == [["email"], ["email"], []]
    assert pii.pseudonymised(docs.limit(0), SECRET, text="te.xt").count() == 0


def test_query_equals_the_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    key = hashlib.sha256(queries.PII_KEY.encode()).hexdigest()
    want = {r["doc_id"]: replaced(r["text"], key) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op10_pii(spark, folder).collect()
    assert {r["doc_id"]: (r["text"], r["kinds"]) for r in got} == want and all(r["n_replaced"] == len(r["kinds"]) for r in got)
    assert sum(len(k) for _, k in want.values()) > 20
