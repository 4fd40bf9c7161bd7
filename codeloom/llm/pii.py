"""Operator 9: format-preserving pseudonyms for personal data. Built-in functions only.

One pattern finds candidates; each is validated (issuer range and Luhn for cards,
modulo 97 for IBANs, ranges for social security numbers, octets and calendar dates).
Validated numbers and dates are permuted inside their own format by a keyed Feistel
network:

* digit strings: two halves, each in turn shifted by a keyed hash of the other,
  modulo its own power of ten. Cards keep the issuer's digits, permute the others and
  get a new valid check digit; IBANs permute their digits and get new valid check
  digits; phones keep the country code and are permuted by their digits alone, so one
  number stays one however it is spelt (ten digits without a code count as +1);
* IPv4 addresses: two halves of 16 bits;
* dates from 1900 to 2099: the 73,049 = 17 x 4,297 days, as a pair of residues. One day
  has one pseudonym in all forms but one: dd/mm/yyyy with a day after the 12th (else it
  is read as mm/dd/yyyy) is permuted among such days, by applying the permutation until
  it gives one, so that no two dates of one form meet.

A permutation is one to one, so equal values stay linked across documents and
different values stay apart, without a table of values. E-mail addresses and
secrets (access keys, long hexadecimal tokens) have no fixed number format; they
become keyed hashes spelt in their alphabet.

Who has the key can undo the permutations. It is a parameter without a default; it
reaches the executors as a one-row table, so it stands in no plan and no event log.

One narrow pass: no shuffle, no state. Texts without a digit, '@' or a known key
prefix are passed on untouched. No pattern repeats a group without a bound in a way
that recurses in the JVM, so long runs of labels, digits or hyphens are safe.

Defined cases: a null text stays null with counts 0; an empty text stays empty;
very long texts are handled as wholes; candidates that fail validation stay as
they are; repeated rows are treated alike; ids may be null; an empty table gives no
rows; an empty key raises ValueError; columns besides id and text are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked

KINDS = ["email", "secret", "iban", "card", "phone", "ssn", "ip", "date"]
_B, _E = r"(?<![\w.+-])", r"(?![\w])"
#: Candidates, in order of preference at one place.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)++",
    "secret": r"(?<![\w])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w])",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?![\w])|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?![\w])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w]|[./-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The issuers' ranges of card numbers, and the country codes of one and two digits (the others have three).
_ISSUER = "|".join(
    f"^(?={length}$)(?:{start})"
    for length, start in [
        (r"(?:\d{13}|\d{16}|\d{19})", "4"), (r"\d{16}", r"5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720"), (r"\d{15}", "3[47]"),
        (r"\d{14,19}", "30[0-5]|36|38"), (r"\d{16,19}", r"6011|64[4-9]|65|62|35(?:2[89]|[3-8]\d)"),
    ]
)
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_DAYS, _DAY_A, _DAY_B = 73049, 17, 4297  # 1900-01-01 to 2099-12-31; the product of two primes
ROUNDS = 10


def _mac(key: Column, *parts: Column) -> Column:
    """A keyed number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, tweak: Column) -> Column:
    """A permutation of pairs (a below size_a, b below size_b), as a struct."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((s["a"] + _mac(key, tweak, i, s["b"])) % size_a).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + _mac(key, tweak, i, s["a"])) % size_b).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def permuted_digits(digits: Column, key: Column, tweak: Column) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")

    def joined(s: Column) -> Column:
        return F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0"))

    pair = feistel(F.substr(digits, F.lit(1), left).cast("long"), F.substr(digits, left + 1, n - left).cast("long"), ten(left), ten(n - left), key, F.concat(tweak, n.cast("string")))
    return _bound(pair, joined)


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those given."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the Luhn rule; double_last: the last digit is one that counts double (a payload without its check digit)."""
    n = F.length(digits)

    def value(d: Column, i: Column) -> Column:
        x = d.cast("int")
        twice = (n - 1 - i) % 2 == (0 if double_last else 1)
        return F.when(twice, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x)


def mod97(letters_and_digits: Column) -> Column:
    """The IBAN rule: letters count 10 to 35, all read as one number modulo 97."""

    def step(s: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((s * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")

    return F.aggregate(F.split(letters_and_digits, ""), F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _iban(m: Column, key: Column) -> Column:
    compact = F.regexp_replace(m, " ", "")
    valid = mod97(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))) == 1
    rest = F.substr(compact, F.lit(5))

    def renewed(rest: Column) -> Column:
        inner = _bound(refilled(rest, permuted_digits(_digits(rest), key, F.lit("iban"))), lambda r: F.concat(F.lpad((98 - mod97(F.concat(r, F.substr(compact, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), r))
        return _bound(inner, lambda x: _spelt(m, F.concat(F.substr(compact, F.lit(1), F.lit(2)), x)))

    return F.when(valid & (F.length(_digits(rest)) >= 2), _bound(rest, renewed))


def _spelt(form: Column, chars: Column) -> Column:
    """form with its non-blanks replaced, in order, by the characters given."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["out"], F.substr(chars, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _card(m: Column, key: Column) -> Column:
    def renewed(d: Column) -> Column:
        issuer = F.regexp_extract(d, _ISSUER, 0)
        inner = permuted_digits(F.substr(d, F.length(issuer) + 1, F.length(d) - F.length(issuer) - 1), key, F.concat(F.lit("card"), issuer))
        spelt = _bound(F.concat(issuer, inner), lambda p: refilled(m, F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string"))))
        return F.when(d.rlike(_ISSUER), F.when(luhn_sum(d, False) % 10 == 0, spelt))

    return _bound(_digits(m), renewed)


def _phone(m: Column, key: Column) -> Column:
    def renewed(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(d, _COUNTRY, 0)).otherwise("")
        rest = permuted_digits(F.substr(d, F.length(code) + 1), key, F.concat(F.lit("phone"), F.when(code == "", "1").otherwise(code)))
        return refilled(m, F.concat(code, rest))

    return _bound(_digits(m), renewed)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999: 898 areas times 99 x 9999."""
    area, group, serial = (F.substr(m, F.lit(p), F.lit(n)).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)

    def spelt(s: Column) -> Column:
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4))

    return F.when(valid, _bound(feistel(rank, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn")), spelt))


def _ip(m: Column, key: Column) -> Column:
    def renewed(o: Column) -> Column:
        n = [o[k].cast("long") for k in range(4)]
        valid = (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
        spelt = lambda s: F.concat_ws(".", *[(F.floor(s[h] / d) % 256).cast("string") for h in ("a", "b") for d in (256, 1)])
        return F.when(valid, _bound(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, F.lit("ip")), spelt))

    return _bound(F.split(m, r"\."), renewed)


def _moved(form: str, key: Column, late: bool):
    """From a day's number to its pseudonym in that form; late: among the days after the 12th of a month."""
    shifted = lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * _DAY_B + s["b"]).cast("int"))
    once = lambda s: feistel(s["a"], s["b"], F.lit(_DAY_A), F.lit(_DAY_B), key, F.lit("date"))

    def moved(day: Column) -> Column:
        start = F.struct(F.floor(day / _DAY_B).alias("a"), (day % _DAY_B).cast("long").alias("b"))
        out = _bound(start, once)
        if late:  # a cycle through the early days is left after 64 steps with probability below 1e-25
            out = F.aggregate(F.sequence(F.lit(1), F.lit(64)), out, lambda s, _: F.when(F.dayofmonth(shifted(s)) > 12, s).otherwise(once(s)))
        return F.when((day >= 0) & (day < _DAYS), _bound(out, lambda s: F.date_format(shifted(s), form)))

    return moved


def _date(m: Column, key: Column) -> Column:
    """yyyy-mm-dd, dd.mm.yyyy and mm/dd/yyyy (or dd/mm/yyyy where only that is a date)."""
    out = F.lit(None).cast("string")
    for shape, form in (("^....-", "yyyy-MM-dd"), (r"^..\.", "dd.MM.yyyy"), ("^../", "MM/dd/yyyy"), ("^../", "dd/MM/yyyy")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
        out = F.coalesce(out, F.when(m.rlike(shape), _bound(day, _moved(form, key, form == "dd/MM/yyyy"))))
    return out


def _hashed(m: Column, key: Column, n: Column) -> Column:
    """n hexadecimal digits."""
    return F.substr(F.repeat(F.sha2(F.concat_ws("|", key, m), 512), F.ceil(n / 128).cast("int")), F.lit(1), n)


def _secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, "^(?:AKIA|gh[a-z]_|sk-)", 0)
    tail = _hashed(m, key, F.length(m) - F.length(head))
    return F.concat(head, F.when(m.rlike("[A-Z]") & ~m.rlike("[g-z]"), F.upper(tail)).otherwise(tail))


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), _hashed(F.lower(m), key, F.lit(16)), F.lit("@"), F.lit("d"), _hashed(F.lower(F.substring_index(m, "@", -1)), key, F.lit(8)), F.lit(".example"))


def _of_kind(kind: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def replacement(m: Column, key: Column) -> Column:
    """struct(kind, value): kind is null where the candidate is not valid."""
    makers = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date}
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in PATTERNS:  # the first kind that fits as a whole and validates
        made = _bound(makers[kind](m, key), _of_kind(kind))
        out = F.coalesce(out, F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), made))
    return F.coalesce(out, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def pseudonymize(df: DataFrame, *, key: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count for each kind, for each row of df."""
    if not key:
        raise ValueError("a key is needed")
    own = df.sparkSession.createDataFrame([(key,)], "pseudonym_key string")
    rows = picked(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", own.scalar())
    some = F.col("text").rlike("[0-9@]|AKIA|gh[pousr]_|sk-|[0-9A-Fa-f]{32}")
    found = F.when(some, F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: replacement(m, F.col("key"))))
    rows = rows.select("doc_id", "text", F.inline(F.array(F.struct(found.alias("found")))))  # made once; the generator keeps it from being repeated
    gaps = F.split("text", ANY, -1)
    renewed = F.array_join(F.flatten(F.zip_with(gaps, "found", lambda g, f: F.array(g, F.coalesce(f["value"], F.lit(""))))), "")
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda f: f["kind"] == kind)), F.lit(0)).cast("long")
    counts = [F.when(F.size("found") > 0, count(k)).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    out = rows.select("doc_id", F.when(F.size("found") > 0, renewed).otherwise(F.col("text")).alias("text"), *counts)
    return out.select("doc_id", "text", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col("n_email")).alias("n_found"), *[f"n_{k}" for k in KINDS])
