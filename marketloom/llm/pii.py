"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by one pattern, validated by kind and replaced within their format:

- numbers and dates pass a keyed Feistel network on a pair of residues (a mod p, b mod q), whose rounds add a
  keyed hash of one half to the other: a permutation of the kind's valid values. Card numbers keep whether
  their Luhn digit holds, account numbers get new check digits, dates walk on until they are in range;
- e-mail addresses and long hexadecimal secrets become keyed digests of the same format.

A value is brought to a canonical form first, so equal values get equal pseudonyms in all documents,
however they are spaced. The rest of a text stays as it is, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import unused

ROUNDS = 10

# What personal data looks like, in the order in which alternatives are tried.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
_ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|\+\d{10,14}(?!\d)"
_NUMBER = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
_DATE_GROUPLESS = r"(?<![\d/.])(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/])"
PATTERN = "|".join((_EMAIL, _HEX, _IBAN, _IP, _ISO_DATE, _DATE_GROUPLESS, _SSN, _NUMBER, _PHONE))

_FIRST_DAY, _DAYS, _DATE_MODULI = "1900-01-01", 73_049, (271, 270)  # dates of 1900 to 2099; 271 * 270 is just above


def _digest(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def feistel(a: Column, b: Column, p: Column | int, q: Column | int, key: str, kind: str) -> tuple[Column, Column]:
    """A keyed permutation of pairs (a mod p, b mod q)."""
    p, q = ((F.lit(x) if isinstance(x, int) else x).cast("long") for x in (p, q))

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        half = F.when(even, state["b"]).otherwise(state["a"])
        added = F.conv(F.substring(_digest(key, kind, p, q, i, half), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(state["a"] + F.pmod(added, p), p)).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(F.pmod(state["b"] + F.pmod(added, q), q)).alias("b"),
        )

    state = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)
    return state["a"], state["b"]


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    p, q = (F.pow(F.lit(10.0), x).cast("long") for x in (left, n - left))
    a, b = feistel(digits.substr(F.lit(1), left).cast("long"), digits.substr(left + 1, n).cast("long"), p, q, key, kind)
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """The text `shape` with its digits replaced in order by `digits`."""
    place = lambda i: F.length(_digits(shape.substr(F.lit(1), i)))
    put = lambda i: F.when(shape.substr(i, F.lit(1)).between("0", "9"), digits.substr(place(i), F.lit(1))).otherwise(shape.substr(i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), put), "")


def luhn_digit(body: Column) -> Column:
    """Check digit that makes body and digit pass the Luhn test."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = body.substr(n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = d.substr(F.lit(1), F.length(d) - 1)
        off = F.pmod(F.substring(d, -1, 1).cast("int") - luhn_digit(body), F.lit(10))  # 0: valid, and stays so
        return _once(permuted_digits(body, key, "card"), lambda new: F.concat(new, F.pmod(luhn_digit(new) + off, F.lit(10)).cast("string")))

    return _refilled(m, _once(_digits(m), of))


def _mod97(account: Column) -> Column:
    """Remainder by 97 of an account number (no blanks) with its first four characters moved to the end and letters as 10 to 35."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = turned.substr(i, F.lit(1))
        return F.when(c.between("0", "9"), F.pmod(rest * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(rest * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        tail = plain.substr(F.lit(5), F.length(plain))
        digits = _digits(tail)
        new = permuted_digits(digits, key, "iban")

        def checked(moved: Column) -> Column:
            zero = F.concat(plain.substr(F.lit(1), F.lit(2)), F.lit("00"), moved)
            return F.concat(F.lpad((F.lit(98) - _mod97(zero)).cast("string"), 2, "0"), _digits(moved))

        return F.when((_mod97(plain) == 1) & (F.length(digits) >= 4), _refilled(m, _once(_refilled(tail, new), checked)))

    return _once(F.replace(m, F.lit(" "), F.lit("")), of)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        o = [o[i].cast("int") for i in range(4)]
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        text = _once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.concat_ws(".", *(F.pmod(F.shiftright(s[c], k), F.lit(256)).cast("string") for c in "ab" for k in (8, 0))))
        return F.when(F.greatest(*o) <= 255, text)

    return _once(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    a, b = feistel((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def text(s: Column) -> Column:
        new = F.floor(s["a"] / 99) + 1
        return F.format_string("%03d-%02d-%04d", new + F.when(new > 665, 1).otherwise(0), F.pmod(s["a"], F.lit(99)) + 1, s["b"] + 1)

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _once(F.struct(a.alias("a"), b.alias("b")), text))


def _phone(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        head, own = d.substr(F.lit(1), F.length(d) - 10), F.substring(d, -10, 10)
        area, exchange = own.substr(F.lit(1), F.lit(3)).cast("int"), own.substr(F.lit(4), F.lit(3)).cast("int")
        # three sets that are permuted each within itself, so that no two numbers meet: valid numbers, low areas, low exchanges
        low, short = area < 200, exchange < 200
        least, exchanges = F.when(low, 0).otherwise(200), F.when(low, 1000).when(short, 200).otherwise(800)
        first = F.when(low | short, 0).otherwise(200)
        a, b = feistel((area - least) * exchanges + exchange - first, own.substr(F.lit(7), F.lit(4)).cast("long"), F.when(low, 200).otherwise(800) * exchanges, F.lit(10_000), key, "phone")
        return F.concat(head, _once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.format_string("%03d%03d%04d", F.floor(s["a"] / exchanges) + least, F.pmod(s["a"], exchanges) + first, s["b"])))

    return _refilled(m, _once(_digits(m), of))


def _moved_day(day: Column, key: str) -> Column:
    p, q = _DATE_MODULI

    def walk(x: Column, i: Column) -> Column:
        a, b = feistel(F.floor(x / q), F.pmod(x, F.lit(q).cast("long")), p, q, key, "date")
        return F.when((i == 0) | (x >= _DAYS), a * q + b).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), day.cast("long"), walk)


def _date(m: Column, key: str) -> Column:
    iso = m.substr(F.lit(5), F.lit(1)) == "-"

    def of(x: Column) -> Column:
        first, second = x[0].cast("int"), x[1].cast("int")
        month_first = ~iso & (second > 12)
        text = F.when(iso, m).otherwise(F.format_string("%s-%02d-%02d", x[2], F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)))
        day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), _moved_day(day, key).cast("int"))
        sign = F.when(m.contains("/"), "/").otherwise(".")
        parts = [F.date_format(new, c) for c in ("dd", "MM", "yyyy")]
        shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(month_first, F.concat(parts[1], sign, parts[0], sign, parts[2])).otherwise(F.concat(parts[0], sign, parts[1], sign, parts[2]))
        return F.when(day.between(0, _DAYS - 1), shown)

    return _once(F.split(m, "[-/.]"), of)


def _hex(m: Column, key: str) -> Column:
    low = F.lower(m)
    new = F.concat(_digest(key, "hex", low), _digest(key, "hex2", low)).substr(F.lit(1), F.length(m))
    return F.when(m == low, new).otherwise(F.upper(new))


def _email(m: Column, key: str) -> Column:
    local, domain = _digest(key, "local", F.lower(m)), _digest(key, "domain", F.lower(F.split(m, "@")[1]))
    return F.concat(F.lit("u"), F.substring(local, 1, 16), F.lit("@d"), F.substring(domain, 1, 16), F.lit(".example"))


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email").when(whole(_HEX) , "hex").when(m.rlike("^[A-Z]{2}"), "iban").when(whole(_IP), "ip")
        .when(whole(f"{_ISO_DATE}|{_DATE_GROUPLESS}"), "date").when(whole(_SSN), "ssn").when(whole(_NUMBER), "number").otherwise("phone")
    )


def pseudonym(m: Column, key: str) -> Column:
    """What replaces one found value; the value itself where its kind's validation fails."""

    def of(kind: Column) -> Column:
        new = F.when(kind == "email", _email(m, key)).when(kind == "hex", _hex(m, key))
        for name, make in (("iban", _iban), ("ip", _ip), ("date", _date), ("ssn", _ssn), ("number", _card), ("phone", _phone)):
            new = new.when(kind == name, make(m, key))
        return F.coalesce(new, m)

    return _once(_kind(m), of)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces the personal data in the column `text`; adds n_replaced (int). All other columns and rows stay.

    key: the secret that ties pseudonyms together; another key gives unrelated ones. Null text stays null with
    n_replaced 0; empty text stays empty. A value that fails its kind's validation (octets over 255, impossible dates,
    wrong check sums of account numbers) stays. Repeated rows get equal results; a column named n_replaced is overwritten.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)
    pieces = F.split(F.col(text), PATTERN, -1)

    def joined(pair: Column) -> Column:
        return F.struct(
            F.array_join(F.flatten(F.zip_with(pair["pieces"], pair["new"], lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "").alias("text"),
            F.size(F.filter(F.zip_with(pair["found"], pair["new"], lambda x, y: x != y), lambda x: x)).alias("n"),
        )

    replaced = _once(F.struct(pieces.alias("pieces"), found.alias("found"), F.transform(found, lambda m: pseudonym(m, key)).alias("new")), joined)
    value = unused(docs, "replaced")
    with_value = docs.withColumn(value, F.when(F.col(text).rlike(r"[0-9@]|[A-Fa-f]{32}"), F.when(F.col(text).rlike(PATTERN), replaced)))
    return with_value.withColumn(text, F.coalesce(F.col(value)["text"], F.col(text))).withColumn("n_replaced", F.coalesce(F.col(value)["n"], F.lit(0))).drop(value)
