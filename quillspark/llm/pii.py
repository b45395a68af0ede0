"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value is found by its form, validated (check digits, number ranges, the calendar) and permuted
within its format: the result has the same form and is valid again. The permutation depends on the
key and the kind of value only, so equal values get equal pseudonyms in all documents, and
different values different ones. A value is permuted by what it says, not by how it is written: a
card number with and without spaces stays the same number, so does +1 415 555 2671 as +14155552671,
and an address in capitals is the same address; the pseudonym is written like the value.

Two Feistel networks do it, eight rounds each with SHA-256 as round function. One works on a pair
of numbers below two moduli, by addition, so a domain that is the product of two numbers needs no
cycle walking: IPv4 addresses 2**16 * 2**16, telephone numbers 64000 * 10**5 (and two smaller domains
for area codes or exchanges that begin with 0 or 1), social security numbers (898 * 99) * 9999, and dates 189 * 773, the days of the 400 years of the Gregorian cycle.
The other works on the letters and digits of a string, each of which stays within its class.

All of it is DataFrame expressions in one pass over the text; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import unused

ROUNDS = 8
#: Where the key is set, and one for the sample tables, which holds no secret.
KEY_SETTING = "spark.quillspark.pseudonymKey"
SAMPLE_KEY = "key of the sample tables"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|\b(?i:password|passwd|pwd|token|secret|api_?key) ?[=:] ?[\"']?[A-Za-z0-9_+/-]{8,}(?![A-Za-z0-9_+/-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\.[0-9])"
DATE = r"(?<![A-Za-z0-9_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![A-Za-z0-9_]|[./-][0-9])"
SSN = r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_]|-[0-9])"
PHONE = r"(?<![A-Za-z0-9_+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])"
ABROAD = r"(?<![A-Za-z0-9_+])\+[1-9](?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![A-Za-z0-9_])"
CARD = r"(?<![A-Za-z0-9_.-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_-])"
FORMS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ipv4": IPV4, "date": DATE.replace(r"([./])", r"[./]").replace(r"\1", r"[./]"), "ssn": SSN, "phone": PHONE, "abroad": ABROAD, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: A text without these characters holds none of the forms.
HINT = "[0-9@=]|AKIA|[:] ?[\"']?[A-Za-z0-9_+/-]{8}"


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def _prf(key: str, kind: str, *parts: Column) -> Column:
    return _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def key_of(spark: SparkSession) -> str:
    """The session's key, or that of the sample tables where none is set."""
    return spark.conf.get(KEY_SETTING, None) or SAMPLE_KEY


def permuted_pair(left: Column, right: Column, a: int | Column, b: int, key: str, kind: str | Column) -> Column:
    """Struct (l, r) of a permutation of the pairs with 0 <= left < a, 0 <= right < b."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_l = F.when(even, F.pmod(acc["l"] + _prf(key, kind, i, acc["r"]), F.lit(a))).otherwise(acc["l"])
        new_r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _prf(key, kind, i, acc["l"]), F.lit(b)))
        return F.struct(new_l.cast("long").alias("l"), new_r.cast("long").alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shifted(text: Column, other: Column, i: Column, key: str, kind: str) -> Column:
    """Every letter and digit moved within its class, by what the other half says, or its digest
    if that is shorter: each character takes a hash of it."""

    def move(c: Column, j: Column, said: Column) -> Column:
        code = F.ascii(c)
        add = _prf(key, kind, i, j, said)
        within = lambda low, n: F.char(F.lit(low) + F.pmod(code - F.lit(low) + add, F.lit(n)))
        return F.when(code.between(48, 57), within(48, 10)).when(code.between(65, 90), within(65, 26)).when(code.between(97, 122), within(97, 26)).otherwise(c)

    said = F.when(F.length(other) > 64, F.sha2(other, 256)).otherwise(other)
    return _let(said, lambda d: F.array_join(F.transform(F.split(text, ""), lambda c, j: move(c, j, d)), ""))


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A permutation of the strings with the same character classes: digits, upper-case letters
    and lower-case letters stay such, other characters stay."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(acc["l"], acc["r"], i, key, kind)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(_shifted(acc["r"], acc["l"], i, key, kind)).alias("r"),
        )

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.when(F.length(text) > 1, out).otherwise(_shifted(text, F.lit(""), F.lit(0), key, kind))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _laid_out(m: Column, digits: Column, skip: Column) -> Column:
    """m with its digits, but for the first ``skip``, replaced by ``digits`` in turn."""

    def at(c: Column, j: Column) -> Column:
        n = F.length(_digits(F.substr(m, F.lit(1), j + 1)))
        return F.when(c.rlike("[0-9]") & (n > skip), F.substr(digits, n - skip, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), at), "")


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _email(m: Column, key: str) -> Column:
    """The local part and the domain but for its last label, each on its own: addresses of one
    host stay addresses of one host. Small letters are permuted; capitals stay capitals."""
    low = F.lower(m)
    local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    last = F.substring_index(host, ".", -1)
    name = F.substr(host, F.lit(1), F.length(host) - F.length(last) - 1)
    out = F.concat(permuted_text(local, key, "local"), F.lit("@"), permuted_text(name, key, "host"), F.lit("."), last)
    return _let(out, lambda o: F.when(m == low, o).otherwise(F.array_join(F.transform(F.split(o, ""), lambda c, j: F.when(F.substr(m, j + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")))


def _secret(m: Column, key: str) -> Column:
    head = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(m, "^([A-Za-z_]+ ?[=:] ?[\"']?)", 1))
    return _let(head, lambda h: F.concat(h, permuted_text(F.substr(m, F.length(h) + 1, F.length(m)), key, "secret")))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of an IBAN's number: letters count 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _iban(m: Column, key: str) -> Column:
    """Country kept, account permuted, check digits computed anew."""
    flat = F.regexp_replace(m, " ", "")
    country = F.substring(m, 1, 2)
    valid = _mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1

    def rebuilt(account: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, account)
        spaced = lambda c, j: F.when(c == " ", c).otherwise(F.substr(whole, F.length(F.regexp_replace(F.substr(m, F.lit(1), j + 1), " ", "")), F.lit(1)))
        return _let(whole, lambda w: F.array_join(F.transform(F.split(m, ""), spaced), ""))

    return F.when(valid, _let(permuted_text(F.substr(flat, F.lit(5), F.length(flat)), key, "iban"), rebuilt)).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    valid = F.array_max(o) <= 255
    out = permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
    name = lambda p: F.concat_ws(".", *[F.floor(x).cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])
    return F.when(valid, _let(out, name)).otherwise(m)


EPOCH = "1800-01-01"


def _date(m: Column, key: str) -> Column:
    """Year-month-day, day.month.year and month/day/year (or day/month/year, where only that is a
    date) between 1800 and 2199. A result with slashes is read by the same rule, so the day comes
    first only where it did and is above 12."""

    def as_date(form: str) -> Column:
        return F.to_date(F.try_to_timestamp(m, F.lit(form)))

    iso, dotted = m.rlike("^[0-9]{4}-"), F.substring(m, 3, 1) == "."
    month_first = as_date("MM/dd/yyyy")
    day = F.when(iso, as_date("yyyy-MM-dd")).when(dotted, as_date("dd.MM.yyyy")).otherwise(F.coalesce(month_first, as_date("dd/MM/yyyy")))
    n = F.datediff(day, F.lit(EPOCH).cast("date"))

    def moved(p: Column) -> Column:
        to = F.date_add(F.lit(EPOCH).cast("date"), (p["l"] * 773 + p["r"]).cast("int"))
        day_first = month_first.isNull() & (F.dayofmonth(to) > 12)
        return F.when(iso, F.date_format(to, "yyyy-MM-dd")).when(dotted, F.date_format(to, "dd.MM.yyyy")).when(day_first, F.date_format(to, "dd/MM/yyyy")).otherwise(F.date_format(to, "MM/dd/yyyy"))

    return F.when(n.between(0, 146096), _let(permuted_pair(F.floor(n / 773), n % 773, 189, 773, key, "date"), moved)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)

    def moved(p: Column) -> Column:
        i = F.floor(p["l"] / 99)
        return F.concat(_padded(i + F.when(i >= 665, 2).otherwise(1), 3), F.lit("-"), _padded(p["l"] % 99 + 1, 2), F.lit("-"), _padded(p["r"] + 1, 4))

    return F.when(valid, _let(permuted_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), moved)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """Ten digits, the country code kept. Area and exchange that begin with 2 to 9, as valid ones do,
    still do; the others are permuted among those whose area, or else exchange, begins with 0 or 1,
    so no result is that of a valid number, too."""
    digits = F.substring(_digits(m), -10, 10)
    at = lambda d, i, n=1: F.substring(d, i, n).cast("long")
    skip = F.length(_digits(m)) - 10

    def moved(d: Column) -> Column:
        area, exchange = at(d, 1), at(d, 4)
        rest = at(d, 2, 2) * 10 + at(d, 5)
        left = F.when(area < 2, area * 10000 + at(d, 2, 4)).when(exchange < 2, ((area - 2) * 2 + exchange) * 1000 + rest).otherwise(((area - 2) * 8 + exchange - 2) * 1000 + rest)
        size = F.when(area < 2, 20000).when(exchange < 2, 16000).otherwise(64000)
        return _let(permuted_pair(left, at(d, 6, 5), size, 100000, key, F.concat(F.lit("phone"), size.cast("string"))), lambda p: _laid_out(m, rebuilt(p, area, exchange), skip))

    def rebuilt(p: Column, area: Column, exchange: Column) -> Column:
        first, rest = F.floor(p["l"] / 1000), p["l"] % 1000
        text = lambda a, e: F.concat(a.cast("string"), _padded(F.floor(rest / 10), 2), e.cast("string"), (rest % 10).cast("string"))
        head = F.when(area < 2, _padded(p["l"], 5)).when(exchange < 2, text(F.floor(first / 2) + 2, first % 2)).otherwise(text(F.floor(first / 8) + 2, first % 8 + 2))
        return F.concat(head, _padded(p["r"], 5))

    return _let(digits, moved)


def _abroad(m: Column, key: str) -> Column:
    """8 to 15 digits after a plus sign; the first two, of the country code, are kept. Eleven digits
    from 1 on are a telephone number of the other form, differently written."""
    digits = _digits(m)
    rest = permuted_text(F.substr(digits, F.lit(3), F.length(digits)), key, "abroad")
    return F.when(digits.rlike("^1[0-9]{10}$"), _phone(m, key)).when(F.length(digits).between(8, 15), _let(rest, lambda d: _laid_out(m, d, F.lit(2)))).otherwise(m)


def _card(m: Column, key: str) -> Column:
    """13 to 19 digits with a right check digit; the first digit is kept, the last computed."""
    digits = _digits(m)
    inner = permuted_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card")
    payload = F.concat(F.substring(digits, 1, 1), inner)
    checked = lambda p: F.concat(p, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(p, d.cast("string"))))[0].cast("string"))
    return F.when(_luhn(digits), _let(_let(payload, checked), lambda d: _laid_out(m, d, F.lit(0)))).otherwise(m)


HANDLERS = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card}


def kind_of(m: Column) -> Column:
    """The first form that a found string has as a whole."""
    out = None
    for name, form in FORMS.items():
        hit = m.rlike(f"^(?:{form})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = None
    for name, handler in HANDLERS.items():
        out = F.when(kind == name, handler(m, key)) if out is None else out.when(kind == name, handler(m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the values in ``column`` replaced, and n_found (strings of one of the forms)
    and n_replaced (those that are valid, and so were permuted).

    A null text stays null with counts 0; empty texts and texts without such values are unchanged.
    What has a form but isn't valid (a card number with a wrong check digit, 31.02.2020) stays. Ten
    digits without any mark of a telephone number aren't one of the forms. Whoever has the ``key`` can
    take the pseudonyms back.
    Rows keep their number and order, and all other columns; columns named n_found or n_replaced
    are replaced. A permutation may map a value to itself, with probability 1 / size of its format.
    """
    text = F.col(column)
    hinted = text.rlike(HINT)
    held, new_column = unused("_found", docs.columns), unused("_new", docs.columns)
    found = F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.split(text, ANY, -1)
    new = F.transform(F.col(held), lambda m: _let(kind_of(m), lambda k: pseudonym(m, k, key)))
    joined = F.array_join(F.zip_with(pieces, F.col(new_column), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    names = [c for c in docs.columns if c not in ("n_found", "n_replaced")]
    return (
        docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(found, F.array().cast("array<string>")).alias(held))
        .withColumn(new_column, F.when(F.size(held) > 0, new))
        .withColumn(column, F.when(F.size(held) > 0, joined).otherwise(text))
        .withColumn("n_found", F.size(held))
        .withColumn("n_replaced", F.when(F.size(held) > 0, F.size(F.filter(F.zip_with(held, new_column, lambda a, b: a != b), lambda z: z))).otherwise(F.lit(0)))
        .drop(held, new_column)
    )
