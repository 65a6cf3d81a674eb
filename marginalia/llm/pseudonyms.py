"""Format-preserving pseudonyms for personal numbers, dates and addresses, by a keyed Feistel network.

Values are found by pattern, validated (check digits, calendars, number ranges), turned into a pair of
numbers below two bounds and sent through eight Feistel rounds whose round function is HMAC-SHA-256
of the key. That is a permutation of the value's format: equal values get equal pseudonyms in every
document, different ones stay different, and check digits hold again. Everything is column
expressions; texts never leave the JVM.

=========  ==========================================  ====================================================
kind       valid when                                  pseudonym
=========  ==========================================  ====================================================
email      pattern                                     letters and digits before the @ permuted, case kept
iban       remainder modulo 97                         account letters and digits permuted, check digits anew
date       a day of the years 1800 to 2199             a day of those years, same notation
ssn        area, group and serial in range             likewise in range
ip         four numbers up to 255                      four numbers up to 255
phone      pattern                                     digits after the country code permuted
card       13 to 19 digits, Luhn check digit           first digit kept, others permuted, check digit anew
=========  ==========================================  ====================================================
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import query, table

ROUNDS = 8
#: Production deployments pass their own secret.
KEY = b"an example key; pass your own"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: Characters of an account number by country; elsewhere all lengths are tried.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_BOUND = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                  for n, names in IBAN_LENGTHS.items())
IBAN = (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_BOUND})(?![A-Za-z0-9])"
        r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))")
DATE = (r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})"
        r"(?!(?!T[0-9]{2})[0-9A-Za-z/-]|\.[0-9])")
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
PHONE = (r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])")
CARD = (r"(?<![0-9A-Za-z])(?<![0-9][.,])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
        r"(?![0-9A-Za-z]|[.,][0-9])")
#: The first that fits at a place takes the text.
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "ip": IP, "card": CARD, "phone": PHONE}


ANY = "(?:" + "|".join(KINDS.values()) + ")"


def _hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as hex text."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def feistel(key: bytes, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """``struct(l, r)``: the pair, below ``(a, b)``, through the rounds; a permutation of all such pairs."""
    def mixed(i: Column, side: str, value: Column, bound: Column) -> Column:
        message = F.concat_ws("|", F.lit(kind), a.cast("string"), b.cast("string"), i.cast("string"), F.lit(side), value.cast("string"))
        return F.conv(F.substring(_hmac(key, message), 1, 15), 16, 10).cast("long") % bound

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["l"] + mixed(i, "l", s["r"], a)) % a).alias("l"), s["r"].alias("r"))) \
            .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(i, "r", s["l"], b)) % b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _power(base: int, n: Column) -> Column:
    most = 15 if base == 10 else 13
    return F.element_at(F.array(*[F.lit(base ** i).cast("long") for i in range(most + 1)]), n.cast("int") + 1)


def _number(text: Column, base: int, first: int) -> Column:
    digits = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, c: s * base + (F.ascii(c) - first))


def _spelled(value: Column, n: Column, base: int, first: int) -> Column:
    places = F.when(n > 0, F.sequence(n - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.char(F.call_function("div", value, _power(base, i)) % base + first)), "")


def permuted(key: bytes, kind: str, text: Column, base: int, first: int) -> Column:
    """A text over ``base`` characters from code ``first`` on, permuted among those of its length.

    Texts too long for two 64-bit halves go in chunks, each bound to its place.
    """
    size = 28 if base == 10 else 24

    def one(k: Column) -> Column:
        def whole(part: Column) -> Column:
            n = F.length(part)
            u = F.floor(n / 2).cast("int")
            halves = feistel(key, kind, _number(F.substr(part, F.lit(1), u), base, first),
                             _number(F.substr(part, u + 1, n - u), base, first), _power(base, u), _power(base, n - u))
            return _let(halves, lambda s: F.concat(_spelled(s["l"], u, base, first), _spelled(s["r"], n - u, base, first)))

        return _let(F.substr(text, k * size + 1, F.lit(size)), whole)

    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / size).cast("int"), F.lit(0)))
    return F.when(F.length(text) > 0, F.array_join(F.transform(chunks, one), "")).otherwise(F.lit(""))


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _refilled(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits, and letters if given, replaced one by one; case and other signs kept."""
    def at(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        before = F.substr(shape, F.lit(1), i)
        out = F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_only(before, "0-9")), F.lit(1)))
        if letters is not None:
            new = F.substr(letters, F.length(_only(before, "A-Za-z")), F.lit(1))
            out = out.when(c.rlike("[a-z]"), new).when(c.rlike("[A-Z]"), F.upper(new))
        return out.otherwise(c)

    return F.when(F.length(shape) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")).otherwise(F.lit(""))


def _each_digit(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)


def _luhn(payload: Column) -> Column:
    """The check digit for ``payload``."""
    doubled = F.transform(F.reverse(_each_digit(payload)), lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10) % 10


def _mod97(text: Column) -> Column:
    """The number spelled by digits and letters (A is 10) modulo 97."""
    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _email(key: bytes, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_refilled(local, permuted(key, "email", _only(local, "0-9"), 10, 48),
                              permuted(key, "email", F.lower(_only(local, "A-Za-z")), 26, 97)),
                    F.substr(m, F.length(local) + 1))


def _iban(key: bytes, m: Column) -> Column:
    """The longest beginning of ``m``, cut at a blank, whose check digits hold is replaced."""
    def valid(x: Column) -> Column:
        plain = _only(x, "A-Z0-9")
        return (F.length(plain) >= 12) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1)

    words = F.split(m, " ")
    begun = F.transform(F.sequence(F.size(words), F.lit(1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    one = lambda x: F.concat(_one_iban(key, x), F.substr(m, F.length(x) + 1))
    return F.coalesce(F.get(F.transform(F.slice(F.filter(begun, valid), 1, 1), one), F.lit(0)), m)


def _one_iban(key: bytes, m: Column) -> Column:
    def made(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
        new = _refilled(account, permuted(key, "iban", _only(account, "0-9"), 10, 48),
                        permuted(key, "iban", F.lower(_only(account, "A-Z")), 26, 97))
        fresh = _let(new, lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        spaced = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
            F.substr(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(x, F.length(_only(F.substr(m, F.lit(1), i), "A-Z0-9")), F.lit(1)))), "")
        return _let(fresh, spaced)

    return _let(_only(m, "A-Z0-9"), made)


#: 400 years, a whole Gregorian cycle: 146097 = 189 * 773 days from 1800-01-01 on.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _date(key: bytes, m: Column) -> Column:
    def made(p: Column) -> Column:
        number = lambda i: F.element_at(p, i).cast("int")
        year_first = F.length(F.element_at(p, 1)) == 4
        day_first = ~year_first & (number(2) <= 12)  # otherwise the month comes first
        y = F.when(year_first, number(1)).otherwise(number(3))
        mo = F.when(year_first | day_first, number(2)).otherwise(number(1))
        d = F.when(year_first, number(3)).when(day_first, number(1)).otherwise(number(2))
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        longest = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        valid = y.between(1800, 2199) & mo.between(1, 12) & (d >= 1) & (d <= longest)
        safe = lambda x, other: F.when(valid, x).otherwise(F.lit(other))
        day = F.datediff(F.make_date(safe(y, 2000), safe(mo, 1), safe(d, 1)), F.lit(FIRST_DAY).cast("date"))
        pair = feistel(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"))
        new = _let(pair, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")))
        like = lambda x, i: F.lpad(x.cast("string"), F.greatest(F.length(F.element_at(p, i)), F.length(x.cast("string"))), F.lit("0"))
        sign = F.substring(_only(m, "./-"), 1, 1)
        told = lambda n: (F.when(year_first, F.concat_ws(sign_of, like(F.year(n), 1), like(F.month(n), 2), like(F.day(n), 3)))
                          .when(day_first, F.concat_ws(sign_of, like(F.day(n), 1), like(F.month(n), 2), F.year(n).cast("string")))
                          .otherwise(F.concat_ws(sign_of, like(F.month(n), 1), like(F.day(n), 2), F.year(n).cast("string"))))
        sign_of = "\x00"
        return F.when(valid, F.replace(_let(new, told), F.lit(sign_of), sign)).otherwise(m)

    return _let(F.split(m, "[./-]"), made)


def _ssn(key: bytes, m: Column) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas, 99 groups, 9999 serials
    pair = feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))

    def told(s: Column) -> Column:
        at = F.floor(s["l"] / 99)
        return F.concat_ws("-", F.lpad(F.when(at >= 665, at + 2).otherwise(at + 1).cast("string"), 3, "0"),
                           F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(pair, told)).otherwise(m)


def _ip(key: bytes, m: Column) -> Column:
    def made(p: Column) -> Column:
        n = [F.element_at(p, i).cast("long") for i in (1, 2, 3, 4)]
        valid = (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
        bound = F.lit(65536).cast("long")
        pair = feistel(key, "ip", n[0] * 256 + n[1], n[2] * 256 + n[3], bound, bound)
        told = lambda s: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])
        return F.when(valid, _let(pair, told)).otherwise(m)

    return _let(F.split(m, r"\."), made)


def _phone(key: bytes, m: Column) -> Column:
    country = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)).otherwise(F.lit(""))

    def made(code: Column) -> Column:
        rest = F.substr(m, F.length(code) + 1)
        return F.concat(code, _refilled(rest, permuted(key, "phone", _only(rest, "0-9"), 10, 48)))

    return _let(country, made)


def _card(key: bytes, m: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        payload, head = F.substr(d, F.lit(1), n - 1), F.substring(d, 1, 1)
        new = F.concat(head, permuted(key, "card", F.substr(d, F.lit(2), n - 2), 10, 48))
        full = _let(new, lambda x: F.concat(x, _luhn(x).cast("string")))
        return F.when(_luhn(payload).cast("string") == F.substring(d, -1, 1), _let(full, lambda x: _refilled(m, x))).otherwise(m)

    return _let(_only(m, "0-9"), made)


def _replaced(key: bytes, m: Column) -> Column:
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    makers = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}
    out = None
    for kind, maker in makers.items():
        out = F.when(whole(kind), maker(key, m)) if out is None else out.when(whole(kind), maker(key, m))
    return out.otherwise(m)


def pseudonymised(text: Column, key: bytes = KEY) -> Column:
    """``struct(text, changed)``: the text with pseudonyms, and the number of values replaced.

    Null gives a null text and 0. Values that fail their validation stay as they are.
    """
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def rebuilt(ms: Column) -> Column:
        news = F.transform(ms, lambda m: _replaced(key, m))
        return _let(news, lambda n: F.struct(
            F.array_join(F.zip_with(F.split(text, ANY, -1), n, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(ms, n, lambda a, b: a != b), lambda x: x)).cast("long").alias("changed")))

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("changed"))
    return _let(found, lambda ms: F.when(F.size(ms) > 0, rebuilt(ms)).otherwise(plain))


def pseudonymise(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all columns in place, none added."""
    return docs.withColumn(text, pseudonymised(F.col(text), key)["text"])


@query("op3_feistel_pseudonyms")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pseudonymised(F.col("text")).alias("x")).select("doc_id", "x.text", "x.changed")
