import datetime
import hashlib
import hmac
import re

import pytest

from marginalia.llm import pseudonyms as P

KEY = b"test key"


def F(kind, a, b, i, side, x):
    m = f"{kind}|{a}|{b}|{i}|{side}|{x}".encode()
    return int(hmac.new(KEY, m, hashlib.sha256).hexdigest()[:15], 16)


def feistel(kind, l, r, a, b):
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            l = (l + F(kind, a, b, i, "l", r)) % a
        else:
            r = (r + F(kind, a, b, i, "r", l)) % b
    return l, r


def back(kind, l, r, a, b):
    for i in reversed(range(P.ROUNDS)):
        if i % 2 == 0:
            l = (l - F(kind, a, b, i, "l", r)) % a
        else:
            r = (r - F(kind, a, b, i, "r", l)) % b
    return l, r


def digits(kind, s, step=feistel):
    if not s:
        return ""
    u = len(s) // 2
    l, r = step(kind, int(s[:u] or 0), int(s[u:]), 10 ** u, 10 ** (len(s) - u))
    return (f"{l:0{u}d}" if u else "") + f"{r:0{len(s) - u}d}"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", P.pseudonymised(df.text, key).alias("x")).select("doc_id", "x.*").collect()
    return {r.doc_id: (r.text, r.changed) for r in rows}


CARDS = ["4111111111111111", "4387513035237269", "5555 5555 5555 4444", "378282246310005", "6011-1111-1111-1117"]


def test_cards(spark):
    got = run(spark, [f"pay {c}, now" for c in CARDS] + ["no 4111111111111112", "4111111111111111 " * 2])
    for i, c in enumerate(CARDS):
        text, n = got[i]
        new = text.removeprefix("pay ").removesuffix(", now")
        assert n == 1 and new != c and luhn(re.sub(r"\D", "", new)) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c)
        old, bare = re.sub(r"\D", "", c), re.sub(r"\D", "", new)
        assert bare[:-1] == old[0] + digits("card", old[1:-1])
        assert digits("card", bare[1:-1], back) == old[1:-1]
    assert got[5] == ("no 4111111111111112", 0)
    one = got[0][0].removeprefix("pay ").removesuffix(", now")
    assert got[6] == (f"{one} {one} ", 2)


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"])
def test_ibans(spark, iban):
    got = run(spark, [f"to {iban}.", iban.replace("8", "7", 1)])
    new = got[0][0].removeprefix("to ").removesuffix(".")
    shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s))
    assert new != iban and shape(new) == shape(iban) and new[:2] == iban[:2] and mod97(new.replace(" ", "")) == 1
    if "8" in iban:
        assert got[1][0] == iban.replace("8", "7", 1)


def test_dates(spark):
    days = ["2024-02-29", "1999/12/31", "31.12.1999", "7.3.1985", "12/25/1980", "2023-02-29", "2024-13-01", "1500-01-01", "1999-12-31", "31/12/1999"]
    got = run(spark, [f"on {d} at" for d in days])
    first = datetime.date(1800, 1, 1)

    def told(d):
        n = (d - first).days
        l, r = feistel("date", n // 773, n % 773, 189, 773)
        assert back("date", l, r, 189, 773) == (n // 773, n % 773)
        return first + datetime.timedelta(l * 773 + r)

    a, b = told(datetime.date(2024, 2, 29)), told(datetime.date(1999, 12, 31))
    c, d = told(datetime.date(1985, 3, 7)), told(datetime.date(1980, 12, 25))
    want = [a.isoformat(), f"{b:%Y/%m/%d}", f"{b:%d.%m.%Y}", f"{c.day}.{c.month}.{c.year}", f"{d:%m/%d/%Y}"] + days[5:8] + [b.isoformat(), f"{b:%d/%m/%Y}"]
    assert [got[i][0] for i in range(len(days))] == [f"on {w} at" for w in want]
    assert [got[i][1] for i in range(len(days))] == [1, 1, 1, 1, 1, 0, 0, 0, 1, 1]


def test_other_kinds(spark):
    texts = ["call +1 (464) 555-9887 or +1-464-555-9887", "ssn 078-05-1120, 666-05-1120", "host 29.217.126.147. not 999.1.1.1 nor 1.2.3.4.5",
             "Mail Rfml.67@mail6.example.com and rfml.67@mail6.example.com!", "v1.2.3 and 12345 and 3.14 and 10:20:30 and 1/2"]
    got = run(spark, texts)
    phone = digits("phone", "4645559887")
    assert got[0] == (f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} or +1-{phone[:3]}-{phone[3:6]}-{phone[6:]}", 2)
    l, r = feistel("ssn", 77 * 99 + 4, 1119, 898 * 99, 9999)
    area = l // 99 + 1
    assert got[1] == (f"ssn {area + (area >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}, 666-05-1120", 1)
    l, r = feistel("ip", 29 * 256 + 217, 126 * 256 + 147, 65536, 65536)
    assert got[2] == (f"host {l // 256}.{l % 256}.{r // 256}.{r % 256}. not 999.1.1.1 nor 1.2.3.4.5", 1)
    one, two = re.findall(r"\S+@\S+com", got[3][0])
    assert one.lower() == two and one[0].isupper() and two.endswith("@mail6.example.com") and two != "rfml.67@mail6.example.com"
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail6\.example\.com", two)
    assert got[4] == (texts[4], 0)


def test_permutation_of_a_small_format(spark):
    rows = spark.range(1000).selectExpr("lpad(cast(id as string), 3, '0') as d")
    out = [r.p for r in rows.select(P.permuted(KEY, "x", rows.d, 10, 48).alias("p")).collect()]
    assert sorted(out) == [f"{i:03d}" for i in range(1000)]
    letters = spark.createDataFrame([("".join(chr(97 + (i * 7 + j) % 26) for j in range(60)),) for i in range(40)], "d string")
    out = [r.p for r in letters.select(P.permuted(KEY, "x", letters.d, 26, 97).alias("p")).collect()]
    assert len(set(out)) == len({r.d for r in letters.collect()}) and all(re.fullmatch("[a-z]{60}", x) for x in out)


def test_odd_rows(spark):
    long = "word 12 " * 50_000 + "x" * 200_000 + " 4111111111111111 " + "9" * 50_000
    got = run(spark, [None, "", "plain", long, "a.b-" * 60_000])
    assert got[0] == (None, 0) and got[1] == ("", 0) and got[2] == ("plain", 0)
    assert got[3][1] == 1 and len(got[3][0]) == len(long) and "4111111111111111" not in got[3][0]
    assert got[4] == ("a.b-" * 60_000, 0)
    df = spark.createDataFrame([(1, "4111111111111111", "x", 3)] * 2, "doc_id long, text string, changed string, m int")
    out = P.pseudonymise(df, KEY)
    assert out.columns == df.columns and len(out.collect()) == 2 and len({r.text for r in out.collect()}) == 1
    assert P.pseudonymise(df.limit(0), KEY).collect() == []
    assert run(spark, ["4111111111111111"], b"another key" * 20) != run(spark, ["4111111111111111"])


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in P.op3(spark, sf).collect()}
    assert set(got) == set(docs)
    kinds = [r"[A-Za-z0-9.]+@[\w.-]+\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d])", r"(?<!\d)\d{16}(?!\d)"]
    seen = 0
    for d, text in docs.items():
        values = [v for k in kinds for v in re.findall(k, text or "") if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        seen += len(values)
        assert not any(v in got[d].text for v in values)
        assert got[d].changed >= len(values)
        if not any(c.isdigit() or c == "@" for c in text or ""):
            assert got[d].text == text and got[d].changed == 0
    assert seen > 5


def test_values_beside_other_words(spark):
    """Account numbers before upper-case words, other numbers and cards; dates after colons and before times."""
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t))
    mod97 = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    cases = [("BE68539007547034", " EUR"), ("ES9121000418450200051332", " IBAN"), ("AT611904300234573201", " BIC"), ("BE68 5390 0754 7034", " 2024"),
             ("PL61109010140000071219812874", " A"), ("DE89370400440532013000", " TO BE68")]
    check = 98 - int("".join(str(int(c, 36)) for c in "539007547034ZZ00")) % 97  # no country of this name
    cases += [(f"ZZ{check:02d}539007547034", " EUR"), (f"ZZ{check:02d} 5390 0754 7034", " NEXT ABCD")]
    dates = [("DOB:1985-03-02", "1985-03-02"), ("1985-03-02T10:00", "1985-03-02"), ("born:02.03.1985.", "02.03.1985"), ("at 1985-03-02T10:00:00Z", "1985-03-02")]
    other = ["1985-03-02", "02.03.1985", "BE68539007547034 4111 1111 1111 1111", "BE68539007547035 EUR", "1985-03-02Tx", "v1985-03-02"]
    got = run(spark, [f"to {iban}{after}" for iban, after in cases] + [t for t, _ in dates] + other)
    for k, (iban, after) in enumerate(cases):
        new = got[k][0][3:3 + len(iban)]
        assert got[k] == (f"to {new}{after}", 1) and new != iban and shape(new) == shape(iban)
        assert new[:2] == iban[:2] and mod97(new.replace(" ", ""))
    first = len(cases) + len(dates)
    plain = {"1985-03-02": got[first][0], "02.03.1985": got[first + 1][0]}
    for k, (text, date) in enumerate(dates, len(cases)):
        assert plain[date] != date and got[k] == (text.replace(date, plain[date]), 1)
    assert got[first + 2][1] == 2 and "BE68539007547034" not in got[first + 2][0] and "4111 1111 1111 1111" not in got[first + 2][0]
    assert [got[k] for k in range(first + 3, first + 6)] == [(t, 0) for t in other[3:]]
