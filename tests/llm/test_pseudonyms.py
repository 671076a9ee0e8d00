import datetime
import hashlib
import re

from factweave.llm import pseudonyms as P

K = "k"


def prf(*parts):
    return int(hashlib.sha256("|".join([K, *map(str, parts), K]).encode()).hexdigest()[:15], 16)


def feistel(x, y, n, m, kind):
    for i in range(1, P.ROUNDS + 1):
        x = (x + prf(kind, n, m, i, "x", y)) % n
        y = (y + prf(kind, n, m, i, "y", x)) % m
    return x, y


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10


def card(m):
    d = re.sub(r"\D", "", m)
    body, u = d[:-1], (len(d) - 1) // 2
    x, y = feistel(int(body[:u]), int(body[u:]), 10**u, 10 ** (len(body) - u), "card")
    new = f"{x:0{u}d}{y:0{len(body) - u}d}"
    new += str(-luhn(new + "0") % 10)
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in m)


def date(y, m, d):
    day = (datetime.date(y, m, d) - datetime.date(1800, 1, 1)).days
    a, b = feistel(day // 773, day % 773, 189, 773, "date")
    return datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)


def test_values(spark):
    c1, c2 = "4111 1111 1111 1111", "4111-1111-1111-1111"
    iso, dmy, us = date(1984, 2, 29), date(1984, 2, 29).strftime("%d.%m.%Y"), date(2001, 3, 4).strftime("%m/%d/%Y")
    x, y = feistel(743 - 200, 5553824 - 2000000, 800, 8000000, "phone")
    rows = {
        1: (None, None, 0), 2: ("", "", 0), 3: ("plain text, no values 12 345.", None, 0),
        4: (f"a {c1}, {c2}; 4111111111111111.", f"a {card(c1)}, {card(c2)}; {card('4111111111111111')}.", 3),
        5: ("4111111111111112 0000000000000000 x4111111111111111", None, 0),
        6: ("born 1984-02-29 or 29.02.1984, 03/04/2001; 1983-02-29 1700-01-01 99/99/1999", f"born {iso} or {dmy}, {us}; 1983-02-29 1700-01-01 99/99/1999", 3),
        7: ("+1 (743) 555-3824!", f"+1 ({x + 200}) {str(y + 2000000)[:3]}-{str(y + 2000000)[3:]}!", 1),
        9: (f"{c1} 12/26 4111111111111111 123, 2 {c1}; {c1} 5500 0000 0000 0004", f"{card(c1)} 12/26 {card('4111111111111111')} 123, 2 {card(c1)}; {card(c1)} {card('5500 0000 0000 0004')}", 5),
        10: (f"{c1} 743-555-3824 3782 822463 10005 7", f"{card(c1)} {x + 200}-{str(y + 2000000)[:3]}-{str(y + 2000000)[3:]} {card('3782 822463 10005')} 7", 3),
        8: ("000-12-3456 666-12-3456 1.2.3.4.5 256.1.1.1", None, 0),
    }
    df = spark.createDataFrame([(i, t, "n") for i, (t, _, _) in rows.items()], "doc_id long, text string, old string")
    got = {r.doc_id: r for r in P.pseudonymise(df, K).collect()}
    for i, (old, new, n) in rows.items():
        assert got[i].text == (old if new is None else new) and got[i].n_pseudonyms == n and got[i].old == "n", i


def test_formats_and_links(spark):
    texts = ["call 10.20.30.40 or Ann.Bo-9@Mail.example.com, 123-45-6789", "ann.bo-9@mail.example.com 123-45-6789 10.20.30.40", "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432", "x" * 300_000 + " 10.20.30.40"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b, c, d = (r.text for r in P.pseudonymise(df, K).orderBy("doc_id").collect())
    ip, mail, ssn = re.fullmatch(r"call ([\d.]+) or ([a-z]{3}\.[a-z]{2}-\d@Mail\.example\.com), (\d{3}-\d\d-\d{4})", a).groups()
    assert b == f"{mail.replace('Mail', 'mail')} {ssn} {ip}" and d.endswith(ip) and ip != "10.20.30.40" and max(map(int, ip.split("."))) < 256
    spaced, plain = re.fullmatch(r"(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) (GB\d\d[A-Z]{4}\d{14})", c).groups()
    assert spaced.replace(" ", "") == plain and int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1


def test_bijection(spark):
    from pyspark.sql import functions as F

    ids = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert ids.select(P.digits_feistel(F.col("d"), "t", F.lit(K)).alias("e")).where("e rlike '^[0-9]{3}$'").distinct().count() == 1000
    assert P.pseudonymise(spark.createDataFrame([], "text string"), K).collect() == []


def test_dates_one_to_one(spark):
    """Every date of 40 years in every way of writing it has a pseudonym of its own, written and read the same way."""
    from pyspark.sql import functions as F

    days = spark.range(40 * 365 + 10).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("t"))
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]
    rows = days.select(F.explode(F.array(*(F.date_format("t", f) for f in forms))).alias("text")).distinct()
    made = P.pseudonymise(rows.withColumn("old", F.col("text")).withColumn("__new", F.lit("mine")), K).where("n_pseudonyms = 1 and __new = 'mine'").select("old", "text").collect()
    assert len(made) == rows.count() == len({r.text for r in made})
    first = lambda t: t[2] == "/" and int(t[:2]) > 12
    assert all(first(r.old) == first(r.text) and re.sub(r"\d", "0", r.old) == re.sub(r"\d", "0", r.text) for r in made)
