"""Format-preserving pseudonyms for validated personal numbers, dates and addresses, in SQL functions alone.

One regular expression finds the candidates, and each is checked: cards by Luhn, IBANs by modulo 97, US social
security numbers by their unused areas, phones by the North American plan, dates by the calendar, IPv4 by range.
What passes is permuted by a keyed Feistel network on Z_n x Z_m (halves are added to a SHA-256 based function of
the other half, modulo n and m in turn), so it is a bijection of the format's valid values: equal values get
equal pseudonyms in every document, different ones different, and the holder of the key can undo it.  Check
digits are made anew; separators, letter case and digit places stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_B, _E = r"(?<![\p{L}0-9_])(?<![0-9][.,-])", r"(?![\p{L}0-9_])"
EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = _B + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _E
IPV4 = _B + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![.][0-9])" + _E
DATE = _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})" + _E
SSN = _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-[0-9])" + _E
PHONE = r"(?<![\p{L}0-9_+(])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}" + _E
CARD = _B + r"[0-9](?:[ -]?[0-9]){12,}+" + _E
#: What a run of digit groups that is no card as a whole may hold: dates, numbers and phones as above, cards in blocks.
BLOCKS = r"[2-6][0-9]{3}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\3[0-9]{4,5}|[2-6][0-9]{12,18}"
INSIDE = rf"(?<![0-9])(?=((?:{BLOCKS}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[2-9][0-9]{{2}}[ -][2-9][0-9]{{2}}[ -][0-9]{{4}})(?![0-9])))"
LONGER = r"(?<![0-9])(?=([2-6][0-9]{3}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3})(?![0-9]))"
ANY = "|".join((EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD))
#: The Gregorian calendar repeats after 146,097 = 189 * 773 days; pseudonyms of dates stay in one such period.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Steps of a walk that each end it with a chance of 0.6; the chance that any of all dates needs more is below 1e-20.
WALK = 64


def _prf(key: Column, *parts: Column) -> Column:
    """60 bits of SHA-256 over the key and the parts."""
    word = F.sha2(F.concat_ws("|", key, *(p.cast("string") for p in parts), key), 256)
    return F.conv(F.substring(word, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, n: Column, m: Column, kind: str, key: Column) -> Column:
    """A keyed permutation of (x, y) in Z_n x Z_m as struct(x, y), over ROUNDS pairs of half rounds."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def turn(s, i):
        left = F.pmod(s["x"] + _prf(key, F.lit(kind), n, m, i, F.lit("x"), s["y"]), n.cast("long"))
        return F.struct(left.alias("x"), F.pmod(s["y"] + _prf(key, F.lit(kind), n, m, i, F.lit("y"), left), m.cast("long")).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def digits_feistel(d: Column, kind: str, key: Column) -> Column:
    """A keyed permutation of decimal strings of one length (2 to 36 digits)."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(F.left(d, u).cast("long"), F.right(d, v).cast("long"), power(u), power(v), kind, key)
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), v, "0")))[0]


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _relay(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    lay = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lay, lambda s: s["out"])


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when((F.length(d) - i) % 2 == 1, twice(digit(i))).otherwise(digit(i)))


def _card(m: Column, key: Column) -> Column:
    def new(d):
        body = digits_feistel(F.left(d, F.length(d) - 1), "card", key)
        return F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]

    d = _only_digits(m)
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & (F.translate(d, "0", "") != ""), _relay(m, new(d)))


def _inside(m: Column, key: Column) -> Column:
    """struct(text, n): a run of digit groups with the n valid values in it replaced."""
    full = lambda c, p: c.rlike(f"^(?:{p})$")
    one = lambda c: F.when(full(c, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), _date(c, key)).when(full(c, "[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(c, key)).when(F.length(_only_digits(c)) == 10, _phone(c, key)).otherwise(_card(c, key))
    found = F.transform(F.array_distinct(F.concat(F.regexp_extract_all(m, F.lit(LONGER), F.lit(1)), F.regexp_extract_all(m, F.lit(INSIDE), F.lit(1)))), lambda c: F.struct(c.alias("old"), one(c).alias("new")))
    start = F.struct(m.alias("text"), F.lit(0).alias("n"))
    # of overlapping values the first counts: what it replaces is no longer there to be found
    put = lambda s, p: F.when(F.contains(s["text"], p["old"]), F.struct(F.replace(s["text"], p["old"], p["new"]).alias("text"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.filter(found, lambda p: p["new"].isNotNull()), start, put)


def _phone(m: Column, key: Column) -> Column:
    """Area and exchange begin with 2 to 9; a country code stays."""
    d = F.right(_only_digits(m), F.lit(10))
    x = F.substr(d, F.lit(1), F.lit(3)).cast("long") - 200
    y = F.substr(d, F.lit(4), F.lit(7)).cast("long") - 2_000_000
    out = feistel(x, y, F.lit(800), F.lit(8_000_000), "phone", key)
    new = F.transform(F.array(out), lambda s: F.concat((s["x"] + 200).cast("string"), (s["y"] + 2_000_000).cast("string")))[0]
    return _relay(m, F.when(F.length(_only_digits(m)) > 10, F.concat(F.lit("1"), new)).otherwise(new))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("long") for k in (1, 2, 3))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key)
    pad = lambda v, k: F.lpad(v.cast("string"), k, "0")
    text = lambda s: F.concat_ws("-", pad(s["x"] + F.when(s["x"] > 664, 2).otherwise(1), 3), pad(F.floor(s["y"] / 9999) + 1, 2), pad(s["y"] % 9999 + 1, 4))
    return F.when(ok, F.transform(F.array(out), text)[0])


def _ipv4(m: Column, key: Column) -> Column:
    p = [F.split_part(m, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]
    out = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), "ipv4", key)
    text = lambda s: F.concat_ws(".", *(v.cast("long").cast("string") for x in ("x", "y") for v in (F.floor(s[x] / 256), s[x] % 256)))
    return F.when(F.greatest(*p) < 256, F.transform(F.array(out), text)[0])


def _date(m: Column, key: Column) -> Column:
    """Year first as written; with points the day leads; with slashes the month, unless only the day can.

    A date of the last kind, whose day is above 12, is permuted until its pseudonym is one as well, which visits the
    same cycle, so those dates too map one to one among themselves.
    """
    iso = m.rlike("^[0-9]{4}")
    year = F.when(iso, F.left(m, F.lit(4))).otherwise(F.right(m, F.lit(4)))
    one = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 1, 2))
    two = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 4, 2))
    day_first = ~iso & (m.contains(".") | (one.cast("int") > 12))
    made = F.concat_ws("-", year, F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two))
    day = F.datediff(F.try_to_date(made, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    turn = lambda s: feistel(s["x"], s["y"], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key)
    when = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * DAYS[1] + s["y"]).cast("int"))
    once = turn(F.struct(F.floor(day / DAYS[1]).cast("long").alias("x"), (day % DAYS[1]).alias("y")))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda s, _: F.when(F.dayofmonth(when(s)) > 12, s).otherwise(turn(s)))
    out = F.when(day_first & ~m.contains("."), walk).otherwise(once)

    def text(s):
        new = when(s)
        y, mm, dd = (F.date_format(new, p) for p in ("yyyy", "MM", "dd"))
        return _relay(m, F.when(iso, F.concat(y, mm, dd)).when(day_first, F.concat(dd, mm, y)).otherwise(F.concat(mm, dd, y)))

    same_kind = F.when(iso, ~(m.contains("-") & m.contains("/"))).otherwise(F.substring(m, 3, 1) == F.substring(m, 6, 1))
    return F.when(same_kind & day.between(0, DAYS[0] * DAYS[1] - 1), F.transform(F.array(out), text)[0])


def _letters(s: Column, kind: str, key: Column) -> Column:
    """A keyed permutation of strings that keeps each character's class; only ASCII letters and digits change."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))

    def shifted(c, shift):
        for first, n in (("a", 26), ("A", 26), ("0", 10)):
            base = ord(first)
            yield c.rlike(f"[{first}-{chr(base + n - 1)}]"), F.chr(F.pmod(F.ascii(c) - base + shift, F.lit(n)) + base)

    def turn(s, i):
        def move(c, j):
            shift = _prf(key, F.lit(kind), i, j, F.array_join(s["b"], ""))
            case = None
            for test, value in shifted(c, shift):
                case = F.when(test, value) if case is None else case.when(test, value)
            return case.otherwise(c)

        return F.struct(s["b"].alias("a"), F.transform(s["a"], move).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))


def _email(m: Column, key: Column) -> Column:
    """The local part changes, in lower case and as digits; the domain stays."""
    return F.concat(_letters(F.lower(F.split_part(m, F.lit("@"), F.lit(1))), "email", key), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


def _mod97(s: Column) -> Column:
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
    ok = (_mod97(F.concat(rest, F.left(plain, F.lit(4)))) == 1) & F.length(plain).between(15, 34)

    def text(new):
        check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, new)
        grouped = F.rtrim(F.regexp_replace(whole, "(.{4})", "$1 "))
        return F.when(m.contains(" "), grouped).otherwise(whole)

    return F.when(ok, F.transform(F.array(_letters(rest, "iban", key)), text)[0])


def _pseudonym(m: Column, key: Column) -> Column:
    """struct(text, n): the candidate's pseudonym and the number of values in it, or n = 0 where it holds none."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    whole = lambda text: F.struct(text.alias("text"), text.isNotNull().cast("int").alias("n"))
    case = F.when(m.contains("@"), whole(_email(m, key))).when(m.rlike("^[A-Z]"), whole(_iban(m, key))).when(full(IPV4), whole(_ipv4(m, key)))
    case = case.when(full(DATE), whole(_date(m, key))).when(full(SSN), whole(_ssn(m, key))).when(full(PHONE), whole(_phone(m, key)))
    card = F.transform(F.array(_card(m, key)), lambda c: F.when(c.isNotNull(), whole(c)).otherwise(_inside(m, key)))[0]
    return case.otherwise(card)


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str = "n_pseudonyms") -> DataFrame:
    """df with the valid values in its text column replaced and their number in a long column of the name found.

    A run of digit groups that is no card as a whole is searched for cards in their usual blocks, social security
    numbers, phones and dates.  A null text stays null with a count of 0; invalid look-alikes, and text without such
    values, stay byte for byte.  Other columns are untouched, except that a column named found is replaced.  E-mail
    names are compared without regard to case; a repeated value has one pseudonym wherever it stands.
    """
    t, k = F.col(text), F.lit(key)
    hits = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    new = "__new"
    while new in df.columns:
        new += "_"
    out = df.withColumn(new, F.transform(hits, lambda m: F.struct(m.alias("old"), _pseudonym(m, k).alias("new"))))
    out = out.withColumn(found, F.coalesce(F.aggregate(new, F.lit(0), lambda s, x: s + x["new"]["n"]), F.lit(0)).cast("long"))
    gaps = F.split(t, ANY, -1)
    values = F.concat(F.transform(new, lambda x: F.when(x["new"]["n"] > 0, x["new"]["text"]).otherwise(x["old"])), F.array(F.lit("")))
    made = F.array_join(F.zip_with(gaps, values, lambda a, b: F.concat(a, b)), "")
    return out.withColumn(text, F.when(F.col(found) > 0, made).otherwise(t)).drop(new)


KEY = "factweave example key: set your own"


def op9_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms and their number for every document."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), KEY)


def pseudonym_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row, null and repeated ids and null texts too, with pseudonyms; n_chars is counted anew."""
    out = pseudonymise(docs.select("doc_id", "text", "lang", "source"), KEY)
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


__all__ = ["pseudonymise", "feistel", "digits_feistel", "op9_feistel_pseudonyms", "pseudonym_stage"]
