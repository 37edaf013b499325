"""Format-preserving pseudonyms: keyed Feistel permutations of numbers, dates, addresses within their format."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound

EMAIL = r"(?<![\w.+-])[\w.+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
NUMBER = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Alternatives in order: what an earlier one takes, a later one doesn't see.
ANY = "|".join([EMAIL, IP, DATE, SSN, PHONE, NUMBER])
ROUNDS = 8
#: Days of 400 years of the calendar; the range begins in 1801.
DAYS, FIRST_DAY = 146_097, "1801-01-01"
#: The first 12 days of each month, whose number is a product of two factors, and those of the later days.
EARLY, EARLY_A, EARLY_B = 12, 240, 240
LATE_DAYS, LATE_A, LATE_B = 88_497, 9, 9_833


def pads(key: str) -> tuple[str, str]:
    """Inner and outer pad of HMAC-SHA-256 for a key, in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hex."""
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def feistel(key: str, tag: str, high: Column, low: Column, a: Column | int, b: Column | int) -> Column:
    """Struct (l, r): a permutation of the pairs l < a, r < b, chosen by key and tag. a and b are at most 10**10."""
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other, size = F.when(even, s["r"]).otherwise(s["l"]), F.when(even, a).otherwise(b)
        said = keyed(key, F.concat_ws("|", F.lit(tag), i.cast("string"), a.cast("string"), b.cast("string"), other.cast("string")))
        f = F.conv(F.substring(said, 1, 15), 16, 10).cast("long")
        moved = (F.when(even, s["l"]).otherwise(s["r"]) + f % size) % size
        return F.struct(F.when(even, moved).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(high.cast("long").alias("l"), low.cast("long").alias("r")), step)


def permuted_digits(key: str, tag: str, digits: Column) -> Column:
    """A string of 2 to 20 digits permuted among those of its length."""

    def run(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - half
        a, b = F.round(F.pow(F.lit(10.0), half)), F.round(F.pow(F.lit(10.0), rest))
        out = feistel(key, tag, F.substr(d, F.lit(1), half), F.substr(d, half + 1, rest), a, b)
        return bound(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))

    return bound(digits, run)


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of digits with every second one doubled, counted from the end."""
    reverse = F.reverse(F.split(digits, ""))
    odd = 0 if double_last else 1
    terms = F.transform(reverse, lambda c, i: F.when(i % 2 == odd, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x)


def filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn by those of digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        isdigit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(isdigit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(isdigit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def only_digits(token: Column) -> Column:
    return F.regexp_replace(token, r"[^0-9]", "")


def new_number(key: str, token: Column, unchecked: bool) -> Column:
    """13 to 19 digits: all but the last are permuted, and the last is worked out anew.

    Numbers with a right check digit (Luhn) are permuted among themselves, and with ``unchecked`` so are those without: there the distance of
    the last digit from the right one (1 to 9) is shifted by a number drawn from the others. Without it they stay.
    """

    def run(d: Column) -> Column:
        n = F.length(d)
        off = luhn_sum(d, False) % 10

        def last(x: Column, distance: Column | int) -> Column:
            return F.concat(x, ((20 - luhn_sum(x, True) % 10 + distance) % 10).cast("string"))

        body = F.substr(d, F.lit(1), n - 1)
        card = bound(permuted_digits(key, "card", body), lambda x: last(x, F.lit(0)))

        def other(x: Column) -> Column:
            by = F.conv(F.substring(keyed(key, F.concat_ws("|", F.lit("last"), x)), 1, 8), 16, 10).cast("long")
            return last(x, (off - 1 + by) % 9 + 1)

        return filled(token, F.when(off == 0, card).otherwise(bound(permuted_digits(key, "number", body), other) if unchecked else d))

    return bound(only_digits(token), run)


def new_phone(key: str, token: Column) -> Column:
    """The last ten digits are permuted, a country code stays."""
    return bound(only_digits(token), lambda d: filled(token, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permuted_digits(key, "phone", F.right(d, F.lit(10))))))


def new_ssn(key: str, token: Column) -> Column:
    """Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999 are permuted among all such; other numbers of this form stay."""
    area, group, serial = (F.substring(token, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(key, "ssn", index * 99 + group - 1, serial - 1, 898 * 99, 9999)

    def told(s: Column) -> Column:
        i = F.floor(s["l"] / 99)
        return F.concat_ws("-", F.lpad((i + F.when(i >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, bound(out, told)).otherwise(token)


def new_ip(key: str, token: Column) -> Column:
    """Four numbers up to 255 are permuted among all addresses; others stay."""

    def run(parts: Column) -> Column:
        x = [parts[i].cast("int") for i in range(4)]
        valid = F.forall(parts, lambda p: p.cast("int") <= 255)
        out = feistel(key, "ip", x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536)
        new = bound(out, lambda s: F.concat_ws(".", *[v.cast("string") for v in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))
        return F.when(valid, new).otherwise(token)

    return bound(F.split(token, r"\."), run)


def new_date(key: str, token: Column) -> Column:
    """A valid date of 1801 to 2200 is permuted and written in the same form; others stay.

    Days up to the 12th of a month are permuted among themselves, and so are later ones, whatever the form: one day has one pseudonym in all
    forms. Of dd/MM/yyyy and MM/dd/yyyy the second is tried first; what only the first can read is a later day, whose pseudonym has no
    other reading either.
    """
    first = F.lit(FIRST_DAY).cast("date")

    def later(month: Column) -> Column:
        """The permuted day of a later one; such days are numbered without the first 12 of each month."""
        start = lambda m: F.datediff(F.add_months(first, m), first) - EARLY * m

        def placed(s: Column) -> Column:
            def found(near: Column) -> Column:
                m = F.when(start(near + 1) <= s, near + 1).when(start(near) <= s, near).otherwise(near - 1)
                return bound(m, lambda m: F.date_add(F.add_months(first, m), (s - start(m) + EARLY).cast("int")))

            return bound(F.least(F.floor(s * 4800 / LATE_DAYS), F.lit(4799)).cast("int"), found)

        said = bound(month, lambda i: feistel(key, "late", F.floor(i / LATE_B), i % LATE_B, LATE_A, LATE_B))
        return bound(bound(said, lambda s: (s["l"] * LATE_B + s["r"]).cast("int")), placed)

    def permuted(day: Column) -> Column:
        own = F.date_add(first, day)
        month = (F.year(own) - 1801) * 12 + F.month(own) - 1
        early = bound(month * EARLY + F.dayofmonth(own) - 1, lambda i: feistel(key, "early", F.floor(i / EARLY_B), i % EARLY_B, EARLY_A, EARLY_B))
        early = bound(bound(early, lambda s: (s["l"] * EARLY_B + s["r"]).cast("int")), lambda s: F.date_add(F.add_months(first, F.floor(s / EARLY).cast("int")), s % EARLY))
        return F.when(F.dayofmonth(own) > EARLY, later(day - EARLY * (month + 1))).otherwise(early)

    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")
    days = []
    for form in forms:
        shape = r"^\d{4}[-/]" if form.startswith("y") else r"^\d{2}[./]"
        mark = F.contains(token, F.lit("-" if "-" in form else "." if "." in form else "/"))
        day = F.datediff(F.try_to_timestamp(F.when(token.rlike(shape) & mark, token), F.lit(form)).cast("date"), first)
        days.append(F.when(day.between(0, DAYS - 1), F.struct(day.alias("day"), F.lit(form).alias("form"))))

    def written(read: Column) -> Column:
        new = bound(read["day"], permuted)
        told = F.lit(None).cast("string")
        for form in forms:
            told = F.when(read["form"] == form, F.date_format(new, form)).otherwise(told)
        return F.coalesce(told, token)

    return bound(F.coalesce(*days), written)


def new_email(key: str, token: Column) -> Column:
    """Letters and digits of the part before @ are permuted within their kind; the domain stays.

    Its two halves take turns: each is shifted, letter by letter, by a key stream drawn from the other.
    """
    local, domain = F.substring_index(token, "@", 1), F.substring_index(token, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))
    kinds = (("a", 97, 26, "^[a-z]$"), ("A", 65, 26, "^[A-Z]$"), ("0", 48, 10, "^[0-9]$"))

    def shifted(text: Column, said: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(said, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for _, base, size, kind in kinds:
                out = F.when(c.rlike(kind), F.char((F.ascii(c) - base + by) % size + base)).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        moved = bound(keyed(key, F.concat_ws("|", F.lit("email"), i.cast("string"), F.length(local).cast("string"), other)), lambda said: shifted(F.when(even, s["l"]).otherwise(s["r"]), said))
        return F.struct(F.when(even, moved).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved).alias("r"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return bound(out, lambda s: F.concat(s["l"], s["r"], F.lit("@"), domain))


def new_value(key: str, token: Column, unchecked: bool) -> Column:
    whole = lambda p: token.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(token, F.lit("@")), new_email(key, token))
        .when(token.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), new_ip(key, token))
        .when(whole(DATE), new_date(key, token))
        .when(whole(SSN), new_ssn(key, token))
        .when(whole(PHONE), new_phone(key, token))
        .otherwise(new_number(key, token, unchecked))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", unchecked: bool = True) -> DataFrame:
    """Replaces personal values in text_col by keyed pseudonyms of the same format, and adds n_found (long), the values of these forms.

    E-mail addresses, IPv4 addresses, dates (yyyy-MM-dd, yyyy/MM/dd, dd.MM.yyyy, MM/dd/yyyy, dd/MM/yyyy), social security
    numbers, phone numbers of ten digits, and numbers of 13 to 19 digits, each validated: an octet above 255, an impossible date or area
    stays as it is. Account numbers without a check digit are numbers too, so 13 to 19 digits that are no card number are permuted among such; with
    unchecked=False only those with a right check digit (Luhn) are. A permutation under one key: equal values get equal pseudonyms in all documents, different
    values different ones, and every pseudonym is valid again (check digit, octets, calendar).

    Each row is worked on alone, with column expressions, without a shuffle: the text is cut at its values, and put
    together again. A null text stays null with n_found 0; an empty one empty. All rows and columns stay.
    An empty table gives an empty one. A column named n_found is replaced. The key is part of the plan; who can
    read plans can undo the permutation.
    """
    text, inner = F.col(text_col), "__pii"
    while inner in docs.columns:
        inner += "_"
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    plain = F.split(text, ANY, -1)

    def put(values: Column) -> Column:
        new = F.transform(values, lambda v: new_value(key, v, unchecked))
        return F.concat_ws("", F.flatten(F.transform(F.arrays_zip(plain.alias("p"), new.alias("n")), lambda z: F.array(z["p"], F.coalesce(z["n"], F.lit(""))))))

    has = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    out = F.when(has, bound(found, lambda v: F.struct(F.when(F.size(v) > 0, put(v)).otherwise(text).alias("text"), F.size(v).cast("long").alias("n")))).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    columns = [F.col(f"{inner}.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_found"]
    return docs.withColumn(inner, out).select(*columns, F.col(f"{inner}.n").alias("n_found"))


#: The key of the registered query; a real one comes from the caller.
QUERY_KEY = "pseudonyms of the registered query"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
