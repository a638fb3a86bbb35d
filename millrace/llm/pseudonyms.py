"""Format-preserving pseudonyms for validated numbers and dates (native expressions only).

A value is split into two parts with fixed moduli, and a keyed Feistel network adds round values
to one part and the other in turn. The network is a permutation of exactly the values that are
valid in the format, so a pseudonym has the same form and passes the same validation, and equal
values have equal pseudonyms in all documents, however they are punctuated.

Kinds: payment card numbers (13 to 19 digits, Luhn), account numbers of countries that use digits
only (IBAN, modulo 97), North American phone numbers with and without an area code, social
security numbers, IPv4 addresses and dates of the years 1800 to 2199 (one Gregorian cycle of
146097 = 189 * 773 days), written year or day first. What looks like one of them but is not valid
stays as it is, and so do dates with the month first, which cannot be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: For tests and the registered query only; pass a secret of your own.
DEMO_KEY = "not-a-secret"
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

# The forms that are looked at.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMS = {
    "date": "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})",
    "ip": f"{OCTET}(?:\\.{OCTET}){{3}}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": "(?:(?:\\+?1[ .-]?)?(?:\\([2-9][0-9]{2}\\) ?|[2-9][0-9]{2}[ .-]))?[2-9][0-9]{2}[ .-][0-9]{4}",
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[0-9]){11,26}",
    "card": "[0-9](?:[ -]?[0-9]){12,18}",
}
CANDIDATE = "(?<![0-9A-Za-z_.+-])(?:" + "|".join(FORMS.values()) + ")(?![0-9A-Za-z_]|[.-][0-9])"
KINDS = tuple(FORMS)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(a: Column, b: Column, moduli: tuple[Column, Column], key: str, kind: str) -> Column:
    """struct(a, b) after ROUNDS rounds on Z_m x Z_n."""

    def round_value(i: Column, other: Column, modulus: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"), F.lit(key)), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)

    def step(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        return F.struct(
            F.when(left, F.pmod(s["a"] + round_value(i, s["b"], moduli[0]), moduli[0])).otherwise(s["a"]).alias("a"),
            F.when(left, s["b"]).otherwise(F.pmod(s["b"] + round_value(i, s["a"], moduli[1]), moduli[1])).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _reform(value: Column, digits: Column) -> Column:
    """value with its digits replaced in turn by those of digits, punctuation kept."""
    chars = F.split(value, "")

    def step(s: Column, c: Column) -> Column:
        number = c.rlike("[0-9]")
        return F.struct(F.concat(s["text"], F.when(number, F.substring(digits, s["n"], 1)).otherwise(c)).alias("text"), F.when(number, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("n")), step, lambda s: s["text"])


def _number(digits: Column, start: int, length: int | Column) -> Column:
    return digits.substr(F.lit(start), F.lit(length) if isinstance(length, int) else length).cast("long")


def _day(value: Column) -> Column:
    parsed = F.coalesce(F.try_to_date(F.when(value.rlike("^[0-9]{4}-"), value), "yyyy-MM-dd"), F.try_to_date(F.when(value.rlike("^[0-9]{2}/"), value), "dd/MM/yyyy"))
    day = F.datediff(parsed, F.to_date(F.lit(FIRST_DAY))).cast("long")
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day)


def kind_of(value: Column) -> Column:
    """The kind whose form and validation the whole value passes; null if none."""
    whole = lambda k: value.rlike(f"^(?:{FORMS[k]})\\z")
    digits = _digits(value)
    ssn = (~digits.substr(1, 3).isin("000", "666")) & (digits.substr(1, 1) != "9") & (digits.substr(4, 2) != "00") & (digits.substr(6, 4) != "0000")
    return (
        F.when(whole("date"), F.when(_day(value).isNotNull(), "date")).when(whole("ip"), "ip").when(whole("ssn"), F.when(ssn, "ssn")).when(whole("phone"), "phone").when(whole("card"), F.when((_check_digit(digits.substr(F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))) & ~digits.rlike("^0+\\z"), "card")).when(whole("iban"), F.when(_iban_check(value.substr(1, 2), digits.substr(F.lit(3), F.length(digits) - 2)) == digits.substr(1, 2), "iban"))
    )


def _check_digit(payload: Column) -> Column:
    """The Luhn digit that completes payload."""
    total = F.aggregate(
        F.transform(F.filter(F.split(F.reverse(payload), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    letters = F.concat(*[(F.ascii(country.substr(i, 1)) - 55).cast("string") for i in (1, 2)])
    rest = F.aggregate(F.filter(F.split(F.concat(account, letters, F.lit("00")), ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)
    return _pad(98 - rest, 2)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of that kind; the value itself where kind is null."""
    fixed = lambda m, n: (F.lit(m).cast("long"), F.lit(n).cast("long"))
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def date(v: Column) -> Column:
        moved = lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["a"] * DAYS[1] + s["b"]).cast("int"))
        day = _day(v)
        return _let(feistel(F.floor(day / DAYS[1]), day % DAYS[1], fixed(*DAYS), key, "date"), lambda s: F.when(v.rlike("^[0-9]{4}-"), F.date_format(moved(s), "yyyy-MM-dd")).otherwise(F.date_format(moved(s), "dd/MM/yyyy")))

    def ip(v: Column) -> Column:
        part = lambda i: F.split(v, "\\.").getItem(i).cast("long")
        octets = lambda n: F.concat_ws(".", F.floor(n / 256).cast("long"), n % 256)
        return _let(feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), fixed(65536, 65536), key, "ip"), lambda s: F.concat_ws(".", octets(s["a"]), octets(s["b"])))

    def ssn(v: Column) -> Column:
        # areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
        d = _digits(v)
        area = _number(d, 1, 3) - 1 - F.when(_number(d, 1, 3) > 666, 1).otherwise(0)
        return _let(
            feistel(area, (_number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1, fixed(898, 99 * 9999), key, "ssn"),
            lambda s: F.concat_ws("-", _pad(s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0), 3), _pad(F.floor(s["b"] / 9999) + 1, 2), _pad(s["b"] % 9999 + 1, 4)),
        )

    def phone(v: Column) -> Column:
        # area and exchange codes start with 2 to 9; a country code stays
        d = _digits(v)
        last = d.substr(F.length(d) - 9, F.lit(10))
        local = _let(feistel(_number(d, 1, 3) - 200, _number(d, 4, 4), fixed(800, 10_000), key, "local"), lambda s: _reform(v, F.concat(_pad(s["a"] + 200, 3), _pad(s["b"], 4))))
        return F.when(F.length(d) == 7, local).otherwise(_let(
            feistel(_number(last, 1, 3) - 200, _number(last, 4, 7) - 2_000_000, fixed(800, 8_000_000), key, "phone"),
            lambda s: _reform(v, F.concat(d.substr(F.lit(1), F.length(d) - 10), _pad(s["a"] + 200, 3), _pad(s["b"] + 2_000_000, 7))),
        ))

    def card(v: Column) -> Column:
        d = _digits(v)
        n = F.length(d) - 1
        left = F.floor(n / 2).cast("int")

        def whole(s: Column) -> Column:
            return _let(F.concat(_pad(s["a"], left), _pad(s["b"], n - left)), lambda p: _reform(v, F.concat(p, _check_digit(p))))

        return _let(feistel(_number(d, 1, left), d.substr(left + 1, n - left).cast("long"), (power(left), power(n - left)), key, "card"), whole)

    def iban(v: Column) -> Column:
        d, country = _digits(v), v.substr(1, 2)
        n = F.length(d) - 2
        left = F.floor(n / 2).cast("int")
        account = lambda s: F.concat(_pad(s["a"], left), _pad(s["b"], n - left))
        moved = feistel(_number(d, 3, left), d.substr(left + 3, n - left).cast("long"), (power(left), power(n - left)), key, "iban")
        return _let(_let(moved, account), lambda p: _reform(v, F.concat(_iban_check(country, p), p)))

    out = F.when(kind == "date", date(value)).when(kind == "ip", ip(value)).when(kind == "ssn", ssn(value)).when(kind == "phone", phone(value)).when(kind == "card", card(value)).when(kind == "iban", iban(value))
    return F.coalesce(out, value)


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, one count a kind): the whole text with its validated values replaced."""

    def of(found: Column) -> Column:
        counted = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
        pieces = F.split(text, CANDIDATE)
        values = F.transform(found, lambda x: pseudonym(x["value"], x["kind"], key))
        joined = F.array_join(F.zip_with(pieces, F.concat(values, F.array(F.lit(""))), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
        return F.struct(joined.alias("text"), *[counted(k) for k in KINDS])

    found = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    bare = F.struct(text.alias("text"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    return F.when(text.rlike(CANDIDATE), _let(found, of)).otherwise(bare)


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, keep: list[str] | None = None) -> DataFrame:
    """docs with ``text`` rewritten and the struct ``_fp`` of the counts by kind.

    A null text stays null with no values. Nothing is shuffled or joined, so null and repeated
    doc_id values do not matter. Texts of any length are rewritten as a whole. ``_fp`` replaces a
    column of that name, other columns are carried. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "_fp"] if keep is None else keep
    out = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], pseudonymised(F.col("text"), key).alias("_fp"))
    return out.select(*[F.col("_fp.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in keep], F.struct(*[F.coalesce(F.col(f"_fp.n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]).alias("_fp"))


def pseudonym_report(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """Per row of docs: doc_id, text, and the number of values replaced by kind."""
    return pseudonymise(docs, key, keep=["doc_id", "text"]).select("doc_id", "text", *[f"_fp.n_{k}" for k in KINDS])
