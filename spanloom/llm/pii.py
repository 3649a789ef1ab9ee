"""PII: format-preserving Feistel pseudonyms of validated numbers and dates, in built-in functions only.

A text is searched once for what could be a private number or date; each hit is validated, and a valid one is permuted
by a keyed Feistel network inside the set of valid values of its format, so the pseudonym is valid itself, equal values
get equal pseudonyms in every document, and whoever has the key can undo it.  Everything else stays as it was, byte for
byte.  Kinds, what validates them, and the set that is permuted:

* ``card``: 13 to 19 digits, bare or in groups split by hyphens, or 13 to 16 in groups split by spaces (where a fifth
  group could be another number), that pass the Luhn check; first digit, number of digits and separators stay; the check
  digit is made anew.
* ``phone``: North American numbers, with +1 or brackets or two separators; area and exchange codes 200-999 stay so.
  With +1, which leaves no doubt of a phone, numbers with other codes too, as a set of their own.
* ``ssn``: ddd-dd-dddd with area 001-899 but 666, group 01-99, serial 0001-9999.
* ``ip``: four decimal numbers 0-255 without leading zeros.
* ``date``: yyyy-mm-dd (or with / or .) of the proleptic Gregorian calendar from 1900-01-01 to 2099-12-31; dd/mm/yyyy
  and dd.mm.yyyy likewise.
* ``email``: all letters and digits of the local part (letters stay letters of their case, digits digits), letters and
  digits by themselves, in even chunks of at most CHUNK, each permuted under a tweak of the chunks before it.

The network alternates additions modulo the two factors of the size of the set: (a, b) -> (a + F(b) mod A, b) and
(a, b) -> (a, b + F(a) mod B), ROUNDS times, with F keyed by kind and round; it is a permutation for any
sizes, so no value is walked twice and none collide.  F is SHA-256 of a subkey (itself SHA-256 of key, kind and format),
the round and the other half; 60 of its bits are used.

The key is the caller's: ``configured_key`` reads it from the session's ``spark.spanloom.pii.key``.

Defined cases: null texts stay null, empty ones empty; texts of any length are searched whole; a value that occurs many
times is replaced everywhere; of overlapping candidates the leftmost counts, then the first kind in the order phone,
card, ssn, date, ip, email; invalid candidates stay; repeated rows and null doc_ids are treated like others; extra
columns are kept by ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import unused

ROUNDS = 8
#: Where a session keeps the key.
KEY_SETTING = "spark.spanloom.pii.key"
#: Fixed: days from 1900-01-01 to 2099-12-31 are 73,049 = 319 x 229.
DAY_FACTORS = (319, 229)
#: Letters or digits of a local part that are permuted at once; 26 to this power fits a long.
CHUNK = 12
KINDS = ("phone", "card", "ssn", "date", "ip", "email")

_D, _ND = r"(?<![\w@.%+-])", r"(?![\w-])(?!\.\d)"
_PATTERNS = {
    "phone": r"(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}",
    "card": r"\d{13,19}|\d{4}-\d{4}-\d{4}-\d{1,4}(?:-\d{1,3})?|\d{4} \d{4} \d{4} \d{1,4}|\d{4}-\d{6}-\d{4,5}|\d{4} \d{6} \d{4,5}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
CANDIDATE = _D + "(?:" + "|".join(_PATTERNS.values()) + ")" + _ND + "|" + EMAIL


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn_sum(digits: Column, parity: int) -> Column:
    """Sum of the Luhn terms; digits whose distance from the right is of the given parity (1: check digit in place) are doubled."""
    n = F.length(digits)
    term = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == parity, F.when(term(i) > 4, term(i) * 2 - 9).otherwise(term(i) * 2)).otherwise(term(i))
    )


def _div(x: Column, y: Column) -> Column:
    """The quotient of longs; exact, as a division of doubles beyond 2^53 is not."""
    return F.call_function("div", x, y)


def feistel(value: Column, a: int | Column, b: int | Column, tweak: Column, back: bool = False) -> Column:
    """Permute value in [0, a * b): alternate modular additions of keyed hashes of the other half.

    tweak: a string of key, kind and format; the result is a permutation for each tweak.
    """
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    start = F.struct(_div(value, b).alias("l"), (value % b).alias("r"), F.sha2(tweak, 256).alias("key"))
    sign = F.lit(-1 if back else 1).cast("long")

    def hashed(acc: Column, x: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", acc["key"], i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        first = F.pmod(left + sign * (hashed(acc, right, i) % a), a)
        second = F.pmod(right + sign * (hashed(acc, left, i) % b), b)
        return F.struct(F.when(i % 2 == 0, first).otherwise(left).alias("l"), F.when(i % 2 == 0, right).otherwise(second).alias("r"), acc["key"].alias("key"))

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, start, turn, lambda acc: acc["l"] * b + acc["r"])


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by the given ones; its other characters stay."""
    chars = F.split(shape, "")
    put = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), put, lambda acc: acc["out"])


def _bound(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _padded(value: Column, n: Column | int) -> Column:
    return F.lpad(value.cast("string"), n, "0") if isinstance(n, int) else F.call_function("lpad", value.cast("string"), n, F.lit("0"))


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _card(x: Column, tweak: Column, back: bool) -> Column:
    d = _digits(x)
    body = F.length(d) - 2  # between the first digit and the check digit
    value = F.substring(d, F.lit(2), body).cast("long")
    high = F.floor(body / 2).cast("int")
    new = F.concat(F.substring(d, 1, 1), _padded(feistel(value, _power(high), _power(body - high), F.concat(tweak, F.length(d).cast("string"), F.substring(d, 1, 1)), back), body))
    return _refill(x, F.concat(new, ((10 - _luhn_sum(new, 0) % 10) % 10).cast("string")))


def _phone(x: Column, tweak: Column, back: bool) -> Column:
    d = _digits(x)
    ten = F.substring(d, -10, 10)
    area, exchange, line = (F.substring(ten, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    valid = (area >= 200) & (exchange >= 200)
    new = feistel((area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line, 80_000, 80_000, tweak, back)
    digits = F.concat((_div(new, F.lit(8_000_000)) + 200).cast("string"), (_div(new % 8_000_000, F.lit(10_000)) + 200).cast("string"), _padded(new % 10_000, 4))
    # the other codes: areas 000-199 with all exchanges (2 x 10^9 numbers), then areas 200-999 with exchanges 000-199
    low = 2_000_000_000
    value = F.when(area < 200, ten.cast("long")).otherwise(low + (area - 200) * 2_000_000 + exchange * 10_000 + line)
    odd = feistel(value, 60_000, 60_000, F.concat(tweak, F.lit("other")), back)
    rest = odd - low
    others = F.when(odd < low, _padded(odd, 10)).otherwise(F.concat((_div(rest, F.lit(2_000_000)) + 200).cast("string"), _padded(rest % 2_000_000, 7)))
    return _refill(x, F.concat(F.when(F.length(d) > 10, "1").otherwise(""), F.when(valid, digits).otherwise(others)))


def _ssn(x: Column, tweak: Column, back: bool) -> Column:
    area = F.substring(x, 1, 3).cast("long") - 1
    area = F.when(area > 665, area - 1).otherwise(area)
    new = feistel((area * 99 + F.substring(x, 5, 2).cast("long") - 1) * 9999 + F.substring(x, 8, 4).cast("long") - 1, 898 * 99, 9999, tweak, back)
    serial, rest = new % 9999 + 1, F.floor(new / 9999).cast("long")
    area = F.floor(rest / 99) + 1
    area = F.when(area > 665, area + 1).otherwise(area)
    return F.concat(_padded(area, 3), F.lit("-"), _padded(rest % 99 + 1, 2), F.lit("-"), _padded(serial, 4))


def _ip(x: Column, tweak: Column, back: bool) -> Column:
    part = F.split(x, r"\.")
    value = F.aggregate(part, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
    new = feistel(value, 1 << 16, 1 << 16, tweak, back)
    return F.concat_ws(".", *[(F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def _day(x: Column) -> Column:
    """The date of a hit in any of the date formats; null if it is none of the calendar."""
    d = _digits(x)
    first = x.rlike(r"^\d{4}\D")
    iso = F.concat_ws("-", F.when(first, F.substring(d, 1, 4)).otherwise(F.substring(d, 5, 4)), F.when(first, F.substring(d, 5, 2)).otherwise(F.substring(d, 3, 2)), F.when(first, F.substring(d, 7, 2)).otherwise(F.substring(d, 1, 2)))
    return F.when(F.length(d) == 8, iso.try_cast("date"))


def _date(x: Column, tweak: Column, back: bool) -> Column:
    origin = F.lit("1900-01-01").cast("date")
    new = F.date_add(origin, feistel(F.date_diff(_day(x), origin).cast("long"), *DAY_FACTORS, tweak, back).cast("int"))
    return _refill(x, F.when(x.rlike(r"^\d{4}\D"), F.date_format(new, "yyyyMMdd")).otherwise(F.date_format(new, "ddMMyyyy")))


def _email(x: Column, tweak: Column, back: bool) -> Column:
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)

    def power(base: int, n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(CHUNK // 2 + 1)]), n + 1)

    def chunk(text: Column, base: int, alphabet: str, tweak: Column) -> Column:
        n = F.length(text)
        high = F.floor(n / 2).cast("int")
        value = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc * base + F.instr(F.lit(alphabet), c) - 1)
        new = feistel(value, power(base, high), power(base, n - high), tweak, back)
        return F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("s"), new.alias("v")), lambda acc, i: F.struct(F.concat(F.substring(F.lit(alphabet), (acc["v"] % base + 1).cast("int"), F.lit(1)), acc["s"]).alias("s"), _div(acc["v"], F.lit(base)).alias("v")), lambda acc: acc["s"])

    def permuted(text: Column, base: int, alphabet: str, tag: str) -> Column:
        """The new characters of text as an array; each chunk's tweak has the length of text and a hash of the plain chunks before."""
        n = F.length(text)
        chunks = F.regexp_extract_all(text, F.concat(F.lit(".{1,"), F.ceil(n / F.ceil(n / CHUNK)).cast("string"), F.lit("}")), F.lit(0))
        first = F.struct(F.lit("").alias("s"), F.concat(tweak, F.lit(tag), n.cast("string")).alias("t"))

        def turn(acc: Column, old: Column) -> Column:
            after = lambda new: F.struct(F.concat(acc["s"], new).alias("s"), F.concat(tweak, F.lit(tag + "\x00"), F.sha2(F.concat_ws(":", acc["t"], new if back else old), 256)).alias("t"))
            return _bound(chunk(old, base, alphabet, acc["t"]), after)

        return F.split(F.when(n > 0, F.aggregate(chunks, first, turn, lambda acc: acc["s"])).otherwise(""), "")

    new_letters = _bound(F.regexp_replace(F.lower(local), "[^a-z]", ""), lambda text: permuted(text, 26, "abcdefghijklmnopqrstuvwxyz", "a"))
    new_digits = _bound(_digits(local), lambda text: permuted(text, 10, "0123456789", "0"))

    def put(acc: Column, c: Column) -> Column:
        low, is_letter, is_digit = F.lower(c), c.rlike("[A-Za-z]"), c.rlike("[0-9]")
        letter = F.get(acc["letters"], acc["a"])
        next_ = F.when(is_letter, F.when(c == low, letter).otherwise(F.upper(letter))).when(is_digit, F.get(acc["digits"], acc["d"])).otherwise(c)
        return F.struct(F.concat(acc["out"], next_).alias("out"), (acc["a"] + is_letter.cast("int")).alias("a"), (acc["d"] + is_digit.cast("int")).alias("d"), acc["letters"].alias("letters"), acc["digits"].alias("digits"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("a"), F.lit(0).alias("d"), new_letters.alias("letters"), new_digits.alias("digits"))
    return F.concat(F.aggregate(F.split(local, ""), first, put, lambda acc: acc["out"]), F.lit("@"), domain)


def kind_of(x: Column) -> Column:
    """The kind of a candidate, after validation; null for what is none."""
    full = {k: x.rlike("^(?:" + p + ")$") for k, p in _PATTERNS.items()}
    d = _digits(x)
    ten = F.substring(d, -10, 10)
    phone = full["phone"] & (ten.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") | x.startswith("+1")) & (F.length(d).isin(10) | ((F.length(d) == 11) & d.startswith("1")))
    card = full["card"] & F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0)
    ssn = full["ssn"] & x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    date = full["date"] & F.coalesce(_day(x).between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ip = x.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    return F.when(phone, "phone").when(card, "card").when(ssn, "ssn").when(date, "date").when(ip, "ip").when(x.contains("@"), "email")


def pseudonym(x: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a kind; with back, the value of a pseudonym; null kinds leave x as it is."""
    make = {"phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "email": _email}
    out = F.when(kind.isNull(), x)
    for name, f in make.items():
        out = out.when(kind == name, f(x, F.lit(f"{key}\x00{name}\x00"), back))
    return out


def configured_key(spark: SparkSession) -> str:
    """The key that the session is set to use."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def pseudonymise(docs: DataFrame, key: str, back: bool = False, text_col: str = "text") -> DataFrame:
    """docs with the text column pseudonymised and, added last, pii: its values as array<struct<kind, pseudonym>>.

    The added column is called pii, with underscores after it where docs has such a column.  Texts without a digit or an
    at sign are passed on without a search.  Hits and the texts between them are found by the same pattern, made one text
    again in order; nothing is shuffled.
    """
    text = F.col(f"`{text_col}`")
    hits, values, made, new = (unused(docs, f"pii_{c}") for c in ("hits", "values", "made", "text"))
    found = docs.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    judged = F.transform(hits, lambda x: F.struct(x.alias("value"), kind_of(x).alias("kind")))
    found = found.withColumn(values, F.when(F.size(hits) > 0, judged).otherwise(F.array().cast("array<struct<value:string,kind:string>>")))
    replaced = F.transform(values, lambda v: F.struct(v["kind"].alias("kind"), pseudonym(v["value"], v["kind"], key, back).alias("pseudonym")))
    found = found.withColumn(made, F.when(F.size(values) > 0, replaced).otherwise(F.array().cast("array<struct<kind:string,pseudonym:string>>")))
    between = F.split(text, CANDIDATE, -1)
    whole = F.concat(F.array_join(F.transform(made, lambda v, i: F.concat(F.get(between, i), v["pseudonym"])), ""), F.get(between, F.size(made)))
    return found.withColumn(new, F.when(F.size(made) > 0, whole).otherwise(text)).select(
        *[F.col(new).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.filter(made, lambda v: v["kind"].isNotNull()).alias(unused(docs, "pii"))
    )
