"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A value found in a text is validated and replaced by another of the same
format through a keyed Feistel permutation of what it says, without its
separators. Equal values get equal pseudonyms in every document and notation,
different values different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Formats, in the order in which they are tried at a place. Fixed values. All runs are bounded, so that no text, however long,
#: can exhaust the stack or make the search go back over itself, and no value is longer than a few hundred characters.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?=[A-Za-z0-9])[A-Za-z0-9.\-]{1,255}(?<=\.[A-Za-z]{2,63})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    ("date", r"(?<![\d\-/.])(?:\d{4}[\-/.](?:0[1-9]|1[0-2])[\-/.](?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[\-/.](?:0[1-9]|1[0-2])[\-/.]\d{4}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/\d{4})(?![\d\-/]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?(?!OTHER)\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[abp])[_\-][A-Za-z0-9_\-]{16,255})(?![A-Za-z0-9])"),
]
#: A phone number ends where a value of another format begins.
OTHER = "|".join(f"(?:{p})" for k, p in KINDS if k in ("email", "ip", "date", "ssn", "card"))
KINDS = [(k, p.replace("OTHER", OTHER)) for k, p in KINDS]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: What a text must hold for any format to match: a digit, an at sign, a long hexadecimal run or the beginning of a key.
HINT = r"[0-9@]|[a-fA-F]{32}|AKIA|(?:sk|pk|gh[po]|xox[abp])[_\-]"
#: Calling codes of one and two digits; all others have three. Fixed values.
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ROUNDS = 6
#: Character classes, each permuted within itself. Fixed values.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days of 400 Gregorian years, as the two radices of the date permutation, and days from 1800 to 1970.
DAY_RADIX = (189, 773)
SINCE_1800 = 62_091
#: Social security numbers: 898 areas (001 to 899 but 666) with 99 groups each, and 9,999 serials.
SSN_RADIX = (898 * 99, 9999)
#: Control characters between which values are marked in a text; the first one in the text itself is escaped by the second.
MARK, OWN, VALUE = "\x01", "\x02", "\x03"


def _moved(char: Column, by: Column, alphabets: list[str]) -> Column:
    """The character so many places on in its alphabet; one in no alphabet stays."""
    out = char
    for alphabet in alphabets:
        at = F.instr(F.lit(alphabet), char)
        out = F.when(at > 0, F.substr(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
    return out


def _permuted(key: str, value: Column, alphabets: list[str]) -> Column:
    """A keyed permutation of the strings of one pattern: a Feistel network on the two halves of the value.

    In a round every character of one half moves on in its class by a number
    hashed from the key, the round, the length and the other half in lower
    case, so values that differ only in case stay so.
    """
    middle = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substr(value, F.lit(1), middle).alias("l"), F.substr(value, middle + 1, F.length(value)).alias("r"))

    def half(own: Column, other: Column, turn: Column) -> Column:
        hashed = F.sha2(F.concat_ws("/", F.lit(key), turn.cast("string"), F.length(own).cast("string"), F.lower(other)), 512)
        by = lambda h, i: F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = lambda h: F.array_join(F.transform(F.split(own, ""), lambda c, i: _moved(c, by(h, i), alphabets)), "")
        return F.get(F.transform(F.array(hashed), moved), F.lit(0))  # hashed once, not for each character

    def turned(s: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(half(s["l"], s["r"], turn).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), half(s["r"], s["l"], turn).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turned, lambda s: F.concat(s["l"], s["r"]))


def _mixed(key: str, left: Column, right: Column, radix: tuple[int, int], finish) -> Column:
    """A keyed permutation of pairs of numbers below the radices, finished by a function of both."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def add(own: Column, other: Column, turn: Column, size: int) -> Column:
        hashed = F.conv(F.substr(F.sha2(F.concat_ws("/", F.lit(key), turn.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return (own + hashed) % size

    def turned(s: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(add(s["l"], s["r"], turn, radix[0]).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), add(s["r"], s["l"], turn, radix[1]).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turned, lambda s: finish(s["l"], s["r"]))


def _plain(value: Column) -> Column:
    """The letters and digits of a value, without what separates them."""
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _written_as(value: Column, plain: Column) -> Column:
    """The characters of plain in the places of the value's letters and digits."""
    state = F.struct(F.lit("").alias("s"), plain.alias("n"))

    def put(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], F.left(a["n"], F.lit(1))).alias("s"), F.substr(a["n"], F.lit(2), F.length(a["n"])).alias("n"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))

    return F.aggregate(F.split(value, ""), state, put, lambda a: a["s"])


def _luhn(digits: Column) -> Column:
    """The check digit that makes the number valid."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return (10 - total % 10) % 10


def _card(key: str, value: Column) -> Column:
    """A number with a valid check digit goes to another such; others stay."""
    digits = _plain(value)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    valid = _luhn(body).cast("string") == F.right(digits, F.lit(1))
    new = F.transform(F.array(_permuted(key, body, [DIGITS])), lambda p: F.concat(p, _luhn(p).cast("string")))
    return F.when(valid, _written_as(value, F.get(new, F.lit(0)))).otherwise(value)


def _iban(key: str, value: Column) -> Column:
    """An account number with valid check digits goes to another such of its country; others stay."""
    whole = _plain(value)
    country, account = F.substr(whole, F.lit(1), F.lit(2)), F.substr(whole, F.lit(5), F.length(whole))

    def check(account: Column) -> Column:
        rest = F.aggregate(
            F.split(F.concat(account, country, F.lit("00")), ""),
            F.lit(0),
            lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
        )
        return F.lpad((98 - rest).cast("string"), 2, "0")

    new = F.transform(F.array(_permuted(key, account, [DIGITS, UPPER])), lambda p: F.concat(country, check(p), p))
    return F.when(check(account) == F.substr(whole, F.lit(3), F.lit(2)), _written_as(value, F.get(new, F.lit(0)))).otherwise(value)


def _ssn(key: str, value: Column) -> Column:
    """A number with an area, group and serial that are issued goes to another such; others stay."""
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")

    def written(high: Column, low: Column) -> Column:
        at = F.floor(high / 99) + 1
        part = lambda n, width: F.lpad(n.cast("string"), width, "0")
        return F.concat_ws("-", part(at + (at >= 666).cast("int"), 3), part(high % 99 + 1, 2), part(low + 1, 4))

    return F.when(valid, _mixed(key, place * 99 + group - 1, serial - 1, SSN_RADIX, written)).otherwise(value)


def _ip(key: str, value: Column) -> Column:
    part = F.transform(F.split(value, r"\."), lambda c: c.cast("int"))
    left, right = F.get(part, F.lit(0)) * 256 + F.get(part, F.lit(1)), F.get(part, F.lit(2)) * 256 + F.get(part, F.lit(3))
    high, low = (lambda n: F.floor(n / 256).cast("string")), (lambda n: (n % 256).cast("string"))
    return _mixed(key, left, right, (65_536, 65_536), lambda a, b: F.concat_ws(".", high(a), low(a), high(b), low(b)))


def _date(key: str, value: Column) -> Column:
    """Real dates go to dates of the same 400 years and format; others stay."""
    a, b = DAY_RADIX
    mark = F.regexp_extract(value, r"[-/.]", 0)
    parts = F.split(value, r"[-/.]")
    first, second, third = (F.get(parts, F.lit(k)).cast("int") for k in range(3))
    year_first = F.length(F.get(parts, F.lit(0))) == 4
    american = ~year_first & (second > 12)
    iso = F.when(year_first, F.concat_ws("-", *[F.get(parts, F.lit(k)) for k in range(3)])).otherwise(
        F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.when(american, first).otherwise(second).cast("string"), 2, "0"), F.lpad(F.when(american, second).otherwise(first).cast("string"), 2, "0"))
    )
    day = F.unix_date(F.try_to_date(iso, "yyyy-MM-dd"))
    inside = F.pmod(day + SINCE_1800, F.lit(a * b))

    def written(left: Column, right: Column) -> Column:
        moved = F.date_from_unix_date((day - inside + left * b + right).cast("int"))
        as_ = lambda pattern: F.date_format(moved, pattern)
        joined = lambda *p: F.concat(as_(p[0]), mark, as_(p[1]), mark, as_(p[2]))
        return F.when(year_first, joined("yyyy", "MM", "dd")).when(american, joined("MM", "dd", "yyyy")).otherwise(joined("dd", "MM", "yyyy"))

    return F.coalesce(_mixed(key, F.floor(inside / b), inside % b, DAY_RADIX, written), value)


def _phone(key: str, value: Column) -> Column:
    """The national number is permuted, with a calling code or without one; it has 7 to 15 digits with its code."""
    code = F.regexp_extract(value, CALLING, 0)
    national = F.substr(value, F.length(code) + 1, F.length(value))
    valid = F.length(_plain(value)).between(7, 15)
    return F.when(valid, F.concat(code, _written_as(national, _permuted(key, _plain(national), [DIGITS])))).otherwise(value)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that some format of KINDS has matched; the value itself where it is not valid."""
    own = lambda kind: f"{key}/{kind}"
    tail = F.regexp_extract(value, r"\.[A-Za-z]{2,63}$", 0)
    email = F.concat(_permuted(own("email"), F.substr(value, F.lit(1), F.length(value) - F.length(tail)), [DIGITS, LOWER, UPPER]), tail)
    out = F.when(value.contains("@"), email)
    out = out.when(value.rlike(r"^[0-9a-f]{32,64}$"), _permuted(own("secret"), value, [DIGITS + LOWER[:6]]))
    out = out.when(value.rlike(r"^[0-9A-F]{32,64}$"), _permuted(own("secret"), value, [DIGITS + UPPER[:6]]))
    out = out.when(value.rlike(r"^(?:AKIA|(?:sk|pk|gh[po]|xox[abp])[_\-])"), F.concat(F.substr(value, F.lit(1), F.lit(4)), _permuted(own("secret"), F.substr(value, F.lit(5), F.length(value)), [DIGITS, LOWER, UPPER])))
    out = out.when(value.rlike(r"^[A-Z]{2}\d"), _iban(own("iban"), value))
    out = out.when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), _ip(own("ip"), value))
    out = out.when(value.rlike(r"^(?:\d{4}[-/.]\d\d[-/.]\d\d|\d\d[-/.]\d\d[-/.]\d{4})$"), _date(own("date"), value))
    out = out.when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(own("ssn"), value))
    out = out.when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), _phone(own("phone"), value))
    return out.otherwise(_card(own("card"), value))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """Replace personal data in the whole text by pseudonyms of the same format.

    Found are email addresses, IBANs, IPv4 addresses, dates, social security
    numbers, phone numbers, card and account numbers of 13 to 19 digits, and
    keys. Numbers are validated first: card numbers by their check digit,
    IBANs modulo 97, social security numbers by the parts that are issued,
    dates by the calendar, phone numbers by their 7 to 15 digits. What is not
    valid stays as it is; what is becomes another valid value, a date one of
    the same 400 years (1800 to 2199 for most). A date that could be either is
    read day first. Separators have no part in a permutation, nor has case, nor a calling
    code, so a value is linked across notations. Whoever has the key can undo
    the pseudonyms: it is a secret of the caller's and has no default.

    Equal values get equal pseudonyms everywhere under one key. A permutation
    may map a value to itself, as rarely as any other value. Null stays null,
    an empty text empty; very long texts are searched in linear time; no row is
    added, dropped or shuffled; other columns are kept, whatever their names.
    count_col names a column for the number of values replaced; docs must not have it.
    """
    text = F.col(f"`{text_col}`")
    parts, new = unused(docs, "_parts", "_new")
    escaped = F.replace(text, F.lit(MARK), F.lit(MARK + OWN))
    marked = F.split(F.regexp_replace(escaped, PATTERN, f"{MARK}{VALUE}$0{MARK}{VALUE}"), MARK + VALUE, -1)
    out = docs.withColumn(parts, F.when(text.rlike(HINT), marked))
    out = out.withColumn(new, F.transform(parts, lambda p, i: F.when(i % 2 == 1, pseudonym(p, key)).otherwise(p)))
    if count_col:
        changed = F.filter(F.zip_with(parts, new, lambda a, b: a != b), lambda x: x)
        out = out.withColumn(count_col, F.coalesce(F.size(changed), F.lit(0)))
        out = out.withColumn(count_col, F.when(F.col(parts).isNull(), 0).otherwise(F.col(count_col)))
    whole = F.replace(F.array_join(new, ""), F.lit(MARK + OWN), F.lit(MARK))
    return out.withColumn(text_col, F.when(F.col(new).isNull(), text).otherwise(whole)).drop(parts, new)
