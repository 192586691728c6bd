"""Operator 4, personal data: format-preserving Feistel pseudonyms with DataFrame functions alone.

Validated card numbers (Luhn), IPv4 addresses, phone numbers, bank accounts (mod 97), dates, and the
names in e-mail addresses and keys are replaced by a keyed permutation of all values of the same
format, so equal values stay equal across documents and the format survives. The permutation is a
Feistel network of ROUNDS rounds over two halves with SHA-256 of the key, the round and the other
half as its round function. Numbers that fail validation are left alone.

Null texts stay null with no matches; empty texts stay empty; repeated rows give repeated results;
all other columns of the input are kept as they are. Very long texts are one expression each and are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8

#: What is looked for, in order of precedence.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}\b",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}\"?[0-9A-Za-z][0-9A-Za-z._-]{6,}[0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,5}\)?){1,4}[ .-]?[0-9]{3,8}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])?[0-9]{3}[ .-][0-9]{4}(?![0-9]))",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: A text without these has none of the above.
_HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_?key)"


def _digest(key: str, what: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column, at: int = 1, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def permute_text(value: Column, key: str, what: str) -> Column:
    """Digits, small and capital letters of value permuted within their kinds; other characters stay.

    Feistel network over the string's halves: each character of one half is shifted, within its
    kind, by a number drawn from the other half.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def shifted(one: Column, other: Column, turn: Column) -> Column:
        digest = lambda block: _digest(key, what, turn, block, other)

        def moved(c: Column, i: Column) -> Column:
            # 16 characters to a digest, 4 hexadecimal digits each
            d = F.conv(F.substr(digest(F.floor(i / 16)), (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            turn_in = lambda base, size: F.char(((code - base + d) % size + base).cast("long"))
            return F.when(c.rlike("[0-9]"), turn_in(48, 10)).when(c.rlike("[a-z]"), turn_in(97, 26)).when(c.rlike("[A-Z]"), turn_in(65, 26)).otherwise(c)

        return F.when(F.length(one) == 0, one).otherwise(F.array_join(F.transform(F.filter(F.split(one, ""), lambda c: c != ""), moved), ""))

    def step(state: Column, turn: Column) -> Column:
        # even turns move the left half, odd turns the right one
        left = F.when(turn % 2 == 0, shifted(state["l"], state["r"], turn)).otherwise(state["l"])
        right = F.when(turn % 2 == 1, shifted(state["r"], state["l"], turn)).otherwise(state["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, key: str, what: str, left: int, right: int) -> Column:
    """A number of 0 .. left*right-1, permuted: a Feistel network over its quotient and remainder."""

    def step(state: Column, turn: Column) -> Column:
        a = F.when(turn % 2 == 0, (state["a"] + _number(_digest(key, what, turn, state["b"]))) % left).otherwise(state["a"])
        b = F.when(turn % 2 == 1, (state["b"] + _number(_digest(key, what, turn, state["a"]))) % right).otherwise(state["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.floor(value / right).cast("long").alias("a"), (value % right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * right + s["b"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn digits, counted from the right; digits is a string of digits."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def add(total: Column, x: Column) -> Column:
        return total + x

    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    return F.when((luhn_sum(digits) % 10 == 0) & (F.length(F.regexp_replace(digits, F.substr(digits, F.lit(1), F.lit(1)), "")) > 0), _refill(m, F.concat(body, check))).otherwise(m)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of shape replaced by those of `digits` in turn; separators stay."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(state["s"], F.when(is_digit, F.substr(digits, state["i"], F.lit(1))).otherwise(c)).alias("s"), (state["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), put, lambda s: s["s"])


def _ip(m: Column, key: str) -> Column:
    part = F.split(m, r"\.")
    octet = lambda i: F.element_at(part, i).cast("long")
    number = ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)
    new = permute_number(number, key, "ip", 65536, 65536)
    out = F.concat_ws(".", *(F.pmod(F.floor(new / (256**k)), F.lit(256)).cast("long").cast("string") for k in (3, 2, 1, 0)))
    return F.when((octet(1) <= 255) & (octet(2) <= 255) & (octet(3) <= 255) & (octet(4) <= 255), out).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Valid dates move within their 400-year cycle of 146,097 = 189 x 773 days."""
    iso = F.when(m.rlike("^[0-9]{2}/"), F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)))).when(m.contains("."), F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)))).otherwise(F.regexp_replace(m, "/", "-"))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    number = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long")
    cycle = F.floor(number / 146097).cast("long")
    new = F.date_add(F.lit("1800-01-01").cast("date"), (cycle * 146097 + permute_number(F.pmod(number, F.lit(146097)), key, "date", 189, 773)).cast("int"))
    shown = F.when(m.rlike("^[0-9]{2}/"), F.date_format(new, "MM/dd/yyyy")).when(m.contains("."), F.date_format(new, "dd.MM.yyyy")).when(m.contains("/"), F.date_format(new, "yyyy/MM/dd")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.when(day.isNotNull() & (F.year(day) >= 1400) & (F.year(day) <= 2999), shown).otherwise(m)


def _iban(shown: Column, key: str) -> Column:
    """The country stays; the rest is permuted and the check digits are made anew. Blanks between groups stay where they are."""
    m = F.regexp_replace(shown, " ", "")

    def rest97(text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return F.aggregate(chars, F.lit(0), lambda t, c: F.when(c.rlike("[0-9]"), (t * 10 + F.ascii(c) - 48) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97))

    country, body = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    new = permute_text(body, key, "iban")
    check = F.lpad((98 - rest97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    made = F.concat(country, check, new)
    grouped = F.when(shown.contains(" "), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    return F.when(rest97(F.concat(body, country, F.substr(m, F.lit(3), F.lit(2)))) == 1, grouped).otherwise(shown)


def _ssn(m: Column, key: str) -> Column:
    """Valid numbers move among the valid ones: 898 areas (not 000, 666 and from 900 on), groups 01 to 99, serials 0001 to 9999."""
    part = lambda i, n: F.substr(m, F.lit(i), F.lit(n)).try_cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    new = permute_number(number, key, "ssn", 898 * 99, 9999)
    place = F.floor(new / (99 * 9999)).cast("long") + 1
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    digits = F.concat(pad(place + F.when(place >= 666, 1).otherwise(0), 3), pad(F.pmod(F.floor(new / 9999), F.lit(99)) + 1, 2), pad(F.pmod(new, F.lit(9999)) + 1, 4))
    return F.when(ok, _refill(m, digits)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """A country code stays; all digits after it are permuted."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?", 0)
    national = F.substr(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(national, permute_text(F.regexp_replace(national, "[^0-9]", ""), key, "phone")))


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _key(m: Column, key: str) -> Column:
    front = F.regexp_extract(m, r'^(AKIA|[A-Za-z_]+\s{0,3}[=:]\s{0,3}"?)', 1)
    return F.concat(front, permute_text(F.substr(m, F.length(front) + 1, F.length(m)), key, "key"))


_MAKERS = {"email": _email, "key": _key, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str, kinds: list[str]) -> Column:
    """The pseudonym of one match; a match of no valid kind stays as it is."""
    out = None
    for kind in kinds:
        is_kind = m.rlike(rf"^(?:{PATTERNS[kind]})$")
        out = F.when(is_kind, _MAKERS[kind](m, key)) if out is None else out.when(is_kind, _MAKERS[kind](m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, kinds: list[str] | None = None, text_col: str = "text", out_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """docs with out_col (the text with pseudonyms) and count_col (values that were replaced, an int; 0 for null texts).

    key: the secret of the permutation, which the caller keeps. Input columns named like the new ones give way.
    """
    kinds = kinds or list(PATTERNS)
    old_name, new_name = (next(n for n in (f"{stem}{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for stem in ("__old", "__new"))
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
    text = F.col(f"`{text_col}`")
    found = docs.withColumn(old_name, F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    # a text's different values are permuted once each
    found = found.withColumn(new_name, F.transform(F.col(old_name), lambda m: pseudonym(m, key, kinds)))
    between = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(between, F.col(new_name), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(F.col(old_name), F.col(new_name), lambda a, b: a != b), lambda x: x))
    new_text = F.when(F.size(old_name) > 0, joined).otherwise(text)
    return found.withColumn(count_col, F.when(F.size(old_name) > 0, changed).otherwise(0)).withColumn(out_col, new_text).drop(old_name, new_name)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, how many values were replaced, and the text with pseudonyms."""
    docs = common.columns(common.read(spark, sf_dir, "documents"), doc_id=("doc_id", "long"), text=("text", "string"))
    # a fixed key for this query alone, so that its result can be repeated
    return pseudonymise(docs, "key of the registered query").select("doc_id", F.col("n_replaced").cast("long").alias("n_replaced"), "text")
