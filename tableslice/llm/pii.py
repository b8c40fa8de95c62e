"""Format-preserving pseudonyms for personal data; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What counts as a candidate, by kind (Java regular expressions without capturing groups).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of_country() -> str:
    forms = []
    for n, of in IBAN_LENGTHS.items():
        fours, left = divmod(n - 4, 4)
        forms.append(f"(?:{of.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}"
                     + (f" ?[A-Z0-9]{{{left}}}" if left else ""))
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


IBAN_OF_COUNTRY = _iban_of_country()
DATE = (
    r"(?<![A-Za-z0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}|(?![A-Za-z0-9/-]))"
    r"|(?:(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}"
    r"|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![A-Za-z0-9/-]))"
)
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IP = r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"
PHONE = (
    r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![A-Za-z0-9])"
)
#: As far as a card that starts here can reach, and what tells whether a group ends there.
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}[ -]?[A-Za-z0-9]?"
#: How cards are commonly written; looked for before other groupings.
_CARD_FORM = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
_FIRST_DAY, _DAYS = "1900-01-01", (229, 319)  # 229 * 319 = 73049 days, 1900 to 2099


def _keyed(key: str, *parts: Column) -> Column:
    """A keyed hash below 2^60."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _feistel(a: Column, b: Column, of_a: Column, of_b: Column, key: str, domain: Column) -> Column:
    """A keyed permutation of pairs below ``of_a, of_b``: sides shifted by hashes of each other, in turn."""
    def turn(state: Column, i: Column) -> Column:
        x, y = state["a"], state["b"]
        return F.when(
            i % 2 == 0, F.struct((x + _keyed(key, domain, i, y) % of_a) % of_a, y).cast("struct<a:bigint,b:bigint>")
        ).otherwise(
            F.struct(x, (y + _keyed(key, domain, i, x) % of_b) % of_b).cast("struct<a:bigint,b:bigint>")
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of any length up to 36 as other digits of that length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = (n - left).cast("int")
    a = F.coalesce(F.substring(digits, F.lit(1), left).cast("long"), F.lit(0))
    b = F.substring(digits, left + 1, right).cast("long")
    out = _feistel(a, b, _pow10(left), _pow10(right), key, F.concat(F.lit(kind), n.cast("string")))
    text = lambda v, w: F.lpad(v.cast("string"), w, F.lit("0"))
    return F.transform(F.array(out), lambda s: F.concat(
        F.when(left > 0, text(s["a"], left)).otherwise(""), text(s["b"], right)))[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one by one by ``digits``."""
    places = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        F.substring(m, i, F.lit(1)).rlike("[0-9]"),
        F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i))), F.lit(1)),
    ).otherwise(F.substring(m, i, F.lit(1))))
    return F.array_join(places, "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; places ``doubled`` modulo 2 from the right, counted from 0, are doubled."""
    def add(total: Column, d: Column, i: Column) -> Column:
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(values, F.lit(0), lambda total, v: add(total, v["d"], v["i"]))


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    payload = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    new = F.transform(F.array(payload), lambda p: F.concat(
        p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string")))[0]
    return _luhn_sum(digits, 1) % 10 == 0, _fill(m, new)


def _mod97(chars: Column) -> Column:
    """Value modulo 97 of digits and capital letters, A = 10 to Z = 35."""
    def add(r: Column, i: Column) -> Column:
        c = F.substring(chars, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), add)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    """Country and letters stay, the account's digits are permuted, check digits follow."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    account = F.substring(plain, F.lit(5), F.length(plain) - 4)
    digits = _digits(account)
    moved = _permuted_digits(digits, key, "iban")
    check = lambda d: F.lpad(
        (98 - _mod97(F.concat(_fill(account, d), F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    new = F.transform(F.array(moved), lambda d: F.concat(check(d), d))[0]
    valid = (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & (F.length(digits) > 0)
    return valid & F.length(plain).between(15, 34), _fill(m, new)


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999 are permuted among themselves."""
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - (area > 666).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = _feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))
    text = F.transform(F.array(out), lambda s: F.concat_ws(
        "-",
        F.lpad((F.floor(s["a"] / 99) + 1 + (s["a"] >= 665 * 99).cast("int")).cast("string"), 3, "0"),
        F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0")))[0]
    return valid, text


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    valid = F.forall(part, lambda p: p <= 255)
    out = _feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    octets = lambda v: (F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return valid, F.transform(F.array(out), lambda s: F.concat_ws(".", *octets(s["a"]), *octets(s["b"])))[0]


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """A day from 1900 to 2099 becomes another, written alike; a/b/year is month first where it can be."""
    month_first = F.substring(m, 1, 2).cast("int") <= 12
    read = F.coalesce(
        F.try_to_timestamp(m, F.lit("yyyy-MM-dd")), F.try_to_timestamp(m, F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(m, F.lit("dd.MM.yyyy")),
        F.when(month_first, F.try_to_timestamp(m, F.lit("MM/dd/yyyy"))).otherwise(
            F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))),
    ).cast("date")
    first = F.lit(_FIRST_DAY).cast("date")
    day = F.datediff(read, first)
    a, b = _DAYS
    out = _feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, F.lit("date"))
    def write(s: Column) -> Column:
        to = F.date_add(first, (s["a"] * b + s["b"]).cast("int"))
        return (
            F.when(m.rlike("^[0-9]{4}-"), F.date_format(to, "yyyy-MM-dd"))
            .when(m.rlike("^[0-9]{4}/"), F.date_format(to, "yyyy/MM/dd"))
            .when(F.substring(m, 3, 1) == ".", F.date_format(to, "dd.MM.yyyy"))
            .when(month_first, F.date_format(to, "MM/dd/yyyy")).otherwise(F.date_format(to, "dd/MM/yyyy"))
        )
    return read.isNotNull(), F.transform(F.array(out), write)[0]


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    """The country code stays, the other digits are permuted."""
    country = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[^0-9]", 1))
    digits = _digits(m)
    rest = F.substring(digits, country + 1, F.length(digits))
    moved = _permuted_digits(rest, key, "phone")
    valid = F.length(digits).between(9, 15) & (F.length(rest) >= 7)
    return valid, _fill(m, F.concat(F.substring(digits, F.lit(1), country), moved))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    """Letters and digits before the @ follow from a keyed hash of the whole address; no inverse."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    at = F.instr(m, "@")

    def place(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        h = F.conv(F.substring(digest, (i - 1) % 31 * 2 + 1, F.lit(3)), 16, 10).cast("int")
        return F.when(c.rlike("[0-9]"), (h % 10).cast("string")).when(
            c.rlike("[A-Za-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), h % 26 + 1, F.lit(1))
        ).otherwise(c)

    local = F.array_join(F.transform(F.sequence(F.lit(1), at - 1), place), "")
    return F.lit(True), F.concat(local, F.substring(m, at, F.length(m)))


def _whole(w: Column) -> Column:
    return F.array(w)


def _lengths(of: str, most: int, least: int) -> Callable[[Column], Column]:
    """Beginnings of a candidate with ``most`` to ``least`` characters ``of`` that end with a group, longest first."""
    each = [rf"^{of}(?:[ -]?{of}){{{n - 1}}}(?![A-Za-z0-9])" for n in range(most, least - 1, -1)]
    return lambda w: F.filter(F.array(*[F.regexp_extract(w, e, 0) for e in each]), lambda t: t != "")


def _common_cards(w: Column) -> Column:
    return F.filter(_lengths("[0-9]", 19, 13)(w), lambda t: t.rlike(_CARD_FORM))


def _phone_lengths(w: Column) -> Column:
    return F.array(w, F.regexp_extract(w, r"^(?:[^0-9]*[0-9]){9,15}(?![0-9])", 0))


#: In this order: candidate, what of it may be the value (best first), check and pseudonym.
KINDS = (
    (EMAIL, _whole, _email), (IBAN_OF_COUNTRY, _whole, _iban), (IBAN, _lengths("[A-Z0-9]", 34, 15), _iban),
    (DATE, _whole, _date), (SSN, _whole, _ssn), (IP, _whole, _ip), (PHONE, _phone_lengths, _phone),
    (CARD, _common_cards, _card), (CARD, _lengths("[0-9]", 19, 13), _card),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _mark(kind: int) -> str:
    """A character that stands for a value of this kind while the others are looked for."""
    return chr(0xE000 + kind)


def _taken_out(text: Column, kind: int, key: str) -> Column:
    """``t, new``: the text with a mark for each valid value of the kind, and the values' pseudonyms in order.

    Candidates are looked for at every place, so one that fails hides none that
    starts inside it.  Of values that overlap the first is taken.  A mark that
    was in the text stands for itself.
    """
    pattern, parts_of, make = KINDS[kind]
    mark = _mark(kind)
    place = f"(?=({pattern}|{mark}))"

    def best(w: Column) -> Column:
        """Characters of the value at the start of a candidate, 0 for none."""
        good = F.filter(parts_of(w), lambda t: (t != "") & make(t, key)[0])
        return F.when(w == mark, 1).otherwise(F.coalesce(F.length(F.get(good, F.lit(0))), F.lit(0)))

    spans = "array<struct<at:int,n:int>>"
    state = f"struct<at:int,upto:int,found:{spans}>"

    def chosen(text: Column) -> Column:
        lengths = F.transform(F.split(text, place, -1), F.length)
        sizes = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(text, F.lit(place), 1), best))
        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("upto"), F.array().cast(spans).alias("found")).cast(state)
        steps = F.zip_with(lengths, sizes, lambda length, n: F.struct(length.alias("length"), n.alias("n")))

        def step(s: Column, c: Column) -> Column:
            take = (c["n"] > 0) & (s["at"] >= s["upto"])
            return F.struct(
                (s["at"] + c["length"]).alias("at"), F.when(take, s["at"] + c["n"]).otherwise(s["upto"]).alias("upto"),
                F.when(take, F.concat(s["found"], F.array(F.struct(s["at"].alias("at"), c["n"].alias("n")))))
                .otherwise(s["found"]).alias("found")).cast(state)

        return F.aggregate(steps, start, step)["found"]

    def written(text: Column, found: Column) -> Column:
        def before(f: Column, i: Column) -> Column:
            # The first character is the blank before the text.
            begin = F.when(i > 0, F.get(found, i - 1)["at"] + F.get(found, i - 1)["n"]).otherwise(2)
            return F.concat(F.substring(text, begin, f["at"] - begin), F.lit(mark))

        last = F.get(found, F.size(found) - 1)
        rest = F.substring(text, F.coalesce(last["at"] + last["n"], F.lit(2)), F.length(text))
        value = lambda f: F.substring(text, f["at"], f["n"])
        return F.struct(
            F.concat(F.array_join(F.transform(found, before), ""), rest).alias("t"),
            F.transform(found, lambda f: F.when(value(f) == mark, mark).otherwise(make(value(f), key)[1])).alias("new"))

    # With a blank before it a text never starts with a place, at which split would give no first part.
    found = _let(F.concat(F.lit(" "), text), lambda t: _let(chosen(t), lambda f: written(t, f)))
    none = F.struct(text.alias("t"), F.array().cast("array<string>").alias("new"))
    return F.when(text.rlike(f"{pattern}|{mark}"), found).otherwise(none)


def _put_back(text: Column, kind: int, new: Column) -> Column:
    return F.array_join(
        F.zip_with(F.split(text, _mark(kind), -1), new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def pseudonymize(docs: DataFrame, key: str = "tableslice", text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all other columns as they are.

    Card numbers (Luhn), IBANs (modulo 97), social security numbers (allowed
    ranges), IPv4 addresses (octets up to 255), dates (1900 to 2099, valid days)
    and phone numbers (9 to 15 digits) are permuted within their kind and format
    by a keyed Feistel network, so results are valid again and equal values stay
    equal across documents.  The part of an e-mail address before the @ follows
    from a keyed hash, letter for letter.  Inside a longer run of digits or groups every start and
    length at a border is tried: 13 to 19 digits of a card, the country's length
    of an IBAN, 9 to 15 digits of a phone number.  What fails its check stays.
    Whole texts are read; null stays null, an empty text stays empty.  A row
    never looks at another, so ties and repeated rows give repeated results.
    """
    old = F.col(f"`{text}`")
    name = "__pii"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    out, rest = docs, F.when(old.rlike("[0-9@]"), old)
    for kind in range(len(KINDS)):  # a step each: nested, they are more than the analyzer resolves
        out = out.withColumn(f"{name}{kind}", _taken_out(rest, kind, key))
        rest = F.col(f"{name}{kind}.t")
    for kind in reversed(range(len(KINDS))):
        rest = _put_back(rest, kind, F.col(f"{name}{kind}.new"))
    return out.withColumn(text, F.when(old.rlike("[0-9@]"), rest).otherwise(old)).select(
        *[f"`{c}`" for c in docs.columns])
