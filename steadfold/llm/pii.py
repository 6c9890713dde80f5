"""Personal data under format-preserving Feistel pseudonyms (DataFrame operations only).

What is found and valid - numbers with a right check digit, dates that exist - is replaced by another value of the same
format, by a permutation under a key: equal values get equal pseudonyms in every document, so records stay linked, and
whoever has the key can invert them. Everything is Columns; there is no table of values, and so nothing to shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Sealed

#: What each kind looks like. A text is searched for all of them at once; the first that fits wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Digits of cards by issuer, and letters of an IBAN by country, which a number has that others follow.
ISSUED = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35[0-9]{14,17}|6[0-9]{15,18}|5[06-9][0-9]{11,17})$"
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Code points that no text should have, of which one that a text has not stands around what is valid in it.
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
ROUNDS = 8
#: The days of the years 1 to 9999, counted from the first day of 1900, and how many make a block. Dates are
#: permuted within their block, so that years stay likely; what is left at either end belongs to the block beside it.
FIRST_DAY, LEAST_DAY, MOST_DAY, DAYS = "1900-01-01", -693595, 2958463, 65536
#: Steps that a walk may take. The rarest of the walked, days after the 12th of a month, are three in five of all days.
STEPS = 64


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed a single time however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _draw(key: str, *parts: Column | str) -> Column:
    """A number below 2**60, by key and parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def _shifted(s: Column, digest: Column) -> Column:
    """s with every digit and ASCII letter moved on within its kind, by the digest and its place."""

    def move(c: Column, i: Column) -> Column:
        code, by = F.ascii(c), F.conv(F.substring(F.sha2(F.concat_ws("|", digest, i.cast("string")), 256), 1, 15), 16, 10).cast("long")
        turn = lambda first, n: F.chr((F.lit(first) + (code - first + by) % n).cast("long"))
        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(_letters(s), move), "")


def permuted(s: Column, key: str, kind: str) -> Column:
    """A Feistel network whose halves are those of the string and whose sums are taken letter by letter, so that every
    character stays a digit, a small or a capital letter, or what it is. A permutation of each format."""
    half = (F.char_length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.char_length(s)).alias("b"))

    def moved(mine: Column, r: Column, other: Column) -> Column:
        # the other half is hashed once, however long the string is
        return once(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other, F.lit(key)), 256), lambda digest: _shifted(mine, digest))

    def step(t: Column, r: Column) -> Column:
        return F.struct(F.when(r % 2 == 0, moved(t["a"], r, t["b"])).otherwise(t["a"]).alias("a"), F.when(r % 2 == 0, t["b"]).otherwise(moved(t["b"], r, t["a"])).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: F.concat(t["a"], t["b"]))


def permuted_number(n: Column, half: Column | int, key: str, *kind: Column | str) -> Column:
    """A Feistel network on [0, half * half); half: a number, or a column of longs."""
    half = half if isinstance(half, Column) else F.lit(half).cast("long")
    start = F.struct(F.floor(n / half).alias("a"), F.pmod(n, half).cast("long").alias("b"))

    def step(t: Column, r: Column) -> Column:
        moved = F.pmod(t["a"] + _draw(key, *kind, r, t["b"]), half).cast("long")
        return F.struct(t["b"].alias("a"), moved.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: t["a"] * half + t["b"])


def walked(first: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """step of first, of that, and so on until it is valid: a permutation of what is valid, if step is one of more."""
    state = F.struct(first.alias("x"), F.lit(False).alias("done"))
    on = lambda t, _: F.when(t["done"], t).otherwise(once(step(t["x"]), lambda x: F.struct(x.alias("x"), valid(x).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, on, lambda t: t["x"])


def _refilled(shape: Column, kept: str, letters: Column) -> Column:
    """shape with its characters of the class `kept` replaced, one after the other, by those of letters."""
    place = lambda i: F.char_length(F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{kept}]", ""))
    one = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(shape)), lambda i: F.when(one(i).rlike(f"[{kept}]"), F.substr(letters, place(i), F.lit(1))).otherwise(one(i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit follows."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(_letters(F.reverse(digits)), worth), F.lit(0), lambda s, x: s + x)


def _mod97(letters: Column) -> Column:
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_letters(letters), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    part = lambda i: F.get(parts, F.lit(i)).cast("long")
    whole = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    out = once(permuted_number(whole, 65536, key, "ip"), lambda n: F.concat_ws(".", *[F.shiftrightunsigned(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda p: p.cast("int") < 256), out)


def _date(m: Column, key: str) -> Column:
    """yyyy-MM-dd and dd/MM/yyyy are permutations of all days, MM/dd/yyyy one of the days that cannot be read as dd/MM:
    those after the 12th of a month."""
    first = F.lit(FIRST_DAY).cast("date")

    def moved(form: str, valid: Callable[[Column], Column]) -> Column:
        def of_day(day: Column) -> Column:
            block = F.least(F.greatest(F.floor(day / DAYS), F.lit(LEAST_DAY // DAYS + 1).cast("long")), F.lit((MOST_DAY + 1) // DAYS - 1).cast("long"))
            low = F.when(block == LEAST_DAY // DAYS + 1, F.lit(LEAST_DAY)).otherwise(block * DAYS)
            high = F.when(block == (MOST_DAY + 1) // DAYS - 1, F.lit(MOST_DAY)).otherwise(block * DAYS + (DAYS - 1))

            def within(b: Column) -> Column:
                low, high = b["low"], b["high"]
                half = F.ceil(F.sqrt(high - low + 1))
                there = walked(b["day"] - low, lambda x: permuted_number(x, half, key, "date", low), lambda x: (x <= high - low) & valid(F.date_add(first, (x + low).cast("int"))))
                return F.date_format(F.date_add(first, (there + low).cast("int")), form)

            return once(F.struct(day.cast("long").alias("day"), low.cast("long").alias("low"), high.cast("long").alias("high")), within)

        day = F.datediff(F.try_to_date(m, form), first)
        return F.when(day.between(LEAST_DAY, MOST_DAY), once(day, of_day))

    every = lambda _: F.lit(True)
    return F.when(m.contains("-"), moved("yyyy-MM-dd", every)).otherwise(F.coalesce(moved("dd/MM/yyyy", every), moved("MM/dd/yyyy", lambda d: F.dayofmonth(d) > 12)))


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial, permuted among the numbers that are issued."""
    valid = lambda x: ~F.substr(x, F.lit(1), F.lit(3)).isin("000", "666") & ~x.startswith("9") & (F.substr(x, F.lit(5), F.lit(2)) != "00") & (F.substr(x, F.lit(8), F.lit(4)) != "0000")
    return F.when(valid(m), walked(m, lambda x: permuted(x, key, "ssn"), valid))


def _iban(m: Column, key: str) -> Column:
    def moved(plain: Column) -> Column:
        country, bank = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.char_length(plain))
        right = _mod97(F.concat(bank, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        new = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        return F.when(right, _refilled(m, "A-Z0-9", once(permuted(bank, key, "iban"), new)))

    return once(F.regexp_replace(m, " ", ""), moved)


def _card(m: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.char_length(digits) - 1)
        check = lambda b: ((10 - _luhn(b) % 10) % 10).cast("string")
        return F.when(check(body) == F.substr(digits, F.char_length(digits), F.lit(1)), _refilled(m, "0-9", once(permuted(body, key, "card"), lambda b: F.concat(b, check(b)))))

    return once(F.regexp_replace(m, "[^0-9]", ""), moved)


def _phone(m: Column, key: str) -> Column:
    """The country's digits before the last ten stay; so do numbers of under nine or over fifteen digits."""

    def moved(digits: Column) -> Column:
        stay = F.greatest(F.char_length(digits) - 10, F.lit(0))
        new = F.concat(F.substr(digits, F.lit(1), stay), permuted(F.substr(digits, stay + 1, F.lit(10)), key, "phone"))
        return F.when(F.char_length(digits).between(9, 15), _refilled(m, "0-9", new))

    return once(F.regexp_replace(m, "[^0-9]", ""), moved)


MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """A struct (kind, value) for a match: the first kind that it has the form of and is valid as; null if none."""
    made = []
    for kind, make in MAKERS.items():
        whole = PATTERNS[kind]  # what it looks behind and ahead for is not there, and so does not forbid
        value = make(m, key)
        made.append(F.when(m.rlike(f"^(?:{whole})$"), F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))))
    return F.coalesce(*made)


def _inner(m: Column) -> Column:
    """(start, size) of the first, then longest, run of whole groups in m that is a valid card or IBAN; null if none."""
    alone = lambda i: F.substr(m, i, F.lit(1)).isin(" ", "-", "")
    places = F.sequence(F.lit(1), F.char_length(m))
    starts = F.filter(places, lambda i: ~alone(i) & ((i == 1) | alone(F.greatest(i - 1, F.lit(1)))))
    ends = F.reverse(F.filter(places, lambda i: ~alone(i) & alone(i + 1)))

    def valid(part: Column) -> Column:
        def card(digits: Column) -> Column:
            last = F.char_length(digits)
            return (_luhn(F.substr(digits, F.lit(1), last - 1)) + F.substr(digits, last, F.lit(1)).cast("int")) % 10 == 0

        def iban(plain: Column) -> Column:
            sized = [f"(?:{'|'.join(of.split())})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, of in IBAN_SIZES.items()]
            return F.when(plain.rlike(f"^(?:{'|'.join(sized)})$"), _mod97(F.concat(F.substr(plain, F.lit(5), F.char_length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1).otherwise(F.lit(False))

        of_card = F.when(part.rlike("^[0-9][0-9 -]+$"), once(F.regexp_replace(part, "[^0-9]", ""), lambda d: F.when(d.rlike(ISSUED), card(d)).otherwise(F.lit(False))))
        return F.coalesce(of_card, once(F.regexp_replace(part, " ", ""), iban))

    tried = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda b: b - a >= 12), lambda b: F.struct(a.alias("start"), (b - a + 1).alias("size")))))
    return F.get(F.filter(tried, lambda t: valid(F.substr(m, t["start"], t["size"]))), F.lit(0))


def _separated(text: Column, found: Column, mark: Column, key: str) -> Column:
    """text with mark around valid cards and IBANs that other numbers stand next to, so that a search finds them alone and
    goes on after them. A round separates one in each match; what is left of that match is searched in the next."""
    both = f"^(?:{PATTERNS['card']}|{PATTERNS['iban']})$"

    def cut(m: Column) -> Column:
        whole = F.coalesce(*[F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), MAKERS[k](m, key)) for k in ("iban", "card", "phone")])
        apart = lambda t: F.when(t.isNotNull(), F.concat(F.substr(m, F.lit(1), t["start"] - 1), mark, F.substr(m, t["start"], t["size"]), mark, F.substr(m, t["start"] + t["size"], F.char_length(m))))
        return F.coalesce(F.when(m.rlike(both) & whole.isNull(), once(_inner(m), apart)), m)

    def step(t: Column, _: Column) -> Column:
        def again(x: Column) -> Column:
            pieces = F.zip_with(F.split(x, ANY, -1), F.transform(F.regexp_extract_all(x, F.lit(f"({ANY})"), F.lit(1)), cut), lambda part, m: F.concat(part, F.coalesce(m, F.lit(""))))
            return F.array_join(pieces, "")

        return F.when(t["done"], t).otherwise(once(again(t["text"]), lambda x: F.struct(x.alias("text"), (x == t["text"]).alias("done"))))

    rounds = F.sequence(F.lit(0), F.size(found) + 2)
    return F.when(F.exists(found, lambda m: cut(m) != m), F.aggregate(rounds, F.struct(text.alias("text"), F.lit(False).alias("done")), step, lambda t: t["text"])).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text's personal data under pseudonyms, n_pii, and n_email, n_ip, ... for each kind.

    A null text stays null, without any. What has a form but is not valid (a wrong check digit, a day that does not
    exist) stays as it is. A pseudonym can, with the chance of one in its format's size, be the value itself. The key
    stands in the query's plan: guard the event log as you guard the key. Other columns stay, but for those that are
    named like one that is added.
    """
    sealed = Sealed.of(docs)
    text = sealed[text_col]
    all_of = lambda t: F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))
    mark = F.get(F.filter(F.array(*[F.lit(c) for c in MARKS]), lambda c: ~text.contains(c)), F.lit(0))
    some = sealed.frame.withColumn("found", F.when(text.rlike("[0-9@]"), all_of(text)))
    some = some.withColumn("mark", F.when(F.size("found") > 0, mark))
    apart = F.when(F.col("mark").isNotNull(), _separated(text, F.col("found"), F.col("mark"), key))
    some = some.withColumn("cut", F.explode(F.array(F.coalesce(apart, text))))
    some = some.withColumn("found", F.when(F.col("cut") == text, F.col("found")).otherwise(all_of(F.col("cut"))))
    some = some.withColumn("new", F.explode(F.array(F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))))
    parts = F.split(F.col("cut"), ANY, -1)
    new = F.zip_with(parts, F.zip_with("found", "new", lambda m, p: F.coalesce(p["value"], m)), lambda part, p: F.concat(part, F.coalesce(p, F.lit(""))))
    joined = F.array_join(new, "")
    joined = F.when(F.col("cut") == text, joined).otherwise(F.replace(joined, F.col("mark"), F.lit("")))
    none, zero = F.col("new").isNull(), F.lit(0).cast("long")
    count = lambda f: F.when(none, zero).otherwise(F.coalesce(F.size(F.filter("new", f)), F.lit(0)).cast("long"))
    of_kind = lambda k: lambda p: p["kind"] == k
    added = {"n_pii": count(lambda p: p.isNotNull())} | {f"n_{k}": count(of_kind(k)) for k in MAKERS}
    return some.select(*sealed.back(added, {text_col: F.when(none, text).otherwise(joined)}))
