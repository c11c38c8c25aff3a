"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value found in a text is validated, taken apart into digits of some radix (decimal digits,
letters, octets, or the two coordinates of a day in its 400-year cycle), and permuted by a keyed
Feistel network: in each round one half's digits are shifted by a stream that SHA-256 makes of the
key, the kind, the round and the other half.  Each round can be undone, so the network is a
permutation of the format: a valid value becomes another valid value of the same format,
different values stay different, and an equal value gets an equal pseudonym in every document,
however it is spaced there.  Card and bank numbers get fitting check digits.

Only DataFrame expressions run here, row by row: one pattern cuts the text, the matches are
replaced and the pieces joined again.  Nothing is shuffled; texts without a digit or ``@`` pass.

Kinds: ``card`` (13 to 19 digits, Luhn), ``iban`` (mod 97), ``ssn``, ``phone`` (ten digits after an
optional country code, which stays), ``ip`` (octets to 255), ``date`` (real days: year-month-day,
or day and month in either order before the year, with ``/`` or ``.``), ``email`` (the local part;
the domain stays), ``secret`` (32 to 64 hexadecimal digits with both letters and decimals, the letters all
small or all capital; the case stays, and both cases of a value get the same digits).

Edge cases: a null text stays null; what fails validation stays as it is; repeated rows get equal
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "spectraloom demonstration key"

#: Kind, pattern and the characters that may not stand before and after it.
KINDS = {
    # possessive, so that the longest domain takes no stack
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?<![A-Za-z0-9._%+-])", ""),
    "secret": (r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,64}", r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"),
    "date": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}", r"(?<![0-9A-Za-z./-])", r"(?![0-9A-Za-z]|[./-][0-9])"),
    "ip": (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?<![0-9A-Za-z]|[0-9]\.)", r"(?![0-9A-Za-z]|\.[0-9])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])", r"(?![0-9A-Za-z]|-[0-9])"),
    "card": (r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"),
    "phone": (r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+]|[0-9][.-])", r"(?![0-9A-Za-z]|[.-][0-9])"),
}


def _renumbered(pattern: str, first: int) -> str:
    """Back references counted from the group after ``first``."""
    for i in (2, 1):
        pattern = pattern.replace(f"\\{i}", f"\\{first + i}")
    return pattern


def any_pattern() -> str:
    """One pattern for all kinds, the earlier kinds first."""
    parts, groups = [], 0
    for pattern, before, after in KINDS.values():
        parts.append(f"{before}(?:{_renumbered(pattern, groups)}){after}")
        groups += pattern.count("([")
    return "|".join(parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, kind: str, key: str, undo: bool = False) -> Column:
    """Digits of the given radices, permuted as one number; ``undo`` turns the rounds back."""
    sign = F.lit(-1 if undo else 1)
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def network(x: Column) -> Column:
        size, half = x["size"], F.floor(x["size"] / 2).cast("int")

        def round_(state: Column, i: Column) -> Column:
            first = i % 2 == 0
            other = F.when(first, F.slice(state, half + 1, size - half)).otherwise(F.slice(state, F.lit(1), half))

            def moved(halves: Column) -> Column:
                def shifted(digit: Column, j: Column) -> Column:
                    seed = F.concat_ws("|", F.lit(key), F.lit(kind), size, i, j, halves)
                    stream = F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("bigint")
                    shift = F.pmod(digit + sign * stream, F.get(x["radices"], j))
                    return F.when((j < half) == first, shift).otherwise(digit)

                return F.transform(state, shifted)

            return let(F.array_join(other, "."), moved)

        return F.aggregate(rounds, x["values"], round_)

    parts = let(values, lambda v: F.struct(v.alias("values"), F.size(v).alias("size")))
    bound = let(parts, lambda v: F.struct(v["values"].alias("values"), v["size"].alias("size"), radices.alias("radices")))
    return let(bound, network)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _numbers(text: Column) -> Column:
    return F.transform(_characters(text), lambda c: c.cast("bigint"))


def _same(array: Column, radix: int) -> Column:
    return F.transform(array, lambda _: F.lit(radix).cast("bigint"))


def _permuted_digits(digits: Column, kind: str, key: str) -> Column:
    return let(_numbers(digits), lambda n: F.array_join(feistel(n, _same(n, 10), kind, key), ""))


def _only(text: Column, others: str) -> Column:
    return F.regexp_replace(text, others, "")


def _refilled(text: Column, new: Column, wanted: str) -> Column:
    """``text`` with its characters of the class ``wanted`` taken from ``new``, one after another."""

    def refill(value: Column) -> Column:
        def filled(c: Column, j: Column) -> Column:
            n = F.length(_only(F.substring(text, F.lit(1), j + 1), f"[^{wanted}]"))
            return F.when(c.rlike(f"[{wanted}]"), F.substring(value, n, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_characters(text), filled), "")

    return let(new, refill)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, the last digit counted once; ``digits`` is a bound value or a column."""

    def weighed(c: Column, j: Column) -> Column:
        doubled = (F.length(digits) - 1 - j) % 2 == 1
        d = c.cast("bigint")
        return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(_characters(digits), weighed), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _card(text: Column, key: str) -> Column:
    def checked(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        zeroed = F.concat(_permuted_digits(body, "card", key), F.lit("0"))
        whole = let(
            zeroed,
            lambda z: F.concat(
                F.substring(z, F.lit(1), F.length(z) - 1),
                F.pmod(F.lit(10) - luhn_sum(z) % 10, F.lit(10)).cast("string"),
            ),
        )
        return F.when(luhn_sum(digits) % 10 == 0, _refilled(text, whole, "0-9"))

    return let(_only(text, "[^0-9]"), checked)


def _iban_rest(text: Column) -> Column:
    """Remainder by 97 of a bank number with its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    values = F.transform(
        _characters(turned),
        lambda c: F.ascii(c).cast("bigint") - F.when(c.rlike("[0-9]"), 48).otherwise(55),
    )
    return F.aggregate(
        values, F.lit(0).cast("bigint"), lambda a, x: F.when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97)
    )


def _iban(text: Column, key: str) -> Column:
    def checked(bare: Column) -> Column:
        country = F.substring(bare, 1, 2)
        account = _letters(F.substring(bare, F.lit(5), F.length(bare)), "iban", key)
        whole = let(
            account,
            lambda new: F.concat(
                country,
                F.lpad((F.lit(98) - _iban_rest(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0"),
                new,
            ),
        )
        valid = (_iban_rest(bare) == 1) & F.length(bare).between(15, 34)
        return F.when(valid, _refilled(text, whole, "0-9A-Z"))

    return let(F.replace(text, F.lit(" "), F.lit("")), checked)


def _phone(text: Column, key: str) -> Column:
    def local(digits: Column) -> Column:
        kept = F.substring(digits, F.lit(1), F.length(digits) - 10)
        last = F.substring(digits, F.length(digits) - 9, F.lit(10))
        return _refilled(text, F.concat(kept, _permuted_digits(last, "phone", key)), "0-9")

    return let(_only(text, "[^0-9]"), local)


#: Steps of a cycle walk; values that fit are a fifth of all or more, so that this many never all miss.
WALK = 128


def walked(value: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """``step`` of the value, again and again until it fits: a permutation of the values that fit, if ``step`` is one of all."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), step(value), lambda v, _: F.when(fits(v), v).otherwise(step(v)))


def _ssn(text: Column, key: str) -> Column:
    valid = lambda digits: ~digits.rlike("^(?:000|666|9)|^...00|0000$")

    def checked(digits: Column) -> Column:
        return F.when(valid(digits), _refilled(text, walked(digits, lambda d: _permuted_digits(d, "ssn", key), valid), "0-9"))

    return let(_only(text, "[^0-9]"), checked)


def _ip(text: Column, key: str) -> Column:
    def checked(octets: Column) -> Column:
        moved = F.array_join(feistel(octets, _same(octets, 256), "ip", key), ".")
        return F.when(F.forall(octets, lambda x: x < 256), moved)

    return let(F.transform(F.split(text, r"\."), lambda x: x.cast("bigint")), checked)


#: Days of the 400-year calendar cycle, as a product of two radices, and where the cycles begin.
CYCLE = (189, 773)
CYCLE_START = "1600-01-01"


def moved_day(day: Column, key: str) -> Column:
    """Another day of the same 400-year cycle."""
    days = F.datediff(day, F.lit(CYCLE_START).cast("date")).cast("bigint")
    size = CYCLE[0] * CYCLE[1]
    within = F.pmod(days, F.lit(size))
    pair = F.array(F.floor(within / CYCLE[1]), within % CYCLE[1])
    moved = feistel(pair, F.array(*[F.lit(r).cast("bigint") for r in CYCLE]), "date", key)
    total = let(moved, lambda m: F.get(m, F.lit(0)) * CYCLE[1] + F.get(m, F.lit(1))) + (days - within)
    return F.date_add(F.lit(CYCLE_START).cast("date"), total.cast("int"))


def _date(text: Column, key: str) -> Column:
    """The moved day as the text writes it: the same order, marks and numbers of digits.

    A day is moved on until it can be written so, and until it would be read in the same order again.
    """
    parts = F.split(text, "[-/.]")
    mark = F.substring(F.regexp_replace(text, "[0-9]", ""), 1, 1)
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))

    def day(year: Column, month: Column, day_: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day_, 2, "0")).try_cast("date")

    def short(number: Column, written: Column) -> Column:
        return (F.length(written) > 1) | (number < 10)

    def fits(at: Column, order: Column) -> Column:
        d, m = F.dayofmonth(at), F.month(at)
        return (
            F.when(order == "iso", True)
            .when(order == "dmy", short(d, a) & short(m, b))
            # days up to 12 would be read as months
            .otherwise(short(m, a) & short(d, b) & (d > 12))
        )

    def written(at: Column, order: Column) -> Column:
        year = F.lpad(F.year(at).cast("string"), 4, "0")
        d, m = F.dayofmonth(at).cast("string"), F.month(at).cast("string")
        padded = lambda v, like: F.lpad(v, F.length(like), F.lit("0"))
        return (
            F.when(order == "iso", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
            .when(order == "dmy", F.concat(padded(d, a), mark, padded(m, b), mark, year))
            .otherwise(F.concat(padded(m, a), mark, padded(d, b), mark, year))
        )

    iso, dmy, mdy = day(a, b, c), day(c, b, a), day(c, a, b)
    order = F.when(mark == "-", "iso").when(dmy.isNotNull(), "dmy").otherwise("mdy")
    given = F.when(mark == "-", iso).otherwise(F.coalesce(dmy, mdy))
    moved = lambda x: walked(x["day"], lambda v: moved_day(v, key), lambda v: fits(v, x["order"]))
    return let(
        F.struct(given.alias("day"), order.alias("order")),
        lambda x: F.when(x["day"].isNotNull(), let(moved(x), lambda v: written(v, x["order"]))),
    )


def _letters(text: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """Digits, small and capital letters, each moved within its class; other characters stay."""
    code = lambda c: F.ascii(c).cast("bigint")
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)

    def moved(chars: Column) -> Column:
        if hexadecimal:
            values = F.transform(chars, lambda c: code(c) - F.when(c.rlike("[0-9]"), 48).otherwise(87))
            return F.array_join(F.transform(feistel(values, _same(chars, 16), kind, key), lambda v: F.lower(F.hex(v))), "")
        values = F.transform(chars, lambda c: F.coalesce(code(c) - base(c), F.lit(0)).cast("bigint"))
        new = feistel(values, F.transform(chars, lambda c: radix(c).cast("bigint")), kind, key)
        return F.array_join(F.zip_with(chars, new, lambda c, v: F.coalesce(F.char(base(c) + v), c)), "")

    return let(_characters(text), moved)


def _email(text: Column, key: str) -> Column:
    local = F.substring_index(text, "@", 1)
    return F.concat(_letters(local, "email", key), F.substring(text, F.length(local) + 1, F.length(text)))


def _secret(text: Column, key: str) -> Column:
    cased = lambda new: F.when(text.rlike("[A-F]"), F.upper(new)).otherwise(new)
    return let(_letters(F.lower(text), "secret", key, hexadecimal=True), cased)


BY_KIND = {
    "email": _email,
    "secret": _secret,
    "iban": _iban,
    "date": _date,
    "ip": _ip,
    "ssn": _ssn,
    "card": _card,
    "phone": _phone,
}


def kind_of(match: Column) -> Column:
    kind = None
    for name, (pattern, _, _) in KINDS.items():
        fits = match.rlike(f"^(?:{pattern})$")
        kind = F.when(fits, name) if kind is None else kind.when(fits, name)
    return kind


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a found value, null if it isn't valid."""
    made = None
    for name, make in BY_KIND.items():
        made = F.when(kind == name, make(match, key)) if made is None else made.when(kind == name, make(match, key))
    return made


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id``, the ``text`` with pseudonyms, and how many values of each kind were replaced."""
    pattern = any_pattern()
    text = F.col("text")
    none = F.array().cast("array<struct<old:string,kind:string,new:string>>")
    looked = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    cut = docs.select("doc_id", "text", looked.alias("found"))
    named = cut.select(
        "doc_id", "text", F.transform("found", lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind"))).alias("found")
    )
    made = named.select(
        "doc_id",
        "text",
        F.coalesce(
            F.transform(
                "found", lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key).alias("new"))
            ),
            none,
        ).alias("found"),
    )
    between = F.split(text, pattern)
    after = F.concat(F.transform("found", lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, after, lambda a, b: F.concat(a, b)), "")
    changed = lambda name: F.size(F.filter("found", lambda x: (x["kind"] == name) & x["new"].isNotNull()))
    return made.select(
        "doc_id",
        F.when(F.size("found") > 0, whole).otherwise(text).alias("text"),
        *[changed(name).cast("bigint").alias(f"n_{name}") for name in KINDS],
    )
