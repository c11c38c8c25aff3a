from __future__ import annotations

import datetime
import hashlib
import re

import pytest
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401
from pyspark.sql import functions as F

from spectraloom.llm import pseudonyms as P


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_feistel(values, radices, kind, key=P.KEY):
    values, half = list(values), len(values) // 2
    for i in range(P.ROUNDS):
        first = i % 2 == 0
        other = ".".join(map(str, values[half:] if first else values[:half]))
        for j in range(len(values)):
            if (j < half) == first:
                seed = "|".join([key, kind, str(len(values)), str(i), str(j), other])
                values[j] = (values[j] + int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16)) % radices[j]
    return values


def pseudonym_of(spark, values):
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, text string")
    return [r["text"] for r in sorted(rows_of(P.pseudonymised(docs)), key=lambda r: r["doc_id"])]


def test_network_matches_plain_python_and_turns_back(spark):
    rows = [([1, 2, 3, 4, 5], [10] * 5), ([7], [10]), ([], []), ([0, 255, 3, 9], [256] * 4), ([188, 772], [189, 773]), ([25, 0, 9], [26, 1, 10])]
    df = spark.createDataFrame(rows, "v array<bigint>, r array<bigint>")
    df = df.select("v", "r", P.feistel(F.col("v"), F.col("r"), "k", P.KEY).alias("p"))
    df = df.withColumn("back", P.feistel(F.col("p"), F.col("r"), "k", P.KEY, undo=True))
    for r in rows_of(df):
        assert r["p"] == brute_feistel(r["v"], r["r"], "k") and r["back"] == r["v"]


def test_is_a_permutation(spark):
    df = spark.range(5_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d")).filter("length(d) = 4")
    assert df.select(P._permuted_digits(F.col("d"), "x", "key").alias("p")).distinct().count() == df.count()
    days = spark.range(4_000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert days.select(P.moved_day(F.col("d"), "key").alias("p")).distinct().count() == 4_000


def test_cards(spark):
    values = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "378282246310005"]
    a, b, c, bad, amex = pseudonym_of(spark, values)
    assert luhn(a) and a != values[0] and len(a) == 16 and luhn(amex) and len(amex) == 15
    assert b == " ".join(a[i : i + 4] for i in range(0, 16, 4)) and c == b.replace(" ", "-") and bad == values[3]
    body = brute_feistel([int(x) for x in values[0][:-1]], [10] * 15, "card")
    assert a[:-1] == "".join(map(str, body))


def test_phones_addresses_and_numbers(spark):
    values = ["+1 (017) 555-7713", "017-555-7713", "1.2.3.4", "1.2.3.400", "123-45-6789", "000-45-6789", "1.2.3.4.5"]
    p = pseudonym_of(spark, values)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p[0]) and p[0] != values[0]
    assert re.sub(r"\D", "", p[0])[1:] == re.sub(r"\D", "", p[1])
    assert p[2] != values[2] and all(0 <= int(x) < 256 for x in p[2].split(".")) and p[3] == values[3] and p[6] == values[6]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", p[4]) and p[4] != values[4] and p[5] == values[5]


def test_dates(spark):
    values = ["2024-02-29", "29.02.2024", "29/02/2024", "2023-02-29", "02/29/2024", "31.04.2020"]
    p = pseudonym_of(spark, values)
    day = datetime.date.fromisoformat(p[0])
    assert p[0] != values[0] and p[1] == day.strftime("%d.%m.%Y") and p[2] == day.strftime("%d/%m/%Y")
    assert p[3] == values[3] and p[5] == values[5]
    # month first: the next day on the cycle that can't be read the other way round
    start = datetime.date(1600, 1, 1)
    while day.day <= 12:
        at = (day - start).days % (189 * 773)
        a, b = brute_feistel(divmod(at, 773), [189, 773], "date")
        day += datetime.timedelta(days=a * 773 + b - at)
    assert p[4] == day.strftime("%m/%d/%Y")


def test_mail_secrets_and_bank_numbers(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    values = ["und.34@mail7.example.com", secret, "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]
    p = pseudonym_of(spark, values)
    assert re.fullmatch(r"[a-z]{3}\.\d\d@mail7\.example\.com", p[0]) and p[0] != values[0]
    assert re.fullmatch("[0-9a-f]{40}", p[1]) and p[1] != secret
    number = int("".join(str(int(c, 36)) for c in p[2][4:] + p[2][:4]))
    assert number % 97 == 1 and p[2] != values[2] and p[3].replace(" ", "") == p[2] and p[4] == values[4]


def test_text_around_stays_and_values_stay_linked(spark, docs_of):
    rows = [
        (1, "Call +1 (017) 555-7713 or 4111111111111111, 4111111111111111; é 97.51.17.173."),
        (2, "4111111111111111\n"),
        (2, "4111111111111111\n"),
        (3, None),
        (4, ""),
        (None, "no digits at all @"),
        (5, "7536784127813050 4845168114407329 " * 300),
        (6, "1234567 and 12 and 3.14 and v1.2.3"),
    ]
    got = {}
    for r in rows_of(P.pseudonymised(docs_of(rows, "1 AS found"))):
        got.setdefault(r["doc_id"], []).append(r)
    card = got[2][0]["text"].strip()
    assert len(got[2]) == 2 and got[2][0] == got[2][1] and got[1][0]["text"].count(card) == 2
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \d{16}, \d{16}; é \d+\.\d+\.\d+\.\d+\.", got[1][0]["text"])
    assert got[1][0]["n_card"] == 2 and got[1][0]["n_phone"] == 1 and got[1][0]["n_ip"] == 1
    assert got[3][0]["text"] is None and got[4][0]["text"] == "" and got[None][0]["text"] == rows[5][1]
    assert got[6][0]["text"] == rows[7][1] and len(got[5][0]["text"]) == len(rows[6][1])
    assert P.pseudonymised(docs_of([])).count() == 0


@pytest.mark.parametrize("kind", ["card", "phone", "ip", "email", "secret"])
def test_planted_values_are_gone(spark, docs_of, sample_texts, kind):
    found = rows_of(P.pseudonymised(docs_of(sample_texts)))
    before, after = dict(sample_texts), {r["doc_id"]: r["text"] for r in found}
    pattern, left, right = P.KINDS[kind]
    for doc_id, text in before.items():
        for m in re.finditer(left.replace("|[0-9]\\.", "").replace("|[0-9][.-]", "") + f"(?:{pattern})" + right, text):
            if kind != "card" or luhn(re.sub(r"\D", "", m[0])):
                assert m[0] not in after[doc_id]
    assert all(after[d] == t for d, t in before.items() if not re.search("[0-9@]", t))


def test_capital_secrets(spark, docs_of):
    secret = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    values = [f'TOKEN = "{secret}"', secret.lower(), secret[:31], "A" * 40, "1" * 40, secret + "x"]
    p = pseudonym_of(spark, values)
    new = p[0][9:-1]
    assert re.fullmatch("[0-9A-F]{40}", new) and new != secret and p[0] == f'TOKEN = "{new}"'
    assert p[1] == new.lower() and p[2:] == values[2:]
    assert P.pseudonymised(docs_of(values[:2])).agg(F.sum("n_secret")).first()[0] == 2


def test_dates_stay_distinct_and_keep_their_shape(spark):
    """All ways to write four years of days, both orders: no two share a pseudonym, and every one is read in the same order."""
    first = datetime.date(2000, 1, 1)
    values = set()
    for i in range(1_461):
        d = first + datetime.timedelta(days=i)
        for x, y in ((d.day, d.month), (d.month, d.day)):
            values |= {f"{p}/{q}/{d.year}" for p in {str(x), f"{x:02d}"} for q in {str(y), f"{y:02d}"}}
    values = sorted(values)
    made = pseudonym_of(spark, values)
    assert len(set(made)) == len(values) > 4_500
    shape = lambda v: [len(p) for p in v.split("/")]

    def order(v):
        x, y, year = map(int, v.split("/"))
        for kind, (m, d) in (("dmy", (y, x)), ("mdy", (x, y))):
            try:
                datetime.date(year, m, d)
                return kind
            except ValueError:
                pass
        return None

    assert all(shape(a) == shape(b) and order(a) == order(b) is not None for a, b in zip(values, made))
    assert sum(a == b for a, b in zip(values, made)) < 10


def test_valid_numbers_stay_valid(spark):
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in range(1, 100, 7) for s in range(1, 10_000, 97)]
    made = pseudonym_of(spark, values)
    bad = re.compile(r"^(?:000|666|9)|-00-|-0000$")
    assert len(set(made)) == len(values) and not any(map(bad.search, made))


def test_long_odd_texts(spark):
    """Long domains, local parts and runs of digits take neither the stack nor long."""
    values = ["x@a" + ".a" * 200_000, "x" * 5_000 + "@example.org", "1" * 300_000, "1.1" * 100_000, ("AB12 " * 60_000), "a@" * 100_000]
    made = pseudonym_of(spark, values)
    assert [len(v) for v in made] == [len(v) for v in values] and made[0][1:] == values[0][1:]
