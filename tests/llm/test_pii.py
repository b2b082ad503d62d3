"""Pseudonyms: permutations, formats, checks, links and exact round trips."""

import datetime as dt
import ipaddress
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendspark.llm import pii
from trendspark.llm.common import table

KEY = b"k"
DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
VALID = [
    "1999-02-28", "5.3.2020", "05.03.2020", "25.12.2020", "3/5/2020", "13/5/2020", "12/31/1999", "01/15/2020", "219-09-9999", "4111 1111 1111 1111", "4111111111111111", "5500-0055-5555-5559",
    "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "10.0.0.255", "+1 (017) 555-7713", "(555) 123-4567", "+44 20 7946 0958", "a.b+c34@mail.example.org", "é.ß9@x.fr", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
]
INVALID = ["4111 1111 1111 1112", "9807915762804491", "1999-02-30", "2150-01-01", "999.1.1.1", "1.2.3.4.5", "000-12-3456", "666-12-3456", "DE88 3704 0044 0532 0130 00", "31/31/2020", "version 2.0.", "x4111111111111111"]
shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    image = [pii.permute(x, size, KEY, "t") for x in range(size)]
    assert sorted(image) == list(range(size)) and [pii.permute(y, size, KEY, "t", True) for y in image] == list(range(size))
    odd = [x for x in range(size) if x % 3 == 1]
    assert sorted(pii.permute(x, size, KEY, "t", allowed=lambda y: y % 3 == 1) for x in odd) == odd


def test_keys_and_kinds_differ():
    images = {tuple(pii.permute(x, 10_000, k, t) for x in range(20)) for k in (b"a", b"b") for t in ("t", "u")}
    assert len(images) == 4


@pytest.mark.parametrize("value", VALID)
def test_valid_values_change_and_come_back(value):
    new, counts = pii.replace_values(f"x {value} y", KEY)
    assert sum(counts.values()) == 1 and value not in new and pii.replace_values(new, KEY, True)[0] == f"x {value} y"
    if not re.search("[a-f0-9]{40}|^[0-9.]+$", value) and "@" not in value:
        assert shape(new) == shape(f"x {value} y")
    assert pii.replace_values(f"other {value}.", KEY)[0] == f"other {new[2:-2]}."  # equal values stay linked


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert pii.replace_values(f"x {value} y", KEY) == (f"x {value} y", {})


CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("text, value", [
    (f"card {CARD} 123", CARD), ("card 4111111111111111 123", "4111111111111111"), ("no. 12 4111111111111111", "4111111111111111"), (f"12 {CARD}", CARD),
    (f"{CARD} 12/27", CARD), (f"7 8 {CARD} 5", CARD), (f"AB12 {CARD}", CARD), ("GB82 WEST 1234 5698 7654 32 USED", "GB82 WEST 1234 5698 7654 32"),
    ("GB33 BUKB 2020 1555 5555 55 2024 PAID", "GB33 BUKB 2020 1555 5555 55"), ("BE68 5390 0754 7034 PAID", "BE68 5390 0754 7034"),
])
def test_numbers_beside_short_groups(text, value):
    for i in range(40):
        key = b"k%d" % i
        new, counts = pii.replace_values(text, key)
        assert value not in new and sum(counts.values()) == 1 and new.replace(value, "") != text
        assert pii.replace_values(new, key, True) == (text, counts)


def test_same_day_in_other_formats_stays_linked():
    new = pii.replace_values("2020-03-05 5.3.2020", KEY)[0]
    assert pii.replace_values(new, KEY, True)[0] == "2020-03-05 5.3.2020"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=list("0123456789./- ()+@ab:\n"), max_size=60))
def test_round_trip_of_any_text(text):
    new, counts = pii.replace_values(text, KEY)
    back, again = pii.replace_values(new, KEY, True)
    if counts == again:
        assert back == text


def test_tables(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    out = pii.query(spark, DATA)
    back = pii.pseudonymise(out.select("doc_id", "text"), pii.QUERY_KEY, inverse=True).select("doc_id", F.col("text").alias("back"))
    joined = docs.join(back, "doc_id").where("text <> back")
    assert out.count() == docs.count() and joined.count() == 0
    assert out.select(F.sum(sum(F.col(f"n_{k}") for k in pii.KINDS))).first()[0] > 0


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a@b.org " * 20_000, 3), (3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_email int").withColumn("n_words", F.lit("x"))
    out = pii.pseudonymise(df, KEY)
    assert out.count() == 5 and out.columns[:3] == ["doc_id", "text", "n_words"] and out.where("text is null").count() == 2
    assert out.where("doc_id = 2").first().n_email == 20_000 and pii.pseudonymise(df.limit(0), KEY).count() == 0


@pytest.mark.parametrize("value", ["иван@mail.ru", "王小明@example.cn", "김철수@example.kr", "Ωμέγα.7@example.gr", "éva+x@example.fr"])
def test_other_scripts(value):
    new, counts = pii.replace_values(f"x {value} y", KEY)
    assert counts == {"email": 1} and value not in new and len(new) == len(value) + 4 and new.endswith(value[value.index("@"):] + " y")
    assert pii.replace_values(new, KEY, True)[0] == f"x {value} y"
    assert all(pii._class_of(c) == pii._class_of(d) for c, d in zip(value, new[2:]))


def test_nothing_replaced_counts_nothing():
    assert pii.replace_values("x __@mail.ru y", KEY) == ("x __@mail.ru y", {})


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_finder(text):
    """(start, end) of values that stand between spaces, found by means other than the operator's."""
    at = 0
    for token in re.split(r"(\s+)", text):
        word = token.rstrip(".,;:!?)")
        start = at
        at += len(token)
        kinds = [lambda w: w.count(".") == 3 and w.isascii() and ipaddress.IPv4Address(w), lambda w: len(w) == 10 and w.isascii() and dt.date.fromisoformat(w).year in range(1900, 2100), lambda w: w.isascii() and w.isdigit() and 13 <= len(w) <= 19 and luhn(w)]
        for kind in kinds:
            try:
                if kind(word):
                    yield start, start + len(word)
            except ValueError:
                pass
        if word.isascii() and word.count("@") == 1 and all(re.fullmatch(r"[\w.-]+", x) for x in word.split("@")) and re.search(r"\w$", word.split("@")[0]) and re.search(r"\.[a-zA-Z]{2,}$", word):
            yield start, start + word.index("@")


def test_query_against_a_plain_finder(spark):
    """All values that a plain finder sees have changed in place, and the other characters outside digits and letters have not moved."""
    old = {r.doc_id: r.text or "" for r in table(spark, LARGER, "documents").collect()}
    new = {r.doc_id: r.text or "" for r in pii.query(spark, LARGER).collect()}
    seen = 0
    for d, t in old.items():
        if re.search(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", t):
            continue  # network addresses change their length, and what follows its place
        assert len(new[d]) == len(t)
        for a, b in plain_finder(t):
            assert new[d][a:b] != t[a:b], t[a:b]
            seen += 1
        assert all(x == y or (x.isalnum() and y.isalnum()) for x, y in zip(t, new[d]))
    assert seen > 20
