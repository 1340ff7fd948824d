from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.dates import month_label, month_of, parse_date
from caselens.functions.places import city_state, zip5
from caselens.functions.text import (
    collapse_ws, is_blank, mask_tokens_removed, masks_removed_anywhere, nonempty_or, text_after_last, trim_ws, words)
from caselens.operators import clean
import pytest
import datetime


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select("i", "t").select(fn(F.col("t")), "i").orderBy("i").collect()]


def test_white_space_is_unicode(spark):
    texts = ["  a b \t\n", "", None, "　"]
    assert apply(spark, trim_ws, texts) == ["a b", "", None, ""]
    assert apply(spark, collapse_ws, ["a \t b c d\ne"]) == ["a b c d e"]
    assert apply(spark, words, [" a  b\n", " "]) == [["a", "b"], []]
    assert apply(spark, is_blank, texts + ["x"]) == [False, True, True, True, False]


def test_whole_word_masks_in_any_case(spark):
    texts = ["XXXX paid xxx on Xx", "axxb XXY X", "XX/XX/2020 and XX", "  a   b\t c ", "éXX XX", None, "XX"]
    assert apply(spark, mask_tokens_removed, texts) == [
        "paid on", "axxb XXY X", "//2020 and", "a b\t c", "éXX", None, ""]


def test_masks_anywhere_in_upper_case(spark):
    texts = ["On XX/XX/XXXX I paid", "aXXb xx X", "XX/XX/2020", "a \n\t b c", None, "XXXX XX"]
    assert apply(spark, masks_removed_anywhere, texts) == [
        "On I paid", "ab xx X", "//2020", "a b c", None, ""]


def test_text_that_is_all_mask_stays(spark):
    df = spark.createDataFrame([(1, "XXXX"), (2, "a XX"), (3, None)], "i int, t string")
    got = {r.i: r.t for r in clean.remove_masks_anywhere(df, text="t").collect()}
    assert got == {1: "XXXX", 2: "a", 3: None}
    assert {r.i: r.t for r in clean.remove_masks_anywhere(df, text="t", keep_original_if_empty=False).collect()}[1] == ""
    assert [r[0] for r in df.where("i = 1").select(nonempty_or(F.lit(""), "t")).collect()] == ["XXXX"]


def test_text_after_last_marker(spark):
    texts = ["prompt Tags: 1 Tags: a, b ", "no marker ", "Tags:"]
    assert apply(spark, lambda c: text_after_last(c, "Tags:"), texts) == ["a, b", "no marker", ""]


def test_postal_codes(spark):
    assert apply(spark, zip5, ["139", "02139", "02139-1234", "606XX", None, " 7 "]) == [
        "00139", "02139", "02139-1234", "606XX", None, "00007"]
    df = spark.createDataFrame([("A", "X"), ("A", None)], "c string, s string")
    assert [r[0] for r in df.select(city_state("c", "s")).collect()] == ["A, X", None]


def test_dates(spark):
    texts = ["2024-03-31", "no date", None]
    assert apply(spark, lambda c: month_label(parse_date(c)), texts) == ["2024-03", None, None]
    assert apply(spark, lambda c: month_of(parse_date(c)), texts)[0] == datetime.date(2024, 3, 1)
    with pytest.raises(Exception):
        apply(spark, lambda c: parse_date(c, strict=True), texts)


def test_personal_data(spark):
    text = 'mail a.b@c.org, token = "abcdef123456", card 1234567890123456, call +1 (152) 555-8590 or 555-123-4567.'
    row = clean.scrub_pii(spark.createDataFrame([(text,)], "t string"), text="t").first()
    assert row.t == "mail [EMAIL], [SECRET], card [NUMBER], call [PHONE] or [PHONE]."
    assert (row.n_email, row.n_secret, row.n_long_number, row.n_phone) == (1, 1, 1, 2)


def test_missing_values_and_stamps(spark):
    df = spark.createDataFrame([("NA", "x"), ("none", ""), ("a", "null")], "a string, b string")
    assert [tuple(r) for r in clean.restore_nulls(df).collect()] == [(None, "x"), ("none", None), ("a", None)]
    assert clean.with_text(spark.createDataFrame([("",), (None,)], "t string"), text="t").count() == 1
    assert clean.stamp(df, snapshot_date="2024-12-31").first().snapshot_date == "2024-12-31"
    assert clean.equals_all(df, a="a", b="null").count() == 1


def test_fixed_tables():
    assert len(rules.STATE_NAMES) == 51 and len(rules.KEYWORDS) == 22 and len(rules.STATUTE_PATTERNS) == 8
