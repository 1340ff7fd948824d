import pytest
from pyspark.sql import functions as F

from caselens.functions.tagging import (
    keyword_tags, line_tags_lenient, line_tags_strict, pattern_tags, tags_from_text, tags_to_text, union_tags)
from caselens.functions.themes import accept_theme, theme_cleaned, theme_unless_generic
from caselens.operators import tags as tag_ops
from tests.test_text import apply


def test_split_tags(spark):
    texts = ["Fraud,  Identity Theft , ,x", "['Fraud', 'Debt']", "", None]
    assert apply(spark, tags_from_text, texts) == [["fraud", "identity theft", "x"], ["fraud", "debt"], [], None]
    raw = apply(spark, lambda c: tags_from_text(c, strip_brackets=False, drop_blank=False), texts)
    assert raw[0] == ["fraud", "identity theft", "", "x"] and raw[1] == ["['fraud'", "'debt']"]


def test_lenient_lines(spark):
    lines = ["1. a, b", "a , ,b", "1.2 mg. x", "", None, "1."]
    assert apply(spark, line_tags_lenient, lines) == [["a", "b"], ["a", "b"], ["2 mg. x"], [], [], []]


def test_strict_lines(spark):
    lines = ["1. a, b", "a, b", "12.x,,y ", "1. one two three four five six", "1. one two three four five six seven",
             "1. ", " 1. a", None, "x 1. a"]
    assert apply(spark, line_tags_strict, lines) == [
        ["a", "b"], [], ["x", "y"], ["one two three four five six"], [], [], [], [], []]


def injected(spark, text, tags, **options):
    df = spark.createDataFrame([(text, tags)], "t string, g array<string>")
    return df.select(keyword_tags("t", "g", **options)).first()[0]


def test_first_word_triggers(spark):
    def first(text, tags=None):
        return injected(spark, text, tags, match="first_word")

    assert first("my CREDITOR called") == ["credit report error"]
    assert first("the debt and the data") == ["data breach", "debt collection"]
    assert first("an unauthorized pull") == ["unauthorized charges", "unauthorized access"]
    assert first("human trafficking") == ["trafficking"]
    # Only the stem itself counts as present, its noun does not.
    assert first("trafficking", ["trafficking"]) == ["trafficking"]
    assert first("fcra", ["FCRA violation"]) == ["FCRA violation"]
    assert first("fraud", ["Fraud"]) == []
    assert first("éfraud defraud") == []
    assert first("nothing") == []


def test_phrases(spark):
    assert injected(spark, "my credit and debt", []) == []
    assert injected(spark, "Debt  Collections and a fraudster", None) == ["fraud", "debt collection"]
    assert injected(spark, "fcra violations", ["FCRA Violation"]) == []


def test_patterns(spark):
    text = ("Under 15 U.S.C. § 1681c-2 and 15 USC 1692g, Section 605B of the FCRA, the fair credit reporting act, "
            "FDCPA and fdcpa, Florida state law, statute of limitations, fcra")
    got = apply(spark, pattern_tags, [text, "none", "FCRAs"])
    assert set(got[0]) == {
        "15 U.S.C. § 1681c-", "15 USC 1692g", "Section 605B of the FCRA", "fair credit reporting act",
        "FDCPA", "fdcpa", "Florida state law", "statute of limitations", "FCRA", "fcra"}
    assert got[1:] == [[], []]


def test_merging(spark):
    df = spark.createDataFrame([("fraud under the FCRA", ["b", "a"]), ("x", None)], "t string, g array<string>")
    merged = tag_ops.add_rule_tags(df, text="t", tags="g", match="phrase").collect()
    assert [r.tags for r in merged] == [["FCRA", "a", "b", "fraud"], []]
    assert df.select(tags_to_text(union_tags("g", "g"))).first()[0] == "a, b"


def test_reply_batches(spark):
    cases = spark.createDataFrame([(1, p, f"c{p}") for p in range(3)], "batch int, pos int, id string")
    replies = spark.createDataFrame([(1, "1. a, b\n2. c")], "batch int, reply string")
    got = tag_ops.parse_reply_lines(cases, replies, batch="batch", pos="pos", reply="reply")
    assert {r.id: r.tags for r in got.collect()} == {"c0": ["a", "b"], "c1": ["c"], "c2": []}


THEMES = [
    # reply, truncated, within range
    ("**Identity Theft**", "Identity Theft", "Identity Theft"),
    ("`Debt`_ collection\nmore", "Debt collection", "Debt collection"),
    (".Hidden", "", ""),
    ("Note: x", "", ""),
    ("Complaints about fees", "", "Complaints about fees"),
    ("one", "one", ""),
    ("a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i j"),
    ("a b c d e f g h i j k", "a b c d e f g", ""),
    ("  two \t words  ", "two words", "two words"),
    ("", "", ""),
    (None, "", ""),
]


def test_themes(spark):
    replies = [t[0] for t in THEMES]
    assert apply(spark, theme_cleaned, replies) == [t[1] for t in THEMES]
    assert apply(spark, lambda c: theme_cleaned(c, "range"), replies) == [t[2] for t in THEMES]
    assert apply(spark, theme_unless_generic, ["Issue", " Dispute ", "Dispute fees"]) == ["", "", "Dispute fees"]
    with pytest.raises(ValueError):
        theme_cleaned(F.lit("x"), "other")


def test_worker_side_themes_agree():
    for reply, truncated, ranged in THEMES:
        assert accept_theme()(reply) == truncated
        assert accept_theme("range")(reply) == ranged
    assert accept_theme()("Issue.") == ""
