import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.vectors import cosine, hash_embedding


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,units", [("", 0), (None, 0), ("two words", 2), ("混合 text と kana", 5), ("a_b c-d", 3), ("한글", 2)])
def test_units(spark, text, units):
    assert one(spark, text, T.units) == units


@pytest.mark.parametrize("text,blank", [(None, True), (" \n", True), ("TODO", True), (" n/a ", True), ("todo list", False)])
def test_blank(spark, text, blank):
    assert one(spark, text, T.is_blank) is blank


def test_trigrams_keep_order_and_need_three_characters(spark):
    assert one(spark, " abcabcd ", T.trigrams) == ["abc", "bca", "cab", "bcd"]
    assert one(spark, "ab", T.trigrams) == []
    assert one(spark, "a\nb😀", T.trigrams) == ["a\nb", "\nb😀"]


def test_axis_signature_ignores_punctuation_and_case(spark):
    assert one(spark, "One, Two…（three） R", T.axis_signature) == "onetwothreer"
    assert one(spark, "rq R", lambda c: T.axis_signature(c, True)) == "r"


def test_code_and_sections(spark):
    assert one(spark, "a\n  ...\n\n # ...\n b ", T.normalised_code) == "a\nb"
    assert one(spark, "intro\n## A\nx\n### sub\n## B\n", T.h2_sections) == ["## A\nx\n### sub", "## B"]


def test_names_and_addresses(spark):
    assert one(spark, "Hello, World!", T.slug) == "hello-world" and one(spark, "¿?", T.slug) == "unnamed"
    for url, want in (("https://github.com/o/n.git", "github.com__o__n"), ("git@gitlab.com:o/n.git", "gitlab.com__o__n"), ("https://GitHub.com/o/n/", "github.com__o__n"), ("http://github.com/o/n", None), ("https://evil.org/o/n", None), ("", None)):
        assert one(spark, url, lambda c: T.repo_id(T.repo_parts(c))) == want
    assert one(spark, "a~/b", T.pointer_token) == "a~0~1b"
    assert one(spark, "x_3_12", T.card_anchor) == "f3-c12" and one(spark, "x", T.card_anchor) is None
    assert one(spark, "One. Two.", T.first_sentence) == "One."
    assert one(spark, ["A b", "a-b", None, "--"], T.clean_tags, "array<string>") == ["a-b"]
    assert one(spark, "x" * 300, T.excerpt) == "x" * 240 + "…"
    assert one(spark, "{bad", lambda c: T.json_flag(c, "$.pending")) is False and one(spark, '{"pending":true}', lambda c: T.json_flag(c, "$.pending")) is True


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    got = row.select(cosine(F.col("a"), F.col("b")).alias("ab"), cosine(F.col("a"), F.col("z")).alias("az"), cosine(F.col("a"), F.col("s")).alias("s")).first()
    assert got.ab == pytest.approx(0.6) and got.az == 0.0 and got.s is None
    digest = hashlib.sha256(b"text").digest()
    raw = [digest[(7 * i) % 32] / 255 - 0.5 for i in range(40)]
    norm = sum(x * x for x in raw) ** 0.5
    assert one(spark, "text", lambda c: hash_embedding(c, 40)) == pytest.approx([x / norm for x in raw])
