import pytest
from pyspark.sql import functions as F

from gritmeter.functions import lines
from gritmeter.functions import scalar as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("\n", 1), ("a\r\nb", 2)])
def test_line_count(spark, text, n):
    assert one(spark, lines.line_count(F.col("c")), c=text) == n
    assert len(one(spark, lines.lines_of(F.col("c")), c=text)) == n


@pytest.mark.parametrize("path,language", [("a/b.PY", "Python"), (".toml", "Unknown"), ("x/Makefile", "Shell"), ("a.hpp", "C++"), ("a/.x.json", "JSON"), ("a", "Unknown")])
def test_language(spark, path, language):
    assert one(spark, S.language(F.col("p")), p=path) == language


@pytest.mark.parametrize("age,most,days", [(14, 30, 7), (30, 30, 10), (90, 30, 30), (730, 30, 30), (730, 180, 180), (365, 30, 30)])
def test_auto_window(spark, age, most, days):
    assert one(spark, S.auto_window(F.col("a"), most // 30), a=age) == days


@pytest.mark.parametrize("days,label", [(7, "7 days"), (13, "13 days"), (14, "2 weeks"), (30, "4 weeks"), (56, "8 weeks"), (60, "2 months"), (180, "6 months")])
def test_window_label(spark, days, label):
    assert one(spark, S.window_label(F.col("d")), d=days) == label


@pytest.mark.parametrize("name,style", [("validate", "snake"), ("a_b", "snake"), ("A", "screaming"), ("A_B2", "screaming"), ("Pool", "pascal"), ("getData", "camel"), ("get_Data", "mixed"), ("_x", "mixed")])
def test_naming(spark, name, style):
    assert one(spark, S.naming_style(F.col("n")), n=name) == style


@pytest.mark.parametrize("size,value", [(0, 0.0), (352_000, 0.43196), (616_000, 1.0), (4_000_000, 1.0)])
def test_multiplier(spark, size, value):
    assert one(spark, S.size_multiplier(F.col("b"), F.lit(None).cast("bigint")), b=size) == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("index,verdict", [(0, "CLEAN"), (20, "CLEAN"), (21, "ACCEPTABLE"), (41, "MESSY"), (61, "SLOPPY"), (81, "DISASTER")])
def test_verdict(spark, index, verdict):
    assert one(spark, S.verdict(F.col("i")), i=index) == verdict


@pytest.mark.parametrize("text,language,n", [("", "Python", 0), ("fn main()", "Rust", 4), ("{}();", "Rust", 5), ("abc_d", "JavaScript", 2)])
def test_content_tokens(spark, text, language, n):
    assert one(spark, S.content_tokens(F.col("c"), F.col("l")), c=text, l=language) == n


def test_groups(spark):
    got = {p: one(spark, S.layer_group(F.col("p")), p=p) for p in ("a.py", "src/a.py", "src/api/r.py", "./src/main.rs", "/abs/x/y.py")}
    assert got == {"a.py": None, "src/a.py": "src", "src/api/r.py": "src/api", "./src/main.rs": "src/main.rs", "/abs/x/y.py": "//abs"}


def test_words(spark):
    assert one(spark, S.has_word(F.col("t"), F.col("w")), t="a foo.b(", w="foo.b")
    assert not one(spark, S.has_word(F.col("t"), F.col("w")), t="a xfoo ", w="foo")


def test_short_numbers(spark):
    assert [one(spark, S.short_number(F.col("n")), n=n) for n in (7, 1500, 2_300_000)] == ["7", "1.5k", "2.3M"]
