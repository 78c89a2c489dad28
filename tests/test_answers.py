from pyspark.sql import functions as F

from lithos.operators import answers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(x):
    return F.lit(x).cast("string")


def test_clean_output(spark):
    clean = lambda t, p: value(spark, answers.clean_output(text(t), text(p)))
    assert clean(" Q: why　so\n[ Prompt: 3 t/s ]\n<think>a\nb</think>\n yes \nllama_x: 1\n[end of text] ", "Q: why") == "so\n\nyes"
    assert clean("warning: a\r b\nanswer", None) == "answer"
    assert clean("", "Q") == "" and clean(None, "Q") is None


def test_string_list(spark):
    split = lambda t: value(spark, answers.string_list(text(t), 3))
    assert split("a、 b,a；　c; d") == ["a", "b", "c"]
    assert split("one") == ["one"] and split(" , ") == split("") == split(None) == []


def test_abstains(spark):
    said = lambda a, t: value(spark, answers.abstains(text(a), text(t), ["cannot", "unknown"]))
    assert said("abstain", None) and said("answer", "I cannot say") and not said("answer", "yes") and not said(None, None)


def test_brief(spark):
    assert value(spark, answers.brief(text("a \n b"), 3)) == "a b"
    assert value(spark, answers.brief(text("ab cdef"), 4)) == "ab…"
    assert value(spark, answers.brief(text(None), 4)) == ""


def test_abstain_evidence_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, i int, text string")
    assert answers.abstain_evidence(none, "g", [F.col("i")], "text").count() == 0
