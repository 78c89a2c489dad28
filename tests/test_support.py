from pyspark.sql import functions as F

from lithos.operators import support


def value(spark, column):
    v = spark.range(1).select(column.alias("v")).first().v
    return round(float(v), 6)


def test_definition(spark):
    score = lambda t: value(spark, support.definition(F.lit(t).cast("string"), ["moon", "sun"], ["means", "is called"]))
    assert score("moon means light") == 4 + 1 + 3
    assert score("moon" + "x" * 33 + "means") == 4 + 1
    assert score("light means") == score("") == score(None) == 0


def test_concept_crisis(spark):
    score = lambda t: value(spark, support.concept_crisis(F.lit(t).cast("string"), ["orb"], ["is", "known"], ["threat", "end"], F.lit(False), ["storm"]))
    assert score("a threat") == -1.8
    assert score("orb storm") == round(0.8 - 1.0, 6)
    assert score("orb is known threat end") == round(0.8 + 0.56 + 0.68 + 1.9, 6)
    assert score("") == score(None) == 0.0


def test_causality_of_a_profile(spark):
    score = lambda profile: value(spark, support.causality(F.lit("betrayal of Talulah"), ["Talulah"], [], ["betrayal"], ["because"], F.lit(False), F.lit(profile)))
    assert score(False) == round(0.42 + 0.28, 6)
    assert score(True) == -1.0
