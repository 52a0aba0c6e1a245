from pyspark.sql import functions as F

from tessera.functions import labels


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_blank_and_norm(spark):
    for value in (None, "", "  ", "NaN", "None"):
        assert one(spark, value, labels.is_blank) is True
        assert one(spark, value, labels.norm) == ""
    assert one(spark, "null", labels.is_blank) is False
    assert one(spark, "null", labels.norm) == ""
    assert one(spark, " Unit  Tests-now ", labels.norm) == "unit_tests_now"


def test_the_four_label_sets_differ(spark):
    value = "B b; a,C ;a;nan"
    assert one(spark, value, labels.bench_set) == ["a", "b_b", "c"]
    assert one(spark, value, labels.vote_list) == ["b_b", "a,c", "a"]
    assert one(spark, value, labels.coder_set) == ["B b", "a", "a,C", "nan"]
    assert one(spark, value, labels.icr_label) == "B b;a;a,C;nan"
    assert one(spark, None, labels.icr_label) == "nan"
    assert one(spark, None, labels.bench_set) == []


def test_gates(spark):
    assert [one(spark, v, labels.gate_value) for v in ("1.0", "JA", " no ", "0", "2", None)] == [1, 1, 0, 0, None, None]
    assert [one(spark, v, labels.numeric_gate) for v in ("1.0", "0.4", "x", None)] == [1, 0, None, None]
    assert [one(spark, v, labels.coded_gate) for v in ("1", "0", "2", "x", None)] == [1, 0, 0, 1, 1]


def test_names_and_texts(spark):
    assert one(spark, "Mistral-Large-3", labels.model_family) == "mistral"
    assert one(spark, "Org/Model-3.5 (x)", labels.model_slug) == "org_model_3_5_x"
    assert one(spark, "abcdef", lambda c: labels.clipped(c, 4)) == "abcd… [+2 chars clipped]"
    assert one(spark, "Universit¨at caf´e", labels.joined_accents) == "Universität café"
