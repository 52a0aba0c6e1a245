"""A text that several sources hold is lost to no mix that uses one of them."""

from pyspark.sql import functions as F

from tessera.llm import mixing


def test_copies_stand_in_each_mix_among_its_own_sources(spark):
    rows = [(i, f"shared text {i}", "old") for i in range(40)] + [(100 + i, f"shared text {i}", "mirror") for i in range(40)] + [(200 + i, f"own text {i}", "mirror") for i in range(5)]
    targets = [(1, "mirror", 1.0, 2, 10_000), (2, "mirror", 0.5, 2, 20_000), (2, "old", 0.5, 3, 20_000), (3, "mirror", 0.5, 1, 20_000), (3, "old", 0.5, 0, 20_000), (4, "mirror", 1.0, 1, 10_000), (4, "old", None, 1, 10_000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = spark.createDataFrame(targets, "mix_id long, source string, target_weight double, max_repeats int, budget_tokens long")
    drawn = mixing.mix_sources(documents, wanted, slices=4)[0].join(documents.select("doc_id", "text"), "doc_id")
    uses = {(r["mix_id"], r["text"]): (r["n"], r["sources"]) for r in drawn.groupBy("mix_id", "text").agg(F.count("*").alias("n"), F.array_join(F.collect_set("source"), ",").alias("sources")).collect()}
    for mix, times in ((1, 2), (3, 1), (4, 1)):
        assert all(uses.get((mix, f"shared text {i}")) == (times, "mirror") for i in range(40)), mix
        assert all(uses.get((mix, f"own text {i}")) == (times, "mirror") for i in range(5)), mix
    assert all(uses.get((2, f"shared text {i}")) == (3, "old") for i in range(40)) and all(uses.get((2, f"own text {i}")) == (2, "mirror") for i in range(5))
