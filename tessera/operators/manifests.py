"""Working sets on disk: candidates of a manifest, confirmed papers and where their files are, refills and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators.ordering import global_rank, hash_key
from tessera.operators.sampling import stratified_sample


def candidates(manifest: DataFrame) -> DataFrame:
    """Manifest rows as candidates: ``pdf`` is the local copy where one is noted, else the source; pages that are no number are null."""
    pages = F.col("pages").cast("string").try_cast("double").try_cast("int")
    local = F.nullif(labels.strip(F.col("dst")), F.lit(""))
    return manifest.filter("id is not null").select("set_name", "id", "volume", "rel_path", F.coalesce(local, "src").alias("pdf"), pages.alias("pages"))


def preferred_ids(manifests: DataFrame, name: str) -> DataFrame:
    """Ids of ``<name>_confirmed`` if that set has rows, else of ``<name>``; an error if neither has any."""
    rows = manifests.filter(F.col("set_name").isin(name, f"{name}_confirmed")).select("set_name", "id")
    best = rows.agg(F.max("set_name").alias("best")).first()["best"]  # the confirmed name sorts behind the plain one
    if best is None:
        raise ValueError(f"no manifest for set {name!r}")
    return rows.filter(F.col("set_name") == best).select("id")


def confirmed_sources(confirmed: DataFrame, staged: DataFrame, others: DataFrame) -> DataFrame:
    """(id, rel_path, source, staged): where the file of every confirmed paper is taken from.

    The paper's own place among the ``staged`` candidates comes first, then any other set that holds the same relative
    path; sets whose name starts with an underscore are bookkeeping and give nothing. A paper without either is reported
    as not staged, so that manifest and folder never fall behind the decisions.
    """
    own = staged.filter("id is not null").groupBy("id").agg(F.min(F.struct("set_name", "rel_path")).alias("o")).select("id", F.col("o.set_name").alias("own"), "o.rel_path")
    siblings = others.filter("rel_path is not null and set_name not like '\\\\_%'").groupBy("rel_path").agg(F.min("set_name").alias("sibling"))
    placed = confirmed.select("id").distinct().join(own, "id", "left").withColumn("rel_path", F.coalesce("rel_path", F.concat("id", F.lit(".pdf"))))
    source = F.coalesce("own", "sibling")
    return placed.join(siblings, "rel_path", "left").select("id", "rel_path", source.alias("source"), source.isNotNull().alias("staged"))


def attrition(rejected: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, in_set): rejected papers, and whether they were lost from the set or come from outside it."""
    inside = manifest.select("id").distinct().withColumn("__in", F.lit(True))
    return rejected.select("id").distinct().join(inside, "id", "left").select("id", F.coalesce("__in", F.lit(False)).alias("in_set"))


def refill_target(have: Column, need: Column, target: Column) -> Column:
    """The target a set is filled to: null if it holds what is needed, else the larger of both."""
    return F.when(have < need, F.greatest(target, need))


def pretest(manifest: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A stratified draw of ``n`` papers by volume, with the figures of the parent's manifest."""
    rows = manifest.filter("id is not null and volume is not null").groupBy("id").agg(*[F.max(c).alias(c) for c in ("volume", "score", "pages")])
    return stratified_sample(rows, n, seed).select("id", "volume", "score", "pages")


def stream(primary: DataFrame, overflow: DataFrame, seen: DataFrame, seed: int = 42) -> DataFrame:
    """(id, phase, position): the primary papers, then the overflow's that are not among them, without those seen; each in seeded order."""
    first = primary.filter("id is not null").select("id").distinct().withColumn("phase", F.lit(0))
    second = overflow.filter("id is not null").select("id").distinct().join(first, "id", "left_anti").withColumn("phase", F.lit(1))
    left = first.unionByName(second).join(seen.select("id").distinct(), "id", "left_anti")
    keyed = left.withColumn("__k", F.concat(F.col("phase").cast("string"), hash_key(seed, "id")))
    return global_rank(keyed, "__k", ["id"]).select("id", "phase", "position")


def sizes(manifest: DataFrame, confirmed: DataFrame, targets: DataFrame) -> DataFrame:
    """(set_name, on_disk, manifest, confirmed, target, status) of every set; without target there is no status."""
    known = confirmed.select("id").distinct().withColumn("__c", F.lit(True))
    rows = manifest.join(known, "id", "left").groupBy("set_name").agg(
        F.count_distinct("dst").alias("on_disk"), F.count("*").alias("manifest"), F.count_distinct(F.when(F.col("__c"), F.col("id"))).alias("confirmed"),
    )
    missing = F.col("target") - F.col("on_disk")
    status = F.when(F.col("target").isNull(), "").when(missing <= 0, "OK").otherwise(F.concat(F.lit("SHORT by "), missing))
    return rows.join(targets.select("set_name", "target"), "set_name", "left").select("*", status.alias("status"))


def validated(rows: DataFrame, required: list[str]) -> DataFrame:
    """The required fields trimmed, nulls as empty text, and ``missing``: the names of those that are blank."""
    text = {c: labels.strip(F.coalesce(F.col(c), F.lit(""))) for c in required}
    trimmed = rows.withColumns(text)
    return trimmed.withColumn("missing", F.concat_ws(";", *[F.when(F.col(c) == "", c) for c in required]))
