"""Decisions by classes of records are those of each pair."""

from pyspark.sql import functions as F

from veridex.operators import assay
from veridex.plans.decisions import assay_records


def test_classes_decide_as_pairs_do(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(assay, "CHUNK", 2)
    monkeypatch.setattr(assay, "TILE", 3)
    k = F.col("feature_id").cast("bigint")
    kegg = F.struct(F.lit("KEGG").alias("scheme"), F.concat(F.lit("C"), k % 7).alias("value"), F.lit("exact_structure").alias("resolution"))
    inchi = F.struct(F.lit("inchi key").alias("scheme"), F.concat(F.lit("AB-"), k % 3).alias("value"), F.when(k % 4 > 0, "exact_structure").otherwise("lipid_species").alias("resolution"))
    records = assay_records(spark, sf_dir).filter(k <= 60).withColumn("ids", F.when(k % 5 == 0, F.array(kegg)).when(k % 5 == 1, F.array(inchi)).otherwise(F.array(kegg, inchi)))
    want = sorted(map(tuple, assay.decide(assay.candidates(records), records).collect()), key=str)
    got = sorted(map(tuple, assay.decide_candidates(records).collect()), key=str)
    assert len(want) > 300 and got == want
    assert {r.status for r in assay.decide_candidates(records).select("status").distinct().collect()} >= {"requires_human_review", "non_combinable"}
    kinds = assay.count_candidates(records)
    assert kinds.agg(F.sum("pairs")).first()[0] == len(want) and assay.summary(kinds).first().pairs == len(want)


def test_repeated_feature_ids_do_not_pair_with_themselves(spark, sf_dir):
    records = assay_records(spark, sf_dir).filter("feature_id <= '000000000005'").withColumn("ids", F.array(F.struct(F.lit("kegg").alias("scheme"), F.lit("C1").alias("value"), F.lit("exact_structure").alias("resolution"))))
    n = records.count()
    twice = records.unionByName(records.filter("feature_id = '000000000001'").withColumn("loq", F.lit(9.0)))
    assert assay.summary(assay.count_candidates(twice)).first().pairs == n * (n - 1) // 2 + n - 1 == assay.decide_candidates(twice).count()
