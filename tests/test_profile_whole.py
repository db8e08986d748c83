from pyspark.sql import functions as F

from ledgerloom.operators import profile


def test_a_unique_field_of_many_values_stays_an_identifier(spark):
    n = 25_000
    raw = spark.range(n).select(F.lit("g").alias("source_group"), F.format_string('{"reg_no": "R%d", "name": "N%d"}', "id", F.col("id") % 10).alias("raw_json"))
    stats = profile.field_stats(profile.flatten(raw), raw)
    rows = {r["path"]: r for r in stats.withColumn("idc", profile.is_id_candidate()).collect()}
    assert rows["reg_no"]["n_distinct"] == n and rows["reg_no"]["idc"] and not rows["name"]["idc"]
    assert [(r["id_path"], r["name_path"]) for r in profile.name_beside(stats).collect()] == [("reg_no", "name")]
