from datetime import datetime

from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import properties as P

T0 = datetime(2024, 1, 1)


def test_one_property_has_values_of_several_types(spark, tmp_path):
    texts = ['{"v": 5, "w": {"x": [1, 2]}}', '{"v": "7"}', '{"v": "hot"}', '{"v": 2.5}', '{"v": true}', '{"v": null}', "{}", "not json", None]
    log = spark.createDataFrame([(f"ev-{k}", k, T0, t, []) for k, t in enumerate(texts)], schemas.EVENT)
    P.write_events(P.with_variant(log), str(tmp_path / "log"))
    stored = P.read_events(spark, str(tmp_path / "log")).orderBy("seq")
    assert [r[0] for r in stored.select(P.value_of("v", "int")).collect()] == [5, 7, None, 2, 1, None, None, None, None]
    assert [r[0] for r in stored.select(P.value_of("v", "string")).collect()] == ["5", "7", "hot", "2.5", "true", None, None, None, None]
    assert [r[0] for r in stored.select(P.kind_of("v")).collect()] == ["BIGINT", "STRING", "STRING", "DECIMAL(2,1)", "BOOLEAN", "VOID", None, None, None]
    assert [r[0] for r in stored.select(P.value_of("w.x[1]", "int")).collect()][0] == 2
    assert P.with_json(stored).first().properties == '{"v":5,"w":{"x":[1,2]}}'


def test_a_filter_on_a_property_reaches_the_scan(spark, tmp_path):
    log = spark.range(3000).select(
        F.concat(F.lit("ev-"), "id").alias("id"), F.col("id").alias("seq"), F.lit(T0).cast("timestamp_ntz").alias("ts"),
        F.to_json(F.struct((F.col("id") % 9).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("note"))).alias("properties"), F.array(F.lit("a")).alias("labels"),
    )
    P.write_events(P.with_variant(log), str(tmp_path / "log"))
    log.write.parquet(str(tmp_path / "json"))
    found = P.read_events(spark, str(tmp_path / "log")).where(P.value_of("k", "int") > 7).select("seq")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == log.where(F.get_json_object("properties", "$.k").cast("int") > 7).count()
    assert "properties:struct<0:int>" in plan and "GreaterThan(properties.`0`,7)" in plan

    def note_and_k(path):
        import glob

        import pyarrow.parquet as pq

        sizes = {}
        for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    column = meta.row_group(g).column(c)
                    sizes[column.path_in_schema] = sizes.get(column.path_in_schema, 0) + column.total_compressed_size
        return sizes

    shredded, text = note_and_k(tmp_path / "log"), note_and_k(tmp_path / "json")
    own = sum(v for k, v in shredded.items() if k.startswith("properties.typed_value.k."))
    assert 0 < own < text["properties"] / 20
