import pytest

from vellum.plans import geometry_queries


def test_more_classes_than_prompts_raise(spark, tmp_path):
    rows = [(n, [1.0 + n, 2.0], n) for n in range(65)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(ValueError, match="64 classes"):
        geometry_queries.zero_shot(spark, str(tmp_path))
