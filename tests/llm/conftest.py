import pytest


@pytest.fixture
def write(spark, tmp_path):
    def run(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return run
