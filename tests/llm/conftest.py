import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as the driver's are; returns the folder. ``extra`` adds columns whose names the operators use inside."""

    def write(extra=False, **rows):
        from pyspark.sql import functions as F

        for name, own in rows.items():
            df = spark.createDataFrame(own, SCHEMAS[name])
            if extra:
                for c in ("id", "key", "score", "host", "fp", "uid", "spans", "root", "block", "term"):
                    df = df.withColumn(c, F.lit("x"))
            df.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write

