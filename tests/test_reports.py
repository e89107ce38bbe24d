"""Report files from relations."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import evaluate, models, reports

ROWS = [(1, "order late late", "Shipping", "High", "external"), (2, "refund now", "Refund", "Low", None), (3, "Mera order kahan hai", "Shipping", "High", "manual"), (4, None, None, "Low", "manual")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_ord long, ticket_text string, category string, priority string, source string")


def test_written_report(spark, rows, tmp_path):
    report = reports.together(reports.counts_of("category|x", rows, F.col("category")), reports.row_of("size", rows.agg(F.count("*").alias("rows"), F.lit(1234567.25).alias("big"), F.lit(None).cast("double").alias("none"))))
    text = reports.write(spark, f"file://{tmp_path}/a/report.md", "Dataset", report)
    assert text == (tmp_path / "a" / "report.md").read_text()
    assert text == "# Dataset\n\n## category\\|x\n\n| name | value |\n| --- | --- |\n| Shipping | 2 |\n| Refund | 1 |\n| none | 1 |\n\n## size\n\n| name | value |\n| --- | --- |\n| big | 1,234,567.25 |\n| rows | 4 |\n| none |  |\n"
    with pytest.raises(ValueError):
        reports.write(spark, f"file://{tmp_path}/b.md", "Dataset", report, limit=2)
    assert not (tmp_path / "b.md").exists()
    assert reports.write(spark, f"file://{tmp_path}/c.md", "Empty", report.limit(0)) == "# Empty\n\n"


def test_diversity_and_summary(spark, rows):
    report = reports.diversity(rows.where("ticket_text is not null"))
    got = {(r.section, r.name): r.value for r in report.collect()}
    assert got["length", "max_words"] == 4 and got["vocabulary", "total_tokens"] == 9 and got["language", "hinglish"] == 1 and got["keywords", "Shipping: late"] == 2
    short = reports.summary(report, sections=("language", "vocabulary"))
    assert {r.section for r in short.collect()} == {"language", "vocabulary"}


def test_model_comparison_of_a_benchmark(spark, tmp_path):
    made = [(i, f"T{i}", f"{('refund money', 'parcel late')[i % 2]} word{i % 7}", ("Refund", "Shipping")[i % 2], ("High", "Low")[i % 2], ("train", "train", "test", "holdout")[(i // 2) % 4]) for i in range(80)]
    frame = spark.createDataFrame(made, "row_ord long, ticket_id string, ticket_text string, category string, priority string, split string")
    metrics = models.benchmark(frame, "category", (models.Config(models.NB, models.NB),), 50)
    flat = metrics.select(F.lit("category").alias("target"), F.concat_ws(" on ", *[c for c, t in metrics.dtypes if t == "string"]).alias("model"), F.lit(0).alias("ord"), *[c for c, t in metrics.dtypes if t == "double"])
    report = reports.models(flat, evaluate.best(flat, "target", "accuracy", "ord").select("target", "model"))
    text = reports.write(spark, f"file://{tmp_path}/models.md", "Models", report)
    assert "## best model for category" in text and "accuracy | 1 |" in text
