"""Tables as folders of part files, and tables in which a URL comes several times."""

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    for path in Path(FOLDER).iterdir():
        if path.name != "pages.parquet":
            shutil.copy(path, tmp_path)
    spark.read.parquet(f"{FOLDER}/pages.parquet").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    problem, rows = compare(entry.queries()["x01_stream_scan"](spark, str(tmp_path)), duck(FOLDER), entry.oracle_sql()["x01_stream_scan"])
    assert problem is None and rows == spark.read.parquet(f"{FOLDER}/pages.parquet").count()


@pytest.fixture(scope="module")
def repeated_urls(spark, tmp_path_factory):
    """A folder in which many pages have the URL of another page, some of two others, and other content."""
    folder = tmp_path_factory.mktemp("repeated")
    for path in Path(FOLDER).iterdir():
        if path.name != "pages.parquet":
            shutil.copy(path, folder)
    duck(FOLDER).execute(f"""COPY (SELECT page_id, url, html FROM pages
      UNION ALL SELECT page_id + 1020, url, html || '<img src="http://other.test/a.png"><a href="mailto:x@y.test">' FROM pages WHERE page_id % 3 <> 1
      UNION ALL SELECT page_id + 3040, url, html FROM pages WHERE page_id % 3 = 2) TO '{folder}/pages.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["d12_fill_schema", "d13_extraction_report", "f01_using_ip_address", "f07_subdomain_count", "f09_domain_registration_length",
     "f10_external_favicon", "f35_explain", "p01_schema", "p05_class_share", "v02_verdict", "v05_explanation"],
)
def test_each_crawl_of_a_url_counts(spark, repeated_urls, name):
    problem, rows = compare(entry.queries()[name](spark, repeated_urls), duck(repeated_urls), entry.oracle_sql()[name])
    assert problem is None and rows


def test_confidence_interval_calls_no_row_functions_of_the_engine(spark):
    """Hashes, noise and order come for many rows at once; a missing probability counts as 1 as before."""
    from pyspark.sql import functions as F

    from urlguard.operators import training as tr

    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.lit(0.4)).alias("y_prob"))
    found = tr.confidence_interval(rows, "k", "y_prob")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "conv(" not in plan
    by_key = {r.k: r for r in found.collect()}
    assert by_key[0].lower == by_key[0].upper == 1.0
    assert len(by_key) == 3000 and all(0.3 < by_key[k].lower < 0.4 < by_key[k].upper < 0.5 for k in range(1, 3000))


def test_a_dealt_batch_is_written_by_many_tasks_and_read_as_one(spark, tmp_path):
    from urlguard.plans.inputs import Inputs
    from urlguard.session import new_folder

    for path in Path(FOLDER).iterdir():
        if path.name != "pages.parquet":
            shutil.copy(path, tmp_path)
    spark.read.parquet(f"{FOLDER}/pages.parquet").repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    seen, checkpoint = [], new_folder(spark, "dealt-checkpoint")

    def note(batch, number):
        parities = {r.page_id % 2 for r in batch.select("page_id").collect()}
        seen.append((number, parities, batch.rdd.getNumPartitions()))

    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task for each file
    try:
        for dealt in Inputs(spark, str(tmp_path)).dealt("pages", 2, "page_id % 2"):
            query = dealt["pages"].writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(n, p) for n, p, _ in seen] == [(0, {0}), (1, {1})]
    assert min(tasks for _, _, tasks in seen) > 1
