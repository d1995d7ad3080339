"""The crawl of the link-safety queries holds all pages, and the messages name them."""

from pyspark.sql import functions as F

from wardline.plans import fixtures as X

SF = "/root/testdata/sf0.1"


def test_every_page_is_crawled_and_named(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert pages > X.SITES
    fetched = X.fetches(spark, SF).select("request_url", "method").distinct()
    assert fetched.count() == 6 * pages
    number = F.regexp_extract("content", r"(site|bug)(\d+)", 2)
    named = X.crawled_messages(spark, SF).select(number.alias("n"), (F.col("message_id") % 16).alias("kind")).where("n <> ''")
    for kind in (4, 6, 0, 5, 7, 15):  # those whose addresses are crawled
        assert named.where((F.col("kind") == kind) & (F.col("n").cast("int") < pages)).select("n").distinct().count() == pages
