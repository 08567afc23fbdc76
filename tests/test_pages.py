"""The source of captured pages: what is pushed and pruned, batch and stream, lists up to their last page."""

from pyspark.sql import functions as F

from bidloom.operators import extract
from bidloom.sources import pages

ROWS = [(k, ["a", "b"][k % 2], k // 2, f"https://x/{k}", f"<p>{k}</p>" + ("<a class='next'>n</a>" if k < 30 else ""), ["p", "q", "r"][k % 3], "extra") for k in range(60)]
SCHEMA = "page_id long, list string, page_no int, url string, html string, platform string, more string"


def source(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    pages.write_pages(spark.createDataFrame(ROWS, SCHEMA).repartition(4), path)
    return path


def test_filters_are_pushed_and_prune(spark, tmp_path):
    path = source(spark, tmp_path)
    asked = pages.read_pages(spark, path, ["p"], ["a"], 5, 20)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan and "GreaterThanOrEqual(page_no,5)" in plan and "EqualTo(list,a)" in plan
    assert sorted(r["page_id"] for r in asked.collect()) == [r[0] for r in ROWS if r[5] == "p" and r[1] == "a" and 5 <= r[2] <= 20]
    one = pages.read_pages(spark, path, urls=["https://x/7"])
    assert [tuple(r) for r in one.collect()] == [(7, "b", 3, "https://x/7", ROWS[7][4], "q")]
    assert pages.read_pages(spark, path).count() == 60 and pages.read_pages(spark, path, platforms=[]).count() == 0


def test_stream_gives_the_same_rows(spark, tmp_path):
    path = source(spark, tmp_path)
    for k in range(2):
        out = pages.stream_pages(spark, path, 2, platforms=["p", "q"], page_to=40).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        out.format("parquet").start(f"{tmp_path}/out").awaitTermination()
        got = sorted(map(tuple, spark.read.schema(pages.PAGES).parquet(f"file://{tmp_path}/out").collect()))
        assert got == sorted(map(tuple, pages.read_pages(spark, path, ["p", "q"], page_to=40).collect()))
        if k == 0:
            pages.write_pages(spark.createDataFrame([(100, "a", 40, "https://x/100", "", "q", "")], SCHEMA), path)


def test_lists_end_and_are_followed(spark, tmp_path):
    rows = pages.read_pages(spark, source(spark, tmp_path))
    reached = extract.until_last(rows, "list", "page_no", "a.next")
    assert sorted(r["page_id"] for r in reached.collect()) == list(range(32)) and reached.columns == rows.columns
    followed = extract.follow(rows.where("page_id < 2").select("page_id", "url"), rows, F.concat(F.lit("https://x/"), (F.col("page_id") + 9).cast("string")))
    assert sorted((r["page_id"], r["target_page_id"]) for r in followed.collect()) == [(0, 9), (1, 10)]
