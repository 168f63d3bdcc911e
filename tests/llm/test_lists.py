"""A block list of 10^5 entries: the memory-mapped array and the join say the same."""

from pyspark.sql import functions as F

from costloom.llm import urlfilter


def test_a_long_list_from_a_file_by_array_and_by_join(spark, tmp_path):
    lines = [f"host{i}.example{i % 7}.com" + (f"/p{i % 13}" if i % 3 == 0 else "") for i in range(100_000)]
    (tmp_path / "list.txt").write_text("\n".join([*urlfilter.BLOCKED_HOSTS, "# a note", "", *lines]))
    listed = urlfilter.read_block_list(spark, str(tmp_path / "list.txt"))
    rules = spark.createDataFrame([(v, t, True) for v, t in urlfilter.RULES], "verdict string, text string, is_rule boolean")
    entries = rules.unionByName(listed.select("verdict", "text", "is_rule"))
    assert entries.count() == len(urlfilter.RULES) + len(urlfilter.BLOCKED_HOSTS) + len(lines)
    n = F.col("page_id")
    host = F.concat(F.when(n % 5 == 0, F.lit("www.")).otherwise(F.lit("")), F.lit("host"), n.cast("string"), F.lit(".example"), (n % 8).cast("string"), F.lit(".com"))
    pages = spark.range(0, 120_000, 17).select(F.col("id").alias("page_id")).withColumn("url", F.concat(F.lit("https://"), host, F.lit("/p"), (n % 11).cast("string"), F.lit("/x?y")))
    by_array = urlfilter.judge_pages(pages, entries)
    by_join = urlfilter.judge_pages(pages, entries, max_bytes=0)
    a, b = (sorted(map(tuple, df.select("page_id", "rule", "verdict", "listed").collect())) for df in (by_array, by_join))
    assert a == b and 0 < sum(r[3] is not None for r in a) < len(a)
    want = {r[0]: r[0] < 100_000 and r[0] % 8 == r[0] % 7 and (r[0] % 3 != 0 or f"p{r[0] % 11}/x".startswith(f"p{r[0] % 13}")) for r in a}
    assert {r[0]: r[3] is not None for r in a} == want
