"""A url with a line break before its scheme's end has the host that its path follows."""

from routelake.llm import urls


def test_leading_line_break(spark):
    pages = spark.createDataFrame([(1, "\nhttp://example.org/es/x"), (2, "ht\ntp://example.org/es/x")], "page_id long, url string")
    got = urls.judge(pages, urls.rule_table(spark, urls.RULES)).collect()
    assert {(r.page_id, r.host, r.path, r.verdict) for r in got} == {(i, "example.org", "/es/x", "block") for i in (1, 2)}
