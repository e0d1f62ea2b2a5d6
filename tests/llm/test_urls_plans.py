"""Rounds of the path tree are plans of their own size, however many there are."""

from quadrel.llm import urls


def test_no_plan_grows_with_the_rounds(spark, monkeypatch):
    joins, write = [], urls.materialise

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(urls, "materialise", counted)
    deep = [(i, f"http://a.net/{'x/' * (i % 8)}{i}/p{i}") for i in range(160)]
    paths = urls.distinct_paths(urls.parsed(spark.createDataFrame(deep, "page_id bigint, url string")))
    t = urls.templates(paths)
    assert max(joins) <= 4 and len(joins) > 6
    assert t.count() == 160 and t.select("path").distinct().count() == 160
