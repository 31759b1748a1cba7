"""Urls of hot hosts and names of long words."""

from lumicurve.llm import url_filter


def test_hot_names_and_repeated_rows(spark):
    rows = [(k, f"http://{w}{'abcdefgh'[k % 8]}.com/{'casino' if k % 3 == 0 else 'news'}/p{k}", "<p>casino news</p>", "x", "y") for k, w in enumerate(["qzx", "vwk", "jjq"] * 10)]
    rows += [(None, rows[0][1], None, "x", "y"), (0, None, "", "x", "y")] + [(7, "https://hot.com/casino/news/casino", "", "x", "y")] * 60
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, tokens string").repartition(3)
    out = url_filter.judge_urls(pages).collect()
    assert len(out) == len(rows)
    assert {tuple(r.words) for r in out if r.host == "hot.com"} == {("hot", "/casino", "/news", "/casino")}
    assert len({r.score for r in out if r.host == "hot.com"}) == 1
    assert [r.words for r in out if not r.host] == [[]]


def test_names_are_split_at_long_words(spark):
    pages = spark.createDataFrame([(1, "http://internationalcommunications.com/" + "q" * 3000, "<p>international communications</p>")], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages).collect()[0].words == ["international", "communications", "/" + "q" * 3000]
