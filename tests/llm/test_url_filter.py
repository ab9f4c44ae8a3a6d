"""Suffix statistics beyond the sample that the trees are fit on."""

from tempora.llm import url_filter


def test_suffixes_are_counted_on_all_labelled_urls(spark):
    rows = [(f"https://www.site{i % 300}.com/{i}", i % 2) for i in range(1200)] + [("https://often.net/x", 1)] * 3000
    model, suffixes, mean = url_filter.train(spark.createDataFrame(rows, "url string, blocked int"), max_labelled=100, trees=2)
    got = {r.suffix: r for r in suffixes.collect()}
    assert len(got) == 301 and got["often.net"].suffix_n == 1 and all(got[f"site{i}.com"].suffix_n == 4 for i in range(300))
    assert mean == 601 / 1201
    assert abs(got["site1.com"].suffix_rate - (4 + 20 * mean) / 24) < 1e-12
