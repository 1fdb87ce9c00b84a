"""op6's query judges by the words of its contract."""

import pytest

from rankspark.llm import query_op6

WORDS = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_the_rules_are_the_contracts():
    assert len(query_op6.RULES) == 5 and {rule: word for word, rule in query_op6.RULES} == WORDS


@pytest.mark.parametrize("learns", [True, False])
def test_every_rule_gives_its_word(spark, tmp_path, learns):
    urls = {1: "http://a.com/en/1", 2: "http://www.example.com/en/71", 3: "https://x.net/de/1?q", 4: "http://www.EXAMPLE.net/de/81", 5: "ftp://b.org/es/", 6: "http://notnet/de/1", 7: "http://example.net/de/7"}
    want = {1: "com/en/", 2: "example.com/en/7", 3: "net/de/", 4: "example.net/de/8", 5: "org/es/", 6: None, 7: "net/de/"}
    rows = [(i, u) for i, u in urls.items() if learns or i in (3, 6, 7)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in query_op6.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, (rule, verdict) in got.items():
        assert rule == want[i] and (rule is None or verdict == WORDS[rule])
