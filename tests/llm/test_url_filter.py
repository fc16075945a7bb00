from locusloom.llm import url_filter


def test_oracle_and_odd_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f"), (2, "https://example.com/en"), (3, "http://a.b.example.com/en/"), (4, None), (5, ""),
        (6, "example.com/en/"), (7, "http://x.net/es/a"), (8, "http://x.net/esa"), (9, "http://com/"), (10, "http://notexample.com/en/"),
        (11, "http://h.net?x=/fr/"), (None, "ftp://u@k.net/fr/://net/es/"), (7, "http://x.net/es/a"), (12, "http://" + "a." * 5000 + "net/fr/" + "p/" * 5000),
    ]
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert {(1, "www.example.com/en/", "allow"), (2, "com/", "allow"), (3, "example.com/en/", "block"), (4, None, "allow"), (5, None, "allow"),
            (6, None, "allow"), (7, "net/es/", "block"), (8, None, "allow"), (9, "com/", "allow"), (10, "com/", "allow"), (11, None, "allow"),
            (None, "net/fr/", "block"), (12, "net/fr/", "block")} == got
    assert url_filter.judge(pages, rules).count() == len(rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
