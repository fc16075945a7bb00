"""Replies meet enrichment rows by the first characters of the names, and take the rows that a plain search takes."""

import random

from pyspark.sql import functions as F

from locusloom.operators import retrieval as rt


def _plain(replies, table):
    taken = {}
    for request, place, name, rank, reason in sorted((r for r in replies if r[2]), key=lambda r: (r[0], r[1])):
        rows = [t for t in table if t[0] == request and t[3] is not None and name.lower() in t[3].lower()]
        if rows:
            _, _, id_, term, genes, p = min(rows, key=lambda t: (t[1], t[2]))
            taken.setdefault((request, id_), (request, id_, term, rank, reason, genes, p))
    return sorted(taken.values())


def test_matched_replies_equal_a_plain_search(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abAB é") for _ in range(n))
    table = [(draw.randrange(3), i, f"t{draw.randrange(60)}", None if i % 17 == 0 else text(draw.randrange(25)), f"g{i}", float(i)) for i in range(150)]
    replies = [(draw.randrange(4), i, None if i % 13 == 0 else text(draw.randrange(12)), i % 7, f"why {i}") for i in range(200)]
    got = rt.matched_replies(
        spark.createDataFrame(replies, "request_id int, place int, name string, rank int, reason string"),
        spark.createDataFrame(table, "request_id int, row int, id string, term string, genes string, p double"))
    assert sorted(tuple(r) for r in got.collect()) == _plain(replies, table)


def test_a_name_meets_only_terms_that_hold_its_first_characters(spark):
    n = 2000
    word = F.substring(F.md5(F.col("id").cast("string")), 1, 12)
    table = spark.range(n).select(F.lit(1).alias("request_id"), word.alias("low"), "id")
    names = spark.range(n).select(F.lit(1).alias("request_id"), word.alias("name"))
    met = rt.named_terms(names, table)
    assert met.filter("low = name").count() == n and met.count() < 2 * n  # of 4 million
