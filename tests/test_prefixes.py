"""Common prefixes of prompts against an item-by-item comparison."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prefixes

ITEM = "stream string, n long, reset boolean, content string, tokens long"
REQUEST = "stream string, request long, charged boolean, segment long, length long"


def logs(seed):
    """Streams of items with compactions that log part of the old prompt anew, some of it changed; and requests."""
    draw, items, requests, want = random.Random(seed), [], [], {}
    for stream in "abc":
        prompt, segment, n, base = [], 0, 0, []
        for request in range(40):
            if draw.random() < 0.2:
                segment, kept = segment + 1, list(prompt[: draw.randrange(len(prompt) + 1)])
                if kept and draw.random() < 0.6:
                    at = draw.randrange(len(kept))
                    kept[at] = (f"{kept[at][0]}!", kept[at][1])
                items.append((stream, n, True, None, 99))
                n += 1
                prompt = []
                for c in kept:
                    items.append((stream, n, False, *c))
                    prompt.append(c)
                    n += 1
            for _ in range(draw.randrange(4)):
                c = (draw.choice("pqr") if draw.random() < 0.7 else None, draw.randrange(5))
                items.append((stream, n, False, *c))
                prompt.append(c)
                n += 1
            charged = draw.random() < 0.8
            requests.append((stream, request, charged, segment, len(prompt)))
            k = 0
            while k < min(len(prompt), len(base)) and prompt[k][0] == base[k][0]:
                k += 1
            want[stream, request] = (k, sum(t for _, t in prompt[:k]))
            if charged:
                base = list(prompt)
    return items, requests, want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stable_prefixes_are_item_by_item(spark, seed):
    items, requests, want = logs(seed)
    chain = prefixes.chained(spark.createDataFrame(items, ITEM).repartition(3), "stream", ["n"], F.col("reset"), F.col("content"), "tokens")
    found = prefixes.stable_prefix(chain, spark.createDataFrame(requests, REQUEST), "stream", across=True)
    assert {(r["stream"], r["request"]): (r["stable_items"], r["stable"]) for r in found.collect()} == want


def test_an_item_that_changed_ends_the_prefix(spark):
    body = [("s", i, False, c, 10) for i, c in enumerate("abcd")]
    again = [("s", 4, True, None, 0), *[("s", 5 + i, False, c, 10) for i, c in enumerate("abXd")]]
    chain = prefixes.chained(spark.createDataFrame(body + again, ITEM), "stream", ["n"], F.col("reset"), F.col("content"), "tokens")
    found = prefixes.stable_prefix(chain, spark.createDataFrame([("s", 0, True, 0, 4), ("s", 1, True, 1, 4)], REQUEST), "stream", across=True).orderBy("request").collect()
    assert [(r["stable_items"], r["stable"]) for r in found] == [(0, 0), (2, 20)]


def test_a_compaction_shares_nothing_and_uncharged_requests_move_nothing(spark):
    rows = [("s", i, False, "x", 10) for i in range(4)] + [("s", 4, True, None, 0), ("s", 5, False, "x", 10)]
    chain = prefixes.chained(spark.createDataFrame(rows, ITEM), "stream", ["n"], F.col("reset"), F.col("content"), "tokens")
    asked = spark.createDataFrame([("s", 0, True, 0, 2), ("s", 1, False, 0, 3), ("s", 2, True, 0, 4), ("s", 3, True, 1, 1)], REQUEST)
    found = prefixes.stable_prefix(chain, asked, "stream").orderBy("request").collect()
    assert [(r["stable_items"], r["stable"]) for r in found] == [(0, 0), (2, 20), (2, 20), (0, 0)]
    assert prefixes.stable_prefix(chain.where("false"), spark.createDataFrame([], REQUEST), "stream").count() == 0
