"""A harvest's budgets, order and restarts."""

from collections import Counter

from pyspark.sql import functions as F

from lumenfold.operators.harvest import Budget, Harvest


def test_budgets_order_and_restart(spark, tmp_path):
    links = spark.createDataFrame([(s, f"p{i}", f"p{j}", f"a{j}") for s in (1, 2, 3) for i in range(12) for j in (2 * i + 1, 2 * i + 2, 0)], "source long, page string, url string, anchor string")
    entries = spark.createDataFrame([(7, 0, 2, "p0"), (7, 1, 1, "p0"), (8, 0, 3, "p0"), (8, 0, 3, "p5")], "plan long, position long, source long, url string")
    score = lambda url, anchor, depth: 20 - F.substring(url, 2, 9).cast("int") - depth
    make = lambda: Harvest(spark, str(tmp_path / "h"), links, score, Budget(round=2, source=4, plan=6, depth=2, least=6.0))
    make().begin(entries)
    assert make().step() == 4  # p0 of two sources, and both entries of the third
    lost = make()
    lost.store.append("visited", lost.picked().withColumn("round", F.lit(9)), ["plan", "source"], 32)  # the driver is lost before the commit
    rows = make().run(5).collect()
    pages = [(r["plan"], r["source"], r["url"]) for r in rows]
    assert len(set(pages)) == len(pages)
    assert all(n <= 4 for n in Counter(p[:2] for p in pages).values()) and all(n <= 6 for n in Counter(p[0] for p in pages).values())
    assert max(Counter((r["plan"], r["source"], r["round"]) for r in rows).values()) == 2 and {r["depth"] for r in rows} == {0, 1}
    second = sorted((r["position"], r["url"]) for r in rows if r["plan"] == 7 and r["round"] == 2)
    assert second == [(0, "p1"), (0, "p2"), (1, "p1"), (1, "p2")]  # best first, each source in the plan's order
    assert max(r["round"] for r in rows if r["plan"] == 7) == 2  # six pages: the plan's budget is spent
    assert make().step() == 0 and make().visited().count() == len(rows)


def test_links_of_poor_pages_are_not_followed(spark, tmp_path):
    links = spark.createDataFrame([(1, "good", "x", None), (1, "poor", "y", "a")], "source long, page string, url string, anchor string")
    h = Harvest(spark, str(tmp_path / "h"), links, lambda url, anchor, depth: F.when(url == "poor", 1.0).otherwise(9.0))
    h.begin(spark.createDataFrame([(1, 0, 1, "good"), (1, 0, 1, "poor")], "plan long, position long, source long, url string"))
    assert {r["url"] for r in h.run(4).collect()} == {"good", "poor", "x"}
