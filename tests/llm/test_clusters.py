"""Hamerly's clusters against plain rounds and DuckDB."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import hamerly, queries

SF = "/root/testdata/sf0.01"


def plain(rows, k=16, rounds=3):
    """{row number: (cluster, distance)} and centroids, in Python's integers."""
    q = [[int(np.floor(64 * float(x))) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), q[i]))
    cents = [q[i] for i in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        of = [min((dist(v, c), j) for j, c in enumerate(cents)) for v in q]
        if n < rounds:
            for j in range(len(cents)):
                own = [v for v, (_, i) in zip(q, of, strict=True) if i == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(j, d) for d, j in of], cents


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("many, spread", [(5, 1.0), (60, 0.3), (300, 1.0), (300, 1e5)])
def test_equals_plain_rounds(spark, many, spread):
    rng = np.random.default_rng(many)
    rows = [(int(i), (rng.standard_normal(64) * spread + rng.integers(0, 4)).tolist()) for i in rng.permutation(many * 3)[:many]]
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], rows[2][1])]  # a repeated row, a repeated id
    got, cents = hamerly.cluster(vectors(spark, rows).repartition(3))
    want, want_cents = plain(rows)
    assert cents.tolist() == want_cents
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    got, cents = hamerly.cluster(vectors(spark, rows))
    want, want_cents = plain(rows)
    assert cents.tolist() == want_cents and sorted(r["cluster"] for r in got.collect()) == sorted(j for j, _ in want)


def test_bounds_spare_scans_and_stay_valid():
    rng = np.random.default_rng(3)
    base = rng.integers(-400, 400, (16, 64))
    x = base[rng.integers(0, 16, 5000)] + rng.integers(-40, 40, (5000, 64))
    now = base + rng.integers(-30, 30, base.shape)
    cluster, upper, lower, _, scanned = hamerly.Moved(now).assign(x, np.zeros(5000, np.int32), np.zeros(5000), np.zeros(5000), True, False)
    assert scanned.all()
    for _ in range(4):
        before, now = now, now + rng.integers(-6, 7, now.shape)
        cluster, upper, lower, _, scanned = hamerly.Moved(now, before).assign(x, cluster, upper, lower, False, False)
        d = hamerly.squared(x, now)
        assert (d.argmin(1) == cluster).all() and scanned.mean() < 0.5
        own = np.sqrt(d[np.arange(len(x)), cluster])
        d[np.arange(len(x)), cluster] = 1 << 60
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()


def test_odd_vectors(spark):
    ok = [0.5] * 64
    rows = [(1, ok), (2, None), (3, [0.5] * 63), (4, [None] + [0.5] * 63), (5, [float("nan")] + [0.5] * 63), (6, [float("inf")] + [0.5] * 63), (None, ok), (7, [])]
    df = vectors(spark, rows).withColumns({"cluster": F.lit("x"), "q": F.lit(1), "distance": F.lit(2)})
    got = hamerly.clusters_with_inertia(df).collect()
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"], r["inertia"]) for r in got) == [(0, 0, 0, 0), (1, 0, 0, 0)]
    assert hamerly.clusters_with_inertia(df.where("vec_id < 0")).collect() == []
    with pytest.raises(Exception, match="a component is over"):
        hamerly.cluster(vectors(spark, [(1, [1e30] + [0.0] * 63)]))


def test_equals_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(queries.oracle_sql()["op11_hamerly_clusters"])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in queries.op11_hamerly_clusters(spark, SF).collect()) == want and len({w[1] for w in want}) == 16
