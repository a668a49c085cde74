import math
import random

import duckdb

from kinloom.operators import progressive


def test_means_of_the_schedule_do_not_hang_on_the_order(spark):
    two = [(1, 0.04), (1, 0.066666667 - 1e-17), (2, 0.518518518), (2, 0.518518519), (3, 0.000000001), (3, 0.0)]
    many = [(4, w) for w in (0.031970464, 0.031970465) * 8] + [(5, w) for w in (0.1, 0.2, 0.3, 0.400000002)] + [(6, w) for w in (0.7, 0.1, 0.200000003, 0.3)]
    con = duckdb.connect()
    means = lambda rows: dict(map(tuple, spark.createDataFrame(rows, "p1 long, weight double").groupBy("p1").agg(progressive.mean_weight()).collect()))
    found = means(two + many)
    con.sql("create table w (p1 bigint, weight double)")
    con.executemany("insert into w values (?, ?)", two)
    assert [found[n] for n in (1, 2, 3)] == [m for _, m in con.sql("select p1, round(avg(weight), 9) from w group by 1 order by 1").fetchall()]
    assert means(many[::-1]) == {n: found[n] for n in (4, 5, 6)}


def test_means_of_the_schedule_are_those_of_exact_sums(spark):
    tipped = [  # a plain sum in rising order rounds these the other way
        (0.013888889, 0.015873016, 0.023809524, 0.058823529),
        (0.012195122, 0.016949153, 0.021276596, 0.023809524, 0.029411765, 0.032258065),
        (0.013513514, 0.015873016, 0.016129032, 0.019230769, 0.020833333, 0.028571429, 0.111111111, 0.25),
    ]
    draw = random.Random(5)
    groups = tipped + [tuple(round(1 / draw.randint(1, 90), 9) for _ in range(2 * draw.randint(1, 40))) for _ in range(300)]
    rows = [(n, w) for n, ws in enumerate(groups) for w in ws]
    draw.shuffle(rows)
    found = dict(map(tuple, spark.createDataFrame(rows, "p1 long, weight double").groupBy("p1").agg(progressive.mean_weight()).collect()))
    assert found == {n: math.floor(math.fsum(ws) / len(ws) * 1e9 + 0.5) / 1e9 for n, ws in enumerate(groups)}
