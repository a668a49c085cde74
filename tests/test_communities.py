"""Communities, learnt scores and the operators that came with them, on small fixtures."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.operators import attributes, blocking, communities, learning, progressive, statistics
from kinloom.operators.components import connected_components
from kinloom.sources import loaders


def _score(edges, of, resolution=1.0):
    total = 2 * sum(w for *_, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - resolution * sum(k * k for k in degree.values()) / total**2


def test_modularity_and_communities(spark):
    groups = [range(g * 10, g * 10 + 6) for g in range(6)]
    rows = [(a, b, 1.0) for g in groups for a, b in combinations(g, 2)] + [(groups[i][0], groups[(i + 1) % 6][1], 0.5) for i in range(6)]
    edges = spark.createDataFrame([*rows, (3, 2, 0.4), (None, 1, 1.0), (1, 50, 0.0)], "p1 long, p2 long, weight double")
    want = {n: min(g) for g in groups for n in g}
    for connected in (False, True):
        found = {r.profile_id: r.cluster_id for r in communities.communities(edges, connected=connected).collect()}
        assert found == want
    clusters = spark.createDataFrame(list(want.items()), "profile_id long, cluster_id long")
    assert communities.modularity(edges, clusters).first()[0] == pytest.approx(_score(rows, want))
    some = clusters.where("profile_id < 30")
    alone = {n: want[n] if n < 30 else -n for n in want}
    assert communities.modularity(edges, some, 0.7).first()[0] == pytest.approx(_score(rows, alone, 0.7))
    assert communities.community_blocks(edges.limit(0)).count() == 0 and communities.modularity(edges.limit(0), clusters).first()[0] == 0.0


def test_a_kernel_machine_learns_what_no_line_divides(spark):
    r = random.Random(3)
    points = [(i, i + 1000, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(600)]
    rows = [(*p, int(p[2] ** 2 + p[3] ** 2 < 0.5)) for p in points]
    edges = spark.createDataFrame(rows, "p1 long, p2 long, x double, y double, is_match int")
    found = learning.kernel_match_probabilities(edges, edges.where("p1 < 300"), ("x", "y"))
    right = found.where("p1 >= 300").agg(F.avg((F.col("pred") == F.col("is_match")).cast("int"))).first()[0]
    assert right > 0.93 and found.columns == [*edges.columns, "p_match", "pred"]


def test_batches_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([(i, "red car" if i % 2 else "blue boat sails") for i in range(20)] + [(20, None), (21, "")], "id long, text string")
    got = learning.batches_of_alike(rows, "id", F.col("text"), 5, groups=3).collect()
    assert sorted(x.id for x in got) == list(range(22)) and [sum(x.batch == b for x in got) for b in range(5)] == [5, 5, 5, 5, 2]
    assert len({x.cluster for x in got if x.id < 20 and x.id % 2}) == 1
    assert learning.batches_of_alike(rows.limit(0), "id", F.col("text"), 5).count() == 0
    stage = learning.PairSimilarity(first="a", second="b", outputCol="s")
    stage.write().overwrite().save(f"{tmp_path}/stage")
    pairs = spark.createDataFrame([("red car", "red bus"), (None, "x")], "a string, b string")
    values = [r.s for r in learning.PairSimilarity.load(f"{tmp_path}/stage").transform(pairs).collect()]
    assert values[0] == pytest.approx(1 / 3) and values[1] != values[1]
    with pytest.raises(ValueError):
        stage.transform(pairs.withColumn("a", F.lit(1)))


def test_two_steps_keep_profiles_that_meet(spark):
    bag = lambda **kv: [(k, v) for k, v in kv.items()]
    rows = [(1, 0, "a", bag(name="red fox jumps", city="rome")), (2, 1, "b", bag(title="red fox jumps", place="rome")), (3, 0, "c", bag(name="other words here", city="oslo"))]
    profiles = spark.createDataFrame(rows, f"profile_id long, source_id int, original_id string, attributes {loaders.ATTRIBUTES}")
    kept, threshold = attributes.blocked_profiles(profiles)
    assert sorted(r.profile_id for r in kept.select("profile_id").collect()) == [1, 2] and threshold == 1.0
    clusters = {(r.source_id, r.key): r.cluster_id for r in attributes.cluster_attributes_in_two_steps(profiles).collect()}
    assert clusters[0, "name"] == clusters[1, "title"] != clusters[0, "city"] == clusters[1, "place"]
    assert attributes.blocked_profiles(profiles.limit(0), step=0.5)[0].count() == 0


def test_keys_blocks_and_schedules(spark):
    bags = spark.createDataFrame([(1, 0, [("k", "Ab cd"), ("x", None), ("y", " "), ("z", "q")])], f"profile_id long, source_id int, attributes {loaders.ATTRIBUTES}")
    assert set(bags.select(X.keyed_ngrams(F.col("attributes"), exclude=("z",))).first()[0]) == {"k_ab_", "k_b_c", "k__cd"}
    held = spark.createDataFrame([("a", i, 0) for i in range(4)] + [("b", 0, 0), ("b", 1, 0), ("c", 9, 0)], "block_key string, profile_id long, source_id int")
    assert sorted({r.block_key for r in blocking.bounded_blocks(held, 3).collect()}) == ["b"] and blocking.bounded_blocks(held).count() == 6
    edges = spark.createDataFrame([(i, i + 20, 1.0) for i in range(20)], "p1 long, p2 long, weight double")
    first = progressive.within_budget(progressive.profile_schedule(edges, seed=5), 7).collect()
    assert sorted(r.position for r in first) == list(range(1, 8))
    offsets = statistics.token_offsets(spark.createDataFrame([(1, "  Ab, cd"), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    assert sorted((r.id, r.token, r.start, r.end) for r in offsets) == [(1, "ab", 2, 4), (1, "cd", 6, 8)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.range(25).withColumn("v", F.lit(None).cast("string")).repartition(3)
    chunks = list(loaders.pandas_stream(df, 10, by=["id"]))
    assert [len(c) for c in chunks] == [10, 10, 5] and [x for c in chunks for x in c["id"]] == list(range(25))
    assert list(loaders.pandas_stream(df.limit(0), 10)) == []
    loaders.save_tables(str(tmp_path / "state"), blocks=df)
    assert loaders.load_tables(spark, str(tmp_path / "state"), "blocks")["blocks"].count() == 25
    loaders.write_features(df, str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert loaders.filled(spark.createDataFrame([(None, None, True)], "n int, t string, b boolean")).first()[:2] == (0, "unk")
    (tmp_path / "d").mkdir()
    for name, body in {"a.csv": "id,name\n1,x\n2,y\n", "b.csv": "key,name\n7,x\n8,z\n", "t.csv": "l,r\n1,7\n2,9\n", "pairs.txt": 'a "b\tc\t1\n', "n.csv": "dataset,profiles,block_sizes\nabt,5,2.5\n"}.items():
        (tmp_path / "d" / name).write_text(body)
    entry = {"format": "csv", "type": "clean", "base_path": "d", "d1": "a.csv", "d1_id_field": "id", "d2": "b.csv", "d2_id_field": "key", "gt": "t.csv", "gt_d1_field": "l", "gt_d2_field": "r"}
    profiles, first, second, truth = loaders.load_dataset(spark, entry, f"{tmp_path}/")
    assert profiles.count() == 4 and first.count() == second.count() == 2 and truth.count() == 1
    assert tuple(loaders.load_labelled_pairs(spark, f"{tmp_path}/d/pairs.txt").first()) == ('a "b', "c", 1)
    assert tuple(loaders.load_counts(spark, f"{tmp_path}/d/n.csv").first()) == ("abt", 5, 2.5)


def test_components_of_a_long_path(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "p1 long, p2 long")
    found = connected_components(edges)
    assert found.count() == 3000 and found.where("component <> 0").count() == 0
