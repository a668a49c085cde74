from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinloom.functions import augment as A
from kinloom.functions import similarity as S
from kinloom.functions import text as X
from kinloom.operators import attributes, blocking, clustering, evaluation, graph, progressive, simjoin
from kinloom.operators.components import connected_components
from kinloom.sources import loaders

DATA = "/root/testdata/sf0.001"
FAST = ["token_blocks", "purge_level", "cleaned_blocks", "pairs_cbs", "edge_features", "supervised_rcnp", "similarity_functions", "edit_join", "extended_ngrams", "attribute_entropy", "column_scores", "threshold_sweep", "blast_thresholds", "null_patterns", "weights_entropy", "multi_attribute_join"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(map(tuple, df.select(*columns).collect()))
    ref = sorted(con.sql(__spark_entry__.oracle_sql()[name]).select(*(f'"{c}"' for c in columns)).fetchall())
    assert [tuple(float(v) if isinstance(v, float) else v for v in r) for r in mine] == ref


def tiny(spark):
    rows = [(0, 0, "red apple pie"), (1, 0, "red apple tart"), (2, 0, "green apple"), (3, 0, "unique"), (4, 0, None), (5, 0, "")]
    return spark.createDataFrame(rows, "profile_id long, source_id int, text string")


def test_blocks_pairs_and_weights(spark):
    members = blocking.blocks_by_key(tiny(spark), X.tokens(F.col("text")))
    stats = {r.block_key: (r["size"], r.comparisons) for r in blocking.block_stats(members).collect()}
    assert stats == {"red": (2, 2), "apple": (3, 6)}
    full = members.join(blocking.block_stats(members), "block_key")
    pairs = graph.pairs(full)
    assert {(r.p1, r.p2): r.cbs for r in pairs.collect()} == {(0, 1): 2, (0, 2): 1, (1, 2): 1}
    js = {(r.p1, r.p2): r.weight for r in graph.weighted(pairs, full, "js").collect()}
    assert js[0, 1] == 1.0 and js[0, 2] == 0.5
    edges = graph.weighted(pairs, full, "js")
    assert [(r.p1, r.p2) for r in graph.wep(edges).collect()] == [(0, 1)]
    assert graph.cnp(edges, 1, "and").count() <= graph.cnp(edges, 1, "or").count() <= edges.count()


def test_two_sources_count_only_pairs_across(spark):
    rows = [(0, 0, "a b"), (1, 0, "a"), (2, 1, "a c"), (3, 1, "c")]
    members = blocking.blocks_by_key(spark.createDataFrame(rows, "profile_id long, source_id int, text string"), X.tokens(F.col("text")))
    stats = blocking.block_stats(members, clean=True)
    assert [(r.block_key, r.comparisons) for r in stats.collect()] == [("a", 2)]
    assert {(r.p1, r.p2) for r in graph.pairs(members.join(stats, "block_key"), clean=True).collect()} == {(0, 2), (1, 2)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "p1 long, p2 long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(edges.limit(0)).count() == 0


def test_joins_against_brute_force(spark):
    names = ["martha", "marhta", "jon", "john", "jo", "a", "", "ab", "martina", "marta", "abcd", "abdc"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, s string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for most in (1, 2):
        want = {(i, j) for i, j in combinations(range(len(names)), 2) if lev(names[i], names[j]) <= most}
        assert {(r.p1, r.p2) for r in simjoin.edit_distance_join(rows, F.col("s"), most, "id").collect()} == want
    texts = ["a b c", "a b d", "a b c d", "x y", "x y", "", None, "z"]
    sets = [set((t or "").split()) for t in texts]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    got = simjoin.set_similarity_join(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), X.tokens(F.col("t")), 0.5, "id")
    assert {(r.p1, r.p2) for r in got.collect()} == want


def test_alignment_and_loaders(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), (None, "x")], "a string, b string")
    got = rows.select(S.jaro(F.col("a"), F.col("b")), S.jaro_winkler(F.col("a"), F.col("b")), S.smith_waterman(F.col("a"), F.col("b"))).collect()
    assert round(got[0][0], 4) == 0.9444 and round(got[0][1], 4) == 0.9611 and round(got[1][0], 4) == 0.7667 and got[2][0] != got[2][0]
    bag = loaders.as_profiles(spark.createDataFrame([("1 ", "x", None, ["p", "q"])], "ID string, a string, b string, c array<string>"), "id")
    assert [(a.key, a.value) for a in bag.first().attributes] == [("a", "x"), ("c", "p"), ("c", "q")] and bag.first().original_id == "1"


def test_clusterings_partition_the_nodes(spark):
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7), (10, 11, 0.9), (10, 12, 0.9), (10, 13, 0.6)], "p1 long, p2 long, weight double")
    for f in (clustering.center_clusters, clustering.merge_center_clusters, clustering.markov_clusters, clustering.ricochet_clusters, clustering.cut_clusters):
        assert sorted(r.profile_id for r in f(edges, 0.1).collect()) == [0, 1, 2, 3, 10, 11, 12, 13]
    assert sorted(r.profile_id for r in clustering.unique_mapping_clusters(edges, 0.1).collect()) == [0, 1, 2, 3, 10, 11]


def test_auc(spark):
    ranked = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "position long, hit int")
    assert {r.level: round(r.auc, 6) for r in progressive.recall_auc(ranked, 2, (1, 2)).collect()} == {1: round(2 / 2 / 3, 6), 2: round((4 + 2) / 2 / 5, 6)}


def test_extended_ngrams_against_combinations(spark):
    texts = ["a", "abc", "abcdefg", "qwertyuiopasdfghjklzxcv", "abcabcabcabcabcabcabcabcabc", "", None, "ab abcd"]

    def want(text):
        out = set()
        for t in set((text or "").split()):
            grams = [t[i : i + 3] for i in range(len(t) - 2)] or [t]
            least = len(grams) * 95 // 100
            out |= {"".join(c) for k in range(max(1, least), len(grams) + 1) for c in combinations(grams, k)}
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", X.extended_ngrams(F.col("t")).alias("g"))
    assert {r.id: set(r.g) for r in rows.collect()} == {i: want(t) for i, t in enumerate(texts)}


def bags(spark):
    names = [f"name{i}" for i in range(40)]
    left = [(i, 0, [("title", n), ("year", str(1990 + i % 5))]) for i, n in enumerate(names)]
    right = [(100 + i, 1, [("name", n), ("when", str(1990 + i % 5)), ("title", f"other{i}")]) for i, n in enumerate(names)]
    return spark.createDataFrame(left + right, f"profile_id long, source_id int, attributes {loaders.ATTRIBUTES}")


def test_attributes_cluster_across_sources(spark):
    found = attributes.cluster_attributes(bags(spark)).collect()
    by = {(r.source_id, r.key): r.cluster_id for r in found}
    assert by[0, "title"] == by[1, "name"] >= 0 and by[0, "year"] == by[1, "when"] >= 0 and by[0, "title"] != by[0, "year"] and by[1, "title"] == -1
    entropy = {(r.source_id, r.key): r.entropy for r in found}
    assert abs(entropy[0, "year"] - 2.321928) < 1e-6 and abs(entropy[1, "title"] - 5.321928) < 1e-6
    blocks = blocking.cluster_blocks(bags(spark), attributes.cluster_attributes(bags(spark)), X.words)
    assert {r.block_key for r in blocks.where("block_key like 'other3\\_%'").collect()} == {"other3_-1"}
    assert {r.profile_id for r in blocks.where(F.col("block_key") == f"name3_{by[0, 'title']}").collect()} == {3, 103}
    kept = blocking.cluster_blocks(bags(spark), attributes.cluster_attributes(bags(spark)), X.words, drop_default=True)
    assert kept.count() == blocks.where("block_key not like '%\\_-1'").count() < blocks.count()
    assert attributes.cluster_attributes(bags(spark).limit(0)).count() == 0


def test_columns_are_selected(spark):
    rows = spark.createDataFrame([(i, f"rare{i}", "same", None if i else "x") for i in range(10)], "id long, a string, b string, c string")
    assert [r.name for r in attributes.select_columns(rows, ["a", "b", "c"], "id", 1).collect()] == ["a"]
    assert {r.name: round(r.null_rate, 6) for r in attributes.column_scores(rows, ["a", "b", "c"], "id").collect()} == {"a": 0.0, "b": 0.0, "c": 0.9}


def test_sweep_and_classifier(spark):
    rows = [(i, i + 100, i / 20, int(i > 9)) for i in range(20)] + [(90, 91, None, 1)]
    scored = spark.createDataFrame(rows, "p1 long, p2 long, p_match double, is_match int")
    for r in graph.threshold_sweep(scored).collect():
        kept = [x for x in rows if x[2] is not None and x[2] >= r.threshold]
        assert (r.retained, r.matches) == (len(kept), sum(x[3] for x in kept)) and r.recall == r.matches / 11
    assert graph.threshold_sweep(scored.limit(0)).agg(F.sum("retained")).first()[0] == 0
    edges = scored.withColumnRenamed("p_match", "js").where("js is not null")
    assert all(r.pred == r.is_match and (r.p_match >= 0.5) == bool(r.pred) for r in graph.match_probabilities(edges, edges, ("js",)).collect())


def test_cut_and_ricochet_part_two_cliques(spark):
    cliques = [(a + k, b + k, 1.0) for k in (0, 10) for a, b in combinations(range(4), 2)]
    edges = spark.createDataFrame([*cliques, (3, 10, 0.2)], "p1 long, p2 long, weight double")
    for f in (clustering.cut_clusters, clustering.ricochet_clusters):
        groups = {}
        for r in f(edges, 0.1).collect():
            groups.setdefault(r.cluster_id, set()).add(r.profile_id)
        assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]


def test_augmentation(spark):
    texts = ["a bb ccc dd e f", "x", "", None, "- a - b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.when(F.col("t").isNotNull(), F.filter(F.split("t", " "), lambda x: x != "")).alias("w"))
    of = lambda op, seed=7: {r.id: r.o for r in rows.select("id", A.augment(F.col("w"), op, seed).alias("o")).collect()}
    before = {r.id: r.w for r in rows.collect()}
    for seed in range(5):
        assert len(of("del", seed)[0]) in (4, 5) and len(of("ins", seed)[0]) == 7 and of("drop_same", seed)[1] == []
        assert {i: sorted(w or []) for i, w in of("swap", seed).items()} == {i: sorted(w or []) for i, w in before.items()}
        lengths = {len(x) for x in of("drop_len", seed)[0]}
        assert len({1, 2, 3} - lengths) == 1
    assert of("drop_sym")[4] == ["a", "b"] and set(of("drop_token")[0]) <= set(before[0])
    assert all(of(o)[2] == [] and of(o)[3] is None for o in ("del", "swap", "drop_len", "drop_sym", "drop_same", "drop_token", "ins"))
    bag = bags(spark).where("profile_id = 100").select(A.augment_attributes(F.col("attributes"), "drop_col").alias("d"), A.augment_attributes(F.col("attributes"), "append_col").alias("p")).first()
    words = sorted(w for a in bag.p for w in a.value.split())
    assert len(bag.d) == len(bag.p) == 2 and words == ["1990", "name0", "other0"]


def test_feature_sets():
    sets = dict(evaluation.feature_sets())
    assert len(sets) == 255 and sets[1] == ("cfibf",) and len(sets[255]) == 9
    assert sets[78] == ("cfibf", "raccb", "rs", "nrs") and sets[128] == ("cfibf", "raccb", "js", "numCompP1", "numCompP2")


def test_measures(spark):
    pairs = lambda *rows: spark.createDataFrame(list(rows), "p1 long, p2 long, cbs long")
    found, truth = pairs((0, 1, 3), (0, 1, 3), (2, 3, 1), (0, 3, 1)), pairs((0, 1, 0), (2, 4, 0))
    people = spark.createDataFrame([(i, i % 2) for i in range(5)], "profile_id long, source_id int")
    one = evaluation.blocking_quality(found, truth, people).first()
    assert [round(x, 6) for x in one] == [0.7, 0.5, 0.333333, 0.4, 0.583333]
    assert round(evaluation.blocking_quality(found, truth, people, clean=True).first().reduction, 6) == 0.5
    assert list(evaluation.blocking_quality(found.limit(0), truth.limit(0), people.limit(0)).first()) == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert {r.CBS: r.cnt for r in evaluation.cbs_histogram(found.distinct(), truth).collect()} == {3: 1, 0: 1}
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)], "profile_id long, cluster_id long")
    assert list(evaluation.cluster_quality(clusters, truth).first()) == [2, 4, 2, 1.0, 0.5]
    assert list(evaluation.cluster_quality(clusters.limit(0), truth).first()) == [0, 0, 2, 0.0, 0.0]


def test_matched_and_split(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (4, 5)], "p1 long, p2 long")
    assert [(r.p1, r.p2, r.weight) for r in evaluation.matched(pairs, tiny(spark), X.tokens(F.col("text")), 0.5).collect()] == [(0, 1, 0.5)]
    edges = spark.createDataFrame([(i, i + 1, int(i % 4 == 0)) for i in range(40)], "p1 long, p2 long, is_match int")
    split = evaluation.balanced_split(edges, 12)
    assert split.count() == 40 and {(r.is_match, r["count"]) for r in split.where("train").groupBy("is_match").count().collect()} == {(0, 6), (1, 6)}
    assert sorted(split.where("train").collect()) == sorted(evaluation.balanced_split(edges.repartition(3), 12).where("train").collect())
