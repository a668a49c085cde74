"""The text index, statistics, positions and loaders on small fixtures."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.operators import blocking, graph, progressive, simjoin, statistics, textindex
from kinloom.plans import lineage
from kinloom.sources import loaders


def test_extended_ngrams_leave_out_as_many_as_asked(spark):
    r = random.Random(1)
    for length in (1, 3, 5, 22, 24, 43, 45):
        token = "".join(r.choice("abcdefgh") for _ in range(length))
        grams = [token[i : i + 3] for i in range(max(1, length - 2))]
        n = len(grams)
        sizes = range(max(1, n * 95 // 100), n + 1)
        want = {"".join(c) for k in sizes for c in combinations(grams, k)}
        got = spark.createDataFrame([(token,)], "t string").select(X.extended_ngrams(F.col("t")).alias("x")).first().x
        assert set(got) == want and len(got) == len(set(got)), (length, n)
    got = spark.createDataFrame([("ab" * 25,)], "t string").select(F.size(X.extended_ngrams(F.col("t"), 3, 1)).alias("n")).first().n
    assert got <= 49


def test_positions_follow_the_order(spark):
    r = random.Random(2)
    rows = [(r.choice(["same prefix a", "same prefix b", None, ""]), r.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n long, _0 long").repartition(7)
    got = [(x.k, x.n, x._0) for x in blocking.global_position(df, [F.asc_nulls_first("k"), F.desc("n"), F.col("_0")]).orderBy("position").collect()]
    assert got == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1], x[2]))
    assert blocking.global_position(df.limit(0), ["k"]).columns == ["k", "n", "_0", "position"] and blocking.global_position(df.limit(0), ["k"]).count() == 0


def test_heaviest_edges_and_ties(spark):
    rows = [(i, i + 100, float(i % 3)) for i in range(60)]
    edges = spark.createDataFrame(rows, "p1 long, p2 long, weight double")
    want = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))[:25]
    assert sorted(tuple(x) for x in graph.cep(edges, 25).collect()) == sorted(want) and graph.cep(edges, 0).count() == 0
    first = progressive.profile_schedule(edges).where("phase = 1").count()
    assert first == 60


def test_blocks_of_profiles_in_several_rows(spark):
    rows = spark.createDataFrame([(1, 0, "a b a"), (1, 0, "b c"), (2, 0, "b")], "profile_id long, source_id int, text string")
    keys = X.words(F.col("text"))
    assert Counter(blocking.blocks_by_key(rows, keys).select("block_key", "profile_id").collect()) == Counter([("a", 1), ("b", 1), ("b", 1), ("c", 1), ("b", 2)])
    assert blocking.blocks_by_key(rows, keys, unique=False).count() == 4


def test_index_configuration_and_specs(spark):
    config = textindex.IndexConfig().add("name", ("standard", "3gram")).add("all", ("standard",), ("name", "place"))
    assert textindex.IndexConfig.from_json(config.to_json()) == config and config.remove("all").analysed() == [("name", "standard"), ("name", "3gram")]
    with pytest.raises(ValueError):
        config.add("x", ("none",))
    full, cross = textindex.full_spec(config), textindex.full_spec(config, cross=True)
    assert len(full.clauses) == 3 and len(cross.clauses) == 6 and full.is_subset(cross) and full.union(cross).clauses == cross.clauses
    rows = spark.createDataFrame([(1, "red car", "rome"), (2, "red bus", "oslo"), (3, None, None), (4, "", "rome")], "id long, name string, place string")
    index = textindex.analysed(rows, "id", config)
    assert textindex.num_indexed(index).first().n == 3
    best = textindex.search(index, index.where("id = 1"), full, 1).collect()
    assert [(x.query_id, x.id, x.rank) for x in best] == [(1, 1, 1)]
    needed = textindex.QuerySpec(frozenset({("all", "all", "standard")}), (), frozenset({("name", "name", "standard")}))
    assert {x.id for x in textindex.scored(index, index.where("id = 1"), needed).collect()} == {1, 2}
    assert {x.id for x in textindex.scored(index, index.where("id = 1"), textindex.QuerySpec(needed.clauses)).collect()} == {1, 2, 4}
    assert textindex.search(index, index.limit(0), full, 3).count() == 0


def test_statistics_on_odd_tables(spark):
    none = spark.createDataFrame([], "p1 long, p2 long, similarity double")
    ids = spark.createDataFrame([(1,)], "profile_id long")
    assert tuple(statistics.candidate_statistics(none, none, ids, ids).first()) == (0.0, 0.0, 0.0, 0)
    assert statistics.pseudo_labels(none, 3, 3).count() == 0
    texts = spark.createDataFrame([(1, "a b c d"), (2, None), (3, ""), (4, "e f")], "id long, text string")
    pairs = statistics.synthetic_pairs(texts, "id", F.col("text"), copies=3).collect()
    assert Counter((x.id, x.label) for x in pairs) == Counter({(1, 1): 3, (4, 1): 3, (1, 0): 1, (4, 0): 1})
    assert all(x.other in ("a b c d", "e f") and x.other != x.text for x in pairs if x.label == 0)
    assert statistics.synthetic_pairs(texts.limit(1), "id", F.col("text"), copies=2).count() == 2
    wide = spark.createDataFrame([(1, " A ", None, 2)], "id int, `a.b` string, `a:b` string, ab int")
    assert statistics.plain_names(wide).columns == ["id", "ab", "ab2", "ab3"]
    assert statistics.one_text(wide, "id", lower=True).first().text == "a 2"
    with pytest.raises(ValueError):
        statistics.natural_merge(texts, wide.select("ab"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    post = simjoin.postings(texts, X.words(F.col("text")), "id")
    weights = statistics.sif_weights(post).withColumn("weight", F.lit(1.0))
    assert [tuple(x) for x in statistics.weighted_mean_vectors(post, weights, vectors).collect()] == [(1, [0.5, 0.5])]


def test_loaders_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in ({"id": "1", "name": "x", "tags": ["p", None, "q"], "place": {"city": "rome"}}, {"id": " 2 ", "name": None})))
    rows = {x.original_id: [(a.key, a.value) for a in x.attributes] for x in loaders.load_json_profiles(spark, f"{tmp_path}/a.json", "id").collect()}
    assert sorted(rows["1"]) == [("city", "rome"), ("name", "x"), ("tags", "p"), ("tags", "q")] and rows["2"] == []
    (tmp_path / "b.csv").write_text('id;name\n1;"a;b"\n2;\n')
    rows = {x.original_id: [(a.key, a.value) for a in x.attributes] for x in loaders.load_csv_profiles(spark, f"{tmp_path}/b.csv", "id", separator=";").collect()}
    assert rows == {"1": [("name", "a;b")], "2": []}
    left, right = loaders.load_json_profiles(spark, f"{tmp_path}/a.json", "id"), loaders.load_csv_profiles(spark, f"{tmp_path}/b.csv", "id", 1, ";")
    truth = loaders.load_groundtruth(spark.createDataFrame([(1, "1"), (2, "9"), (2, "2"), (2, "2")], "a int, b string"), "a", "b")
    assert loaders.convert_groundtruth(truth, left, right).count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://x:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(session)
