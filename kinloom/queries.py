"""The library's queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import augment as A
from kinloom.functions import similarity as S
from kinloom.functions import text as X
from kinloom.operators import attributes, blocking, clustering, communities, evaluation, graph, learning, progressive, simjoin, statistics, textindex
from kinloom.plans.lineage import cut
from kinloom.sources import loaders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than half of the cores, dealt to all; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("profile_id"), F.lit(0).alias("source_id"), "text")


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000_000).alias("profile_id"), F.lit(1).alias("source_id"), "text")
    return profiles(spark, sf_dir).unionByName(items)


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
MEMBERS = f"m AS (SELECT DISTINCT doc_id AS profile_id, unnest({TOKENS}) AS block_key FROM documents)"
BLOCKS = "b AS (SELECT block_key, count(*) AS size, count(*) * (count(*) - 1) AS comparisons FROM m GROUP BY 1 HAVING count(*) > 1)"
LEVEL = """lv AS (SELECT comparisons, sum(comparisons) AS c, sum(size) AS s FROM b GROUP BY 1),
cu AS (SELECT comparisons, sum(c) OVER w AS cc, sum(s) OVER w AS bc, row_number() OVER w AS rank0 FROM lv WINDOW w AS (ORDER BY comparisons)),
nx AS (SELECT *, lead(comparisons) OVER w AS nc, lead(cc) OVER w AS ncc, lead(bc) OVER w AS nbc FROM cu WINDOW w AS (ORDER BY comparisons)),
lim AS (SELECT coalesce(max(nc) FILTER (WHERE bc::DOUBLE * ncc < 1.0 * cc::DOUBLE * nbc), max(comparisons) FILTER (WHERE rank0 = 2)) AS level FROM nx)"""
FILTERED = """pu AS (SELECT m.profile_id, b.* FROM m JOIN b USING (block_key) JOIN lim ON b.comparisons <= lim.level),
rk AS (SELECT *, count(*) OVER (PARTITION BY profile_id) AS n, row_number() OVER (PARTITION BY profile_id ORDER BY comparisons, block_key) AS rn FROM pu),
li AS (SELECT *, max(CASE WHEN rn = greatest(1, CAST(round_even(n * 0.8::DOUBLE, 0) AS INT)) THEN comparisons END) OVER (PARTITION BY profile_id) AS lim FROM rk),
k AS (SELECT block_key, profile_id FROM li WHERE comparisons <= lim),
kb AS (SELECT block_key, count(*) AS size, count(*) * (count(*) - 1) AS comparisons FROM k GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT k.profile_id, kb.* FROM k JOIN kb USING (block_key))"""
PAIRS = """e AS (SELECT x.profile_id AS p1, y.profile_id AS p2, count(*) AS cbs, sum(1.0::DOUBLE / x.comparisons) AS raccb, sum(1.0::DOUBLE / x.size) AS rs
FROM f x JOIN f y ON x.block_key = y.block_key AND x.profile_id < y.profile_id GROUP BY 1, 2)"""
NODES = """nd AS (SELECT profile_id, count(*) AS blocks, sum(1.0::DOUBLE / size) AS inv_size, sum(1.0::DOUBLE / comparisons) AS inv_comparisons, sum(comparisons) AS comparisons, sum(size - 1) AS redundant FROM f GROUP BY 1),
dg AS (SELECT profile_id, count(*) AS degree FROM (SELECT p1 AS profile_id FROM e UNION ALL SELECT p2 FROM e) GROUP BY 1),
tt AS (SELECT count(DISTINCT block_key)::DOUBLE AS b_all FROM f), et AS (SELECT count(*)::DOUBLE AS e_all FROM e),
j AS (SELECT e.*, a.blocks::DOUBLE AS bi, b.blocks::DOUBLE AS bj, cbs::DOUBLE AS c, tt.b_all AS bb, et.e_all AS ea, da.degree AS d1, db.degree AS d2,
 a.inv_size AS is1, b.inv_size AS is2, a.inv_comparisons AS ic1, b.inv_comparisons AS ic2, a.comparisons AS c1, b.comparisons AS c2, a.redundant AS r1, b.redundant AS r2
 FROM e JOIN nd a ON e.p1 = a.profile_id JOIN nd b ON e.p2 = b.profile_id JOIN dg da ON e.p1 = da.profile_id JOIN dg db ON e.p2 = db.profile_id, tt, et)"""
CORE = f"WITH {MEMBERS}, {BLOCKS}, {LEVEL}, {FILTERED}, {PAIRS}"
WEIGHTS = {
    "cbs": "c", "js": "c / (bi + bj - c)", "ecbs": "c * log10(bb / bi) * log10(bb / bj)", "arcs": "raccb",
    "ejs": "c / (bi + bj - c) * log10(ea / d1) * log10(ea / d2)",
    "chi2": "pow(c - bj * bi / bb, 2) / (bj * bi / bb) + coalesce(pow(bj - c - bj * (bb - bi) / bb, 2) / nullif(bj * (bb - bi) / bb, 0), 0) + coalesce(pow(bi - c - (bb - bj) * bi / bb, 2) / nullif((bb - bj) * bi / bb, 0), 0) + coalesce(pow(bb - (bi + bj - c) - (bb - bj) * (bb - bi) / bb, 2) / nullif((bb - bj) * (bb - bi) / bb, 0), 0)",
}
JS = f"{CORE}, {NODES}, w AS (SELECT p1, p2, round(c / (bi + bj - c), 9) AS weight FROM j)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(blocking.clean_blocks(profiles(spark, sf_dir), X.tokens(F.col("text"))))


def js_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = members(spark, sf_dir)
    return cut(graph.weighted(graph.pairs(own), own, "js").withColumn("weight", F.round("weight", 9)))


# tokenisers ----------------------------------------------------------------------------------------------------------


def _tokenised(name: str, keys: Callable[[Column], Column], sql: str, source: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return rows.select(F.col(id_col).alias("id"), F.explode(keys(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    text = sql.replace("text", text_col) if text_col != "text" else sql
    QUERIES[name] = run
    SQL[name] = f"SELECT token, count(*) AS n FROM (SELECT {id_col} AS id, unnest({text}) AS token FROM {source}) GROUP BY 1"


_tokenised("tokens", X.tokens, f"list_distinct({TOKENS})")
_tokenised("ngrams_padded", X.ngrams, f"list_distinct(flatten(list_transform(list_distinct({TOKENS}), lambda t: list_transform(range(1, len(t) + 3), lambda i: substr('__' || t || '__', i, 3)))))", "part", "p_partkey", "p_name")
_tokenised("ngrams_plain", lambda t: X.ngrams(t, 3, False), f"list_distinct(flatten(list_transform(list_distinct({TOKENS}), lambda t: CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)) END)))")
_PLAIN = "CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)) END"
_tokenised("extended_ngrams", X.extended_ngrams, f"list_distinct(flatten(list_transform(list_transform(list_distinct({TOKENS}), lambda t: {_PLAIN}), lambda g: list_append(CASE WHEN len(g) > 1 THEN list_transform(range(1, len(g) + 1), lambda i: array_to_string(list_filter(g, lambda x, k: k <> i), '')) ELSE []::VARCHAR[] END, array_to_string(g, '')))))", "part", "p_partkey", "p_name")
_tokenised("suffixes", X.suffixes, f"list_distinct(flatten(list_transform(list_distinct({TOKENS}), lambda t: CASE WHEN len(t) < 2 THEN [t] ELSE list_transform(range(1, len(t)), lambda i: substr(t, i)) END)))")
_tokenised("extended_suffixes", X.extended_suffixes, f"list_distinct(list_filter(flatten(list_transform(list_distinct({TOKENS}), lambda t: list_append(flatten(list_transform(range(1, greatest(len(t), 2)), lambda i: list_transform(range(2, greatest(len(t) - i + 2, 3)), lambda n: substr(t, i, n)))), t))), lambda s: s <> ''))", "part", "p_partkey", "p_name")
_tokenised("tokens_underscore", lambda t: X.tokens(t, separator=X.WORD_OR_UNDERSCORE), f"list_distinct({TOKENS.replace('_]', ']')})", "customer", "c_custkey", "c_name")
_tokenised("word_bigrams", lambda t: X.word_shingles(t, 2, 2), f"list_transform(range(1, len({TOKENS})), lambda i: ({TOKENS})[i] || ' ' || ({TOKENS})[i + 1])", "benchmark", "item_id")
_tokenised("plain_words", X.plain_words, f"list_filter(list_distinct({TOKENS}), lambda t: regexp_matches(t, '^([A-Za-z]+|[0-9]+)$'))")
_tokenised("edge_ngrams", X.edge_ngrams, f"flatten(list_transform({TOKENS}, lambda t: list_transform(range(3, least(6, greatest(len(t), 3)) + 1), lambda n: substr(t, 1, n))))", "part", "p_partkey", "p_name")

for _name in ("del", "swap", "drop_len", "drop_sym", "drop_same", "drop_token", "ins"):
    QUERIES[f"augment_{_name}"] = lambda spark, sf_dir, o=_name: table(spark, sf_dir, "benchmark").select("item_id", F.array_join(A.augment(X.words(F.col("text")), o), " ").alias("text"))

# attributes ----------------------------------------------------------------------------------------------------------

PART_COLUMNS = ["p_name", "p_brand", "p_type"]
LONG = "l AS (SELECT p_partkey AS id, name, list_filter(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (value FOR name IN (p_name, p_brand, p_type)))"


@query(f"WITH {LONG}, t AS (SELECT name AS key, token, count(*)::DOUBLE AS n FROM (SELECT name, unnest(w) AS token FROM l) GROUP BY 1, 2) SELECT 0 AS source_id, key, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) + 1e-10, 6) AS entropy FROM t GROUP BY 2")
def attribute_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of the tokens of three columns of parts."""
    bags = loaders.as_profiles(table(spark, sf_dir, "part"), "p_partkey", keep=tuple(PART_COLUMNS))
    return rounded(attributes.attribute_entropy(attributes.attribute_tokens(bags)))


@query(f"""WITH {LONG}, s AS (SELECT name, count(*)::DOUBLE AS n, sum(len(w)) / count(*) AS avgdl FROM l WHERE len(w) > 0 GROUP BY 1), r AS (SELECT count(*)::DOUBLE AS n_all FROM part),
f AS (SELECT name, id, len(w)::DOUBLE AS dl, token, count(*)::DOUBLE AS tf FROM (SELECT *, unnest(w) AS token FROM l) GROUP BY ALL), d AS (SELECT name, token, count(*)::DOUBLE AS df FROM f GROUP BY 1, 2)
SELECT name, round(1 - any_value(n) / any_value(n_all) + 1e-10, 6) AS null_rate, round(any_value(avgdl) + 1e-10, 6) AS mean_words, round(sum(ln((n + 0.5 - df) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) / dl) / any_value(n) + 1e-10, 6) AS mean_score FROM f JOIN d USING (name, token) JOIN s USING (name), r GROUP BY 1""")
def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rate, mean words and mean BM25 of three columns' values against themselves."""
    return rounded(attributes.column_scores(table(spark, sf_dir, "part"), PART_COLUMNS, "p_partkey"))


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, shops = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return loaders.as_profiles(people, "c_custkey", 0).unionByName(loaders.as_profiles(shops, "s_suppkey", 1))


@query()
def attribute_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of customers and suppliers with alike tokens, and their mean entropy."""
    return rounded(attributes.cluster_attributes(_bags(spark, sf_dir), threshold=0.1))


@query()
def clustered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of token blocks kept apart by attribute cluster."""
    bags = _bags(spark, sf_dir)
    rows = blocking.cluster_blocks(bags, attributes.cluster_attributes(bags, threshold=0.1), X.words)
    return blocking.block_stats(rows.select("block_key", "profile_id", "source_id").distinct(), clean=True)


# blocking and cleaning -----------------------------------------------------------------------------------------------


@query(f"WITH {MEMBERS}, {BLOCKS} SELECT block_key, size, comparisons FROM b")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of token blocking, one source."""
    return blocking.block_stats(blocking.blocks_by_key(profiles(spark, sf_dir), X.tokens(F.col("text"))))


TWO = f"""WITH d AS (SELECT doc_id AS profile_id, 0 AS source_id, text FROM documents UNION ALL SELECT item_id + 1000000000000, 1, text FROM benchmark),
m AS (SELECT DISTINCT profile_id, source_id, unnest({TOKENS}) AS block_key FROM d)"""


@query(f"{TWO}, s AS (SELECT block_key, count(*) AS size, count(*) FILTER (WHERE source_id = 0) * count(*) FILTER (WHERE source_id = 1) AS comparisons FROM m GROUP BY 1) SELECT * FROM s WHERE comparisons > 0")
def token_blocks_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of token blocking between documents and benchmark items."""
    return blocking.block_stats(blocking.blocks_by_key(two_sources(spark, sf_dir), X.tokens(F.col("text"))), clean=True)


@query(f"WITH {MEMBERS}, {BLOCKS}, {LEVEL} SELECT level FROM lim")
def purge_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of the largest blocks that purging leaves."""
    return blocking.purge_level(token_blocks(spark, sf_dir))


@query(f"WITH {MEMBERS}, {BLOCKS}, {LEVEL}, {FILTERED} SELECT profile_id, block_key, size, comparisons FROM f")
def cleaned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership after purging and filtering."""
    return members(spark, sf_dir).select("profile_id", "block_key", "size", "comparisons")


@query("""WITH k AS (SELECT DISTINCT c_custkey AS profile_id, c_mktsegment AS block_key FROM customer), o AS (SELECT profile_id, row_number() OVER (ORDER BY block_key, profile_id) - 1 AS pos FROM k),
s AS (SELECT DISTINCT unnest(range(greatest(pos - 2, 0), pos + 1)) AS block_id, profile_id FROM o) SELECT block_id, profile_id FROM s WHERE block_id IN (SELECT block_id FROM s GROUP BY 1 HAVING count(*) > 1)""")
def sorted_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three customers in the order of segment and key."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("block_key"), F.col("c_custkey").alias("profile_id"), F.lit(0).alias("source_id"))
    return blocking.sorted_neighbourhood(keys, 3).select("block_id", "profile_id")


@query()
def lsh_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents by equal MinHash bands."""
    return blocking.block_stats(blocking.lsh_blocks(profiles(spark, sf_dir), X.tokens(F.col("text")), 32, 0.6))


@query("SELECT page_id::VARCHAR AS original_id, k AS key, v AS value FROM (SELECT page_id, unnest(['url', 'html']) AS k, unnest([url, html]) AS v FROM pages) WHERE v IS NOT NULL")
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bags of attributes."""
    return loaders.as_profiles(table(spark, sf_dir, "pages"), "page_id").select("original_id", F.explode("attributes").alias("a")).select("original_id", "a.key", "a.value")


# the graph -----------------------------------------------------------------------------------------------------------


@query(f"{CORE} SELECT p1, p2, cbs, round(raccb, 9) AS raccb, round(rs, 9) AS rs FROM e")
def pairs_cbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with common blocks."""
    return graph.pairs(members(spark, sf_dir)).select("p1", "p2", "cbs", F.round("raccb", 9).alias("raccb"), F.round("rs", 9).alias("rs"))


def _weights(scheme: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = members(spark, sf_dir)
        edges = cut(graph.pairs(own)) if scheme == "ejs" else graph.pairs(own)
        return graph.weighted(edges, own, scheme).withColumn("weight", F.round("weight", 6))

    QUERIES[f"weights_{scheme}"] = run
    SQL[f"weights_{scheme}"] = f"{CORE}, {NODES} SELECT p1, p2, round({WEIGHTS[scheme]}, 6) AS weight FROM j"


for _scheme in WEIGHTS:
    _weights(_scheme)


@query(f"{JS} SELECT * FROM w WHERE weight >= (SELECT avg(weight) FROM w)")
def wep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edge pruning."""
    return graph.wep(js_edges(spark, sf_dir))


TH = "t AS (SELECT n, avg(weight) AS a, max(weight) / 2 AS h FROM (SELECT p1 AS n, weight FROM w UNION ALL SELECT p2, weight FROM w) GROUP BY 1)"


@query(f"{JS}, {TH} SELECT w.* FROM w JOIN t x ON p1 = x.n JOIN t y ON p2 = y.n WHERE weight >= x.h OR weight >= y.h")
def wnp_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted node pruning by half of either end's maximum."""
    return graph.wnp(js_edges(spark, sf_dir), "or", "max")


@query(f"{JS}, {TH} SELECT w.* FROM w JOIN t x ON p1 = x.n JOIN t y ON p2 = y.n WHERE weight >= x.h AND weight >= y.h")
def wnp_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted node pruning by half of both ends' maxima."""
    return graph.wnp(js_edges(spark, sf_dir), "and", "max")


CARDINALITY = "kc AS (SELECT count(*) // 2 AS cep_k, greatest(1, CAST(floor(count(*) / count(DISTINCT profile_id) - 1) AS BIGINT)) AS cnp_k FROM f)"


def _bounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Edges, and the bounds that their blocks set to the number kept in all and for each node."""
    own = members(spark, sf_dir)
    bound = graph.cardinality(own).first()
    return graph.weighted(graph.pairs(own), own, "js").withColumn("weight", F.round("weight", 9)), bound["cep_k"], bound["cnp_k"]


@query(f"{JS}, {CARDINALITY} SELECT p1, p2, weight FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, p1, p2) AS rn FROM w), kc WHERE rn <= cep_k")
def cep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edges, half as many as the blocks have places."""
    edges, keep, _ = _bounded(spark, sf_dir)
    return graph.cep(edges, keep)


TOPK = "r AS (SELECT n, o, weight, p1, p2, row_number() OVER (PARTITION BY n ORDER BY weight DESC, o) AS rn FROM (SELECT p1 AS n, p2 AS o, * FROM w UNION ALL SELECT p2, p1, * FROM w))"


@query(f"{JS}, {CARDINALITY}, {TOPK} SELECT p1, p2, any_value(weight) AS weight FROM r, kc WHERE rn <= cnp_k GROUP BY 1, 2")
def cnp_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the heaviest of either end, as many as a profile has blocks less one."""
    edges, _, k = _bounded(spark, sf_dir)
    return graph.cnp(cut(edges), k)


@query(f"{JS}, {CARDINALITY}, {TOPK} SELECT p1, p2, any_value(weight) AS weight FROM r, kc WHERE rn <= cnp_k GROUP BY 1, 2 HAVING count(*) = 2")
def cnp_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the heaviest of both ends, as many as a profile has blocks less one."""
    edges, _, k = _bounded(spark, sf_dir)
    return graph.cnp(cut(edges), k, "and")


FEATURES = f"""{CORE}, {NODES}, ca AS (SELECT sum(comparisons)::DOUBLE AS c_all FROM kb),
ft AS (SELECT p1, p2, round(c * ln(bb / bi) * ln(bb / bj) + 1e-10, 6) AS cfibf, round(greatest(raccb, 1e-6) + 1e-10, 6) AS raccb, round(c / nullif(r1 + r2 - c, 0) + 1e-10, 6) AS js, d1 AS numCompP1, d2 AS numCompP2, round(rs + 1e-10, 6) AS rs,
 round(c / (bi + bj - c) * ln(c_all / c1) * ln(c_all / c2) + 1e-10, 6) AS aejs, round(rs / nullif(is1 + is2 - rs, 0) + 1e-10, 6) AS nrs, round(raccb / nullif(ic1 + ic2 - raccb, 0) + 1e-10, 6) AS wjs FROM j, ca)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c) + 1e-10, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"{FEATURES} SELECT * FROM ft")
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine features of every edge."""
    own = members(spark, sf_dir)
    return rounded(graph.features(cut(graph.pairs(own)), own))


SCORED = "s AS (SELECT l_partkey AS p1, l_suppkey + 1000000 AS p2, round(max(l_discount) * 10, 6) AS p_match, CAST(max(l_discount) * 10 >= 0.7 AS INT) AS pred, max(CAST(l_returnflag = 'R' AS INT)) AS is_match FROM lineitem GROUP BY 1, 2), v AS (SELECT * FROM s WHERE p_match >= 0.5)"


def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of scored edges: parts and suppliers that share a line, by their largest discount."""
    d = F.max("l_discount") * 10
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p1"), (F.col("l_suppkey") + 1000000).alias("p2")).agg(F.round(d, 6).alias("p_match"), (d >= 0.7).cast("int").alias("pred"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("is_match"))


_SUPERVISED = {
    "bcl": "SELECT * FROM s WHERE pred = 1",
    "wep": "SELECT * FROM v WHERE p_match >= (SELECT avg(p_match) FROM v)",
    "wnp": "SELECT p1, p2, p_match, pred, is_match FROM (SELECT *, avg(p_match) OVER (PARTITION BY p1) AS a, avg(p_match) OVER (PARTITION BY p2) AS b FROM v) WHERE p_match >= a - 1e-12 OR p_match >= b - 1e-12",
    "rwnp": "SELECT p1, p2, p_match, pred, is_match FROM (SELECT *, avg(p_match) OVER (PARTITION BY p1) AS a, avg(p_match) OVER (PARTITION BY p2) AS b FROM v) WHERE p_match >= a - 1e-12 AND p_match >= b - 1e-12",
    "blast": "SELECT p1, p2, p_match, pred, is_match FROM (SELECT *, max(p_match) OVER (PARTITION BY p1) AS a, max(p_match) OVER (PARTITION BY p2) AS b FROM v) WHERE p_match >= 0.35::DOUBLE * (a + b)",
    "cep": "SELECT * FROM v ORDER BY p_match DESC, p1, p2 LIMIT 200",
    "cnp": "SELECT p1, p2, p_match, pred, is_match FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY p_match DESC, p2) AS a, row_number() OVER (PARTITION BY p2 ORDER BY p_match DESC, p1) AS b FROM v) WHERE a <= 3 OR b <= 3",
    "rcnp": "SELECT p1, p2, p_match, pred, is_match FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY p_match DESC, p2) AS a, row_number() OVER (PARTITION BY p2 ORDER BY p_match DESC, p1) AS b FROM v) WHERE a <= 3 AND b <= 3",
}


def _supervised(name: str, sql: str) -> None:
    QUERIES[f"supervised_{name}"] = lambda spark, sf_dir: graph.supervised(scored_edges(spark, sf_dir), name, 200 if name == "cep" else 3)
    SQL[f"supervised_{name}"] = f"WITH {SCORED} {sql}"


for _name, _sql in _SUPERVISED.items():
    _supervised(_name, _sql)


@query(f"WITH {SCORED}, r AS (SELECT count(*) FILTER (WHERE is_match = 1) AS matches, count(*) AS retained FROM s WHERE pred = 1), g AS (SELECT count(*) AS total FROM s WHERE is_match = 1) SELECT matches, retained, total, round(matches / total, 6) AS recall, round(matches / retained, 6) AS precision, round(2 * (matches / total) * (matches / retained) / (matches / total + matches / retained), 6) AS f1 FROM r, g")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 of the predicted edges."""
    edges = scored_edges(spark, sf_dir)
    return rounded(graph.quality(graph.supervised(edges, "bcl"), edges.where("is_match = 1")))


@query(f"""WITH {SCORED}, t AS (SELECT unnest(range(0, 21)) / 20::DOUBLE AS threshold), g AS (SELECT count(*) FILTER (WHERE is_match = 1) AS total FROM s),
c AS (SELECT threshold, count(p_match) AS retained, count(*) FILTER (WHERE is_match = 1 AND p_match IS NOT NULL) AS matches FROM t LEFT JOIN s ON p_match >= threshold GROUP BY 1)
SELECT round(threshold + 1e-10, 6) AS threshold, retained, matches, round(coalesce(matches / nullif(total, 0), 0) + 1e-10, 6) AS recall, round(coalesce(matches / nullif(retained, 0), 0) + 1e-10, 6) AS precision, round(coalesce(2 * matches / nullif(retained + total, 0), 0) + 1e-10, 6) AS f1 FROM c, g""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 of scored edges at 21 thresholds."""
    return rounded(graph.threshold_sweep(scored_edges(spark, sf_dir)))


@query()
def match_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities by logistic regression on all edges' features; true are edges whose token sets are alike."""
    own = members(spark, sf_dir)
    edges = graph.pairs(own)
    truth = graph.weighted(edges, own, "js").where("weight >= 0.5")
    marked = graph.features(edges, own, truth)
    return graph.match_probabilities(marked, marked)


ALIKE = f"{JS}, tr AS (SELECT p1, p2 FROM w WHERE weight >= 0.5), fd AS (SELECT p1, p2 FROM w WHERE weight >= 0.3)"


@query(f"""{ALIKE}, x AS (SELECT (SELECT count(*) FROM fd JOIN tr USING (p1, p2)) AS h, (SELECT count(*) FROM fd) AS kp, (SELECT count(*) FROM tr) AS al, (SELECT count(*) * (count(*) - 1) / 2 FROM documents) AS ps),
y AS (SELECT 1 - coalesce(kp / nullif(ps, 0), 0) AS a, coalesce(h / nullif(al, 0), 0) AS b, coalesce(h / nullif(kp, 0), 0) AS c FROM x)
SELECT round(a + 1e-10, 6) AS reduction, round(b + 1e-10, 6) AS completeness, round(c + 1e-10, 6) AS quality, round(coalesce(2 * b * c / nullif(b + c, 0), 0) + 1e-10, 6) AS f1, round(coalesce(2 * a * b / nullif(a + b, 0), 0) + 1e-10, 6) AS rm FROM y""")
def blocking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of weight 0.3 or more, against those of 0.5 or more as true."""
    edges = js_edges(spark, sf_dir)
    return rounded(evaluation.blocking_quality(edges.where("weight >= 0.3"), edges.where("weight >= 0.5"), profiles(spark, sf_dir)))


@query(f"{CORE}, dd AS (SELECT text, min(doc_id) AS a FROM documents WHERE text IS NOT NULL GROUP BY 1), tr AS (SELECT a AS p1, doc_id AS p2 FROM documents JOIN dd USING (text) WHERE doc_id > a) SELECT coalesce(cbs, 0) AS CBS, count(*) AS cnt FROM tr LEFT JOIN e USING (p1, p2) GROUP BY 1")
def cbs_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common blocks of each copy and the first document of its text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    first = docs.groupBy("h", "s").agg(F.min("doc_id").alias("p1"))
    return evaluation.cbs_histogram(graph.pairs(members(spark, sf_dir)), docs.join(first, ["h", "s"]).where("doc_id > p1").select("p1", F.col("doc_id").alias("p2")))


@query(f"WITH {SCORED}, t AS (SELECT p_match, 0.35::DOUBLE * (max(p_match) OVER (PARTITION BY p1) + max(p_match) OVER (PARTITION BY p2)) AS t FROM v) SELECT round(min(t) + 1e-10, 6) AS low, round(max(t) + 1e-10, 6) AS high, round(avg(t) + 1e-10, 6) AS mean, count(*) FILTER (WHERE p_match >= t) AS retained FROM t")
def blast_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean threshold of scored edges."""
    return rounded(evaluation.blast_thresholds(scored_edges(spark, sf_dir)))


@query("SELECT text IS NULL AS text_null, lang IS NULL AS lang_null, source IS NULL AS source_null, count(*) AS n FROM documents GROUP BY ALL")
def null_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by which columns are null."""
    return evaluation.null_patterns(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query(f"{CORE}, d AS (SELECT doc_id AS id, list_distinct({TOKENS}) AS s FROM documents), x AS (SELECT p1, p2, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS t FROM e JOIN d a ON a.id = p1 JOIN d b ON b.id = p2) SELECT p1, p2, round(c / (t - c) + 1e-10, 6) AS weight FROM x WHERE c / (t - c) >= 0.5")
def entity_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cleaned blocks whose whole token sets have a Jaccard similarity of 0.5 or more."""
    return rounded(evaluation.matched(graph.pairs(members(spark, sf_dir)), profiles(spark, sf_dir), X.tokens(F.col("text")), 0.5))


@query(f"{CORE}, {NODES}, be AS (SELECT block_key, log2(size) AS entropy FROM f GROUP BY block_key, size), ee AS (SELECT x.profile_id AS p1, y.profile_id AS p2, sum(be.entropy) AS entropy FROM f x JOIN f y ON x.block_key = y.block_key AND x.profile_id < y.profile_id JOIN be ON be.block_key = x.block_key GROUP BY 1, 2) SELECT p1, p2, round(c / (bi + bj - c) * entropy + 1e-10, 6) AS weight FROM j JOIN ee USING (p1, p2)")
def weights_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard weights times the summed entropy of the common blocks (log2 of their sizes)."""
    own = members(spark, sf_dir).withColumn("entropy", F.log2(F.col("size").cast("double")))
    return rounded(graph.weighted(graph.pairs(own), own, "js", use_entropy=True))


@query(f"WITH d AS (SELECT p_partkey AS id, p_name AS s, list_sort(list_distinct({TOKENS.replace('text', 'p_type')})) AS w FROM part) SELECT a.id AS p1, b.id AS p2 FROM d a JOIN d b ON a.id < b.id AND a.w = b.w AND len(a.w) > 0 WHERE levenshtein(a.s, b.s) <= 2")
def multi_attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one type (word sets of Jaccard 1) whose names are within two edits."""
    return simjoin.multi_attribute_join(table(spark, sf_dir, "part"), "p_partkey", {"p_type": 1.0}, {"p_name": 2})


@query()
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges with 50 training edges of each label."""
    return evaluation.balanced_split(scored_edges(spark, sf_dir), 100)


# joins ---------------------------------------------------------------------------------------------------------------


@query(f"WITH d AS (SELECT doc_id AS id, list_distinct({TOKENS}) AS s, len(list_distinct({TOKENS})) AS n FROM documents), x AS (SELECT a.id AS p1, b.id AS p2, len(list_intersect(a.s, b.s)) AS c, a.n + b.n AS t FROM d a JOIN d b ON a.id < b.id AND a.n > 0 AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8) SELECT p1, p2, round(c / (t - c) + 1e-10, 6) AS similarity FROM x WHERE c / (t - c) >= 0.8")
def set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose token sets have a Jaccard similarity of 0.8 or more."""
    return rounded(simjoin.set_similarity_join(profiles(spark, sf_dir), X.tokens(F.col("text")), 0.8, "profile_id"))


@query("WITH d AS (SELECT p_partkey AS id, p_name AS s FROM part) SELECT x.id AS p1, y.id AS p2, levenshtein(x.s, y.s)::INT AS distance FROM d x JOIN d y ON x.id < y.id AND abs(len(x.s) - len(y.s)) <= 2 WHERE levenshtein(x.s, y.s) <= 2")
def edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts within two edits."""
    return simjoin.edit_distance_join(table(spark, sf_dir, "part"), F.col("p_name"), 2, "p_partkey")


POST = f"p AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2), q AS (SELECT id, token, count(*) AS tf FROM (SELECT item_id AS id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2)"


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = X.words(F.col("text"))
    return simjoin.postings(table(spark, sf_dir, "documents"), keys, "doc_id"), simjoin.postings(table(spark, sf_dir, "benchmark"), keys, "item_id")


@query(f"""WITH {POST}, l AS (SELECT id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l), d AS (SELECT token, count(*)::DOUBLE AS df FROM p GROUP BY 1),
sc AS (SELECT q.id AS query_id, p.id, round(sum(ln((n + 0.5 - df) / (df + 0.5) + 1) * tf2 / (tf2 + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN (SELECT id, token, tf::DOUBLE AS tf2 FROM p) p USING (token) JOIN d USING (token) JOIN l ON l.id = p.id, st GROUP BY 1, 2)
SELECT query_id, sum(score) AS total FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM sc) WHERE rank <= 5 GROUP BY 1""".replace("sum(score) AS total", "round(sum(score), 4) AS total"))
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the five best BM25 scores of each benchmark item among documents."""
    return simjoin.bm25_join(*_postings(spark, sf_dir), 5).groupBy("query_id").agg(F.round(F.sum("score"), 4).alias("total"))


@query(f"""WITH {POST}, st AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM p), d AS (SELECT token, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM p, st GROUP BY token, n),
wp AS (SELECT id, token, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS nm FROM p JOIN d USING (token)), wq AS (SELECT id, token, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS nm FROM q JOIN d USING (token)),
sc AS (SELECT wq.id AS query_id, wp.id, sum(wq.w / wq.nm * wp.w / wp.nm) AS score FROM wq JOIN wp USING (token) GROUP BY 1, 2)
SELECT query_id, round(sum(score), 4) AS total FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM sc) WHERE rank <= 5 GROUP BY 1""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the five best TF-IDF cosines of each benchmark item among documents."""
    return simjoin.tfidf_join(*_postings(spark, sf_dir), 5).groupBy("query_id").agg(F.round(F.sum("score"), 4).alias("total"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), s AS (SELECT a.id AS query_id, b.id, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM u a, u b WHERE a.id % 20 = 0)
SELECT query_id, round(sum(score), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM s) WHERE rank <= 10 GROUP BY 1""")
def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the ten best cosines of every twentieth vector among all."""
    rows = table(spark, sf_dir, "embeddings")
    return simjoin.cosine_topk_join(rows, rows.where("vec_id % 20 = 0"), 10, "vec_id", "embedding").groupBy("query_id").agg(F.round(F.sum("score"), 4).alias("total"))


# similarity functions ------------------------------------------------------------------------------------------------


@query(r"""WITH x AS (SELECT a.p_partkey AS p1, b.p_partkey AS p2, a.p_name AS s, b.p_name AS t, a.p_retailprice AS u, b.p_retailprice AS v, string_split(lower(a.p_name), ' ') AS m, string_split(lower(b.p_name), ' ') AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p1, p2, levenshtein(s, t)::DOUBLE AS lev, round(levenshtein(s, t) / greatest(len(s), len(t)), 6) AS lev_sim, round(len(list_intersect(m, n)) / (len(list_distinct(m)) + len(list_distinct(n)) - len(list_intersect(m, n))), 6) AS jaccard, round(len(list_intersect(m, n)) / sqrt(len(list_distinct(m)) * len(list_distinct(n))), 6) AS cosine, (s = t)::INT::DOUBLE AS exact, round(2 * abs(u - v) / (u + v), 6) AS rel_diff, round(1 - (CASE WHEN abs(u - v) <= 1e-4 THEN 0 ELSE abs(u - v) END) / greatest(abs(u), abs(v)), 6) AS abs_norm FROM x""")
def similarity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of each part with the next."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p1"), F.col("p_name").alias("s"), F.col("p_retailprice").alias("u"))
    x = part.join(part.select((F.col("p1") - 1).alias("p1"), F.col("s").alias("t"), F.col("u").alias("v")), "p1").withColumn("p2", F.col("p1") + 1)
    m, n = F.split(F.lower("s"), " "), F.split(F.lower("t"), " ")
    s, t, u, v = map(F.col, "stuv")
    return rounded(x.select("p1", "p2", S.edit_distance(s, t).alias("lev"), S.edit_ratio(s, t).alias("lev_sim"), S.set_jaccard(m, n).alias("jaccard"), S.cosine(m, n).alias("cosine"), S.exact_match(s, t).alias("exact"), S.relative_difference(u, v).alias("rel_diff"), S.absolute_norm(u, v).alias("abs_norm")))


@query()
def string_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro, Jaro-Winkler, Needleman-Wunsch and Smith-Waterman of each part's name and type."""
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", S.jaro(a, b).alias("jaro"), S.jaro_winkler(a, b).alias("jaro_winkler"), S.needleman_wunsch(a, b).alias("needleman_wunsch"), S.smith_waterman(a, b).alias("smith_waterman"))


# clustering ----------------------------------------------------------------------------------------------------------

@query(f"""WITH RECURSIVE {JS.removeprefix('WITH ')}, g AS (SELECT p1, p2 FROM w WHERE weight >= 0.5), b2 AS (SELECT p1 AS x, p2 AS y FROM g UNION SELECT p2, p1 FROM g),
rc AS (SELECT DISTINCT x AS n, x AS r FROM b2 UNION SELECT b2.y, rc.r FROM rc JOIN b2 ON rc.n = b2.x) SELECT n AS profile_id, min(r) AS cluster_id FROM rc GROUP BY 1""")
def connected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of pairs of weight 0.5 or more."""
    return clustering.component_clusters(js_edges(spark, sf_dir), 0.5)


@query(f"""WITH RECURSIVE {JS.removeprefix('WITH ')}, g AS (SELECT p1, p2 FROM w WHERE weight >= 0.5), b2 AS (SELECT p1 AS x, p2 AS y FROM g UNION SELECT p2, p1 FROM g),
rc AS (SELECT DISTINCT x AS n, x AS r FROM b2 UNION SELECT b2.y, rc.r FROM rc JOIN b2 ON rc.n = b2.x), cl AS (SELECT n, min(r) AS c FROM rc GROUP BY 1), tr AS (SELECT p1, p2 FROM w WHERE weight >= 0.4),
x AS (SELECT (SELECT count(*) FROM tr JOIN cl a ON a.n = p1 JOIN cl b ON b.n = p2 WHERE a.c = b.c) AS matches, (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM cl GROUP BY c)) AS pairs, (SELECT count(*) FROM tr) AS total)
SELECT *, round(coalesce(matches / nullif(total, 0), 0) + 1e-10, 6) AS completeness, round(coalesce(matches / nullif(pairs, 0), 0) + 1e-10, 6) AS quality FROM x""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of weight 0.5 or more against pairs of 0.4 or more."""
    edges = js_edges(spark, sf_dir)
    return rounded(evaluation.cluster_quality(clustering.component_clusters(edges, 0.5), edges.where("weight >= 0.4")))


for _name in ("center", "merge_center", "unique_mapping", "markov", "ricochet", "cut"):
    QUERIES[f"{_name}_clusters"] = lambda spark, sf_dir, f=getattr(clustering, f"{_name}_clusters"): f(js_edges(spark, sf_dir), 0.3)

# progressive ---------------------------------------------------------------------------------------------------------


@query(f"""{JS}, f1 AS (SELECT 1 AS phase, 0::BIGINT AS batch, weight, p1, p2 FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY weight DESC, p2) AS rn FROM w) WHERE rn = 1),
rk2 AS (SELECT n, row_number() OVER (ORDER BY mean DESC, n) AS visit FROM (SELECT p1 AS n, round(avg(weight), 9) AS mean FROM w GROUP BY 1)), {TOPK},
f2 AS (SELECT 2 AS phase, (a.visit - 1) // 40 AS batch, r.weight, r.p1, r.p2 FROM r JOIN rk2 a ON r.n = a.n LEFT JOIN rk2 b ON r.o = b.n WHERE r.rn <= 20 AND (b.visit IS NULL OR b.visit > a.visit) AND (r.p1, r.p2) NOT IN (SELECT (p1, p2) FROM f1))
SELECT * FROM f1 UNION ALL SELECT * FROM f2""")
def progressive_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progressive order of comparisons by profile."""
    return progressive.profile_schedule(js_edges(spark, sf_dir))


@query("""WITH k AS (SELECT c_custkey AS profile_id, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS pos FROM customer), p AS (SELECT least(a.profile_id, b.profile_id) AS p1, greatest(a.profile_id, b.profile_id) AS p2, count(*) AS c FROM k a JOIN k b ON b.pos BETWEEN a.pos + 1 AND a.pos + 5 GROUP BY 1, 2)
SELECT p1, p2, round(c / (1 + 1 - c), 6) AS weight FROM p""")
def neighbourhood_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of customers within five places of segment order."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("block_key"), F.col("c_custkey").alias("profile_id"))
    return rounded(progressive.neighbourhood_schedule(keys, 5))


# more of the graph and its measures ------------------------------------------------------------------------------------


def _wnp(name: str, mode: str, sql: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: graph.wnp(js_edges(spark, sf_dir), mode, **options)
    SQL[name] = f"{JS}, {TH} SELECT w.* FROM w JOIN t x ON p1 = x.n JOIN t y ON p2 = y.n WHERE {sql}"


# means of rounded weights may differ in the last place, so the limits are not put to the test of equality
_wnp("wnp_chi2", "or", "weight >= sqrt(x.h * x.h * 4 / 4 + y.h * y.h) / 2", threshold="max", chi2_divider=2.0)


def _purged(name: str, smooth: float) -> None:
    QUERIES[name] = lambda spark, sf_dir: blocking.purge_level(token_blocks(spark, sf_dir), smooth)
    SQL[name] = f"WITH {MEMBERS}, {BLOCKS}, {LEVEL.replace('1.0 * cc', f'{smooth} * cc')} SELECT level FROM lim"


_purged("purge_level_1049", 1.049)
_purged("purge_level_1045", 1.045)


@query(f"WITH {MEMBERS}, {BLOCKS}, {LEVEL}, {FILTERED} SELECT profile_id, block_key FROM rk WHERE rn <= greatest(1, CAST(round_even(n * 0.8::DOUBLE, 0) AS INT))")
def filtered_blocks_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's smallest blocks, four fifths of them and no more."""
    membership = blocking.blocks_by_key(profiles(spark, sf_dir), X.tokens(F.col("text")))
    purged = blocking.purge(membership, blocking.block_stats(membership))
    return blocking.filter_blocks_top(purged).select("profile_id", "block_key")


@query(f"{FEATURES} SELECT p1, p2, cfibf, js FROM ft")
def feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of every edge; Spark leaves out what the others need."""
    own = members(spark, sf_dir)
    return rounded(graph.features(graph.pairs(own), own).select("p1", "p2", "cfibf", "js"))


@query(f"{ALIKE}, x AS (SELECT (SELECT count(*) FROM fd JOIN tr USING (p1, p2)) AS h, (SELECT count(*) FROM fd) AS kp, (SELECT count(*) FROM tr) AS al, (SELECT count(*) FROM documents) AS n) SELECT round(coalesce(h / nullif(al, 0), 0) + 1e-10, 6) AS recall, round(coalesce(h / nullif(kp, 0), 0) + 1e-10, 6) AS precision, round(kp / (n * n) + 1e-10, 6) AS cssr, kp AS candidates FROM x")
def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of weight 0.3 or more against those of 0.5 or more, and their share of all."""
    edges, docs = js_edges(spark, sf_dir), profiles(spark, sf_dir)
    return rounded(statistics.candidate_statistics(edges.where("weight >= 0.3"), edges.where("weight >= 0.5"), docs, docs))


@query(f"WITH {SCORED}, d AS (SELECT *, ('0x' || substr(md5('1:' || p1 || ':' || p2), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s) SELECT p1, p2, u < 0.1::DOUBLE AS train FROM d")
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges, a tenth of them for training."""
    return statistics.split_train_test(scored_edges(spark, sf_dir), 1, 10).select("p1", "p2", "train")


@query(f"WITH {SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY p_match DESC, p1, p2) AS rn, count(*) OVER () AS n FROM s) SELECT p1, p2, CAST(rn <= 100 AS INT) AS label FROM o WHERE rn <= 100 OR rn > n - 300")
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best and the 300 worst scored edges as labelled ones."""
    return statistics.pseudo_labels(scored_edges(spark, sf_dir), 100, 300, "p_match").select("p1", "p2", "label")


@query(f"WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE pred = 1 AND is_match = 1) AS a, count(*) FILTER (WHERE pred = 0 AND is_match = 0) AS b, count(*) FILTER (WHERE pred = 1 AND is_match = 0) AS c, count(*) FILTER (WHERE pred = 0 AND is_match = 1) AS d FROM s) SELECT round(a / (a + d) + 1e-10, 6) AS tpr, round(b / (b + c) + 1e-10, 6) AS tnr, round(c / (b + c) + 1e-10, 6) AS fpr, round(d / (a + d) + 1e-10, 6) AS fnr FROM c")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the predicted labels of scored edges."""
    return rounded(statistics.label_rates(scored_edges(spark, sf_dir), "pred"))


@query("SELECT o_custkey AS cluster_id, sum(n)::BIGINT AS size, round(max(n) / sum(n) + 1e-10, 6) AS purity FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the commonest status among each customer's orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("profile_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderstatus").alias("kind"))
    return rounded(statistics.purity(orders.select("profile_id", "cluster_id"), orders.select("profile_id", "kind")))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity) + 1e-10, 6) AS l_quantity, round(avg(l_discount) + 1e-10, 6) AS l_discount FROM lineitem GROUP BY 1, 2")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of lines by flag and status."""
    return statistics.group_means(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"), ["l_returnflag", "l_linestatus"])


@query("SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions joined on the column that both have."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r"))
    return statistics.natural_merge(left, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")).drop("r")


@query(f"WITH t AS (SELECT item_id AS p1, {TOKENS} AS l FROM benchmark) SELECT p1, unnest(l) AS p2, unnest(range(1, len(l) + 1))::INT AS rank FROM t")
def pairs_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as ranked pairs: each benchmark item's words in order."""
    return statistics.pairs_of_lists(table(spark, sf_dir, "benchmark").select("item_id", X.words(F.col("text")).alias("l")), "item_id", "l")


@query("SELECT o_orderpriority AS dataset, round(count(*) / (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') * (SELECT avg(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT') / avg(o_totalprice) + 1e-10, 6) AS speed_up FROM orders GROUP BY 1")
def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of orders over growth of their mean price, by priority."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("comparisons"), F.avg("o_totalprice").alias("rt"))
    return rounded(statistics.speed_up(runs, "1-URGENT"))


@query("SELECT p_partkey AS id, lower(trim(regexp_replace(concat_ws(' ', trim(p_name), trim(p_brand), trim(p_type), p_size), ' +', ' ', 'g'))) AS text FROM part")
def one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of parts as one text."""
    return statistics.one_text(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"], lower=True)


@query("SELECT r_regionkey AS rkey, r_name AS rname FROM region")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names without marks."""
    return statistics.plain_names(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r.key"), F.col("r_name").alias("r:name")))


_POSITIVE = f"b AS (SELECT item_id AS id, {TOKENS} AS w FROM benchmark WHERE len({TOKENS}) > 0), n AS (SELECT id, w, unnest(range(1, 6)) AS copy FROM b), k AS (SELECT id, copy, w, list_transform(list_filter(range(0, len(w)), lambda i: ('0x' || substr(md5('1:' || id || ':' || copy || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.4::DOUBLE), lambda i: w[i + 1]) AS o FROM n)"


@query(f"WITH {_POSITIVE} SELECT id, copy::INT AS copy, array_to_string(w, ' ') AS text, array_to_string(CASE WHEN len(o) = 0 THEN w ELSE o END, ' ') AS other, 1 AS label FROM k")
def synthetic_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with five copies of it that lack some words."""
    return statistics.synthetic_pairs(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), others=0)


@query()
def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same and a random other item as a negative."""
    return statistics.synthetic_pairs(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


@query(f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1) SELECT token, round(0.001::DOUBLE / (0.001::DOUBLE + n / (SELECT sum(n) FROM c)::DOUBLE) + 1e-10, 6) AS weight FROM c")
def sif_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of benchmark words by their share."""
    return rounded(statistics.sif_weights(simjoin.postings(table(spark, sf_dir, "benchmark"), X.words(F.col("text")), "item_id")))


_UNIT = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)"


@query(f"WITH {_UNIT}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score FROM u a, u b WHERE a.id % 20 = 0) SELECT query_id, id, round(score + 1e-10, 6) AS score FROM s WHERE score >= 0.9")
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with a cosine of 0.9 or more to every twentieth one."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(simjoin.cosine_threshold_join(rows, rows.where("vec_id % 20 = 0"), 0.9, "vec_id", "embedding"))


@query(f"WITH {_UNIT}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score FROM u a, u b) SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each, itself included."""
    return simjoin.knn_graph(table(spark, sf_dir, "embeddings"), 5, "vec_id", "embedding").select("query_id", "id", "rank")


_BM25 = f"""{POST}, l AS (SELECT id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l), d AS (SELECT token, count(*)::DOUBLE AS df FROM p GROUP BY 1),
sc AS (SELECT q.id AS query_id, p.id, round(sum(ln((n + 0.5 - df) / (df + 0.5) + 1) * tf2 / (tf2 + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM q JOIN (SELECT id, token, tf::DOUBLE AS tf2 FROM p) p USING (token) JOIN d USING (token) JOIN l ON l.id = p.id, st GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""


@query(f"WITH {_BM25} SELECT query_id, id, rank::INT AS rank, round(score + 1e-10, 6) AS score FROM rr WHERE rank <= 5")
def bm25_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents by BM25 of each benchmark item, in order."""
    return rounded(simjoin.bm25_join(*_postings(spark, sf_dir), 5)).select("query_id", "id", "rank", "score")


@query(f"WITH {_BM25}, t AS (SELECT query_id, min(id) AS id FROM rr WHERE rank <= 3 GROUP BY 1), h AS (SELECT rank, count(*) AS n, count(t.id) AS h FROM rr LEFT JOIN t USING (query_id, id) WHERE rank <= 5 GROUP BY 1) SELECT rank::INT AS k, sum(n) OVER w AS candidates, sum(h) OVER w AS hits, round(sum(h) OVER w / (SELECT count(*) FROM t) + 1e-10, 6) AS recall FROM h WINDOW w AS (ORDER BY rank)")
def recall_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the five best, true being the smallest id among each item's three best."""
    ranked = cut(simjoin.bm25_join(*_postings(spark, sf_dir), 5))
    return rounded(statistics.recall_at(ranked, ranked.where("rank <= 3").groupBy("query_id").agg(F.min("id").alias("id")), 5))


# the text index: parts by name and type, asked by every fiftieth part ---------------------------------------------------

PARTS = textindex.IndexConfig().add("p_name", ("standard",)).add("both", ("3gram",), ("p_name", "p_type"))
_F = f"f AS (SELECT p_partkey AS id, 'p_name' AS field, unnest({TOKENS.replace('text', 'p_name')}) AS token FROM part UNION ALL SELECT id, 'both', unnest(flatten(list_transform(w, lambda t: {_PLAIN}))) FROM (SELECT p_partkey AS id, {TOKENS.replace('text', 'b')} AS w FROM (SELECT p_partkey, p_name || ' ' || p_type AS b FROM part)))"
_INDEX = f"""WITH {_F}, p AS (SELECT id, field, token, count(*)::DOUBLE AS tf FROM f GROUP BY ALL), l AS (SELECT id, field, sum(tf) AS dl FROM p GROUP BY ALL), st AS (SELECT field, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l GROUP BY 1), d AS (SELECT field, token, count(*)::DOUBLE AS df FROM p GROUP BY ALL),
c AS (SELECT q.id AS query_id, p.id, field, sum(ln((n + 0.5 - df) / (df + 0.5) + 1) * p.tf / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * wt) AS score FROM (SELECT id, field, token, tf AS qtf FROM p WHERE id % 50 = 0) q JOIN p USING (field, token) JOIN d USING (field, token) JOIN l ON l.id = p.id AND l.field = p.field JOIN st USING (field), LATERAL (SELECT WEIGHT AS wt) GROUP BY q.id, p.id, field),
s AS (SELECT query_id, id, round(sum(CASE field WHEN 'p_name' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * score), 9) AS score, count(*) FILTER (WHERE field = 'p_name') AS hits FROM c GROUP BY 1, 2)"""


def _parts_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = cut(textindex.analysed(table(spark, sf_dir, "part"), "p_partkey", PARTS))
    return index, index.where("id % 50 = 0")


def _parts_prepared(spark: SparkSession, sf_dir: str) -> textindex.Prepared:
    return textindex.prepared_rows(table(spark, sf_dir, "part"), "p_partkey", PARTS, "id % 50 = 0")


NAME, BOTH = ("p_name", "p_name", "standard"), ("both", "both", "3gram")
SPEC = textindex.full_spec(PARTS).with_boosts({NAME: 2.0})


@query(_INDEX.replace("WEIGHT", "1.0::DOUBLE") + " SELECT query_id, id, round(score + 1e-10, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best parts over two fields, names counting double."""
    return rounded(textindex.search(_parts_prepared(spark, sf_dir), None, SPEC, 5))


@query(_INDEX.replace("WEIGHT", "(ln(qtf) + 1) * (ln((n + 1) / (df + 1)) + 1)") + " SELECT query_id, id, round(score + 1e-10, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def index_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``index_search`` with weighted query terms."""
    return rounded(textindex.search(_parts_prepared(spark, sf_dir), None, SPEC, 5, weighted=True))


@query(_INDEX.replace("WEIGHT", "1.0::DOUBLE") + " SELECT query_id, count(*) AS n, round(sum(score) + 1e-10, 4) AS total FROM s WHERE hits > 0 GROUP BY 1")
def index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share a word of the name with the query, and the sum of their scores."""
    spec = textindex.QuerySpec(SPEC.clauses, SPEC.boosts, frozenset({NAME}))
    return textindex.totals(_parts_prepared(spark, sf_dir), None, spec).select("query_id", "n", F.round(F.col("total") + 1e-10, 4).alias("total"))


@query(_INDEX.replace("WEIGHT", "1.0::DOUBLE") + ", w AS (SELECT p_partkey - p_partkey % 50 AS query_id, p_partkey AS id FROM part WHERE p_partkey >= 50) SELECT w.query_id, w.id, round(coalesce(a.score, 0) + 1e-10, 6) AS name_score, round(coalesce(b.score, 0) + 1e-10, 6) AS both_score FROM w LEFT JOIN c a ON a.query_id = w.query_id AND a.id = w.id AND a.field = 'p_name' LEFT JOIN c b ON b.query_id = w.query_id AND b.id = w.id AND b.field = 'both'")
def index_score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by clause of each part and the last queried one before it."""
    pairs = table(spark, sf_dir, "part").where("p_partkey >= 50").select((F.col("p_partkey") - F.col("p_partkey") % 50).alias("query_id"), F.col("p_partkey").alias("id"))
    return rounded(textindex.score_docs(_parts_prepared(spark, sf_dir), None, pairs, SPEC).select("query_id", "id", F.col("`p_name.p_name.standard`").alias("name_score"), F.col("`both.both.3gram`").alias("both_score")))


@query(_INDEX.replace("WEIGHT", "1.0::DOUBLE") + ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5), g AS (SELECT query_id, sum(score) - (max(score) + min(score)) / 2 AS auc, max(score) AS m, count(*) AS k, max(score) FILTER (WHERE rank = 2) AS b FROM r GROUP BY 1) SELECT query_id, round(auc + 1e-10, 6) AS auc, round(coalesce(auc / nullif(m * (k - 1), 0), 0) + 1e-10, 6) AS norm_auc, round(coalesce(b / m, 0) + 1e-10, 6) AS ratio FROM g")
def index_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast the five best scores of each query fall."""
    return rounded(textindex.normalised_auc(textindex.search(_parts_prepared(spark, sf_dir), None, SPEC, 5)))


@query()
def index_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query specs in the order of their scores."""
    single = [textindex.QuerySpec(frozenset({c})) for c in sorted(SPEC.clauses)]
    ranked = textindex.rank_specs(_parts_prepared(spark, sf_dir), None, single, 5)
    return spark.createDataFrame([(i, sorted(".".join(c) for c in s.clauses), float(v)) for i, (s, v) in enumerate(ranked, 1)], "place int, clauses array<string>, value double")


@query("SELECT count(*) AS n FROM part")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the index."""
    return textindex.num_indexed(_parts_index(spark, sf_dir)[0])


for _n in (2, 4):
    _tokenised(f"{_n}gram_analyser", X.ANALYZERS[f"{_n}gram"], f"flatten(list_transform({TOKENS}, lambda t: CASE WHEN len(t) < {_n} THEN [t] ELSE list_transform(range(1, len(t) - {_n} + 2), lambda i: substr(t, i, {_n})) END))", "part", "p_partkey", "p_name")
_tokenised("stop_words", X.ANALYZERS["standard_stopwords"], f"list_filter({TOKENS}, lambda t: t NOT IN ({', '.join(map(repr, X.STOP_WORDS))}))", "benchmark", "item_id")

# keys, blocks and schedules with more to say ----------------------------------------------------------------------------

_BAG = "bag AS (SELECT p_partkey AS id, key, value FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (value FOR key IN (p_name, p_brand, p_type)))"


def _part_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.as_profiles(table(spark, sf_dir, "part"), "p_partkey", keep=tuple(PART_COLUMNS))


@query(f"WITH {_BAG}, v AS (SELECT id, key, replace(trim(lower(value)), ' ', '_') AS v FROM bag WHERE trim(value) <> ''), g AS (SELECT DISTINCT id, key || '_' || unnest(CASE WHEN len(v) < 3 THEN [v] ELSE list_transform(range(1, len(v) - 1), lambda i: substr(v, i, 3)) END) AS token FROM v) SELECT token, count(*) AS n FROM g GROUP BY 1")
def keyed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have each 3-gram of each of three columns."""
    return _part_bags(spark, sf_dir).select(F.explode(X.keyed_ngrams(F.col("attributes"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH {_BAG}, t AS (SELECT id, key, unnest({TOKENS.replace('text', 'value')}) AS token FROM bag)
SELECT token || '_' || CASE WHEN key = 'p_name' THEN 0 WHEN key = 'p_type' THEN 1 ELSE -1 END AS block_key, id::VARCHAR AS original_id, array_to_string(list_sort(list_distinct(list('0_' || key))), ',') AS attributes FROM t GROUP BY 1, 2""")
def cluster_block_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which columns a part is in each block of two clusters of columns and of the rest."""
    bags = _part_bags(spark, sf_dir)
    clusters = spark.createDataFrame([("p_name", 0, 1.0), ("p_type", 1, 1.0)], "key string, cluster_id int, entropy double")
    found = blocking.cluster_block_attributes(bags, clusters, X.words).join(bags.select("profile_id", "original_id"), "profile_id")
    return found.select("block_key", "original_id", F.array_join("attributes", ",").alias("attributes"))


@query(f"WITH {MEMBERS}, n AS (SELECT block_key FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100) SELECT m.* FROM m JOIN n USING (block_key)")
def bounded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token blocks of 2 to 100 documents."""
    return blocking.bounded_blocks(blocking.blocks_by_key(profiles(spark, sf_dir), X.tokens(F.col("text"))), 100).select("profile_id", "block_key")


def _block_entropy(name: str, per_profile: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("profile_id"), F.lit(0).alias("source_id"), "p_name")
        return blocking.block_entropy(cut(blocking.blocks_by_key(rows, X.tokens(F.col("p_name")))), per_profile).withColumn("entropy", F.round(F.col("entropy") + 1e-13, 9))

    QUERIES[name] = run
    SQL[name] = f"""WITH m AS (SELECT DISTINCT p_partkey AS id, unnest({TOKENS.replace('text', 'p_name')}) AS block_key FROM part), c AS (SELECT a.block_key, b.block_key AS other, count(*)::DOUBLE AS n FROM m a JOIN m b USING (id) GROUP BY 1, 2),
z AS (SELECT block_key, count(*)::DOUBLE AS size FROM m GROUP BY 1), s AS (SELECT block_key, sum(n) AS a, sum(n * ln(n)) AS l FROM c GROUP BY 1) SELECT block_key, round((ln(a) - l / a) / a{" / size" if per_profile else ""} + 1e-13, 9) AS entropy FROM s JOIN z USING (block_key)"""


_block_entropy("block_entropy", False)
_block_entropy("block_entropy_per_profile", True)


@query(r"""WITH p AS (SELECT item_id AS id, regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)', 1) AS l FROM benchmark), u AS (SELECT id, unnest(l) AS piece, unnest(range(0, len(l))) AS place FROM p),
o AS (SELECT id, piece, sum(len(piece)) OVER (PARTITION BY id ORDER BY place) AS e FROM u) SELECT id, lower(piece) AS token, (e - len(piece))::BIGINT AS "start", e::BIGINT AS "end" FROM o WHERE regexp_matches(piece, '[\p{L}\p{N}_]')""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark items and their places."""
    return statistics.token_offsets(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""{SQL["progressive_schedule"].replace("SELECT * FROM f1 UNION ALL SELECT * FROM f2", "")}, al AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2) SELECT row_number() OVER (ORDER BY phase, batch, weight DESC, p1, p2) AS position, phase, batch, weight, p1, p2 FROM al QUALIFY position <= 500""")
def schedule_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 comparisons of the progressive order."""
    return progressive.within_budget(progressive.profile_schedule(js_edges(spark, sf_dir)), 500)


# runs, loaders and training tables ---------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1")
def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and their places in a given order."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return statistics.in_order(counts, "o_orderpriority", ["2-HIGH", "1-URGENT"])


_CORPUS = "k AS (SELECT text, min(id) AS id, arg_min(kind, id) AS kind FROM (SELECT doc_id AS id, source AS kind, array_to_string(string_split(text, ' ')[1:64], ' ') AS text FROM documents WHERE text IS NOT NULL) GROUP BY 1)"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.distinct_by_start(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(f"WITH {_CORPUS} SELECT id, text, kind FROM k")
def distinct_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each start of 64 words."""
    return _corpus(spark, sf_dir)


@query(f"""WITH {_CORPUS}, l AS (SELECT a.id AS p1, b.id AS p2, CAST(a.kind = b.kind AS INT) AS label FROM k a JOIN k b ON b.id IN (a.id + 1, a.id + 7) WHERE a.kind IS NOT NULL AND b.kind IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('1:' || p1 || ':' || p2), 1, 8))::BIGINT, p1, p2) AS rn FROM l) SELECT p1, p2, label, CASE WHEN rn <= 200 THEN 'train' WHEN rn <= 250 THEN 'valid' ELSE 'test' END AS part FROM o WHERE rn <= 300""")
def labelled_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with ids 1 or 7 apart, labelled by source, in three parts."""
    kinds = _corpus(spark, sf_dir)
    pairs = kinds.select(F.col("id").alias("p1"), F.explode(F.array(F.col("id") + 1, F.col("id") + 7)).alias("p2"))
    return statistics.labelled_slices(pairs, kinds, {"train": 200, "valid": 250, "test": 300})


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(source, 'unk') AS source FROM documents LEFT JOIN labels USING (doc_id)")
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, nulls filled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return loaders.filled(rows).select("doc_id", "quality", "toxic", "source")


@query("SELECT doc_id AS ltable_id, doc_id + 1 AS rtable_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, doc_id + 2 FROM labels WHERE toxic = 1")
def matches_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs labelled 1 of two tables."""
    own = table(spark, sf_dir, "labels")
    split = lambda label, step: own.select(F.col("doc_id").alias("ltable_id"), (F.col("doc_id") + step).alias("rtable_id"), F.col(label).alias("label"))
    return loaders.matches_of_splits(split("quality", 1), split("toxic", 2))


@query("SELECT p_partkey, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END + 1e-10, 6) AS likeness FROM (SELECT p_partkey, list_distinct(" + TOKENS.replace("text", "p_name") + ") AS x, list_distinct(" + TOKENS.replace("text", "p_name || ' ' || p_type") + ") AS y FROM part)")
def pair_similarity_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline stage's likeness of parts' names to their names and types, by distinct words."""
    text = lambda *c: F.array_join(F.array_distinct(X.words(F.concat_ws(" ", *c))), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", text("p_name").alias("a"), text("p_name", "p_type").alias("b"))
    return rounded(learning.PairSimilarity(first="a", second="b", feature="jaccard", outputCol="likeness").transform(rows).select("p_partkey", "likeness"))


# communities and learnt scores -------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {JS.removeprefix('WITH ')}, g AS (SELECT p1, p2 FROM w WHERE weight >= 0.5), b2 AS (SELECT p1 AS x, p2 AS y FROM g UNION SELECT p2, p1 FROM g),
rc AS (SELECT DISTINCT x AS n, x AS r FROM b2 UNION SELECT b2.y, rc.r FROM rc JOIN b2 ON rc.n = b2.x), cl AS (SELECT n, min(r) AS c FROM rc GROUP BY 1),
dd AS (SELECT p1 AS a, p2 AS b, weight AS v FROM w WHERE weight >= 0.2 UNION ALL SELECT p2, p1, weight FROM w WHERE weight >= 0.2), pl AS (SELECT coalesce(x.c, -1 - a) AS ca, coalesce(y.c, -1 - b) AS cb, v FROM dd LEFT JOIN cl x ON x.n = a LEFT JOIN cl y ON y.n = b),
kk AS (SELECT ca, sum(v) AS s, sum(CASE WHEN ca = cb THEN v ELSE 0 END) AS i FROM pl GROUP BY 1) SELECT round(sum(i) / sum(s) - sum(s * s) / sum(s) / sum(s) + 1e-10, 6) AS modularity FROM kk""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of components of weight 0.5 or more on the pairs of weight 0.2 or more."""
    edges = js_edges(spark, sf_dir)
    return rounded(communities.modularity(edges.where("weight >= 0.2"), clustering.component_clusters(edges, 0.5)))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simjoin.knn_graph(table(spark, sf_dir, "embeddings"), 10, "vec_id", "embedding")
    return cut(near.select(F.col("query_id").alias("p1"), F.col("id").alias("p2"), F.col("score").alias("weight")))


@query()
def louvain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of vectors by communities of the graph of the ten nearest."""
    return communities.community_blocks(_near(spark, sf_dir))


@query()
def leiden_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with connected communities."""
    return communities.community_blocks(_near(spark, sf_dir), connected=True)


@query()
def kernel_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities by a kernel machine trained on 250 edges of each label; true are edges whose token sets are alike."""
    marked = cut(_marked(spark, sf_dir))
    train = evaluation.balanced_split(marked, 500).where("train")
    return learning.kernel_match_probabilities(marked, train)


@query()
def training_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of logistic regression by the size of its training set."""
    return learning.training_size_sweep(_marked(spark, sf_dir), [20, 50, 100])


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = members(spark, sf_dir)
    edges = graph.pairs(own)
    return graph.features(edges, own, graph.weighted(edges, own, "js").where("weight >= 0.5"))


@query()
def batches_of_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of 64 alike ones."""
    return learning.batches_of_alike(spread(table(spark, sf_dir, "documents")), "doc_id", F.col("text"), 64)


@query()
def attribute_clusters_in_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of customers and suppliers clustered by the profiles that MinHash blocks bring together."""
    return attributes.cluster_attributes_in_two_steps(_bags(spark, sf_dir), threshold=0.1)


HEADLINE = ("token_blocks", "cleaned_blocks", "pairs_cbs", "wep", "edge_features", "set_join", "cosine_top", "connected_clusters")
