"""Statistics of candidates, runs and clusters, and the making of training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import words
from kinloom.operators.blocking import global_position


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def candidate_statistics(candidates: DataFrame, truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``recall, precision, cssr, candidates``; ``cssr`` is the share of all ``left`` by ``right`` rows. Repeated pairs count once."""
    true = truth.select("p1", "p2").distinct()
    hit = candidates.select("p1", "p2").distinct().join(true.withColumn("hit", F.lit(1)), ["p1", "p2"], "left").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("candidates"))
    sizes = [t.agg(F.count("*").alias(n)) for t, n in ((true, "total"), (left, "l"), (right, "r"))]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sizes, hit)  # one row each
    return one.select(_ratio(F.col("hits"), F.col("total")).alias("recall"), _ratio(F.col("hits"), F.col("candidates")).alias("precision"), _ratio(F.col("candidates"), F.col("l") * F.col("r")).alias("cssr"), "candidates")


def recall_at(ranked: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """``k, candidates, hits, recall`` for k from 1 to ``most`` of ``ranked (query_id, id, rank)`` against ``truth (query_id, id)``."""
    true = truth.select("query_id", "id").distinct()
    hits = ranked.where(F.col("rank") <= most).join(true.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("rank").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h"))
    every = ranked.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("k"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # ``most`` rows
    sums = every.join(hits.withColumnRenamed("rank", "k"), "k", "left").na.fill(0).select("k", F.sum("n").over(upto).alias("candidates"), F.sum("h").over(upto).alias("hits"))
    return sums.crossJoin(F.broadcast(true.agg(F.count("*").alias("total")))).select("k", "candidates", "hits", _ratio(F.col("hits"), F.col("total")).alias("recall"))


def group_means(runs: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Means of all number columns that are not in ``by``, over the runs of each group."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return runs.groupBy(*by).agg(*(F.round(F.avg(c) + 1e-10, digits).alias(c) for c, k in runs.dtypes if k in kinds and c not in by))


def natural_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows joined on all columns that both have."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no column in common")
    return left.join(right, shared)


def pairs_of_lists(rows: DataFrame, id_col: str, lists: str) -> DataFrame:
    """``p1, p2, rank`` of a row's list of partners, best first; null and empty lists give none."""
    return rows.select(F.col(id_col).alias("p1"), F.posexplode(lists).alias("rank", "p2")).select("p1", "p2", (F.col("rank") + 1).alias("rank"))


def speed_up(runs: DataFrame, base: str, name: str = "dataset", comparisons: str = "comparisons", time: str = "rt") -> DataFrame:
    """``name, speed_up``: growth of the comparisons over growth of the time, against the run called ``base``."""
    one = runs.where(F.col(name) == base).agg(F.first(comparisons).alias("c0"), F.first(time).alias("t0"))
    return runs.crossJoin(F.broadcast(one)).select(name, (F.col(comparisons) / F.col("c0") * F.col("t0") / F.col(time)).alias("speed_up"))


def draw(seed: int, *parts: Column | str) -> Column:
    """A number from 0 up to 1 that a seed and some columns decide, by MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split_train_test(edges: DataFrame, n: int, total: int, seed: int = 1) -> DataFrame:
    """``edges (p1, p2, ...)`` with ``train``, true for about ``n`` of ``total`` rows, drawn by their ids."""
    return edges.withColumn("train", draw(seed, "p1", "p2") < n / max(1, total))


def synthetic_pairs(rows: DataFrame, id_col: str, text: Column, copies: int = 5, others: int = 1, drop: float = 0.4, seed: int = 1) -> DataFrame:
    """``id, copy, text, other, label``: training pairs for each row with a text.

    A positive pairs the text with a copy of it in which each word is left out with probability ``drop`` (a copy that
    would be empty is the text); a negative pairs it with the text of a row a random way further in the order of ids.
    """
    base = rows.select(F.col(id_col).alias("id"), F.array_join(words(text), " ").alias("text")).where("text <> ''")
    placed = global_position(base, ["id"])
    total = placed.count()
    own = F.split("text", " ")
    numbered = lambda n: base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    left = F.array_join(F.transform(F.filter(F.transform(own, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: draw(seed, F.col("id"), F.col("copy"), x["i"]) >= drop), lambda x: x["w"]), " ")
    same = numbered(copies).select("id", "copy", "text", F.when(left == "", F.col("text")).otherwise(left).alias("other"), F.lit(1).alias("label"))
    step = lambda n: F.floor(draw(seed, F.lit("far"), F.col("id"), F.col("copy")) * (n - 1)).cast("long") + 1
    far = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(others)))).withColumn("at", F.pmod(F.col("position") + step(max(2, total)), F.lit(max(1, total))))
    unlike = far.join(placed.select(F.col("position").alias("at"), F.col("text").alias("other")), "at").select("id", "copy", "text", "other", F.lit(0).alias("label"))
    return same.unionByName(unlike) if others and total > 1 else same


def pseudo_labels(scored: DataFrame, positives: int, negatives: int, score: str = "similarity") -> DataFrame:
    """``scored (p1, p2, ...)`` cut to its ``positives`` best and ``negatives`` worst edges, with ``label``; ties by ids.

    Where the two overlap an edge is positive.
    """
    placed = global_position(scored, [F.desc(score), F.col("p1"), F.col("p2")])
    total = scored.count()
    label = F.when(F.col("position") < positives, 1).when(F.col("position") >= total - negatives, 0)
    return placed.withColumn("label", label).where("label is not null").drop("position")


def label_rates(labelled: DataFrame, label: str = "label", truth: str = "is_match") -> DataFrame:
    """One row ``tpr, tnr, fpr, fnr`` of labels against the truth."""
    count = lambda a, b: F.count_if((F.col(label) == a) & (F.col(truth) == b))
    one = labelled.agg(*(count(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)))
    n = {c: F.col(c) for c in ("n00", "n01", "n10", "n11")}
    yes, no = n["n11"] + n["n01"], n["n00"] + n["n10"]
    return one.select(_ratio(n["n11"], yes).alias("tpr"), _ratio(n["n00"], no).alias("tnr"), _ratio(n["n10"], no).alias("fpr"), _ratio(n["n01"], yes).alias("fnr"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows with ``place``, the column's value's place in ``order`` from 1; others come last, with one place more."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int") if order else F.lit(0)
    return df.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1))


def distinct_by_start(rows: DataFrame, id_col: str, text: str, kind: str, most: int = 64) -> DataFrame:
    """``id, text, kind`` of one row for each start of ``most`` space-separated words: that of the smallest id. Null texts are left out."""
    start = F.substring_index(F.col(text), " ", most)
    return rows.where(F.col(text).isNotNull()).groupBy(start.alias("text")).agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(kind).alias("kind"))).alias("x")).select("x.id", "text", "x.kind")


def labelled_slices(pairs: DataFrame, kinds: DataFrame, ends: dict[str, int], seed: int = 1) -> DataFrame:
    """``p1, p2, label, part``: ``pairs (p1, p2)`` labelled by whether both have one kind, dealt to parts in drawn order.

    A part takes the places up to its end, after the part before; what lies beyond the last end is left out, as are
    pairs of a row with itself or without a kind.
    """
    of = lambda p: kinds.select(F.col("id").alias(p), F.col("kind").alias(f"kind_{p}"))
    marked = pairs.where("p1 <> p2").select("p1", "p2").distinct().join(of("p1"), "p1").join(of("p2"), "p2").select("p1", "p2", (F.col("kind_p1") == F.col("kind_p2")).cast("int").alias("label")).where("label is not null")
    placed = global_position(marked, [draw(seed, "p1", "p2"), F.col("p1"), F.col("p2")])
    part = F.coalesce(*(F.when(F.col("position") < end, F.lit(name)) for name, end in sorted(ends.items(), key=lambda x: x[1])))
    return placed.withColumn("part", part).where("part is not null").drop("position")


def token_offsets(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, token, start, end``: the lower-cased words of each text and their places in it, in characters from 0.

    Ids are of one row each. Positions are sums of the lengths of the pieces before, so a long text costs in proportion.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    each = rows.select(F.col(id_col).alias("id"), F.posexplode(pieces).alias("at", "piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", upto).where(F.col("piece").rlike(r"[\p{L}\p{N}_]")).select("id", F.lower("piece").alias("token"), (F.col("end") - F.length("piece")).alias("start"), "end")


def purity(clusters: DataFrame, kinds: DataFrame) -> DataFrame:
    """``cluster_id, size, purity``: the share of each cluster's commonest kind; ``kinds (profile_id, kind)``."""
    counted = clusters.join(kinds, "profile_id").groupBy("cluster_id", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("cluster_id").agg(F.sum("n").alias("size"), _ratio(F.max("n"), F.sum("n")).alias("purity"))


def sif_weights(postings: DataFrame, a: float = 1e-3) -> DataFrame:
    """``token, weight``: ``a / (a + share)`` with the token's share of all words of ``postings (id, token, tf)``."""
    counts = postings.groupBy("token").agg(F.sum("tf").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").cast("double").alias("all")))).select("token", (a / (a + F.col("n") / F.col("all"))).alias("weight"))


def weighted_mean_vectors(postings: DataFrame, weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, vector``: the mean of a text's word vectors by weight; words without a vector are left out."""
    each = postings.join(weights, "token").join(vectors.select("token", F.posexplode("vector").alias("at", "x")), "token")
    n = postings.join(vectors.select("token"), "token", "left_semi").groupBy("id").agg(F.sum("tf").alias("n"))
    sums = each.groupBy("id", "at").agg(F.sum(F.col("tf") * F.col("weight") * F.col("x")).alias("x")).join(n, "id")
    return sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))).alias("v")).select("id", F.transform("v", lambda s: s["x"]).alias("vector"))


def one_text(df: DataFrame, id_col: str, columns: list[str] | None = None, lower: bool = False) -> DataFrame:
    """``id, text``: all columns but the id (or those named), trimmed and joined by spaces; nulls count as empty."""
    own = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in (columns or [c for c in df.columns if c != id_col])]
    text = F.trim(F.regexp_replace(F.concat_ws(" ", *own), " +", " "))
    return df.select(F.col(id_col).alias("id"), (F.lower(text) if lower else text).alias("text"))


def plain_names(df: DataFrame, marks: str = "./:") -> DataFrame:
    """``df`` without the given marks in its column names; names that would clash keep a number behind them."""
    names: list[str] = []
    for c in df.columns:
        bare = "".join(x for x in c if x not in marks)
        k = 1
        while bare in names:
            k += 1
            bare = "".join(x for x in c if x not in marks) + str(k)
        names.append(bare)
    return df.toDF(*names)
