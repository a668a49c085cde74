"""N-gram Jaccard join by rare-first prefix filtering, giving the components of documents that link.

Documents with equal shingle sets are one class. A class's shingles are ordered by rising document count, then hash;
two sets that reach the threshold share a shingle in their prefixes of ``n - ceil(t * n) + 1``. Counts come from all
documents, in ``2 ** COUNT_BITS`` hash buckets: a table of fixed size, which is all that is broadcast. Shingles that
fall together only change the order, never the result.

Candidates meet on prefix shingles and pass a length filter, a positional filter (what may still be shared behind the
common shingle) and a suffix filter (sets whose counts in 64 hash classes differ too much cannot overlap enough). Each
surviving pair is verified once, on whole sets, which are made only for classes that have such a pair.

Only components are asked for, so not every pair of a group needs a look. First every prefix shingle compares some
pivots with its other classes: in turn the class with the fewest rarer shingles before it, which in a group of near
copies has the fewest changes, and a random one. Then, in rounds, a pivot is compared with the classes that are not in
its component yet, until no link is found. Last, all candidates that still lie in different components are compared;
there the join itself holds a bitmap filter (the parities of a set's counts in 128 hash classes differ in no more
places than two sets have elements apart). Shingles of two classes are done after the first pass. What is left out are
pairs whose ends are joined already, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.bpe import slices
from kinloom.llm.members import filter_of, may_hold
from kinloom.llm.shingles import shingle_sets, signed
from kinloom.operators.components import connected_components
from kinloom.plans.lineage import cut

COUNT_BITS, PARTS, PIVOTS, CLASSES = 20, 64, 4, 64

#: Pairs (16 bytes each) up to which they are broadcast to the sets; more are joined by a shuffle.
SMALL = 50_000


def document_counts(rows: DataFrame, n: int, bits: int = COUNT_BITS) -> np.ndarray:
    """Documents by hash bucket of their shingles, over all of ``rows (doc_id, text)``.

    Tasks send arrays of counts, not shingles, and these are summed in two steps, so that no task gets one from
    every other. The result has ``2 ** bits`` entries whatever the input.
    """
    width = (1 << bits) // PARTS

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for _, texts in slices(stream):
            for own in shingle_sets(texts, n):
                np.add.at(total, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
        if total.any():
            tag = int(xxhash.xxh3_64_intdigest(total.tobytes()) % 32)
            total = total.astype(np.uint16) if total.max() < 1 << 16 else total
            raw = [total[p * width : (p + 1) * width].tobytes() for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([tag] * PARTS, pa.int32()), pa.array(raw, pa.binary())], ["part", "tag", "counts"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for raw in frame["counts"]:
            total += np.frombuffer(raw, np.uint16 if len(raw) == 2 * width else np.int64)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "tag": [0], "counts": [total.tobytes()]})

    schema = "part int, tag int, counts binary"
    summed = rows.mapInArrow(count, schema).groupBy("part", "tag").applyInPandas(added, schema).groupBy("part").applyInPandas(added, schema)
    out = np.zeros(1 << bits, np.int64)
    for part, raw in summed.select("part", "counts").collect():
        out[part * width : (part + 1) * width] = np.frombuffer(raw, np.int64)
    return out


def prefixes(rows: DataFrame, n: int, t: Fraction, counts: np.ndarray) -> DataFrame:
    """``doc_id, node, n, sig, odd_0, odd_1, prefix``: each document's class (hash of its set; null without words), parities and prefix."""
    order = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))
    bits = int(math.log2(len(counts)))
    edges_ = np.arange(1, 2 * CLASSES, dtype=np.uint64) << np.uint64(57)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch, texts in slices(stream):
            nodes, sizes, sigs, odd, firsts = [], [], [], [], []
            for own in shingle_sets(texts, n):
                size = len(own)
                sizes.append(size)
                nodes.append(_class_of(own) if size else None)
                edges = np.concatenate([[0], np.searchsorted(own, edges_), [size]])
                within = np.diff(edges)
                sigs.append(np.minimum(within[::2] + within[1::2], 255).astype(np.uint8).tobytes())
                odd.append(np.packbits((within & 1).astype(np.uint8)).view(np.int64))
                keep = size - math.ceil(t * size) + 1 if size else 0
                if keep < size:
                    key = rank[(own >> np.uint64(64 - bits)).astype(np.int64)]
                    some = np.argpartition(key, keep - 1)[:keep]
                    # ties at the edge of the prefix go by hash, as everywhere
                    some = np.flatnonzero(key <= key[some].max())
                    own = own[some[np.lexsort((own[some], key[some]))[:keep]]]
                else:
                    own = own[np.lexsort((own, rank[(own >> np.uint64(64 - bits)).astype(np.int64)]))]
                firsts.append(signed(own))
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in firsts])).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            odds = np.concatenate([np.zeros(0, np.int64), *odd]).reshape(-1, 2)
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(odds[:, 0]), pa.array(odds[:, 1]), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "node", "n", "sig", "odd_0", "odd_1", "prefix"])

    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("odd_0", T.LongType()), T.StructField("odd_1", T.LongType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields, T.StructField("prefix", T.ArrayType(T.LongType()))]))


def _class_of(own: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def whole_sets(rows: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``node`` and its whole set (``shingles``, 64-bit hashes) for the classes ``wanted (node, least)``.

    Their documents are named to the tasks by a filter of fixed size; what it lets through besides is dropped after.
    """
    table = filter_of(wanted.select(F.xxhash64("least").alias("key")))
    chosen = rows.sparkSession.sparkContext.broadcast(table)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = chosen.value
        for batch in stream:
            some = batch.filter(pa.array(may_hold(bits, batch.column(0).to_numpy())))
            for _, texts in slices(iter([some])):
                sets = [s for s in shingle_sets(texts, n) if len(s)]
                offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *map(signed, sets)])))
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), lists], ["node", "shingles"])

    made = rows.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(run, "node long, shingles array<long>")
    made = cut(made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    chosen.unpersist()
    return made


def _may_link(t: Fraction) -> Column:
    """Length and positional filters on columns ``n, pos`` of a pair's ends (``a_``, ``b_``)."""
    p, q = t.numerator, t.denominator
    length = F.least("a_n", "b_n") * q >= F.greatest("a_n", "b_n") * p
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    return length & (rest * (p + q) >= (F.col("a_n") + F.col("b_n")) * p)


def _may_match(t: Fraction) -> Column:
    """Bitmap filter on columns ``n, odd_0, odd_1`` of a pair's ends (``a_``, ``b_``)."""
    p, q = t.numerator, t.denominator
    total = F.col("a_n") + F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_odd_{k}").bitwiseXOR(F.col(f"b_odd_{k}"))) for k in (0, 1)), F.lit(0))
    return (total - apart) * (p + q) >= total * (2 * p)


def unlike(pairs: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` that pass the suffix filter."""
    p, q = t.numerator, t.denominator

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), CLASSES).astype(np.int16) for c in (2, 4))
            total = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            most = total - 2 * (-(-total * p // (p + q)))
            yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(1) <= most))

    end = lambda c: info.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("n").alias(f"{c}_n"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "a_sig", "a_n", "b_sig", "b_n").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold.

    Sets are compared row by row where they are joined: batches of pairs of whole sets would fill an executor.
    """
    p, q = t.numerator, t.denominator
    common = F.size(F.array_intersect("of_a", "of_b"))
    named = F.broadcast(pairs) if pairs.count() <= SMALL else pairs
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")).join(named, c) for c in ("a", "b"))
    return x.join(y, ["a", "b"]).where(common * (p + q) >= (F.size("of_a") + F.size("of_b")) * p).select("a", "b")


def components(docs: DataFrame, n: int = 5, threshold: str | float = "0.8", id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id, group_key``, a row for each row of ``docs``.

    ``component_id`` is the smallest id of the component; ``group_key`` tells components apart even where ids repeat
    or are null. A text without words (or null) has an empty set, links with nothing and is its own component, with a
    null ``group_key``. Copies of a text share their class. An empty table gives no rows; other columns are not
    carried.
    """
    t = Fraction(str(threshold))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(prefixes(rows, n, t, document_counts(rows, n)))
    classes = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("sig", "odd_0", "odd_1", "prefix")))
    classes = cut(classes)
    info = classes.select("node", "n", "sig")
    postings = classes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    live = cut(postings.withColumn("of", F.count("*").over(Window.partitionBy("token"))).where("of > 1"))

    several = live.where("of > 2")

    pairs = cut(unlike(_pairs(_with_pivots(_placed(live, None), range(PIVOTS)), t, None), info, t))
    sets = whole_sets(rows, n, _named(pairs, classes))
    known = cut(sets.select("node"))
    tried, links = pairs, cut(verified(pairs, sets, t))
    parts = cut(connected_components(links, "a", "b"))
    for turn in range(PIVOTS, PIVOTS + most_rounds):
        more = unlike(_pairs(_with_pivots(_placed(several, parts), [turn]), t, tried), info, t)
        more = cut(more.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi"))
        new = cut(verified(more, sets, t))
        if new.isEmpty():
            break
        tried, links = tried.unionByName(more), links.unionByName(new)
        parts = cut(connected_components(links, "a", "b"))
    ends = _placed(several, parts).join(classes.select("node", "odd_0", "odd_1"), "node")
    left, right = (ends.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "pos", "part", "odd_0", "odd_1"))) for x in "ab")
    met = left.join(right, "token").where(F.expr("a_node < b_node and a_part <> b_part") & _may_match(t))
    rest = cut(unlike(_pairs(met, t, tried), info, t))
    missing = _named(rest, classes).join(known, "node", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionByName(whole_sets(rows, n, missing))
    new = cut(verified(rest, sets, t))
    if not new.isEmpty():
        parts = cut(connected_components(links.unionByName(new), "a", "b"))

    grouped = classes.select("node", "least")
    grouped = grouped.join(parts, "node", "left").withColumn("group_key", F.coalesce("component", "node"))
    ids = grouped.groupBy("group_key").agg(F.min("least").alias("component_id"))
    per_class = grouped.join(ids, "group_key").select("node", "group_key", "component_id")
    return found.select("doc_id", "node", F.col("n").alias("n_shingles")).join(per_class, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group_key")


def _placed(live: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return live.withColumn("part", F.col("node"))
    return live.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _with_pivots(placed: DataFrame, turns) -> DataFrame:
    """Each shingle's classes beside its pivots of these turns, where they are not in one component."""
    order = lambda k: F.struct(F.lit(0) if k % 2 else F.col("pos"), F.xxhash64(F.lit(k), "node"))
    chosen = F.array_distinct(F.array(*(F.min_by(F.struct("node", "n", "pos", "part"), order(k)) for k in turns)))
    met = placed.join(placed.groupBy("token").agg(chosen.alias("ps")), "token").withColumn("p", F.explode(F.filter("ps", lambda p: p["part"] != F.col("part"))))
    return met.select(*(F.col(f"{own}{c}").alias(f"{end}_{c}") for own, end in (("", "a"), ("p.", "b")) for c in ("node", "n", "pos")))


def _pairs(met: DataFrame, t: Fraction, tried: DataFrame | None) -> DataFrame:
    pairs = met.where(_may_link(t)).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, least`` of the classes in ``pairs``."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return classes.select("node", "least").join(nodes, "node", "left_semi")


def keep_one(docs: DataFrame, n: int = 5, threshold: str | float = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id; documents without words all stay.

    Rows that repeat an id inside one component count as one document. Rows with a null id count by their texts: a
    component with ids drops them, one of null ids alone keeps one. All columns stay.
    """
    if docs.where(F.col(id_col).isNull()).isEmpty():
        found = components(docs, n, threshold, id_col, text_col)
        first = found.where("doc_id = component_id or group_key is null").select("doc_id").distinct()
        return docs.join(first.withColumnRenamed("doc_id", id_col), id_col, "left_semi").select(*docs.columns)
    unnamed = F.col(id_col).isNull()
    key = F.struct(unnamed.cast("int").alias("unnamed"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"), F.when(unnamed, F.sha2(F.coalesce(text_col, F.lit("")), 256)).otherwise("").alias("sha"))
    keyed = docs.withColumn("_key", key)
    found = components(keyed, n, threshold, "_key", text_col)
    first = found.where("doc_id = component_id or group_key is null").select(F.col("doc_id").alias("_key"), F.col("group_key").isNull().alias("_bare")).distinct()
    kept = keyed.join(first, "_key")
    alone = F.expr("_key.unnamed = 1 and not _bare")
    return kept.where(~alone).unionByName(kept.where(alone).dropDuplicates(["_key"])).select(*docs.columns)
