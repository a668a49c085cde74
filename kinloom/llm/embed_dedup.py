"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation of the principal axes is learned so that signs are balanced codes (fitted on ``SAMPLE`` vectors at the
most, all vectors are indexed; vectors of each length have their own, a random one where the sample holds fewer than
``FEW`` of them). A code is cut into ``TABLES`` substrings; vectors of one label that share a substring
in a table are compared by cosine in double precision. A pair counts in the first table that brings it together, so
it is counted once without ever being written down: a group gives back, for each vector, how many it links to and
the vector from which it was reached, both in proportion to its rows. Equal vectors are one class with a multiplicity.
Buckets over ``BLOCK`` rows are compared block by block in separate groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators.components import connected_components
from kinloom.plans.lineage import cut

SAMPLE, TABLES, BLOCK, GROUP, THRESHOLD, ROUNDS, SEED, BITS, FEW = 20_000, 5, 2048, 20_000, 0.98, 40, 11, 64, 256

#: Buckets up to this size are compared row by row for all buckets at once; larger ones by a product of matrices.
SMALL = 48


class Quantiser:
    """Centre and rotation for vectors of one ``size``; ``codes`` gives the signs of the rotated axes as unsigned 64-bit integers.

    Without vectors to learn from, the axes are random.
    """

    def __init__(self, size: int, vectors: np.ndarray | None = None, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> None:
        self.size, self.bits = size, min(bits, size)
        random = np.random.default_rng(seed)
        if vectors is None or len(vectors) < FEW:
            self.centre, self.axes = np.zeros(size), np.linalg.qr(random.normal(size=(size, self.bits)))[0]
            return
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.centre = unit.mean(0)
        flat = unit - self.centre
        axes = np.linalg.eigh(flat.T @ flat)[1][:, ::-1][:, : self.bits]
        turn = np.linalg.qr(random.normal(size=(self.bits, self.bits)))[0]
        low = flat @ axes
        for _ in range(rounds):
            signs = np.where(low @ turn >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(signs.T @ low)
            turn = (a @ b).T
        self.axes = axes @ turn

    def codes(self, unit: np.ndarray) -> np.ndarray:
        on = ((unit - self.centre) @ self.axes >= 0).astype(np.uint64)
        return (on << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


class Quantisers(dict):
    """Those that were learned, by the vectors' length; random ones for other lengths, made when first asked for."""

    def __missing__(self, size: int) -> Quantiser:
        self[size] = made = Quantiser(size)
        return made


def substrings(bits: int, tables: int) -> list[tuple[int, int]]:
    """Begin and width of each table's substring."""
    edges = np.linspace(0, bits, min(tables, bits) + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that hold finite components, not all zero, and those rows in double precision, for each length."""
    found: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            most = np.abs(x).max()
            if np.isfinite(most) and most > 0:
                rows, own = found.setdefault(len(x), ([], []))
                rows.append(i)
                own.append(x)
    for rows, own in found.values():
        yield np.array(rows, np.int64), np.array(own)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, which neither overflows nor vanishes."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit(rows: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Quantisers:
    """A quantiser for each length of vector, from ``sample`` vectors at the most in all."""
    share = min(1.0, 1.3 * sample / max(1, rows.count()))
    got = rows.select("embedding").where("embedding is not null").sample(share, seed).limit(sample).toArrow().column(0).combine_chunks()
    return Quantisers({v.shape[1]: Quantiser(v.shape[1], _unit(v)) for _, v in _vectors(got) if len(v) >= FEW})


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``table``.

    Only vectors of equal, non-null labels and of one length are compared. Null or zero vectors and those with null or
    non-finite components link with nothing. ``component_id`` is the smallest id of the component (a null id stays
    null where no other is there), a long for ids that are integers. Repeated rows are links of each other.
    """
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    models = fit(rows)
    root_kind = T.LongType() if isinstance(rows.schema["vec_id"].dataType, T.IntegralType) else rows.schema["vec_id"].dataType

    def coded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            raw: list[bytes | None] = [None] * len(batch)
            keys: list[np.ndarray | None] = [None] * len(batch)
            codes = np.zeros(len(batch), np.int64)
            for at, vectors in _vectors(batch.column(1)):
                model = models[vectors.shape[1]]
                own = model.codes(_unit(vectors))
                codes[at] = own.view(np.int64)
                values = np.stack([(own >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in substrings(model.bits, tables)], 1).astype(np.int64)
                for i, v, k in zip(at.tolist(), vectors, values, strict=True):
                    raw[i], keys[i] = (v + 0.0).tobytes(), k  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), batch.column(2), pa.array(codes), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "vector", "label", "code", "keys"])

    schema = T.StructType([rows.schema["vec_id"], T.StructField("vector", T.BinaryType()), rows.schema["label"], T.StructField("code", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    every = cut(rows.mapInArrow(coded, schema).withColumn("node", F.when(F.col("vector").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "vector"))))
    classes = every.where("node is not null").groupBy("node").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label"), F.first("code").alias("code"), F.first("keys").alias("keys"))
    classes = cut(classes)

    spread = classes.select("node", "times", "vector", "code", F.struct("label", F.length("vector").alias("bytes")).alias("label"), F.posexplode("keys").alias("tab", "value"))
    # bucket sizes; only those over a block are kept, and a bucket of one vector has nothing to compare
    sizes = spread.groupBy("label", "tab", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = spread.join(sizes.drop("n"), ["label", "tab", "value"]).withColumn("own", F.pmod(F.xxhash64("node", "tab"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = max(1, tables * classes.count() // GROUP)
    bucket = F.xxhash64("label", "tab", "value", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("node", "times", "vector", "code", "tab", "own", (F.col("own") != F.col("other")).alias("across"), bucket.alias("bucket")).withColumn("part", F.pmod("bucket", F.lit(groups)))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([of_one_length(own, size // 8) for size, own in frame.groupby(frame["vector"].map(len))])

    def of_one_length(frame: pd.DataFrame, size: int) -> pd.DataFrame:
        cuts = substrings(min(BITS, size), tables)
        frame = frame.sort_values(["bucket", "tab", "node"], kind="stable")
        vectors = _unit(np.frombuffer(b"".join(frame["vector"]), np.float64).reshape(len(frame), size))
        codes, times, nodes, own, tabs, across, buckets = (frame[c].to_numpy() for c in ("code", "times", "node", "own", "tab", "across", "bucket"))
        keys = np.stack([(codes.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in cuts], 1)
        starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        sizes = np.diff(np.append(starts, len(frame)))
        links = np.zeros(len(frame), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        size_of = np.repeat(sizes, sizes)
        for lag in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero((size_of[lag:] <= SMALL) & (buckets[lag:] == buckets[:-lag]))
            # across two blocks only rows of different blocks; pairs that an earlier table brings together count there
            at = at[(nodes[at] != nodes[at + lag]) & (~across[at] | (own[at] != own[at + lag]))]
            at = at[~((keys[at] == keys[at + lag]) & (np.arange(len(cuts))[None] < tabs[at, None])).any(1)]
            at = at[np.einsum("ij,ij->i", vectors[at], vectors[at + lag]) >= threshold]
            np.add.at(links, at, times[at + lag])
            np.add.at(links, at + lag, times[at])
            ends.append((nodes[at], nodes[at + lag]))
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own_rows = slice(start, start + size)
            got, parent = _bucket(vectors[own_rows], keys[own_rows, : tabs[start]], nodes[own_rows], own[own_rows], times[own_rows], bool(across[start]), threshold)
            links[own_rows] = got
            ends.append((nodes[own_rows], parent))
        some = links > 0
        left, right = (np.concatenate([np.zeros(0, np.int64), *(e[i] for e in ends)]) for i in (0, 1))
        counts = pd.DataFrame({"node": nodes[some], "links": links[some], "parent": nodes[some]})
        return pd.concat([counts, pd.DataFrame({"node": left, "links": 0, "parent": right})[left != right]])

    found = cut(dealt.groupBy("part").applyInPandas(compare, "node long, links long, parent long"))
    edges = found.select("node", F.col("parent").alias("other"))
    joined = connected_components(edges.where("node <> other"), "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = classes.select("node", "times", "least").join(links, "node", "left").join(joined.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = grouped.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = every.select("vec_id", "node").join(per_class, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast(root_kind).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _bucket(vectors: np.ndarray, earlier: np.ndarray, nodes: np.ndarray, own: np.ndarray, times: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of one large bucket, and the row from which a search first reached it (or itself)."""

    def near(side) -> np.ndarray:
        found = vectors[side] @ vectors.T >= threshold
        found &= nodes[side, None] != nodes[None]
        if across:
            found &= own[side, None] != own[None]
        for key in earlier.T:
            found &= key[side, None] != key[None]
        return found

    links = np.concatenate([near(slice(a, a + 512)) @ times for a in range(0, len(nodes), 512)])
    left, parent = links > 0, nodes.copy()
    for seed in np.flatnonzero(left).tolist():
        front = [seed] if left[seed] else []
        left[seed] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(near(slice(at, at + 1))[0] & left)
            left[new] = False
            parent[new] = nodes[at]
            front += new.tolist()
    return links, parent
