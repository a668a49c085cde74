"""Packing documents into training sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded, ended with a separator id and cut at the sequence length. Pieces are dealt by a hash of their
document (and, for rows alike, of their number in a batch, so that no group grows with these) into randomised groups of about ``GROUP`` documents, and each group is packed on its own, so the work of a
task is bounded and groups never wait for each other. Inside a group pieces go by falling length into the first bin
with room, found by descending a tournament tree whose nodes hold the largest room below them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import bpe

LENGTH, SEPARATOR, GROUP, SEED = 4096, 2, 4000, 17


class Tournament:
    """Bins of equal capacity; ``put`` gives the first bin with room and takes the room."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each size (at most ``capacity``); equal sizes go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree, filled = Tournament(max(1, len(sizes)), capacity), [0] * max(1, len(sizes))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        bins[i] = b = tree.put(size)
        offsets[i] = filled[b]
        filled[b] += size
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR, with_ids: bool = False, groups: int = 0) -> DataFrame:
    """Encoded documents cut at ``length``: ``doc_id, start, length, ids_crc32, doc_tokens``, and on demand ``ids`` and
    ``pack_group``, the document's one of so many random groups.

    Every document has a piece at least, since its ids end with ``separator``; a null text counts as empty. Other
    columns of ``docs`` are not carried.
    """
    where = path or bpe.default_path()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(where)
        for batch, texts in bpe.slices(stream):
            row, start, size, crc, total, own, group = [], [], [], [], [], [], []
            copies: Counter[str] = Counter()
            names_of = batch.column(0).to_pylist() if groups else []
            for i, ids in enumerate(model.encode(texts)):
                ids = np.append(ids, separator).astype("<u4")
                if groups:
                    key = f"{SEED} {names_of[i]} {len(ids)} {zlib.crc32(ids.tobytes())}"
                    copies[key] += 1
                    mine = xxhash.xxh3_64_intdigest(f"{key} {copies[key]}") % groups
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    row.append(i), start.append(at), size.append(len(part)), total.append(len(ids))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        own.append(part.astype(np.int32))
                    if groups:
                        group.append(mine)
            longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *longs, *([bpe._lists(own)] if with_ids else []), *([pa.array(group, pa.int64())] if groups else [])], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    if groups:
        schema.add("pack_group", T.LongType())
    names = schema.names
    return rows.mapInArrow(run, schema)


def _groups(docs: DataFrame, group: int = GROUP) -> int:
    """Groups grow in number with the documents, not in size."""
    return max(1, -(-docs.count() // group))


def _filled(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's pieces by falling length and then as they are named, with the bin and offset of each."""
    keys = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32"))]
    table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
    return table, *first_fit_decreasing(table["length"].to_numpy(), capacity)


def place(docs: DataFrame, capacity: int = LENGTH, **options) -> DataFrame:
    """Where each piece goes: the columns of :func:`pieces` with ``sequence_id`` and ``offset`` (gapless from 0).

    Repeated documents are packed as often as they occur. Null ids are packed like others. No documents, no rows.
    """
    cut = pieces(docs, length=capacity, groups=_groups(docs), **options)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, bins, offsets = _filled(table, capacity)
        return table.drop_columns("pack_group").append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = T.StructType([*cut.drop("pack_group").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return cut.groupBy("pack_group").applyInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = LENGTH, pad: int = 0, **options) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens``, ``ids`` padded to ``capacity`` and what they hold
    (arrays ``doc_ids``, ``starts``, ``lengths``, in order of their place)."""
    cut = pieces(docs, length=capacity, with_ids=True, groups=_groups(docs), **options)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["ids"].combine_chunks()
        begins, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        table, bins, offsets = _filled(table.drop_columns("ids").append_column("row", pa.array(np.arange(len(table)))), capacity)
        order = np.lexsort((offsets, bins))
        table, bins, offsets = table.take(pa.array(order)), bins[order], offsets[order]
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        lengths = table["length"].to_numpy()
        out = np.full((len(first), capacity), pad, np.int32)
        sequence = np.cumsum(np.append(False, bins[1:] != bins[:-1]))
        for row, at, offset, n in zip(table["row"].to_pylist(), sequence.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
            out[at, offset : offset + n] = flat[begins[row] : begins[row] + n]
        packed = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * capacity), pa.array(out.ravel()))
        edges = pa.array(np.append(first, len(bins)).astype(np.int32))
        held = [pa.ListArray.from_arrays(edges, table[c].combine_chunks()) for c in ("doc_id", "start", "length")]
        return pa.Table.from_arrays([pa.array((key[0].as_py() << 32) + bins[first]), pa.array(np.add.reduceat(lengths, first)), packed, *held], names)

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(cut.schema["doc_id"].dataType)), T.StructField("starts", longs), T.StructField("lengths", longs)])
    names = schema.names
    return cut.groupBy("pack_group").applyInArrow(run, schema)
