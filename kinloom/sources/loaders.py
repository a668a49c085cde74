"""Profiles (bags of attributes) and ground truth from JSON, CSV, Parquet and pandas; sinks for results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = "array<struct<key:string,value:string>>"


def as_profiles(df: DataFrame, id_col: str, source_id: int = 0, keep: tuple[str, ...] | None = None, split_by: str | None = None) -> DataFrame:
    """``profile_id, source_id, original_id, attributes`` of a table: every other column is an attribute.

    Null values are left out; arrays give one attribute for each element; with ``split_by`` strings are split into
    several values. ``profile_id`` is a hash of source and original id, so it does not depend on partitions.
    """
    attributes: list[Column] = []
    for name, kind in df.dtypes:
        if name.lower() == id_col.lower() or (keep is not None and name not in keep):
            continue
        values = F.col(name).cast("array<string>") if kind.startswith("array") else F.split(F.col(name).cast("string"), split_by, -1) if split_by else F.array(F.col(name).cast("string"))
        attributes.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _under(name)))
    bag = F.filter(F.concat(*attributes), lambda a: a["value"].isNotNull()) if attributes else F.array().cast(ATTRIBUTES)
    original = F.trim(F.col(id_col).cast("string"))
    return df.select(F.xxhash64(F.lit(source_id), original).alias("profile_id"), F.lit(source_id).alias("source_id"), original.alias("original_id"), bag.cast(ATTRIBUTES).alias("attributes"))


def _under(name: str):
    return lambda value: F.struct(F.lit(name).alias("key"), value.alias("value"))


def load_json_profiles(spark: SparkSession, path: str, id_col: str, source_id: int = 0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Profiles of a JSON-lines file; nested objects are flattened to their leaves' names."""
    return as_profiles(flattened(spark.read.json(path, primitivesAsString=True)), id_col, source_id, keep)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns replaced by their fields, to any depth; a clashing name gets its parent's in front."""
    while any(kind.startswith("struct") for _, kind in df.dtypes):
        columns, names = [], {n for n, k in df.dtypes if not k.startswith("struct")}
        for name, kind in df.dtypes:
            if kind.startswith("struct"):
                for field in df.schema[name].dataType.names:
                    own = field if field not in names else f"{name}_{field}"
                    names.add(own)
                    columns.append(F.col(f"`{name}`.`{field}`").alias(own))
            else:
                columns.append(F.col(f"`{name}`"))
        df = df.select(*columns)
    return df


def load_csv_profiles(spark: SparkSession, path: str, id_col: str, source_id: int = 0, separator: str = ",", header: bool = True, split_by: str | None = None) -> DataFrame:
    return as_profiles(spark.read.csv(path, sep=separator, header=header, quote='"', escape='"'), id_col, source_id, split_by=split_by)


def load_pandas_profiles(spark: SparkSession, frame, id_col: str, source_id: int = 0) -> DataFrame:
    return as_profiles(spark.createDataFrame(frame.astype(object).where(frame.notna(), None).astype(str).where(frame.notna(), None)), id_col, source_id)


def load_groundtruth(df: DataFrame, first: str, second: str) -> DataFrame:
    """``id1, id2`` as strings."""
    return df.select(F.col(first).cast("string").alias("id1"), F.col(second).cast("string").alias("id2"))


def convert_groundtruth(truth: DataFrame, profiles1: DataFrame, profiles2: DataFrame | None = None) -> DataFrame:
    """Original ids to ``p1 < p2``; rows that do not resolve are dropped, pairs are distinct."""
    end = lambda p, i: p.select(F.col("original_id").alias(f"id{i}"), F.col("profile_id").alias(f"x{i}"))
    joined = truth.join(end(profiles1, 1), "id1").join(end(profiles2 or profiles1, 2), "id2")
    return joined.select(F.least("x1", "x2").alias("p1"), F.greatest("x1", "x2").alias("p2")).where("p1 < p2").distinct()


def catalog(path: str, kind: str | None = None) -> list[dict]:
    """Entries of a JSON catalog of datasets, of one type if given."""
    with open(path, encoding="utf-8") as file:
        return [e for e in json.load(file) if kind is None or e["type"] == kind]


def load_dataset(spark: SparkSession, entry: dict, base_folder: str = "") -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """``profiles, first, second, truth`` of a catalog's entry; a dirty dataset has one table and no ``second``.

    ``truth`` holds the profile ids of the matches, ``p1 < p2``.
    """
    folder = f"{base_folder}{entry['base_path']}/"
    load = load_json_profiles if entry["format"] == "json" else load_csv_profiles
    read = spark.read.json if entry["format"] == "json" else lambda path: spark.read.csv(path, header=True, quote='"', escape='"')
    first = load(spark, folder + entry["d1"], entry["d1_id_field"])
    second = load(spark, folder + entry["d2"], entry["d2_id_field"], 1) if entry["type"] == "clean" else None
    truth = load_groundtruth(read(folder + entry["gt"]), entry["gt_d1_field"], entry["gt_d2_field"])
    return first.unionByName(second) if second else first, first, second, convert_groundtruth(truth, first, second)


def save_tables(folder: str, **tables: DataFrame) -> None:
    """Profiles, blocks, indexes or truth under their names, as Parquet that other sessions read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, profiles, block_sizes`` from a CSV file with a line of headings."""
    return spark.read.csv(path, header=True, schema="dataset string, profiles int, block_sizes double").where("dataset is not null")


def load_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``left, right, label`` from a file of tab-separated lines."""
    return spark.read.csv(path, sep="\t", quote="", schema="left string, right string, label int")


def matches_of_splits(*splits: DataFrame, first: str = "ltable_id", second: str = "rtable_id", label: str = "label") -> DataFrame:
    """The id pairs labelled 1 of training, validation and test tables together."""
    own = [s.where(F.col(label) == 1).select(first, second) for s in splits]
    out = own[0]
    for s in own[1:]:
        out = out.unionByName(s)
    return out


def filled(df: DataFrame, text: str = "unk") -> DataFrame:
    """Nulls (and NaN) of number columns as 0, of text columns as ``text``; other columns stay."""
    return df.na.fill(0).na.fill(text)


def load_feature_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True).selectExpr("cast(conf_id as int) conf_id", "split(conf, ',') features")


def pandas_stream(df: DataFrame, rows: int, by: list[str] | None = None) -> Iterator:
    """Chunks of ``rows`` rows (the last may be shorter) as pandas frames, ordered by ``by`` if given.

    Tasks pack rows into Arrow streams of at most ``rows`` rows; the driver holds one partition's streams at a time.
    """
    ordered = df.orderBy(*by) if by else df

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                own = batch.slice(at, rows)
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                yield pa.RecordBatch.from_pydict({"stream": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    held, count = [], 0
    for row in ordered.mapInArrow(packed, "stream binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(bytes(row.stream)).read_all())
        count += held[-1].num_rows
        while count >= rows:
            table = pa.concat_tables(held)
            yield table.slice(0, rows).to_pandas()
            held, count = [table.slice(rows)], count - rows
    if count:
        yield pa.concat_tables(held).to_pandas()


def extract_field(profiles: DataFrame, field: str) -> DataFrame:
    """``profile_id, value``: lower-cased values of a field joined by spaces, blanks dropped."""
    own = F.filter("attributes", lambda a: a["key"] == field)
    value = F.lower(F.array_join(F.transform(own, lambda a: a["value"]), " "))
    return profiles.select("profile_id", value.alias("value")).where(F.trim("value") != "")


def write_features(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), single: bool = False) -> None:
    """Parquet in place of what was at ``path``; ``single`` writes one file by one task, for small results."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_statistics(df: DataFrame, path: str, separator: str = ";") -> None:
    df.write.mode("overwrite").csv(path, sep=separator, header=True)
