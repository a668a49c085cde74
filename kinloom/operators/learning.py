"""Match probabilities by a kernel machine, sweeps over training sizes, batches of alike rows, and column transformers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import similarity
from kinloom.functions.text import ANALYZERS, words
from kinloom.operators import graph
from kinloom.operators.blocking import global_position
from kinloom.operators.evaluation import balanced_split
from kinloom.operators.statistics import draw
from kinloom.plans.lineage import cut


def kernel_features(vector: Column, inputs: int, width: int = 128, gamma: float | None = None, seed: int = 1) -> Column:
    """``width`` random cosines whose products come near ``exp(-gamma * distance ** 2)``; ``gamma`` is ``1 / inputs`` unless given."""
    gamma = 1 / inputs if gamma is None else gamma
    random = np.random.default_rng(seed)
    turn, shift = random.normal(0, np.sqrt(2 * gamma), (inputs, width)), random.uniform(0, 2 * np.pi, width)

    @F.pandas_udf("array<double>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch):
                yield pd.Series(list(np.sqrt(2 / width) * np.cos(np.stack(batch.to_numpy()) @ turn + shift)))
            else:
                yield pd.Series([], dtype=object)

    return array_to_vector(mapped(vector_to_array(vector)))


def kernel_match_probabilities(edges: DataFrame, labelled: DataFrame, columns: tuple[str, ...] = graph.FEATURES, label: str = "is_match", width: int = 128, penalty: float = 1.0) -> DataFrame:
    """``edges`` with ``p_match`` and ``pred`` by a support vector machine with a Gaussian kernel on ``columns``.

    Columns are brought to one scale; the kernel is approximated by ``width`` random cosines, the machine's margins
    become probabilities by a logistic curve, both fitted to all of ``labelled``, which needs both labels (sample it
    beforehand). Nulls count as 0.
    """
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    raw = lambda df: df.withColumn("_raw", array_to_vector(x))
    learnt = raw(labelled.where(F.col(label).isNotNull())).select("_raw", F.col(label).cast("double").alias("_label"))
    scale = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(learnt)
    mapped = lambda df: scale.transform(df).withColumn("_kernel", kernel_features(F.col("_scaled"), len(columns), width))
    learnt = cut(mapped(learnt).select("_kernel", "_label"))
    machine = LinearSVC(featuresCol="_kernel", labelCol="_label", rawPredictionCol="_margin", predictionCol="_side", regParam=1 / max(1.0, penalty * learnt.count()), maxIter=100).fit(learnt)
    curve = LogisticRegression(featuresCol="_margin", labelCol="_label", probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_logit").fit(machine.transform(learnt).select("_margin", "_label"))
    scored = curve.transform(machine.transform(mapped(raw(edges))))
    return scored.select(*edges.columns, vector_to_array("_p")[1].alias("p_match"), F.col("_pred").cast("int").alias("pred"))


def training_size_sweep(edges: DataFrame, sizes: list[int], runs: int = 1, columns: tuple[str, ...] = graph.FEATURES, label: str = "is_match", kernel: bool = False) -> DataFrame:
    """``size, run, matches, retained, total, recall, precision, f1`` of matchers trained on ``size / 2`` edges of each label.

    Each run draws other training edges; the rest of the edges are judged.
    """
    own, out = cut(edges), None
    fit = kernel_match_probabilities if kernel else graph.match_probabilities
    for size in sizes:
        for run in range(runs):
            split = cut(balanced_split(own, size, label, run))
            test = split.where("not train")
            found = fit(test, split.where("train"), columns, label).where("pred = 1")
            row = graph.quality(found, test.where(F.col(label) == 1)).select(F.lit(size).alias("size"), F.lit(run).alias("run"), "*")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no sizes given")
    return out


def batches_of_alike(rows: DataFrame, id_col: str, text: Column, size: int, groups: int = 50, features: int = 1 << 12, seed: int = 1) -> DataFrame:
    """``id, cluster, batch``: rows clustered by k-means on TF-IDF, dealt to batches of ``size`` cluster by cluster.

    Rows of a cluster stand in an order that the seed draws, clusters likewise. Null and empty texts have a zero
    vector; fewer distinct rows than ``groups`` give fewer clusters; an empty table gives no rows.
    """
    own = rows.select(F.col(id_col).alias("id"), words(text).alias("_words"))
    if own.isEmpty():
        return own.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("batch"))
    model = Pipeline(stages=[HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), KMeans(featuresCol="_x", predictionCol="cluster", k=groups, seed=seed)])
    placed = model.fit(own).transform(own).select("id", "cluster")
    ordered = global_position(placed, [draw(seed, "cluster"), F.col("cluster"), draw(seed, "id"), F.col("id")])
    return ordered.select("id", "cluster", F.expr(f"position div {int(size)}").alias("batch"))


def _named(*functions) -> dict:
    return {f.__name__: f for f in functions}


#: Names under which a transformer finds a similarity of two texts, and of their tokens.
OF_TEXTS = _named(similarity.edit_distance, similarity.edit_ratio, similarity.hamming_distance, similarity.jaro, similarity.jaro_winkler, similarity.needleman_wunsch, similarity.smith_waterman, similarity.exact_match)
OF_TOKENS = _named(similarity.jaccard, similarity.cosine, similarity.overlap_count, similarity.overlap_coefficient, similarity.dice)


class PairSimilarity(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that adds the similarity of two text columns, NaN where either is null."""

    first = Param(Params._dummy(), "first", "first text column", TypeConverters.toString)
    second = Param(Params._dummy(), "second", "second text column", TypeConverters.toString)
    feature = Param(Params._dummy(), "feature", "name of the similarity", TypeConverters.toString)
    analyser = Param(Params._dummy(), "analyser", "name of the analyser that gives tokens", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column to add", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, first: str | None = None, second: str | None = None, feature: str | None = None, analyser: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(feature="jaccard", analyser="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        a, b, name, analyser = (self.getOrDefault(p) for p in (self.first, self.second, self.feature, self.analyser))
        for c in (a, b):
            if dict(dataset.dtypes)[c] != "string":
                raise ValueError(f"{c} is no text column")
        return dataset.withColumn(self.getOrDefault(self.outputCol), self._value(F.col(a), F.col(b), name, ANALYZERS[analyser]))

    @staticmethod
    def _value(a: Column, b: Column, name: str, tokens) -> Column:
        if name in OF_TEXTS:
            return OF_TEXTS[name](a, b)
        return F.when(a.isNull() | b.isNull(), F.lit(float("nan"))).otherwise(OF_TOKENS[name](tokens(a), tokens(b)))
