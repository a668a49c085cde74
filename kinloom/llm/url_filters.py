"""URL filtering by stated rules and by association rules that Spark's FP-growth mines from labelled URLs.

A URL is a set of tokens (top-level domain, site, host, path words, query keys, extension, ...). Tokens that stand in
the same labelled URLs are one item, as sets of them would double with each; rules take any of them in its place.
FP-growth mines item sets that go with a label; rules are pruned by support and confidence, and a rule that a shorter
one of no less confidence implies is dropped. What is left is bounded by the support, not by the data. An inverted
index from tokens to rules counts, for a URL, how many items of each rule it has; a rule fits when all are there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.plans.lineage import cut

#: The stated rules as (verdict, host, path).
STATED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """The longest stated rule that fits (host and all subdomains, start of the path) and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, sorted; none for null or a URL without ``://``."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return []
    host = re.match("[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    path, _, fragment = tail.partition("#")
    path, _, query = path.partition("?")
    labels = host.lower().split(".")
    found = {f"scheme:{scheme.lower()}", f"tld:{labels[-1]}", f"site:{'.'.join(labels[-2:])}", f"depth:{min(9, path.strip('/').count('/') + bool(path.strip('/')))}"}
    found |= {f"sub:{x}" for x in labels[:-2]}
    for part in path.split("/"):
        if part:
            stem, dot, end = part.rpartition(".")
            if dot and end.isalpha():
                found.add(f"ext:{end.lower()}")
                part = stem
            found |= {f"path:{w}" for w in re.sub("[0-9]+", "0", part.lower()).split("-") if w}
    found |= {f"query:{q.partition('=')[0].lower()}" for q in query.split("&") if q}
    if fragment:
        found.add("fragment")
    return sorted(found)


@dataclass(frozen=True)
class Mined:
    """``tokens`` names one token of each item; ``items`` holds all tokens that may stand for each."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    items: tuple[tuple[str, ...], ...] = ()


def with_tokens(pages: DataFrame, url_col: str = "url", name: str = "tokens") -> DataFrame:
    """``pages`` cut to ``url_col`` and the array of its tokens."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(u) for u in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["url", name])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, T.StructType([T.StructField("url", T.StringType()), T.StructField(name, T.ArrayType(T.StringType()))]))


def mine(labelled: DataFrame, min_support: float = 0.02, min_confidence: float = 0.9) -> list[Mined]:
    """Rules from all rows of ``labelled (tokens, label)``, best first.

    Only rules that end in a label are kept, and of those none whose tokens include another rule's for the same
    label with at least its confidence. No labelled rows, no rules. Their number and that of the items depend on
    ``min_support`` alone: what reaches the driver does not grow with the rows.
    """
    rows = cut(labelled.where("label is not null").select(F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"), "label"))
    total = rows.count()
    if not total:
        return []
    # tokens that stand in the same rows have equal counts and sums of the rows' hashes
    row = F.xxhash64("tokens", "label").cast("decimal(38,0)")
    each = rows.select(F.explode("tokens").alias("token"), row.alias("row")).groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("in"))
    each = each.where(F.col("n") >= min_support * total).groupBy("n", "in").agg(F.array_sort(F.collect_list("token")).alias("item")).collect()
    members = {r["item"][0]: tuple(r["item"]) for r in each}
    chosen = F.array(*(F.lit(t) for t in sorted(members))).cast("array<string>")
    items = rows.select(F.array_union(F.array_intersect("tokens", chosen), F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL))).select("antecedent", "consequent", "confidence", "support").collect()
    named = ((tuple(sorted(r[0])), r) for r in found)
    rules = sorted((Mined(own, r[1][0].removeprefix(LABEL), r[2], r[3], tuple(members[t] for t in own)) for own, r in named), key=lambda m: (-m.confidence, -m.support, len(m.tokens), m.tokens))
    kept: list[Mined] = []
    for m in sorted(rules, key=lambda m: (len(m.tokens), m.tokens)):
        if not any(k.verdict == m.verdict and k.confidence >= m.confidence and set(k.tokens) <= set(m.tokens) for k in kept):
            kept.append(m)
    return sorted(kept, key=rules.index)


class Index:
    """Rules by their tokens."""

    def __init__(self, rules: list[Mined]) -> None:
        self.rules = rules
        self.sizes = [len(r.tokens) for r in rules]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, r in enumerate(rules):
            for k, item in enumerate(r.items or [(t,) for t in r.tokens]):
                for t in item:
                    self.postings[t].append((i, k))

    def best(self, found: list[str]) -> Mined | None:
        """The first rule, in the order given, all of whose items are there."""
        hits: dict[int, set[int]] = defaultdict(set)
        for t in found:
            for i, k in self.postings.get(t, ()):
                hits[i].add(k)
        fits = [i for i, own in hits.items() if len(own) == self.sizes[i]]
        return self.rules[min(fits)] if fits else None


def judge(pages: DataFrame, rules: list[Mined], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence``, a row for each row of ``pages``.

    The stated rule decides where one fits, else the best mined rule, else ``default`` (also for a null url or one
    without ``://``). ``mined_rule`` holds the tokens of the mined rule that fits, joined by commas. Other columns
    are not carried.
    """
    index = Index(rules)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            best = [index.best(tokens(u)) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b and ",".join(b.tokens) for b in best], pa.string()), pa.array([b and b.verdict for b in best], pa.string()), pa.array([b and b.confidence for b in best], pa.float64())],
                schema.names,
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    schema = T.StructType([*rows.schema.fields, T.StructField("mined_rule", T.StringType()), T.StructField("mined", T.StringType()), T.StructField("confidence", T.DoubleType())])
    parts = rows.mapInArrow(run, schema).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = stated_rule(F.col("host"), F.col("path"))
    return parts.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, "mined", F.lit(default))).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def labelled_by_stated(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``(tokens, label)`` of all pages that a stated rule covers: the labels the query mines."""
    rows = with_tokens(pages, url_col)
    return rows.select("tokens", stated_rule(host_of(F.col("url")), path_of(F.col("url")))[1].alias("label")).where("label is not null")
