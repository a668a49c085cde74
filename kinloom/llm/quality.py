"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A rule is a feature of the text and a limit. Costs (seconds a document) and selectivities (share rejected) are
measured on a bounded sample, and rules run in the order of share / cost, so that cheap rules that reject much come
first. A document leaves at the first rule that rejects it; features that several rules share are computed once.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.bpe import batches

#: Rows at most from which costs and selectivities are estimated.
SAMPLE_ROWS = 400

#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"


class Features:
    """Lazily computed features of one text (UTF-8). Words are runs of anything but ASCII white space."""

    __slots__ = ("_memo", "_words", "raw")

    def __init__(self, text: str) -> None:
        self.raw, self._words, self._memo = text.encode("utf-8", "surrogatepass"), None, {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def get(self, name: str) -> float:
        if name not in self._memo:
            self._memo[name] = getattr(self, f"_{name}")()
        return self._memo[name]

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        bare = self.raw.translate(None, SPACE)
        # a code point has one byte that is not a continuation byte
        return len(bare) if bare.isascii() else int(np.count_nonzero(np.frombuffer(bare, np.uint8) & 0xC0 != 0x80))

    def _n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def _n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip(SPACE)]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        n = len(self.words)
        if n < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, n)
        if len(index) < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1].astype(np.int64)
            keys = (pair[:-1] << 32) | ids[2:]
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        same = sorted_[1:] == sorted_[:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(keys) + 2, bool)
        twice[order[np.append(same, False) | np.append(False, same)]] = True
        return int(np.count_nonzero(twice | np.append(False, twice[:-1]) | np.append([False, False], twice[:-2])))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the features and says whether the text goes."""

    name: str
    rejects: Callable[[Features], bool]


def _too_few(f: Features) -> bool:
    return f.get("n_words") < 50


def _repeats(f: Features) -> bool:
    return 100 * f.get("n_repeat_words") > 50 * f.get("n_words")


def _symbols(f: Features) -> bool:
    return f.get("n_symbols") > f.get("n_words")


def _dup_lines(f: Features) -> bool:
    return 100 * f.get("n_dup_lines") > 50 * (1 + f.raw.count(b"\n"))


def _word_length(f: Features) -> bool:
    return not 2 * f.get("n_words") <= f.get("word_chars") <= 20 * f.get("n_words")


BASE = ("too_few_words", "repeated_words")
RULES = (Rule("too_few_words", _too_few), Rule("repeated_words", _repeats), Rule("symbols", _symbols), Rule("duplicate_lines", _dup_lines), Rule("word_length", _word_length))


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> list[tuple[str, float, float]]:
    """Rules in the order to run, with measured cost (s a document) and share rejected.

    The sample holds ``sample_rows`` rows at the most, whole texts, from the first partitions that fill it; only sums
    reach the driver. The order follows measured times and may differ from run to run; verdicts do not.
    """
    total = docs.count()
    share = min(1.0, 1.5 * sample_rows / max(1, total))

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(stream, 0):
            seconds, gone = [], []
            for rule in rules:
                features = [Features(t) for t in texts]
                began = time.perf_counter()
                gone.append(sum(map(rule.rejects, features)))
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(seconds, pa.float64()), pa.array(gone, pa.int64()), pa.array([len(texts)] * len(rules), pa.int64())], ["name", "seconds", "gone", "n"])

    sample = docs.select(text_col).sample(share, seed).limit(sample_rows)
    sums = {r[0]: r[1:] for r in sample.mapInArrow(measure, "name string, seconds double, gone long, n long").groupBy("name").agg(F.sum("seconds"), F.sum("gone"), F.sum("n")).collect()}
    measured = []
    for rule in rules:
        seconds, gone, n = sums.get(rule.name, (0.0, 0, 0))
        measured.append((rule.name, max(1e-7, seconds / max(1, n)), gone / max(1, n)))
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[1], m[0]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None, all_features: bool = False) -> DataFrame:
    """``doc_id``, ``kept``, ``rejected_by`` (first rule of the cascade that rejects, else null), ``rules_run``.

    With ``all_features`` also ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``
    (one of the two base rules rejects), which makes every feature of every document be computed. A null or empty
    text has no words and is rejected. Every row gets a verdict of its own; other columns are not carried.
    """
    by_name = {r.name: r for r in rules}
    names = order or [m[0] for m in plan(docs, rules, text_col)]
    chain = [by_name[n] for n in names]
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if all_features else ()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream):
            kept, by, ran, base, values = [], [], [], [], [[] for _ in stats]
            for text in texts:
                features = Features(text)
                gone = next((i for i, r in enumerate(chain) if r.rejects(features)), None)
                kept.append(gone is None)
                by.append(None if gone is None else chain[gone].name)
                ran.append(len(chain) if gone is None else gone + 1)
                if stats:
                    base.append(_too_few(features) or _repeats(features))
                    for own, name in zip(values, stats, strict=True):
                        own.append(features.get(name))
            columns = [batch.column(0), pa.array(kept, pa.bool_()), pa.array(by, pa.string()), pa.array(ran, pa.int32())]
            if stats:
                columns += [pa.array(base, pa.bool_()), *(pa.array(v, pa.int64()) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), T.StructField("rules_run", T.IntegerType())])
    if stats:
        schema = T.StructType([*schema.fields, T.StructField("base_failed", T.BooleanType()), *(T.StructField(s, T.LongType()) for s in stats)])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns, in one pass and without a join."""
    by_name = {r.name: r for r in rules}
    chain = [by_name[n] for n in (order or [m[0] for m in plan(docs, rules, text_col)])]
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, at):
            keep = [not any(r.rejects(f) for r in chain) for f in map(Features, texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
