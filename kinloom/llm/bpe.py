"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the pairs that are new by binary search over
the sorted pair keys, takes for each word the lowest rank, and merges all occurrences of that pair in the word at
once. Words leave the array when none of their pairs can be merged. Texts are cut at ASCII white space first (the
vocabulary's own pattern skips other white space), and a bounded cache (``CACHE`` entries, emptied when full, without
effect on results) holds the ids of each piece.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 600_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that ``rows`` name, one after the other, and their lengths."""
    each = lengths[rows]
    ends = np.cumsum(each)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + each, each)], each


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for, and keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(split)
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token.encode()
        letters = byte_alphabet()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.uint32 if size < 1 << 16 else np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.reset()

    def reset(self) -> None:
        self.index = _Numbers()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in one flat array, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        owner, symbols = np.repeat(np.arange(len(words)), lengths), self.inner[raw]
        final = np.cumsum(lengths)[lengths > 0] - 1
        symbols[final] = self.last[raw[final]]
        done_owner, done_symbols = [], []
        none = np.int64(len(self.ranks))
        rank = np.full(len(symbols), none)  # of the pair that begins here
        stale = np.arange(len(symbols))
        while len(symbols):
            stale = stale[(stale < len(symbols) - 1)]
            stale = stale[owner[stale] == owner[stale + 1]]
            pair = (symbols[stale] * self.base + symbols[stale + 1]).astype(self.keys.dtype)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[stale] = np.where(self.keys[at] == pair, self.ranks[at], none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            each = np.repeat(best, np.diff(np.append(first, len(symbols))))
            over = each == none
            if over.any():
                done_owner.append(owner[over])
                done_symbols.append(symbols[over])
                keep = ~over
                owner, symbols, rank, each = owner[keep], symbols[keep], rank[keep], each[keep]
                if not len(symbols):
                    break
            hit = rank == each
            # in a run such as "aaa" every second pair is taken, from the left
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
                hit &= (place - begun) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[each[at]]
            keep = np.ones(len(hit), bool)
            keep[at + 1] = False
            owner, symbols, rank = owner[keep], symbols[keep], rank[keep]
            # pairs with a merged symbol are new: that which begins there and that which ends there
            at -= np.arange(len(at))
            rank[at] = none
            before = at[at > 0] - 1
            rank[before] = none
            stale = np.concatenate([at, before])
        if not done_owner:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _parts(self, piece: str) -> list[bytes | int]:
        """Words (bytes) and added tokens (ids) of a piece without white space."""
        if "<" not in piece or not self.special.search(piece):
            return self._words(piece)
        out: list[bytes | int] = []
        for part in self.special.split(piece):
            out += [self.added[part]] if part in self.added else self._words(part)
        return out

    def _words(self, part: str) -> list[bytes | int]:
        if not part.isascii():
            # per character, as the library does: a final sigma is not treated apart
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if part.isalpha():
            return [part.encode()]
        if part[-1:] in (",", ".") and part[:-1].isalpha():
            return [part[:-1].encode(), part[-1:].encode()]
        return [w.encode() for w in self.words.findall(part)]

    def pieces(self, pieces: list[str]) -> None:
        """Keep the ids of pieces that the index has just numbered."""
        parts = [self._parts(p) for p in pieces]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        words = [w for p in parts for w in p]
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, sizes = self.merge([w if isinstance(w, bytes) else b"" for w in index])
        if fixed := [(i, w) for w, i in index.items() if isinstance(w, int)]:  # added tokens stand for themselves
            begins = np.cumsum(sizes) - sizes
            ids = np.insert(ids, [begins[i] for i, _ in fixed], [w for _, w in fixed])
            sizes[[i for i, _ in fixed]] = 1
        rows = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        flat, each = _gather(ids, np.cumsum(sizes) - sizes, sizes, rows)
        lengths = np.bincount(np.repeat(np.arange(len(parts)), counts), each, minlength=len(parts)).astype(np.int64)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat]).astype(np.int32)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text (int32), none of them null."""
        if len(self.index) > CACHE:
            self.reset()
        cut = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        pieces = cut.flatten().dictionary_encode()
        known = self.index.__getitem__
        number = np.fromiter(map(known, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.pieces(new)
        rows, ends = number[pieces.indices.to_numpy()], np.cumsum(pc.list_value_length(cut).to_numpy())
        ids, each = _gather(self.flat, self.starts, self.lengths, rows)
        before = np.append(0, np.cumsum(each))
        return np.split(ids, before[ends[:-1]]) if len(ends) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, a space between them: what the library gives for a vocabulary without a decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(stream: Iterator[pa.RecordBatch], text: int = 1, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of about ``most`` bytes of text at the most (one row at least), with their texts, null as empty."""
    for batch in stream:
        column = pc.fill_null(batch.column(text), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at), column.slice(at, end - at)
            at = end
        del batch, column
        pa.default_memory_pool().release_unused()  # a worker's memory is shared with others on its executor


def batches(stream: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """As :func:`slices`, the texts as a list."""
    for part, column in slices(stream, text):
        yield part, column.to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``ids`` (array of int), the whole text's ids.

    A null text counts as empty and gives no ids. Ids of documents may repeat or be null; rows stay apart. Other
    columns are not carried. The vocabulary file at ``path`` must be readable on every executor.
    """
    where = path or default_path()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch, texts in slices(stream):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``decoded`` for rows of ``(doc_id, ids)``; null or no ids give an empty text."""
    where = path or default_path()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in stream:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each whole text and return counts and hashes in place of ids and text.

    Columns: ``doc_id``, ``n_tokens`` (long), ``ids_sha256`` of the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` of the decoded text in UTF-8. Rows as in :func:`encode`; both directions run in one pass,
    so ids never leave the worker.
    """
    where = path or default_path()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch, texts in slices(stream):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))
