"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained on a small labelled table (words and labels), by full-batch
gradient ascent on the conditional likelihood with forward-backward sums in numpy, and adds spans that patterns
miss. A word's features are its shape, its classes and those of its neighbours, so scores are kept by word. Decoding
is exact Viterbi in numpy batches: a word whose outside label wins by more than any two transitions can change is
outside on the best path, so texts are cut at such words and only the stretches between them are decoded together.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.bpe import batches

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LABELS = ("O", *KINDS)
CACHE = 300_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them from the left: each match holds one @, its local part reaches back to the last match."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            past = m.end()
        at = text.find("@", max(at + 1, past))


def scan_base(text: str) -> list[Span]:
    """The base spans of a text, by start and then kind."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# features ------------------------------------------------------------------------------------------------------------

EDGE = ".,;:!?\"'"


def shape(word: str) -> str:
    """Letters as X or x, digits as d, in runs of at most four; other characters stay."""
    out = []
    for c in word:
        k = "d" if c in "0123456789" else ("X" if c.isupper() else "x") if c.isalpha() else c
        if out[-4:] != [k] * 4:
            out.append(k)
    return "".join(out)


def features(word: str) -> list[str]:
    bare = word.strip(EDGE)
    if bare.isalpha():
        return ["alpha", "alpha:X" if bare[:1].isupper() else "alpha:x", f"alpha:{bare.lower()}" if bare.lower() in ("at", "dot") else "alpha:other"]
    digits = sum(c in "0123456789" for c in bare)
    return [f"shape:{shape(bare)}", f"digits:{min(digits, 20)}", f"at:{'@' in bare}", f"dots:{min(bare.count('.'), 4)}", f"dashes:{min(bare.count('-'), 4)}", f"first:{shape(bare[:1])}", f"last:{shape(bare[-1:])}", f"only:{not bare.strip('0123456789')}", f"letters:{any(c.isalpha() for c in bare)}", f"hex:{bool(re.fullmatch('[0-9a-f]{12,}', bare))}"]


def coarse(word: str) -> str:
    """The class that a word shows to its neighbours."""
    bare = word.strip(EDGE)
    return "alpha" if bare.isalpha() else shape(bare) if len(bare) <= 8 else "long"


def spread(word: str) -> list[list[str]]:
    """Features of a word for itself, for the word after it and for the word before it."""
    near = coarse(word)
    return [features(word), [f"before:{near}"], [f"after:{near}"]]


# the labelled table --------------------------------------------------------------------------------------------------


def labelled_rows(n: int = 600, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: sentences of made-up words with personal data in many formats, and look-alikes outside."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "la", "ei", "ue", "do", "sh", "ti", "é", "ü"]) for _ in range(r.randint(1, 5)))
    name = lambda: f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{r.choice(['', digits(2)])}"

    def card() -> str:
        body = r.choice("3456") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    inside = {
        "email": [lambda: f"{name()}@{word()}.{word()}.com", lambda: f"{name()}@mail{r.randint(1, 9)}.{word()}.org", lambda: f"{name()}(at){word()}.com", lambda: f"{name()}[at]{word()}[dot]com"],
        "ip": [lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)) + f":{r.randint(80, 9999)}"],
        "card": [card, lambda: " ".join(re.findall("....", card())), lambda: "-".join(re.findall("....", card()))],
        "phone": [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 99)}{digits(10)}"],
    }
    outside = [lambda: str(r.randint(0, 99)), lambda: str(r.randint(1000, 2100)), lambda: digits(r.randint(3, 13)), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), lambda: f"https://{word()}.com/{word()}/{digits(4)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{word()}$$$", lambda: "|", lambda: f"({word()})", lambda: f"{word()}-{word()}", lambda: "AKIA" + "".join(r.choice("ABCDEFGH0123456789") for _ in range(16)), lambda: f"{digits(r.randint(20, 30))}", lambda: f"{word()}=", lambda: f'"{word()}{digits(3)}"', lambda: "=", lambda: "+", lambda: f"({digits(2)})", lambda: f"{digits(3)}-{digits(2)}", lambda: f"[{digits(1)}]", lambda: f"{digits(2)}%", lambda: word() + r.choice("$%&*#|<>~^") * r.randint(1, 4), lambda: word() + r.choice(".,;:") + r.choice("$%&*#") * 3, lambda: f"{r.choice(['password', 'token', 'key'])}={digits(4)}{word()}{digits(5)}", lambda: r.choice("$%&*#") * 3 + word(), lambda: f"{word()}@{word()}", lambda: f"@{word()}"]
    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 4)):
            plain = [w.capitalize() if r.random() < 0.15 else w for w in (word() for _ in range(r.randint(1, 6)))]
            words += plain
            labels += ["O"] * len(plain)
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                own = r.choice(inside[kind])().split(" ")
            else:
                kind, own = "O", [r.choice(outside)() for _ in range(r.choice([1, 1, 1, 2, 3]))]
            if r.random() < 0.2:
                own[-1] += r.choice(".,;")
            words += own
            labels += [kind] * len(own)
        words.append(word() + ".")
        labels.append("O")
        rows.append((words, labels))
    return rows


class Crf:
    """Weights of a trained field."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.features, self.weights, self.moves = index, weights, moves
        self.reset()
        n = moves.shape[0]
        swing = moves[:, 1:, None] + moves.T[None, :, :][:, :, 1:].transpose(0, 2, 1)  # [a, k, b]
        self.swing = float((swing - (moves[:, 0][:, None, None] + moves[0, :][None, None, :])).max())
        assert n == len(LABELS)

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.table = np.zeros((0, 3, len(LABELS)))

    def __getstate__(self):
        return self.features, self.weights, self.moves

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words in a row; texts are kept apart by the empty word."""
        if len(self.words) > CACHE:
            self.reset()
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            table = np.zeros((len(new), 3, len(LABELS)))
            kinds: dict[str, np.ndarray] = {}
            for i, w in enumerate(new):
                known[w] = len(known)
                if w:
                    bare = w.strip(EDGE)
                    key = f"\0{bare[:1].isupper()}" if bare.isalpha() and bare.lower() not in ("at", "dot") else w
                    if key not in kinds:
                        kinds[key] = np.array([sum((self.weights[self.features[f]] for f in fs if f in self.features), np.zeros(len(LABELS))) for fs in spread(w)])
                    table[i] = kinds[key]
            self.table = np.concatenate([self.table, table])
        rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        own, after, before = self.table[rows, 0], self.table[rows, 1], self.table[rows, 2]
        own[1:] += after[:-1]
        own[:-1] += before[1:]
        own[rows == known.get("", -1)] = [0.0] + [-1e9] * (len(LABELS) - 1)
        return own

    def decode(self, words: list[str]) -> np.ndarray:
        """The best labels of words in a row (empty words, between texts, are outside)."""
        if not words:
            return np.zeros(0, np.int64)
        e = self.scores(["", *words, ""])
        open_ = e[:, 0] - e[:, 1:].max(1) <= self.swing
        labels = np.zeros(len(e), np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return labels[1:-1]
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still open are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        score = e[starts] + self.moves[0]
        steps = int(lengths[0])
        back: list[np.ndarray] = []
        for t in range(1, steps):
            live = int(np.searchsorted(-lengths, -t, "left"))
            paths = score[:live, :, None] + self.moves[None]
            best = paths.argmax(1)
            back.append(best)
            score[:live] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + e[starts[:live] + t]
        last = (score + self.moves[:, 0]).argmax(1)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            labels[starts[:live] + t] = last[:live]
            if t:
                last[:live] = back[t - 1][np.arange(live), last[:live]]
        return labels[1:-1]


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Fit a field to labelled rows: Adam on the mean conditional log-likelihood with an L2 penalty."""
    texts = [[spread(w) for w in words] for words, _ in rows]
    index: dict[str, int] = {}
    most, count, labels = max(map(len, texts)), len(texts), len(LABELS)
    where, feats = [], []
    for i, text in enumerate(texts):
        for t in range(len(text)):
            own = text[t][0] + (text[t - 1][1] if t else []) + (text[t + 1][2] if t + 1 < len(text) else [])
            for f in own:
                where.append(i * most + t)
                feats.append(index.setdefault(f, len(index)))
    where_, feats_ = np.array(where), np.array(feats)
    lengths = np.array(list(map(len, texts)))
    mask = np.arange(most)[None] < lengths[:, None]
    gold = np.zeros((count, most), np.int64)
    for i, (_, own) in enumerate(rows):
        gold[i, : len(own)] = [LABELS.index(x) for x in own]
    hot = np.eye(labels)[gold] * mask[..., None]
    both = mask[:, 1:, None, None]
    gold_moves = (hot[:, :-1, :, None] * hot[:, 1:, None, :] * both).sum((0, 1))
    gold_moves[0] += hot[:, 0].sum(0)
    ends = hot[np.arange(count), lengths - 1]
    gold_moves[:, 0] += ends.sum(0)
    w, moves = np.zeros((len(index), labels)), np.zeros((labels, labels))
    first, second = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    # one row for each (word, feature); sums by sorting once
    by_where, by_feat = np.argsort(where_, kind="stable"), np.argsort(feats_, kind="stable")
    where_starts = np.flatnonzero(np.diff(where_[by_where], prepend=-1))
    where_ids = where_[by_where][where_starts]
    feat_starts = np.flatnonzero(np.diff(feats_[by_feat], prepend=-1))
    for step in range(1, rounds + 1):
        e = np.zeros((count * most, labels))
        e[where_ids] = np.add.reduceat(w[feats_[by_where]], where_starts)
        e = e.reshape(count, most, labels)
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + moves[None], 1) + e[:, t], alpha[:, t - 1])
        total = lse(alpha[:, -1] + moves[:, 0], 1)
        beta[np.arange(count), lengths - 1] = moves[:, 0]
        for t in range(most - 2, -1, -1):
            inner = lse(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], inner, beta[:, t])
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both
        model_moves = pair.sum((0, 1))
        model_moves[0] += p[:, 0].sum(0)
        model_moves[:, 0] += p[np.arange(count), lengths - 1].sum(0)
        diff = (hot - p).reshape(-1, labels)
        grads = [np.add.reduceat(diff[where_[by_feat]], feat_starts) / count - decay * w, (gold_moves - model_moves) / count - decay * moves]
        for x, g, a, b in zip((w, moves), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(index, w, moves)


def plausible(kind: str, text: str) -> bool:
    """Whether a stretch has what every datum of its kind has; keeps the field from naming mere punctuation."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        return "@" in text[1:-1] or bool(re.search(r"[(\[ ]at[)\] ]", text.lower()))
    return digits >= {"ip": 4, "card": 12, "phone": 7}[kind]


def crf_spans(model: Crf, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text, without the punctuation around them."""
    words, counts = [], []
    for text in texts:
        own = text.split()
        counts.append(len(own))
        words += own
        words.append("")
    labels = model.decode(words)
    out: list[list[Span]] = []
    at = 0
    for text, n in zip(texts, counts, strict=True):
        own = labels[at : at + n]
        at += n + 1
        found: list[Span] = []
        if own.any():
            places = [m.span() for m in re.finditer(r"\S+", text)]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                if own[a]:
                    start, end = places[a][0], places[b - 1][1]
                    while start < end and text[start] in EDGE:
                        start += 1
                    while end > start and text[end - 1] in EDGE:
                        end -= 1
                    if start < end and plausible(LABELS[own[a]], text[start:end]):
                        found.append((LABELS[own[a]], start, end))
        out.append(found)
    return out


def beside(text: str, spans: list[Span], base: list[Span]) -> list[Span]:
    """The field's ``spans`` without the words of ``base`` spans: the parts between these that are plausible."""
    out = []
    for kind, start, end in spans:
        met = sorted((b[1], b[2]) for b in base if start < b[2] and b[1] < end)
        if not met:
            out.append((kind, start, end))
            continue
        at = start
        for b, e in [*met, (end, end)]:
            while at < b < end and not text[b - 1].isspace():
                b -= 1
            stop = b
            while at < stop and text[at] in EDGE + " \t\r\n":
                at += 1
            while at < stop and text[stop - 1] in EDGE + " \t\r\n":
                stop -= 1
            if at < stop and plausible(kind, text[at:stop]):
                out.append((kind, at, stop))
            at = max(at, e)
            while at < end and not text[at].isspace():
                at += 1
    return out


FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_pii(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``findings`` (array of ``kind, start, end, base``; code points of the text, end exclusive).

    Base spans are those of the patterns; of the field's spans only what lies outside the words of base spans is kept. One row per row
    of ``docs``; a null text counts as empty. Other columns are not carried. Without ``model`` one is trained from
    :func:`labelled_rows`.
    """
    field = model or train(labelled_rows())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch, texts in batches(stream):
            rows = []
            for text, more in zip(texts, crf_spans(field, texts), strict=True):
                base = scan_base(text)
                own = [(*s, True) for s in base] + [(*s, False) for s in beside(text, more, base)]
                own.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "findings"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("findings", FINDING)]))
