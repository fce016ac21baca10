"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (hashed, weighted by the logarithm of their count and
brought to unit length), statistics of its structure (bins of shares: capitals, symbols,
digits, bars, repeated words and lines, ...) and the length that the table states for it.
The machine adds a weight for each feature and, for each pair, the product of two low-rank
vectors; the pairs are summed in linear time, as half of (square of sum - sum of squares).

It is fitted by AdaGrad on the driver, on at most ``FIT_ROWS`` labelled rows chosen by a hash
of their key, and scored in a map-only pass over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from quillweave.llm.common import ship, whole_text

#: labelled rows that the machine is fitted on, at most
FIT_ROWS = 6000
WORD_SLOTS = 1 << 16
RANK = 8
ROUNDS = 6
BINS = 32
#: share of the squared length that words have against one structure bin
WORD_SCALE = 0.7

SHARES = (
    "capitals", "symbols", "digits", "bars", "bangs", "beyond_ascii", "spaces",
    "distinct_words", "repeats_next", "commonest_word", "repeated_lines",
)
COUNTS = ("chars", "words", "lines", "word_length", "stated_chars")
#: a linear and a logarithmic bin for each share, a logarithmic one for each count
SLOTS = WORD_SLOTS + BINS * (2 * len(SHARES) + len(COUNTS))

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SYMBOL = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?" for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])


def features(text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text; a statistic that has no value has the last bin."""
    words = text.split()
    counts = Counter(words)
    data = text.encode()
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, n_words = max(len(data), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(int(bytes_of[_LETTER].sum()), 1)
    shares = (
        bytes_of[_CAPITAL].sum() / letters, bytes_of[_SYMBOL].sum() / n, bytes_of[_DIGIT].sum() / n,
        bytes_of[ord("|")] / n, bytes_of[ord("!")] / n, bytes_of[128:].sum() / n, bytes_of[:33].sum() / n,
        len(counts) / n_words, sum(map(eq, words, words[1:])) / n_words,
        max(counts.values(), default=0) / n_words, 1 - len(set(lines)) / max(len(lines), 1),
    )
    sizes = (len(text), len(words), len(lines), len(text) / n_words, stated if stated is not None and stated >= 0 else None)
    at, bins = WORD_SLOTS, []
    for x in shares:
        bins.append(at + min(BINS - 1, int(x * (BINS - 1))))
        bins.append(at + BINS + (BINS - 1 if x <= 0 else min(BINS - 2, int(-2 * np.log2(x)))))
        at += 2 * BINS
    for x in sizes:
        bins.append(at + (BINS - 1 if x is None else min(BINS - 2, int(2 * np.log2(1 + x)))))
        at += BINS
    of_words = np.fromiter([zlib.crc32(w.encode()) % WORD_SLOTS for w in counts], np.int32, len(counts))
    # words that share a slot are one feature: a row has at most SLOTS entries, and no pair of a slot with itself
    of_words, same = np.unique(of_words, return_inverse=True)
    weights = np.bincount(same, weights=np.log1p(np.fromiter(counts.values(), np.float64, len(counts))), minlength=len(of_words)).astype(np.float32)
    weights *= WORD_SCALE / max(float(np.sqrt((weights * weights).sum())), 1e-6)
    return (
        np.concatenate([np.array(bins, np.int32), of_words]),
        np.concatenate([np.ones(len(bins), np.float32), weights.astype(np.float32)]),
    )


class FactorisationMachine:
    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = 7):
        self.bias = 0.0
        self.weight = np.zeros(slots, np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (slots, rank)).astype(np.float32)

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bias, weights and all pairs of each row; every row has features."""
        slots = np.concatenate([r[0] for r in rows])
        values = np.concatenate([r[1] for r in rows]).astype(np.float64)
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        linear = np.add.reduceat(self.weight[slots] * values, starts)
        part = self.factor[slots] * values[:, None]
        total = np.add.reduceat(part, starts)
        squares = np.add.reduceat((part * part).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -40, 40))) if rows else np.empty(0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1, seed: int = 7) -> None:
        """AdaGrad on the logistic loss, in a seeded order; the rows are the caller's, in a fixed order."""
        if not len(rows) or labels.all():
            self.bias = 40.0  # nothing known against any document
            return
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        seen_w = np.full(self.weight.shape, 1e-2, np.float32)
        seen_v = np.full(self.factor.shape, 1e-2, np.float32)
        order = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in order.permutation(len(rows)):
                slots, values = rows[i]
                x = values[:, None]
                v = self.factor[slots]
                total = (v * x).sum(axis=0)
                margin = self.bias + float(self.weight[slots] @ values) + 0.5 * float(total @ total - ((v * x) ** 2).sum())
                slope = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[i]
                if abs(slope) < 1e-4:
                    continue
                grad_w = slope * values + 1e-5 * self.weight[slots]
                grad_v = slope * (x * total - v * x * x) + 1e-4 * v
                seen_w[slots] += grad_w * grad_w
                seen_v[slots] += grad_v * grad_v
                self.weight[slots] -= rate * grad_w / np.sqrt(seen_w[slots])
                self.factor[slots] -= 0.5 * rate * grad_v / np.sqrt(seen_v[slots])
                self.bias -= 0.01 * slope


def held_out(key: Column) -> Column:
    """Rows that no machine is fitted on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _inputs(df: DataFrame, text: str, stated: str) -> list[Column]:
    length = F.col(stated).cast("bigint") if stated in df.columns else F.lit(None).cast("bigint")
    return [whole_text(text).alias("_text"), length.alias("_stated")]


def fit(
    docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", stated: str = "n_chars"
) -> FactorisationMachine:
    """Machine for ``labels.quality`` from at most ``rows`` rows that are not held out.

    A key with several labels counts with the lowest; null labels and keys are left out.
    Without rows, or with label 1 only, every document scores near 1.
    """
    ship(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    drawn = usable.groupBy(key).agg(F.min("quality").cast("int").alias("_label"))
    drawn = drawn.orderBy(F.xxhash64(key), key).limit(rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts, stated, labels, order = (part.column(i).to_pylist() for i in range(4))
                pairs = [features(t, s) for t, s in zip(texts, stated)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32())), pa.array(labels, pa.int32()), pa.array(order, pa.int64())],
                    names=["slots", "vals", "label", "ord"],
                )

    # at most ``rows`` small rows, so the broadcast is bounded; keys that repeat are cut to the bound again,
    # as rows of features: whole texts are not moved
    chosen = docs.join(F.broadcast(drawn), key).select(*_inputs(docs, text, stated), "_label", F.xxhash64(key, text).alias("_ord"))
    got = chosen.mapInArrow(featurise, "slots array<int>, vals array<float>, label int, ord bigint").orderBy("ord").limit(rows).toArrow()
    machine = FactorisationMachine()
    data = [(np.asarray(s, np.int32), np.asarray(v, np.float32)) for s, v in zip(got.column("slots").to_numpy(), got.column("vals").to_numpy())] if got.num_rows else []
    machine.fit(data, got.column("label").to_numpy().astype(np.float64) if got.num_rows else np.empty(0))
    return machine


def _scored(docs: DataFrame, machine: FactorisationMachine, carried: list[str], text: str, stated: str, low: float) -> DataFrame:
    """``carried`` as c0, c1, ... with ``score``, of the rows that score at least ``low``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS * (RANK + 1) numbers
    taken = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    own = carried.index(text) if text in carried else None  # a text that is carried isn't sent twice
    inputs = docs.select(*taken, *_inputs(docs, text, stated)[own is not None :])
    fields = inputs.select(*[f"c{i}" for i in range(len(carried))]).schema
    types = [to_arrow_type(f.dataType) for f in fields]
    schema = fields.add("score", DoubleType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(len(types) if own is None else own).to_pylist()
                scores = shared.value.scores([features(t or "", s) for t, s in zip(texts, part.columns[-1].to_pylist())])
                columns = [part.column(i).cast(t) for i, t in enumerate(types)]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)
                yield out.filter(pa.array(scores >= low))

    return inputs.mapInArrow(run, schema)


def score(
    docs: DataFrame, machine: FactorisationMachine, *, threshold: float = 0.7, key: str = "doc_id", text: str = "text", stated: str = "n_chars"
) -> DataFrame:
    """``key``, ``score`` (double, 0 to 1) and ``predicted`` of every whole text.

    Null texts count as empty and are scored like any other, texts of any length whole; an absent or
    null stated length has a bin of its own; repeated rows and ties score alike; other columns,
    whatever their names, play no part; an empty table gives no rows.
    """
    scored = _scored(docs, machine, [key], text, stated, 0.0)
    return scored.select(F.col("c0").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, machine: FactorisationMachine, *, threshold: float = 0.7, text: str = "text", stated: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all their columns, that score at least ``threshold``."""
    scored = _scored(docs, machine, docs.columns, text, stated, threshold)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
