"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes.  In each window one gated
recurrent unit reads forwards and one backwards; both states of a position give the
probabilities of the languages there, so every byte is labelled.  A document's probabilities
are the means over its letters (ASCII letters and bytes beyond ASCII).

The network is trained in numpy by backpropagation through time (Adam on the cross-entropy of
every letter's label), on the driver, on at most ``FIT_WINDOWS`` windows a language, chosen by
hashes anywhere in the texts: one a document, or up to ``FIT_EACH`` where documents are few.  Documents are labelled in one map-only pass over whole texts;
memory is bounded by ``ROWS`` windows, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType

from quillweave.llm.common import ship
from quillweave.llm.fm_quality import held_out

WINDOW = 64
HIDDEN = 16
#: windows a language, and commonest languages, that the network is fitted on at most
FIT_WINDOWS, FIT_LANGUAGES = 1500, 64
#: windows of one document at most
FIT_EACH = 16
#: steps of training, whatever the number of windows, and windows a step
STEPS, BATCH, RATE = 400, 64, 0.012
#: windows labelled at a time
ROWS = 2048
#: the input beyond a text's end
PAD = 256
UNKNOWN = "und"
_ANY_LETTER = regex.compile(r"\p{L}")
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)] + [False])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Gru:
    """One direction: bytes x (time, rows) to states (time, rows, hidden)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        # update gate, reset gate, candidate side by side; a byte's row of ``of_byte`` is its embedding times the input weights
        self.of_byte = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32)
        self.of_state = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.hidden
        given, felt = self.of_byte[x], h @ self.of_state
        gates = given[:, : 2 * k] + felt[:, : 2 * k]
        np.clip(gates, -30, 30, out=gates)
        _sigmoid(gates)
        update, reset = gates[:, :k], gates[:, k:]
        new = felt[:, 2 * k :] * reset
        new += given[:, 2 * k :]
        new *= 2
        np.clip(new, -30, 30, out=new)
        _sigmoid(new)
        new *= 2
        new -= 1
        out = h - new
        out *= update
        out += new
        return out, update, reset, new, felt[:, 2 * k :]

    def states(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The states alone, one at a time in one buffer.

        Each gate has contiguous tables of its own, with the sign and scale of its exponent in them.
        """
        k, n = self.hidden, x.shape[1]
        parts = [(slice(i * k, (i + 1) * k), scale) for i, scale in enumerate((-1, -1, -2))]
        of_byte = [np.ascontiguousarray(self.of_byte[:, p] * np.float32(scale)) for p, scale in parts]
        of_state = [np.ascontiguousarray(self.of_state[:, p] * np.float32(scale)) for p, scale in parts]
        given, update, reset, new, h = (np.zeros((n, k), np.float32) for _ in range(5))
        with np.errstate(over="ignore"):  # the exponential of a closed gate is infinite, and its inverse 0
            for row in x:
                for gate, table, weights in zip((update, reset), of_byte, of_state):
                    np.matmul(h, weights, out=gate)
                    gate += np.take(table, row, axis=0, out=given, mode="clip")
                    np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                np.matmul(h, of_state[2], out=new)
                new *= reset
                new += np.take(of_byte[2], row, axis=0, out=given, mode="clip")
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                h -= new
                h *= update
                h += new
                yield h

    def back(self, x: np.ndarray, states: list[tuple], slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both tables; ``states`` as ``step`` gave them in order, ``slopes`` of each state."""
        k = self.hidden
        of_byte, of_state = np.zeros_like(self.of_byte), np.zeros_like(self.of_state)
        carried = np.zeros_like(slopes[0])
        for t in range(len(states) - 1, -1, -1):
            _, update, reset, new, felt = states[t]
            before = states[t - 1][0] if t else np.zeros_like(new)
            slope = slopes[t] + carried
            d_new = slope * (1 - update) * (1 - new * new)
            d_update = slope * (before - new) * update * (1 - update)
            d_reset = d_new * felt * reset * (1 - reset)
            given = np.concatenate([d_update, d_reset, d_new], axis=1)
            heard = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
            np.add.at(of_byte, x[t], given)
            of_state += before.T @ heard
            carried = slope * update + heard @ self.of_state.T
        return of_byte, of_state


class ByteTagger:
    """Forward and backward units and the layer that labels positions."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.units = [Gru(rng, hidden), Gru(rng, hidden)]
        self.out = rng.normal(0, 0.1, (2, hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    @cached_property
    def parameters(self) -> list[np.ndarray]:
        return [*(table for unit in self.units for table in (unit.of_byte, unit.of_state)), self.out, self.bias]

    def _run(self, unit: Gru, x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        h = np.zeros((x.shape[1], unit.hidden), np.float32)
        for row in x:
            step = unit.step(row, h)
            h = step[0]
            yield step

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each position (time, language, rows) the probabilities; only sums of both directions are held."""
        scores = np.empty((len(x), len(self.languages), x.shape[1]), np.float32)
        for t, h in enumerate(self.units[0].states(x)):
            np.matmul(self.out[0].T, h.T, out=scores[t])
        for t, h in enumerate(self.units[1].states(x[::-1])):
            scores[-1 - t] += self.out[1].T @ h.T
        scores += self.bias[:, None]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all letters, for ``parameters``."""
        steps = [list(self._run(self.units[0], x)), list(self._run(self.units[1], x[::-1]))]
        ahead = np.stack([s[0] for s in steps[0]])
        behind = np.stack([s[0] for s in steps[1]])
        scores = ahead @ self.out[0] + behind[::-1] @ self.out[1] + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        slope = np.exp(scores)
        slope /= slope.sum(axis=2, keepdims=True)
        slope[:, np.arange(x.shape[1]), label] -= 1
        letters = _LETTER[x]
        slope *= (letters / max(letters.sum(), 1)).astype(np.float32)[:, :, None]
        of_out = np.stack([np.einsum("tbh,tbl->hl", ahead, slope), np.einsum("tbh,tbl->hl", behind[::-1], slope)])
        back = [self.units[0].back(x, steps[0], slope @ self.out[0].T), self.units[1].back(x[::-1], steps[1], (slope @ self.out[1].T)[::-1])]
        return [*back[0], *back[1], of_out, slope.sum(axis=(0, 1))]

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam in a seeded order; ``windows`` are rows of ``WINDOW`` inputs."""
        first, second = ([np.zeros_like(p) for p in self.parameters] for _ in range(2))
        rng, t = np.random.default_rng(seed), 0
        batches = max(1, -(-len(windows) // BATCH))
        rounds = -(-steps // batches)
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(len(windows)), batches):
                t += 1
                rate = RATE * (1 - t / (rounds * batches + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                grads = self.gradients(np.ascontiguousarray(windows[part].T), labels[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for p, g, m, v in zip(self.parameters, grads, first, second):
                    g = g / max(1.0, norm)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over each text's letters; of a text without letters all are 0."""
        sums, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for x, of in windows_of(texts):
            inside = _LETTER[x]
            chances = self.probabilities(x)
            chances *= inside[:, None, :]
            np.add.at(sums, of, chances.sum(axis=0).T)
            np.add.at(letters, of, inside.sum(axis=0))
        return sums / np.maximum(letters, 1)[:, None]


def windows_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs (time, rows), text of each row): all bytes of the texts, ``ROWS`` windows at a time."""
    held, of, n = [], [], 0

    def rows() -> tuple[np.ndarray, np.ndarray]:
        return np.ascontiguousarray(np.concatenate(held).T), np.concatenate(of)

    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        for start in range(0, len(data), WINDOW * ROWS):
            part = data[start : start + WINDOW * ROWS]
            cut = np.full(-(-len(part) // WINDOW) * WINDOW, PAD, np.uint16)
            cut[: len(part)] = part
            held.append(cut.reshape(-1, WINDOW))
            of.append(np.full(len(held[-1]), i))
            n += len(held[-1])
            if n >= ROWS:
                yield rows()
                held, of, n = [], [], 0
    if n:
        yield rows()


def as_windows(texts: list[str]) -> np.ndarray:
    """The first ``WINDOW`` bytes of each of the windows that training drew."""
    out = np.full((len(texts), WINDOW), PAD, np.uint16)
    for row, text in zip(out, texts):
        data = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        row[: len(data)] = data
    return out


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", windows: int = FIT_WINDOWS) -> ByteTagger:
    """Network for the languages that rows not held out name, from at most ``windows`` windows a language.

    Rows whose key, language or text is null, or without a letter, teach nothing; the ``FIT_LANGUAGES`` commonest
    languages are learned.  Reruns agree.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    known = rows.filter(F.col("_lang").isNotNull() & F.col("_key").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_key")))
    counts = known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(FIT_LANGUAGES).collect()
    if not counts:
        return ByteTagger([])
    # a share of the rows that has a few times as many windows as wanted, so few rows are ranked
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["_lang"], min(1.0, (3 * windows + 100) / r["count"]))])
    each = F.create_map(*[F.lit(x) for r in counts for x in (r["_lang"], min(FIT_EACH, -(-windows // r["count"])))])
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(5), "_key"), F.lit(1 << 20)) < share[F.col("_lang")] * (1 << 20))
    drawn = drawn.withColumn("_nth", F.explode(F.sequence(F.lit(1), each[F.col("_lang")])))
    spare = F.greatest(F.char_length("_text") - WINDOW, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(6), "_key", "_nth"), spare.cast("bigint")).cast("int") + 1
    drawn = drawn.select("_lang", F.xxhash64(F.lit(7), "_key", "_nth").alias("_draw"), F.substring("_text", start, F.lit(WINDOW)).alias("_window"))
    drawn = drawn.filter(F.col("_window").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_window"))
    got = drawn.withColumn("_place", place).filter(F.col("_place") <= windows).orderBy("_lang", "_place").select("_lang", "_window").toArrow()
    names = got.column("_lang").to_pylist()
    languages = sorted(set(names))
    tagger = ByteTagger(languages)
    if languages:
        label = {name: i for i, name in enumerate(languages)}
        tagger.fit(as_windows(got.column("_window").to_pylist()), np.array([label[x] for x in names]))
    return tagger


def predict(docs: DataFrame, tagger: ByteTagger, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (mean probability, 0 to 1) of every whole text.

    Null texts, and texts without a letter, are ``und`` with score 0, as is any text if nothing
    was learned.  Ties go to the first language by code point; repeated rows are labelled alike;
    null keys and other columns do no harm; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # 2 * (257 + hidden) * 3 * hidden numbers and the labels
    key_type = to_arrow_type(docs.schema[key].dataType)
    schema = docs.select(key).schema.add("lang_pred", StringType(), False).add("score", DoubleType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t if t and net.languages and _ANY_LETTER.search(t) else "" for t in part.column(1).to_pylist()]
                chances = net.pooled(texts)
                best = chances.argmax(axis=1) if net.languages else [0] * len(texts)
                said = [net.languages[k] if t else UNKNOWN for t, k in zip(texts, best)]
                score = [min(1.0, float(row[k])) if t else 0.0 for t, row, k in zip(texts, chances, best)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(key_type), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=schema.names
                )

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def position_labels(tagger: ByteTagger, text: str) -> list[str]:
    """The likeliest language of each byte of one text."""
    out: list[str] = []
    for x, _ in windows_of([text]):
        out += [tagger.languages[k] for k in tagger.probabilities(x).argmax(axis=1).T.reshape(-1)]
    return out[: len(text.encode())]
