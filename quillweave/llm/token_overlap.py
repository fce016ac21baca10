"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are encoded with both vocabularies, a batch at a time.  Token starts are byte offsets, so
``pandas.merge_asof`` (backward, keyed by document) finds for each start the token of the other
side that covers it; the union of both directions, equal starts once, is all overlaps.  Where
tokens of both sides end together a group ends.

Overlaps of identifier pairs are counted over the whole corpus: each task adds up its pairs and
Spark sums them.  The scores of a document look these counts up.  The pair table grows with the
vocabularies, not with the corpus; it is sent to the tasks only if its row count, taken first, is
at most ``SENT_PAIRS`` (of 13 bytes each), else documents' pairs are joined with it by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from quillweave.llm.bpe_stream import byte_symbols
from quillweave.llm.common import keep, ship, whole_text

#: bytes of text that are aligned at a time (one longer text is a batch of its own), and rows
BATCH_BYTES, BATCH_ROWS = 1 << 20, 512
#: rows of the pair table that are sent to every task, at most
SENT_PAIRS = 2_000_000
#: distinct pairs that a task adds up before it hands them on
SUMMED_PAIRS = 1 << 21
#: below this code point both BPE libraries have the same letters, numbers and blanks
SETTLED = "԰"


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: identifiers of texts, special strings being plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"] for t in spec["added_tokens"]}
        pieces = {i: p.encode() if p in added else bytes(back[c] for c in p) for p, i in {**{t["content"]: t["id"] for t in spec["added_tokens"]}, **vocab}.items()}
        self.bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self._fast = self._ranked(spec, pieces)

    @staticmethod
    def _ranked(spec: dict, pieces: dict[int, bytes]):
        """The same vocabulary by ranks, where identifiers go in merge order and the split is the usual one."""
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(model["vocab"]) - len(merges)
        usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None
        if not usual or model["dropout"] or model["ignore_merges"] or any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(merges)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {pieces[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Texts with characters newer than either library's tables go to the file's own library."""
        if self._fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [t.isascii() or max(t) < SETTLED for t in texts]
        others = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self._fast.encode_ordinary(t) if p else next(others).ids for t, p in zip(texts, plain)]


class Pieces:
    """A sentencepiece model file: identifiers of texts, and each piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Aligner:
    """Tokens of both sides, their overlaps and groups, for a batch of texts."""

    def __init__(self, file_a: str, file_b: str):
        self.a, self.b = ByteLevel(file_a), Pieces(file_b)
        self.length_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.length_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.code = np.uint32 if len(self.a.bytes) * len(self.b.bytes) <= 1 << 32 else np.uint64
        # a token with what stands before it: in its group, and where its side of the group begins
        self.says_a = np.array([[f",{i}" for i in range(len(self.a.bytes))], [f";{i}" for i in range(len(self.a.bytes))]], object)
        self.says_b = np.array([[f",{i}" for i in range(len(self.b.bytes))], [f"|{i}" for i in range(len(self.b.bytes))]], object)

    def __call__(self, texts: list[str | None]) -> Aligned:
        ids_a: list[list[int]] = [[] for _ in texts]
        ids_b: list[list[int]] = [[] for _ in texts]
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        both = zip(some, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in some]))
        for i, text, a, b in both:
            data = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == data and b"".join(map(self.b.bytes.__getitem__, b)) == data:
                ids_a[i], ids_b[i] = a, b
        return Aligned(self, ids_a, ids_b)


class Aligned:
    def __init__(self, by: Aligner, ids_a: list[list[int]], ids_b: list[list[int]]):
        self.by, self.n = by, len(ids_a)
        self.a, self.n_a, doc_a, start_a = self._side(ids_a, by.length_a)
        self.b, self.n_b, doc_b, start_b = self._side(ids_b, by.length_b)
        a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(doc_a))})
        b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(doc_b))})
        over_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
        over_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
        #: whether a token starts a group: both sides start there
        self.opens_a = start_b[over_a] == start_a
        self.opens_b = start_a[over_b] == start_b
        rest = ~self.opens_b  # equal starts were found from the other side
        self.link_a = np.concatenate([a["a"].to_numpy(), over_b[rest]])
        self.link_b = np.concatenate([over_a, b["b"].to_numpy()[rest]])
        self.link_doc = np.concatenate([doc_a, doc_b[rest]])
        self.n_groups = np.bincount(doc_a[self.opens_a], minlength=self.n)
        self.n_links = np.bincount(self.link_doc, minlength=self.n)

    @staticmethod
    def _side(ids: list[list[int]], length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Identifiers end to end, tokens a document, and each token's document and start in all bytes."""
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.array(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64)
        size = length[flat]
        return flat, n, np.repeat(np.arange(len(ids)), n), np.cumsum(size) - size

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of the distinct linked pairs, by document."""
        code = self.a[self.link_a] * len(self.by.b.bytes) + self.b[self.link_b]
        order = np.lexsort((code, self.link_doc))
        code, doc = code[order], self.link_doc[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], code[at], np.diff(np.append(at, len(code)))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        group_a, group_b = np.cumsum(self.opens_a) - 1, np.cumsum(self.opens_b) - 1
        first_a, first_b = np.append(np.flatnonzero(self.opens_a), len(self.a)), np.flatnonzero(self.opens_b)
        said = np.empty(len(self.a) + len(self.b), object)
        said[np.arange(len(self.a)) + first_b[group_a]] = self.by.says_a[self.opens_a.astype(np.int8), self.a]
        said[np.arange(len(self.b)) + first_a[group_b + 1]] = self.by.says_b[self.opens_b.astype(np.int8), self.b]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(said[start:end].tolist())[1:] for start, end in zip([0, *ends], ends)]

    def spans(self) -> Iterator[tuple[list, list, list, list]]:
        """Of each document: its tokens on both sides, links (positions) and groups (tokens before each group)."""
        end_a, end_b, end = np.cumsum(self.n_a), np.cumsum(self.n_b), np.cumsum(self.n_links)
        order = np.lexsort((self.link_b, self.link_a, self.link_doc))
        for i in range(self.n):
            a, b = end_a[i] - self.n_a[i], end_b[i] - self.n_b[i]
            links = order[end[i] - self.n_links[i] : end[i]]
            linked = zip((self.link_a[links] - a).tolist(), (self.link_b[links] - b).tolist())
            cuts = zip(np.flatnonzero(self.opens_a[a : end_a[i]]).tolist(), np.flatnonzero(self.opens_b[b : end_b[i]]).tolist())
            yield self.a[a : end_a[i]].tolist(), self.b[b : end_b[i]].tolist(), [dict(a=x, b=y) for x, y in linked], [dict(a=x, b=y) for x, y in cuts]


@lru_cache(maxsize=1)
def _aligner(file_a: str, file_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(file_a, file_b)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(keys, texts) of two-column batches, cut by rows and by bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, min(start + BATCH_ROWS, int(np.searchsorted(sizes, before + BATCH_BYTES, "right"))))
            part = batch.slice(start, end - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            start = end


def spans(df: DataFrame, file_a: str, file_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``a_ids``, ``b_ids``, ``links`` (positions of overlapping tokens) and ``groups`` (where each begins) of every text."""
    ship(df.sparkSession)
    key_type = to_arrow_type(df.schema[key].dataType)
    place = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    kinds = {key: key_type, "a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "links": place, "groups": place}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(file_a, file_b)
        for keys, texts in _batches(batches):
            columns = [keys, *map(list, zip(*align(texts).spans()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    pair = "array<struct<a: int, b: int>>"
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, links {pair}, groups {pair}"
    return df.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(run, schema)


_SIZES = ("n_a", "n_b", "n_groups", "n_links")


def _scanned(df: DataFrame, file_a: str, file_b: str, key: str, text: str) -> DataFrame:
    """One row a text: a number, the sizes, the digest of the groups, and its pairs with their times, packed."""
    key_type = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(file_a, file_b)
        row = TaskContext.get().partitionId() << 33
        for keys, texts in _batches(batches):
            found = align(texts)
            doc, code, times = found.pairs()
            cuts = np.searchsorted(doc, np.arange(len(keys) + 1)).tolist()
            code, times = code.astype(align.code), times.astype(np.uint32)
            digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(found.groups(), found.n_a)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(keys)), pa.int64()), pa.array(keys, key_type),
                    *(pa.array(getattr(found, c), pa.int64()) for c in _SIZES), pa.array(digests, pa.string()),
                    pa.array([code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["row", "key", *_SIZES, "groups_sha256", "pairs", "times"],
            )
            row += len(keys)

    schema = f"row bigint, key {df.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in _SIZES)}, groups_sha256 string, pairs binary, times binary"
    return df.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch, code: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of a batch's rows end to end, and the number of pairs of each row."""
    pairs = [np.frombuffer(x, code) for x in batch.column("pairs").to_pylist()]
    times = [np.frombuffer(x, np.uint32) for x in batch.column("times").to_pylist()]
    n = np.array([len(x) for x in pairs], np.int64)
    joined = [np.concatenate(x) if len(x) else np.empty(0) for x in (pairs, times)]
    return joined[0].astype(np.int64), joined[1].astype(np.int64), n


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, of, np.concatenate(times))
    return distinct, total


def pair_counts(scanned: DataFrame, code: type, size_b: int) -> DataFrame:
    """(a, b, n, best): how many links of the corpus hold each pair, and whether no pair of the same b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, held = [], [], 0

        def rows() -> pa.RecordBatch:
            a, b = np.divmod(codes[0], size_b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times[0])], names=["a", "b", "n"])

        for batch in batches:
            more, count, _ = _unpacked(batch, code)
            codes, times, held = [*codes, more], [*times, count], held + len(more)
            if held > 2 * SUMMED_PAIRS:
                total = _summed(codes, times)
                codes, times, held = [total[0]], [total[1]], len(total[0])
                if held > SUMMED_PAIRS:
                    yield rows()
                    codes, times, held = [], [], 0
        if held:
            total = _summed(codes, times)
            codes, times = [total[0]], [total[1]]
            yield rows()

    parts = scanned.select("pairs", "times").mapInArrow(run, "a bigint, b bigint, n bigint")
    total = parts.groupBy("b", "a").agg(F.sum("n").alias("n"))
    return total.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).alias("best"))


def _looked_up(scanned: DataFrame, pairs: DataFrame, code: type, size_b: int) -> DataFrame:
    """Scores of the rows, the pair table being sent to the tasks."""
    table = pairs.select((F.col("a") * size_b + F.col("b")).alias("code"), "n", "best").toArrow().sort_by("code")
    held = tuple(table.column(c).to_numpy() for c in ("code", "n", "best"))
    shared = scanned.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            found, times, n = _unpacked(batch, code)
            at = np.searchsorted(known, found)
            ends = np.cumsum(n)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * count[at])]
            scores = [pa.array(s[ends] - s[ends - n], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *scores], names=[*carried, "n_best", "count_sum"])

    carried = ["row", "key", *_SIZES, "groups_sha256"]
    schema = scanned.select(*carried).schema.add("n_best", LongType()).add("count_sum", LongType())
    return scanned.mapInArrow(run, schema)


def _joined(scanned: DataFrame, pairs: DataFrame, code: type, size_b: int) -> DataFrame:
    """Scores of the rows by a shuffled join of their distinct pairs, for pair tables of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times, n = _unpacked(batch, code)
            a, b = np.divmod(found, size_b)
            row = np.repeat(batch.column("row").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, a, b, times)], names=["row", "a", "b", "times"])

    each = scanned.select("row", "pairs", "times").mapInArrow(run, "row bigint, a bigint, b bigint, times bigint")
    scores = each.join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    full = scanned.drop("pairs", "times").join(scores, "row", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def overlaps(
    df: DataFrame, file_a: str, file_b: str, *, key: str = "doc_id", text: str = "text", sent: int = SENT_PAIRS
) -> DataFrame:
    """``key``, sizes, ``n_best``, ``count_sum`` and ``groups_sha256`` of every whole text.

    Side A gets a space before the text, as side B adds one.  Null and empty texts, and texts
    that one side doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Rows that repeat are rows of their own and count as often; null keys, other columns and
    texts of any length do no harm; an empty table gives no rows.
    """
    ship(df.sparkSession)
    aligner = _aligner(file_a, file_b)
    code, size_b = aligner.code, len(aligner.b.bytes)
    scanned = keep(_scanned(df, file_a, file_b, key, text), "overlap-rows")
    pairs = keep(pair_counts(scanned, code, size_b), "overlap-pairs")
    score: Callable = _looked_up if pairs.count() <= sent else _joined
    return score(scanned, pairs, code, size_b).select(F.col("key").alias(key), *_SIZES, "n_best", "count_sum", "groups_sha256")
