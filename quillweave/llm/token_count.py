"""Token counts by heap-and-linked-list byte-pair merging.

A text is a chain of symbols.  A heap holds the adjacent pairs whose join is a piece; the
best-scored pair (ties: the leftmost) is popped and joined until none is left.  The count is
the initial symbols minus the merges; identifiers are never looked up.

Pieces hold the space mark at their start only and some characters (the line feed) in no
longer piece at all, so no merge crosses from a word to a following mark or such a
character.  A text therefore falls into words that merge by themselves, and the counts of
words seen lately are kept in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from quillweave.llm.common import ship, text_rows, whole_text

MARK = "▁"
#: words whose counts a task remembers before it starts afresh
REMEMBERED = 1_000_000
#: longer words are counted but not remembered
REMEMBERED_LENGTH = 64


class PieceCounter:
    """Counts what the sentencepiece library would emit for a byte-fallback BPE model.

    The library only reads the model file here (pieces, scores and kinds, and the text
    normalisation of models that have one).
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        if not any(model.is_byte(i) for i in ids) or any(model.is_unused(i) for i in ids):
            raise ValueError("only BPE models with byte fallback and without unused pieces are counted")
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.singles = {p for p in self.rank if len(p) == 1}
        longer = {c for p in self.rank if len(p) > 1 for c in p}
        self.newline_apart = "\n" not in longer
        self.mark_leads = not any(MARK in p.lstrip(MARK) for p in self.rank)
        probe = " a  é\n b\t"
        self.normalize = None if model.normalize(probe) == MARK + probe.replace(" ", MARK) else model.normalize
        self._after_mark = _Remembered(self, MARK)
        self._bare = _Remembered(self, "")

    def weight(self, symbol: str) -> int:
        """Tokens of one unmerged symbol: itself, or its bytes if it is no piece."""
        return 1 if symbol in self.rank else len(symbol.encode())

    def merged(self, word: str) -> int:
        """Tokens of a chain of symbols: initial symbols minus merges.

        A symbol that is no piece weighs its bytes until it is merged into one.
        """
        rank = self.rank
        n = len(word)
        heavy = {} if self.singles.issuperset(word) else {i: w for i, c in enumerate(word) if (w := self.weight(c)) > 1}
        count = n + sum(heavy.values()) - len(heavy)
        parts = list(word)
        # a heap entry is rank * n + left end: the lowest rank first, ties leftmost first
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        if not heap:
            return count
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        parts.append("")  # what follows the last symbol: never part of a pair
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            left = parts[i]
            if not left or j == n or rank.get(whole := left + parts[j]) != r:
                continue  # one of the two has been merged meanwhile
            parts[i] = whole
            parts[j] = ""
            count -= 1
            if heavy:
                count -= heavy.pop(i, 1) + heavy.pop(j, 1) - 2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(whole + parts[k])) is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank.get(parts[h] + whole)) is not None:
                push(heap, r * n + h)
        return count

    def _words(self, line: str, first: bool) -> int:
        """Tokens of a line without the mark's rewriting; the first line has a mark before it."""
        if "  " in line or line[:1] == " " or line[-1:] == " ":
            marked = (MARK if first else "") + line.replace(" ", MARK)
            runs = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
            return sum(self._after_mark[r[1:]] if r[0] == MARK else self._bare[r] for r in runs)
        words = line.split(" ")
        if first:
            return sum(map(self._after_mark.__getitem__, words))
        head = self._bare[words[0]] if words[0] else 0
        return head + sum(map(self._after_mark.__getitem__, words[1:]))

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty text has none."""
        if not text:
            return 0
        if self.normalize is not None or not self.mark_leads:
            marked = self.normalize(text) if self.normalize else MARK + text.replace(" ", MARK)
            return self.merged(marked) if marked else 0
        text = text.replace(MARK, " ")
        if not self.newline_apart:
            return self._words(text, True)
        lines = text.split("\n")
        total = (len(lines) - 1) * self.weight("\n") + self._words(lines[0], True)
        return total + sum(self._words(line, False) for line in lines[1:] if line)


class _Remembered(dict):
    """Word -> count, computed on the first look-up."""

    def __init__(self, counter: PieceCounter, lead: str):
        self.counter, self.lead = counter, lead

    def __missing__(self, word: str) -> int:
        n = self.counter.merged(self.lead + word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=1)
def _counter(model_file: str) -> PieceCounter:
    """One counter for all tasks of a Python worker."""
    return PieceCounter(model_file)


def token_counts(df: DataFrame, model_file: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text, in one map-only pass.

    Null texts count as empty (0 bytes, 0 tokens); null keys, repeated rows and other columns
    of the table do no harm, an empty table gives no rows.  A word of any length costs
    n log n; memory is bounded by one batch of rows and the table of remembered words.
    """
    ship(df.sparkSession)
    schema = df.select(key).schema.add("n_bytes", LongType(), False).add("n_tokens", LongType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for keys, texts in text_rows(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, key_type),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                names=[key, "n_bytes", "n_tokens"],
            )

    key_type = to_arrow_type(df.schema[key].dataType)
    return df.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(run, schema)


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
