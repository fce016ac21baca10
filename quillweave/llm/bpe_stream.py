"""BPE encoding and decoding as bounded-lookahead streaming transducers.

**Encoding.**  A later symbol can change earlier tokens only through merges that contend for
a symbol, each of a higher rank than the one before and each reaching one left part further.
``lookahead`` follows these chains through the merge list once and returns how many symbols
they can reach.  The transducer keeps a window of symbols, merges it, and emits the tokens
that end further than that from the window's end; they are stable.  What is left begins the
next window, so the transducer's memory does not depend on the length of a word.  (The text is
a cell and held anyway; of it, the longest run without white space is also held normalised.)
Words met lately are looked up; the table has two generations of bounded size.

**Decoding.**  Pieces are bytes; an incremental UTF-8 state machine turns them into text as
identifiers arrive, holding back only an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StringType

from quillweave.llm.common import ship, text_rows, whole_text

#: runs between white space, and words, whose identifiers a task remembers: of the latest, and of those before
REMEMBERED = 100_000
REMEMBERED_LENGTH = 64
#: bytes of a word that is merged by identifiers, at once
SHORT = 64
#: identifiers decoded at a time, and characters of a text taken at a time
BLOCK = 8192


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class MergeList:
    """Ranks of a merge list over symbols, its lookahead, and plain merging of one window."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int]):
        self.vocab = vocab
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        # the same by identifiers: a pair's number to its rank and result in one number
        self.shift = max(vocab.values(), default=1).bit_length()
        known = ((k, vocab.get(a), vocab.get(b), vocab.get(a + b)) for (a, b), k in self.rank.items())
        self.pairs = {a << self.shift | b: k << self.shift | c for k, a, b, c in known if None not in (a, b, c)}

    def lookahead(self, suffix: str = "") -> int:
        """Symbols after a token's end that can still change it.

        ``reach`` of a merge: how far left of its own right part's end what happens there can
        be felt.  A merge hands on to one of a higher rank whose right part is its left part
        (contended for) or its result (made by it).
        """
        def width(token: str) -> int:
            return len(token.removesuffix(suffix)) if suffix else len(token)

        felt: dict[str, int] = {}
        most = 1
        for a, b in self.rank:  # in rank order
            reach = width(a) + max(felt.get(b, 0), width(b))
            felt[a] = max(felt.get(a, 0), reach)
            felt[a + b] = max(felt.get(a + b, 0), reach)
            most = max(most, reach)
        return most + max(map(width, self.vocab), default=1)

    def merge_ids(self, ids: list[int]) -> list[int]:
        """As ``merge`` for a short chain of identifiers, each symbol and merge being in the vocabulary."""
        get, shift = self.pairs.get, self.shift
        none = len(self.rank) << shift
        result = (1 << shift) - 1
        ranks = [get(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            whole = ids[at] = best & result
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << shift | whole, none)
            if at < len(ranks):
                ranks[at] = get(whole << shift | ids[at + 1], none)
        return ids

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a chain of symbols: lowest rank first, ties leftmost first."""
        rank = self.rank
        n = len(symbols)
        if n < 24:  # short: look for the best pair each time
            parts, none = list(symbols), len(rank)
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) < none:
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank.get((parts[at - 1], parts[at]), none)
                if at < len(ranks):
                    ranks[at] = rank.get((parts[at], parts[at + 1]), none)
            return parts
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p is not None]


class WordTransducer:
    """Symbols of one word in, stable tokens out; the word's last symbol bears the suffix."""

    def __init__(self, merges: MergeList, suffix: str, lookahead: int):
        self.merges, self.suffix, self.lookahead = merges, suffix, lookahead
        self.window = 4 * lookahead + 256
        self.held: list[str] = []

    def push(self, symbols: str) -> Iterator[str]:
        for start in range(0, len(symbols), self.window):
            self.held.extend(symbols[start : start + self.window])
            if len(self.held) <= self.window:
                continue
            stable = len(self.held) - self.lookahead
            at = 0
            # the window's last symbols may be the word's end or not: neither matters this far left
            for token in self.merges.merge(self.held):
                if at + len(token) > stable:
                    break
                at += len(token)
                yield token
            del self.held[:at]

    def finish(self) -> Iterator[str]:
        if self.held:
            self.held[-1] += self.suffix
            yield from self.merges.merge(self.held)
            self.held = []


class StreamEncoder:
    """Identifiers of texts under a tokenizers file of the byte-level word BPE kind.

    The file must have the parts this reads (NFC, white space to one space, lower case; a
    split that keeps what its pattern matches; byte-level symbols); others are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"]
            or steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"]
            or not splits[0]["invert"] or splits[0]["behavior"] != "Removed" or spec["post_processor"]
        ):
            raise ValueError("this tokenizer has parts that the encoder doesn't know")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens are only known as plain strings of the raw text")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = MergeList(pairs, self.vocab)
        self.lookahead = self.merges.lookahead(self.suffix)
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._words = regex.compile(splits[0]["pattern"]["Regex"])
        self._space = regex.compile(r"\s+")
        self._symbols = byte_symbols()
        # identifiers of single bytes within a word and at its end, if the vocabulary has them and all merges
        ends = [[self.vocab.get(x + tail) for x in self._symbols] for tail in ("", self.suffix)]
        self._bytes = ends if None not in ends[0] + ends[1] and len(self.merges.pairs) == len(self.merges.rank) else None
        self._letters_stay = all(self._words.findall(x) == [x] for x in ("abcdefghijklmnopqrstuvwxyz", "a", "the"))
        self.forget()

    def forget(self) -> None:
        """Empties the tables of what was encoded lately; a worker may go on to other work."""
        self._latest: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        """Identifiers of a run without white space, as little-endian 32-bit numbers."""
        known = self._before.get(chunk)
        if known is None:
            if chunk.isascii():
                plain = chunk.lower()
                if plain.isalpha() and self._letters_stay:
                    return self._word(plain) if plain == chunk else self._remember(chunk, self._word(plain))
            else:
                # lower case is taken character by character: no rule for a word's last sigma
                plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            known = b"".join([self._word(word.group()) for word in self._words.finditer(plain)])
        return self._remember(chunk, known)

    def _word(self, word: str) -> bytes:
        # letters of ASCII alone are a run of their own with the same identifiers; other words get a name no run has
        name = word if word.isascii() and word.isalpha() else " " + word
        known = self._latest.get(name)
        if known is not None:
            return known
        known = self._before.get(name)
        return self._remember(name, self._merged(word) if known is None else known)

    def _merged(self, word: str) -> bytes:
        data = word.encode()
        if self._bytes is not None and len(data) <= SHORT:
            inside, last = self._bytes
            ids = [inside[b] for b in data]
            ids[-1] = last[data[-1]]
            return array("I", self.merges.merge_ids(ids)).tobytes()
        out = array("I")
        transducer = WordTransducer(self.merges, self.suffix, self.lookahead)
        for start in range(0, len(word), BLOCK):
            symbols = "".join([self._symbols[b] for b in word[start : start + BLOCK].encode()])
            out.extend([self.vocab[t] for t in transducer.push(symbols)])
        out.extend([self.vocab[t] for t in transducer.finish()])
        return out.tobytes()

    def _remember(self, name: str, ids: bytes) -> bytes:
        """Two generations: what wasn't met while the latest table filled is forgotten."""
        if len(name) <= REMEMBERED_LENGTH:
            if len(self._latest) >= REMEMBERED:
                self._before, self._latest = self._latest, {}
            self._latest[name] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        """Blocks of identifiers of a text without added tokens; blocks end at white space."""
        start = 0
        while start < len(text):
            known = self._latest.get
            end = start + BLOCK
            if end < len(text):
                edge = self._space.search(text, end)
                end = edge.start() if edge else len(text)
            else:
                end = len(text)
            chunks = self._space.split(text[start:end])
            yield b"".join([known(c) or self._chunk(c) for c in chunks if c])
            start = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of identifiers, each a run of little-endian unsigned 32-bit numbers."""
        if self._added is None or not self._added.search(text):
            yield from self._plain(text)
            return
        for part in self._added.split(text):
            if part in self.added:
                yield array("I", [self.added[part]]).tobytes()
            elif part:
                yield from self._plain(part)


class StreamDecoder:
    """Text of identifiers, block by block.

    ``style`` ``"file"`` does what the tokenizer file asks for (without a decoder: pieces
    joined by a space), ``"bytes"`` gives the encoded words themselves, a space after each.
    """

    def __init__(self, path: str, style: str = "file"):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if style == "file" and spec["decoder"] is not None:
            raise ValueError("this tokenizer names a decoder that isn't known here")
        suffix = spec["model"]["end_of_word_suffix"] or ""
        back = {s: b for b, s in enumerate(byte_symbols())}
        pieces = {i: p for p, i in spec["model"]["vocab"].items()}
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}

        def as_bytes(piece: str) -> bytes:
            if style == "file":
                return piece.encode()
            body = piece.removesuffix(suffix)
            return bytes(back[c] for c in body) + (b" " if body != piece else b"")

        table = {i: as_bytes(p) for i, p in pieces.items()} | {i: p.encode() for i, p in added.items()}
        self.pieces = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
        self.between = b" " if style == "file" else b""
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.begun = False

    def push(self, ids: bytes) -> str:
        """Text of a block of identifiers as far as it is certain."""
        if not ids:
            return ""
        data = self.between.join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        rest = self.machine.decode(b"", final=True)
        self.reset()
        return rest


@lru_cache(maxsize=1)
def _coders(path: str) -> tuple[StreamEncoder, StreamDecoder]:
    """One pair for all tasks of a Python worker."""
    return StreamEncoder(path), StreamDecoder(path)


def encode_decode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` (binary, unsigned 32-bit little-endian) and ``decoded`` of every whole text.

    One map-only pass.  Null texts count as empty (no identifiers, empty text); ties and
    repeated rows are encoded row by row, an empty table gives no rows.
    """
    return _mapped(df, path, key, text, digests=False)


def encode_digests(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode`` with SHA-256 digests, taken block by block, in place of the two outputs."""
    return _mapped(df, path, key, text, digests=True)


def _mapped(df: DataFrame, path: str, key: str, text: str, digests: bool) -> DataFrame:
    ship(df.sparkSession)
    schema = df.select(key).schema.add("n_tokens", LongType(), False)
    if digests:
        schema = schema.add("ids_sha256", StringType(), False).add("decoded_sha256", StringType(), False)
    else:
        schema = schema.add("ids", BinaryType(), False).add("decoded", StringType(), False)
    key_type = to_arrow_type(df.schema[key].dataType)
    kinds = [key_type, pa.int64(), *([pa.string()] * 2 if digests else [pa.binary(), pa.string()])]

    def row(encoder: StreamEncoder, decoder: StreamDecoder, text: str) -> tuple:
        n = 0
        ids_sum, text_sum = hashlib.sha256(), hashlib.sha256()
        ids_kept, text_kept = [], []
        for block in encoder.encode(text):
            n += len(block) // 4
            said = decoder.push(block)
            if digests:
                ids_sum.update(block)
                text_sum.update(said.encode())
            else:
                ids_kept.append(block)
                text_kept.append(said)
        rest = decoder.finish()
        if digests:
            text_sum.update(rest.encode())
            return n, ids_sum.hexdigest(), text_sum.hexdigest()
        return n, b"".join(ids_kept), "".join(text_kept) + rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(path)
        for keys, texts in text_rows(batches):
            rows = [row(encoder, decoder, t) for t in texts]
            columns = [keys, *map(list, zip(*rows))]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        encoder.forget()

    return df.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(run, schema)
