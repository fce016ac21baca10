"""Chat rendering, prompt rows, response spans and token lengths."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as DEFAULT_GRAMMAR
from quillweave.functions.grammar import TagGrammar
from quillweave.functions.wording import DEFAULT as DEFAULT_WORDING
from quillweave.functions.wording import Wording


@dataclass(frozen=True)
class ChatTemplate:
    """Fixed heads of a chat format and the text that ends a turn."""

    user_head: str
    assistant_head: str
    turn_end: str

    def render_prompt(self, query: Column, generate: bool = True) -> Column:
        """User turn, ending in the assistant head if an answer is to be generated."""
        tail = self.turn_end + (self.assistant_head if generate else "")
        return F.concat(F.lit(self.user_head), query, F.lit(tail))

    def render_pair(self, query: Column, response: Column) -> Column:
        return F.concat(self.render_prompt(query), response, F.lit(self.turn_end))

    def response_span(self, text: Column) -> Column:
        """``[start, end)`` of the part after the last assistant head; -1, -1 if none."""
        after = F.char_length(F.substring_index(text, self.assistant_head, -1))
        size = F.char_length(text)
        found = text.contains(F.lit(self.assistant_head))
        return F.struct(
            F.when(found, size - after).otherwise(-1).alias("start"),
            F.when(found, size).otherwise(-1).alias("end"),
        )


CHAT_TEMPLATES = {
    # fixed values: heads of the two chat formats in use
    "im": ChatTemplate(
        user_head="<|im_start|>user\n",
        assistant_head="<|im_start|>assistant\n",
        turn_end="<|im_end|>\n",
    ),
    "turn": ChatTemplate(
        user_head="<|turn>user\n",
        assistant_head="<|turn>model\n",
        turn_end="<turn|>\n",
    ),
}


def prompt_row(query: Column, response: Column) -> list[Column]:
    """``prompt`` (one user message) and ``solution``."""
    message = F.struct(F.lit("user").alias("role"), query.alias("content"))
    return [F.array(message).alias("prompt"), response.alias("solution")]


def last_message(messages: Column) -> Column:
    """Content of the last message of a list."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def infill_request(
    before: Column | None = None,
    after: Column | None = None,
    grammar: TagGrammar = DEFAULT_GRAMMAR,
    wording: Wording = DEFAULT_WORDING,
) -> Column:
    """Wrapped query with one empty mask between two texts."""
    before = F.lit(wording.request_before) if before is None else before
    after = F.lit(wording.request_after) if after is None else after
    return grammar.wrap_query(F.concat(before, grammar.render(), after))


# ---- token lengths -------------------------------------------------------------------
@functools.lru_cache(maxsize=4)
def _load(loader: Callable[[], Callable]):
    return loader()


def token_counter(loader: Callable[[], Callable[[list[str]], list[int]]]):
    """Arrow batch function ``text -> number of tokens``.

    ``loader`` runs once per Python worker and returns a function from a list of texts to
    their token counts; only the counts travel back.
    """

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        counted = _load(loader)(texts.fillna("").tolist())
        return pd.Series(counted, index=texts.index, dtype="int32")

    return count


class BytePairLoader:
    """Loader for a rank-file vocabulary, e.g. one of the installed public ones."""

    def __init__(self, name: str, pattern: str, rank_file: str, special: dict[str, int] | None = None):
        self.name, self.pattern, self.rank_file = name, pattern, rank_file
        self.special = special or {}

    def __hash__(self):
        return hash((self.name, self.pattern, self.rank_file, *sorted(self.special.items())))

    def __eq__(self, other):
        return isinstance(other, BytePairLoader) and vars(self) == vars(other)

    def __call__(self):
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        encoding = tiktoken.Encoding(
            self.name,
            pat_str=self.pattern,
            mergeable_ranks=load_tiktoken_bpe(self.rank_file),
            special_tokens=self.special,
        )

        def count(texts: list[str]) -> list[int]:
            batch = encoding.encode_batch(texts, num_threads=1, allowed_special="all", disallowed_special=())
            return [len(ids) for ids in batch]

        return count


#: letters, digits, or other visible characters in a row: an upper bound of words, no vocabulary needed
PRE_TOKEN = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"


def pre_tokens(text: Column) -> Column:
    """Number of pre-tokens, a native expression; null texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PRE_TOKEN))


def with_token_lengths(
    df: DataFrame,
    count: Callable[[Column], Column],
    template: ChatTemplate,
    query: str = "query",
    response: str = "response",
) -> DataFrame:
    """``len_prompt`` (with the assistant head) and ``len_prompt_completion`` (whole chat).

    ``count`` maps a text column to its length: ``pre_tokens``, a given length column's
    arithmetic, or a tokenizer's ``token_counter``.
    """
    return df.withColumn(
        "len_prompt", count(template.render_prompt(F.col(query)))
    ).withColumn(
        "len_prompt_completion", count(template.render_pair(F.col(query), F.col(response)))
    )


def within_budget(limit: int) -> Column:
    """Prompt in two thirds of the limit, whole chat in the limit less 256."""
    return (F.col("len_prompt") <= limit * 2 // 3) & (F.col("len_prompt_completion") <= limit - 256)


def token_limits(df: DataFrame, limit: int) -> DataFrame:
    """Longest lengths and the limits derived from them: one row."""
    return df.agg(
        F.max("len_prompt").alias("max_prompt"),
        F.max("len_prompt_completion").alias("max_prompt_completion"),
    ).select(
        "*",
        (F.col("max_prompt") + 1).alias("prompt_limit"),
        (F.lit(limit) - (F.col("max_prompt") + 2)).alias("completion_limit"),
    )
