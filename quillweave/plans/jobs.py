"""Training-set jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.operators.chat import CHAT_TEMPLATES, pre_tokens, prompt_row, with_token_lengths, within_budget
from quillweave.operators.gate import pinned
from quillweave.operators.mixing import Recipe, mix, plan
from quillweave.operators.sampling import hash_rank, head_n, split_head


def chat_set(
    corpus: DataFrame,
    recipe: Recipe,
    *,
    train_share: tuple[int, int] = (98, 100),
    template: str = "im",
    query: str = "query",
    response: str = "response",
    key=("row_id",),
    subset: str = "subset",
) -> DataFrame:
    """Mixture -> chat ``text`` -> ``split`` by position; text is rendered last."""
    planned = plan(corpus, recipe, key, subset=subset)
    text = CHAT_TEMPLATES[template].render_pair(F.col(query), F.col(response))
    rendered = planned.draw().select("pos", text.alias("text"))
    return split_head(rendered, planned.rows * train_share[0] // train_share[1])


def first_rows_set(
    corpus: DataFrame,
    rows: int,
    *,
    train_share: tuple[int, int] = (98, 100),
    template: str = "im",
    query: str = "query",
    response: str = "response",
    key=("row_id",),
    seed: int = 42,
) -> DataFrame:
    """First ``rows`` of the shuffled corpus (all splits together), rendered and split."""
    taken = head_n(corpus, key, rows, seed=seed)
    ranked = hash_rank(taken, key, seed=seed, out="pos")
    text = CHAT_TEMPLATES[template].render_pair(F.col(query), F.col(response))
    return split_head(ranked.select("pos", text.alias("text")), rows * train_share[0] // train_share[1])


def prompt_set(
    corpus: DataFrame,
    recipe: Recipe,
    count=pre_tokens,
    *,
    limit: int = 4096,
    template: str = "im",
    key=("row_id",),
    subset: str = "subset",
) -> DataFrame:
    """Mixture -> prompt rows within the token budget, with their token lengths."""
    mixed = mix(corpus, recipe, key, subset=subset)
    sized = with_token_lengths(mixed, count, CHAT_TEMPLATES[template])
    return pinned(sized).filter(within_budget(limit)).select(
        "*", *prompt_row(F.col("query"), F.col("response"))
    )
