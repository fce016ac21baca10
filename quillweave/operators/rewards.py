"""Rewards of rollouts: columns ``query``, ``completion``, ``golden`` -> score columns.

Every reward is a native expression, so a table of rollouts is scored in one map-only
stage.  The parsed tags are staged once per row and shared by all rewards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as DEFAULT_GRAMMAR
from quillweave.functions.grammar import TagGrammar
from quillweave.functions.numbers import numerically_equal
from quillweave.functions.text import strip
from quillweave.operators.chat import last_message
from quillweave.operators.gate import pinned


# ---- matches ------------------------------------------------------------------------
def loose_match(predicted: Column, wanted: Column) -> Column:
    """Trimmed texts equal, else numerically equal; null on either side is no match."""
    same = (strip(predicted) == strip(wanted)) | numerically_equal(predicted, wanted)
    return F.coalesce(same, F.lit(False))


def exact_match(predicted: Column, wanted: Column) -> Column:
    return predicted.eqNullSafe(wanted)


# ---- input -----------------------------------------------------------------------
def from_messages(
    df: DataFrame, prompts: str = "prompts", completions: str = "completions", solution: str = "solution"
) -> DataFrame:
    """``query``, ``completion`` and ``golden`` from message lists; the last message counts."""
    others = [c for c in df.columns if c not in (prompts, completions, solution)]
    return df.select(
        *others,
        last_message(F.col(prompts)).alias("query"),
        last_message(F.col(completions)).alias("completion"),
        F.col(solution).alias("golden"),
    )


# ---- staging -----------------------------------------------------------------------
def stage(
    df: DataFrame,
    grammar: TagGrammar = DEFAULT_GRAMMAR,
    query: str = "query",
    completion: str = "completion",
    golden: str = "golden",
) -> DataFrame:
    """Add what the rewards share: ``_strict``, ``_lenient``, ``_golden_ok``, tag arrays
    ``_pred`` and ``_real`` and their matches ``_exact`` and ``_loose``, lengths ``_len`` and
    ``_golden_len``.  Each text is parsed once; what no reward asks for is not computed."""
    q, c, g = F.col(query), F.col(completion), F.col(golden)
    parsed = df.withColumns({f"_tags_{x}": grammar.tags(text) for x, text in (("q", q), ("c", c), ("g", g))})
    of_q, of_c, of_g = (F.col(f"_tags_{x}") for x in "qcg")
    return parsed.withColumns(
        {
            "_strict": grammar.is_valid_parsed(q, c, of_q, of_c),
            "_lenient": grammar.can_infill(q, c),
            "_golden_ok": grammar.can_infill(q, g),
            "_pred": F.when(grammar.can_infill(q, c), grammar.filled(of_q, of_c)),
            "_real": F.when(grammar.can_infill(q, g), grammar.filled(of_q, of_g)),
            "_len": F.char_length(c),
            "_golden_len": F.char_length(g),
        }
    ).drop("_tags_q", "_tags_c", "_tags_g").withColumns({"_exact": _matches(exact_match), "_loose": _matches(loose_match)})


def _matches(match: Callable[[Column, Column], Column]) -> Column:
    """Matching tags, place by place; null where an infill failed."""
    hits = F.zip_with("_pred", "_real", lambda p, r: match(p["content"], r["content"]))
    both = F.col("_pred").isNotNull() & F.col("_real").isNotNull()
    return F.when(both, F.size(F.filter(hits, lambda x: x)))


def correct_tags(match=exact_match) -> Column:
    """Matching tags, place by place; null where an infill failed.  The usual matches are staged."""
    staged = {exact_match: "_exact", loose_match: "_loose"}.get(match)
    return F.col(staged) if staged else _matches(match)


def length_ratio() -> Column:
    return F.col("_len") / F.greatest(F.col("_golden_len"), F.lit(1))


def length_factor(ratio: Column | None = None) -> Column:
    """1 up to 1.2 times the golden length, linear to 0.7 at twice, then decaying."""
    r = length_ratio() if ratio is None else ratio
    return (
        F.when(r <= 1.2, F.lit(1.0))
        .when(r <= 2.0, F.lit(1.0) - F.lit(0.3) * (r - 1.2) / F.lit(0.8))
        .otherwise(F.lit(0.7) * F.exp(-(r - 2.0)))
    )


# ---- rewards -----------------------------------------------------------------------
def format_first_form() -> Column:
    """2 for a valid completion, 1 if only the golden text can be infilled, else -1."""
    return F.when(F.col("_strict"), 2).when(F.col("_golden_ok"), 1).otherwise(-1)


def format_score() -> Column:
    """2 for a valid completion, 1 for one that can be infilled leniently, else -1."""
    return F.when(F.col("_strict"), 2).when(F.col("_lenient"), 1).otherwise(-1)


def length_sign() -> Column:
    return F.when(F.col("_len") <= F.col("_golden_len"), 1).otherwise(-1)


def length_clipped() -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - length_ratio()))


def tag_count() -> Column:
    return F.coalesce(correct_tags(), F.lit(0))


def accuracy() -> Column:
    """Share of correct tags; a query without tags has accuracy 0."""
    return correct_tags() / F.greatest(F.size("_real"), F.lit(1))


def accuracy_by_length() -> Column:
    """(2 acc - 1) times the length factor, 0.5 more if all is right; -1 on failure."""
    acc = accuracy()
    score = (F.lit(2.0) * acc - 1) * length_factor() + F.when(acc == 1, 0.5).otherwise(0.0)
    return F.coalesce(score, F.lit(-1.0))


def _strict_by_length(match) -> Column:
    score = correct_tags(match) * length_factor()
    return F.coalesce(F.when(F.col("_strict"), score), F.lit(-1.0))


def strict_by_length() -> Column:
    """Correct tags of a valid completion times the length factor; -1 on failure."""
    return _strict_by_length(exact_match)


def loose_by_length() -> Column:
    """As ``strict_by_length`` with loose tag matching."""
    return _strict_by_length(loose_match)


#: reward name -> expression over a staged table
REWARDS: dict[str, Callable[[], Column]] = {
    "format_v1": format_first_form,
    "format": format_score,
    "length_sign": length_sign,
    "length_clip": length_clipped,
    "tags": tag_count,
    "accuracy_length": accuracy_by_length,
    "strict_length": strict_by_length,
    "loose_length": loose_by_length,
}


def score(df: DataFrame, names: Sequence[str], grammar: TagGrammar = DEFAULT_GRAMMAR, **columns) -> DataFrame:
    """Columns of ``df`` plus one score per reward name."""
    unknown = [n for n in names if n not in REWARDS]
    if unknown:
        raise KeyError(f"unknown rewards {unknown}; there are {sorted(REWARDS)}")
    scores = [REWARDS[n]().alias(n) for n in names]
    return stage(df, grammar, **columns).select(*[F.col(c) for c in df.columns], *scores)


# ---- statistics and samples ------------------------------------------------------------
def details(df: DataFrame, *, strict: bool = True, match=loose_match, grammar=DEFAULT_GRAMMAR, **columns):
    """What the statistics need, per rollout; null on rows that could not be scored."""
    staged = stage(df, grammar, **columns)
    scored = (F.col("_strict") if strict else F.col("_lenient")) & F.col("_golden_ok")
    staged = staged.withColumn("_hits", F.when(scored, correct_tags(match)))
    acc = F.col("_hits") / F.greatest(F.size("_real"), F.lit(1))
    by_count = F.col("_hits") * length_factor()
    by_accuracy = (F.lit(2.0) * acc - 1) * length_factor() + F.when(acc == 1, 0.5).otherwise(0.0)
    return staged.select(
        *[F.col(c) for c in df.columns],
        F.col("_hits").alias("correct_tags"),
        acc.alias("accuracy"),
        (acc == 1).alias("perfect"),
        F.when(F.col("_hits").isNotNull(), length_ratio()).alias("ratio"),
        F.when(F.col("_hits").isNotNull(), length_factor()).alias("factor"),
        (by_count if strict else by_accuracy).alias("reward"),
    )


def batch_statistics(detailed: DataFrame, by: str = "step") -> DataFrame:
    """Means over the scored rollouts of each batch, and how many could not be scored."""
    return detailed.groupBy(by).agg(
        F.avg("correct_tags").alias("correct_tags"),
        F.avg("accuracy").alias("accuracy"),
        F.avg(F.col("perfect").cast("int")).alias("perfect"),
        F.avg("ratio").alias("ratio"),
        F.avg("factor").alias("factor"),
        F.avg("reward").alias("reward"),
        F.count_if(F.col("correct_tags").isNull()).alias("failures"),
        F.count(F.lit(1)).alias("rollouts"),
    )


def sample_dump(
    df: DataFrame,
    *,
    every: int = 10,
    by: str = "step",
    order: str = "row_id",
    last: bool = True,
    cut: Sequence[int] | None = None,
    **scoring,
) -> DataFrame:
    """One rollout of every ``every``-th batch (batches count from 1): the last one, or the
    first scored one with its texts cut to ``cut`` characters for display.  Only the batches
    shown are scored (``scoring`` goes to ``details``)."""
    shown = df.filter((F.col(by) + 1) % every == 0)
    if last:  # the key decides, so only the rows shown are scored and only keys are compared
        keys = shown.groupBy(F.col(by).alias("_by")).agg(F.max(order).alias("_order"))
        rows = details(shown.join(keys, (F.col(by) == F.col("_by")) & (F.col(order) == F.col("_order"))).select(*df.columns), **scoring)
    else:
        scored = pinned(details(shown, **scoring)).filter(F.col("correct_tags").isNotNull())
        keys = scored.groupBy(F.col(by).alias("_by")).agg(F.min(order).alias("_order"))
        rows = scored.join(keys, (F.col(by) == F.col("_by")) & (F.col(order) == F.col("_order")))
    texts = [
        (F.left(F.col(t), F.lit(n)) if n else F.col(t)).alias(t)
        for t, n in zip(("query", "completion", "golden"), cut or (None, None, None))
    ]
    return rows.select(by, order, *texts, "correct_tags", "ratio", "reward")
