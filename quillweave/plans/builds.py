"""Corpus builds: chosen subsets -> pairs or question/answer rows -> split -> one table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as DEFAULT_GRAMMAR
from quillweave.operators.gate import pinned, with_validity
from quillweave.operators.masking import MASKERS
from quillweave.operators.qa import QA_BUILDERS
from quillweave.operators.sampling import split_by_share
from quillweave.sources.writers import staged


def chosen(registry: Mapping[str, object], subsets: Iterable[str] | None) -> list[str]:
    """Subset names to build: all, or the given ones; an unknown name is an error."""
    names = list(registry) if subsets is None else list(subsets)
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise KeyError(f"unknown subsets {unknown}; there are {list(registry)}")
    return names


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_pairs(
    corpora: Mapping[str, DataFrame],
    subsets: Iterable[str] | None = None,
    *,
    key=("row_id",),
    grammar=DEFAULT_GRAMMAR,
    **options,
) -> DataFrame:
    """Pairs of the chosen corpora with ``subset`` and ``is_valid``; map-only.

    Rows with ``is_valid`` false are the quarantine: write the table once, partitioned by
    ``is_valid``, or use ``operators.gate.split_valid`` on parts of it.
    """
    parts = [
        MASKERS[name](corpora[name], key, grammar=grammar, **options).withColumn("subset", F.lit(name))
        for name in chosen(MASKERS, corpora if subsets is None else subsets)
    ]
    return pinned(with_validity(_together(parts), grammar))


def build_qa(
    corpora: Mapping[str, DataFrame],
    subsets: Iterable[str] | None = None,
    *,
    key=("row_id",),
    percent: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Question/answer rows of the chosen corpora with ``subset`` and ``split`` (train/test).

    The builders run once: their rows are written to the shared folder, the pools are counted
    and cut on the stored keys, and the split is taken while the rows are read back.
    """
    parts = []
    for name in chosen(QA_BUILDERS, corpora if subsets is None else subsets):
        rows = QA_BUILDERS[name](corpora[name], key)
        if "pair" not in rows.columns:
            rows = rows.withColumn("pair", F.lit(0))
        parts.append(rows.withColumn("subset", F.lit(name)))
    return split_by_share(
        staged(_together(parts)), (*key, "pair"), pool=F.col("subset"), percent=percent, seed=seed
    )
