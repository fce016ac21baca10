"""Driver queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as G
from quillweave.functions.text import canonical
from quillweave.operators import chat, gate, masking, mixing, qa, rewards, sampling, turns, viewing
from quillweave.plans import builds, jobs, recipes
from quillweave.plans.fixtures import (
    FOUR_TIER_SOURCES,
    KIND_SOURCES,
    TIER_SOURCES,
    table,
    view,
)
from quillweave.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHAT_LIMIT = 1024


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{writers.scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# ---- canonical text and question/answer rows --------------------------------------------
@query
def text_canonical(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("\t　 "))
    return table(spark, sf, "documents").select("doc_id", canonical(padded).alias("text"))


@query
def qa_article(spark, sf):
    return qa.qa_cnn_daily_mail(view(spark, sf, "article"))


@query
def qa_tagged(spark, sf):
    return qa.qa_gsm8k_reasoning(view(spark, sf, "tagged"))


@query
def qa_reason_answer(spark, sf):
    return qa.qa_hk_o1aw(view(spark, sf, "reason"))


def _rationale(spark, sf):
    return view(spark, sf, "reason").withColumnsRenamed(
        {"prompt": "source", "thinking": "rationale", "answer": "target"}
    )


@query
def qa_rationale(spark, sf):
    return qa.qa_kaist_cot(_rationale(spark, sf))


def _positions(spark, sf):
    return sampling.dense_position(view(spark, sf, "turns"), ["conv_id"], "turn", ties=["text"])


@query
def qa_pairs_from_turns(spark, sf):
    return qa.qa_from_turns(_positions(spark, sf))


@query
def qa_instruct(spark, sf):
    return qa.qa_magpie_reasoning(view(spark, sf, "fields"))


@query
def qa_math(spark, sf):
    return qa.qa_numina_math(view(spark, sf, "problem"))


@query
def qa_cut_chain(spark, sf):
    return qa.qa_o1_journey(view(spark, sf, "chain"))


@query
def qa_steps_joined(spark, sf):
    return qa.qa_process_bench(view(spark, sf, "steps"))


@query
def qa_news(spark, sf):
    return qa.qa_uhgeval(view(spark, sf, "news"))


# ---- masking ----------------------------------------------------------------------------
def _counted(spark, sf):
    key = F.col("row_id")
    return view(spark, sf, "article").select(
        "row_id",
        F.char_length("article").alias("n"),
        masking.mask_count(F.char_length("article"), 4, 0, key).alias("masks"),
    )


@query
def poisson_counts(spark, sf):
    return _counted(spark, sf)


@query
def mask_ranges(spark, sf):
    ranges = masking.mask_ranges(F.col("n"), F.col("masks"), 0, F.col("row_id"))
    return (
        _counted(spark, sf)
        .select("row_id", F.posexplode(ranges).alias("place", "_r"))
        .select("row_id", "place", F.col("_r.s").alias("s"), F.col("_r.e").alias("e"))
    )


@query
def mask_poisson(spark, sf):
    return masking.mask_cnn_daily_mail(view(spark, sf, "article"))


@query
def mask_poisson_fields(spark, sf):
    return masking.mask_uhgeval(view(spark, sf, "news"))


@query
def mask_summary(spark, sf):
    """Flagship: mask every document, check every pair, sum up per source."""
    docs = readers.spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    pairs = masking.mask_spans(docs, F.col("text"), ["doc_id"], keep=["source"])
    sizes = F.transform(G.tags(F.col("response")), lambda t: F.char_length(t["content"]))
    return (
        gate.with_validity(pairs)
        .select("source", "is_valid", sizes.alias("_sizes"))
        .select(
            "source",
            "is_valid",
            F.size("_sizes").alias("masks"),
            F.aggregate("_sizes", F.lit(0), lambda n, x: n + x).alias("hidden"),
        )
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(F.col("is_valid")).alias("valid"),
            F.sum("masks").alias("masks"),
            F.sum("hidden").alias("hidden_chars"),
        )
    )


@query
def tag_extract(spark, sf):
    tags = masking.extract_tags(F.col("generation"))
    return view(spark, sf, "tagged").select("row_id", tags.alias("_t")).select("row_id", "_t.*")


@query
def tag_extract_pages(spark, sf):
    """The same rule on raw web pages: outermost elements without attributes."""
    tags = masking.extract_tags(F.col("html"), ("head", "body"))
    return table(spark, sf, "pages").select("page_id", tags.alias("_t")).select("page_id", "_t.*")


@query
def mask_structured(spark, sf):
    return masking.mask_gsm8k_reasoning(view(spark, sf, "tagged"))


@query
def mask_between(spark, sf):
    return masking.mask_hk_o1aw(view(spark, sf, "reason"))


@query
def mask_two_part(spark, sf):
    return masking.mask_kaist_cot(_rationale(spark, sf))


def _conversations(spark, sf):
    return turns.conversation_rows(view(spark, sf, "turns"))


@query
def mask_one_turn(spark, sf):
    return masking.mask_lima(_conversations(spark, sf), ["conv_id"])


@query
def mask_fields(spark, sf):
    return masking.mask_magpie_reasoning(view(spark, sf, "fields"))


@query
def mask_solution(spark, sf):
    return masking.mask_numina_math(view(spark, sf, "problem"))


@query
def mask_chain(spark, sf):
    return masking.mask_o1_journey(view(spark, sf, "chain"))


@query
def mask_steps(spark, sf):
    return masking.mask_process_bench(view(spark, sf, "steps"))


# ---- validation and infill ------------------------------------------------------------------
@query
def pair_validate(spark, sf):
    rolled = view(spark, sf, "rollouts")
    return gate.with_validity(rolled, response="completion").select("row_id", "is_valid")


def _infilled(spark, sf, fill):
    filled = fill(F.col("query"), F.col("completion"))
    return (
        view(spark, sf, "rollouts")
        .select("row_id", F.posexplode_outer(filled).alias("place", "_t"))
        .select("row_id", "place", F.col("_t.desc").alias("tag_desc"), F.col("_t.content").alias("content"))
    )


@query
def infill_strict(spark, sf):
    return _infilled(spark, sf, G.infill_strict)


@query
def infill_lenient(spark, sf):
    return _infilled(spark, sf, G.infill_lenient)


@query
def infill_roundtrip(spark, sf):
    """Filling the response back into the query gives the document again."""
    pairs = masking.mask_cnn_daily_mail(view(spark, sf, "article"))
    return pairs.select("row_id", G.restore(F.col("query"), F.col("response")).alias("text"))


# ---- sampling ---------------------------------------------------------------------------------
def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source")


@query
def shuffle_rank(spark, sf):
    return sampling.hash_rank(_ids(spark, sf), ["doc_id"], seed=42)


@query
def head_n(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sampling.head_n(docs, ["doc_id"], docs.count() // 3, seed=42)


@query
def sample_wor(spark, sf):
    """A third of every source, exactly."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return sampling.sample_per_pool(
        docs, ["doc_id"], F.col("source"), lambda size: F.floor(size / 3), seed=7
    )


@query
def sample_wr(spark, sf):
    docs = _ids(spark, sf)
    return sampling.sample_with_replacement(docs, ["doc_id"], 2 * docs.count(), seed=42)


@query
def sample_adaptive(spark, sf):
    """Half the table (fits) and one and a half tables (does not) in one result."""
    docs = _ids(spark, sf)
    n = docs.count()
    small = sampling.sample_adaptive(docs, ["doc_id"], n // 2, seed=42)
    large = sampling.sample_adaptive(docs, ["doc_id"], n + n // 2, seed=42)
    return small.withColumn("part", F.lit("small")).unionByName(large.withColumn("part", F.lit("large")))


@query
def repeat_subset(spark, sf):
    copies = F.when(F.col("source") == "src1", 3).otherwise(1)
    return sampling.repeat(_ids(spark, sf), copies)


@query
def content_keys_events(spark, sf):
    """The same for a table with timestamps, every row twice."""
    events = table(spark, sf, "events")
    keyed = sampling.with_content_key(events.unionByName(events))
    return keyed.groupBy("occurrence").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("digests"))


@query
def content_keys(spark, sf):
    """Stable keys for rows without one: text digest and copy number."""
    return sampling.with_content_key(table(spark, sf, "documents").select("lang", "text")).select(
        F.md5("text").alias("text_md5"), "lang", "occurrence"
    )


# ---- mixtures -----------------------------------------------------------------------------------
def _mixed(spark, sf, recipe_of):
    rows = view(spark, sf, "subset")
    total = table(spark, sf, "documents").count()
    mixed = mixing.mix(rows, recipe_of(total))
    return mixed.select("row_id", "subset", "pool", "draw", "pos", F.md5("query").alias("query_md5"))


@query
def mix_weights(spark, sf):
    return _mixed(spark, sf, lambda n: recipes.weighted(3, 1, 2, n, TIER_SOURCES))


@query
def mix_keep_high(spark, sf):
    return _mixed(spark, sf, lambda n: recipes.keep_high(n * 9 // 10, TIER_SOURCES))


@query
def mix_long_only(spark, sf):
    return _mixed(spark, sf, lambda n: recipes.long_only(n, TIER_SOURCES))


@query
def mix_long_short(spark, sf):
    return _mixed(
        spark, sf, lambda n: recipes.long_short(n // 10, n // 4, n // 8, n // 8, TIER_SOURCES)
    )


@query
def mix_two_kinds(spark, sf):
    return _mixed(spark, sf, lambda n: recipes.two_kinds(n // 2, n - n // 2, KIND_SOURCES))


@query
def mix_ablation(spark, sf):
    return _mixed(spark, sf, lambda n: recipes.without_high(n // 4, TIER_SOURCES))


@query
def mix_quotas(spark, sf):
    return _mixed(
        spark,
        sf,
        lambda n: recipes.quotas(
            FOUR_TIER_SOURCES, verifiable=n // 4, high=n // 5, mid=n // 3, low=n // 10
        ),
    )


@query
def pool_counts(spark, sf):
    rows = view(spark, sf, "subset")
    tier = mixing.pool_of(F.col("subset"), TIER_SOURCES)
    pool = mixing.length_class_pool(tier, mixing.is_long_query())
    return rows.groupBy(pool.alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query
def split_90_10(spark, sf):
    docs = _ids(spark, sf)
    return sampling.split_by_share(docs, ["doc_id"], pool=F.col("source"))


@query
def split_head(spark, sf):
    docs = _ids(spark, sf)
    n = docs.count()
    return sampling.split_head(
        sampling.hash_rank(docs, ["doc_id"], seed=42, out="pos"), n * 98 // 100
    )


# ---- chat -------------------------------------------------------------------------------------------
def _rendered(spark, sf, template):
    pairs = masking.mask_cnn_daily_mail(view(spark, sf, "article"))
    text = chat.CHAT_TEMPLATES[template].render_pair(F.col("query"), F.col("response"))
    return pairs.select("row_id", text.alias("text"))


@query
def chat_render(spark, sf):
    return _rendered(spark, sf, "im")


@query
def chat_render_turn(spark, sf):
    """Question/answer rows in the second format."""
    rows = qa.qa_numina_math(view(spark, sf, "problem"))
    text = chat.CHAT_TEMPLATES["turn"].render_pair(F.col("q"), F.col("a"))
    return rows.select("row_id", text.alias("text"))


@query
def chat_request(spark, sf):
    rows = view(spark, sf, "problem")
    request = chat.infill_request(F.col("problem"), F.col("solution"))
    return rows.select("row_id", chat.CHAT_TEMPLATES["im"].render_prompt(request).alias("text"))


@query
def prompt_rows(spark, sf):
    rows = masking.mask_numina_math(view(spark, sf, "problem"))
    prompts = rows.select("row_id", *chat.prompt_row(F.col("query"), F.col("response")))
    return prompts.select(
        "row_id",
        F.size("prompt").alias("messages"),
        F.get("prompt", F.lit(0))["role"].alias("role"),
        chat.last_message(F.col("prompt")).alias("content"),
        "solution",
    )


@query
def response_span(spark, sf):
    rows = _rendered(spark, sf, "im").withColumn(
        "_s", chat.CHAT_TEMPLATES["im"].response_span(F.col("text"))
    )
    return rows.select("row_id", "_s.start", "_s.end")


def _budgeted(spark, sf):
    pairs = masking.mask_numina_math(view(spark, sf, "problem"))
    sized = chat.with_token_lengths(pairs, chat.pre_tokens, chat.CHAT_TEMPLATES["im"])
    return gate.pinned(sized).filter(chat.within_budget(CHAT_LIMIT))


@query
def token_budget(spark, sf):
    return _budgeted(spark, sf).select("row_id", "len_prompt", "len_prompt_completion")


@query
def token_max(spark, sf):
    return chat.token_limits(_budgeted(spark, sf), CHAT_LIMIT)


@query
def chat_training_set(spark, sf):
    """Mixture, chat text and 98/2 split in one job."""
    n = table(spark, sf, "documents").count()
    return jobs.chat_set(view(spark, sf, "subset"), recipes.weighted(3, 2, 1, n, TIER_SOURCES))


@query
def prompt_training_set(spark, sf):
    """Adaptive mixture, prompt rows within the token budget."""
    n = table(spark, sf, "documents").count()
    recipe = recipes.quotas(FOUR_TIER_SOURCES, verifiable=n // 5, high=n // 5, mid=n // 10, low=n // 10)
    rows = jobs.prompt_set(view(spark, sf, "subset"), recipe, limit=CHAT_LIMIT)
    message = F.get("prompt", F.lit(0))
    return rows.select(
        "pos", "row_id", "len_prompt", "len_prompt_completion", F.size("prompt").alias("messages"),
        message["role"].alias("role"), message["content"].alias("content"), "solution",
    )


@query
def first_rows_training_set(spark, sf):
    """The first third of the shuffled corpus as chat text, split 98/2."""
    docs = view(spark, sf, "subset")
    return jobs.first_rows_set(docs, table(spark, sf, "documents").count() // 3)


# ---- rewards --------------------------------------------------------------------------------------------
def _scores(spark, sf, *names):
    scored = rewards.score(view(spark, sf, "rollouts"), names)
    return scored.select("row_id", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])


@query
def reward_format_v1(spark, sf):
    return _scores(spark, sf, "format_v1")


@query
def reward_format(spark, sf):
    return _scores(spark, sf, "format")


@query
def reward_length_sign(spark, sf):
    return _scores(spark, sf, "length_sign")


@query
def reward_length_clip(spark, sf):
    return _scores(spark, sf, "length_clip")


@query
def reward_tags(spark, sf):
    return _scores(spark, sf, "tags")


@query
def reward_mix(spark, sf):
    """From prompt and completion message lists, whose last message counts."""

    def messages(role, text):
        return F.array(F.struct(F.lit(role).alias("role"), F.col(text).alias("content")))

    batch = view(spark, sf, "rollouts").select(
        "row_id",
        messages("user", "query").alias("prompts"),
        messages("assistant", "completion").alias("completions"),
        F.col("golden").alias("solution"),
    )
    scored = rewards.score(rewards.from_messages(batch), ["accuracy_length"])
    return scored.select("row_id", F.round("accuracy_length", 6).alias("accuracy_length"))


@query
def reward_strict(spark, sf):
    return _scores(spark, sf, "strict_length")


@query
def reward_loose(spark, sf):
    return _scores(spark, sf, "loose_length")


@query
def reward_several(spark, sf):
    return _scores(spark, sf, *rewards.REWARDS)


_MEANS = ("correct_tags", "accuracy", "perfect", "ratio", "factor", "reward")


@query
def reward_stats(spark, sf):
    stats = rewards.batch_statistics(rewards.details(view(spark, sf, "rollouts")))
    return stats.select("step", *[F.round(m, 6).alias(m) for m in _MEANS], "failures", "rollouts")


def _sampled(rollouts, **options):
    shown = rewards.sample_dump(rollouts, **options)
    return shown.select(
        "step", "row_id", "query", "completion", "golden", "correct_tags",
        F.round("ratio", 6).alias("ratio"), F.round("reward", 6).alias("reward"),
    )


@query
def reward_samples(spark, sf):
    return _sampled(view(spark, sf, "rollouts"), every=10)


@query
def reward_samples_first(spark, sf):
    return _sampled(
        view(spark, sf, "rollouts"),
        every=20, last=False, cut=(1000, 2000, 2000), strict=False, match=rewards.exact_match,
    )


# ---- viewing ---------------------------------------------------------------------------------------------
@query
def row_format(spark, sf):
    rows = view(spark, sf, "subset").select(
        "row_id",
        F.when(F.col("row_id") % 3 > 0, F.col("query")).alias("query"),
        F.when(F.col("row_id") % 5 == 0, "").otherwise(F.col("response")).alias("response"),
        F.when(F.col("row_id") % 2 == 0, F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))).alias("messages"),
    )
    return rows.select("row_id", viewing.row_format(rows).alias("format"))


@query
def page_n(spark, sf):
    """A page from the middle of the table."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return viewing.page(docs, "doc_id", docs.count() // 2, 25)


@query
def page_indexed(spark, sf):
    """The first, a middle and the last page, by one stored index."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rows, index = docs.count(), viewing.write_page_index(docs, "doc_id", _scratch(spark, "pages"), step=100)
    first, middle, last = (viewing.indexed_page(docs, "doc_id", index, start, 25) for start in (0, rows // 2, rows - 7))
    return first.unionByName(middle).unionByName(last)


@query
def display_escape(spark, sf):
    shown = F.concat(F.lit("\\(<b>\\) \\[x\\] "), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id",
        viewing.display_text(shown).alias("plain"),
        viewing.display_text(shown, latex=True).alias("latex"),
    )


@query
def messages_flat(spark, sf):
    rows = view(spark, sf, "subset").select(
        "row_id",
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
        ).alias("messages"),
    )
    return viewing.message_blocks(rows, ["row_id"])


# ---- sources, sinks, whole builds -------------------------------------------------------------------------
@query
def jsonl_roundtrip(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"),
        F.col("source").alias("subset"), F.lit("train").alias("split"),
    )
    root = writers.write_jsonl_tree(rows, _scratch(spark, "jsonl"))
    return readers.read_jsonl_tree(spark, root, "doc_id bigint, text string, lang string")


@query
def jsonl_quarantine(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", "text"))
    shape = F.col("doc_id") % 10
    lines = docs.select(
        F.when(shape == 3, F.concat(F.lit("x"), line))
        .when(shape == 5, "null")
        .when(shape == 7, "  ")
        .otherwise(F.concat(F.lit(" "), line, F.lit(" ")))
        .alias("value")
    )
    path = _scratch(spark, "lines")
    lines.write.text(path)
    good, bad = readers.read_jsonl_tolerant(spark, path, "doc_id bigint, text string")
    return good.withColumn("status", F.lit("row")).unionByName(
        bad.select(
            F.regexp_extract("line", r'"doc_id":(\d+)', 1).cast("bigint").alias("doc_id"),
            F.lit(None).cast("string").alias("text"),
            F.lit("quarantine").alias("status"),
        )
    )


@query
def publish_layout(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("subset"))
    labelled = sampling.split_by_share(docs, ["doc_id"], pool=F.col("subset"))
    root = writers.publish(labelled, _scratch(spark, "published"))
    whole = spark.read.parquet(root)
    return whole.groupBy("subset", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")
    )


@query
def gate_reasons(spark, sf):
    """Why and where each pair is refused; the rollouts, with more kinds of damage."""
    rows = view(spark, sf, "rollouts").select("row_id", "query", F.col("completion").alias("response"))
    kind = F.floor(F.col("row_id") / 12) % 5
    query = F.when(kind == 1, F.replace("query", F.lit(' desc="'), F.lit(' id="m_3" desc="'))).when(kind == 2, F.concat("query", F.lit("<|/MASKED|>"))).otherwise(F.col("query"))
    response = F.when(kind == 3, F.replace("response", F.lit("<|/MASKED|>"), F.lit("<|/MASKED|> "))).when(kind == 4, F.replace("response", F.lit("<|/MASKED|>"), F.lit("<|M_INPUT")))
    damaged = rows.select("row_id", query.alias("query"), response.otherwise(F.col("response")).alias("response"))
    told = damaged.select("row_id", G.trouble(F.col("query"), F.col("response")).alias("t"))
    return told.select("row_id", "t.reason", "t.at")


@query
def publish_replace(spark, sf):
    """One subset published again with other rows: it is replaced, the others are as they were, and the manifest agrees."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("subset"), F.lit("train").alias("split"))
    root = writers.republish(docs, _scratch(spark, "republished"))
    writers.write_manifest(docs, root)
    again = docs.filter("subset = 'src1' and doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    writers.write_manifest(again, writers.republish(again, root))
    whole = spark.read.schema("doc_id bigint, text string, subset string, split string").parquet(root)
    kept = whole.groupBy("subset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    said = spark.read.parquet(f"{root}/_manifest").select(F.col("subset"), "split", F.col("rows").alias("manifest_rows"))
    wrong = writers.unlike_manifest(spark, root).select("subset", "split", F.lit(True).alias("wrong"))
    return kept.join(said, ["subset", "split"], "full").join(wrong, ["subset", "split"], "left").withColumn("wrong", F.coalesce("wrong", F.lit(False)))


@query
def split_shards(spark, sf):
    """Two splits written as numbered shards into one folder, and one of them read by its name."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    root = _scratch(spark, "shards")
    for split, rows in (("test", docs.filter("doc_id % 10 = 0")), ("train", docs.filter("doc_id % 10 <> 0 or doc_id is null"))):
        writers.write_split_shards(rows, root, split, 4)
    read = readers.read_split_shards(spark, root, "test", "doc_id bigint, text string")
    index = spark.read.schema("file string, rows bigint").json(f"{root}/_shards/test")
    return read.select("doc_id", F.char_length("text").alias("chars")).unionByName(index.agg(F.lit(-1).cast("bigint").alias("doc_id"), F.sum("rows").cast("int").alias("chars")))


@query
def shuffled_files(spark, sf):
    """Rows written in shuffled order, a thousand ranks a block: what each block holds, and that its files are sorted."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ranked = sampling.hash_rank(docs, ["doc_id"], seed=42)
    root = writers.write_in_order(ranked, _scratch(spark, "ordered"), rows_per_file=1000)
    back = spark.read.schema("doc_id bigint, text string, rank bigint, block bigint").parquet(root)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    placed = back.select("block", "rank", "doc_id", at.alias("at"))
    return placed.groupBy("block").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("doc_id", "at").alias("first_doc"), F.max_by("doc_id", "at").alias("last_doc")
    )


@query
def jsonl_statuses(spark, sf):
    """Lines with all sorts of damage, parsed once and written by status."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", "text"))
    shape = F.col("doc_id") % 10
    damaged = (
        F.when(shape == 3, F.concat(F.lit("x"), line).cast("binary")).when(shape == 5, F.lit("null").cast("binary")).when(shape == 7, F.lit("  ").cast("binary"))
        .when(shape == 8, F.concat(F.lit("\ufeff"), line).cast("binary")).when(shape == 9, F.concat(line.cast("binary"), F.unhex(F.lit("FF"))))
        .otherwise(F.concat(F.lit(" "), line, F.lit(" ")).cast("binary"))
    )
    path = _scratch(spark, "lines")
    docs.select(damaged.cast("string").alias("value")).write.text(path)
    root = writers.sort_jsonl(spark, path, "doc_id bigint, text string", _scratch(spark, "statuses"))
    told = spark.read.schema("file string, line binary, row struct<doc_id: bigint, text: string>, status string").parquet(root)
    number = F.regexp_extract(F.decode(F.substring("line", 1, 60), "ISO-8859-1"), r'"doc_id":(\d+)', 1).try_cast("bigint")
    return told.select("status", F.coalesce("row.doc_id", number).alias("doc_id"), F.char_length("row.text").alias("chars"))


def _published(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("subset"))
    labelled = sampling.split_by_share(docs, ["doc_id"], pool=F.col("subset"))
    return writers.publish(labelled, _scratch(spark, "published"), rebalance=True)


@query
def read_one_split(spark, sf):
    """The test split of one subset, read from its own folder."""
    return readers.read_subset(spark, _published(spark, sf), "src1", "test", "doc_id bigint, text string")


@query
def read_all_splits(spark, sf):
    return readers.read_subset(spark, _published(spark, sf), "src1")


@query
def jsonl_plain_tree(spark, sf):
    """Pairs written as ``<subset>/<split>.jsonl`` and discovered again."""
    pairs = table(spark, sf, "documents").select(F.col("text").alias("query"), F.col("source").alias("response"), "lang")
    root = _scratch(spark, "tree")
    english = F.col("lang").eqNullSafe(F.lit("en"))
    for subset, rows in (("english", pairs.filter(english)), ("other", pairs.filter(~english))):
        writers.save_pairs(rows.drop("lang"), root, subset)
    return readers.read_jsonl_tree(spark, root, "query string, response string")


@query
def gate_split(spark, sf):
    """Rows that pass the gate and rows set aside."""
    pairs = view(spark, sf, "rollouts").select("row_id", "query", F.col("completion").alias("response"))
    good, bad = gate.split_valid(pairs)
    return good.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False)))


@query
def build_chosen_pairs(spark, sf):
    """Two subsets by choice."""
    built = builds.build_pairs(_corpora(spark, sf), ["numina_math", "hk_o1aw"])
    return built.groupBy("subset").agg(F.count_if("is_valid").alias("pairs"), F.count_if(~F.col("is_valid")).alias("quarantined"))


@query
def qa_absent_column(spark, sf):
    """An optional column that the table lacks counts as null."""
    return qa.qa_hk_o1aw(view(spark, sf, "reason").drop("thinking"))


def _corpora(spark, sf):
    return {
        "cnn_daily_mail": view(spark, sf, "article"),
        "gsm8k_reasoning": view(spark, sf, "tagged"),
        "hk_o1aw": view(spark, sf, "reason"),
        "kaist_cot": _rationale(spark, sf),
        "lima": _conversations(spark, sf).withColumnRenamed("conv_id", "row_id"),
        "magpie_reasoning": view(spark, sf, "fields"),
        "numina_math": view(spark, sf, "problem"),
        "o1_journey": view(spark, sf, "chain"),
        "process_bench": view(spark, sf, "steps"),
        "uhgeval": view(spark, sf, "news"),
    }


@query
def build_all_pairs(spark, sf):
    """All ten corpora masked; rows kept and rows set aside, per subset."""
    built = builds.build_pairs(_corpora(spark, sf))
    return built.groupBy("subset").agg(
        F.count_if("is_valid").alias("pairs"),
        F.count_if(~F.col("is_valid")).alias("quarantined"),
        F.sum(F.when(F.col("is_valid"), F.char_length("response"))).alias("response_chars"),
    )


@query
def build_all_qa(spark, sf):
    """All ten corpora as question/answer rows, split 90/10 per subset."""
    built = builds.build_qa(_corpora(spark, sf))
    return built.groupBy("subset", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.char_length("q")).alias("q_chars"),
        F.sum(F.char_length("a")).alias("a_chars"),
    )
