"""N-gram Jaccard join by size, heavy and light, and the groups it links.

Texts link when their sets of word n-grams have a Jaccard similarity of at least a
threshold.  Equal sets are one node.  The join over different sets goes in steps, all exact:

1. **Shared n-grams.**  In the order of n-gram hashes, two linked sets share at least
   ``slack(n)`` of their first ``prefix(n)`` n-grams.  These prefixes are dealt by hash to
   buckets in packed form (four bytes an n-gram, one entry for each block of documents that
   has it, so a common n-gram is no hot key); a set goes on only if enough of its prefix
   is found in other sets.
2. **Rarest first.**  The sets that go on are dealt out whole in the same way, now to count
   the sets of each n-gram.  A set of which less than four in five n-grams are found in
   others is out; of the rest, only the rarest ``n - need + 1`` n-grams can be the first
   that two linked sets share.
3. **Heavy and light.**  Small sets enumerate their pairs of n-grams (subsets of size two) and
   meet where they share one; large sets are posted to the inverted list of each n-gram.
   Sets near the boundary do both.  The boundary is the size at which the cost counted from
   the data, subsets against list entries to scan, is least.
4. **Stars before pairs.**  A list or subset with many sets is not paired out.  First every set
   is compared with one hub, the most shared set of its largest list.  Then entries go that no
   other size in their list can answer: where two sets first meet bounds their overlap, and so
   the sizes that an entry can link to.  The lists' own hubs come next, and lists of one
   component go.
5. **Light and heavy lists.**  In a list that is one component but for at most ``LIGHT`` entries,
   those are paired with all others.  The sets of any other list are compared by what
   sets them apart from its majority of n-grams: two linked sets either share such a difference or
   are both linked to the set that differs least (``_differences``), so that one becomes the
   hub, and the rarest differences that their overlap needs are the next, longer subsets.  Each
   holds at most half of the list, and is light or heavy again.
6. Every pair is verified on the whole sets; components are merged by minimum labels.

N-grams are 64-bit hashes; a set is named by a 128-bit hash of its n-grams.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillweave.llm.common import keep, ship, whole_text

WORDS = 5
PERCENT = 80
#: bytes of text for one bucket of packed prefixes, and the least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 24_000_000, 64
#: keys that are broadcast at most, as bytes of text and 64 for each; beyond that the join is a shuffled one
BROADCAST_BYTES = 64_000_000
#: sets smaller than this have lists only: their slack is no two n-grams
LEAST_PAIRED = 16
#: what a subset costs, in list entries
SUBSET_COST = 3

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: owner of an n-gram that several sets of a block have; a block has fewer documents
ALL = 65535
#: documents of a block at most, and bytes of their texts (one longer text is a block of its own)
BLOCK, BLOCK_BYTES = 2048, 8_000_000
#: entries outside a list's largest component that are paired with the others
LIGHT = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; fewer words are one n-gram, none give none."""
    split = text.encode().translate(_FOLD).split()
    n = len(split)
    if n < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed=n)] if n else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, n)
    x = h[: n - words + 1].copy()
    for i in range(1, words):
        x *= _STEP
        x += h[i : n - words + 1 + i]
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


def name_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def least_common(n, percent: int):
    """N-grams that a set of ``n`` shares with any set it links to, at least."""
    return (n * percent + 99) // 100


def slack(n):
    return 1 + n // 10


def prefix(n, percent: int):
    return n - least_common(n, percent) + slack(n)


def least_shared(n, percent: int):
    """The slack of the smallest set that one of ``n`` can link to."""
    return slack(least_common(n, percent))


def _sql(formula, n: str, *args) -> str:
    """The integer formulas above as SQL."""
    texts = {
        least_common: "(({n} * {p} + 99) div 100)",
        slack: "(1 + {n} div 10)",
    }
    if formula is prefix:
        n_sql = f"({n} - {_sql(least_common, n, *args)} + {_sql(slack, n)})"
        return f"least({n}, {n_sql})"
    if formula is least_shared:
        return _sql(slack, _sql(least_common, n, *args))
    return texts[formula].format(n=n, p=args[0] if args else "")


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch of (key, text), by rows and bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, min(start + BLOCK, int(np.searchsorted(ends, before + BLOCK_BYTES, "right"))))
        yield batch.slice(start, end - start)
        start = end


def _scan(docs: DataFrame, buckets: int, percent: int, words: int, key_type, whole: bool = False) -> DataFrame:
    """One pass over the texts: a row for each document, and packed n-grams for each block of documents and bucket.

    The n-grams are prefixes, or with ``whole`` the sets, which the documents' rows then hold too.
    A block's id is its partition and its number there, so blocks with equal rows stay apart; the
    result is to be written before it is read twice.
    """
    bits = buckets.bit_length() - 1
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in _cut(batch):
                block = next(blocks)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                sizes = np.array([len(s) for s in sets], np.int64)
                names = [name_of(s) for s in sets]
                first = {s: i for i, s in reversed(list(enumerate(names)))}  # equal sets of a block count once
                mine = [i for i in first.values() if len(sets[i])]
                if not mine:
                    yield _sets(part, sets, names, sizes, block, np.zeros(len(sets)))
                    continue
                cut = [sets[i] if whole else sets[i][: min(len(sets[i]), prefix(len(sets[i]), percent))] for i in mine]
                grams = np.concatenate(cut)
                owners = np.repeat(np.array(mine, np.uint16), [len(c) for c in cut])
                order = np.argsort(grams, kind="stable")
                grams, owners = grams[order], owners[order]
                same = grams[1:] == grams[:-1]
                several = np.r_[False, same] | np.r_[same, False]
                own = np.bincount(owners[several], minlength=len(sets))
                yield _sets(part, sets, names, sizes, block, own)
                # an n-gram that several sets of the block have is dealt out once, for all of them
                first_of = ~np.r_[False, same]
                tally = np.diff(np.r_[np.nonzero(first_of)[0], len(grams)]).astype(np.uint16)
                yield _packs(block, grams[first_of], np.where(several, ALL, owners)[first_of].astype(np.uint16), tally)
                if whole and several.any():
                    yield _packs(block, grams[several], owners[several], None)

    def _sets(part, sets, names, sizes, block, own) -> pa.RecordBatch:
        n = part.num_rows
        held = {"whole": [x.view(np.int64) for x in sets]} if whole else {}
        return _rows(n, key=part.column(0).cast(key_type), n=sizes, sid=names, block=np.full(n, block), place=np.arange(n), found=own, **held)

    def _packs(block: int, grams: np.ndarray, owners: np.ndarray, tally: np.ndarray | None) -> pa.RecordBatch:
        """Sorted n-grams cut by bucket; without ``tally`` they stay with their block."""
        low = ((grams << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        used, at = np.unique((grams >> shift).astype(np.int64), return_index=True)
        cuts = list(zip(at, [*at[1:], len(grams)]))
        more = {} if tally is None else {"tally": [tally[a:b].tobytes() for a, b in cuts]}
        return _rows(
            len(used), bucket=used, block=np.full(len(used), block),
            grams=[low[a:b].tobytes() for a, b in cuts], owners=[owners[a:b].tobytes() for a, b in cuts], **more,
        )

    fields = {
        "key": key_type, "n": pa.int64(), "sid": pa.binary(), "block": pa.int64(), "place": pa.int32(), "found": pa.int64(), "whole": pa.list_(pa.int64()),
        "bucket": pa.int32(), "grams": pa.binary(), "owners": pa.binary(), "tally": pa.binary(),
    }

    def _rows(count: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f], t) if f in columns and not isinstance(columns[f], pa.Array) else columns.get(f, pa.nulls(count, t)) for f, t in fields.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(fields))

    key = docs.schema["key"].dataType.simpleString()
    schema = f"key {key}, n bigint, sid binary, block bigint, place int, found bigint, whole array<bigint>, bucket int, grams binary, owners binary, tally binary"
    return docs.mapInArrow(run, schema)


def _unpacked(table: pa.Table, *columns: tuple[str, type]) -> tuple[np.ndarray, ...]:
    """Row number of each n-gram, and the packed columns end to end."""
    parts = [[np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in columns]
    of = np.repeat(np.arange(table.num_rows), [len(x) for x in parts[0]])
    return of, *(np.concatenate(p) if p else np.empty(0, kind) for p, (_, kind) in zip(parts, columns))


def _found_elsewhere(table: pa.Table) -> pa.Table:
    """For one bucket: how many n-grams of each (block, place) occur in other blocks."""
    of, grams, owners = _unpacked(table, ("grams", np.uint32), ("owners", np.uint16))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    at = order[np.r_[False, same] | np.r_[same, False]]
    at = at[owners[at] != ALL]
    spots, counts = np.unique(of[at] * 65536 + owners[at], return_counts=True)
    blocks = table.column("block").to_numpy()[spots // 65536] if len(spots) else np.empty(0, np.int64)
    return pa.table({"block": pa.array(blocks, pa.int64()), "place": pa.array(spots % 65536, pa.int32()), "elsewhere": pa.array(counts, pa.int64())})


def _set_counts(table: pa.Table) -> pa.Table:
    """For one bucket: its rows as they are, with a byte for each n-gram that tells in how many sets it is.

    The byte is exact up to 127 and counts doublings from there, so it keeps the order.
    """
    of, grams, tally = _unpacked(table, ("grams", np.uint32), ("tally", np.uint16))
    _, which = np.unique(grams, return_inverse=True)
    counts = np.bincount(which, weights=tally)
    codes = np.where(counts < 128, counts, np.minimum(255, 121 + np.floor(np.log2(np.maximum(counts, 1))))).astype(np.uint8)[which]
    ends = np.cumsum(np.bincount(of, minlength=table.num_rows))
    parts = [c.tobytes() for c in np.split(codes, ends[:-1])]
    return table.drop(["tally"]).append_column("counts", pa.array(parts, pa.binary()))


def _rarest(percent: int):
    """For one block of documents: of each set that is shared enough, the n-grams by which it can meet others."""
    names = ["sid", "n", "gram", "df", "at", "listed", "rank"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.float64()]

    def run(sets: pa.Table, packed: pa.Table) -> pa.Table:
        if not (sets.num_rows and packed.num_rows):
            return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
        dealt = packed.filter(pc.is_valid(packed.column("counts")))
        row, low, owner, df = _unpacked(dealt, ("grams", np.uint32), ("owners", np.uint16), ("counts", np.uint8))
        gram = (dealt.column("bucket").to_numpy().astype(np.int64)[row] << 32) | low
        stayed = packed.filter(pc.is_null(packed.column("counts")))
        if stayed.num_rows:  # n-grams of several sets of the block: each set's own, with the count of the one dealt out
            row, low, own = _unpacked(stayed, ("grams", np.uint32), ("owners", np.uint16))
            mine = (stayed.column("bucket").to_numpy().astype(np.int64)[row] << 32) | low
            for_all = owner == ALL
            once, count = gram[for_all], df[for_all]
            order = np.argsort(once)
            found = count[order][np.searchsorted(once[order], mine)]
            gram, owner, df = (np.concatenate([x[~for_all], y]) for x, y in ((gram, mine), (owner, own), (df, found)))
        owner, df = owner.astype(np.int64), df.astype(np.int32)
        order = np.lexsort((gram, df, owner))
        owner, df, gram = owner[order], df[order], gram[order]
        size = np.bincount(owner, minlength=65536)
        shared = np.bincount(owner, weights=df > 1, minlength=65536).astype(np.int64)
        start = np.cumsum(size) - size
        need = least_common(size, percent)
        at = np.arange(len(owner)) - start[owner]
        spare = (size - need)[owner]
        keep_it = (df > 1) & (shared >= need)[owner] & (at <= spare + 1)
        row_of = np.zeros(65536, np.int64)
        row_of[sets.column("place").to_numpy()] = np.arange(sets.num_rows)
        of = owner[keep_it]
        sid = sets.column("sid").combine_chunks().cast(pa.binary()).take(pa.array(row_of[of]))
        columns = [sid, size[of], gram[keep_it], df[keep_it], at[keep_it], (at <= spare)[keep_it], shared[of] / np.maximum(size[of], 1)]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, types)})

    return run


def _shared(scanned: DataFrame, enough: str) -> DataFrame:
    """Rows of a scan of which at least ``enough`` (SQL) n-grams are found in other sets."""
    packed = scanned.filter("bucket is not null").select("bucket", "block", "grams", "owners")
    found = packed.groupBy("bucket").applyInArrow(_found_elsewhere, "block bigint, place int, elsewhere bigint")
    found = found.groupBy("block", "place").agg(F.sum("elsewhere").alias("elsewhere"))
    rows = scanned.filter("bucket is null").join(found, ["block", "place"], "left")
    return rows.filter(f"n > 0 and found + coalesce(elsewhere, 0) >= {enough}")


def _small(keys: DataFrame) -> DataFrame:
    """One column of keys, to be broadcast if its bytes, counted first, allow it."""
    size = F.octet_length(F.col(keys.columns[0]).cast("string"))
    return F.broadcast(keys) if (keys.agg(F.sum(F.coalesce(size, F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES else keys


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose key is in ``wanted``; null keys are equal."""
    keys = _small(wanted.select(F.col("key").alias("_key")))
    return docs.join(keys, docs["key"].eqNullSafe(F.col("_key")), "left_semi").select("key", "text")


def _candidate_keys(kept: DataFrame, percent: int) -> DataFrame:
    """(meet, sid, n, rank, df, at): the subsets and lists by which sets meet; ``rank`` orders hubs.

    ``at``: n-grams of the set that come before those it meets by.
    """
    # cost by class of sizes, a few hundred rows: subsets of a set, and entries of its lists
    by_set = kept.groupBy("sid").agg(F.first("n").alias("n"), F.count("*").alias("m"), F.sum(F.when(F.col("listed"), F.col("df"))).alias("entries"))
    classes = by_set.groupBy(F.expr("cast(8 * log2(n) as int)").alias("class")).agg(
        F.max("n").alias("most"), F.sum(F.expr("m * (m - 1) / 2")).alias("subsets"), F.sum("entries").alias("entries")
    )
    boundary = _boundary([(r["most"], float(r["subsets"] or 0), float(r["entries"] or 0)) for r in classes.collect()], percent)
    small = (F.col("n") >= LEAST_PAIRED) & (F.col("n") <= boundary)
    # who can link to a set that has lists only must be in the lists too
    listed = F.col("listed") & (~small | (F.col("n") * 100 >= boundary * percent) | (F.col("n") * percent <= LEAST_PAIRED * 100))
    lists = kept.filter(listed).select(F.xxhash64(F.lit(1), "gram").alias("meet"), "sid", "n", "rank", "df", "at")
    a, b = kept.filter(small).alias("a"), kept.filter(small).select("sid", "gram", "df", "at").alias("b")
    pairs = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.gram") < F.col("b.gram"))).select(
        F.xxhash64(F.lit(2), "a.gram", "b.gram").alias("meet"), F.col("a.sid").alias("sid"), F.col("a.n").alias("n"), F.col("a.rank").alias("rank"),
        F.least("a.df", "b.df").alias("df"), (F.greatest("a.at", "b.at") - 1).alias("at"),
    )
    return keep(lists.unionByName(pairs), "join-keys")


def _boundary(classes: list[tuple[int, float, float]], percent: int) -> int:
    """The largest small set: where subsets plus the entries that the others scan cost least."""
    options = [LEAST_PAIRED - 1] + sorted(most for most, _, _ in classes if most >= LEAST_PAIRED)

    def cost(x: int) -> float:
        paired = sum(s for most, s, _ in classes if LEAST_PAIRED <= most <= x)
        scanned = sum(e for most, _, e in classes if most * 100 >= x * percent or most < LEAST_PAIRED)
        return SUBSET_COST * paired + scanned

    return min(options, key=lambda x: (cost(x), x))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets meet the threshold."""
    left = sets.select(F.col("sid").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("grams").alias("of_b"))

    common = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - common
    return pairs.join(right, "b").join(left, "a").filter(100 * common >= percent * either).select("a", "b")


def _possible(a: str, b: str, percent: int, positions: bool = True) -> Column:
    """Whether two sets can link by their sizes and by where they meet (columns of the prefixes ``a`` and ``b``).

    Where they share their first n-gram, each has ``n - at`` left, and the link needs the
    overlap ``percent / (100 + percent)`` of both sizes.
    """
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    if not positions:
        return fits
    need = F.ceil((n_a + n_b) * percent / (100 + percent))
    return fits & (n_a - F.col(f"{a}.at") >= need) & (n_b - F.col(f"{b}.at") >= need)


def components(links: DataFrame) -> DataFrame:
    """(sid, comp): the smallest sid that each linked one reaches, by minimum labels and shortcuts."""
    both = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("sid"), F.least("a", "b").alias("comp")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, labels["sid"] == heard["a"]).select("sid", "comp", F.least("comp", "heard").alias("low"))
        jump = labels.select(F.col("sid").alias("low"), F.col("comp").alias("over"))
        step = keep(lower.join(jump, "low").select("sid", F.least("low", "over").alias("comp"), (F.least("low", "over") < F.col("comp")).alias("moved")), "labels")
        labels = step.select("sid", "comp")
        if step.filter("moved").isEmpty():
            return labels


def _star_pairs(keys: DataFrame, percent: int, positions: bool = True) -> DataFrame:
    """(a, b): of each key's sets, all against its hub, unless in the hub's component already."""
    best = F.max(F.struct("rank", "n", "sid", "comp", "at")).alias("hub")
    hubs = keys.groupBy("meet").agg(best, F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    met = keys.alias("k").join(hubs.select("meet", "hub"), "meet")
    met = met.filter((F.col("comp") != F.col("hub.comp")) & _possible("k", "hub", percent, positions))
    return met.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct()


def _alive(keys: DataFrame, percent: int) -> DataFrame:
    """Entries of keys that hold several components and a size that the entry can link to.

    An entry that meets at ``at`` has ``n - at`` left and links to sizes up to ``most``; in its key
    something must be as small, and something must take its own size.
    """
    most = F.expr(f"least(n * 100 div {percent}, (100 * n - {100 + percent} * at) div {percent})")
    left = keys.withColumn("most", most)
    for _ in range(2):
        ends = left.groupBy("meet").agg(F.min("n").alias("lowest"), F.max("most").alias("reach"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        ends = ends.filter("low < high").select(F.col("meet").alias("_meet"), "lowest", "reach")
        fits = (F.col("meet") == F.col("_meet")) & (F.col("most") >= F.col("lowest")) & (F.col("n") <= F.col("reach"))
        left = left.join(ends, fits).select("meet", "sid", "n", "rank", "at", "comp", "most")
    return keep(left.drop("most"), "join-alive")


def _weighed(keys: DataFrame) -> DataFrame:
    """(meet, hub, main, outside): each open key's most shared set, its largest component and the entries outside that."""
    by_comp = keys.groupBy("meet", "comp").agg(F.count("*").alias("c"), F.max(F.struct("rank", "n", "sid")).alias("hub"))
    by_key = by_comp.groupBy("meet").agg(F.sum("c").alias("entries"), F.max(F.struct("c", "comp")).alias("main"), F.max("hub").alias("hub"))
    return by_key.filter("entries > main.c").select("meet", F.col("hub.sid").alias("hub"), F.col("main.comp").alias("main"), (F.col("entries") - F.col("main.c")).alias("outside"))


def _across(keys: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """(a, b): the entries outside a light key's largest component with all that are in other components."""
    few = keys.join(light.select(F.col("meet").alias("_meet"), "main"), (F.col("meet") == F.col("_meet")) & (F.col("comp") != F.col("main")))
    a, b = few.select("meet", "sid", "n", "at", "comp").alias("a"), keys.alias("b")
    pairs = a.join(b, (F.col("a.meet") == F.col("b.meet")) & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b", percent))
    return pairs.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()


def _differences(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(meet, sid, n, tokens, phi): how the sets of a key differ from its majority of n-grams R; ``center`` is one of them.

    Let X be a set's differences from R (n-grams of R that it lacks, and its own that R lacks), t the threshold and
    phi(A) = |X_A| - |A| * (1 - t) / (1 + t).  A and B link if |X_A| + |X_B| - 2 |X_A & X_B| is at most
    (|A| + |B|) * (1 - t) / (1 + t), that is if they share (phi(A) + phi(B)) / 2 differences.  If linked
    sets share none, phi(A) + phi(B) <= 0, and the set M of least phi links to both: |X_A| + |X_M| bounds
    how far A and M differ, and phi(A) + phi(M) <= phi(A) + phi(B) <= 0.  That holds for any R; taking the
    majority keeps each difference to half of the key's sets.  ``phi`` is scaled to whole numbers.
    """
    centers = sets.select(F.col("sid").alias("center"), F.col("grams").alias("about"))
    both = group.join(centers, "center").join(sets.select("sid", "grams"), "sid")

    def apart(about: Column) -> Column:
        lacks = F.transform(F.array_except(about, "grams"), lambda x: F.struct(x.alias("gram"), F.lit(False).alias("own")))
        owns = F.transform(F.array_except("grams", about), lambda x: F.struct(x.alias("gram"), F.lit(True).alias("own")))
        return F.concat(lacks, owns)

    many = group.groupBy("meet").agg(F.count("*").alias("entries"))
    usual = both.select("meet", F.explode(apart(F.col("about"))).alias("x")).groupBy("meet", "x").agg(F.count("*").alias("c"))
    usual = usual.join(many, "meet").filter("2 * c > entries").groupBy("meet").agg(
        F.collect_list(F.when(F.col("x.own"), F.col("x.gram"))).alias("more"), F.collect_list(F.when(~F.col("x.own"), F.col("x.gram"))).alias("less")
    )
    none = F.array().cast("array<bigint>")
    majority = F.array_union(F.array_except("about", F.coalesce("less", none)), F.coalesce("more", none))
    both = both.join(usual, "meet", "left").withColumn("about", majority)
    tokens = F.transform(apart(F.col("about")), lambda x: F.xxhash64(x["gram"], x["own"]))
    told = both.select("meet", "sid", "n", tokens.alias("tokens"))
    return keep(told.withColumn("phi", F.size("tokens").cast("bigint") * (100 + percent) - F.col("n") * (100 - percent)), "join-differences")


def _longer_keys(told: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(meet, sid, n, rank, at): sets by the rarest differences that they must share with what they link to."""
    each = told.join(hubs, "meet").select("meet", "sid", "n", "phi", "least", F.explode("tokens").alias("token"))
    shared = each.groupBy("meet", "token").agg(F.count("*").alias("c")).filter("c > 1")
    each = each.join(shared, ["meet", "token"])
    mine = Window.partitionBy("meet", "sid")
    need = F.greatest(F.lit(1), F.ceil((F.col("phi") + F.col("least")) / (2 * (100 + percent))))
    each = each.withColumn("have", F.count("*").over(mine)).withColumn("place", F.row_number().over(mine.orderBy("c", "token")))
    each = each.filter(F.col("place") <= F.col("have") - need + 1)
    return each.select(F.xxhash64("meet", "token").alias("meet"), "sid", "n", (-F.col("phi")).cast("double").alias("rank"), F.lit(0).cast("bigint").alias("at"))


class _Linker:
    """The links found so far and their components."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        found = keep(_verified(pairs, self.sets, self.percent), "join-links")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.comp = components(self.links)

    def placed(self, keys: DataFrame) -> DataFrame:
        keys = keys.drop("comp")
        if self.comp is None:
            return keys.withColumn("comp", F.col("sid"))
        return keys.join(self.comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def _links(sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame | None:
    """(sid, comp): stars on each set's largest list, stars on what is open, then light and heavy keys until none is open."""
    linker = _Linker(sets, percent)
    now = linker.placed(keys)
    largest = now.groupBy("sid").agg(F.max(F.struct("df", "meet", "n", "rank", "comp", "at")).alias("k")).select("sid", "k.*")
    linker.verify(_star_pairs(largest, percent, positions=False))
    now = _alive(linker.placed(keys), percent)
    linker.verify(_star_pairs(now, percent))
    now, shared_hubs = _alive(linker.placed(now), percent), True
    while True:
        weighed = keep(_weighed(now), "join-weighed")
        heavy = weighed.filter(F.col("outside") > LIGHT).select("meet", F.col("hub").alias("center"))
        linker.verify(_across(now, weighed.filter(F.col("outside") <= LIGHT), percent))
        if heavy.isEmpty():
            return linker.comp
        group = now.join(heavy, "meet").select("meet", "center", "sid", "n")
        if shared_hubs:  # the many subsets by which the same sets meet have one hub, and are one group
            group = group.withColumn("meet", F.xxhash64("center")).distinct()
            shared_hubs = False
        told = _differences(keep(group, "join-group"), sets, percent)
        hubs = told.groupBy("meet").agg(F.min(F.struct("phi", "sid")).alias("m")).select("meet", F.col("m.phi").alias("least"), F.col("m.sid").alias("hub"))
        stars = linker.placed(told.select("meet", "sid")).join(linker.placed(hubs.select("meet", F.col("hub").alias("sid"))).select("meet", F.col("sid").alias("hub"), F.col("comp").alias("of_hub")), "meet")
        stars = stars.filter(F.col("comp") != F.col("of_hub"))
        linker.verify(stars.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct())
        now = keep(linker.placed(keep(_longer_keys(told, hubs, percent), "join-longer")), "join-open")


def linked(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """key, n_shingles, component of every document: the smallest key that links reach, its own included.

    Texts with fewer words than an n-gram are one n-gram; null texts and texts without words
    have size 0, link to nothing and are components of their own.  Rows with equal texts are
    linked; rows that repeat a key are documents of their own.  A null key is larger than any
    other: a component of null keys only has a null id.  An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    key_type = to_arrow_type(docs.schema["key"].dataType)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(size / BUCKET_BYTES + 1)))
    scanned = keep(_scan(docs, buckets, percent, words, key_type), "join-scan")
    rows = scanned.filter("bucket is null").select("key", "n", "sid")
    first = _shared(scanned, _sql(least_shared, "n", percent))
    wanted = keep(first.groupBy("sid").agg(F.min("key").alias("key")), "join-wanted")
    again = keep(_scan(_texts_of(docs, wanted), buckets, percent, words, key_type, whole=True), "join-again")
    named = again.filter("bucket is null").select("block", "place", "sid", "n", F.col("whole").alias("grams"))
    named = named.join(wanted.select("sid"), "sid", "left_semi")
    packed = again.filter("bucket is not null")
    dealt = packed.filter("tally is not null").select("bucket", "block", "grams", "owners", "tally")
    dealt = dealt.groupBy("bucket").applyInArrow(_set_counts, "bucket int, block bigint, grams binary, owners binary, counts binary")
    stayed = packed.filter("tally is null").select("bucket", "block", "grams", "owners", F.lit(None).cast("binary").alias("counts"))
    both = named.select("block", "place", "sid").groupBy("block").cogroup(dealt.unionByName(stayed).groupBy("block"))
    kept = both.applyInArrow(_rarest(percent), "sid binary, n bigint, gram bigint, df int, at bigint, listed boolean, rank double")
    kept = keep(kept.distinct(), "join-rarest")
    sets = keep(named.select("sid", "n", "grams").join(kept.select("sid").distinct(), "sid", "left_semi"), "join-sets")
    comp = _links(sets, _candidate_keys(kept, percent), percent)

    names = rows.filter("n > 0").groupBy("sid").agg(F.min("key").alias("low"))
    if comp is not None:
        joined = names.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        lows = joined.join(comp.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("low").alias("least"))
        names = joined.join(lows, "comp", "left").select("sid", F.coalesce("least", "low").alias("low"))
    return rows.join(names, (rows["sid"] == names["sid"]) & (rows["n"] > 0), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("key")).alias("component")
    )


def one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each linked group: that of the smallest key, null keys last.

    Rows are told apart by key and a hash of the whole row; of rows that are equal in every
    column one stays (texts without words link to nothing and all stay).
    """
    parts = [F.col(key).isNull().alias("missing"), F.col(key).alias("id"), F.xxhash64(*df.columns).alias("row")]
    named = df.withColumn("_row", F.struct(*parts))
    groups = keep(linked(named, key="_row", text=text, words=words, percent=percent), "groups")
    gone = groups.filter(F.col("_row") != F.col("component")).select("_row").distinct()
    again = groups.filter((F.col("_row") == F.col("component")) & (F.col("n_shingles") > 0)).groupBy("_row").count().filter("count > 1").select("_row")

    single = named.join(_small(keep(gone.unionByName(again), "gone")), "_row", "left_anti")
    twice = named.join(_small(again), "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(twice).select(*df.columns)


def linked_sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """DuckDB SQL for ``linked``: every pair that shares an n-gram is counted, then links are followed."""
    grams = f"case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + {words - 1}], ' ') for i in range(1, len(w) - {words - 2})]) end"
    return f"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (select doc_id, {grams} as g, least(len(w), {words}) as kind from texts),
parts as (select doc_id, kind, len(g) as n, unnest(g) as gram from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b
  from parts a join parts b on a.gram = b.gram and a.kind = b.kind and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach as (
  select doc_id as a, doc_id as b from sets
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a)
select doc_id, len(g)::bigint as n_shingles, c.component_id
from sets join (select a, min(b) as component_id from reach group by a) c on c.a = sets.doc_id"""
