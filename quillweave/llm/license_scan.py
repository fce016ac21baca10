"""License scans: every text block that contains enough of a license template.

A block is a window of consecutive words, a quarter longer than the template; it matches
when it holds at least ``CONTAINMENT`` of the template's distinct words.  The search is an
exact set-similarity join of templates and windows:

* **order**: template words by the number of documents that hold them, counted over all
  documents, rarest first (ties by the word);
* **prefix filter**: with ``need`` common words, a matching window holds one of the
  template's ``size - need + 1`` rarest words, so only windows around those are looked at;
* **length filter**: a text with fewer than ``need`` words has no such window;
* **positional filter**: around the rare words, the template's words within reach must
  still be ``need`` distinct ones; then a linear slide verifies each window.

Base phrases (places where words stand consecutively) are found beside it and keep their labels.

Licenses that differ in a word (CC BY, BY-NC, BY-SA, BY-ND, ...) are told apart by that word: from
a word that begins the template to where its window has enough words, itself no distinguishing one,
no such word of the family may stand but the template's own, and each of those must.  Templates are the paragraphs of a
license, so a text that holds only a later one, such as the warranty, is found too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillweave.llm.common import ship, text_rows, whole_text

CONTAINMENT = 0.9
SLACK = 1.25
#: phrase -> label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label -> templates, a paragraph of the license or a usual notice each (fixed values)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nc-nd": ("licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "cc-by-nc-sa": ("licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
#: words that tell licenses of a family apart -> what they say (fixed values); a label is of the family that it begins with
MARKS: dict[str, dict[str, str]] = {
    "cc-": {"nc": "noncommercial", "noncommercial": "noncommercial", "nd": "noderivatives", "noderivs": "noderivatives", "noderivatives": "noderivatives", "sa": "sharealike", "sharealike": "sharealike"},
}

#: capitals to small letters, everything that is no word character to space; bytes beyond ASCII are word characters
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Template:
    def __init__(self, label: str, text: str, containment: float, seen: Mapping[bytes, int]):
        words = words_of(text)
        self.label = label
        self.words = frozenset(words)
        self.need = math.ceil(containment * len(self.words) - 1e-9)
        self.window = math.ceil(SLACK * len(words))
        family = next((m for f, m in MARKS.items() if label.startswith(f)), {})
        self.marks = {w.encode(): what for w, what in family.items()}
        self.own = frozenset(self.marks[w] for w in self.words if w in self.marks)
        # as many words as may be missing can't all be the first that is there
        self.first = frozenset(list(dict.fromkeys(words))[: len(self.words) - self.need + 1]) - self.marks.keys() if self.marks else self.words
        order = sorted(self.words, key=lambda w: (seen.get(w, 0), w))
        self.rare = tuple(order[: len(order) - self.need + 1])

    def _marked(self, words: list[bytes], hits: list[tuple[int, bytes]]) -> bool:
        """Whether the words up to the ``need``-th distinct template word hold the template's marks and no others."""
        if not self.marks:
            return True
        seen: set[bytes] = set()
        for end, word in hits:
            seen.add(word)
            if len(seen) == self.need:
                break
        if hits[0][1] not in self.first or word in self.marks:
            return False
        return {self.marks[w] for w in words[hits[0][0] : end + 1] if w in self.marks} == self.own

    def blocks(self, folded: bytes, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(start, end, containment) of the unions of overlapping windows that match."""
        if len(words) < self.need or not any(w in folded for w in self.rare):
            return
        rare = [i for i, w in enumerate(words) if w in self.rare]
        reach = self.window - 1
        spans: list[list[int]] = []
        for i in rare:
            if spans and i - reach <= spans[-1][1]:
                spans[-1][1] = i + reach
            else:
                spans.append([i - reach, i + reach])
        for low, high in spans:
            hits = [(i, words[i]) for i in range(max(low, 0), min(high, len(words) - 1) + 1) if words[i] in self.words]
            if len({w for _, w in hits}) < self.need:
                continue
            held: Counter[bytes] = Counter()
            last, found = 0, None
            for first, (start, word) in enumerate(hits):
                while last < len(hits) and hits[last][0] < start + self.window:
                    held[hits[last][1]] += 1
                    last += 1
                share = len(held) / len(self.words)
                if len(held) >= self.need and self._marked(words, hits[first:last]):
                    end = hits[last - 1][0] + 1
                    if found and start < found[1]:
                        found = (found[0], max(found[1], end), max(found[2], share))
                    else:
                        if found:
                            yield found
                        found = (start, end, share)
                held[word] -= 1
                if not held[word]:
                    del held[word]
            if found:
                yield found


def _places(phrase: Sequence[bytes], folded: bytes, words: list[bytes]) -> list[int]:
    if not all(w in folded for w in phrase):
        return []
    out, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == list(phrase):
                out.append(at)
    except ValueError:
        return out


def word_frequencies(df: DataFrame, vocabulary: frozenset[bytes], *, text: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of a (small) vocabulary, counted over all documents."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(vocabulary.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = df.select(whole_text(text).alias("_text")).mapInArrow(count, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(
    df: DataFrame,
    *,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    base: Mapping[str, str] = BASE,
    containment: float = CONTAINMENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """key, n_words, places (phrase label, start word) and blocks (label, start, end, containment) of every whole text.

    Null texts count as empty; null keys and repeated rows are scanned like any other; equal
    frequencies are ordered by the word; an empty table gives no rows.  Two passes over the
    texts: frequencies, then the scan, both map-side.
    """
    vocabulary = frozenset(w for ts in templates.values() for t in ts for w in words_of(t))
    seen = word_frequencies(df, vocabulary, text=text)
    made = [Template(label, t, containment, seen) for label, ts in sorted(templates.items()) for t in ts]
    phrases = [(words_of(p), label) for p, label in base.items()]
    place, block = "struct<label: string, start: bigint>", "struct<label: string, start: bigint, end: bigint, containment: double>"
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_words bigint, places array<{place}>, blocks array<{block}>"
    key_type = to_arrow_type(kind)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    block_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            counts, places, blocks = [], [], []
            for t in texts:
                folded = t.encode().translate(_FOLD)
                words = folded.split()
                counts.append(len(words))
                places.append([{"label": label, "start": i} for p, label in phrases for i in _places(p, folded, words)])
                blocks.append([{"label": m.label, "start": a, "end": b, "containment": c} for m in made for a, b, c in m.blocks(folded, words)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(blocks, block_type)],
                names=[key, "n_words", "places", "blocks"],
            )

    return df.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(run, schema)


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and score of each scanned text; a base phrase scores 1."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    labels = F.concat(base, F.transform("blocks", lambda b: b["label"]))

    def joined(names):
        return F.concat_ws(",", F.array_sort(F.array_distinct(names)))

    contained = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return scanned.select(
        key,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(labels).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(contained).alias("score"),
    )


def scan_sql(templates: Mapping[str, Sequence[str]] = TEMPLATES, base: Mapping[str, str] = BASE, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for ``summary``: every window that starts with a template word is counted."""
    rows = []
    for n, (label, text) in enumerate((label, t) for label, ts in sorted(templates.items()) for t in ts):
        made = Template(label, text, containment, {})
        rows += [f"({n}, '{label}', {made.window}, {made.need}, {len(made.words)}, '{w.decode()}', {w in made.first})" for w in sorted(made.words)]
    own, marks = [], []
    for n, (label, text) in enumerate((label, t) for label, ts in sorted(templates.items()) for t in ts):
        made = Template(label, text, containment, {})
        own += [f"({n}, '{what}')" for what in sorted(made.own)]
        marks += [f"({n}, '{w.decode()}', '{what}')" for w, what in sorted(made.marks.items())]
    phrases = []
    for phrase, label in base.items():
        parts = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        phrases.append(f"select doc_id, row_no, '{label}' as label, i - 1 as start from (select doc_id, row_no, w, unnest(range(1, len(w) + 1)) as i from split_words) where {test}")
    return f"""
with split_words as (
  select doc_id, row_number() over () as row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
template (t, label, reach, need, size, word, begins) as (values {", ".join(rows)}),
spots as (select row_no, unnest(w) as word, unnest(range(0, len(w))) as pos from split_words),
hits as (select row_no, t, label, reach, need, size, pos, spots.word, begins from spots join template using (word)),
mark (t, word, what) as (values {", ".join(marks or ["(-1, '', '')"])}),
own (t, what) as (values {", ".join(own or ["(-1, '')"])}),
firsts as (
  select a.row_no, a.t, a.label, a.need, a.size, a.pos, b.word, min(b.pos) as spot
  from hits a join hits b on a.row_no = b.row_no and a.t = b.t and b.pos >= a.pos and b.pos < a.pos + a.reach
  where a.begins group by a.row_no, a.t, a.label, a.need, a.size, a.pos, b.word),
enough as (
  select row_no, t, label, need, size, pos, count(*) as held, list_sort(list(spot))[need] as until
  from firsts group by row_no, t, label, need, size, pos having count(*) >= need),
said as (
  select e.row_no, e.t, e.pos, list_sort(list(distinct m.what)) as whats
  from enough e join mark m on m.t = e.t join spots s on s.row_no = e.row_no and s.word = m.word and s.pos between e.pos and e.until
  group by e.row_no, e.t, e.pos),
meant as (select t, list_sort(list(what)) as whats from own group by t),
windows as (
  select e.* from enough e left join said d on d.row_no = e.row_no and d.t = e.t and d.pos = e.pos left join meant o on o.t = e.t
  where coalesce(d.whats, []) = coalesce(o.whats, []) and not exists (
    select 1 from mark m join spots s on s.word = m.word where m.t = e.t and s.row_no = e.row_no and s.pos = e.until)),
contained as (select row_no, list(distinct label) as labels, max(held::double / size) as score from windows group by row_no),
places as ({" union all ".join(phrases)}),
based as (
  select row_no, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as labels
  from places group by row_no)
select s.doc_id, len(s.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base,
       b.first_word::bigint as first_word, b.last_word::bigint as last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(c.labels, [])))), ','), '') as labels,
       case when b.n_base > 0 then 1.0 else coalesce(c.score, 0.0) end::double as score
from split_words s left join based b using (row_no) left join contained c using (row_no)"""
