"""Quality, licenses and pages."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.llm import fm_quality, html_extract, license_scan
from tests.llm.conftest import TEXTS


def prose(r, n=80):
    return " ".join(r.choice(["the", "river", "stone", "walks", "and", "quiet", "harbour", "light", "of", "seven"]) + r.choice(["", "s", "ed"]) for _ in range(n)) + "."


def junk(r, n=80):
    return r.choice([lambda: "BUY NOW!! " * n, lambda: " ".join(r.choice("abcdef") + "$$$ %%%" for _ in range(n)), lambda: "same " * n])()


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows = [(i, prose(r) if i % 3 else junk(r)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_pairs_in_linear_time():
    m = fm_quality.FactorisationMachine(50, 4)
    r = np.random.default_rng(1)
    m.weight[:] = r.normal(size=50)
    m.factor[:] = r.normal(size=(50, 4))
    rows = [(r.integers(50, size=n), r.normal(size=n).astype(np.float32)) for n in (1, 5, 9)]
    for (slots, values), got in zip(rows, m.margins(rows)):
        want = m.bias + sum(m.weight[s] * v for s, v in zip(slots, values))
        want += sum(m.factor[slots[i]] @ m.factor[slots[j]] * values[i] * values[j] for i in range(len(slots)) for j in range(i))
        assert got == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    machine = fm_quality.fit(docs, labels)
    out = fm_quality.score(docs, machine).withColumn("held", fm_quality.held_out(F.col("doc_id"))).collect()
    for r in out:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held"]]
    assert len(held) > 150 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_read(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(fm_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fm_quality.fit(docs, labels), fm_quality.fit(docs.repartition(5), turned)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.factor, b.factor)


def test_fit_moves_no_texts(labelled, plan_of, monkeypatch):
    """Texts become features where they are read; only rows of features are ordered and cut."""
    docs, labels = labelled
    plans, of = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: plans.append(plan_of(df)) or of(df))
    fm_quality.fit(docs, labels, rows=100)
    (plan,) = plans
    assert "MapInArrow" in plan
    assert not [line for line in plan.splitlines() if "_text#" in line and ("TakeOrdered" in line or "Sort" in line or "Exchange" in line)]


def test_quality_of_odd_rows(odd_documents, no_documents, labelled):
    machine = fm_quality.fit(*labelled)
    rows = fm_quality.score(odd_documents, machine).collect()
    good = fm_quality.good(odd_documents, machine)
    assert good.columns == odd_documents.columns and good.count() == sum(r["predicted"] for r in rows)
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert fm_quality.score(no_documents, machine).collect() == []
    unlabelled = fm_quality.fit(odd_documents, labelled[1].filter("false"))
    assert {r["predicted"] for r in fm_quality.score(odd_documents, unlabelled).collect()} == {1}


def test_slots_of_a_row_are_distinct(monkeypatch):
    """Words that share a slot are summed, so the pair sum holds no pair of a slot with itself."""
    monkeypatch.setattr(fm_quality, "WORD_SLOTS", 7)
    slots, values = fm_quality.features(" ".join(f"w{i}" for i in range(100)), 5)
    assert len(set(slots.tolist())) == len(slots) == len(values)
    words = values[slots < 7]
    assert len(words) <= 7 and float((words**2).sum()) == pytest.approx(fm_quality.WORD_SCALE**2, rel=1e-3)


def windows(text, label_of):
    """Every window counted, the plain way."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, top = set(), 0.0
    for label, ts in license_scan.TEMPLATES.items():
        for t in ts:
            parts = t.split()
            size, width = len(set(parts)), -(-len(parts) * 5 // 4)
            need = next(n for n in range(size + 1) if n / size >= license_scan.CONTAINMENT - 1e-12)
            marks = license_scan.MARKS["cc-"] if label.startswith("cc-") else {}
            for i in range(len(words)):
                share = len(set(words[i : i + width]) & set(parts)) / size
                if share >= license_scan.CONTAINMENT - 1e-12 and words[i] in parts:
                    end = next(e for e in range(i, i + width) if len(set(words[i : e + 1]) & set(parts)) == need)
                    begin = list(dict.fromkeys(parts))[: size - need + 1] if marks else parts
                    if words[i] in marks or words[i] not in begin or words[end] in marks or {marks[w] for w in words[i : end + 1] if w in marks} != {marks[w] for w in parts if w in marks}:
                        continue
                    labels.add(label)
                    top = max(top, share)
    places = [(i, lab) for i in range(len(words) - 1) for p, lab in license_scan.BASE.items() if words[i : i + len(p.split())] == p.split()]
    base = sorted({lab for _, lab in places})
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
        ",".join(sorted(labels | set(base))), 1.0 if places else top,
    )


def test_licenses_by_brute_force(spark):
    r = random.Random(2)
    vocabulary = [w for ts in license_scan.TEMPLATES.values() for t in ts for w in t.split()] + ["MIT License", "apache-license", "été", "GNU GENERAL Public license"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(60)]
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            words = t.split()
            for drop in (0, 1, 2, 4):
                kept = [w for i, w in enumerate(words) if i >= drop]
                r.shuffle(kept) if drop == 1 else None
                texts.append("before it. " + ", ".join(kept) + " after it")
    rows = list(enumerate(texts)) + [(None, "MIT License mit license"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = license_scan.summary(license_scan.scan(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, *windows(t or "", None))) for k, t in rows)


@pytest.mark.parametrize("kind, long", [("", ""), ("-nc", "-NonCommercial"), ("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivs")])
def test_close_licenses_have_one_label(spark, kind, long):
    """Short and long notices, with words that could be marks of another license next to them."""
    short = f"Licensed under CC BY{kind.upper()} 4.0."
    full = f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License."
    texts = [short, full, f"nd sa {short} Nd nc sa the and", f"sa nd nc {full} ND, SA and more", short * 2 + " words between, a few of them, so that they stand apart " + full]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.summary(license_scan.scan(df)).collect()}
    assert set(got.values()) == {f"cc-by{kind}"}


def test_later_paragraphs(spark):
    """A license's warranty alone, with a word changed and some missing."""
    texts = {
        "mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE",
        "gpl": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU license for more details.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.summary(license_scan.scan(df)).collect()}
    assert got == dict(enumerate(texts))


def test_blocks_and_places(spark):
    df = spark.createDataFrame([(1, "x y\nReleased under the MIT License.\n" * 2)], "doc_id bigint, text string")
    (row,) = license_scan.scan(df).collect()
    assert [p["start"] for p in row["places"]] == [5, 12]
    assert {(b["label"], b["containment"]) for b in row["blocks"]} == {("mit", 1.0)}
    assert min(b["start"] for b in row["blocks"]) <= 5 and max(b["end"] for b in row["blocks"]) == 14


def test_licenses_of_odd_rows(odd_documents, no_documents):
    rows = license_scan.summary(license_scan.scan(odd_documents)).collect()
    assert len(rows) == len(TEXTS)
    assert {r["doc_id"]: r["labels"] for r in rows if r["labels"]} == {6: "mit"}
    assert license_scan.scan(no_documents).collect() == []


def page(body, wrap="article"):
    return (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><!-- <p>no</p> -->'
        f'<div class="ad">buy this now</div><{wrap}>{body}</{wrap}><footer>&copy; host, all rights and more words here</footer></body></html>'
    )


def test_main_text(spark):
    r = random.Random(3)
    rows = [(i, f"u{i}", page(f"<h1>Title {i} &amp; more</h1>" + "".join(f"<p>{prose(r, 20)}\n  <b>bold</b> end</p>" for _ in range(4)))) for i in range(40)]
    odd = page('<header><h1>Big news</h1></header><p>One&nbsp;two <i>th</i>ree<br>four<p>Five<div class="comments"><p>I agree with this</p></div><form>Sign up</form><p>Six seven eight</p><aside>side</aside>')
    rows += [(100, "odd", odd), (101, None, None), (101, None, None), (102, "e", ""), (103, "t", "plain words only"), (None, "s", "<script>no</script>"), (104, "w", page("<h1>Head here</h1><p>some words follow in it</p>", "div"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = {}
    for row in html_extract.extract(df).collect():
        got.setdefault(row["page_id"], []).append(row["text"])
    for i in range(40):
        (text,) = got[i]
        want = html_extract.html.unescape("\n".join(" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", rows[i][2].split("<article>")[1], re.S)))
        assert text == want
    assert got[100] == ["Big news\nOne two three four\nFive\nSix seven eight"]
    assert got[101] == ["", ""] and got[102] == [""] and got[103] == ["plain words only"] and got[None] == [""]
    assert got[104] == ["Head here\nsome words follow in it"]
    assert html_extract.extract(df.filter("false")).collect() == []


def test_pages_without_article():
    """Unknown names are neutral, an advert in the middle ends nothing, and a layout's name is no sidebar."""
    r = random.Random(5)
    table = np.zeros((3, 2, html_extract.SLOTS), np.int64)
    for _ in range(20):
        html_extract.count_cues(page("<h1>Some title</h1>" + "".join(f"<p>{prose(r, 20)}</p>" for _ in range(4))), table)
    weights = html_extract.Weights(table)
    assert (weights.cue[table[0].sum(axis=0) == 0] == 0).all()
    halves = [[prose(r, 30) for _ in range(2)] for _ in range(2)]
    first, second = ("".join(f"<p>{t}</p>" for t in half) for half in halves)
    want = "\n".join(halves[0] + halves[1])
    advert = f'<div class="ad-slot">{prose(r, 60)}</div>'
    for wrapper in ('class="qqwrap"', 'class="no-sidebar"', 'id="content-sidebar-wrap"'):
        body = f'<div {wrapper}><div class="zzinner">{first}{advert}{second}</div></div>'
        assert html_extract.main_text(page(body, "section"), weights) == want
    # a page with an article still ends where it ends
    body = f"<p>{halves[0][0]}</p>{advert}<p>{halves[1][0]}</p>"
    assert html_extract.main_text(page(body), weights) == f"{halves[0][0]}\n{halves[1][0]}"


@pytest.mark.parametrize("text", ["<div>" * 30_000, "<p>a<b" * 20_000, "<script>" * 20_000, "<" * 50_000, "</p>" * 30_000, "<li>x" * 20_000, '<a "' * 5_000])
def test_hostile_pages_take_no_long(text):
    html_extract.main_text(text, html_extract.Weights(np.zeros((3, 2, html_extract.SLOTS), np.int64)))


def test_best_region():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *sums])


# ---- whole articles, whatever their names ----------------------------------------------------
def learned(seed=11, pages=30):
    """Weights from plain labelled pages."""
    r = random.Random(seed)
    table = np.zeros((3, 2, html_extract.SLOTS), np.int64)
    for _ in range(pages):
        body = "".join(f"<p>{prose(r, r.randint(5, 60))}</p>" for _ in range(6))
        html_extract.count_cues(page(f"<h1>{prose(r, 4)}</h1>{body}", "article"), table)
    return html_extract.Weights(table)


@pytest.mark.parametrize(
    "opening, closing",
    [
        ('<article class="post category-social tag-search">', "</article>"), ('<article id="how-to-share-menus">', "</article>"),
        ('<article class="comments">', "</article>"), ('<main class="search login">', "</main>"),
        ('<div class="comments-open"><article>', "</article></div>"), ('<div class="related"><main>', "</main></div>"),
        ('<form><article>', "</article></form>"), ('<section class="related-work">', "</section>"), ('<div class="x17 notices">', "</div>"),
        ('<div class="zebra"><div class="quux">', "</div></div>"), ("", ""),
    ],
)
def test_names_take_no_article_away(opening, closing):
    r = random.Random(opening)
    blocks = [prose(r, 30) for _ in range(8)]
    inner = "".join(f"<p>{b}</p>" for b in blocks)
    text = f'<html><body><nav><a href="/">{prose(r, 3)}</a></nav>{opening}{inner}{closing}<div class="site-footer">{prose(r, 4)}</div><footer>{prose(r, 5)}</footer></body></html>'
    assert html_extract.main_text(text, learned()) == "\n".join(blocks)


def test_formulas_and_fallbacks_are_text():
    text = "<article><p>We see <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p><noscript><p>No script, <b>still</b> text.</p></noscript><object><p>In place of it.</p></object><p>End.</p></article>"
    assert html_extract.main_text(text, learned()) == "We see x=2 here.\nNo script, still text.\nIn place of it.\nEnd."


def made_page(r):
    """A page of nested boxes with names never seen, noise beside and inside, and its text."""
    def name():
        return "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(3))

    def noise():
        words = prose(r, r.randint(1, 12))
        return r.choice([
            f'<div class="ad">{words}</div>', f'<aside class="{name()}"><p>{words}</p></aside>', f'<div class="{name()} comment-list"><p>{words}</p></div>',
            f"<nav><ul><li>{words}</li></ul></nav>", f'<form><input name="q">{words}<button>{words}</button></form>', f'<div id="cookie-banner">{words}</div>',
            f"<script>var a = '<p>{words}</p>';</script>", f"<!-- {words} -->", f'<div class="newsletter signup"><b>{words}</b></div>', f"<select><option>{words}</select>",
        ])

    blocks, inner = [], ""
    for _ in range(r.randint(4, 12)):
        words = prose(r, r.randint(8, 50)).split(" ")
        at = r.randrange(len(words))
        blocks.append(" ".join(words))
        said = " ".join([*words[:at], f"<em>{words[at]}</em>", *words[at + 1 :]])
        inner += r.choice([f"<p>{said}</p>", f'<div class="{name()}"><p>{said}</div>', f"<ul><li>{said}</ul>", f"<blockquote>{said}</blockquote>"])
        if r.random() < 0.3:
            inner += noise()
    box = r.choice(["article", "main"])
    inner = f'<{box} class="{name()} {r.choice(["post", "tag-share", "category-menu", name()])}">{inner}</{box}>'
    for _ in range(r.randint(0, 3)):
        inner = f'<div class="{name()}" id="{name()}">{inner}</div>'
    before, after = ("".join(noise() for _ in range(r.randint(0, 3))) for _ in range(2))
    return f"<!DOCTYPE html><html><head><title>{name()}</title></head><body>{before}{inner}{after}<footer>{name()}</footer></body></html>", "\n".join(blocks)


def test_made_pages():
    """Pages whose text is known by construction, their names unseen."""
    weights, r = learned(), random.Random(8)
    for _ in range(300):
        text, want = made_page(r)
        assert html_extract.main_text(text, weights) == want, text


def test_unmarked_pages_by_learned_weights():
    """Weights of pages of the same kind that mark their article: without the mark nearly all of its blocks are found."""
    r = random.Random(9)
    table = np.zeros((3, 2, html_extract.SLOTS), np.int64)
    for _ in range(200):
        html_extract.count_cues(made_page(r)[0], table)
    weights = html_extract.Weights(table)
    found = blocks = 0
    for _ in range(200):
        text, want = made_page(r)
        got = set(html_extract.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1section", text), weights).split("\n"))
        found, blocks = found + sum(b in got for b in want.split("\n")), blocks + want.count("\n") + 1
    assert found >= 0.9 * blocks
