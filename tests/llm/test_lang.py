"""The byte network: gradients by differences, labels by a plain loop, held-out accuracy."""

import numpy as np
import pytest

from quillweave.llm import lang_gru
from quillweave.llm.queries import op13_lang_gru
from tests.llm.conftest import TEXTS

FOLDER = "/root/testdata/sf0.01"


def small(hidden=5, seed=3):
    net = lang_gru.ByteTagger(["a", "b", "c"], hidden=hidden, seed=seed)
    for unit in net.units:
        unit.of_byte, unit.of_state = unit.of_byte.astype(np.float64), unit.of_state.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    return net


def loss(net, x, label):
    steps = [[s[0] for s in net._run(net.units[0], x)], [s[0] for s in net._run(net.units[1], x[::-1])][::-1]]
    scores = np.stack(steps[0]) @ net.out[0] + np.stack(steps[1]) @ net.out[1] + net.bias
    scores -= np.log(np.exp(scores).sum(axis=2, keepdims=True))
    letters = lang_gru._LETTER[x]
    return -(scores[:, np.arange(x.shape[1]), label] * letters).sum() / letters.sum()


def test_gradients_by_differences():
    net = small()
    x = lang_gru.as_windows(["some text", "é 12", "zz"])[:, :9].T.copy()
    label = np.array([0, 2, 1])
    grads = net.gradients(x, label)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parameters, grads):
        flat, got = p.reshape(-1), g.reshape(-1)
        for i in {int(np.abs(got).argmax()), *rng.integers(0, len(flat), 4).tolist()}:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss(net, x, label)
            flat[i] = old - step
            down = loss(net, x, label)
            flat[i] = old
            assert got[i] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=2e-2)


def by_loop(net, text):
    """Mean probabilities over letters, position by position."""
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    def read(unit, data):
        h, k, out = np.zeros(unit.hidden), unit.hidden, []
        for byte in data:
            given, felt = unit.of_byte[byte].astype(float), h @ unit.of_state.astype(float)
            update, reset = sigmoid(given[:k] + felt[:k]), sigmoid(given[k : 2 * k] + felt[k : 2 * k])
            h = update * h + (1 - update) * np.tanh(given[2 * k :] + reset * felt[2 * k :])
            out.append(h)
        return out

    data, total, n = text.encode(), 0, 0
    for start in range(0, len(data), lang_gru.WINDOW):
        window = [*data[start : start + lang_gru.WINDOW]]
        window += [lang_gru.PAD] * (lang_gru.WINDOW - len(window))
        for byte, ahead, behind in zip(window, read(net.units[0], window), read(net.units[1], window[::-1])[::-1]):
            if lang_gru._LETTER[byte]:
                score = np.exp(ahead @ net.out[0] + behind @ net.out[1] + net.bias)
                total, n = total + score / score.sum(), n + 1
    return total / n if n else np.zeros(len(net.languages))


def test_pooled_by_a_plain_loop(monkeypatch):
    monkeypatch.setattr(lang_gru, "ROWS", 3)  # texts longer than a block of windows
    net = lang_gru.ByteTagger(["a", "b", "c"], seed=5)
    texts = ["One text.", "", "123", "é" * 200 + " and so on " * 30, "x", "\x00 nul"]
    want = np.stack([by_loop(net, t) for t in texts])
    assert np.allclose(net.pooled(texts), want, atol=1e-4)
    assert len(lang_gru.position_labels(net, texts[3])) == len(texts[3].encode())


@pytest.fixture(scope="module")
def said(spark):
    return op13_lang_gru(spark, FOLDER).collect()


def test_held_out_accuracy(spark, said):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(said) == len(docs)
    held = [r for r in said if r.held_out and docs[r.doc_id].text and r.lang_pred != "und"]
    assert sum(r.held_out for r in said) > 100
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in said)


def test_reruns_agree(spark, said):
    assert sorted(map(tuple, op13_lang_gru(spark, FOLDER).collect())) == sorted(map(tuple, said))


def test_odd_documents(odd_documents, no_documents):
    net = lang_gru.fit(odd_documents, windows=5)
    assert net.languages == ["en"]
    rows = lang_gru.predict(odd_documents, net)
    assert rows.columns == ["doc_id", "lang_pred", "score"]
    rows = rows.collect()
    assert len(rows) == len(TEXTS)
    assert sum(r.lang_pred == "und" for r in rows) == sum(not any(map(str.isalpha, t or "")) for _, t in TEXTS)
    nothing = lang_gru.fit(no_documents)
    assert nothing.languages == []
    assert {r.lang_pred for r in lang_gru.predict(odd_documents, nothing).collect()} == {"und"}
    assert lang_gru.predict(no_documents, net).count() == 0
