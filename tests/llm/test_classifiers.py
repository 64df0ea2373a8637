from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import quality, toxicity
from lexiloom.llm.toxicity import Landmarks, alphabet, sentence_features

WORDS = ["".join(random.Random(i).choices("aeiourstlnm", k=2 + i % 6)) for i in range(300)]


def crc(i):
    return zlib.crc32(str(i).encode())


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def corpus(n=400):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(n):
        text = " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 6)))
        bad = rng.random() < 0.3
        if bad:
            text = " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in text.split())
        rude = rng.random() < 0.3
        if rude:
            words = text.split()
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["gronkel", "brizzard", "flumpet"]))
            text = " ".join(words)
        rows.append((i, text))
        marks.append((i, int(not bad), int(rude)))
    return rows, marks


@pytest.mark.parametrize("module, column, folds, fold", [(quality, 1, 5, 0), (toxicity, 2, 4, 2)])
def test_held_out_texts_are_told_apart(docs, labels, module, column, folds, fold):
    rows, marks = corpus()
    odd = [(900, None), (901, ""), (901, ""), (None, "some words"), (902, "w" * 50000)]
    got = module.score(docs(rows + odd), labels(marks + [(1, None, None), (None, 1, 1), (5000, 1, 1)])).collect()
    assert len(got) == len(rows) + len(odd)
    wanted = {m[0]: m[column] for m in marks}
    held = [r for r in got if r.doc_id in wanted and r.held_out]
    assert all(r.held_out == (crc("" if r.doc_id is None else r.doc_id) % folds == fold) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len(held) > 40
    assert np.mean([r.predicted == wanted[r.doc_id] for r in held]) > 0.95
    by_id = [r.score for r in got if r.doc_id in (900, 901)]
    assert len(by_id) == 3 and len(set(by_id)) == 1


@pytest.mark.parametrize("module, value", [(quality, 0.5), (toxicity, 0.0)])
def test_without_labels(docs, labels, module, value):
    assert [r.score for r in module.score(docs([(1, "a b"), (2, None)]), labels([])).collect()] == [value] * 2
    assert module.score(docs([]), labels([(1, 1, 1)])).collect() == []


def test_labels_of_the_held_out_fold_are_not_learned(docs, labels):
    rows, marks = corpus(200)
    flipped = [(i, 1 - q, 1 - t) if crc(i) % 5 == 0 else (i, q, t) for i, q, t in marks]
    a, b = (sorted(map(tuple, quality.score(docs(rows), labels(m)).collect())) for m in (marks, flipped))
    assert a == b


def test_toxicity_does_not_learn_from_the_held_out_fold(docs, labels):
    rows, marks = corpus(200)
    flipped = [(i, q, 1 - t) if crc(i) % 4 == 2 else (i, q, t) for i, q, t in marks]
    assert flipped != marks
    a, b = (sorted(map(tuple, toxicity.score(docs(rows), labels(m)).collect())) for m in (marks, flipped))
    assert a == b and len({r[2] for r in a}) > 1


def test_training_sample_is_bounded(docs, labels):
    rows, marks = corpus(100)
    usable = quality.id_hash("doc_id") % 5 != 0
    got = quality.sample(docs(rows), labels(marks), "quality", usable, 30, "doc_id", "text").collect()
    assert len(got) == 30 and all(crc(r.doc_id) % 5 for r in got)


def test_sparse_rows_and_dot_products_agree():
    column = pa.array(["a b a, c!! D", "", None, "x y z 12 x y z", "one"])
    weights = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1)
    dots = quality.dot_products(column, weights)
    assert np.allclose(dots, [values @ weights[numbers] for numbers, values in quality.sparse_rows(column)])


def test_updates_follow_the_closed_form():
    z, n = np.zeros(4), np.zeros(4)
    for label in (1, 0, 1, 1):
        quality.update(z, n, np.array([0, 2]), np.array([1.0, 2.0]), label)
    assert (z[[1, 3]] == 0).all() and (n[[0, 2]] > 0).all()
    assert quality.leader(z, n)[0] > 0


def features(texts, words):
    codes = alphabet()
    edge = bytes([toxicity.EDGE])
    landmarks = Landmarks([edge + bytes(codes[np.frombuffer(w.encode(), np.uint8)]) + edge for w in words])
    rows, found = sentence_features(pa.array(texts), landmarks, codes)
    out = np.zeros((len(texts), len(words)))
    np.maximum.at(out, rows, found)
    return out


def test_inserted_letters_and_gaps_stay_close():
    out = features(["you gronkel!", "g.r.o.n.k.e.l", "g r o n k e l", "gro-nkel", "grxonkel", "stone walls"], ["gronkel"])[:, 0]
    assert out[0] > 0.99 and out[1] > 0.99 and out[2] > 0.99 and out[3] > 0.99
    assert 0.02 < out[4] < 0.99 and out[5] == 0


def test_letters_in_all_gaps_and_split_words_stay_close():
    texts = ["gxrxoxnxkxexl", "you mxorxon!", "mxoxrxoxn", "mo ron.", "a m o ro n", "mor\non", "stone mirror walls on"]
    out = features(texts, ["gronkel", "moron"])
    assert out[0, 0] > 0.75 and (out[1:4, 1] > 0.75).all() and out[4, 1] > 0.25
    assert not out[5:].any() and out[0, 1] < 0.01 and out[1:, 0].max() < 0.01


def test_share_equals_its_definition():
    word = np.array([toxicity.EDGE, 7, 18, 15, 14, toxicity.EDGE], np.uint8)
    wide = np.array([toxicity.EDGE, 7, 1, 18, 2, 15, 3, 14, toxicity.EDGE], np.uint8)

    def held(w, most):
        spans = [(i, j, k) for i in range(len(w)) for j in range(i) for k in range(j) if i - k < most]
        return {(w[k], w[j], w[i]): toxicity.DECAY ** (i - k + 1) for i, j, k in sorted(spans, key=lambda s: s[2] - s[0])}

    marks = Landmarks([word.tobytes()])
    for other in (word, wide, wide[:-2], word[2:]):
        close, there = held(word.tolist(), toxicity.CLOSE), held(other.tolist(), toxicity.SPAN)
        share = sum(w for t, w in close.items() if t in there) / sum(close.values())
        got = marks.share(other, np.array([0]), np.array([len(other)]))[0, 0]
        assert np.isclose(got, share if share >= toxicity.SHARE_FLOOR else 0)
    assert np.isclose(marks.share(wide, np.array([0]), np.array([len(wide)])), 1)


def test_held_out_insults_with_filled_gaps_are_found(docs, labels):
    rows, marks = corpus(800)
    rude = {i for i, _, toxic in marks if toxic}
    rng = random.Random(3)

    def filled(word, gaps):
        chosen = set(rng.sample(range(1, len(word)), min(gaps, len(word) - 1)))
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * (i in chosen) + c for i, c in enumerate(word))

    def disguise(text, gaps):
        return " ".join(filled(w, gaps) if w in ("gronkel", "brizzard", "flumpet") else w for w in text.split(" "))

    table = list(rows)
    for at, gaps in enumerate((1, 2, 99), 1):
        table += [(i + 10000 * at, disguise(text, gaps)) for i, text in rows if i in rude]
    got = toxicity.score(docs(table), labels(marks)).collect()
    for at in (1, 2, 3):
        found = [r.predicted for r in got if r.doc_id // 10000 == at]
        assert len(found) > 150 and np.mean(found) > 0.95
    assert np.mean([r.predicted for r in got if r.doc_id < 10000 and r.doc_id not in rude]) < 0.03


def test_kernel_equals_its_definition():
    word = np.array([toxicity.EDGE, 7, 18, 15, 14, toxicity.EDGE], np.uint8)

    def triples(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    key = (w[i], w[j], w[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = triples(word.tolist()), triples(word[1:].tolist())
    marks = Landmarks([word.tobytes(), word[1:].tobytes()])
    assert np.isclose(marks.gram[0, 1], sum(a[t] * b.get(t, 0) for t in a))
    near = marks.likeness(word, np.array([0]), np.array([len(word)]))
    assert np.allclose(near, [[1, marks.gram[0, 1] / marks.gram[1, 1]]])


def test_dropping_toxic_texts_keeps_columns(docs, labels):
    rows, marks = corpus()
    df = docs(rows + [(None, None)])
    kept = toxicity.drop_toxic(df, labels(marks))
    assert kept.columns == df.columns
    scored = {r.doc_id: r.predicted for r in toxicity.score(df, labels(marks)).collect()}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(i if i is not None else -1 for i, p in scored.items() if not p)


def test_sparse_cells_add_what_whole_rows_add():
    """Likeness and shares add only the landmarks that a triple belongs to; sums are the same to the last bit."""
    from lexiloom.llm.toxicity import Cells

    rng = np.random.default_rng(3)
    dense = rng.random((40, 7)) * (rng.random((40, 7)) < 0.2)
    owner, rows = rng.integers(0, 9, 500), rng.integers(0, 40, 500)
    got, whole = np.zeros((9, 7)), np.zeros((9, 7))
    Cells(dense).add(got, owner, rows, 0.3)
    np.add.at(whole, owner, 0.3 * dense[rows])
    assert (got == whole).all()
    Cells(dense).add(got, owner[:0], rows[:0])
    Cells(np.zeros((5, 7))).add(got, np.array([0, 1]), np.array([4, 0]))
    assert (got == whole).all()
