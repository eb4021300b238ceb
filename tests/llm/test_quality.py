import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_odd import ODD, rows_of

from argentum.llm import quality_crf as crf
from argentum.llm import quality_rules as rules


def measured_slowly(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def cover(k, first_too):
        seen, windows = set(), Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        out = set()
        for i in range(n - k + 1):
            w = tuple(words[i : i + k])
            if w in seen or first_too and windows[w] > 1:
                out.update(range(i, i + k))
            seen.add(w)
        return out

    lines, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in lines:
                dup_lines += 1
                dup_chars += len(re.sub(r"[\x20\x09-\x0D]", "", line))
            lines.add(line)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup_lines, "dup_line_chars": dup_chars,
        "n_repeat_words": len(cover(8, True)), "coverage": {k: sum(len(words[i]) for i in cover(k, False)) for k in rules.COVERAGE},
    }


def texts():
    rng = random.Random(9)
    for _ in range(150):
        yield "".join(rng.choice(["a", "bé", "c|", "dd", "e"]) + rng.choice([" ", " ", "\n", "  ", "\t", "\x85"]) for _ in range(rng.randrange(120)))
    yield "x y z w v u t s r " * 40


@pytest.mark.parametrize("text", [t or "" for _, t in ODD] + list(texts()))
def test_measures_equal_brute_force(text):
    assert rules.measure(text) == measured_slowly(text)


def test_rules_over_rows(odd):
    got = rows_of(rules.quality_rules(odd), "doc_id", "n_words", "n_repeat_words", "base_failed", "kept")
    want = []
    for i, t in ODD:
        m = measured_slowly(t or "")
        failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        want.append((i, m["n_words"], m["n_repeat_words"], failed, rules.verdict(m)[1]))
        assert not (failed and want[-1][-1])
    assert got == sorted(want, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert rules.quality_rules(odd.limit(0)).collect() == []


def test_rules_as_a_filter_keep_all_columns(make):
    good = " ".join(f"word{i}" for i in range(60))
    docs = make([(1, good), (2, None), (3, "a b c"), (4, "same line here today\n" * 30), (None, good + " x"), (5, good), (5, good)])
    kept = rules.keep_by_rules(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert rows_of(kept, "doc_id", "class_id") == [(1, None), (5, None), (5, None), (None, None)]
    assert rules.keep_by_rules(docs.limit(0)).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        u, t = rng.normal(size=n) * 2, rng.normal(size=(2, 2)) * 2
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]
        got = 1 / (1 + np.exp(-np.array(crf.marginals(u.tolist(), t.tolist()))))
        assert np.allclose(got, want)
        p, moves = crf.Chains([n]).expectations(u, t)
        assert np.allclose(p, want)
        for a, b in itertools.product((0, 1), repeat=2):
            assert np.isclose(moves[a, b], sum(w * sum(y[i] == a and y[i + 1] == b for i in range(n - 1)) for y, w in weight.items()) / z)


def corpus(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "re"]) for _ in range(rng.randrange(1, 4)))
    out, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        lines = []
        for _ in range(rng.randrange(1, 12)):
            ws = [word() for _ in range(rng.randrange(4, 15))]
            lines.append(" ".join(ws).capitalize() + "." if good else [" | ".join(ws), " ".join(w + "###" for w in ws), " ".join(w.upper() + "!!" for w in ws)][i // 4 % 3])
        out.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return out, labels


def test_held_out_accuracy_and_edges(spark, make):
    rows, marks = corpus()
    docs = make(rows + [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, q, None) for i, q in marks] + [(7, None, 1), (None, 1, 1), (9, 0, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = crf.train(docs, labels)
    got = crf.quality_scores(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {model["prior"]}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    again = crf.train(docs.repartition(5), labels.repartition(4))
    assert np.allclose(again["w"], model["w"])
    kept = crf.keep_by_quality(docs, model)
    assert kept.schema == docs.schema
    assert rows_of(kept, "doc_id") == rows_of(crf.quality_scores(docs, model).where("predicted = 1"), "doc_id")
    assert crf.quality_scores(docs.limit(0), model).collect() == []


def enumerated(own, w, t):
    """(marginals of good, expected transitions, log of the total weight) over all labellings of one chain."""
    u, n = crf.with_neighbours(own) @ w, len(own)
    weights = {y: np.exp(sum(u[i] for i in range(n) if y[i]) + sum(t[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
    z = sum(weights.values())
    moves = np.zeros((2, 2))
    for y, x in weights.items():
        for a, b in zip(y, y[1:]):
            moves[a, b] += x / z
    return np.array([sum(x for y, x in weights.items() if y[i]) / z for i in range(n)]), moves, np.log(z)


def short_documents():
    rng = np.random.default_rng(5)
    return [(rng.random((n, len(crf.OWN))) + 0.3 * y, rng.integers(1, 50, n).astype(float), y) for n in (1, 4, 2, 6, 3, 1, 5) for y in (0, 1)]


def test_fit_equals_a_plain_second_version():
    docs = short_documents()
    lines, k = sum(len(own) for own, *_ in docs), crf.N_FEATURES

    def objective(theta):
        w, t = theta[:k], theta[k:].reshape(2, 2)
        ends = [(crf.with_neighbours(own) @ w).sum() * y + (len(own) - 1) * t[y, y] - enumerated(own, w, t)[2] for own, _, y in docs]
        return sum(ends) / lines - crf.RIDGE * (theta**2).sum() / 2

    theta, m, v = (np.zeros(k + 4) for _ in range(3))
    for r in range(1, crf.ROUNDS + 1):
        w, t = theta[:k], theta[k:].reshape(2, 2)
        slope = np.zeros(k + 4)
        for own, _, y in docs:
            p, moves, _ = enumerated(own, w, t)
            slope[:k] += crf.with_neighbours(own).T @ (y - p)
            moves[y, y] -= len(own) - 1
            slope[k:] -= moves.ravel()
        slope = slope / lines - crf.RIDGE * theta
        if r == 3:  # the slope is that of the likelihood
            step = 1e-5 * np.eye(k + 4)
            assert np.allclose(slope, [(objective(theta + e) - objective(theta - e)) / 2e-5 for e in step], atol=1e-7)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + crf.RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model = crf.fit(docs)
    assert np.allclose(model["w"], theta[:k], atol=1e-6) and np.allclose(np.array(model["t"]).ravel(), theta[k:], atol=1e-6)


def test_document_scores_equal_enumeration():
    model = crf.fit(short_documents())
    a, b = model["map"]
    for text in ["One line only.", "a b c\nA B!! C\n\n x | y | z \nthe end of it.", "same\nsame\nsame\nother words here"]:
        own, sizes = crf.line_features(text)
        good = enumerated(own, np.array(model["w"]), np.array(model["t"]))[0]
        p = (good * sizes).sum() / sizes.sum()
        assert np.isclose(crf.score(text, model), 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b))))


def test_training_is_bounded_by_lines(spark, make, monkeypatch):
    line = "Good words stand in this line."
    rows = [(i, "\n".join([line if i % 2 else "x | y"] * 40)) for i in range(1, 60)] + [(100, "\n".join([line] * 30_000)), (101, "\n".join([line] * 1200)), (102, None)]
    rows += [(3, rows[2][1])] * 200  # one id with many rows
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 60), 100, 101, 102]], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(crf, "fit", lambda docs: seen.append([len(own) for own, *_ in docs]))
    crf.train(make(rows), labels, lines=400)
    assert sum(seen[0]) <= 400 and set(seen[0]) <= {0, 40} and seen[0].count(40) == 10
    crf.train(make(rows), labels)
    assert max(seen[1]) == 40


def test_without_labels_every_score_is_a_half(spark, odd):
    model = crf.train(odd, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in crf.quality_scores(odd, model).collect()} == {0.5}


def test_scores_use_text_alone(spark, make):
    rows, marks = corpus(120)
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id bigint, quality int, toxic int")
    model = crf.train(make(rows), labels)
    moved = make([(i + 10_000, t) for i, t in rows])
    a = {r.doc_id: r.score for r in crf.quality_scores(make(rows), model).collect()}
    b = {r.doc_id - 10_000: r.score for r in crf.quality_scores(moved, model).collect()}
    assert a == b
