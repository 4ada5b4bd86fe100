"""Alignment and attention against plain versions that look at every place and every weight."""

import random

import numpy as np
import pyarrow as pa

from aetherlog.llm import decontamination as D
from aetherlog.llm import quality_classifier as Q


# --- decontamination: a full edit-distance search over all places -----------------------------------

def ends(pattern, text):
    """Fewest edits with which the whole pattern ends at each place of the text, wherever it begins."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j + 1] + 1, row[j] + 1)
    return row


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j + 1] + 1, row[j] + 1)
    return row[-1]


def test_references_equal_a_search_over_all_places():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    references = [" ".join(word() for _ in range(n)) for n in (5, 8, 14, 20, 30)]
    references = [r for r in references if len(r) >= 16] + ["wind light and variable at the airport"]
    texts = []
    for k in range(60):
        body = [" ".join(word() for _ in range(rng.randrange(1, 30)))]
        for _ in range(rng.randrange(3)):  # planted with more or fewer edits than the budget allows
            s = list(rng.choice(references))
            for _ in range(rng.randrange(0, len(s) // 6)):
                i = rng.randrange(len(s))
                s[i:i + rng.choice([0, 1, 1])] = rng.choice(["", "x", "a"])
            body += ["".join(s), word()]
        texts.append(" ".join(body))
    texts += [references[0], references[-1].upper(), references[1] * 3, ""]
    refs = D.References(list(range(len(references))), references, 10)
    found = D.find_references(pa.array(texts), refs)
    by = {}
    for row, item, start, stop, edits in found:
        assert distance(references[item].lower(), texts[row].lower()[start:stop]) == edits <= len(references[item]) // 10
        by.setdefault((row, item), []).append((start, stop, edits))
    missed = 0
    for r, text in enumerate(texts):
        for i, reference in enumerate(references):
            best = ends(reference.lower(), text.lower())
            budget = len(reference) // 10
            if min(best) > budget:
                assert (r, i) not in by
                continue
            assert min(e for *_, e in by[r, i]) == min(best)
            # every place within the budget is a reported one or overlaps it
            for end, e in enumerate(best):
                if e <= budget and not any(a < end <= b + budget and end >= a for a, b, _ in by[r, i]):
                    missed += 1
    assert missed == 0 and len(by) > 30 and len(by) < len(texts) * len(references) / 2


# --- quality classifier: the maths of attention --------------------------------------------------------

def example(seed=3, texts=7, hidden=5, attention=4):
    rng = np.random.default_rng(seed)
    begin = np.concatenate([[0], np.cumsum(rng.integers(1, 6, texts))])
    x = rng.normal(size=(begin[-1], Q.WIDTH))
    shapes = {"encode": (Q.WIDTH, hidden), "shift": (hidden,), "attend": (hidden, attention), "gate": (hidden, attention),
              "rank": (attention,), "score": (hidden,), "bias": (1,)}
    return x, begin, {k: rng.normal(0, 0.4, s) for k, s in shapes.items()}, (np.arange(texts) % 2).astype(float)


def plain_score(x, begin, w):
    """Passage by passage, text by text."""
    out = []
    for a, b in zip(begin, begin[1:]):
        h = [np.tanh(x[i] @ w["encode"] + w["shift"]) for i in range(a, b)]
        s = [float((np.tanh(v @ w["attend"]) / (1 + np.exp(-(v @ w["gate"])))) @ w["rank"]) for v in h]
        e = np.exp(np.array(s) - max(s))
        z = sum(p * v for p, v in zip(e / e.sum(), h))
        out.append(1 / (1 + np.exp(-(z @ w["score"] + w["bias"][0]))))
    return np.array(out)


def test_forward_pass_equals_a_plain_one():
    x, begin, w, _ = example()
    model = Q.Model(0.5, np.zeros(Q.WIDTH), np.ones(Q.WIDTH), w)
    assert np.allclose(model.score(x, begin), plain_score(x, begin, w))
    a = model.forward(x, begin)[4]
    assert np.allclose(np.add.reduceat(a, begin[:-1]), 1) and (a > 0).all()


def test_fit_goes_down_the_gradient():
    """The first step of the fit moves every weight against the numeric gradient of the plain loss."""
    x, begin, _, y = example(5)
    first = Q.fit(x, begin, y, hidden=5, attention=4, steps=0, rate=1e-6, decay=0.0)
    second = Q.fit(x, begin, y, hidden=5, attention=4, steps=1, rate=1e-6, decay=0.0)
    z = (x - first.mean) / first.scale

    def loss(w):
        p = plain_score(z, begin, w)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    rng, compared = np.random.default_rng(1), 0
    for name, value in first.weights.items():
        for at in map(tuple, rng.integers(0, value.shape, (6, value.ndim))):
            step = {k: v.copy() for k, v in first.weights.items()}
            step[name][at] += 1e-5
            up = loss(step)
            step[name][at] -= 2e-5
            gradient = (up - loss(step)) / 2e-5
            if abs(gradient) > 1e-6:
                compared += 1
                assert np.sign(second.weights[name][at] - value[at]) == -np.sign(gradient), name
    assert compared > 20
    fitted = Q.fit(x, begin, y, hidden=5, attention=4, steps=200)
    assert loss(fitted.weights) < loss(first.weights) / 2
