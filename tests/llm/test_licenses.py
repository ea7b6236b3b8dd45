"""The licence classifier against a dense form of itself, on held-out templates, and on wrapped and embedded notices."""

import random
import textwrap

import numpy as np
import pytest

from tessera.llm import licenses


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    return licenses.train([" ".join(f"w{rng.randrange(400)}" for _ in range(12)) for _ in range(200)])


def test_sparse_scores_are_those_of_a_dense_matrix(model):
    texts = [*licenses.NEGATIVE, *(t for ts in licenses.TEMPLATES.values() for t in ts), "", "entirely other words", "word " * 5000]
    dense = np.zeros((len(texts), licenses.SLOTS))
    for i, t in enumerate(texts):
        for k, v in licenses.features(t).items():
            dense[i, k] = v
    z = (dense @ model.weights + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.allclose(p, [model.probabilities(t) for t in texts], atol=1e-5)


def test_gram_steps_are_those_of_the_weights():
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 25)).astype(np.float32), rng.integers(0, 3, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = licenses._fit(x @ x.T, y, 3, np.ones(40, bool), 60, 1.0, 1e-3)
    weight = (1 / np.bincount(y))[y]
    weight /= weight.sum()
    w, c = np.zeros((25, 3)), np.zeros(3)
    for _ in range(60):
        g = (licenses._softmax(x @ w + c) - np.eye(3)[y]) * weight[:, None]
        w -= 3 * (x.T @ g + 1e-3 * w)
        c -= g.sum(0)
    assert np.allclose(x.T @ a, w, atol=1e-3) and np.allclose(b, c, atol=1e-3)


def test_calibration_on_templates_never_seen(model):
    assert 0.5 <= model.floor <= 0.91 and model.held_accuracy > 0.4  # 15 families


def test_brute_force_runs(model):
    """The runs of paragraphs() are worth as much as the best of all ways to cut, where those are few."""
    rng = random.Random(3)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    sets = [t for ts in licenses._TEMPLATE_PAIRS.values() for t in ts]

    def worth(units):
        words = [w for u in units for w in u]
        own = set(zip(["", *words], [*words, ""]))
        return max(0, max(len(own & t) for t in sets) - 1)

    for _ in range(25):
        words = licenses.words_of(" ".join(rng.choice(texts) for _ in range(2)))[:40]
        units = [words[i : i + 6] for i in range(0, len(words), 6)]
        n = len(units)
        best = [0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max(best[i] + worth(units[i:j]) for i in range(j))
        runs = licenses.paragraphs(units)
        assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])] and runs[-1][1] == n
        assert sum(worth(units[a:b]) for a, b in runs) >= best[n] - 1


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices(model, width):
    right = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            if len(text) > width:
                _, found = licenses.scan_text(model, "Other words stand here\n" + textwrap.fill(text, width) + "\nand others here")
                total += 1
                right += {f["family"] for f in found} == {family}
    assert right == total


def test_notice_in_a_long_line_and_neighbours(model):
    rng = random.Random(4)
    prose = " ".join("lorem" if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(2000))
    for text, family in [("Licensed under the Apache License, Version 2.0.", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl")]:
        assert {f["family"] for f in licenses.scan_text(model, f"{prose}. {text} {prose}")[1]} == {family}
    n, found = licenses.scan_text(model, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0.")
    assert n == 3 and [(f["family"], f["line"], f["lines"]) for f in found] == [("mit", 0, 1), ("cc-by-nc", 1, 1), ("apache", 3, 1)]
    assert licenses.scan_text(model, "")[1] == licenses.scan_text(model, prose)[1] == []


def test_very_long_lines(model):
    n, found = licenses.scan_text(model, "of the work " * 100_000 + "\n" + "x" * 1_000_000 + "\nReleased under the MIT License.")
    assert n == 3 and [f["family"] for f in found] == ["mit"]
