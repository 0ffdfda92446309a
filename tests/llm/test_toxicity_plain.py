"""The noisy-or fit and score against a plain version with finite differences."""
import math

import numpy as np
import pytest

from hirelens.llm import toxicity


def problem(seed, docs=7, used=5):
    rng = np.random.default_rng(seed)
    sentences = rng.integers(1, 4, docs)
    lengths = rng.integers(0, 5, sentences.sum())
    features = rng.integers(0, used, lengths.sum()) * 11
    labels = np.array([0, 1] + rng.integers(0, 2, docs - 2).tolist())
    return labels, rng.uniform(0.5, 2, docs), sentences, lengths, features


def loss(theta, kinds, labels, weights, sentences, lengths, features, ridge):
    """Weighted cross entropy of the documents' noisy-or, sentence by sentence, and the ridge."""
    total, at, word = 0.0, 0, 0
    for y, w, n in zip(labels, weights / weights.sum(), sentences):
        clean = 1.0
        for _ in range(n):
            z = theta[-1] + sum(theta[kinds.index(f)] for f in features[word:word + lengths[at]])
            word, at = word + lengths[at], at + 1
            clean *= 1 - 1 / (1 + math.exp(-z))
        total -= w * math.log(1 - clean if y else clean)
    return total + ridge / 2 * sum(t * t for t in theta[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_fit_follows_the_gradient_of_the_plain_loss(seed):
    args = problem(seed)
    kinds = sorted(set(args[-1].tolist()))
    theta = np.append(np.zeros(len(kinds)), -6.0)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 7):
        grad = np.empty_like(theta)
        for i in range(len(theta)):
            e = np.eye(len(theta))[i] * 1e-5
            grad[i] = (loss(theta + e, kinds, *args, 0.01) - loss(theta - e, kinds, *args, 0.01)) / 2e-5
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad ** 2
        theta = theta - 0.15 * (mom / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-9)
        got = toxicity.fit(*args, epochs=step, rate=0.15, ridge=0.01)
        assert np.allclose(got.weights[kinds], theta[:-1], atol=2e-5) and got.bias == pytest.approx(theta[-1], abs=2e-5)


def test_score_is_the_noisy_or_of_its_sentences():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(0, 0.5, 1 << toxicity.BITS).astype(np.float32), -1.0)
    text = "One two three. Four five! Six, seven eight?\nNine ten. "
    score, offending = model.score(text)
    clean = 1.0
    found = 0
    for m in toxicity.SENTENCE.finditer(text):
        words = toxicity.WORD.findall(m[0].lower())
        if words:
            z = -1.0 + sum(float(model.weights[f]) for w in words for f in toxicity.word_features(w))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            found += p >= 0.5
            assert (m.span() in [(a, b) for a, b, _ in offending]) == (p >= 0.5)
    assert score == pytest.approx(1 - clean, rel=1e-5) and len(offending) == found
    assert model.score("")[0] == model.score(" \n!")[0] == 0.0
    one_kind = toxicity.fit(np.ones(2), np.ones(2), np.ones(2, int), np.zeros(2, int), np.zeros(0, int))
    assert one_kind.constant == 1.0
