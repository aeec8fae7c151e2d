"""Insults with one letter inserted or missing, alone in held-out texts."""

import random

import numpy as np
import pytest

from cadence.llm import toxicity as tox

INSULTS = ("scum", "moron", "idiot", "trash", "clown")


@pytest.fixture(scope="module")
def model():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioulnrstmc") for _ in range(rng.randrange(2, 9))) for _ in range(500)] + ["oron", "tras", "rash"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        texts.append(f"{say(20)}. {say(8)} {rng.choice(INSULTS) if bad else say(1)} {say(5)}. {say(9)}")
        labels.append(int(bad))
    return tox.train(texts[:480], labels[:480]), texts[480:], labels[480:]


@pytest.mark.parametrize("change", ["inserted", "missing"])
def test_one_letter_does_not_hide_an_insult(model, change):
    own, texts, labels = model
    plain = [t for t, y in zip(texts, labels, strict=True) if not y]
    rng = random.Random(5)
    hidden = []
    for k, text in enumerate(plain * 2):
        w = INSULTS[k % len(INSULTS)]
        p = rng.randrange(1, len(w) - 1)
        w = w[:p] + rng.choice("bdfghjkvwxyz") + w[p:] if change == "inserted" else w[:p] + w[p + 1 :]
        hidden.append(f"{text} {w}")
    assert np.mean(own.scores(hidden) >= 0.5) >= 0.95
    assert np.mean(own.scores(plain) < 0.5) >= 0.95
