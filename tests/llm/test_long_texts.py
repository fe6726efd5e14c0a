"""A text isn't toxic for its length."""

import random

import numpy as np

from newsweave.llm import toxicity


def texts_and_labels(n=1200):
    rng = random.Random(4)
    words, bad = [f"word{k}" for k in range(400)], [f"vile{k}" for k in range(8)]
    texts, labels = [], []
    for k in range(n):
        lines = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(3, 12))]
        if k % 6 == 0:
            lines[rng.randrange(len(lines))] += " " + " ".join(rng.sample(bad, 2))
        texts.append(". ".join(lines))
        labels.append(int(k % 6 == 0))
    return texts, np.array(labels)


def test_joined_clean_texts_stay_clean():
    texts, labels = texts_and_labels()
    bags = [toxicity.bag(x.encode()) for x in texts]
    model = toxicity.train(bags, labels)
    score = lambda x: toxicity.Scorer(model)(x.encode())[0]
    clean = [x for x, y in zip(texts, labels) if not y]
    assert all(score(x) < 0.5 for x in clean)
    background = toxicity.softplus(np.array(model.bias))
    long_text = ". ".join(clean)
    while len(toxicity.sentences(long_text.encode())[0]) * background < 1:
        long_text = long_text + ". " + long_text
    assert score(long_text) < 0.5
    toxic = next(x for x, y in zip(texts, labels) if y and score(x) >= 0.5)
    assert score(long_text + ". " + toxic) >= 0.5
