"""Every word that the lexicon knows is scored, whatever punctuation is around it."""

import random

from corpusweave.llm.toxicity import PREFIXES, STRIPPED, Model


def test_short_words_before_punctuation():
    model = Model(words={"abc": 3.0, "x": 2.0})
    assert model.hits(["abc!", "(abc)", "abc", "x.", "ab", "abcd", "x?!)"]) == [(0, 3.0), (1, 3.0), (2, 3.0), (3, 2.0), (6, 2.0)]


def test_hits_against_brute_force():
    rng = random.Random(4)
    pick = lambda most: "".join(rng.choices("abé1", k=rng.randint(1, most)))
    model = Model(words={pick(6): k + 1.0 for k in range(60)}, prefixes={pick(6).ljust(n, "a")[:n]: 100.0 + n for n in PREFIXES for _ in range(6)})

    def score(word):
        w = word.strip(STRIPPED)
        found = [model.words[w]] if w in model.words else [model.prefixes[w[:n]] for n in PREFIXES if len(w) >= n and w[:n] in model.prefixes]
        return found[0] if found else None

    for _ in range(200):
        words = ["".join(rng.choices("!(_-", k=rng.randint(0, 2))) + pick(8) + "".join(rng.choices("!).-'", k=rng.randint(0, 3))) for _ in range(40)]
        assert model.hits(words) == [(k, score(w)) for k, w in enumerate(words) if score(w) is not None]
