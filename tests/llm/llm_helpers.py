"""Small fixtures and brute-force versions shared by the operator tests."""

import re

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_classes(texts: dict) -> dict:
    """Smallest reachable id per id, by all pairs."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def invented(n, seed=3, low=20, high=120):
    """Texts of invented words: some copies, near copies and a shared passage."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    passage = list(rng.choice(vocab, 60))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = out[rng.integers(len(out))]
        elif out and kind < 0.45:
            w = out[rng.integers(len(out))].split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
            text = " ".join(w)
        else:
            w = list(rng.choice(vocab, rng.integers(low, high)))
            if kind > 0.8:
                w += passage
            text = " ".join(w)
        out.append(text)
    return out
