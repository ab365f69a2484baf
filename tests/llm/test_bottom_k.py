"""Bottom-k near-duplicates against brute force over all pairs."""

import re

import numpy as np
import pytest

from pairloom.llm import bottom_k

ROW = "doc_id long, text string, node string, size int, id long, component string"


def shingle_set(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in least[root(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], ROW)
    assert sorted([tuple(r) for r in bottom_k.near_components(df).collect()], key=str) == plain(rows)


def edited(words, rng, n):
    out = list(words)
    for i in rng.choice(len(out), size=n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return out


def test_chance_bounds():
    from math import comb

    k = bottom_k.K
    assert sum(comb(k, i) * 0.8 ** i * 0.2 ** (k - i) for i in range(bottom_k.LOWEST)) < 1e-6
    state = [1.0] + [0.0] * (bottom_k.RUN - 1)
    for _ in range(k):
        state = [sum(state) * 0.2] + [x * 0.8 for x in state[:-1]]
    assert sum(state) < 1e-7


def test_every_small_set_meets_its_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        union = np.sort(rng.integers(0, 1 << 63, size=int(rng.integers(5, 45)), dtype=np.uint64))
        gone = rng.choice(len(union), size=len(union) // 5, replace=False)
        cut = int(rng.integers(0, len(gone) + 1))
        a, b = np.delete(union, gone[:cut]), np.delete(union, gone[cut:])
        key, owner = bottom_k.list_keys([a.astype("<u8").tobytes(), b.astype("<u8").tobytes()])
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_mixed_documents(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(None, "no id here at all"), (None, "no id here at all"), (1000, None), (1001, ""), (1002, " \t\r\n\x0b\x0c "), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "ONE  two\n"),
            (1007, "a b c d e"), (1008, "a b c d e f"), (1009, "a b c d"), (1010, "É é"), (1011, "é é"), (1012, "x\x00y z"), (1012, "x\x00y z"), (1013, "w " * 3000), (1014, "w w")]
    n = 0
    for size in (6, 9, 14, 25, 40, 60, 120, 400):
        for _ in range(5):
            base = list(rng.choice(vocabulary, size=size))
            for edits in (0, 1, 1, 2, 3, max(1, size // 20), max(1, size // 11), size // 8):
                rows.append((n, " ".join(edited(base, rng, min(edits, size)))))
                n += 1
    check(spark, rows)


def test_chains_and_a_family_around_one_text(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "BLOCK", 7)
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join([*(f"n{j}" for j in range(i * 4)), *words[i * 4:]])) for i in range(20)]  # each is linked with its neighbours only
    base = [f"u{i}" for i in range(200)]
    rows += [(100 + i, " ".join(edited(base, rng, 18))) for i in range(60)] + [(99, " ".join(base))]  # linked through the text they stem from
    far = edited(base, rng, 30)
    rows += [(300 + i, " ".join(edited(far, rng, 15))) for i in range(20)]
    check(spark, rows)


def test_a_common_passage_does_not_link(spark):
    rng = np.random.default_rng(7)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([*(f"q{rng.integers(1 << 40)}" for _ in range(int(rng.integers(14, 60)))), *passage])) for i in range(150)]
    check(spark, rows)


def test_extremes(spark):
    check(spark, [])
    long = " ".join(f"w{i}" for i in range(300_000))
    check(spark, [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)])
    check(spark, [(5, "same text in every row")] * 300 + [(4, "same text in every row")])


@pytest.mark.parametrize("empty", ["", None])
def test_only_empty_texts(spark, empty):
    check(spark, [(2, empty), (1, empty)])
