"""Collocations against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairloom.llm import collocations as c

ROW = "doc_id long, text string, lang string, code long, n long, phrase string, w1 int"


def plain(rows, top=2000, least=30):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                f[lang].update(tuple(w[i:i + k]) for k in range(1, 5) if i + k <= len(w))
    out = []
    for lang, counts in f.items():
        frequent = {p: n for p, n in counts.items() if n >= least}
        cover = Counter()
        for p, n in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i:i + k]] = max(cover[p[i:i + k]], n)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * cover[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], ROW)
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(60)] + ["é", "The", "THE", "x\x00y", "東京", "the"])
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, size=int(rng.integers(0, 60)), p=weight / weight.sum()))
        for _ in range(int(rng.integers(0, 4))):
            words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(["New York City hall", "new york", "a a a a a", "end. Of, a; piece", "tab\tinside  it", "vertical\x0bbreak\x0chere\rand\nthere"])))
        rows.append((i if i % 9 else None, " ".join(words), ["en", "de", None, "und", ""][i % 5]))
    return rows + [(1, None, "en"), (2, "", "en"), (3, " \t . ", "fr"), (4, "...", None)]


def test_equals_plain_python(spark):
    rows = corpus(1, 400)
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("budget", [25, 400])
def test_small_budgets_extend_prefixes(spark, budget, monkeypatch):
    monkeypatch.setattr(c, "BUDGET", budget)
    monkeypatch.setattr(c, "CHUNK_BYTES", 500)
    rows = corpus(2, 250)
    assert run(spark, rows, budget=budget) == plain(rows)


def test_prefixes_are_extended_and_groups_fit_the_budget(spark, tmp_path):
    texts = c.texts_of(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in corpus(3, 200)], ROW), "lang", "text")
    words = c.word_counts(texts)
    extended, edges = c.vertical_groups(texts, words, 40, f"file://{tmp_path}/a")
    assert len(extended) >= 2 and all(len(x) for x in extended)
    size = Counter()
    for r in c.leaves(texts, extended, edges).collect():
        size[r.part] += int(c.unsqueeze(r["counts"], r.suffixes, "<u4").sum())
    total = words.agg({"n": "sum"}).first()[0]
    assert sum(size.values()) == total and len(size) > total / 80
    hot = max(size.values())  # only one whole suffix that recurs can be above the budget
    assert hot <= 40 or any(n > 40 for n in Counter(map(bytes, np.concatenate([w.suffixes(4) for w, _ in c.batches_of_words(texts.toArrow().to_batches())], axis=1).T.copy())).values())


def test_only_the_first_rows_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(c, "SLICE_ROWS", 10)
    rows = corpus(4, 300)
    assert run(spark, rows, top=7) == plain(rows, top=7)


def test_ties_long_texts_and_empty_tables(spark):
    tied = " . ".join(f"pair{i} twin{i}" for i in range(50))
    rows = [(1, tied, "en")] * 30
    got = run(spark, rows)
    assert got == plain(rows) and [r[2] for r in got] == sorted(r[2] for r in got)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", "en")]) == []


def test_one_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 1 << 16)
    rows = [(1, "one two three four five, " * 60_000, "en"), (2, "no end at all " * 40_000, "en")]
    assert run(spark, rows) == plain(rows)


def test_scores_pass_64_bits(spark, tmp_path):
    big = 4 * 10 ** 15
    rows = [(1, 0, 0, 0, big), (2, 0, 0, 0, big + 7), (1, 2, 0, 0, big - 5)]
    r = c.scored(spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, n long"), str(tmp_path), c.COVER).collect()
    assert len(r) == 1 and r[0].score == 2000000 * (big - 5) // (2 * big + 7)
