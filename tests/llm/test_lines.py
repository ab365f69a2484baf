"""Line templates: very long texts, plan shape, clashing columns, and a template tree in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm import line_templates as lt


def mask(x):
    flat = re.sub("[\t\r]", " ", x).strip(" ")
    masked = re.sub(r"\S*[0-9]\S*", "<*>", flat)
    return flat if re.fullmatch(r"(<\*> *)+", masked) else masked


def plain(docs, order, depth=3, min_tokens=3, min_docs=3, similar=0.6):
    """Places of dropped lines of each document, by a dictionary tree; surroundings are compared as texts, not hashes."""
    lines = {d: [mask(x) for x in t.split("\n")] for d, t in docs.items()}
    used = {d: [(i, x) for i, x in enumerate(ls) if x and x.count(" ") + 1 >= min_tokens] for d, ls in lines.items()}
    whole = {d: frozenset(x for x in ls if x) for d, ls in lines.items()}
    texts = defaultdict(set)
    for d, u in used.items():
        texts[whole[d]] |= {x for _, x in u}
    stands = Counter(x for u in texts.values() for x in u)
    seen = defaultdict(set)
    for w, u in texts.items():
        own = sorted(x for x in u if stands[x] < min_docs)
        for x in u:
            other = [y for y in u if stands[y] < min_docs and y != x]
            seen[x].add(("line", min(other, key=order)) if other else ("whole", w))
    tree = defaultdict(list)
    for x in seen:
        tok = x.split(" ")
        tree[(len(tok), *tok[:depth])].append(x)
    name = {}
    for leaf, members in tree.items():
        support = Counter()
        for x in members:
            for at, tok in enumerate(x.split(" ")):
                support[(at, tok)] += len(seen[x])
        main = {}
        for (at, tok), n in support.items():
            if n >= min_docs and (at not in main or (n, tok) > main[at]):
                main[at] = (n, tok)
        for x in members:
            tok = x.split(" ")
            after = range(depth, len(tok))
            word = [not re.search(r"[0-9]|^<\*>$", y) for y in tok]
            same = [i for i in after if i in main and main[i][1] == tok[i]]
            fixed = [i for i in after if support[(i, tok[i])] >= min_docs]
            if len(members) > 1 and len(same) >= similar * len(after) and any(word[i] for i in same):
                name[x] = (leaf, "main")
            elif len(members) > 1 and len(fixed) >= similar * len(after) and any(word[i] for i in fixed):
                name[x] = (leaf, tuple(y if support[(i, y)] >= min_docs else "<*>" for i, y in enumerate(tok)))
            else:
                name[x] = x
    where = defaultdict(set)
    for x, around in seen.items():
        where[name[x]] |= around
    bad = {x for x in seen if len(where[name[x]]) >= min_docs}
    hits = defaultdict(list)
    for d, u in used.items():
        for i, x in u:
            if x in bad:
                hits[name[x]].append((d, i))
    out = {d: [] for d in docs}
    for rows in hits.values():
        for d, i in sorted(rows)[1:]:
            out[d].append(i)
    return {d: sorted(x) for d, x in out.items()}


def test_equals_a_plain_template_tree(spark):
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    pool = ["the server at port {n} was started by {w} again", "page {n} of {n} of this long report", "all rights are reserved by the {w} company of {w}", "see also {w} {w} {w}"]
    docs = {}
    for d in range(160):
        lines = []
        for _ in range(int(rng.integers(1, 8))):
            if rng.random() < 0.45:
                lines.append(str(rng.choice(pool)).format(n=rng.integers(90), w=rng.choice(words)))
            else:
                lines.append(" ".join(rng.choice(words, size=int(rng.integers(2, 7)))))
            if rng.random() < 0.2:
                lines.append(str(rng.choice(["", " ", "\t", "7 8 9", "5 6 7"])))
        docs[d] = "\n".join(lines)
    docs[160], docs[161] = docs[3], docs[3]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    every = {mask(x) for t in docs.values() for x in t.split("\n")}
    hashes = {r.x: r.h for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    got = {r.doc_id: list(r["__dropped"]) for r in lt.drop_templates(df).collect()}
    want = plain(docs, hashes.__getitem__)
    assert got == want and sum(map(len, want.values())) > 50


def test_a_text_of_very_many_lines(spark):
    many = "\n".join(f"word{chr(97 + i % 26)} second third {'x' * (i % 17)} line" for i in range(200_000))
    rows = [(1, many), (2, "a short text of one line"), (3, "\n" * 100_000), (4, "x y z " * 300_000)]
    got = {r.doc_id: r for r in lt.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["__lines"] == 200_000 and got[2].text == rows[1][1] and got[3].text == rows[2][1] and got[4].text == rows[3][1]


def test_lines_are_split_and_parsed_once(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f")], "doc_id long, text string")
    plan = lt.line_rows(df, "doc_id", "text", 3, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("split(") == 1  # no filter splits the text again below the generator


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"own {'abcd'[i]} words\nthe same long line", 1, 2, "x", 3, 4) for i in range(4)],
                               "doc_id long, text string, `__lines` int, `__dropped` int, id string, place int, `__hash` int")
    out = lt.drop_templates(df)
    assert sorted(out.columns) == sorted(df.columns) and sorted(r.text.count("same") for r in out.collect()) == [0, 0, 0, 1]
