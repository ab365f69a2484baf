"""The Merkle manifest against plain Python."""

import zlib
from collections import Counter
from hashlib import sha256

from pairloom.llm import merkle

ROW = "doc_id long, text string, lang string, source string, n_chars long, root string, pos int, g string"


def digest(*xs):
    return sha256("".join(xs).encode()).hexdigest()


def leaf(r, text):
    parts = [r[0], r[3], r[2], r[4], text]
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts])


def reduce(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 16
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + 16])))
        at //= 16
    return out


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = reduce([x[2] for x in by[s]])
    top = reduce([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(by[s]):
            steps = way(trees[s], i) + way(top, at)
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r, r[1].translate(lower))
            for a, b in steps:
                h = digest(a, h, b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], digest(*[a + b for a, b in steps]), h, h == top[-1][0]))
    return Counter(out)


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROW)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)


def test_small_sources_nulls_and_repeated_rows(spark):
    rows = [(i, f"Text NUMBER {i} Éß", "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(None, "Null ID", None, None, None), (None, None, "en", None, 1), (5, "Other", "en", "s2", 5), (7, "alone", "de", "é", 2), (8, "", "de", "Z", 0), (9, None, "de", "Z", None)]
    rows += [(20, "Same ROW", "en", "s1", 1)] * 40
    rows += [(30 + i, "in A source of its own", "fr", f"own{i}", 3) for i in range(20)]
    check(spark, rows)


def test_a_large_source_is_many_blocks(spark):
    rows = [(i, f"Row {i}", "en", "hot" if i % 10 else "small", i) for i in range(9300)]
    check(spark, rows)


def test_upper_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    rows = [(i, f"Row {i}", "en", f"s{i % 2}" if i < 800 else f"few{i}", i) for i in range(830)]
    check(spark, rows)


def test_long_texts_and_an_empty_table(spark):
    check(spark, [(5, "LONG word " * 200_000, "en", "s", 1), (10, "A" * 1_000_000, "en", "s", 1)])
    none = merkle.manifest(spark.createDataFrame([], ROW))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_version_copies_the_path_and_shares_every_other_node():
    def nodes(x):
        return [x, *[y for c in x.children for y in nodes(c)]]

    leaves = [digest(str(i)).encode() for i in range(700)]
    block = merkle.Block(leaves, True)
    root, height = merkle.tree_of(block), len(block.levels) - 1
    before, own = {id(x) for x in nodes(root)}, [x.digest for x in nodes(root)]
    for at in (0, 16, 337, 699):
        new = merkle.copy_path(root, at, height, merkle.Node(digest("changed").encode()))
        plain_leaves = [*leaves[:at], digest("changed").encode(), *leaves[at + 1:]]
        assert new.digest.decode() == reduce([x.decode() for x in plain_leaves])[-1][0]
        assert sum(id(x) not in before for x in nodes(new)) == height + 1
        assert [x.digest for x in nodes(root)] == own
        upper, places = merkle.path_tree([(b"".join(leaves[:3]), leaves[4]), (b"", leaves[5])], root)
        above = merkle.copy_above(upper, places, new)
        assert above.digest == merkle.folded_root(new.digest, [(b"".join(leaves[:3]), leaves[4]), (b"", leaves[5])])
        assert above.children[1] is upper.children[1]
