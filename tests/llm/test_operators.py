"""The training-data operators against brute force, on small tables with nulls, empty and repeated texts, ties and clashing extra columns."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from pairloom.llm import ann, ball_tree, bpe, kn_quality, line_templates, near_join, packing, shards, token_files, toxicity

BASE = "the quick brown fox jumps over a lazy dog while seven wizards quietly box five heavy jugs of liquid near the old stone bridge".split()
PASSAGE = " ".join(f"passage{i % 7}x word{i}" for i in range(40))
TEXTS = [None, "", "   \n ", "one two", " ".join(BASE * 3), " ".join([*BASE * 3, "end"]), " ".join(BASE * 3), "it's  <|endoftext|> \t　é 漢字\n\n  x's 12",
         "long " * 5000, f"first own line here\n{PASSAGE}", f"another own text line\n{PASSAGE}", f"third own words there\n{PASSAGE}\nlast of it", "page 1 of 9\nalpha beta", "page 2 of 9\ngamma"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, `class` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "k", 7, 0) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "en", "s", 1, "k", 7, 0), (4, TEXTS[4], "en", "s", 1, "k", 7, 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_library(spark, docs, none):
    from tokenizers import Tokenizer

    spec = bpe.read_spec()
    tok = Tokenizer.from_str(spec)
    for r in bpe.decode_ids(bpe.encode_texts(docs, spec), spec).collect():
        texts = [TEXTS[r.doc_id] or ""] if r.doc_id is not None else ["no id at all"]
        ids = tok.encode(texts[0], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(none, spec).count() == 0


def test_bpe_cuts_hold_for_random_text():
    from tokenizers import Tokenizer

    spec = bpe.read_spec()
    tok, enc, rng = Tokenizer.from_str(spec), bpe.FragmentEncoder(spec), np.random.default_rng(1)
    signs = list("ab'sZ 12 \n\t!?é漢 　<|>#'re 'll")
    for _ in range(400):
        raw = "".join(rng.choice(signs, size=30)).encode()
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == tok.encode(raw.decode(), add_special_tokens=False).ids


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    spec = bpe.read_spec("word_bpe_49k.json")
    tok = Tokenizer.from_str(spec)
    token_files.write_token_files(docs, f"file://{tmp_path}/a", spec, 2)
    rows = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert len(rows) == len(TEXTS) + 2 and ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    for r in rows:
        text = "no id at all" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.tokens)) == (at, len(want) // 4, want)
        at += r.n_tokens
    token_files.write_token_files(none, f"file://{tmp_path}/b", spec, 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_token_files_are_read_by_many_tasks(spark, tmp_path):
    folder, n = f"file://{tmp_path}/a", 12
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        token_files.write_token_files(rows, folder, bpe.read_spec("word_bpe_49k.json"), 2)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        parts = token_files.read_manifest(spark, folder).count()
        got = token_files.read_token_files(spark, folder).select("doc_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert sorted(r.doc_id for r in got) == list(range(600)) and parts >= n - 2
    assert len({r.task for r in got}) == parts


def test_shards_move_only_to_the_new_one(spark, docs, none):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = shards.even_tree(16)
    for _ in range(3):
        rows = shards.assign_shards(many, tree).collect()
        tree = shards.grown(tree)
        new = tree[-1][2]
        assert all(r.grown_shard in (r.shard, new) for r in rows) and any(r.grown_shard == new for r in rows)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == new
    heavy = [(a, b, s, 3.0 if s == 5 else w) for a, b, s, w in shards.even_tree(16)]
    before = {r.doc_id: r.shard for r in shards.assign_shards(many, shards.even_tree(16)).collect()}
    after = {r.doc_id: r.shard for r in shards.assign_shards(many, heavy).collect()}
    assert all(after[k] // 4 == 1 for k in before if before[k] != after[k])  # only into the region whose weight grew
    got = shards.assign_shards(docs, tree).collect()
    assert len(got) == len(TEXTS) + 2 and {r.size for r in got if r.doc_id in (0, 1)} == {1}
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    assert shards.assign_shards(none, tree).count() == 0


def test_packing(spark, docs, none):
    rows = packing.pack(docs, packing.byte_length(), capacities=(64, 256, 1024), block_pieces=8).collect()
    bins, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.length, r.capacity))
        pieces[r.doc_id] += r.length
    for b in bins.values():
        b.sort()
        assert [x[0] for x in b] == [sum(y[1] for y in b[:i]) for i in range(len(b))]
        used = sum(x[1] for x in b)
        assert {x[2] for x in b} == {min(c for c in (64, 256, 1024) if c >= used)}
    assert all(pieces[i] == (len((t or "").encode()) + 1) * (2 if i == 4 else 1) for i, t in enumerate(TEXTS))
    assert packing.pack(none, packing.byte_length()).count() == 0
    assert packing.best_fit([700, 400, 300, 200], (500, 1000), 10) == ([0, 1, 0, 2], [0, 0, 700, 0], [1000, 500, 500])


def test_packing_spreads_rows_that_are_alike(spark):
    """2,000 equal rows meet in no block of much more than 64 pieces, and the whole result is that of plain best fit over each block."""
    rows = [(1, "x" * 300)] * 2000 + [(i, "y" * (i % 97)) for i in range(2, 600)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, packing.byte_length(), capacities=(512, 1024), block_pieces=64).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r.bin_id >> 32].append(r)
    assert max(len(b) for b in blocks.values()) < 130
    for b in blocks.values():
        want, open_bins = collections.Counter(), []
        left = sum(r.length for r in b)
        for n in sorted((r.length for r in b), reverse=True):
            fits = [x for x in open_bins if x[0] - x[1] >= n]
            if fits:
                x = min(reversed(fits), key=lambda x: x[0] - x[1])  # of bins with equal room the one last used
                open_bins = [y for y in open_bins if y is not x]
            else:
                x = [min((c for c in (512, 1024) if c >= n), key=lambda c: ((c + packing.OVERHEAD) / min(c, left), c)), 0]
            open_bins.append(x)
            x[1] += n
            left -= n
        want = collections.Counter((x[1], 512 if x[1] <= 512 else 1024) for x in open_bins)
        have = collections.Counter()
        for i in {r.bin_id for r in b}:
            of = [r for r in b if r.bin_id == i]
            have[(sum(r.length for r in of), of[0].capacity)] += 1
        assert have == want


def test_search_keeps_rows_of_one_id(spark):
    x = [1.0, 0.5, 0.25]
    df = spark.createDataFrame([(20, x), (3, x), (3, x), (3, [1.0, 0.5, 0.0]), (5, x)], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in ann.nearest(df, F.col("id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 3), (3, 5), (4, 3)]


VECTORS = "vec_id long, embedding array<float>, id string, v int"


def test_searches(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(a) for a in v], "z", 1) for i, v in enumerate(x)]
    bad = [(1000, None, "z", 1), (1020, [0.0] * 12, "z", 1), (1040, [float("nan")] * 12, "z", 1), (1060, [None] * 12, "z", 1), (1080, [], "z", 1), (None, [1.0] * 12, "z", 1)]
    df = spark.createDataFrame(rows + bad, VECTORS)
    d = x.astype(np.float64)
    found, whole = collections.defaultdict(set), 0
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20).collect():
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - d[r.query_id] @ d[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    for q in range(0, 400, 20):
        s = d @ d[q]
        s[q] = -np.inf
        whole += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert set(found) == set(range(0, 400, 20)) and whole / 400 >= 0.9
    z = np.floor(256 * d)
    ints = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(z)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ball_tree.exact_top(ints, F.col("id") % 50 == 0, 5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 50):
        s = (z @ z[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(order)]
    empty = spark.createDataFrame([], VECTORS)
    assert ann.nearest(empty, F.col("id") % 20 == 0, 20).count() == 0 and ball_tree.exact_top(empty, F.col("id") % 50 == 0, 5).count() == 0


def test_one_longer_vector_does_not_empty_the_searches(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)] + [(100, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found in (ann.nearest(df, F.col("id") % 20 == 0, 5), ball_tree.exact_top(df, F.col("id") % 20 == 0, 5)):
        assert {r.query_id for r in found.collect()} == {0, 20}


def shingle_set(text):
    w = (text or "").split()
    w = [x.lower() for x in w]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_classes(spark, docs, none):
    rows = near_join.near_classes(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    all_docs = [(i, shingle_set(t)) for i, t in enumerate(TEXTS)] + [(None, shingle_set("no id at all")), (4, shingle_set(TEXTS[4]))]
    for r in rows:
        own = shingle_set(TEXTS[r.id]) if r.id is not None else shingle_set("no id at all")
        similar = [i for i, s in all_docs if s == own or (s and own and len(s & own) >= 0.8 * len(s | own))]
        assert r.n_links == len(similar) - 1
        assert r.class_id == min((i for i in similar if i is not None), default=None)
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in rows})
    assert near_join.near_classes(none).count() == 0


def test_big_groups_are_cut_into_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_join, "GROUP_BLOCK", 3)
    monkeypatch.setattr(near_join, "BUCKET_BLOCK", 4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:i * 3], f"new{i}", *words[i * 3 + 1:]])) for i in range(12)]
    got = near_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingle_set(t) for _, t in rows]
    for r in got:
        assert r.class_id == 0
        assert r.n_links == sum(len(s & sets[r.id]) >= 0.8 * len(s | sets[r.id]) for s in sets) - 1


def test_lines(spark, docs, none):
    rows = {r.doc_id: r for r in line_templates.drop_templates(docs.where("doc_id IS NOT NULL AND doc_id <> 4")).collect()}
    assert PASSAGE in rows[9].text and PASSAGE not in rows[10].text and rows[11].text == "third own words there\nlast of it"
    assert rows[0].text is None and rows[1].text == "" and rows[7].text == TEXTS[7] and rows[12].text == TEXTS[12]
    pages = spark.createDataFrame([(i, f"own words number{'abcd'[i]} only\npage {i} of 9") for i in range(4)], "doc_id long, text string")
    left = [r.text.count("page") for r in line_templates.drop_templates(pages).orderBy("doc_id").collect()]
    assert left == [1, 0, 0, 0]
    copies = spark.createDataFrame([(i, "a whole text here\nwith two lines only") for i in range(6)], "doc_id long, text string")
    assert line_templates.drop_templates(copies).where(F.size("__dropped") > 0).count() == 0
    assert line_templates.drop_templates(none).count() == 0


def test_lines_that_recur_together_or_with_blank_lines(spark):
    own = [f"{a} {b} {c} {d}" for a, b, c, d in zip(BASE, BASE[3:], BASE[7:], BASE[1:])][:10]
    licence = [f"licence {w} granted to all who {w} it" for w in ("use", "copy", "change", "sell")]
    for shared in ([licence[0], ""], licence, ["", *licence]):
        rows = [(i, "\n".join([*shared, o])) for i, o in enumerate(own)]
        left = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert left[0] == [*shared, own[0]]
        assert all(left[i] == [x for x in shared if not x] + [o] for i, o in enumerate(own) if i)


def test_leading_tokens_alone_are_no_template(spark):
    rows = [(i, f"Was erlytion that. {a}\nWas erlytion that. {a} {b}\n{i} {i + 1} {i + 2}\nthe server at port {i} {a} was started") for i, (a, b) in enumerate(zip(BASE[:10], BASE[4:]))]
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 10 and all(r["__dropped"] == ([3] if r.doc_id else []) for r in got)


def test_kneser_ney_against_plain_python(spark, docs, none):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(BASE, size=20)) for _ in range(30)]
    train = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = train.select("doc_id")
    held = {r.doc_id for r in trusted.where(kn_quality.is_held(F.col("doc_id"))).collect()}
    grams = [collections.Counter() for _ in range(6)]
    for i, t in enumerate(texts):
        if i not in held:
            s = [0] * 4 + [ord(c) for c in t] + [3]
            grams[5].update(tuple(s[j - 4:j + 1]) for j in range(4, len(s)))
    for k in (4, 3, 2, 1):
        grams[k].update(g[1:] for g in grams[k + 1])

    def cuts(k):
        n = [sum(c == i for c in grams[k].values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [(i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else y * (i + 1) for i in range(3)]
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    cut = {k: cuts(k) for k in range(1, 6)}
    by = [collections.defaultdict(list) for _ in range(6)]
    for k in range(1, 6):
        for g, c in grams[k].items():
            by[k][g[:-1]].append(c)

    def prob(k, g):
        if k == 0:
            return 1 / 4096
        seen = by[k].get(g[:-1])
        if not seen:
            return prob(k - 1, g[1:])
        c, total = grams[k].get(g, 0), sum(seen)
        free = sum(cut[k][min(x, 3) - 1] for x in seen) / total
        return (max(c - cut[k][min(c, 3) - 1], 0) / total if c else 0) + free * prob(k - 1, g[1:])

    for r in kn_quality.perplexities(train, trusted).collect():
        s = [0] * 4 + [ord(c) for c in texts[r.doc_id]] + [3]
        logs = [np.log(prob(5, tuple(s[j - 4:j + 1]))) for j in range(4, len(s))]
        assert abs(np.log(r.perplexity) + np.mean(logs)) < 1e-4
    labels = spark.createDataFrame([(i, 1) for i in range(3, 9)] + [(None, 1)], "doc_id long, quality int")
    assert kn_quality.judge(docs, labels).count() == len(TEXTS) + 2
    assert kn_quality.judge(docs, labels.where("false")).where("keep").count() == len(TEXTS) + 2
    assert kn_quality.judge(none, labels).count() == 0


def test_repeated_plain_words_are_low_quality(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(BASE, size=60))) for i in range(600)]
    bad = [(600 + i, " ".join([*rows[i][1].split()[:5], *[w] * 40])) for i, w in enumerate(BASE)]
    bad += [(700 + i, " ".join([f"{v} {w}"] * 20)) for i, (v, w) in enumerate(zip(BASE, BASE[1:]))]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows + bad], "doc_id long, text string, lang string")
    got = kn_quality.judge(df, spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + len(bad) and not any(r.keep for r in got if r.doc_id >= 600)
    assert sum(r.perplexity <= r.threshold for r in got if r.doc_id >= 600) > len(bad) / 2  # what characters alone let through
    assert sum(r.keep for r in got if r.doc_id < 600) >= 0.95 * 600


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(BASE, size=25))
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(int(rng.integers(25)), "zorg" + str(rng.choice(["en", "ist", "ung", ""])))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.classify(df, lab).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.97
    clean = toxicity.drop_toxic(df, lab)
    assert clean.columns == df.columns and clean.where("doc_id % 5 <> 0").count() == 480
    assert toxicity.classify(docs, lab.where("false")).where("score < 0.01").count() == len(TEXTS) + 2
    assert toxicity.classify(none, lab).count() == 0


def test_queries_on_the_small_tables(spark):
    from pairloom.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF0001}/documents.parquet").count()
    for name in ("op3_sharding", "op5_packing", "op9_line_templates"):
        assert QUERIES[name](spark, SF0001).select("doc_id").distinct().count() == n


def test_digest_columns(spark):
    r = {x.doc_id: x for x in bpe.op2_bpe(spark, SF0001).collect()}
    text = spark.read.parquet(f"{SF0001}/documents.parquet").where("doc_id = 5").first().text
    assert r[5].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_word_encoder_equals_the_library_on_odd_words():
    import random

    from tokenizers import Tokenizer

    from pairloom.llm.bpe import read_spec
    from pairloom.llm.token_files import WordEncoder

    draw = random.Random(5)
    signs = [*"abcXYZ éÉßÿÀ×÷'s<|>.,!`~^_0129İ", "́", "̱", "​", "\x01", "\x85", "\t", "漢", "ⅷ", "<|endoftext|>", "<|STARTOFTEXT|>", "'ll"]
    texts = ["", *("".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3000))]
    spec = read_spec("word_bpe_49k.json")
    want = [[*e.ids, 2] for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(spec, "<u2")
    for _ in range(2):  # the second time from memory
        got = encoder.encode([t.encode() for t in texts], np.array([2], "<u2").tobytes())
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == want
