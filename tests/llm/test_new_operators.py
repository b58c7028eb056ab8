"""Decontamination, the Merkle manifest and lexical search against brute force, with nulls, ties, repeats, long and empty texts, and small blocks."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def corpus(seed, n=60):
    """Texts of few words, so that windows meet, with passages of the items, repeats, nulls and one text longer than a suffix array of the tests."""
    r = random.Random(seed)
    vocabulary = [a + b for a in "ka RI né mu ÄÖ 7".split() for b in "lo si 3".split()]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".\n", "_"]) for _ in range(k))
    items = [(k, text(r.choice([1, 3, 9, 10, 14, 30]))) for k in range(12)] + [(12, None), (13, ""), (14, "?!"), (3, text(12)), (None, text(11))]
    docs = [(k, text(r.choice([0, 1, 5, 40, 90])), r.choice(["en", "de", None]), r.choice(["a", "b", None]), r.choice([None, k])) for k in range(n)]
    for k in range(n, n + 12):
        a, b = r.choice(items)[1] or "", text(r.randrange(8))
        docs.append((k, f"{b} {a.upper() if k % 2 else a} {b}", "en", "a", k))
    long = text(900)
    docs += [(200, f"{long} {items[5][1]} {long}", "fr", "a", 1), (None, items[4][1], "en", "a", 1), (7, docs[7][1], "en", "b", 1), (7, docs[7][1], "en", "b", 1), (8, None, None, None, None), (9, "", "", "", 0)]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus(5)
    return docs, items, spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def contaminated(docs, items, window=10):
    out = []
    for i, t, *_ in docs:
        w, hit, names = words(t), set(), set()
        for name, u in items:
            v = words(u)
            k = min(len(v), window)
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block,shard", [(1 << 22, 1 << 20), (25, 300)])
def test_decontamination(spark, tables, monkeypatch, block, shard):
    from roadweave.llm import suffix_decontaminate as S

    docs, items, df, it = tables
    key = lambda x: (x[0] is None, x)
    if shard != S.SHARD:  # the cut of long texts, in this process
        monkeypatch.setattr(S, "SHARD", shard)
        texts = [t for _, t, *_ in docs]
        hashes, at = S.terms_of(texts)
        block_ = S.Items([(str(k), S.terms_of([t])[0]) for k, t in items], 10)
        spans, _ = S.Shard(hashes, at, block_.longest).found(block_)
        assert [sum(b - a for a, b in s) for s in spans] == [x[2] for x in contaminated(docs, items)]
    got = S.occurrences(df.withColumn("digest", df["lang"]).withColumn("spans", df["lang"]), it, block=block)
    got = got.withColumn("hit", S.hit_words(got["spans"])).collect()
    found = [(r["doc_id"], r["n_words"], r["hit"], sorted({m["item_id"] for m in r["matches"]})) for r in got]
    assert sorted(found, key=key) == sorted(contaminated(docs, items), key=key)
    by = collections.defaultdict(list)
    for r in docs:
        by[hashlib.sha256((r[1] or "").encode()).digest()].append(words(r[1]))
    texts = {str(k) if k is not None else "": [words(t) for j, t in items if j == k] for k, _ in items}
    for r in got:
        w = by[bytes(r["digest"])][0]
        for m in r["matches"]:
            same = [v for v in texts[m["item_id"]] if v[m["item_word"] : m["item_word"] + m["words"]] == w[m["doc_word"] : m["doc_word"] + m["words"]]]
            assert same and m["words"] >= min(10, min(map(len, same)))
    longest = next(m for r in got if r["doc_id"] == 200 for m in r["matches"] if m["item_id"] == "5")
    assert longest["words"] >= len(words(items[5][1]))


def test_clean_documents_stay_whole(spark, tables):
    from roadweave.llm.suffix_decontaminate import decontaminate, occurrences

    docs, items, df, it = tables
    clean = decontaminate(df.withColumn("copies", df["lang"]), it)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = [d for d, c in zip(docs, contaminated(docs, items)) if not c[2]]
    assert sorted((tuple(r)[:5] for r in clean.collect()), key=key) == sorted(want, key=key) and clean.columns == [*df.columns, "copies"]
    none = it.where("false")
    assert decontaminate(df, none).count() == len(docs) and occurrences(df.where("false"), it).count() == 0


def test_suffix_array_is_in_order():
    from roadweave.llm.suffix_decontaminate import PACK, coded, suffix_array

    r = np.random.default_rng(1)
    for n, kinds, depth in ((1, 1, 3), (50, 2, 40), (400, 3, 12), (300, 1, 300)):
        words_ = r.integers(1, kinds + 1, n).astype(np.uint64)
        ends = np.sort(r.integers(0, n + 1, 3))
        ends[-1] = n
        full, packed = coded(words_, ends, depth + PACK)
        places = np.flatnonzero(full)
        order = suffix_array(packed, places, depth)
        _, code = np.unique(packed >> np.uint64(48), return_inverse=True)
        text = lambda p: [int(x) for x in code[p : p + depth]]  # noqa: B023, E731
        until = lambda s: s[: s.index(0)] if 0 in s else s
        keys = [until(text(p)) for p in order]
        assert sorted(order.tolist()) == places.tolist() and keys == sorted(keys)


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def proven(docs):
    """doc_id, leaf, subroot, root, proof digest, folded root, verified of every row."""
    groups = collections.defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(d) for d in sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))]) for g in names}
    top, out = climb([trees[g][-1][0] for g in names]), []
    for at, g in enumerate(names):
        for k, d in enumerate(sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))):
            changed = d if d[0] is None or zlib.crc32(str(d[0]).encode()) % 7 or d[4] is None else (*d[:4], d[4] + 1)
            siblings, h = [], leaf(changed)
            for levels, i in ((trees[g], k), (top, at)):
                for nodes in levels[:-1]:
                    j = i ^ 1
                    siblings += nodes[j : j + 1]
                    h = H(*(nodes[j : j + 1] + [h] if j < i else [h] + nodes[j : j + 1]))
                    i >>= 1
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], H(*siblings), h, h == top[-1][0]))
    return out


@pytest.mark.parametrize("n,ranges", [(1, 1), (37, 4), (700, 9)])
def test_merkle_manifest(spark, tmp_path, n, ranges):
    from roadweave.llm import merkle_manifest as M

    docs = corpus(n, n)[0]
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (x[0] is not None, *x[:1], *x[1:])
    got = [tuple(r) for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    want = proven(docs)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and key
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("leaf", M.F.lit("x")).withColumn("proof", M.F.lit("y"))
    # Many ranges, so that groups span them, and few nodes a task, so that they meet in blocks first.
    whole = M.manifest(df, M.FIELDS, ranges=ranges * 12, most=64)
    folded = whole.withColumn("folded", M.folded(M.F.col("leaf"), M.F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] == want[0][3] for r in folded) and sorted(repr((r["doc_id"], r["leaf"], r["subroot"])) for r in folded) == sorted(repr((w[0], w[1], w[2])) for w in want)
    assert M.manifest(df.where("false"), M.FIELDS).count() == 0


def test_subtrees_combine_in_blocks():
    from roadweave.llm import merkle_manifest as M

    for total, cuts in ((1, []), (2, [1]), (100, [3, 50, 51]), (257, list(range(5, 257, 9))), (64, [32])):
        nodes = [M.digest(str(k).encode()) for k in range(total)]
        height = M.height_of(total)
        levels = M.levels_of(nodes, height)
        tiles = [t for a, b in zip([0, *cuts], [*cuts, total]) for t in M.whole_subtrees(a, b, total)]
        assert [t[2] for t in tiles] == [0, *(t[3] for t in tiles)][:-1] and tiles[-1][3] == total
        made = [(level, i, M.levels_of(nodes[a:b], level)[-1][0]) for level, i, a, b in tiles]
        assert all(levels[level][i] == d for level, i, d in made)
        root, paths = M.combine(made, height, total)
        assert root == levels[-1][0]
        for (level, i, d), path in zip(made, paths):
            steps = [path[k : k + M.STEP] for k in range(0, len(path), M.STEP)]
            assert steps == [M.step(levels[at], i >> (at - level)) for at in range(level, height)]


def ranked(docs, items, k):
    bags = [collections.Counter(words(t)) for _, t, *_ in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total, out = sum(s > 0 for s in sizes), sum(sizes), []
    df = collections.Counter(t for b in bags for t in b)
    for name, text in items:
        scores = []
        for (i, *_), bag, size in zip(docs, bags, sizes):
            m = 50 + 50 * size * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(words(text)) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block,k", [(1 << 18, 50), (20, 7)])
def test_lexical_search(spark, tables, block, k):
    from roadweave.llm.lexical_search import LexicalIndex

    docs, items, df, it = tables
    index = LexicalIndex(df.withColumn("terms", df["lang"]))
    got = [tuple(r) for r in index.search(it.withColumn("rank", it["text"]), k, block).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0, x[3])
    assert sorted(got, key=key) == sorted(ranked(docs, items, k), key=key)
    assert index.search(it.where("item_id > 12 AND item_id < 15"), k).count() == 0
    assert LexicalIndex(df.where("false")).search(it, k).count() == 0 and index.search(it.where("false"), k).count() == 0


def test_best_is_safe_with_ties():
    from roadweave.llm.lexical_search import best

    r = np.random.default_rng(4)
    for n in (0, 1, 5, 60):
        score, ids, known = r.integers(0, 4, n), r.permutation(n), r.integers(0, 5, n) > 0
        want = sorted(np.flatnonzero(score > 0).tolist(), key=lambda j: (-score[j], not known[j], ids[j]))[:7]
        top = best(score, ids, known, 7).tolist()
        rank = lambda j: (-score[j], not known[j], ids[j])  # noqa: B023, E731
        assert sorted(map(rank, top)) == sorted(map(rank, want))
