"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

WORDS = [a + b for a in "ka to ri ne mu".split() for b in "lo si ta ve".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = text(r, 120)
    out = [(1, base, "en", "a", 1), (2, base, None, None, None), (3, base + " tail", "de", "b", 2), (3, base + " tail", "de", "b", 2), (4, None, None, "a", None), (5, "", "en", "c", 0), (6, "one two", "en", "c", 0), (7, "ONE two", "en", "c", 0), (None, "ka lo", None, "a", 1), (9, text(r, 30000), "en", "a", 1), (10, "é 　x\ty\n", "fr", "b", 1)]
    for k in range(40):
        words = base.split()
        for _ in range(k % 9):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append((20 + k, " ".join(words), "en", "abc"[k % 3], 1))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_exact_dedup(spark, docs, rows, empty, tmp_path):
    from roadweave.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, f"file://{tmp_path}/index", 4)
    got = index.deduplicate(docs.withColumnRenamed("n_chars", "kept")).collect()
    size = collections.Counter(t or "" for _, t, *_ in rows)
    keep = {}
    for i, t, *_ in rows:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for x in got:
        t = x["text"] or ""
        want = keep[t] if keep[t] >= 0 else None
        assert (x["keep_id"], x["group_size"], x["kept"]) == (want, size[t], x["doc_id"] == want)
        assert x["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    more = spark.createDataFrame([(900, rows[0][1]), (901, "brand new"), (902, "brand new")], "doc_id long, text string")
    later = {x["doc_id"]: x for x in index.deduplicate(more).collect()}
    assert not later[900]["kept"] and later[900]["keep_id"] == keep[rows[0][1]]
    assert later[902]["kept"] and not later[901]["kept"]
    assert index.entries().count() == len(size) + 1
    assert index.deduplicate(empty).count() == 0


def test_jaccard_join(spark, docs, rows, empty):
    from roadweave.llm.jaccard_join import similar_groups

    got = {x["doc_id"]: x for x in similar_groups(docs).collect() if x["doc_id"] is not None}
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), find(i)), i
    assert similar_groups(empty).count() == 0


def test_signature_tree_finds_every_similar_pair():
    from roadweave.llm.jaccard_join import bitmap
    from roadweave.llm.signature_tree import SignatureTree

    r = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(r.integers(1, 5)):
            s = base.copy()
            k = int(r.integers(0, 25))
            s[:k] = r.integers(0, 2**63, k).astype(np.uint64)
            sets.append(np.unique(s))
    bits = np.frombuffer(b"".join(map(bitmap, sets)), np.uint64).reshape(len(sets), -1)
    tree = SignatureTree(bits, np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = {frozenset(p) for p in zip(*map(np.ndarray.tolist, tree.pairs(0.75)))}
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if both / (len(sets[a]) + len(sets[b]) - both) >= 0.75:
            assert frozenset((a, b)) in found


def test_mixing(spark, docs, rows, empty):
    from roadweave.llm.mixing import Mixture, permuted, targets

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    m = Mixture(docs, block=16)
    a, b = (sorted(map(tuple, m.taken().collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(rows)
    by = collections.Counter()
    for doc, source, size, source_size, target, taken in a:
        assert taken <= 2 * size
        by[source] += taken
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sizes[s] for s in order], [5, 2, 1, 5])))
    for s in order:
        assert abs(by[s] - want[s]) <= 32, s
    mixed = m.documents().collect()
    assert sum(count(x["text"]) for x in mixed) == sum(x[5] for x in a)
    assert Mixture(empty).taken().count() == 0 and Mixture(empty).documents().count() == 0
    for n in (1, 2, 7, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_embeddings(spark):
    from roadweave.llm.embedding_dedup import near_duplicates

    r = np.random.default_rng(5)
    base = r.normal(size=(6, 16))
    vec = [(k, (base[k % 6] * (1 + k % 3) + r.normal(size=16) * 0.1).tolist()) for k in range(60)] + [(100 + k, base[0].tolist()) for k in range(5)]
    bad = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, []), (205, [float("inf")] + [1.0] * 15), (206, [1.0] * 3), (101, base[0].tolist())]
    got = near_duplicates(spark.createDataFrame(vec + bad, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(vec) + len(bad)
    x = np.array([v for _, v in vec] + [base[0].tolist()], dtype=np.float32).astype(float)
    ids = [k for k, _ in vec] + [101]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    low = list(range(len(x)))
    for _ in range(len(x)):
        low = [min(low[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
    for row in got:
        if row["vec_id"] in ids:
            i = ids.index(row["vec_id"])
            assert row["n_links"] == link[i].sum() - 1
            assert row["component_id"] == min(ids[j] for j in range(len(x)) if low[j] == low[i])
        else:
            assert (row["n_links"], row["component_id"], row["kept"]) == (0, row["vec_id"], True)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sentencepiece(spark, docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    from roadweave.llm.sentencepiece_scan import encode, summary

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = rows + [(300, "x" * 400 + "日本語 " * 90, "ja", "a", 1), (301, " lead  and trail  ", "en", "a", 1), (302, "▁ ▁a", "en", "a", 1)]
    got = sorted(map(tuple, summary(spark.createDataFrame(texts, SCHEMA), path, chunk=64).collect()), key=str)
    want = []
    for i, t, *_ in texts:
        ids = sp.encode(t or "")
        plain = (t or "").replace("▁", " ")
        want.append((i, len(plain), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(plain.encode())))
    assert [(a, b, d, e, f) for a, b, _, d, e, f in got] == sorted(want, key=str)
    assert max(x[2] for x in got) > 100
    assert encode(docs, path, 64).where("doc_id = 9").count() > 100
    assert summary(empty, path).count() == 0


def test_token_files(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from roadweave.llm.common import shared_path
    from roadweave.llm.token_files import TokenFile, file_parts, read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for table in (docs, empty):
        at = shared_path(spark, "t")
        stats = spark.createDataFrame(write_token_files(table, at, path, end_id=2).collect(), "shard int, piece int, documents long, ids long, bytes long")
        got = sorted((tuple(r) for r in read_token_files(spark, at, stats).collect()), key=lambda r: r[1])
        start, want = 0, []
        for i, t, *_ in sorted(rows if table is docs else [], key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
    r = np.random.default_rng(1)
    for vocabulary in (2, 37, 256, 49408, 100000, 1 << 20):
        lots = [r.integers(0, vocabulary, n).astype("<u4") for n in (0, 1, 5000, 0, 20000, 3)]
        data = b"".join(file_parts(((k, x.tobytes()) for k, x in enumerate(lots)), vocabulary, 512))
        f = TokenFile(data)
        assert all((f.document(k) == x).all() and len(f.document(k)) == len(x) for k, x in enumerate(lots))
        assert (f.ids(4000, 4100) == np.concatenate(lots)[4000:4100]).all()
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        TokenFile(bytes(broken)).ids(0, 600)


def test_warc_round_trip_and_salvage(spark):
    from roadweave.llm.common import shared_path
    from roadweave.llm.warc import marked, read_warc, record_bytes, salvage, write_warc

    html = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "WARC/1.1\r\n\r\n" * 5), (6, "u", "é" * 5000), (6, "u", "é" * 5000)]
    for compress in (True, False):
        at = shared_path(spark, "w")
        pages = spark.createDataFrame(html, "page_id long, url string, html string")
        write_warc(marked(pages), at, compress=compress).collect()
        got = sorted((int(r["record_id"]), r["payload_length"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_warc(spark, at).where("status = 'ok'").collect())
        sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        top = {}
        for i, _, h in html:
            top[h or ""] = max(top.get(h or "", 0), i)
        assert got == sorted((i, len((h or "").encode()), sha(h), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else str(top[h or ""])) for i, _, h in html)
    import gzip

    records = [record_bytes(k, "u", bytes([65 + k]) * 3000, None, "2024-01-01T00:00:00Z") for k in range(6)]
    for data, spoil in ((b"".join(map(gzip.compress, records)), 12), (b"".join(records), 900)):
        size = [len(gzip.compress(r)) if spoil == 12 else len(r) for r in records]
        whole = [x for x in salvage(data) if x[2] is not None]
        assert len(whole) == 6
        bad = bytearray(data)
        bad[sum(size[:2]) + spoil] ^= 0xFF
        found = list(salvage(b"junk" + bytes(bad[:-5])))
        assert [x[2]["warc-page-id"] for x in found if x[2]] == ["0", "1", "3", "4"]
        assert sum(x[1] for x in found) == len(bad) - 1
        assert {x[0] for x in found if x[2] is None} >= {0, 4 + sum(size[:2])}


def test_quality_and_toxicity(spark):
    from roadweave.llm.quality import fit_quality, score_quality
    from roadweave.llm.toxicity import fit_toxicity, score_toxicity, with_decision

    r = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        t = text(r, r.randint(5, 60))
        toxic, junk = k % 4 == 0, k % 5 == 0
        if toxic:
            w = t.split()
            w.insert(r.randrange(len(w)), r.choice(["vile", "grub"]) + r.choice(["", "x", "yz"]))
            t = " ".join(w)
        rows.append((k, " ".join(x + "###" for x in t.split()) if junk else t, "en" if k % 2 else None, "extra"))
        labels.append((k, int(not junk), int(toxic)))
    rows += [(9000, None, None, None), (9001, "", "xx", None), (None, "ka lo", "en", None), (9002, text(r, 20000), "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame(labels + [(9000, None, None)], "doc_id long, quality int, toxic int")
    for fit, score, col, least in ((fit_quality, score_quality, 1, 0.97), (fit_toxicity, score_toxicity, 2, 0.9)):
        got = score(docs, fit(docs, lab), "score").collect()
        assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
        held = [(x["score"] >= 0.5) == labels[x["doc_id"]][col] for x in got if x["doc_id"] is not None and x["doc_id"] < 600 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
        assert np.mean(held) >= least
        model = fit(docs, lab.limit(0))
        assert score(docs, model, "score").count() == len(rows)
        assert score(docs.limit(0), model, "score").count() == 0
    assert with_decision(score_toxicity(docs, model), model).where("toxic_by_lang IS NULL").count() == 0


def test_html(spark):
    from roadweave.llm.html_extract import blocks, extract, trained
    from roadweave.llm.html_pages import training_pages

    f = trained()
    right = total = 0
    for h, y in training_pages(120, seed=99):
        p = f.decode(blocks(h))
        total += len(y)
        right += sum(a == b for a, b in zip(p, y))
    assert right / total > 0.99
    long = "<p>" + "word " * 50000 + "</p>"
    pages = [
        (1, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two\n three. <script>bad()</script>Four.<p>Five six seven.</article><div class=ad>Buy now this thing.</div><footer>&copy; me</footer>"),
        (2, None, None),
        (3, "u", ""),
        (4, "u", "<<<>>&#xZZ; <div"),
        (5, "u", f"<article>{long}</article>"),
    ]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text"), f).collect()}
    assert got[1]["text"] == "T & U One two three. Four. Five six seven."
    assert got[2]["text"] == got[3]["text"] == "" and got[5]["n_chars"] == 249999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), f).count() == 0


def test_html_unclosed_unseen_elements():
    from roadweave.llm.html_extract import blocks

    def texts(h):
        return [b.text for b in blocks(h)]

    assert texts("<html><head><title>T</title><p>Article one.<p>Two.") == ["Article one.", "Two."]
    assert texts("<head><meta charset=x><noscript><img></noscript><style>s</style>Bare text.") == ["Bare text."]
    assert texts("<head><title>T<meta></head><body><p>A") == ["A"]
    assert texts("<head><title>T<p>A")[-1] == "A"
    for tag in ("svg", "math", "object", "iframe", "canvas", "audio", "video", "noscript", "template"):
        assert texts(f"<body><div><{tag}></div><p>A</p><p>B</p>") == ["A", "B"], tag
        assert texts(f"<body><{tag}><p>A</p><p>B</p></body>") == ["A", "B"], tag
        assert texts(f"<body><p>A <{tag}>hidden</{tag}>B</p>") == ["A B"], tag
    assert texts("<p>A</p><svg><foreignObject><div>hidden</div></foreignObject></svg><p>B") == ["A", "B"]
    assert texts("<div><video>hidden</div></video><p>A") == ["A"]
    assert texts("<p>A<video><p>hidden</p></video>B") == ["A", "B"]
    assert [b.tags for b in blocks("<article><p>A<object><param></object>")] == [("article", "p")]
    assert texts("<p>A<script>unclosed <p>B") == ["A"]
