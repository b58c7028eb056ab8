"""Large sets, split groups, clashing columns, damaged pages and independent twins of the models."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_edge_cases import SCHEMA, shingles, text


def components_of(sets):
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            low[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def compared(spark, rows):
    from roadweave.llm.jaccard_join import similar_groups

    got = {r["doc_id"]: r for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = components_of(sets)
    wrong = [i for i in sets if (got[i]["n_shingles"], got[i]["component_id"]) != (len(sets[i]), want[i])]
    assert not wrong
    return want


def test_jaccard_join_of_long_texts_near_the_threshold(spark):
    """Sampled levels and sets over 4,096 shingles: pairs with a similarity of 0.68 to 0.82."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(5000)]
    rows, i = [], 0
    for n in (200, 260, 400, 800, 1500, 3000, 6000, 20000):
        for k in range(5 if n < 5000 else 2):
            base = [r.choice(vocabulary) for _ in range(n)]
            rows.append((i, " ".join(base)))
            share = 0.68 + 0.14 * (k + 0.5) / 5
            # The last words are others, so that the share of shingles in common is about the wanted one.
            keep = round(2 * share / (1 + share) * n)
            rows.append((i + 1, " ".join(base[:keep] + [r.choice(vocabulary) for _ in range(n - keep)])))
            rows.append((i + 2, " ".join(base[n // 8 :])))
            i += 3
    want = compared(spark, rows)
    assert 20 < len(set(want.values())) < len(rows)


def test_jaccard_join_of_a_large_group(spark):
    """A family of 1,300 near copies, over a chunk of a key, which no single hub links, among texts that share one passage."""
    r = random.Random(6)
    passage, rows = text(r, 40), []
    base = text(r, 70).split()
    for k in range(1300):
        words = list(base)
        for _ in range(k % 4):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(2000 + k, f"{text(r, 60)} {passage}") for k in range(60)]
    compared(spark, rows)


def test_vectors_of_a_large_bucket(spark):
    """700 vectors so close that each bucket of theirs is split into chunks."""
    from roadweave.llm.embedding_dedup import near_duplicates

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=16) + r.normal(size=(700, 16)) * 0.12, r.normal(size=(100, 16))])
    for kind in ("float", "double"):
        own = x.astype(np.float32).astype(float) if kind == "float" else x
        got = {v["vec_id"]: v for v in near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").withColumnRenamed("vec_id", "vec_id")).collect()}
        u = own / np.linalg.norm(own, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        found = sum(got[k]["n_links"] for k in got)
        assert all(got[k]["n_links"] <= link[k].sum() - 1 for k in got)
        assert found >= 0.999 * (link.sum() - len(x))


def test_sentencepiece_null_characters(spark):
    import public_tokenizers
    import sentencepiece

    from roadweave.llm.sentencepiece_scan import Pieces, decode, encode, summary

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    texts = ["\0", "\0\0", "\0a", "a\0", "a \0 ", " \0", "\0 \0", "a\0\0b  ", "  ", " ", "\0" * 50]
    assert [np.frombuffer(i, "<u4").tolist() for i in m.encode(texts)] == [sp.encode(t) for t in texts]
    long = "ab \0 cd\0\0" * 60
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, long])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in summary(rows, path, chunk=64).collect()}
    for k, t in enumerate([*texts, long]):
        ids = np.array(sp.encode(t), "<u4")
        assert (got[k]["n_tokens"], got[k]["ids_crc32"], got[k]["text_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(t.encode())), repr(t)
    back = decode(encode(rows, path, 64), path).where("doc_id = 11").orderBy("chunk").collect()
    assert "".join(r["text"] for r in back) == long and len(back) > 2


def test_draws_are_exact_at_any_size():
    from roadweave.llm.mixing import drawn

    counts = np.array([500, 300, 0, 10, 1000])
    x = np.array([drawn(np.random.default_rng([1, k]), counts, 400) for k in range(3000)])
    assert (x.sum(1) == 400).all() and (x <= counts).all()
    share = counts / counts.sum()
    assert np.allclose(x.mean(0), 400 * share, atol=0.6)
    assert np.allclose(x.var(0), 400 * share * (1 - share) * (1810 - 400) / 1809, rtol=0.12, atol=0.2)
    many = np.array([10**13, 5 * 10**12, 7])
    got = drawn(np.random.default_rng(3), many, 6 * 10**12)
    assert got.sum() == 6 * 10**12 and abs(got[0] - 4 * 10**12) < 10**7


def test_token_files_roll_and_stay_in_order(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from roadweave.llm.common import shared_path, stored
    from roadweave.llm.token_files import TokenFile, read_token_files, write_token_files

    r = random.Random(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, text(r, r.randint(0, 60))) for k in range(300)] + [(300, text(r, 5000))]
    at = shared_path(spark, "t")
    files = stored(write_token_files(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS ids"), at, path, end_id=2, block=128, roll=2000), "files")
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t in rows:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(x) for x in read_token_files(spark, at, files).collect()) == want
    sizes = sorted((f["ids"], f["documents"]) for f in files.collect())
    # A file ends with the document that fills it: 1,000 ids and one of at most 60 words more. Only the giant document's file is longer.
    assert len(sizes) > 8 and sizes[-2][0] <= 1000 + 200 and sizes[-1][0] >= want[-1][2]
    # Random access within several files.
    found = {}
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(at).collect():
        whole = TokenFile(f["content"])
        for k, name in enumerate(whole.names.tolist()):
            found[name] = zlib.crc32(whole.document(k).astype("<u4").tobytes())
    assert found == {i: c for i, _, _, c in want}


def test_encoder_agrees_with_the_library():
    import public_tokenizers

    from roadweave.llm.token_files import Encoder

    e, r = Encoder(public_tokenizers.path("word_bpe_49k.json"), most=300), random.Random(5)
    signs = list("abcéèêßÿöàÀÉZ.,!?<|>'\"-_ \t\n12日️é̈ſKİıﬁ÷×þ\0\x1c\x85  ") + ["<|endoftext|>", "'s", "</w>"]
    for _ in range(20):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(200)]
        got = [np.frombuffer(i, "<u4").tolist() for i in e.encode(texts)]
        assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_clashing_columns(spark):
    """Operators bear columns of the input named like their own."""
    import public_tokenizers

    from roadweave.llm.embedding_dedup import near_duplicates
    from roadweave.llm.jaccard_join import similar_groups
    from roadweave.llm.mixing import Mixture
    from roadweave.llm.sentencepiece_scan import summary
    from roadweave.llm.warc import marked

    r = random.Random(9)
    rows = [(k, text(r, 80), "en", "ab"[k % 2], 1) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = docs.selectExpr("*", "1 AS spans", "2 AS size", "3 AS text_hash", "4 AS part", "5 AS row", "6 AS sid", "7 AS n", "8 AS component", "9 AS key", "10 AS ids", "11 AS chunk", "12 AS doc", "13 AS b_source")
    assert sorted(map(tuple, similar_groups(extra).collect())) == sorted(map(tuple, similar_groups(docs).collect()))
    plain = sorted((x["doc_id"], x["text"]) for x in Mixture(docs, block=8).documents().collect())
    mixed = Mixture(extra, block=8).documents()
    assert mixed.columns == extra.columns and sorted((x["doc_id"], x["text"]) for x in mixed.collect()) == plain
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sorted(map(tuple, summary(extra, path).collect())) == sorted(map(tuple, summary(docs, path).collect()))
    v = spark.createDataFrame([(k, [1.0 + k % 2, float(k % 3)], 1, "x", 2) for k in range(9)], "vec_id long, embedding array<double>, cid int, key string, rep int")
    assert near_duplicates(v).columns == ["vec_id", "n_links", "component_id", "kept"] and near_duplicates(v).count() == 9
    pages = spark.createDataFrame([(1, "u", "<p>a", 1), (2, "u", "<p>a", 1)], "page_id long, url string, html string, digest int")
    assert marked(pages).count() == 2


def test_quality_scores_are_the_gaussian_densities(spark):
    """A plain density by inverse and determinant, written apart, gives the scores of the factored one."""
    from roadweave.llm.quality import Discriminant, statistics, transformed

    r = random.Random(12)
    texts = [" ".join(x + "##" * (k % 3 == 0) for x in text(r, r.randint(3, 90)).split()) for k in range(400)]
    x = np.array([statistics(t) for t in texts])
    y = np.array([int(k % 3 != 0) if r.random() < 0.9 else int(k % 3 == 0) for k in range(400)])
    model = Discriminant.fit(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    z = (transformed(x) - transformed(x).mean(0)) / (transformed(x).std(0) + 1e-6)
    pooled = sum(np.cov(z[y == k].T) * (y == k).sum() for k in (0, 1)) / len(z)
    logs = []
    for k in (0, 1):
        c = 0.88 * np.cov(z[y == k].T) + 0.10 * pooled + 0.02 * np.eye(z.shape[1])
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    raw = 4 * np.arcsinh((logs[1] - logs[0]) / 4)
    want = 1 / (1 + np.exp(-(model.slope * np.clip(raw, -400, 400) + model.offset)))
    assert np.allclose(model.score(x), want, atol=1e-6)
    ties = model.score(np.array([statistics(t) for t in [texts[0], texts[0], "", None]]))
    assert ties[0] == ties[1] and ties[2] == ties[3]


def test_toxicity_scores_are_a_plain_forward_pass():
    """Word by word and filter by filter, without cached products or parts."""
    from roadweave.llm.toxicity import FILTERS, WIDTHS, TextNetwork, word_rows, words_of

    net = TextNetwork.start(4)
    r = random.Random(1)
    texts = [text(r, n) for n in (0, 1, 2, 3, 40, 500)] + [None, "", "  ", "Ka. lo!"]

    def plain(t):
        vectors = [net.table[word_rows(w)].sum(0) for w in words_of(t)] + [np.zeros(net.table.shape[1])] * 2
        out, first = net.offset, 0
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                at = [sum(vectors[p + j] @ net.filters[:, (first + j) * FILTERS + f] for j in range(width) if p + j < len(vectors)) for p in range(len(vectors))]
                out += max(0.0, max(at) + net.bias[k * FILTERS + f]) * net.out[k * FILTERS + f]
            first += width
        return 1 / (1 + np.exp(-out - net.shift))

    assert np.allclose(net.scorer(most=20).score(texts), [plain(t) for t in texts], atol=1e-4)
    assert len(set(net.scorer().score([texts[4]] * 3))) == 1


def other_layout(r):
    """A page of another family: nested tables and divs without telling names, line breaks for paragraphs. (html, words of the article, other words)"""
    said = lambda n: " ".join("".join(r.choices("aeioubdfklmnprst", k=r.randint(2, 9))) for _ in range(n))
    own, rest = [], []

    def keep(n):
        own.append(said(n) + ".")
        return own[-1]

    def other(n):
        rest.append(said(n))
        return rest[-1]

    top = " | ".join(f"<a href=/{k}>{other(2)}</a>" for k in range(r.randint(4, 8)))
    body = "".join(f"<div class=x{r.randint(1, 99)}><div>{keep(r.randint(20, 60))}<br><br>{keep(r.randint(20, 60))}</div></div>" if r.random() < 0.4 else f"<p>{keep(r.randint(15, 70))}</p>" for _ in range(r.randint(4, 9)))
    side = "".join(f"<li><a href=#>{other(3)}</a></li>" for _ in range(r.randint(4, 9)))
    foot = f"<footer><p>{other(8)}</p></footer>" if r.random() < 0.5 else f"<div><a href=/a>{other(1)}</a> <a href=/b>{other(2)}</a></div>"
    return f"<html><body><table><tr><td>{top}</td></tr></table><div><div><h1>{keep(5)}</h1>{body}</div></div><ul>{side}</ul>{foot}", own, rest


def test_html_of_another_layout_family():
    from roadweave.llm.html_extract import trained

    field, r = trained(), random.Random(21)
    hit = miss = extra = 0
    for _ in range(60):
        html, own, rest = other_layout(r)
        got = field.main_text(html)
        hit += sum(x in got for x in own)
        miss += sum(x not in got for x in own)
        extra += sum(x in got for x in rest)
    f1 = 2 * hit / (2 * hit + miss + extra)
    print(f"block F1 {f1:.3f}")
    assert f1 > 0.9


def test_html_deep_pages_and_open_comments():
    import time

    from roadweave.llm.html_extract import blocks

    begun = time.process_time()
    assert len(blocks("<div>x" * 8000)) == 8000
    assert time.process_time() - begun < 5
    assert [b.text for b in blocks("<p>A. <!-- c<p>Second</p><p>Third")] == ["A. Second", "Third"]
    assert [b.text for b in blocks("<p>A<!-- <p>hidden</p> -->B")] == ["AB"]
    assert blocks("<a>x<div>y</a>")[0].linked == 1


def test_index_of_another_session_and_failed_append(spark, tmp_path):
    from roadweave.llm.exact_dedup import DigestIndex

    at = f"file://{tmp_path}/index"
    first = DigestIndex(spark, at, 4)
    first.deduplicate(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    later = DigestIndex(spark.newSession(), at, 4)
    batch = later.spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in later.deduplicate(batch).collect()}
    assert got == {3: (1, False), 4: (4, True)}
    # A batch that comes again after its append changes nothing.
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in later.deduplicate(batch).collect()}
    assert again == got and later.entries().count() == 3


def test_pipeline_stages_bear_nulls_and_empty_tables(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    r = random.Random(5)
    rows = [(k, text(r, 50), "en", "a", 1) for k in range(6)] + [(7, None, None, None, None), (8, "", "en", None, 0), (None, text(r, 30), None, "b", 1)]
    for docs, some in ((spark.createDataFrame(rows, SCHEMA), True), (spark.createDataFrame([], SCHEMA), False)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, sf)
            found = out.count()
            assert found if some else not found, name


@pytest.mark.parametrize("n", [0, 1])
def test_warc_of_few_pages_and_a_long_payload(spark, n):
    from roadweave.llm.common import shared_path
    from roadweave.llm.warc import marked, read_warc, write_warc

    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 400_000, "x")][:n], "page_id long, url string, html string, record_type string")
    at = shared_path(spark, "w")
    write_warc(marked(pages), at).collect()
    got = read_warc(spark, at).where("status = 'ok'").collect()
    assert len(got) == n and all(g["payload_length"] == 2_000_003 for g in got)


@pytest.mark.parametrize("setting", ["4", "64", "80", "500"])
def test_mixture_does_not_depend_on_the_session(spark, setting):
    from roadweave.llm.mixing import op3_mix

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", setting)
    try:
        got = sorted(map(tuple, op3_mix(spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == MIXED.setdefault("rows", got) and len(got) == 200


MIXED: dict[str, list] = {}


def test_markup_of_any_kind_is_borne():
    import time

    from roadweave.llm.html_extract import blocks

    for page in ("<p>a<![foo]>b", "<p>a<![ y", "<p>a<![]>b", "<p>a<![1]>b", "<p>a<![-- x -->b", "<p>a<![&amp;", "<p>a<!x>b", "<p>a<?x>b"):
        assert " ".join(b.text for b in blocks(page)) in ("ab", "a"), page
    r = random.Random(6)
    parts = "<p> </p> <div> </div> <a> </a> <li> <ul> </ul> <td> <tr> <table> <br> <script> </script> <svg> </svg> <math> <head> </head> <body> <!-- --> <! <![ ]]> > < </ <a b=' \" = & &amp; &# x <template> <title> <desc>".split(" ")
    for _ in range(20_000):
        blocks("".join(r.choice(parts) for _ in range(r.randrange(25))))
    for unit in ("<a href=x>t<p>", "<div class=a>x</p>", "<a ", "</a ", "<!x ", "<svg><b>x"):
        begun = time.time()
        blocks(unit * 64_000)
        assert time.time() - begun < 20, unit


def test_field_against_enumeration():
    import itertools

    from roadweave.llm.html_extract import Block, Field, blocks, features

    r = np.random.default_rng(2)
    pages = ["<ul><li>home<li><a href=x>news</a></ul><article><p>One two three.<p>Four five six seven.</article><footer>© a</footer>", "<div>a b</div><p>c d e.<p>f <a>g</a>", "<p>only"]
    found = [blocks(p) for p in pages]
    names = sorted({f for page in found for b in page for f in features(b)})
    field = Field({f: k for k, f in enumerate(names)}, r.normal(size=(len(names), 2)), r.normal(size=(2, 2)))

    def score(page: list[Block], labels: tuple[int, ...], w, t) -> float:
        return sum(w[field.index[f], y] for b, y in zip(page, labels) for f in features(b)) + sum(t[a, b] for a, b in zip(labels, labels[1:]))

    for page in found:
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda y: score(page, y, field.weights, field.moves))
        assert field.decode(page) == list(best)
    # The fit's likelihood, by enumeration, is at its maximum: no small step along any weight raises it.
    truth = [[0, 0, 1, 1, 0][: len(found[0])], [0, 1, 1], [1]]
    truth = [y[: len(p)] + [0] * (len(p) - len(y)) for y, p in zip(truth, found)]
    fitted = Field.fit(list(zip(pages, truth)), rounds=3000, penalty=0.5, rate=0.02)
    field = Field(fitted.index, fitted.weights, fitted.moves)

    def objective(w, t) -> float:
        total = 0.0
        for page, y in zip(found, truth):
            every = [score(page, z, w, t) for z in itertools.product((0, 1), repeat=len(page))]
            total += score(page, tuple(y), w, t) - np.logaddexp.reduce(every)
        return total / len(found) - 0.5 * 0.5 / len(found) * ((w**2).sum() + (t**2).sum())

    base, h = objective(field.weights, field.moves), 1e-4
    for table in (field.weights, field.moves):
        for at in np.ndindex(table.shape):
            for sign in (h, -h):
                table[at] += sign
                assert objective(field.weights, field.moves) <= base + 1e-6, at
                table[at] -= sign


def test_other_tokenizers_get_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    from roadweave.llm.token_files import Encoder

    texts = ["Hello  World, it's\tFINE.", None, "", "á Ünï 12 <|endoftext|> x"]
    known = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    other.normalizer = normalizers.NFC()  # no folding of case
    other.save(str(tmp_path / "t.json"))
    own = Encoder(str(tmp_path / "t.json"))
    assert known.runs and not own.runs and not Encoder(public_tokenizers.path("byte_bpe_50k.json")).runs
    for encoder, tokenizer in ((known, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))), (own, other)):
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_digest_index_is_joined_by_merging(spark, tmp_path):
    from roadweave.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, f"file://{tmp_path}/index", 4)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index.deduplicate(docs).count()
    fresh = docs.selectExpr("unhex(sha2(cast(text as binary), 256)) AS digest").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and fresh.count() == 0
