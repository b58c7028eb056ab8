"""Each stage of the pipeline against a brute-force version, on its own input."""

import collections
import itertools
import re
import zlib

import numpy as np

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_stages(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as p

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        seen.append((before, after))
        assert k == 4 or docs.columns == columns, name
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen[0]
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for i, q in good.items() if q == 1 and i in {r["doc_id"] for r in before})
    assert kept < {r["doc_id"] for r in before}
    before, after = seen[1]
    last = {}
    for r in before:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())
    before, after = seen[2]
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for r in before:
        w = r["text"].encode().translate(fold).split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in sets if low[i] == i)
    before, after = seen[3]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    taken = collections.Counter()
    for r in after:
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(taken[i] <= 2 * n for i, n in size.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 64 * 21
    before, after = seen[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(sp.encode(r["text"])), zlib.crc32(np.array(sp.encode(r["text"]), "<u4").tobytes()), zlib.crc32(r["text"].encode())) for r in before)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["text_crc32"]) for r in after) == want
