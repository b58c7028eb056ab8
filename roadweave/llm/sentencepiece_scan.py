"""SentencePiece encoding and decoding of texts of any length, by a max-plus scan over chunks.

The pieces' merges define one valid segmentation of a text, and a segmentation is that one exactly if every two
neighbouring pieces are what merging their joined characters alone would give. (Merges happen in a
total order, by score and then place. As long as none has crossed a border between the pieces, the
merges inside of two neighbours are those of the pair alone; so the first crossing would show in the pair.) So the
segmentation is the only path of weight 0 in a graph whose states are pieces and whose steps weigh 0
between neighbours that agree and minus infinity otherwise. A chunk of a giant document is then a
max-plus matrix from the pieces that can lie over its left edge to those over its right edge. The
products of these matrices, which are associative, give the piece over every edge, and each chunk is traced on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import grouped, slices, stored, table

CHUNK = 16384  # characters of a giant document that one chunk holds
SPACE = "▁"
NEVER = np.float32(-np.inf)
State = tuple[int, int]  # where a piece begins and ends


class Pieces:
    """A SentencePiece BPE model without normalisation rules: its pieces, scores and ids, and units cached by their text."""

    def __init__(self, path: str, most: int = 120_000) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.sp.get_piece_size())
        plain = [i for i in ids if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.scores = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces that go on after a space, which no text can be cut at")
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.texts = np.empty(len(ids), object)
        self.texts[:] = b""
        for p, i in self.ids.items():
            self.texts[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.texts[i] = bytes([b])
        probe = " a  ①\tﬁ Ａe\u0301\n b "
        if b"".join(self.texts[self.sp.encode(probe)]) != f" {probe}".encode():
            raise ValueError("the model changes texts before it encodes them, or does not begin them with a space")
        self.most, self.cache = most, {}
        self.agree = lru_cache(1 << 18)(self._agree)

    def merged(self, chars: str) -> list[str]:
        parts = list(chars)
        while len(parts) > 1:
            scores = [self.scores.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            k = int(np.argmax(scores))
            if scores[k] == NEVER:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _agree(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def units(self, text: str) -> list[str]:
        """Parts of a text without SPACE signs that encode on their own: each begins with the spaces before its word; as many SPACE signs stand for spaces at the end."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        out.append(" " * run + parts[-1] if parts[-1] else SPACE * (run + 1))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; an empty text has none. The model takes a SPACE sign in a text for a space."""
        split = [self.units(t.replace(SPACE, " ")) if t else [] for t in texts]
        need = set().union(*split).difference(self.cache) if split else set()
        if len(self.cache) + len(need) > self.most:
            self.cache.clear()
            need = set().union(*split)
        fresh = list(need)
        for at in range(0, len(fresh), 4_000):
            part = fresh[at : at + 4_000]
            # A unit of spaces alone stands at a text's end; it has no word for the space that begins a text to belong to.
            found = self.sp.encode([" " * (len(u) - 1) if u.startswith(SPACE) else u for u in part], num_threads=1)
            for u, ids in zip(part, found):
                if u.startswith(SPACE):
                    ids = ids or [self.ids[SPACE]]
                self.cache[u] = np.array(ids, dtype="<u4").tobytes()
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes, first: bool = True) -> str:
        text = b"".join(self.texts[np.frombuffer(ids, "<u4")]).decode("utf-8", "replace")
        return text[1:] if first and text.startswith(" ") else text

    # From here on texts are in the model's own form: a SPACE for each space, and one at the start of a document.

    def over(self, s: str, p: int) -> list[State]:
        """All pieces that begin before p and end at p or after it, in order."""
        out = [(a, e) for a in range(max(0, p - self.longest), p) for e in range(p, min(len(s), a + self.longest) + 1) if s[a:e] in self.ids]
        return sorted(out) if (p - 1, p) in out else sorted([*out, (p - 1, p)])

    def paths(self, s: str, start: State, stop: int) -> dict[State, State | None]:
        """All pieces before stop that agreeing steps reach from a piece, each with the one before it; start may be empty, for a fresh start."""
        back: dict[State, State | None] = {start: None}
        ending: dict[int, list[State]] = {start[1]: [start]}
        for p in range(start[1], stop):
            for a, e in ending.pop(p, ()):
                left = s[a:e]
                for n in range(1, min(self.longest, len(s) - p) + 1):
                    right = s[p : p + n]
                    if (n == 1 or right in self.ids) and (p, p + n) not in back and self.agree(left, right):
                        back[p, p + n] = (a, e)
                        ending.setdefault(p + n, []).append((p, p + n))
        return back

    def cuts(self, s: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place from low to high at which a word's end meets a space; every segmentation has a border there."""
        found = [s.find(SPACE, low, high)]
        while found[0] > 0 and s[found[0] - 1] == SPACE:
            found[0] = s.find(SPACE, found[0] + 1, high)
        if found[0] <= 0:
            return None
        last = s.rfind(SPACE, low, high)
        while s[last - 1] == SPACE:
            last = s.rfind(SPACE, low, last)
        return found[0], last

    def transfer(self, s: str, p: int, q: int, starts: bool, ends: bool) -> np.ndarray:
        """The chunk's max-plus matrix: 0 from a piece over its left edge p to one over its right edge q if a path leads there."""
        left = [(p, p)] if starts else self.over(s, p)
        right = self.over(s, q)
        out = np.full((len(left), len(right)), NEVER, np.float32)
        cut = self.cuts(s, max(p + 1, max(e for _, e in left)), q)
        fits = (lambda st: st[1] == q) if ends else (lambda st: True)
        if cut:
            rows = [any(e == cut[0] for _, e in self.paths(s, st, cut[0])) for st in left]
            back = self.paths(s, (cut[1], cut[1]), q)
            cols = [st in back and fits(st) for st in right]
            out[np.ix_(rows, cols)] = 0
        else:
            for i, st in enumerate(left):
                back = self.paths(s, st, q)
                out[i, [j for j, r in enumerate(right) if r in back and fits(r)]] = 0
        return out

    def trace(self, s: str, p: int, q: int, starts: bool, first: int, last: int) -> bytes:
        """The ids of the pieces that begin in the chunk, between the given pieces over its edges."""
        left = ([(p, p)] if starts else self.over(s, p))[first]
        right = self.over(s, q)[last]
        cut = self.cuts(s, max(p + 1, max(e for _, e in ([(p, p)] if starts else self.over(s, p)))), q)

        def walk(back: dict[State, State | None], at: State) -> list[int]:
            found = []
            while back[at] is not None:
                found.append(s[slice(*at)])
                at = back[at]
            return [i for x in reversed(found) for i in self.ids_of(x)]

        if not cut:
            return np.array(walk(self.paths(s, left, q), right), "<u4").tobytes()
        back = self.paths(s, left, cut[0])
        head = walk(back, next(st for st in back if st[1] == cut[0] and st[0] < cut[0]) if left[1] != cut[0] else left)
        body = self.encode([s[cut[0] + 1 : cut[1]].replace(SPACE, " ")])[0] if cut[1] > cut[0] else b""
        tail = walk(self.paths(s, (cut[1], cut[1]), q), right)
        return np.array(head, "<u4").tobytes() + body + np.array(tail, "<u4").tobytes()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def scanned(parts: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairing neighbours, scanning the pairs and filling in between: a logarithmic depth of associative products."""
    if len(parts) < 2:
        return list(parts)
    pairs = scanned([times(a, b) for a, b in zip(parts[::2], parts[1::2])])
    out = [parts[0]]
    for k in range(1, len(parts)):
        out.append(pairs[k // 2] if k % 2 else times(pairs[k // 2 - 1], parts[k]))
    return out


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of encoded_parts in one table."""
    short, parts = encoded_parts(docs, model, chunk, doc_id, text)
    return short.unionByName(parts)


_PARTS = "doc_id long, doc long, chunk int, chunks int, ids binary"
Batches = Iterator[pa.RecordBatch]


def encoded_parts(docs: DataFrame, model: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text", then: Callable[[Batches], Batches] = lambda rows: rows, schema: str = _PARTS) -> tuple[DataFrame, DataFrame]:
    """Two tables, of documents of one chunk and of longer ones: doc_id, doc (a number of the row, for documents of several chunks), chunk, chunks, ids (binary, little-endian unsigned 32-bit).

    A row per document of up to `chunk` characters, and per chunk of a longer one: document order is by chunk, and the chunks' ids
    joined are the ids of the whole text. A null text counts as empty and has a row without ids. Rows that repeat stay apart. A chunk is never
    shorter than the longest piece. The model path must be readable on the executors; other columns are not read. then makes
    batches of the given schema of those of both tables, in the same Python worker.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _pieces(model)
        for part in slices(batches, "text", 1 << 20):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(m.encode(part.column("text").to_pylist()), pa.binary())],
                names=["doc_id", "doc", "chunk", "chunks", "ids"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lap = _pieces(model).longest
        step = max(chunk, 2 * lap)
        for part in slices(batches, "text"):
            for i, doc, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "doc", "text"))):
                s = SPACE + t.replace(" ", SPACE)
                edges = list(range(0, max(1, len(s) - lap), step)) + [len(s)]
                for k in range(0, len(edges) - 1, 64):
                    own = list(enumerate(zip(edges[k : k + 65], edges[k + 1 : k + 65]), k))
                    low = [max(0, p - lap) for _, (p, _) in own]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([i] * len(own), pa.int64()),
                            "doc": pa.array([doc] * len(own), pa.int64()),
                            "chunk": pa.array([j for j, _ in own], pa.int32()),
                            "chunks": pa.array([len(edges) - 1] * len(own), pa.int32()),
                            "p": pa.array([p - a for a, (_, (p, _)) in zip(low, own)], pa.int32()),
                            "q": pa.array([q - a for a, (_, (_, q)) in zip(low, own)], pa.int32()),
                            "s": pa.array([s[a : q + lap] for a, (_, (_, q)) in zip(low, own)]),
                        }
                    )

    wide = "doc_id long, doc long, chunk int, chunks int, p int, q int, s string"
    giant = rows.where(F.col("n_chars") > chunk).select("doc_id", F.monotonically_increasing_id().alias("doc"), "text")
    pieces = stored(giant.mapInArrow(cut, wide), "chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _pieces(model)
        for part in batches:
            found = [m.transfer(s, p, q, k == 0, k == n - 1) for s, p, q, k, n in zip(*(part.column(c).to_pylist() for c in ("s", "p", "q", "chunk", "chunks")))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("chunk"), pa.array([f.shape[0] for f in found], pa.int32()), pa.array([(f == 0).tobytes() for f in found], pa.binary())], names=["doc", "chunk", "states", "steps"])

    def scan(whole: pa.Table) -> pa.RecordBatch:
        """Of each document's chunks the numbers of the pieces over their edges, from the prefix products forward and a choice backward."""
        doc, chunks, states, steps = (whole.column(c) for c in ("doc", "chunk", "states", "steps"))
        doc_of, states = doc.to_numpy(), states.to_numpy()
        bounds = np.flatnonzero(np.append(True, doc_of[1:] != doc_of[:-1])).tolist() + [len(doc_of)]
        firsts, lasts = np.zeros(len(doc_of), np.int32), np.zeros(len(doc_of), np.int32)
        for a, b in zip(bounds, bounds[1:]):
            parts = [np.where(np.frombuffer(steps[k].as_py(), bool).reshape(states[k], -1), np.float32(0), NEVER) for k in range(a, b)]
            prefix = scanned(parts)
            last = int(prefix[-1][0].argmax())
            for k in range(b - 1, a - 1, -1):
                before = prefix[k - a - 1][0] if k > a else np.zeros(1, np.float32)
                lasts[k] = last
                firsts[k] = last = int((before + parts[k - a][:, last]).argmax())
        return pa.RecordBatch.from_arrays([doc.combine_chunks(), chunks.combine_chunks(), pa.array(firsts), pa.array(lasts)], names=["doc", "chunk", "first", "last"])

    steps = pieces.mapInArrow(transfers, "doc long, chunk int, states int, steps binary")
    edges = stored(grouped(steps, ["doc"], scan, "doc long, chunk int, first int, last int", order=["chunk"]), "edges")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _pieces(model)
        for part in slices(batches, "s", 1 << 20):
            cols = [part.column(c).to_pylist() for c in ("s", "p", "q", "chunk", "first", "last")]
            ids = [m.trace(s, p, q, k == 0, f, e) for s, p, q, k, f, e in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "doc", "chunk", "chunks")), pa.array(ids, pa.binary())], names=["doc_id", "doc", "chunk", "chunks", "ids"])

    parts = pieces.join(edges, ["doc", "chunk"]).select("doc_id", "doc", "chunk", "chunks", "p", "q", "s", "first", "last")
    return rows.where(F.col("n_chars") <= chunk).mapInArrow(lambda b: then(small(b)), schema), parts.mapInArrow(lambda b: then(trace(b)), schema)


def decoded(batches: Batches, model: str) -> Batches:
    """The batches with a text, the characters of each row's ids."""
    m = _pieces(model)
    for part in slices(batches, "ids"):
        found = [m.decode(i or b"", k == 0) for i, k in zip(part.column("ids").to_pylist(), part.column("chunk").to_pylist())]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds text, the characters of each row's ids; a document's rows joined by chunk are its text. A null or empty ids gives an empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(f for f in encoded.schema.fields if f.name != "text"), StructField("text", StringType())])
    return encoded.drop("text").mapInArrow(lambda b: decoded(b, model), schema)


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings joined, from theirs and the second one's length: the first is carried over that many zero bytes."""
    times = lambda m, v: _xor(m[k] for k in range(32) if v >> k & 1)
    step = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        step = [times(step, x) for x in step]
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        length >>= 1
    return first ^ second


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def summary(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_chunks, n_tokens, ids_crc32 (of all ids as little-endian unsigned 32-bit integers), text_crc32 (of the decoded text) of every document.

    Each chunk is encoded, decoded and summed up on its own; only the sums of documents of several chunks are brought together.
    """
    out = "doc_id long, doc long, chunk int, n_chars long, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long"

    def sums(batches: Batches) -> Batches:
        for part in decoded(batches, model):
            ids, texts = part.column("ids").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]
            cols = [[len(t) for t in part.column("text").to_pylist()], [len(i) // 4 for i in ids], map(zlib.crc32, ids), map(len, texts), map(zlib.crc32, texts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "doc", "chunk")), *(pa.array(list(c), pa.int64()) for c in cols)], names=[c.split()[0] for c in out.split(", ")])

    short, parts = encoded_parts(docs, model, chunk, then=sums, schema=out)

    def join(t: pa.Table) -> pa.RecordBatch:
        rows: dict[int, list[int]] = {}
        for doc, i, chars, tokens, ids_sum, size, text_sum in zip(*(t.column(c).to_pylist() for c in ("doc", "doc_id", "n_chars", "n_tokens", "ids_crc32", "n_bytes", "text_crc32"))):
            if doc not in rows:
                rows[doc] = [i, 0, 0, 0, 0, 0]
            r = rows[doc]
            r[1:] = [r[1] + chars, r[2] + 1, r[3] + tokens, joined_crc(r[4], ids_sum, 4 * tokens), joined_crc(r[5], text_sum, size)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows.values())], names=["doc_id", "n_chars", "n_chunks", "n_tokens", "ids_crc32", "text_crc32"])

    result = "doc_id long, n_chars long, n_chunks long, n_tokens long, ids_crc32 long, text_crc32 long"
    whole = short.select("doc_id", "n_chars", F.lit(1).cast("long").alias("n_chunks"), "n_tokens", "ids_crc32", "text_crc32")
    return whole.unionByName(grouped(parts, ["doc"], join, result, order=["chunk"]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checksums of every document, from its encoded and decoded chunks, as summary gives them."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return summary(table(spark, sf_dir, "documents"), model)
