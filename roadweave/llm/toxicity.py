"""Toxicity classifier: a convolutional network over hashed word embeddings, trained in numpy by parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, held_out, slices, table
from roadweave.llm.labelled import labelled_rows

ROUNDS = (2, 4)  # times that each training text is learnt from: at least, and at most where texts are few
VISITS = 16_384  # texts to learn from in all rounds together, below which there are more than the fewest rounds
PART = 4096  # training texts that one task learns from in a round, while there are at most PARTS such parts
PARTS = 256
BLOCK = 512  # rows of the embedding table that are averaged together
TOGETHER = 16_384  # words that are scored together
PIECE = 1 << 18  # bytes of texts whose words are hashed together
NO_WORD = -1  # the key of an empty word
GRID = 4096  # steps of scores between which thresholds are sought
BUCKETS = 1 << 14  # rows of the embedding table
DIM = 12
WIDTHS = (1, 2, 3)  # words that a filter spans
FILTERS = 10  # of each width
_STRIP = b".,;:?!'\"()[]{}|*#%&$-_"
_SPACE, _TRIMMED = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", _STRIP))
_FIRST = np.tri(15, 14, -1, np.uint8)  # ones at the first k of 14 places
_END = object()


def word_rows(word: bytes) -> list[int]:
    """Rows of the embedding table for a word: itself, and its first three, four and five bytes as marked prefixes."""
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in (b"w" + word, b"p3" + word[:3], b"p4" + word[:4], b"p5" + word[:5])]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: lower-cased, between white space, without marks at their ends."""
    return [w.strip(_STRIP) for w in (text or "").lower().encode("utf-8", "replace").split()]


def short_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxh32 of each row's first bytes, fewer than 16; the rows are padded with zeros to 4, 8 or 16 bytes."""
    turned = lambda h, k: (h << np.uint32(k)) | (h >> np.uint32(32 - k))
    p1, p2, p3, p4, p5 = map(np.uint32, (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    h = p5 + lengths.astype(np.uint32)
    for k, lane in enumerate(np.ascontiguousarray(data).view("<u4").T):
        h = np.where(lengths >= 4 * k + 4, turned(h + lane * p3, 17) * p4, h)
    last = lengths // 4 * 4
    for k in range(3):
        more = np.flatnonzero(lengths - last > k)
        h[more] = turned(h[more] + data[more, last[more] + k].astype(np.uint32) * p5, 11) * p1
    h = (h ^ (h >> np.uint32(15))) * p2
    h = (h ^ (h >> np.uint32(13))) * p3
    return h ^ (h >> np.uint32(16))


def word_keys(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the keys of its words, which words_of gives. A key is a word's four rows of the embedding table in one number, which is all that a network sees of it, or NO_WORD.

    The texts are worked together, in pieces of about PIECE bytes that end at white space; words of over 14 bytes are hashed one by one.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(raw)
    data, keys, places, at = np.frombuffer(joined, np.uint8), [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            ahead = _SPACE[data[end : end + 4096]]
            end += int(ahead.argmax()) if ahead.any() else len(ahead)
        b = data[at:end]
        edge = np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        inner = ~(_SPACE | _TRIMMED)[b]
        kept, before = np.flatnonzero(inner), np.append(0, np.cumsum(inner))
        i, j = before[starts], before[ends]
        found = np.flatnonzero(j > i)
        first = kept[i[found]]
        n = kept[j[found] - 1] + 1 - first
        own = np.lib.stride_tricks.sliding_window_view(np.append(b, np.zeros(14, np.uint8)), 14)[first] * _FIRST[np.minimum(n, 14)]
        key = np.zeros(len(found), np.int64)
        for mark, most in ((b"w", 14), (b"p3", 3), (b"p4", 4), (b"p5", 5)):
            rows = np.zeros((len(found), 16 if most > 5 else 8), np.uint8)
            rows[:, : len(mark)] = np.frombuffer(mark, np.uint8)
            rows[:, len(mark) : len(mark) + most] = own[:, :most]
            key = key * BUCKETS + (short_hashes(rows, np.minimum(n, most) + len(mark)) % np.uint32(BUCKETS)).astype(np.int64)
        for k in np.flatnonzero(n > 14).tolist():
            key[k] = key[k] % BUCKETS**3 + word_rows(joined[at + first[k] : at + first[k] + n[k]])[0] * BUCKETS**3
        out = np.full(len(starts), NO_WORD)
        out[found] = key
        keys.append(out)
        places.append(starts + at)
        at = end
    every, where = (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.split(every, np.searchsorted(where, np.cumsum([len(r) + 1 for r in raw])[:-1]))[: len(raw)]


def rows_of(keys: np.ndarray) -> np.ndarray:
    """The four rows of each key."""
    rows = (keys[:, None] // BUCKETS ** np.arange(3, -1, -1)) % BUCKETS
    rows[keys == NO_WORD] = word_rows(b"")
    return rows


def window_sums(products: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filters by places: the value of each filter over the words of ids that begin at a place. Each look-up reads one short row, that of a filter's position."""
    columns = np.ascontiguousarray(products.T)
    out, at = np.empty((len(WIDTHS) * FILTERS, len(ids)), np.float32), 0
    for k, width in enumerate(WIDTHS):
        total = out[k * FILTERS : (k + 1) * FILTERS]
        total[:] = columns[at * FILTERS : (at + 1) * FILTERS].take(ids, axis=1)
        for j in range(1, width):
            total[:, :-j] += columns[(at + j) * FILTERS : (at + j + 1) * FILTERS].take(ids[j:], axis=1)
        at += width
    return out


@dataclass
class TextNetwork:
    """Filters of several widths over word vectors, rectified and max-pooled over the whole text, then one logistic unit.

    A word's vector is the sum of its hashed rows. Since a filter is linear before pooling, each distinct
    word's products with all filter positions are computed once and kept, and a text is a sum of shifted look-ups.
    """

    table: np.ndarray
    filters: np.ndarray  # DIM x positions * FILTERS, positions being all offsets of all widths
    bias: np.ndarray
    out: np.ndarray
    offset: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def start(cls, seed: int) -> TextNetwork:
        r = np.random.default_rng(seed)
        positions = sum(WIDTHS)
        return cls(r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, positions * FILTERS)).astype(np.float32), np.full(len(WIDTHS) * FILTERS, -0.05, np.float32), r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def copy(self) -> TextNetwork:
        return replace(self, table=self.table.copy(), filters=self.filters.copy(), bias=self.bias.copy(), out=self.out.copy(), thresholds=dict(self.thresholds))

    def put(self, block: int, weight: np.ndarray, value: np.ndarray) -> None:
        """Sets the parameters of a block as Learner.blocks() gives them; what has no weight stays."""
        value = value.reshape(len(weight), -1)
        if block < BUCKETS // BLOCK:
            self.table[block * BLOCK : (block + 1) * BLOCK][weight > 0] = value[weight > 0]
        elif weight[0]:
            n, f = self.filters.size, len(self.out)
            self.filters[:], self.bias[:], self.out[:] = value[0, :n].reshape(self.filters.shape), value[0, n : n + f], value[0, n + f : n + 2 * f]
            self.offset = float(value[0, -1])

    def pooled(self, products: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the pooled filter values and the word at which each had its maximum; ids hold two empty words after each text."""
        totals = window_sums(products, ids)
        places, start = np.empty((len(lengths), len(totals)), np.int64), 0
        for d, end in enumerate(np.cumsum(lengths + 2).tolist()):
            places[d] = totals[:, start:end].argmax(1) + start
            start = end
        return totals[np.arange(len(totals)), places], places

    def scorer(self, most: int = TOGETHER) -> _Scorer:
        return _Scorer(self, most)


class Learner:
    """Adam on the logistic loss, over texts as they come; a filter's gradient goes to the words at its maximum alone. No text is cut.

    A step takes `batch` texts, or fewer with over `most` words together, so that only a text longer than that needs more memory.
    """

    def __init__(self, net: TextNetwork, batch: int = 48, rate: float = 0.01, most: int = 100_000) -> None:
        self.net, self.batch, self.rate, self.most = net, batch, rate, most
        self.params = [net.table, net.filters, net.bias, net.out]
        self.moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.seen = np.zeros(BUCKETS, np.int64)
        self.steps = self.texts = self.held = 0
        self.pending: list[tuple[np.ndarray, int]] = []

    def add(self, keys: np.ndarray, label: int) -> None:
        self.pending.append((np.append(keys, [NO_WORD, NO_WORD]), label))
        self.held += len(keys) + 2
        if len(self.pending) >= self.batch or self.held >= self.most:
            self.step()

    def step(self) -> None:
        """Learns from the texts that wait."""
        if not self.pending:
            return
        self.steps += 1
        self.texts += len(self.pending)
        y = np.array([label for _, label in self.pending], np.int64)
        lengths = np.array([len(t) - 2 for t, _ in self.pending])
        used, local = np.unique(np.concatenate([t for t, _ in self.pending]), return_inverse=True)
        self.pending, self.held = [], 0
        rows, empty = rows_of(used), used == NO_WORD
        vectors = self.net.table[rows].sum(1)
        vectors[empty] = 0
        products = vectors @ self.net.filters
        values, places = self.net.pooled(products, local, lengths)
        h = np.maximum(values + self.net.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.net.out + self.net.offset, -30, 30)))
        g = ((p - y) / len(y)).astype(np.float32)
        gh = g[:, None] * self.net.out * (values + self.net.bias > 0)
        gp = np.zeros_like(products)
        start = 0
        for k, width in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(width):
                word = local[np.minimum(places[:, part] + j, len(local) - 1)]
                np.add.at(gp.reshape(-1), (word * gp.shape[1] + (start + j) * FILTERS + np.arange(FILTERS)).reshape(-1), gh[:, part].reshape(-1))
            start += width
        gv = gp @ self.net.filters.T
        gv[empty] = 0
        hit = np.flatnonzero(gp.any(1))  # the words at some maximum
        touched, where = np.unique(rows[hit], return_inverse=True)
        ge = np.zeros((len(touched), DIM), np.float32)
        # By single numbers, since NumPy adds whole rows at places many times slower.
        np.add.at(ge.reshape(-1), (where.reshape(-1, 1) * DIM + np.arange(DIM)).reshape(-1), np.repeat(gv[hit], rows.shape[1], axis=0).reshape(-1))
        grads = [ge, vectors.T @ gp + 1e-5 * self.net.filters, gh.sum(0), h.T @ g + 1e-4 * self.net.out]
        self.net.offset -= self.rate * float(g.sum())
        self.seen[touched] += 1
        for k, (v, gr, (m, s)) in enumerate(zip(self.params, grads, self.moment)):
            sel = touched if k == 0 else slice(None)
            n = self.seen[touched][:, None] if k == 0 else self.steps
            mean, square = m[sel], s[sel]
            mean += 0.1 * (gr - mean)
            square += 0.01 * (gr * gr - square)
            v[sel] -= self.rate * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.99**n)) + 1e-7)
            if k == 0:
                m[sel], s[sel] = mean, square

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The parameters by block, with the weight of each row in an average: the steps that changed it, or the texts for what all of them change."""
        for k in range(0, BUCKETS, BLOCK):
            yield k // BLOCK, self.seen[k : k + BLOCK].astype(np.float64), self.net.table[k : k + BLOCK]
        rest = np.concatenate([self.net.filters.ravel(), self.net.bias, self.net.out, [self.net.offset]])
        yield BUCKETS // BLOCK, np.array([float(self.texts)]), rest[None, :]


class _Scorer:
    """Scores texts, about `most` words at a time."""

    def __init__(self, net: TextNetwork, most: int) -> None:
        self.net, self.most = net, most

    def maxima(self, parts: list[np.ndarray]) -> np.ndarray:
        """Of each part (its words' keys, and NO_WORD twice) the maximum of each filter over all places."""
        used, local = np.unique(np.concatenate(parts), return_inverse=True)
        vectors = self.net.table[rows_of(used)].sum(1)
        vectors[used == NO_WORD] = 0
        ends = np.cumsum([len(p) for p in parts])
        totals = window_sums(vectors @ self.net.filters, local)
        totals[:, ends - 1] = totals[:, ends - 2] = 0  # what begins at an empty word does not reach into the next part
        return np.maximum.reduceat(totals, np.append(0, ends[:-1]), axis=1).T

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """The words of each text's parts with the text's number; parts of long texts overlap by the widest filter. Texts of about PIECE characters are taken together."""
        held: list[str | None] = []
        size = done = 0
        for t in chain(texts, (_END,)):
            if t is not _END:
                held.append(t)
                size += len(t or "")
            if size >= PIECE or t is _END:
                for d, keys in enumerate(word_keys(held) if held else (), done):
                    for at in range(0, max(1, len(keys)), self.most):
                        yield d, np.append(keys[at : at + self.most + max(WIDTHS) - 1], [NO_WORD, NO_WORD])
                done, held, size = done + len(held), [], 0

    def raw(self, texts: Iterable[str | None]) -> np.ndarray:
        """The logistic unit's input for each whole text."""
        rows: list[np.ndarray] = []
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def work() -> None:
            for (d, _), value in zip(held, self.maxima([p for _, p in held]) if held else ()):
                if d == len(rows):
                    rows.append(value)
                else:
                    rows[d] = np.maximum(rows[d], value)
            held.clear()

        for part in self.parts(texts):
            held.append(part)
            size += len(part[1])
            if size >= self.most:
                work()
                size = 0
        work()
        out = np.array(rows, np.float32).reshape(-1, len(self.net.out))
        return np.maximum(out + self.net.bias, 0) @ self.net.out + self.net.offset

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts).astype(np.float64) + self.net.shift, -40, 40)))


def learnt(rows: DataFrame, nets: list[TextNetwork], parts: int, seed: int) -> list[TextNetwork]:
    """The networks after one round over all rows. nets[0] learns from all of them, and nets[1 + f] from those outside of fold f.

    Each part of the rows is learnt from by a task of its own, in an order by hash, from what the round began with. A row of the embedding table
    becomes the mean of the parts that changed it, weighted by their steps; the rest is weighted by the parts' texts. The averages are
    made by blocks on executors, and the driver gets one set of parameters.
    """
    sent = rows.sparkSession.sparkContext.broadcast(nets)
    schema = "net int, block int, part int, weight array<double>, value array<float>"

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        net, block, part, weight, value = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(net, pa.int32()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(list(weight), pa.list_(pa.float64())), pa.array([v.ravel() for v in value], pa.list_(pa.float32()))], names=["net", "block", "part", "weight", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners, now = [], None

        def ended() -> Iterator[pa.RecordBatch]:
            for k, learner in enumerate(learners):
                learner.step()
                yield batch_of([(k, block, now, weight, value.astype(np.float32)) for block, weight, value in learner.blocks()])

        for batch in slices(batches, "text", 1 << 20):
            for part, fold, label, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "fold", "label")), word_keys(batch.column("text").to_pylist())):
                if part != now:
                    yield from ended()
                    learners, now = [Learner(n.copy()) for n in sent.value], part
                for k, learner in enumerate(learners):
                    if fold != k - 1:
                        learner.add(keys, label)
        yield from ended()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for net, block, weight, value in zip(*(batch.column(c) for c in ("net", "block", "weight", "value"))):
                w = weight.values.to_numpy()
                v = value.values.to_numpy().reshape(len(w), -1) * w[:, None]
                at = held.setdefault((net.as_py(), block.as_py()), [np.zeros(w.shape), np.zeros(v.shape)])
                at[0] += w
                at[1] += v
        for (net, block), (w, v) in held.items():
            yield batch_of([(net, block, 0, w, (v / np.maximum(w, 1e-9)[:, None]).astype(np.float32))])

    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("doc_id", F.lit(seed)).alias("order"), "doc_id", "fold", "label", "text")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "order", "doc_id", "label", "text")
    done = dealt.select("part", "fold", "label", "text").mapInArrow(learn, schema).repartition(min(parts, len(nets) * 8), "net", "block").sortWithinPartitions("net", "block", "part").mapInArrow(average, schema)
    out = [n.copy() for n in nets]
    scratch = Scratch(rows.sparkSession)
    averaged = scratch.stored(done, "parameters", len(nets) * (BUCKETS // BLOCK + 1))  # a write, so that the shuffled texts go at its end
    for r in averaged.collect():
        out[r["net"]].put(r["block"], np.array(r["weight"]), np.array(r["value"], np.float32))
    scratch.drop(averaged)
    sent.unpersist()
    return out


def best_thresholds(scored: DataFrame, least: int) -> tuple[float, dict[str, float]]:
    """Of scored rows (lang, label, score) the threshold of the largest F1 of label 1, over all languages and for each with `least` rows of each label; 0.5 without rows of both.

    All rows are counted by steps of 1/GRID of the score; a threshold lies at the middle of the gap between two steps that have rows. A language's steps, GRID + 1 at most, meet in one task.
    """
    step = F.floor(F.col("score") * GRID).alias("step")
    by_lang = scored.groupBy("lang", step).agg(F.count("*").alias("n"), F.sum("label").alias("hit"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    counted = by_lang.withColumn("key", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("whole"), "lang"))))
    counted = counted.where("key.whole OR lang IS NOT NULL").groupBy("key", "step").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    down, whole = Window.partitionBy("key").orderBy(F.desc("step")), Window.partitionBy("key")
    taken, found = F.sum("n").over(down), F.sum("hit").over(down)
    rates = counted.select("key", "step", (2 * found / (taken + F.sum("hit").over(whole))).alias("f1"), ((F.col("lo") + F.coalesce(F.lead("hi").over(down), F.col("lo"))) / 2).alias("threshold"), F.sum("hit").over(whole).alias("ones"), (F.sum("n").over(whole) - F.sum("hit").over(whole)).alias("zeros"))
    best = rates.where("ones > 0 AND zeros > 0").groupBy("key", "ones", "zeros").agg(F.max_by("threshold", F.struct("f1", "step")).alias("threshold"))
    rows = best.where(F.col("key.whole") | (F.least("ones", "zeros") >= least)).collect()
    return next((r["threshold"] for r in rows if r["key"]["whole"]), 0.5), {r["key"]["lang"]: r["threshold"] for r in rows if not r["key"]["whole"]}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 5, least: int = 30, part: int = PART) -> TextNetwork:
    """Trains on all training documents, whole, by parts whose networks are averaged after each round.

    Two more networks learn from half of the rows each, and score the other half; by these scores of all rows every language with `least` rows of each label gets
    a threshold, and other languages, null among them, that of all. Without rows of both classes every score is that of the larger one.
    The labelled texts are kept in the shared folder for the time of the fit; only parameters and thresholds come to the driver.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(labelled_rows(docs, labels, label).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")), "labelled")
    by = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    counts = {k: by.get((0, k), 0) + by.get((1, k), 0) for k in (0, 1)}
    net = TextNetwork.start(seed)
    if min(counts.values()) < 2:
        net.out[:], net.offset = 0, 10.0 if counts[1] > counts[0] else -10.0
        scratch.drop(rows)
        return net
    crossed = all(by.get((f, k), 0) for f in (0, 1) for k in (0, 1))
    nets = [net] + [net.copy() for _ in range(2 * crossed)]
    total = sum(counts.values())
    parts = min(PARTS, -(-total // part))
    for k in range(min(ROUNDS[1], max(ROUNDS[0], -(-VISITS // total)))):
        nets = learnt(rows, nets, parts, seed + k)
    net = nets[0]
    by_fold = nets[1:] if crossed else [net]
    scored = reduce(DataFrame.unionByName, (score_toxicity(rows.where(F.col("fold") == f) if crossed else rows, other, "score") for f, other in enumerate(by_fold)))
    net.threshold, net.thresholds = best_thresholds(scored.select("lang", "label", "score"), least)
    scratch.drop(rows)
    return net


def score_toxicity(docs: DataFrame, net: TextNetwork, column: str = "toxicity_score", text: str = "text") -> DataFrame:
    """All columns of docs and the score of each whole text; a column of that name is replaced. No shuffle; only the text goes to Python, and only the score comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = sent.value.scorer()
        for texts in batches:
            yield pa.array(scorer.score(t.as_py() for t in texts), pa.float64())

    return docs.withColumn(column, score(F.col(text)))


def with_decision(scored: DataFrame, net: TextNetwork, column: str = "toxicity_score", lang: str = "lang") -> DataFrame:
    """Adds lang_threshold, by the row's language, and toxic_by_lang (the score reaches it)."""
    threshold = F.lit(net.threshold)
    for k, v in sorted(net.thresholds.items()):
        threshold = F.when(F.col(lang) == k, F.lit(v)).otherwise(threshold)
    return scored.withColumn("lang_threshold", threshold).withColumn("toxic_by_lang", F.col(column) >= F.col("lang_threshold"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, with the thresholds and decisions by language; a null text scores as an empty one."""
    docs = table(spark, sf_dir, "documents")
    net = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = with_decision(score_toxicity(docs.select("doc_id", "text", "lang"), net, "score"), net, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "lang_threshold", "toxic_by_lang")
