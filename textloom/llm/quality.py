"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Terms are a text's words (hashed, lower case) and their shapes: letters of one case as one letter, other characters
as they are, repeats once; a word that repeats the one before it has one shape of its own. Every term has a sparse random index vector; a term's vector is the sum of the index
vectors of the terms next to it in the training texts, scaled to length one. A document is the mean of its words'
vectors beside the mean of its shapes' vectors. A network with one hidden layer gives a log-odds, which is divided by
a temperature fitted on a part of the sample kept from training.

It is fitted on a sample of at most about `bound` labelled rows, chosen by a hash of the id; that bound is a
documented parameter. Scoring reads whole texts of all rows in one narrow pass.

Null and empty texts have the vector zero and get the score the network gives to it. With no labels, or labels of
one kind only, the score is the share of label 1 (1 without labels, so that nothing is rejected unlearned). Labels
whose id or quality is null are left out; a document with several labels is learned from with each. Repeated rows
and null ids are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, kept, materialise, trim

PLACES = 8192
SIZE = 32
REPEAT = 2 * PLACES  # the place of a word that repeats the one before it, instead of its shape's
_SHAPE = [(re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"), (re.compile(r"(.)\1+"), r"\1")]


def term_places(word: str) -> tuple[int, int]:
    """Hashed places of a word and of its shape; shapes lie behind the words."""
    shape = word
    for pattern, by in _SHAPE:
        shape = pattern.sub(by, shape)
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % PLACES, PLACES + zlib.crc32(shape[:8].encode("utf-8", "surrogatepass")) % PLACES


class Terms:
    """Places of the words of texts, remembered for words seen before (a bounded memory)."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        known = self.known
        trim(known, self.most)
        for word in set(words).difference(known):
            a, b = term_places(word)
            known[word] = a << 16 | b
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        shapes = codes & 0xFFFF
        shapes[1:][codes[1:] == codes[:-1]] = REPEAT
        return codes >> 16, shapes


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors: four entries of plus or minus one each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((REPEAT + 1, SIZE), np.float32)
    for _ in range(4):
        out[np.arange(REPEAT + 1), rng.integers(0, SIZE, REPEAT + 1)] += rng.choice([-1, 1], REPEAT + 1)
    return out


def term_vectors(sample: DataFrame) -> np.ndarray:
    """Context sums of all terms over the sample, added up by place in Spark; REPEAT + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((REPEAT + 1, SIZE))
        terms = kept("terms", Terms)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, shapes = terms.places(text)
                if len(words) < 2:
                    continue
                here = index[words] + index[shapes]
                around = np.zeros_like(here)
                around[1:] += here[:-1]
                around[:-1] += here[1:]
                for places in (words, shapes):
                    used, at = np.unique(places, return_inverse=True)
                    for d in range(SIZE):
                        total[used, d] += np.bincount(at, around[:, d], len(used))
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["place", "sums"])

    summed = sample.select("text").mapInArrow(run, "place bigint, sums array<double>").groupBy("place").agg(*(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(SIZE)))
    out = np.zeros((REPEAT + 1, SIZE), np.float32)
    for row in summed.collect():
        out[row[0]] = row[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 2 * SIZE), np.float32)
    terms = kept("terms", Terms)
    for row, text in enumerate(texts):
        words, shapes = terms.places(text)
        if len(words):
            for first in range(0, len(words), 1 << 16):
                out[row, :SIZE] += vectors[words[first : first + (1 << 16)]].sum(0)
                out[row, SIZE:] += vectors[shapes[first : first + (1 << 16)]].sum(0)
            out[row] /= len(words)
    return out


class Network:
    """tanh layer, then a log-odds; trained by Adam on the mean cross entropy."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.weights = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 5e-3, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        kept, used = order[: len(x) // 6], order[len(x) // 6 :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-3
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            used = rng.permutation(used)
            for at in range(0, len(used), batch):
                rows = used[at : at + batch]
                z = (x[rows] - self.mean) / self.scale
                a, b, c, d = self.weights
                h = np.tanh(z @ a + b)
                error = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -50, 50))) - y[rows]) / len(rows)
                back = np.outer(error, c) * (1 - h * h)
                slopes = [z.T @ back + 1e-4 * a, back.sum(0), h.T @ error + 1e-4 * c, np.array([error.sum()])]
                step += 1
                for w, g, m, v in zip(self.weights, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(kept):
            logits = self.logits(x[kept])
            heats = np.geomspace(0.25, 8, 40)
            loss = [np.mean(np.logaddexp(0, logits / t) - y[kept] * logits / t) for t in heats]
            self.temperature = float(heats[int(np.argmin(loss))])


class Model:
    def __init__(self, vectors: np.ndarray, network: Network | None, prior: float):
        self.vectors, self.network, self.prior = vectors, network, prior

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.prior) if self.network is None else self.network.scores(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, bound: int = 8000, seed: int = 11) -> Model:
    """Fit on about `bound` of the rows of docs (doc_id, text) that have a label (doc_id, quality)."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("quality"))
    n, million = usable.count(), 1_000_000
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(million)) < min(million, million * bound // max(n, 1)))
    # about `bound` rows of sixteen bytes: broadcast of a bounded size
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality"), "sample")
    vectors = term_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "vector"])

    rows = sorted((r.doc_id, r.quality, bytes(r.vector)) for r in sample.mapInArrow(run, "doc_id bigint, quality double, vector binary").collect())
    y = np.array([q for _, q, _ in rows])
    if not len(y) or y.min() == y.max():
        return Model(vectors, None, float(y.mean()) if len(y) else 1.0)
    network = Network(2 * SIZE)
    network.fit(np.stack([np.frombuffer(v, np.float32) for _, _, v in rows]).astype(float), y)
    return Model(vectors, network, float(y.mean()))


def training_labels(labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    return labels.where(id_remainder("doc_id", modulus) != held_out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # term vectors and weights: a fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                scores = shared.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that score `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.scores(batch.column(at).slice(first, 500).to_pylist()) >= least for first in range(0, batch.num_rows, 500)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)
