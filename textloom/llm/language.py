"""Language identification by the nearest centroid of n-gram vectors.

A text is read as lower-case letters with one blank between runs of them. Its letter pairs and triples are counted
in hashed places, damped by a logarithm, weighted by inverse document frequency and scaled to length one. Every
language has several centroids, found by k-means on the sphere over its training texts. The language of the centroid
with the greatest cosine is predicted; the score is the softmax over the languages' best cosines. A text farther
from its centroid than the language's radius for texts of its length is rejected. Radii are a high quantile of the
distances of held-out training texts and of their starts (each is measured by centroids learned without it), by
length: a short text has few grams in common with any centroid, so it gets more room. Length is the number of distinct grams, as a text that
repeats one word is as hard to place as that word. Centroids of a few odd texts (junk, other languages) are dropped.

Training uses at most about `per_language` texts of each language, chosen by a hash of the id: the bound is a
parameter and documented; prediction reads whole texts of all rows, in one narrow pass.

Null texts and texts without a letter are `und` with score 0 and rejected. With nothing to learn from, every text is.
Training rows with null text, language or id are left out. Repeated rows and null ids are kept in the output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

PLACES = 4096
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letter_codes(text: str) -> np.ndarray:
    """Code points of the letters, other characters as blanks, runs of blanks as one."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of letter pairs and triples; chunked, so that a long text needs bounded memory."""
    counts = np.zeros(PLACES)
    for first in range(0, len(text), 1 << 20):
        codes = letter_codes(f" {text[max(0, first - 2) : first + (1 << 20)]} ")
        pairs = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)
        triples = pairs[:-1] * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
        for grams in (pairs, triples):
            grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(2654435761)
            counts += np.bincount(grams >> np.uint32(20), minlength=PLACES)
    return counts


class Centroids:
    def __init__(self, languages: list[str], owners: np.ndarray, centroids: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.languages, self.owners, self.centroids, self.radii, self.idf = languages, owners, centroids, radii, idf

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)

    def radius(self, owners: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.radii[owners, length_classes(counts)]

    def predict(self, texts: list[str | None], sharpness: float = 25.0) -> list[tuple[str, float, float, bool]]:
        """(language, score, distance, rejected) of each text."""
        out: list = [(UNKNOWN, 0.0, 1.0, True)] * len(texts)
        some = [i for i, text in enumerate(texts) if text and any(map(str.isalpha, text))] if self.languages else []
        for first in range(0, len(some), 256):
            part = some[first : first + 256]
            counts = np.stack([gram_counts(texts[i]) for i in part])
            cosines = self.vectors(counts) @ self.centroids.T
            best = np.stack([cosines[:, self.owners == k].max(1) for k in range(len(self.languages))], axis=1)
            likely = np.exp(sharpness * (best - best.max(1, keepdims=True)))
            likely /= likely.sum(1, keepdims=True)
            nearest = cosines.argmax(1)
            radius = self.radius(self.owners[nearest], counts)
            for row, i in enumerate(part):
                k, distance = self.owners[nearest[row]], float(1 - cosines[row, nearest[row]])
                out[i] = (self.languages[k], float(likely[row, k]), distance, bool(distance > radius[row]))
        return out


def length_classes(counts: np.ndarray) -> np.ndarray:
    """Texts by the logarithm of their number of distinct grams."""
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int)


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """At most k centroids of unit vectors; seeds are picked far apart, and centroids with less than a share `least`
    of the vectors are dropped, as long as one stays."""
    mean = vectors.mean(0)
    seeds = [int((vectors @ mean).argmax())]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int((vectors @ vectors[seeds].T).max(1).argmin()))
    centroids = vectors[seeds]
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(1)
        used = [c for c in range(len(centroids)) if (member == c).any()]
        centroids = np.stack([vectors[member == c].sum(0) for c in used])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    held = np.bincount((vectors @ centroids.T).argmax(1), minlength=len(centroids))
    return centroids[(held >= least * len(vectors)) | (held == held.max())]


def start_counts(text: str) -> np.ndarray:
    """Counts of a start of the text, of 8 to 512 characters by a hash of the text."""
    return gram_counts(text[: 8 << zlib.crc32(text[:4096].encode("utf-8", "surrogatepass")) % 7])


def packed(counts: np.ndarray) -> bytes:
    places = np.flatnonzero(counts)
    return np.concatenate([places, np.minimum(counts[places], 65535)]).astype("<u2").tobytes()


def unpacked(packs: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packs), PLACES), np.float32)
    for row, pack in enumerate(packs):
        places, counts = np.frombuffer(pack, "<u2").reshape(2, -1)
        out[row, places] = counts
    return out


def held_out_radii(model: Centroids, vectors: np.ndarray, lengths: np.ndarray, starts: list[bytes], of: np.ndarray, folds: np.ndarray, k: int, quantile: float = 0.99, least: int = 30, slack: float = 0.9) -> np.ndarray:
    """language x length class: the distance that a share `quantile` of the language's held-out texts and starts of
    that length keep to their nearest centroid, whichever language it is of. A class with under `least` texts takes the radius of
    the next shorter one that has them; below the shortest of these the cosine falls with the root of the length. A
    longer text never has more room than a shorter one. Without texts to hold out nothing is rejected."""
    n_languages, classes = int(of.max()) + 1, int(np.log2(PLACES)) + 1
    distances, start_distances, start_lengths = np.full(len(of), np.nan), np.full(len(of), np.nan), np.zeros(len(of), int)
    for fold in np.unique(folds):
        learn = folds != fold
        found = [spherical_means(vectors[learn & (of == lang)], k) for lang in range(n_languages) if (learn & (of == lang)).any()]
        if found:
            learned, out = np.concatenate(found).T, np.flatnonzero(~learn)
            distances[out] = 1 - (vectors[out] @ learned).max(1)
            for some in np.array_split(out, -(-len(out) // 256)):
                counts = unpacked([starts[i] for i in some])
                start_distances[some], start_lengths[some] = 1 - (model.vectors(counts) @ learned).max(1), length_classes(counts)
    start_distances[[not start for start in starts]] = np.nan
    distances, lengths, of = np.concatenate([distances, start_distances]), np.concatenate([lengths, start_lengths]), np.concatenate([of, of])
    radii = np.ones((n_languages, classes))
    for lang in range(n_languages):
        own = (of == lang) & ~np.isnan(distances)
        if not own.any():
            continue
        shares = {c: distances[own & (lengths == c)] for c in range(classes) if (own & (lengths == c)).sum() >= least}
        shares = shares or {int(lengths[own].min()): distances[own]}
        cosines = {c: slack * (1 - np.quantile(share, quantile)) for c, share in shares.items()}
        shortest = min(cosines)
        for c in range(classes):
            radii[lang, c] = 1 - (cosines[max(k for k in cosines if k <= c)] if c >= shortest else cosines[shortest] * 0.5 ** ((shortest - c) / 2))
    return np.maximum.accumulate(radii[:, ::-1], axis=1)[:, ::-1]


def train(labelled: DataFrame, per_language: int = 800, centroids: int = 4, seed: int = 1) -> Centroids:
    """Learn from (doc_id, text, lang). About `per_language` texts a language are brought to the driver, as counts."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r.lang: r["count"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").count().collect()}
    if not sizes:
        return Centroids([], np.empty(0, int), np.empty((0, PLACES)), np.empty((0, 0)), np.ones(PLACES))
    million = 1_000_000
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(million, million * per_language // n)))))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(million)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, np.minimum(gram_counts(text), 65535).astype("<u2").tobytes(), packed(start_counts(text))) for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if any(map(str.isalpha, text))]
            lang, counts, start = zip(*kept, strict=True) if kept else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(counts, pa.binary()), pa.array(start, pa.binary())], names=["lang", "counts", "start"])

    rows = sorted((r.lang, bytes(r.counts), bytes(r.start)) for r in sample.select("text", "lang").mapInArrow(run, "lang string, counts binary, start binary").collect())
    languages = sorted({lang for lang, *_ in rows})
    if not languages:
        return Centroids([], np.empty(0, int), np.empty((0, PLACES)), np.empty((0, 0)), np.ones(PLACES))
    counts = np.stack([np.frombuffer(c, "<u2") for _, c, _ in rows]).astype(np.float32)
    of = np.array([languages.index(lang) for lang, *_ in rows])
    # each language weighs the same in the document frequencies
    seen = np.mean([(counts[of == k] > 0).mean(0) for k in range(len(languages))], axis=0)
    idf = np.log((1 + 1e-3) / (seen + 1e-3)) + 0.05
    model = Centroids(languages, np.empty(0, int), np.empty((0, PLACES)), np.empty((0, 0)), idf)
    vectors = model.vectors(counts).astype(np.float32)
    found = [spherical_means(vectors[of == k], centroids) for k in range(len(languages))]
    model.centroids = np.concatenate(found)
    model.owners = np.repeat(np.arange(len(languages)), [len(c) for c in found])
    # exact copies share a fold, so that no text is measured by its copy
    folds = np.array([zlib.crc32(c) % 4 for _, c, _ in rows])
    model.radii = held_out_radii(model, vectors, length_classes(counts), [start for *_, start in rows], of, folds, centroids)
    return model


def training_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(id_remainder("doc_id", modulus) != held_out)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, distance, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x PLACES numbers: bounded
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = shared.value.predict(part.column(1).to_pylist())
                columns = zip(*found, strict=True) if found else [[]] * 4
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, distance double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows whose text has a language that isn't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for first in range(0, batch.num_rows, 500):
                keep += [not rejected for *_, rejected in shared.value.predict(batch.column(at).slice(first, 500).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
