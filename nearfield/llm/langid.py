"""Language identification by nearest centroid.

A text becomes counts of hashed byte n-grams of its letters, weighted by inverse document frequency and scaled to length one.
Each language has several centroids, found by spherical k-means on a bounded sample of labelled documents. The language of the
centroid of the largest cosine wins; a text farther from it than nearly all training texts of that centroid is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, held_out, slices

CELLS = 4096
ORDERS = (1, 2, 3)
#: Letters of ASCII and all bytes of other characters stay; the rest counts as one blank.
LETTERS = np.array([b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint64)
SCORED = "doc_id long, lang_pred string, score double, rejected boolean, nearest string"


def ngram_counts(column: pa.Array) -> np.ndarray:
    """A row of CELLS counts for each text."""
    column = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64)
    raw = np.frombuffer("".join(column.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    letters = LETTERS[raw]
    out = np.zeros((len(sizes), CELLS), np.float32)
    for order in ORDERS:
        code = np.full(max(0, len(letters) - order + 1), order, np.uint64)
        blank = np.ones(len(code), bool)
        for k in range(order):
            own = letters[k : k + len(code)]
            code = code * np.uint64(1_000_003) + own
            blank &= own == 32
        cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        cell[blank] = -1
        end = 0
        for row, n in enumerate(sizes.tolist()):
            begin, end = end, end + n
            if n >= order:
                own = cell[begin : end - order + 1]
                out[row] += np.bincount(own[own >= 0], minlength=CELLS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Centroids:
    languages: list[str]
    centres: np.ndarray
    owner: np.ndarray
    weights: np.ndarray
    reach: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return scaled(np.log1p(counts) * self.weights)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.centres.T
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centres; they start at rows far from each other."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = scaled(np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit_centroids(documents: DataFrame, per_language: int = 500, at_most: int = 4000, clusters: int = 4, quantile: float = 0.002) -> Centroids:
    """Centroids from text and lang of documents that aren't held out.

    The sample is bounded: about per_language documents of each language and at_most in all, but about 20 of each language however
    many there are. Null and empty texts and null languages don't count.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = {r[0]: r[1] for r in documents.where(F.col("lang").isNotNull() & ~held_out()).groupBy("lang").count().collect()}
    each = min(per_language, max(20, at_most // max(1, len(counts))))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    chosen = known.select("doc_id", "lang", "text").where(F.pmod(F.xxhash64("doc_id", F.lit("training sample")), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = [r.astype("<f4").tobytes() for r in ngram_counts(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "counts"])

    rows = sorted(((r[0] if r[0] is not None else -1, r[1], r[2]) for r in chosen.mapInArrow(run, "doc_id long, lang string, counts binary").limit(max(2 * at_most, 60 * len(counts))).collect()))
    languages = sorted({r[1] for r in rows})
    x = np.stack([np.frombuffer(r[2], "<f4") for r in rows]) if rows else np.zeros((0, CELLS), np.float32)
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    vectors = scaled(np.log1p(x) * weights)
    tag = np.array([languages.index(r[1]) for r in rows], np.int64)
    centres, owner, reach = [np.zeros((0, CELLS), np.float32)], [], []
    for k in range(len(languages)):
        own = vectors[tag == k]
        found = spherical_means(own, clusters)
        cosine = own @ found.T
        best = cosine.argmax(1)
        for c in range(len(found)):
            held = cosine[best == c, c]
            owner.append(k)
            reach.append(float(np.quantile(held, quantile)) if len(held) else 0.0)
        centres.append(found)
    return Centroids(languages, np.concatenate(centres), np.array(owner, np.int64), weights, np.array(reach))


def identify_languages(documents: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected, nearest for every whole text.

    nearest is the language of the nearest centroid; lang_pred is the same, but `und` for a null text, one without a letter, or a
    model without languages (score 0). rejected tells that the distance is beyond what training texts of that centroid show. A
    null doc_id stays null; repeated rows are scored each; of equal cosines the first centroid wins, languages being in order of
    their names; a text of any length is counted whole, with some 40 bytes of memory for each of its own; an empty table gives no
    rows; other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in slices(batch, limit=2_000_000):
                for start in range(0, len(piece), 1000):
                    part = piece.slice(start, 1000)
                    named = [has_letter(t) and bool(model.languages) for t in part.column("text").to_pylist()]
                    lang, score, far = ["und"] * len(part), np.zeros(len(part)), np.ones(len(part), bool)
                    if model.languages:
                        best, cosine = model.nearest(ngram_counts(part.column("text")))
                        lang = [model.languages[model.owner[b]] if ok else "und" for b, ok in zip(best.tolist(), named, strict=True)]
                        score = np.where(named, cosine, 0.0)
                        far = ~np.array(named, bool) | (cosine < model.reach[best])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far), pa.array(lang, pa.string())], ["doc_id", "lang_pred", "score", "rejected", "nearest"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
