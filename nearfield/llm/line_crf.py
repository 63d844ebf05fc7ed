"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Node features describe the line and its neighbours; transitions tie neighbouring lines together. The
field is trained on a bounded sample of labelled documents, whose lines carry their document's label, by gradient ascent on the
exact log-likelihood. A document's score is the mean of its lines' forward-backward marginals of "good", weighted by length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, forget_tokenizers, held_out, packed_rows, slices, unpacked_rows

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
ENDINGS = b".!?:;\"')"
#: Lines of one training document; documents with more are not drawn for training.
TRAIN_LINES = 80
NAMES = ("length", "words", "upper", "digits", "symbols", "bars", "distinct", "repeats", "word_length", "ended", "capital", "seen_before", "symbol_runs", "shouts")
#: The same symbol three times or more on end.
SYMBOL_RUN = re.compile(rb"([!-/:-@\[-`{-~])\1\1+")
SCORED = "doc_id long, score double, n_lines int"


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line that isn't blank, and the lines' lengths; one blank line stands for a text without any."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, w = len(line), len(words)
        n_upper = n - len(line.translate(None, UPPER))
        n_digit = n - len(line.translate(None, DIGITS))
        n_ascii_letters = n_upper + n - len(line.translate(None, LOWER))
        n_high = n - len(line.translate(None, bytes(range(128, 256))))
        letters = n_ascii_letters + n_high
        symbols = n - letters - n_digit - (w - 1)
        repeats = sum(map(eq, words, words[1:]))
        first = line.lstrip()[:1]
        runs = len(SYMBOL_RUN.findall(line)) if symbols > 2 else 0
        rows.append((
            math.log1p(n) / 8, math.log1p(w) / 6, n_upper / max(1, letters), n_digit / n, symbols / n, 8 * line.count(b"|") / n,
            len(set(words)) / w, repeats / w, min(20.0, n / w) / 10, line.rstrip()[-1:] in ENDINGS, first.isupper() or first > b"\x7f",
            line in seen, runs / w, line.count(b"!") / w,
        ))
        seen.add(line)
        sizes.append(n)
    if not rows:
        return np.zeros((1, len(NAMES))), np.ones(1)
    return np.array(rows, float), np.array(sizes, float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the ends), whether the line is first or last, and 1."""
    none = np.zeros((1, x.shape[1]))
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), ends, np.ones((len(x), 1))])


@dataclass(frozen=True)
class LineField:
    """Weights of the good state (bad is the base), and log-potentials of transitions [from, to]; state 1 is good."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def marginals(self, x: np.ndarray) -> list[float]:
        """Forward-backward over the lines of one document, on probabilities scaled at each line."""
        node = with_neighbours((x - self.mean) / self.scale) @ self.weights
        odds = np.exp(np.clip(node, -40, 40)).tolist()
        (a, b), (c, d) = np.exp(self.transitions).tolist()
        ahead, good = [], 0.5
        for i, o in enumerate(odds):
            zero, one = ((1 - good) * a + good * c, (1 - good) * b + good * d) if i else (1.0, 1.0)
            good = one * o / (zero + one * o)
            ahead.append(good)
        out, zero, one = [0.0] * len(odds), 0.5, 0.5
        for i in range(len(odds) - 1, -1, -1):
            p, q = (1 - ahead[i]) * zero, ahead[i] * one
            out[i] = q / (p + q)
            zero, one = a * zero + b * odds[i] * one, c * zero + d * odds[i] * one
            zero, one = zero / (zero + one), one / (zero + one)
        return out

    def score(self, text: str) -> tuple[float, int]:
        x, sizes = line_features(text)
        return float(np.average(self.marginals(x), weights=sizes)), len(x)


def train_field(documents: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Adam on the penalised log-likelihood of all lines; documents are handled together, line by line."""
    flat = np.vstack(documents)
    mean, scale = flat.mean(0), flat.std(0) + 1e-3
    longest = max(map(len, documents))
    n = len(documents)
    width = 3 * flat.shape[1] + 3
    x, mask = np.zeros((longest, n, width)), np.zeros((longest, n))
    for k, own in enumerate(documents):
        x[: len(own), k] = with_neighbours((own - mean) / scale)
        mask[: len(own), k] = 1
    y = labels.astype(int)
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    per = weight / mask.sum(0)  # every document counts by its weight, however many lines it has
    for step in range(1, rounds + 1):
        node, trans = x @ theta[:width], theta[width:].reshape(2, 2)
        node = np.stack([np.zeros_like(node), node], -1)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = node[0]
        for i in range(1, longest):
            new = np.logaddexp(alpha[i - 1, :, :1] + trans[0], alpha[i - 1, :, 1:] + trans[1]) + node[i]
            alpha[i] = np.where(mask[i, :, None] > 0, new, alpha[i - 1])
        total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        for i in range(longest - 2, -1, -1):
            ahead = node[i + 1] + beta[i + 1]
            new = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
            beta[i] = np.where(mask[i + 1, :, None] > 0, new, 0)
        good = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - total))
        slope = (y - good) * mask * per
        grad = np.concatenate([np.einsum("ln,lnw->w", slope, x), np.zeros(4)])
        for s in (0, 1):
            for t in (0, 1):
                pair = np.exp(np.minimum(0, alpha[:-1, :, s] + trans[s, t] + node[1:, :, t] + beta[1:, :, t] - total))
                grad[width + 2 * s + t] = ((((y == s) & (y == t)) - pair) * mask[1:] * per).sum()
        grad = grad / weight.sum() - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:width], theta[width:].reshape(2, 2), mean, scale)


def fit_quality(documents: DataFrame, labels: DataFrame, per_label: int = 800) -> LineField | None:
    """The field from labels.quality of rows that aren't held out; None where fewer than two labels are known.

    The sample is bounded: about per_label documents of each label, of at most TRAIN_LINES lines.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = {k: min(1.0, per_label / n) for k, n in counts.items()}
    limit = F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * 1_000_000
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("training sample")), F.lit(1_000_000)) < limit).limit(4 * per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, q, line_features(t)[0]) for d, q, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True)]
            rows = [(d, q, x.astype("<f4").tobytes()) for d, q, x in rows if len(x) <= TRAIN_LINES]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "x": pa.array([r[2] for r in rows], pa.binary())})

    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")  # at most 4 * per_label ids
    rows = sorted(map(tuple, joined.mapInArrow(run, "doc_id long, label int, x binary").limit(8 * per_label).collect()))
    if len({r[1] for r in rows}) < 2:
        return None
    labels_ = np.array([r[1] for r in rows])
    weight = np.where(labels_ == 1, 1 / share[1], 1 / share[0])
    return train_field([np.frombuffer(r[2], "<f4").reshape(-1, len(NAMES)).astype(float) for r in rows], labels_, weight / weight.mean())


def score_quality(documents: DataFrame, model: LineField | None) -> DataFrame:
    """doc_id, score, n_lines for every whole text.

    A null or empty text is scored as one blank line; without a model every score is 0.5. A null doc_id stays null; repeated rows
    are scored each; a text of any length is scored whole, and one without line breaks is a single line; an empty table gives no
    rows; other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for piece in slices(batch):
                found = [field.score(t or "") if field else (0.5, 0) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())], ["doc_id", "score", "n_lines"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def keep_good(documents: DataFrame, model: LineField | None, threshold: float = 0.3) -> DataFrame:
    """The rows of documents whose score reaches the threshold, with all columns; each row is scored in place.

    A null or empty text is scored as one blank line; a model of None keeps every row; null ids, repeated rows, ties at the threshold
    (kept) and columns of any name pass through; a text of any length is scored whole; an empty table gives no rows.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        field = sent.value
        for batch in batches:
            if field:
                batch = batch.filter(pa.array([field.score(t or "")[0] >= threshold for t in batch.column("text").to_pylist()], pa.bool_()))
            yield batch

    rows = packed_rows(documents)
    return unpacked_rows(rows.mapInArrow(run, rows.schema), documents.columns)
