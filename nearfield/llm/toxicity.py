"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

A sentence is a set of units: its words, and single letters that stand apart put together; a unit longer than LONGEST characters is
cut into windows that overlap. The kernel of two units counts their common subsequences of three characters, each weighted by
decay ** span in both, over spans of at most SPAN characters, and is scaled to 1 for equal units; so gaps and inserted characters
only weaken a match. A document is judged by the values of its TOP worst units and by how many units it has, in a logistic fit: one
insult among many plain words is enough, and a long text has more chances of a word that merely looks like one. A unit that speaks
for neither side counts as the machine's bias.

The landmarks are units that mark toxic documents, no two of them too much alike, and common units that don't; the Nystroem map
makes them coordinates, in which a linear machine separates units. Its value for a unit is a sum over the unit's subsequences of
fixed weights, so one table of weights scores any unit, whole.

Documents are labelled, not sentences. All units of a clean document count as clean; of a toxic one the units that mark toxic
documents and the most suspicious one count as toxic, and which one that is is chosen again after each round (multiple-instance
training). Labels may be wrong: a unit weighs on
each side by the share of documents it has there, so a few wrong labels don't outweigh many right ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, held_out, slices

DECAY, SPAN = 0.75, 7
#: Characters of one unit, and how far windows of a longer one overlap.
LONGEST, OVERLAP = 48, 16
SCORED = "doc_id long, score double, worst_sentence string"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Offsets (second, third character) of subsequences by their first character, and their weights.
STEPS = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]
EDGES = ".,;:!?\"'()[]{}«»“”‘’…-–—*$%&#|"
#: Characters whose subsequences are held at once.
AT_ONCE = 100_000
FILTER_POWER = 20
#: Units that a document is judged by.
TOP = 3


def units(sentence: str) -> list[str]:
    """Words in lower case without punctuation at their ends; runs of single letters are put together; long ones cut."""
    out, apart = [], []
    for word in sentence.lower().split():
        word = word.strip(EDGES)
        if len(word) == 1 and word.isalpha():
            apart.append(word)
            continue
        if len(apart) > 2:
            out.append("".join(apart))
        apart = []
        if len(word) > 2:
            out.append(word if word.isalpha() else "".join(filter(str.isalpha, word)) or word)
    if len(apart) > 2:
        out.append("".join(apart))
    if any(len(u) > LONGEST for u in out):
        step = LONGEST - OVERLAP
        out = [u[i : i + LONGEST] for u in out for i in range(0, max(1, len(u) - OVERLAP), step)]
    return out


def spaced_norm(length: np.ndarray) -> np.ndarray:
    """Root of the kernel of a unit of this many distinct characters with itself; no unit of that length has less."""
    n = np.maximum(np.asarray(length, float)[:, None] - np.array([k for _, k, _ in STEPS])[None], 0)
    return np.sqrt(np.maximum((n * np.array([w * w for *_, w in STEPS])[None]).sum(1), 1e-9))


SPACED = spaced_norm(np.arange(2 * LONGEST + 2))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, key, weight) of every subsequence of the units, ascending by unit and key; equal ones of a unit are added up.

    The key packs the three characters' code points.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(code)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # characters from here to the end of the unit
    unit, key, weight = [], [], []
    for j, k, w in STEPS:
        at = np.flatnonzero(left > k)
        unit.append(owner[at])
        key.append(code[at] << np.uint64(42) | code[at + j] << np.uint64(21) | code[at + k])
        weight.append(np.full(len(at), w))
    unit, key, weight = np.concatenate(unit), np.concatenate(key), np.concatenate(weight)
    if not len(key):
        return unit, key, weight
    order = np.lexsort((key, unit))
    unit, key, weight = unit[order], key[order], weight[order]
    first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (key[1:] != key[:-1])])
    return unit[first], key[first], np.add.reduceat(weight, first)


def in_parts(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The units in parts of about AT_ONCE characters, each with its place."""
    begin, held = 0, 0
    for i, w in enumerate(words):
        held += len(w)
        if held >= AT_ONCE:
            yield begin, words[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(words):
        yield begin, words[begin:]


def norms(words: list[str]) -> np.ndarray:
    """Root of each unit's kernel with itself; units without a subsequence have a tiny one."""
    out = np.full(len(words), 1e-18)
    for begin, part in in_parts(words):
        unit, _, weight = subsequences(part)
        out[begin : begin + len(part)] += np.bincount(unit, weight * weight, len(part))
    return np.sqrt(out)


class Landmarks:
    """Units whose subsequences span the feature space; kernel values of any units with them."""

    def __init__(self, points: list[str]):
        self.points = points
        unit, key, weight = subsequences(points)
        self.keys, at = np.unique(key, return_inverse=True)
        self.right = np.zeros((len(self.keys), len(points)))
        np.add.at(self.right, (at, unit), weight / norms(points)[unit])

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.points)))
        for begin, part in in_parts(words):
            unit, key, weight = subsequences(part)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            near = self.keys[at] == key
            unit, at, weight = unit[near], at[near], weight[near]
            for low in range(0, len(unit), 20_000):
                u, rows = unit[low : low + 20_000], self.right[at[low : low + 20_000]] * weight[low : low + 20_000, None]
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                np.add.at(out, begin + u[first], np.add.reduceat(rows, first, axis=0))
        return out / norms(words)[:, None] if len(words) else out


@dataclass(frozen=True)
class InsultMachine:
    """Scores are a logistic function of the worst units' values and the number of units; values belong to keys, which ascend."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def sums(self, words: list[str]) -> np.ndarray:
        """The sum of values over each unit's subsequences, where above 0."""
        out = np.zeros(len(words))
        if not len(self.keys):
            return out
        mark = np.uint64(0x9E3779B97F4A7C15)
        near = np.zeros(1 << FILTER_POWER, bool)
        near[self.keys * mark >> np.uint64(64 - FILTER_POWER)] = True
        for begin, part in in_parts(words):
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            owner = np.repeat(np.arange(len(part)), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
            for j, k, w in STEPS:
                at = np.flatnonzero(left > k)
                key = code[at] << np.uint64(42) | code[at + j] << np.uint64(21) | code[at + k]
                some = np.flatnonzero(near[key * mark >> np.uint64(64 - FILTER_POWER)])
                key = key[some]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                own = np.where(self.keys[place] == key, self.values[place], 0.0)
                out[begin : begin + len(part)] += w * np.bincount(owner[at[some]], own, len(part))
        return np.maximum(out, 0.0)

    def unit_values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each unit, at least the bias."""
        return self.sums(words) / norms(words) + self.bias if words else np.zeros(0)

    def worst(self, documents: list[np.ndarray], words: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For documents, given as numbers of distinct units: the TOP largest values (the bias where there are fewer) and the logarithm
        of the number of units, a row for each; and the worst unit, -1 where none is above the bias.

        The value with the least norm of a unit's length bounds its own from above, so the own one is computed for few units.
        known: the units' norms, where they are at hand.
        """
        sums = self.sums(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        upper = sums / SPACED[np.minimum(sizes, len(SPACED) - 1)]
        own = np.full(len(words), np.nan) if known is None else sums / known

        def settle(some: list[np.ndarray]) -> None:
            at = np.unique(np.concatenate([*some, np.zeros(0, np.int64)]))
            at = at[np.isnan(own[at])]
            own[at] = sums[at] / norms([words[i] for i in at.tolist()])

        if known is None:
            first = [d[np.argsort(-upper[d], kind="stable")[:TOP]] for d in documents]
            settle(first)
            settle([d[upper[d] > own[f].min()] for d, f in zip(documents, first, strict=True) if len(d) > TOP])
        out, unit = np.full((len(documents), TOP + 1), self.bias), np.full(len(documents), -1)
        for i, d in enumerate(documents):
            value = np.nan_to_num(own[d], nan=0.0)
            order = np.argsort(-value, kind="stable")[:TOP]
            out[i, : len(order)] += value[order]
            out[i, TOP] = math.log1p(len(d))
            if len(order) and value[order[0]] > 0:
                unit[i] = d[order[0]]
        return out, unit

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slopes + self.shift, -30, 30)))


NOTHING = InsultMachine(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros(TOP + 1), -3.0)


def disguised(word: str) -> list[str]:
    """The unit with a letter doubled, left out, or a strange character put in, at every inner place."""
    inner = range(1, len(word) - 1)
    return [v for i in inner for v in (word[:i] + word[i] + word[i:], word[:i] + "_" + word[i:], word[:i] + "x" + word[i:], word[:i] + word[i + 1 :])]


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """How much more often a unit is in toxic documents than in clean ones, smoothed by half a document."""
    return {u: math.log((toxic[u] + 0.5) / (n_toxic + 1)) - math.log((clean[u] + 0.5) / (n_clean + 1)) for u in toxic}


def choose_landmarks(odds: dict[str, float], toxic: Counter, clean: Counter, most: int, alike: float = 0.9) -> tuple[list[str], list[str]]:
    """Units by the log-odds of their documents, no two of them more alike than that; then common clean ones."""
    ranked = sorted((u for u in odds if odds[u] > 1.5 and toxic[u] >= 3), key=lambda u: (-odds[u] * math.sqrt(toxic[u]), u))[: 4 * most]
    marked: list[str] = []
    if ranked:
        near = Landmarks(ranked).kernel(ranked)
        kept: list[int] = []
        for i in range(len(ranked)):
            if len(kept) < most and (not kept or near[i, kept].max() <= alike):
                kept.append(i)
        marked = [ranked[i] for i in kept]
    return marked, [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if odds.get(u, 0.0) < 1.5][: most // 2]


def linear_machine(z: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradient steps; c weighs the examples."""
    x = np.hstack([z, np.ones((len(z), 1))])
    step = 1 / (1 + 2 * np.linalg.norm(x * np.sqrt(c)[:, None], 2) ** 2)
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = np.r_[ahead[:-1], 0] - 2 * x.T @ (c * y * slack)
        new = ahead - step * grad
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return w[:-1], float(w[-1])


def train_machine(texts: list[str], labels: np.ndarray, landmarks: int = 96, negatives: int = 6000, rounds: int = 3, cost: float = 40000, marks: float = 2.5) -> InsultMachine:
    """The machine from labelled documents; see the module's text. Ties between units go to the first in order of the text."""
    documents = [[u for s in SENTENCE.split(t) for u in units(s)] for t in texts]
    toxic, clean = Counter(), Counter()
    for own, y in zip(documents, labels, strict=True):
        (toxic if y else clean).update(set(own))
    odds = log_odds(toxic, clean, int(labels.sum()), int((1 - labels).sum()))
    marked, common = choose_landmarks(odds, toxic, clean, landmarks)
    if not marked:
        return NOTHING
    space = Landmarks(marked + common)
    gram = space.kernel(space.points)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(gram)))
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    words = list(dict.fromkeys(u for own in documents for u in own))
    number = {u: i for i, u in enumerate(words)}
    numbered = [np.array([number[u] for u in dict.fromkeys(own)], np.int64) for own in documents]
    suspicion = np.array([odds.get(u, -9.0) if toxic[u] >= 3 else -9.0 for u in words])
    known = norms(words)
    # Clean units in order of a checksum stand for all clean ones; they get the weight of those.
    pool = sorted(clean, key=lambda u: (zlib.crc32(u.encode("utf-8", "surrogatepass")), u))
    drawn = list(dict.fromkeys(common + pool[:negatives]))
    total = clean.total()
    z_drawn = space.kernel(drawn) @ root
    machine = None
    for _ in range(rounds):
        witnesses: Counter = Counter()
        for own, y in zip(numbered, labels, strict=True):
            if not y or not len(own):
                continue
            # Units that mark toxic documents by themselves, and the most suspicious one by the machine so far.
            some = {words[i] for i in own[suspicion[own] > marks].tolist()}
            if machine is not None and values[own].max() > -0.5:
                some.add(words[int(own[values[own].argmax()])])
            witnesses.update(some)
        good = sorted(witnesses)
        shown = [(v, witnesses[u]) for u in good if witnesses[u] >= 5 for v in disguised(u) if v not in clean]
        # Clean units that the last round took for toxic ones come in as well, by their own number of documents.
        hard = [] if machine is None else [words[i] for i in np.argsort(-values, kind="stable")[: negatives // 3] if clean[words[i]]]
        hard = [u for u in hard if u not in set(drawn)]
        z = np.vstack([space.kernel(good + [v for v, _ in shown]) @ root, z_drawn, space.kernel(hard) @ root])
        y = np.r_[np.ones(len(good) + len(shown)), -np.ones(len(drawn) + len(hard))]
        own = np.array([clean[u] for u in drawn], float)
        own *= (total - sum(clean[u] for u in hard)) / own.sum()
        c = np.r_[[witnesses[u] for u in good], [0.02 * n for _, n in shown], own, [clean[u] for u in hard]].astype(float)
        c *= np.where(y > 0, 0.5 / c[y > 0].sum(), 0.5 / c[y < 0].sum()) * cost
        w, b = linear_machine(z, y, c)
        machine = InsultMachine(space.keys, space.right @ (root @ w), b, np.zeros(TOP + 1), 0.0)
        values = machine.sums(words) / known + b
    evidence, _ = machine.worst(numbered, words, known)
    return InsultMachine(machine.keys, machine.values, machine.bias, *logistic_fit(evidence, labels))


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and shift of y on the columns of x by damped Newton steps, with a small penalty."""
    own = np.hstack([x, np.ones((len(x), 1))])
    theta, penalty = np.zeros(own.shape[1]), np.diag([0.01] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(own @ theta, -30, 30)))
        s = p * (1 - p) + 1e-6
        step = np.linalg.solve((own * s[:, None]).T @ own + penalty, own.T @ (y - p) - penalty @ theta)
        theta = theta + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return theta[:-1], float(theta[-1])


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 20_000) -> InsultMachine:
    """The machine from labels.toxic of rows that aren't held out; with fewer than two labels known it calls nothing toxic.

    The sample is bounded: about per_label documents of each label, of at most longest characters.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return NOTHING
    limit = F.when(F.col("label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0])) * 1_000_000
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("training sample")), F.lit(1_000_000)) < limit).limit(4 * per_label)
    texts = documents.where(F.length("text") <= longest).select("doc_id", "text")
    rows = sorted(map(tuple, texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text").limit(8 * per_label).collect()))  # at most 4 * per_label ids
    if len({r[1] for r in rows}) < 2:
        return NOTHING
    return train_machine([r[2] for r in rows], np.array([r[1] for r in rows]))


def score_toxicity(documents: DataFrame, model: InsultMachine) -> DataFrame:
    """doc_id, score, worst_sentence for every whole text.

    Of equal units the first is the worst one. A null or empty text, or one without units, gets the score of the bias and no sentence; worst_sentence is the first that holds the worst unit, given where the score is at least 0.5. Unbroken
    texts of any length are scored in windows. A null doc_id stays null; repeated rows are scored each; an empty table gives no rows;
    other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            for piece in slices(batch, limit=2_000_000):
                distinct: dict[str, int] = {}
                own = [np.array([distinct.setdefault(u, len(distinct)) for u in dict.fromkeys(units(t) if t else [])], np.int64) for t in piece.column("text").to_pylist()]
                words = list(distinct)
                evidence, unit = machine.worst(own, words)
                scores = machine.scores(evidence).tolist()
                sentences = [None if s < 0.5 or u < 0 else next((x for x in SENTENCE.split(piece.column("text")[k].as_py()) if words[u] in units(x)), None) for k, (s, u) in enumerate(zip(scores, unit.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64()), pa.array(sentences, pa.string())], ["doc_id", "score", "worst_sentence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
