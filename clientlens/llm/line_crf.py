"""Text quality by a linear-chain conditional random field over lines.

Each line is good or bad. What speaks for either are features of the line and of both neighbours, and a pair of
successive labels. Forward-backward gives each line's probability of being good, and their mean, weighted by the lengths of the lines,
is the quality of the text; a logistic curve turns it into a probability of label 1.

Only whole texts are labelled. Their lines start with the label of the text; after each fit, lines of bad texts
that look good are called good, but for the worst one, and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import in_small_batches, pieces, valid

SAMPLE = 5000  # labelled texts that are learned from, at most; the first by a hash of their ids
SAMPLE_LINES = 300  # longer texts are not learned from, but scored like all others
FITS, STEPS, RATE, RIDGE = 3, 120, 0.1, 1e-3
THRESHOLD = 0.3
BYTES = 2_000_000  # of text scored at once: forward-backward steps through all its texts together

UPPER, LOWER, DIGIT, SPACE, STOP, MARK, OTHER = range(7)
N_FEATURES = 13


def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = UPPER if c.isupper() else LOWER
        elif c.isspace():
            kinds[i] = SPACE
        elif c.isdigit():
            kinds[i] = DIGIT
        elif c in ".,;:'\"-()?":
            kinds[i] = STOP
        elif i < 128:
            kinds[i] = MARK
    return kinds


def features(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines of some texts, and the number of lines of each text."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    lines = [line for x in split for line in x]
    lengths = np.array([len(line) for line in lines], dtype=np.int64)
    codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds[codes]
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = np.stack([np.add.reduceat(kind == k, starts) for k in range(7)], axis=1).astype(np.float64)
    n[:, SPACE] -= 1  # the line's own end
    words = np.empty((len(lines), 4))
    at = 0
    for own in split:
        seen: set[str] = set()
        for line in own:
            w = line.split()
            distinct = set(w)
            words[at] = len(w), len(distinct), sum(map(str.__eq__, w[1:], w)), line in seen
            seen.add(line)
            at += 1
    letters = np.maximum(1.0, n[:, UPPER] + n[:, LOWER])
    chars = np.maximum(1.0, lengths - n[:, SPACE])
    per_word = np.maximum(1.0, words[:, 0])
    out = np.stack(
        [
            np.ones(len(lines)),
            np.log1p(lengths) / 5,
            n[:, UPPER] / letters,
            n[:, DIGIT] / chars,
            n[:, STOP] / chars * 5,
            n[:, MARK] / chars * 5,
            n[:, MARK] / per_word / 2,
            n[:, OTHER] / chars,
            np.where(words[:, 0] > 0, words[:, 1] / per_word, 1.0),
            words[:, 2] / per_word,
            words[:, 3],
            np.minimum(chars / per_word / 10, 3.0),
            lengths == 0,
        ],
        axis=1,
    )
    return out, lengths, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The features of each line beside those of the line before and after it; zeros at the ends of a text."""
    ends = np.cumsum(counts)
    before, after = np.vstack([np.zeros_like(x[:1]), x[:-1]]), np.vstack([x[1:], np.zeros_like(x[:1])])
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after])


def marginals(emit: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once.

    `emit`: how much each line speaks for good; `steps`: what pairs of successive labels add. Returns each line's probability of
    good and the expected number of each pair of labels.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    step = np.exp(steps - steps.max())
    e = np.stack([np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))], axis=1)
    forward, backward = np.empty_like(e), np.empty_like(e)
    for t in range(longest):
        at = starts[: active[t]] + t
        f = e[at] if t == 0 else (forward[at - 1] @ step) * e[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    backward[starts + sizes - 1] = 0.5
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (backward[at + 1] * e[at + 1]) @ step.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(emit), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] * step * (backward[at] * e[at])[:, None, :]
    pairs = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))
    return good, pairs


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair scores under which the labels of the lines are likeliest, by Adam."""
    w, steps = start[0].copy(), start[1].copy()
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for i in range(1, STEPS + 1):
        good, pairs = marginals(x @ w, counts, steps)
        slope = np.concatenate([(labels - good) @ x, (seen - pairs).ravel()]) / len(x) - RIDGE * np.concatenate([w, steps.ravel()])
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        move = RATE * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.99**i)) + 1e-8)
        w, steps = w + move[: len(w)], steps + move[len(w) :].reshape(2, 2)
    return w, steps


def weighted(good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each text's lines, by their lengths."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * (lengths + 1), starts) / np.add.reduceat(lengths + 1, starts)


def curve(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method."""
    x, beta = np.stack([mean, np.ones_like(mean)], axis=1), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (label - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1])


class Model:
    """A fitted field with its curve."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, quality: np.ndarray):
        self.weights, self.steps = np.zeros(3 * N_FEATURES), np.zeros((2, 2))
        self.slope = self.offset = 0.0
        if not len(counts):
            return
        near = with_neighbours(x, counts)
        of = np.repeat(np.arange(len(counts)), counts)
        labels = quality[of].astype(np.int64)
        for _ in range(FITS):
            self.weights, self.steps = fit(near, counts, labels, (self.weights, self.steps))
            good = marginals(near @ self.weights, counts, self.steps)[0]
            worst = np.minimum.reduceat(good, np.cumsum(counts) - counts)[of]
            labels = np.where(quality[of] == 1, 1, (good > 0.5) & (good > worst)).astype(np.int64)
        self.slope, self.offset = curve(weighted(good, lengths, counts), quality)

    def score(self, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = marginals(with_neighbours(x, counts) @ self.weights, counts, self.steps)[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * weighted(good, lengths, counts) + self.offset, -30, 30)))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """quality and the features and lengths of a text's lines."""
    kinds = _classes()
    for batch in batches:
        described = [features([text.as_py()], kinds) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x.astype(np.float32).tobytes() for x, _, _ in described], pa.binary()),
                pa.array([lengths.tobytes() for _, lengths, _ in described], pa.binary()),
            ],
            names=["quality", "x", "lengths"],
        )


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text leaves 0 on division by 5. A row without id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents that are not held out.

    Which ones depends on a hash of their ids alone. The sample of ids is bounded, so it can go to every task and no text is
    shuffled to meet it. Several labels of one id count as the larger of them, several documents of one id each by itself. Without labelled
    rows every score is 0.5.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality"))
        .where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")
        .where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) < SAMPLE_LINES)
        .select("quality", valid(F.coalesce("text", F.lit(""))).alias("text"))
        .mapInArrow(_described, "quality int, x binary, lengths binary")
        .toArrow()
    )
    order = sorted(range(rows.num_rows), key=lambda i: rows["x"][i].as_py())  # any fixed order: sums then never differ
    x = [np.frombuffer(rows["x"][i].as_py(), np.float32).reshape(-1, N_FEATURES).astype(np.float64) for i in order]
    lengths = [np.frombuffer(rows["lengths"][i].as_py(), np.int64) for i in order]
    counts = np.array([len(a) for a in x], dtype=np.int64)
    quality = rows["quality"].to_numpy()[order].astype(np.float64)
    return Model(np.vstack(x) if x else np.empty((0, N_FEATURES)), np.concatenate(lengths) if x else np.empty(0), counts, quality)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """The documents with one more column, `as_col`: the probability of label 1.

    A null or empty text is one empty line. Every line of a text counts, however many there are; each row is scored by itself, repeated
    ones too. Malformed UTF-8 is read with replacement characters. An empty table gives no rows. A column that is called `as_col` is replaced.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = _classes()
        for batch in batches:
            scores = [model.score(*features([t or "" for t in texts], kinds)) for texts in pieces(batch, BYTES)]
            yield pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

    return in_small_batches(docs).withColumn(as_col, score(valid(F.col(text_col))))
