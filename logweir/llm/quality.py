"""Quality classifier: gated-attention multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. A passage is encoded by hashed trigrams of byte classes (small and capital letters,
digits, each punctuation mark, ...) through a learned layer; gated attention weighs the passages, and the weighted sum is scored by a
logistic unit. Labels are known per document only. All weights are learned together with Adam in numpy.

The fit reads a bounded sample: `train_rows` distinct labelled texts per class, none longer than `train_chars`, chosen by the hash of
the text; copies count once, with the label that most of them have. Scoring runs over every text and whole, in slices of bounded bytes.

Defined cases: null, empty and blank texts are one empty passage and get that passage's score; copies get equal scores; without both
labels in training every score is the share of label 1 (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, slices, small_batches, text_bytes, word_spans, written

PASSAGE = 64
FEATURES, HIDDEN, GATE = 512, 32, 16
TRAIN_ROWS, TRAIN_CHARS = 1200, 60_000
EPOCHS, RATE, BAG, DECAY, SEED = 12, 0.01, 32, 1e-4, 7


def byte_classes() -> np.ndarray:
    """Class of each byte: letters, capitals, digits, spaces and line ends by kind; other ASCII by itself; UTF-8 leads and trails."""
    out = np.arange(256, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[9, 11, 12, 32]] = 4
    out[[10, 13]] = 5
    out[0x80:0xC0] = 6
    out[0xC0:] = 7
    return out


CLASSES = byte_classes()


def encode(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES counts, passages of each text); a text has one passage at least."""
    n = len(off) - 1
    starts, _, row = word_spans(raw, off)
    words = np.bincount(row, minlength=n)
    passages = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)])
    total = int(first[-1])
    # a passage begins at its first word; a text's first one at its first byte
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    heads = nth % PASSAGE == 0
    begin = np.empty(total + 1, np.int64)
    begin[-1] = len(raw)
    begin[first[:-1]] = off[:-1]
    begin[first[row[heads]] + nth[heads] // PASSAGE] = np.where(nth[heads] == 0, off[row[heads]], starts[heads])
    kind = CLASSES[raw]
    code = np.full(len(raw), 0, np.int64)
    if len(raw) > 2:
        code[:-2] = (kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:]
    slot = ((code * 2_654_435_761) >> 15) % FEATURES
    passage = np.repeat(np.arange(total), np.diff(begin))
    counts = np.bincount(passage * FEATURES + slot, minlength=total * FEATURES).reshape(total, FEATURES)
    return counts, passages


def scaled(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts as unit vectors."""
    x = np.log1p(counts).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)


@dataclass
class Model:
    w: np.ndarray  # encoder
    b: np.ndarray
    v: np.ndarray  # attention: content and gate
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray  # score
    d: np.ndarray

    @classmethod
    def start(cls, rng: np.random.Generator) -> Model:
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(normal(FEATURES, HIDDEN) * 4, np.zeros(HIDDEN, np.float32), normal(HIDDEN, GATE), normal(HIDDEN, GATE), normal(GATE), normal(HIDDEN), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]

    def forward(self, x: np.ndarray, size: np.ndarray):
        """Scores of bags; size: passages of each."""
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        p = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(p[:, None] * h, first)
        return 1 / (1 + np.exp(-(z @ self.c + self.d))), (first, h, t, s, p, z)

    def gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        score, (first, h, t, s, p, z) = self.forward(x, size)
        g = ((score - y) * weight / len(y)).astype(np.float32)
        dz = np.repeat(g[:, None] * self.c, size, axis=0)
        dp = (dz * h).sum(1)
        de = p * (dp - np.repeat(np.add.reduceat(p * dp, first), size))
        dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = (dz * p[:, None] + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()])]


def fit(bags: Sequence[np.ndarray], labels: Sequence[int], epochs: int = EPOCHS) -> Model | float:
    """The model; a constant if one label is missing. Both classes weigh the same in training, then odds return to their shares."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(SEED)
    model = Model.start(rng)
    x = [scaled(b) for b in bags]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = [np.zeros_like(p) for p in model.parts()]
    v = [np.zeros_like(p) for p in model.parts()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BAG):
            some = order[at : at + BAG]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for i, (p, g) in enumerate(zip(model.parts(), model.gradient(np.concatenate([x[k] for k in some]), np.array([len(x[k]) for k in some]), y[some], weight[some]), strict=True)):
                g = g + DECAY * p
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def training(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, chars: int) -> tuple[list[np.ndarray], list[int]]:
    """Encoded bags and labels of the sample."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    texts = docs.where(F.coalesce(F.char_length(text), F.lit(0)) <= chars).select(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    # copies are one text with the label that most of them have
    votes = texts.join(sized_broadcast(known, 64), "k").groupBy("h", "y").count()
    found = written(votes.groupBy("h").agg(F.max(F.struct("count", "y"))["y"].alias("y")), "labelled")
    counts = found.groupBy("y").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return [], []
    share = F.coalesce(*[F.when(F.col("y") == r["y"], min(1.0, rows / r["n"])) for r in counts])
    chosen = found.where((F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 30)) < share * float(1 << 30)) | F.col("h").isin([r["least"] for r in counts]))
    chosen = chosen.limit(4 * rows)  # a bound for the broadcast; the expected number is 2 * rows at most

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(2))
            bags = []
            for i, j in slices(off):
                counts, passages = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                bags += [x.tobytes() for x in np.split(np.minimum(counts, 255).astype(np.uint8), np.cumsum(passages)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.binary())], names=["h", "y", "bag"])

    some = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("h", "y", "t")
    bags = some.mapInArrow(encoded, "h long, y int, bag binary").orderBy("h").collect()
    return [np.frombuffer(r["bag"], np.uint8).reshape(-1, FEATURES) for r in bags], [r["y"] for r in bags]


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.7, keep: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per row of docs: key, the columns of `keep`, score (0 to 1, higher: label 1 likelier), predicted (score >= cut)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(*training(docs, labels, key, text, label, train_rows, train_chars)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            raw, off = text_bytes(b.column(b.num_columns - 1))
            out = [np.zeros(0)]
            for i, j in slices(off):
                if isinstance(model, float):
                    out.append(np.full(j - i, model))
                    continue
                counts, passages = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                out.append(model.forward(scaled(counts), passages)[0].astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out), pa.float64())], names=[*b.schema.names[:-1], "score"])

    source = docs.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(scored, f"{schema}, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
