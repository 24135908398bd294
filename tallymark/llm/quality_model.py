"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words.  Every passage of the whole text is
encoded (character-class transitions, word repetition and length figures), a hidden layer and a
gated attention (tanh times sigmoid) weigh the passages, and the weighted representation is
scored.  Document labels train all layers at once; the passages have no labels of their own.

Training takes at most about SAMPLE labelled rows and TRAIN_BYTES of text (documented bounds; rows are chosen by a hash of the label's doc_id,
fewer of them where their texts are long, and texts over LONGEST bytes are not trained on) and gathers only their
encoded passages.  Scoring is one map over all whole documents with the model, of fixed size, in its closure.

Defined results for odd input: a null, empty or blank text is a bag with one passage of zeros and gets the
score the model gives that; repeated rows score alike; an empty document table gives no rows; without any usable
label every score is 0.5; with one class only, every score is that class's smoothed rate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import is_training_fold, ready
from .textkit import chunks, column, unpack, pack, word_hashes, words, tidy

PASSAGE_WORDS = 40
SAMPLE = 3000
TRAIN_BYTES, LONGEST = 16 << 20, 1 << 20
HIDDEN, GATE, EPOCHS = 16, 8, 160
FOLDS, HELD = 3, 1

#: Byte classes: lower, upper, digit, white space, sentence marks, quotes and brackets, symbols, other ASCII, non-ASCII.
_CLASSES = 9
_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[list(b".,;:!?")] = 4
_CLASS[list(b"'\"()[]{}-")] = 5
_CLASS[list(b"#*$%&|<>@^~=+_\\/")] = 6
_CLASS[128:] = 8
WIDTH = _CLASSES * _CLASSES + _CLASSES + 5


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each document's passages begin; every document has one at least."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    begin = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((begin[-1], WIDTH), np.float32)
    if not len(starts):
        return x, begin
    doc = np.repeat(np.arange(len(n_words)), n_words)
    of_word = begin[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE_WORDS
    of_byte = np.zeros(len(data), np.int64)  # a byte belongs to the passage of the last word of its document that began, or to the first one
    full = offsets[:-1] < offsets[1:]
    of_byte[offsets[:-1][full]] = begin[:-1][full]
    of_byte[starts] = of_word
    of_byte = np.maximum.accumulate(of_byte)
    inner = np.ones(len(data), bool)  # what follows another byte of its document
    inner[offsets[:-1][full]] = False
    pair = np.flatnonzero(inner)
    cls = _CLASS[data]
    size = np.bincount(of_byte, minlength=begin[-1]).astype(np.float32)[:, None] + 1
    x[:, : _CLASSES**2] = np.bincount(of_byte[pair] * _CLASSES**2 + cls[pair - 1] * _CLASSES + cls[pair], minlength=begin[-1] * _CLASSES**2).reshape(begin[-1], -1) / size
    x[:, _CLASSES**2 : _CLASSES**2 + _CLASSES] = np.bincount(of_byte * _CLASSES + cls, minlength=begin[-1] * _CLASSES).reshape(begin[-1], -1) / size
    per = np.bincount(of_word, minlength=begin[-1]).astype(np.float32)
    some = np.maximum(per, 1)
    h = word_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    distinct = np.ones(len(h), bool)
    distinct[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    tail = x[:, -5:]
    tail[:, 0] = np.bincount(of_word, same, begin[-1]) / some
    tail[:, 1] = np.bincount(of_word[order], distinct, begin[-1]) / some
    tail[:, 2] = np.bincount(of_word, length, begin[-1]) / some / 10
    tail[:, 3] = np.minimum(np.bincount(of_word, length**2, begin[-1]) / some / 100, 50)
    tail[:, 4] = per / PASSAGE_WORDS
    return x, begin


class Model:
    """Gated-attention scorer; its parameters have a fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        r = np.random.RandomState(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": np.zeros(GATE),
            "c": r.normal(0, 0.3, HIDDEN), "c0": np.zeros(1),
        }

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, begin[:-1]
        bag = np.repeat(np.arange(len(at)), np.diff(begin))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))}

    def gradients(self, x: np.ndarray, f: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        d = (f["s"] - y) * weight
        dz = d[:, None] * p["c"]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        mean = np.bincount(f["bag"], f["a"] * da)
        de = f["a"] * (da - mean[f["bag"]])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - f["h"] ** 2
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
        x = self.standard(x).astype(np.float32)
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # between plain and balanced
        weight /= weight.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        for step in range(1, epochs + 1):
            grad = self.gradients(x, self.forward(x, begin), y, weight)
            rate = 0.05 * (1 - 0.9 * step / epochs)
            for k, g in grad.items():
                g = g + 1e-4 * self.p[k] * (k not in ("b", "c0"))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: u.astype(np.float32) for k, u in self.p.items()}
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, begin = encode(data, offsets)
        return self.forward(self.standard(x).astype(np.float32), begin)["s"].astype(np.float64)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.value)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | Constant:
    """A model from labelled rows outside the held-out fold."""
    docs = ready(docs)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & is_training_fold("doc_id", FOLDS, HELD)).select(F.col("doc_id").alias("__label_id"), F.col("quality").cast("int").alias("__quality"))
    share = min(1.0, sample / max(usable.count(), 1))

    def rows_of(share: float) -> DataFrame:
        chosen = usable.where(F.pmod(F.xxhash64(F.lit("quality"), "__label_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
        texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
        return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id")).select("text", "__quality")  # chosen has about `sample` rows

    volume = rows_of(share).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = rows_of(share * min(1.0, TRAIN_BYTES / max(volume, 1)))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(0))
            blobs = []
            for a, b in chunks(offsets, 1 << 20):
                x, begin = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                blobs += [pack(x[begin[i] : begin[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], names=["bag", "y"])

    got = rows.mapInArrow(tidy(bags), "bag binary, y int").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Constant(0.5 if not len(y) else (y.sum() + 1) / (len(y) + 2))
    xs = [np.frombuffer(unpack(b), np.float32).reshape(-1, WIDTH) for b in got.column("bag").to_pylist()]
    order = sorted(range(len(xs)), key=lambda i: (xs[i].shape, xs[i].tobytes(), y[i]))  # the order of rows must not matter
    xs, y = [xs[i] for i in order], y[order]
    x, begin = np.concatenate(xs), np.concatenate([[0], np.cumsum([len(v) for v in xs])])
    return Model(x.mean(0), 1 / (x.std(0) + 1e-3)).fit(x, begin, y)


def _scores(model: Model | Constant, texts: pa.Array) -> np.ndarray:
    data, offsets = column(texts)
    out = np.empty(len(texts))
    for a, b in chunks(offsets, 1 << 20):
        out[a:b] = model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(~is_training_fold("doc_id", FOLDS, HELD), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(tidy(scan), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns as they are, without those that score under the threshold."""
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(tidy(scan), docs.schema)
