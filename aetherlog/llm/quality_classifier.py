"""Quality of transcripts by attention over their passages: multiple-instance learning from document labels.

Labels say whether a whole transcript is good, not which part of it. Every passage is encoded, a gated attention learns from the
labels which passages matter, and the score is that of the weighted passage representation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import text_pieces

PASSAGE_WORDS = 100
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _CONTROL, _LEAD, _TAIL = range(len(_PUNCTUATION), len(_PUNCTUATION) + 8)
_CLASSES = len(_PUNCTUATION) + 8
_WORD_FEATURES = 7
WIDTH = _CLASSES + _WORD_FEATURES
_CLASS = np.full(256, _CONTROL, np.int64)
for _i, _b in enumerate(_PUNCTUATION):
    _CLASS[_b] = _i
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = _LOWER, _UPPER, _DIGIT
_CLASS[[9, 32]], _CLASS[10], _CLASS[0xC0:], _CLASS[0x80:0xC0] = _BLANK, _BREAK, _LEAD, _TAIL


def passage_features(texts: pa.Array, passage_words: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, features, first passage of each row)`` for pieces of the texts.

    A passage is a run of ``passage_words`` words with what stands before the next one; a text without words is one empty
    passage. Features are shares of character classes and of word shapes.
    """
    for a, b, piece in text_pieces(texts):
        starts, ends, first = piece.words()
        words = np.diff(first)
        count = np.maximum(1, -(-words // passage_words))
        begin = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(b - a), count)
        nth = np.arange(begin[-1]) - begin[row]
        word0 = first[row] + nth * passage_words
        word1 = np.minimum(word0 + passage_words, first[row + 1])
        edge = piece.offsets[row].copy()
        inner = nth > 0
        edge[inner] = starts[word0[inner]]
        passage = np.repeat(np.arange(begin[-1]), np.diff(np.append(edge, len(piece.data))))
        hist = np.bincount(passage * _CLASSES + _CLASS[piece.data], minlength=int(begin[-1]) * _CLASSES).reshape(-1, _CLASSES)
        size = np.maximum(hist.sum(axis=1), 1)
        out = np.zeros((int(begin[-1]), WIDTH))
        out[:, :_CLASSES] = np.sqrt(hist / size[:, None])
        if len(starts):
            own = np.repeat(np.arange(begin[-1]), word1 - word0)
            h = piece.spans(starts, ends)
            n = np.maximum(word1 - word0, 1)

            def share(marks: np.ndarray) -> np.ndarray:
                return np.bincount(own, weights=marks, minlength=int(begin[-1])) / n
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            order = np.lexsort((h, own))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
            upper = np.concatenate([[0], np.cumsum(_CLASS[piece.data] == _UPPER)])
            letters = np.concatenate([[0], np.cumsum(np.isin(_CLASS[piece.data], (_UPPER, _LOWER)))])
            capitals, letter = upper[ends] - upper[starts], letters[ends] - letters[starts]
            for k, v in enumerate((share(same), share(again), share(ends - starts) / 10, share((capitals == letter) & (letter > 1)),
                                   share(_CLASS[piece.data[starts]] == _UPPER), share(letter == 0), np.log1p(word1 - word0) / 5)):
                out[:, _CLASSES + k] = v
        yield a, b, out, begin


@dataclass
class Model:
    """Parameters of the scorer; of fixed size. A model without weights gives every text its prior."""

    prior: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        seg = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        h = np.tanh(x @ w["encode"] + w["shift"])
        left, gate = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        s = (left * gate) @ w["rank"]
        e = np.exp(s - np.maximum.reduceat(s, begin[:-1])[seg])
        a = e / np.add.reduceat(e, begin[:-1])[seg]
        z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
        return seg, h, left, gate, a, z, 1 / (1 + np.exp(-(z @ w["score"] + w["bias"])))

    def score(self, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each text; every text has a passage."""
        if not self.weights:
            return np.full(len(begin) - 1, self.prior)
        return self.forward((features - self.mean) / self.scale, begin)[-1]


def fit(features: np.ndarray, begin: np.ndarray, labels: np.ndarray, hidden: int = 24, attention: int = 12, steps: int = 300,
        rate: float = 0.03, decay: float = 1e-3, seed: int = 7) -> Model:
    """Gradient descent (Adam) on the logistic loss of the labelled texts."""
    if not len(labels):
        return Model()
    prior = float(labels.mean())
    if prior in (0.0, 1.0):
        return Model(prior)
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 0.02
    x = (features - mean) / scale
    shapes = {"encode": (WIDTH, hidden), "shift": (hidden,), "attend": (hidden, attention), "gate": (hidden, attention),
              "rank": (attention,), "score": (hidden,), "bias": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in ("rank", "score") else np.zeros(s) for k, s in shapes.items()}
    model = Model(prior, mean, scale, w)
    m1, m2 = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    for t in range(1, steps + 1):
        seg, h, left, gate, a, z, y = model.forward(x, begin)
        do = (y - labels) / len(labels)
        dz = do[:, None] * w["score"]
        da = (dz[seg] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, begin[:-1])[seg])
        dg = ds[:, None] * w["rank"]
        dl, dr = dg * gate * (1 - left ** 2), dg * left * gate * (1 - gate)
        dh = a[:, None] * dz[seg] + dl @ w["attend"].T + dr @ w["gate"].T
        dp = dh * (1 - h ** 2)
        grads = {"encode": x.T @ dp, "shift": dp.sum(axis=0), "attend": h.T @ dl, "gate": h.T @ dr, "rank": (left * gate).T @ ds,
                 "score": z.T @ do, "bias": do.sum(keepdims=True)}
        for k, g in grads.items():
            g = g + decay * w[k] * (k != "bias")
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] -= rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def held_out(key: str) -> Column:
    """Whether a key belongs to the part that is never learned from: crc32 of its text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(transcripts: DataFrame, labels: DataFrame, key: str = "transcript_id", text: str = "text", label: str = "quality",
          sample: int = 3000, **options) -> Model:
    """Fit the scorer on at most ``sample`` labelled transcripts that are not held out, those with the smallest key hashes.

    Their passages' features come to the driver, nothing else; a null label or key is not learned from. If labels for a key
    repeat, the largest counts. Without two classes the model knows the prior only.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("__label"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(sample)
    body = transcripts.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(
        F.broadcast(chosen), F.col("__key") == F.col(key)).select("__key", "__label", "__text")  # at most ``sample`` rows
    kind = body.dtypes[0][1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [None] * batch.num_rows
            for a, b, x, begin in passage_features(batch.column(2)):
                for r in range(b - a):
                    blobs[a + r] = x[begin[r]:begin[r + 1]].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["key", "label", "x"])

    rows = body.mapInArrow(encode, f"key {kind}, label INT, x BINARY").toArrow().sort_by("key")
    parts = [np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH) for x in rows.column("x")]
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    y = (rows.column("label").to_numpy() > 0).astype(float)
    return fit(np.concatenate(parts).astype(float) if parts else np.zeros((0, WIDTH)), begin, y, **options)


def score_transcripts(transcripts: DataFrame, model: Model, key: str = "transcript_id", text: str = "text") -> DataFrame:
    """key, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    Only the text is looked at. A null text counts as an empty one, which is one empty passage. Repeated rows give repeated
    results; an empty table gives an empty one.
    """
    source = transcripts.select(F.col(key), held_out(key).alias("held_out"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, x, begin in passage_features(batch.column(2)):
                score[a:b] = model.score(x, begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, held_out BOOLEAN, score DOUBLE, predicted INT")
