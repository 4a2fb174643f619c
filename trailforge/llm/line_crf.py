"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines before and after it. Training is
on labelled documents, whose lines all take the document's label, by full-batch gradient ascent on the penalised
likelihood. A document's quality is the mean of its lines' forward-backward marginals, weighted by line length,
put through a logistic curve that is fitted on the same training documents.

The model is fitted on a bounded sample: TRAIN_DOCS labelled documents (those with the smallest hashes of their
id), all lines of each. Scores read whole texts, however long, and depend on nothing but the text.

Defined results: null and empty texts are one empty line and get a score like any other; labels that are null or
of ids without a document teach nothing; of conflicting labels the higher counts, and of rows that share an id the smallest text; without usable labels of both
kinds every score is 0.5. Repeated rows each get a row, an empty table gives none. Only doc_id and text, doc_id and quality are read; other columns are
carried along.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, pieces, strings, table, trimmed

TRAIN_DOCS = 4000
#: Lines, padded to the longest document, that are worked on together in fitting.
GROUP_LINES = 1 << 16
STEPS = 80
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\x0b\x0c"
_PROSE = b".,;:'\"()?-"
_SYMBOL = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT + _PROSE)
OWN = 14


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, OWN) of each line by itself, and line lengths in bytes."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    count: dict[bytes, int] = {}
    for x in lines:
        count[x] = count.get(x, 0) + 1
    rows = []
    for x in lines:
        n = len(x)
        ws = x.split()
        k = len(ws)
        m = max(n, 1)
        upper, lower, digit, symbol, prose, space = (n - len(x.translate(None, c)) for c in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _PROSE, _SPACE))
        rows.append((
            min(n, 2000) ** 0.5 / 20, n == 0, upper / m, lower / m, digit / m, symbol / m, prose / m, min(n - upper - lower - digit - symbol - prose - space, n) / m,
            (n - space) / max(k, 1) / 10 if k else 0.0, len(set(ws)) / k if k else 1.0, min(symbol / max(k, 1), 4.0), (count[x] > 1) * 1.0 if n else 0.0, x[-1:] in (b".", b"!", b"?"),
            sum(map(operator.eq, ws, ws[1:])) / k if k else 0.0,
        ))
    return np.array(rows, np.float64), np.array([len(x) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features (lines, 3 * OWN + 1): a line's own, those of the lines before and after it, and a constant."""
    edge = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1))])


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    own, length = own_features(text)
    return with_neighbours(own), length


class Crf:
    """Two states; weights w of state good against bad, and scores t of the four transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray, a: float, b: float):
        self.w, self.t, self.a, self.b = w, t, a, b

    def marginals(self, e: np.ndarray, length: np.ndarray, weight: np.ndarray | None = None):
        """P(good) for padded emissions e (docs, lines); with weights of the docs also the weighted expected transition counts (2, 2)."""
        d, n = e.shape
        f = np.empty((n, d, 2))
        emit = np.exp(np.stack([-np.abs(e) / 2 - e / 2, -np.abs(e) / 2 + e / 2], -1))  # bad, good; the larger is 1
        tr = np.exp(self.t)
        scale = np.empty((n, d))
        for i in range(n):
            x = emit[:, i] if i == 0 else (f[i - 1] @ tr) * emit[:, i]
            scale[i] = x.sum(1)
            f[i] = x / scale[i][:, None]
        back = np.ones((d, 2))
        good = np.empty((d, n))
        trans = np.zeros((2, 2))
        for i in range(n - 1, -1, -1):
            on = (i < length)[:, None]
            back = np.where((i >= length - 1)[:, None], 1.0, back)
            g = f[i] * back
            s = g.sum(1, keepdims=True)
            good[:, i] = (g / s)[:, 1]
            if i:
                y = emit[:, i] * back
                if weight is not None:
                    z = f[i - 1][:, :, None] * tr * y[:, None, :]
                    trans += (z / z.sum((1, 2), keepdims=True) * (on * weight[:, None])[:, :, None]).sum(0)
                back = y @ tr.T
                back /= back.sum(1, keepdims=True)
        if weight is None:
            return good
        return good, trans

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        return self.quality_of([own_features(t) for t in texts])

    def quality_of(self, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The same from own_features()."""
        out = np.empty(len(feats))
        order = sorted(range(len(feats)), key=lambda i: len(feats[i][0]))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            length = np.array([len(feats[i][0]) for i in part])
            flat = np.concatenate([with_neighbours(feats[i][0]) for i in part]) @ self.w
            e = np.zeros((len(part), length.max()))
            e[np.arange(length.max()) < length[:, None]] = flat
            good = self.marginals(np.clip(e, -30, 30), length)
            for r, i in enumerate(part):
                weight = feats[i][1] + 1.0
                out[i] = float(good[r, : length[r]] @ weight / weight.sum())
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        q = np.clip(self.quality(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(q / (1 - q)) + self.b, -30, 30)))

    @staticmethod
    def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Crf:
        return Crf.fit_features([own_features(t) for t in texts], labels, steps)

    @staticmethod
    def fit_features(own: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS) -> Crf:
        feats = [with_neighbours(f) for f, _ in own]
        y = np.array(labels)
        width = 3 * OWN + 1
        crf = Crf(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)
        if len(set(labels)) < 2:
            return crf
        order = sorted(range(len(feats)), key=lambda i: len(feats[i]))
        groups = []
        share = {k: len(y) / (2 * (y == k).sum()) for k in (0, 1)}  # both kinds weigh alike
        while order:
            n = min(256, len(order))
            while n > 1 and n * len(feats[order[n - 1]]) > GROUP_LINES:
                n = (n + 1) // 2
            part, order = order[:n], order[n:]
            length = np.array([len(feats[i]) for i in part])
            x = np.zeros((len(part), length.max(), width))
            for r, i in enumerate(part):
                x[r, : length[r]] = feats[i]
            groups.append((x, length, y[part]))
        m, v = np.zeros(width + 4), np.zeros(width + 4)
        total = sum(int(g[1].sum()) for g in groups)
        for step in range(1, steps + 1):
            grad = np.concatenate([-1e-4 * crf.w, np.zeros(4)])
            for x, length, lab in groups:
                mask = np.arange(x.shape[1]) < length[:, None]
                wt = np.where(lab == 1, share[1], share[0])[:, None]
                good, trans = crf.marginals(np.clip(x @ crf.w, -30, 30), length, wt[:, 0])
                grad[:width] += np.einsum("dl,dlk->k", (lab[:, None] - good) * mask * wt, x) / total
                seen = np.zeros((2, 2))
                for k in (0, 1):
                    seen[k, k] = share[k] * (length[lab == k] - 1).sum()
                grad[width:] += ((seen - trans) / total).ravel()
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            crf.w = crf.w + move[:width]
            crf.t = np.clip(crf.t + move[width:].reshape(2, 2), -2.5, 2.5)
        q = np.clip(crf.quality_of(own), 1e-6, 1 - 1e-6)
        crf.a, crf.b = _logistic(np.log(q / (1 - q)), y)
        return crf


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1) by Newton steps with a small penalty."""
    d, c = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ c, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, d.T @ (y - p) - 1e-2 * c)
        c = c + np.clip(step, -2, 2)
    return max(float(c[0]), 0.0), float(c[1])


def train(docs: DataFrame, labels: DataFrame, held_out=None, train_docs: int = TRAIN_DOCS) -> Crf:
    """Fit on at most train_docs labelled documents; rows of labels where held_out is true are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")  # labels without a document take no place in the sample
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # bounded by train_docs, so it may be broadcast
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [own_features(t) for t in strings(b)]
            cols = [b.column("doc_id"), b.column("quality"), pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "quality", "features", "lengths"])

    # features of the sample's lines come to the driver, not texts: 120 bytes a line
    got = rows.select("doc_id", "text", "quality").mapInArrow(trimmed(run), "doc_id long, quality int, features binary, lengths binary").orderBy("doc_id").collect()
    return Crf.fit_features([(np.frombuffer(r.features).reshape(-1, OWN), np.frombuffer(r.lengths)) for r in got], [r.quality for r in got])


def classify(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs with the columns score and predicted behind their own; own columns of those names give way."""
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = crf.score(strings(b)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(trimmed(run), schema)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    crf = train(docs, table(spark, sf_dir, "labels"), crc_mod(4) == 2)
    held = F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out")
    return classify(docs, crf).select("doc_id", held, "score", "predicted")
