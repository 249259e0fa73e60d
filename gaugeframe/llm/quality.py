"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

*Word vectors.* Words and runs of symbols are hashed to ``V`` rows. Every row
has a sparse ternary index vector drawn from its number. A pass over all
documents adds the index vectors of the neighbours within two places to a
row's context vector; tasks emit their sums, which have a fixed size.

*Pooling.* A document is the mean of its word vectors, the norm of the mean of
dense random signs (large when few words fill the text), the share of words
that repeat the one before, and the log length; the means are shrunk as if the text had ``PRIOR`` more words of average kind.

*Network.* One hidden tanh layer and a logistic output, trained on a bounded
sample of labelled rows by Adam; a temperature fitted on a part of the sample
that training leaves out calibrates the probabilities.

Null and empty texts are scored as documents without words; texts are read
whole; rows are scored one by one, so ties and repeated rows don't matter, and rows
without an id are scored too. Without labels of either kind every row has one score. Empty
tables give empty results; extra columns are left out by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import emit_array, fold_of, labelled_sample, sample_rows, salts_of, sum_arrays
from .tokens import SPACE, chunks, hash_ranges, mix

FOLDS, HELD_OUT = 4, 2
#: Bound of the labelled sample, for each label.
PER_LABEL = 4000
V, D, NONZERO, BLOCKS = 1 << 13, 32, 4, 16
SIGNS = 16
#: Pooled vector, norm of the signs, repeats, log length.
WIDTH = D + 3
THRESHOLD = 0.7
#: Words of average kind that are added to a document's own.
PRIOR = 8
HIDDEN, STEPS, RATE, DECAY = 24, 600, 0.02, 1e-3

KIND = np.full(256, 2, np.uint8)  # 0: space, 1: letter or digit, 2: other
KIND[SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def rows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed row and the document of each word or run of symbols."""
    kind = KIND[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offs] = True
    edges = np.flatnonzero(cut)
    s, e = edges[:-1], edges[1:]
    keep = kind[s] > 0
    s, e = s[keep], e[keep]
    return (hash_ranges(buf, s, e, fold=True) >> np.uint64(64 - V.bit_length() + 1)).astype(np.int64), np.searchsorted(offs, s, side="right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each row's index vector."""
    seed = mix(np.arange(1, V * NONZERO + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(V, NONZERO)
    return (seed % np.uint64(D)).astype(np.int64), np.where(seed >> np.uint64(63), 1.0, -1.0)


def sign_vectors() -> np.ndarray:
    bits = mix(np.arange(V, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return np.where((bits[:, None] >> np.arange(SIGNS, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0).astype(np.float32)


def context_sums(docs: DataFrame, spark: SparkSession) -> np.ndarray:
    """V x D sums of neighbours' index vectors over all documents."""

    def run(batches):
        at, sign = index_vectors()
        total = np.zeros(V * D)
        for b in batches:
            for _, _, buf, offs in chunks(b.column("text")):
                if not len(buf):
                    continue
                row, doc = rows_of(buf, offs)
                for gap in (1, 2):
                    same = doc[gap:] == doc[:-gap]
                    a, c = row[:-gap][same], row[gap:][same]
                    for k in range(NONZERO):
                        total += np.bincount(a * D + at[c, k], sign[c, k], V * D)
                        total += np.bincount(c * D + at[a, k], sign[a, k], V * D)
        yield emit_array(total, BLOCKS, TaskContext.get().partitionId() % salts)

    salts = salts_of(spark, BLOCKS)
    out = sum_arrays(docs.select("text").mapInArrow(run, "block int, salt int, blob binary"), spark, BLOCKS)
    return np.zeros((V, D)) if out is None else out.astype(np.float64).reshape(V, D)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors at unit length; rows never seen stay zero."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(vec: np.ndarray, signs: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, WIDTH))
    if len(buf):
        row, doc = rows_of(buf, offs)
        if len(row):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            count = np.diff(np.r_[first, len(doc)])
            d = doc[first]
            out[d, :D] = np.add.reduceat(vec[row], first, axis=0) / count[:, None]
            out[d, D] = np.linalg.norm(np.add.reduceat(signs[row], first, axis=0) / count[:, None], axis=1) / np.sqrt(SIGNS)
            again = np.r_[False, (row[1:] == row[:-1]) & (doc[1:] == doc[:-1])]
            out[d, D + 1] = np.add.reduceat(again.astype(float), first) / count
            out[d, D + 2] = np.log1p(count)
    return out


def pool(docs: DataFrame, vec: np.ndarray, spark: SparkSession, keep: list[str]) -> DataFrame:
    """keep and features of every row."""
    shared = spark.sparkContext.broadcast(vec)  # V x D floats

    def run(batches):
        signs = sign_vectors()
        for b in batches:
            x = np.zeros((len(b), WIDTH))
            for i, j, buf, offs in chunks(b.column("text")):
                x[i:j] = pooled(shared.value, signs, buf, offs)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], [*keep, "features"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, features array<double>")


def shrunk(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Pooled means as if each document had PRIOR words more of average kind: few words tell little."""
    n = np.expm1(x[:, -1:])
    return np.column_stack([(x[:, :-1] * n + base * PRIOR) / (n + PRIOR), x[:, -1:]])


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 7) -> dict:
    """Weights of the network and its temperature."""
    base = (x[:, :-1] * w[:, None]).sum(axis=0) / w.sum()
    x = shrunk(x, base)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / std
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 0
    p = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v = {k: np.zeros_like(u) for k, u in p.items()}, {k: np.zeros_like(u) for k, u in p.items()}
    zt, yt, wt = z[~held], y[~held], w[~held] / max(w[~held].sum(), 1e-9)
    for t in range(1, STEPS + 1):
        h = np.tanh(zt @ p["a"] + p["b"])
        g = wt * (1 / (1 + np.exp(-np.clip(h @ p["c"] + p["d"], -30, 30))) - yt)
        back = np.outer(g, p["c"]) * (1 - h * h)
        grad = {"a": zt.T @ back + DECAY * p["a"] / 10, "b": back.sum(axis=0), "c": h.T @ g + DECAY * p["c"] / 10, "d": np.array([g.sum()])}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = p | {"mean": mean, "std": std, "t": 1.0, "base": base}
    raw, yh, wh = logits(net, x[held]), y[held], w[held]
    loss = lambda t: float((wh * np.logaddexp(0, np.where(yh == 1, -raw, raw) / t)).sum())
    net["t"] = min(np.geomspace(0.25, 8, 60), key=loss) if held.any() else 1.0
    return net


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    """Of features that are shrunk already."""
    return (np.tanh((x - net["mean"]) / net["std"] @ net["a"] + net["b"]) @ net["c"] + net["d"]) / net["t"]


def classify(docs: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    vec = word_vectors(context_sums(docs, spark))
    picked, share = labelled_sample(labels, "quality", FOLDS, HELD_OUT, PER_LABEL)
    rows = pool(sample_rows(docs, picked, spark), vec, spark, ["doc_id", "y"]).collect()
    rows = sorted({(r["doc_id"], r["y"], tuple(r["features"])) for r in rows})
    x, y = np.array([r[2] for r in rows]).reshape(len(rows), WIDTH), np.array([r[1] for r in rows], float)
    if len(set(y)) == 2:
        w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
        net = train(x, y, w)
    else:
        net = {"a": np.zeros((WIDTH, 1)), "b": np.zeros(1), "c": np.zeros(1), "d": np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))]), "mean": np.zeros(WIDTH), "std": np.ones(WIDTH), "t": 1.0, "base": np.zeros(WIDTH - 1)}
    shared = spark.sparkContext.broadcast((vec, net))

    def run(batches):
        vec, net = shared.value
        signs = sign_vectors()
        for b in batches:
            out = np.empty(len(b))
            for i, j, buf, offs in chunks(b.column("text")):
                out[i:j] = 1 / (1 + np.exp(-np.clip(logits(net, shrunk(pooled(vec, signs, buf, offs), net["base"])), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
