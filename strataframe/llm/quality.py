"""Operator 10: a byte-level convolutional network in numpy that scores text quality.

A document is cut into overlapping chunks of CHUNK bytes that cover all of it. In each chunk learned filters of
8 bytes, 4 apart, read byte embeddings; their responses are max-pooled over the chunk, pass a small dense layer
together with the chunk's size (a short text has fewer chances of a high maximum), and the chunk outputs are
averaged into one logit. The network is fitted on a bounded sample of labelled rows (`fit_rows` a class, taken in hash
order of the id), on all chunks of each, and scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, ship

CHUNK, STEP = 512, 384
GROUP = 4  # bytes between filter positions; a filter reads two groups
DIM, FILTERS, HIDDEN = 8, 48, 24
PAD = 256
FIT_ROWS, EPOCHS, BATCH, RATE = 3000, 14, 64, 4e-3
SOME = 256  # chunks at once
THRESHOLD = 0.7


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """([chunks, CHUNK] byte codes padded with PAD, text of each chunk); every byte of a text is in a chunk, an empty text has one of padding."""
    starts, sizes, owner, base = [], [], [], 0
    for i, t in enumerate(texts):
        ks = np.arange(max(1, -(-(len(t) - (CHUNK - STEP)) // STEP)))
        starts.append(base + ks * STEP)
        sizes.append(np.minimum(len(t) - ks * STEP, CHUNK))
        owner.append(np.full(len(ks), i))
        base += len(t)
    if not texts:
        return np.zeros((0, CHUNK), np.int16), np.zeros(0, np.int64)
    starts, sizes, owner = map(np.concatenate, (starts, sizes, owner))
    raw = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    codes = np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts].astype(np.int16)
    codes[np.arange(CHUNK) >= sizes[:, None]] = PAD
    return codes, owner


class Network:
    """Parameters by name, in float32; `logits` and `fit`."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "bytes": normal(PAD + 1, DIM, scale=0.5), "left": normal(GROUP * DIM, FILTERS, scale=0.18), "right": normal(GROUP * DIM, FILTERS, scale=0.18), "bias": np.zeros(FILTERS, np.float32),
            "dense": normal(FILTERS + 1, HIDDEN, scale=0.2), "shift": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.3), "prior": np.zeros(1, np.float32),
        }
        self.p["bytes"][PAD] = 0

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(max response of each filter in each chunk, its place)."""
        p, n = self.p, len(codes)
        x = p["bytes"][codes].reshape(n, CHUNK // GROUP, GROUP * DIM)
        y = (x.reshape(-1, GROUP * DIM) @ np.hstack((p["left"], p["right"]))).reshape(n, CHUNK // GROUP, 2 * FILTERS)
        y = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
        y[:, 1:][codes[:, GROUP :: GROUP][:, : y.shape[1] - 1] == PAD] = -1e9  # places past the text; the first always counts
        at = y.argmax(axis=1)
        return np.take_along_axis(y, at[:, None], 1)[:, 0], at

    def hidden(self, best: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.log1p((codes != PAD).sum(axis=1)) / np.float32(np.log1p(CHUNK))
        a = np.hstack((np.maximum(best + self.p["bias"], 0), 4 * (1 - size[:, None]))).astype(np.float32)
        return a, np.maximum(a @ self.p["dense"] + self.p["shift"], 0)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        codes, owner = cut(texts)
        parts = [self.hidden(self.pooled(codes[a : a + SOME])[0], codes[a : a + SOME])[1] @ self.p["out"] for a in range(0, len(codes), SOME)]
        out = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return np.bincount(owner, weights=out, minlength=len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1) + float(self.p["prior"][0])

    def gradients(self, codes: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the documents; SOME chunks at a time, whatever the documents' lengths."""
        p, held = self.p, []
        for a in range(0, len(codes), SOME):
            best, at = self.pooled(codes[a : a + SOME])
            held.append((at, *self.hidden(best, codes[a : a + SOME])))
        weight = 1 / np.bincount(owner)[owner]
        z = np.bincount(owner, weights=np.concatenate([h @ p["out"] for _, _, h in held]) * weight, minlength=len(y)) + p["prior"][0]
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        total = {k: np.zeros_like(v) for k, v in p.items()}
        total["prior"] += d.sum()
        both = np.vstack((p["left"], p["right"])).T
        for k, (at, a, h) in enumerate(held):
            mine = slice(k * SOME, k * SOME + len(at))
            dz = (d[owner[mine]] * weight[mine]).astype(np.float32)
            dh = dz[:, None] * p["out"] * (h > 0)
            da = (dh @ p["dense"].T * (a > 0))[:, :FILTERS]
            near = codes[mine][np.arange(len(at))[:, None, None], (at * GROUP)[:, :, None] + np.arange(2 * GROUP)]
            seen = p["bytes"][near].reshape(len(at), FILTERS, 2, GROUP * DIM)
            total["out"] += h.T @ dz
            total["dense"] += a.T @ dh
            total["shift"] += dh.sum(0)
            total["bias"] += da.sum(0)
            total["left"] += np.einsum("bf,bfk->kf", da, seen[:, :, 0])
            total["right"] += np.einsum("bf,bfk->kf", da, seen[:, :, 1])
            push = (da[:, :, None] * both).reshape(-1, DIM)
            total["bytes"] += np.stack([np.bincount(near.ravel(), weights=push[:, j], minlength=PAD + 1) for j in range(DIM)], 1).astype(total["bytes"].dtype)
        total["bytes"][PAD] = 0
        return total

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam on the logistic loss, all chunks of BATCH documents at a time, documents in random order."""
        r, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(order), BATCH):
                docs = order[k : k + BATCH]
                t += 1
                rate = RATE * min(1, t / 30) * (1 - t / (steps + 1))
                for name, g in self.gradients(*cut([texts[i] for i in docs.tolist()]), y[docs]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return self

    def constant(self, logit: float) -> Network:
        """The network that gives every text one logit."""
        self.p["out"][:], self.p["prior"][:] = 0, logit
        return self


def held_out(column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves `part`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == part


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network fitted on at most fit_rows labelled rows of each class outside the held-out part.

    Rows whose label is null or not 0 or 1, or whose id is null, are not learned from; an id with both labels counts as
    1. All chunks of the fitted texts are learned from; null texts are empty. Where the labels, or the documents found
    for them, are of one class, every score is 0.982 or 0.018, by that class; without any, 0.5.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id", parts, part))
    rates = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not rates:
        return Network().constant(0.0)
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for k in (0, 1)]
    some = some[0].unionByName(some[1]).groupBy("id").agg(F.max("y").alias("y"))  # at most 2 * fit_rows rows

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, (t or "").encode()) for batch in batches for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not got:
            return
        y = np.array([g[1] for g in got], np.float64)
        if 0 < y.sum() < len(y):
            own = Network().fit([g[2] for g in got], y)
            own.p["prior"] += np.float32(np.log(rates[1] / rates[0]) - np.log(y.sum() / (len(y) - y.sum())))
        else:
            own = Network().constant(8.0 * y[0] - 4)
        yield pa.RecordBatch.from_pydict({"name": list(own.p), "shape": [list(v.shape) for v in own.p.values()], "raw": [v.astype("<f4").tobytes() for v in own.p.values()]}, schema=pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("raw", pa.binary())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("id", "y", "text")
    made = rows.repartition(1).mapInArrow(train, "name string, shape array<long>, raw binary").collect()  # fitted in one task of an executor
    net = Network().constant(0.0)
    for r in made:
        net.p[r["name"]] = np.frombuffer(bytes(r["raw"]), "<f4").reshape(r["shape"]).copy()
    return net


def score_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and held_out, score, predicted (these three replace columns of the same name).

    Null and empty texts are scored as a chunk of padding. Rows are scored one by one, so repeats get equal scores;
    no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net.p)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(id_col, parts, part).alias("held"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = sent.value
        for part_, texts in rows_of(batches):
            score = 1 / (1 + np.exp(-own.logits(texts)))
            yield pa.RecordBatch.from_arrays([*part_.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part_.schema.names[1:], "score", "predicted"])

    schema = held.drop("text").schema.add("score", "double").add("predicted", "integer")
    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("held").alias("held_out"), "score", "predicted")
