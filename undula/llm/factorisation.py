"""Quality classification by a factorisation machine.

Features of a text: its distinct words hashed to 2^16 (each 1 / sqrt of their number), statistics of
its structure in steps (length, lines and their repeats, distinct words, shares of capitals, digits,
marks and characters beyond ASCII) and its n_chars as metadata. With weights w and factors v,

    y = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

so all pairwise interactions cost time linear in the features. The score is the logistic function
of y. The machine is fitted by AdaGrad in one task on the features of a bounded sample: the ``SAMPLE`` labelled
training rows that come first by a hash, rows of a repeated doc_id included. Every document is scored over its whole text.

Defined cases: null and empty texts have structure features only; a null n_chars is a step of its
own; labels that are null or without document teach nothing, different labels of a document count each, equal rows once; without two
classes the score is the share of ones, smoothed; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import word_hashes, words_of

WORD_BITS = 16
STEPS = 16
#: Bound of the training sample, in labelled rows.
SAMPLE = 6_000
RANK = 8
EPOCHS = 12
BATCH = 256
RATE = 0.1
DECAY = 1e-5
SEED = 7
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BEYOND = bytes(range(128, 256))
FACTS = 11
DIMENSION = (1 << WORD_BITS) + FACTS * STEPS


def _share(part: int, whole: int) -> int:
    """0 for none, then steps by the square root of the share."""
    return 0 if not part else 1 + min(STEPS - 2, int(math.sqrt(part / whole) * (STEPS - 2)))


def _size(n: int) -> int:
    return min(STEPS - 1, int(n).bit_length())


def structure(text: str, words: list[bytes], distinct: int, n_chars) -> list[int]:
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    of = lambda kinds: _share(n - len(data.translate(None, kinds)) if data else 0, n)
    lines = [x for x in text.split("\n") if x]
    steps = [
        _size(len(words)), _size(len(lines)), _size(len(data) // max(1, len(words))), of(CAPITALS), of(DIGITS), of(MARKS), of(BEYOND),
        _share(distinct, max(1, len(words))), _share(len(lines) - len(set(lines)), max(1, len(lines))),
        _size(max(map(len, words), default=0)), STEPS - 1 if n_chars is None else min(STEPS - 2, int(max(0, n_chars)).bit_length() // 2),
    ]
    return [(1 << WORD_BITS) + k * STEPS + s for k, s in enumerate(steps)]


def features(texts, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of all texts one after another, and where each begins."""
    words = [words_of(t) for t in texts]
    hashes = word_hashes([w for ws in words for w in ws]) & np.uint64((1 << WORD_BITS) - 1)
    index, value, starts, at, total = [], [], [], 0, 0
    for text, ws, n in zip(texts, words, n_chars):
        own = np.unique(hashes[at : at + len(ws)]).astype(np.int64)
        at += len(ws)
        facts = structure(text or "", ws, len(own), n)
        index += [own, np.array(facts)]
        value += [np.full(len(own), 1 / math.sqrt(max(1, len(own))), np.float32), np.ones(len(facts), np.float32)]
        starts.append(total)
        total += len(own) + len(facts)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    return np.concatenate(index), np.concatenate(value), np.array(starts)


def raw_scores(model: dict, index, value, starts) -> tuple[np.ndarray, np.ndarray]:
    """y of each text by the sum-of-squares identity, and the sums of v_if x_i."""
    vx = model["v"][index] * value[:, None]
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat(vx * vx, starts)
    linear = np.add.reduceat(model["w"][index] * value, starts)
    return model["w0"] + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def logistic(y) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(y, np.float64), -60, 60)))


def train(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray) -> dict:
    rng = np.random.default_rng(SEED)
    share = (label.sum() + 1) / (len(label) + 2)
    model = {"w0": math.log(share / (1 - share)), "w": np.zeros(DIMENSION, np.float32),
             "v": rng.normal(0, 0.05, (DIMENSION, RANK)).astype(np.float32)}
    if len(label) == 0 or label.min() == label.max():
        model["v"][:] = 0
        return model
    gw, gv = np.full(DIMENSION, 1e-6, np.float32), np.full((DIMENSION, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            lengths = np.array([len(index[r]) for r in rows])
            i, x = np.concatenate([index[r] for r in rows]), np.concatenate([value[r] for r in rows])
            y, sums = raw_scores(model, i, x, np.cumsum(lengths) - lengths)
            error = (logistic(y) - label[rows]).astype(np.float32) / len(rows)
            e, s = np.repeat(error, lengths), np.repeat(sums, lengths, axis=0)
            used, back = np.unique(i, return_inverse=True)
            dw, dv = np.zeros(len(used), np.float32), np.zeros((len(used), RANK), np.float32)
            np.add.at(dw, back, e * x)
            np.add.at(dv, back, (e * x)[:, None] * (s - model["v"][i] * x[:, None]))
            dw += DECAY * model["w"][used]
            dv += DECAY * model["v"][used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model["w"][used] -= RATE * dw / np.sqrt(gw[used])
            model["v"][used] -= RATE * 0.5 * dv / np.sqrt(gv[used])
            model["w0"] -= RATE * float(error.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int = SAMPLE) -> dict:
    """The machine of ``labels`` (doc_id, quality) on rows for which ``is_training`` holds."""
    usable = labels.filter(is_training & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = usable.orderBy(*order).limit(sample)
    held = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("*", F.xxhash64("text", "n_chars").alias("row"))
    # A doc_id may be in any number of rows, so the bound is on rows and labels together; equal ones are one.
    mixed = F.xxhash64("doc_id", "label", "row")
    picked = held.select("doc_id", "label", "row").distinct().orderBy(mixed, *order[1:], "row").limit(sample)
    rows = held.join(F.broadcast(picked), ["doc_id", "label", "row"]).dropDuplicates(["doc_id", "label", "row"])
    kinds = "doc_id long, label int, row long, index array<int>, value array<float>"

    def extract(batches):
        for frame in batches:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                i, x, starts = features(part["text"].tolist(), _chars(part["n_chars"]))
                cuts = starts[1:]
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in ("doc_id", "label", "row")},
                                    "index": np.split(i.astype(np.int32), cuts), "value": np.split(x, cuts)})

    def learn(batches):
        frames = [f for f in batches if len(f)]
        every = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=["doc_id", "label", "row", "index", "value"])
        every = every.sort_values(["doc_id", "label", "row"], kind="stable")
        model = train(every["index"].tolist(), every["value"].tolist(), every["label"].to_numpy(np.float32))
        yield pd.DataFrame({"w0": [model["w0"]], "w": [model["w"].tobytes()], "v": [model["v"].tobytes()]})

    # Only features of the sample move to the one task that fits the machine.
    made = rows.mapInPandas(extract, kinds).repartition(1).mapInPandas(learn, "w0 double, w binary, v binary").first()
    if made is None:
        return {"w0": 0.0, "w": np.zeros(DIMENSION, np.float32), "v": np.zeros((DIMENSION, RANK), np.float32)}
    return {"w0": made["w0"], "w": np.frombuffer(made["w"], np.float32), "v": np.frombuffer(made["v"], np.float32).reshape(DIMENSION, RANK)}


def _chars(column) -> list:
    return [None if x is None or x != x else int(x) for x in column.tolist()]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), 200):
            i, x, starts = features(text.iloc[at : at + 200].tolist(), _chars(n_chars.iloc[at : at + 200]))
            out.append(logistic(raw_scores(shared.value, i, x, starts)[0]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.select("doc_id", run.asNondeterministic()("text", F.col("n_chars").cast("double")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score."""
    return score(docs, fit(docs, labels, is_training, sample))
