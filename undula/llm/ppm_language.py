"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the orders 0 .. ``ORDER``: how often a byte followed the bytes
before it. With total T and D distinct followers of a context, a byte seen c times there costs
-log2(c / (T + D)) bits; an unseen one costs the escape -log2(D / (T + D)) and is coded in the context
that is one byte shorter; below order 0 any byte costs 8 bits. Counts are frozen before scoring, so
the code length of a text is exact and does not depend on order or partitioning. The language with
the shortest code is predicted; the score is its share of the probabilities 2^-bits.

Texts are lower-cased, runs of other ASCII than letters become one space, and the context before
the first byte is spaces. A long text is worked off in pieces that know the bytes before them. The
trees are fitted on a bounded sample: of each language ``PER_LANGUAGE`` training documents by hash,
whole, and no more rows than that where a doc_id is in many. A share by hash is drawn from the counts first, so that only a few times
the sample is ranked. The grams of all languages
share one table with a column per language in which the escapes are already followed, so one lookup
scores a position for all languages.

Defined cases: ``und`` with score 0 if the text is null or has no letters, or if nothing was learned;
equal code lengths go to the smallest language name; rows without lang, text or doc_id teach nothing;
repeated rows get equal results; an empty table gives no rows. ``keep_identified`` drops texts without
letters and, where languages were learned, texts for which each takes ``EXCESS_BITS`` more than the plain bytes; the others go on with
the predicted language. Without learned languages texts with letters go on as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from undula.llm.common import bounded, fresh

ORDER = 4
#: Bound of the training sample, in documents per language (at most 1000, so that it is cut before its shuffle).
PER_LANGUAGE = 400
#: A text is in no learned language if each takes so many bits more than the plain bytes: odds of 2 ** 40, which a few
#: odd letters do not reach. Unseen scripts cost about 3 bits a byte more, letters at random less than 8 in all.
EXCESS_BITS = 40.0
UNKNOWN = "und"
CHUNK = 1 << 20
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 0x20 for b in range(256))
GRAMS = "lang string, size int, gram long, n long"


def normalised(text: str | None) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) if text else b""


def has_letters(text: str | None, form: bytes) -> bool:
    return bool(form) and (any(97 <= b <= 122 for b in form[:64]) or form.translate(None, bytes(range(97, 123))) != form
                           or any(c.isalpha() for c in text))


def grams(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``part_grams`` of whole forms."""
    return part_grams([(b" " * ORDER, f) for f in forms])


def part_grams(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes up to each position of each part as a number, and the end of each part.

    A part is (the ORDER bytes before it, its bytes).
    """
    data = np.frombuffer(b"".join(lead + body for lead, body in parts), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(body) for _, body in parts), np.int64, len(parts))
    starts = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    own = np.ones(len(data), bool)
    own[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    found = data.copy()
    for back in range(1, ORDER + 1):
        found[back:] |= data[:-back] << np.uint64(8 * back)
    return found[own], np.cumsum(lengths)


def pieces(forms: list[bytes]):
    """(numbers of the forms, parts) of at most CHUNK bytes; a longer form is cut."""
    numbers, parts, size = [], [], 0
    for k, f in enumerate(forms):
        for at in range(0, len(f), CHUNK):
            body = f[at : at + CHUNK]
            if parts and size + len(body) > CHUNK:
                yield np.array(numbers), parts
                numbers, parts, size = [], [], 0
            numbers.append(k)
            parts.append(((b" " * ORDER + f[max(0, at - ORDER) : at])[-ORDER:], body))
            size += len(body)
    if parts:
        yield np.array(numbers), parts


def count_grams(sample: DataFrame) -> DataFrame:
    """lang, size, gram, n of a sample (text, lang)."""

    def run(batches):
        for frame in batches:
            for lang, part in frame.groupby("lang"):
                for _, parts in pieces([f for f in map(normalised, part["text"]) if f]):
                    whole, _ = part_grams(parts)
                    for size in range(1, ORDER + 2):
                        keys, n = np.unique(whole & np.uint64((1 << 8 * size) - 1), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "size": size, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    return sample.select("lang", "text").mapInPandas(run, GRAMS).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _start(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys by open addressing: the key and the row (-1: free) of each slot."""
    bits = max(4, int(len(keys) * 2).bit_length())
    held, rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
    left, at = np.arange(len(keys)), _start(keys, bits)
    while len(left):
        free = rows[at] < 0
        rows[at[free]] = left[free]
        done = rows[at] == left
        held[at[done]] = keys[left[done]]
        left, at = left[~done], (at[~done] + 1) & (len(rows) - 1)
    return held, rows


def find(places: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The row of each key, -1 for none."""
    held, slots = places
    at = _start(keys, len(slots).bit_length() - 1)
    rows = slots[at]
    wrong = np.flatnonzero((rows >= 0) & (held[at] != keys))
    while len(wrong):
        at[wrong] = (at[wrong] + 1) & (len(slots) - 1)
        rows[wrong] = slots[at[wrong]]
        wrong = wrong[(rows[wrong] >= 0) & (held[at[wrong]] != keys[wrong])]
    return rows


def build_model(counts: pd.DataFrame) -> dict:
    """langs, and per order the places of grams, their bits, the places of contexts, their escapes."""
    langs = sorted(counts["lang"].unique())
    if not langs:
        return {"langs": [], "levels": []}
    column = {lang: k for k, lang in enumerate(langs)}
    levels = []
    for size in range(1, ORDER + 2):
        part = counts[counts["size"] == size]
        keys, row = np.unique(part["gram"].to_numpy().astype(np.uint64), return_inverse=True)
        c = np.zeros((len(keys), len(langs)))
        c[row, part["lang"].map(column).to_numpy()] = part["n"].to_numpy()
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, of, c)
        np.add.at(distinct, of, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            seen = np.log2((total + distinct)[of] / c)
        if levels:
            shorter = levels[-1]["bits"][find(levels[-1]["grams"], keys & np.uint64((1 << 8 * (size - 1)) - 1))]
        else:
            shorter = np.full((len(keys), len(langs)), 8.0)
        bits = np.where(c > 0, seen, escape[of] + shorter).astype(np.float32)
        levels.append({"grams": placed(keys), "bits": bits, "contexts": placed(contexts), "escapes": escape.astype(np.float32)})
    return {"langs": langs, "levels": levels}


def code_bits(model: dict, whole: np.ndarray) -> np.ndarray:
    """Bits of each position in each language."""
    out = np.zeros((len(whole), len(model["langs"])), np.float32)
    left = np.arange(len(whole))
    for order in range(ORDER, -1, -1):
        level = model["levels"][order]
        keys = whole[left] & np.uint64((1 << 8 * (order + 1)) - 1)
        rows = find(level["grams"], keys)
        hit = rows >= 0
        out[left[hit]] += level["bits"][rows[hit]]
        left, keys = left[~hit], keys[~hit]
        rows = find(level["contexts"], keys >> np.uint64(8))
        known = rows >= 0
        out[left[known]] += level["escapes"][rows[known]]
    out[left] += 8.0
    return out


def score_texts(model: dict, texts) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits beyond those of plain bytes of each text; the bits are null for a text that is not coded."""
    forms = [normalised(t) for t in texts]
    names, scores, rates = [UNKNOWN] * len(forms), [0.0] * len(forms), [None] * len(forms)
    use = [k for k, f in enumerate(forms) if has_letters(texts[k], f)] if model["langs"] else []
    kept = [forms[k] for k in use]
    bits = np.zeros((len(kept), len(model["langs"])))
    for numbers, parts in pieces(kept):
        whole, ends = part_grams(parts)
        np.add.at(bits, numbers, np.add.reduceat(code_bits(model, whole).astype(np.float64), np.concatenate(([0], ends[:-1]))))
    if use:
        best = bits.argmin(axis=1)
        least = bits.min(axis=1, keepdims=True)
        share = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
        for k, f, lang, s, b in zip(use, kept, best, share, least[:, 0]):
            names[k], scores[k], rates[k] = model["langs"][lang], float(s), float(b) - 8.0 * len(f)
    return names, scores, rates


def fit(docs: DataFrame, is_training: Column, per_language: int = PER_LANGUAGE) -> dict:
    """The model of the rows of ``docs`` (doc_id, text, lang) for which ``is_training`` holds."""
    rows = docs.filter(is_training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # A share of each language, four times the sample on average, is drawn where the rows are; only those are ranked.
    counts = rows.groupBy("lang").agg(F.count("*").alias("__n"))
    place = F.xxhash64(F.lit("draw"), "doc_id")
    share = F.least(F.lit(1 << 20), F.ceil((1 << 20) * (4.0 * per_language + 64) / F.col("__n")))
    drawn = rows.select("doc_id", "lang").join(bounded(counts, 100_000), "lang").filter(F.pmod(place, F.lit(1 << 20)) < share)
    ranked = drawn.select("doc_id", "lang").distinct().withColumn("__rank", F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id")))
    chosen = ranked.filter(F.col("__rank") <= per_language).select("doc_id", "lang")
    found = rows.filter("text is not null").select("doc_id", "lang", "text").join(bounded(chosen, 100_000), ["doc_id", "lang"], "left_semi")
    again = W.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text"))
    sample = found.withColumn("__rank", F.row_number().over(again)).filter(F.col("__rank") <= per_language)
    return build_model(count_grams(sample).toPandas())


def predict(docs: DataFrame, model: dict, out: str) -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, excess (bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, excess double")
    def run(text: pd.Series) -> pd.DataFrame:
        names, scores, rates = [], [], []
        for at in range(0, len(text), 500):
            n, s, b = score_texts(shared.value, text.iloc[at : at + 500].tolist())
            names += n
            scores += s
            rates += b
        return pd.DataFrame({"lang": names, "score": scores, "excess": pd.array(rates, "Float64")})

    return docs.withColumn(out, run.asNondeterministic()("text"))


def identify(docs: DataFrame, is_training: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    model = fit(docs, is_training, per_language)
    found = predict(docs.select("doc_id", "text"), model, "__found")
    return found.select("doc_id", F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))


def keep_identified(docs: DataFrame, is_training: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` in their predicted languages, without the rows that have none; the other columns as they were."""
    model = fit(docs, is_training, per_language)
    if not model["langs"]:
        letters = F.pandas_udf(lambda text: text.map(lambda t: has_letters(t, normalised(t))), "boolean")
        return docs.filter(letters.asNondeterministic()("text"))
    name = fresh(docs, "found")
    found = predict(docs, model, name)
    kept = found.filter((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.excess") <= EXCESS_BITS))
    return kept.select(*[F.col(f"{name}.lang").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
