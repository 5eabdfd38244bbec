"""Phrase collocations, relative Lempel-Ziv deduplication and the filter audit against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import corpora
import numpy as np
import pytest

from undula.llm import filter_audit, phrases, relative_lz
from undula.llm.double_array import DoubleArray


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- double-array trie


def test_trie_accepts_whole_entries_only():
    rng = random.Random(1)
    entries = sorted({(rng.choice(("de", "en")), "".join(rng.choice("abé漢") for _ in range(rng.randint(1, 5))).encode()) for _ in range(300)})
    trie = DoubleArray(entries)
    words = ["".join(rng.choice("abé漢x") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    stream, starts, _ = phrases.word_stream(" ".join(words).encode() + b"\n")
    for lang in ("de", "en", "fr"):
        number = {b: k + 1 for k, (r, b) in enumerate(entries) if r == lang}
        assert trie.accepted(lang, stream, starts).tolist() == [number.get(w.encode(), 0) for w in words]


def test_empty_trie_accepts_nothing():
    stream, starts, _ = phrases.word_stream(b"a b\n")
    assert DoubleArray([]).accepted("en", stream, starts).tolist() == [0, 0]


def test_word_stream_knows_pieces():
    stream, starts, joined = phrases.word_stream(b"  a bb \n c\n\n d e  \n")
    assert stream.tobytes() == b"a bb\nc\nd e\n"
    assert starts.tolist() == [0, 2, 5, 7, 9] and joined.tolist() == [True, False, False, True, False]


# --- phrases


def brute_phrases(rows, support, best):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[s : s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in candidates.items():
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed=4):
    rng = random.Random(seed)
    phrase = ["New York city", "of the", "É漢 z", "a b c d", "a b c d e"]
    rows = []
    for k in range(120):
        parts = [rng.choice(phrase + ["x", "y", "THE", "w", ". ", ",\t", "!\n", "q\x0br"]) for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(parts), rng.choice(("en", "en", "en", "de", None, "und", "")), "s"))
    return rows + [r for r in corpora.EDGES]


@pytest.mark.parametrize("block", [None, 40])
def test_phrases_equal_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
        rows = corpus()[:40]
    else:
        rows = corpus()
    docs = corpora.docs_df(spark, rows, extra=True)
    assert mined(phrases.mine(docs, support=5, best=12)) == brute_phrases([(r[1], r[2]) for r in rows], 5, 12)


def test_small_slices_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    want = brute_phrases([(r[1], r[2]) for r in rows], 8, 2000)
    for name, value in (("CHUNK", 100), ("HELD", 3), ("RANK_PARTS", 3)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(phrases.mine(corpora.docs_df(spark, rows), support=8)) == want


def test_phrase_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES)
    assert phrases.mine(docs.limit(0)).count() == 0
    # "long " 30,000 times is one piece: pairs, triples and fours of it, of which the longest stand for the others.
    assert mined(phrases.mine(docs)) == brute_phrases([(r[1], r[2]) for r in corpora.EDGES], 30, 2000)
    assert phrases.mine(corpora.docs_df(spark, [". ,", "", None])).count() == 0


def test_scores_pass_64_bits(spark):
    a, parts = 6_000_000_000_000_000_000, 7_000_000_000_000_000_000
    known = spark.createDataFrame([("en", 1, "x", parts), ("en", 1, "y", parts), ("en", 2, "x y", a)], "lang string, k int, phrase string, f long")
    assert phrases.scored(known).first()["score"] == 2_000_000 * a // (2 * parts)


# --- relative Lempel-Ziv


def brute_passages(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least = {}
    for (doc_id, _), w in zip(rows, split):
        for s in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[s : s + window])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - window + 1):
            if doc_id is not None and least[tuple(w[s : s + window])] < doc_id:
                gone |= set(range(s, s + window))
        out.append((-1 if doc_id is None else doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def passages(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect())


def shared_texts(seed, n, vocabulary=300):
    """Copies, near copies, passages in other surroundings, repeats inside a text, chains of overlaps."""
    rng = random.Random(seed)
    common = [corpora.prose(rng, k, vocabulary).split() for k in (30, 49, 50, 51, 70, 120, 200)]
    texts = []
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0 and texts:
            w = rng.choice(texts).split()
        elif kind == 1 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        elif kind == 2:
            w = [x for _ in range(3) for x in corpora.prose(rng, rng.randint(0, 40), vocabulary).split() + rng.choice(common)]
        elif kind == 3 and texts:
            a, b = rng.choice(texts).split(), rng.choice(texts).split()
            w = a[rng.randint(0, 40) :] + b[: rng.randint(0, 200)]
        elif kind == 4:
            w = ["same"] * rng.randint(0, 130)
        else:
            w = corpora.prose(rng, rng.randint(0, 300), vocabulary).split()
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,vocabulary", [(1, 300), (2, 3), (3, 40)])
def test_passages_equal_brute_force(spark, seed, vocabulary):
    texts = shared_texts(seed, 90, vocabulary)
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "s"), (None, texts[5], None, "s"), (7, texts[8], "en", "s"), (7, texts[7], "en", "t"), (200, texts[7], "en", "s")]
    docs = corpora.docs_df(spark, rows, extra=True).withColumn("row", corpora.F.lit("clash"))
    got = passages(relative_lz.deduplicate_passages(docs))
    assert got == brute_passages([(r[0], r[1]) for r in rows], 50)


def test_short_windows_and_seeds(spark):
    texts = shared_texts(11, 60, 30)
    docs = corpora.docs_df(spark, texts)
    for window, seed in ((8, 8), (8, 1), (12, 5)):
        assert passages(relative_lz.deduplicate_passages(docs, window, seed)) == brute_passages(list(enumerate(texts)), window)


def test_hot_passage_joined_by_broadcast(spark, monkeypatch):
    from undula.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    texts = shared_texts(6, 80)
    assert passages(relative_lz.deduplicate_passages(corpora.docs_df(spark, texts))) == brute_passages(list(enumerate(texts)), 50)


def test_long_factors_spare_most_checks(spark):
    rng = random.Random(8)
    text = corpora.prose(rng, 2000)
    docs = corpora.docs_df(spark, [text, text, corpora.prose(rng, 500), f"{corpora.prose(rng, 90)} {text} {corpora.prose(rng, 90)}"])
    parses = relative_lz.parsed(relative_lz.indexed(docs, 50, 25)).filter("end - start >= 50")
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in parses.select("doc_id", "start", "end").distinct().collect()}
    assert set(spans) == {1, 3} and all(hi - lo > 1900 for lo, hi in spans.values())
    ranges = relative_lz.open_ranges(relative_lz.parsed(relative_lz.indexed(docs, 50, 25)), 50)
    windows = sum(s["hi"] - s["lo"] + 1 for r in ranges.collect() for s in r["ranges"])
    assert windows < 400


def test_passage_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES)
    got = passages(relative_lz.deduplicate_passages(docs))
    assert got == brute_passages([(r[0], r[1]) for r in corpora.EDGES], 50)
    assert relative_lz.deduplicate_passages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        relative_lz.deduplicate_passages(docs, 10, 11)


def test_range_hashes_do_not_depend_on_place():
    words = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 6], np.uint64)
    r = relative_lz.Ranges(words, relative_lz.ROOTS[0])
    a, b, c = r.of(np.array([0, 5, 0]), np.array([4, 9, 5]))
    assert a == b and a != c


# --- filter audit


def brute_audit(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    docs = defaultdict(list)
    for doc_id, text, _, source in rows:
        text, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id}
        docs[source or ""].append(({x for x, f in fails.items() if f}, doc_id))
    out = []
    for part, members in docs.items():
        shapley, found = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(members)
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                early = sum(x in m[0] for m in members) - len(gone)
                left = [m for m in left if x not in m[0]]
                shapley[x] += len(gone)
                alone = sum(m[0] == {x} for m in members)
                found.append((part, "".join(order), step, len(left), len(gone), early, alone, sum(m[1] in good for m in gone), sum(m[1] in toxic for m in gone)))
        out += [(*f, shapley[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def audited(df):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", *filter_audit.METRICS, "shapley")) for r in df.collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [corpora.prose(rng, rng.choice((10, 49, 50, 80)), rng.choice((20, 400))) for _ in range(40)]
    rows = [(k, rng.choice((t, t.upper(), t + " #", texts[0], "", None)), "en", rng.choice(("a", "b", None, ""))) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a"), (None, None, "en", None), (3, texts[0], "en", "a"), (3, texts[0], "en", "a"), (90, "AB" * 50_000, "en", "b")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = corpora.docs_df(spark, rows, extra=True).withColumn("mask", corpora.F.lit("clash")).withColumn("part", corpora.F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", corpora.F.lit("clash"))
    assert audited(filter_audit.audit_filters(docs, marks)) == brute_audit(rows, labels)


def test_audit_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit_filters(docs, none)) == brute_audit(corpora.EDGES, [])
    assert filter_audit.audit_filters(docs.limit(0), none).count() == 0
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.steps(spark, letters)


def test_recursion_lists_every_prefix_once(spark):
    found = filter_audit.steps(spark, "XYZ").collect()
    prefixes = ["".join(p) for k in (1, 2, 3) for p in itertools.permutations("XYZ", k)]
    assert sorted((r["prefix"], r["mask"]) for r in found) == sorted((p, m) for p in prefixes for m in range(8))
