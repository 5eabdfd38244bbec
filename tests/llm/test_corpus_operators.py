"""Jaccard join, mixing, token shards and the pipeline."""

import random
from collections import Counter

import corpora
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from undula.llm import chosen_path, pivotal_mix, training_order


def grams(text):
    w = [b.decode() for b in chosen_path.words_of(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts):
    sets, links, root = [grams(t) for t in texts], Counter(), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


def near_copies(rng, groups=12, words=80):
    texts = []
    for _ in range(groups):
        first = corpora.prose(rng, words, 5000).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(first)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [512, 8])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(chosen_path, "TILE", tile)
    monkeypatch.setattr(chosen_path, "LEAF", tile)
    rng = random.Random(8)
    texts = near_copies(rng) + ["one two", "One, TWO!", "three", "", "", None, "a b c d e", "a b c d e f"]
    docs = corpora.docs_df(spark, texts, extra=True)
    links, root = brute_links(texts)
    got = corpora.by_id(chosen_path.jaccard_join(docs))
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == {k: (root[k], links[k]) for k in range(len(texts))}
    kept = chosen_path.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_join_edges(spark):
    rows = chosen_path.jaccard_join(corpora.docs_df(spark, corpora.EDGES)).collect()
    assert len(rows) == len(corpora.EDGES)
    assert {(r["class_id"], r["n_links"], r["class_size"]) for r in rows if r["doc_id"] in (4, 5)} == {(4, 2, 3)}
    assert {r["n_links"] for r in rows if r["doc_id"] not in (4, 5)} == {0}
    assert chosen_path.jaccard_join(corpora.docs_df(spark, ["a"]).limit(0)).count() == 0
    kept = chosen_path.keep_one_of_each(corpora.docs_df(spark, corpora.EDGES)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", "None", "1", "2", "3", "4", "6", "7", "8", "9"])


def test_runs_reach_the_recall():
    rng = random.Random(1)
    runs = chosen_path.runs_needed(0.99)
    missed = 0
    for _ in range(2000):
        def meet(depth):
            if depth == 0:
                return True
            return any(rng.random() < 0.8 and meet(depth - 1) for _ in range(1 + (rng.random() < 0.25)))

        missed += not any(meet(chosen_path.DEPTH) for _ in range(runs))
    assert missed <= 40


def test_recall_over_the_drawn_coordinates():
    rng = np.random.default_rng(2)
    agree = rng.binomial(chosen_path.COORDINATES, 0.8, 1_000_000)
    met = np.ones(len(agree))
    for _ in range(chosen_path.DEPTH):
        x = agree / chosen_path.COORDINATES * met
        met = 0.75 * x + 0.25 * (1 - (1 - x) ** 2)
    missed = lambda runs: np.where(agree < chosen_path.AGREE, 1, (1 - met) ** runs).mean()
    runs = chosen_path.runs_needed()
    assert missed(runs) <= 0.00101 and missed(runs - 1) > 0.001
    with pytest.raises(ValueError):
        chosen_path.runs_needed(1.0)


def test_shared_counts_of_random_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, 60)).astype(np.uint64) for _ in range(30)] + [np.array([10**15], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = chosen_path.shared_counts(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def water_levels(sizes, order, share=1.5):
    """Share by weight, cap, and share what is left again, until none is above."""
    weights = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while True:
        unit = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if unit * weights[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * weights[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over


def check_mix(rows, docs):
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len((d["text"] or "").split())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = water_levels(sizes, order)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken, longest = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6


@pytest.mark.parametrize("group", [20_000, 10])
def test_mix_meets_targets(spark, monkeypatch, group):
    monkeypatch.setattr(pivotal_mix, "GROUP_UNITS", group)
    monkeypatch.setattr(pivotal_mix, "FAN_IN", 3)
    rng = random.Random(2)
    rows = [(k, corpora.prose(rng, rng.randrange(0, 80)), "en", rng.choice(["a", "a", "a", "b", "c", "é", None, "z"])) for k in range(500)]
    docs = corpora.docs_df(spark, rows, extra=True)
    got = pivotal_mix.mix(docs).collect()
    check_mix(got, docs.collect())
    again = pivotal_mix.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    out = Counter(r["doc_id"] for r in pivotal_mix.mixed_documents(docs).collect())
    assert out == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_rounding_is_unbiased():
    rng = np.random.default_rng(0)
    weights, probs = [3.0, 5.0, 2.0, 8.0, 4.0, 1.0], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3]
    total = np.zeros(6)
    for _ in range(4000):
        out, hold, p = pivotal_mix.pivot(weights, probs, rng.random(6))
        done = np.array([p if x is None else x for x in out])
        assert done @ weights == pytest.approx(np.dot(probs, weights))
        total += done
    assert total / 4000 == pytest.approx(probs, abs=0.04)


def test_mix_edges(spark):
    rows = pivotal_mix.mix(corpora.docs_df(spark, corpora.EDGES)).collect()
    assert len(rows) == len(corpora.EDGES)
    assert len({r["taken"] for r in rows if r["doc_id"] == 4}) == 1
    assert pivotal_mix.mix(corpora.docs_df(spark, ["a"]).limit(0)).count() == 0
    empty = pivotal_mix.mix(corpora.docs_df(spark, ["", None])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in empty} == {(0, 0.0, 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation_and_its_inverse(n):
    slots = training_order.permute(np.arange(n), n, 99)
    assert sorted(slots) == list(range(n))
    assert (training_order.permute(slots, n, 99, back=True) == np.arange(n)).all()
    assert n < 100 or (slots != training_order.permute(np.arange(n), n, 100)).any()


def test_shards_hold_every_token(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).union(corpora.docs_df(spark, corpora.EDGES))
    length, rows, path = 256, 16, str(tmp_path)
    index = training_order.materialise(docs, path, length=length, shard_rows=rows)
    n = index.count()
    assert sorted(r["slot"] for r in index.collect()) == list(range(n))
    read = {r["slot"]: np.frombuffer(r["tokens"], "<u2") for r in training_order.read_slots(spark, path, length, rows).collect()}
    assert sorted(read) == list(range(n))
    for name in tmp_path.glob("shards/part-*"):
        assert name.stat().st_size % (2 * (length + 1)) == 0
    enc = training_order.encoder(training_order.load_ranks(training_order.VOCABULARY))
    end, texts, stream = len(enc._mergeable_ranks), [], []
    slot = {r["sequence"]: r for r in index.collect()}
    for k in range(n):
        stream += read[slot[k]["slot"]][: slot[k]["n_tokens"]].tolist()
    part = []
    for t in stream:
        if t == end:
            texts.append(enc.decode(part))
            part = []
        else:
            part.append(t)
    assert Counter(texts) == Counter(r["text"] for r in docs.collect() if r["text"])
    some = training_order.read_slots(spark, path, length, rows, start=rows + 3, stop=2 * rows + 1).collect()
    assert {r["slot"]: bytes(r["tokens"]) for r in some} == {s: read[s].tobytes() for s in range(rows + 3, min(n, 2 * rows + 1))}
    starts = [(i, s) for r in slot.values() for i, s in zip(r["doc_ids"], r["starts"])]
    assert all(0 <= s < length for _, s in starts)


def test_no_tokens(spark):
    assert training_order.ordered(corpora.docs_df(spark, ["", None])).count() == 0
    assert training_order.ordered(corpora.docs_df(spark, ["a"]).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = start.union(corpora.docs_df(spark, [(10_001, "12 34", "en", "src1"), (10_002, None, "en", "src1")])), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == start.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    identified, distinct, clean, mixed, tokens = seen
    assert identified.count() == start.count() and identified.filter("doc_id > 10000").count() == 0
    texts = {r["doc_id"]: r["text"] for r in identified.collect()}
    order = sorted(texts)
    _, root = brute_links([texts[k] for k in order])
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(order[k] for k in set(root))
    assert clean.join(distinct, "doc_id", "left_anti").count() == 0
    copies = mixed.groupBy("doc_id").count()
    assert copies.filter("count > 2").count() == 0 and copies.join(clean, "doc_id", "left_anti").count() == 0
    ids = tokens.select(F.explode("doc_ids").alias("doc_id")).distinct()
    assert ids.count() == mixed.filter("text <> ''").select("doc_id").distinct().count()
