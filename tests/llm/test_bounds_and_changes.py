"""Long texts in pieces, bounded samples, deletions, many sources, odd columns."""

import hashlib
import math
import random

import corpora
import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import cuckoo_dedup, decontaminate, factorisation, pivotal_mix, ppm_language
from undula.llm.common import attach, cut_lineage


# --- language


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    texts = [corpora.prose(rng, 400), "kurz", corpora.prose(rng, 90), "漢字 " * 50]
    rows = [(k, t, ("en", "de", "en", "zh")[k], "s") for k, t in enumerate(texts)]
    docs = corpora.docs_df(spark, rows)
    whole = ppm_language.fit(docs, F.lit(True))
    want = ppm_language.score_texts(whole, texts)
    for size in (1, 3, 64, 1000):
        monkeypatch.setattr(ppm_language, "CHUNK", size)
        if size > 60:
            again = ppm_language.fit(docs, F.lit(True))
            assert all(np.array_equal(a["bits"], b["bits"]) for a, b in zip(whole["levels"], again["levels"]))
        got = ppm_language.score_texts(whole, texts)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2], rel=1e-5)


def test_the_sample_bounds_rows(spark, monkeypatch):
    seen, count = [], ppm_language.count_grams
    monkeypatch.setattr(ppm_language, "count_grams", lambda s: (seen.append({r["lang"]: r["count"] for r in s.groupBy("lang").count().collect()}), count(s))[1])
    rows = [(1, f"text number {k}", "en", "s") for k in range(300)] + [(k, f"wort {k}", "de", "s") for k in range(2, 60)]
    ppm_language.fit(corpora.docs_df(spark, rows), F.lit(True), 20)
    assert seen == [{"en": 20, "de": 20}]


def test_the_model_decides_which_documents_stay(spark):
    rows = [(k, "the cat sat on the mat and the dog ran", "en", "s") for k in range(20)]
    rows += [(30, "漢字仮名交じり文", None, "s"), (31, "the mat and the cat", "zz", "s"), (32, "?! 12", "en", "s"), (33, None, "en", "s")]
    docs = corpora.docs_df(spark, rows, extra=True).withColumn("__found", F.lit("clash"))
    kept = ppm_language.keep_identified(docs, F.col("doc_id") < 30)
    assert kept.columns == docs.columns
    langs = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert set(langs) == {*range(20), 31} and langs[31] == "en"
    untaught = ppm_language.keep_identified(docs, F.lit(False))
    assert {r["doc_id"]: r["lang"] for r in untaught.collect()} == {**{k: "en" for k in range(20)}, 30: None, 31: "zz"}


# --- exact deduplication


def test_deletion_leaves_the_largest_live_document(spark):
    docs = corpora.docs_df(spark, [(k, t, "en", "s") for k, t in ((3, "a"), (9, "A"), (9, "a"), (5, "b"), (None, "c"), (7, "c"), (1, "d"))])
    name = lambda t: hashlib.sha256(t.encode()).digest()

    def content(index):
        found = {}
        for row in index.collect():
            found |= cuckoo_dedup._loaded(row).content
        return found

    index, live = cuckoo_dedup.build_index(docs, buckets=3), cut_lineage(cuckoo_dedup.members(docs))
    gone = corpora.docs_df(spark, [(k, t, "en", "s") for k, t in ((9, "a"), (9, "a"), (5, "B"), (7, "c"), (77, "never"))])
    new = corpora.docs_df(spark, [(20, "d", "en", "s"), (21, "e", "en", "s")])
    after = cuckoo_dedup.update_index(index, new, gone, live)
    assert content(after) == {name("a"): [3, 1], name("c"): [None, 1], name("d"): [20, 2], name("e"): [21, 1]}
    filters = [cuckoo_dedup._loaded(r) for r in after.collect()]
    assert all(d in f.filter for f in filters for d in f.content) and sum(len(p) for f in filters for p in f.filter.table) == 4
    members = {(bytes(r["digest"]), r["doc_id"]): r["copies"] for r in cuckoo_dedup.changed_members(live, new, gone).collect()}
    assert members == {(name("a"), 3): 1, (name("c"), None): 1, (name("d"), 1): 1, (name("d"), 20): 1, (name("e"), 21): 1}


# --- quality


def test_scores_equal_a_double_loop_over_all_pairs(spark):
    rng = random.Random(3)
    texts = [corpora.prose(rng, n, 60) for n in (3, 40, 120, 1)] + ["A B! 12\nA B! 12\n", "", None, "é漢 " * 9]
    docs = corpora.docs_df(spark, texts + [corpora.prose(rng, 30, 60) for _ in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8, 48)], "doc_id long, quality int, toxic int")
    model = factorisation.fit(docs, labels, F.lit(True))
    got = corpora.by_id(factorisation.score(docs, model))
    for k, text in enumerate(texts):
        index, value, _ = factorisation.features([text], [None if text is None else len(text)])
        words = set(factorisation.words_of(text))
        assert len(index) == len({int(factorisation.word_hashes([w])[0]) & 0xFFFF for w in words}) + factorisation.FACTS
        y = model["w0"] + sum(float(model["w"][i]) * float(x) for i, x in zip(index, value))
        for a in range(len(index)):
            for b in range(a + 1, len(index)):
                y += float(model["v"][index[a]].astype(np.float64) @ model["v"][index[b]].astype(np.float64)) * float(value[a]) * float(value[b])
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-y)), abs=1e-4)


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    rows = [(1, f"good words {k}", "en", "s") for k in range(200)] + [(2, f"bad junk {k % 50}", "en", "s") for k in range(400)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = factorisation.fit(corpora.docs_df(spark, rows), labels, F.lit(True), sample=60)
    assert model["w"].any()
    scores = corpora.by_id(factorisation.score(corpora.docs_df(spark, rows), model))
    assert scores[1]["score"] > scores[2]["score"]
    # Two common words of each kind and a number for each of at most 60 rows.
    assert np.count_nonzero(model["w"][: 1 << factorisation.WORD_BITS]) <= 4 + 60


# --- mixing


def test_many_small_sources_are_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "GROUP_UNITS", 40)
    monkeypatch.setattr(pivotal_mix, "FAN_IN", 2)
    rng = random.Random(5)
    rows = [(k, corpora.prose(rng, rng.randint(1, 60)), "en", f"s{rng.choice([0] * 300 + list(range(60)))}") for k in range(900)]
    found = pivotal_mix.mix(corpora.docs_df(spark, rows)).collect()
    largest, taken, target, of = {}, {}, {}, {r[0]: r[3] for r in rows}
    for r in found:
        s = of[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        largest[s], taken[s], target[s] = max(largest.get(s, 0), r["size"]), taken.get(s, 0) + r["taken"], r["target"]
    assert len(found) == 900 and all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


# --- columns


def test_map_columns_and_taken_names(spark):
    docs = corpora.docs_df(spark, ["a b", "a b", "c", None]).withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("__found", F.lit(1))
    facts = spark.createDataFrame([("a b", 7, 2)], "text string, fact int, n int")
    assert sorted((r["doc_id"], r["fact"]) for r in attach(docs, facts, "text", "n").collect()) == [(0, 7), (1, 7), (2, None), (3, None)]
    assert pivotal_mix.mixed_documents(docs).columns == docs.columns
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
