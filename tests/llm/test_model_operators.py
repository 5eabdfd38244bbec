"""Language identification, quality, sanitisation: held-out accuracy and definitions by hand."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import corpora
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from undula.llm import disclosure, factorisation, ppm_language, queries
from undula.llm.common import crc_part, word_hashes

SF = "/root/testdata/sf0.001"


class PlainTree:
    """The same context tree with dictionaries, one byte at a time."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ppm_language.ORDER + 1)]
        for form in filter(None, map(ppm_language.normalised, texts)):
            data = b" " * ppm_language.ORDER + form
            for i in range(ppm_language.ORDER, len(data)):
                for k in range(ppm_language.ORDER + 1):
                    self.seen[k][data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, total = b" " * ppm_language.ORDER + ppm_language.normalised(text), 0.0
        for i in range(ppm_language.ORDER, len(data)):
            for k in range(ppm_language.ORDER, -1, -1):
                followers = self.seen[k].get(data[i - k : i])
                if not followers:
                    continue
                t, d = sum(followers.values()), len(followers)
                if data[i] in followers:
                    total += math.log2((t + d) / followers[data[i]])
                    break
                total += math.log2((t + d) / d)
            else:
                total += 8
        return total


def test_code_lengths_equal_a_plain_tree(spark):
    texts = {"en": ["the cat sat on the mat", "a dog"], "de": ["die Katze saß auf der Matte", "ÜBER 12 uns"]}
    rows = [(k, t, lang, "s") for k, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])]
    model = ppm_language.fit(corpora.docs_df(spark, rows), F.lit(True))
    assert model["langs"] == ["de", "en"]
    trees = {lang: PlainTree(texts[lang]) for lang in texts}
    for text in ("the mat", "die Matte über", "xyz 漢字", "q", "A cat, the DOG."):
        whole, ends = ppm_language.grams([ppm_language.normalised(text)])
        got = ppm_language.code_bits(model, whole).sum(axis=0)
        assert got == pytest.approx([trees["de"].bits(text), trees["en"].bits(text)], rel=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op5_ppm_language(spark, SF).join(docs, "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row["n"] > 20 and row["a"] > 0.95
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES, extra=True)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in ppm_language.identify(docs, crc_part("doc_id", 4) != 2).collect()]
    assert len(found) == len(corpora.EDGES)
    assert {i for i, lang, _ in found if lang == "und"} == {None, 1, 2, 6, 7}
    assert all(s == 0 for _, lang, s in found if lang == "und")
    assert {r["doc_id"] for r in ppm_language.keep_identified(docs, F.lit(True)).collect()} == {None, 3, 4, 5, 8, 9}
    untaught = ppm_language.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert ppm_language.identify(docs.limit(0), F.lit(True)).count() == 0


def test_prediction_ignores_lang_source_and_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ppm_language.fit(docs, crc_part("doc_id", 4) != 2)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a, b = (ppm_language.predict(d, model, "f").select("doc_id", "f.lang", "f.score").orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


def test_word_hashes_depend_on_the_word_alone():
    a, b = word_hashes([b"ab", b"c", b"ab"]), word_hashes([b"c", b"abc", b"ab"])
    assert a[0] == a[2] == b[2] and a[1] == b[0] and len({*a.tolist(), *b.tolist()}) == 3
    many = word_hashes([str(k).encode() for k in range(20_000)])
    assert len(set(many.tolist())) == 20_000


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    model = {"w0": 0.3, "w": rng.normal(size=50).astype(np.float32), "v": rng.normal(size=(50, 4)).astype(np.float32)}
    index, value = np.array([3, 7, 20, 41, 5]), rng.normal(size=5).astype(np.float32)
    got, _ = factorisation.raw_scores(model, index, value, np.array([0, 3]))
    for y, (a, b) in zip(got, ((0, 3), (3, 5))):
        i, x = index[a:b], value[a:b]
        pairs = sum(model["v"][i[p]] @ model["v"][i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p + 1, len(i)))
        assert y == pytest.approx(0.3 + model["w"][i] @ x + pairs, rel=1e-4)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = queries.op6_factorisation_machine(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in found]
    assert len(right) > 80 and sum(right) / len(right) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found)


def test_quality_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES, extra=True)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, None), (None, 1), (77, 1), (9, 1)], "doc_id long, quality int")
    found = factorisation.classify(docs, labels, F.lit(True)).collect()
    assert len(found) == len(corpora.EDGES) and all(0 <= r["score"] <= 1 for r in found)
    one = factorisation.classify(docs, labels.filter("quality = 1"), F.lit(True)).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.5
    assert factorisation.classify(docs, labels.limit(0), F.lit(True)).count() == len(corpora.EDGES)
    assert factorisation.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def luhn(digits):
    pairs = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in pairs) % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, *m.span()) for kind, pattern, holds in rules for m in re.finditer(pattern, text or "") if holds(m[0])]


PII = [
    "mail a.b@c.de, x@y@z.org é🙂 q@r +d@e.f.g; a@b.c+d@e.f p@q..r", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3 1..2.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1112 5500000000000004x 1 2 3",
    "+49 (30) 1234-5678. +1 2 +12345678901234567 ++4 915 123 456-", "12" * 5000, "a" * 20_000, "a@b" + ".c" * 3000, "1." * 4000, "+1 " + "5 " * 4000, "9 " * 3000, "", None,
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    texts = PII + ["".join(rng.choice("ab1234567890@.+- ()é🙂") for _ in range(300)) for _ in range(60)]
    got = corpora.by_id(disclosure.find_spans(corpora.docs_df(spark, texts, extra=True)))
    for k, text in enumerate(texts):
        assert [tuple(s) for s in got[k]["base"]] == brute_base(text), k


def test_disclosing_terms_are_found(spark):
    rng = random.Random(6)
    common = [corpora.prose(rng, 60, 20).replace("w", "word") for _ in range(200)]
    told = [f"{corpora.prose(rng, 30)} Zanzibaria mailto boss@corp.example wordy {corpora.prose(rng, 30)}" for _ in range(4)]
    texts = [f"{t} wordy" for t in common] + told + ["Zanzibaria far away"]
    docs = corpora.docs_df(spark, texts)
    found = corpora.by_id(disclosure.find_spans(docs))
    words = lambda k: {(s["kind"], texts[k][s["start"] : s["end"]]) for s in found[k]["terms"]}
    for k in range(200, 204):
        # log(205 * 4 / (4 * 5)) / log(205 / 4) = 0.943 and 1: both go; the frequent word stays.
        assert words(k) == {("removed", "Zanzibaria"), ("removed", "mailto")}
    assert all(not found[k]["terms"] and not found[k]["base"] for k in (*range(200), 204))
    clean = corpora.by_id(disclosure.sanitised(docs))
    assert "  [email] wordy" in clean[200]["text"] and "Zanzibaria" not in clean[200]["text"]
    assert clean[204]["text"] == texts[204] and clean[0]["text"] == texts[0]


def test_a_single_document_discloses(spark):
    rng = random.Random(7)
    common = [corpora.prose(rng, 60, 20).replace("w", "word") + " wordy" for _ in range(200)]
    told = "Zanzibaria wordy boss@corp.example Quillonia +49 30 1234567"
    docs = corpora.docs_df(spark, [*common, told, *["Quillonia"] * 3])
    found = corpora.by_id(disclosure.find_spans(docs))
    # 1 for the word of one document; log(204 / 4) / log(204) = 0.74 for that of four; wordy is in nearly all.
    assert {(s["kind"], told[s["start"] : s["end"]]) for s in found[200]["terms"]} == {("removed", "Zanzibaria"), ("general", "Quillonia")}
    assert all(not found[k]["terms"] for k in found if k != 200)


def test_sanitising_edges(spark):
    docs = corpora.docs_df(spark, [*corpora.EDGES, (20, "+4111 1111 1111 1111 end", "en", "s")], extra=True)
    assert disclosure.find_spans(docs).count() == len(corpora.EDGES) + 1
    clean = corpora.by_id(disclosure.sanitised(docs))
    assert clean[2]["text"] is None and clean[1]["text"] == "" and clean[9]["text"] == "long " * 30_000
    assert clean[20]["text"] in ("[phone] end", "+[card] end")
    assert disclosure.find_spans(docs.limit(0)).count() == 0


def brute_terms(texts):
    """(kind, start, end) of the terms of each text by plain counts over distinct texts."""
    whole = {t or "" for t in texts}
    bases = {t: brute_base(t) for t in whole}
    words = {t: {w.lower() for w in regex.findall(r"\p{L}+", t) if len(w) >= disclosure.LETTERS} for t in whole}
    near, n_c, n_t, n_ct = {}, Counter(), Counter(), Counter()
    for t in whole:
        near[t] = set()
        for kind, a, b in bases[t]:
            # A word that the window's edge may cut is no term of it.
            low, high = max(0, a - disclosure.WINDOW), b + disclosure.WINDOW
            for m in [*regex.finditer(r"\p{L}+", t[:a], pos=low), *regex.finditer(r"\p{L}+", t[:high], pos=b)]:
                whole_word = (m.start() > low or low == 0) if m.start() < a else m.end() < high
                apart = all(m.end() <= x or y <= m.start() for _, x, y in bases[t])
                if whole_word and apart and len(m[0]) >= disclosure.LETTERS:
                    near[t].add((f"{kind}:{t[a:b].lower()}", m[0].lower(), *m.span()))
        n_c.update({f"{kind}:{t[a:b].lower()}" for kind, a, b in bases[t]})
        n_t.update(words[t])
        n_ct.update({x[:2] for x in near[t]})
    out = {}
    for t in whole:
        best = {}
        for c, term, a, b in near[t]:
            information = math.log2(len(whole) / n_c[c])
            degree = math.log2(len(whole) * n_ct[c, term] / (n_c[c] * n_t[term])) / information if information else 0
            assert min(abs(degree - x) for x in (disclosure.GENERALISE, disclosure.REMOVE)) > 1e-9
            if degree >= disclosure.GENERALISE:
                best[a, b] = max(best.get((a, b), "general"), "removed" if degree >= disclosure.REMOVE else "general")
        out[t] = sorted((kind, *place) for place, kind in best.items())
    return out


def disclosing_texts(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    facts = ["boss@corp.example", "10.2.3.4", "4111 1111 1111 1111", *[f"u{k}@c.de" for k in range(30)], *[f"+49 30 12345{k}" for k in range(10, 40)]]
    texts = []
    for _ in range(150):
        words = [rng.choice(names[: rng.choice((8, 60, 900))]) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.choice((0, 0, 1, 3))):
            words.insert(rng.randrange(len(words)), rng.choice(facts))
        texts.append(rng.choice((" ", ", ", "-")).join(words))
    return [*texts, *rng.sample(texts, 40), *[texts[3]] * 30, "", None]


def test_terms_equal_brute_force(spark):
    texts = disclosing_texts(11)
    expected = brute_terms(texts)
    found = corpora.by_id(disclosure.find_spans(corpora.docs_df(spark, texts, extra=True)))
    assert sum(map(len, expected.values())) > 100
    for k, text in enumerate(texts):
        assert [tuple(s) for s in found[k]["terms"]] == expected[text or ""], k


def test_the_sieve_marks_every_copied_text(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("same"), "id")
    copies = rows.filter("id % 3 = 0").select("same")
    alone, marked = disclosure._sieved(rows, copies)
    assert marked.filter("id % 3 = 0").count() == copies.count() and alone.count() + marked.count() == 20_000
    assert marked.filter("id % 3 <> 0").count() < 20
    assert disclosure._sieved(rows, copies.limit(0))[0].count() == 20_000


def test_copies_do_not_hide_what_discloses(spark):
    rng = random.Random(8)
    common = [corpora.prose(rng, 40).replace("w", "word") for _ in range(300)]
    told = "Zanzibaria sends boss@corp.example to Quillonia"
    once = corpora.by_id(disclosure.find_spans(corpora.docs_df(spark, [*common, told])))[300]["terms"]
    found = corpora.by_id(disclosure.find_spans(corpora.docs_df(spark, [*common, *[told] * 100])))
    assert len(once) == 3 and all(found[k]["terms"] == once for k in range(300, 400))


def test_very_many_matches_in_one_text(spark):
    numbers = "".join(f"{10 + k % 90} x " for k in range(100_000)) + "4111 1111 1111 1111"
    mails = " ".join(f"word u{k}@example.org" for k in range(20_000))
    texts = [numbers, mails, *[f"word {k}" for k in range(50)]]
    start = time.time()
    found = corpora.by_id(disclosure.find_spans(corpora.docs_df(spark, texts)))
    assert [tuple(s) for s in found[0]["base"]] == brute_base(numbers) and len(found[1]["base"]) == 20_000
    assert [tuple(s) for s in found[1]["base"]] == brute_base(mails)
    assert time.time() - start < 120


def test_sanitised_texts_equal_plain_replacement(spark):
    mails = " ".join(f"wörd u{k}@example.org" for k in range(5_000)) + "🙂" * 3_000 + " a@b.c"
    docs = corpora.docs_df(spark, [*disclosing_texts(5), mails, "🙂 word" * 900 + " x@y.zz +4111 1111 1111 1111"], extra=True)
    found, clean = corpora.by_id(disclosure.find_spans(docs)), corpora.by_id(disclosure.sanitised(docs))
    for row in docs.collect():
        text, out, at = row["text"], [], 0
        for s in sorted([*found[row["doc_id"]]["base"], *found[row["doc_id"]]["terms"]], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], {"removed": "", "general": "[word]"}.get(s["kind"], f"[{s['kind']}]")]
            at = max(at, s["end"])
        assert clean[row["doc_id"]]["text"] == (None if text is None else "".join(out) + text[at:])
