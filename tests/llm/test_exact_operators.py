"""Decontamination, exact and line deduplication, and WARC archives against brute force."""

import hashlib
import random
import re

import corpora
import pytest

from undula.llm import cuckoo_dedup, decontaminate, line_windows, warc_dict
from undula.llm.common import attach, components, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words_follow_the_pattern():
    for text in ("Ab, c-d É9_x\n`y{z", None, "", "…ünï 漢字"):
        assert [w.decode() for w in words_of(text)] == words(text)


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        k = min(13, len(v))
        if not k:
            continue
        windows = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)}
        for s in range(len(w) - k + 1):
            if tuple(w[s : s + k]) in windows:
                hit |= set(range(s, s + k))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [None, 200])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    items = [(k, corpora.prose(rng, n, 30)) for k, n in enumerate((40, 13, 14, 5, 1, 60, 12))] + [(90, "..."), (91, None), (92, "")]
    items += [(93, items[0][1].upper()), (94, "w1 w1 " * 10)]
    texts = [corpora.prose(rng, 200, 30) for _ in range(8)]
    texts += [f"{corpora.prose(rng, 50)} {items[k][1]}, {corpora.prose(rng, 20)}" for k in (0, 1, 2, 5, 6)]
    texts += [" ".join(items[0][1].split()[4:25]), items[5][1].replace(" ", "--\n"), "w1 " * 40, "", None, "!!"]
    docs = corpora.docs_df(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = corpora.by_id(decontaminate.find_contamination(docs, bench))
    for k, text in enumerate(texts):
        n, hits, found = brute_hits(text, items)
        row = got[k]
        assert (row["n_words"], row["n_hit"], list(row["items"])) == (n, hits, found), k
        assert row["contaminated"] == (hits > 0 and 20 * hits >= n)
        assert sum(len(words(text[s["start"] : s["end"]])) for s in row["spans"]) == hits
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["contaminated"]}


def test_contamination_edges(spark):
    docs = corpora.docs_df(spark, corpora.EDGES)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).filter("n_hit > 0").count() == 0
    odd = spark.createDataFrame([(None, "same text here")], "item_id long, text string")
    rows = decontaminate.find_contamination(docs, odd).filter("n_hit > 0").collect()
    assert [(r["n_hit"], list(r["items"])) for r in rows] == [(3, [])] * 3
    assert decontaminate.find_contamination(docs.limit(0), odd).count() == 0


def test_cuckoo_filter_grows_and_forgets():
    index, digests = cuckoo_dedup.LiveIndex(8), [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k, d in enumerate(digests):
        index.insert(d, k, 1)
        index.insert(d, k + 10_000, 2)
    assert index.resizes > 0 and len(index.content) == 5000
    assert all(index.content[d] == [k + 10_000, 3] and d in index.filter for k, d in enumerate(digests))
    for d in digests[:2500]:
        index.delete(d, 3)
    assert all(d in index.filter for d in digests[2500:])
    # Two candidate buckets of four 16-bit marks: false hits are rare.
    assert sum(d in index.filter for d in digests[:2500]) < 25
    index.delete(hashlib.sha256(b"never").digest(), 1)


def test_deduplicate_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cuckoo_dedup, "BUCKET_DIGESTS", 7)
    rng = random.Random(5)
    texts = [rng.choice(("Aa", "aA", "b", "Éa", "éa", "", None, f"u{k}")) for k in range(60)]
    docs = corpora.docs_df(spark, texts, extra=True)
    keep = {}
    for k, t in enumerate(texts):
        keep.setdefault("".join(c.lower() if c < "\x80" else c for c in t or ""), []).append(k)
    want = {k: (max(g), len(g), k == max(g)) for g in keep.values() for k in g}
    got = {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in corpora.by_id(cuckoo_dedup.deduplicate(docs)).items()}
    assert got == want
    edges = cuckoo_dedup.deduplicate(corpora.docs_df(spark, corpora.EDGES)).collect()
    assert len(edges) == len(corpora.EDGES)
    assert sorted(r["kept"] for r in edges if r["doc_id"] == 4) == [False, False]
    assert [r["keep_id"] for r in edges if r["doc_id"] is None] == [2, None]
    assert cuckoo_dedup.deduplicate(docs.limit(0)).count() == 0


def test_index_inserts_and_deletes(spark):
    old = corpora.docs_df(spark, ["a", "b", "b", "c"])
    index = cuckoo_dedup.build_index(old, buckets=4)
    changed = cuckoo_dedup.update_index(index, corpora.docs_df(spark, ["d", "a"], first=10), corpora.docs_df(spark, ["c", "b"]))
    content = {}
    for row in changed.collect():
        content |= cuckoo_dedup._loaded(row).content
    name = lambda t: hashlib.sha256(t.encode()).digest()
    assert content == {name("a"): [11, 2], name("b"): [2, 1], name("d"): [10, 1]}


def brute_lines(texts):
    seen, gone = {}, {}
    for k, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
        w = min(3, len(full))
        for s in range(len(full) - w + 1 if w else 0):
            part = full[s : s + w]
            window = tuple(x for _, x in part)
            if window in seen:
                gone.setdefault(k, set()).update(range(part[0][0], part[-1][0] + 1))
            else:
                seen[window] = (k, s)
    return gone


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    lines = ["", " ", "a", "b ", "\tb", "c", "d"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "", "a", "a", "a\na\na\na\na"]
    gone = brute_lines(texts)
    got = corpora.by_id(line_windows.deduplicate_lines(corpora.docs_df(spark, texts, extra=True)))
    for k, text in enumerate(texts):
        want = text
        if k in gone:
            want = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[k])
        assert (got[k]["text"], got[k]["n_removed"]) == (want, len(gone.get(k, ()))), k
    edges = line_windows.deduplicate_lines(corpora.docs_df(spark, corpora.EDGES)).collect()
    assert len(edges) == len(corpora.EDGES) and all(r["n_removed"] == 0 for r in edges)
    assert line_windows.deduplicate_lines(corpora.docs_df(spark, ["x"]).limit(0)).count() == 0


def test_first_occurrence_is_of_one_text(spark):
    # The same or no doc_id, the same place, different texts: all but one lose the header; equal rows share their fate.
    head = "a\nb\nc"
    rows = [(d, f"{head}\nown {k} {d}", None, None) for d in (None, 7) for k in range(3)]
    got = line_windows.deduplicate_lines(corpora.docs_df(spark, [*rows, rows[0]], extra=True)).collect()
    kept = {r["text"] for r in got if r["n_removed"] == 0}
    assert len(kept) == 1 and all("None" in t for t in kept)
    assert all(r["n_removed"] == 3 for r in got if r["text"] not in kept)


PAGES = [
    (1, "http://a/ b\n", "x" * 1500), (2, None, "x" * 1500), (3, "http://c", "x" * 999), (4, "u", "x" * 999), (5, "é", "é" * 500), (6, "z", "é" * 500),
    (7, "n", None), (8, "e", ""), (None, "q", "x" * 1500), (2, None, "x" * 1500), (9, "long", "<p>\r\n\r\nWARC/1.1\r\n" * 60_000), (None, "q", "y" * 2000), (None, "r", "y" * 2000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"{tmp_path}/warc"
    warc_dict.write_archives(pages, path)
    rows = warc_dict.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES)
    want = []
    for page_id, url, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        top = max(ids, default=None)
        first = len(data) < 1000 or top is None or page_id == top
        kept = None if url is None else url.replace(" ", "%20").replace("\n", "%0A")
        want.append((page_id, kept, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else top, data if first else None))
    order = lambda r: str(tuple(r))
    got = [(*tuple(r)[:6], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_archives_share_a_dictionary_in_front(spark, tmp_path):
    rng = random.Random(1)
    pages = [(k, f"http://h/{k}", f"<html>{corpora.prose(rng, 200)}</html>") for k in range(300)]
    warc_dict.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/w")
    names = list((tmp_path / "w").glob("part-*"))
    assert names
    for name in names:
        data = name.read_bytes()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(data[4:8], "little") > 0
    assert warc_dict.read_archives(spark, f"{tmp_path}/w").count() == 300
    assert warc_dict.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_attach_serves_heavy_and_light_keys(spark, monkeypatch):
    from undula.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 50)
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(-1, None)], "id long, k string")
    facts = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    got = {r["id"]: r["n"] for r in attach(rows, facts, "k", "n").collect()}
    assert got == {k: 200 if k % 3 else 1 for k in range(300)} | {-1: None}


def test_components_of_paths_and_stars(spark):
    links = [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(100)] + [("s000", f"s{k:03d}") for k in range(200)] + [("x", "x")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"p{k:03d}": "p000" for k in range(101)} | {f"s{k:03d}": "s000" for k in range(200)}
