"""The registered queries of the corpus operators, with SQL restatements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.llm import (
    chosen_path,
    cuckoo_dedup,
    decontaminate,
    disclosure,
    factorisation,
    filter_audit,
    line_windows,
    phrases,
    pivotal_mix,
    ppm_language,
    relative_lz,
    training_order,
    warc_dict,
)
from undula.llm.common import crc_part, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_training_order")
def op1_training_order(spark, sf_dir):
    found = training_order.ordered(table(spark, sf_dir, "documents"))
    return found.select("slot", "shard", "sequence", "n_tokens", "doc_ids", "tokens_sha256")


@query(
    "op2_decontaminate",
    f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(w[s + 1 : s + k], ' ') AS win FROM (
    SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, s, k, item_id FROM dw JOIN iw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op3_disclosure")
def op3_disclosure(spark, sf_dir):
    found = disclosure.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in disclosure.PATTERNS], F.sha2(disclosure.span_text(F.col("base")), 256).alias("base_sha256"),
        disclosure.span_text(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


@query(
    "op4_cuckoo_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
)
def op4_cuckoo_dedup(spark, sf_dir):
    found = cuckoo_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op5_ppm_language")
def op5_ppm_language(spark, sf_dir):
    docs, part = table(spark, sf_dir, "documents"), crc_part("doc_id", 4)
    found = ppm_language.identify(docs, part != 2)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op6_factorisation_machine")
def op6_factorisation_machine(spark, sf_dir):
    part = crc_part("doc_id", 3)
    found = factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 1)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_chosen_path_join")
def op7_chosen_path_join(spark, sf_dir):
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


@query(
    "op8_line_windows",
    """
WITH p AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM (
    SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, i, t, row_number() OVER d - 1 AS s, count(*) OVER (PARTITION BY doc_id) AS m,
    lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2
    FROM p WHERE t <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, s, i AS lo, CASE least(m, 3) WHEN 1 THEN i WHEN 2 THEN i1 ELSE i2 END AS hi,
    CASE least(m, 3) WHEN 1 THEN t WHEN 2 THEN t || chr(10) || t1 ELSE t || chr(10) || t1 || chr(10) || t2 END AS win
    FROM f WHERE s <= m - least(m, 3)),
r AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(len(string_split(text, chr(10))), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN k USING (doc_id)
""",
)
def op8_line_windows(spark, sf_dir):
    found = line_windows.deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op9_pivotal_mix")
def op9_pivotal_mix(spark, sf_dir):
    found = pivotal_mix.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(
    "op10_warc",
    """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes < 1000 OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM p JOIN g USING (payload_digest)
""",
)
def op10_warc(spark, sf_dir):
    found = warc_dict.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op11_phrases",
    rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[s + 1 : s + k], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT lang, k, phrase, a, i, array_to_string(w[1 : i], ' ') AS x, array_to_string(w[i + 1 : k], ' ') AS y FROM (
    SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT u.lang, u.phrase, u.a, min({{'score': 2000000::HUGEINT * a // (l.f + r.f), 'i': i, 'l': l.f, 'r': r.f}}) AS best
    FROM u JOIN f l ON l.lang = u.lang AND l.k = i AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.k = u.k - i AND r.phrase = y GROUP BY ALL),
b AS (SELECT lang, array_to_string(w[t + 1 : t + m], ' ') AS phrase, max(a) AS most FROM (
    SELECT lang, w, a, m, unnest(range(0, k - m + 1)) AS t FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
e AS (SELECT lang, phrase, a, best FROM s LEFT JOIN b USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, CAST(best.l AS BIGINT) AS l, CAST(best.r AS BIGINT) AS r, n, CAST(best.score AS BIGINT) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank FROM e) JOIN n USING (lang) WHERE rank <= 2000
""",
)
def op11_phrases(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents"))


@query(
    "op12_relative_lz",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS win FROM (
    SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
g AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win),
h AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM v JOIN g USING (win) WHERE least < doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d) ANTI JOIN h USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
)
def op12_relative_lz(spark, sf_dir):
    found = relative_lz.deduplicate_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op13_filter_audit",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(string_split('ABCDE', '')) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS p, 0 AS step, '' AS letter, 0 AS bit, 0 AS earlier, 0 AS applied
    UNION ALL SELECT p || f.letter, step + 1, f.letter, f.bit, applied, applied | f.bit FROM o JOIN f ON applied & f.bit = 0),
r AS (SELECT part, w.p AS filter_order, o.step, o.letter,
    sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, (SELECT p FROM o WHERE step = 5) w JOIN o ON o.step > 0 AND starts_with(w.p, o.p) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
""",
)
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
