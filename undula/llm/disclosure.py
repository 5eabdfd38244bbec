"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans are emails, IPv4 addresses, card numbers and phone numbers, found by patterns and checked
(parts up to 255; 13-19 digits that pass Luhn; 9-15 digits). Each distinct match is a protected
entity c. A term t is a word of ``LETTERS`` letters or more, lower-cased, within ``WINDOW`` characters of it.
All counts are of distinct texts, so copies change nothing, whatever their doc_id: N is the number of
texts, n(c) and n(t) count those that hold the entity and the term, n(c,t) those that
hold the term in a window of the entity. The term discloses the entity to the degree

    PMI(c,t) / IC(c) = log(N n(c,t) / (n(c) n(t))) / log(N / n(c)),

1 where the term alone identifies it. From ``GENERALISE`` on, the term is replaced by a general word, from
``REMOVE`` on it is removed, in every window of that entity. Every pair that occurs is scored, also one
of a single document: most entities occur once, and what stands beside those tells most about them.
An entity in all documents has no information and nothing discloses it.

Every pattern is written so that no text makes it slow: runs are possessive and begin where the run
begins, which leaves the leftmost, non-overlapping matches as they are. Places come from running sums
of lengths that double their reach, windows from blocks of the text, and overlaps from a bisection of
the sorted spans, so a text with very many matches costs n log n. Pairs of entity and term are
linear in the text (a window is bounded), counted with pre-aggregation, and return to the documents by
``common.attach``; nothing is gathered per entity. Words are counted by (term, copies of the text): each
of these counts is a multiple of the copies, so the quotient is the exact number of distinct texts. A
sieve of ``SIEVE_BITS`` bits is broadcast, and only texts that it marks move to meet their number of copies.

Defined cases: null texts count as empty; positions are code points, end exclusive; spans of terms
never overlap base spans; rows with equal texts count once and get equal spans; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage, row_key

#: The four base patterns, as possessive Java expressions.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SMALL_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)(?:\.|$)){4}$"
LETTERS = 4
WINDOW = 100
GENERALISE, REMOVE = 0.7, 0.9
LEVELS = ("general", "removed")
#: Code points of the blocks that windows are cut from.
BLOCK = 1024
#: Bits of the sieve of copied texts (8 MB); a full one lets all texts through. A row of it holds SIEVE_ROW bits, as Spark's bitmaps do.
SIEVE_BITS, SIEVE_ROW = 1 << 26, 1 << 15
#: Steps of a bisection; more than any array has places.
BISECTION = [1 << k for k in range(29, -1, -1)]


def _zero() -> Column:
    return F.lit(0).cast("int")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, add) -> Column:
    """Running totals of an array under the associative ``add``, in a round per doubling of the reach."""
    rounds = F.when(F.size(values) > 1, F.transform(
        F.sequence(_zero(), F.ceil(F.log2(F.size(values))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int")
    )).otherwise(F.array().cast("array<int>"))

    def further(acc, reach):
        return F.transform(acc, lambda x, i: F.when(i >= reach, add(F.get(acc, i - reach), x)).otherwise(x))

    return F.aggregate(rounds, values, further)


def _spans(text: Column, pattern: str, holds=None) -> Column:
    """The matches that hold, in order, as array<struct<start,end,match>>."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    holds = holds or (lambda match: F.lit(True))

    def placed(matches):
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, m: gap + F.char_length(m))
        ends = _let(lengths, lambda x: _running(x, lambda a, b: a + b))
        named = F.zip_with(ends, matches, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match")))
        # Places are only worked out where a match holds.
        return F.when(F.exists(matches, holds), F.filter(named, lambda s: holds(s["match"]))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), _zero(), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(SMALL_PARTS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,match>> by kind as listed, then start."""

    def of(kind: str, pattern: str) -> Column:
        none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
        found = _spans(text, pattern, lambda m: _holds(kind, m))
        named = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
        return F.when(F.contains(text, F.lit(NEEDED[kind])), named).otherwise(none) if NEEDED[kind] else named

    return F.concat(*[of(k, p) for k, p in PATTERNS.items()])


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _stretch(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points begin .. end-1 of the text that ``blocks`` make up; each block is touched once."""
    low = lambda j: F.greatest(begin - j * BLOCK, _zero())
    inside = F.sequence(F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
    parts = F.transform(inside, lambda j: F.substring(F.get(blocks, j), low(j) + 1, F.least(end - j * BLOCK, F.lit(BLOCK)) - low(j)))
    return F.when(end > begin, F.array_join(parts, "")).otherwise(F.lit(""))


def _cut(blocks: Column, begin: Column, length: Column) -> Column:
    """The substring of at most BLOCK code points from ``begin`` of the text that ``blocks`` make up."""
    at = F.floor(begin / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return F.substring(two, begin - at * BLOCK + 1, length)


def _before(spans: Column, place: Column) -> Column:
    """How many of the sorted ``spans`` start before ``place``."""
    steps = F.array(*[F.lit(d) for d in BISECTION])
    return F.aggregate(steps, _zero(), lambda at, d: F.when(F.get(spans, at + d - 1)["start"] < place, at + d).otherwise(at))


def _meeting(spans: Column, begin: Column, end: Column) -> Column:
    """Those of the sorted, disjoint ``spans`` that meet begin .. end-1, and at most one before them."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    first, last = F.greatest(_before(spans, begin) - 1, _zero()), _before(spans, end) - 1
    found = F.transform(F.sequence(first, last), lambda i: F.struct(F.get(spans, i)["start"].alias("start"), F.get(spans, i)["end"].alias("end")))
    return F.when(last >= first, found).otherwise(none)


def _near(blocks: Column, kinds: Column, span: Column) -> Column:
    """Terms within the window of a base span that overlap none of the base spans, which ``kinds`` lists by kind."""
    word = r"\p{L}++"
    begin = F.greatest(span["start"] - WINDOW, _zero())
    left = _spans(_cut(blocks, begin, span["start"] - begin), word)
    left = F.filter(left, lambda s: (begin == 0) | (s["start"] > 0))
    right = _spans(_cut(blocks, span["end"], F.lit(WINDOW)), word)
    right = F.filter(right, lambda s: s["end"] < WINDOW)
    entity = _entity(span)

    def named(words, by):
        long = F.filter(words, lambda s: s["end"] - s["start"] >= LETTERS)
        return F.transform(long, lambda s: F.struct(entity.alias("entity"), F.lower(s["match"]).alias("term"),
                                                    (s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    around = F.flatten(F.transform(kinds, lambda spans: _meeting(spans, begin, span["end"] + WINDOW)))
    return _let(around, lambda base: F.filter(F.concat(named(left, begin), named(right, span["end"])), lambda t: ~_overlaps(t, base)))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["match"]))


def near_terms(text: Column, base: Column) -> Column:
    """array<struct<entity,term,start,end>> of the terms in the windows of the base spans; null without any."""
    kinds = F.transform(F.array(*[F.lit(k) for k in PATTERNS]), lambda k: F.filter(base, lambda s: s["kind"] == k))
    every = _let(_blocks(text), lambda b: _let(kinds, lambda k: F.flatten(F.transform(base, lambda s: _near(b, k, s)))))
    return F.when(F.size(base) > 0, every)


def _overlaps(term: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (term["start"] < b["end"]) & (b["start"] < term["end"]))


def _sieved(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that have no copy for certain, and those that may have one, by a sieve of the keys in ``copies``."""
    place = F.pmod(F.xxhash64("same"), F.lit(SIEVE_BITS))
    line, bit = F.floor(place / SIEVE_ROW), place % SIEVE_ROW
    sieve = copies.groupBy(line.alias("__line")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    met = rows.join(F.broadcast(sieve), line == F.col("__line"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return met.filter(~marked).select(rows.columns), met.filter(marked).select(rows.columns)


def _disclosing(base: DataFrame, docs: DataFrame) -> DataFrame:
    """pair, level, rows: pairs of entity and term that exceed a threshold."""
    near = base.select("same", F.explode("near").alias("x")).select("same", "x.entity", "x.term")
    pairs = near.groupBy("entity", "term", "same").agg(F.count("*").alias("rows"))
    pairs = cut_lineage(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.sum("rows").alias("rows")))
    entities = base.select("same", F.explode("base").alias("b")).select("same", _entity(F.col("b")).alias("entity"))
    entities = entities.distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    copies = cut_lineage(base.groupBy("same").agg(F.count("*").alias("copies")).filter("copies > 1"))
    n = float(base.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0))
    words = F.array_distinct(F.split(F.lower("text"), r"\P{L}++"))
    long = F.explode(F.filter(words, lambda w: F.char_length(w) >= LETTERS)).alias("term")
    alone, marked = _sieved(docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("same", row_key("text")), copies)
    marked = attach(marked, copies.withColumn("n", F.col("copies")), "same", "copies")
    terms = alone.select(F.lit(1).cast("long").alias("n"), long).union(marked.select(F.coalesce("n", F.lit(1)).alias("n"), long))
    terms = terms.groupBy("term", "n").agg(F.count("*").alias("rows"))
    terms = terms.groupBy("term").agg(F.sum(F.expr("rows div n")).alias("n_t"))
    # A frequent word stands beside very many entities, and a frequent entity beside very many words.
    entities = cut_lineage(entities.join(pairs.groupBy("entity").agg(F.count("*").alias("n_pairs")), "entity"))
    terms = cut_lineage(terms.join(pairs.groupBy("term").agg(F.count("*").alias("n_pairs")), "term"))
    joined = attach(attach(pairs, entities, "entity", "n_pairs").drop("n_pairs"), terms, "term", "n_pairs")
    information = F.log2(F.lit(n) / F.col("n_c"))
    pmi = F.log2(F.lit(n) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    degree = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    level = F.when(degree >= REMOVE, 1).when(degree >= GENERALISE, 0)
    return joined.select(F.concat_ws("\n", "entity", "term").alias("pair"), level.alias("level"), "rows").filter("level is not null")


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, base and terms (arrays of kind, start, end)."""
    whole = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    base = whole.select("doc_id", "key", "text", base_spans(F.col("text")).alias("base"))
    base = cut_lineage(base.select("doc_id", "key", row_key("text").alias("same"), "base", near_terms(F.col("text"), F.col("base")).alias("near")))
    disclosing = cut_lineage(_disclosing(base, docs))
    places = base.select("key", F.explode("near").alias("x")).select("key", "x.start", "x.end", F.concat_ws("\n", "x.entity", "x.term").alias("pair"))
    hit = attach(places, disclosing, "pair", "rows").filter("level is not null")
    hit = hit.groupBy("key", "start", "end").agg(F.max("level").alias("level"))
    name = F.when(F.col("level") == 1, LEVELS[1]).otherwise(LEVELS[0])
    terms = hit.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(name.alias("kind"), "start", "end"))).alias("terms"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return base.join(terms, "key", "left").select("doc_id", "key", plain.alias("base"), F.coalesce("terms", empty).alias("terms"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text with base spans as [kind], general terms as [word], removed ones gone."""
    found = find_spans(docs).select("key", "base", "terms").dropDuplicates(["key"]).filter("size(base) + size(terms) > 0")
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    rows = keyed.join(found, "key", "left")
    spans = F.array_sort(F.concat(
        F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ))
    text = F.col("text")

    def label(s):
        return F.when(s["kind"] == "removed", "").when(s["kind"] == "general", "[word]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    def replaced(blocks, spans, reach):
        # A span that begins inside those before it only lengthens them.
        places = F.sequence(_zero(), F.size(spans) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))
        pieces = F.transform(heads, lambda i: F.concat(
            _stretch(blocks, F.coalesce(F.get(reach, i - 1), _zero()), F.get(spans, i)["start"]), label(F.get(spans, i))
        ))
        return F.concat(F.array_join(pieces, ""), _stretch(blocks, F.element_at(reach, -1), F.char_length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    clean = _let(_blocks(text), lambda b: _let(spans, lambda s: _let(_running(ends, F.greatest), lambda r: replaced(b, s, r))))
    return rows.select("doc_id", F.when(F.col("base").isNull(), text).otherwise(clean).alias("text"))
