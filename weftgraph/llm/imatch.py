"""I-Match fingerprints, in DataFrame functions only.

Terms are runs of letters and digits in lower case, known by their 64-bit hash.  Document frequencies
come from all documents; the lexicon keeps the terms of an inverse-document-frequency band.  Since a
term of the band stands in at least a share e**-max_idf of the documents, the lexicon has at most
(mean distinct terms of a document) * e**max_idf entries however many documents there are; it is broadcast
if it has at most MAX_LEXICON, else joined by a shuffle.  Several randomised lexicon subsets are fixed by the terms' hashes;
a text's distinct terms are sorted, and those of each subset are hashed.  Coarse subsets change with
almost any edit, fine ones survive larger edits, so the share of equal signatures is a likeness.

A text without a term of the lexicon is hashed by all its sorted terms, a text without terms by its
characters, in every subset's place.

Each document's text meets the next one's (descending doc_id) without a global sort: a sortable key (doc_id,
then a hash of the text) is cut into ranges by a sample, each range's greatest document is sent to the next
range too, and a window runs in each range.  Texts are shuffled once.  Many rows of one doc_id, or without
one, spread over ranges by their texts.

Edge cases: null texts count as empty; a null doc_id comes last in descending order; repeated doc_ids
are ordered by the hash of their texts, for the edit and for near_next alike (equal rows are alike, so their
order does not matter); texts are taken whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import saved

#: Subsets: of each rate (one term in so many) so many subsets.
RATES = ((4, 2), (16, 4), (48, 8), (96, 8), (256, 8))
SUBSETS = sum(n for _, n in RATES)
NO_TERM = 0  # stands in every text, in no subset
MAX_LEXICON = 2_000_000


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct terms."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _mask(h: Column) -> Column:
    """Bit k: the term with this hash is in subset k."""
    out, k = F.lit(0), 0
    for rate, n in RATES:
        for _ in range(n):
            out = out.bitwiseOR(F.when(F.pmod(F.xxhash64(F.lit(101 + k), h), F.lit(rate)) == 0, F.lit(1 << k)).otherwise(F.lit(0)))
            k += 1
    return out.cast("int")


def lexicon(docs: DataFrame, min_idf: float = 0.7, max_idf: float = 5.0) -> DataFrame:
    """(h, mask) of the terms with min_idf <= ln(documents / documents with the term) <= max_idf."""
    counted = (
        docs.select(F.explode(F.concat(F.array(F.lit(NO_TERM).cast("long")), terms(F.coalesce("text", F.lit(""))))).alias("h"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    )
    counted = saved(counted)
    n = counted.filter(F.col("h") == NO_TERM).agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
    idf = F.log(F.lit(float(n)) / F.col("df"))
    band = counted.filter((F.col("h") != NO_TERM) & idf.between(min_idf, max_idf)).select("h", _mask(F.col("h")).alias("mask"))
    return band.union(docs.sparkSession.range(1).select(F.lit(NO_TERM).cast("long"), F.lit(0)))


def _hex(x: Column) -> Column:
    """A long as 16 digits, in the order of its unsigned value."""
    return F.lpad(F.hex(x), 16, "0")


def _key(docs: DataFrame) -> Column:
    """A text whose order is that of (doc_id, null first; hash of the text)."""
    c = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        own = _hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63))))  # the sign's bit turned: signed order
    else:
        own = F.hex(F.encode(c.cast("string"), "UTF-8"))
    return F.concat(F.coalesce(F.concat(F.lit("1"), own), F.lit("0")), F.lit("!"), _hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def _list(items: list, kind: str) -> Column:
    """A constant array: one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, items))), ",").cast(f"array<{kind}>")


def paired(docs: DataFrame, rows_per_range: int = 1000, max_ranges: int = 16_384, per_range: int = 8) -> DataFrame:
    """doc_id, text, key and next_text, in ranges `r`; rows with `ghost` only lend their text.

    Of the keys about per_range for each range reach the driver, then one for each range: at most
    max_ranges * (per_range + 1) short texts, however many rows there are (ranges then hold more of them).
    """
    n = docs.count()
    k = max(1, min(max_ranges, n // rows_per_range))
    key = _key(docs)
    cuts = []
    if k > 1:
        found = sorted({x[0] for x in docs.sample(False, min(1.0, per_range * k / n), 7).select(key).collect()})
        cuts = [found[i * len(found) // k] for i in range(1, k)] if found else []
        cuts = sorted(set(cuts))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    own = own.withColumn("r", _rank(F.col("key"), cuts))
    tops = dict(own.groupBy("r").agg(F.max("key")).collect())  # a row for each range
    if not tops:
        return own.select("doc_id", "text", "key", "r", F.lit(False).alias("ghost"), F.lit("").alias("next_text"))
    order = sorted(tops)
    after = dict(zip(order, order[1:] + order[:1]))
    span = range(len(cuts) + 1)
    is_top = F.col("key") == F.get(_list([tops.get(i, "") for i in span], "string"), F.col("r"))
    place = lambda r, ghost: F.struct(r.alias("r"), F.lit(ghost).alias("ghost"))
    here, there = place(F.col("r"), False), place(F.get(_list([after.get(i, 0) for i in span], "int"), F.col("r")), True)
    sent = own.withColumn("to", F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("r").orderBy(F.desc("ghost"), "key")
    return sent.select("doc_id", "text", "key", "to.r", "to.ghost").withColumn("next_text", F.lag("text").over(w))


def _rank(x: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are at most x, by bisection."""
    if not cuts:
        return F.lit(0)
    known, steps = _list(cuts, "string"), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    forward = lambda low, step: F.when(F.get(known, low + step - 1) <= x, low + step).otherwise(low)  # noqa: E731  (null past the end)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), forward)


def _signatures(found: Column, fallback: Column) -> Column:
    """The subsets' hashes over sorted (h, mask) terms, as hexadecimal text; empty where a subset has
    no term of the text."""
    one = lambda k: F.filter(found, lambda t: t["mask"].bitwiseAND(F.lit(1 << k)) != 0)
    sign = lambda ts: F.when(F.size(ts) > 0, F.hex(F.xxhash64(F.transform(ts, lambda t: t["h"])))).otherwise(F.lit(""))
    return F.when(F.size(found) > 0, F.array(*(sign(one(k)) for k in range(SUBSETS)))).otherwise(F.array_repeat(fallback, SUBSETS))


def _likeness(a: Column, b: Column) -> Column:
    """Equal signatures among the subsets in which either text has a term."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    told = F.filter(both, lambda v: v.isNotNull())
    share = F.aggregate(told, F.lit(0), lambda s, v: s + v) / F.size(told)
    return F.when(F.size(told) > 0, share).otherwise((a == b).cast("double")).cast("double")


def imatch(docs: DataFrame, **band) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and the arrays of signatures own, edited and next."""
    lex = saved(lexicon(docs, **band))
    small = lex.count() <= MAX_LEXICON
    rows = (
        paired(docs)
        .withColumn("edited", F.when(F.col("ghost"), F.lit("")).otherwise(F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) / 2 as int))"), F.expr("substring(next_text, 1, cast(length(text) / 2 as int))"))))
        .select("r", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                "key", terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"),
                F.hex(F.xxhash64("text")).alias("raw_a"), F.hex(F.xxhash64("edited")).alias("raw_b"))
        .withColumns({"raw_a": F.when(F.size("a") > 0, F.hex(F.xxhash64("a"))).otherwise(F.col("raw_a")), "raw_b": F.when(F.size("b") > 0, F.hex(F.xxhash64("b"))).otherwise(F.col("raw_b"))})
    )
    # One row for each term and side; what belongs to the document goes with the term that all have.
    own = F.struct("ghost", "doc_id", "n_chars", "edited_sha256", "key", "raw_a", "raw_b")
    term = lambda h, side, doc: F.struct(h.cast("long").alias("h"), F.lit(side).alias("side"), doc.alias("doc"))
    side = lambda c, bit: F.transform(c, lambda h: term(h, bit, F.when(F.lit(False), own)))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    told = rows.select("r", "rid", F.explode(F.concat(F.array(term(F.lit(NO_TERM), 0, own)), side("a", 1), side("b", 2))).alias("t")).select("r", "rid", "t.*")
    pick = lambda bit: F.array_sort(F.collect_list(F.when(F.col("side") == bit, F.struct("h", "mask"))))
    # All rows of a range lie in one partition already, so with a broadcast this aggregate needs no exchange.
    found = told.join(F.broadcast(lex) if small else lex, "h").groupBy("r", "rid").agg(pick(1).alias("fa"), pick(2).alias("fb"), F.first("doc", ignorenulls=True).alias("doc"))
    signed = found.select("r", "doc.*", _signatures(F.col("fa"), F.col("doc.raw_a")).alias("own"), _signatures(F.col("fb"), F.col("doc.raw_b")).alias("edited"))
    w = Window.partitionBy("r").orderBy(F.desc("ghost"), "key")
    return signed.withColumn("next", F.lag("own").over(w)).filter(~F.col("ghost")).drop("r", "ghost", "key", "raw_a", "raw_b")


def imatch_digest(docs: DataFrame) -> DataFrame:
    got = imatch(docs)
    return got.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", ".").alias("fingerprint"), F.array_join("edited", ".").alias("edited_fingerprint"),
        _likeness(F.col("own"), F.col("edited")).alias("near_edited"), _likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
