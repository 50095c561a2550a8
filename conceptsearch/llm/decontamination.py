"""Benchmark decontamination by spaced seeds.

Texts are sequences of lower-cased words without punctuation.  A spaced seed
hashes the words at fixed places of a window and ignores the others, so it
still matches when ignored words were replaced.  Hashes of all windows of
the documents are joined with those of the benchmark; each hit gives a
diagonal (item, offset in the document), on which item and document are
compared word by word.  A document is contaminated by an item when ``SPAN``
consecutive words of the item (all of a shorter one) agree with it but for
``SUBSTITUTED`` of them.  For 13 words and 2 substitutions the two masks are
lossless: wherever the substitutions are, one mask fits between them at some
place.  Items of 9 to 12 words are searched by ``SHORT_MASKS`` too, with which
they are lossless from 9 words on (a test tries all).  Items of fewer than
``MIN_ITEM_WORDS`` words can't be told from chance once words are replaced:
all their words must agree.  Such an item that more than ``COMMON_SHARE`` of
all documents hold is common language ("the") and removes no document; it is
still reported.  Only DataFrame functions are used.

Defined cases: null and empty texts match nothing; items with equal words are
one, under their smallest id; rows that share id and text are one; a null id
is an id; empty tables give an empty result.

Scale: the documents' windows are hashed and probed in the scan, by the masks
that the lengths of the benchmark's items need (two from 13 words on).  The
benchmark's hashes and items are broadcast when a count shows at most
``MAX_BROADCAST_SEEDS`` hashes; then hits are compared where they are found,
one for each run of hits, and only verdicts are shuffled.  Otherwise hashes
are shuffled with the windows, and diagonals join back to the documents by
id; no key there is larger than a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm.tables import fresh, materialise, same

#: Word places that each seed hashes.
MASKS = ((0, 3, 4, 6, 7, 8), (0, 1, 2, 3, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 5, 6), (0, 1, 2, 3, 5, 6), (0, 2, 3, 4, 5, 6), (0, 1, 4, 5, 7, 8),
               (0, 1, 5, 6, 7, 8), (0, 1, 2, 4, 6, 8))
WINDOW = 9
SPAN = 13
SUBSTITUTED = 2
#: Words from which substitutions are allowed.
MIN_ITEM_WORDS = 9
#: Share of all documents from which on a shorter item counts as common words:
#: it is reported by ``leaks`` and ``item_report``, but removes nothing.
COMMON_SHARE = 0.01
#: An item in so few documents removes them, however small the table is.
COMMON_LEAST = 10
#: Common items that are named in the plan; more of them are joined.
MAX_COMMON = 1000
PLACES = 6
#: Places, words from the first to the last of them, and the least and most
#: words of the items that are searched by them.
SEEDS = (*((mask, mask[-1] + 1, MIN_ITEM_WORDS, 2**31 - 1) for mask in MASKS),
         *((mask, mask[-1] + 1, MIN_ITEM_WORDS, SPAN - 1) for mask in SHORT_MASKS),
         *((tuple(range(min(n, PLACES))), n, n, n) for n in range(1, MIN_ITEM_WORDS)))
#: 40 bytes each in the broadcast.
MAX_BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the text's words: letters and digits, lower-cased."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+")
    return F.transform(F.array_remove(cut, ""), lambda w: F.xxhash64(w))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (word hashes) of each distinct item that has words."""
    return (benchmark.select("item_id", word_hashes(F.col("text")).alias("item"))
            .filter(F.size("item") > 0)
            .groupBy("item").agg(F.min("item_id").alias("item_id")))


def _places(rows: DataFrame, words: str, *keep: str, sizes: list[int]) -> DataFrame:
    """keep..., words, at, least, most, p0..., seed: a row for each window and
    mask that items of one of these sizes need."""
    used = [k for k, (_, _, least, most) in enumerate(SEEDS) if any(least <= n <= most for n in sizes)]
    table = F.array(*(_mask(k) for k in used or range(len(MASKS))))
    windows = (rows.select(*keep, words, F.posexplode(words).alias("at", "word"))
               .select(*keep, words, "at", F.inline(table)).filter(F.col("at") + F.col("width") <= F.size(words)))
    return windows.withColumn("seed", F.xxhash64("mask", *(F.get(words, F.col("at") + F.col(f"p{j}")) for j in range(PLACES))))


def _mask(k: int) -> Column:
    """The k-th of SEEDS as a struct; the last place stands for missing ones."""
    places, width, least, most = SEEDS[k]
    named = {"mask": k, "width": width, "least": least, "most": most}
    named |= {f"p{j}": places[min(j, len(places) - 1)] for j in range(PLACES)}
    return F.struct(*(F.lit(v).alias(n) for n, v in named.items()))


def _run_goes_on() -> Column:
    """Whether the window before, on the same diagonal, agrees as well."""
    places = (F.get("words", F.col("at") + F.col(f"p{j}") - 1) == F.get("item", F.col("item_at") + F.col(f"p{j}") - 1)
              for j in range(PLACES))
    return F.coalesce(reduce(Column.__and__, places), F.lit(False))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, text_hash, item_id, best (agreeing words in the best span), agreed
    (in all), words (of the item): a row for each document and item."""
    # an array of one, exploded: else filters on the words cut every text a second time
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"),
                       F.explode(F.array(word_hashes(F.col(text)))).alias("words"))
    held = materialise(items(benchmark), "items")
    sizes = [r["n"] for r in held.select(F.least(F.size("item"), F.lit(SPAN)).alias("n")).distinct().collect()]
    seeds = _places(held, "item", "item_id", sizes=sizes).filter(F.size("item").between(F.col("least"), F.col("most")))
    seeds = materialise(seeds.select("item_id", F.col("at").alias("item_at"), "seed"), "seeds")
    if seeds.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS:
        # an item has a window at least, so the items are bounded as well
        hits = _places(rows, "words", "doc", "text_hash", sizes=sizes).join(F.broadcast(seeds), "seed")
        own = F.broadcast(held.select("item", F.col("item_id").alias("own")))
        hits = hits.join(own, same(F.col("item_id"), F.col("own"))).filter(~_run_goes_on())
        return _compared(hits.withColumn("shift", F.col("at") - F.col("item_at")))
    hits = _places(rows, "words", "doc", "text_hash", sizes=sizes).drop("words").join(seeds, "seed")
    diagonals = hits.select("doc", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    diagonals = materialise(diagonals, "diagonals").toDF("d_doc", "d_hash", "item_id", "shift")
    diagonals = diagonals.join(held.select("item", F.col("item_id").alias("own")), same(F.col("item_id"), F.col("own")))
    return _compared(rows.join(diagonals, same(F.col("doc"), F.col("d_doc")) & (F.col("text_hash") == F.col("d_hash"))))


def _compared(diagonals: DataFrame) -> DataFrame:
    """What ``contaminated`` gives, of doc, text_hash, words, item_id, item, shift."""
    # the part of the document that lies along the item, nulls where there is none
    agree = F.transform("item", lambda w, j: F.coalesce(
        F.when(F.col("shift") + j >= 0, F.get(F.col("words"), F.col("shift") + j)) == w, F.lit(False)).cast("int"))
    span = F.least(F.lit(SPAN), F.size("item"))
    cut = diagonals.select("doc", "text_hash", "item_id", span.alias("span"), agree.alias("agree"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("span") + 1),
                                   lambda s: total(F.slice("agree", s, F.col("span")))))
    found = cut.select("doc", "text_hash", "item_id", "span", best.alias("best"), total(F.col("agree")).alias("agreed"),
                       F.size("agree").alias("words"))
    allowed = F.when(F.col("span") >= MIN_ITEM_WORDS, SUBSTITUTED).otherwise(0)
    return (found.filter(F.col("best") >= F.col("span") - allowed)
            .groupBy("doc", "text_hash", "item_id")
            .agg(F.max("best").alias("best"), F.max("agreed").alias("agreed"), F.first("words").alias("words")))


def item_report(found: DataFrame, documents: int, common_share: float = COMMON_SHARE) -> DataFrame:
    """item_id, words, found (distinct documents that hold the item) and
    removes (whether ``decontaminate`` takes them out) of each item that was
    found, from rows of ``contaminated``."""
    return (found.groupBy("item_id").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("found"))
            .withColumn("removes", (F.col("words") >= MIN_ITEM_WORDS) | (F.col("found") <= max(COMMON_LEAST, common_share * documents))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  common_share: float = COMMON_SHARE) -> DataFrame:
    """The documents that no item contaminates, with their columns unchanged.
    Items that ``item_report`` finds to be common words remove nothing; a
    ``common_share`` of 1 lets every item remove."""
    found = materialise(contaminated(docs, benchmark, text, doc_id), "found")
    common = item_report(found, docs.count(), common_share).filter(~F.col("removes")).select("item_id")
    common = [r["item_id"] for r in common.limit(MAX_COMMON + 1).collect()]
    if len(common) <= MAX_COMMON:
        harmful = found.filter(~F.coalesce(F.col("item_id").isin(common), F.lit(False))) if common else found
    else:
        report = item_report(found, docs.count(), common_share).filter("removes").select(F.col("item_id").alias("own"))
        harmful = found.join(report, same(F.col("item_id"), F.col("own")), "left_semi")
    bad = materialise(harmful.select("doc", "text_hash").distinct(), "contaminated")
    bad_id, bad_hash = fresh(docs, "bad_id", "bad_hash")
    bad = bad.toDF(bad_id, bad_hash)
    return docs.join(bad, same(F.col(doc_id), F.col(bad_id)) & (F.xxhash64(F.col(text)) == F.col(bad_hash)), "left_anti")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, best, agreed, words of every document that an item
    contaminates."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    return found.select(F.col("doc").alias("doc_id"), "item_id", "best", "agreed", "words")
