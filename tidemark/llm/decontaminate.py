"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

A window is ``n`` consecutive words of a test item, or all of a shorter one. Each window is searched by its rarest word,
rare in the training text: that keeps posting lists short. The index stores the postings of those words (row, place)
with the words to either side, so the offset-adjusted lists of all the other words of an item are intersected where the
posting is: how far the training words agree with the item's to the left and to the right tells every window that
holds the posting. Postings and the places of anchors in items are joined as rows, so a word that anchors many windows
is no long list in one row, and a skewed join can be split. Only occurrences travel, by row.

Words are runs of the characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered. Terms of the index are lowered fully,
which joins words that differ only in the case of other letters; the comparison of words tells them apart again.

What the items give (terms, anchors) is broadcast while its bytes, added up before, are no more than BROADCAST_BYTES;
beyond that the same joins shuffle.

Defined cases: a null text has no words; items without words match nothing; an item that repeats counts by its id
once; every row gives a row, those that repeat too; a null doc_id is an id; of words that are equally rare the first in
order is searched; long texts are rows like others, and a posting holds 2 n - 1 of their words; other columns are
ignored, whatever their names; empty tables give no rows (documents) or no hits (items).
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged, text_key, without

PHRASE = 10
BROADCAST_BYTES = 8 << 20
# Fixed value: what separates words, before A-Z are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def small(df: DataFrame, *texts: str) -> DataFrame:
    """Marked for broadcast where the bytes of its text columns, added up before, and some for each row allow that."""
    size = sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in texts), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def items_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different items as (item, w: their words) and the ids of each (item, item_id)."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), F.array_join(words(lowered(F.col("text"))), " ").alias("joined"))
    named = staged(cut.filter("joined <> ''").distinct())
    different = staged(named.select("joined").distinct().select(F.monotonically_increasing_id().alias("item"), "joined"))
    ids = staged(named.join(different, "joined").select("item", "item_id"))
    discard(named)
    return different.select("item", F.split("joined", " ").alias("w")), ids


def windows(different: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """Every window that can occur, with its rarest word: item, start, size, offset (of that word in the item), term."""
    place = staged(different.select("item", F.size("w").alias("length"), F.posexplode("w").alias("offset", "word")).select("*", F.lower("word").alias("term")))
    vocabulary = place.select("term").distinct()
    tokens = documents.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
    counts = tokens.join(small(vocabulary, "term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = place.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("offset").rowsBetween(0, n - 1)
    best = F.min(F.struct("n", "term", "offset")).over(ahead)
    each = counted.select("item", F.col("offset").alias("start"), F.least("length", F.lit(n)).alias("size"), "length", best.alias("best"))
    return each.filter("start = 0 OR start + size <= length").filter("best.n > 0").select("item", "start", "size", "best.offset", "best.term")


def anchors_of(found: DataFrame, different: DataFrame, reach: int) -> DataFrame:
    """Places in items to search by: item, term, word, size, and the words on both sides, nearest first, joined by spaces."""
    place = found.groupBy("item", "offset", "term").agg(F.min("size").alias("size")).join(different, "item")
    return place.select("item", "offset", "term", "size", F.element_at("w", F.col("offset") + 1).alias("word"), *beside("w", F.col("offset"), reach))


def beside(w: str, at: Column, reach: int) -> tuple[Column, Column]:
    """The words before and after place ``at``, nearest first, joined by spaces."""
    low = F.greatest(at - reach, F.lit(0))
    before = F.reverse(F.slice(w, low + 1, at - low))
    return F.array_join(before, " ").alias("before"), F.array_join(F.slice(w, at + 2, F.lit(reach)), " ").alias("after")


def index(documents: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """Postings of the terms with the words on both sides, and one row at least per document (place 0 or null):
    row, doc_id, text_key, n_words, pos, term, word, before, after."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words(F.col("text")).alias("w")
    )
    wanted = small(terms, "term")
    if wanted is not terms:
        each = rows.select("*", F.posexplode_outer("w").alias("pos", "word"))
        met = each.join(wanted, F.lower("word") == F.col("term"), "left")
        kept = met.filter("term IS NOT NULL OR pos IS NULL OR pos = 0")
    else:
        # Places are found by words alone, so that no word of the shuffle carries its document.
        each = rows.select("doc_id", "text_key", F.posexplode("w").alias("pos", "word"))
        met = each.join(terms, F.lower("word") == F.col("term")).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "term")).alias("places"))
        d, m = rows.alias("d"), met.alias("m")
        own = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
        first = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("term"))
        kept = d.join(m, own, "left").select("d.*", F.explode(F.concat(F.coalesce("m.places", F.array()), F.array(first))).alias("at"))
        kept = kept.select("row", "doc_id", "text_key", "w", "at.*")
    here = F.when(F.col("term").isNotNull(), F.get("w", F.col("pos")))
    before, after = beside("w", F.col("pos"), reach)
    near = [F.when(F.col("term").isNotNull(), lowered(c)).alias(name) for c, name in ((here, "word"), (before, "before"), (after, "after"))]
    return kept.select("row", "doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "pos", "term", *near)


def agreeing(a: str, b: str) -> Column:
    """How many words two lists, joined by spaces, have in common from their beginnings on."""
    same = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def occurrences(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Where windows occur: row, item, low, high (exclusive); windows that overlap around one posting are one."""
    held = small(anchors, "term", "word", "before", "after").select(
        "item", "term", "size", F.col("word").alias("of"), F.col("before").alias("of_before"), F.col("after").alias("of_after")
    )
    met = postings.filter("term IS NOT NULL").join(held, "term").filter("word = of")
    spans = met.select("row", "item", "size", "pos", agreeing("before", "of_before").alias("left"), agreeing("after", "of_after").alias("right"))
    return spans.filter("left + right + 1 >= size").select("row", "item", (F.col("pos") - F.col("left")).alias("low"), (F.col("pos") + F.col("right") + 1).alias("high"))


def scan(documents: DataFrame, items: DataFrame, n: int = PHRASE) -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_hit (words inside any occurrence), item_ids (sorted as strings), ranges."""
    different, ids = items_of(items)
    anchors = staged(anchors_of(windows(different, documents, n), different, n - 1))
    postings = staged(index(documents, anchors.select("term").distinct(), n - 1))
    found = staged(occurrences(postings, anchors))
    names = found.select("row", "item").distinct().join(ids, "item").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("ranges"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("hit"))

    def extend(state: Column, span: Column) -> Column:
        new = F.greatest(span["high"] - F.greatest(span["low"], state["reach"]), F.lit(0))
        return F.struct(F.greatest(state["reach"], span["high"]).alias("reach"), (state["hit"] + new).alias("hit"))

    hits = names.join(spans, "row").withColumn("n_hit", F.aggregate("ranges", zero, extend, lambda s: s["hit"]))
    rows = postings.filter("pos IS NULL OR pos = 0").select("row", "doc_id", "text_key", "n_words")
    # The place 0 can be a posting as well as stand for its row.
    rows = rows.dropDuplicates(["row"])
    return rows.join(hits, "row", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "ranges",
    )


def proximity_matches(documents: DataFrame, items: DataFrame, span: int, n: int = PHRASE) -> DataFrame:
    """Documents in which all distinct words of a window stand, in any order, within ``span`` consecutive words:
    doc_id, phrase, low (the first such place).

    The rarest word's postings give the places to look at; the others are looked for in the words on both sides.
    """
    different, ids = items_of(items)
    found = windows(different, documents, n).join(different, "item")
    phrases = staged(found.select("term", F.slice("w", F.col("start") + 1, F.col("size")).alias("need")).select("term", F.array_join("need", " ").alias("phrase")).distinct())
    postings = index(documents, phrases.select("term").distinct(), span - 1).filter("term IS NOT NULL")
    around = F.split(F.concat_ws(" ", F.array_join(F.reverse(F.split("before", " ")), " "), "word", "after"), " ")
    near = postings.withColumn("near", F.array_remove(around, "")).withColumn("near_at", F.greatest(F.col("pos") - (span - 1), F.lit(0)))
    met = near.join(small(phrases, "term", "phrase"), "term")
    need = F.array_distinct(F.split("phrase", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - span + 1, F.lit(1)))
    holds = F.filter(starts, lambda s: F.size(F.array_intersect(need, F.slice("near", s, F.lit(span)))) == F.size(need))
    hit = met.withColumn("at", F.array_min(holds)).filter("at IS NOT NULL")
    return hit.groupBy("doc_id", "phrase").agg(F.min(F.col("near_at") + F.col("at") - 1).alias("low"))


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a word of any window of the items."""
    return without(documents, scan(documents, items).filter("n_hit > 0"))
