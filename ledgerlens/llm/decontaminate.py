"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item's words are cut into windows of ``window`` consecutive words (an item of fewer
words is one window). A window is contained in a document only if all its words are there, so its
necessary prefix is a single word: the rarest one, by counts over all documents. The join goes
from document words to those rarest words; a match fixes where the window would start, the
length and positional bound drops starts before the text or windows past its end, and the
words of that stretch are held against the window word by word.

The benchmark is the stated query set: its windows are taken in blocks of ``BLOCK_WINDOWS``, so what
is broadcast (a block's windows and words) has that bound at any benchmark size.

Edge cases: null and empty texts have no words; an item without words has no window; repeated
items and repeated rows count as they stand (items by distinct id; a null id shows as an empty string); a document
without hits has the digest of the empty string; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpoint, no_text, text_key

WINDOW = 10
BLOCK_WINDOWS = 100_000
#: What stands between words: the ASCII characters but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_CHARS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def _lower(c):
    return F.translate(c, UPPER, LOWER)


def _words(col):
    """Words by splitting at the gaps, which costs about half of matching the words."""
    inner = F.btrim(col, F.lit(_GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def windows(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """``(win array<string>, item string)``: the distinct windows of each item, in lower case."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         _words(_lower(no_text(text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (words.select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s"), window).alias("win")).distinct())


def _rarest(block: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to each window its rarest word (``token``) and that word's place (``off``, from 0).
    Words are compared here in full lower case, which equal windows also share."""
    vocab = block.select(F.explode("low").alias("token")).distinct()
    seen = (docs.select(F.explode("w").alias("token")).select(F.lower("token").alias("token"))
            .join(F.broadcast(vocab), "token").groupBy("token").count())
    counts = vocab.join(seen, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("n"))
    spread = block.select("wid", F.posexplode("low").alias("off", "token"))
    best = (spread.join(F.broadcast(counts), "token").groupBy("wid")
            .agg(F.min(F.struct("n", "token", "off")).alias("b")))
    return block.join(best, "wid").select("wid", "win", "b.token", "b.off")


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """One pass over the documents: every occurrence of a window, ``(id, key, n_words, start, len, win)``, and for each row
    of ``docs`` (``id``: its column of that name, or null) a row of length 0. ``key`` names the document's text."""
    wins = windows(items, item_id, item_text, window).select("win").distinct()
    distinct = checkpoint(wins.withColumn("low", F.transform("win", F.lower)).withColumn("wid", F.monotonically_increasing_id()))
    n = distinct.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    own = F.col("id") if "id" in docs.columns else F.lit(None).cast("long").alias("id")
    clean = docs.select(own, no_text(text).alias("t"))
    words = clean.select("id", text_key(F.col("t")).alias("key"), _words(F.col("t")).alias("w"))
    spark = docs.sparkSession
    # The empty word, which no text has, stands at every document's end and brings its row through the join.
    last = spark.range(1).select(F.lit(-1).cast("long").alias("wid"), F.array().cast("array<string>").alias("win"),
                                 F.lit("").alias("token"), F.lit(0).alias("off"))
    found = []
    for i in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == i)
        probe = _rarest(block, words)
        probe = F.broadcast(checkpoint(probe if i else probe.union(last)))
        at = words.select("id", "key", "w", F.posexplode(F.array_append("w", "")).alias("pos", "word"))
        at = at.withColumn("word", F.lower("word")).join(probe, F.col("word") == F.col("token"))
        start, size = F.col("pos") - F.col("off"), F.size("win")
        at = at.where((start >= 0) & (start + size <= F.size("w")))
        same = F.concat_ws(" ", F.slice("w", F.greatest(start + 1, F.lit(1)), size))     # filters may run in any order
        found.append(at.where((size == 0) | (_lower(same) == F.concat_ws(" ", "win")))
                     .select("id", "key", F.size("w").cast("long").alias("n_words"), start.alias("start"), size.alias("len"), "win"))
    return reduce(DataFrame.union, found)


def decontaminate_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and their ids."""
    rows = checkpoint(scan(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), items, "text", item_id, item_text, window))
    found = rows.where("len > 0").select("key", "start", "len", "win").distinct()
    spots = (found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p"))
             .distinct().groupBy("key").agg(F.count("*").alias("n_hit")))
    named = (found.select("key", "win").distinct().join(windows(items, item_id, item_text, window), "win")
             .select("key", "item").distinct().groupBy("key")
             .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    return rows.where("len = 0").select("id", "key", "n_words").join(spots.join(named, "key"), "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents without any hit; all columns are kept."""
    bad = checkpoint(scan(docs.select(F.col(text).alias("text")), items, "text", **kw).where("len > 0").select("key").distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      text_key(no_text(text)).alias("key"))
    return row.join(bad, "key", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def items_digest(items):
    """Lowercase SHA-256 of the item ids, sorted as strings, joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)
