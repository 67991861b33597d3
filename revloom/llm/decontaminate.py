"""Benchmark passages in documents by spaced-seed hashing; DataFrame functions only.

A mask is laid over every place of a text and hashes only the words at its ones, so a hit survives
substituted words at its zeros. Seeds of the benchmark are joined with those of the documents. Each
hit fixes an alignment of an item to a document; around it the words of both are compared place by
place, and the item is found if in some window of aligned words enough are equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from revloom.llm.common import UPPER
from revloom.session import pin

# Fixed masks: which words of a place count. Whatever words SHARE allows to differ in a window of 10 to 20, one hits.
MASKS = ("111011", "101111", "11100011")
SHORT = 9  # items of up to so many words have masks of their own length instead
WINDOW = 20  # words compared together
SHARE = 80  # per cent of a window's words that are equal
BROADCAST_SEEDS = 500_000  # seeds of the benchmark that go to all workers; more are joined by a shuffle
NO_ID = -(2**63)
SPACES = "\t\n\x0b\x0c\r "


def word_array(text: Column) -> Column:
    """Words between space, tab, \\n, \\v, \\f and \\r; A-Z are lower-cased."""
    plain = F.translate(text, UPPER + SPACES[:-1], UPPER.lower() + " " * (len(SPACES) - 1))
    return F.array_remove(F.split(plain, " "), "")


def short_masks(words: int) -> list[str]:
    """Masks as long as an item, one of which is free of any substitutions that ``SHARE`` allows.

    The item is cut into two blocks more than words that may differ; each mask has the ones of two
    blocks, so two blocks without a substitution are always left. Without any allowed it is all ones.
    """
    allowed = words * (100 - SHARE) // 100
    if not allowed:
        return ["1" * words]
    block = [k * (allowed + 2) // words for k in range(words)]
    return ["".join("01"[b in pair] for b in block) for pair in combinations(range(allowed + 2), 2)]


def _masks(lengths: Sequence[int]) -> list[tuple[str, int]]:
    """The fixed masks (of any longer item: 0), and those of every length of a short item."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in sorted(set(lengths)) for m in short_masks(n))]


def _seeds(rows: DataFrame, masks: Sequence[tuple[str, int]], keep: Sequence[str], items: bool = False) -> DataFrame:
    """``(keep…, place, seed)`` of all places and masks, from an array ``hashes`` of word hashes.

    Items take the masks of their length only.
    """
    n = F.size("hashes")

    def at(i: Column) -> Column:
        one = []
        for k, (m, length) in enumerate(masks):
            fits = i + len(m) <= n
            if items:
                fits &= n == length if length else n > SHORT
            one.append(F.when(fits, F.xxhash64(F.lit(k), *[F.get("hashes", i + j) for j, c in enumerate(m) if c == "1"])))
        return F.array(*one)

    least = min(len(m) for m, _ in masks)
    places = F.when(n >= least, F.sequence(F.lit(0), n - least))
    seeded = rows.select(*keep, F.flatten(F.transform(places, at)).alias("seeds"))
    # Outer, as the plain form makes Spark compute the seeds a second time to test their number.
    long = seeded.select(*keep, F.posexplode_outer("seeds").alias("k", "seed")).where(F.col("seed").isNotNull())
    return long.select(*keep, F.floor(F.col("k") / len(masks)).cast("int").alias("place"), "seed")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _equal_share(doc: Column, item: Column, offset: Column) -> Column:
    """Largest per cent of equal words in a window of the aligned words; ``offset``: place of the item's first word."""
    # Item places that have a place in the document.
    low = F.greatest(F.lit(0), -offset)
    high = F.least(F.size(item), F.size(doc) - offset)
    width = F.least(F.lit(WINDOW), F.size(item))
    # The document's slice is as long as the item; where there is no document, nothing is equal.
    equal = F.transform(
        F.sequence(F.lit(0), F.size(item) - 1),
        lambda j: F.when((j >= low) & (j < high) & (F.get(doc, j + offset) == F.get(item, j)), 1).otherwise(0),
    )
    sums = F.transform(
        F.sequence(F.lit(1), F.size(item) - width + 1),
        lambda s: F.aggregate(F.slice(equal, s, width), F.lit(0), lambda a, x: a + x),
    )
    return F.array_max(sums) * 100 / width


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc, text_hash, item_id, share)``: items found in documents, by id (null: ``NO_ID``) and text hash."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), word_array(F.coalesce(F.col(item_text_col), F.lit(""))).alias("item"))
    items = pin(items.where((F.size("item") > 0) & F.col("item_id").isNotNull()).distinct())
    lengths = [r[0] for r in items.where(F.size("item") <= SHORT).select(F.size("item")).distinct().collect()]
    masks = _masks(lengths)
    item_seeds = pin(
        _seeds(items.select("item_id", "item", _hashes("item").alias("hashes")), masks, ["item_id", "item"], items=True)
        .select("seed", F.col("place").alias("q"), "item_id", F.xxhash64("item").alias("item_hash")).distinct()
    )
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(text_col)).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # A short item may reach over an end of the document by the words that may differ.
    over = max(lengths, default=0) * (100 - SHARE) // 100
    ends = F.array_repeat(F.lit(0).cast("bigint"), over)
    hashes = F.concat(ends, _hashes("words"), ends) if over else _hashes("words")
    hashed = rows.select("doc", "text_hash", word_array(F.col("text")).alias("words")).select("doc", "text_hash", hashes.alias("hashes"))
    # The size of what is broadcast is known before; a larger benchmark takes a shuffle join.
    small = item_seeds.count() <= BROADCAST_SEEDS
    seeds = _seeds(hashed, masks, ["doc", "text_hash"])
    hits = seeds.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    hits = pin(hits.select("doc", "text_hash", "item_id", "item_hash", (F.col("place") - F.col("q") - over).alias("offset")).distinct())
    keyed = items.select("item_id", F.xxhash64("item").alias("item_hash"), "item")
    wanted = (
        hits.join(keyed, ["item_id", "item_hash"])
        .groupBy("doc", "text_hash")
        .agg(F.collect_list(F.struct("item_id", "item", "offset")).alias("hits"))
    )
    near = rows.join(wanted, ["doc", "text_hash"]).select("doc", "text_hash", word_array(F.col("text")).alias("words"), "hits")
    tested = F.transform(
        "hits", lambda h: F.struct(h["item_id"].alias("item_id"), _equal_share(F.col("words"), h["item"], h["offset"]).alias("share"))
    )
    found = near.select("doc", "text_hash", F.explode_outer(tested).alias("t")).select("doc", "text_hash", "t.item_id", "t.share")
    return found.where(F.col("share") >= SHARE).groupBy("doc", "text_hash", "item_id").agg(F.max("share").alias("share"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_items, item_ids, share, contaminated)`` for every row.

    ``item_ids`` are the items found in the document in order, ``share`` the largest per cent of
    equal words in a window of ``WINDOW`` (or all, of a shorter item) aligned words, 0 if there is
    no item; a document with any item is contaminated. An item is found where one seed of the
    masks hits and a window around it has at least ``SHARE`` per cent of equal words.

    Null and empty texts hold nothing; items that are null, have a null id or no
    word are not looked for. Items of one to four words are found as they are. Rows that share an item id are that item, each with
    its text. Rows are treated one by one: repeated rows and null ids stay, other columns are
    ignored, an empty table gives an empty one, an empty benchmark finds nothing.
    """
    found = find_passages(docs, benchmark, id_col, text_col, item_col, item_text_col)
    per_doc = found.groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("share").alias("share")
    )
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash")).withColumn(
        "doc", F.coalesce("doc_id", F.lit(NO_ID))
    )
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return rows.join(per_doc, ["doc", "text_hash"], "left").select(
        "doc_id", F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("share", F.lit(0.0)).alias("share"), F.col("item_ids").isNotNull().alias("contaminated"),
    )
