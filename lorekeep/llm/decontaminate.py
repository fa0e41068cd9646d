"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (all its words, if it has fewer). A hash of three of a window's words
picks candidate positions of a document. The set of the windows' hashes goes to all tasks inside the scan's expression, as an
array of bits of a bounded size, so that only candidates leave the scan, however many windows there are. They are then
compared with the windows word by word, in a join that broadcasts the windows if their number is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import ascii_lower, materialize, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OWN = ["n_words", "n_hit", "n_items", "items", "hits", "contaminated"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _slice(words: Column, start: Column, length: int) -> Column:
    return F.slice(words, start + 1, F.lit(length))


def _key(words: Column, start: Column, length: int) -> Column:
    """A hash of the first, middle and last word of the window at start."""
    return F.xxhash64(*(F.get(words, start + i) for i in (0, length // 2, length - 1)), F.lit(length))


def _places(key: Column, bits: int) -> list[Column]:
    """The two bits of a hash in a set of so many (a power of two)."""
    return [key.bitwiseAND(bits - 1), F.shiftright(key, 31).bitwiseAND(bits - 1)]


def bit_set(windows: DataFrame, bits: int) -> Column:
    """The set of the windows' keys: an array of bits / 64 numbers, which the optimizer makes one constant."""
    places = windows.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("at"))
    numbers = places.groupBy((F.col("at") / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("n"))
    held = {r.i: r.n for r in numbers.collect()}  # bits / 64 rows at most
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")


def _starts(words: Column, length: int) -> Column:
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def windows_of(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The distinct windows of all items: key, length, window (words joined by a space), items (sorted ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    start = F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i")
    cut = items.select("item", "w", size.alias("length"), start).select(
        "item", "length", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("length"))).alias("window"),
        F.xxhash64(F.get("w", "i"), F.get("w", F.col("i") + F.expr("length div 2").cast("int")), F.get("w", F.col("i") + F.col("length") - 1), "length").alias("key"),
    )
    return cut.groupBy("key", "length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, filter_bits: int | None = None, max_broadcast: int = 1_000_000, slim: bool = False) -> DataFrame:
    """One row per input row: its columns, then n_words, n_hit, items (sorted strings), n_items, hits, contaminated.

    ``hits`` lists (start, length) in words, sorted. A word is hit if it lies inside any occurrence of a window. A document
    is contaminated if a word is hit and hit words are 1/20 of its words at least. Null and empty texts have no words and no
    hits; a benchmark without words hits nothing. Items without id count for hits but not in items. Rows of one doc_id (a
    whole number) with one text share a result. Input columns with the names of these are replaced. The set has 32 bits a
    window, 2**24 at most, or filter_bits; its size never changes the result, nor does ``max_broadcast`` (windows).
    With ``slim``, one row per doc_id and text instead, of doc_id, a hash of the text (__text) and the new columns; that saves joining the texts.
    """
    windows = materialize(windows_of(benchmark, n), "windows")
    many = windows.count()  # size check: how the windows travel
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most n of them
    bits = filter_bits or min(1 << 24, max(1 << 10, 1 << (32 * many).bit_length()))
    known = bit_set(windows, bits)
    windows = F.broadcast(windows) if many <= max_broadcast else windows
    keep = without(docs, OWN)
    row = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__text")]
    words = docs.select(*row, words_of(F.col("text")).alias("w"))

    def may_be(key: Column) -> Column:
        one, two = (F.bit_get(F.get(known, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1 for at in _places(key, bits))
        return one & two

    def found(size: int) -> Column:
        keyed = F.transform(_starts(F.col("w"), size), lambda i: F.struct(i.alias("start"), _key(F.col("w"), i, size).alias("key")))  # each hash once
        starts = F.filter(keyed, lambda x: may_be(x["key"]))
        return F.transform(starts, lambda x: F.struct(x["start"].alias("start"), F.lit(size).alias("length"), F.concat_ws(" ", _slice(F.col("w"), x["start"], size)).alias("window")))

    parts = [found(size) for size in lengths]
    none = F.array().cast("array<struct<start:int,length:int,window:string>>")
    spread = words.select("__id", "__text", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(none, *parts)).alias("c"))
    spread = spread.select("__id", "__text", "n_words", F.col("c.start").alias("start"), F.col("c.length").alias("length"), F.col("c.window").alias("window"))
    checked = spread.join(windows.select("length", "window", "items"), ["length", "window"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "length"))
    by_row = checked.groupBy("__id", "__text").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))

    n_hit = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), cover, lambda acc: acc["n"])
    by_row = by_row.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    if slim:
        return by_row.select(F.col("__id").alias("doc_id"), "__text", *OWN)
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *row).alias("d")
    match = F.expr("d.__id <=> r.__id AND d.__text = r.__text")
    return left.join(by_row.alias("r"), match).select("row.*", *[F.col(f"r.{c}") for c in OWN])


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, all their columns unchanged. Null and empty texts stay; repeated rows stay or go
    together; an empty table gives an empty one, an empty benchmark the whole table."""
    bad = find_hits(docs, benchmark, slim=True, **options).where("contaminated").select(F.col("doc_id").alias("__id"), "__text")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__text"))
    return rows.alias("d").join(bad.alias("b"), F.expr("d.__id <=> b.__id AND d.__text = b.__text"), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, with the hit words cut out of their texts; what stands between words stays. Texts without hits, null ones
    too, stay as they are; repeated rows come out each; an empty table gives an empty one."""
    marked = find_hits(docs, benchmark, **options)
    word, rest = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("text", F.lit(f"{word}|{rest}"), F.lit(0))
    odd = F.when(F.col("text").rlike(f"^{word}"), 0).otherwise(1)  # words and what lies between alternate
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    kept = F.filter(pieces, lambda _, i: ~(((i + odd) % 2 == 0) & F.array_contains(gone, F.floor((i - odd) / 2).cast("int"))))
    return marked.withColumn("text", F.when(F.size("hits") > 0, F.concat_ws("", kept)).otherwise(F.col("text"))).select(*docs.columns)
