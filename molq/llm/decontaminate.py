"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names of a text are marked as typed slots; what stands between them is the
template. Windows of ``width`` template words of the benchmark items are joined, by hash, with those
of the records. For every aligned pair the window words are compared in full and the slots are
checked: one value of the item must always stand for one value of the record. So a question with other
numbers or names is caught, while texts that share a form by chance, with slots filled at random, are not.

An item is read in three ways, and any of them finds it. ``strict``: names are capitalised words inside a sentence,
windows have ``width`` words and must hold ``literals`` plain ones. Two loose readings, one with these names and one
with every capitalised word as a name, take the whole template as one window for items under ``width`` words,
windows of half the width up to 3 * width - 1 words, and full ones beyond. They keep windows rich in slots,
and ask instead that few of the values differ.

The project's records carry no running text, so the functions take any id and text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.llm.common import stored

WIDTH = 8
LITERALS = 5
SHARE = 0.5
READINGS_A_FILE = 5000

# Units that may follow a number.
UNITS = ("km cm mm nm um kg mg ug ml hz khz mhz ghz kb mb gb tb seconds second minutes minute hours hour days day weeks week "
         "months month years year meters meter metres metre miles mile feet inches inch grams gram pounds pound liters liter "
         "litres litre degrees degree percent dollars dollar euros euro cents cent").split()

NUMBER, UNIT, NAME = "⟦n⟧", "⟦u⟧", "⟦a⟧"


def _tokens(texts: DataFrame, every: bool = False) -> DataFrame:
    """Marks capitalised words inside a sentence as names, or ``every`` capitalised word. Adds ``line``, the lower-cased words with marked slots and their values, and ``bare``, without the values.

    Each step is a column of its own, so that no step is repeated inside the conditions of the next."""
    t = F.col("t")
    names = f"({NAME}\\p{{Lu}}\\p{{Ll}}+"
    return (texts.withColumn("t", F.coalesce("text", F.lit(""))).drop("text")
            .withColumn("t", F.when(F.contains(t, F.lit("⟦")) | F.contains(t, F.lit("⟧")), F.regexp_replace(t, "[⟦⟧]", " "))
                        .otherwise(t))
            .withColumn("t", F.regexp_replace(t, r"(?<![\p{L}\p{N}\p{M}_])(\p{Lu}\p{Ll}+)", f"{NAME}$1") if every else
                        F.regexp_replace(t, r"([^.!?:\s] )(\p{Lu}\p{Ll}+)", f"$1{NAME}$2"))
            .withColumn("t", F.when(F.contains(t, F.lit(NAME)), F.regexp_replace(F.regexp_replace(
                t, f"{names}) (\\p{{Lu}}\\p{{Ll}}+)", "$1_$2"), f"{names}_\\p{{Ll}}+) {NAME}(\\p{{Lu}}\\p{{Ll}}+)", "$1_$2")).otherwise(t))
            .withColumn("t", F.when(t.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
                t, r"([0-9])[.,]([0-9])", "$1_$2"), r"([0-9])[.,]([0-9])", "$1_$2"), r"[0-9][0-9_]*", f" {NUMBER}$0 "),
                f"(?i)({NUMBER}[0-9_]+ +)({'|'.join(UNITS)})( |[.,;:?!)]|$)", f"$1{UNIT}$2$3")).otherwise(t))
            .withColumn("line", F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\p{M}⟦⟧_ ]+", " ")).drop("t")
            .withColumn("bare", F.when(F.contains("line", F.lit("⟦")), F.regexp_replace("line", "⟦(.)⟧[^ ]*", "⟦$1⟧"))
                        .otherwise(F.col("line"))))


def _split(column: str) -> Column:
    return F.array_remove(F.split(column, " "), "")


def _runs(tokens: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """(*keys, n, place, window): hash of every run of each of ``widths`` template words, one width after the other.

    Hashes of 1, 2, 4, ... words are put together from the hashes of half the length, other lengths from those."""
    runs = tokens.select(*keys, F.transform(_split("bare"), lambda w: F.xxhash64(w)).alias("run1")).withColumn("n", F.size("run1"))
    size = 1
    while size * 2 <= max(widths):
        # The places at the end whose second half is missing are cut off below.
        runs = runs.withColumn(f"run{size * 2}", F.zip_with(f"run{size}", F.slice(f"run{size}", size + 1, 1 << 30),
                                                            lambda a, b: F.xxhash64(a, b)))
        size *= 2
    for width in widths:
        done = 1 << (width.bit_length() - 1)
        whole, left = F.col(f"run{done}"), width - done
        while left:
            part = 1 << (left.bit_length() - 1)
            whole = F.zip_with(whole, F.slice(f"run{part}", done + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))
            done, left = done + part, left - part
        runs = runs.withColumn(f"run{width}", whole)
    # An outer explode, so that no condition on the array is pushed down and evaluates every step again.
    cut = [F.slice(f"run{w}", F.lit(1), F.greatest(F.col("n") - (w - 1), F.lit(0))) for w in widths]
    return runs.select(*keys, "n", F.posexplode_outer(F.concat(*cut)).alias("place", "window")).where("window is not null")


def _width_and_at(runs: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``at``, the word counted from 1 where a window of ``width`` words begins, from ``place`` and ``n``."""
    offset, at = F.lit(0), F.when(F.lit(False), F.lit(0))
    for w in widths:
        at = at.when(F.col("width") == w, F.col("place") - offset + 1)
        offset = offset + F.greatest(F.col("n") - (w - 1), F.lit(0))
    return runs.withColumn("at", at)


def _read_items(items: DataFrame, width: int) -> DataFrame:
    """(item, every, strict, width, version, i_words, i_bare): every reading of every text of an item."""
    both = [_tokens(items, every).withColumn("every", F.lit(every)) for every in (False, True)]
    words = both[0].unionByName(both[1]).select("item", "every", "line", "bare", _split("line").alias("i_words"), _split("bare").alias("i_bare"))
    n = F.size("i_bare")
    loose = F.when(n < width, n).when(n < 3 * width, max(width // 2, 1)).otherwise(width)
    return (words.where(n > 0).withColumn("strict", F.explode(F.array(F.lit(True), F.lit(False))))
            .where("not (strict and every)").withColumn("width", F.when(F.col("strict"), width).otherwise(loose))
            .where(n >= F.col("width")).withColumn("version", F.xxhash64("line", "every", "strict")))


def find_leaks(records: DataFrame, benchmark: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
               item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, literals: int = LITERALS,
               share: float = SHARE) -> DataFrame:
    """(id, item, n_windows, item_windows, reparameterised) for every record that holds a benchmark item.

    A record holds an item when, in one of the readings above, at least ``share`` of the item's windows stand in it
    with consistent slots. In the strict reading windows with under ``literals`` plain words do not count. In the loose
    ones windows without any plain word count only where the item has no other; the windows must stand within some 8 words
    of one another's order, and at most 1 - literals / width of the words may be differing slot values, a repeated one
    taken once. The figures are those of the strict reading where it finds the item. ``reparameterised`` tells
    that some slot value differs. Null texts and texts without a word hold nothing and are held by nothing;
    rows with a null id are left out. Rows that repeat an id are judged as one: an item is reported once per id. Other
    columns are not read. Item windows are stored, so Spark broadcasts them only when their size on
    disk is below its threshold and shuffles otherwise.
    """
    if width & (width - 1):
        raise ValueError("the window width must be a power of two")
    texts = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("item is not null")
    readings = stored(_read_items(items.dropDuplicates(["item", "text"]), width), "items")
    # At most ``width`` + 1 different numbers.
    in_use = {every: sorted((r["width"] for r in readings.where(F.col("every") == every).select("width").distinct().collect()), reverse=True)
              or [width] for every in (False, True)}
    plain = F.size(F.filter(F.slice("i_bare", F.col("at"), F.col("width")), lambda w: ~F.startswith(w, F.lit("⟦"))))
    cut = []
    for every, widths in in_use.items():
        keys = ["item", "every", "strict", "width", "version", "i_bare"]
        runs = _runs(readings.where(F.col("every") == every).withColumn("bare", F.array_join("i_bare", " ")), keys, widths)
        for w in widths:
            cut.append(_width_and_at(runs.where(F.col("width") == w), widths).where(F.col("at").between(1, F.col("n") - (w - 1))))
    every_window = cut[0]
    for more in cut[1:]:
        every_window = every_window.unionByName(more)
    every_window = every_window.withColumn("plain", plain)
    has_plain = every_window.groupBy("item", "version").agg(F.max("plain").alias("most"))
    # Files follow the number of items, not of partitions: many tiny files would look too large to broadcast.
    files = readings.count() // READINGS_A_FILE + 1
    item_windows = stored(
        every_window.join(has_plain, ["item", "version"])
        .where(F.col("plain") >= F.when(F.col("strict"), literals).otherwise(F.least(F.col("most"), F.lit(1))))
        .select("item", "every", "strict", "width", "version", "at", "window").coalesce(files), "item-windows")
    sizes = item_windows.groupBy("item", "version").agg(F.count(F.lit(1)).cast("int").alias("item_windows"))

    hits = None
    for every, widths in in_use.items():
        wanted = item_windows.where(F.col("every") == every).withColumnRenamed("at", "there")
        met = (_width_and_at(_runs(_tokens(texts, every), ["id"], widths).join(wanted, "window"), widths)
               .groupBy("id", "item", "every", "strict", "width", "version", (F.col("at") - F.col("there")).alias("shift"))
               .agg(F.collect_set("there").alias("places")))
        hits = met if hits is None else hits.unionByName(met)
    enough = F.col("n_windows") >= share * F.col("item_windows")
    # Loose windows belong together when their shifts are near: of two staggered rows of boxes, one holds both.
    boxes = F.when(F.col("strict"), F.array(F.lit(0).cast("bigint"))).otherwise(F.array(
        F.floor(F.col("shift") / (2 * width)) * 2, F.floor((F.col("shift") + width) / (2 * width)) * 2 + 1))
    found = stored(hits.withColumn("box", F.explode(boxes)), "hits")
    promising = (found.select("id", "item", "version", "box", F.explode("places").alias("at"))
                 .groupBy("id", "item", "version", "box").agg(F.count_distinct("at").alias("n_windows"))
                 .join(sizes, ["item", "version"]).where(enough).select("id", "item", "version", "box"))
    found = stored(found.join(promising, ["id", "item", "version", "box"], "left_semi"), "promising")

    near = texts.join(found.select("id").distinct(), "id", "left_semi")
    record_side = [_tokens(near, every).select("id", F.lit(every).alias("every"), _split("line").alias("r_words"),
                                               _split("bare").alias("r_bare")) for every in (False, True)]
    item_side = readings.select("item", "version", "i_words", "i_bare")
    pairs = found.join(item_side, ["item", "version"]).join(record_side[0].unionByName(record_side[1]), ["id", "every"])
    alike = F.filter("places", lambda p: F.slice("i_bare", p, F.col("width")) == F.slice(
        "r_bare", F.greatest(p + F.col("shift"), F.lit(1)), F.col("width")))
    covered = F.array_distinct(F.flatten(F.transform("alike", lambda p: F.sequence(p, p + (F.col("width") - 1)))))
    slots = F.transform(F.filter("covered", lambda p: F.startswith(F.get("i_bare", p - 1), F.lit("⟦"))),
                        lambda p: F.struct(F.get("i_words", p - 1).alias("i"), F.get("r_words", p + F.col("shift") - 1).alias("r")))
    judged = (pairs.withColumn("alike", alike).where(F.size("alike") > 0).withColumn("covered", covered)
              .withColumn("slots", F.array_distinct(slots))
              .where(F.size("slots") == F.size(F.array_distinct("slots.i")))
              .withColumn("changed", F.size(F.filter("slots", lambda s: s["i"] != s["r"])))
              .where(F.col("strict") | (F.col("changed") * width <= (width - literals) * F.size("covered"))))
    merged = (judged.select("id", "item", "strict", "version", "box", "changed", F.explode("alike").alias("at"))
              .groupBy("id", "item", "strict", "version", "box")
              .agg(F.count_distinct("at").cast("int").alias("n_windows"), F.min(F.col("changed") > 0).alias("reparameterised")))
    return (merged.join(sizes, ["item", "version"]).where(enough)
            .groupBy("id", "item").agg(F.max_by(F.struct("n_windows", "item_windows", "reparameterised"),
                                                F.struct("strict", "n_windows", "version", "box")).alias("best"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_windows", "best.item_windows",
                    "best.reparameterised"))


def drop_leaks(records: DataFrame, benchmark: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
               item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """``records`` without the rows that hold a benchmark item; rows with a null id stay."""
    leaks = find_leaks(records, benchmark, id_col, text_col, item_col, item_text_col, **how)
    return records.join(stored(leaks.select(id_col).distinct(), "leaks"), id_col, "left_anti").select(*records.columns)
