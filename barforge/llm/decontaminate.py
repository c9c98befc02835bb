"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of typed tokens: numbers, names (capitalised words that don't begin a
sentence) and units (after a number) turn into placeholders, other words are lower-cased. Windows of ``width`` tokens
are hash-joined; windows that hold more placeholders than words are left out of the index, as they fit any table. An item
of ``least`` tokens or more, but fewer than ``width``, is one window, the whole of it.
Matches of a document and an item at the same distance form an alignment. Its slots must be consistent: a slot of the
item stands for one slot of the document, that of most of the alignment's windows (of equally many the last), and windows
in which it stands for another are dropped. Verbatim copies, re-parameterised questions and copies with a slip keep
enough windows; chance meetings of templates don't. A document is contaminated by an item when its consistent windows
cover at least ``coverage`` of the item's windows and at least two of them (all of an item that has no more).

The index holds the benchmark's windows only; it is broadcast when it has at most ``most_windows`` rows: documents are then
read once and whole, and nothing of them is held or shuffled but matching windows. It is joined by shuffle otherwise: a first
pass joins bare hashes, and aligning starts from the documents that it finds.

Defined results: null texts have no tokens; items with fewer than ``least`` tokens have no window and match nothing;
documents with the same id count as one; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, let, materialize, maybe_broadcast, text_of

#: Units of measure (fixed values).
UNITS = (
    "mm cm m km g kg mg t lb lbs oz s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years ml l liter liters "
    "litre litres meter meters metre metres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces dollar dollars cent cents "
    "euro euros percent degree degrees km² m² mph kph w kw v hz kb mb gb"
).split()
#: Placeholders of the canonical form; no word has these characters.
NUMBER, NAME, UNIT = "#n", "#p", "#u"
#: Marks a word that begins a sentence while tokens are made.
FIRST = "\u0002"


def marked_text(text: Column) -> Column:
    """Words and numbers of a text with one space between them, those that begin a sentence behind FIRST.

    Each step is one pass over the whole text, and each pattern begins with a character that most positions rule out.
    """
    t = F.concat(F.lit("."), F.replace(text, F.lit(FIRST), F.lit("")))
    t = F.regexp_replace(t, r"[.,](?<=[0-9].)(?=[0-9])", "")
    t = F.regexp_replace(t, r"([0-9])(?=\p{L})", "$1 ")
    t = F.regexp_replace(t, r"[.!?:;\n][^\p{L}\p{N}]*+(?=\p{Lu})", "$0 \u0002")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}\u0002²]+", " "))


def typed_text(marked: Column) -> Column:
    """The canonical form, token by token, of a marked text."""
    t = F.regexp_replace(F.concat(F.lit(" "), marked), r" \p{Lu}[^ ]*+", f" {NAME}")
    t = F.lower(F.replace(F.regexp_replace(t, "[0-9]++", NUMBER), F.lit(FIRST), F.lit("")))
    return F.ltrim(F.regexp_replace(t, rf"{NUMBER} (?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?= |$)", f"{NUMBER} {UNIT}"))


def _windows(typed: Column, widths: list[int]) -> Column:
    """For each width, the hashes of the windows of that many tokens, by position."""
    hashes = F.transform(typed, lambda w: F.xxhash64(w))

    def of(h: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
        return F.when(F.size(h) >= n, each).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, lambda h: F.array(*(of(h, n) for n in widths)))


def tokenized(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows`` with _marked, _typed and _windows (hashes by width and position) of ``text``."""
    out = rows.withColumn("_marked", marked_text(text_of())).withColumn("_typed", F.split(typed_text(F.col("_marked")), " ", -1))
    return out.withColumn("_windows", let(F.col("_typed"), lambda t: _windows(t, widths)))


def raw_tokens() -> Column:
    return F.split("_marked", " ", -1)


def benchmark_index(benchmark: DataFrame, width: int) -> DataFrame:
    """(hash, item_id, at, width, typed, item_raw, item_windows): the usable windows of each item."""
    items = tokenized(benchmark.select("item_id", "text"), [width])
    each = items.select("item_id", raw_tokens().alias("_raw"), "_typed", F.lit(width).alias("width"), F.posexplode(F.get("_windows", F.lit(0))).alias("at", "hash"))
    typed = F.slice("_typed", F.col("at") + 1, width)
    holes = F.size(F.filter(typed, lambda w: w.isin(NUMBER, NAME, UNIT)))
    index = each.select("hash", "item_id", "at", "width", typed.alias("typed"), F.slice("_raw", F.col("at") + 1, width).alias("item_raw")).where(2 * holes <= width)
    sizes = index.groupBy(F.col("item_id").alias("_i")).agg(F.countDistinct("at").alias("item_windows"))
    return index.join(sizes, F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i")


def window_matches(docs: DataFrame, index: DataFrame, widths: list[int], held: bool = False) -> DataFrame:
    """(doc_id, item_id, item_windows, shift, at, slots) of every window of one of ``widths`` that a document shares with an item.

    ``held``: the index is broadcast. Documents are then read once, and nothing that grows with them is held or joined back.
    """
    rows = tokenized(docs.select("doc_id", "text"), widths)
    of_width = F.posexplode(F.slice("_windows", 1, len(widths))).alias("k", "_of")  # of a bare column Spark would filter by size first, and make all tokens for that as well
    if held:
        # No operator between the tokens and the join copies a row, so tokens are carried along for all windows.
        by_width = rows.withColumn("_raw", raw_tokens()).select("doc_id", "_raw", "_typed", of_width)
        each = by_width.select("doc_id", "_raw", "_typed", "k", F.posexplode("_of").alias("pos", "_hash")).join(index.select("hash"), F.col("_hash") == F.col("hash"), "left_semi")
    else:
        # First only hashes become rows; the tokens of documents are carried along for the windows that match.
        hashes = rows.select("doc_id", of_width).select("doc_id", "k", F.posexplode("_of").alias("pos", "_hash"))
        some = hashes.join(index.select("hash"), F.col("_hash") == F.col("hash"), "left_semi").groupBy(F.col("doc_id").alias("_some"))
        some = maybe_broadcast(materialize(some.agg(F.collect_set(F.struct("k", "pos")).alias("_at")), "suspects"), 100_000)
        suspects = docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("_some")))
        each = tokenized(suspects, widths).select("doc_id", raw_tokens().alias("_raw"), "_typed", "_windows", F.inline("_at"))
        each = each.withColumn("_hash", F.get(F.get("_windows", F.col("k")), F.col("pos")))
    # From here on a row has the tokens of its window, not those of its document.
    own = lambda tokens: F.slice(tokens, F.col("pos") + 1, F.get(F.array(*map(F.lit, widths)), F.col("k"))).alias(tokens)
    near = each.select("doc_id", "pos", "_hash", own("_typed"), own("_raw"))
    # Neither a key of the join nor a test for null, which Spark would make for every window: only those that meet are compared.
    met = near.join(index, F.col("_hash") == F.col("hash")).where(F.slice("_typed", 1, F.col("width")).eqNullSafe(F.col("typed")))
    plain = lambda w: F.lower(F.translate(w, FIRST, ""))
    slots = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.get(F.col("typed"), k).isin(NUMBER, NAME, UNIT)),
        lambda k: F.struct(
            F.get(F.col("typed"), k).alias("type"), plain(F.get(F.col("item_raw"), k)).alias("item"), plain(F.get(F.col("_raw"), k)).alias("doc")
        ),
    )
    return met.select("doc_id", "item_id", "item_windows", (F.col("pos") - F.col("at")).alias("shift"), "at", slots.alias("slots"))


def consistent_windows(met: DataFrame) -> DataFrame:
    """The windows of window_matches() in which each slot of the item stands for what it stands for in most of its alignment."""
    line = ["doc_id", "item_id", "shift"]
    each = met.select(*line, "item_windows", "at", F.explode_outer("slots").alias("s"))
    votes = each.withColumn("_votes", F.count("*").over(Window.partitionBy(*line, "s.type", "s.item", "s.doc")))
    most = F.max(F.struct("_votes", "s.doc")).over(Window.partitionBy(*line, "s.type", "s.item"))
    other = votes.withColumn("_other", F.coalesce(F.col("s.doc") != most["doc"], F.lit(False)))
    return other.groupBy(*line, "item_windows", "at").agg(F.max("_other").alias("_other")).where(~F.col("_other")).drop("_other")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.3, most_windows: int = 100_000, least: int = 3) -> DataFrame:
    """(doc_id, item_id, windows, item_windows): every document and item of which consistent windows cover enough."""
    items = materialize(benchmark.select("item_id", "text", F.size(F.split(typed_text(marked_text(text_of())), " ", -1)).alias("_n")), "items")
    short = sorted(r[0] for r in items.where(F.col("_n").between(least, width - 1)).select("_n").distinct().collect())  # fewer than ``width``
    index = benchmark_index(items, width)
    for n in short:
        index = index.unionByName(benchmark_index(items.where(F.col("_n") == n), n))
    index = materialize(index, "benchmark-windows")
    table = maybe_broadcast(index, most_windows)
    met = window_matches(docs, table, [width, *short], held=table is not index)
    covered = F.countDistinct("at").alias("windows")
    found = consistent_windows(met).groupBy("doc_id", "item_id", "item_windows").agg(covered)
    enough = (F.col("windows") >= F.least(F.lit(2), F.col("item_windows"))) & (F.col("windows") >= coverage * F.col("item_windows"))
    return found.where(enough).select("doc_id", "item_id", F.col("windows").cast("long"), F.col("item_windows").cast("long"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each contaminated document: doc_id, item_ids (sorted), windows (of the best covered item)."""
    pairs = contaminated(docs, benchmark, **options)
    return pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("windows").alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents, those with a null id among them."""
    (name,) = fresh(docs, "_bad")
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(maybe_broadcast(materialize(bad, "contaminated"), 500_000), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
