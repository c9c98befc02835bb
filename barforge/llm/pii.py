"""Personal data: fixed patterns, and information-theoretic sanitisation around them.

Base spans: emails, IP addresses, card and phone numbers, leftmost and non-overlapping for each kind; matches that fail
their check are dropped without another try. Each base span is a protected entity.

Method: a term (a run of at least three letters outside of base spans) of a text that holds an entity reveals it by as
much as its presence raises the entity's probability: the pointwise mutual information of term and entity over the
entity's own information, ``log(p(e|t) / p(e)) / -log p(e)``, from counts of distinct texts over the whole corpus. p(e|t) is
smoothed towards p(e) by ``smooth`` texts, so that an entity of a single text is measured like any other, with less trust
in terms seen once. Terms are generalised from ``generalise`` on and removed from ``remove`` on, in the texts that hold the
entity. Texts without an entity are left alone.

All texts are read whole, twice: for spans and the terms around them, and for the number of texts with each term. Only
texts with an entity are kept on the way, and only keys, terms and counts are shuffled. Terms too common to reveal any
entity are put aside by their counts before they meet an entity; the others are broadcast when they number at most ``most_terms``.

Defined results: a null text is an empty one; equal texts have equal spans and count once in the statistics; no row is
lost or repeated whatever its other columns are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, materialize, maybe_broadcast, text_of, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The patterns: those of the task, with repetitions that never give back what they took where nothing after could take it,
#: and starts inside a run of the same characters left out, as they fail wherever the run's start has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
SPAN = "struct<kind:string,start:int,stop:int,entity:string>"
TERM = r"\p{L}{3,}+"


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((size - i) % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\.", -1), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), let(digits, _luhn)).otherwise(False)


def placed(text: Column, pattern: str) -> Column:
    """(match, start, stop) of every match, in order. Places come from the lengths of what lies between the matches,
    summed in about sqrt(n) blocks of sqrt(n) matches, so that no growing array is copied for each of n matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    nothing = F.array().cast("array<struct<match:string,start:int,stop:int>>")

    def place(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        stop = begin + F.length(p["match"])
        one = F.struct(p["match"].alias("match"), begin.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def whole(pairs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(pairs))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int")), lambda b: F.slice(pairs, b * size + 1, size))
        lengths = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["match"]))
        one = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), nothing.alias("out")), place)["out"]

        def joined(blocks: Column) -> Column:
            begins = let(
                F.transform(blocks, lengths), lambda n: F.transform(n, lambda _, k: F.aggregate(F.slice(n, F.lit(1), k), F.lit(0), lambda x, y: x + y))
            )
            return F.flatten(F.zip_with(blocks, begins, one))

        return let(blocks, joined)

    return let(pairs, lambda p: F.when(F.size(p) == 0, nothing).otherwise(whole(p)))


def _spans_of(kind: str, text: Column) -> Column:
    """Spans of a kind whose matches pass its check."""

    def span(m: Column) -> Column:
        entity = m["match"] if kind in ("email", "ip") else F.regexp_replace(m["match"], "[^0-9]", "")
        entity = F.lower(entity) if kind == "email" else entity
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), entity.alias("entity")).cast(SPAN)

    found = F.transform(F.filter(placed(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"])), span)
    return F.when(GATES[kind](text), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    """By start, then kind as listed (terms last), then end."""
    rank = lambda k: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), k), F.lit(0)) + F.when(k == "term", 9).otherwise(0)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s["kind"]).alias("b"), s["stop"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with _base (ordered spans), _key (two hashes of the text) and, where there are spans, _terms (term, start, stop) and _text."""
    text = text_of()
    found = docs.withColumn("_base", F.concat(*(_spans_of(k, text) for k in KINDS)))
    found = found.withColumn("_base", F.when(F.size("_base") > 1, ordered(F.col("_base"))).otherwise(F.col("_base")))
    some = F.size("_base") > 0
    # Of the kinds only emails have letters: they are blanked out, so that terms lie outside of all spans.
    pieces = F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("match"))
    blanked = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.repeat(F.lit("0"), F.coalesce(F.length(p["match"]), F.lit(0))))), "")
    terms = F.transform(placed(blanked, TERM), lambda m: F.struct(F.lower(m["match"]).alias("term"), m["start"].alias("start"), m["stop"].alias("stop")))
    return found.withColumns(
        {"_key": F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")), "_terms": F.when(some, terms), "_text": F.when(some, text)}
    )


def letters_runs(text: Column) -> Column:
    """The distinct lower-cased runs of letters of a text."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " ", -1))


def disclosing_terms(found: DataFrame, docs: DataFrame, smooth: float, generalise: float, most_terms: int) -> DataFrame:
    """(_key, term, disclosure) at or above ``generalise``, the greatest over the text's entities. ``found``: base_spans(), materialized."""
    copies = materialize(found.groupBy("_key").agg(F.count("*").alias("_n")), "texts")
    whole = copies.agg(F.count("*").alias("rows"))
    repeated = maybe_broadcast(materialize(copies.where("_n > 1").select("_key.*", "_n"), "repeated"), 500_000)
    each = found.where(F.size("_base") > 0).groupBy("_key").agg(
        F.first(F.array_distinct(F.transform("_base", lambda b: F.concat_ws(":", b["kind"], b["entity"])))).alias("entities"),
        F.first(F.array_distinct(F.transform("_terms", lambda t: t["term"]))).alias("terms"),
    )  # rows of equal texts are equal
    each = materialize(each, "holders")
    # Entities of the same texts meet every term equally often: they are one group, known by two sums of its texts' hashes. Most
    # entities have one text, so a text of many entities and terms has few groups to pair with its terms.
    where = each.select("_key", F.explode("entities").alias("_e"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_key").cast("decimal(38,0)"))
    signed = where.groupBy("_e").agg(F.count("*").alias("texts"), F.xxhash64(total(1), total(2)).alias("_s1"), F.xxhash64(total(3), total(4)).alias("_s2"))
    signed = signed.select("_e", F.struct("texts", "_s1", "_s2").alias("group"))
    groups = where.join(signed, "_e").groupBy(F.col("_key").alias("_k")).agg(F.collect_set("group").alias("groups"))
    each = materialize(each.select("_key", "terms").join(groups, F.col("_key") == F.col("_k")).drop("_k"), "groups")
    # A text of n copies adds 1 / n for each of them: sums are numbers of distinct texts.
    hashed = docs.select(text_of().alias("t")).select("t", F.xxhash64("t").alias("_a"), F.xxhash64(F.lit(7), "t").alias("_b"))
    weighed = hashed.join(repeated, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select("t", (1 / F.coalesce("_n", F.lit(1))).alias("w"))
    seen = weighed.select(F.explode(letters_runs(F.col("t"))).alias("_w"), "w").where(F.length("_w") >= 3)
    seen = seen.groupBy("_w").agg(F.round(F.sum("w")).cast("long").alias("with_term"))
    rows = F.broadcast(materialize(whole.join(each.agg(F.max(F.array_max(F.transform("groups", lambda g: g["texts"]))).alias("most")), F.lit(True)), "rows"))  # a single row
    # both <= texts, so a term of more texts than this is below ``generalise`` for every entity; one more against rounding.
    can = F.pow("most", F.lit(generalise)) * F.pow(F.greatest(F.col("rows"), F.col("most") + 1), F.lit(1.0 - generalise)) + 1
    seen = maybe_broadcast(materialize(seen.join(rows, F.col("with_term") <= can).select("_w", "with_term"), "terms"), most_terms)
    met = each.select("_key", "groups", F.explode("terms").alias("term")).join(seen, F.col("term") == F.col("_w"))
    met = materialize(met.select("_key", "term", "with_term", F.explode("groups").alias("group")), "met")
    joint = met.groupBy("group", "term", "with_term").agg(F.count("*").alias("both"))
    all_ = joint.join(rows, F.lit(True))
    texts = F.col("group.texts")
    prior = texts / F.greatest(F.col("rows"), texts + 1)
    given = F.least((F.col("both") + smooth * prior) / (F.col("with_term") + smooth), F.lit(1.0))
    measured = all_.withColumn("disclosure", F.log(given / prior) / -F.log(prior)).where(F.col("disclosure") >= generalise)
    strong = measured.select(F.col("group").alias("_g"), F.col("term").alias("_t"), "disclosure")
    hit = met.join(strong, (F.col("group") == F.col("_g")) & (F.col("term") == F.col("_t")))
    return hit.groupBy("_key", "term").agg(F.max("disclosure").alias("disclosure"))


def find_spans(docs: DataFrame, smooth: float = 1.0, generalise: float = 0.8, remove: float = 0.95, most_terms: int = 100_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with spans and base_spans: arrays of (kind, start, stop, entity, disclosure), with and without terms; with
    sanitised: entities replaced by their kind, terms generalised to [TERM] or, from ``remove`` on, left out (null for texts
    without a span, which stay as they are); and with text_sha256, of the whole text as sanitised.

    Without ``keep_text`` the text is left out, so that only texts with spans, ids, spans and other columns are written on the way.
    """
    columns = [c for c in docs.columns if keep_text or c != "text"]
    found = base_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "text"))
    found = found.withColumn("_sha", F.when(F.col("_text").isNull(), F.sha2(text_of(), 256)))
    found = materialize(found.drop("text"), "spans")
    terms = disclosing_terms(found, docs, smooth, generalise, most_terms)
    terms = terms.groupBy(F.col("_key").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_strong"))  # a text's own terms
    base = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["entity"].alias("entity"), F.lit(1.0).alias("disclosure")))
    bare = found.where(F.size("_base") == 0).select("row", "_sha", F.lit(None).cast("string").alias("sanitised"), base.alias("spans"), base.alias("base_spans"))
    some = found.where(F.size("_base") > 0).join(terms, F.col("_key") == F.col("_k"), "left")
    strong = F.transform(
        F.filter("_terms", lambda t: F.map_contains_key("_strong", t["term"])),
        lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), t["term"].alias("entity"), F.element_at("_strong", t["term"]).alias("disclosure")),
    )
    every = ordered(F.concat(base, F.coalesce(strong, F.filter(base, lambda s: F.lit(False)))))
    some = some.select("row", "_sha", "_text", every.alias("spans"), base.alias("base_spans"))
    some = some.select("row", "_sha", _sanitised(F.col("_text"), remove).alias("sanitised"), "spans", "base_spans")
    out = bare.unionByName(some).withColumn("text_sha256", F.coalesce("_sha", F.sha2("sanitised", 256)))
    return unpacked(out, columns, "spans", "base_spans", "sanitised", "text_sha256")


def _tops(stops: Column) -> Column:
    """For each of ``stops`` the greatest before it, 0 at first; in blocks like placed()."""
    none = F.array().cast("array<int>")

    def whole(stops: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(stops))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(stops) - 1) / size).cast("int")), lambda b: F.slice(stops, b * size + 1, size))
        step = lambda s, x: F.struct(F.greatest(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        one = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"]
        before = lambda tops: F.transform(tops, lambda _, k: F.coalesce(F.array_max(F.slice(tops, F.lit(1), k)), F.lit(0)))
        return let(blocks, lambda x: F.flatten(F.zip_with(x, let(F.transform(x, lambda block: F.array_max(block)), before), one)))

    return F.when(F.size(stops) == 0, none).otherwise(let(stops, whole))


def _sanitised(text: Column, remove: float) -> Column:
    def piece(s: Column, at: Column) -> Column:
        label = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["disclosure"] >= remove, "").otherwise("[TERM]")
        inside = s["start"] < at  # begins in a span before it
        return F.when(inside, "").otherwise(F.concat(F.substring(text, at + 1, s["start"] - at), label))

    stops = F.transform("spans", lambda s: s["stop"])
    rest = F.substring(text, F.coalesce(F.array_max(stops), F.lit(0)) + 1, F.lit(2**31 - 1))
    return F.concat(F.array_join(F.zip_with("spans", _tops(stops), piece), ""), rest)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``spans`` and ``sanitised``; a text without spans is its own sanitised text."""
    found = find_spans(docs, **options)
    return found.withColumn("sanitised", F.coalesce("sanitised", "text")).drop("base_spans", "text_sha256")
