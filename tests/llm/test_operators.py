"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from barforge.llm._common import maybe_broadcast
from barforge.llm import decontaminate, html_text, jaccard, mixing, pii, quality, sharding, urls, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, _base int, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice("ab cd ef gh the of and in on Karl Rome apple house river stone light".split()) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


def documents(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(60, 140)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None) for i in range(60)]
    rows += [(60, None, "en", "s0", 1), (61, "", None, None, 1), (None, prose(rng, 80), "en", "s0", 1), (62, " \n\t ", "en", "s1", 1), (63, "x" * 3000 + " " + prose(rng, 3000), "en", "s2", 1)]
    rows += [rows[5], rows[5], (64, rows[5][1], "en", "s9", 1), (65, rows[7][1] + " extra", "en", "s0", 1), (66, "dup line here\n" * 30, "en", "s0", 1), (67, " ".join("%%% &&&" for _ in range(60)), "en", "s0", 1)]
    return spark.createDataFrame([(*r, "k", "s", 1, 2) for r in rows], DOC), rows


def empty(spark):
    return spark.createDataFrame([], DOC)


def repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_features_and_verdicts(spark):
    docs, rows = documents(spark)
    out = quality.quality_rules(docs)
    assert quality.quality_rules(empty(spark)).count() == 0
    assert len([c for c in out.columns if c == "kept"]) == 1 and "spans" in out.columns
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(rows)
    for r in rows:
        w, t, g = WORD.findall(r[1] or ""), r[1] or "", got[(r[0], r[1])]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert g["n_words"] == len(w) and g["word_chars"] == sum(map(len, w)) and g["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert g["n_dup_lines"] == len(lines) - len(set(lines)) and g["n_repeat_words"] == repeats(w)
        assert g["base_failed"] == (len(w) < 50 or 100 * repeats(w) > 50 * len(w))
    assert not got[(67, rows[-1][1])]["kept"] and not got[(66, rows[-2][1])]["kept"] and got[(3, rows[3][1])]["kept"]


def test_word_lengths_have_no_last_cell(spark):
    """Texts without spaces: their own group's lengths decide, however long its words are."""
    rows = [(i, " ".join("字" * (60 + (i + j) % 7) + str(j) for j in range(60)), "zh", "s") for i in range(240)] + [(999, " ".join("字" * 900 + str(j) for j in range(60)), "zh", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame([(i, t + f" {i}", lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string")).where("not base_failed").collect()}
    assert kept and all(kept[i] for i in kept if i < 999) and not kept.get(999, False)


def test_fences_follow_a_source_whose_median_is_zero(spark):
    """Four in ten documents of one source carry symbols; elsewhere the same share of symbols is junk."""
    plain = lambda k: " ".join(f"w{k + 100}x{j}" for j in range(60))
    marked = lambda k, n: plain(k).replace(" ", "% ", n)
    rows = [(i, marked(i, 16) if i % 5 < 2 else plain(i), "en", "prices") for i in range(250)] + [(1000 + i, plain(i), "en", "news") for i in range(250)]
    rows += [(2000, marked(1, 16), "en", "news"), (2001, " ".join(f"%%%%%%w{j}" for j in range(60)), "en", "prices")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in kept if i < 2000) and not kept[2000] and not kept[2001]


def test_sharding(spark):
    docs, rows = documents(spark)
    out = sharding.external_shuffle(docs, shards=5, bucket_bytes=4000).collect()
    assert len(out) == len(rows) and sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(r[0]), str(r[1])) for r in rows)
    for s in range(5):  # docs has a column named shard already: the result's is _shard
        assert sorted(r["slot"] for r in out if r["_shard"] == s) == list(range(sum(r["_shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["_shard"], 5) for r in out) and len({r["_shard"] for r in out}) == 5
    assert sharding.external_shuffle(empty(spark)).count() == 0
    one = spark.createDataFrame([("é€",), (None,)], "t string").select(F.crc32("t"), sharding.record_size(F.col("t"))).collect()
    assert one[0][0] == zlib.crc32("é€".encode()) and [r[1] for r in one] == [21, 16]


def plain_shard(key, shards, seed=20240229):
    """The shard of greatest weight; a weight chains the hashes of seed, key and shard, and a null key leaves the hash as it is."""

    def weight(s):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    return max(range(shards), key=weight)


def test_shards_against_plain_hashes(spark):
    docs, _ = documents(spark)
    out = sharding.external_shuffle(docs, shards=40).collect()
    assert all((r["_shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], 40), plain_shard(r["doc_id"], 41)) for r in out)


def test_slots_depend_on_seed_and_data_alone(spark):
    docs, _ = documents(spark)
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["_shard"], r["slot"], r["grown_shard"])
    a, b = (sorted(map(key, sharding.external_shuffle(docs.repartition(n), shards=5, bucket_rows=8).collect())) for n in (1, 7))
    assert a == b
    n = spark.range(6).select(sharding.fisher_yates(F.col("id").cast("int") * 3, F.lit(5))).collect()
    assert all(sorted(r[0]) == list(range(3 * i)) for i, r in enumerate(n) if i) and n[5][0] != list(range(15))


def test_a_hot_repeated_row_fills_many_buckets(spark):
    """A third of all rows are one row: they get a slot each, spread over the shard, the same whatever the partitions."""
    rows = [(i, f"text {i}", i % 3) for i in range(200)] + [(7, "text 7", 1)] * 100 + [(None, None, None)] * 40 + [(None, "é" * 900, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark long")
    runs = [sharding.external_shuffle(docs.repartition(n), shards=3, bucket_rows=8, bucket_bytes=4000).collect() for n in (1, 5)]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    assert sorted((r[0], r[1], r[2]) for r in runs[0] if r[0] is not None) == sorted(r for r in rows if r[0] is not None)
    assert sum(r[0] is None and r[1] is None for r in runs[0]) == 40 and sum(r[1] == "é" * 900 for r in runs[0]) == 5
    for s in range(3):
        assert sorted(r["slot"] for r in runs[0] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in runs[0])))
    at = sorted(r["slot"] for r in runs[0] if r["doc_id"] == 7)
    assert len(at) == 101 and sum(b - a > 1 for a, b in zip(at, at[1:], strict=False)) > 10


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, tmp_path):
    spark.createDataFrame([(i, ["x" * 100] * 10, [1, 2], (None, "y")) for i in range(50)], "a long, b array<string>, c array<int>, d struct<e: string, f: string>").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    hinted = lambda found: "ResolvedHint" in found._jdf.queryExecution().analyzed().toString()
    assert hinted(maybe_broadcast(df, 50)) and not hinted(maybe_broadcast(df, 49)) and not hinted(maybe_broadcast(df, 50, 50_000))
    assert hinted(maybe_broadcast(df.where("a < 0"), 0, 0))


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_components(rows, width, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for n in (4, 12, 40, 90, 200):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for k in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 15))):
                copy[rng.randrange(n)] = f"v{rng.randrange(500)}"
            rows.append((len(rows), " ".join(copy).title() if k % 2 else "\t".join(copy)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + k, shared + " " + " ".join(f"q{k}_{i}" for i in range(20))) for k in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (None, rows[0][1]), (5, rows[5][1]), (2004, "  ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _n int")
    want = plain_components(rows, width, percent)
    for block in (4096, 3):
        got = jaccard.jaccard_components(df, width, percent, block=block).collect()
        assert len(got) == len(rows) and all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t, width)) for _, t in rows)
    kept = {r["doc_id"] for r in jaccard.one_of_each(df, width, percent).collect()}
    assert kept == {*want.values(), None}
    assert jaccard.jaccard_components(df.limit(0), width, percent).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_cell_at_every_size(percent):
    """Words appended and removed, from 1 shingle to 150, by the definition of a link alone, whatever counts as frequent."""
    rng = np.random.default_rng(percent)
    for n in range(1, 151):
        links = [(more, less) for more in range(n) for less in range(n) if 100 * (n - less) >= percent * (n + more) and more + less]
        for more, less in links if len(links) < 30 else rng.permutation(links)[:30]:
            for share in (0.0, 0.5, 0.95, 1.0):
                words = rng.integers(1, 2**63, size=n + more, dtype=np.uint64)
                listed = np.sort(words[rng.random(len(words)) < share])
                order = jaccard.Order(listed, rng.integers(1, 9, len(listed)))
                sets = sorted((np.sort(words[:n]), np.sort(words[less:])), key=len)
                (_, inner), (outer, _) = (jaccard.prefix_lengths(len(s), percent) for s in sets)
                assert set(order.rarest(sets[0], inner).tolist()) & set(order.rarest(sets[1], outer).tolist()), (n, more, less, share)


def test_a_document_with_two_texts_links_their_classes(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(1, a), (5, b), (5, a), (9, b), (5, b), (7, a + " more"), (11, None), (5, None), (12, "alone")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (7, 1), (11, 11), (12, 12)}


def test_hot_passages_of_many_documents(spark):
    """Documents that are mostly one passage, with rests of their own: some linked, all in large cells."""
    rng = random.Random(8)
    shared = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(shared + [f"q{rng.randrange(8) if k % 3 else k}_{i}" for i in range(rng.randrange(4, 20))])) for k in range(150)]
    want = plain_components(rows, 3, 90)
    for block in (4096, 7):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, block=block).collect()}
        assert got == want
    assert 1 < len(set(want.values())) < 150


def edited(base, words, name):
    """``base`` with ``words`` words replaced, far from each other and from both ends."""
    copy = list(base)
    for k in range(words):
        copy[10 + k * (len(base) // words) + name % 7] = f"{name}x{k}"
    return copy


def test_copies_that_are_just_not_linked_make_few_pairs(spark, monkeypatch):
    """Pairs of near copies below the threshold, and pairs of copies that a few links join: not as many as the square of their number."""
    tried, verified = [], jaccard.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(edited(base, 5, k))) for k in range(40)] + [(100 + k, " ".join(edited(base, 1, 100 + k))) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == plain_components(rows, 5, 80)
    assert sum(tried[1:]) < len(rows)


@pytest.mark.parametrize("block", [4096, 9])
def test_a_forest_with_a_pair_that_is_no_link_is_searched_again(spark, monkeypatch, block):
    """Were every forest one pair that is no link, all that the stars left out would still be found."""
    found, pairs = [], jaccard.residual_pairs

    def wrong(rows, points, percent, forest):
        if forest:
            return rows.select("bucket").distinct().select("bucket", F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
        return found.append(pairs(rows, points, percent, forest)) or found[-1]

    monkeypatch.setattr(jaccard, "residual_pairs", wrong)
    shared = [f"p{i}" for i in range(100)]  # a document for each of its shingles comes first in that cell, so no star links the others
    rows = [(k, " ".join(shared[k : k + 3])) for k in range(98)] + [(100 + k, " ".join(shared + [f"q{k}_{i}" for i in range(3)])) for k in range(22)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, block=block).collect()}
    assert got == plain_components(rows, 3, 90) and got[121] == 100 and found


def test_a_bucket_hands_on_a_forest():
    rng = np.random.default_rng(4)
    common = rng.integers(1, 2**63, size=300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**63, size=10, dtype=np.uint64)])) for _ in range(30)]
    sets += [np.unique(np.concatenate([common[:255], rng.integers(1, 2**63, size=55, dtype=np.uint64)])) for _ in range(30)]
    sketches = pd.DataFrame({"node": range(60), "counts": [jaccard.count_vector(x) for x in sets], "fine": [jaccard.fine_counts(x) for x in sets]})
    rows = pd.DataFrame({"bucket": 7, "cell": 1, "node": range(60), "first": -1, "inner": True, "label": range(60), "own": -1, "i": -1, "j": -1})
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))}
    everything = set(jaccard.bucket_join(rows, sketches, 90, forest=False)[["a", "b"]].itertuples(index=False, name=None))
    some = set(jaccard.bucket_join(rows, sketches, 90, forest=True)[["a", "b"]].itertuples(index=False, name=None))
    assert len(want) == 435 and want == everything and some < want and len(some) == 29


def test_texts_that_share_some_passage_are_not_dealt_with_finer_counts(spark, monkeypatch):
    """All pairs of ten passages: each text meets many others in its cells and is linked with its own copies only."""
    dealt, pairs = [], jaccard.residual_pairs

    def counted(rows, *rest, **named):
        dealt.append(rows.count())
        return pairs(rows, *rest, **named)

    monkeypatch.setattr(jaccard, "residual_pairs", counted)
    passages = [" ".join(f"p{k}_{i}" for i in range(60)) for k in range(10)]
    rows = [(100 * i + 10 * j, f"{passages[i]} {passages[j]}") for i in range(10) for j in range(i)]
    rows += [(k + 1, f"{text} more words") for k, text in rows[::3]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == plain_components(rows, 3, 90) and len(set(got.values())) == 45
    assert dealt[0] < len(rows)


def test_members_of_a_cell_are_cut_where_sizes_allow_no_link(spark):
    points = [(1, 100), (2, 110), (3, 120), (4, 134), (5, 300), (6, 270), (7, 299), (8, 90), (8, 1000), (9, 1112), (9, 10)]
    df = spark.createDataFrame([(k, n, 1, [77]) for k, n in points] + [(20, 50, 1, [78]), (21, 50, 0, [79]), (22, 50, 0, [79])], "node long, n long, inner int, cells array<bigint>")
    got = {(r["node"], r["near"], r["run"] is not None) for r in jaccard.shared_cells(df, 90).collect()}
    assert got == {(2, True, True), (3, False, True), (5, False, True), (6, False, True), (7, False, True), (8, True, False)}
    runs = {r["node"]: r["run"] for r in jaccard.shared_cells(df, 90).collect()}
    assert runs[2] == runs[3] and runs[5] == runs[6] == runs[7] != runs[2]
    df = spark.createDataFrame([(1, 100, 1, [77]), (1, 500, 1, [77]), (2, 450, 1, [77]), (3, 112, 1, [77])], "node long, n long, inner int, cells array<bigint>")
    assert {r["node"] for r in jaccard.shared_cells(df, 90).where("near").collect()} >= {2}


def test_finer_counts_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3000, 40000):
        common = rng.integers(1, 2**63, size=n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(1, 2**63, size=n // 5, dtype=np.uint64)])) for _ in range(2))
        p, q = (jaccard.counts_of(jaccard.count_vector(x)) for x in (a, b))
        (each, before), (other, _) = (jaccard.codes_of(c, jaccard.fine_counts(x)) for c, x in ((p, a), (q, b)))
        assert (each == jaccard.codes(a)).all()
        bound = np.count_nonzero(np.bincount(other, minlength=1 << 15)[each] > before)
        assert n <= bound <= np.minimum(p, q).sum() and bound == np.minimum(*(np.bincount(x, minlength=1 << 15) for x in (each, other))).sum()


def test_a_word_appended_to_sixteen_links(spark):
    words = [f"w{i}" for i in range(18)]
    rows = [(2 * n + k, f"t{n} " + " ".join(words[: n - 1 + k])) for n in range(12, 18) for k in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    want = plain_components(rows, 3, 90)
    assert got == {i: want[i] for i, _ in rows} and got[33] == 32


def test_shingle_hashes_do_not_depend_on_pieces():
    rng = random.Random(1)
    data = " ".join("x" * rng.randrange(1, 40) + str(i) for i in range(500)).encode()
    whole = jaccard.word_hashes(data)
    assert len(whole) == 500 and len(set(whole.tolist())) == 500
    assert (jaccard.word_hashes(data, piece=64) == whole).all() and (jaccard.word_hashes(data.upper()) == whole).all()


def test_the_tree_bounds_and_finds(spark):
    rng = np.random.default_rng(0)
    points = rng.integers(0, 9, (300, jaccard.GROUPS))
    tree = jaccard.CountTree(points, np.arange(300))
    for i in range(0, 300, 37):
        want = [j for j in range(300) if j != i and np.minimum(points[i], points[j]).sum() >= jaccard.need(60, points[i].sum() + points[j].sum())]
        assert sorted(tree.search(points[i], i, 60).tolist()) == want


def test_decontamination(spark):
    rng = random.Random(2)
    items = ["If a train leaves Paris at 9 with 120 people and 35 km later 12 people get off, how many people stay on the train?", "too short", None, prose(rng, 30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    filler = prose(rng, 50)
    changed = items[0].replace("Paris", "Oslo").replace("120", "77").replace("35", "41").replace("9", "8")
    clash = items[0].replace("12 people", "120 people")  # equal slots no longer stand for equal slots
    docs = [(0, f"{filler}. {items[0]} {filler}"), (1, f"{filler}. {changed} {filler}"), (2, filler), (3, None), (4, items[3]), (5, "too short"), (None, items[0]), (0, filler), (6, ""), (7, "7 " * 50)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _bad int")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated_documents(df, bench).collect()}
    assert got == {0: [0], 1: [0], 4: [3], None: [0]}
    by_shuffle = {r["doc_id"] for r in decontaminate.contaminated_documents(df, bench, most_windows=0).collect()}
    assert by_shuffle == set(got)
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {2, 3, 5, 6, 7}
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs) and decontaminate.contaminated(df.limit(0), bench).count() == 0
    slots = decontaminate.window_matches(spark.createDataFrame([(1, clash)], "doc_id long, text string"), decontaminate.benchmark_index(bench, 8), [8])
    assert slots.count() > 0


def test_slots_of_a_copy_and_of_another_text(spark):
    """One altered number, two numbers that become equal, a short item; and a text of the same template whose numbers fit nowhere."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my".split()
    item = " ".join(f"{w} 12" for w in words)
    bench = spark.createDataFrame([(1, item), (2, "the train from Paris took 120 minutes and the bus 35 minutes to the sea"), (3, "What is 3 plus 4?"), (4, "of it")], "item_id long, text string")
    docs = [(1, item.replace("my 12", "my 13")), (2, " ".join(f"{w} {20 + k}" for k, w in enumerate(words))), (3, "the train from Oslo took 8 minutes and the bus 8 minutes to the sea")]
    docs += [(4, "He asked: what is 17 plus 5? Nobody knew."), (5, "What is it plus 4?"), (6, "of it and of it"), (7, "so what is the plus of 4?"), (8, "It was long. " * 3000 + item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated_documents(df, bench).collect()}
    assert got == {1: [1], 3: [2], 4: [3], 8: [1]}


def test_documents_are_tokenized_once_and_not_joined_back(spark, monkeypatch):
    """With a broadcast index no table grows with the documents but that of matching windows; the join by shuffle finds the same."""
    rng, tables = random.Random(7), []
    kept = decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: tables.append(name) or kept(df, name))
    items = [prose(rng, 20), "The bus to Oslo took 35 minutes and 12 people got off", "What is 3 plus 4?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(k, f"{prose(rng, 30)}. {items[k % 3]} {prose(rng, 30)}" if k % 2 else prose(rng, 60)) for k in range(40)] + [(1, items[0]), (None, items[2]), (99, None), (3, f"{items[1]}. {items[1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.contaminated(df, bench)
    assert tables == ["items", "benchmark-windows"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"\p{Lu}[^ ]*+") == 1
    by_shuffle = decontaminate.contaminated(df, bench, most_windows=0)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, by_shuffle.collect())) and {k for k in range(40) if k % 2} | {None} <= {r["doc_id"] for r in out.collect()}


def plain_spans(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]

    kinds = list(pats)
    return sorted((m.start(), kinds.index(k), m.end()) for k, p in pats.items() for m in re.finditer(p, t or "") if ok(k, m[0]))


def test_personal_data(spark):
    texts = ["a@b.c+d@e.f, x@y and é😀 u.v@w-x.y.z.", "1.2.3.4.5 256.1.1.1 001.002.003.004 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890", "+1 (017) 555-7713 +12 +4 1 2 3 4 5 6 7 8 9 0 -", None, "", "@.@ a@b. +", "0" * 400, "a" * 20000 + "@b.c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    got = pii.find_spans(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _base int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(r["text"]))
        assert ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["base_spans"]) == want
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_that_reveal_are_found_and_removed(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(rng, 20)} Kaspar wrote from k.spar@mail.org to the {prose(rng, 20)}") for i in range(6)] + [(10 + i, f"the {prose(rng, 40)}") for i in range(80)]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), most_terms=1000).collect()}
    for i, t in rows:
        terms = {t[s["start"] : s["stop"]] for s in out[i]["spans"] if s["kind"] == "term"}
        if i < 6:
            assert "Kaspar" in terms and "the" not in terms and "k.spar" not in out[i]["sanitised"] and "[EMAIL]" in out[i]["sanitised"] and "Kaspar" not in out[i]["sanitised"]
        else:
            assert out[i]["spans"] == [] and out[i]["sanitised"] == t
    again = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), most_terms=0).collect()
    assert {r["doc_id"]: r["spans"] for r in again} == {i: r["spans"] for i, r in out.items()}


def test_terms_of_entities_in_one_or_two_texts(spark):
    rng = random.Random(5)
    rows = [(i, f"{prose(rng, 20)} Zacharias wrote to z{i}@mail.org from the {prose(rng, 20)}") for i in range(1)]
    rows += [(i, f"{prose(rng, 20)} the pseudonym of +49 151 5550 1234 and {prose(rng, 20)}") for i in (1, 2)] + [(10 + i, f"the {prose(rng, 40)}") for i in range(200)]
    for most_terms in (0, 1000):
        out = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), most_terms=most_terms).collect()}
        terms = {i: {s["entity"] for s in out[i] if s["kind"] == "term"} for i in out}
        assert "zacharias" in terms[0] and "pseudonym" in terms[1] & terms[2]
        assert not {"the", "and", "apple", "house"} & (terms[0] | terms[1] | terms[2]) and not any(out[i] for i in out if i >= 10)


def plain_terms(texts, smooth=1.0, least=0.8):
    """{text: {(start, stop): disclosure}} of the terms that reveal an entity of their text, pair by pair."""
    import math

    import regex

    distinct = sorted({t or "" for t in texts})
    runs = {t: {w for w in regex.findall(r"\p{L}+", t.lower()) if len(w) >= 3} for t in distinct}
    entities, terms = {}, {}
    for t in distinct:
        spans = plain_spans(t)
        entities[t] = {(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for a, k, b in spans}
        outside = list(t)
        for a, k, b in spans:
            if k == 0:
                outside[a:b] = "0" * (b - a)
        terms[t] = [(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"\p{L}{3,}", "".join(outside))]
    out = {}
    for t in distinct:
        best = {}
        for e in entities[t]:
            texts_of = [u for u in distinct if e in entities[u]]
            prior = len(texts_of) / max(len(distinct), len(texts_of) + 1)
            for w in {w for w, _, _ in terms[t]}:
                both, with_term = sum(w in {x for x, _, _ in terms[u]} for u in texts_of), sum(w in runs[u] for u in distinct)
                given = min((both + smooth * prior) / (with_term + smooth), 1.0)
                best[w] = max(best.get(w, -9.0), math.log(given / prior) / -math.log(prior))
        out[t] = {(a, b): best[w] for w, a, b in terms[t] if best.get(w, -9.0) >= least}
    return out


def test_disclosure_against_plain_pairs(spark):
    """Entities of one text, of the same texts, of overlapping texts; copies; terms inside and outside of emails."""
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    people = [f"{chr(97 + i)}{chr(97 + i)}.mail{i}@host.org" for i in range(9)] + ["+49 151 5550 1234", "10.0.0.7"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))) for _ in range(150)]
    for k in range(40):
        inside = rng.sample(people, rng.randrange(1, 5)) if k % 4 else people[:3]  # three that are always together
        texts.append(" ".join(rng.sample(words, 12) + inside + ([f"secret{chr(97 + people.index(inside[0]))}"] if k % 3 else ["Geheim"])))
    texts += texts[-6:] + [None, ""]
    want = plain_terms(texts)
    for most_terms in (0, 1000):
        got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_terms=most_terms).collect()
        for r in got:
            found = {(s["start"], s["stop"]): s["disclosure"] for s in r["spans"] if s["kind"] == "term"}
            assert found.keys() == want[r["text"] or ""].keys() and all(abs(v - want[r["text"]][k]) < 1e-9 for k, v in found.items())
    assert sum(map(len, want.values())) > 20


def test_many_entities_and_terms_in_one_text(spark):
    """Rows follow their number, not its square."""
    letters = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    text = " ".join(f"u{i}@h{i}.org {letters(i)}" for i in range(3000))
    rows = [(0, text)] + [(i, f"the {letters(90_000 + i)} of it") for i in range(1, 40)]
    (r,) = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").collect()
    assert len(r["base_spans"]) == 3000 and sum(s["kind"] == "term" for s in r["spans"]) == 3000


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>One <b>two</b>three\n four &lt;x&gt;.<br>five<p>{}</article><footer>&copy; site words</footer>'


def test_the_linear_scan_finds_what_all_regions_give():
    """Of regions with the greatest sum the one that ends first, without leading words that add nothing; none where no sum is above zero."""
    rng = random.Random(5)
    for n in (0, 1, 2, 9, 40):
        for _ in range(60):
            scores = [float(rng.randrange(-4, 4)) for _ in range(n)]
            every = [(sum(scores[a:b]), -b, a) for b in range(1, n + 1) for a in range(b)]
            best = max(every, default=(0.0, 0, 0))
            assert html_text.best_region(scores) == ((best[2], -best[1]) if best[0] > 0 else (0, 0))


def test_main_text(spark):
    pages = [PAGE.format(f"Body {i} " * 30) for i in range(20)]
    weights = html_text.fit(pages)
    assert html_text.extract(PAGE.format("six&nbsp;seven"), weights) == "Head & line One twothree four <x>. five six seven"
    nested = PAGE.format('eight<aside>skip <aside>this</aside> too</aside> nine<div class="comments"><p>not me</p></div>')
    assert html_text.extract(nested, weights) == "Head & line One twothree four <x>. five eight nine"
    names = PAGE.format('a <a class="related" href="#">linked</a> word<h2 id="search-results">Results</h2><section><div class="ad">buy<p>now</section>after')
    assert html_text.extract(names, html_text.Weights(1.0, {}, 0.01)) == "Head & line One twothree four <x>. five a linked word Results after"
    assert html_text.extract(PAGE.format("long " * 200_000), weights).count("long") == 200_000
    rows = [(i, "u", p) for i, p in enumerate(pages)] + [(90, None, None), (91, "u", ""), (92, "u", "plain < words"), (None, "u", pages[0]), (0, "u", pages[0])]
    out = html_text.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["page_id"]: r["text"] for r in out}[92] == "plain < words" and {r["page_id"]: r["text"] for r in out}[90] == ""
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html_text.best_region([1, -5, 2, 3, -1, 2, -9, 6]) == (2, 6)
    rng = random.Random(6)
    for _ in range(300):  # the quadratic search: first start, then first end, of the greatest sum above zero
        scores = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 14))]
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        i, j = html_text.best_region(scores)
        assert sum(scores[i:j]) == max(best, 0) and (best > 0) == (j > i)


def test_names_and_formulas_of_articles():
    """A name says what an element is when it is whole or last; formulas and fallbacks are words of the article."""
    text = lambda body: html_text.extract(f"<article>{body}</article>", html_text.Weights(1.0, {}, 0.01))
    assert text('<section class="related-work"><p>We discuss</p></section>') == "We discuss"
    assert text('<div class="search-page-content"><p>hello all</p></div>') == "hello all"
    for name in ("ad", "site-nav", "box post__share", "Related", "x_comments"):
        assert text(f'<p>one</p><div class="{name}"><p>buy</p></div><p>two</p>') == "one two", name
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>") == "Let x=2 be"
    assert text("<p>a</p><object data='f'><p>no film</p></object><p>b</p>") == "a no film b"
    assert text("<p><math><semantics><mi>y</mi><annotation encoding='t'>\\y</annotation></semantics></math></p>") == "y"


def test_urls(spark):
    rules = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow")]
    rows = [(1, "http://A.example.NET/en/1?x"), (2, "https://b.net/q#f"), (3, "http://b.net"), (4, None), (5, "nohost/x"), (6, "http://h.org/a//b/c/d?z"), (6, "http://h.org/a//b/c/d?z"), (None, "x://y?://z/w")]
    rows += [(100 + i, f"http://mix.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)], "page_id long, bad int")
    out = urls.filter_urls(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string"), labels, rules).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == len(rows)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2]["rule"], by[2]["verdict"]) == ("net/", "block") and by[3]["rule"] is None and by[3]["path"] == ""
    assert (by[4]["host"], by[4]["path"], by[5]["host"]) == ("", "", "") and by[6]["path"] == "/a//b/c/d" and by[None]["host"] == "y"
    assert all(by[100 + i]["verdict"] == ("block" if i % 2 else "allow") and by[100 + i]["template"].startswith("/bad" if i % 2 else "/good") for i in range(60))
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), labels, rules).count() == 0


def test_a_bad_branch_among_thousands_of_slugs(spark):
    """One frequent bad branch beside many segments seen once, and one below a branch that isn't bad as a whole."""
    rows = [(i, f"http://big.org/casino/{'abc'[i % 3]}x{i}") for i in range(100)] + [(1000 + i, f"http://big.org/slug{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/page") for i in range(600)]
    rows += [(3000 + i, f"http://big.org/en/a/b/{'win' if i % 4 == 0 else 'news'}/{i}") for i in range(200)]
    labels = [(i, 1) for i in range(0, 100, 2)] + [(1000 + i, 0) for i in range(0, 600, 3)] + [(3000 + i, int(i % 4 == 0)) for i in range(200)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), []).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {*range(100), *range(3000, 3200, 4)}
    templates = {r["template"] for r in got}
    assert any(t.startswith("/casino") for t in templates) and any("/win" in t for t in templates) and len(templates) < 12


def test_mixing(spark):
    docs, rows = documents(spark)
    placed, mixed = mixing.mix(docs, block_words=16, shard_slots=50)
    out = mixing.taken_words(placed, mixed).collect()
    assert len(out) == len(rows) and sorted(r["size"] for r in out) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"] and abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 32
    again = mixing.taken_words(*mixing.mix(docs.repartition(3), block_words=16, shard_slots=50)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["offset"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    slots = mixed.groupBy("shard", "slot").agg(F.countDistinct("source_id", "block").alias("n"))
    assert slots.where("n <> 1").count() == 0
    assert mixing.taken_words(*mixing.mix(empty(spark))).count() == 0
    twice = mixing.mixed_documents(docs, block_words=16)
    assert twice.columns == docs.columns and twice.where("text is null").count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([100, 100, 100], [5.0, 2.0, 1.0]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5.0, 2.0]) == pytest.approx([20, 1495]) and mixing.targets([], []) == []
    for n in (1, 2, 7, 100, 1009):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 3))
        assert sorted(p.tolist()) == list(range(n))
    draws = mixing.draw_shards([1000, 10, 0], 7, 1)
    assert draws.sum(axis=0).tolist() == [1000, 10, 0] and draws.min() >= 0


def test_runs_of_shards_cover_every_slot_once(spark):
    sources = [mixing.Source(str(i), 0, 0.0, 50, n) for i, n in enumerate([1000, 37, 0, 512])]
    for groups in (1, 3, 100):
        runs = mixing.shard_runs(spark, sources, 11, 5, most_groups=groups).toPandas()
        assert sorted(runs["shard"].unique()) == list(range(11)) and runs.groupby("source_id")["n"].sum().to_dict() == {0: 1000, 1: 37, 3: 512}
        for _, own in runs.sort_values("first").groupby("source_id"):
            assert (own["first"] == own["n"].cumsum() - own["n"]).all()
        for _, own in runs.sort_values("slot0").groupby("shard"):
            assert (own["slot0"] == own["n"].cumsum() - own["n"]).all() and 130 <= own["n"].sum() <= 150


def test_archives(spark):
    long = "long é " * 40
    rows = [(3, "http://a/ b\r\nX: y", long), (1, "u", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\nfake\r\n\r\n" * 10), (None, "u", long), (1, "u", long)]
    path = warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _digest int"))
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(rows) and all(r["reason"] is None for r in out)
    by = {r["page_id"]: r for r in out}
    assert (by[1]["record_type"], by[3]["record_type"], by[3]["refers_to"], by[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert by[4]["record_type"] == "response" and by[5]["payload_bytes"] == 0 and by[3]["payload_bytes"] == len(long.encode())
    assert all(r["payload_digest"] == hashlib.sha256((dict((x[0], x[2]) for x in rows)[r["page_id"]] or "").encode()).hexdigest() for r in out)
    assert by[3]["url"] == "http://a/%20b%0D%0AX:%20y" and by[6]["payload"].decode() == rows[5][2]
    assert warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_one_large_page_leaves_the_other_files_large(spark):
    rows = [(i, "u", f"page {i} " * 20) for i in range(2000)] + [(5000, "u", "x" * (33 << 20))]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path").collect()]
    assert len(files) <= 4 and warc.read_archives(spark, path, payload=False).where("reason is null").count() == 2001


def test_salvage_covers_every_byte():
    import gzip

    def record(i, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    parts = [record(0, b"a" * 50), record(1, b"b" * 50).replace(b"bbb", b"xbb", 1), gzip.compress(record(2, b"c" * 50)), b"noise", record(3, b"WARC/1.1\r\nnot one"), gzip.compress(record(4, b"d" * 99))[:-20], record(5, b"e")]
    found = list(warc.salvage(b"".join(parts)))
    assert [f.header.get("warc-record-id") for f in found if not f.reason] == [f"<urn:page:{i}>" for i in (0, 2, 3, 5)]
    assert [(f.start, f.end) for f in found][0][0] == 0 and all(a.end == b.start for a, b in zip(found, found[1:], strict=False)) and found[-1].end == len(b"".join(parts))
    assert sum(bool(f.reason) for f in found) == 3 and list(warc.salvage(b"")) == []
