"""Importance resampling against a plain version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barforge.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, width, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(f.encode()) % buckets for f in runs]


def plain(docs, target, width=2, buckets=10_000, least=20, percent=25, seed=7):
    """(id, n_words, n_features, weight, score, rank) of each document, one by one."""
    found, wanted = [plain_features(t, width, buckets) for _, t in docs], [plain_features(t, width, buckets)[1] for t in target]
    s, t = Counter(b for _, f in found for b in f), Counter(b for f in wanted for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0, *o[1:4]))
    drawn = Counter()
    ranks = {}
    for rank, o in enumerate(order[: percent * len(order) // 100], 1):
        ranks[o, drawn[o]] = rank
        drawn[o] += 1
    seen = Counter()
    rows = []
    for o in out:
        rows.append((*o, ranks.get((o, seen[o]))))
        seen[o] += 1
    return rows


def corpus():
    rng = random.Random(5)
    words = "red Green BLUE über naïve river 12 x1 ÄÖ don't stone".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", ";-", "\t", "é"]) for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 90))) for i in range(120)]
    docs += [(120, None), (121, ""), (122, " ;; "), (None, prose(60)), (123, prose(30_000)), (124, "one"), (125, "\x00a\x00 b" * 40), (126, docs[3][1])]
    docs += [docs[9]] * 40 + [(9, prose(50))]
    return docs, [prose(40), "river stone " * 30, None, ""]


@pytest.mark.parametrize(("width", "buckets", "percent"), [(2, 10_000, 25), (3, 97, 60), (1, 5, 100)])
def test_against_plain(spark, monkeypatch, width, buckets, percent):
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, score int, buckets string")
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=buckets, percent=percent)
    want = plain(docs, target, width, buckets, percent=percent)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_blocks_change_nothing():
    texts = pa.array([t for _, t in corpus()[0]])
    whole = importance.feature_buckets(texts, 2, 1000)
    for most in (1, 500, 10_000):
        parts = [importance.feature_buckets(b, 2, 1000) for b in importance.blocks_of(texts, most)]
        assert sum(len(p[0]) for p in parts) == len(texts)
        assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in range(3))


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    """A block of many copies hashes as much as one text."""
    hashed = []
    monkeypatch.setattr(importance, "hashed", lambda strings, n, f=importance.hashed: (hashed.append(len(strings)), f(strings, n))[1])
    importance.feature_buckets(pa.array(["a b c a b"]), 2, 100)
    once, hashed[:] = list(hashed), []
    importance.feature_buckets(pa.array(["a b c a b"] * 500), 2, 100)
    assert hashed == once == [3, 3]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(i, "a b c " * 10) for i in range(8)], "doc_id long, text string")
    assert importance.resample(nothing, docs).count() == 0
    assert importance.resample(docs, nothing).where("rank is not null").count() == 2
    assert importance.drawn_documents(docs, nothing).columns == docs.columns


def test_ranks_of_many_equal_rows(spark):
    """Copies beyond a chunk, scores in several cells, ids that tie."""
    rows = [(1, 50, 9, 3, 5000)] * 9000 + [(i, 50, 9, 3, 5000) for i in range(2, 30)] + [(i, 50, 9, 3, -4000 + 37 * i) for i in range(30, 300)] + [(7, 3, 0, 0, 99_999)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in importance.ranked(scored, percent=99).collect() if r["rank"])
    order = sorted((-s, i) for i, n, _, _, s in rows if n >= 20)[: 99 * 9298 // 100]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]


def test_target_raises_what_is_like_it(spark):
    rng = random.Random(1)
    prose = lambda words: " ".join(rng.choice(words) for _ in range(60))
    alike, other = "sum product angle triangle".split(), "goal match player league".split()
    docs = [(i, prose(alike if i % 2 else other)) for i in range(400)]
    out = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(prose(alike),) for _ in range(20)], "text string"))
    drawn = [r["doc_id"] % 2 for r in out.where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(drawn) > 60
