"""Token counts by heap-and-linked-list byte-pair merging.

A text is split as the vocabulary file says (special strings, normal form, lower case, pieces), each piece becomes a
linked list of byte symbols, and a heap gives the lowest-ranked adjacent pair again and again. The count is the number
of initial symbols less the number of merges; no token identifiers are made. Pieces that were counted before come from
a table of bounded size in each worker.

Defined results: a null or empty text has no tokens; repeated rows count alike; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    known = set(plain)
    return [chr(b) if b in known else chr(next(rest)) for b in range(256)]


class MergeCounter(dict):
    """Counts the tokens of a text; as a dict, the counts of pieces seen so far."""

    def __init__(self, spec: dict, most_pieces: int = 400_000):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-pair models are counted")
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.most_pieces = most_pieces
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.steps = self._normalizers(spec.get("normalizer"))
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["use_regex"]:
            raise ValueError("this way of splitting is not known")
        pattern = splits[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self.pieces = regex.compile(pattern).findall

    @staticmethod
    def _normalizers(spec: dict | None) -> list[str]:
        kinds = [n["type"] for n in (spec["normalizers"] if spec["type"] == "Sequence" else [spec])] if spec else []
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalizer among {kinds}")
        return [k for k in kinds if k != "Replace"]  # white space only separates pieces here

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most_pieces:
            self.clear()
        n = self[piece] = self.merged(piece)
        return n

    def merged(self, piece: str) -> int:
        """Symbols of ``piece`` that are left when no adjacent pair can be merged."""
        table = self.symbols
        parts: list = [table[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(parts)
        parts[-1] += self.suffix
        if n == 1:
            return 1
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, n) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, _ = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two was merged since
            parts[i] += parts[j]
            parts[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, n))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, n))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        specials, parts = 0, [text]
        if self.special:
            parts = self.special.split(text)
            specials = len(parts) - 1
        for step in self.steps:
            parts = [self._normal(step, p) for p in parts]
        look = self.__getitem__
        return specials + sum(sum(map(look, self.pieces(p))) for p in parts)

    @staticmethod
    def _normal(step: str, text: str) -> str:
        if text.isascii():
            return text.lower() if step == "Lowercase" else text
        if step == "NFC":
            return unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma


_ready: dict[str, MergeCounter] = {}


def token_counter(spark: SparkSession, vocabulary: str):
    """A function from a text column to its number of tokens, for a vocabulary file that the driver can read."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    spec = spark.sparkContext.broadcast(content)  # a vocabulary: a few MB whatever the corpus
    key = hashlib.sha256(content.encode()).hexdigest()

    @pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _ready.get(key)
        if counter is None:
            counter = _ready[key] = MergeCounter(json.loads(spec.value))
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    def column(text: Column) -> Column:
        return count(text)

    return column
