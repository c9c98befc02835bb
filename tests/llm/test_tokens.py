import json

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barforge.llm.tokens import MergeCounter, token_counter

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İstanbul é don't 'sch 12345 \x1c\x1dab", "", "   ", "😀😀 漢字かな", "x" * 5000 + "'ll", "<|endoftext", "ǅ ŉ ß ẞ", "word " * 2000, None]


def test_counts_are_the_library_s(spark):
    library = Tokenizer.from_file(PATH)
    want = [len(library.encode(t, add_special_tokens=False).ids) if t else 0 for t in TEXTS]
    with open(PATH, encoding="utf-8") as f:
        counter = MergeCounter(json.load(f), most_pieces=3)  # the table is emptied again and again
    assert [counter.count(t) for t in TEXTS] == want
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = rows.select("i", token_counter(spark, PATH)(F.col("text")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == want
