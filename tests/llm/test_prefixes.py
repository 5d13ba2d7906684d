"""Counts inside words and unspaced texts against the library."""

import random

import public_tokenizers
from calspar.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "they're we'll 'Re it's's ''''sss'ss don't", "日本語のテキストは空白なしで続く。", "naïve été İstanbul ΣΑΣ ǅ", "a!!<|endoftext|>x <|startoftext|>", "internationalization" * 3,
    " \n lead and trail \t", "😀😀👨‍👩‍👧", "a\x1cb c\x1d d", "ครั้งหนึ่งนานมาแล้ว", "",
]


def test_every_prefix_of_a_text():
    library, counter = Tokenizer.from_file(PATH), tokens.Counter(PATH)
    random.seed(5)
    texts = TEXTS + ["".join(random.choice("abeinrstTHE'019.!_éß \n日Σ") for _ in range(random.randint(1, 40))) for _ in range(200)]
    for text in texts:
        got = counter.every(text)
        assert got == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)], text
        assert (got[-1] if got else 0) == counter.count(text)


def test_questions_inside_words(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    kept = tokens.prefix_counts(docs, PATH).select("doc_id", *[tokens.tokens_at(k).alias(f"at{k}") for k in (0, 7, 500)], *[tokens.cut_at(k, inside=True).alias(f"cut{k}") for k in (0, 3, 6)])
    for row in kept.collect():
        text = [*TEXTS, ""][row["doc_id"]]
        n = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [row[f"at{k}"] for k in (0, 7, 500)] == [n[min(k, len(text))] for k in (0, 7, 500)]
        for k in (0, 3, 6):
            assert row[f"cut{k}"] == max(i for i in range(len(text) + 1) if n[i] <= k and (i == 0 or tokens.WORD.fullmatch(text[i - 1]))), (text, k)
