"""Token counts against the library, on random and hand-picked texts."""

import random

import public_tokenizers
import pytest
from calspar.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
HAND = [
    "", " ", "a", "The cat's don't we'll I'D 12345 $$$!!", "<|endoftext|>x<|startoftext|>", "<|endoftext|", "naïve Ça va İstanbul ΣΑΣ ǅ", "x" * 3000,
    "été 가 日本語のテキスト ", "a\x1cb c\x1d d", "a\x00b", "tab\tnew\nline\x85nel em", "ª º µ ß ÷×", "😀😀 👨‍👩‍👧", "''''sss'ss", "it's's 'Re 'LL", "\ufeffbom \u200bzero", "a\u2003b\u3000c\u1680d\u2028e\u202ff\u205fg\u180eh\u0085i\u00a0j",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    counter = tokens.Counter(PATH)
    random.seed(3)
    pool = "abcdefghijklmnopqrstuvwxyzETAOIN'0123456789.,!?-_éüñçß  \n日Σ"
    texts = HAND + ["".join(random.choice(pool) for _ in range(random.randint(1, 120))) for _ in range(1500)]
    texts += ["".join(random.choice("aeinrst") for _ in range(random.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want, text
        assert sum(n for _, n in counter.spans(text)) == want, text


def test_every_prefix_of_a_piece(library):
    prefixes = tokens.Prefixes(tokens.Vocabulary(PATH))
    for piece in ("internationalization", "tttthhhheeee", "schwierigkeiten", "!!!???..."):
        want = [len(library.encode(piece[:i], add_special_tokens=False).ids) for i in range(1, len(piece) + 1)]
        assert prefixes.all(piece) == want


def test_operator_on_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The end", "z"), (3, "The end", "z"), (None, "a b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(docs, PATH, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, True), (3, 7, 2, True), (None, 3, 2, True)], key=str)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_budget_questions(spark, library):
    text = "One extraordinarily long sentence, cut by budget."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kept = tokens.prefix_counts(docs, PATH)
    row = kept.select("ends", "counts", tokens.tokens_at(20).alias("at"), tokens.cut_at(5).alias("cut")).first()
    for end, count in zip(row["ends"], row["counts"]):
        assert count == len(library.encode(text[:end], add_special_tokens=False).ids)
    assert row["at"] == len(library.encode("One extraordinarily", add_special_tokens=False).ids)
    fit = [e for e in row["ends"] if len(library.encode(text[:e], add_special_tokens=False).ids) <= 5]
    assert row["cut"] == max(fit)
