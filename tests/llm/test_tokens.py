import random
from array import array

import numpy as np
from tokenizers import Tokenizer

from sitesignal.llm.bpe import Coder, default_path, ids_coder, prefix_counter
from sitesignal.llm.tokens import longest_prefixes, prefix_token_counts, tokens_of_prefixes, truncated

PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "!", "..", "é", "12", "\x1c", " ", "<|endoftext|>", "Zx", "'ll", "\r\n", "日本", "😀", " don't", "'T"]


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_every_prefix_has_the_count_of_the_library():
    tokenizer, counter = Tokenizer.from_file(default_path()), prefix_counter(default_path())
    for text in texts(300):
        counts = np.cumsum(np.frombuffer(counter(text), np.int8), dtype=int)
        prefixes = [text[:k] for k in range(1, len(text) + 1)]
        assert [len(e.ids) for e in tokenizer.encode_batch(prefixes, add_special_tokens=False)] == list(counts), text


def test_ids_are_those_of_the_library():
    tokenizer, code = Tokenizer.from_file(default_path()), ids_coder(default_path())
    for text in [*texts(300), "plain words\nand lines", ""]:
        assert code(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_forgetting_changes_nothing():
    coder = Coder(str.encode)
    coder.spaced.size = coder.units.size = 3
    text = " ".join(random.Random(2).choice("abcdefgh") for _ in range(200))
    assert coder(text) == text.encode()


def test_counts_budgets_and_prefixes(spark, odd_docs, no_docs):
    counts = prefix_token_counts(odd_docs).cache()
    tokenizer = Tokenizer.from_file(default_path())
    texts = [r.text or "" for r in odd_docs.collect()]
    n = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = counts.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(n)
    assert sorted(r.n_bytes for r in rows) == sorted(len(t.encode()) for t in texts)
    heads = [len(tokenizer.encode(t[:9], add_special_tokens=False).ids) for t in texts]
    assert sorted(r.n_tokens for r in tokens_of_prefixes(counts, 9).collect()) == sorted(heads)
    for row in longest_prefixes(counts, 5).where("doc_id = 2").collect():
        text = next(r.text for r in odd_docs.collect() if r.doc_id == 2)
        fits = [k for k in range(len(text) + 1) if len(tokenizer.encode(text[:k], add_special_tokens=False).ids) <= 5]
        assert row.n_chars == max(fits)
    assert prefix_token_counts(no_docs).count() == 0


def test_cuts_from_stored_steps_equal_encoding_every_prefix(spark, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(default_path())
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(60, None), (None, "the the the"), (None, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for budget in (0, 1, 12):
        expected = []
        for doc_id, text in rows:
            text = text or ""
            counts = [len(e.ids) for e in tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
            longest = max(k for k, n in enumerate(counts) if n <= budget)
            expected.append((doc_id, len(text.encode()), len(text), counts[-1], longest))
        found = [tuple(r) for r in truncated(prefix_token_counts(docs), budget).collect()]
        order = lambda r: (r[0] is None, r)
        assert sorted(found, key=order) == sorted(expected, key=order)
        assert all((r[4] < r[2]) == (r[3] > budget) for r in found)
    assert truncated(prefix_token_counts(odd_docs), 1024).count() == odd_docs.count()
    assert truncated(prefix_token_counts(no_docs), 1024).count() == 0
