"""Token counts by prefix dynamic programming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.bpe import default_path, prefix_counter
from sitesignal.llm.common import map_batches


def prefix_token_counts(docs: DataFrame, tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """The exact token count at every prefix of every whole text.

    Columns: doc_id, n_bytes (UTF-8), n_chars (code points), n_tokens and, with
    ``keep``, ``steps``: a signed byte per code point by which the count of the
    prefix that ends there differs from the one before. One narrow pass, no
    shuffle. ``tokenizer`` is the path of a byte-level BPE file of the
    ``tokenizers`` library, to be found on the executors.

    A null text counts as empty; a null doc_id and repeated rows are kept as
    they are, row by row; an empty table gives an empty one. A special string
    inside a text is one token, as the library has it; inside the string the
    counts are those of its cut text.
    """
    path = tokenizer or default_path()

    def prepare():
        counter = prefix_counter(path)

        def step(part):
            texts = [t or "" for t in part["text"]]
            steps = [counter(t) for t in texts]
            out = [
                part["doc_id"],
                [len(t) if t.isascii() else len(t.encode()) for t in texts],
                [len(t) for t in texts],
                [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps],
            ]
            return [*out, steps] if keep else out

        return step

    columns = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_chars", "bigint"), ("n_tokens", "bigint")]
    if keep:
        columns.append(("steps", "binary"))
    return map_batches(docs.select("doc_id", "text"), prepare, columns)


def tokens_of_prefixes(counts: DataFrame, n_chars: int) -> DataFrame:
    """doc_id and the tokens of the text's first ``n_chars`` code points, from stored steps, row by row.

    A shorter text counts whole, an empty one 0; null ids and repeated rows are kept; no counts give no rows.
    """

    def prepare():
        def step(part):
            heads = [np.frombuffer(s[:n_chars], np.int8) for s in part["steps"]]
            return [part["doc_id"], [int(h.sum(dtype=np.int64)) for h in heads]]

        return step

    return map_batches(
        counts.select("doc_id", "steps"), prepare, [("doc_id", "bigint"), ("n_tokens", "bigint")]
    )


def longest_prefix(steps: bytes, budget: int) -> int:
    """The code points of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def longest_prefixes(counts: DataFrame, budget: int) -> DataFrame:
    """doc_id and n_chars, the code points of the longest prefix with at most ``budget`` tokens, row by row."""
    return truncated(counts, budget).select("doc_id", F.col("prefix_chars").alias("n_chars"))


def truncated(counts: DataFrame, budget: int) -> DataFrame:
    """The counts and, from their stored steps, where each text is to be cut: prefix_chars in place of ``steps``.

    ``prefix_chars`` are the code points of the longest prefix with at most ``budget`` tokens. It is all of a text
    that fits, also of an empty one, and 0 where already the first code point does not fit. Null ids and
    repeated rows are kept row by row; no counts give no rows.
    """
    numbers = ["doc_id", "n_bytes", "n_chars", "n_tokens"]

    def prepare():
        return lambda part: [*(part[c] for c in numbers), [longest_prefix(s, budget) for s in part["steps"]]]

    columns = [(c, "bigint") for c in [*numbers, "prefix_chars"]]
    return map_batches(counts.select(*numbers, "steps"), prepare, columns)
