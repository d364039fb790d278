import bisect
import random
import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

from sitesignal.llm.bpe import default_path
from sitesignal.llm.packing import best_fit, pack


def one_by_one(counts, window):
    capacities, used = [], 0
    for length in sorted(counts.elements(), reverse=True):
        i = bisect.bisect_left(capacities, length)
        if i < len(capacities):
            capacity = capacities.pop(i)
        else:
            capacity, used = window, used + 1
        bisect.insort(capacities, capacity - length)
    return used


def test_histogram_packing_is_best_fit_decreasing():
    rng = random.Random(3)
    for window in (1, 2, 7, 32, 100):
        for _ in range(30):
            counts = Counter(rng.randint(1, window) for _ in range(rng.randint(0, 200)))
            placed, used = best_fit(counts, window)
            assert used == one_by_one(counts, window)
            filled, seen = defaultdict(list), Counter()
            for length, first, n, at, offset in placed:
                assert first == seen[length]
                seen[length] += n
                for w in range(at, at + n):
                    filled[w].append((offset, length))
            assert seen == +counts and sorted(filled) == list(range(used))
            for spans in filled.values():
                end = 0
                for offset, length in sorted(spans):
                    assert offset == end
                    end += length
                assert end <= window


def test_pack(odd_docs, no_docs):
    rows = pack(odd_docs, window=64, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(default_path())
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    expected = Counter()
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected[r.doc_id, len(ids)] += len(ids)
    assert {k: sum(len(x) for _, x in v) // 4 for k, v in documents.items()} == expected
    assert pack(no_docs).count() == 0


def test_no_setting_changes_a_sequence(spark, rows_at):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('word', id % 90, ' '), cast(1 + id % 50 as int)) as text")
    first = rows_at(4, lambda: pack(docs, window=64))
    assert first == rows_at(7, lambda: pack(docs, window=64)) == rows_at(211, lambda: pack(docs, window=64))
