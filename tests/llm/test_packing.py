import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillcast.llm.packing import Block, pack, packed_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def _check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    return len(held)


def test_pieces_and_checksums(spark):
    texts = [(1, None), (2, ""), (3, "the and " * 40), (4, "ç " * 90), (3, "the and " * 40), (None, "x")]
    rows = packed_documents(spark.createDataFrame(texts, "doc_id long, text string"), PATH, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    expected = []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    _check(rows, 64)
    assert packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("low, high", [(1, 100), (30, 70), (51, 99), (100, 100)])
def test_few_sequences_at_every_number_of_blocks(spark, low, high):
    draw = np.random.default_rng(3)
    items = spark.createDataFrame([(int(n),) for n in draw.integers(low, high + 1, 600)], "length long")
    rows = pack(items, capacity=100, block_items=100).collect()
    assert sorted(r["length"] for r in rows) == sorted(r["length"] for r in items.collect())
    used = _check(rows, 100)
    whole = Block(np.sort(np.array([r["length"] for r in rows]))[::-1], 100, 0)
    assert whole.least <= used <= len(whole.loads(whole.first(0.0))) * 1.02  # best fit of all items in one task
    if low > 50:
        assert used == 600


def test_children_are_valid_and_no_worse_in_the_end():
    draw = np.random.default_rng(5)
    lengths = np.sort(draw.integers(20, 60, 400))[::-1].astype(np.int64)
    block = Block(lengths, 100, 1)
    a, b = block.first(0.3), block.first(0.3)
    child = block.child(a, b)
    assert block.loads(child).max() <= 100 and block.loads(child).sum() == lengths.sum()
    best = block.evolve([a, b], 60)[0]
    assert block.fitness(best) >= max(block.fitness(a), block.fitness(b))


@pytest.mark.parametrize("n, length", [(601, 30), (250, 60), (1000, 45)])
def test_lengths_that_never_fill_a_sequence_cost_one_part_filled_sequence(spark, n, length):
    items = spark.createDataFrame([(length,)] * n, "length long")
    rows = pack(items, capacity=100, block_items=50).collect()
    assert len(rows) == n and _check(rows, 100) == -(-n // (100 // length))
