import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillcast.llm.tokens import Counter, Memo, counter, merged, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "<|endoftext|>a<|startoftext|>", "a\x1cb \x85 c\xa0d", "É ́x ΣΑΣ σας İstanbul ß", "don't I'M we'VE 12345 ½ ٣",
    "<|ENDOFTEXT|> <|endoftext|", "日本語 한국어 👩‍👩 ​", "a" * 5000, "ab" * 3000 + "\t\r\nx\x0bq z", "x<|endoftext|>́y",
]


def test_counts_match_the_library():
    library = Tokenizer.from_file(PATH)
    draw = random.Random(1)
    letters = "aeinthr's<|>dofx \n\t\x01ćÉ12Σ!.~_"
    texts = ODD + ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(3000)]
    own = counter(PATH)
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_merging_takes_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert merged(list("abc"), ranks) == 1
    assert merged(list("aab"), {("a", "a"): 0, ("a", "b"): 1}) == 2  # the earlier rank wins over the later pair
    assert merged(list("aaaaa"), {("a", "a"): 0, ("aa", "aa"): 1}) == 2
    assert merged([], ranks) == 0


@pytest.mark.parametrize("rows", [[], [(1, None, 5), (1, None, 5), (2, "the and", 7), (None, "x " * 3000, 1)]])
def test_rows_with_nulls_repeats_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = token_counts(docs, PATH).collect()
    expected = [(i, len((t or "").encode()), counter(PATH).count(t)) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)


def test_a_memo_keeps_frequent_words_within_its_bytes():
    memo = Memo(limit=10 * (Memo.ENTRY + 8))
    for i in range(500):
        memo.put(f"word{i:04}", i)
        assert len(memo.young) + len(memo.old) <= 22
        if i:
            assert memo.get("word0000") in (0, None)
            memo.put("word0000", 0)
    assert memo.get("word0000") == 0 and memo.get("word0001") is None
    memo.put("x" * 1000, 1)
    assert memo.get("x" * 1000) is None


def test_a_small_memo_changes_no_count():
    library = Tokenizer.from_file(PATH)
    own = Counter(PATH)
    own._kept = Memo(limit=3000)
    texts = [*ODD, "the and the, and? " * 20, "Ã© é Ã© é, Ã©, don't dont don't"] * 2
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
