import math
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillcast.llm import lmscore, tokens
from tillcast.llm.lmscore import scores
from tillcast.llm.packing import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(docs, backoff=0.4):
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in docs]
    one, two = Counter(), Counter()
    for x in ids:
        one.update(x)
        two.update(zip(x, x[1:]))
    out = []
    for (i, _), x in zip(docs, ids, strict=True):
        a, b = Counter(x), Counter(zip(x, x[1:]))
        rest, total = max(sum(one.values()) - len(x), 1), 0.0
        for k, w in enumerate(x):
            single = math.log((one[w] - a[w]) / rest) if one[w] > a[w] else math.log(backoff / rest)
            if k == 0:
                total += single
            elif (seen := two[x[k - 1], w] - b[x[k - 1], w]) > 0:
                total += math.log(seen / (one[x[k - 1]] - a[x[k - 1]]))
            else:
                total += single + (math.log(backoff) if one[w] > a[w] else 0.0)
        out.append((i, len(x), total))
    return out


@pytest.mark.parametrize("block_tokens, part_pairs", [(3_000_000, 2_000_000), (50, 40)])
def test_scores_match_brute_force(spark, block_tokens, part_pairs):
    docs = [(i, f"the cat sat on the mat number {i % 7} and then it went {'away ' * (i % 5)}") for i in range(40)]
    docs += [(50, None), (51, ""), (52, "unheard xylophone"), (53, "the " * 3000), (52, "unheard xylophone"), (None, "the cat")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    found = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.log_score) for r in scores(frame, PATH, block_tokens=block_tokens, part_pairs=part_pairs).collect()), key=str)
    want = sorted(((i is None, i, n, s) for i, n, s in brute(docs)), key=str)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert all(abs(f[3] - w[3]) < 1e-4 for f, w in zip(found, want, strict=True))
    assert scores(frame.limit(0), PATH).count() == 0


def test_the_memo_leaves_room_for_the_blocks():
    own = encoder(PATH, lmscore.MEMO_BYTES)
    assert own._kept.limit == lmscore.MEMO_BYTES < tokens.KEPT_BYTES // 2
    small = encoder(PATH, 20_000)
    words = [f"word{i} and{i}" for i in range(500)]
    assert [small.encode(w) for w in words] == [own.encode(w) for w in words]
    assert len(small._kept.young) + len(small._kept.old) < 250 < len(own._kept.young)
