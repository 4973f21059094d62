"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as its symbols in a linked list. A heap holds the adjacent pairs by rank and
place; the lowest is popped, its two symbols become one, and the pairs with the new
neighbours are pushed. A pair whose symbols have changed since is skipped. The count is the
initial symbols less the merges; no identifier is made.

The split into words, case folding and byte symbols follow the vocabulary file, by its own
library. Words repeat, so each worker keeps the counts of those it has seen, in a table of
bounded size. Texts stay in their partitions: there is no shuffle.

Null and empty texts have 0 bytes and 0 tokens; rows that repeat are counted each; a text of
any length is counted whole; columns other than the identifier and the text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tillcast.llm.common import kept

#: Bytes of each of a memo's two generations in one worker, and the longest word that it keeps.
KEPT_BYTES = 224 << 20
KEPT_LENGTH = 64

Ranks = dict[tuple[str, str], int]


def merged(symbols: list[str], ranks: Ranks) -> int:
    """Number of symbols left when no adjacent pair has a rank any more."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    get, width = ranks.get, n.bit_length()  # a heap entry is the rank, then the place
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        rank << width | i
        for i, pair in enumerate(zip(symbols, symbols[1:]))
        if (rank := get(pair)) is not None
    ]
    heapq.heapify(heap)
    place = (1 << width) - 1
    left = n
    while heap:
        entry = heapq.heappop(heap)
        i = entry & place
        j = after[i]
        if j >= n or get((symbols[i], symbols[j])) != entry >> width:
            continue  # one of the two went into another merge
        symbols[i] += symbols[j]
        symbols[j] = ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, rank << width | i)
        h = before[i]
        if h >= 0 and (rank := get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, rank << width | h)
    return left


class Memo:
    """What a worker has found for words, in two generations bounded by bytes.

    A full generation becomes the old one and a new one is begun; a word that is found in the old one
    moves on to the new. So frequent words stay, and no more than two generations are ever held.
    """

    #: Bytes of an entry beside its key and value: two objects and a place in the table.
    ENTRY = 200

    def __init__(self, limit: int | None = None):
        self.limit = KEPT_BYTES if limit is None else limit
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) > KEPT_LENGTH:
            return
        self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, self.ENTRY
        self.young[key] = value

    def trim(self) -> None:
        """Let the old generation go: what a worker keeps between tasks is one generation."""
        self.old = {}


class Words:
    """Splits texts as one vocabulary file says: into words, and those into pieces to merge."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = spec = json.load(file)
        self.library = library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str if library.normalizer else str
        self._split = library.pre_tokenizer.pre_tokenize_str
        special = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda t: -len(t[0]))
        self._special = dict(special)
        self._find = re.compile("(" + "|".join(re.escape(t) for t, _ in special) + ")") if special else None
        self._marks = {t[:2] for t, _ in special}
        # on printable ASCII the library's folding is lower() and its byte symbols are the text
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        known = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self._ascii = regex.compile(steps[0]["pattern"]["Regex"]).findall if known else None

    def _plain(self, text: str) -> list[str]:
        if self._ascii and text.isascii() and text.isprintable():
            return self._ascii(text.lower())
        return [p for p, _ in self._split(self._normalize(text)) if p]

    def pieces(self, word: str) -> list[str | int]:
        """Pieces of a text without blanks and line ends; special strings become their ids."""
        if self._find and any(m in word for m in self._marks):
            parts = self._find.split(word)  # every second part is a special string
            out: list[str | int] = []
            for i, part in enumerate(parts):
                out += [self._special[part]] if i % 2 else self._plain(part) if part else []
            return out
        return self._plain(word)


class Counter(Words):
    """Counts tokens of texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self._end = self.spec["model"].get("end_of_word_suffix") or ""
        merges = (m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"])
        self._ranks: Ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self._kept = Memo()

    def _piece(self, piece: str | int) -> int:
        if isinstance(piece, int):
            return 1
        key = "\n" + piece  # no word holds a line end, so pieces have keys of their own
        n = self._kept.get(key)
        if n is None:
            n = self._merged(piece)
            self._kept.put(key, n)
        return n

    def _merged(self, piece: str) -> int:
        symbols = list(piece)
        symbols[-1] += self._end
        return merged(symbols, self._ranks)

    def _word(self, word: str) -> int:
        n = self._kept.get(word)
        if n is None:
            parts = self.pieces(word)
            whole = len(parts) == 1 and isinstance(parts[0], str)  # kept as a word only
            n = self._merged(parts[0]) if whole else sum(map(self._piece, parts))
            self._kept.put(word, n)
        return n

    def count(self, text: str | None) -> int:
        # no token spans a blank or a line end, so the parts between them count on their own
        total, kept = 0, self._kept.young
        for word in (text or "").replace("\n", " ").split(" "):
            if word:
                n = kept.get(word)
                total += self._word(word) if n is None else n
        return total


@kept
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    documents: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``path`` names the vocabulary."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = [own.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )
        own._kept.trim()

    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
