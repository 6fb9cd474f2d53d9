"""Token counts by heap-and-linked-list byte-pair merging, without emitting ids.

A pre-token starts as a doubly linked list of its bytes' symbols. A heap holds the adjacent pairs that have a merge,
by (rank, place); the lowest is popped again and again, skipping pairs that an earlier merge changed, its two symbols
become one, and the new neighbours' pairs are pushed. The count is the initial symbols less the merges done. Counts of
pre-tokens are kept in a bounded table for each worker.

Defined cases: a null text is an empty one with no tokens; added special strings within a text count one each, as the
library takes them by default; repeated rows are counted as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import common

#: The byte-level pre-tokenizer's split.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens and blank-separated segments whose counts a worker keeps; a table starts anew beyond it.
MEMO = 600_000
MEMO_CHARS = 64


class TokenCounter:
    """Counts tokens for a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level, model = spec["pre_tokenizer"], spec["model"]
        plain = level["type"] == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"] and not spec["normalizer"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"special strings that take in their surroundings: {path}")
        numbers = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[numbers[a], numbers[b]] = (rank, numbers[a + b])
        self.symbols = [numbers[chr(c)] for c in byte_letters()]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple(special)
        self.split = regex.compile(SPLIT)
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        if n < 2:
            return n
        merges = self.merges
        symbol: list[int] = [self.symbols[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapify(heap)
        count = n
        while heap:
            _, i, new, left, right = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # a merge since then took one of the two
            symbol[i], symbol[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found:
                    heappush(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found:
                    heappush(heap, (found[0], h, found[1], symbol[h], new))
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text in which no special string is looked for."""
        total, words = 0, self.words
        for word in self.split.findall(text):
            n = words.get(word)
            if n is None:
                n = self.merged(word.encode("utf-8"))
                if len(word) <= MEMO_CHARS:
                    if len(words) >= MEMO:
                        words.clear()
                    words[word] = n
            total += n
        return total

    def run(self, text: str) -> int:
        """As ``plain``, by segments: the split always falls before a blank that a letter, a digit or a visible ASCII
        sign follows."""
        parts = text.split(" ")
        segments = self.segments
        try:
            return self.plain(parts[0]) + sum(map(segments.__getitem__, parts[1:]))
        except KeyError:
            pass
        total, held = self.plain(parts[0]), []
        for part in parts[1:]:
            n = segments.get(part)
            if n is None:
                if not part or not (part[0].isalnum() or "!" <= part[0] <= "~"):
                    return self.plain(text)  # runs of white space and the like
                n = self.plain(" " + part)
                if len(part) <= MEMO_CHARS:
                    held.append((part, n))
            total += n
        if len(segments) + len(held) > MEMO:
            segments.clear()
        segments.update(held)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not any(mark in text for mark in self.marks):
            return self.run(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.run, filter(None, pieces)))


def byte_letters() -> list[int]:
    """The code point by which byte-level vocabularies write each byte: visible Latin-1 letters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [b if b in visible else next(spare) for b in range(256)]


_counters: dict[str, TokenCounter] = {}
common.keeps("counts", _counters.clear)


def counter(path: str) -> TokenCounter:
    """The worker process's own, while tasks that count follow one another."""
    common.begin("counts")
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(count, batch.column(1).to_pylist())), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long"), common.text_of(text_column), F.octet_length(common.text_of(text_column)).cast("long"))
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
