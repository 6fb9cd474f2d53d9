"""Whole-text encoding by the tokenizers library, with one call for each different piece of text.

The public vocabularies used here split a text between a run of Latin letters (with the blank before it) and the ASCII
signs, digits and white space around it, so such pieces can be encoded on their own and their ids joined. A text that
holds anything else between its letters (apostrophes, runs of white space, other scripts, special strings) goes to the
library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from noteweave.llm import common

#: Pieces held by one worker, in two tables: when the one in use is half of them, it takes the other's place, and pieces met
#: again come back from there. Longer pieces are not held.
MEMO_PIECES, MEMO_CHARS = 600_000, 64
#: Characters that are cut into pieces at once, or one text that has more.
GROUP_CHARS = 4 << 20
#: Runs of letters handed to the library as one text.
JOINED = 200
#: Runs of Latin letters; both vocabularies split between such a run and ASCII signs, digits or white space.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
RUN = re.compile(f" ?[{LETTERS}]+")
#: By byte: an ASCII letter. Of À to ÿ the second bytes that are none.
_LETTER = np.array([chr(k).isascii() and chr(k).isalpha() for k in range(256)])
_SIGNS = np.array([0x97, 0xB7], np.uint8)
LIKE_RUNS = re.compile(f"[ {LETTERS}]+")
#: What else may stand alone: signs and digits whose own split does not depend on the letters around them.
ALONE = re.compile(rf"\s|\s?[!-&(-@\[-`{{-~]+(?:\s[!-&(-@\[-`{{-~]+)*\s?", re.ASCII)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = {2: "H", 4: "I"}[width]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a run of letters is one pre-token: the same model behind a plain byte map
        self.letters = Tokenizer.from_file(path)
        self.letters.no_truncation()
        self.letters.no_padding()
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.blank = self.tokenizer.normalizer is None
        if not self.blank:
            self.letters.normalizer = normalizers.Lowercase()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = tuple(content[:2] for content in added)
        # ids that end a run, where the vocabulary marks ends, or begin one that has a blank before it
        vocabulary = self.tokenizer.get_vocab()
        ends = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = bool(ends)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(ends) if ends else t.startswith("Ġ"))]] = True
        self.joins = not any(LIKE_RUNS.fullmatch(content) for content in added)

    def whole(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[bytes]:
        """Straight from the library."""
        return [array(self.kind, e.ids).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, many in one text for the library; each by itself where it cannot be told where runs end."""
        if not self.joins:
            return self.each(runs)
        if not self.ends:  # only a blank tells where a run begins
            bare = [p for p in runs if p[0] != " "]
            if bare:
                found = dict(zip(bare, self.each(bare), strict=True))
                led = [p for p in runs if p[0] == " "]
                found.update(zip(led, self.runs(led), strict=True))
                return [found[p] for p in runs]
        joined = ["".join([p if p[0] == " " else f" {p}" for p in runs[k : k + JOINED]]) for k in range(0, len(runs), JOINED)]
        raw = b"".join(self.whole(joined))
        size = array(self.kind).itemsize
        at = np.flatnonzero(self.edge[np.frombuffer(raw, f"<u{size}")])
        if len(at) != len(runs):
            return self.each(runs)
        cuts = ((np.r_[0, at + 1] if self.ends else np.r_[at, len(raw) // size]) * size).tolist()
        return [raw[a:b] for a, b in pairwise(cuts)]

    def each(self, runs: list[str]) -> list[bytes]:
        return self.whole(runs if self.blank else [p.lstrip() for p in runs], self.letters)

    def learn(self, new: set[str]) -> None:
        """Put pieces into the table, from the one before it or by the library."""
        met = {p: self.old[p] for p in new if p in self.old}
        if len(self.memo) + len(new) > MEMO_PIECES // 2:
            self.old, self.memo = self.memo, {}
        self.memo.update(met)
        new = [p for p in new if len(p) <= MEMO_CHARS and p not in met]
        runs = [p for p in new if RUN.fullmatch(p)]
        self.memo.update(zip(runs, self.runs(runs), strict=True))
        others = [p for p in new if not p or ALONE.fullmatch(p)]  # no letters, so not a run
        self.memo.update(zip(others, self.whole(others), strict=True))

    def found(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces; None for one that does not stand alone."""
        if not self.blank:  # case and the white space around a piece make no difference to its ids
            bare = [p.strip(" \t\n\r") for p in pieces]
            pieces = [p.lower() if RUN.match(p) else p for p in bare]  # other scripts may have letters that become Latin
        got = list(map(self.memo.get, pieces))
        lacks = [k for k, ids in enumerate(got) if ids is None]
        self.learn({pieces[k] for k in lacks})
        for k in lacks:
            got[k] = self.memo.get(pieces[k])
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        gc.disable()  # nothing below makes cycles, and collections would walk the whole table
        try:
            ends = np.cumsum([0, *map(len, texts)]) // GROUP_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(ends[:-1])) + 1).tolist(), len(texts)] if texts else []
            return [ids for a, b in pairwise(cuts) for ids in self.group(texts[a:b])]
        finally:
            gc.enable()

    def group(self, texts: list[str]) -> list[bytes]:
        special = [any(mark in text for mark in self.marks) for text in texts]
        pieces, bounds = pieces_of(["" if s else text for text, s in zip(texts, special, strict=True)])
        each = pieces.dictionary_encode()
        ids = pa.array(self.found(each.dictionary.to_pylist()), pa.large_binary()).take(each.indices)
        alone = np.r_[0, np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))][bounds]
        ends = np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
        data = memoryview(ids.buffers()[2] or b"")
        out = [data[a:b].tobytes() for a, b in pairwise(ends)]
        for k in np.flatnonzero(special | (np.diff(alone) > 0)).tolist():  # a special string, or a piece that does not stand alone
            out[k] = self.whole([texts[k]])[0]
        return out


def pieces_of(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The runs of Latin letters in all texts, each with the blank before it, and what stands between them; and where each
    text's pieces begin and end."""
    coded = [text.encode() for text in texts]
    data = b"".join(coded)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum([0, *map(len, coded)])
    run = _LETTER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[~np.isin(raw[lead + 1], _SIGNS)]
    run[lead] = run[lead + 1] = True
    blank = raw == 0x20
    leads = blank[:-1] & run[1:]
    inner = ends[1:-1]
    leads[inner[(inner > 0) & (inner < len(raw))] - 1] = False  # the letter is another text's
    run[:-1] |= leads
    begin = np.ones(len(raw), bool)
    begin[1:] = (run[1:] != run[:-1]) | (run[1:] & blank[1:])
    begin[ends[ends < len(raw)]] = True
    at = np.r_[np.flatnonzero(begin), len(raw)].astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return pieces, np.searchsorted(at, ends)


_encoders: dict[tuple, PieceEncoder] = {}
common.keeps("encoding", _encoders.clear)


def encoder(path: str, width: int) -> PieceEncoder:
    """The worker process's own; it keeps one at a time, while tasks that encode follow one another. The library works in the
    task's own thread: a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    common.begin("encoding")
    key = (path, width)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
