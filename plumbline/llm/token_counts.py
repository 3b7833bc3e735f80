"""Token counts of a byte-level BPE with overlap resynchronisation for huge documents.

Whole texts of up to ``chunk_chars`` characters are cut at *stable* places only, and each distinct
segment is counted once by the tokenizers library. Longer ones are encoded in overlapping chunks
with offsets. Neighbouring chunks are spliced where both have a token boundary at a stable place
of the overlap; if there is none, the overlap is doubled, up to the rest of the text.

A place is stable where the pre-tokenizer must cut whatever stands to its left and right, as its
pattern has no look-behind and no token takes in both characters: between two characters of
different classes of letter, number, white space and other, where the left one is not white space
and no apostrophe. White space itself is left out on the left because it may be drawn to the next
token; an apostrophe because a contraction may follow it.

Defined cases: null text is the empty text with 0 tokens; repeated rows and null ids keep their
rows; special strings inside a text are handled as the library does by default; empty tables give
empty results; other columns are ignored. A file of another kind of tokenizer is an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1024
CACHED_SEGMENTS = 300_000
CACHED_CHARS = 48
#: White space other than space, tab, line feed and carriage return, in any definition.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Runs of plain white space and the characters after them: cut where white space follows others.
SEGMENT = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


@lru_cache(maxsize=2)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    spec = json.loads(t.to_str())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    # the places where texts are cut are proven for this kind of file only: another would be miscounted
    if model["type"] != "BPE" or model["dropout"] or spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
        raise ValueError(f"{path}: no byte-level BPE with its usual pattern")
    t.no_truncation()
    t.no_padding()
    return t


def _class(c: str) -> str:
    if c.isspace() or RARE_SPACE.match(c):
        return "space"
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "other"


def stable(text: str, at: int, specials: tuple[str, ...] = ()) -> bool:
    """Whether the text can be cut before position ``at`` without changing any token."""
    left, right = text[at - 1], text[at]
    if left == "'" or _class(left) == "space" or _class(left) == _class(right):
        return False
    # a special string must not lie across the cut
    return not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in specials)


def resynchronised(text: str, encode, specials: tuple[str, ...] = (), chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """``(tokens, widenings)`` of a text: overlapping chunks, spliced at stable common boundaries.

    ``encode(text)`` gives the character offsets (start, end) of the tokens of a text.
    """
    total = widened = 0
    start = 0  # where the current chunk starts; always the text's start or a splice
    part = encode(text[: chunk])
    end = min(len(text), chunk)
    while end < len(text):
        size = overlap
        while True:
            back = max(start, end - size)
            stop = min(len(text), back + chunk + size)
            after = encode(text[back:stop])
            mine = {start + s for s, _ in part}
            common_cuts = [p for p in (back + s for s, _ in after) if p in mine and back < p < end and p > start and stable(text, p, specials)]
            # The last places of the first chunk and the first ones of the second are still open
            # to what the other chunk doesn't see; a stable place isn't. The middle one is taken.
            if common_cuts:
                cut = common_cuts[len(common_cuts) // 2]
                break
            widened += 1
            if back == start:  # all of this chunk overlaps: take a longer one in its place
                end = min(len(text), end + max(chunk, end - start))
                part = encode(text[start:end])
                if end == len(text):
                    break
                size = overlap
                continue
            size *= 2
        if end == len(text) and not common_cuts:
            break
        total += sum(1 for s, _ in part if start + s < cut)
        part = [(back + s - cut, back + e - cut) for s, e in after if back + s >= cut]
        start, end = cut, stop
    return total + len(part), widened


class Counter:
    """Counts tokens of texts; keeps the counts of short segments."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tok, self.chunk, self.overlap = load(path), chunk, overlap
        self.specials = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.kept: dict[str, int] = {}

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tok.encode(text, add_special_tokens=False).offsets

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.kept) > CACHED_SEGMENTS:
            self.kept.clear()
        out: list[int | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = resynchronised(t, self.offsets, self.specials, self.chunk, self.overlap)[0]
            elif RARE_SPACE.search(t) or any(re.search(r"\s", s) for s in self.specials):
                out[i] = self.whole([t])[0]
            else:
                cut.append((i, SEGMENT.findall(t)))
        fresh = list({s for _, segs in cut for s in segs if s not in self.kept})
        self.kept.update(zip(fresh, self.whole(fresh)))
        for i, segs in cut:
            out[i] = sum(map(self.kept.__getitem__, segs))
        for s in fresh:
            if len(s) > CACHED_CHARS:
                del self.kept[s]
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: a row for each row of ``docs``."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, chunk, overlap)
        for b in common.slices(batches):
            n = np.array(counter.count(b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = common.text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", "n_bytes").schema.add("n_tokens", "long").add("over_limit", "boolean"))
