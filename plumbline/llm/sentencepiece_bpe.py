"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (identity, a leading dummy space, spaces as U+2581), cut
where no piece of the vocabulary can reach across (before the first U+2581 after other characters,
and around characters that are in no longer piece), and each distinct word is encoded once.

Merge rounds: the words' symbols lie in one flat numpy array. Each round takes, per word, the
smallest rank of any adjacent pair, merges all its non-overlapping occurrences from the left at
once, compacts the arrays, and drops the words in which no pair is left. The library merges one
pair at a time and looks again; that gives the same unless a merge makes a new pair that goes
before the pairs still waiting. Such words are recognised in the round and merge their leftmost
pair only.

Defined cases: null text is the empty text; the empty text has no pieces but the end id; whole
texts are encoded, however long; repeated rows are encoded each; null ids and other columns pass
through or are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = "▁"
#: Distinct words and ids kept in a task; beyond either the words of a batch are encoded anew.
CACHED_WORDS = 300_000
CACHED_IDS = 4_000_000
NONE = np.int32(2**31 - 1)


class Known:
    """The ids of words encoded so far; None stands for the end of a text."""

    def __init__(self, end_id: int):
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str | None, int] = {None: 0}
        self.ids, self.starts, self.lens = np.array([self.end_id], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lens) - lens))
        self.ids, self.lens = np.concatenate((self.ids, ids)), np.concatenate((self.lens, lens))


class PieceModel:
    """Vocabulary, pair ranks and piece bytes of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.end_id, unk = sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.unk = unk
        self.byte_ids = np.full(256, unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        # symbols: pieces, then the characters that are part of pieces but no piece themselves
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)
        self.base = max(symbols.values()) + 1
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] * self.base + symbols[p[k:]]] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_piece = np.append(keys, np.int64(2**62)), np.array([pairs[k] for k in keys.tolist()] + [0], np.int32)
        self.pair_rank = np.append(rank[self.pair_piece[:-1]], NONE)
        inner = {c for p in ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that go on after a space inside are not supported")
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)  # in no longer piece
        self.word = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.piece_bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if i == unk else bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spaced = np.array([not special[i] and pieces[i].startswith(SPACE) for i in range(n)])
        self.silent = np.array([bool(sp.is_control(i)) for i in range(n)])
        for probe in ("", " a  b", "x\n\ty", "a" * 40 + " ▁é\U0001f600"):
            if self.encode([probe])[0].tolist()[:-1] != sp.encode(probe):
                raise ValueError(f"the normaliser of {path} is not supported")

    # -------------------------------------------------------------- encoding
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; ``NONE`` where they don't merge."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) * self.base + right)
        at = np.searchsorted(self.pair_key, key)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_piece[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words that are normalised and cut already."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sym, char = self.char_symbol[chars], chars
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], piece[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            if (best == NONE).any():  # these words are done
                over = np.repeat(best == NONE, count)
                done.append((word[over], sym[over], char[over]))
                sym, char, word, rank, piece = (x[~over] for x in (sym, char, word, rank, piece))
                best, count = best[best != NONE], count[best != NONE]
                if not len(sym):
                    break
            best = np.repeat(best, count)
            at = np.flatnonzero(rank == best)
            new = np.flatnonzero(np.append(True, np.diff(at) != 1))
            turn = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            at = at[turn % 2 == 0]
            late = self._overtaken(sym, word, rank, piece, best, at)
            if len(late):
                own = word[at]
                at = at[~np.isin(own, late) | np.append(True, own[1:] != own[:-1])]
            sym, char, word, rank, piece = self._merged(sym, char, word, rank, piece, at)
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym, char = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return self._ids(word[order], sym[order], char[order], len(words))

    def _merged(self, sym, char, word, rank, piece, at):
        """The arrays after the pairs at ``at`` have merged; ranks are looked up where they changed."""
        sym = sym.copy()
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, char, word, rank, piece = (x[keep] for x in (sym, char, word, rank, piece))
        mine = place[at]
        for p in (mine, mine[mine > 0] - 1):
            p = p[p < len(sym) - 1]
            same = word[p] == word[p + 1]
            q = p[same]
            rank[q], piece[q] = self._ranks(sym[q], sym[q + 1])
            rank[p[~same]] = NONE
        rank[-1] = NONE
        return sym, char, word, rank, piece

    def _overtaken(self, sym, word, rank, piece, best, at):
        """Words with several merges in this round of which one makes a pair that doesn't wait."""
        own = word[at]
        several = np.flatnonzero(np.append(own[1:] == own[:-1], False) | np.append(False, own[1:] == own[:-1]))
        if not len(several):
            return np.empty(0, np.int64)
        a = at[several]
        s2, _, w2, r2, _ = self._merged(sym, sym, word, rank, piece, at)
        place = np.cumsum(np.isin(np.arange(len(sym)), at + 1, invert=True)) - 1
        mine, limit = place[a], best[a]
        # one at a time from the left: the right neighbour has not merged yet, the left one has
        right = np.minimum(a + 2, len(sym) - 1)
        bad = (right == a + 2) & (word[right] == word[a]) & (self._ranks(piece[a], sym[right])[0] <= limit)
        left = np.maximum(mine - 1, 0)
        bad |= (w2[left] == w2[mine]) & (left < mine) & (r2[left] <= limit)
        return np.unique(word[a][bad])

    def _ids(self, word, sym, char, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word); a character that is no piece gives the ids of its bytes."""
        other = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(other):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in char[other].tolist()]
            width = np.ones(len(sym), np.int64)
            width[other] = [len(r) for r in raw]
            at = np.repeat(np.isin(np.arange(len(sym)), other), width)
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            sym[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def encode(self, texts: list[str], known: Known | None = None) -> list[np.ndarray]:
        """Ids of each text, then the end id."""
        known = known or Known(self.end_id)
        words = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*words) - known.slot.keys())
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            known.add(part, *self.encode_words(part))
        for ws in words:
            ws.append(None)  # stands for the end id
        total = sum(map(len, words))
        slots = np.fromiter(map(known.slot.__getitem__, chain.from_iterable(words)), np.int64, total)
        lens = known.lens[slots]
        ends = np.cumsum(lens)
        flat = known.ids[np.repeat(known.starts[slots] - ends + lens, lens) + np.arange(ends[-1] if total else 0)]
        cuts = ends[np.cumsum([len(ws) for ws in words]) - 1].tolist() if words else []
        if len(known.slot) > CACHED_WORDS or len(known.ids) > CACHED_IDS:
            known.reset()
        return [flat[s:e] for s, e in zip([0, *cuts], cuts)]

    # -------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; control ids are silent and the dummy space at the front goes."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        if self.spaced[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # one U+FFFD for each byte that is not part of a character
            raw = raw.decode("utf-8", "surrogateescape")
            return re.sub("[\udc80-\udcff]", "�", raw)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col`` array<int>: the ids of the whole text, then the end id."""
    common.bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        known = Known(model.end_id)
        for b in common.slices(batches):
            ids = model.encode([t or "" for t in b.column(cols.index(text_col)).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(ids)], names=[*cols, out_col])

    schema = docs.select(*cols).schema.add(out_col, T.ArrayType(T.IntegerType()))
    return docs.select(*cols).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", check_col: str = "lossless") -> DataFrame:
    """``docs`` with ``out_col`` as ``encode`` gives it, and whether decoding it gives the text again.

    Both in one pass, so that a task has one Python worker with one model.
    """
    common.bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in (out_col, check_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        known = Known(model.end_id)
        for b in common.slices(batches):
            texts = [t or "" for t in b.column(cols.index(text_col)).to_pylist()]
            ids = model.encode(texts, known)
            same = [model.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, lists(ids), pa.array(same, pa.bool_())], names=[*cols, out_col, check_col])

    schema = docs.select(*cols).schema.add(out_col, T.ArrayType(T.IntegerType())).add(check_col, T.BooleanType())
    return docs.select(*cols).mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col`` string: the text of ``ids_col`` (null: empty)."""
    common.bound_batches(rows.sparkSession)
    cols = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in common.slices(batches):
            ids = b.column(cols.index(ids_col))
            flat, off = np.asarray(ids.values if hasattr(ids, "values") else ids.flatten()), np.asarray(ids.offsets)
            texts = ["" if null else model.decode(flat[s:e]) for s, e, null in zip(off[:-1].tolist(), off[1:].tolist(), np.asarray(ids.is_null(), bool).tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*cols, out_col])

    return rows.select(*cols).mapInArrow(run, rows.select(*cols).schema.add(out_col, "string"))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoding and decoding each text."""
    rows = encode(docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text")), model_path).select("doc_id", "ids")
    return decode(rows, model_path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
