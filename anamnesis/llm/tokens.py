"""Token counts by byte-pair merging on arrays.

A text's pre-tokens are found, and the distinct ones of a batch are merged together: their
symbols lie in one ragged array, and each step applies, in every pre-token at once, the pair of
lowest rank that this pre-token holds. What is left at the end is counted.

White space never lies in a pre-token of this vocabulary and no rule looks past it, so texts
are first cut at ASCII white space by array operations, and only the distinct words of a batch
reach the vocabulary's own normaliser and splitter. Special strings are found first, as the
library does it, and count as one token each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import WHITE, byte_class, ragged_index, range_hashes, runs, text_slices

_SLICE = 8 << 20
_CACHE_WORDS = 1 << 20
_TABLE_BITS = 18
_LETTER = byte_class((65, 90), (97, 122))
_DIGIT = byte_class((48, 57))
_PLAIN = byte_class((0x21, 0x26), (0x28, 0x7E))  # ASCII without the apostrophe and control bytes


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for value in range(256):
        letters[value] = chr(value if value in shown else spare)
        spare += value not in shown
    return letters


class MergeTable:
    """Ranks of symbol pairs, and the symbols of single bytes inside and at the end of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.of_letter = {letter: value for value, letter in enumerate(letters)}
        self.inner = np.array([ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([ids[x + suffix] for x in letters], dtype=np.int64)
        pairs = [(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        self.width = max(ids.values()) + 1
        key = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self._index(key)

    def _index(self, key: np.ndarray) -> None:
        """Ranks by key in a few open tables: what finds its place taken in one goes to the next."""
        self.tables, waiting = [], np.arange(len(key))
        while len(waiting):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.tables) & (1 << 64) - 1 | 1)
            slot = ((key[waiting].astype(np.uint64) * factor) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            keys, ranks = np.full(1 << _TABLE_BITS, -1, np.int64), np.full(1 << _TABLE_BITS, self.none, np.int32)
            slot, first = np.unique(slot, return_index=True)
            keys[slot], ranks[slot] = key[waiting[first]], waiting[first]
            self.tables.append((factor, keys, ranks))
            waiting = np.delete(waiting, first)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        out = np.full(len(wanted), self.none, dtype=np.int64)
        for factor, keys, ranks in self.tables:
            slot = ((wanted.astype(np.uint64) * factor) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            hit = keys[slot] == wanted
            out[hit] = ranks[slot[hit]]
        return out

    def count(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; `data` holds their bytes one after another, none is empty."""
        return self.merge(data, length)[1]

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all pre-tokens in order, number of symbols of each)."""
        counts = np.zeros(len(length), dtype=np.int64)
        owner = np.arange(len(length))
        symbols = self.inner[data]
        ends = np.cumsum(length) - 1
        symbols[ends] = self.last[data[ends]]
        rank = np.full(len(symbols), self.none, dtype=np.int64)
        inner = np.ones(len(symbols), dtype=bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        finished, owners = [], []
        while len(owner):
            starts = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, starts)
            going = least < self.none
            over = np.repeat(~going, length)
            counts[owner[~going]] = length[~going]
            finished.append(symbols[over])
            owners.append(np.repeat(owner[~going], length[~going]))
            chosen = (rank == np.repeat(least, length)) & (rank < self.none)
            # Equal neighbours overlap (a a a): every other one from the left is merged.
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run_start = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            gone = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(length))
            place = (np.cumsum(keep) - 1)[at]
            symbols, rank = symbols[keep], rank[keep]
            length, owner = (length - gone)[going], owner[going]
            # Only pairs that touch a merged symbol are new.
            ends = np.cumsum(length) - 1
            first, last = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
            last[ends] = True
            first[ends - length + 1] = True
            rank[place[last[place]]] = self.none
            changed = np.concatenate([place[~last[place]], place[~first[place]] - 1])
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        order = np.argsort(np.concatenate(owners) if owners else np.zeros(0, np.int64), kind="stable")
        return (np.concatenate(finished) if finished else np.zeros(0, np.int64))[order], counts


class TokenCounter:
    """Tokens of whole texts under one vocabulary file, with a bounded memory of words already counted."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = MergeTable(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self.known = np.zeros(0, np.uint64)
        self.known_counts = np.zeros(0, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        start, end, row = runs(~WHITE[data], offsets)
        hashes = range_hashes(data, start, end)
        words, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.known, words), max(len(self.known) - 1, 0))
        counts = np.zeros(len(words), dtype=np.int64)
        old = self.known[slot] == words if len(self.known) else np.zeros(len(words), bool)
        counts[old] = self.known_counts[slot[old]]
        new = np.flatnonzero(~old)
        if len(new):
            counts[new] = self._words(data, start[first[new]], end[first[new]])
            if len(self.known) + len(new) > _CACHE_WORDS:
                self.known, self.known_counts = words, counts
            else:
                merged = np.concatenate([self.known, words[new]])
                order = np.argsort(merged, kind="stable")
                self.known = merged[order]
                self.known_counts = np.concatenate([self.known_counts, counts[new]])[order]
        return np.bincount(row, weights=counts[inverse.ravel()], minlength=len(offsets) - 1).astype(np.int64)

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        letters = data[ragged_index(start, length)]
        word = np.repeat(np.arange(len(start)), length)
        plain = np.ones(len(start), dtype=bool)
        plain[word[~_PLAIN[letters]]] = False
        for token in self.special:  # only words that hold the whole string can differ
            mark = np.frombuffer(token.encode(), np.uint8)
            plain[word[letters == mark[0]]] = False
        keep = plain[word]
        letters, word = letters[keep], word[keep]
        pieces, piece_length, owner = self._plain_pieces(letters, word)
        more, more_length, more_owner, extra = [], [], [], np.zeros(len(start), np.int64)
        for i in np.flatnonzero(~plain).tolist():
            text = data[start[i]:end[i]].tobytes().decode()
            for part, special in self._parts(text):
                if special:
                    extra[i] += 1
                    continue
                for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    values = bytes(map(self.merges.of_letter.__getitem__, piece))
                    if values:
                        more.append(values)
                        more_length.append(len(values))
                        more_owner.append(i)
        pieces = np.concatenate([pieces, np.frombuffer(b"".join(more), np.uint8)])
        piece_length = np.concatenate([piece_length, np.array(more_length, np.int64)])
        owner = np.concatenate([owner, np.array(more_owner, np.int64)])
        counts = self.merges.count(pieces, piece_length)
        return np.bincount(owner, weights=counts, minlength=len(start)).astype(np.int64) + extra

    @staticmethod
    def _plain_pieces(letters: np.ndarray, word: np.ndarray):
        """Pre-tokens of plain ASCII words: runs of letters, single digits, runs of other marks."""
        kind = np.where(_LETTER[letters], 1, np.where(_DIGIT[letters], 2, 3))
        head = np.ones(len(letters), dtype=bool)
        head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (word[1:] != word[:-1])
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(letters)))
        lower = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
        return lower, length, word[at]

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings, leftmost first."""
        at = 0
        while True:
            places = [(p, token) for token in self.special if (p := text.find(token, at)) >= 0]
            if not places:
                break
            place, token = min(places)
            if place > at:
                yield text[at:place], False
            yield token, True
            at = place + len(token)
        if at < len(text):
            yield text[at:], False


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def _run(path: str, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1), _SLICE):
                tokens = own.count(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(offsets)), pa.array(tokens),
                     pa.array(tokens > limit)], schema=schema)

    return run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row per row of `docs`.

    `vocabulary` is the path of a byte-level BPE file whose pre-tokens hold no white space; it
    must be readable on the executors. A null text is empty and has no token; a null id stays
    null; repeated rows are repeated; other columns are ignored.
    """
    run, schema = _run(vocabulary, limit)
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, schema)
