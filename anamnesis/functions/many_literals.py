"""Many literals counted in one walk over each text, in Arrow batches.

The literals of a task form one Aho-Corasick automaton, so a text costs its length and its
matches, not its length times the number of literals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa

_LOWER = {i: i + 32 for i in range(65, 91)}


def fold(text: str) -> str:
    """A-Z only, as `ascii_lower`."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _automaton(needles: dict[str, int]) -> ahocorasick.Automaton | None:
    if not needles:
        return None
    made = ahocorasick.Automaton()
    for needle, number in needles.items():
        made.add_word(needle, (number, len(needle)))
    made.make_automaton()
    return made


def _counts(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Matches of each literal from left to right, none overlapping another of its own."""
    counts: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (number, length) in automaton.iter(text):
        if end - length + 1 >= free.get(number, 0):
            counts[number] = counts.get(number, 0) + 1
            free[number] = end + 1
    return counts


def hits_of(patterns: Sequence[tuple[str, str, bool]], restricted: bool):
    """A task function: (memory_id, updated_at, text[, pattern_ids]) to the pairs that match, with counts.

    `patterns` holds (pattern_id, literal, ignore case). With `restricted` a text is tried for its own patterns only.
    """
    by_id = {pattern_id: (fold(literal) if folded else literal, folded) for pattern_id, literal, folded in patterns}

    def found_in(text: str, wanted: list[str] | None, walks) -> Iterator[tuple[str, int]]:
        if wanted is not None:
            low = fold(text)
            for pattern_id in wanted:
                if pattern_id in by_id:
                    needle, folded = by_id[pattern_id]
                    yield pattern_id, (low if folded else text).count(needle)
            return
        for folded, (automaton, holders) in walks.items():
            if automaton is not None:
                for number, count in _counts(automaton, fold(text) if folded else text).items():
                    for pattern_id in holders[number]:
                        yield pattern_id, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {}
        for folded in () if restricted else (True, False):
            needles: dict[str, int] = {}
            holders: list[list[str]] = []
            for pattern_id, (needle, own) in by_id.items():
                if own == folded:
                    if needle not in needles:
                        needles[needle] = len(holders)
                        holders.append([])
                    holders[needles[needle]].append(pattern_id)
            walks[folded] = _automaton(needles), holders
        for batch in batches:
            given = batch.column(3).to_pylist() if restricted else [None] * batch.num_rows
            rows, ids, counts = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text is None:
                    continue
                for pattern_id, count in found_in(text, (given[i] or []) if restricted else None, walks):
                    if count:
                        rows.append(i)
                        ids.append(pattern_id)
                        counts.append(count)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(counts, pa.int64())],
                ["pattern_id", "memory_id", "updated_at", "matches"])

    return run
