"""Posting lists of character runs, and the texts that hold words, for rows in order of their thread.

The runs of many texts are cut as numbers: each character is its place in the alphabet
of these texts, a run is up to three places, and the number of the thread stands behind
it. Sorting the numbers finds the equal ones and puts the rest in the order in which
they are stored, so no row exists for a single posting.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Characters that are cut together, at least; a thread's texts are never parted.
CHARACTERS = 4 << 20
#: Bits of the number of a thread within a list; longer lists are parted.
LIST_BITS = 12
#: Postings handed on at once.
POSTINGS = 1 << 20
SCHEMA = "user_id string, gram string, n bigint, threads array<string>"
_ARROW = pa.schema([
    ("user_id", pa.string()), ("gram", pa.string()), ("n", pa.int64()), ("threads", pa.list_(pa.string()))])


def lists(batches: Iterable[pa.RecordBatch], longest: int = 3) -> Iterator[pa.RecordBatch]:
    """(user_id, gram, n, threads) of (user_id, thread_id, text) rows, equal keys side by side."""
    keys, of, texts, size = [], [], [], 0
    for batch in batches:
        users, threads, bodies = (batch.column(k).cast(pa.binary()).to_pylist() for k in range(3))
        for key, raw in zip(zip(users, threads), bodies, strict=True):
            text = raw.decode("utf-8", "replace")
            if not keys or keys[-1] != key:
                if size >= CHARACTERS:
                    yield from _listed(keys, of, texts, longest)
                    keys, of, texts, size = [], [], [], 0
                keys.append(key)
            of.append(len(keys) - 1)
            texts.append(text)
            size += len(text)
    yield from _listed(keys, of, texts, longest)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers sorted, each once. The array given is sorted in place."""
    numbers.sort()
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _listed(keys: list[tuple], of: list[int], texts: list[str], longest: int) -> Iterator[pa.RecordBatch]:
    """The posting lists of some threads; ``of`` numbers the thread of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    held = np.zeros(0x110000, bool)
    held[points] = True
    alphabet = np.flatnonzero(held)
    width = int(len(alphabet)).bit_length()
    room = 63 - longest * width
    if len(keys) > 1 << max(room, 0):
        # Too many characters and threads for one number: halves, each with its own alphabet.
        half = of.index(len(keys) // 2)
        yield from _listed(keys[:of[half]], of[:half], texts[:half], longest)
        yield from _listed(keys[of[half]:], [k - of[half] for k in of[half:]], texts[half:], longest)
        return
    low = int(len(keys) - 1).bit_length()
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    places = place[points]
    ends = np.cumsum(sizes)
    codes = places.copy()
    for k in range(1, longest):
        codes <<= width
        codes[:-k] |= places[k:]
        # Beyond the end of a text there is no character.
        for back in range(1, k + 1):
            cut = ends[sizes >= back] - back
            codes[cut] &= ~((1 << width) - 1)
    del places, points
    codes <<= low
    codes |= np.repeat(np.array(of, np.int64), sizes)
    found = [_distinct(codes)]
    for k in range(1, longest):
        # Shorter runs are beginnings of longer ones.
        found.append(_distinct(found[-1] & ~(((1 << width) - 1) << (low + (k - 1) * width))))
    yield from _batches(_distinct(np.concatenate(found)), keys, alphabet, width, low, longest)


def _batches(
    postings: np.ndarray, keys: list[tuple], alphabet: np.ndarray, width: int, low: int, longest: int,
) -> Iterator[pa.RecordBatch]:
    """Sorted numbers of runs and threads as rows of one list each."""
    user = np.cumsum([0, *[int(a[0] != b[0]) for a, b in pairwise(keys)]])
    users = _strings([keys[k][0] for k in np.flatnonzero(np.diff(user, prepend=-1))])
    ids = _strings([k[1] for k in keys])
    thread = (postings & ((1 << low) - 1)).astype(np.int32)
    runs = postings >> low
    part = user[thread] * ((len(keys) >> LIST_BITS) + 1) + (thread >> LIST_BITS)
    starts = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (part[1:] != part[:-1])]))
    ends = np.append(starts[1:], len(postings))
    names, of_run = _names(runs[starts], alphabet, width, longest)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + POSTINGS)))
        first, last = starts[at], ends[to - 1]
        yield pa.RecordBatch.from_arrays([
            users.take(pa.array(user[thread[starts[at:to]]])), names.take(pa.array(of_run[at:to])),
            pa.array(ends[at:to] - starts[at:to]),
            pa.ListArray.from_arrays(
                pa.array(np.append(starts[at:to], last) - first, pa.int32()), ids.take(pa.array(thread[first:last]))),
        ], schema=_ARROW)
        at = to


def _strings(raw: list[bytes | None]) -> pa.Array:
    """Bytes as strings, as they are."""
    array = pa.array(raw, pa.binary())
    valid, offsets, data = array.buffers()
    return pa.StringArray.from_buffers(len(array), offsets, data, valid)


def _names(runs: np.ndarray, alphabet: np.ndarray, width: int, longest: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct runs of sorted numbers as strings, and which of them each number is."""
    new = np.concatenate([[True], runs[1:] != runs[:-1]])
    once = runs[new]
    places = np.stack([(once >> ((longest - 1 - k) * width)) & ((1 << width) - 1) for k in range(longest)], 1)
    points = np.append(0, alphabet)[places].astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    sizes = (places > 0).sum(1)
    names = [text[k:k + n] for k, n in zip(range(0, longest * len(once), longest), sizes.tolist(), strict=True)]
    return pa.array(names, pa.string()), np.cumsum(new) - 1


HELD = "user_id string, thread_id string, unit string"


def holding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of which each word is in some text of their thread.

    Rows (place, user_id, thread_id, text, unit) are a text or a candidate, whose unit is its
    words joined by blanks. Those of one thread have the same place and lie side by side.
    """
    held: list[tuple] = []
    last = None
    words: dict[bytes, list[bytes]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        places = batch.column(0).to_numpy()
        columns = [batch.column(k).cast(pa.binary()).to_pylist() for k in range(1, 5)]
        ends = [*(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
        found = []
        if held and places[0] != last:
            found, held = _held(held, words), []
        for start, end in pairwise([0, *ends]):
            rows = [c[start:end] for c in columns]
            if end == len(places):
                # The next batch may go on with this thread.
                held.append(rows)
            else:
                found += _held([*held, rows], words)
                held = []
        last = places[-1]
        yield _candidates(found)
    yield _candidates(_held(held, words))


#: Units whose words are remembered.
REMEMBERED = 100_000


def _held(parts: list[list[list]], words: dict[bytes, list[bytes]]) -> list[tuple]:
    """(user_id, thread_id, units) of the candidates among the rows of one place."""
    users, threads, texts, units = ([x for part in parts for x in part[k]] for k in range(4)) if len(parts) != 1 else parts[0]
    if len(set(threads)) > 1 or len(set(users)) > 1:
        # Threads that share a place by chance.
        by_key = defaultdict(list)
        for row in zip(users, threads, texts, units, strict=True):
            by_key[row[:2]].append(row)
        return [x for rows in by_key.values() for x in _held([[list(c) for c in zip(*rows, strict=True)]], words)]
    # No word has whitespace, so none reaches from one text into the next.
    text = b"\n".join([t for t in texts if t is not None])
    seen, kept = {}, []
    for unit in units:
        if unit is None:
            continue
        if unit not in words:
            if len(words) >= REMEMBERED:
                words.clear()
            words[unit] = unit.split(b" ")
        for word in words[unit]:
            if word not in seen:
                seen[word] = word in text
            if not seen[word]:
                break
        else:
            kept.append(unit)
    return [(users[0], threads[0], kept)] if kept else []


def _candidates(found: list[tuple]) -> pa.RecordBatch:
    users = [user for user, _, units in found for _ in units]
    threads = [thread for _, thread, units in found for _ in units]
    columns = [users, threads, [unit for _, _, units in found for unit in units]]
    return pa.RecordBatch.from_arrays([_strings(c) for c in columns], names=["user_id", "thread_id", "unit"])
