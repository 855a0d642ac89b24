"""Terms of texts, counted for a batch of rows at once inside Spark's tasks.

A row comes as the list of its words. Arrow numbers the different words of a batch, so a word is cut into pieces, or
joined with its neighbour, once per batch and not once per occurrence; what is left are sums over numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION = 1 << 20        # bytes of words that are counted together; a longer row stands alone
LOW, HIGH = 3, 5         # characters of a piece


def portions(words: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """Runs of rows with about ``PORTION`` bytes of words, each with the number of its first row."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(words.flatten()).fill_null(0).to_numpy(zero_copy_only=False))])[np.cumsum(lengths)]
    cuts = [0, *(np.flatnonzero(np.diff(ends // PORTION)) + 1).tolist(), len(words)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield start, words.slice(start, end - start)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key, and the different keys in the order of their numbers."""
    coded = pa.array(keys, pa.int64()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)


def pieces(words: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces of words that are padded with one blank; the places of each word's pieces, one word after the
    other; and how many each word has. A short word is a piece as a whole.

    A piece is a shorter one and a character more, so pieces of a size are numbered by pairs of numbers."""
    if not len(words):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer(f" {'  '.join(words.to_pylist())} ".encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))     # characters of the word from here on
    seen = np.zeros(int(text.max()) + 1, bool)
    seen[text] = True
    letters, codes = np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen) - 1)[text]
    known, ids, spelled = 0, codes, letters[:, None]
    places, names = np.full((len(text), HIGH - LOW + 1), -1), []
    for n in range(2, HIGH + 1):
        at = np.flatnonzero(left >= n)
        of, pairs = numbered(ids[at] * len(letters) + codes[at + n - 1])
        ids = np.zeros(len(text), np.int64)
        ids[at] = of
        spelled = np.column_stack([spelled[pairs // len(letters)], letters[pairs % len(letters)]])
        if n >= LOW:
            places[at, n - LOW] = of + known
            known += len(spelled)
            whole = spelled.astype("<u4").tobytes().decode("utf-32-le")
            names += [whole[i:i + n] for i in range(0, len(whole), n)]
    found = places >= 0
    counts = np.add.reduceat(found.sum(axis=1), np.cumsum(sizes) - sizes)
    return pa.array(names, pa.string()), places[found], counts


def _summed(rows: np.ndarray, ids: np.ndarray, n: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of row and id once, in their order, with the sum of its numbers."""
    keys = rows * width + ids
    if n is None:
        keys.sort()
        heads = _heads(keys)
        sums = np.diff(heads, append=len(keys))
    elif len(n) and (int(keys.max()) + 1).bit_length() + (bits := int(n.max()).bit_length()) < 63:   # sorted with their numbers
        keys = (keys << bits) | n
        keys.sort()
        n = keys & ((1 << bits) - 1)
        keys >>= bits
        heads = _heads(keys)
        sums = np.add.reduceat(n, heads)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = _heads(keys)
        sums = np.add.reduceat(n[order], heads) if len(heads) else n
    keys = keys[heads]
    return keys // max(width, 1), keys % max(width, 1), sums.astype(np.int64)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def counted(words: pa.ListArray, kind: str | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of some rows, and for each pair of a row and a term that occurs in it: the row, the term's place
    and how often it occurs. Terms are words and pairs of neighbours ("word"), pieces of words ("character"), or the
    members of the lists as they are."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(words)), lengths)
    coded = words.flatten().dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if kind == "word":
        first, known = np.flatnonzero(rows[1:] == rows[:-1]), len(names)
        of_pair, pairs = numbered(ids[first] * known + ids[first + 1])
        left, right = (names.take(pa.array(side)) for side in (pairs // max(known, 1), pairs % max(known, 1)))
        names = pa.concat_arrays([names, pc.binary_join_element_wise(left, right, " ")])
        rows, ids = np.concatenate([rows, rows[first]]), np.concatenate([ids, of_pair + known])
    rows, ids, n = _summed(rows, ids, None, len(names))
    if kind == "character":
        names, places, sizes = pieces(names)
        each, starts = sizes[ids], np.cumsum(sizes) - sizes
        at = np.repeat(starts[ids] - np.cumsum(each) + each, each) + np.arange(each.sum())
        rows, ids, n = _summed(np.repeat(rows, each), places[at], np.repeat(n, each), len(names))
    return names, rows, ids, n
