"""Suffix sorting by difference covers, in NumPy, for the text of one task."""

import numpy as np


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where one of each stands, and which one every value is.

    As ``np.unique``, by one vectorised sort that need not be stable: a quarter of its time.
    """
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    nth = np.empty(len(values), np.int64)
    nth[order] = np.cumsum(new) - 1
    return ordered[new], order[new], nth


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of tuples of symbols, and how many there are."""
    names = columns[0].astype(np.uint64)
    top = int(names.max()) + 1
    for column in columns[1:]:
        width = int(column.max()) + 1
        if top > (1 << 63) // width:  # too wide for one word: rank what there is first
            names = ranked(names)[2].astype(np.uint64)
            top = int(names.max()) + 1
        names = names * np.uint64(width) + column.astype(np.uint64)
        top *= width
    found, _, ranks = ranked(names)
    return ranks + 1, len(found)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (symbols from 0 on) in the order of their suffixes.

    The difference cover is {1, 2} modulo 3: suffixes at its positions are named by their
    triples, the string of names is sorted by the same algorithm until all names differ,
    and the remaining suffixes are ordered by their first symbol and the sampled suffix
    after it, and merged in.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(4, np.int64)))
    # With n = 1 (mod 3) the sample also has the empty suffix, so that every position
    # of class 0 has a sampled one behind it.
    first = np.arange(1, n + (n % 3 == 1), 3)
    second = np.arange(2, n, 3)
    sample = np.concatenate((first, second))
    names, count = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if count < len(sample):
        order = suffix_order(names)
    else:
        order = np.argsort(names)  # all differ
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((padded[rest] << 32) | rank[rest + 1])]  # all differ
    # How many sampled suffixes of each class go before each remaining one.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((padded[ones] << 32) | rank[ones + 1], (padded[rest] << 32) | rank[rest + 1])
    pair_of_two = (padded[twos] << 32) | padded[twos + 1]
    pair_of_rest = (padded[rest] << 32) | padded[rest + 1]
    low = np.searchsorted(pair_of_two, pair_of_rest, "left")
    same = np.zeros(len(rest), bool)
    inner = low < len(twos)
    same[inner] = pair_of_two[low[inner]] == pair_of_rest[inner]
    if len(twos):
        # Equal pairs are told apart by the sampled suffix after them.
        nth = np.cumsum(np.concatenate(([0], (np.diff(pair_of_two) != 0).astype(np.int64))))
        ranked = (nth << 32) | rank[twos + 2]
        asked = (nth[low[same]] << 32) | rank[rest[same] + 2]
        low[same] = np.searchsorted(ranked, asked)
    merged = np.empty(n, np.int64)
    places = np.arange(len(rest)) + before + low
    merged[places] = rest
    free = np.ones(n, bool)
    free[places] = False
    merged[free] = sampled
    return merged


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for phase in range(min(8, len(out))):
        whole = (len(data) - phase) // 8 * 8
        out[phase::8] = np.ascontiguousarray(data[phase : phase + whole]).view(np.uint64)[: len(out[phase::8])]
    return out


def first_owner(strings: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of ``length`` bytes in every string, the least owner of an equal window.

    The suffixes of all strings are sorted, and neighbours compared by their prefixes.
    Every string ends in a symbol of its own, so no comparison goes on into the next one.
    """
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0" * 8, np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    symbols = data[: ends[-1] + 1].astype(np.int64)
    symbols[ends] = 256 + np.arange(len(ends))
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    window = np.arange(len(symbols)) + length <= ends[owner]
    order = suffix_order(symbols)
    order = order[window[order]]
    every_8 = words(data)
    differs = np.zeros(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        piece = every_8[order + at]
        differs |= piece[1:] != piece[:-1]
    heads = np.flatnonzero(np.concatenate(([True], differs)))
    least = np.minimum.reduceat(owners[owner[order]], heads)
    found = np.empty(len(symbols), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return [found[a : b - length + 1] for a, b in zip(starts, ends, strict=True)]
