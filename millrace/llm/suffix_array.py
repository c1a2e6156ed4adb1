"""Suffix order of a block of bytes by two-stage sorting, with adjacent common prefixes.

Only suffixes smaller than their successor are sorted directly, eight bytes at a time and only
while they tie.  The others are induced: the buckets of first bytes are scanned in ascending
order, and the predecessor of each suffix met is appended to the bucket of its own first byte.
Everything works on whole arrays; the order is exact for the first ``depth`` bytes.
"""

import numpy as np


def words_at(text):
    """The eight bytes from each position as one big-endian number, zeros past the end."""
    word = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        word = (word[:-n] << np.uint64(8 * n)) | word[n:]
    return np.concatenate((word[:len(text)], np.zeros(1, np.uint64)))


def smaller_than_next(text):
    """True where a suffix is smaller than its successor; the last one never is."""
    n = len(text)
    # A run of one byte is decided by what follows the run.
    ends = np.full(n, n, np.int64)
    change = np.flatnonzero(text[:-1] != text[1:])
    ends[change] = change
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    place = np.minimum(ends, n - 2)
    return (ends < n) & (text[place] < text[place + 1])


def _sorted_directly(at, words, depth):
    """The positions in the order of their first ``depth`` bytes."""
    end = len(words) - 1
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    for done in range(8, depth, 8):
        # Positions that tie with a neighbour, and the number of their tie.
        tied = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(tied):
            break
        tie = np.cumsum(new[tied])
        key = words[np.minimum(at[tied] + done, end)]
        rank = np.unique(key, return_inverse=True)[1]
        order = np.argsort(tie * np.int64(len(tied) + 1) + rank)
        at[tied] = at[tied][order]
        tie, rank = tie[order], rank[order]
        new[tied[1:]] = (tie[1:] != tie[:-1]) | (rank[1:] != rank[:-1])
    return at


def suffix_order(text, depth):
    """All positions of ``text`` (bytes as uint8), ordered by the suffixes' first bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = smaller_than_next(text)
    words = words_at(text)
    direct = np.flatnonzero(small)
    if len(direct):
        direct = _sorted_directly(direct, words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix
    order = []
    for byte in range(256):
        if not waiting[byte] and bounds[byte] == bounds[byte + 1]:
            continue
        scanned = []
        # Induced suffixes come first; those of a run of this byte follow one another.
        induced = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(induced):
            scanned.append(induced)
            before = induced[induced > 0] - 1
            induced = before[(text[before] == byte)]
        scanned.append(direct[bounds[byte]:bounds[byte + 1]])
        bucket = np.concatenate(scanned)
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        first = text[before]
        before = before[np.argsort(first, kind="stable")]
        count = np.bincount(first, minlength=256)
        stop = np.cumsum(count)
        for larger in np.flatnonzero(count):
            waiting[larger].append(before[stop[larger] - count[larger]:stop[larger]])
        waiting[byte] = []
    return np.concatenate(order)


def common_prefixes(text, order, depth):
    """Common prefix of each suffix in order with the one before it, at most ``depth``."""
    words = words_at(text)
    end = len(words) - 1
    length = np.zeros(len(order), np.int64)
    open_pairs = np.arange(1, len(order))
    for done in range(0, depth, 8):
        left = words[np.minimum(order[open_pairs - 1] + done, end)]
        right = words[np.minimum(order[open_pairs] + done, end)]
        differ = left ^ right
        same = np.full(len(differ), 8, np.int64)
        unlike = differ != 0
        # The highest differing byte tells how many bytes agree.
        high = differ[unlike]
        agree = np.zeros(len(high), np.int64)
        for size in (4, 2, 1):
            quiet = (high >> np.uint64(64 - 8 * size)) == 0
            agree[quiet] += size
            high = np.where(quiet, high << np.uint64(8 * size), high)
        same[unlike] = agree
        length[open_pairs] += same
        open_pairs = open_pairs[~unlike]
        if not len(open_pairs):
            break
    return np.minimum(length, depth)
