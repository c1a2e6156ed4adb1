"""Re-Pair grammars over token ids: compression, expansion and access to a part.

``compress`` replaces frequent pairs of neighbouring symbols by new symbols, round by round: each
round takes the pairs that occur at least 1/256 as often as the most frequent one, resolves
overlaps from left to right, and replaces all their occurrences at once.  It ends when no pair is
frequent, the rules are used up, or a round has shortened the sequence by less than a hundredth.  Rule k is symbol ``base + k``; its two symbols are older.
"""

from dataclasses import dataclass

import numpy as np

# A pair has to occur so often to become a rule; rules of one grammar.
LEAST = 4
RULES = 16_000


@dataclass
class Grammar:
    """Symbols below ``base`` are ids; ``length`` holds the ids that each rule stands for."""

    base: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    sequence: np.ndarray

    def widths(self, symbols):
        """How many ids each symbol stands for."""
        ruled = symbols >= self.base
        widths = np.ones(len(symbols), np.int64)
        widths[ruled] = self.length[symbols[ruled] - self.base]
        return widths

    def expand(self, symbols):
        """The ids of some symbols; each step replaces all rules by their two symbols."""
        while True:
            ruled = symbols >= self.base
            if not ruled.any():
                return symbols.astype(np.uint32)
            place = np.cumsum(ruled) - ruled + np.arange(len(symbols))
            longer = np.empty(len(symbols) + int(ruled.sum()), symbols.dtype)
            rule = symbols[ruled] - self.base
            longer[place[~ruled]] = symbols[~ruled]
            longer[place[ruled]] = self.left[rule]
            longer[place[ruled] + 1] = self.right[rule]
            symbols = longer

    def ids(self):
        """All ids: each rule is expanded once, its ids are copied to every use."""
        rules = self.expand((np.arange(len(self.left)) + self.base).astype(self.sequence.dtype))
        source = np.concatenate([rules, self.sequence.astype(np.uint32)])
        start = np.arange(len(self.sequence)) + len(rules)
        ruled = self.sequence >= self.base
        first = np.cumsum(self.length) - self.length
        start[ruled] = first[self.sequence[ruled] - self.base]
        widths = self.widths(self.sequence)
        ends = np.cumsum(widths)
        place = np.arange(ends[-1] if len(ends) else 0)
        return source[place + np.repeat(start - ends + widths, widths)]

    def part(self, start, stop):
        """The ids from start to stop; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.widths(self.sequence))
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[first - 1]) if first else 0
        return self.expand(self.sequence[first:last])[start - before:stop - before]


def symbol_type(base):
    """The narrowest type that holds the ids and as many rules as there may be."""
    return np.uint16 if base + RULES <= 1 << 16 else np.uint32


def _frequent(pairs, room):
    """Pairs to replace in a round, at most ``room``, the most frequent first."""
    ordered = np.sort(pairs)
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(heads, len(ordered)))
    chosen = np.flatnonzero(counts >= max(LEAST, counts.max() // 256))
    if len(chosen) > room:
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:room]]
    return np.sort(ordered[heads[chosen]])


def _numbers(pairs, chosen):
    """Places of the chosen pairs, and the number of the pair at each; two chosen pairs of one
    table slot wait for each other: the later one stays for another round."""
    bits = max(10, int(8 * len(chosen)).bit_length())
    table = np.full(1 << bits, -1, np.int32)

    def slots(keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    table[slots(chosen)] = np.arange(len(chosen))
    number = table[slots(pairs)]
    place = np.flatnonzero(number >= 0)
    number = number[place]
    same = chosen[number] == pairs[place]
    return place[same], number[same]


def compress(ids, base, rules=RULES):
    """The grammar of an array of ids below ``base``."""
    symbol = symbol_type(base)
    pair, bits = (np.uint32, 16) if symbol is np.uint16 else (np.uint64, 32)
    sequence = ids.astype(symbol)
    left, right, length = [], [], []
    lengths = np.ones(0, np.int64)
    while len(lengths) < rules and len(sequence) > 1:
        pairs = sequence[:-1].astype(pair) << pair(bits) | sequence[1:]
        chosen = _frequent(pairs, rules - len(lengths))
        if not len(chosen):
            break
        place, number = _numbers(pairs, chosen)
        # Of places one after another every second one, from the first.
        head = np.concatenate(([True], place[1:] != place[:-1] + 1))
        run = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
        taken = (np.arange(len(place)) - run) % 2 == 0
        place, number = place[taken], number[taken]
        uses = np.bincount(number, minlength=len(chosen))
        useful = uses >= 2
        if not useful.any():
            break
        name = np.cumsum(useful) - 1 + len(lengths) + base
        kept = useful[number]
        place, number = place[kept], number[kept]
        chosen = chosen[useful]
        left.append((chosen >> pair(bits)).astype(symbol))
        right.append((chosen & pair((1 << bits) - 1)).astype(symbol))
        known = Grammar(base, None, None, lengths, None)
        length.append(known.widths(left[-1]) + known.widths(right[-1]))
        lengths = np.concatenate([lengths, length[-1]])
        sequence[place] = name[number].astype(symbol)
        keep = np.ones(len(sequence), bool)
        keep[place + 1] = False
        sequence = sequence[keep]
        if 100 * len(place) < len(sequence):
            break
    none = np.zeros(0, symbol)
    return Grammar(base, np.concatenate([none, *left]), np.concatenate([none, *right]),
                   lengths, sequence)
