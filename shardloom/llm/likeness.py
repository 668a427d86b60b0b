"""Which of many captions may give the same description: keys under which like captions meet, and bounds that lose none."""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .captions import ADDED, COMMON

#: Words that come so often relative to the collection are looked at for phrases.
OFTEN_SHARE = 500
#: Two words are one phrase if they share so much of the captions of the more frequent one.
TOGETHER = 0.5
#: Captions that a pair has to be seen in to count.
SEEN = 20

#: A word (or phrase) of at most so many captions is a key of its own.
ALONE = 10
#: The rarest other words and phrases of a caption that make its keys.
TELLING = 6
#: Captions that may share a key by chance, on average; from so few words together on, more are a key.
CHANCE = 0.1
#: Among n captions FEW / n of them may, if that is more: what few captions have in common costs little to look at.
FEW = 1000
MOST_TOGETHER = 5
#: Captions that may share all telling words; of more, a rare word a letter away has to be shared as well.
SIBLINGS = 1000

#: A word belongs to a phrase if so much of its captions have it.
AT_HOME = 0.9


def often_words(known: dict[str, int], classes: int) -> dict[str, int]:
    """A number for every word that is looked at for phrases, the most frequent first."""
    often = [w for w, n in known.items() if n > classes / OFTEN_SHARE and w not in COMMON]
    return {w: i for i, w in enumerate(sorted(often, key=lambda w: -known[w]))}


def _distinct(x: np.ndarray) -> np.ndarray:
    """Like ``np.unique``, whose table is slower than a sort of what is nearly in order."""
    x = np.sort(x, kind="stable")
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _numbered(texts: pa.ListArray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of every frequent word, once a text, in order."""
    at = pc.index_in(texts.flatten(), value_set=pa.array(list(number), pa.string())).fill_null(-1).to_numpy().astype("i8")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
    both = _distinct((row * len(number) + at)[at >= 0])
    return both // len(number), both % len(number)


def pairs_of(texts: pa.ListArray, number: dict[str, int], known: dict[str, int]) -> np.ndarray:
    """Every two frequent words of a text that can be linked, as a code: the smaller number times that of all words, and the other."""
    row, word = _numbered(texts, number)
    single = -np.array([known[w] for w in number])
    # a word is linked to none that has less than its share of captions
    reach = np.searchsorted(single, single * TOGETHER, "right") - 1
    at, out = np.arange(len(row)), [np.empty(0, "i8")]
    for d in range(1, len(row)):
        at = at[at + d < len(row)]
        at = at[(row[at + d] == row[at]) & (word[at + d] <= reach[word[at]])]
        if not len(at):
            break
        out.append(word[at] * len(number) + word[at + d])
    return np.concatenate(out)


def homes_of(texts: pa.ListArray, number: dict[str, int], phrase: np.ndarray) -> np.ndarray:
    """Every phrase of a text with every frequent word of it, as a code like a pair's; ``phrase`` has the phrase of each word, -1 for none."""
    row, word = _numbered(texts, number)
    inside = np.flatnonzero(phrase[word] >= 0)
    held = _distinct(row[inside] * len(number) + phrase[word[inside]])
    at, which = held // len(number), held % len(number)
    starts = np.searchsorted(row, np.arange(len(texts) + 1))
    first, size = starts[at], np.diff(starts)[at]
    places = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    return np.repeat(which, size) * len(number) + word[places]


def tally(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Every code once and how often it came."""
    if words <= 2048:
        n = np.bincount(codes, minlength=1)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(codes, return_counts=True)


def linked_words(number: dict[str, int], known: dict[str, int], pairs: dict[int, int]) -> np.ndarray:
    """The phrase of every frequent word, named by its first word's number, -1 for none; from how many captions have each pair."""
    single = [known[w] for w in number]
    root = list(range(len(number)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for code, n in sorted(pairs.items()):
        i, j = divmod(code, len(number))
        if n >= SEEN and n >= TOGETHER * max(single[i], single[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    at = [find(i) for i in range(len(number))]
    members = np.bincount(at, minlength=len(at))
    return np.array([r if members[r] > 1 else -1 for r in at], "i8")


def named(number: dict[str, int], known: dict[str, int], phrase: np.ndarray, inside: dict[int, int]) -> tuple[dict[str, str], dict[str, tuple[str, int]]]:
    """What ``phrases`` gives; ``inside`` has how many captions of each phrase have each word."""
    often = list(number)
    unit = {w: f"{often[r]} +" for w, r in zip(often, phrase.tolist()) if r >= 0}
    most: dict[int, int] = defaultdict(int)
    for w, r in zip(often, phrase.tolist()):
        most[r] = max(most[r], known[w])
    homes: dict[str, tuple[str, int]] = {}
    for code, n in sorted(inside.items()):
        r, i = divmod(code, len(often))
        size = most[r]
        if n >= AT_HOME * max(known[often[i]], SEEN) and known[often[i]] <= size:
            name = unit.get(often[i], often[i])
            homes[name] = max((unit[often[r]], size), homes.get(name, ("", 0)), key=lambda h: h[1])
    return unit, homes


def phrases(texts: list[list[str]], known: dict[str, int], classes: int) -> tuple[dict[str, str], dict[str, tuple[str, int]]]:
    """The phrase of every frequent word that nearly always comes with another, and the words that belong to one phrase, from all captions.

    Words of a phrase tell no more together than one of them does. A word that
    is found with one phrase alone tells as much as its share of that phrase's
    captions; the second result has the phrase and the number of those.
    ``p07_incremental.learn`` makes the same counts in tasks.
    """
    number = often_words(known, classes)
    rows = pa.array(texts, pa.list_(pa.string()))
    counted = lambda codes: dict(zip(*(c.tolist() for c in tally(codes, len(number)))))
    phrase = linked_words(number, known, counted(pairs_of(rows, number, known)))
    return named(number, known, phrase, counted(homes_of(rows, number, phrase)))


class Collection:
    """How frequent the words of a collection are, which make phrases, and what captions they belong to."""

    def __init__(self, known: dict[str, int], classes: int, phrase: dict[str, str] | None = None, homes: dict[str, tuple[str, int]] | None = None) -> None:
        self.known, self.classes, self.homes = known, max(1, classes), homes or {}
        self.often = max(50, classes // 2000)
        phrase = phrase or {}
        #: Of a word that can be in a key: its phrase or itself, and how frequent it is.
        self.telling = {t: (phrase.get(t, t), n) for t, n in known.items() if t not in COMMON}
        #: Of a frequent word: its bit in a signature, 0 for those that are not counted.
        self.firm = {t: self._bit(t) if (len(t) > 2 or t.isdigit()) and t not in COMMON and t not in ADDED else 0 for t, n in known.items() if n >= self.often}
        self.hashes: dict[str, int] = {}

    def frequent(self, word: str) -> bool:
        return self.known.get(word, 0) >= self.often

    @staticmethod
    def _bit(text: str) -> int:
        return 1 << (crc32(text.encode()) & 127)

    def hashed(self, text: str) -> int:
        h = self.hashes.get(text)
        if h is None:
            if len(self.hashes) > 500_000:
                self.hashes.clear()
            h = self.hashes[text] = int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little")
        return h

    def signature(self, tokens: list[str]) -> tuple[int, int]:
        """Bits (128) of the words that only themselves can match, and the number of those that others may match.

        Frequent words and numbers are no misspellings of each other; any other
        word may be one, or have one, of whatever word.
        """
        bits = free = 0
        firm = self.firm
        for t in tokens:
            bit = firm.get(t)
            if bit is not None:
                bits |= bit
            elif len(t) > 2 or t.isdigit():
                if t.isalpha():
                    free += 1
                else:
                    bits |= self._bit(t)
        return bits, min(free, 255)

    def keys(self, tokens: list[str], rarer: dict[str, int] | None = None) -> list[int]:
        """The keys of a caption as numbers of 64 bits: two captions can give the same description under any of them.

        Rare words are keys alone. Of the others the TELLING rarest, phrases
        counting as one, make keys in the smallest groups that not even CHANCE
        other captions are expected to share. So captions meet that keep one
        rare word, or as many telling ones as such a group has, whatever else an
        edit takes away. If no group is small enough, all of them are one key;
        where even that is shared by more than SIBLINGS, together with every
        word that occurs once or rarely, each without any one of its letters.
        A caption without telling words has its common words as its key.
        """
        telling, n = self.telling, self.classes
        units: dict[str, int] = {}
        for t in tokens:
            f = telling.get(t)
            if f is None:
                if not rarer or t not in rarer:
                    continue
                f = (t, rarer[t])
            if f[1] < units.get(f[0], n + 1):
                units[f[0]] = f[1]
        ranked = sorted([(c, u) for u, c in units.items()])
        out = [self.hashed(u) for c, u in ranked if c <= ALONE]
        rest = ranked[len(out) : len(out) + TELLING]
        homes = [self.homes[u] for _, u in rest if u in self.homes]
        if 2 * len(homes) > len(rest) and 2 * homes.count(most := max(homes, key=homes.count)) > len(rest):
            # most belong to one phrase: it is its captions that may share a key
            n = most[1]
        shares = [(min(1.0, c / n), self.hashed(u)) for c, u in rest]
        groups, chance = len(out), max(CHANCE, FEW / n)
        stack = [(0, 0, 1.0, 0)]
        while stack:
            first, key, share, size = stack.pop()
            for i in range(first, len(shares)):
                s, k = share * shares[i][0], key ^ shares[i][1]
                if s * n <= chance:
                    out.append(k)
                elif size + 1 < MOST_TOGETHER:
                    stack.append((i + 1, k, s, size + 1))
        if groups == len(out):
            key, share = 0, 1.0
            for x, k in shares:
                key, share = key ^ k, share * x
            own = [t for t in set(tokens) if len(t) >= 6 and t.isalpha() and t not in COMMON and telling.get(t, (t, 1))[1] <= ALONE] if share * n > SIBLINGS else []
            for t in own:
                out += {self.hashed(v) ^ key ^ 1 for v in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}}
            if not own:
                out.append(key or self.hashed(" ".join(sorted(set(tokens) & COMMON))))
        return out


#: Last words may be cut off, on both sides.
CUT = 2
#: Words left over on both sides together with which captions may still give the same description.
LEFT = 3


def possible(bits: tuple[np.ndarray, np.ndarray], free: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that the signatures do not rule out; every pair that ``same_description`` accepts is among them.

    A bit of one that the other has not is at least one word that is left over,
    unless a word of the other that is not firm, or one cut off, takes it up.
    """
    spare = free[i] + free[j] + CUT
    left = [np.bitwise_count(bits[0][x] & ~bits[0][y]).astype("i4") + np.bitwise_count(bits[1][x] & ~bits[1][y]) - spare for x, y in ((i, j), (j, i))]
    return (left[0] <= 0) | (left[1] <= 0) | (left[0] + left[1] <= LEFT)
