"""Byte-level BPE by a rank queue over a hierarchical bitmap.

A pre-token is a linked list of byte positions. Every adjacent pair that the
vocabulary can merge waits in the bucket of its merge rank. A three-level
bitmap over the ranks finds the lowest non-empty bucket by find-first-set.
Entries that an earlier merge made stale are recognised when they come up and
skipped. A merge only creates pairs of a higher rank than its own (a token
exists before any merge that uses it), so a bucket is complete when its turn
comes and its entries are worked off from left to right. The cost is
O(n log n) at worst in the length of the pre-token; there is no rescan.
"""

from __future__ import annotations

import base64
from array import array

import regex

#: Fixed value: the pre-token pattern of the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BITS = 6
MASK = (1 << BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """``left << 32 | right`` to the id of the merged token, for every split of a token in two tokens.

    The id is the merge's rank.
    """
    table: dict[int, int] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = ranks.get(token[:cut])
            if left is not None:
                right = ranks.get(token[cut:])
                if right is not None:
                    table[left << 32 | right] = rank
    return table


class RankQueue:
    """Positions by merge rank; ``pop`` returns the lowest rank with its positions in order."""

    def __init__(self, size: int) -> None:
        self.words = [0] * ((size >> BITS) + 1)
        self.blocks = [0] * ((size >> 2 * BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> BITS
        block = word >> BITS
        self.words[word] |= 1 << (rank & MASK)
        self.blocks[block] |= 1 << (word & MASK)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        bits = self.blocks[block]
        word = block << BITS | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        rank = word << BITS | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            bits = self.blocks[block]
            self.blocks[block] = bits = bits & ~(1 << (word & MASK))
            if not bits:
                self.top &= ~(1 << block)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Encodes texts; distinct pre-tokens are kept up to ``memory`` entries and then forgotten together."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 200_000, longest: int = 64) -> None:
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.merges = merge_table(ranks)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.memory, self.longest = memory, longest

    def pre_token(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        merges, queue, count = self.merges, self.queue, len(piece)
        ids = [self.byte_ids[b] for b in piece]
        if count < 2:
            return ids
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        for i in range(count - 1):
            rank = merges.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            for i in positions:
                j = after[i]
                # stale: i was merged away (-1), is the last, or its pair has changed
                if ids[i] < 0 or j >= count or merges.get(ids[i] << 32 | ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                following = after[i] = after[j]
                if following < count:
                    before[following] = i
                    new = merges.get(rank << 32 | ids[following])
                    if new is not None:
                        queue.push(new, i)
                previous = before[i]
                if previous >= 0:
                    new = merges.get(ids[previous] << 32 | rank)
                    if new is not None:
                        queue.push(new, previous)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> list[int]:
        ids = self.pre_token(text.encode("utf-8", "surrogatepass"))
        if len(text) <= self.longest:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> array:
        """Ids of a text; none for a null or empty one."""
        out = array("i")
        if text:
            known, piece = self.known.get, self.piece
            for part in self.split(text):
                out.extend(known(part) or piece(part))
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        known, piece = self.known.get, self.piece
        return sum([len(known(part) or piece(part)) for part in self.split(text)])
