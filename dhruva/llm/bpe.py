"""Byte-level BPE over a rank file of a public tokenizer.

Merging works on a segment tree over the byte positions of a pre-token: a leaf holds the rank of the
pair that starts at its position, an inner node the leftmost minimum of its children, so the root names
the next merge. A merge changes three leaves (the pair itself, its live left neighbour and the swallowed
position) and repairs their root paths. Many pre-tokens of similar length share one set of arrays and are
merged in lock step; a few long ones take the same tree one by one.

Pre-tokens recur, so each Python worker remembers the ids of words it has already encoded. The memory is a
cache of fixed size: it only saves work and is emptied when full.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import regex

# White space of the split pattern: the Unicode property White_Space (fixed values).
WHITE_SPACE = "\t-\r\x20\x85\xa0  -     　"
# The tokenizer's published split pattern, with the class above for \s (fixed values).
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}" + WHITE_SPACE + "]+|["
    + WHITE_SPACE + "]+(?![^" + WHITE_SPACE + "])|[" + WHITE_SPACE + "]+"
)
# Words with their leading blank: every split of SPLIT lies within one of these units.
UNITS = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
FINE = regex.compile(SPLIT)
# The same two for texts in which re's classes say the same as the Unicode properties: without the four
# separators that only Python counts as blanks, and without numeric characters but decimal digits.
UNITS_PLAIN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
FINE_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _separators(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def split_units(text: str) -> list[str]:
    return (UNITS if _separators(text) else UNITS_PLAIN).findall(text)


def split_word(word: str) -> list[str]:
    odd = _separators(word) or not word.isascii() and any(c.isnumeric() and not c.isdecimal() for c in word)
    return (FINE if odd else FINE_PLAIN).findall(word)


NONE = np.int64(1) << 62
CACHE_ENTRIES, CACHE_CHARS = 300_000, 12_000_000
LOCK_STEP = 24  # fewer pre-tokens of one size than this are merged one by one


class PairRanks:
    """Rank of the token that two adjacent tokens form: an open-addressing table in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        bits = max(8, (len(pairs) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slots, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the pair forms no token or a side is negative (no token there)."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << np.int64(20) | right)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots_open = slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots_open]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots_open[hit]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.n_vocab = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token_bytes = np.zeros(self.n_vocab, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.ranks = PairRanks(ranks)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    # -- merging ---------------------------------------------------------------------------------

    def merge_one(self, data: bytes) -> list[int]:
        """Ids of one pre-token by a scalar segment tree."""
        n, get = len(data), self.ranks.pairs.get
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) < none:
            rank, at = divmod(root, size)
            gone = after[at]
            then, prev = after[gone] if gone < n else n, before[at]
            ids[at], ids[gone], after[at] = rank, -1, then
            changed = [(gone, none)]
            new = none
            if then < n:
                before[then] = at
                pair = get(rank << 20 | ids[then])
                new = none if pair is None else pair * size + at
            changed.append((at, new))
            if prev >= 0:
                pair = get(ids[prev] << 20 | rank)
                changed.append((prev, none if pair is None else pair * size + prev))
            for leaf, value in changed:
                k = size + leaf
                if tree[k] == value:
                    continue
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    tree[k] = a if a < b else b
                    k >>= 1
        return [x for x in ids if x >= 0]

    def merge_many(self, items: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian int32 bytes) of pre-tokens of at most ``size`` bytes, a power of two."""
        n, bits, wide = len(items), size.bit_length() - 1, size + 2
        lens = np.fromiter(map(len, items), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in items), np.uint8).reshape(n, size)
        # Column 0 and column size + 1 are sentinels without a token, so neighbours always exist.
        ids = np.full((n, wide), -1, np.int64)
        ids[:, 1 : size + 1] = np.where(np.arange(size) < lens[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = self.ranks.look_up(ids[:, 1 : size + 1].ravel(), ids[:, 2 : size + 2].ravel()).reshape(n, size)
        tree[:, size:] = np.where(rank >= 0, (rank << bits) + np.arange(size), NONE)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        flat, f_ids, f_after, f_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * size) + 1]
            live = root < NONE
            if not live.all():
                rows, root = rows[live], root[live]
            if not len(rows):
                break
            at = root & (size - 1)
            rank = root >> bits
            cell = rows * wide
            here = cell + at + 1
            gone = f_after[here]
            then = f_after[cell + gone]
            prev = f_before[here]
            f_ids[here], f_ids[cell + gone] = rank, -1
            f_after[here] = then
            f_before[cell + then] = at + 1
            k = len(rows)
            left = np.concatenate((rank, f_ids[cell + prev]))
            right = np.concatenate((f_ids[cell + then], rank))
            new = self.ranks.look_up(left, right)
            base = rows * (2 * size)
            self._set(flat, base, size, gone - 1, np.full(k, NONE))
            self._set(flat, base, size, at, np.where(new[:k] >= 0, (new[:k] << bits) + at, NONE))
            has = np.flatnonzero(prev > 0)
            if len(has):
                p, r = prev[has] - 1, new[k:][has]
                self._set(flat, base[has], size, p, np.where(r >= 0, (r << bits) + p, NONE))
        keep = ids >= 0
        counts = keep.sum(1) * 4
        data, ends = ids[keep].astype("<i4").tobytes(), np.cumsum(counts).tolist()
        return [data[e - c : e] for e, c in zip(ends, counts.tolist())]

    @staticmethod
    def _set(flat: np.ndarray, base: np.ndarray, size: int, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point update: writes leaves and repairs their paths, stopping where nothing changes."""
        node = base + size + leaf
        changed = flat[node] != value
        if not changed.any():
            return
        base, node, value, leaf = base[changed], node[changed], value[changed], leaf[changed]
        flat[node] = value
        k = (size + leaf) >> 1
        while len(k) and k[0] > 0:
            child = base + 2 * k
            least = np.minimum(flat[child], flat[child + 1])
            node = base + k
            moved = flat[node] != least
            if not moved.all():
                base, k, node, least = base[moved], k[moved], node[moved], least[moved]
            flat[node] = least
            k = k >> 1

    def _learn(self, new: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode("utf-8", "surrogatepass")
            groups.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for size, items in groups.items():
            if size == 1 or len(items) < LOCK_STEP or size * len(items) > 1 << 22 and size > 4096:
                for piece, data in items:
                    self.pieces[piece] = np.array(self.merge_one(data), "<i4").tobytes()
                continue
            step = max(LOCK_STEP, (1 << 20) // size)
            for start in range(0, len(items), step):
                part = items[start : start + step]
                done = self.merge_many([data for _, data in part], size)
                self.pieces.update((piece, ids) for (piece, _), ids in zip(part, done))

    # -- texts -----------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes; null and empty texts have none."""
        units = [split_units(t) if t else [] for t in texts]
        fresh = set().union(*units) - self.words.keys()
        if fresh:
            if len(self.words) > CACHE_ENTRIES or self.held > CACHE_CHARS:
                self.words.clear()
                self.pieces.clear()
                self.held = 0
                fresh = set().union(*units)
            self.held += sum(map(len, fresh))
            split = {w: split_word(w) for w in fresh}
            new = {p for parts in split.values() for p in parts} - self.pieces.keys()
            self._learn(list(new))
            piece = self.pieces.__getitem__
            for word, parts in split.items():
                self.words[word] = piece(parts[0]) if len(parts) == 1 else b"".join(map(piece, parts))
        word = self.words.__getitem__
        return [b"".join(map(word, u)) for u in units]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One encoder for each rank file and Python worker."""
    return ByteBPE(path)
