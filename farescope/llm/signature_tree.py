"""A tree of set signatures, joined with itself.

Leaves hold a few sets of like size, nodes hold the OR of the token bitmaps below them,
the range of set sizes, and the most tokens that any set below loses to shared bits. A pair
of nodes is dropped when the largest overlap that two sets below them can have is too
small for the similarity wanted, or when all that lies below is linked already.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
FAN = 8


class Node:
    __slots__ = ("bits", "least", "most", "lost", "members", "children")

    def __init__(self, bits, least, most, lost, members, children):
        self.bits, self.least, self.most, self.lost = bits, least, most, lost
        self.members, self.children = members, children


class Links:
    """Which members are in one component, and the links that made it so."""

    def __init__(self, labels: list[int]):
        self.root = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            self.root[i] = first.setdefault(label, i)
        self.made: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.made.append((a, b))

    def one(self, members: list[int], others: list[int]) -> bool:
        """Whether all are in one component."""
        want = self.find(members[0])
        return all(self.find(x) == want for x in others) and all(self.find(x) == want for x in members)


def width(size: int) -> int:
    """Bits for a set of ``size``: two to four for each token, within limits."""
    return min(1 << 16, max(256, 1 << (2 * size - 1).bit_length()))


def bitmap(values: np.ndarray) -> bytes:
    """The low bits of every hash as a position in a bitmap of the set's own width."""
    bits = width(len(values))
    out = np.zeros(bits, np.uint8)
    out[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: bytes, to: int) -> np.ndarray:
    """A bitmap at a smaller width: halves laid over each other."""
    words = np.frombuffer(bits, "<u8")
    return np.bitwise_or.reduce(words.reshape(-1, to // 64), 0)


def ones(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * overlap >= percent * union, of sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def grow(maps: np.ndarray, sizes: list[int], lost: list[int], order: list[int]) -> Node:
    level = []
    for i in range(0, len(order), LEAF):
        m = order[i : i + LEAF]
        n = [sizes[x] for x in m]
        level.append(Node(np.bitwise_or.reduce(maps[m], 0), min(n), max(n), max(lost[x] for x in m), m, []))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FAN):
            c = level[i : i + FAN]
            above.append(
                Node(
                    np.bitwise_or.reduce([x.bits for x in c], 0),
                    min(x.least for x in c),
                    max(x.most for x in c),
                    max(x.lost for x in c),
                    [m for x in c for m in x.members],
                    c,
                )
            )
        level = above
    return level[0]


def traverse(maps: np.ndarray, sizes: list[int], percent: int, settled, pair) -> None:
    """Call ``pair`` for the pairs of members whose bounds allow the similarity.

    ``settled(a, b)`` tells of two lists of members that no pair between them matters any more.
    """
    lost = [n - ones(m) for n, m in zip(sizes, maps)]

    def may(x, y) -> bool:
        if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
            return False
        common = min(ones(x.bits & y.bits) + min(x.lost, y.lost), x.most, y.most)
        return (100 + percent) * common >= percent * (x.least + y.least)

    def leaf(members: list[int], others: list[int]) -> None:
        """All pairs of two leaves, or of one with itself, by their own bounds."""
        a, b = np.array(members), np.array(others)
        n, k = np.array(sizes), np.array(lost)
        common = np.bitwise_count(maps[a][:, None] & maps[b][None]).sum(2, dtype=np.int64)
        common = np.minimum(common + np.minimum(k[a][:, None], k[b][None]), np.minimum(n[a][:, None], n[b][None]))
        d = n[a][:, None] + n[b][None]
        for i, j in zip(*np.nonzero((100 + percent) * common >= percent * d)):
            x, y = members[i], others[j]
            if members is not others or i < j:
                pair(x, y)

    def cross(x: Node, y: Node) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if settled(x.members, y.members) or not may(x, y):
                continue
            if x.children and (len(x.members) >= len(y.members) or not y.children):
                todo += [(c, y) for c in x.children]
            elif y.children:
                todo += [(x, c) for c in y.children]
            else:
                leaf(x.members, y.members)

    def own(node: Node) -> None:
        for c in node.children:
            own(c)
        for i, c in enumerate(node.children):
            for d in node.children[:i]:
                cross(d, c)
        if not node.children and not settled(node.members, node.members):
            leaf(node.members, node.members)

    own(grow(maps, sizes, lost, sorted(range(len(sizes)), key=sizes.__getitem__)))


def by_width(sizes: list[int]):
    """Members in classes of bitmap width, each with the class of the next width: others are too unlike in size."""
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        classes.setdefault(width(n), []).append(i)
    for w in sorted(classes):
        yield w, classes[w], classes.get(2 * w, [])


def hopeful(maps: list[bytes], sizes: list[int], labels: list[int], percent: int = 75) -> list[int]:
    """Members that may be similar to one with another label, as far as bitmaps and sizes tell."""
    found: set[int] = set()
    for w, same, next_ in by_width(sizes):
        members = same + next_
        if len(members) < 2:
            continue
        at = [labels[m] for m in members]

        def settled(a: list[int], b: list[int], at=at, members=members) -> bool:
            if all(members[x] in found for x in a) and all(members[x] in found for x in b):
                return True
            first = at[a[0]]
            return all(at[x] == first for x in a) and all(at[x] == first for x in b)

        def pair(a: int, b: int, at=at, members=members) -> None:
            if at[a] != at[b]:
                found.update((members[a], members[b]))

        wide = np.stack([folded(maps[m], w) for m in members])
        traverse(wide, [sizes[m] for m in members], percent, settled, pair)
    return sorted(found)


def join(sets: list[np.ndarray], labels: list[int], percent: int = 75) -> list[tuple[int, int]]:
    """Links between positions of ``sets`` that connect all that similarity connects.

    Sets with equal labels count as linked already. A pair is compared unless a bound rules
    it out or both are in one component by then.
    """
    links = Links(labels)
    sizes = [len(s) for s in sets]
    maps = [bitmap(s) for s in sets]
    for w, same, next_ in by_width(sizes):
        members = same + next_
        if len(members) < 2:
            continue

        def settled(a: list[int], b: list[int], members=members) -> bool:
            return links.one([members[x] for x in a], [members[x] for x in b])

        def pair(a: int, b: int, members=members) -> None:
            a, b = members[a], members[b]
            if links.find(a) != links.find(b) and similar(sets[a], sets[b], percent):
                links.add(a, b)

        wide = np.stack([folded(maps[m], w) for m in members])
        traverse(wide, [sizes[m] for m in members], percent, settled, pair)
    return links.made


def pairs(sets: list[np.ndarray], percent: int = 75) -> list[tuple[int, int]]:
    """Every similar pair of positions of ``sets``, the smaller first, whatever else links the two."""
    sizes = [len(s) for s in sets]
    maps = [bitmap(s) for s in sets]
    found: set[tuple[int, int]] = set()
    for w, same, next_ in by_width(sizes):
        members = same + next_
        if len(members) < 2:
            continue

        def pair(a: int, b: int, members=members) -> None:
            name = min(members[a], members[b]), max(members[a], members[b])
            if name not in found and similar(sets[name[0]], sets[name[1]], percent):
                found.add(name)

        wide = np.stack([folded(maps[m], w) for m in members])
        traverse(wide, [sizes[m] for m in members], percent, lambda a, b: False, pair)
    return sorted(found)
