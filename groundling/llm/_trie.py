"""Similarity join of globally ordered sets in a prefix tree."""

from __future__ import annotations

import numpy as np


class Node:
    """A run of keys that all sets below share, the sizes of those sets, and their class if they have one."""

    __slots__ = ("keys", "kids", "ends", "low", "high", "member", "mixed")

    def __init__(self, keys: np.ndarray, low: int, high: int, member: int):
        self.keys, self.kids, self.ends = keys, {}, []
        self.low, self.high = low, high
        self.member, self.mixed = member, False


class Classes:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class PrefixTree:
    """Sets of sorted keys with paths in common. Probing with a set walks the paths with the overlap so far and leaves a subtree where
    the keys still to come, on the path or in the set, cannot reach the threshold num/den."""

    def __init__(self, num: int, den: int, classes: Classes):
        self.num, self.den, self.classes = num, den, classes
        self.root = Node(np.zeros(0, np.uint64), 1 << 60, 0, -1)

    def probe(self, keys: np.ndarray, member: int) -> list[int]:
        """Members whose sets are similar to ``keys``: at least one of every class that has any."""
        n, num, den, find = len(keys), self.num, self.den, self.classes.find
        both = num + den
        out = []
        stack = [(kid, 0, 0, n) for kid in self.root.kids.values()]
        own = self.root.kids.get(int(keys[0])) if n else None
        if own is not None:
            stack.append((own, 0, 0, n))
        while stack:
            node, overlap, depth, rest = stack.pop()
            if node.high * den < num * n or n * den < num * node.low:
                continue
            if (overlap + min(node.high - depth, rest)) * both < num * (n + node.low):
                continue
            if not node.mixed and find(node.member) == find(member):
                continue
            at = np.searchsorted(keys, node.keys)
            overlap += int((keys[np.minimum(at, n - 1)] == node.keys).sum())
            depth += len(node.keys)
            rest = n - int(np.searchsorted(keys, node.keys[-1], "right"))
            if node.ends and overlap * both >= num * (n + depth):
                for x in node.ends:
                    if self.classes.join(x, member):
                        out.append(x)
            if node.kids:
                bound = overlap
                stack.extend((kid, bound, depth, rest) for kid in node.kids.values())
                if rest:  # the path that the set itself would take is walked first
                    own = node.kids.get(int(keys[n - rest]))
                    if own is not None:
                        stack.append((own, bound, depth, rest))
        return out

    def insert(self, keys: np.ndarray, member: int) -> None:
        n, find = len(keys), self.classes.find
        node, at = self.root, 0
        while at < n:
            kid = node.kids.get(int(keys[at]))
            if kid is None:
                leaf = Node(keys[at:], n, n, member)
                leaf.ends.append(member)
                node.kids[int(keys[at])] = leaf
                return
            most = min(len(kid.keys), n - at)
            differ = np.flatnonzero(kid.keys[:most] != keys[at : at + most])
            common = int(differ[0]) if len(differ) else most
            if common < len(kid.keys):
                top = Node(kid.keys[:common], kid.low, kid.high, kid.member)
                top.mixed = kid.mixed
                kid.keys = kid.keys[common:]
                top.kids[int(kid.keys[0])] = kid
                node.kids[int(keys[at])] = top
                kid = top
            kid.low, kid.high = min(kid.low, n), max(kid.high, n)
            kid.mixed = kid.mixed or find(kid.member) != find(member)
            node, at = kid, at + common
        node.ends.append(member)


def links(sets: list[tuple[int, np.ndarray]], num: int, den: int, classes: Classes) -> list[tuple[int, int]]:
    """Pairs that join the classes of similar sets; similar sets in one class already add none."""
    tree, out = PrefixTree(num, den, classes), []
    for member, keys in sorted(sets, key=lambda s: (len(s[1]), s[0])):
        out += [(x, member) for x in tree.probe(keys, member)]
        tree.insert(keys, member)
    return out
