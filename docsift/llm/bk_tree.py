"""BK-trees over 64-bit fingerprints."""

from __future__ import annotations


class BKTree:
    """Children are keyed by their Hamming distance to the parent.

    Whatever is within ``radius`` of a query at distance d from a node lies below the node's edges d - radius to
    d + radius (triangle inequality), so only those are followed. Values can be taken out; a branch with none left is
    not entered again.
    """

    __slots__ = ("root",)

    # A node is [value, still there, number of values left in its branch, parent, children by distance].
    def __init__(self, values) -> None:
        self.root: list | None = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, True, 1, None, {}]
            return
        node = self.root
        while True:
            node[2] += 1
            distance = (node[0] ^ value).bit_count()
            child = node[4].get(distance)
            if child is None:
                node[4][distance] = [value, True, 1, node, {}]
                return
            node = child

    def take_within(self, value: int, radius: int) -> list[int]:
        """Take out and return all values within the radius."""
        found: list[int] = []
        stack = [self.root] if self.root is not None and self.root[2] else []
        while stack:
            node = stack.pop()
            distance = (node[0] ^ value).bit_count()
            if node[1] and distance <= radius:
                found.append(node[0])
                node[1] = False
                above = node
                while above is not None:
                    above[2] -= 1
                    above = above[3]
            children = node[4]
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for edge, c in children.items() if abs(edge - distance) <= radius and c[2]]
                else:
                    for edge in range(distance - radius, distance + radius + 1):
                        child = children.get(edge)
                        if child is not None and child[2]:
                            stack.append(child)
        return found


def linked_groups(values: list[int], radius: int):
    """Groups of two and more distinct values that are connected by links of at most ``radius`` differing bits.

    Every value is asked for once, and what a query finds is taken out of the tree, so a dense group costs one
    query for each of its values and never all of its pairs.
    """
    tree = BKTree(values)
    for value in values:
        waiting = tree.take_within(value, 0)  # nothing, if an earlier group took it
        group = []
        while waiting:
            asked = waiting.pop()
            group.append(asked)
            waiting += tree.take_within(asked, radius)
        if len(group) > 1:
            yield group
