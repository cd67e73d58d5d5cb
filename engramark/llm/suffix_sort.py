"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, blind tries for what has a longer common prefix."""

from __future__ import annotations

#: Bytes that multikey quicksort looks at before a group goes to a blind trie.
SHALLOW = 16


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; the first ``known`` bytes are equal."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie_order(strings: list[bytes], group: list[int], known: int) -> list[int]:
    """The group in order. Inner nodes hold a depth and the bytes that branch there, not the bytes between."""
    root: list = [None, {}]  # depth, next byte -> node; a leaf is a list of equal strings under depth -1
    leaf = [-1, [group[0]]]
    root = leaf
    for i in group[1:]:
        s, node = strings[i], root
        while node[0] >= 0:
            node = node[1].get(_at(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = common_prefix(s, other, known)
        if depth == len(s) == len(other):
            node[1].append(i)
            continue
        parent, byte, node = None, 0, root
        while 0 <= node[0] < depth:
            parent, byte = node, _at(s, node[0])
            node = node[1][byte]
        if node[0] == depth:
            node[1][_at(s, depth)] = [-1, [i]]
            continue
        branch = [depth, {_at(other, depth): node, _at(s, depth): [-1, [i]]}]
        if parent is None:
            root = branch
        else:
            parent[1][byte] = branch
    order, stack = [], [root]
    while stack:
        depth, below = stack.pop()
        if depth < 0:
            order += below
        else:
            stack += [below[byte] for byte in sorted(below, reverse=True)]
    return order


def deep_shallow_order(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of the strings in order; the first ``known`` bytes of all are equal."""
    order: list[int] = []
    stack = [(list(range(len(strings))), known)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2 or depth < 0:
            order += group
        elif depth >= known + shallow:
            order += blind_trie_order(strings, group, depth)
        else:
            pivot = _at(strings[group[len(group) // 2]], depth)
            less, same, more = [], [], []
            for i in group:
                byte = _at(strings[i], depth)
                (same if byte == pivot else less if byte < pivot else more).append(i)
            # Strings that end here are equal: nothing is left to compare.
            stack += [(more, depth), (same, depth + 1 if pivot >= 0 else -1), (less, depth)]
    return order
