"""Suffix automata over small integer alphabets."""

from __future__ import annotations


def build(sequences) -> tuple[list[dict], list[int], list[int], list[int]]:
    """The generalised suffix automaton of several sequences: for each state its transitions,
    suffix link, longest length, and the (sequence, end) at which it was made, as an index into the
    order in which symbols were read (-1 for clones). State 0 is the root."""
    move, link, size, made = [{}], [-1], [0], [-1]
    read = 0
    for sequence in sequences:
        last = 0
        for c in sequence:
            if c in move[last]:  # already there from an earlier sequence
                q = move[last][c]
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = _clone(move, link, size, made, last, c, q)
                read += 1
                continue
            new = len(move)
            move.append({})
            link.append(0)
            size.append(size[last] + 1)
            made.append(read)
            p = last
            while p >= 0 and c not in move[p]:
                move[p][c] = new
                p = link[p]
            if p >= 0:
                q = move[p][c]
                link[new] = q if size[p] + 1 == size[q] else _clone(move, link, size, made, p, c, q)
            last = new
            read += 1
    return move, link, size, made


def _clone(move, link, size, made, p, c, q) -> int:
    new = len(move)
    move.append(dict(move[q]))
    link.append(link[q])
    size.append(size[p] + 1)
    made.append(-1)
    link[q] = new
    while p >= 0 and move[p].get(c) == q:
        move[p][c] = new
        p = link[p]
    return new
