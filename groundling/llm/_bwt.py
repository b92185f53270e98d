"""Common prefixes of at least a given length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

GAP = 0  # ends every text; bytes are shifted up by one


def suffix_order(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``least`` symbols at least, the first place of its equals for each) by prefix doubling; settled suffixes take no further part."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.append(symbols + 1, np.zeros(7, np.int16))  # less than any symbol past the end
    for j in range(7):
        key = key << 9 | padded[j : n + j]
    sa = np.argsort(key).astype(np.int32)
    new = np.ones(n, dtype=bool)
    new[1:] = key[sa][1:] != key[sa][:-1]
    slot = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    step = 7
    while step < least:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        p = sa[at]
        after = np.where(p + step < n, rank[np.minimum(p + step, n - 1)] + 1, 0)
        key = (rank[p].astype(np.int64) << 32) | after
        order = np.argsort(key)
        key = key[order]
        sa[at] = p[order]
        new[at[1:]] |= key[1:] != key[:-1]
        rank[sa[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        step *= 2
    return sa, rank


def long_prefixes(texts: list[bytes], least: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For every text the sorted starts of strings of ``least`` bytes that occur again in any of ``texts``.

    The lengths of common prefixes of neighbouring suffixes are found by increasing value: a
    boundary of value l, extended backward by each character before it, gives the
    boundaries of value l + 1. Expansion stops at ``least``; neighbours without a
    boundary by then share that much. While boundaries are many, all are extended in one sweep; later only their own
    runs of the transform are visited. ``texts`` are distinct; one of ``times`` 2 is there twice: its suffixes, sorted once, have two rows each in the transform.
    """
    size = np.array([len(t) for t in texts], np.int64)
    bound = np.concatenate([[0], np.cumsum(size + 1)])
    n = int(bound[-1])
    symbols = np.full(n, GAP, np.int16)
    inside = np.ones(n, dtype=bool)
    inside[bound[1:] - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    sa, rank = suffix_order(symbols, least)
    copies = np.repeat(np.ones(len(texts), np.int64) if times is None else np.array(times, np.int64), size + 1)[sa]
    row = np.cumsum(copies) - copies  # the first row of each
    sa = np.repeat(sa, copies)
    n = len(sa)
    bwt = symbols[sa - 1]
    bwt[sa == 0] = 300  # before the first suffix stands nothing
    target = row[rank[sa - 1]].astype(np.int32)  # where extending a place backward leads: the first of those that share ``least`` symbols
    target[sa == 0] = 0
    order = np.argsort(bwt, kind="stable").astype(np.int32)  # by character, then place
    same = np.zeros(n, dtype=bool)
    same[1:] = bwt[order][1:] == bwt[order][:-1]
    before = np.full(n, -1, np.int32)  # place of the same character's previous occurrence
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    target_in_order = target[order]
    run = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1]).astype(np.int32)
    run_of = np.repeat(np.arange(len(run), dtype=np.int32), np.diff(np.append(run, n)))
    found = np.zeros(n, dtype=bool)  # boundaries so far
    head = np.ones(n, dtype=bool)
    head[1:] = symbols[sa][1:] != symbols[sa][:-1]
    found |= head
    last = np.flatnonzero(head)
    after = None  # the next boundary after each place, as it was when last taken; ``recent`` has those found since
    recent = np.zeros(0, np.int64)
    for _ in range(1, least):
        if len(last) > n // 64:
            mark = np.zeros(n, np.int32)
            mark[last] = 1
            upto = np.cumsum(mark, dtype=np.int32)[order]
            hit = np.zeros(n, dtype=bool)
            hit[1:] = same[1:] & (upto[1:] > upto[:-1])
            reach = target_in_order[hit]
            after = None
        else:
            if after is None or len(recent) + len(last) > n // 16:
                bounds = np.append(np.flatnonzero(found), n).astype(np.int32)  # the first place is always one
                after, recent = np.repeat(bounds[1:], np.diff(bounds)), recent[:0]
            else:
                recent = np.sort(np.concatenate([recent, last]))
            # a boundary's characters are those before the next one: beyond it they are the next one's
            stop = after[last]
            if len(recent):
                stop = np.minimum(stop, np.append(recent, n)[np.searchsorted(recent, last, "right")])
            more = run_of[stop - 1] - run_of[last]
            start = np.concatenate([last, np.repeat(last, more)])
            at = np.concatenate([last, run[np.repeat(run_of[last] + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())]])
            back = before[at]
            reach = target[at[(back < start) & (back >= 0)]]
        reach = reach[~found[reach]]
        reach.sort()
        last = reach[np.append(True, reach[1:] != reach[:-1])] if len(reach) else reach
        found[last] = True
        if not len(last):
            break
    joined = np.flatnonzero(~found)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[sa[joined]] = True
    repeated[sa[joined - 1]] = True
    return [np.flatnonzero(repeated[bound[i] : max(bound[i], bound[i] + size[i] - least + 1)]) for i in range(len(texts))]
