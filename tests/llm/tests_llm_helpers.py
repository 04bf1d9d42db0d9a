"""Plain-Python versions that several tests use."""

import hashlib


def key_hash(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def targets(sizes):
    """Source -> target by filling up again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        weights = sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= weight[s] * rest / weights}
        if not over or not weights:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * rest / weights for s in names}
        capped |= over
        if len(capped) == len(names):
            return {s: float(3 * sizes[s]) for s in names}


def mixed(rows):
    """doc_id -> copies for rows of (doc_id, source, size) with distinct ids: by hash order, to the nearest of the boundary."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes), {}
    for s, total in sizes.items():
        rounds = int(goal[s] // total) if total else 0
        left = goal[s] - rounds * total
        for _, i, n in sorted((key_hash(i), i, n) for i, x, n in rows if x == s):
            more = left > 0 and (n <= left or 2 * left > n)
            out[i] = rounds + more
            left = left - n if n <= left else -1
    return out
