"""Small sequential models that the Spark jobs are compared with."""

from __future__ import annotations


def sequential_bucket(requests, period_ms):
    """``(ms, amount, limit)`` of one account in order -> admitted flags and levels in units."""
    level, last, out = None, None, []
    for ms, amount, limit in requests:
        if amount <= 0:
            out.append((True, None))
            continue
        if amount > limit:
            out.append((False, None))
            continue
        full = limit * period_ms
        level = full if level is None else min(full, level + max(ms - last, 0) * limit)
        last = ms
        ok = level >= amount * period_ms
        if ok:
            level -= amount * period_ms
        out.append((ok, level))
    return out


def sequential_ledger(rows, size):
    """``(pk, key)`` rows -> class per pk, going batch by batch through a set of claimed keys."""
    claimed, result = set(), {}
    ordered = sorted(rows)
    for start in range(0, len(ordered), size):
        for pk, key in ordered[start:start + size]:
            text = None if key is None else key.strip().lower() or None
            if text is None:
                result[pk] = "missing_key"
            elif text in claimed:
                result[pk] = "duplicate"
            else:
                claimed.add(text)
                result[pk] = "unique"
    return result


def keyset_batches(keys, size):
    ordered = sorted(keys)
    return [(i // size, ordered[i], ordered[min(i + size, len(ordered)) - 1],
             len(ordered[i:i + size])) for i in range(0, len(ordered), size)]
