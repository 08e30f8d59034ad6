"""A plain sequential reading of the message rules, one message at a time.

Used on small random inputs to check the distributed operators.
"""

import math
from collections import OrderedDict

MINUTE = 60_000


class Attempt:
    def __init__(self, arr, ts):
        self.created, self.first, self.last, self.points = arr, ts, ts, {}


def read(messages, *, max_attempts=100, length_ms=None, width=MINUTE):
    """(counted arrival numbers, {job: OrderedDict(attempt → Attempt)})."""
    jobs, counted = {}, []
    for m in sorted(messages, key=lambda m: m["arr"]):
        if not m["attempt_id"] or m["job_id"] is None:
            continue
        known = jobs.setdefault(m["job_id"], OrderedDict())
        attempt = known.get(m["attempt_id"])
        if attempt is None:
            if not m["enabled"]:
                known.clear()
                continue
            attempt = known[m["attempt_id"]] = Attempt(m["arr"], m["ts"])
            while len(known) > max_attempts:
                known.popitem(last=False)
        if m["ts"] < attempt.last:
            continue
        attempt.last = m["ts"]
        counted.append(m["arr"])
        if m["is_worker"]:
            bucket = m["ts"] - m["ts"] % width
            attempt.points[bucket] = max(m["load"], attempt.points.get(bucket, -math.inf))
            if length_ms is not None:
                newest = max(attempt.points)
                attempt.points = {
                    b: v for b, v in attempt.points.items() if newest - b <= length_ms
                }
    return counted, {j: known for j, known in jobs.items() if known}


def resize(size, target, limits):
    mb, cores, count = size
    total = target * count
    limit = min(count * limits.per_container, limits.per_job)
    if total > limit:
        total = max(cores * count, limit)
    return mb, max(int(total / count), 1), count


def decide(attempt, size, policies, limits, *, width=MINUTE, delay=30_000):
    """The (type, size) of the first policy that wants a change, or None.

    A policy is (type, window, is_up, trigger, margin).
    """
    for kind, window, is_up, trigger, margin in policies:
        if not attempt.points:
            continue
        last = max(attempt.points)
        length = window // width * width
        inside = {b: v for b, v in attempt.points.items() if last - length <= b}
        first = min(inside)
        if last == first or last - first < length or first < attempt.first + delay:
            continue
        usage = sum(inside.values()) / len(inside)
        cores = size[1]
        wanted = usage >= cores * trigger if is_up else usage <= cores * trigger
        if not wanted:
            continue
        target = math.ceil(usage * (1 + margin if is_up else 1 - margin))
        new = resize(size, target, limits)
        if new != size:
            return kind, new
    return None
