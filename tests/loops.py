"""Plain forms of the sequence operators, written from their definitions, to test against."""

import math
import re
from bisect import bisect_left
from itertools import groupby


def lengths(labels):
    """(value, length) of the stretches of equal labels."""
    return [(value, sum(1 for _ in group)) for value, group in groupby(labels)]


def spread(stretches):
    return [value for value, n in stretches for _ in range(n)]


def runs_of(labels):
    """(value, first, last)."""
    ends = [sum(n for _, n in lengths(labels)[:i + 1]) for i in range(len(lengths(labels)))]
    return [(value, end - n, end - 1) for (value, n), end in zip(lengths(labels), ends)]


def taken_value(stretches, i):
    """What a short stretch becomes: the value of its longer neighbour, the left one if equal; a lone one stays."""
    near = [(stretches[j][1], -j, stretches[j][0]) for j in (i - 1, i + 1) if 0 <= j < len(stretches)]
    return max(near)[2] if near else stretches[i][0]


def merge_leftmost(labels, min_run):
    """One short stretch at a time, the first one, until none is left or all is one stretch."""
    now = lengths(labels)
    while len(now) > 1 and any(n < min_run for _, n in now):
        first = [n < min_run for _, n in now].index(True)
        changed = [*now[:first], (taken_value(now, first), now[first][1]), *now[first + 1:]]
        now = lengths(spread(changed))
    return spread(now)


def merge_together(labels, min_run, passes=10):
    """All short stretches at once, from the stretches as they were; again on the result."""
    now = lengths(labels)
    for _ in range(passes):
        now = lengths(spread([(value if n >= min_run else taken_value(now, i), n) for i, (value, n) in enumerate(now)]))
    return spread(now)


def _stretches(pattern, labels):
    return list(re.finditer(pattern, "".join(map(str, labels))))


def cycles_between_reds(labels):
    """Stretches without 0 right after a 0 that hold a 2."""
    return [(m.start(), m.end() - 1) for m in _stretches("(?<=0)[12]+", labels) if "2" in m.group()]


def cycles_of_green(labels, min_run):
    return [(m.start(), m.end() - 1) for m in _stretches("2+", labels) if len(m.group()) >= min_run]


def smooth_states(states, n, initial=None):
    """At each place the state of the last n equal ones in a row so far."""
    accepted = [states[i] if i + 1 >= n and len(set(states[i + 1 - n:i + 1])) == 1 else None for i in range(len(states))]
    return [next((s for s in reversed(accepted[:i + 1]) if s is not None), initial or states[0]) for i in range(len(states))]


def windows_of(times, size, overlap, min_rows):
    """(start, first row, last row, rows) of the kept windows of one log, times in ascending seconds.

    Window k is [t0 + k step, + size); the last k is the last that starts in the log, and not after the first
    one that reaches a step short of the end.
    """
    step, length = size * (1 - overlap), times[-1] - times[0]
    last = min(math.floor(length / step), max(0, math.ceil((length - overlap * size) / step)))
    spans = [(times[0] + k * step, bisect_left(times, times[0] + k * step), bisect_left(times, times[0] + k * step + size)) for k in range(last + 1)]
    return [(start, low, high - 1, high - low) for start, low, high in spans if high - low >= min_rows]
