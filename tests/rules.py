"""Rules stated in plain Python, to compare with."""

from itertools import groupby


def is_gap(c):
    return c == "-" or c.isspace()


def file_name(text, n=80):
    """Letters, digits and '_' stay, runs of white space or '-' become one '_'."""
    kept = [c for c in text if c.isalnum() or c == "_" or is_gap(c)]
    runs = ("_" if gap else "".join(run) for gap, run in groupby(kept, is_gap))
    return "".join(runs)[:n]
