"""Plain Python versions of operators, for small inputs."""

import bisect
import itertools
import re


def count(text):
    return len(text.split())


def cut(text, size):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def pack(text, separators, size, hard_split=True):
    """Greedy packing: bisect for the longest run of pieces that fits, again and again."""
    chunks = [text]
    for separator in separators:
        chunks = [
            c
            for chunk in chunks
            for c in (
                runs(chunk.split(separator), separator, size, hard_split)
                if count(chunk) > size
                else [chunk.strip()]
            )
        ]
    whole = itertools.chain.from_iterable(
        [c] if count(c) <= size else cut(c, size) for c in chunks
    )
    return [c for c in whole if c]


def runs(pieces, separator, size, hard_split):
    head = ""

    def first(n):
        taken = list(itertools.dropwhile(lambda p: p == "", [head, *pieces[:n]]))
        return separator.join(taken)

    while pieces:
        fitting = bisect.bisect_right(range(len(pieces) + 1), size, key=lambda n: count(first(n)))
        n = max(fitting - 1, 0)
        yield first(n).strip()
        if n == len(pieces):
            return
        tail = [pieces[n]]
        if hard_split and count(pieces[n]) > size:
            tail = cut(pieces[n], size)
        yield from tail[:-1]
        head, pieces = tail[-1].strip(), pieces[n + 1 :]
    yield head


def page_windows(pages, size):
    """Word windows over (page_no, text) pairs joined in page order."""
    words = "".join(t or "" for _, t in sorted(pages, key=lambda p: p[0])).split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def clean(text):
    for noise in (r"</?s>", r"/g\d+", r"\b\d+\s+of\s+\d+\b"):
        text = re.sub(noise, "", text)
    return " ".join(text.split())
