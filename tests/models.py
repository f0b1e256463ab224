"""Plain models of operators, written from their definitions, to hold results against."""

import re


def overlap(a, b):
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def greedy_duplicates(ids, linked):
    """The first earlier kept id that a row is linked with, in order."""
    kept, out = [], {}
    for i in ids:
        first = next((k for k in kept if linked(k, i)), None)
        out[i] = first
        if first is None:
            kept.append(i)
    return out


def greedy_clusters(rows, threshold):
    """Number of the cluster of each (id, domain, keywords), in order."""
    clusters, out = {}, {}
    for i, domain, words in rows:
        listed = clusters.setdefault(domain, [])
        scores = [overlap(words, c) for c in listed]
        best = max(range(len(listed)), key=lambda n: (scores[n], -n), default=None)
        if best is None or scores[best] < threshold:
            listed.append(set())
            best = len(listed) - 1
        listed[best] |= set(words)
        out[i] = (domain, best)
    return out


def chunks(text, size, lap):
    text, out, start = " ".join(text.split()), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blanks = [m.end() for m in re.finditer(" ", text) if start < m.end() <= end]
            end = blanks[-1] if blanks else end
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end == len(text):
            return out
        start = max(end - lap, 0) if max(end - lap, 0) > start else end
    return out
