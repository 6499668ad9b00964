"""Brute-force sequential greedy walk used to check the distributed rounds."""

from __future__ import annotations


def sequential_emerging(points: list[dict], stop_words, min_frequency: int) -> list[tuple[str, int, list[str]]]:
    """Brute-force sequential greedy walk (test oracle for small fixtures).

    ``points`` are dicts with ``id`` and ``text`` in signal order.
    """
    import re

    stops = set(stop_words)
    seen_order: dict[str, list[int]] = {}
    for i, pnt in enumerate(points):
        t = re.sub(r"\[(?:ssn|cc|email|phone) redacted\]", " ", pnt["text"], flags=re.I)
        toks = [w for w in re.findall(r"[a-z0-9]+", t) if len(w) > 2 and w not in stops]
        grams = [f"{toks[j]} {toks[j + 1]}" for j in range(len(toks) - 1)]
        grams += [f"{toks[j]} {toks[j + 1]} {toks[j + 2]}" for j in range(len(toks) - 2)]
        for g in dict.fromkeys(grams):
            seen_order.setdefault(g, []).append(i)
    ranked = sorted((kv for kv in seen_order.items() if len(kv[1]) >= min_frequency), key=lambda kv: -len(kv[1]))
    claimed: set[int] = set()
    out = []
    for g, idx in ranked:
        free = [i for i in idx if i not in claimed]
        if len(free) < min_frequency:
            continue
        claimed.update(free)
        out.append((g, len(free), [points[i]["id"] for i in free]))
    return out
