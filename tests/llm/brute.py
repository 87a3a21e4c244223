"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def line_dedup(docs: list[tuple], min_words: int) -> dict:
    """(doc_id, text) in order → doc_id → text: every run of enough words that occurs earlier is deleted."""
    seen: set[tuple] = set()
    out = {}
    for d, text in docs:
        if text is None:
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(SPACE)]
        gone: set[int] = set()
        for i in range(len(full)):
            for j in range(i + 1, len(full) + 1):
                run = tuple(lines[k] for k in full[i:j])
                if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= min_words:
                    if run in seen:
                        gone.update(range(i, j))
                    seen.add(run)
        keep = []
        for k, x in enumerate(lines):
            before = sum(f <= k for f in full)
            drop = before - 1 in gone if k in full else before - 1 in gone and before in gone
            keep += [] if drop else [x]
        out[d] = "\n".join(keep)
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def jaccard_classes(docs: list[tuple], threshold: float = 0.8) -> dict:
    """(doc_id, text) → doc_id → (class_id, n_links), by all pairs of distinct texts."""
    texts = sorted({t for _, t in docs if shingles(t)})
    sets = [shingles(t) for t in texts]
    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].add(j), links[j].add(i)
    of = {t: i for i, t in enumerate(texts)}
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, ls in enumerate(links):
        for j in ls:
            root[find(i)] = find(j)
    least: dict = {}
    for d, t in docs:
        if t in of:
            r = find(of[t])
            least[r] = min(d, least.get(r, d))
    return {d: (least[find(of[t])], len(links[of[t]])) if t in of else (d, 0) for d, t in docs}


def quality_grams(text: str, n: int) -> list[int]:
    """The buckets of a text's words and of its pairs of words, as ``quality`` hashes them."""
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [h(w.encode()) for w in text.split()]
    # of two values the hash of the first seeds that of the second
    two = [h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"))) for a, b in zip(one, one[1:], strict=False)]
    return [signed(x) % n for x in one + two]


def quality_scores(docs: list[tuple], trusted: set, n: int, prior: float, left_out: bool = False) -> dict:
    """doc_id → mean log ratio; ``left_out``: of trusted documents only, each by the target counts of the others."""
    grams = {d: quality_grams(t, n) for d, t in docs}
    raw, target = Counter(b for bs in grams.values() for b in bs), Counter(b for d in trusted for b in grams[d])
    out = {}
    for d in trusted if left_out else grams:
        t = target - Counter(grams[d]) if left_out else target
        sums = sum(t.values()), sum(raw.values())
        ratio = lambda b: math.log((t[b] + 1) / (sums[0] + n)) - math.log((raw[b] + 1) / (sums[1] + n))  # noqa: E731, B023
        out[d] = sum(map(ratio, grams[d])) / (len(grams[d]) + prior)
    return out
