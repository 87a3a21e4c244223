"""Token counts, lexical search and periodic runs: libraries, brute force, and the awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rosterloom.llm")
from rosterloom.llm import language, lexical, packing, periodic, tokencount  # noqa: E402
from rosterloom.llm.common import table  # noqa: E402
from rosterloom.llm.queries import QUERIES, tokenizer_paths  # noqa: E402
from tests.llm.test_operators import SCHEMA, prose, rows  # noqa: E402

PATH = tokenizer_paths()["path"]
PARTS = ["'s", "'re", "'ve", "'ll", "'l", "'r", "'", "''", " ", "  ", "\n", "\n\n", "\t", " ", "　", "<|endoftext|>", "<|endof", "<", "|>", "a", "aaa", "the", " the", "123", "é", "日本", "語", "🙂", "'S", "!", "...", "----", "\x00", "\x85", "x" * 50, "²", "٣", "​", "́", "word", "re", "ll"]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_transducer_counts_as_the_library(library):
    r, m = random.Random(4), tokencount.machine(PATH)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2FFF), r.randint(97, 122), r.randint(0x4E00, 0x9FFF)])) for _ in range(r.randint(0, 60))) for _ in range(1000)]
    for t in texts:
        assert tokencount.walk(m.start, t)[1] == library(t), t
    before = len(m.states)
    m.clear()
    assert len(m.states) == 1 < before and tokencount.walk(m.start, texts[0])[1] == library(texts[0])


def test_state_maps_compose_at_any_cut(library):
    r, m = random.Random(5), tokencount.machine(PATH)
    for k in range(150):
        text = "".join(r.choice(PARTS) for _ in range(30)) if k % 3 else r.choice(["a", "-", "ab", " ", "<|endoftext|>", "日本"]) * 200
        size, halo = r.randint(1, 20), r.choice([0, 3, 128])
        cuts = range(0, len(text), size)
        states = [[m.start] if c == 0 else tokencount.entries(m, text[max(0, c - halo) : c]) for c in cuts]
        maps = [(n, {e: (s, t, -1) for e, s, t in tokencount.state_map(own, text[c : c + size], 4)}) for n, (c, own) in enumerate(zip(cuts, states, strict=True))]
        while True:
            blocks = [tokencount.compose(maps[b : b + 5], maps[b][1]) for b in range(0, len(maps), 5)]
            state, n, lacking = tokencount.compose([(5 * b, x) for b, x in enumerate(blocks)], [tokencount.told(m.start)])[tokencount.told(m.start)]
            if lacking < 0:
                break
            own = tokencount.state_map([tokencount.read(m, state)], text[cuts[lacking] : cuts[lacking] + size])
            maps[lacking][1].update({e: (s, t, -1) for e, s, t in own})
        assert n == library(text) and state == tokencount.told(tokencount.walk(m.start, text)[0])


@pytest.mark.parametrize(("chunk", "halo"), [(65_536, 128), (3000, 128), (150, 0)])
def test_token_counts(spark, sf_dir, library, chunk, halo):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("length(text) < 9000")
    if halo == 0:  # a round for each lacking state
        docs = spark.createDataFrame([(0, "aaaaab" * 130), (1, "日本語" * 120), (2, "x " * 300), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(docs, PATH, chunk=chunk, halo=halo).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), n := library(r.text), n > 1024) for r in docs.collect()}


def test_token_counts_of_awkward_rows(messy, empty, library):
    docs = messy.withColumn("n_tokens", messy["doc_id"])
    out = tokencount.count(docs, PATH, chunk=5000)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "score", "_words", "size", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == sorted((r[0], library(r[1])) for r in rows())
    assert tokencount.count(empty, PATH).count() == 0


def test_token_counts_refuse_other_tokenizers():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokencount.Machine(public_tokenizers.path("word_bpe_49k.json"))


def _search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))

    held = [(d, c, sum(c.values())) for d, t in docs if (c := Counter(terms(t)))]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            found += [(-s, d is None, d if d is not None else 0, d)] if s > 0 else []
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_lexical_search_matches_brute_force(spark, monkeypatch, k):
    r = random.Random(k)
    docs = [(d, prose(r.choice([1, 3, 20, 60]), r.randrange(300))) for d in range(400)] + [(500 + d, "Ünï BAN ban bake") for d in range(60)] + [(7, None), (8, "!"), (None, "ban ünï")]
    items = [(i, prose(r.choice([1, 2, 6, 12]), i)) for i in range(25)] + [(90, "ban ban BAN"), (91, "ünï"), (92, None), (93, "..."), (94, "nowhere"), (90, "ban ban BAN")]
    monkeypatch.setattr(lexical, "LEAF", 4)
    for most in (20_000, 40):
        got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, most)
        assert sorted(map(tuple, got.collect()), key=repr) == _search(docs, items, k)


def test_tree_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    n, size = 3000, 50
    counts = r.integers(1, 12, n)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    terms = np.concatenate([np.sort(r.choice(size, c, replace=False)) for c in counts])
    tfs, m = r.integers(1, 9, offsets[-1]), r.integers(75, 500, n)
    tree = lexical.Tree(m, np.arange(n), offsets, terms, tfs, size, 16)
    w = np.zeros(size, np.int64)
    w[[1, 9, 44]] = [900, 4000, 12]
    own = np.add.reduceat(w[terms] * lexical.part(tfs, np.repeat(m, counts)), offsets[:-1])
    best = np.lexsort((np.arange(n), -own))[:20]
    docs, scores = tree.search(np.array([1, 9, 44]), w[[1, 9, 44]])
    assert docs.tolist() == best.tolist() and scores.tolist() == own[best].tolist()
    in_tree = own[tree.docs]
    for a, lo, hi in zip(tree.most @ w, tree.lo, tree.hi, strict=True):
        assert in_tree[lo:hi].max() <= a
    leaves = [k for k, (a, b) in enumerate(tree.children) if a == b]
    assert sorted((tree.lo[k], tree.hi[k]) for k in leaves)[0][0] == 0 and sum(tree.hi[k] - tree.lo[k] for k in leaves) == n and len(leaves) > 50


def test_lexical_search_of_awkward_rows(spark, messy, empty):
    items = messy.withColumnRenamed("doc_id", "item_id")
    got = sorted(map(tuple, lexical.search(messy, items).collect()), key=repr)
    want = _search([r[:2] for r in rows()], [r[:2] for r in rows()], 20)
    assert [(i, k, s) for i, k, _, s in got] == [(i, k, s) for i, k, _, s in want]
    assert lexical.search(empty, items).count() == lexical.search(messy, empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def _runs(w: list, least: int) -> list[tuple]:
    best: dict = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for t in range(150):
        docs = [[r.choice("ab" if t % 3 else "abc") for _ in range(r.choice([0, 1, 2, 5, 13, 30, 60]))] for _ in range(5)]
        docs += [[*"ab" * 20, "c", *["x"] * 30, *"ab" * 20], ["x"] * 40] if t % 4 == 0 else []
        got = periodic.runs_of(pa.array([x for d in docs for x in d], pa.large_string()), np.array([len(d) for d in docs]), least)
        assert [got.get(k, []) for k in range(len(docs))] == [_runs(d, least) for d in docs]


def test_runs_of_very_long_texts():
    for doc, want in ((["x"] * 100_000, [(0, 100_000, 1)]), ([*"ab" * 50_000, "c"], [(0, 100_000, 2)]), ([w for k in range(20_000) for w in (f"u{k}", *"abcdefg")], [])):
        assert periodic.runs_of(pa.array(doc, pa.large_string()), np.array([len(doc)]), 12).get(0, []) == want


def _looped(doc_id: int, words: list) -> list:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_query_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = _looped(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        found = _runs(words, 12)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None,) * 3)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(words) if i not in gone).encode()).hexdigest()


def test_periodic_runs_of_awkward_rows(messy, empty):
    out = periodic.periodic_runs(messy.withColumn("runs", messy["doc_id"]))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "score", "_words", "size", "n_words", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == messy.count()
    by_id = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by_id[14].runs] == [(0, 100, 1)] and by_id[14].collapsed == "x" and by_id[3].collapsed == by_id[4].collapsed == by_id[5].collapsed == ""
    assert [tuple(x) for x in by_id[11].runs] == [(0, 80, 2)]
    assert periodic.periodic_runs(empty).count() == 0
    null_ids = messy.selectExpr("cast(null as long) as doc_id", "text")
    assert periodic.periodic_runs(periodic.with_loops(null_ids)).count() == messy.count()


def test_curve_spreads_texts_of_any_length(spark, sf_dir):
    """Few documents lie at an edge of the cube, long ones as little as short ones, and neighbours along the curve are more alike than chance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("length(text) > 200")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", "repeat(concat(text, ' '), 40) as text"))
    got = packing.tokenized(docs, **tokenizer_paths()).collect()
    points = np.array([[r[x] for x in packing.AXES] for r in got])
    cuts = packing.axis_cuts(spark.createDataFrame([tuple(map(float, p)) for p in points], "x0 double, x1 double, x2 double"))
    cells = np.column_stack([np.searchsorted(c, points[:, k], side="right") for k, c in enumerate(cuts)])
    size = np.array([r.tokens for r in got])
    edge = ((cells < 8) | (cells > 1015)).any(axis=1)
    assert edge.mean() < 0.1 and edge[size > 5000].mean() < 0.15 and (size > 5000).sum() > 30
    # forty repeats of a text point where the text does
    first = {r.doc_id: p for r, p in zip(got, points, strict=True)}
    assert max(np.abs(p - first[d - 100000]).max() for d, p in first.items() if d >= 100000) < 0.3
    vectors = np.zeros((len(got), 50_257), np.float32)
    for k, r in enumerate(got):
        np.add.at(vectors[k], np.frombuffer(r.ids, "<u2"), 1)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(packing.curve_key(points, cuts))
    beside = (vectors[order[1:]] * vectors[order[:-1]]).sum(axis=1).mean()
    chance = (vectors @ vectors.mean(axis=0)).mean()
    assert beside > chance + 0.05


def test_long_words_are_scored_whole(monkeypatch):
    assert language.split_words("x" * 5000) == ["x" * 5000]
    keys = np.sort(np.unique(language.gram_hashes([a + b for a in " ab" for b in " ab"] + list(" ab"))))
    model = language.Model(("l",), [keys], [-1.0 - np.arange(len(keys)) / 7], [np.full(len(keys), -0.3)])
    words = ["ab" * 400, "b", "a" * 301]
    whole = model.words(words)
    monkeypatch.setattr(language, "PART", 50)
    assert model.words(words) == pytest.approx(whole) and whole.shape == (3, 1)
