"""Joins by names at large distances, and phonetic keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import scalars
from rosterloom.operators import fuzzy, space


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _names(n, seed, letters="abcdefghijkl ", longest=60):
    r = random.Random(seed)
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]
    for t in made[: n // 2]:  # near copies, by letters changed, left out, put in and swapped
        u = list(t)
        for _ in range(r.randint(1, 14)):
            k = r.randrange(len(u) + 1)
            how = r.randrange(4)
            if how == 0:
                u.insert(k, r.choice(letters))
            elif k < len(u) and how == 1:
                del u[k]
            elif k < len(u) and how == 2:
                u[k] = r.choice(letters)
            elif k + 1 < len(u):
                u[k], u[k + 1] = u[k + 1], u[k]
        made.append("".join(u))
    return sorted({*made, "", "a", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ñ𝒶" * 9})


@pytest.mark.parametrize("most, transpositions", [(5, False), (12, False), (24, False), (1, True), (6, True)])
def test_gram_pairs_equal_brute_force(spark, most, transpositions):
    xs, ys = _names(90, 1), sorted({*_names(60, 2), *_names(90, 1)[::3]})
    frame = lambda v, c: spark.createDataFrame([(t,) for t in [*v, v[0], None]], f"{c} string")
    distances = fuzzy.damerau_distances([(a, b) for a in xs for b in ys]) if transpositions else [_levenshtein(a, b) for a in xs for b in ys]
    want = [(*p, int(d)) for p, d in zip(((a, b) for a in xs for b in ys), distances, strict=True) if d <= most]
    got = [tuple(r) for r in fuzzy.gram_pairs(frame(xs, "s"), frame(ys, "t"), "s", "t", most, transpositions).collect()]
    assert sorted(got) == sorted(want) and any(0 < d for *_, d in want)


def test_gram_pairs_by_block_and_empty(spark):
    xs = _names(40, 3)
    df = spark.createDataFrame([(k % 3, t) for k, t in enumerate(xs)], "text int, s string").withColumn("n", F.lit("more"))
    want = sorted((j % 3, a, b, d) for i, a in enumerate(xs) for j, b in enumerate(xs) if i % 3 == j % 3 and (d := _levenshtein(a, b)) <= 12)
    assert sorted(tuple(r) for r in fuzzy.gram_pairs(df, df, "s", "s", 12, block=["text"]).collect()) == want
    assert fuzzy.gram_pairs(df.limit(0), df, "s", "s", 12, block=["text"]).count() == 0


def test_gram_pairs_try_few_pairs(spark):
    """Unlike texts of 50 letters hardly meet at 12 edits: the filters leave a small share of all pairs to the distance."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    asked = spark.sparkContext.accumulator(0)

    def counted(a, b, most):
        @F.udf("int")
        def run(x, y):
            asked.add(1)
            return _levenshtein(x, y)

        return run(a, b)

    plain, fuzzy.F.levenshtein = fuzzy.F.levenshtein, counted
    try:
        assert fuzzy.gram_pairs(df, df, "s", "s", 12).count() == 300
    finally:
        fuzzy.F.levenshtein = plain
    assert 300 <= asked.value < 0.02 * 300 * 300


def test_texts_that_are_all_alike_are_compared_without_pieces(spark, monkeypatch):
    """Addresses meet several times for each pair there is: no sets of pieces are built for the pairs."""
    r = random.Random(3)
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['www.', 'm.', ''])}th{r.choice(['an', 'ering', 'st'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de'])}/{r.randrange(10**5)}{r.choice(['', '#top', '?page=2&ref=x'])}" for _ in range(120)]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "s string")
    monkeypatch.setattr(fuzzy, "TILE", 50)
    monkeypatch.setattr(fuzzy.F, "array_intersect", lambda *_: pytest.fail("pairs are made by pieces"))
    got = sorted(tuple(p) for p in fuzzy.gram_pairs(df, df, "s", "s", 12).collect())
    assert got == sorted((a, b, _levenshtein(a, b)) for a in set(urls) for b in set(urls) if _levenshtein(a, b) <= 12)


@pytest.mark.parametrize(("most", "transpositions"), [(5, False), (12, False), (6, True)])
def test_tiles_equal_brute_force(spark, monkeypatch, most, transpositions):
    """Blocks, nulls, empty texts, texts around and over 64 letters, letters of four bytes."""
    monkeypatch.setattr(fuzzy, "DENSE", -1.0)
    monkeypatch.setattr(fuzzy, "TILE", 20)
    monkeypatch.setattr(fuzzy, "AT_ONCE", 100)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abé😀") for _ in range(r.choice([0, 3, 7, 30, 62, 64, 66, 70])))
    x = [(r.choice("uv"), word()) for _ in range(50)] + [("u", None), ("w", "a")]
    y = [(g, t[:3] + t[5:] + "ab") for g, t in x[:50]] + [(r.choice("uv"), word()) for _ in range(20)] + [("u", None), (None, "a")]
    d = fuzzy._damerau if transpositions else _levenshtein
    want = sorted((g, a, b, d(a, b)) for g, a in set(x) for h, b in set(y) if g == h and a is not None and b is not None and d(a, b) <= most)
    left, right = spark.createDataFrame(x, "g string, a string"), spark.createDataFrame(y, "g string, b string")
    assert sorted(tuple(p) for p in fuzzy.gram_pairs(left, right, "a", "b", most, transpositions, ["g"]).collect()) == want


def test_fuzzy_left_join_at_a_large_distance(spark):
    x = spark.createDataFrame([(1, "comunidad campesina de san pedro de cachora"), (2, "q"), (3, None)], "i int, n string")
    y = spark.createDataFrame([(7, "cc san pedro de cachora"), (8, "san pedro de cachora, comunidad"), (9, "comunidad campesina san pedro cachora")], "j int, n string")
    got = sorted(((r.i, r.j, r.distance) for r in fuzzy.fuzzy_left_join(x, y, "n", 24).collect()), key=repr)
    near = sorted(((i, j, _levenshtein(a, b)) for i, a in [(1, x.first().n), (2, "q")] for j, b in [(r.j, r.n) for r in y.collect()] if _levenshtein(a, b) <= 24), key=repr)
    assert got == sorted([*near, (3, None, None)], key=repr) and (1, 9, 6) in got


def test_places_are_resolved_at_large_distances(spark):
    x = spark.createDataFrame([(1, 10101_00001, "caserio nuevo progreso alto"), (2, 10101_00002, "xyz")], "r int, p long, n string")
    ref = spark.createDataFrame([(5, 10101_00009, "nuevo progreso", 0.0, 0.0), (6, 20202_00009, "caserio nuevo progreso alto", 0.0, 0.0)], "id int, p long, n string, x double, y double")
    got = sorted(tuple(r) for r in space.resolve_places(x, ref, "r", "p", "n", "id", "x", "y", steps=((2, 6), (12, 6), (24, 6))).collect())
    assert _levenshtein("caserio nuevo progreso alto", "nuevo progreso") == 13 and got == [(1, 5, 3), (2, 5, 3)]


SOUNDS = {
    "Knight": "NT", "phone": "FN", "School": "SKL", "write": "RT", "character": "XRKTR", "edge": "EJ", "nation": "NXN", "Xavier": "SFR", "whiskey": "WSK",
    "thumb": "0M", "science": "SNS", "sign": "SN", "signed": "SNT", "aeroplane": "ERPLN", "José": "JS", "Quispe": "KSP", "Huamán": "HMN", "match": "MX", "laugh": "LK",
    "Ahlberg": "ALBRK", "year": "YR", "boxwood": "BKSWT", "Vásquez": "FSKS", "dumb": "TM", "accent": "AKSNT", "Ghost": "KST", "night": "NT", "session": "SXN",
    "O'Higgins": "OHKNS", "": "", "123": "", "Ñuñoa": "NN",
}


def test_metaphone_of_known_names(spark):
    df = spark.createDataFrame([(k,) for k in [*SOUNDS, None]], "n string")
    got = {r[0]: r[1] for r in df.select("n", scalars.metaphone(F.col("n"))).collect()}
    assert got == {**SOUNDS, None: None}


def _sounds(name):
    """Metaphone read letter by letter, with a look at the neighbours."""
    w = "".join(c for k, c in enumerate(name) if c in "CG" or k == 0 or name[k - 1] != c)
    out, k = "", 0
    if w.startswith("AE") or w[:2] in ("GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w.startswith("WH"):
        w = "W" + w[2:]
    if w.endswith("MB"):
        w = w[:-1]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    vowel = lambda i: at(i) != "" and at(i) in "AEIOU"
    while k < len(w):
        c, n, step = w[k], at(k + 1), 1
        if c in "AEIOU":
            out += c if k == 0 else ""
        elif c == "X":
            out += "S" if k == 0 and name.startswith("X") else "KS"
        elif w.startswith("SCH", k):
            out, step = out + "SK", 3
        elif w.startswith("TCH", k):
            out, step = out + "X", 3
        elif c == "C" and w.startswith("CIA", k):
            out += "X"
        elif c == "C" and n == "H":
            out, step = out + "X", 2
        elif c == "S" and n == "C" and at(k + 2) and at(k + 2) in "EIY" and not w.startswith("CIA", k + 1):
            out, step = out + "S", 2
        elif c == "C" and n and n in "EIY":
            out += "S"
        elif c == "C":
            out, step = out + "K", 2 if n == "K" else 1
        elif c == "D" and n == "G" and at(k + 2) and at(k + 2) in "EIY":
            out, step = out + "J", 2
        elif c == "D":
            out += "T"
        elif c == "G" and n == "G":
            out, step = out + "K", len(w[k:]) - len(w[k:].lstrip("G"))
        elif c == "G" and n == "H":
            out, step = out + ("K" if vowel(k + 2) or k + 2 == len(w) else ""), 2
        elif c == "G" and w[k:] in ("GN", "GNED"):
            pass
        elif c == "G":
            out += "J" if n and n in "EIY" else "K"
        elif c in "TS" and n == "I" and at(k + 2) and at(k + 2) in "AO":
            out += "X"
        elif c in "TSP" and n == "H":
            out, step = out + {"T": "0", "S": "X", "P": "F"}[c], 2
        elif c in "HWY":
            out += c if vowel(k + 1) else ""
        else:
            out += {"Q": "K", "V": "F", "Z": "S"}.get(c, c)
        k += step
    return out


def test_metaphone_equals_a_plain_reading(spark):
    r = random.Random(8)
    pieces = "SCH TCH CIA CH SCE SCI CK GH GN GNED DGE TIO TIA TH SIO SH PH WH WR KN MB AE X H W Y".split() + list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    names = sorted({"".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(3000)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", scalars.metaphone(F.col("n"))).collect()}
    wrong = {n: (got[n], _sounds(n)) for n in names if got[n] != _sounds(n)}
    assert not wrong, dict(list(wrong.items())[:20])
