"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from glimmer.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    found = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            found[a].append(b)
            found[b].append(a)
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in found.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(found[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(rng, letters, n, longest=12):
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(list(letters), int(rng.integers(7, longest))))
        words.add(word)
        for _ in range(int(rng.integers(4))):
            i = int(rng.integers(len(word) + 1))
            other = [word[:i] + word[i + 1 :], word[:i] + rng.choice(list(letters)) + word[i:], word[:i] + rng.choice(list(letters)) + word[i + 1 :]][int(rng.integers(3))]
            if len(other) >= 7:
                words.add(other)
    return {w: int(2 * 10 ** rng.uniform(0, 4)) for w in sorted(words)}


@pytest.mark.parametrize(("letters", "long_list"), [("ab", 1e-3), ("abc", 0.5), ("aeiouéÿÀ", 0.01)])
def test_variants_are_those_of_all_pairs(spark, letters, long_list):
    counts = vocabulary(np.random.default_rng(3), letters, 250)
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), long_list=long_list)
    assert rows_of(found) == brute(counts)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_grams_an_edit_leaves_alone_are_those_of_both_words(longest):
    """The keys of the two words meet at the place of each edit, and some gram is left alone."""
    rng = np.random.default_rng(longest)
    letters = "abcd"
    some = ["".join(rng.choice(list(letters), q)) for q in range(3, longest + 1) for _ in range(8 ** (q - 1))]
    pairs = {(g[:q], g[: q - 1]) for g in some for q in range(3, len(g) + 1)}  # every gram's beginnings are there too
    grams = spelling.Grams(sorted(pairs), 2, longest)
    matrix = lambda w: np.frombuffer(w.encode(), np.uint8)[None]
    for _ in range(300):
        word = "".join(rng.choice(list(letters), int(rng.integers(2 * longest, 11))))
        edited, put = grams.keys(matrix(word))
        i = int(rng.integers(len(word)))
        other = word[:i] + "z" + word[i + 1 :]
        assert edited[0, i] == grams.keys(matrix(other))[0][0, i]
        more = word[:i] + "z" + word[i:]
        assert put[0, i] == grams.keys(matrix(more))[0][0, i]
        _, kept, first, last = (x[0] for x in grams.decompose(matrix(word)))
        assert all((kept & ((last < k) | (first > k))).any() for k in range(len(word)))


def test_words_of_texts(spark):
    rng = np.random.default_rng(2)
    pool = ["straße", "fenêtres", "Ouverture", "WINDOWS", "x" * 300, "Ähnliche", "a×b÷cdefg", "колесо", "short", "ÿÿÿÿÿÿÿÿ"]
    texts = [(None if k == 3 else k, None if k == 5 else " ".join(rng.choice(pool, 200)) + "—" + "1".join(pool)) for k in range(60)] + [(7, ""), (7, "Windows windows")]
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % 31 == 0 else run] += 1
    wanted = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = spelling.word_counts(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string"), every=31)
    assert {r["word"]: r["n"] for r in found.collect()} == wanted
    assert any(w not in pool and len(w) == 299 for w in wanted) or max(map(len, wanted)) == 300


def test_long_words_ties_short_words_and_empty(spark):
    a = "ab" * 3000
    counts = {a: 100, a[:50] + a[51:]: 2, "wordings": 40, "wordinga": 40, "wordingb": 2, "wording": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = rows_of(spelling.group_variants(df))
    assert found == brute(counts)
    assert found["wordingb"][0] == "wordinga"
    assert rows_of(spelling.group_variants(df.limit(0))) == {}
    with pytest.raises(ValueError, match="letters"):
        spelling.group_variants(spark.createDataFrame([("ab", 2)], "word string, n long"))


def test_query(spark):
    assert queries.op11_spelling_variants(spark, "/root/testdata/sf0.001").where("form is not null").count() > 0
