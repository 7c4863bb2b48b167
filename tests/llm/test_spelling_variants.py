"""Near words and their forms against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codegrove.llm import queries
from codegrove.llm import spelling_variants as V
from codegrove.llm.arrays import Chunk


def plain_words(rows, s):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % s.period == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= s.letters and n >= s.least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, s):
    out = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= s.ratio * n else None
        out[w] = [n, len(others), form, None if form is None else words[form]]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed,parts,letters", [(1, 4, 7), (2, 3, 2), (3, 6, 3)])
def test_random_words(spark, seed, parts, letters):
    """Words over few letters, so that many share their letters and nearly share their halves."""
    rng = random.Random(seed)
    s = V.Settings(parts=parts, letters=letters)
    words = {}
    for _ in range(700):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(letters, letters + 4)))
        words[w] = rng.choice([2, 3, 25, 300, 4000])
    found = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(V.variants(found, s)) == plain_variants(words, s)


def test_chains_of_forms(spark):
    words = {"abcdefgh": 2, "abcdefgx": 20, "abcdefxx": 200, "abcdexxx": 2000, "abcdexxxx": 20000, "zzzzzzzz": 5}
    got = as_dict(V.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words, V.Settings()) and got["abcdefgh"][4] == "abcdexxxx"


def test_checksums():
    data = np.frombuffer(b"one twoo " + b"x" * 200 + b" three", dtype=np.uint8)
    starts, ends = np.array([0, 4, 9, 210]), np.array([3, 8, 209, 215])
    before = np.array([zlib.crc32(b"7:"), zlib.crc32(b":"), zlib.crc32(b"-1:"), zlib.crc32(b"")], dtype=np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]
    assert V.crc32(data, starts, ends, before).tolist() == want
    assert V.letter_runs(Chunk(0, 1, data[:0], np.array([0, 0])))[0].tolist() == []


def test_words_awkward(spark, awkward, nothing):
    s = V.Settings(letters=2, least=1, period=3)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert {r.word: r.n for r in V.words(awkward, s).collect()} == plain_words(rows, s)
    assert V.variants(V.words(nothing)).count() == 0
    assert V.variants(V.words(awkward)).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_query_against_plain(spark, documents):
    s = V.Settings()
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in documents.collect()], s), s)
    got = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_dict(got) == want and any(v[2] for v in want.values())
