"""Spelling variants and fill-in-middle against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import fill_in_middle, queries, spelling

# --- spelling variants


def plain_words(texts):
    counts: Counter = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_near(words):
    """All pairs, with what one deletion leaves of each word to look up the others by."""
    left: dict = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left.setdefault(rest, []).append(w)
    near: dict = {w: set() for w in words}
    for group in left.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def plain_variants(texts):
    words = plain_words(texts)
    near = plain_near(words)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, len(near[w]), words[forms[w]] if forms[w] else None) for w, n in words.items()}


def as_set(rows):
    found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


def test_variants_equal_plain_ones(spark, folder, given):
    assert as_set(queries.op13_spelling_variants(spark, folder).collect()) == plain_variants([(r.doc_id, r.text) for r in given])


def test_near_pairs_miss_nothing(spark):
    rng = random.Random(13)
    words = set()
    for _ in range(60):  # few letters, so that bigrams repeat within words
        word = "".join(rng.choice("abé") for _ in range(rng.randint(7, 14)))
        words.add(word)
        for _ in range(8):
            i = rng.randrange(len(word))
            kind = rng.randrange(3)
            word = word[:i] + ("" if kind == 0 else rng.choice("abéz")) + word[i + (kind != 1) :]
            words.add(word if len(word) >= 7 else word + "aaaaaaa")
    words |= {"a" * k for k in range(7, 12)} | {"x" * 5_000, "x" * 5_001, "x" * 4_999 + "y"}
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    found = [(r.word, r.other) for r in got]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_chains_of_forms_and_odd_rows(spark, odd, empty):
    counts = {"abcdefghij": 2, "abcdefghijk": 20, "abcdefghijkl": 200, "abcdefghijklm": 2000, "qqqqqqqq": 3, "qqqqqqqz": 3}
    rows = [(1_000 + i, " ".join([w] * n) + " ") for i, (w, n) in enumerate(counts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_set(spelling.variants(docs).collect()) == plain_variants(rows)
    assert as_set(spelling.variants(odd).collect()) == plain_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(empty).collect() == []


def test_long_texts_and_counts_passed_on_early(spark, given, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 100)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    texts = [(r.doc_id, r.text) for r in given[:60]]
    for key, text in texts:
        counts: Counter = Counter()
        for w, n in spelling.occurrences(key, text or ""):
            counts[w] += n
        assert {w: n for w, n in counts.items() if n >= 2} == plain_words([(key, text)])


# --- fill-in-middle


def plain_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    drawn = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        form, cut, output = "plain", (None, None), text
    else:
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        cut = len(prefix), len(middle)
        form = "spm" if h4 % 100 < 20 else "psm"
        output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return key, n, form, *cut, sha(output), sha(text)


def test_fill_in_middle_query(spark, folder, given):
    rows = queries.op11_fill_in_middle(spark, folder).collect()
    assert Counter(map(tuple, rows)) == Counter(plain_fim(r.doc_id, r.text) for r in given)


def test_fill_in_middle_of_odd_rows(spark, odd, empty):
    rows = fill_in_middle.transformed(odd).select("*", fill_in_middle.restored().alias("back")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back)) for r in rows)
    assert got == Counter(plain_fim(r.doc_id, r.text) for r in odd.collect())
    assert fill_in_middle.transformed(empty).collect() == []


def test_markers_that_nearly_come_about(spark):
    pieces = ["<", ">", "<S", "S>", "P", "<M", "M>", "<P", " ", "a"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(500, "a<P>b"), (501, "<M>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = fill_in_middle.transformed(docs).select("doc_id", fill_in_middle.restored().alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == dict(rows)


@pytest.mark.parametrize(("least", "most", "block"), [(64, 2048, 1 << 20), (1, 3, 50), (2, 9, 64), (5, 40, 33)])
def test_chunk_counts_equal_whole_ones(given, monkeypatch, least, most, block):
    monkeypatch.setattr(fill_in_middle, "LEAST", least)
    monkeypatch.setattr(fill_in_middle, "MOST", most)
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    monkeypatch.setattr(fill_in_middle, "REMEMBERED", 100)
    rng = random.Random(least)
    texts = ["".join(rng.choice("ab é1 \n日") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += [r.text[:3000] for r in given[:20] if r.text] + ["x" * 5000, " " * 5000, "ab" * 999 + "1", ""]
    for text in texts:
        counted = fill_in_middle.Chunked(text)
        ends = [0, *(m.end() for m in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text))]
        assert "".join(counted.chunks) == text and counted.units == len(ends) - 1
        for units in {0, counted.units, *(rng.randint(0, counted.units) for _ in range(6))}:
            assert counted.end_of(units) == ends[units]


def test_shared_passages_fall_into_the_same_chunks():
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    shared = words(500)
    one, other = (set(fill_in_middle.chunks(words(100) + shared + words(100))) for _ in range(2))
    assert sum(map(len, one & other)) > 0.8 * len(shared)
