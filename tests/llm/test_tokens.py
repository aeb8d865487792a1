"""Encoders against the libraries whose ids they give, packing against exact search, files as a round trip."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyarrow import fs
from tokenizers import Tokenizer

from tidewatch.llm import merge_replay, packing, queries, token_counts, token_files, word_ids

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b", "é", "É", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", ".", ",", "12", "日", "\x1c", "　", "\xa0",
          "😀", "İ", "é", "word", "Thorn", "|", "ß", "ᛪ0", chr(0x16EA7), chr(0x11DE0)]


def drawn(count: int, seed: int, longest: int = 80) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def le32(ids) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORD)


def expected(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_encoder_gives_the_library_ids(words, given, monkeypatch):
    texts = drawn(1500, 1) + [r.text for r in given] + [None, "", "x" * 5000]
    monkeypatch.setattr(word_ids, "BLOCK", 200)
    encoder = word_ids.WordEncoder(WORD)
    assert encoder.by_word
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
    assert got == expected(words, texts)


def test_word_encoder_forgets_and_stays_right(words, given, monkeypatch):
    monkeypatch.setattr(word_ids, "REMEMBERED", 50)
    encoder = word_ids.WordEncoder(WORD)
    texts = [r.text for r in given[:40]]
    for text, ids in zip(texts, expected(words, texts)):
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == ids


def test_other_tokenizers_encode_whole_texts():
    encoder = word_ids.WordEncoder(BYTE)
    assert not encoder.by_word
    texts = ["a  b", None, "it's <|endoftext|>"]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == expected(encoder.tokenizer, texts)


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 256), (60, 4), (40, 2), (200, 50)])
def test_spliced_counts_equal_the_whole(chunk, overlap, given):
    counter = token_counts.TokenCounter(BYTE, chunk, overlap)
    texts = drawn(800, 2) + [r.text for r in given[:60]] + ["z" * 300, " " * 300, "a" + "\n" * 200 + "b", None]
    assert [counter.count(t) for t in texts] == [len(i) for i in expected(counter.tokenizer, texts)]


def test_merges_equal_the_library(given):
    codec = merge_replay.MergeEncoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.merge_ranks(RANKS), special_tokens={}
    )
    texts = drawn(1500, 3) + [r.text for r in given] + [None, "", "ab" * 900, "aaa" * 333]
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t or "") for t in texts]
    assert [codec.decode(x) for x in got] == [(t or "").encode() for t in texts]


def test_a_merge_of_lower_rank_goes_first():
    # "xyz" is of lower rank than "xy", so as "yz" can't be made it comes up right after "xy" was merged
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"xy": 257, b"xyzxy": 258}
    spelt = [b""] * 259
    for token, rank in ranks.items():
        spelt[rank] = token
    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for word in ("xyzxyz", "xyxyzxy", "xyzxyxyz", "zxyxyxyz"):
        assert merge_replay.replay([word.encode()], ranks, spelt)[word.encode()] == library.encode_ordinary(word)


def placed(packing_):
    sequences: dict[int, list[tuple[int, int]]] = {}
    for length, first, last, sequence, each, at in packing_.placed:
        for i in range(last - first):
            sequences.setdefault(sequence + i // each, []).append((at + i % each * length, length))
    return sequences


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            rest = list(rooms)
            rest[rest.index(room)] -= items[i]
            put(i + 1, rest)
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best[0]


def test_packing_fits_and_reduction_is_never_worse_than_the_best():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(rng.choice([1, 2, 3, 5]), capacity) for _ in range(rng.randint(0, 9))]
        done = packing.packed_counts(dict(Counter(items)), capacity)
        sequences = placed(done)
        assert len(sequences) == done.sequences
        assert Counter(n for s in sequences.values() for _, n in s) == Counter(items)
        for members in sequences.values():
            end = 0
            for at, length in sorted(members):
                assert at == end
                end += length
            assert end <= capacity
        reduced = packing.Packing(capacity, dict(Counter(items)))
        reduced.reduce()
        rest = [n for n, c in reduced.left.items() for _ in range(c)]
        assert reduced.fixed + fewest(rest, capacity) == fewest(items, capacity)


def test_packing_of_many_is_close_to_the_bound():
    rng = random.Random(5)
    counts = Counter(min(4096, max(2, int(rng.lognormvariate(6.3, 1.3)))) for _ in range(20_000))
    done = packing.packed_counts(dict(counts), 4096)
    bound = -(-sum(n * c for n, c in counts.items()) // 4096)
    assert done.sequences <= bound + 2


def check_packed(rows, texts, words):
    """texts: (doc_id, text) of each document."""
    made = Counter()
    for (key, _), ids in zip(texts, expected(words, [t for _, t in texts])):
        ids = [*ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            made[key, piece, start, len(part), zlib.crc32(le32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == made
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for at, length in sorted(members):
            assert at == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_packing_query(spark, folder, given, words):
    rows = queries.op6_best_fit_packing(spark, folder).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in given], words)


def test_packing_of_odd_rows(spark, odd, empty, words):
    rows = packing.pack(spark, odd, WORD).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd.collect()], words)
    assert packing.pack(spark, empty, WORD).collect() == []


def in_files(texts, words, end):
    start, made = 0, []
    for key, text in texts:
        [ids] = expected(words, [text])
        made.append((key, start, len(ids) + 1, zlib.crc32(le32([*ids, end]))))
        start += len(ids) + 1
    return made


def test_token_files_query(spark, folder, given, words):
    got = [tuple(r) for r in queries.op8_token_files(spark, folder).orderBy("doc_id").collect()]
    assert got == in_files([(r.doc_id, r.text) for r in sorted(given, key=lambda r: r.doc_id)], words, 2)


def test_files_of_a_store_are_read_by_ranges(tmp_path, monkeypatch):
    ids = np.random.default_rng(5).integers(0, 60_000, 5_000).astype("<u2")
    own = np.unique(np.r_[0, np.random.default_rng(6).integers(0, 5_000, 200), 5_000])
    (tmp_path / "x.bin").write_bytes(ids.tobytes())
    local = token_files.opened(fs.LocalFileSystem(), str(tmp_path / "x.bin"), "<u2")
    store = token_files.opened(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x.bin", "<u2")
    assert isinstance(store, token_files.Ranged)
    wanted = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:])]
    for size in (1 << 20, 100, 1):
        monkeypatch.setattr(token_files, "READ_IDS", size)
        assert token_files._checks(local, own) == token_files._checks(store, own) == wanted


def test_token_files_of_odd_rows(spark, odd, empty, words):
    rows = sorted(token_files.token_files(spark, odd, WORD, 2).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    wanted = Counter((k, n, c) for k, _, n, c in in_files([(r.doc_id, r.text) for r in odd.collect()], words, 2))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == wanted
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert token_files.token_files(spark, empty, WORD, 2).collect() == []


def test_token_counts_queries(spark, folder, given, odd, empty):
    library = Tokenizer.from_file(BYTE)
    wanted = {r.doc_id: (len(r.text.encode()), len(i)) for r, i in zip(given, expected(library, [r.text for r in given]))}
    rows = queries.op9_token_counts(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == wanted
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    texts = odd.collect()
    made = Counter((r.doc_id, len((r.text or "").encode()), len(i)) for r, i in zip(texts, expected(library, [r.text for r in texts])))
    assert Counter(map(tuple, token_counts.token_counts(odd, BYTE).collect())) == made
    assert token_counts.token_counts(empty, BYTE).collect() == []


def test_merge_replay_queries(spark, folder, given, odd, empty):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.merge_ranks(RANKS), special_tokens={}
    )
    rows = {r.doc_id: r for r in queries.op10_merge_replay(spark, folder).collect()}
    assert len(rows) == len(given)
    for r in given:
        ids, got = library.encode_ordinary(r.text), rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(le32(ids)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    ids = merge_replay.encoded(odd, RANKS, public_tokenizers.PATTERN)
    wanted = Counter((r.doc_id, le32(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd.collect())
    back = merge_replay.decoded(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in back) == wanted
    assert merge_replay.round_trip(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_plain_words_are_told_without_decoding():
    from tidewatch.llm import word_ids

    for text in ("abc", "Abc", "a1", "", "a-b", "été", "Été", "ɐb", "ß", "пес", "á", "ǆ", "中"):
        wanted = text.isalpha() and max(text) < word_ids.LATIN_END and text == text.lower()
        assert word_ids._plain(text.encode()) == wanted
    assert word_ids._missing([None, b"a", None, None, b""]) == [0, 2, 3]
    assert word_ids._missing([b"a"]) == [] == word_ids._missing([])
