import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from codegrove.llm import packing, prefix_bpe
from codegrove.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", " ", "é", "日本", "'s", "\n", "00", "--", "the", "ing", "  ", "=", "_", "🙂", "Ã", "\t", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(ranks):
    return prefix_bpe.TextEncoder(ranks, public_tokenizers.PATTERN)


def drawn(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))


def test_encoding_appending_and_decoding(ranks, encoder):
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(1500):
        text = drawn(rng, 50)
        cut = rng.randint(0, len(text))
        ids = right.encode_ordinary(text)
        assert encoder.encode(text) == ids and encoder.decode(ids) == text.encode()
        assert encoder.append(text[:cut], encoder.encode(text[:cut]), text[cut:]) == ids


def test_edits_repair_the_table(encoder):
    rng = random.Random(5)
    for _ in range(150):
        data = bytes(rng.choice(b"abcdeing th-=") for _ in range(500))
        table = prefix_bpe.PrefixTable(encoder.vocabulary, data)
        at = rng.randint(0, 500)
        removed = rng.randint(0, min(4, 500 - at))
        put = bytes(rng.choice(b"abing t") for _ in range(rng.randint(0, 4)))
        table.replace(at, removed, put)
        assert table.last == prefix_bpe.PrefixTable(encoder.vocabulary, data[:at] + put + data[at + removed :]).last


def test_one_token_fits_each_prefix(ranks, encoder):
    """The stored token is the last of plain merging, for every prefix."""
    rng = random.Random(6)
    for _ in range(60):
        data = bytes(rng.choice(b"theinga r") for _ in range(30))
        table = prefix_bpe.PrefixTable(encoder.vocabulary, data)
        for end in range(1, len(data) + 1):
            assert encoder.vocabulary.bytes[table.last[end]] == prefix_bpe.merge_by_rank(data[:end], ranks)[-1]


def test_awkward_texts(spark, awkward, nothing, ranks):
    rows = prefix_bpe.decode(prefix_bpe.encode(awkward, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    texts = Counter((r.doc_id, (r.text or "").encode()) for r in awkward.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rows) == texts
    assert prefix_bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("counts", [
    {}, {1: 5000}, {1024: 3, 512: 7, 300: 9}, {700: 10, 600: 5}, {n: n % 7 + 1 for n in range(1, 1025)},
    {1000: 10, 24: 4, 12: 20, 8: 30}, {341: 10, 342: 9, 683: 4},
])
def test_plans_use_all_pieces(counts):
    used = Counter()
    sequences = packing.plan(counts, 1024)
    for lengths, copies in sequences:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += copies
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(c for _, c in sequences) <= max(least * 11 / 9 + 1, sum(c for n, c in counts.items() if n > 512))


def test_exact_complements_come_first():
    assert sorted(packing.plan({1000: 1, 24: 1, 900: 1, 100: 1, 700: 1, 200: 1, 74: 1, 50: 1}, 1024))[0][0] != ()
    found = {tuple(sorted(g)) for g, _ in packing.plan({1000: 2, 24: 2, 700: 1, 300: 1, 14: 1, 10: 1}, 1024)}
    assert found == {(24, 1000), (10, 14, 300, 700)}


def test_tokenizer_gives_the_library_ids():
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    own, library = packing.Tokenizer(definition, public_tokenizers.PATTERN), Tokenizer.from_str(definition)
    rng = random.Random(7)
    for _ in range(500):
        text = drawn(rng, 40)
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def held_together(spark, docs, pieces, ids_of):
    """Each document's pieces are its ids, and each sequence is filled without gaps."""
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    want = Counter()
    for doc_id, text in docs:
        ids = ids_of(text or "") + [2]
        for nth, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[doc_id, nth, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want


def test_packing_query(spark, awkward, nothing):
    from codegrove.llm.queries import packed_documents

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = lambda t: library.encode(t, add_special_tokens=False).ids
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held_together(spark, docs, QUERIES["op5_complement_packing"](spark, SF).collect(), ids_of)
    held_together(spark, [(r.doc_id, r.text) for r in awkward.collect()], packed_documents(awkward).collect(), ids_of)
    assert packed_documents(nothing).count() == 0


def test_sequences_hold_the_ids(spark, documents):
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    packed = packing.pack(documents, definition, public_tokenizers.PATTERN)
    total = sum(p.length for p in packed.pieces.collect())
    rows = packed.sequences().collect()
    assert sum(len(r.ids) // 4 for r in rows) == total and all(len(r.ids) <= 4096 for r in rows)
    assert sum(int((np.frombuffer(bytes(r.ids), "<u4") == 2).sum()) for r in rows) >= documents.count()


def test_encoding_query(spark, ranks):
    import hashlib

    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_prefix_bpe"](spark, SF).collect():
        ids = right.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
