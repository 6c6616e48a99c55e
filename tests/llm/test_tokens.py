"""Byte BPE, piece counts and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from terravox.llm import bpe, packing, token_counts, word_table

from .helpers import SF, awkward, empty

RNG = random.Random(1)
ALPHABET = " \t\n\r\x0b\x1c  aAbé'ßsS'tll0१9½!?.,…漢字😀́‍▁<s>|endoftextΣσǺ"
ODD = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, " " * 300, "  \n x  y ", "<|endoftext|>", "end.\nStart, it's"]


@pytest.fixture(scope="module")
def coder():
    return bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_coder(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.merges, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(coder):
    assert sorted(coder.hash.index) == list(range(coder.hash.n))
    assert all(coder.hash.find(k) == i for k, i in zip(coder.hash.keys[:2000], coder.hash.index[:2000], strict=True))
    assert coder.hash.find(b"certainly not a token of this vocabulary") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_bpe_is_the_library_and_decodes(coder, tiktoken_coder):
    ids, begin = coder.encode_batch(pa.array(ODD))
    for text, a, b in zip(ODD, begin[:-1], begin[1:], strict=True):
        assert ids[a:b].tolist() == tiktoken_coder.encode_ordinary(text), text
        assert coder.decode(ids[a:b]) == text.encode()
        assert coder.encode(text).tolist() == ids[a:b].tolist()


def test_spans_are_only_cut_for_their_pattern():
    import tiktoken

    other = r"[^r]*r|[^r]+"  # matches go over spaces and lines
    assert bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).spans
    own = bpe.load(P.path("byte_bpe_50k.tiktoken"), other)
    lib = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=own.merges, special_tokens={})
    some = ["over and out\nthere.", "", "rrr", "no such letter", "a, b. c\n\nfor"]
    ids, begin = own.encode_batch(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [lib.encode(t) for t in some]


def test_bpe_query_rows(spark, tiktoken_coder):
    docs = awkward(spark)
    got = bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    text = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(i, len(x := tiktoken_coder.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in text]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.bpe_digests(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_counts_and_prefixes_are_the_library():
    import sentencepiece

    own, lib = token_counts.load(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert [own.count(t) for t in ODD] == [len(x) for x in lib.encode(ODD)]
    for text in ODD[:150]:
        assert own.prefix_counts(text).tolist() == [len(lib.encode(text[:i])) for i in range(len(text) + 1)]
        cut = own.truncate(text, 5)
        assert len(lib.encode(cut)) <= 5 and (cut == text or text.startswith(cut))
    assert own.truncate("x", 0) == ""


def test_count_query_rows(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = awkward(spark)
    got = token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    want = [(r.doc_id, len(t.encode()), n := len(lib.encode(t)), n > 4096) for r in docs.collect() for t in [r.text or ""]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_packing_ids_are_the_library():
    from tokenizers import Tokenizer

    own, lib = packing.load(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids, begin = own.encode(pa.array(ODD))
    for text, a, b in zip(ODD, begin[:-1], begin[1:], strict=True):
        assert ids[a:b].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_packing_ids_with_special_strings_in_any_case():
    from tokenizers import Tokenizer

    own, lib = packing.load(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(9)
    some = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|EndOfText|>x", "A<|endofText|>", " ", "\n", "it's", "<", "|>", "É", "Word"]
    text = ["".join(rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    ids, begin = own.encode(pa.array(text))
    for t, a, b in zip(text, begin[:-1], begin[1:], strict=True):
        assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_word_table_starts_again_when_full():
    table = word_table.WordTable(lambda words: [np.array([len(w), ord(w[0])], "<u4").tobytes() for w in words], at_most=50)
    for n in range(6):
        text = [" ".join(f"w{n}x{i}" for i in range(40)) + " " + "long" * 12, ""]
        data = np.frombuffer("".join(text).encode(), np.uint8)
        ids, begin = table.encode(data, np.array([0, len(data), len(data)]))
        assert ids.tolist() == [v for w in text[0].split(" ") for v in (len(w), ord(w[0]))] and begin.tolist() == [0, 82, 82]


def best_number_of_bins(sizes, capacity, bins=()):
    if not sizes:
        return len(bins)
    first, rest = sizes[0], sizes[1:]
    options = [best_number_of_bins(rest, capacity, (*bins[:i], b - first, *bins[i + 1 :])) for i, b in enumerate(bins) if b >= first]
    return min([*options, best_number_of_bins(rest, capacity, (*bins, capacity - first))])


def test_pack_is_whole_and_best_on_small_blocks():
    rng = random.Random(3)
    for _ in range(150):
        sizes = np.array([rng.randint(1, 10) for _ in range(rng.randint(1, 6))])
        where, offset = packing.pack(sizes, 10)
        for b in set(where.tolist()):
            own = sorted(zip(offset[where == b].tolist(), sizes[where == b].tolist(), strict=True))
            assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 10
        assert len(set(where.tolist())) == best_number_of_bins(sorted(sizes.tolist(), reverse=True), 10)
    assert packing.pack(np.zeros(0, np.int64))[0].tolist() == []


def whole(bins, sizes, capacity):
    assert sorted(n for b in bins for n in b) == sorted(sizes.tolist()) and all(sum(b) <= capacity for b in bins)
    return len(bins)


def test_bins_are_never_more_than_by_best_fit():
    rng = np.random.default_rng(0)
    shapes = [
        rng.integers(1, 60, 3_000), rng.integers(1_200, 1_700, 5_000), rng.integers(900, 2_100, 4_000), np.minimum(4096, rng.exponential(900, 20_000).astype(int) + 1), np.ones(9_000, int), np.full(500, 4096),
        rng.integers(1_300, 1_400, 700), np.concatenate([rng.integers(2_040, 2_060, 400), rng.integers(1, 30, 50)]),
    ]
    for sizes in shapes:
        counts = np.bincount(sizes, minlength=4097)
        plain, bound = whole(packing.best_fit(counts, 4096), sizes, 4096), packing.least_bins(counts, 4096)
        n = whole(packing.complete(sizes, 4096), sizes, 4096)
        assert max(bound, -(-int(sizes.sum()) // 4096)) <= n <= plain
    for seed in range(40):  # bounds hold, and search beats best fit where that isn't best
        small = np.random.default_rng(seed).integers(20, 60, 30)
        counts = np.bincount(small, minlength=101)
        n = whole(packing.complete(small, 100), small, 100)
        assert packing.least_bins(counts, 100) <= n <= len(packing.best_fit(counts, 100))


def test_dominated_fillings():
    present = 1 << 50 | 1 << 30
    assert packing.dominated([20, 30], 0, present) and packing.dominated([48], 2, present) and not packing.dominated([48], 1, present)
    assert not packing.dominated([50], 0, present) and not packing.dominated([60], 5, present)


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = awkward(spark)
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, s, len(p := ids[s : s + 4096]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
    assert packing.pack_documents(empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_registered_queries_cover_all_rows(spark):
    from terravox.llm.queries import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_byte_bpe", "op10_token_counts"):
        assert queries()[name](spark, SF).count() == n
