"""Byte-level BPE, token files, Huffman codes and token counts against the libraries and plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from socklens.llm import byte_bpe, huffman, token_count, token_files
from socklens.llm.pretokens import split
from socklens.llm.queries import bpe_digests
from socklens.llm.shared import new_folder, prepare
from tests.llm.conftest import awkward

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["abc", "aaab", "the in", "aé ïßñ", "0123 4", " \n\t\r\xa0\x1c\x85", "日本語テ", "🙂👍 a", "-_=*#'s't'll", "ÀÈ²½ⅷªº", "a\x00\x1f​  b"]


def texts(n: int) -> list[str]:
    pick = random.Random(5)
    out = []
    for _ in range(n):
        letters = pick.choice(LETTERS) + pick.choice(LETTERS)
        out.append("".join(pick.choice(letters) for _ in range(pick.randint(0, 50))))
    return out


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_the_library(reference):
    for text in [*texts(1500), "a" * 4001, "ab" * 3000, "x" * 17 + "y" * 5000]:
        assert "".join(split(text)) == text
        assert byte_bpe.encode_text(text, RANKS).tolist() == reference.encode_ordinary(text), repr(text)


def test_joining_any_halves_gives_the_whole(reference):
    pairs, pick = byte_bpe.load(RANKS), random.Random(3)
    for _ in range(800):
        data = "".join(pick.choice("abeinorst aaa") for _ in range(pick.randint(2, 30))).encode()
        cut = pick.randrange(1, len(data))
        assert pairs.join(pairs.merge(data[:cut]), pairs.merge(data[cut:])) == pairs.merge(data)


def test_encode_decode_query_shape(docs, no_docs, reference):
    encoded = byte_bpe.encode(docs.withColumn("ids", F.lit("mine")), RANKS)
    assert encoded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    rows = bpe_digests(byte_bpe.decode(encoded, RANKS)).collect()
    want = []
    for doc_id, text, *_ in awkward():
        ids = reference.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    both = byte_bpe.encode(docs.withColumn("decoded", F.lit("mine")), RANKS, decoded=True)
    assert sorted(map(str, map(tuple, bpe_digests(both).collect()))) == sorted(map(str, want))
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS), RANKS).count() == 0


def test_token_files_hold_the_library_ids_in_order(spark, docs, no_docs):
    folder = new_folder(spark, "test")
    token_files.write_token_files(docs, folder, LIBRARY)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t, *_ in awkward()}
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == sorted((str(i), ids[t]) for i, t, *_ in awkward())
    crc = token_files.with_crc32(token_files.read_token_files(spark, folder)).collect()
    assert sorted(r.ids_crc32 for r in crc) == sorted(zlib.crc32(ids[t]) for _, t, *_ in awkward())
    empty = new_folder(spark, "test")
    token_files.write_token_files(no_docs, empty, LIBRARY)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_library_encoder_on_any_text():
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    encoder = token_files.LibraryEncoder(LIBRARY)
    for text in [*texts(800), "x<|endoftext|>y"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_hold_the_ids_of_added_tokens(spark, tmp_path):
    mark, library = "<|endoftext|>", Tokenizer.from_file(LIBRARY)
    assert library.encode(f"a{mark}b", add_special_tokens=False).ids == [64, 50256, 65]
    some = ["a" + mark + "b", mark, mark * 3, f" x  {mark} \n {mark}\t", "<|endoftext", f"<|{mark}|>", "it" + mark + "'s  ", *texts(100)]
    some += [a + mark + b for a, b in zip(texts(100), texts(50)[::-1])]
    table = prepare(spark).createDataFrame(list(enumerate(some)), "doc_id long, text string")
    folder = new_folder(spark, "test")
    token_files.write_token_files(table, folder, LIBRARY)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.doc_id)
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in some]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    # tokens that begin alike, take spaces with them, or want whole words
    for kinds in ({}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        library = Tokenizer.from_file(LIBRARY)
        library.add_tokens([AddedToken("<|end", **kinds), AddedToken("qu", normalized=False)])
        library.save(path := str(tmp_path / f"{'-'.join(kinds)}.json"))
        encoder = token_files.LibraryEncoder(path)
        for text in [*some, "a <|end b", "quiet <|endo qu", f"qu{mark}<|end"]:
            assert np.frombuffer(encoder.encode_marked(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (kinds, text)


def plain_lengths(counts):
    import heapq

    heap = [(c, i, (i,)) for i, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return lengths


def test_huffman_lengths_and_round_trips():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.7, n) * 5).astype(np.int64) + 1
        counts[rng.random(n) < 0.2] = 0
        counts[0] = 1
        free = huffman.code_lengths(counts, 40)
        assert (free * counts).sum() == (np.array(plain_lengths(counts)) * counts).sum() or (counts > 0).sum() == 1
        lengths = huffman.code_lengths(counts, 12)
        assert lengths.max() <= 12 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        book = huffman.Codebook(lengths, 12)
        for size in (0, 1, 63, 64, 65, 3000):
            ids = rng.choice(np.flatnonzero(counts), size)
            bits, offsets = book.pack(ids)
            assert book.unpack(bits, offsets, size).tolist() == ids.tolist()
            if size > 64:  # a checkpoint starts a lane by itself
                assert book.unpack(bits, offsets[1:2], 1)[0] == ids[64]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17), 4)


def test_longest_match_counts_like_greedy_cutting(docs, no_docs):
    def greedy(word, pieces):
        text, at, n = token_count.MARK + word, 0, 0
        while at < len(text):
            ends = [e for e in range(len(text), at, -1) if text[at:e] in pieces and text[at:e].startswith(token_count.MARK) == (at == 0)]
            if not ends:
                return 0
            at, n = ends[0], n + 1
        return n

    pick = random.Random(9)
    for _ in range(400):
        some = {"".join(pick.choice("ab") for _ in range(pick.randint(1, 5))) for _ in range(pick.randint(1, 8))}
        some |= {token_count.MARK + "".join(pick.choice("ab") for _ in range(pick.randint(0, 4))) for _ in range(pick.randint(1, 4))}
        automaton = token_count.LongestMatch(list(some))
        for _ in range(10):
            word = "".join(pick.choice("ab") for _ in range(pick.randint(1, 12)))
            assert automaton.count(word) == greedy(word, some), (word, some)
    pieces = set(token_count.piece_list(PIECES))
    rows = token_count.count_tokens(docs.withColumn("n_words", F.lit("mine")), PIECES).collect()
    known: dict = {}
    for row in rows:
        words = (row.text or "").split()
        counts = [known.setdefault(w, greedy(w, pieces)) for w in words]
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(words), sum(counts) + counts.count(0), counts.count(0))
    assert token_count.count_tokens(no_docs, PIECES).count() == 0
