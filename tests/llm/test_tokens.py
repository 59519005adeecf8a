"""Token counts, BPE and packing against the tokenizers library."""

import hashlib
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "   two  spaces   ", "line\n\nbreaks \r\n\t tabs", "it's we'll I'D y'all's", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b <|ENDOFTEXT|>", "café naïve é",
    "日本語のテキスト" * 40, "　wide space em", "emoji \U0001f600\U0001f469‍\U0001f680 end", "\x1c\x1f control \x85 next", "x" * 3000, "ab" * 2000 + " tail", "İstanbul ΣΣ Σ", "12345 6.78,9 $%^&*() --__--", "word " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (0, "", "x")], "doc_id long, text string, n_tokens string")


def library(path):
    return Tokenizer.from_file(path)


def test_counts(spark, docs):
    t = library(BYTE)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTE).collect())
    want = []
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_counts_of_a_sentencepiece_model(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.where("doc_id > 0"), path).collect()}
    assert got == {i: len(p.encode(t or "")) for i, t in enumerate(TEXTS) if i}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_long_texts_are_split_at_safe_places(name):
    path = public_tokenizers.path(name)
    t, places = token_counts.load_tokenizer(path), token_counts.safe_places(path)
    texts = [x * 3 for x in TEXTS if x] + ["it's12ab,cd 'll9 <|endoftext|>x1<|endoftext|> it's'd 7.5k a_b\t c" * 5]
    for text in texts:
        for most in (1, 3, 10, 50):
            parts = token_counts.parts_of(text, places, most)
            assert sum(token_counts.encode_lengths(t, parts, 20)) == token_counts.encode_lengths(t, [text])[0], (text, most)
    assert len(token_counts.parts_of("word " * 1000, places, 100)) > 40


def test_encode_and_decode(spark, docs):
    t = library(BYTE)
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, BYTE, lexicon_words=50).collect()}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id, len(ids)] == (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_ids_round_trip(spark, docs):
    lexicon = bpe.build_lexicon(docs, BYTE, 100)
    encoded = bpe.token_ids(docs.where("doc_id > 0"), BYTE, lexicon)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()} == {i: t or "" for i, t in enumerate(TEXTS) if i}


def test_transducer_is_a_perfect_numbering():
    words = sorted({b"", b"a", b"tap", b"taps", b"top", b"tops", "été".encode(), *[f"w{i}s".encode() for i in range(300)]})
    entries = {w: (i, i + 1) for i, w in enumerate(words)}
    blob = bpe.Transducer.compile(entries)
    fst = bpe.Transducer(np.frombuffer(blob, dtype=np.uint8))
    assert fst.rows(words).tolist() == list(range(len(words)))
    assert [tuple(np.frombuffer(fst.ids_of(i), dtype="<i4").tolist()) for i in range(len(words))] == [entries[w] for w in words]
    assert fst.rows([b"ta", b"tapss", b"zzz", b"w300s"]).tolist() == [-1] * 4
    assert len(fst.final) < sum(map(len, words))  # suffixes are shared


def test_long_merges_equal_short_ones():
    v = bpe.Vocabulary(BYTE)
    for word in (b"aaaaaaabababab" * 3, b"the" * 12, bytes(range(60, 100))):
        assert v._merge_long([v.byte_id[b] for b in word]) == v.merge(word)
        assert list(v.merge(word * 9)) == library(BYTE).encode((word * 9).decode(), add_special_tokens=False).ids or b"<" in word


def test_pieces_of_packed_documents(spark, docs):
    t = library(WORD)
    rows = packing.pack_documents(docs, WORD, packing.Limits(tokens=64, segments=5, loss_tokens=60)).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for r in docs.where("doc_id > 0").collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        own = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist() and sum(x.length for x in own) == len(ids)
        assert all(x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
    for own in by_bin.values():
        own.sort(key=lambda x: x.offset)
        assert [x.offset for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist()
        assert sum(x.length for x in own) <= 64 and len(own) <= 5 and sum(x.length - 1 for x in own) <= 60
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 1


def test_vector_bins_keep_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 40, 500), np.ones(500, dtype=int), rng.integers(0, 30, 500)], axis=1)
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    capacity = np.array([64, 6, 40])
    bins, place = packing.vector_bin_pack(demand, capacity)
    sums = np.stack([np.bincount(bins, demand[:, i]) for i in range(3)], axis=1)
    assert (sums <= capacity).all()
    assert len({(b, p) for b, p in zip(bins.tolist(), place.tolist())}) == 500
    lower = np.ceil((demand.sum(axis=0) / capacity).max())
    assert bins.max() + 1 <= 1.15 * lower
    with pytest.raises(ValueError):
        packing.vector_bin_pack(np.array([[65, 1, 0]]), capacity)


def test_cut_conversations_keep_every_limit(spark):
    say = lambda n: " ".join(["word"] * n)
    rows = [(c, k, "assistant" if k % 2 else "user", say(3 + (7 * c + 5 * k) % 40)) for c in range(30) for k in range(c % 9 + 1)] + [(50, 0, "assistant", say(300)), (None, 0, None, "hi"), (51, 0, "user", None), (51, 0, "user", None)] + [(c, 0, "user", "hi") for c in range(60, 90)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    limits = packing.Limits(64, 4, 30)
    pieces = {(r.doc_id, r.start): r for r in packing.conversation_pieces(turns, WORD, limits).collect()}
    t = library(WORD)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in pieces.values() if r.doc_id == c), key=lambda r: r.start)
        bears = [b for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) for b in [role == "assistant"] * (len(t.encode(text or "", add_special_tokens=False).ids) + 1)]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and own[-1].start + own[-1].length == own[0].doc_tokens == len(bears)
        assert all(r.loss_tokens == sum(bears[r.start : r.start + r.length]) <= 30 for r in own)
    by_bin = {}
    for r in packing.pack_conversations(turns, WORD, limits).collect():
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert sum(map(len, by_bin.values())) == len(pieces)
    full = [[sum(r.length for r in own), len(own), sum(pieces[r.doc_id, r.start].loss_tokens for r in own)] for own in by_bin.values()]
    assert all(a <= 64 and b <= 4 and c <= 30 for a, b, c in full)
    assert max(f[1] for f in full) == 4 and max(f[2] for f in full) == 30  # both limits bind


def test_conversations_bear_loss_on_assistant_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day to you"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    rows = packing.pack_conversations(turns, WORD).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and len({r.sequence_id for r in rows}) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, BYTE).collect() == []
    assert bpe.encode(none, BYTE).collect() == []
    assert packing.pack_documents(none, WORD).collect() == []


def test_words_encoded_together_equal_words_alone():
    tokenizer = token_counts.load_tokenizer(WORD)
    words = ["plain", "éaux", "ends,", "éaux###", "it's", "don't,", "a'", "a''", "x_", "x_y", "a1", "1,", ",,", "a<|", "<|endoftext|>", "İx", "日本,", "ª.", "µ!", "Mixed***", "éa,", "a-b", "x\x1cy", "$$$", "ſt,", ""]
    for some in (words, words[:3], words[4:], [], ["a,"], ["plain"]):
        want = [array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in some]
        assert packing.word_ids(tokenizer)(some) == want
