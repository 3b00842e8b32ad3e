"""SentencePiece search and token files: brute force, libraries and exact round trips."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from eventspark.llm import prefix_viterbi as pv
from eventspark.llm import token_files as tf

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "▁", "a▁ ▁▁ b", "🤖 é\n\t  z", " ▁ ", "▁▁▁", "x" * 3000, "hello world hello"]


@pytest.fixture(scope="module")
def pieces():
    return pv.Pieces.load(MODEL)


def brute_best(word, pieces):
    """Best sum of scores over all segmentations, from the end to the start."""
    best = {len(word): 0.0}
    for k in range(len(word) - 1, -1, -1):
        best[k] = max([pieces.byte_score + best[k + 1]] + [pieces.scores[word[k:e]] + best[e] for e in range(k + 1, len(word) + 1)
                                                          if word[k:e] in pieces.scores])
    return best[0]


def some_words():
    rng = random.Random(1)
    return sorted({pv.MARK * rng.randint(0, 2) + "".join(rng.choices("abcdethinroné7.🤖", k=rng.randint(1, 12))) for _ in range(400)})


def test_shared_search_equals_brute_force_in_a_unigram_model():
    pieces = pv.Pieces.load(MODEL, merges=False)
    search, back = pv.SharedViterbi(pieces), {v: k for k, v in pieces.ids.items()}
    for word in some_words():
        ids = search.ids(word)
        raw = bytes(pieces.bytes_.index(i) for i in ids if i in set(pieces.bytes_))
        by_bytes = sum(1 for b in raw if b & 0xC0 != 0x80)
        assert pv.SharedViterbi(pieces).ids(word) == ids  # sharing changes nothing
        assert sum(pieces.scores.get(back.get(i), 0.0) for i in ids) + pieces.byte_score * by_bytes == pytest.approx(brute_best(word, pieces))
    assert search.reused > 0.2 * search.computed


def test_shared_search_equals_merging(pieces):
    search, names = pv.SharedViterbi(pieces), {v: k for k, v in pieces.ids.items()}
    for word in some_words():
        want = [i for p in pv.merge(word, pieces.scores) for i in ([pieces.ids[p]] if p in pieces.ids else [pieces.bytes_[b] for b in p.encode()])]
        assert search.ids(word) == want, names
    assert search.reused > 0.2 * search.computed


def test_ids_are_those_of_the_library(spark, pieces, odd_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    marks = ["a", "b", " ", "  ", "   ", "\n", "é", "🤖", "the", "ing", "1", "2024", ".", ",", "://", "()", "{", "_", "中", "文", " " * 9]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 14))) for _ in range(2000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [np.frombuffer(x, "<i4").tolist() for x in pv.Encoder(pieces).encode(texts)]
    assert got == library.encode(texts)


def test_round_trip_of_odd_texts(pieces):
    found = pv.Encoder(pieces).encode(ODD)
    assert [pv.decode_ids(np.frombuffer(x, "<i4").tolist(), pieces) for x in found] == ODD


def test_sentencepiece_tables(spark, odd_docs):
    rows = pv.round_trip(odd_docs, MODEL).collect()
    assert len(rows) == odd_docs.count() and all(r["same"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"] for r in rows)
    encoded = pv.encode(odd_docs, MODEL)
    assert encoded.columns == [*odd_docs.columns, "ids"]
    decoded = pv.decode(encoded.select("doc_id", "ids"), MODEL)
    assert sorted(str(r["text"]) for r in decoded.collect()) == sorted(str(r["text"] or "") for r in odd_docs.collect())
    assert pv.round_trip(odd_docs.limit(0), MODEL).count() == 0


def library_rows(docs):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(BPE), 0, []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_chunks_equal_whole_texts():
    rng = random.Random(5)
    marks = [*"ab1'.,! \n\t　é🤖\x1c\x85s", "  ", " \n", "'s", " a", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 25))) for _ in range(4000)]
    encoder = tf.ChunkEncoder(BPE)
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, odd_docs, tmp_path, encoding):
    path = str(tmp_path / encoding)
    tf.write(odd_docs, path, BPE, encoding, row_group_bytes=1 << 16, page_rows=5)
    docs = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = library_rows(docs)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in tf.digest(spark, path).collect()), key=key) == want
    assert sorted((tuple(r) for r in tf.read_metadata(spark, path).select("doc_id", "start", "n_tokens").collect()), key=key) == [w[:3] for w in want]
    some = tf.read_tokens(spark, path, 5, 9)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in some.collect()) == [(w[0], w[2]) for w in want if w[0] is not None and 5 <= w[0] <= 9]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            ids = meta.row_group(g).column(4)
            assert ids.has_offset_index and ids.has_column_index
            assert ("DELTA_BINARY_PACKED" in ids.encodings) or encoding == "dictionary" or not ids.num_values


def test_token_files_of_an_empty_table(spark, odd_docs):
    assert tf.round_trip(odd_docs.limit(0), BPE).count() == 0


def test_other_tokenizer_settings_go_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain words here", "don't  stop\n now", "", " x", "ends in 12345 !!"]
    for k, before in enumerate((pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))):
        tokenizer.pre_tokenizer = before
        path = str(tmp_path / f"t{k}.json")
        tokenizer.save(path)
        got = tf.ChunkEncoder(path).encode(texts)
        assert [np.frombuffer(x, "<i4").tolist()[:-1] for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_remembered_once():
    import array

    import public_tokenizers
    from eventspark.llm.token_files import ChunkEncoder

    encoder = ChunkEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["the word, the word word. été word's", "  two  spaces\n word", "a 12 12, x1 ² 日本 word", ""]
    ids = [array.array("i", [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]).tobytes() for t in texts]
    assert encoder.encode(texts) == ids and encoder.encode(texts) == ids
    assert {"the", "word", "été"} & set(encoder.spaced) and not {" the", " été"} & set(encoder.pieces)


def test_words_are_looked_up_without_their_signs_and_lines():
    encoder = tf.ChunkEncoder(BPE)
    texts = ["a word. word, (word)\nword's word12 2word\n\nword ¿word? étéword×", "", "word!\n", "'word ''s don't 'll"] * 5
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want
    # before, every word with what stood around it was a chunk of its own
    assert "word" in encoder.spaced and not [c for c in encoder.spaced if c[:4] == "word" and c != "word"]
    assert "word" in encoder.bare and "(word)\nword's" not in encoder.spaced


def test_cuts_of_common_texts_are_those_of_the_pattern():
    import itertools

    encoder = tf.ChunkEncoder(BPE)
    texts = ["".join(t) for t in itertools.product("as1'. \né²×ȿ", repeat=4)] + [f"a{chr(k)}'s" for k in range(1, 0x300)]
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want


def test_blocks_of_texts_with_nulls_and_rare_characters():
    import pyarrow as pa

    encoder = tf.ChunkEncoder(BPE)
    texts = ["out", None, "two  words", "日本 word", "", "<|endoftext|>x", None, "a\n\n\nb", "out"]
    got = encoder.encode_array(pa.array(texts).slice(1, 7))
    assert got.to_pylist() == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[1:8]]
    assert encoder.encode_array(pa.array([], pa.string())).to_pylist() == []


def test_texts_with_rare_characters_are_cut_too():
    import itertools

    encoder = tf.ChunkEncoder(BPE)
    texts = ["".join(t) for t in itertools.product("as1'. \né²中\u3000🤖\u0301\t\xa0", repeat=4)]
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want
    encoder = tf.ChunkEncoder(BPE)
    encoder.encode(["some words. “quoted” words, 中"])
    assert {"some", "words"} <= set(encoder.spaced) | set(encoder.bare) and not {"words.", "words,"} & set(encoder.spaced)
