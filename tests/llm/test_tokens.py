"""Token counts and SentencePiece coding against the library and against brute force."""

import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from quillspan.llm.piece_model import NORMAL, UNIGRAM, UNKNOWN, PieceModel
from quillspan.llm.sentencepiece_codec import Decoder, StreamingViterbi, Window, decode, encode_documents
from quillspan.llm.token_counts import TokenCounter, count_tokens, merge

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   ", "\n\n \t a", "<s> </s> <unk> <0x41>", "☃☃ héé　x", "a" * 5000, " " * 100 + "x" + " " * 33, "\x00a\x00", "ﬁ①Ａ", "▁ ▁a"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    return HARD + ["".join(rng.choice("ab  \n.éz☃") for _ in range(rng.randint(1, 90))) for _ in range(800)] + ["".join(rng.choice("thenandigr") for _ in range(3000))]


def test_counts_and_ids_equal_the_library(library):
    model = PieceModel.load(PATH)
    counter, viterbi, decoder = TokenCounter(model), StreamingViterbi(model), Decoder(model)
    want = library.encode(texts())
    assert [counter.count(t) for t in texts()] == [len(w) for w in want]
    assert [viterbi.encode(t).tolist() for t in texts()] == want
    assert [decoder.decode(w) for w in want] == library.decode(want)


def test_streamed_pieces_equal_the_whole(library):
    model = PieceModel.load(PATH)
    text = model.normalised("".join(random.Random(2).choice("thenandigr é") for _ in range(4000)))
    pieces = list(StreamingViterbi(model).pieces(iter(text)))
    assert "".join(pieces) == text
    assert [model.ids[p] for p in pieces if p in model.ids] == [i for i in library.encode(text[1:].replace("▁", " ")) if i > 258]


def test_commits_on_ordinary_text(library):
    """Paths meet inside words and in full windows; what is kept never grows with the text."""
    model = PieceModel.load(PATH)
    viterbi = StreamingViterbi(model)
    text = model.normalised("It was a bright cold day in April, and the clocks were striking thirteen. " * 40)
    lists = list(viterbi.commits(iter(text)))
    assert [i for x in lists for i in x] == library.encode(text[1:].replace("▁", " "))
    assert len(lists) > len(text) / 20
    for hard in (text, "a" * 3000, "thenandigr" * 500, "漢字" * 900, "ab" * 2000):
        window, most = Window(viterbi), 0
        for char in model.normalised(hard):
            window.read(char)
            window.done = []
            most = max(most, len(window.last))
        assert most <= 5 * model.max_len


def test_sorted_segments_share_their_beginnings(library):
    viterbi = StreamingViterbi(PieceModel.load(PATH))
    rng = random.Random(12)
    words = sorted({"▁" + "".join(rng.choice("thenai☃éxq") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    got = [np.frombuffer(x, np.int32).tolist() for x in viterbi._in_order(words)]
    assert got == [library.encode(w[1:]) for w in words]


def test_decoder_defines_every_id(spark):
    decoder = Decoder(PieceModel.load(PATH))
    assert decoder.decode([-1, 10**6, None]) == "��"
    df = spark.createDataFrame([([-1, None, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r.t for r in df.select(decode(F.col("ids"), PATH).alias("t")).collect()] == ["��", "", ""]


def test_decoder_replaces_each_invalid_byte(library):
    ids = [3 + b for b in (0xE2, 0x82, 0x41, 0xFF)]
    assert Decoder(PieceModel.load(PATH)).decode(ids) == library.decode(ids)


def test_unigram_path_has_the_highest_score():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aab", "▁"]
    scores = [0.0, -2.0, -2.1, -3.0, -3.3, -4.5, -1.0]
    model = PieceModel(pieces, scores, [UNKNOWN] + [NORMAL] * 6, UNIGRAM, False, False)
    viterbi = StreamingViterbi(model)
    score = dict(zip(pieces, scores, strict=True))

    def best(text):
        found = {0: 0.0}
        for end in range(1, len(text) + 1):
            found[end] = max(found[s] + score[text[s:end]] for s in range(end) if text[s:end] in score and s in found)
        return found[len(text)]

    for n in range(1, 8):
        for text in map("".join, product("ab", repeat=n)):
            got = list(viterbi.pieces(text))
            assert "".join(got) == text and sum(score[p] for p in got) == pytest.approx(best(text))
    long = "ab" * 400 + "aab" * 100
    assert sum(score[p] for p in viterbi.pieces(long)) == pytest.approx(best(long))


def test_merge_counts_and_lists():
    assert merge("aaa", {"aa": 1.0})[0] == 1 and merge("aaa", {"aa": 1.0})[1] == [2, 0, 1]
    assert merge("", {}) == (0, [])


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "m.model"
    bad.write_bytes(b"\x12\x02\x18\x03")
    with pytest.raises(ValueError):
        PieceModel.load(str(bad))


def test_frames(spark, library):
    rows = [(1, "the cat", 9, 1), (1, "the cat", 9, 1), (2, None, 8, 1), (None, "", 7, 1), (3, "x " * 5000, 6, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _code int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect()}
    assert got == {(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, *_ in rows}
    assert count_tokens(df, PATH).count() == 5 and count_tokens(df.limit(0), PATH).count() == 0
    coded = encode_documents(df, PATH).collect()
    assert all(r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") for r in coded)
    assert all(r._code == 1 for r in coded) and encode_documents(df.limit(0), PATH).count() == 0
