"""SentencePiece encoding against the library: ids, spans, decoded texts, and the character map alone."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import bytetext, pieces

from .helpers import frame, odd_texts, random_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "e", "n", "t", "h", "é", " ", " ", "  ", "\n", "\t", "▁", "\U0001f9ff", "ñ", "中", "\x00", "the", "ing", "̀", "퟿", "￿", "한"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts_of(seed, n, most=120):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(most))) for _ in range(n)]


def long_texts():
    rnd = random.Random(1)
    return ["a" * 5000, "ab" * 3000, "▁" * 700, " " * 700, "\U0001f9ff" * 50, "".join(rnd.choice("abcdefghijklmnop") for _ in range(4000)), *texts_of(9, 1, 20000), "x" * 300_000]


def test_ids_spans_and_texts_equal_the_library(library):
    texts = [*texts_of(3, 1500), *random_texts(4, 100), *long_texts(), *(t or "" for t in odd_texts()), "<s>a</s><0x41><unk>"]
    model = pieces.Model(pieces.load_model(PATH))
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for a, _, data, offsets in bytetext.chunks(pa.array(texts)):
        ids, begins, ends, rows = encoder.encode(data, offsets)
        decoded = decoder.decode(ids, rows)
        for k, (i, j) in enumerate(zip(rows[:-1], rows[1:])):
            text = texts[a + k]
            want = library.encode(text, add_bos=False, add_eos=True)
            assert ids[i:j].tolist() == want
            assert decoded[k].decode() == library.decode(want)
            if len(text) < 1000:
                source = text.encode()
                spans = [(len(source[:x].decode()), len(source[:y].decode())) for x, y in zip(begins[i : j - 1].tolist(), ends[i : j - 1].tolist())]
                assert spans == library.encode_as_offset_mapping(text)["offsets"]
                assert (begins[j - 1], ends[j - 1]) == (len(source), len(source))


def test_any_ids_decode_as_the_library_says(library):
    decoder, rnd = pieces.Decoder(pieces.Model(pieces.load_model(PATH))), random.Random(5)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32000), 259, 28705, 0, 1, 2]) for _ in range(rnd.randrange(12))]
        assert decoder.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == library.decode(ids)


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_the_character_map_takes_the_longest_rule(rule, trim):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=trim, remove_extra_whitespaces=trim, escape_whitespaces=True)
    blob = next(dict(pieces._fields(v))[2] for n, v in pieces._fields(theirs.serialized_model_proto()) if n == 3)
    ours = pieces.Normaliser(SimpleNamespace(map=pieces.CharacterMap(blob), prefix=trim, trim=trim))
    rnd = random.Random(6)
    marks = ["ﬁ", "①", "é", "が", "が", "Å", "Å", "각", "㍿", "A", "ß", "x", " ", "　", "​", "\t", "½", "ﬃ", "̈́", "각", "́"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(25))) for _ in range(800)] + ["", "   ", " 　 "]
    out, bounds, places = ours(*bytetext.string_buffers(pa.array(texts)))
    for k, text in enumerate(texts):
        want, offsets = theirs.normalize(text, with_offsets=True)
        got = out[bounds[k] : bounds[k + 1]].tobytes().decode()
        assert got == want
        source, mine, at = text.encode(), places[bounds[k] + k : bounds[k + 1] + k + 1].tolist(), 0
        starts = []
        for c in got:
            starts.append(len(source[: mine[at]].decode()))
            at += len(c.encode())
        assert starts + [len(source[: mine[at]].decode())] == list(offsets)


def test_frames(spark, library):
    texts = [*odd_texts(), *texts_of(8, 40), "twice", "twice"]
    docs = frame(spark, texts)
    want = [library.encode(t or "", add_eos=True) for t in texts]
    encoded = pieces.encode(docs, PATH)
    assert {r.doc_id: r.token_ids for r in encoded.collect()} == dict(enumerate(want))
    assert {r.doc_id: r.decoded for r in pieces.decode(encoded, PATH).collect()} == {k: library.decode(w) for k, w in enumerate(want)}
    for row in pieces.digest(docs, PATH).collect():
        ids = want[row.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digest(docs.limit(0), PATH).count() == 0
    null = spark.createDataFrame([(1, None), (2, [2])], "doc_id long, token_ids array<int>")
    assert [r.decoded for r in pieces.decode(null, PATH).collect()] == ["", ""]


def test_other_models_are_refused():
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    with pytest.raises(ValueError):
        pieces.Model(theirs.serialized_model_proto())
