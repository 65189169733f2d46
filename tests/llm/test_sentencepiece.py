import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from saltmarsh.llm import sentencepiece_bpe as sp
from saltmarsh.llm.sentencepiece_bpe import Decoder, Encoder, Model, finish, load_model, merge_all, sentencepiece_round_trip

from .helpers import AWKWARD, docs_with_clashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = [" ", "▁", "a", "e", "\n", "\t", "é", "漢", "\x00", "😀", "\U0010ffff", "<s>", "<0x41>", "    ", "th", "ing", "0", "--", "ا", "л", "�", "\r"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return load_model(MODEL)


def test_round_trip_equals_the_library(spark, library):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = AWKWARD + given + ["x" * 20_000 + " " * 20_000, "▁▁ a ▁b", " lead", "trail ", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in sentencepiece_round_trip(docs, MODEL).collect()}
    digests = {r.doc_id: r for r in sentencepiece_round_trip(docs, MODEL, digests_only=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), decoded)
        assert digests[i].ids == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded == hashlib.sha256(decoded.encode()).hexdigest()


def test_random_texts_and_ids_equal_the_library(library, model):
    encoder, decoder, rng = Encoder(model), Decoder(model), random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice(SCRAPS) for _ in range(rng.randint(1, 30)))
        ids = encoder.encode(text)
        assert ids == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids)
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32_000), 259]) for _ in range(rng.randint(0, 8))]
        assert decoder.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("seed", range(12))
def test_prefix_tables_of_any_piece_list(seed):
    """Pieces in any order of rank, also ties and parts that merge later than the whole: the table against the merges themselves."""
    rng = random.Random(seed)
    letters = "abcd"
    pieces = list({"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(40)})
    singles = list(letters[: rng.randint(2, 4)])
    ranks = {p: rng.randrange(12) if seed % 2 else i for i, p in enumerate(singles + pieces)}
    names = [f"<0x{b:02X}>" for b in range(256)]
    kinds = [sp.BYTE] * 256 + [sp.NORMAL] * len(ranks)
    model = finish(Model(names + list(ranks), kinds, ranks, False, list(range(256))))
    encoder = Encoder(model)
    for _ in range(1500):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))
        wanted = [i for part in merge_all(word, ranks)[0]
                  for i in ([model.ids[part]] if part in model.ids else list(part.encode()))]
        assert list(encoder.ids_of(word)) == wanted, (word, ranks)
        last = encoder.last_tokens(word)
        for end in range(1, len(word) + 1):
            part = merge_all(word[:end], ranks)[0][-1]
            assert last[end - 1] == (model.ids[part] if part in model.ids else -1 - ord(part))


def test_forgetting_changes_nothing(model, monkeypatch):
    words = "some words come back some words do not come back but others do ".split(" ") * 3
    whole = [Encoder(model).ids_of(w) for w in words]
    monkeypatch.setattr(sp, "REMEMBERED_PAIRS", 2)
    monkeypatch.setattr(sp, "REMEMBERED_WORDS", 2)
    encoder = Encoder(model)
    assert [encoder.ids_of(w) for w in words] == whole
    text = " ".join(words)
    assert encoder.encode(text) == Encoder(model).encode(text)


def test_long_words_take_time_in_proportion(model):
    rng, encoder = random.Random(4), Encoder(model)
    start = time.perf_counter()
    word = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    assert Decoder(model).decode(encoder.encode(word)) == word
    assert time.perf_counter() - start < 30


def test_other_models_are_refused(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(bytes([sp.TRAINER << 3 | 2, 2, sp.MODEL_TYPE << 3, 1]))
    with pytest.raises(ValueError, match="only BPE models"):
        load_model(str(other))


def test_clashes_repeats_and_empty_tables(spark):
    docs = docs_with_clashes(spark, AWKWARD)
    got = sentencepiece_round_trip(docs, MODEL)
    assert got.count() == docs.count() and {r.made for r in got.collect()} == {"mine", None}
    assert sentencepiece_round_trip(docs.limit(0), MODEL).count() == 0
