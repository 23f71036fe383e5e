import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filelake.llm import tokens
from filelake.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = list("abcXYZ éßñ'’.,;:-|()0123\n\n\t     \u0085漢字ªº²½×÷_βя\x1ć")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("limit", [500_000, 40])
def test_ids_are_those_of_the_library(library, limit):
    rng = random.Random(3)
    texts = ["", " ", "a", "don't stop", "a  b", "x\n\n y", " lead", "trail ", "l'été, où?", "A1b2 (784) 555-8120.", "<|endoftext|>"[:5]]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    words = ["The", "ouéeux", "word.", "end,\nNext", "3.5", "|", "-", "über", "niño;", "a.b", "x-y", "\n"]
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(200)]
    encoder = PieceEncoder(PATH, limit)
    found = encoder.encode(texts[:500]) + encoder.encode(texts[500:])
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [f.tolist() for f in found] == [w.ids for w in wanted]


@pytest.mark.parametrize("limit", [500_000, 40])
def test_added_tokens_are_those_of_the_library(library, limit):
    end = "<|endoftext|>"
    texts = [end, end * 3, f"see {end} here", f"a{end}b", f" {end} ", f"x  {end}  y", f"l\n{end}\n\nm", f"don'{end}t", f"<|{end}|>", end[:-1] + end, f"漢{end}字 {end[1:]}"]
    rng = random.Random(5)
    texts += ["".join(rng.choice([*ODD, end, end, "<|", "|>"]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    found = PieceEncoder(PATH, limit).encode(texts)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [f.tolist() for f in found] == [w.ids for w in wanted]
    assert found[0].tolist() == [library.token_to_id(end)]


def test_null_is_empty():
    assert PieceEncoder(PATH).encode([None, ""])[0].dtype == np.dtype("<u4")
    assert [len(x) for x in PieceEncoder(PATH).encode([None, ""])] == [0, 0]


def test_a_resting_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.1)
    encoder = tokens.PieceEncoder(PATH)
    first = [x.tolist() for x in encoder.encode(["some words here", None])]
    assert encoder._known
    for _ in range(100):
        time.sleep(0.05)
        if not encoder._known:
            break
    assert not encoder._known and [x.tolist() for x in encoder.encode(["some words here", None])] == first
