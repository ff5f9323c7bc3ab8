import json
import random

import public_tokenizers
import pytest

from dataprobe.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the ", "  ", "\n", "\n\n ", "é", "…", "<|endoftext|>", "'s", "'ll ", "12 ", "\t", "\u00a0", "\u3000", "日本", "!?", "x" * 50, " ",
         "a b", "\x1c", "😀", "\r\n", "<|endof"]


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, encoding="utf-8") as file:
        return tokens._load(file.read())


@pytest.mark.parametrize("chunk, overlap", [(50, 5), (16, 1), (100, 64), (7, 3)])
def test_spliced_equals_whole(tokenizer, chunk, overlap):
    r = random.Random(chunk)
    for n in range(120):
        text = "".join(r.choices(PARTS, k=r.randint(0, 300)))
        if n % 3 == 0:
            text = text.replace(" ", "")
        assert tokens.count_spliced(tokenizer, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False))


def test_proof_needs_the_right_tokenizer():
    with open(PATH, encoding="utf-8") as file:
        definition = json.load(file)
    assert tokens.can_splice(definition)
    assert not tokens.can_splice(definition | {"normalizer": {"type": "Lowercase"}})
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        assert not tokens.can_splice(json.load(file))


@pytest.mark.parametrize("huge", [tokens.HUGE, 40])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_documents(docs, huge, name):
    out = tokens.count_tokens(docs, public_tokenizers.path(name), huge=huge, chunk=30, overlap=4).collect()
    assert len(out) == docs.count()
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        whole = tokens._load(file.read())
    for r in out:
        want = len(whole.encode(r.text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 1024)


def test_empty_and_clashing(empty, clashing):
    assert tokens.count_tokens(empty, PATH).count() == 0
    out = tokens.count_tokens(clashing, PATH)
    assert len(out.columns) == len(clashing.columns) and dict(out.dtypes)["n_tokens"] == "bigint"
