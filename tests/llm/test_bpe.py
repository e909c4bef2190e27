"""The trie encoder against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import sys

import public_tokenizers
import pytest
from samples import awkward, awkward_rows, empty, frame
from tokenizers import Tokenizer
from trialloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and internationalisation'll don't they've aaaaaaaa aaaaaaaaaaaab ababababab zzz 2024 x1y2 état Straße naïve ΣΑΣ ІЇ 東京 😀😀 <|endoftext|>".split()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(bpe.read_tokenizer(PATH))


def texts_to_try() -> list[str | None]:
    rng = random.Random(7)
    found = [None, "", " ", "\u0085", "é ẛ̣", "İI ıi", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "x" * 5000, "ab" * 3001 + "c"]
    found += ["𐐀𐵐 ꟋᲉ", "'S 'Ll it's''s", "　a b​c", "à́<|endoftext|>́", "\x00\x1c\x1d힤"]
    alphabet = "aabbccddeeeest hinrs" + "éßñ東あ١½²_-'.!?"
    found += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(2000)]
    found += ["".join(rng.choices("abns", k=rng.randrange(1, 40))) for _ in range(2000)]
    return found + [" ".join(rng.choices(WORDS, k=30)) for _ in range(50)]


def test_words_and_texts(library, encoder):
    texts = texts_to_try()
    got = encoder.encode_all(texts)
    for text, ids in zip(texts, got):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert ids == wanted, text
        assert encoder.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_every_character_of_the_own_path(library, encoder):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    own = [c for c in points if not bpe._UNSURE.search(c)]
    assert 30_000 < len(own) < 60_000
    for a in range(0, len(own), 500):
        text = " ".join(f"a{c}b {c}{c}" for c in own[a : a + 500])
        assert encoder.encode_all([text])[0] == library.encode(text, add_special_tokens=False).ids, hex(ord(own[a]))


def test_small_memory(library, encoder, monkeypatch):
    for name, value in (("MAX_NODES", 50), ("MAX_WORDS", 10), ("MAX_SYMBOLS", 60), ("BLOCK_CHARS", 100), ("LONG_WORD", 7)):
        monkeypatch.setattr(bpe, name, value)
    texts = texts_to_try()[:1200]
    assert encoder.encode_all(texts) == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_prefixes_are_shared(encoder):
    encoder.empty()
    encoder.learn({"thing", "things", "thin"})
    # t h i n g s, and one closing symbol for each word's end
    assert len(encoder.last) - 1 == len("thing") + 3


def test_apart_is_what_merging_gives(encoder):
    rng, v = random.Random(3), encoder.vocabulary
    whole = [i for i in rng.sample(sorted(v.size), 3000) if v.merged(_string(v, i)) == [i] and not v.text[i].endswith("</w>")]
    ends = [i for i in rng.sample(sorted(v.size), 3000) if v.merged(_string(v, i)) == [i]]
    pairs = [(rng.choice(whole), rng.choice(ends)) for _ in range(3000)] + [(v.parts[i][1], v.parts[i][2]) for i in ends if i in v.parts]
    for a, b in pairs:
        if v.merged(_string(v, a)) == [a] and v.merged(_string(v, b)) == [b]:
            assert v.apart(a, b) == (v.merged(_string(v, a) + _string(v, b)) == [a, b]), (v.text[a], v.text[b])


def _string(v, token):
    return v._symbols(v.text[token])


def test_encode(spark, library):
    rows = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(awkward(spark), PATH).collect()}
    for row in awkward_rows():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        assert (row[0], tuple(ids), library.decode(ids, skip_special_tokens=False)) in rows
    assert bpe.encode(awkward(spark), PATH).count() == len(awkward_rows())
    assert bpe.encode(empty(spark), PATH).count() == 0
    text = "One text, twice: it's 42!"
    got = bpe.digests(bpe.encode(frame(spark, [text, text, None]), PATH)).orderBy("doc_id").collect()
    e = library.encode(text, add_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [tuple(r)[1:] for r in got[:2]] == [(len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids)))] * 2
    assert tuple(got[2])[1:] == (0, sha(""), sha(""))


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
