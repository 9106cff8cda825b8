import base64
import random

import public_tokenizers
import pytest
import tiktoken

from wayspark.llm import byte_bpe as M


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return M.Encoder(public_tokenizers.path(M.VOCABULARY), public_tokenizers.PATTERN)


def samples(n):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, 0x2000, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x1F600, 0x300, 0x660, 0x2160, 0x4E00, 0x200B]]
    pool += ["'s", " 's", "\r\n", "<|endoftext|>", "  ", "\t\t", " ", " ", "word", " word", "123"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_are_those_of_tiktoken(encoder, reference):
    for s in samples(3000):
        want = reference.encode_ordinary(s)
        assert encoder.ids(s).tolist() == want
        for size in (1, 7):
            cut = [p for part in encoder.pieces(s, size) for p in part]
            assert cut == encoder.finder(s)(s) and "".join(cut) == s


def test_query_columns(make_docs, odd, reference):
    import hashlib

    docs = make_docs(list(enumerate(odd)))
    for r in M.digests(docs).collect():
        text = odd[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert M.digests(make_docs([])).count() == 0


def test_offsets_and_split_characters(make_docs):
    text = "é \U0001f600 naïve 日本"
    r = M.encode(make_docs([text]), offsets=True).first()
    table = M.token_bytes(M.Tokenizer.from_file(public_tokenizers.path(M.VOCABULARY)))
    for i, a, b in zip(r.ids, r.starts, r.ends):
        assert table[i] in text[a:b].encode()
    cut = M.decode(M.encode(make_docs([text])).selectExpr("doc_id", "slice(ids, 1, 3) as ids")).first().content
    assert text.encode().startswith(cut) and M.text_of(cut).startswith("é")


def test_bounded_table(encoder, monkeypatch, reference):
    monkeypatch.setattr(M, "REMEMBERED", 10)
    for s in samples(50):
        assert encoder.ids(s).tolist() == reference.encode_ordinary(s)
        assert len(encoder.met) <= 40


def test_byte_characters():
    chars = M.byte_characters()
    assert len(set(chars)) == 256 and chars[ord("a")] == "a" and chars[32] == "Ġ" and chars[10] == "Ċ"


def test_long_texts_are_cut_at_any_match(encoder, reference):
    for text in ("\n" * 5000 + "x", "ab,cd\n" * 3000, "日本" * 4000 + " 語" * 3000, "it'll" * 3000, " " * 3000):
        parts = list(encoder.pieces(text, 500))
        assert [p for part in parts for p in part] == encoder.finder(text)(text)
        assert max(len("".join(p)) for p in parts) <= max(500, 2 * max(len(x) for p in parts for x in p) + M.LOOK)
        assert encoder.ids(text).tolist() == reference.encode_ordinary(text)


def test_both_vocabulary_files_are_the_same(encoder, reference):
    """Ids are those of the ranks in the .tiktoken file, for every token."""
    table = M.token_bytes(encoder.tokenizer)
    ranks = reference._mergeable_ranks
    assert {b: i for i, b in table.items()} == {b: i for b, i in ranks.items() if i in table} and len(table) == len(ranks)


def test_kept_columns_of_any_name(make_docs):
    docs = make_docs(["a b", None]).selectExpr("*", "named_struct('x y', 1) as `a.b`", "2 as `my col`", "3 as `x``y`")
    out = M.encode_and_decode(docs, keep=("a.b", "my col", "x`y"))
    assert out.columns == ["doc_id", "a.b", "my col", "x`y", "ids", "content"] and out.count() == 2
