import base64
import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.llm import tokenizer as T

if not Path(T.VOCABULARY).exists():
    pytest.skip("no vocabulary", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")

VOC = Path(T.VOCABULARY).read_bytes()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOC.splitlines())}
REF = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = T.Encoder(VOC)
TEXTS = ["", "hello world", "Don't we'll I'm 'S", "  two  spaces \n\n\ttabs\r\n", "Ñandú é́ Ωmega 東門 の 地図 👨‍👩‍👧‍👦", "x" * 5000, "<|endoftext|>", "1234567 3.14", "\x00\x01", "ﬁne ﬂow ½ №7 ™", " " * 300 + "a"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = ENC.encode(text)
    assert ids == REF.encode_ordinary(text)
    assert b"".join(ENC.tokens[i] for i in ids) == text.encode()


def test_prefix_table_grows():
    data = "unbelievableness".encode()
    last = []
    for k in range(1, len(data) + 1):
        ENC.extend(last, data[:k])
        assert ENC.read(last) == REF.encode_ordinary(data[:k].decode())


def test_appends_and_edits():
    rnd = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "é", "'", "ll", "12", "don't", "🙂", ".", "the", " Wald"]
    for _ in range(300):
        x = T.Encoding(ENC, "".join(rnd.choices(parts, k=rnd.randrange(30))))
        for _ in range(5):
            at = rnd.randint(0, len(x.text))
            x.replace(at, rnd.randint(0, min(5, len(x.text) - at)), "".join(rnd.choices(parts, k=rnd.randrange(4))))
            x.append("".join(rnd.choices(parts, k=rnd.randrange(3))))
            assert x.tokens() == REF.encode_ordinary(x.text)


class Counting(T.Encoder):
    """Counts the table entries that are worked out."""

    made = 0

    def valid_pair(self, a, b):
        self.made += 1
        return super().valid_pair(a, b)


def test_changes_of_a_long_word_cost_their_surroundings():
    rnd = random.Random(9)
    word = "".join(rnd.choices("abcdefghilmnoprstu", k=4000))
    enc = Counting(VOC)
    x = T.Encoding(enc, word)
    whole, enc.made = enc.made, 0
    x.append("ing")
    assert x.tokens() == REF.encode_ordinary(word + "ing") and enc.made < whole / 50
    enc.made = 0
    x.replace(2000, 3, "zzyx")
    assert x.tokens() == REF.encode_ordinary(x.text) and enc.made < whole / 4
    x.replace(1990, 900, "")
    assert x.tokens() == REF.encode_ordinary(x.text)


def test_every_token_is_its_own_encoding():
    assert all(ENC.encode_bytes(t) == [r] for t, r in list(RANKS.items())[::7])


def test_vocabulary_without_a_byte():
    enc = T.Encoder(b"YQ== 0\nYg== 1")  # a, b
    assert enc.encode_bytes(b"ab") == [0, 1]
    with pytest.raises(ValueError):
        enc.encode_bytes(b"abc")


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x"), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["ids"]) for r in T.token_ids(df).collect()), key=repr)
    assert got == sorted(((i, REF.encode_ordinary(t) if t else []) for i, t in rows), key=repr)
    assert T.token_ids(df.limit(0)).count() == 0
    assert sys.getsizeof(ENC._words) < 1 << 28
