"""Pieces by array operations against the pattern, ids in bulk against the library, and damage anywhere in a block."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pyrocell.llm import queries, token_files
from pyrocell.llm.bpe import PIECES

PARTS = ["'", "'", "s", "t", "re", "ve", "ll", "m", "d", "r", "a", " ", " ", "\n", "\t", "\x85", "É", "1", "٣", "#", "!", "日", "🙂", "\x00", "S"]


def some_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(n)]


def test_pieces_equal_the_pattern():
    texts = some_texts(20_000)
    data, size = "".join(texts).encode(), np.array([len(t.encode()) for t in texts])
    at = token_files.pieces_of(data, np.cumsum(size) - size, size).tolist()
    assert [data[a:b].decode() for a, b in zip(at, [*at[1:], len(data)])] == [p for t in texts for p in PIECES.findall(t)]


def test_ids_in_bulk_equal_the_library_in_a_few_calls():
    path = public_tokenizers.path(queries.TOKENIZER)
    texts, library = [*some_texts(3000), None, "x <|endoftext|> 's", "y" * 5000], Tokenizer.from_file(path)
    ids = token_files.Ids(open(path, encoding="utf-8").read())
    whole, calls = ids.whole, []
    ids.whole = lambda t: calls.append(t) or whole(t)
    for _ in range(2):  # the second time from memory
        tokens, sizes = token_files.ids_of(pa.array(texts), ids, 2)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert tokens.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert calls == ["x <|endoftext|> 's"] * 2


def test_damage_is_noticed_to_the_last_byte_of_a_block():
    ids = np.random.default_rng(2).integers(0, 50_000, 300).astype(np.uint16)
    payload = token_files.compress(ids)
    for at in [*range(20, len(payload), 23), *range(len(payload) - 9, len(payload))]:
        broken = bytearray(payload)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_files.decompress(bytes(broken))
