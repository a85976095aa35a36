import random

import public_tokenizers
import pytest

from loomspan.llm import chat, piece_codec, queries, token_count
from tests.llm.helpers import AWKWARD, documents
from tests.oracle import compare, connection

PARTS = [" ", "  ", "\n", "\t", "\r", "a", "b", "the", "é", "Ü", "!", "?", "'s", "1", "23", "\xa0", "　", "\x0b", "\x1c", "<|endoftext|>", "▁", "😀", "\x00", "﻿", "中", "<0x0A>", "</s>", "²"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["x" * 5000, "ab " * 3000]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = fuzz(5000)
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(path, cache_entries=300, batch_bytes=1000).count(texts) == want


def test_count_rows(spark):
    got = token_count.count_tokens(documents(spark, AWKWARD), public_tokenizers.path("byte_bpe_50k.json"), limit=5).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and not by[1]["over_limit"] and by[5]["n_bytes"] == 600


def test_pieces_equal_the_library():
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"), cache_entries=500)
    for t in fuzz(3000, 2):
        ids = codec.encode(t)
        assert ids == codec.lib.encode(t, add_eos=True)
        assert codec.decode(ids) == t.replace("▁", " ")


def test_heap_and_rows_agree():
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    cuts = list({c for t in fuzz(2000, 3) for c in codec.cuts(t)})
    assert codec.encode_cuts(cuts) == [codec.encode_cut(c) for c in cuts]


def test_a_difference_is_an_error():
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(RuntimeError):
        codec.compare(["hello"], [(5,)])


def test_piece_rows(spark):
    rows = documents(spark, AWKWARD)
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(rows, model).collect()}
    assert got[1]["ids"] == [2] and got[1]["decoded"] == "" and got[4]["decoded"] == "a"
    assert piece_codec.encode_digest(rows, model).count() == len(AWKWARD)


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "z") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, turns string").repartition(3)


CHAT = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "<\\|x|> <|im_start|>\\<|"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, None), (None, 1, "us\ner", "b"), (5, 1, "user", "x"), (5, 0, "user", "y" * 30000),
]


def test_chat_round_trip(spark):
    done = chat.chat_format(conversations(spark, CHAT))
    parsed = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.chat_parse(done).collect()}
    want = {}
    for c, t, r, x in sorted(CHAT, key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert parsed == want
    rows = {r["conv_id"]: r for r in done.collect()}
    assert rows[1]["valid"] and not rows[2]["valid"] and not rows[3]["valid"] and not rows[5]["valid"]
    assert "".join(s["text"] for s in rows[1]["segments"]) == rows[1]["formatted"] and rows[1]["formatted"].count("<|im_start|>") == 5
    assert [s["loss"] for s in rows[1]["segments"]].count(True) == 2
    assert chat.chat_format(conversations(spark, CHAT).where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], connection(folder), folder)
