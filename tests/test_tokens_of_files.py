"""Tokens of a vocabulary file, blocks scored by a model, and pruning by both, against plain loops."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspan.operators import prune as P
from loomspan.operators.models import ModelScorer, batches_by_length, overlap_model
from loomspan.operators.scorers import LexicalScorer
from loomspan.operators.tokenizers import CharTokenizer, FileTokenizer, token_ranges

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "A red fox ran.", "naïve 😀😀 日本語テキスト。", "x" * 3000, "a  b\n\nc\t<|endoftext|> d", "Größe é" * 40]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_tokens_equal_the_library(spark):
    rows = [(0, TEXTS), (1, []), (2, None), (3, [TEXTS[3], None, "b"])]
    got = {r["i"]: r["k"] for r in spark.createDataFrame(rows, "i int, t array<string>").repartition(2).select("i", FileTokenizer(FILE).tokens(F.col("t")).alias("k")).collect()}
    lib = library()
    for i, texts in rows:
        want = [lib.encode(t or "", add_special_tokens=False) for t in texts or []]
        assert [[(t["id"], t["a"], t["b"]) for t in k] for k in got[i] or []] == [[(x, *o) for x, o in zip(e.ids, e.offsets)] for e in want]


def test_char_tokens(spark):
    got = spark.createDataFrame([(["aé", ""],)], "t array<string>").select(CharTokenizer().tokens(F.col("t")).alias("k")).first()["k"]
    assert [[tuple(t) for t in k] for k in got] == [[(97, 0, 1), (233, 1, 2)], []]


def test_token_ranges_by_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for i in range(60):
        at, tok = 0, []
        for _ in range(rng.integers(0, 12)):
            at += int(rng.integers(0, 2))
            end = at + int(rng.integers(1, 4))
            tok.append((0, at, end))
            if rng.random() < 0.2:
                tok.append((0, at, end))  # bytes of one character
            at = end
        spans = sorted((int(a), int(a + n)) for a, n in zip(rng.integers(0, 20, 4), rng.integers(0, 8, 4)))
        rows.append((i, tok, spans))
        hits = [[k for k, (_, a, b) in enumerate(tok) if a < y and b > x] if y > x else [] for x, y in spans]
        want.append([(h[0], h[-1] + 1) if h else None for h in hits])
    df = spark.createDataFrame(rows, "i int, tok array<struct<id:int,a:int,b:int>>, spans array<struct<a:int,b:int>>")
    for r in df.select("i", token_ranges(F.col("tok"), F.col("spans")).alias("r")).collect():
        assert [tuple(x) if x["b"] > x["a"] else None for x in r["r"]] == want[r["i"]]


# --- pruning


def contexts(spark):
    sentences = ["A red fox ran over the hill. ", "Nothing here; ", "the RED fox and the naïve 日本 fox. " * 12, " ", "😀😀 red"]
    rows = [(0, 0, "red fox", sentences), (0, 1, "", ["x"]), (1, 0, "naïve 日本", sentences[::-1]), (2, 0, "why " * 30, ["fox " * 40, "red. "]), (2, 1, "q", [" "])]
    return spark.createDataFrame(rows, "query_idx int, context_idx int, query string, manual_sentences array<string>").withColumn("context_text", F.lit(None).cast("string")).repartition(3), rows


def loop(sentences, query, window, score):
    """What prune does with tokens of the file, in a plain loop. score(query text, query ids, blocks of (text, ids), places)."""
    lib = library()
    limit = max(16, window // 2)
    frags, per = [], []
    for s in sentences:
        e = lib.encode(s, add_special_tokens=False)
        cuts = list(range(0, len(e.ids), limit))
        per.append(len(cuts))
        for c in cuts:
            a = 0 if c == 0 else e.offsets[c][0]
            ends = [o[0] for o in e.offsets[c + 1 :]] + [len(s)]
            upto = lambda n, s=s, ends=ends, a=a: s[a : ends[n - 1]] if n else ""
            frags.append((e.ids[c : c + limit], upto))
    query_ids = lib.encode(query, add_special_tokens=False).ids
    base, used, blocks, taken = len(query_ids) + 1, None, [], []
    for k, (ids, _) in enumerate(frags):
        if used is None or used + len(ids) > window - 2:
            n = len(ids) if used is None and base + len(ids) <= window - 2 else min(len(ids), max(1, window - 2 - base))
            blocks.append([])
            used = base
        else:
            n = len(ids)
        used += n
        blocks[-1].append(k)
        taken.append(n)
    scores, keeps = score(query, query_ids, [[(frags[k][1](taken[k]), frags[k][0][: taken[k]]) for k in b] for b in blocks])
    flat, means, at = [p for b in keeps for p in b], [], 0
    for n in per:
        means.append(sum(flat[at : at + n]) / n if n else 0.0)
        at += n
    return scores, means


@pytest.mark.parametrize("window", [40, 64, 512])
def test_pruning_in_tokens(spark, window):
    df, rows = contexts(spark)
    got = {(r["query_idx"], r["context_idx"]): r for r in P.prune(df, None, window=window, tokenizer=FileTokenizer(FILE)).collect()}

    def terms(t):
        import re

        return set(re.findall(r"[^\W_]+", t.lower()))

    def score(query, _, blocks):
        q = terms(query)
        share = lambda t: round(len(q & terms(t)) / len(q), 6) if q else 0.0
        return [share("".join(t for t, _ in b)) for b in blocks], [[share(t) for t, _ in b] for b in blocks]

    for i, k, query, sentences in rows:
        kept = [s for s in sentences if s.strip()]
        scores, means = loop(kept or [""], query, window, score)
        r = got[i, k]
        if kept:
            assert r["sentence_probabilities"] == pytest.approx(means) and r["block_scores"] == pytest.approx(scores)
            assert r["pruned_context"] == "".join(s for s, m in zip(kept, means) if m > 0.1)
    assert (min(r["scored_share"] for r in got.values()) == 1) == (window == 512)


class Counting:
    """A model that tells how often it was loaded and called; its numbers depend on ids and places, never on padding."""

    loaded = 0

    def __init__(self, log):
        self.log = log
        open(log, "a").write("load\n")

    def __call__(self, ids, mask, types):
        open(self.log, "a").write(f"call {ids.shape[0]} {ids.shape[1]}\n")
        place = np.arange(ids.shape[1])
        value = ((ids * 31 + place * 7 + types * 3) % 101) / 25 - 2
        rank = (value * mask).sum(axis=1) / mask.sum(axis=1)
        return rank, np.stack([np.zeros_like(value), value], axis=2)


@pytest.mark.parametrize("window,batch,buffer", [(64, 1, 1), (64, 300, 10), (64, 1 << 14, 1 << 18), (40, 500, 1 << 18)])
def test_pruning_by_a_model(spark, tmp_path, window, batch, buffer):
    df, rows = contexts(spark)
    log = str(tmp_path / "log")
    scorer = ModelScorer(lambda: Counting(log), FileTokenizer(FILE), start=7, separator=9, batch_tokens=batch, buffer_tokens=buffer)
    got = {(r["query_idx"], r["context_idx"]): r for r in P.prune(df.coalesce(1), None, window=window, scorer=scorer).collect()}

    def score(query, query_ids, blocks):
        scores, keeps = [], []
        for b in blocks:
            context = [x for _, ids in b for x in ids]
            ids = np.array([[7, *query_ids, 9, *context, *([9] if context else [])]])
            head = len(query_ids) + 2
            types = (np.arange(ids.shape[1]) >= head).astype(np.int64)[None]
            rank, keep = Counting(log)(ids, np.ones_like(ids), types)
            p = 1 / (1 + np.exp(keep[0, :, 0] - keep[0, :, 1]))
            scores.append(1 / (1 + np.exp(-rank[0])))
            at, mine = head, []
            for _, x in b:
                mine.append(float(np.mean(p[at : at + len(x)])) if x else 1.0)
                at += len(x)
            keeps.append(mine)
        return scores, keeps

    calls = open(log).read().splitlines()
    assert calls.count("load") >= 1
    for i, k, query, sentences in rows:
        kept = [s for s in sentences if s.strip()]
        if kept:
            scores, means = loop(kept, query, window, score)
            assert got[i, k]["block_scores"] == pytest.approx(scores, abs=1e-6) and got[i, k]["sentence_probabilities"] == pytest.approx(means, abs=1e-6)
    sizes = [tuple(map(int, c.split()[1:])) for c in calls if c.startswith("call")]
    assert all(n * m <= batch or n == 1 for n, m in sizes)
    if batch == 1 << 14:
        assert max(n for n, _ in sizes) > 3  # blocks of several rows met in a batch


def test_batches_hold_every_block_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 200, 500)
    for most in (1, 150, 4000):
        got = list(batches_by_length(lengths, most))
        assert sorted(np.concatenate(got).tolist()) == list(range(500))
        assert all(len(b) == 1 or len(b) * lengths[b].max() <= most for b in got)


def test_wrong_shapes_are_an_error(spark):
    df, _ = contexts(spark)
    bad = ModelScorer(lambda: lambda ids, mask, types: (np.zeros(len(ids)), np.zeros(ids.shape)), FileTokenizer(FILE))
    with pytest.raises(Exception, match="a model gave shapes"):
        P.prune(df, None, scorer=bad).collect()


def test_overlap_model_keeps_what_is_asked(spark):
    df, _ = contexts(spark)
    got = P.prune(df, None, scorer=ModelScorer(overlap_model, FileTokenizer(FILE)), threshold=0.1).where("query_idx = 0 and context_idx = 0").first()
    assert "A red fox ran" in got["pruned_context"] and "Nothing" not in got["pruned_context"]


def test_a_question_that_leaves_no_room(spark):
    rows = spark.createDataFrame([(0, 0, "why " * 70, "A fox. " * 20)], "query_idx int, context_idx int, query string, context_text string")
    assert P.prune(rows, None, window=256).first()["scored_share"] < 0.2
    with pytest.raises(Exception, match="less than a fragment"):
        P.prune(rows, None, window=256, cut_fragments="error").collect()
    assert P.prune(rows, None, window=2048, cut_fragments="error").first()["scored_share"] == 1
    with pytest.raises(ValueError):
        P.prune(rows, cut_fragments="no")


def test_all_of_every_text_is_scored(spark):
    from loomspan.plans.q_prune import pruned
    from tests.oracle import SMALL

    assert pruned(spark, SMALL).agg(F.min("scored_share")).first()[0] == 1


def test_scorers_and_tokens_mix(spark):
    """A lexical scorer on a vocabulary's fragments reads the same whole sentences as on characters, where these aren't cut."""
    df, _ = contexts(spark)
    key = ["query_idx", "context_idx"]
    a = P.prune(df, None, window=4096, scorer=LexicalScorer()).select(*key, "sentence_probabilities").orderBy(*key).collect()
    b = P.prune(df, None, window=4096, scorer=LexicalScorer(), tokenizer=FileTokenizer(FILE)).select(*key, "sentence_probabilities").orderBy(*key).collect()
    assert a == b


def test_batches_go_to_a_model_in_pieces():
    """A batch of many rows is no more to a model than its buffer, a longer row by itself; nothing is lost."""
    import pyarrow as pa

    from loomspan.operators.models import pieces_of

    ids = pa.array([[[1, 2], [3]], [], [[4] * 50], None, [[5, 6]], [[7] * 4], [[8]]], pa.list_(pa.list_(pa.int32())))
    heads = pa.array(range(7))
    got = list(pieces_of(ids.slice(0), heads, 6))
    assert [x for r, _ in got for x in r.to_pylist()] == ids.to_pylist() and [x for _, h in got for x in h.to_pylist()] == list(range(7))
    assert all(len(r.flatten().flatten()) <= 6 or len(r) == 1 for r, _ in got) and len(got) == 4
    part = ids.slice(2, 4)
    assert [x for r, _ in pieces_of(part, heads.slice(2, 4), 6) for x in r.to_pylist()] == part.to_pylist()
