import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm import bpe
from strandwork.llm.queries import VOCABULARY

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")

# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(VOCABULARY)
    return bpe.RankQueueEncoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(encoder, texts):
    count, flat = encoder.encode(texts)
    out, at = [], 0
    for n in count.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


CASES = [None, "", " ", "'s'll  're''s x's\n's \t 've", "don't we'll I'd they'REx", " a  b\n\n c", "'", "it''s", "a'ſ b'S", "x \n", "​ \x1c\x1d a\x85b", "👍🏽 é̀ ½²x٣", "<|endoftext|> [MASK]", "a" * 5000, "ACDEFGHIKLMNPQRSTVWY" * 900, "\r\n\t ", "'ll'", "'l", "'r", " 's", "日本語テキスト。", "��", "A" * 257 + "é" * 300]


def test_cases(both):
    encoder, reference = both
    assert split(encoder, CASES) == [reference.encode_ordinary(t) if t else [] for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="'slvetrmd \n\tA1é", max_size=40), max_size=6))
def test_any_text(both, texts):
    encoder, reference = both
    assert split(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_random_pieces(both):
    encoder, reference = both
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (3, 17, 400, 6000)]
    assert split(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_table(spark, both):
    _, reference = both
    rows = [(i, t, "extra") for i, t in enumerate(CASES)] + [(0, None, "repeat")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_texts(df, VOCABULARY).collect()]
    assert sorted(got) == sorted((i, reference.encode_ordinary(t) if t else []) for i, t, _ in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.where("doc_id > 0"), VOCABULARY).collect()}
    assert counts[1] == 0 and counts[14] == len(reference.encode_ordinary(CASES[14]))
    assert bpe.encode_texts(df.limit(0), VOCABULARY).count() == 0
