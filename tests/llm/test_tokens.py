"""Token counts at every prefix, against the library."""

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Some of what the library's Unicode version and ours class differently.
ODD = ["ᲀ", "\u1c89", "\ua7cb", "\U00010d4a", "\U0001e6c0", "\u0897"]
PIECES = ["a", "the", "'re", "'ll", "'s", "'", "!", " ", "  ", "\n", "\n\n", "\t", "1", "23", "é", "ß", "<|endoftext|>", "<|", "日本", "　", "x", "ing", " of", "\U0001f600", "\x1c", "\x85", *ODD]


def counted(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20), st.sampled_from([1, 3, 1 << 18]))
def test_counts_at_every_prefix(parts, run):
    text = "".join(parts)
    own, kept = tokens.counter(PATH), tokens.RUN_CHARS
    want = [counted(text[:i]) for i in range(len(text) + 1)]
    tokens.RUN_CHARS = run
    try:
        assert own.prefix_counts(text).tolist() == want and own.count(text) == want[-1]
        for budget in (0, 1, 4, 9):
            assert own.count_and_cut(text, budget) == (want[-1], max(i for i, c in enumerate(want) if c <= budget))
    finally:
        tokens.RUN_CHARS = kept


def test_odd_characters_at_the_real_budget():
    rng = random.Random(2)
    for _ in range(12):
        text = "".join(rng.choice([*PIECES, " word", " another", "."]) for _ in range(1500))
        n, within = tokens.counter(PATH).count_and_cut(text, 512)
        near = [i for i in range(max(0, within - 60), min(len(text), within + 60) + 1) if counted(text[:i]) <= 512]
        assert n == counted(text) and within == near[-1]


def test_every_character_is_classed_as_by_the_library():
    own = tokens.counter(PATH)
    chars = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xFB00, 0x10000), *range(0x10000, 0x11000), *range(0x1E000, 0x1F000)] if not 0xD800 <= c < 0xE000]
    for a in range(0, len(chars), 200):
        for glue in ("", "a", "1", "!", " "):
            text = glue.join(chars[a : a + 200])
            assert own.count(text) == counted(text), (a, glue)


def test_whole_documents_and_no_library():
    own = tokens.PrefixCounter(PATH)
    own.encode = None
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert [own.count(t or "") for t in texts] == [counted(t or "") for t in texts]
    assert not any(isinstance(v, Tokenizer) for v in vars(own).values())  # what is left of it cuts probes into pieces
    short = [t for t in texts if t and len(t) < 600][:10]
    assert all(own.prefix_counts(t).tolist() == [counted(t[:i]) for i in range(len(t) + 1)] for t in short)


def test_budgets_come_from_the_kept_counts():
    own = tokens.PrefixCounter(PATH)
    text = " ".join(f"word{i % 97}" for i in range(20_000))
    own.count(text)
    met = len(own.counts)
    own._inside = None  # nothing new is looked at for any other budget
    for budget in (1, 512, 30_000, 10**9):
        assert own.count_and_cut(text, budget)[0] == counted(text)
    assert len(own.counts) == met


@pytest.mark.parametrize("text", ["x" * 300_000, "=" * 300_000, " " * 300_000, "日" * 100_000, "ab1 " * 300_000, "<|endoftext|>" * 5_000])
def test_long_texts(text):
    assert tokens.counter(PATH).count_and_cut(text, 512)[0] == counted(text)


def test_token_counts(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "two words"), (5, "two words"), (None, "é ü x 日本 <|endoftext|>"), (8, long[:3000] + "ᲀ" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n_tokens", "n_bytes", "over_limit", "limit")})
    got = sorted(tokens.token_counts(docs, PATH, 512).collect(), key=lambda r: (r.n_bytes, r.doc_id or 0))
    want = sorted(((len((t or "").encode()), i or 0, counted(t or "")) for i, t in rows))
    assert [(r.n_bytes, r.doc_id or 0, r.n_tokens) for r in got] == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert all(counted((dict((len((t or "").encode()), t or "") for _, t in rows)[r.n_bytes])[: r.n_chars_within]) <= 512 for r in got)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0
