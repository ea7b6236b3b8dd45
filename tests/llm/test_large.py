"""Words, shingles and signatures: exactness, hash collisions of simpler hashes, and memory on a very long text."""

import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, minhash, quality

MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, "{repo}")
from tessera.llm import common, minhash, quality
words = np.random.default_rng(1).integers(0, 5_000_000, 1_000_000)
part = b" ".join(b"%06d" % w for w in words.tolist())
text = pa.array([b" ".join([part[::-1] if i % 2 else part for i in range(5)])]).cast(pa.string())
assert len(text[0].as_buffer()) > 30e6
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{work}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, before // 1024)
"""


def _peak(work):
    repo = common.__file__.rsplit("/tessera/", 1)[0]
    out = subprocess.run([sys.executable, "-c", MEMORY.format(repo=repo, work=work)], capture_output=True, text=True, check=True, timeout=300)
    peak, before = map(int, out.stdout.split())
    return peak - before


def test_memory_is_in_proportion_to_a_long_text():
    assert _peak("h, o = common.shingle_sets(text, 5, True); minhash.signature(h, o)") < 8 * 35  # MB: a text of 100 MB takes 800 beside its own
    assert _peak("quality.judged(text, quality.RULES, quality.RULES)") < 8 * 35  # MB: a text of 100 MB takes 800 beside its own
    assert _peak("quality.passes(quality.Texts(text), quality.RULES)") < 8 * 35  # MB: a text of 100 MB takes 800 beside its own


def test_words_that_polynomial_hashes_take_for_each_other():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    h, _ = common.word_hashes(pa.array([a, b]), False)
    assert h[0] != h[1]
    x, y = (" ".join([w, "one two three four five six"]) for w in (a, b))
    sets, offsets = common.shingle_sets(pa.array([x, y]), 5, True)
    assert len(np.intersect1d(sets[: offsets[1]], sets[offsets[1] :])) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x1c\x85é　", max_size=60)), max_size=12), st.integers(1, 30), st.booleans(), st.integers(0, 3))
def test_word_hashes_in_pieces(texts, size, lower, skip):
    kept, common.PIECE_BYTES = common.PIECE_BYTES, size
    try:
        h, offsets = common.word_hashes(pa.array(texts, pa.string()).slice(skip), lower)
        lines = quality.Texts(pa.array(texts, pa.string()).slice(skip))["lines"].tolist()
    finally:
        common.PIECE_BYTES = kept
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[skip:]]
    fold = (lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)) if lower else (lambda w: w)
    assert h.tolist() == [xxhash.xxh3_64_intdigest(fold(w).encode()) for ws in own for w in ws]
    assert np.diff(offsets).tolist() == [len(ws) for ws in own]
    rows = [[x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for t in texts[skip:]]
    assert lines == [[len(x), len(x) - len(set(x))] for x in rows]


def test_signatures_in_runs(monkeypatch):
    rng = random.Random(5)
    texts = pa.array([" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(60)])
    h, o = common.shingle_sets(texts, 3, True)
    whole = minhash.signature(h, o)
    monkeypatch.setattr(minhash, "RUN", 17)
    assert (minhash.signature(h, o) == whole).all()
    assert (whole[np.diff(o) == 0] == 0).all() and (whole[np.diff(o) > 0] != 0).any(axis=1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=80), max_size=10), st.integers(2, 9))
def test_repeated_windows_in_runs(texts, run):
    kept, quality.RUN = quality.RUN, run
    try:
        got = quality.Texts(pa.array(texts, pa.string()))["n_repeat_words"].tolist()
    finally:
        quality.RUN = kept
    want = []
    for t in texts:
        w = t.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want.append(len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}))
    assert got == want
