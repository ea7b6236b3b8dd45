"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, components, fingerprints, html_text, licenses, minhash, mixing, packing, quality, queries, sharding, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: An extra column for every name that the operators use inside.
CLASH = ["n", "k1", "s0", "rep", "key", "component", "component_id", "kept", "size", "copies", "target", "part", "ghost", "host", "path", "rule", "node", "slot", "shard", "bin_id", "whole", "cluster", "set", "a", "b"]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    long = _text(rng, 30_000, 5000)
    base = _text(rng, 200)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, long, "en", "b", 9), (5, base, "en", "a", 1), (6, base.upper(), "en", "b", 1), (7, " ".join(near), None, None, 1),
        (8, "one two", "en", "a", 1), (9, "one two", "en", "c", None), (10, "one two three", "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (5, base, "en", "a", 1), (11, "é ü x 日本 <|endoftext|>", "en", "", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(awkward):
    return awkward.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


# --- near-duplicates ---------------------------------------------------------------------------------------------


def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in _words(t)]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {i: find(i) for i in ids}


def _families(seed):
    """Copies of a few texts, each with some words changed, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(45):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_as_brute_force(spark, seed):
    rows = _families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = _sets(rows, 4)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, 4).collect()}
    want = _components(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_large_keys_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_KEY", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    rows = _families(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == _components(_sets(rows, 4))


def test_signatures_meet_by_pigeonhole():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, minhash.CHUNKS * minhash.WIDTH)
        b = a.copy()
        b[rng.choice(len(a), 2 * minhash.CHUNKS - 1, replace=False)] += 1
        wrong = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(1)
        assert wrong.min() <= 1


def test_near_duplicates_on_awkward_rows(clashing, empty):
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(clashing, 4).collect()}
    by = {k[0]: r for k, r in got.items() if k[0] is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[1].component_id == 1
    assert by[5].component_id == by[6].component_id == by[7].component_id == 5 and not by[6].kept
    assert by[8].component_id == by[9].component_id == 8 and by[10].component_id == 10
    assert len(by) == 11 and sum(k[0] is None for k in got) == 2
    assert minhash.near_duplicates(empty, 4).count() == 0


def test_dedup_keeps_one_of_each_group(clashing, empty):
    kept = minhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 8, 10, 11]
    assert kept.where("doc_id is null").count() == 2
    assert minhash.drop_near_duplicates(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n\té\x85 \x1c", max_size=20)), max_size=8))
def test_word_hashes_follow_the_definition(texts):
    hashes, offsets = common.word_hashes(pa.array(texts, pa.string()), lower=True)
    known = {}
    for i, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        assert offsets[i + 1] - offsets[i] == len(own)
        for w, h in zip(own, hashes[offsets[i] : offsets[i + 1]], strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    ws = common.Workspace(spark, "test")
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), ws).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(40):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_of_a_long_chain(spark):
    ws = common.Workspace(spark, "test")
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.connected_components(chain, ws).collect()} == {0}


# --- packing ---------------------------------------------------------------------------------------------------------


def _check_bins(rows, capacity, per_source, clusters):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        assert sum(r.size for r in held) <= capacity
        spans = sorted((r.bin_offset, r.bin_offset + r.size) for r in held)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
        assert max(Counter(r.source for r in held).values()) <= per_source
        assert max(Counter(clusters[r.doc_id] for r in held).values()) == 1
    return bins


def test_packing_places_every_word_once(spark):
    rng = random.Random(4)
    rows = [(i, _text(rng, rng.choice([1, 5, 30, 90, 250]), 50) if i % 9 else "same text in many copies", "en", "hot" if rng.random() < 0.5 else f"s{i % 7}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    out = packing.packed(df, capacity=100, per_source=3, group_rows=150).collect()
    size = Counter()
    for r in out:
        size[r.doc_id] += r.size
    assert size == Counter({r[0]: len(r[1].split()) for r in rows})
    bins = _check_bins(out, 100, 3, {r[0]: r[1] for r in rows})
    assert sum(r.size for r in out) / (100 * len(bins)) > 0.75


def test_search_finds_the_tightest_compatible_bin(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BINS", 2)
    rng = random.Random(5)
    bins = packing.Bins(100, 2)
    plain = []  # residual, Counter of sources, clusters
    for _ in range(500):
        size, source, cluster = rng.randrange(1, 60), 1 << rng.randrange(4), rng.choice([0, 0, 1 << rng.randrange(6)])
        fit = [b for b in plain if b[0] >= size and b[1][source] < 2 and not b[2] & cluster]
        at = bins.find(size, source, cluster)
        assert (at is None) == (not fit)
        if at is not None:
            assert bins.blocks[at[0]][at[1]][0] == min(b[0] for b in fit)
        number, offset = bins.put(size, source, cluster)
        if number == len(plain):
            plain.append([100, Counter(), 0])
        b = plain[number]
        assert offset == 100 - b[0]
        b[0] -= size
        b[1][source] += 1
        b[2] |= cluster


def test_packing_on_awkward_rows(clashing, empty):
    out = packing.packed(clashing, capacity=1000).collect()
    assert sum(r.size for r in out if r.doc_id == 4) == 30_000 and len([r for r in out if r.doc_id == 4]) == 30
    assert not [r for r in out if r.doc_id in (1, 2, 3)] and len([r for r in out if r.doc_id == 5]) == 2
    assert packing.packed(empty).count() == 0


def test_packing_counts_words_without_a_regular_expression(clashing, monkeypatch):
    plans, put = [], common.Workspace.put

    def noted(ws, df, *args):
        plans.append(df._jdf.queryExecution().toString())
        return put(ws, df, *args)

    monkeypatch.setattr(common.Workspace, "put", noted)
    size = Counter()
    for r in packing.packed(clashing).collect():
        size[r.doc_id] += r.size
    counted = clashing.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).where("n > 0")
    assert size == Counter({r.doc_id: r.n for r in counted.collect()})
    assert plans and not any("regexp" in p for p in plans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(" \t\n\x0b\x0c\r\x1c\x85\xa0\u3000ab\u65e5", max_size=12), max_size=6), st.sampled_from([1, 2, 5, 1 << 20]), st.integers(0, 6), st.sampled_from([pa.string(), pa.large_string()]))
def test_word_counts_and_hashes_of_texts(texts, run, skip, kind):
    kept, common.RUN = common.RUN, run
    try:
        got = common.word_counts(pa.array(texts, kind).slice(skip))
    finally:
        common.RUN = kept
    assert got.tolist() == [len(_words(t)) for t in texts[skip:]]
    real = [t for t in texts if t is not None]
    assert common.hashed(pa.array(real, kind).slice(skip)).tolist() == [xxhash.xxh3_64_intdigest(t.encode()) for t in real[skip:]]


def test_near_copies_never_share_a_bin(spark, empty, tmp_path):
    texts = [t for _, t in _families(3)]
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(texts)]
    rows += [(None, texts[1] + " tail", "en", "nameless", 0), (0, texts[60] + " tail", "en", "again", 0), (999, texts[60] + " tail", "en", "third", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], len(r[1].split())) for r in rows)
    component = _components(_sets([(i, r[1]) for i, r in enumerate(rows)], 5))
    of = {r[3]: component[i] for i, r in enumerate(rows)}
    assert max(Counter((r.bin_id, of[r.source]) for r in out).values()) == 1
    empty.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert queries.op2_best_fit_packing(spark, str(tmp_path)).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = [f"n{i}" for i in range(20)]
    table = sharding.lookup_table(names, 1009)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1 and len(shares) == 20
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.15 * 1009
    for bad in (lambda: sharding.lookup_table(names, 1000), lambda: sharding.lookup_table([]), lambda: sharding.lookup_table(["a", "a"])):
        with pytest.raises(ValueError):
            bad()


def test_placement_follows_the_table(clashing, empty, tmp_path):
    names = ["x", "y", "z"]
    table = sharding.lookup_table(names, 101)
    rows = sharding.place(clashing, names, "doc_id", 101).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert r.slot == slot and r.shard == names[table[slot]]
    assert sharding.place(empty, names, "doc_id", 101).count() == 0
    sharding.write_shards(clashing, str(tmp_path / "o"), names, "doc_id", 2, 101)
    back = clashing.sparkSession.read.parquet(str(tmp_path / "o"))
    assert back.count() == clashing.count() and set(clashing.columns) < set(back.columns)


# --- pages -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>a < b</script></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<div class="wrap"><div class="post post-{n}"><h1>Head &amp; line</h1><p>One<br>two &lt;x&gt;<p>Three   <a href=x>link</a> and more text, so that it is long enough.</p><ul><li>a<li>b</ul><form>in</form><div class="share-buttons">share</div></div>
<div id="comments"><p>a comment that is quite long but no content of the page at all</p></div></div><aside>side</aside><footer>f</footer></body></html>"""
MAIN = "Head & line\nOne two <x>\nThree link and more text, so that it is long enough.\na\nb"


def test_main_text(spark):
    rows = [(i, f"http://h.com/{i}", PAGE.replace("{n}", str(i))) for i in range(5)] + [(9, None, PAGE), (10, "http://h.com/x", None), (11, "http://h.com/y", ""), (12, "http://h.com/z", "plain text"), (0, "http://h.com/0", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "text", "votes", "of")})
    got = html_text.main_text(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 10 and all(texts[i] == MAIN for i in [*range(5), 9]) and texts[10] == texts[11] == "" and texts[12] == "plain text"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ap! -=\"'&;divscript\n", max_size=120))
def test_any_markup_is_parsed(html):
    text = html_text.extract(html_text.parse(html), None)
    assert "  " not in text and text == text.strip()


# --- licences ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    return licenses.train([_text(rng, 12) for _ in range(200)], steps=120)


def test_licence_families_on_held_out_variants(model):
    rng = random.Random(7)
    right = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(5):
                own = [w for w in text.split() if rng.random() > 0.08]
                own = [*(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 4))), *own]
                got = licenses.scan_paragraph(model, " ".join(own))
                total += 1
                right += bool(got) and got[0] == family
    assert right / total > 0.9
    assert all(licenses.scan_paragraph(model, t)[0] == f for f, texts in licenses.TEMPLATES.items() for t in texts)


def test_plain_paragraphs_are_unknown(model):
    rng = random.Random(8)
    assert not [t for t in licenses.NEGATIVE if licenses.scan_paragraph(model, t)]
    assert not [1 for _ in range(300) if licenses.scan_paragraph(model, _text(rng, 15))]
    assert licenses.scan_paragraph(model, "") is None and model.predict("entirely other words")[0] == licenses.UNKNOWN


def test_license_scan(spark, model, clashing, empty):
    df = spark.createDataFrame([(1, "a line\n\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (2, None), (None, "Released under the MIT License.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.license_scan(df, model).collect()}
    assert rows[1].families == ["cc-by-nc", "mit"] and [f.line for f in rows[1].findings] == [2, 3] and rows[1].n_paragraphs == 3
    assert rows[2].families == [] and rows[None].families == ["mit"]
    assert licenses.license_scan(clashing, model).count() == clashing.count() and licenses.license_scan(empty, model).count() == 0
    assert licenses.license_scan(empty).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def _shingles(text, k=5):
    w = _words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprints(clashing, empty, spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BLOCK", 2)
    for df, ranges in ((clashing.where("doc_id is not null").dropDuplicates(["doc_id"]), 3), (spark.read.parquet(f"{sf}/documents.parquet"), 20)):
        rows = sorted(fingerprints.fingerprint_edits(df, range_rows=ranges).collect(), key=lambda r: r.doc_id)
        texts = [r.text or "" for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: r.doc_id)]
        assert len(rows) == len(texts)
        for i, r in enumerate(rows):
            text, after = texts[i], texts[(i + 1) % len(texts)]
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            for got, other in ((r.near_edited, edited), (r.near_next, after)):
                a, b = _shingles(text), _shingles(other)
                want = len(a & b) / len(a | b) if a | b else 1.0
                assert abs(got - want) <= (0.2 if len(a | b) > fingerprints.K else 1e-9)
        assert len({r.fingerprint for r in rows}) >= len(set(map(frozenset, map(_shingles, texts))))
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(clashing).count() == clashing.count()
    assert fingerprints.fingerprint_edits(clashing.where("doc_id = 8")).first().near_next == 1.0


def test_sketches_merge_and_round_trip(spark):
    rng = random.Random(9)
    a, b = _text(rng, 3000, 10**6), _text(rng, 3000, 10**6)
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, both string")
    for c in ("a", "b", "both"):
        df = fingerprints.sketched(df, c, f"s_{c}")
    r = df.select(
        fingerprints.distinct_count(F.col("s_both")).alias("n"), fingerprints.containment(F.col("s_a"), F.col("s_both")).alias("inside"), fingerprints.decoded(fingerprints.encoded(F.col("s_a"))).alias("back"), "s_a",
        fingerprints.resemblance(fingerprints.merged(F.col("s_a"), F.col("s_b")), F.col("s_both")).alias("same"),
    ).first()
    assert abs(r.n - 5996) < 1500 and r.inside > 0.75 and r.back == r.s_a and r.same > 0.95


# --- quality -----------------------------------------------------------------------------------------------------------------


def _features(text):
    text = text or ""
    words = _words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if _words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n#|", max_size=60), min_size=1, max_size=6))
def test_features_as_defined(texts):
    t = quality.Texts(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(t[f][i]) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _features(text)


def test_verdicts_do_not_depend_on_the_order():
    rng = random.Random(10)
    texts = pa.array([_text(rng, rng.choice([3, 40]), rng.choice([3, 400])) + rng.choice(["", " ###" * 20, "!!" * 40]) for _ in range(60)])
    want = quality.passes(quality.Texts(texts), quality.RULES)
    for _ in range(5):
        order = list(quality.RULES)
        rng.shuffle(order)
        assert (quality.passes(quality.Texts(texts), tuple(order)) == want).all()
    assert 0 < want.sum() < 60


def test_quality_on_awkward_rows(clashing, empty):
    rows = quality.quality_report(clashing).collect()
    assert len(rows) == clashing.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert not by[1].kept and by[1].base_failed and by[1].n_words == 0 and by[5].kept and not by[8].kept
    kept = quality.quality_filter(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_report(empty).count() == 0 and quality.quality_filter(empty).count() == 0


def test_rules_of_most_rejections_for_their_cost_come_first(spark, sf):
    rules = tuple(quality.Rule(c, lambda t: t["n_words"] < 0) for c in "abcd")
    made_up = quality.by_worth(rules, {0: 10, 1: 100, 2: 3, 3: 0}, {0: 1.0, 1: 50.0, 2: 0.1, 3: 0.001})
    assert [r.name for r in made_up] == ["c", "a", "b", "d"]
    order = quality.ordered(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)


def test_rejected_texts_are_not_looked_at_again():
    texts = pa.array(["short"] * 30 + [_text(random.Random(i), 40) for i in range(10)])
    own = quality.Texts(texts)
    kept = quality.passes(own, quality.RULES)
    assert kept.tolist() == [False] * 30 + [True] * 10
    assert own.evaluated["n_words"] == own.evaluated["hashes"] == 40  # the first rule sees all, the words are hashed once
    assert all(own.evaluated[f] == 10 for f in ("n_repeat_words", "n_symbols", "n_shouts", "n_upper", "lines", "n_stutters", "word_chars"))
    report, failed, again = quality.judged(texts, quality.RULES, quality.RULES[::-1])
    assert again.tolist() == kept.tolist() and failed.tolist() == [True] * 30 + [False] * 10
    assert report.evaluated["hashes"] == report.evaluated["n_words"] == 40 and report.evaluated["n_shouts"] == report.evaluated["n_upper"] == 10


# --- URLs --------------------------------------------------------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.net/x", link % "http://q.com/z"), (2, "http://q.com/z", None), (3, "https://q.com/z#a", ""), (4, None, None), (5, "http://EX.org/fr/", '<meta http-equiv="refresh" content="0; url=/y">'), (6, "http://ex.org/y?", ""),
        (7, "http://b.net", ""), (8, "no url", ""), (9, "http://www.example.net/en/1", link % "http://b.net/1"), (10, "http://b.net/1", link % "//mixed.com/m"), (11, "http://mixed.com/m", ""), (2, "http://q.com/z", None), (12, "://", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "ruled", "node", "to", "fate")})
    got = urls.judge(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].rule, by[1].verdict) == ("net/", "block") and (by[2].rule, by[2].verdict) == (None, "block") and by[3].verdict == "block"
    assert (by[5].host, by[5].path, by[5].rule, by[5].verdict) == ("ex.org", "/fr/", "org/fr/", "allow") and by[6].verdict == "allow"
    assert (by[7].path, by[7].rule) == ("", None) and (by[4].host, by[4].path, by[4].verdict) == ("", "", "allow") and by[8].host == ""
    assert by[9].rule == "example.net/en/" and by[10].verdict == "block" and by[11].verdict == "allow"  # an explicit allow among the aliases
    more = spark.createDataFrame([("http://q.com/z", "http://r.com/1"), (None, "x"), ("http://s.com/", None)], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge(df.unionByName(df.limit(1).withColumns({"page_id": F.lit(20).cast("long"), "url": F.lit("http://r.com/1"), "html": F.lit("")})), redirects=more).collect()}[20] == "block"
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.page_id for r in urls.allowed(df).collect()} == {3, 4, 5, 6, 7, 8, 9, 11, 12} - {3}


def test_many_rules_join_as_few(spark, monkeypatch, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    few = {r.page_id: r for r in urls.judge(pages).collect()}
    monkeypatch.setattr(urls, "INLINE_RULES", 0)
    assert {r.page_id: r for r in urls.judge(pages).collect()} == few


# --- mixing --------------------------------------------------------------------------------------------------------------------


def _targets(sizes):
    """Water-filling by rounds: shares by weight, what is above a cap goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {**{s: weight[s] * level for s in free}, **capped}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, _text(rng, rng.choice([1, 3, 10, 40, 150])), "en", rng.choice(["hot"] * 5 + ["a", "b", "small", None]), 0) for i in range(900)]
    rows = [r for r in rows if r[3] != "small" or r[0] % 9 == 0]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, common.Workspace(spark, "test")).collect()
    again = mixing.mix(df.repartition(7), common.Workspace(spark, "test")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want, taken = _targets(sizes), Counter()
    for r in out:
        assert r.size == len(rows_by(rows)[r.doc_id][1].split()) and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 150 for s in want)
    assert want["small"] == 3 * sizes["small"] and taken["small"] == want["small"]


_by = {}


def rows_by(rows):
    if id(rows) not in _by:
        _by.clear()
        _by[id(rows)] = {r[0]: r for r in rows}
    return _by[id(rows)]


def test_rounding_is_unbiased(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), "en", "ab"[i % 2], 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    taken = Counter()
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix(df, common.Workspace(spark, "test")).where("source = 'a'").collect():
            taken[r.doc_id] += r.copies
    assert 0.4 < sum(taken.values()) / (12 * 30) < 0.9 and 1 < len([i for i in taken if taken[i]])


def test_mix_on_awkward_rows(clashing, empty, spark):
    out = mixing.mix(clashing, common.Workspace(spark, "test")).collect()
    assert len(out) == clashing.count() and all(r.copies == 0 for r in out if r.size == 0)
    rows = mixing.mixed_documents(clashing)
    assert rows.columns == clashing.columns and rows.count() > 0
    assert mixing.mix(empty, common.Workspace(spark, "test")).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- queries and pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.near_dedup(spark, first, sf)
    texts = [(r.doc_id, r.text) for r in first.collect()]
    want = _components(_sets(texts, 5))
    assert {r.doc_id for r in second.collect()} == set(want.values())
    third = corpus_pipeline.mix_sources(spark, second, sf)
    assert third.columns == docs.columns
    copies = Counter(r.doc_id for r in third.collect())
    mixed = {r.doc_id: r.copies for r in mixing.mix(second, common.Workspace(spark, "test")).collect()}
    assert copies == Counter({i: n for i, n in mixed.items() if n})
    last = corpus_pipeline.pack_bins(spark, third, sf).collect()
    _check_bins(last, packing.CAPACITY, packing.PER_SOURCE, {i: i for i in copies})
    size = Counter()
    for r in last:
        size[r.doc_id] += r.size
    assert size == Counter({r.doc_id: copies[r.doc_id] * len(_words(r.text)) for r in second.collect() if copies[r.doc_id]})


def test_pipeline_on_awkward_rows(awkward, tmp_path, spark):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    awkward.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, sf, name):
    table = "pages" if name[:4] in ("op4_", "op9_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    assert queries.QUERIES[name](spark, sf).select(key).distinct().count() == rows.where("1 = 1").count()


def test_lookup_table_as_whole_permutations():
    """The table by writing down each shard's whole order of the slots, and striking out what is taken."""
    shards, slots = [f"shard-{i:03d}" for i in range(11)], 1009
    orders = []
    for name in shards:
        digits = hashlib.md5(name.encode()).hexdigest()
        first, step = int(digits[:15], 16) % slots, 1 + int(digits[15:30], 16) % (slots - 1)
        orders.append([(first + k * step) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = i
                orders[i] = free[1:]
    assert sharding.lookup_table(shards, slots) == [owner[x] for x in range(slots)]
    counts = Counter(owner.values())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_many_rows_of_one_key_are_many_blocks_and_keep_the_target(spark):
    """A third of all rows are one and the same, and many have no doc_id: the mix meets its targets, and takes each as often as it says."""
    rng = random.Random(3)
    same = [(7, "one two three four", "a")] * 400
    rows = same + [(None, _text(rng, rng.randrange(1, 40)), rng.choice("abc")) for _ in range(300)] + [(100 + i, _text(rng, rng.randrange(1, 60)), rng.choice("bcd")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, common.Workspace(spark, "test")).collect()
    assert len(got) == len(rows)
    longest = {}
    for _, text, source in rows:
        longest[source] = max(longest.get(source, 0), len(text.split()))
    for source in "abcd":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= longest[source]
    mixed = mixing.mixed_documents(docs)
    taken = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    assert taken == +want


def test_rules_of_equal_length_are_decided_alike(spark, monkeypatch):
    rules = (("block", "net.net", "/a"), ("block", "net", "/a/xyz"), ("allow", "b.net", "/x"), ("block", "net", "/x/yy"))
    pages = spark.createDataFrame([(1, "http://net.net/a/xyz", ""), (2, "http://b.net/x/yy", ""), (3, "http://c.net/" + "a" * 100_000, ""), (4, None, None)], "page_id long, url string, html string")
    few = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    monkeypatch.setattr(urls, "INLINE_RULES", 0)
    many = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert few == many and few[2] == ("net/x/yy", "block") and few[3] == few[4] == (None, "allow")
