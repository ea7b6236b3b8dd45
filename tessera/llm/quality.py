"""Quality rules as a short-circuit cascade, the rules that reject most for their cost first."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUN, SPACES, as_texts, flat, hashed, mixed, pieces, rolling, slices, word_hashes

WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated, about; the verdicts don't depend on it.
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_BREAK = np.arange(256) == 0x0A
_IS_SHOUT = np.isin(np.arange(256), list(b"!?"))
_IS_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_IS_ALPHA = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))
_IS_TAIL = (np.arange(256) & 0xC0) == 0x80


class Texts:
    """Features of a run of texts, each made when a rule first asks for it and then kept.

    `only` leaves those rows that are still of interest: features asked for from then on are counted for these alone, features
    counted before stay. evaluated: how many values of each feature were counted.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.ends = flat(texts)
        self.kept: dict[str, np.ndarray] = {}
        self.words: tuple[np.ndarray, np.ndarray] | None = None
        self.texts: pa.Array | None = texts
        self.evaluated: Counter = Counter()

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = getattr(self, "_" + name)()
            self.evaluated[name] += len(self)
        return self.kept[name]

    def only(self, mask: np.ndarray) -> Texts:
        """These texts without those that the mask leaves out."""
        if mask.all():
            return self
        out = object.__new__(Texts)
        out.texts, out.evaluated = None, self.evaluated
        out.kept = {k: v[mask] for k, v in self.kept.items()}
        out.data, out.ends = _picked(self.data, self.ends, mask)
        out.words = _picked(*self.words, mask) if self.words else None
        return out

    def _bytes(self, table: np.ndarray) -> np.ndarray:
        return _sums(self.data, self.ends, table)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            self.words = word_hashes(self.texts if self.texts is not None else as_texts(self.data.tobytes(), self.ends), lower=False)
            self.evaluated["hashes"] += len(self)
        return self.words

    def _n_words(self) -> np.ndarray:
        return np.diff(self.hashes()[1])

    def _n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        h, offsets = self.hashes()
        same = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
        same[offsets[:-1][np.diff(offsets) > 0]] = False
        return _sums(same, offsets)

    def _word_chars(self) -> np.ndarray:
        return self._bytes(~SPACES & ~_IS_TAIL)

    def _n_symbols(self) -> np.ndarray:
        return self._bytes(_IS_SYMBOL)

    def _n_shouts(self) -> np.ndarray:
        return self._bytes(_IS_SHOUT)

    def _n_upper(self) -> np.ndarray:
        return self._bytes(_IS_UPPER)

    def _n_alpha(self) -> np.ndarray:
        return self._bytes(_IS_ALPHA)

    def _lines(self) -> np.ndarray:
        """(lines with a word, those equal to an earlier one): lines count as equal if their 64-bit hashes are."""
        out = np.zeros((len(self), 2), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for bounds, owners in pieces(self.data, self.ends, _IS_BREAK):
            raw = self.data[bounds[0] : bounds[-1]].tobytes()
            split = pc.split_pattern(as_texts(raw, np.array(bounds) - bounds[0]), "\n")
            lines, of = split.flatten(), np.asarray(split.offsets)
            real = (pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0) if len(lines) else np.zeros(0, bool)
            owner = np.repeat(np.array(owners), np.diff(of))[real]
            np.add.at(out[:, 0], owner, 1)
            pairs = np.unique(np.stack((owner.astype(np.uint64), hashed(lines)[real])), axis=1) if real.any() else np.zeros((2, 0), np.uint64)
            found.append((pairs[0], pairs[1]))
        if found:
            owner, line = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            if len(found) > 1:  # a long text's pieces may share lines
                order = np.lexsort((line, owner))
                owner, line = owner[order], line[order]
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]))) if len(owner) else np.zeros(0, bool)
                owner = owner[new]
            out[:, 1] = out[:, 0] - np.bincount(owner.astype(np.int64), minlength=len(self))
        return out

    def _n_lines(self) -> np.ndarray:
        return self["lines"][:, 0]

    def _n_dup_lines(self) -> np.ndarray:
        return self["lines"][:, 1]

    def _n_repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that their text has twice or more."""
        h, offsets = self.hashes()
        n, total = np.diff(offsets), len(h)
        if total < WINDOW:
            return np.zeros(len(n), np.int64)
        rolled = rolling(h, WINDOW, np.uint64(WINDOW))
        own = np.ones(len(rolled), bool)  # windows within one text
        for back in range(1, WINDOW):
            edge = offsets[1:-1] - back
            own[edge[(edge >= 0) & (edge < len(own))]] = False
        salt = mixed(np.arange(1, len(n) + 1, dtype=np.uint64))
        for i in np.flatnonzero(n).tolist():
            rolled[offsets[i] : offsets[i + 1]] += salt[i]
        in_order = rolled[own]
        in_order.sort()
        twice = in_order[1:][in_order[1:] == in_order[:-1]]
        del in_order
        twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))] if len(twice) else twice
        covered = np.zeros(total, bool)
        for a in range(0, len(rolled) if len(twice) else 0, RUN):
            run = rolled[a : a + RUN]
            again = own[a : a + RUN] & (twice[np.minimum(np.searchsorted(twice, run), len(twice) - 1)] == run)
            for k in range(WINDOW):
                covered[a + k : a + k + len(run)] |= again
        return _sums(covered, offsets)


def _picked(values: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows in the mask, which lie end to end, and their offsets."""
    sizes = np.diff(offsets)
    return values[np.repeat(mask, sizes)], np.concatenate(([0], np.cumsum(sizes[mask])))


def _sums(values: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """How many marks each row has: values themselves, or their entries in a table. Taken in runs."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a in range(0, len(values), RUN):
        run = values[a : a + RUN]
        row = np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, a + len(run), "left"))
        row = row[offsets[row] < offsets[row + 1]]
        out[row] += np.add.reduceat(run if table is None else table[run], np.maximum(offsets[row] - a, 0), dtype=np.int64)
    return out


@dataclass(frozen=True)
class Rule:
    """rejects gives the mask of the texts to reject. needs: the features it looks at. base: one of the rules that count as base_failed."""

    name: str
    rejects: Callable[[Texts], np.ndarray]
    needs: frozenset[str] = frozenset({"?"})
    base: bool = False


#: Thresholds are whole numbers, so that verdicts are exact.
RULES = (
    Rule("few_words", lambda t: t["n_words"] < 10, frozenset({"n_words"}), base=True),
    Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > 20 * t["n_words"], frozenset({"n_words", "n_repeat_words"}), base=True),
    Rule("symbols", lambda t: 100 * t["n_symbols"] > 10 * t["n_words"], frozenset({"n_words", "n_symbols"})),
    Rule("shouting", lambda t: 100 * t["n_shouts"] > 30 * t["n_words"], frozenset({"n_words", "n_shouts"})),
    Rule("capitals", lambda t: 100 * t["n_upper"] > 40 * t["n_alpha"], frozenset({"n_upper", "n_alpha"})),
    Rule("duplicate_lines", lambda t: 100 * t["n_dup_lines"] > 50 * t["n_lines"], frozenset({"n_dup_lines", "n_lines"})),
    Rule("stutter", lambda t: 100 * t["n_stutters"] > 30 * t["n_words"], frozenset({"n_words", "n_stutters"})),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 15 * t["n_words"]), frozenset({"n_words", "word_chars"})),
)
#: What the report says of every text.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def passes(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The verdicts of the cascade: each rule looks only at the texts that those before it let pass, and takes over what was counted for them."""
    n = len(texts)
    alive = np.arange(n)
    for rule in rules:
        if len(alive) == 0:
            break
        bad = rule.rejects(texts)
        if bad.any():
            alive = alive[~bad]
            texts = texts.only(~bad)
    out = np.zeros(n, bool)
    out[alive] = True
    return out


def by_worth(rules: tuple[Rule, ...], rejected: dict[int, int], seconds: dict[int, float]) -> tuple[Rule, ...]:
    """The rules by rejections for each second, the most first."""
    worth = {i: rejected.get(i, 0) / max(seconds.get(i, 0.0), 1e-9) for i in range(len(rules))}
    return tuple(rules[i] for i in sorted(worth, key=lambda i: (-worth[i], i)))


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections for each second, as measured on a sample of the texts (each rule alone, on all of the sample)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
            for a, b in slices(batch.column(0)):
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += int(rule.rejects(Texts(batch.column(0).slice(a, b - a))).sum())
                    spent[i] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(rejected), pa.array(spent)], names=["rule", "rejected", "seconds"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    found = texts.sample(False, share, 1).mapInArrow(measure, "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()
    return by_worth(rules, {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found})


def judged(texts: pa.Array, rules: tuple[Rule, ...], order: tuple[Rule, ...]) -> tuple[Texts, np.ndarray, np.ndarray]:
    """(texts with the features of the report, base_failed, kept).

    The report needs its features for every text; what they settle is settled first, and the other rules go, in their order, over the texts
    that are left, with what is counted already.
    """
    own = Texts(texts)
    for f in FEATURES:
        own[f]
    free = tuple(r for r in order if r.needs <= set(FEATURES))
    failed, kept = np.zeros(len(own), bool), np.ones(len(own), bool)
    for rule in free:
        bad = rule.rejects(own)
        kept &= ~bad
        if rule.base:
            failed |= bad
    kept[kept] = passes(own.only(kept), tuple(r for r in order if r not in free)) if kept.any() else False
    return own, failed, kept


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    kept is the cascade's verdict. Null and empty texts have no words and fail. Repeated rows are judged each, null
    ids stay null, other columns don't matter. A text of n words takes up to 24 n bytes at a time beside its own, so one of 100 MB some 600 MB.
    """
    order = ordered(docs, text_col, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts, failed, kept = judged(batch.column(1).slice(a, b - a), rules, order)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(texts[f]) for f in FEATURES), pa.array(failed), pa.array(kept)], names=["doc_id", *FEATURES, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES) + ", base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they were. Nothing is shuffled."""
    order = ordered(docs, text_col, rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for a, b in slices(texts):
                kept = passes(Texts(texts.slice(a, b - a)), order)
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
