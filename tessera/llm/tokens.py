"""Exact token counts at every prefix of a text, for a byte-level BPE tokenizer of the tokenizers library."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Distinct pieces whose counts a worker keeps; then it starts anew.
KEPT_PIECES = 400_000
#: Pairs of tokens of which it keeps if one can follow the other.
KEPT_PAIRS = 400_000
#: The rank of what is not merged.
NEVER = 1 << 60

#: White space as the library's pattern takes it.
_WS = r"\t-\r\x20\x85\xa0  -     　"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BLANK = regex.compile(rf"[{_WS}]+")


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Token counts at every prefix of a text, for one tokenizer file, by dynamic programming; nothing is encoded.

    A text is cut into pieces as the tokenizer cuts it. For each distinct piece, the programme goes over its bytes and keeps the count at each of its
    prefixes; the count of a text's prefix is the sum of the last entries of the pieces before, and an entry of the piece that it ends in.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.cut_by_library = tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, cut = whole["model"], whole["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or whole["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.longest = max(map(len, model["vocab"]))
        self.tokens = ahocorasick.Automaton()
        for token in model["vocab"]:
            self.tokens.add_word(token, token)
        self.tokens.make_automaton()
        self.chars = {b: c for b, c in enumerate(_byte_chars())}
        special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.met: set[str] = set(map(chr, range(0x250)))
        self.odd: dict[int, str] = {}
        self.known: dict[str, bytes | np.ndarray] = {}
        self.counts: dict[str, int] = {}
        self.made_of = {a + b: (i, (a, b)) for i, (a, b) in enumerate(pairs)}
        if len(self.made_of) < len(pairs):
            raise ValueError("a token that several pairs make is not supported")
        self.spines: dict[tuple[str, int], tuple[tuple[str, int], ...]] = {}
        self.sound: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def shadow(self, text: str) -> str:
        """The text with a stand-in of the same class for each character that the library's pattern and ours class differently (by their Unicode versions).

        A character beyond the common Latin ones is looked at when it is first met: which neighbours the library takes it together with.
        """
        if text.isascii():
            return text
        met = set(text)
        for c in met - self.met:
            own = [len(x) for x in _PIECE.findall(f"a{c}1{c}!{c}\n")]
            theirs = [e - s for _, (s, e) in self.cut_by_library(f"a{c}1{c}!{c}\n")]
            if own != theirs:
                joined = {kind: len(self.cut_by_library(f"{kind}{c}")) == 1 for kind in "a1!"}
                self.odd[ord(c)] = next((_STAND_IN[k] for k, one in joined.items() if one), _STAND_IN[" "])
        self.met |= met
        return text.translate(self.odd) if not self.odd.keys().isdisjoint(map(ord, met)) else text

    def cut(self, part: str) -> list[str]:
        """The pieces of a text without special strings."""
        shown = self.shadow(part)
        found = _PIECE.findall(shown)
        if shown is part:
            return found
        out, at = [], 0
        for piece in found:
            out.append(part[at : at + len(piece)])
            at += len(piece)
        return out

    def learn(self, pieces: list[str]) -> None:
        new = set(pieces).difference(self.counts)
        if len(self.counts) + len(new) > KEPT_PIECES:
            self.counts, self.known = {}, {}
            new = set(pieces)
        for piece in new:
            self.known[piece] = inside = self._inside(piece)
            self.counts[piece] = int(inside[-1])

    def piece_counts(self, pieces: list[str]) -> np.ndarray:
        """The last entries of the pieces."""
        try:
            return np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self.learn(pieces)
            return np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings, (part, is special). A long part is cut in front of single blanks, where pieces end in any case."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from ((part, False) for part in _runs(text, at, m.start()))
            yield m[0], True
            at = m.end()
        yield from ((part, False) for part in _runs(text, at, len(text)))

    def count(self, text: str) -> int:
        return self.count_and_cut(text, 1 << 62)[0]

    def _spine(self, token: str, side: int) -> tuple[tuple[str, int], ...]:
        """What stands at an end of the token while its merges are done, the token itself first: (part, the rank at which it is merged into more)."""
        key = (token, side)
        if key not in self.spines:
            out, rank = [], NEVER
            while True:
                out.append((token, rank))
                if token not in self.made_of:
                    break
                rank, pair = self.made_of[token]
                token = pair[side]
            self.spines[key] = tuple(out)
        return self.spines[key]

    def _apart(self, left: str, right: str, joined: int = NEVER) -> bool:
        """If no merge across the border of two tokens comes before those that they are made by, apart from the one of rank `joined`.

        Until a first merge across it, both sides merge as they do alone. Of equal ranks the leftmost comes first.
        """
        ranks, ends = self.ranks, self._spine(right, 0)
        for x, x_until in self._spine(left, 1):
            for y, y_until in ends:
                rank = ranks.get((x, y), NEVER)
                if rank < x_until and rank <= y_until and rank != NEVER and not (rank == joined and x == left and y == right):
                    return False
        return True

    def _sound(self, token: str) -> bool:
        """If the token's own text is encoded as that token."""
        known = self.sound.get(token)
        if known is None:
            made = self.made_of.get(token)
            known = made is None or (self._sound(made[1][0]) and self._sound(made[1][1]) and self._apart(*made[1], made[0]))
            self.sound[token] = known
        return known

    def _inside(self, piece: str) -> bytes | np.ndarray:
        """Tokens of each prefix of a piece taken as one piece, by code points, 1 first.

        The last token of a prefix's encoding is the one token that ends it and can follow the last token of what is before.
        """
        raw = piece.encode("utf-8", "surrogatepass")
        n, m, met = len(raw), self.longest + 1, self.pairs
        count, last = ([0] * (n + 1) if n < 256 else array("I", bytes(4 * n + 4))), [""] * min(n + 1, m)
        m = len(last)
        if len(met) > KEPT_PAIRS:
            met.clear()
        for end, token in self.tokens.iter(raw.decode("latin-1").translate(self.chars)):
            i = end + 1
            if count[i]:
                continue
            j = i - len(token)
            if j:
                pair = (last[j % m], token)
                fits = met.get(pair)
                if fits is None:
                    fits = met[pair] = self._sound(token) and self._apart(*pair)
            else:
                fits = self._sound(token)
            if fits:
                count[i] = count[j] + 1
                last[i % m] = token
        if n < 256:
            return bytes(count[1:]) if n == len(piece) else bytes([count[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80])
        ends = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[1:]
        return np.array(count)[np.append(ends, n)]

    def inside(self, piece: str) -> np.ndarray:
        """Tokens of each prefix of a piece taken as one piece, by code points, 0 first."""
        if piece not in self.known:
            self.learn([piece])
        own = self.known[piece]
        return np.concatenate(([0], np.frombuffer(own, np.uint8) if isinstance(own, bytes) else own)).astype(np.int64)

    def prefix_counts(self, text: str) -> np.ndarray:
        """n + 1 numbers: the tokens of text[:i] for each i."""
        out, base = [0], 0
        done = 0  # code points before the segment
        start, start_base = 0, 0  # of the segment before a special string, and the count there
        run, run_base = "", 0  # white space that ends here, and the count before it
        for part, is_special in self.segments(text):
            if is_special:
                # a part of a special string is ordinary text, joined to what is before it
                out += [start_base + self.count_plain(text[start : done + k]) for k in range(1, len(part))]
                base += 1
                out.append(base)
                done += len(part)
                start, start_base, run = done, base, ""
                continue
            for piece, n in zip(found := self.cut(part), self.piece_counts(found), strict=True):
                inner = self.inside(piece)[1:] + base
                if len(piece) == 3 and piece[0] == "'" and piece in ("'re", "'ve", "'ll"):
                    inner[1] = base + sum(self.piece_counts(["'", piece[1]]))
                blank = self._blank(piece)
                if run and blank:
                    inner[:blank] = self.inside(run + piece[:blank])[1 + len(run) :] + run_base
                out += inner.tolist()
                base += int(n)
                if blank == len(piece):
                    run_base = run_base if run else base - int(n)
                    run += piece
                else:
                    out[-1] = base
                    run = ""
            done += len(part)
        return np.array(out)

    def _blank(self, piece: str) -> int:
        """How many blanks a piece begins with."""
        m = _BLANK.match(self.shadow(piece))
        return m.end() if m else 0

    def count_plain(self, part: str) -> int:
        return int(self.piece_counts(self.cut(part)).sum())

    def count_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """The tokens of a text, and the most code points from its start that take no more than budget tokens."""
        total, at, within = 0, 0, None
        before, before_n = "", None
        for part, is_special in self.segments(text):
            pieces = [part] if is_special else self.cut(part)
            counts = np.ones(1, np.int64) if is_special else self.piece_counts(pieces)
            own = int(counts.sum())
            if within is None and total + own > budget:
                # the pieces before the first that goes over, and those behind it, as white space may join
                k = int(np.searchsorted(np.cumsum(counts), budget - total, side="right"))
                start = max(0, k - 4)
                while start and (self._blank(pieces[start - 1]) == len(pieces[start - 1]) or self._blank(pieces[start])):
                    start -= 1  # a prefix from here on is cut as it is in the whole text
                begin = at + sum(map(len, pieces[:start]))
                base = total + int(counts[:start].sum())
                # a part of a special string is ordinary text, joined to the text before it
                begin, base = (at - len(before), total - before_n) if is_special and before_n is not None else (begin, base)
                end = at + sum(map(len, pieces[: k + 3]))
                end += max((m.end() for m in islice(_PIECE.finditer(self.shadow(text[end : end + 4096])), max(0, k + 3 - len(pieces)))), default=0)
                near = self.prefix_counts(text[begin:end]) + base
                within = begin + int(np.flatnonzero(near <= budget)[-1])
            before, before_n = part, None if is_special else own
            total += own
            at += len(part)
        return total, len(text) if within is None else within


#: Code points of a text that are cut into pieces at once, if there are blanks.
RUN_CHARS = 1 << 18
_SAFE_CUT = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
#: A letter, a number, another character and white space, which the library and the pattern here class alike.
_STAND_IN = {"a": "\u00aa", "1": "\u00b2", "!": "\u00a1", " ": "\u00a0"}


def _runs(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > RUN_CHARS:
        m = _SAFE_CUT.search(text, at + RUN_CHARS, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a file, made once in a process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chars_within) for each row.

    n_tokens is what the tokenizer file's library gives for the whole text without added tokens; n_chars_within, the
    most code points from the start that take at most `limit` tokens, comes from the same sums at piece ends. Null texts
    are empty. Repeated rows are counted each, null ids stay null, other columns don't matter. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = counter(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(a, 256).to_pylist()]
                n_bytes = [len(t.encode()) for t in texts]
                counts, within = zip(*(own.count_and_cut(t, limit) for t in texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 256), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts]), pa.array(within, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars_within"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long")
