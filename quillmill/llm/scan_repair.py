"""Noise in text from scanned pages: running headers, page numbers, cut words and misread characters.

Lines are labelled furniture, body or break (blank) by a hidden Markov model over layout features of lines, estimated from a
bounded set of labelled pages; Viterbi decoding labels a file as a whole.  Cut words and misread characters are settled with the
word counts of the whole collection, kept in a count sketch of fixed size: a misread word is one that becomes much more
frequent when characters that scanners confuse are put right.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.termhash import Terms, codes_of, mix64, small_batches
from quillmill.llm.scan_samples import BODY, FURNITURE, labelled_listings, labelled_pages
from quillmill.plans.vectors import Shipped, fold_counts

#: Labelled pages for the line model, and their seed.
TRAINING_PAGES, TRAINING_SEED = 400, 5
#: Characters of text for each cell of a row of the word-count sketch, and the least and most cells (powers of two) of each of its two rows.
CELL_CHARS, LEAST_CELLS, MOST_CELLS = 8, 16, 23

BREAK = 2
_HYPHENS = "-¬\xad‐"
# What scanners make of letters, as read -> as printed.
_SIGNS = {"1": "li", "0": "o", "5": "s", "@": "a", "+": "t", "!": "il", "9": "g", "6": "b", "3": "e", "8": "b", "|": "l", "$": "s", "7": "t", "4": "a"}
_SHAPES = (("c", "e"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("e", "c"), ("m", "rn"), ("li", "h"), ("n", "ri"), ("d", "cl"))
_PAGE_WORDS = r"(?:page|seite|página|pagina|pág|pag|p|s|blatt|folio)"
_EDGE = r"[\s\-–—~*.·()\[\]]{0,6}"
_EXPLICIT = re.compile(rf"{_EDGE}{_PAGE_WORDS}\.?\s*[\divxlc]+(?:\s*(?:/|of|von|de|sur|di)\s*\d+)?{_EDGE}|[-–—~*]+\s*\d+\s*[-–—~*]+|\d+\s*(?:/|of|von|sur)\s*\d+", re.I)
_BARE = re.compile(rf"{_EDGE}(?:\d{{1,4}}|[ivxlc]{{1,7}}){_EDGE}", re.I)
_NUMBER = re.compile(r"\d+")
_TITLED = re.compile(r"(?:\d{1,4}\s{2,}\S.*\S|\S.*\S\s{2,}\d{1,4})")
_INSIDE = re.compile(r"[^\W\d_]{4}[.!?;] +\w\w")
_DIGIT = re.compile(r"\d")
_LONE_NUMBER = re.compile(r"(?<![^\W\d_@!+])\d+(?![^\W\d_@!+])")
# Characters that scanners take for one another, made one.
_ALIKE = str.maketrans("105@+!9638|$eci", "losatlgbeblsccl")


def _ended(line: str) -> bool:
    """Whether a line ends in a stop, closing marks behind it or not."""
    return line.rstrip("\"”»)’")[-1:] in _STOPS and bool(line)


_STOPS = tuple(".!?:;…")


@lru_cache(maxsize=16_384)
def _form(x: str) -> int:
    """1 for an explicit page number, 2 for a bare number, 3 for a title with a number at one end, 0 for other lines."""
    if not _DIGIT.search(x) and len(x) > 40:
        return 0
    return 1 if _EXPLICIT.fullmatch(x) else 2 if _BARE.fullmatch(x) else 3 if _TITLED.fullmatch(x) else 0


@lru_cache(maxsize=100_000)
def _folded(line: str) -> str:
    """The line with numbers made equal and confusable characters made one."""
    text = " ".join(line.lower().split())
    if _DIGIT.search(text):
        text = _LONE_NUMBER.sub("#", text)
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d")):
        if a in text:
            text = text.replace(a, b)
    return text.translate(_ALIKE)


def _roman(text: str) -> int | None:
    values, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0
    for a, b in itertools.pairwise([values.get(c, 0) for c in text.lower()] + [0]):
        total += a if a >= b else -a
    return total or None


def _page_number(text: str, form: int) -> int | None:
    found = _NUMBER.findall(text)
    if form == 3 and found:
        return int(found[-1] if re.search(r"\d$", text) else found[0])
    if found:
        return int(found[0])
    bare = re.sub(r"\W", "", text)
    return _roman(bare) if re.fullmatch(r"[ivxlc]+", bare, re.I) else None


def _joined(lone: list[str], frequent: list[str]) -> dict[str, str]:
    """For lone keys, the first frequent key of the same first letter and nearly the same length that lacks few of their letters."""
    by: dict[tuple[str, int], list[int]] = defaultdict(list)
    for n, x in enumerate(frequent):
        by[x[0], len(x)].append(n)
    bags: dict[str, np.ndarray] = {}

    def bag(key: str) -> np.ndarray:
        # Letters share 64 places, so that a difference of bags never exceeds that of the letters.
        if key not in bags:
            bags[key] = np.bincount([ord(c) % 64 for c in key], minlength=64)
        return bags[key]

    tables: dict[tuple[str, int], tuple[list[int], np.ndarray]] = {}
    out: dict[str, str] = {}
    for k in lone:
        near = (k[0], len(k))
        if near not in tables:
            at = sorted(n for m in range(len(k) - 2, len(k) + 3) for n in by.get((k[0], m), ()))
            tables[near] = at, np.array([bag(frequent[n]) for n in at])
        at, table = tables[near]
        if at:
            most, own = max(2, len(k) // 8), Counter(k)
            for n in np.flatnonzero(np.maximum(bag(k) - table, 0).sum(axis=1) <= most).tolist():
                if sum((own - Counter(frequent[at[n]])).values()) <= most:
                    out[k] = frequent[at[n]]
                    break
    return out


def line_symbols(lines: list[str]) -> list[tuple[int, ...] | None]:
    """Layout features of each line, each from a few values; None for a blank line."""
    return _symbols_and_keys(lines)[0]


def _symbols_and_keys(lines: list[str]) -> tuple[list[tuple[int, ...] | None], dict[int, str]]:
    """line_symbols, and what each short line is counted as when lines are compared."""
    bare = [x.strip() for x in lines]
    known = [i for i, x in enumerate(bare) if x]
    if not known:
        return [None] * len(lines), {}
    form = [0] * len(lines)
    for i in known:
        x = bare[i]
        if len(x) < 90:
            form[i] = _form(x)
    keys: dict[int, str] = {i: ("##" if form[i] == 2 else _folded(bare[i])) for i in known if len(bare[i]) < 110}
    # Bare numbers that are counted on from page to page are no copies of those in lists.
    bare_at = [i for i, k in keys.items() if k == "##"]
    counted = _page_apart(bare_at, [_page_number(bare[i], 2) for i in bare_at], False)
    if sum(all(keys.get(j) != "##" for j in range(i - 3, i + 4) if j != i) for i in counted) > 2:
        keys |= {i: "#" for i in bare_at if i not in counted}
    # Furniture is repeated or is a page number; a lone damaged copy joins the key that differs from it least.
    places: dict[str, list[int]] = defaultdict(list)
    for i, k in keys.items():
        places[k].append(i)
    frequent = [k for k, v in places.items() if len(v) >= 2 and 5 < len(k) < 100]
    if frequent:
        for k, other in _joined([k for k, v in places.items() if len(v) == 1 and 5 < len(k) < 100], frequent).items():
            i = places.pop(k)[0]
            places[other].append(i)
            keys[i] = other
    widths = [len(bare[i]) for i in known]
    width = median(widths)
    loose = {i for i in known if form[i] or len(places[keys[i]] if i in keys else ()) >= 2}
    before, text = {}, None
    for i in known:
        before[i] = text
        if i not in loose:
            text = i
    share: dict[str, tuple[int, int, int, int]] = {}
    for k, at in places.items():
        at.sort()
        cuts = [1 for i in at if before[i] is not None and not _ended(bare[before[i]]) and len(bare[before[i]]) > 0.55 * width]
        cutting = 0 if len(cuts) < 0.15 * len(at) else 1 if len(cuts) < 0.45 * len(at) else 2
        gaps = [b - a for a, b in itertools.pairwise(at)]
        even = 0
        if len(gaps) >= 2:
            even = 1 if max(gaps) - min(gaps) <= 0.5 * sum(gaps) / len(gaps) else 0
        numbers = [_page_number(bare[i], form[i]) for i in at if form[i]]
        runs = [b is not None and a is not None and b - a == 1 for a, b in itertools.pairwise(numbers)]
        seq = 2 if not runs else 1 if sum(runs) >= 0.5 * len(runs) else 0
        close = 1 if gaps and min(gaps) < 4 else 0
        share[k] = (cutting, even, seq, close)
    beside = {i for j in loose for i in (j - 2, j - 1, j + 1, j + 2) if keys.get(i) != keys.get(j)}
    out: list[tuple[int, ...] | None] = [None] * len(lines)
    for i in known:
        k = keys.get(i)
        rep = min(len(places[k]), 3) - 1 if k is not None else 0
        cutting, even, seq, close = share[k] if k is not None else (0, 0, 2, 0)
        out[i] = (
            rep * 4 + form[i],
            cutting if rep or form[i] else 0,
            even * 2 + close,
            seq if form[i] else 3,
            int(lines[i][:5].isspace() and len(lines[i]) > 4),
            int(i in beside),
            int(len(bare[i]) < 0.7 * width),
            int(_ended(bare[i])),
            int(i in (known[0], known[-1])),
        )
    return out, keys


#: What the other copies of a line and the pages around it say, for lines that the first decoding takes for furniture (0: all others).
_CANNOT, _NUMBER_APART, _NUMBER_CLOSE, _TITLE_HELD, _TITLE_LOOSE, _TITLE_CLOSE, _LONE_EXPLICIT, _LONE_PAGED, _LONE, _CROWDED = range(1, 11)


class LineModel:
    """Hidden Markov model with states body, furniture and break; each feature is drawn by itself.

    Files are decoded twice.  The first decoding goes by the layout of lines.  Its furniture tells where pages lie, and from that
    each line gets one symbol (`evidence`), whose probabilities are estimated on the same labelled pages and on as many listings.  The second decoding, of these
    symbols, gives the labels.
    """

    SIZES = (12, 3, 4, 4, 2, 2, 2, 2, 2)
    EVIDENCE = 11

    def __init__(self, pages: list[tuple[list[str], list[int]]], listings: list[tuple[list[str], list[int]]]):
        emit = [np.full((2, n), 0.5) for n in self.SIZES]
        move = np.full((3, 3), 0.5)
        seen = [_symbols_and_keys(lines) for lines, _ in pages]
        for (symbols, _), (_, labels) in zip(seen, pages):
            last = BREAK
            for symbol, label in zip(symbols, labels):
                state = BREAK if symbol is None else label
                move[last, state] += 1
                last = state
                if symbol is not None:
                    for table, value in zip(emit, symbol):
                        table[label, value] += 1
        logs = lambda t: np.log(t / t.sum(axis=1, keepdims=True)).tolist()
        self.emit, self.move = [logs(t) for t in emit], logs(move)
        self._known: dict[tuple[int, ...], tuple[float, float]] = {}
        told = np.full((2, self.EVIDENCE), 0.5)
        for (symbols, keys), (lines, labels) in zip([*seen, *(_symbols_and_keys(lines) for lines, _ in listings)], [*pages, *listings]):
            for symbol, what, label in zip(symbols, evidence(lines, symbols, keys, self._first(symbols)), labels):
                if symbol is not None:
                    told[label, what] += 1
        self.told = logs(told)

    def _layout(self, symbol: tuple[int, ...]) -> tuple[float, float]:
        known = self._known.get(symbol)  # there are few different ones
        if known is None:
            known = self._known[symbol] = (sum([t[BODY][v] for t, v in zip(self.emit, symbol)]), sum([t[FURNITURE][v] for t, v in zip(self.emit, symbol)]))
        return known

    def _first(self, symbols: list[tuple[int, ...] | None]) -> list[int]:
        return self._decoded([None if s is None else self._layout(s) for s in symbols])

    def _decoded(self, own: list[tuple[float, float] | None]) -> list[int]:
        """The likeliest states (Viterbi) where each line has a log likelihood as body and as furniture; None is a break."""
        (bb, bf, bx), (fb, ff, fx), (xb, xf, xx) = self.move
        body = furniture = nothing = float("-inf")
        pause = 0.0  # a file begins behind a break
        back: list[tuple[int, int]] = []  # where a line came from as body (or as a break), and as furniture
        for at in own:
            if at is None:
                b, f, x = body + bx, furniture + fx, pause + xx
                pause = max(b, f, x)
                back.append((BODY if b == pause else FURNITURE if f == pause else BREAK, BREAK))
                body = furniture = nothing
                continue
            b, f, x = body + bb, furniture + fb, pause + xb
            best = max(b, f, x)
            b2, f2, x2 = body + bf, furniture + ff, pause + xf
            best2 = max(b2, f2, x2)
            back.append((BODY if b == best else FURNITURE if f == best else BREAK, BODY if b2 == best2 else FURNITURE if f2 == best2 else BREAK))
            body, furniture, pause = best + at[0], best2 + at[1], nothing
        state, path = max((body, BODY), (furniture, FURNITURE), (pause, BREAK), key=lambda x: x[0])[1], []
        for came in reversed(back):
            path.append(state)
            state = came[state == FURNITURE]
        return path[::-1]

    def labels(self, lines: list[str]) -> list[int]:
        """The state of each line."""
        symbols, keys = _symbols_and_keys(lines)
        first = self._first(symbols)
        if FURNITURE not in first:
            return first
        return self._decoded([None if s is None else (self.told[BODY][what], self.told[FURNITURE][what]) for s, what in zip(symbols, evidence(lines, symbols, keys, first))])


def evidence(lines: list[str], symbols: list[tuple[int, ...] | None], keys: dict[int, str], first: list[int]) -> list[int]:
    """What speaks for each line that the first decoding takes for furniture.

    Copies of a running header or of a page number lie a page apart; what stands closer together is a list or a menu.  Where they do
    not lie evenly each copy is looked at by itself (_page_apart).  A header breaks into a sentence or stands by a page number.  A line that has no copy fits
    where it stands beside other furniture or a page's length from it.
    """
    out = [0] * len(lines)
    places: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(first):
        if x == FURNITURE:
            if _may_repeat(lines[i]):
                places[keys.get(i, "")].append(i)
            else:
                out[i] = _CANNOT
    text = [x.strip() for x in lines]
    width = median([len(x) for x in text if x] or [0])
    numbers, titles, alone, uneven = set(), [], [], []
    for at in places.values():
        gaps = [b - a for a, b in itertools.pairwise(at)]
        if not gaps:
            alone += at
            continue
        form = symbols[at[0]][0] % 4
        # The last page may be short, which brings its number close to the one before.
        full = gaps[:-1] or gaps
        if min(full) >= 6 and max(gaps) <= 3 * min(full) or len(gaps) == 1 and _EXPLICIT.fullmatch(text[at[0]]):
            if form:
                numbers.update(at)
                for i in at:
                    out[i] = _NUMBER_APART
            else:
                titles.append(at)
            continue
        good = _page_apart(at, [_page_number(text[i], form) for i in at] if form else None, form == 1)
        if form:
            numbers.update(good)
            for i in at:
                out[i] = _NUMBER_APART if i in good else _NUMBER_CLOSE
        else:
            uneven.append((at, good))
    # A copy beside a page number is a header, however near the next one is.
    for at, good in uneven:
        held = [i for i in at if i in good or any(j in numbers for j in range(i - 3, i + 4))]
        for i in set(at) - set(held):
            out[i] = _TITLE_CLOSE
        if held:
            titles.append(held)
    paged = set(numbers)
    for at in titles:
        before = [next((text[j] for j in range(i - 1, max(-1, i - 5), -1) if text[j] and j not in numbers), "") for i in at]
        after = [next((text[j] for j in range(i + 1, min(len(text), i + 5)) if text[j] and j not in numbers), "") for i in at]
        cut = sum(bool(b) and not _ended(b) and len(b) > max(25, 0.55 * width) and (a[:1].islower() or len(a) > max(25, 0.55 * width)) for b, a in zip(before, after))
        held = cut >= 0.3 * len(at) and not _is_passage(text, at, width) or any(j in numbers for i in at for j in range(i - 3, i + 4))
        for i in at:
            out[i] = _TITLE_HELD if held else _TITLE_LOOSE
        if held:
            paged.update(at)
    for i in alone:
        near = min((abs(i - j) for j in paged), default=None)
        out[i] = _LONE_EXPLICIT if _EXPLICIT.fullmatch(text[i]) else _LONE_PAGED if near is not None and (near <= 3 or near >= 6) else _LONE
    # Many such lines one after the other, blank ones between them or not, are a menu or a table.
    known = [i for i, x in enumerate(first) if x != BREAK]
    for is_run, run in itertools.groupby(known, key=lambda i: first[i] == FURNITURE):
        if is_run and len(run := list(run)) >= 4:
            for i in run:
                out[i] = _CROWDED
    return out


def _is_passage(text: list[str], at: list[int], width: float) -> bool:
    """Whether repeated lines hold the end of a sentence or, as wide as the text, go on in one or are repeated with the lines around them."""
    if 2 * sum(bool(_INSIDE.search(text[i])) for i in at) > len(at):
        return True
    wide = [i for i in at if len(text[i]) >= 0.7 * width]
    if 2 * len(wide) <= len(at):
        return False
    if 2 * sum(text[i][0].islower() for i in wide) > len(wide):
        return True

    def same(i: int, j: int, step: int) -> int:
        n = 0
        while n < 3 and 0 <= (a := i + step * (n + 1)) < len(text) and 0 <= (b := j + step * (n + 1)) < len(text) and text[a] and _folded(text[a]) == _folded(text[b]):
            n += 1
        return n

    return 2 * sum(same(i, j, -1) + same(i, j, 1) >= 3 for i, j in itertools.pairwise(at)) >= len(at) - 1


def _page_apart(at: list[int], values: list[int | None] | None, explicit: bool) -> set[int]:
    """Those copies of one line, at uneven distances, that lie a page from the next ones; of bare numbers those that are counted on."""
    gaps = [b - a for a, b in itertools.pairwise(at)]
    if not (wide := [g for g in gaps if g >= 6]):
        return set()
    page = median(wide)
    # A number is counted on if it fits one that is so many pages before or after it.
    follow = [False] * len(at)
    if values:
        where: dict[int, list[int]] = defaultdict(list)
        for n, v in enumerate(values):
            for k in (1, 2, 3):
                for m in reversed(where.get(v - k, ()) if v is not None else ()):
                    if at[n] - at[m] > 1.5 * k * page:
                        break
                    # The last page may be short.
                    if at[n] - at[m] >= 0.5 * k * page or n == len(at) - 1 and k == 1:
                        follow[m] = follow[n] = True
            if v is not None:
                where[v].append(n)
    out, n = set(), 0
    while n < len(at):
        end = n + 1
        while end < len(at) and gaps[end - 1] < 6:
            end += 1
        group = range(n, end)  # copies closer than a page
        if values and (not explicit or len(group) > 1):
            out.update(at[m] for m in group if follow[m])
        elif len(group) == 1:
            out.add(at[n])
        n = end
    return out


def line_model(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> LineModel:
    return LineModel(labelled_pages(pages, seed), labelled_listings(pages, seed + 1))


class WordCounts:
    """Count sketch of the terms of all texts, and of pairs of terms joined by a hyphen: two rows of equally many cells."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.bits = max(0, int(len(cells)).bit_length() - 2)
        #: No word counts more than this, in any text.
        self.top = int(cells.max(initial=0))

    @staticmethod
    def at(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)

    @staticmethod
    def hyphened(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(45))

    @classmethod
    def cells_of(cls, texts: list[str], bits: int) -> np.ndarray:
        """The cells that the terms of `texts` and their hyphened pairs add one to."""
        texts = [t.lower() for t in texts]
        terms = Terms(texts)
        codes, _ = codes_of(texts)
        gap = (terms.start[1:] - terms.end[:-1] == 1) & (codes[np.minimum(terms.end[:-1], len(codes) - 1)] == 45) if len(terms.start) > 1 else np.zeros(0, dtype=bool)
        pairs = np.flatnonzero(gap)
        every = np.concatenate([terms.hash, cls.hyphened(terms.hash[pairs], terms.hash[pairs + 1])]) if len(terms.hash) else terms.hash
        return np.concatenate(cls.at(every, bits))

    def of(self, words: list[str]) -> dict[str, int]:
        """Estimated count of each word: a term, or two terms with a hyphen between; anything else counts 0."""
        out = dict.fromkeys(words, 0)
        plain = [w for w in out if w.isalnum()]
        joined = [w for w in out if w.count("-") == 1 and all(x.isalnum() for x in w.split("-"))]
        parts = Terms(plain + [x for w in joined for x in w.split("-")]).hash if plain or joined else np.zeros(0, dtype=np.uint64)
        if len(parts) != len(plain) + 2 * len(joined):
            return out
        rest = parts[len(plain) :]
        every = np.concatenate([parts[: len(plain)], self.hyphened(rest[0::2], rest[1::2])])
        low, high = self.at(every, self.bits)
        out.update(zip(plain + joined, np.minimum(self.cells[low], self.cells[high]).tolist()))
        return out


def word_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """The cells of WordCounts over all rows of `texts`; there are as many as the amount of text asks for."""
    rows = texts.select(F.col(text_col).cast("string").alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    bits = min(MOST_CELLS, max(LEAST_CELLS, (chars // CELL_CHARS).bit_length()))

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([WordCounts.cells_of([t for t in part.column(0).to_pylist() if t], bits) for part in small_batches([batch], 0, 1 << 22)])

    return np.minimum(fold_counts(rows, 2 << bits, cells), (1 << 31) - 1).astype(np.int32)


_TOKEN = re.compile(r"[^\s,.;:()\"“”„«»¿?/]+(?:[^\s]*[^\s,.;:()\"“”„«»?/])?")
_CODE = re.compile(r"[A-Z]{1,4}-?\d[\dA-Z-]*|[\d.,%:/+-]+|\d+(?:st|nd|rd|th|x|h|s|m|kg|km|cm|mm|%|°)?|x\d+|[A-Za-z]?\d{1,2}")
#: A word that may go on in the next line of text.
_CUT = re.compile(rf"[^\W_][{_HYPHENS}][^\S\n]*\n\s*[^\s,.;:()\"“”„«»?!/]")
# The sign comes first, so that nearly every character fails at once.
_ODD = re.compile(r"[0-9@+!|$](?:(?<=[^\W\d_].)|(?=[^\W\d_]))")


def _plain(word: str) -> set[str]:
    """The word with each sign put right in every way; where more than eight signs have two readings, all of a kind take the same one."""
    if sum(len(_SIGNS.get(c, c)) > 1 for c in word) <= 8:
        return {"".join(x) for x in itertools.product(*(_SIGNS.get(c, c) for c in word))}
    kinds = sorted({c for c in word if len(_SIGNS.get(c, c)) > 1})
    ways = ({**{c: x[0] for c, x in _SIGNS.items()}, **dict(zip(kinds, chosen))} for chosen in itertools.product(*(_SIGNS[c] for c in kinds)))
    return {word.translate(str.maketrans(way)) for way in ways}


@lru_cache(maxsize=100_000)
def _readings(word: str) -> list[str]:
    """What may have been printed where a scanner read `word` (lower case): one confusion, or all its signs and one more."""
    signs = [c for c in word if c in _SIGNS]
    out: set[str] = set()
    if signs:
        plain = _plain(word)
        # A mark at the end may be punctuation after all.
        plain |= _plain(word[:-1]) if word[-1] == "!" and len(signs) > 1 else set()
        out |= plain
        bases = plain
    else:
        bases = {word}
    for base in bases:
        for read, printed in _SHAPES:
            at = base.find(read)
            while at >= 0:
                out.add(base[:at] + printed + base[at + len(read) :])
                at = base.find(read, at + 1)
    out.discard(word)
    return sorted(out)


def _cut_words(lines: list[str], labels: list[int]) -> dict[int, tuple[str, str]]:
    """Line -> its last word and the word that goes on, where a line ends in a hyphen."""
    out: dict[int, tuple[str, str]] = {}
    for i, j in itertools.pairwise(i for i, x in enumerate(labels) if x == BODY):
        line = lines[i].rstrip()
        if len(line) > 1 and line[-1] in _HYPHENS and line[-2].isalnum():
            last = re.search(r"[^\s\"“”„«»()¿?/]*$", line[:-1])[0]
            first = re.match(r"\s*([^\s,.;:()\"“”„«»?!/]*)", lines[j])[1]
            if last and first and not first[0].isupper():
                out[i] = (last, first)
    return out


def _surely_cut(a: str, b: str, count) -> bool:
    """Whether a word cut by a plain hyphen is one word: known when joined, not with the hyphen, and more than one of its parts is."""
    a, b = a.lower(), b.lower()
    whole = count(a + b)
    return whole >= 2 and whole > 10 * count(f"{a}-{b}") and whole > min(count(a), count(b))


class Scan:
    """Labels, cut words and misread words of one file."""

    def __init__(self, lines: list[str], labels: list[int]):
        self.lines, self.labels = lines, labels
        self.body = [i for i, x in enumerate(labels) if x == BODY]
        self.cut = _cut_words(lines, labels)
        self.tokens: list[tuple[int, str]] = []
        follow = dict(itertools.pairwise(self.body))
        heads = {follow[i] for i in self.cut}
        for i in self.body:
            found = _TOKEN.findall(lines[i])
            if i in self.cut and found:
                found = found[:-1]
            if i in heads and found:
                found = found[1:]
            self.tokens += [(i, t) for t in found]
        self.follow = follow

    def words(self) -> set[str]:
        """Every word whose count is needed."""
        out: set[str] = set()
        for a, b in self.cut.values():
            for x in (a.lower() + b.lower(), a.lower(), b.lower(), f"{a.lower()}-{b.lower()}"):
                out.add(x)
            out.update(_readings((a + b).lower()))
        for t in {t for _, t in self.tokens}:
            out.update(_parts(t))
        return out


@lru_cache(maxsize=200_000)
def _parts(token: str) -> tuple[str, ...]:
    """The words of a token that may be misread, in lower case."""
    if _CODE.fullmatch(token):
        return ()
    token = token.strip("'’-—–")
    parts = re.split(r"[-’'–—]", token)
    # No word is longer than 40 letters; encoded data are.
    return tuple(p.lower() for p in parts if 1 < len(p) <= 40 and any(c.isalpha() for c in p) and not _CODE.fullmatch(p))


_INNER = re.compile(r"(?<![\w@+!|$-])(?=[\w@+!|$]*[a-z])(?:[A-Za-z]?[a-z]+[0159@+!6|$][a-z0159@+!6|$]*[a-z0159+@6]?|[0159@+!6][a-z]{2,})(?![\w-])")


def _misread(word: str, count, readings) -> str | None:
    """What `word` should read, or None if it stands as it is."""
    own = count(word) if word.isalnum() else 0
    odd = any(c in _SIGNS for c in word)
    if len(word) < 3 or re.fullmatch(r"[0-9a-f]*[0-9][0-9a-f]*[0-9][0-9a-f]*|[0-9a-f]{4}", word) and odd:
        return None  # encoded data
    least, factor = (2, 2) if odd else (6, 25)
    best = max(readings(word), key=lambda r: (count(r), r), default=None)
    if best is None:
        return None
    many = count(best)
    return best if many >= least and many >= factor * max(own, 1 if not odd else 0) else None


def _may_repeat(line: str) -> bool:
    """Whether a line can be a running header or a page number at all: rows of tables and code cannot."""
    bare = line.strip()
    if _EXPLICIT.fullmatch(bare) or _BARE.fullmatch(bare):
        return True
    return sum(c.isalpha() for c in bare) > 2 and "|" not in bare and bare[-1] not in _HYPHENS + ".,;" and not (len(gaps := re.findall(r"\s{2,}", bare)) > 1 and max(map(len, gaps)) > 2) and not re.search(r"[{};=]|\w: \S+.*\w: |\s{2,}\S+\s{2,}\S+\s{2,}", bare)


def _quick(lines: list[str], text: str) -> bool:
    """Whether a file may come from a scanner at all; files that fail have nothing to find."""
    if _ODD.search(text) or "¬" in text or "\xad" in text:
        return True
    bare = [x for x in map(str.strip, lines) if x]
    if any(x[-1] in _HYPHENS for x in bare) or any(map(_form, bare)):
        return True
    short = [_folded(x) for x in lines if 0 < len(x) < 90]
    return len(set(short)) < len(short)


def examine(texts: list[str], model: LineModel, counts: WordCounts) -> list[tuple[Scan, dict, dict] | None]:
    """For each text that comes from a scanner: (scan, cut lines -> joined word, (line, token) -> right token)."""
    scans: list[Scan | None] = []
    asked: dict[int, tuple[list[str], list[int], list[tuple[str, str]]]] = {}  # texts whose cut words decide
    for row, text in enumerate(texts):
        lines = text.split("\n") if text else []
        scans.append(None)
        if not text or not _quick(lines, text):
            continue
        labels = model.labels(lines)
        # A file is worth reading word by word only with some sign of a scanner.
        if FURNITURE in labels or "¬" in text or "\xad" in text or len(_INNER.findall(text)) > 1:
            scans[-1] = Scan(lines, labels)
        elif _CUT.search(text) and (pairs := list(_cut_words(lines, labels).values())):
            if len(pairs) > 1 and _ODD.search(text):
                scans[-1] = Scan(lines, labels)
            else:
                asked[row] = (lines, labels, pairs)
    first = counts.of(list({x for _, _, pairs in asked.values() for a, b in pairs for x in ((a + b).lower(), a.lower(), b.lower(), f"{a}-{b}".lower())}))
    for row, (lines, labels, pairs) in asked.items():
        if any(_surely_cut(a, b, lambda w: first.get(w, 0)) for a, b in pairs):
            scans[row] = Scan(lines, labels)
    wanted: set[str] = set()
    for s in scans:
        if s:
            wanted |= s.words()
    known = counts.of(list(wanted))
    # Readings are asked for only where a word is rare or odd: none counts 25 times as much as one that is more frequent.
    most = counts.top / 25
    doubtful = {w: _readings(w) for w in wanted if not w.isalpha() or known.get(w, 0) <= most}
    known.update(counts.of([r for rs in doubtful.values() for r in rs if r not in known]))
    count = lambda w: known.get(w, 0)
    readings = lambda w: doubtful.get(w, [])
    verdict: dict[str, str | None] = {}

    def right(word: str) -> str | None:
        if word not in verdict:
            verdict[word] = _misread(word, count, readings)
        return verdict[word]

    out: list[tuple[Scan, dict, dict] | None] = []
    for s in scans:
        if s is None:
            out.append(None)
            continue
        cut, wrong = {}, {}
        for i, (a, b) in s.cut.items():
            low = (a + b).lower()
            mark = s.lines[i].rstrip()[-1]
            whole, spelt = count(low), count(f"{a.lower()}-{b.lower()}")
            parts = min(count(a.lower()), count(b.lower()))
            fixed = right(low) if low.isalnum() or _ODD.search(low) else None
            if mark == "-" and spelt > whole and not fixed:
                continue
            if mark == "-" and whole <= 1 and not fixed and parts > 3 * max(whole, 1):
                continue  # two words that stand by themselves
            cut[i] = a + b
            if fixed and (whole < 2 or not low.isalpha()):
                cut[i] = fixed if a.islower() else fixed[:1].upper() + fixed[1:]
                keep = next((k for k, (x, y) in enumerate(zip(low, fixed)) if x != y), len(low))
                wrong[i if keep < len(a) else s.follow[i], ""] = fixed
        put_right: dict[str, str] = {}
        for t in {t for _, t in s.tokens}:
            for w in _parts(t):
                if (fix := right(w)) is not None:
                    put_right[t] = re.sub(re.escape(w), lambda m, fix=fix: fix.upper() if m[0].isupper() and len(m[0]) > 2 and not any(c in _SIGNS for c in m[0]) else fix[:1].upper() + fix[1:] if m[0][:1].isupper() else fix, t, count=1, flags=re.I)
        wrong.update(((i, t), put_right[t]) for i, t in s.tokens if t in put_right)
        furniture = sum(x == FURNITURE for x in s.labels)
        signs = sum(1 for _, t in wrong if any(c in _SIGNS for c in t) and _ODD.search(t))
        soft = sum(s.lines[i].rstrip()[-1] != "-" for i in cut)
        # So is a word that is surely cut, whatever else the file has.
        sure = any(s.lines[i].rstrip()[-1] in "-‐" and _surely_cut(*s.cut[i], count) for i in cut)
        if sure or furniture >= 2 or furniture + signs + soft >= 2 and (signs or soft) or len(cut) + signs >= 3 and signs + furniture:
            out.append((s, cut, wrong))
        else:
            out.append(None)
    return out


def restored(scan: Scan, cut: dict, wrong: dict) -> str:
    """The text in continuous paragraphs, without furniture, cut words joined and misread words put right."""
    paragraphs: list[str] = []
    text, glue = "", ""
    fixes: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for (i, t), fix in wrong.items():
        if t:
            fixes[i].append((t, fix))
    skip = ""
    beside = {j for i, x in enumerate(scan.labels) if x == FURNITURE for j in range(i - 2, i + 3)}
    for i, label in enumerate(scan.labels):
        if label == FURNITURE:
            continue
        if label == BREAK:
            # A blank line at a page's edge is no paragraph's end if the sentence goes on.
            if text and not (i in beside and not _ended(text.rstrip())) and not glue:
                paragraphs.append(text)
                text = ""
            continue
        line = scan.lines[i].strip()
        if skip and line.startswith(skip):
            line = line[len(skip) :]
        skip = ""
        for t, fix in fixes.get(i, ()):
            line = line.replace(t, fix)
        if i in cut:
            a, b = scan.cut[i]
            line = line[: -1 - len(a)] + cut[i]
            text += ("" if glue or not text else " ") + line
            glue, skip = "x", b
            continue
        text += ("" if glue or not text or line[:1] in ",.;:!?" and glue else " ") + line
        glue = ""
    if text:
        paragraphs.append(text)
    return "\n\n".join(paragraphs)


class ScannedText:
    """Noise of the scanned files among `files` (key column, text column).

    Null and blank texts and null keys are in no row; rows repeated under one key are taken each and made distinct.
    Files that do not come from a scanner are in no row.  Other columns are not read.
    """

    def __init__(self, files: DataFrame, key_col: str, text_col: str, model: LineModel | None = None):
        self.rows = files.select(F.col(key_col).alias("_key"), F.col(text_col).cast("string").alias("_text")).where("_key is not null and _text is not null")
        self.key_col, self.key_type = key_col, files.schema[key_col].dataType.simpleString()
        model = model or line_model()
        spark = files.sparkSession
        counts = spark.sparkContext.broadcast(Shipped(word_counts(self.rows, "_text")))
        self._kit = lambda: (model, WordCounts(counts.value.vector))

    def found(self) -> DataFrame:
        """(key, line_no, noise): furniture, hyphen and glyph lines, counted from 1 with blank lines."""
        kit = self._kit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, counts = kit()
            for batch in small_batches(batches, 1, 1 << 21):
                at, no, noise = [], [], []
                for row, got in enumerate(examine(batch.column(1).to_pylist(), model, counts)):
                    if got is None:
                        continue
                    scan, cut, wrong = got
                    named = [(i, "furniture") for i, x in enumerate(scan.labels) if x == FURNITURE] + [(i, "hyphen") for i in cut] + [(i, "glyph") for i in {i for i, _ in wrong}]
                    for i, what in named:
                        at.append(row)
                        no.append(i + 1)
                        noise.append(what)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(noise, pa.string())], [self_key, "line_no", "noise"])

        self_key = self.key_col
        return self.rows.mapInArrow(run, f"`{self.key_col}` {self.key_type}, line_no int, noise string").distinct()

    def text(self) -> DataFrame:
        """(key, text): the scanned files, restored."""
        kit, self_key = self._kit, self.key_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, counts = kit()
            for batch in small_batches(batches, 1, 1 << 21):
                got = examine(batch.column(1).to_pylist(), model, counts)
                at = [i for i, x in enumerate(got) if x is not None]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([restored(*got[i]) for i in at], pa.string())], [self_key, "text"])

        return self.rows.mapInArrow(run, f"`{self.key_col}` {self.key_type}, text string").distinct()
