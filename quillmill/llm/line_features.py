"""Counts by line and block of a whole batch of texts, in a fixed number of numpy passes.

A block is a run of lines between blank lines, begun anew by a line that opens like a list item or a table row.  One table of
character classes is looked up for every character; all counts follow from where the classes stand.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from quillmill.functions.termhash import codes_of, span_hash

_LETTER, _DIGIT, _SPACE, _UPPER, _STOP, _CLOSER, _OPENER, _COMMA, _CODE, _JOINT, _MARK = (1 << k for k in range(11))

# Characters by what they do in a text.
_STOPS, _CLOSERS, _OPENERS = ".!?…。！？", "\"”»)’", "\"“«(¿¡—"
_COMMAS, _CODES, _JOINTS, _MARKS = ",;", "={}[]<_", "/·>", "-*•▪◦‣·+|├└│"
_AFTER_STOP = "%”»’\")"
# Pairs of letters that hardly any word holds.
_RARE = (("jqvxz", "bcdfghjkmnpqrtvwxz"), ("bcdfghjkpqtvwz", "x"), ("bfghjklmpqvwx", "z"), ("bcfghjkpqvwxz", "j"), ("bcdfghkmpwy", "q"))
_CONSONANTS = "bcdfghjklmnpqrstvwxz"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            table[i] = (_LETTER if c.isalpha() else _DIGIT) | (_UPPER if unicodedata.category(c) == "Lu" else 0)
        elif c.isspace():
            table[i] = _SPACE
    for chars, bit in ((_STOPS, _STOP), (_CLOSERS, _CLOSER), (_OPENERS, _OPENER), (_COMMAS, _COMMA), (_CODES, _CODE), (_JOINTS, _JOINT), (_MARKS, _MARK)):
        for c in chars:
            table[ord(c)] |= bit
    return table


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case character by character; characters whose lower case is several stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i).lower()
        if len(c) == 1:
            table[i] = ord(c)
    return table


@lru_cache(maxsize=1)
def _rare_pairs() -> tuple[np.ndarray, np.ndarray]:
    """(letter number of each code point up to 255, a table of 27 x 27 pairs); capitals count as no letter."""
    number = np.full(256, 26, dtype=np.uint8)
    number[97:123] = np.arange(26)
    pairs = np.zeros((27, 27), dtype=bool)
    for first, second in _RARE:
        for a in first:
            for b in second:
                pairs[ord(a) - 97, ord(b) - 97] = True
    return number, pairs.ravel()


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words as Lines hashes them."""
    codes, start = codes_of(sorted({w for w in words if w}))
    return np.unique(span_hash(_lower()[codes], start[:-1], start[1:] - 1)) if len(start) > 1 else np.zeros(0, dtype=np.uint64)


def _known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), dtype=bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _past(inside: np.ndarray, place: np.ndarray, step: int = 1) -> np.ndarray:
    """The first place from `place` on (backwards with step -1) that is not `inside`, a mask over characters."""
    at = np.flatnonzero(inside)
    if not len(at):
        return place
    cut = np.flatnonzero(np.diff(at) != 1)
    run = np.zeros(len(at), dtype=np.int64)
    run[cut + 1] = 1
    ends = at[np.concatenate([cut, [len(at) - 1]])] + 1 if step > 0 else at[np.concatenate([[0], cut + 1])] - 1
    k = np.minimum(np.searchsorted(at, place), len(at) - 1)
    return np.where(at[k] == place, ends[np.cumsum(run)[k]], place)


class Lines:
    """Lines of texts: line k is line `number[k]` of text `text[k]` and lies in codes[start[k]:end[k]]."""

    def __init__(self, texts: list[str]):
        self.codes, self.text_start = codes_of(texts)
        self.bits = _classes()[self.codes]
        over = self.codes == 10
        stops = self.text_start[1:] - 1
        over[stops] = True
        self.bits[stops] = _SPACE
        self.end = np.flatnonzero(over)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        first = np.searchsorted(self.start, self.text_start[:-1])
        self.number = np.arange(len(self.start)) - first[self.text]
        ink = (self.bits & _SPACE) == 0
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1 if len(ink) else np.zeros(0, dtype=np.int64)
        if len(ink) and ink[0]:
            edge = np.concatenate([[0], edge])
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.words = self.at(self.word_start)

    def line_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, place)

    def at(self, place: np.ndarray) -> np.ndarray:
        """How many of these places lie in each line."""
        return np.bincount(self.line_of(place), minlength=len(self.end))

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, self.start, dtype=np.int64) if len(self.start) else np.zeros(0, dtype=np.int64)

    def has(self, bit: int) -> np.ndarray:
        return (self.bits & bit) != 0

    def sentence_ends(self) -> np.ndarray:
        """Stops after a letter, digit or closing mark, with white space and a capital, or a line's end, behind them."""
        stop = np.flatnonzero(self.has(_STOP))
        stop = stop[stop > 0]
        before = self.codes[stop - 1]
        fit = (self.bits[stop - 1] & (_LETTER | _DIGIT)) != 0
        for c in _AFTER_STOP:
            fit |= before == ord(c)
        stop = stop[fit]
        last = len(self.codes) - 1
        to = np.minimum(_past(self.has(_CLOSER), np.minimum(stop + 1, last)), last)
        # The next word, and whether the line ends before it.
        line = self.line_of(stop)
        nxt = np.searchsorted(self.word_start, to)
        begin = np.where(nxt < len(self.word_start), self.word_start[np.minimum(nxt, max(0, len(self.word_start) - 1))] if len(self.word_start) else 0, last + 1)
        ended = (begin > self.end[line]) & ((self.bits[to] & _SPACE) != 0)
        begin = np.minimum(_past(self.has(_OPENER), np.minimum(begin, last)), last)
        spaced = (self.bits[to] & _SPACE) != 0
        return stop[ended | (spaced & ((self.bits[begin] & _UPPER) != 0))]

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of letters and digits start and end."""
        inside = self.has(_LETTER | _DIGIT)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        return edge[0::2], edge[1::2]

    def common_terms(self, common: np.ndarray) -> np.ndarray:
        start, end = self.terms()
        return start[_known(span_hash(_lower()[self.codes], start, end), common)]

    def common_words(self, common: np.ndarray) -> np.ndarray:
        """Starts of words that are common when what is neither letter nor digit is taken off their ends."""
        place = np.flatnonzero(self.has(_LETTER | _DIGIT))
        if not len(place):
            return place
        lo = np.searchsorted(place, self.word_start)
        hi = np.searchsorted(place, self.word_end) - 1
        good = hi >= lo
        lo, hi = lo[good], hi[good]
        return self.word_start[good][_known(span_hash(_lower()[self.codes], place[lo], place[hi] + 1), common)]

    def odd_places(self) -> np.ndarray:
        """Where rare pairs of letters, or five consonants in a row, begin."""
        number, pairs = _rare_pairs()
        a = number[np.minimum(self.codes, 255).astype(np.uint8)]
        a[self.codes > 255] = 26
        out = pairs[a[:-1].astype(np.int16) * 27 + a[1:]] if len(a) > 1 else np.zeros(0, dtype=bool)
        consonant = np.zeros(27, dtype=bool)
        consonant[[ord(c) - 97 for c in _CONSONANTS]] = True
        run = consonant[a]
        if len(run) > 5:
            five = run[:-4] & run[1:-3] & run[2:-2] & run[3:-1] & run[4:]
            out[: len(five)] |= five
        return np.flatnonzero(out)

    def joints(self) -> np.ndarray:
        """Bars, tabs, signs between blanks and wide gaps: what stands between cells and menu entries."""
        sign = np.flatnonzero(self.has(_JOINT))
        sign = sign[(sign > 0) & (sign < len(self.codes) - 1)]
        sign = sign[(self.codes[sign - 1] == 32) & (self.codes[sign + 1] == 32)]
        bars = np.flatnonzero((self.codes == 124) | (self.codes == 9))
        gap = self.word_start[1:][(self.word_start[1:] - self.word_end[:-1] >= 3) & (self.line_of(self.word_start[1:]) == self.line_of(self.word_start[:-1]))]
        return np.concatenate([sign, bars, gap])

    def pairs(self) -> np.ndarray:
        colon = np.flatnonzero(self.codes == 58)
        colon = colon[colon < len(self.codes) - 1]
        return colon[self.codes[colon + 1] == 32]

    def first_ink(self) -> np.ndarray:
        """Start of the first word of each line (of a blank line, its end)."""
        k = np.searchsorted(self.word_start, self.start)
        at = self.word_start[np.minimum(k, len(self.word_start) - 1)] if len(self.word_start) else self.end
        return np.where(self.words > 0, at, self.end)

    def last_ink(self) -> np.ndarray:
        """Last character of the last word of each line (of a blank line, its end)."""
        k = np.searchsorted(self.word_start, self.end) - 1
        at = self.word_end[np.maximum(k, 0)] - 1 if len(self.word_end) else self.end
        return np.where(self.words > 0, at, self.end)

    def _code(self, place: np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(place, len(self.codes) - 1)]

    def markers(self) -> np.ndarray:
        """Lines that open like a list item or a row: a sign, or a number or letter with a stop or bracket."""
        at = self.first_ink()
        sign = (self.bits[at] & _MARK) != 0
        at = at + (self.codes[at] == 40)
        ascii_letter = lambda c: ((c | 32) >= 97) & ((c | 32) <= 122)
        digit = lambda c: (c >= 48) & (c <= 57)
        n = digit(self._code(at)).astype(np.int64)
        n += (n == 1) & digit(self._code(at + 1))
        n += (n == 2) & digit(self._code(at + 2))
        n = np.where(n == 0, ascii_letter(self._code(at)).astype(np.int64), n)
        after = self._code(at + n)
        behind = np.minimum(at + n + 1, len(self.codes) - 1)
        numbered = (n > 0) & ((after == 46) | (after == 41)) & ((self.bits[behind] & _SPACE) != 0)
        return (sign | numbered) & (self.words > 0)


def line_table(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Features of every line that is not blank: text, line, words and columns f_*; those of its block begin with f_b."""
    x = Lines(texts)
    seen = np.flatnonzero(x.words > 0)
    marker, first, last = x.markers(), x.first_ink(), x.last_ink()
    counts = {
        "words": x.words, "sentences": x.at(x.sentence_ends()), "glue": x.at(x.common_terms(common)), "commas": x.count(x.has(_COMMA)), "joints": x.at(x.joints()), "code": x.count(x.has(_CODE)), "pairs": x.at(x.pairs()),
        "digits": x.count(x.has(_DIGIT)), "letters": x.count(x.has(_LETTER)), "odd": x.at(x.odd_places()), "chars": last - x.start + 1,
    }
    own = {k: v[seen] for k, v in counts.items()}
    marked = marker[seen]
    fresh = np.ones(len(seen), dtype=bool)
    if len(seen) > 1:
        fresh[1:] = (np.diff(seen) > 1) | (np.diff(x.text[seen]) > 0) | marked[1:]
    head = np.flatnonzero(fresh)
    block = np.cumsum(fresh) - 1
    size = np.bincount(block, minlength=len(head)) if len(seen) else np.zeros(0, dtype=np.int64)
    total = lambda v: np.add.reduceat(v, head) if len(head) else v
    whole = {k: total(v) for k, v in own.items()}
    # A line that breaks although the next word would have fitted is no wrapped line.
    widest = np.maximum.reduceat(own["chars"], head) if len(head) else own["chars"]
    k = np.searchsorted(x.word_start, first[seen])
    lead = (x.word_end - x.word_start)[k] if len(seen) else k
    room = np.zeros(len(seen), dtype=np.int64)
    if len(seen) > 1:
        room[:-1] = ~fresh[1:] & (own["chars"][:-1] + 1 + lead[1:] < widest[block[:-1]])
    out: dict[str, np.ndarray] = {"text": x.text[seen], "line": x.number[seen], "words": own["words"]}

    def shares(c: dict[str, np.ndarray], name: str, pick) -> None:
        words, chars = np.maximum(c["words"], 1), np.maximum(c["chars"], 1)
        for k, by in (("sentences", words), ("glue", words), ("commas", words), ("joints", words), ("code", words), ("pairs", words), ("odd", words), ("digits", chars), ("letters", chars)):
            out[f"{name}{k}"] = pick(c[k] / by)

    shares(own, "f_", lambda v: v)
    shares(whole, "f_b", lambda v: v[block])
    out["f_words"] = np.minimum(own["words"], 60).astype(float)
    out["f_bwords"] = np.minimum(whole["words"], 60)[block].astype(float) if len(seen) else np.zeros(0)
    out["f_bline_words"] = (whole["words"] / np.maximum(size, 1))[block] if len(seen) else np.zeros(0)
    out["f_broom"] = (total(room) / np.maximum(size - 1, 1))[block] if len(seen) else np.zeros(0)
    capital, closed = (x.bits[first[seen]] & _UPPER) != 0, (x.bits[last[seen]] & (_LETTER | _UPPER)) == 0
    for name, v in (("f_bupper", capital), ("f_bclosed", closed)):
        out[name] = (total(v.astype(np.int64)) / np.maximum(size, 1))[block] if len(seen) else np.zeros(0)
    out["f_bmarker"] = marked[head][block].astype(float) if len(seen) else np.zeros(0)
    # What tells headings: alone in its block, its first and last character, and a frame of signs.
    a, z = first[seen], last[seen]
    bare = _past(x.codes == 35, a)
    hashes = bare - a
    out["f_alone"] = (size == 1)[block].astype(float) if len(seen) else np.zeros(0)
    out["f_frame"] = (((hashes > 0) & (hashes <= 6) & (x._code(bare) == 32)) | ((x.codes[a] == 61) & (x.codes[z] == 61) & (z > a))).astype(float)
    out["f_upper"], out["f_closed"] = capital.astype(float), closed.astype(float)
    return out


def statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: words, inked characters, symbols, lines that are not blank, those that end in punctuation, common words."""
    x = Lines(texts)
    rows = len(texts)
    by_text = lambda v: np.bincount(x.text, weights=v, minlength=rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
    ink = ~x.has(_SPACE)
    seen = x.words > 0
    # What ends a line of prose, and marks that may close behind it.
    closers = np.array([ord(c) for c in "\"'”’»)"], dtype=np.uint32)
    z = _past(np.isin(x.codes, closers), x.last_ink(), -1)
    ended = seen & (z >= x.start) & np.isin(x.codes[np.maximum(z, 0)], np.array([ord(c) for c in ".!?:;…"], dtype=np.uint32))
    return {"words": by_text(x.words), "ink": by_text(x.count(ink)), "symbols": by_text(x.count(ink & ~x.has(_LETTER | _DIGIT))), "lines": by_text(seen), "ended": by_text(ended), "common": by_text(x.at(x.common_words(common)))}
