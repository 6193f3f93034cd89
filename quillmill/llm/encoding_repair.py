"""Text decoded with the wrong character encoding: best-first search over encode, decode and unescape steps.

A text is taken as its words (runs without ASCII white space) that hold a character beyond ASCII or an escape.  A state of
the search is the tuple of these words; a step encodes each word with one character set and decodes it with another, or
unescapes it, and leaves words alone that it cannot turn.  The cost of a state is the sum of its characters' implausibility
(what they are and what they stand next to) plus a charge for each step taken.  The open state that may lead to the cheapest
reading is expanded first: what a word can cost at the least, over all steps that may follow, is known for each word by itself, and the sum of these is never more
than any reading costs.  States seen before are dropped by their hash, and the search ends when no open state can lead to a cheaper reading than the best one, so nothing
within the steps is missed.  A text with no implausible character is not searched.
"""

from __future__ import annotations

import codecs
import heapq
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.termhash import small_batches

# Single-byte character sets that texts are confused with.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-15", "koi8_r", "cp866")
RIGHT = ("utf-8", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "koi8_r", "cp866")

#: Charge for a step: valid UTF-8 hardly comes about by chance, other readings do.
STEP_UTF8, STEP_SINGLE, STEP_ESCAPE = 1.0, 3.5, 1.0
#: Words that are searched together (the most implausible ones, then the next); the steps found are applied to all.
PROBE = 32
#: A reading is taken only if it lowers the cost by this much.
LEAST_GAIN = 1.5
#: A character with this cost makes a text worth searching.
STRANGE = 2.5

_WORD = re.compile(r"[^ \t\n\r]*(?:[^\x00-\x7f]|&#?\w{2,8};|\\u[0-9a-fA-F]{4})[^ \t\n\r]*")
_QUOTES, _DASHES, _SIGNS = "“”„‘‚«»‹›", "–—…•", "€£¥¢§©®™°ºª†‡¶±½¼¾²³¹×÷№‰"


@lru_cache(maxsize=None)
def _kind(c: str) -> str:
    if c < "\x80":
        return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "p"
    if c == "�" or "\x80" <= c <= "\x9f" or unicodedata.category(c) in ("Co", "Cn", "Cs"):
        return "Z"
    if c in _QUOTES:
        return "q"
    if c in "’·":
        return "a"
    if c in _DASHES:
        return "h"
    if c in "¿¡":
        return "i"
    if c in "ªº" or c in _SIGNS:
        return "m"
    if c in "µ":
        return "m"
    category = unicodedata.category(c)
    if category[0] in "LM":
        name = unicodedata.name(c, "")
        if name.startswith("LATIN") and category in ("Ll", "Lu") and c != "ƒ":
            return "x" if category == "Ll" else "X"
        if name.startswith("CYRILLIC"):
            known = c.lower() in "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
            return ("c" if category == "Ll" else "K") if known else "o"
        return "g" if name.startswith(("GREEK", "LATIN", "MODIFIER", "SUPERSCRIPT")) or c in "ⁿƒ" else "z"
    if "─" <= c <= "▟":
        return "b"
    return "n"


_LATIN, _CYRILLIC = set("luxX"), set("cKo")
_LETTER = _LATIN | _CYRILLIC | set("gz")


def _char_cost(c: str, kind: str, before: str, after: str) -> float:
    """Implausibility of a character of `kind` between two kinds ("" at an end of the word)."""
    beside = (before in _LETTER) + (after in _LETTER)
    if kind == "Z":
        return 6.0
    if kind in "xX":
        mixed = 2.0 if before in _CYRILLIC or after in _CYRILLIC else 0.0
        if kind == "x":
            return 1.0 + mixed
        return 1.0 + mixed + (3.0 if before in ("l", "x") else 2.0 if after and after in "qahimbnZg" else 0.0)
    if kind in "cKo":
        mixed = 2.0 if before in _LATIN or after in _LATIN else 0.0
        return (0.5 if kind == "c" else 0.6 if kind == "K" else 2.0) + mixed + (2.5 if kind == "K" and before == "c" else 0.0)
    if kind == "g":
        return 1.0 + (3.0 if before in _LATIN or after in _LATIN or before in _CYRILLIC or after in _CYRILLIC else 0.0)
    if kind == "z":
        return 0.8 + (3.0 if {before, after} & (_LATIN | _CYRILLIC) else 0.0)
    if kind == "a":
        return 0.5 if beside == 2 or before in _LETTER else 0.8
    if kind == "q":
        if beside == 2:
            return 4.0
        return 3.0 if c in "„‚" and before in _LETTER else 0.7
    if kind == "h":
        return 2.0 if beside == 2 else 1.5 if c == "•" and beside else 0.7
    if kind == "i":
        return 4.0 if before in _LETTER else 0.7
    if kind == "m":
        if beside == 2:
            return 4.0
        if c == "µ":
            return 3.0 if before in _LETTER else 0.8
        if after in _LETTER:
            return 0.8 if c in "©°€£" else 2.6
        return 1.5 if before in _LETTER and c not in "®™ªº©" else 0.7
    if kind == "b":
        return 4.0 if beside else 0.6
    if c == "\xad":
        return 2.6
    return 2.4 + 1.6 * (before in _LETTER) if beside else 1.2


@lru_cache(maxsize=200_000)
def word_cost(word: str) -> tuple[float, float]:
    """(cost of the word, cost of its strangest character)."""
    if word.isascii():
        return (3.0, 3.0) if "&" in word or "\\u" in word else (0.0, 0.0)
    kinds = [_kind(c) for c in word]
    total = worst = run = 0.0
    for i, (c, k) in enumerate(zip(word, kinds)):
        if k in "ludp":
            run = 0
            continue
        cost = _char_cost(c, k, kinds[i - 1] if i else "", kinds[i + 1] if i + 1 < len(kinds) else "")
        run = run + 1 if k in "xX" and c <= "ÿ" else 0
        if run >= 4:  # no language writes so many of these letters in a row
            cost += 2.0
        total += cost
        worst = max(worst, cost)
    return total, worst


@lru_cache(maxsize=None)
def _to_byte(charset: str) -> dict[int, int]:
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            table[b] = b  # as programs do that decode byte for byte
    return table


@lru_cache(maxsize=None)
def _from_byte(charset: str) -> str:
    """The 256 characters of a single-byte set; bytes that it leaves open stand for the characters of their number."""
    return "".join(_one(b, charset) for b in range(256))


def _one(b: int, charset: str) -> str:
    try:
        return bytes([b]).decode(charset)
    except UnicodeDecodeError:
        return chr(b)


STEPS: list[tuple[str, str]] = [("escape", "")] + [(w, r) for w in WRONG for r in RIGHT if w != r]
#: By wrong set: the steps that encode with it, and what each decodes with.
_BY_WRONG = [(w, [(n, r) for n, (x, r) in enumerate(STEPS) if x == w]) for w in WRONG]
_TO_UTF8 = [(w, [(n, r) for n, r in rights if r == "utf-8"]) for w, rights in _BY_WRONG]


def _unescaped(word: str) -> str:
    plain = html.unescape(word) if "&" in word else word
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), plain) if "\\u" in plain else plain


def _turned(word: str, mode: int) -> Iterator[tuple[int, str]]:
    """The word after each step that applies to it; of mode, see _FOLLOW."""
    if "&" in word or "\\u" in word:
        yield 0, _unescaped(word)
    for wrong, rights in () if mode == 2 else _TO_UTF8 if mode else _BY_WRONG:
        try:
            raw = codecs.charmap_encode(word, "strict", _to_byte(wrong))[0]
        except UnicodeEncodeError:
            continue
        for step, right in rights:
            if right == "utf-8":
                with suppress(UnicodeDecodeError):
                    yield step, raw.decode("utf-8")
            else:
                yield step, codecs.charmap_decode(raw, "strict", _from_byte(right))[0]


def _charge(step: int) -> float:
    wrong, right = STEPS[step]
    return STEP_ESCAPE if wrong == "escape" else STEP_UTF8 if right == "utf-8" else STEP_SINGLE


def _cost(words: tuple[str, ...]) -> float:
    return sum(word_cost(w)[0] for w in words)


@lru_cache(maxsize=200_000)
def _changes(word: str, mode: int = 0) -> dict[int, str]:
    """What each step that may follow makes of the word, where that is not less plausible: parts of a text may be right as they are."""
    most = word_cost(word)[0] + 1e-9
    return {step: there for step, there in _turned(word, mode) if there != word and word_cost(there)[0] <= most}


def _better(word: str, step: int) -> str:
    return _changes(word).get(step, word)


@lru_cache(maxsize=200_000)
def _least(word: str, mode: int) -> float:
    """The least cost of any reading of a word by the steps that may follow: all (0), those that come after a UTF-8 step or an escape (1), or after a single-byte step (2)."""
    least, seen, todo = word_cost(word)[0], {(word, mode)}, [(word, mode)]
    while todo and least > 0:
        now, before = todo.pop()
        for step, there in _changes(now, before).items():
            state = (there, _mode(before, step))
            if state not in seen:
                seen.add(state)
                least = min(least, word_cost(there)[0])
                todo.append(state)
    return least


def _mode(before: int, step: int) -> int:
    return 2 if before == 2 or _CHARGES[step] == STEP_SINGLE else 1


_CHARGES = [_charge(s) for s in range(len(STEPS))]
#: Steps by what came before: text goes wrong again and again as UTF-8, but only once, and then last, between single-byte sets.
_FOLLOW = (set(range(len(STEPS))), {s for s in range(len(STEPS)) if _CHARGES[s] != STEP_SINGLE}, {s for s in range(len(STEPS)) if STEPS[s][0] == "escape"})


def _strangest(word: str) -> tuple[float, float, str]:
    total, worst = word_cost(word)[:2]
    return -worst, -total, word


def search(words: list[str]) -> tuple[list[int], float]:
    """The steps that lead to the cheapest reachable reading of the strangest words, and how much they lower the cost."""
    start = tuple(sorted(words, key=_strangest)[:PROBE])
    origin = _cost(start)
    bound = lambda state, mode: sum([_least(w, mode) for w in state])
    # The first step is charged, too; where no reading is so much cheaper there is nothing to seek.
    if origin - bound(start, 0) <= min(STEP_ESCAPE, STEP_UTF8):
        return [], 0.0
    best, best_path, tick = origin, (), itertools.count()
    heap = [(bound(start, 0), next(tick), 0.0, 0, start, ())]
    seen = {(hash(start), 0)}
    while heap and heap[0][0] < best - 1e-9:
        _, _, charged, mode, state, path = heapq.heappop(heap)
        changes = [_changes(w, mode) for w in state]
        for step in sorted(set().union(*changes)):
            spent = charged + _CHARGES[step]
            if spent >= best - 1e-9:
                continue
            there = tuple([c.get(step, w) for c, w in zip(changes, state)])
            after = _mode(mode, step)
            if there == state or (key := (hash(there), after)) in seen:
                continue
            seen.add(key)
            cost = _cost(there) + spent
            if cost < best - 1e-9:
                best, best_path = cost, (*path, step)
            if (least := bound(there, after) + spent) < best - 1e-9:
                heapq.heappush(heap, (least, next(tick), spent, after, there, (*path, step)))
    return list(best_path), origin - best


def repair(text: str | None) -> tuple[str, list[str], bool] | None:
    """(restored text, steps, whole) of a wrongly decoded text, or None for any other.

    whole is false where characters were lost (replacement or control characters stay, or a word did not turn) or where words
    have a cheaper reading that was not taken.
    """
    if not text or (text.isascii() and "&" not in text and "\\u" not in text):
        return None
    words = sorted(set(_WORD.findall(text)))
    if not any(word_cost(w)[1] >= STRANGE for w in words):
        return None
    turned = {w: w for w in words}
    steps: list[str] = []
    refused = False
    for again in itertools.count():  # parts of a text may have gone wrong in different ways
        path, refused = _gaining(turned, again)
        if not path:
            break
        for w, now in turned.items():
            for step in path:
                now = _better(now, step)
            turned[w] = now
        steps.append(" ".join(f"{a}>{b}" if b else a for a, b in (STEPS[s] for s in path)))
    lost = any(_lost(w) for w in turned.values())
    if not steps and not lost:
        return None
    fixed = _WORD.sub(lambda m: turned.get(m[0], m[0]), text) if steps else text
    return fixed, steps, not lost and not refused


def _gaining(turned: dict[str, str], again: int) -> tuple[list[int], bool]:
    """Steps that make a text cheaper, sought among its strangest words and then the next ones until none is left; whether any were refused."""
    words = sorted(set(turned.values()), key=_strangest)
    strange, refused = sum(word_cost(w)[1] >= STRANGE for w in words), False
    for at in range(0, strange, PROBE):
        path, gain = search(words[at:])
        if path and gain >= LEAST_GAIN * (1 + again):
            if not again or all(_charge(s) != STEP_SINGLE for s in path):
                return path, False
            refused = True  # what is left of lost characters can be read in many ways
    return [], refused


def _lost(word: str) -> bool:
    """Whether a word holds the remains of a character that is gone."""
    kinds = [_kind(c) for c in word]
    return any(k == "Z" for k in kinds)


def wrongly_decoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, restored, steps, whole): every document with a stretch that was decoded wrongly.

    Null and empty texts, null ids and texts with nothing implausible are in no row.  Rows repeated under one id
    give equal rows; they are made one.  Other columns are not read.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 22):
            known: dict[str, tuple | None] = {}
            at, got = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text not in known:
                    known[text] = repair(text)
                if known[text] is not None:
                    at.append(row)
                    got.append(known[text])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([g[0].encode("utf-8", "replace").decode() for g in got], pa.string()), pa.array(["; ".join(g[1]) for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())],
                ["_id", "restored", "steps", "whole"],
            )

    found = rows.mapInArrow(run, f"_id {documents.schema[id_col].dataType.simpleString()}, restored string, steps string, whole boolean")
    return found.select(F.col("_id").alias(id_col), "restored", "steps", "whole").distinct()
