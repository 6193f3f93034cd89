"""Labelled pages, made by rule from a seed, from which the line model for scanned files is estimated."""

from __future__ import annotations

import random

from quillmill.llm.quality_samples import Maker

BODY, FURNITURE = 0, 1


def _wrapped(maker: Maker, width: int) -> list[str]:
    line, lines = "", []
    text = " ".join(t for t, _ in maker.prose())
    for word in text.split(" "):
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return [*lines, line]


def _damaged(r: random.Random, text: str) -> str:
    return "".join(r.choice({"l": "1", "o": "0", "e": "c", "a": "@", "s": "5", "t": "+", "i": "!"}.get(c, c)) if r.random() < 0.05 else c for c in text)


def _paragraphs(maker: Maker, count: int, width: int) -> list[str]:
    r, out = maker.r, []
    for _ in range(count):
        if out:
            out.append("")
        kind = r.random()
        if kind < 0.8:
            for _ in range(r.randint(1, 3)):
                out += _wrapped(maker, width)
        elif kind < 0.9:
            out += ["Readings were:", *(str(r.randint(2, 400)) for _ in range(r.randint(3, 12)))]
        else:
            out += maker.other()
    return out


def _roman(n: int) -> str:
    out = ""
    for value, mark in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += mark * (n // value)
        n %= value
    return out


def _scan(maker: Maker) -> tuple[list[str], list[int]]:
    r = maker.r
    body = _paragraphs(maker, r.randint(3, 14), r.randint(42, 80))
    title = maker.fill(r.choice(("A N N", "V the A N", "P N Guide")))
    title = title.upper() if r.random() < 0.3 else title.title() + r.choice(("", "", "  Rev. B  draft", " — internal use only"))
    style, first, pages = r.randrange(8), r.choice((1, 1, r.randint(2, 150))), len(body) // 15 + 2
    number = lambda n: {0: f"Page {n}", 1: f"Page {n} of {pages + first}", 2: f"p. {n}", 3: f"— {n} —", 4: f"{n} / {first + pages}", 5: _roman(n % 40 + 1), 6: str(n), 7: f"Seite {n}"}[style]
    layout = r.choice(("head", "head+number", "foot", "number", "title number", "head,foot"))
    lines, labels, at, page = [], [], 0, first
    size = r.randint(14, 40)

    def add(text: str) -> None:
        text = _damaged(r, text) if r.random() < 0.3 else text
        lines.append(" " * r.randint(5, 40) + text if r.random() < 0.15 else text)
        labels.append(FURNITURE)

    def blank(chance: float) -> None:
        if r.random() < chance:
            lines.append("")
            labels.append(BODY)

    while at < len(body):
        if layout in ("head", "head+number", "head,foot"):
            add(title)
            if layout == "head+number":
                add(number(page))
            blank(0.5)
        elif layout == "title number":
            add(f"{title}    {page}")
            blank(0.5)
        chunk = body[at : at + size + r.randint(-2, 2)]
        at += len(chunk)
        lines += chunk
        labels += [BODY] * len(chunk)
        if layout in ("foot", "number", "head,foot"):
            blank(0.2)
            if layout == "foot":
                add(title)
            add(number(page))
            blank(0.5)
        page += 1
    return lines, labels


def _plain(maker: Maker) -> tuple[list[str], list[int]]:
    body = _paragraphs(maker, maker.r.randint(2, 14), maker.r.choice((50, 70, 90, 2000)))
    if maker.r.random() < 0.5:
        body = [maker.fill("A N N").title(), "", *body]
    return body, [BODY] * len(body)


def _listing(maker: Maker) -> tuple[list[str], list[int]]:
    """Menus, tables, code and the like, of few kinds and so with repeated lines."""
    r, body = maker.r, []
    kinds = r.sample(range(19), r.choice((1, 1, 2, 3)))
    for _ in range(r.randint(2, 12)):
        if body and r.random() < 0.4:
            body.append("")
        if r.random() < 0.15:
            body += [maker.fill("A N N").title(), ""]
        body += maker.other(r.choice(kinds)) if r.random() < 0.85 else _wrapped(maker, 70)
    return body, [BODY] * len(body)


def labelled_pages(count: int, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """(lines, label of each line); two of three texts come from a scanner."""
    maker = Maker(seed)
    return [(_scan if maker.r.random() < 0.67 else _plain)(maker) for _ in range(count)]


def labelled_listings(count: int, seed: int = 6) -> list[tuple[list[str], list[int]]]:
    """Texts whose lines look like furniture and are none."""
    maker = Maker(seed)
    return [_listing(maker) for _ in range(count)]
