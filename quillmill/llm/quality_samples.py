"""Labelled texts for the rule list that tells prose from everything else.

Every text is made by rule from a seed: prose of several styles and languages over invented content words, and lists, tables, menus,
listings, logs, code, keywords, encoded data and noise.  Each line carries its own label.
"""

from __future__ import annotations

import random

_SYLLABLES = ("ba", "ren", "to", "mil", "ka", "sor", "den", "lu", "vi", "pa", "ter", "no", "gal", "em", "fi", "ron", "sha", "co", "mer", "ti")

# Patterns of sentences; N is a noun, A an adjective, V a verb, P a name, # a number.
_SENTENCES = {
    "en": ("The N of the N is A and has been V-ed by P.", "We have V-ed # N-s in the N, but none of them was A.", "Do not V the N until it is A again.", "If a N looks A, V it and tell P about it.", "P V-s A N-s, whereas Q V-s N-s.", "V the A N-s, wait # days, V them again.", "Why V A N-s at all?", "Never V a A N; V the N instead.", "Several N-s stayed A, several N-s broke.", "Teams V # N-s usually.", "P N-s gently V A N-s.", "P crews V N-s weekly, then V N-s.", "Never V A N-s; V A N-s instead.", "P V-s A N-s monthly, whereas Q V-s A N-s.", "V A N-s, wait # metres, V N-s again.", "Several N-s stayed A, several N-s broke early."),
    "de": ("Der N ist A, weil P die N-en noch nicht V-t.", "Nach der N V-t das N seit # Tagen die N, und niemand hat es gemerkt.", "Über den N V-t die N den N mit dem Formular.", "Wir haben die N-en nicht ge-V-t.", "Mit größter Vorsicht V-t der N das N.", "Trotz der N V-t die N den N.", "Die N kürzt die N für P.", "Früher als geplant ändert der N den N.", "Der N übergibt die N gemäß der N an P."),
    "fr": ("Le N est A, parce que P n’a pas été V-é au même N.", "La N a déjà V-é les N-s depuis # jours.", "À la fin de l’été, l’N V-e le N avec soin.", "Nous avons V-é # N-s dans la N."),
    "es": ("El N V-ó la N hace # días, y la N está A.", "¿Por qué la N V-ó los N-s con P?", "La N todavía no está A durante la mañana.", "Hemos V-ado # N-s en el N."),
    "ru": ("Новый насос не нашёл письмо из центра уже # дней, а P об этом не знает.", "Склад закрыл счёт за воду во время проверки.", "На втором этаже сторож описал старый журнал."),
    "pl": ("Główny magazyn wysłał wyniki pomiarów od # dni, a zespół zamknął skrzynię.", "W ciągu dnia inżynier już wyłączył nową taśmę.", "Źródło otrzymało zużyty łańcuch obok wejścia."),
}
_TAILS = ("", "", "", " until further notice", " since the last N", " while the N is A", " before the next N", " during the N", " as soon as the N V-s", " unless P objects", " by the end of the N")
_FRAGMENTS = ("the N in the N", "for the owner of the A N", "who may V the N and why", "what to do with a A N", "if a N is too A to V", "when the N is A", "about the A N-s of P", "to be V-ed by the P team before the N", "N-s that have been V-ed since the last N", "how to V and V the N")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        words = lambda n, ends: [self._stem() + self.r.choice(ends) for _ in range(n)]
        self.nouns, self.adjectives, self.verbs, self.names = words(160, ("er", "or", "ing", "et", "al", "on", "")), words(80, ("ic", "al", "y", "ent", "ed")), words(80, ("ate", "ise", "en", "")), [w.title() for w in words(80, ("n", "s", "x", "th"))]

    def _stem(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((2, 2, 2, 3))))

    def fill(self, pattern: str) -> str:
        out = []
        for piece in pattern.replace("-s", "\x01s").replace("-", "\x01").split(" "):
            for mark, pool in (("N", self.nouns), ("A", self.adjectives), ("V", self.verbs), ("P", self.names), ("Q", self.names)):
                bare = piece.strip(".,;?¿!’\x01sedótén")
                if bare.endswith(mark) and bare in (mark, "ge\x01" + mark, "l’" + mark):
                    piece = piece.replace(mark, self.r.choice(pool))
                    break
            out.append(piece.replace("\x01", "").replace("#", str(self.r.randint(2, 400))))
        return " ".join(out)

    def prose(self) -> list[tuple[str, int]]:
        r = self.r
        lang = r.choice(("en", "en", "en", "en", "de", "fr", "es", "ru", "pl"))
        if lang == "en":
            some = _SENTENCES["en"][:4] if r.random() < 0.5 else _SENTENCES["en"][4:]
        else:
            some = _SENTENCES[lang]
        sentences = [self.fill(r.choice(some)) for _ in range(r.randint(2, 9))]
        longer = r.random()
        if longer < 0.5:  # long sentences: several clauses with one stop
            merged: list[str] = []
            for s in sentences:
                if merged and r.random() < longer + 0.2:
                    merged[-1] = merged[-1].rstrip(".?!") + r.choice((", and ", ", but ", " ", "; ", " – ")) + s
                else:
                    merged.append(s)
            sentences = merged
        sentences = [s[:1].upper() + s[1:] for s in sentences]
        style = r.random()
        if style < 0.08:
            sentences = [s.upper() for s in sentences]
        elif style < 0.2:
            sentences = [s.rstrip(".?!") for s in sentences]  # no stops
        elif style < 0.26:
            sentences = [s.replace(".", ";") for s in sentences]
        elif style < 0.36:
            noise = str.maketrans({"l": "1", "o": "0", "e": "c", "a": "@"})
            sentences = [" ".join(w.translate(noise) if r.random() < 0.08 else w for w in s.split(" ")) for s in sentences]
        shape = r.random()
        if shape < 0.45:
            return [(" ".join(sentences), 0)]
        if shape < 0.55:
            return [x for s in sentences for x in ((s, 0), ("", -1))][:-1]
        if shape < 0.65:
            lead = r.choice(("", "", "Q: ", "— ", "> "))
            return [(lead + s, 0) for s in sentences]
        width, line, lines = r.randint(38, 100), "", []
        ragged = r.choice((0.0, 0.0, 0.02, 0.06))
        for word in " ".join(sentences).split(" "):
            if len(line) + len(word) >= width or line and r.random() < ragged:
                lines.append((line, 0))
                line = word
            else:
                line = f"{line} {word}".strip()
        return [*lines, (line, 0)]

    def item(self) -> str:
        r = self.r
        if r.random() < 0.5:
            text = self.fill(r.choice(_FRAGMENTS))
        else:
            text = self.fill(r.choice(("A N", "A N N", "A N x #", "A N, A", "A N for the N", "A N (P)", "N", "V N-s")))
        return text[:1].upper() + text[1:] if r.random() < 0.4 else text

    def other(self, kind: int | None = None) -> list[str]:
        r, n = self.r, self.r.randint(2, 12)
        word = lambda: r.choice((*self.nouns, *self.adjectives, *self.names))
        kind = r.randrange(19) if kind is None else kind
        if kind in (0, 1):
            mark = r.choice(("- ", "* ", "• ", "+ ", "#) ", "#. ", "@) "))
            return [mark.replace("#", str(i + 1)).replace("@", "abcdefghijkl"[i]) + self.item() for i in range(n)]
        if kind == 2:
            return [self.item() for _ in range(n)]
        if kind >= 15:  # fragments or names of things only, in any case or all alike
            made = [self.fill(r.choice(_FRAGMENTS) + r.choice(_TAILS) if kind < 17 else r.choice(("A N", "A N", "A N N", "A N x #", "A N, A", "A N for the N", "A N (#)"))) for _ in range(n)]
            case = r.choice((0.0, 0.5, 0.5, 1.0))
            return [x[:1].upper() + x[1:] if r.random() < case else x for x in made]
        if kind == 3:
            joint = r.choice((" / ", " | ", " · ", " > "))
            return [joint.join(self.item() for _ in range(r.randint(2, 4))) for _ in range(n)]
        if kind == 4:
            cells = lambda: [self.item() if r.random() < 0.3 else r.choice((word(), str(r.randint(1, 9999)), f"{r.random() * 999:.2f}", f"{r.randint(0, 99)}%")) for _ in range(4)]
            rows = ["| " + " | ".join(cells()) + " |" for _ in range(n)]
            return [rows[0], "|---|---|---|---|", *rows[1:]]
        if kind == 5:
            return [" | ".join(f"{k}: {v}" for k, v in zip(r.sample(self.nouns, 5), (word(), r.randint(1, 999), f"20{r.randint(10, 25)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", word(), f"{r.random() * 99:.1f}%"))) for _ in range(n)]
        if kind == 6:
            return ["".join(str(x).ljust(14) for x in (word().upper() if i == 0 else r.choice((word(), r.randint(1, 9999))), r.randint(1, 9999), f"{r.random() * 99:.1f}%", word())).rstrip() for i in range(n)]
        if kind == 7:
            return [r.choice(("Home", "Help", "Login", "Search", word().title(), f"{r.choice(self.verbs).title()} {r.choice(self.nouns)}s")) for _ in range(n)]
        if kind == 8:
            leader = r.choice((".", "…", " . "))
            return [f"{r.randint(1, 12)}.{r.randint(1, 20)} {self.fill('A N').title()} {leader * r.randint(5, 40)} {r.randint(1, 90)}" for _ in range(n)]
        if kind == 9:
            return [r.choice(("├── ", "│   ├── ", "└── ", "│   └── ", "./", "src/")) + f"{word().lower()}_{word().lower()}" + r.choice((".csv", ".md", "/", ".pdf")) for _ in range(n)]
        if kind == 10:
            return [f"20{r.randint(10, 25)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} 0{r.randint(0, 9)}:{r.randint(10, 59)}:{r.randint(10, 59)},{r.randint(100, 999)} {r.choice(('INFO', 'WARN', 'ERROR', 'DEBUG'))} [{word()}-{r.randint(1, 99)}] {word()}={r.randint(1, 9999)} bytes={r.randint(1, 99999)}" for _ in range(n)]
        if kind == 11:
            a, b = r.choice(self.nouns), r.choice(self.nouns)
            pool = (f"def {a}_{b}({a}, {b}=3):", f"    return {a}.{b}({a})", f"    {a} = {b}[{r.randint(1, 99)}] // 3", "}", f"for ({a}=0; {a}<9; {a}++) {{", f"SELECT {a}, {b} FROM {a}s;", f"import {a}", f"if ({a} != {b}) {{")
            return [r.choice(pool) for _ in range(n)]
        if kind == 12:
            joint = r.choice((" ", " ", "; ", ", "))
            return [joint.join(word() for _ in range(r.randint(15, 60)))]
        if kind == 13:
            chars = r.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "#%&*+-<=>@_|~!"))
            gap = 0.1 if len(chars) < 60 else 0.0
            return ["".join(" " if r.random() < gap else r.choice(chars) for _ in range(r.randint(30, 76))).strip() for _ in range(n)]
        noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 11)))
        lines = [" ".join(noise() for _ in range(r.randint(5, 12))).capitalize() + r.choice(".!?") for _ in range(n)]
        return [" ".join(lines)] if r.random() < 0.5 else lines

    def heading(self) -> str:
        r = self.r
        words = self.fill(r.choice(("A N", "A N N", "N", "P N N", "P A N N", "V the A N", "A N > V the N", "N of the A N", "P at the N", "P – P N", "The A N")))
        words = words.title() if r.random() < 0.6 else words[:1].upper() + words[1:]
        return r.choice(("{}", "{}", "{}", "{}", "# {}", "## {}", "### {}", "== {} ==")).format(words)

    def text(self) -> tuple[str, list[int]]:
        lines: list[tuple[str, int]] = []
        for _ in range(self.r.randint(1, 4)):
            if lines:
                lines.append(("", -1))
            if self.r.random() < 0.35:
                lines += [(self.heading(), 2), ("", -1)]
            lines += self.prose() if self.r.random() < 0.5 else [(x, 1) for x in self.other()]
        return "\n".join(x for x, _ in lines), [y for _, y in lines]


def labelled_texts(count: int, seed: int = 11) -> list[tuple[int, str, list[int]]]:
    """(id, text, label of each line: 0 prose, 1 other, 2 heading, -1 blank)."""
    maker = Maker(seed)
    return [(i, *maker.text()) for i in range(count)]
