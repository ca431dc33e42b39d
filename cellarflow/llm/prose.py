"""Telling natural prose from lists, tables and junk, unit by unit of a text; plain Python over whole texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Verdicts that a worker remembers, and the longest unit of which it does: some 20 MB at most.
REMEMBERED, REMEMBERED_LENGTH = 50_000, 300
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile("[\ufffd\x80-\x9f□¿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々]")
_MARK = re.compile(
    r"\s*(?:(?:[-–*+•·▪◦‣→>»✔✓✗☐☑☒□■○●]+|\[[ xX✓]?\]|\(?\d{1,4}[.):](?=\s)|\d{1,4} ?[-–](?=\s)|\(?[a-zA-Z][.)](?=\s)|\d{1,4}(?=\s{2,}))\s*)+"
)
_CELL = re.compile(r"[|\t;│]|\s{2,}|,(?=\S)")
_ITEM = re.compile(r"[,;/|·•»>\t、，│]|\s[-–]\s|\s{2,}")
_HARD = re.compile(r"[;|·•»/│]|\s>\s")
_OPEN, _CLOSE = "\"“«„'‘", "\"”»“'’"
_SPECIAL = re.compile(r"[|\t;│/·•»>、，#{]|\s{2,}|,(?=\S)|\s[-–]\s")
_TAGGED = re.compile(r"(?:^|\s)#\w")
_END = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_PAIR = re.compile(r"^[^\s:=][^:=.]{0,24}\s?[:=]\s?\S.{0,45}$")
_NUMERIC = re.compile(r"^[\d\s.,:%+/()°€$£-]*$|^.{0,3}$")
_ASIDE = re.compile(r"[\[(][^\[\]()]{0,40}\d[^\[\]()]{0,40}[\])]")


def lines_of(text: str) -> list[str]:
    return [x for x in (y.strip("﻿ \t　\xa0") for y in text.splitlines()) if x]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def sentences_of(line: str) -> list[str]:
    for stop in (". ", "! ", "? ", "… "):
        line = line.replace(stop, stop[0] + "\0")
    if not line.isascii():
        for stop in "。！？":
            line = line.replace(stop, stop + "\0")
    return line.split("\0")


def letters_in(text: str) -> int:
    return sum(map(len, _LETTERS.findall(text)))


def solid_in(text: str) -> int:
    """Characters that are not white space."""
    return sum(map(len, text.split()))


def _pieces(words: list[str]) -> list[str]:
    """Words with what an apostrophe joins taken apart, as the lists of common words have them."""
    return " ".join(words).replace("'", " ").split()


def _pairs(words: list[str]) -> list[str]:
    return list(map(" ".join, zip(words, words[1:])))


def _grams(text: str) -> list[str]:
    kept = "".join(c for c in text if c.isalpha() or c in "。、")
    return [kept[i : i + 2] for i in range(len(kept) - 1)]


def repeated_share(tokens: list[str], least: int = 4) -> float:
    """Share of the characters that lie in stretches of tokens repeated back to back so many times or more, of any length
    and wherever they start; values over one half may be cut short, for the search ends there.

    A stretch of p tokens repeated least times covers neighbouring multiples of p, so comparing those finds every period.
    Where the different tokens, or the first tokens of different neighbouring pairs, are too long together for one half to be
    repetition, nothing is searched: a run of p tokens repeated so often has at most p of its tokens and p + 1 of its pairs.
    """
    n, sizes = len(tokens), list(map(len, tokens))
    total = sum(sizes)
    if not total or sum(map(len, set(tokens))) > total * (0.5 + 0.5 / least):
        return 0.0
    if sum(len(a) for a, _ in set(zip(tokens, tokens[1:]))) > total * (0.5 + 1 / least):
        return 0.0
    covered, chars = bytearray(n), 0
    period, end = [0] * n, [0] * n  # the last run found over a token
    for p in range(1, n // least + 1):
        at = 0
        while at + p < n:
            if tokens[at] != tokens[at + p] or period[at] and p % period[at] == 0 and end[at] >= at + p + period[at]:
                at += p
                continue
            low, high = at, at + 1
            while low and tokens[low - 1] == tokens[low - 1 + p]:
                low -= 1
            while high + p < n and tokens[high] == tokens[high + p]:
                high += 1
            if high - low >= (least - 1) * p:
                for i in range(low, high + p):
                    if not covered[i]:
                        covered[i] = 1
                        chars += sizes[i]
                    period[i], end[i] = p, high + p
                if chars > 0.5 * total:
                    return chars / total
            at += max(p, (high - at + p - 1) // p * p)
    return chars / total


@dataclass
class ProseModel:
    """What the labelled texts and the common words say; small, and sent to the executors with the function.

    pairs are the word pairs (for scripts without spaces: character pairs) met in labelled prose, other those met in
    labelled lists, tables and junk. langs are the languages with labelled prose.
    nonsense are the words met in labelled junk alone.
    """

    common: frozenset[str] = frozenset()
    by_lang: dict[str, frozenset[str]] = field(default_factory=dict)
    pairs: frozenset[str] = frozenset()
    other: frozenset[str] = frozenset()
    langs: frozenset[str] = frozenset()
    nonsense: frozenset[str] = frozenset()
    _met: dict[tuple[str, bool, bool], str] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fit(cls, samples: Iterable[tuple[str | None, str | None, str | None]], common: Iterable[tuple[str | None, str | None]]) -> ProseModel:
        """samples: (text, lang, kind); common: (lang, word). Rows with nulls in text, kind or word are passed over."""
        by_lang: dict[str, set[str]] = {}
        for lang, word in common:
            if word:
                by_lang.setdefault((lang or "").strip().lower()[:2], set()).add(word.strip().lower())
        prose, rest, langs = Counter(), Counter(), Counter()
        sense: set[str] = set()
        nonsense: set[str] = set()
        for text, lang, kind in samples:
            if not text or not kind:
                continue
            into = prose if kind.strip().lower() == "prose" else rest
            if into is prose:
                langs[(lang or "").strip().lower()[:2]] += 1
            (nonsense if kind.strip().lower() == "junk" else sense).update(words_of(text))
            for line in lines_of(text):
                if _cjk_share(line) > 0.3:
                    into.update(_grams(line))
                elif into is rest or len(words_of(line)) > 4:
                    words = words_of(line)
                    into.update(_pairs(words))
        other = {g for g, n in rest.items() if 3 * n > prose[g]}
        return cls(
            frozenset(w for s in by_lang.values() for w in s), {k: frozenset(v) for k, v in by_lang.items()},
            frozenset(g for g in prose if g not in other), frozenset(other), frozenset(k for k, n in langs.items() if n >= 3),
            frozenset(nonsense - sense),
        )

    def common_share(self, words: list[str]) -> float:
        pieces = _pieces(words)
        return sum(map(self.common.__contains__, pieces)) / len(pieces) if pieces else 0.0

    def known_pairs(self, words: list[str]) -> float:
        """Share of neighbouring words that stand together in labelled prose; pairs of lists and tables count as half."""
        if len(words) < 2:
            return 0.0
        grams = _pairs(words)
        return (sum(map(self.pairs.__contains__, grams)) + 0.5 * sum(map(self.other.__contains__, grams))) / len(grams)

    def verdict(self, line: str, marked_run: bool = False, short_run: bool = False) -> str:
        """unit, remembered for lines and sentences of usual length: menus, notices and stock phrases come again and again."""
        if len(line) > REMEMBERED_LENGTH:
            return self.unit(line, marked_run, short_run)
        key = (line, marked_run, short_run)
        found = self._met.get(key)
        if found is None:
            if len(self._met) >= REMEMBERED:
                self._met.clear()
            found = self._met[key] = self.unit(line, marked_run, short_run)
        return found

    # a unit's verdict: prose, list, table or junk
    def unit(self, line: str, marked_run: bool = False, short_run: bool = False) -> str:
        mark = _MARK.match(line)
        body = line[mark.end() :] if mark else line
        if "(" in body or "[" in body:
            body = _ASIDE.sub(" ", body)
        body = body.strip()
        runs = body.split()
        solid = sum(map(len, runs))
        if solid == 0:
            return "table" if any(c.isdigit() for c in line) else "list" if mark else "junk"
        words = words_of(body)
        letters = sum(map(len, words)) - body.count("'") if words else 0
        odd = 0 if body.isascii() else len(_ODD.findall(body))
        if odd > 0.04 * solid and odd > 2:
            return "junk"
        cells, numeric, n_items, bars = [body], 0, body.count(",") + 1, 0
        if _SPECIAL.search(body):
            if len(_TAGGED.findall(body)) >= 3:
                return "list"
            cells = [c for c in _CELL.split(body.strip("|│ ")) if c.strip()]
            numeric = sum(bool(_NUMERIC.match(c.strip())) for c in cells)
            n_items = sum(bool(x.strip()) for x in _ITEM.split(body))
            bars = len(_HARD.findall(body))
        if letters < 0.5 * solid:
            return "table" if len(cells) >= 3 or any(c.isdigit() for c in body) and letters else "junk"
        if _cjk_share(body) > 0.3:
            return self._cjk(body, bool(mark) or marked_run, cells, numeric)
        n = len(words)
        if not n:
            return "junk"
        share, grams = self.common_share(words), _pairs(words)
        # known counts pairs of lists and tables as half; firm leaves them out, for names say nothing about a sentence
        met = sum(map(self.pairs.__contains__, grams))
        named = sum(map(self.other.__contains__, grams))
        known = (met + 0.5 * named) / len(grams) if grams else 0.0
        firm = met / (len(grams) - named) if len(grams) > named else 0.0
        ended = bool(_END.search(body)) or body[0] in _OPEN and body[-1] in _CLOSE
        if max(map(len, words)) > 40 or letters / n > 16 or solid > 30 * len(runs):
            return "junk"
        if share < 0.3 and sum(map(self.nonsense.__contains__, words)) >= 0.4 * n:
            return "junk"
        if len(cells) >= 3 and numeric >= 1 and numeric * 4 >= len(cells) and not (known > 0.55 and ended):
            return "table"
        if "{" in body and ":" in body and body.count('"') >= 4:
            return "table"
        if n_items >= 4 and n / n_items < 4.2 and known < 0.5 and share < 0.34:
            return "list" if share > 0 or known > 0 or self._listed(words) else "junk"
        if not ended and bars >= 3 and firm < 0.6:
            return "list"
        if n >= 6:
            if share > 0.78 and known < 0.55:
                return "junk"  # words without a sentence
            if n >= 12 and _sorted(words):
                return "junk"
            if n >= 12 and not ended and share < 0.32 and len(set(words)) < 0.6 * n and firm < 0.1:
                return "junk"  # names over and over
            if n >= 12 and not ended and share >= 0.15 and known < 0.15 and self._certain(words, share):
                return "list" if mark or marked_run else "junk"
        if not mark and n <= 9 and share < 0.34 and _PAIR.match(body):
            return "table"
        if not ended and (mark or marked_run) and (n < 6 or firm < 0.6):
            return "list"
        if short_run and n <= 6 and firm < 0.5:
            return "list"
        if known >= 0.5 and share >= 0.12 and (n >= 6 or ended and n >= 4):
            return "prose"
        if n >= 5 and share >= 0.2 and (ended or n >= 8):
            return "prose"
        if n >= 3 and share >= 0.3 and ended and not (short_run and n <= 6 and firm < 0.5):
            return "prose"
        if n >= 7 and ended and share >= 0.1 and known >= 0.15:
            return "prose"
        if _PAIR.match(body) and n <= 9:
            return "table"
        if share >= 0.25 and known >= 0.25 and n >= 5:
            return "prose"
        if n <= 8 and (known > 0 or self._listed(words)):
            return "list"
        return "list" if n <= 6 else "junk"

    def _listed(self, words: list[str]) -> bool:
        return any(map(self.other.__contains__, _pairs(words)))

    def _certain(self, words: list[str], share: float) -> bool:
        """Whether nearly all common words belong to one language of which there is labelled prose."""
        pieces = _pieces(words)
        best, hits = max(((k, sum(map(v.__contains__, pieces))) for k, v in self.by_lang.items()), key=lambda x: x[1], default=("", 0))
        return best in self.langs and hits / len(pieces) >= 0.2 and share - hits / len(pieces) < 0.08

    def _cjk(self, body: str, marked: bool, cells: list[str], numeric: int) -> str:
        if len(cells) >= 3 and numeric >= 1 and numeric * 4 >= len(cells):
            return "table"
        grams = _grams(body)
        if not grams:
            return "list"
        known = sum(1.0 if g in self.pairs else 0.5 if g in self.other else 0.0 for g in grams) / len(grams)
        clear = sum(g in self.pairs for g in grams) / len(grams)
        hira = sum("぀" <= c <= "ゟ" for c in body) / len(body)
        ended = body.rstrip("\"'»”’)]」』").endswith(("。", "！", "？", "!", "?", "…", "♪"))
        stops = body.count("、") + body.count(",") + body.count("，")
        if not ended and "。" not in body:
            if stops >= 3 and len(grams) / stops < 14 or len(_HARD.findall(body)) >= 3:
                return "list"
            if marked or body.endswith("."):
                return "prose" if clear >= 0.6 and len(grams) >= 20 and hira >= 0.3 else "list"
        if clear >= 0.5 and len(grams) >= 8 or clear >= 0.3 and ended and len(grams) >= 6:
            return "prose"
        if hira >= 0.3 and ended and len(grams) >= 10 and known >= 0.2:
            return "prose"
        if hira >= 0.35 and len(grams) >= 18 and known >= 0.3:
            return "prose"
        return "list"

    def shares(self, text: str) -> dict[str, float]:
        """Characters of the text by kind, as shares of those that are judged; empty for a blank text."""
        lines = lines_of(text)
        if not lines:
            return {}
        flat = [x for line in lines for x in _tokens(line)]
        chars = Counter()
        if len(flat) >= 8 and repeated_share(flat) > 0.5:
            chars["junk"] = sum(map(len, lines))
            return {"junk": 1.0}
        if len(lines) >= 6:
            short = sum(len(x) < 60 and len(words_of(x)) <= 3 and _cjk_share(x) <= 0.3 and not _MARK.match(x) for x in lines)
            if short >= 0.8 * len(lines):  # perhaps a sentence with a word or two on every line
                words = [w for x in lines for w in words_of(x)]
                joined = self.known_pairs(words)
                if len(words) >= 8 and joined >= 0.5 and self.common_share(words) >= 0.2 and not _sorted(words):
                    return {"prose": 1.0}
        marked = sum(bool(_MARK.match(x)) for x in lines) >= max(3, 0.6 * len(lines))
        unended = sum(not _END.search(x) for x in lines)
        plain_run = len(lines) >= 3 and unended >= 0.9 * len(lines) and max(map(len, lines)) < 100
        short_run = len(lines) >= 3 and sum(len(x) < 90 and len(words_of(x)) <= 6 for x in lines) >= 0.75 * len(lines)
        for line in _unwrapped(lines):
            tagged = _TAG.sub("\t", line) if "<" in line else line
            tags = len(line) - len(tagged)
            if tags > 0.4 * len(line):
                chars["table" if sum(c.isdigit() for c in tagged) > 2 and re.search(r"</t[dr]>|</li>", line) else "junk"] += len(line)
                continue
            if len(tagged) > 160:
                for part in sentences_of(tagged):
                    if part.strip():
                        chars[self.verdict(part.strip())] += len(part)
            else:
                chars[self.verdict(tagged, marked or plain_run, short_run)] += len(line)
        total = sum(chars.values())
        return {k: v / total for k, v in chars.items()}


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines of text set to a width are joined again; a run counts as such if it has sentence ends and even lines."""
    if len(lines) < 2:
        return lines
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if len(run) > 1:
            widest = max(map(len, run))
            even = all(len(x) + len(y.split(" ", 1)[0]) >= 0.75 * widest for x, y in zip(run, run[1:]) if not _END.search(x))
            if 36 <= widest <= 130 and even and any(_END.search(x) or ". " in x for x in run) and not all(_END.search(x) for x in run):
                out.append(" ".join(run))
                run.clear()
                return
        out.extend(run)
        run.clear()

    for line in lines:
        if _MARK.match(line) or len(line) < 3 or _SPECIAL.search(line) and len(_CELL.split(line)) >= 3:
            close()
            out.append(line)
        else:
            if run and _END.search(run[-1]) and len(run[-1]) < 0.6 * max(map(len, run)):
                close()
            run.append(line)
    close()
    return out


def _tokens(line: str) -> list[str]:
    if _cjk_share(line) > 0.3 and " " not in line:
        return [c for c in line if not c.isspace()]
    return line.split()


def _cjk_share(text: str) -> float:
    found = 0 if text.isascii() else len(_CJK.findall(text))
    return found / max(1, letters_in(text)) if found else 0.0


def _sorted(words: list[str]) -> bool:
    return sum(map(str.__le__, words, words[1:])) >= 0.9 * (len(words) - 1)


KINDS = ("prose", "list", "table", "junk")


def kind_of(shares: dict[str, float]) -> str | None:
    """prose unless more than half is not; else the most frequent of the other kinds. None for a blank text."""
    if not shares:
        return None
    if shares.get("prose", 0.0) >= 0.5:
        return "prose"
    return max(KINDS[1:], key=lambda k: (shares.get(k, 0.0), -KINDS.index(k)))
