"""Sentence boundaries by cascading tables of break and no-break rules.

A candidate is a run of closing marks with the quotes and brackets closing right behind it. At each candidate the tables
are asked in order (line layout, the table of the language spoken there, common abbreviations, defaults); the first rule
whose ``before`` pattern matches what ends at the candidate and whose ``after`` pattern matches what follows decides.
The language is that of the words around the candidate: by script, in Latin script by frequent words of the two
sentences nearest to it, then of the line, then English. It is only looked for where the tables of different languages
may disagree, which is where some abbreviation ends at the candidate.
A line break always ends a sentence, text between a pair of quotes or brackets is never cut.

Null or blank text has no sentences. A text without any mark is one sentence per line. The work is linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex

from palaver.llm.patterns import pat

PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‹": "›", "‘": "’", "《": "》"}
CAND = regex.compile(r"(?:[.!?]+|[。！？؟।॥｡…]+)+(?:[   ](?=[»]))?[»”“」』）)\]›’》\"']*")
OPEN = regex.compile(r"[«“„「『（(\[‹《\"]")
CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"


@dataclass(frozen=True)
class Rule:
    name: str
    breaks: bool
    before: regex.Pattern
    after: regex.Pattern


def _r(name: str, breaks: bool, before: str, after: str) -> Rule:
    return Rule(name, breaks, regex.compile(f"(?:{before})$"), regex.compile(after))


def _never(lang: str, words: list[str], after: str = r"\s") -> Rule:
    """No break behind these abbreviations (given without their last period)."""
    alt = "|".join(regex.escape(w).replace(r"\ ", r"\s?") for w in sorted(words, key=len, reverse=True))
    return _r(lang, False, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{alt})\.", after)


# Abbreviations that stand before a name, a number or a further word, per language.
TITLES = {
    "en": ["Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Rev", "Gen", "Capt", "Sgt", "Hon", "Jr. Mr", "vs", "cf", "approx", "e.g", "i.e", "P.O", "Messrs"],
    "de": ["Dr", "Hr", "Fr", "Hrn", "Prof", "Dipl.-Ing", "z. B", "d. h", "u. a", "z. T", "i. d. R", "o. ä", "bzw", "ca", "vgl", "Vgl", "evtl", "ggf", "inkl", "sog", "St", "Str"],
    "fr": ["M", "MM", "Mme", "Mlle", "Me", "Dr", "Pr", "env", "c.-à-d", "cf", "p. ex", "av", "St", "Ste"],
    "es": ["Sr", "Sra", "Srta", "Dr", "Dra", "Prof", "Lic", "Ing", "p. ej", "Ud", "Uds", "D", "Dña", "aprox"],
    "it": ["sig", "Sig", "sig.ra", "Sig.ra", "dott", "Dott", "dott.ssa", "Dott.ssa", "prof", "Prof", "avv", "Avv", "ing", "Ing", "ad es", "p. es", "ca"],
    "pt": ["Sr", "Sra", "Dr", "Dra", "Prof", "Profa", "Eng", "p. ex", "V. Ex", "aprox"],
    "ru": ["ул", "пр", "просп", "пл", "г-н", "г-жа", "им", "т. е", "т. к", "т. н", "проф", "акад", "См", "см", "ср"],
    "ar": ["د", "أ", "م", "أ. د"],
    "hi": ["डॉ", "श्री", "प्रो", "सुश्री", "पं"],
    "ko": ["Dr", "Mr"],
}
NUMBERED = {
    "en": ["No", "Nos", "Fig", "fig", "p", "pp", "Sec", "Vol", "Ch", "Art", "Apt", "Rm", "para", "ca"],
    "de": ["Nr", "Abs", "Art", "S", "Bd", "Abb", "Tel", "Kap"],
    "fr": ["art", "p", "pp", "n", "fig", "vol", "chap", "al", "tél"],
    "es": ["núm", "Núm", "pág", "págs", "art", "cap", "fig", "vol", "n.º", "tel"],
    "it": ["n", "pag", "pagg", "art", "cap", "fig", "vol", "tel", "nr"],
    "pt": ["n.º", "pág", "págs", "art", "cap", "fig", "vol", "tel"],
    "ru": ["п", "пп", "стр", "с", "рис", "гл", "ст", "д", "кв", "тел", "№"],
    "ar": ["ص", "ج", "رقم"],
    "hi": ["पृ", "क्र", "सं"],
}
MONTHS = r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"

# Words that begin sentences and are no family names, per language.
STARTERS = {
    "en": "The A An It We I You They He She This That These Those There Then Here Our Your His Her My Its In On At If When While But And So Or Please Can Could Would Should What Who Where Why How Is Are Was Were Will Let Nobody Someone Everyone No Not Now".split(),
    "de": "Der Die Das Ein Eine Er Es Wir Ich Ihr Dann Da Hier Aber Und Oder Wenn Wer Was Wo Wie Ist Sind Heute Jetzt Nun".split(),
    "fr": "Le La Les Un Une Il Elle On Nous Vous Je Tu Ce Cette Mais Et Puis Si Qui Que Est".split(),
    "es": "El La Los Las Un Una Él Ella Nosotros Yo Pero Y Si Quién Qué Cómo Es Luego Hoy Ayer".split(),
    "it": "Il Lo La I Gli Le Un Una Lui Lei Noi Io Ma E Poi Se Chi Che Come Oggi".split(),
    "pt": "O A Os As Um Uma Ele Ela Nós Eu Mas E Depois Se Quem Que Como Hoje".split(),
    "ru": "Он Она Они Мы Вы Я Это Но И А Если Кто Что Где Как Сегодня Потом".split(),
}
# Frequent words that tell a language in Latin script from the others.
TELLING = {
    "en": "the and is are was of to for with that this it we you they have has not will be on at from there she he but what can our".split(),
    "de": "der die das und ist sind nicht wir ich sie für mit auf den dem ein eine von noch wird haben hat im zu es auch aus bei nach oder bis über unter".split(),
    "fr": "le la les des du un une est et pas pour avec dans nous vous je il elle on que qui ce cette sur au aux sont encore".split(),
    "es": "el la los las del un una es y no para con en que por se lo ya más hasta está son muy pero nos os".split(),
    "it": "il lo la gli le un una è e non per con che di del della si sono ancora più ma ci nel alla dal".split(),
    "pt": "o a os as do da um uma é e não para com em que por se já mais até são muito mas no na nos".split(),
}
_TELLS: dict[str, list[str]] = {}
for _lang, _words in TELLING.items():
    for _w in _words:
        _TELLS.setdefault(_w, []).append(_lang)
SCRIPT_OF = [("ru", regex.compile(r"\p{Cyrillic}")), ("ko", regex.compile(r"\p{Hangul}")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}"))]
WORDS = regex.compile(r"[\p{Latin}\p{M}]+")


def telling(text: str) -> str | None:
    """The language that most of the words tell, or None where they tell nothing or two languages alike."""
    for lang, rx in SCRIPT_OF:
        if len(rx.findall(text)) * 3 >= len(text):
            return lang
    votes: dict[str, float] = {}
    for w in WORDS.findall(text.lower()):
        for lang in _TELLS.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1 / len(_TELLS[w])
    best = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return best[0][0] if best and (len(best) == 1 or best[0][1] > best[1][1]) else None


LAYOUT = [_r("list-number", False, r"^[ \t]*\d{1,3}\.", r"[ \t]+\S")]
PERSONAL = ["Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Rev", "Gen", "Capt", "Sgt", "Hon"]


def _table(lang: str) -> list[Rule]:
    starts = "|".join(STARTERS.get(lang, [r"(?!)"]))
    out = [_r(f"{lang}-letter-then-start", True, r"(?<![\p{L}\p{M}\p{N}.])\p{L}\.", rf"\s+(?:{starts})\b(?!\.)")]
    if lang == "en":
        out.append(_r("en-title-then-start", True, rf"(?<![\p{{L}}])(?:{'|'.join(PERSONAL)})\.", rf"\s+(?:{starts})\b"))
        out.append(_r("en-dotted-place", False, r"(?<![\p{L}.])(?:U\.S|U\.K|U\.N|E\.U)\.", rf"\s+(?!(?:{starts})\b)\S"))
        out.append(_r("en-number-sign", False, r"(?<!\p{L})(?:item|room|ticket|invoice|order|page|line|case|see|file)\s+no\.", r"\s*\d"))
    if lang in TITLES:
        out.append(_never(lang, TITLES[lang], r"\s+(?!$)"))
    if lang in NUMBERED:
        out.append(_never(lang, NUMBERED[lang], r"\s*[\d०-९٠-٩IVX]"))
    if lang == "de":
        out.append(_r("de-ordinal", False, r"(?<!\d)\d{1,2}\.", rf"\s+{MONTHS}\b"))
        out.append(_r("de-century", False, r"(?<!\d)\d{1,2}\.", r"\s+Jahrhundert"))
    return out


COMMON = [
    _r("letter-chain", False, r"(?<![\p{L}\p{M}\p{N}])\p{L}\.", r"\s?\p{L}\."),
    _r("initial", False, r"(?<![\p{L}\p{M}\p{N}.])\p{Lu}\.", r"\s+\p{Lu}"),
    _r("clock", True, r"\d\s?[ap]\.\s?m\.", r"\s+[\p{Lu}\p{Lo}\"“«¿¡(]"),
]
DEFAULTS = [
    _r("cjk-quote-goes-on", False, r"[。！？!?.…｡][»”“」』）)\]›’》\"']+", rf"(?:{CJK}|\p{{Hangul}}|[、，,：:；;])"),
    _r("punctuation-follows", False, r".", r"[ \t]*[,;:،؛、，；：\-–—](?!-*\s*>)"),
    _r("fullwidth", True, r"[。！？｡][»”“」』）)\]›’》\"']*", r""),
    _r("cjk-ellipsis", True, rf"{CJK}[^\n]?…+[»”“」』）)\]]*", rf"\s*{CJK}"),
    _r("into-cjk", True, r"[.!?؟।][»”“」』）)\]›’》\"']*", CJK),
    _r("lower", False, r".", r"[\s ]+[\"'“«(\[]*\p{Ll}"),
    _r("space", True, r"[.!?。！？؟।॥…][\s]?[»”“」』）)\]›’》\"']*", r"[\s ]"),
]
#: One cascade per language, and one for candidates that no abbreviation of any language ends at.
TABLES = {lang: [*LAYOUT, *_table(lang), *COMMON, *DEFAULTS] for lang in ("en", "de", "fr", "es", "it", "pt", "ru", "ja", "ko", "zh", "ar", "hi")}
PLAIN = DEFAULTS
_ALL = sorted({w for t in (TITLES, NUMBERED) for ws in t.values() for w in ws}, key=len, reverse=True)
ABBREVIATED = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(regex.escape(w).replace(chr(92) + ' ', r'\s?') for w in _ALL)}|\p{{L}}|\d{{1,2}}|no|U\.S|U\.K|U\.N|E\.U)\.$")
#: Rules look back over an abbreviation and one word before it; longer than the longest abbreviation by that.
BACK = max(map(len, _ALL)) + 24


_OWNERS: dict[str, list[str]] = {}
for _t in (TITLES, NUMBERED):
    for _lang, _ws in _t.items():
        for _w in _ws:
            _OWNERS.setdefault(_w.replace(" ", ""), []).append(_lang)


def _local(line: str, ends: list[int], end: int, abbreviation: str) -> str:
    """Language around a candidate: of the sentence it may end and of what follows up to the next mark; where that does not
    tell, one of the languages that have the abbreviation, by the words of the sentence before or of the line."""
    nxt = CAND.search(line, end)
    near = telling(line[ends[-1] if ends else 0 : nxt.start() if nxt else len(line)])
    if near:
        return near
    wide = telling(line[ends[-2] if len(ends) > 1 else 0 : end]) or telling(line) or "en"
    owners = _OWNERS.get("".join(abbreviation[:-1].split()), [])
    return wide if not owners or wide in owners else owners[0]


def _spans(line: str) -> list[tuple[int, int]]:
    """Start and end of the outermost pairs of quotes and brackets."""
    spans, at = [], 0
    while m := OPEN.search(line, at):
        i, ch = m.start(), m.group()
        if ch == '"':
            if i and not (line[i - 1].isspace() or line[i - 1] in "(（[«“„-–—:：,，、>"):
                # a straight quote glued to a letter opens only in scripts without spaces
                if not pat(CJK).match(line[i - 1]):
                    at = i + 1
                    continue
            j = line.find('"', i + 1)
        elif ch == "“":
            j = line.find("”", i + 1)
        else:
            close, depth, j = PAIRS[ch], 1, -1
            both = regex.compile("[" + regex.escape(ch + close) + "]")
            for n in both.finditer(line, i + 1):
                depth += 1 if n.group() == ch and ch != close else -1
                if not depth:
                    j = n.start()
                    break
        if j < 0:
            at = i + 1
            continue
        spans.append((i, j))
        at = j + 1
    return spans


def _line_ends(line: str) -> list[int]:
    """Offsets just behind the last character of each sentence of one line."""
    stop = len(line.rstrip())
    if not stop:
        return []
    spans = _spans(line) if OPEN.search(line) else []
    ends, k, begin = [], 0, 0
    for m in CAND.finditer(line, 0, stop):
        end = m.end()
        if end >= stop:
            break
        # marks directly before a word or number belong to it (3.5, v7.3/notes, docs.example)
        nxt = line[end]
        if m.group()[-1] == "." and not nxt.isspace() and nxt.isascii():
            continue
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        if k < len(spans):
            a, b = spans[k]
            if a < m.start() and b >= end:
                continue  # inside a quotation that goes on
            if a < m.start() and m.start() < b < end:
                # the quotation closes here: in scripts without letter case an embedded one does not end the sentence
                rest = line[end:].lstrip()[:1]
                if line[begin:a].strip() and rest and not (rest.isupper() or rest.islower() or rest.isdigit() or rest in "¿¡\"“«(["):
                    if not pat(rf"{CJK}|\p{{Hangul}}").match(rest) or not nxt.isspace():
                        continue
            elif a >= m.start() and a < end:
                end = a  # a straight quote that opens behind the mark
        text = line[max(0, end - BACK) : end]
        if end > BACK:
            text = "\u0001" + text  # keeps ^ off the cut
        short = ABBREVIATED.search(text) if text[-1] == "." else None
        if not short and nxt == " " and m.group() in (".", "!", "?"):
            # what the default tables decide for a plain mark before a word
            c = line[end + 1 : end + 2]
            if c.isalnum():
                if not c.islower():
                    ends.append(end)
                    begin = end
                continue
        rules = TABLES[_local(line, ends, end, short.group())] if short else PLAIN
        for rule in rules:
            if rule.before.search(text) and rule.after.match(line, end):
                if rule.breaks:
                    ends.append(end)
                    begin = end
                break
    ends.append(stop)
    return ends


def spans(text: str | None) -> list[tuple[int, int]]:
    """(first, last) 1-based inclusive code point positions of each sentence, without the white space around it."""
    if not text:
        return []
    out, base = [], 0
    for line in text.split("\n"):
        at = 0
        for end in _line_ends(line):
            piece = line[at:end]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((base + at + lead + 1, base + at + len(piece.rstrip())))
            at = end
        base += len(line) + 1
    return out


def sentence_frame(df, key_cols: list[str], text_col: str, num_slices: int | None = None):
    """DataFrame of key_cols plus array<struct<begin_at:int,end_at:int>> ``units``, one row per input row."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<struct<begin_at:int,end_at:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"begin_at": a, "end_at": b} for a, b in spans(t)] for t in texts])

    return df.select(*key_cols, cut(F.col(text_col)).alias("units"))
