"""Personal data in free text: detection, typed placeholders and keyed surrogates.

Detectors run in order (email, address, id number, phone, name), each on what the earlier ones left. A found value is
the value itself, without the words around it. Names are found in labels, behind titles and initials, by the evidence of
a name column of the whole corpus (a word before two different family names is a given name) and by context: capitals of
one script in a row that are no ordinary words of the text, verbs of meeting and of speech around them, forms of address
in scripts without case. No list of given names is used.

``redact`` replaces values by typed placeholders; ``surrogate`` replaces them by keyed values of the same type, format,
letter case and (for names) script, gender and parts: the same entity of a record gets the same surrogate wherever it
stands (coreference), two entities never share one and no surrogate equals a value of the record (collision checks with
a counter in the key).

Null text gives null and no values; empty text stays empty. Work is linear in the text; nothing is cut or sampled.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.patterns import pat
from palaver.sources.tables import read_once

# Given names that surrogates are drawn from, by gender and script. Detection does not use them.
FEMALE = """Alice Amina Anna Beatriz Bianca Carla Clara Daniela Elena Emma Eva Farah Fiona Hana Helena Ingrid Irene Jana Julia Karin Laura Leila Lucia
Maria Marta Mei Mina Nadia Nora Olga Paula Petra Rita Sara Silvia Sofia Tara Teresa Vera Yara""".split()
MALE = """Adam Ahmed Alan Andrei Anton Bruno Carlos Daniel David Diego Emil Erik Felix Georg Hassan Hugo Ibrahim Ivan Jakob Jan Jonas Jorge
Karl Kevin Lars Luca Lukas Marco Martin Milan Nils Oscar Pablo Paul Peter Rafael Simon Stefan Thomas Viktor""".split()
FEMALE_CYRILLIC = "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Полина Софья Тамара".split()
MALE_CYRILLIC = "Андрей Борис Виктор Глеб Денис Игорь Кирилл Максим Олег Павел Роман Тимур".split()
# Given names that are also words; alone they are names only where no such word follows.
ALSO_WORDS = set("""Will Mark May Hope Grace Rose Frank Dale Bill Rich Jack Sue Art Faith Joy June April August Summer Daisy Lily Ivy Ruby Pearl Iris Violet
Chase Grant Drew Pat Penny Gene Guy Hunter Miles Ray Rob Rusty Sandy Skip Victor Wade Christian Dean Earl Max Sunny""".split())
NOT_AFTER = regex.compile(r"(?:\s+(?:like|you know|I mean),?)?\s+(?:\p{L}{1,2}-)*(?:period|the|we|you|they|it|this|that|there|someone|I|our|\d)\b")

DIGITS = "zero|one|two|three|four|five|six|seven|eight|nine|oh|double|triple"
EMAIL = [
    regex.compile(r"(?<![\w.+\-%])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])"),
    regex.compile(r"(?<![\w.+\-%])[A-Za-z0-9][A-Za-z0-9._%+\-]*\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?[A-Za-z0-9\-]+(?:(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)[A-Za-z0-9\-]+)*(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)[A-Za-z]{2,}\b"),
    regex.compile(
        r"(?<![\w.+\-%])[A-Za-z0-9][\w\-+]*(?:(?:\.|\s(?:dot|underscore|dash|plus|minus|hyphen)\s)[\w\-+]+)*\s(?:at|@)\s[\w\-]+(?:(?:\sdot\s|\.)[\w\-]+)*+\b(?<=\sdot\s\p{L}+)(?!\s(?:at|dot)\s)", regex.I
    ),
]
PLACE = r"\p{Lu}[\p{L}\-']+(?:[ \-]\p{Lu}[\p{L}\-']+){0,2}"
ZIP = r"\d{4,5}(?:-\d{3,4})?"
ST = r"\p{Lu}[\p{L}'\-]+(?:\s\p{Lu}[\p{L}'\-]+){0,2}"
KIND = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Square|Sq\.?|Way|Place|Pl\.?|Terrace|Crescent|Close|Row|Hill|Walk)"
UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Suite|Unit|Room|Floor|Fl\.?|No\.?)\s?#?\d+[A-Za-z]?)"
TOWN = rf"(?:,\s(?:{ZIP}\s)?{PLACE}(?:,?\s{ZIP})?)"
ADDRESS = [
    regex.compile(rf"\bP\.?\s?O\.?\sBox\s\d+(?:{TOWN})?"),
    regex.compile(rf"(?:\b{UNIT},\s)?(?<![\w.,/\-])\d{{1,5}}[A-Za-z]?,?\s{ST}\s{KIND}(?![\p{{L}}])(?:,\s{UNIT})?(?:{TOWN})?"),
    regex.compile(rf"(?<![\w./\-])\d{{1,5}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|quai|impasse|cours)\s(?:(?:de|du|des|la|le|les|l'|d')\s?)*{ST}(?:{TOWN})?"),
    regex.compile(rf"\b{PLACE}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s\d{{1,4}}\s?[a-zA-Z]?\b(?:{TOWN})?"),
    regex.compile(rf"\b(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Ronda|Via|Viale|Piazza|Corso|Vicolo|Largo|Rua|Travessa|Praça|Alameda|Estrada)\s(?:(?:de|da|do|dos|das|della|del|di|la|el|las|los)\s)*{ST},?\s(?:n\.?[ºo°]?\s?)?\d{{1,4}}\s?[A-Za-z]?\b(?:{TOWN})?"),
    regex.compile(rf"(?:ул\.|улица|пр\.|просп\.|проспект|пер\.|пл\.)\s[\p{{Lu}}][\p{{L}}\-]+,?\s(?:д\.\s?)?\d{{1,4}}(?:,\sкв\.\s?\d+)?(?:,\s(?:{ZIP[:-1]})?(?:\d{{6}}\s)?[\p{{Lu}}][\p{{L}}\-]+)?"),
]
ID = [
    regex.compile(r"(?<![\p{Latin}\d])QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\p{Latin}\d])", regex.I),
    regex.compile(r"(?<![\p{Latin}\d\-])[XYZ]-?\d{7}-?[A-Z](?![\p{Latin}\d])", regex.I),
    regex.compile(r"(?<![\p{Latin}\d+.\-])9\d{2}[- ]\d{2}[- ]\d{4}(?![\d\-])"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])[0-8]\d{2}[- ]\d{2}[- ]\d{4}(?![\d\-])"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])\d{2} \d{3} \d{3} \d{3}(?![\d\-]| \d)"),
    regex.compile(r"(?<![\p{Latin}\d])[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\p{Latin}\d])"),
]
PHONE = [
    regex.compile(r"(?<![\w+.])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,5}(?!\d)"),
    regex.compile(r"(?<![\w+.\-])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])\d{3}([\-. ])\d{3}\1\d{4}(?![\d\-])"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])07\d{3} ?\d{6}(?!\d)"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])0\d(?:[ .\-]\d{2}){4}(?![\d])"),
    regex.compile(r"(?<![\p{Latin}\d+.\-])0\d{2,4}[ \-/]\d{3,4}[ \-]?\d{3,4}(?!\d)"),
    regex.compile(rf"\b(?:plus |\+)?(?:(?:{DIGITS})[ \-,]+){{6,}}(?:{DIGITS})\b", regex.I),
]
def _cap(script: str) -> str:
    """A capitalised word of one script, with parts behind apostrophes or hyphens."""
    one = rf"[\p{{{script}}}\p{{M}}]"
    return rf"(?=\p{{{script}}})\p{{Lu}}{one}*(?<=[\p{{Ll}}\p{{M}}]){one}*+(?:['’\-](?=\p{{{script}}})\p{{Lu}}{one}++)*+"


CAP = f"(?:{'|'.join(_cap(s) for s in ('Latin', 'Cyrillic', 'Greek'))})"
#: Letters of scripts with case may not touch a name, those of scripts without case may.
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
EDGE_L, EDGE_R = rf"(?<![{CASED}\p{{M}}\d_@.'’\-])", rf"(?![{CASED}\p{{M}}\d_@])"
# Titles that stand before a family name.
TITLE_WORDS = """Dr Mr Mrs Ms Prof Hr Fr Hrn M Mme Mlle MM Sr Sra Srta Dra sig Sig sig.ra Sig.ra dott Dott dott.ssa Dott.ssa avv prof Profa
Me Dña Herr Frau Monsieur Madame Señor Señora Senhor Senhora Signor Signora""".split()
TITLE = regex.compile(
    rf"(?<![{CASED}])(?:{'|'.join(regex.escape(x) for x in sorted(TITLE_WORDS, key=len, reverse=True))})\.?\s"
    rf"((?:\p{{Lu}}\.\s)?{CAP}(?:\s(?:\p{{Lu}}\.\s)?{CAP})?){EDGE_R}"
)
LATIN_CAP = _cap("Latin")
OTHER_CASED = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
UNIT = regex.compile(rf"{CAP}|\p{{Lu}}\.")
RUN = regex.compile(rf"{EDGE_L}(?<!P\.)(?:{CAP}|\p{{Lu}}\.)(?:\s(?:{CAP}|\p{{Lu}}\.)|(?<=\.){CAP})*{EDGE_R}")
LATIN_RUN = regex.compile(rf"{EDGE_L}(?<!P\.)(?:{LATIN_CAP}|\p{{Lu}}\.)(?:\s(?:{LATIN_CAP}|\p{{Lu}}\.)|(?<=\.){LATIN_CAP})*{EDGE_R}")
NO_FAMILY = {"Box", "Apt", "Street", "Avenue", "Road", "Lane"}
# Capitalised words that may follow a given name without being a family name.
STOP = set("""The A An I It We You He She They Is Are Was Will Can Could Should Has Have And Or But So If In On At For From To Of With Who What When
Where Why How Please Thanks Um Uh Er Hmm Well Reminder Note Ist Hat Und Wir Ich Sie Er Es Das Die Der Wer Wie Am Im Le La Les Il Elle On Nous Je
El Los Las Lo Yo Ayer Creo Il La Lo I Gli O Os As Eu Ella Ellos Ele Ela Eles Lei Lui Loro Она Он Они Мы Вы Я Это My Our Your His Her Its Their Nobody
Somebody Someone Everybody Everyone Anyone Siehe Nr No Monday Tuesday Wednesday Thursday Friday Saturday Sunday""".split()) | set(TITLE_WORDS)


def _strip_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("ø", "o").replace("Ø", "O")


SPELLED = regex.compile(rf"(?<![a-z])(?:{DIGITS})[ \-,]+(?:{DIGITS})[ \-,]+(?:{DIGITS})")
FRENCH_STREET = regex.compile(r"\d(?:\s(?:bis|ter))?,?\s(?:rue|av|boul|bd|place|chem|all|quai|imp|cours)")
STREET = regex.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s\d")


def _take(rx, text, taken, out, kind, given=frozenset(), is_name_field=False):
    for m in rx.finditer(text):
        a, b = m.span()
        if is_name_field and kind == "address" and not text[:a].strip():
            # an address that opens a name field leaves the field's last two words, unless a postcode ends it
            tail = pat(r"(?<=,\s)\p{Lu}[\p{L}'’\-]+(?:\s\p{Lu}[\p{L}'’\-]+)*?(?=\s\p{Lu}[\p{L}'’.\-]*\s\p{Lu}[\p{L}'’\-]+\s*$)").search(text, text.rfind(",", a) - 1)
            b = min(b, tail.end()) if tail else b
        if kind == "address" and given:  # a town does not go on into a person's name
            for w in pat(r"(?<=[\s\-])\p{Lu}[\p{L}'’]+").finditer(text, text.rfind(",", a, b) + 1 or b, b):
                if w.group() in given and text[w.start() - 2] != ",":
                    b = w.start() - 1
                    break
        if a < b and not any(taken[a:b]):
            out.append((a, b, kind))
            taken[a:b] = b"\x01" * (b - a)


def _french(around: str) -> bool:
    """Whether "M." is Monsieur here and no initial."""
    words = pat(r"[\p{L}'’]+").findall(around.lower())
    fr = sum(w in FRENCH or w[:2] in ("l'", "d'", "n'", "c'", "j'", "l’", "d’", "n’") for w in words)
    return fr > sum(w in ENGLISH for w in words)


# Frequent words that tell French from English.
FRENCH = set("le la les des du un une est a vers pas dans pour avec nous vous arrivera encore que qui de et au aux sur il elle".split())
ENGLISH = set("the is will and should of to with for in out until about take according that we i can did has at who".split())
# Verbs of meeting and telling before a name, and verbs of speech behind one.
BEFORE = regex.compile(
    r"(?:\b(?:spoke|speak|speaking|talk|talked|talking|met|meet|meeting|work|worked|check|checked|chat|chatted) with|\b(?:spoke|speak|talk|talked|listen|listened) to"
    r"|\b(?:thank|thanks|thanked|ask|asked|tell|told|call|called|email|emailed|ping|pinged|remind|reminded|contact|contacted|met|invite|invited|named)"
    r"|\bmit|\bfragt(?:e)?|\bavec|\bhablé con|\bparlato con|\bfalei com|\b[сС])\s$"
)
AFTER = regex.compile(
    r"\s(?:said|says|asked|asks|thinks|thought|told|replied|answered|mentioned|agreed|wrote|called|explained|suggested|lives|works|noted|added|sagte?|meint|meinte|dit|dijo|dice|disse|сказала?|говорит)\b"
)
AND = regex.compile(r"(?:,|,? and|,? or| &| und| et| y| e| и)\s$")
# First words of names of places, words behind a place's or a thing's name, and words of headings.
NO_PERSON = set("""New North South East West Northern Southern Eastern Western San Santa Saint Los Las Puerto Port Mount Lake Fort Bad Rio Sierra Costa United
Street Avenue Road Lane Square Park Bridge Station Airport County City State University College School Hospital Church Museum Hotel Building Room Floor Suite Tower Center Centre
Ticket Invoice Version Action Item Items Next Open Point Points Small Print Meeting Project Team Plan Review Release Department Office Board Committee Ministry Court Act Law Treaty
Participants Attendees Subject Topic Agenda Attachment Location Date Dear Regards Best Hello Hi Yes No Okay Ok Good Great Happy Thank Call Email Phone Office Flat Apartment Apt Box""".split())
# Forms of address behind a name in scripts without case, and words before them that are no names.
HONORIFIC = regex.compile(
    r"(?<![\p{Han}\p{Katakana}])([\p{Han}]{2,5}|[\p{Katakana}ー・]{2,12})(?=さん|様|氏(?!名)|くん|先生|女士)|(?<!\p{Hangul})(\p{Hangul}{2,4})(?=\s?(?:씨|님)(?!\p{Hangul}{2}))"
)
NO_HONORED = set("皆 各位 医者 客 客様 神 王 患者 担当者 社長 部長 課長 奥 娘 息子 学生 担任 大学 会社 고객 선생 사장 부장 과장 팀장 손 대표 여러분".split())


LOW = regex.compile(r"(?<![\p{L}\p{M}])\p{Ll}[\p{L}\p{M}]++")


def _free(text: str, out: list) -> str:
    """The text outside the values found so far."""
    parts, at = [], 0
    for a, b, _ in sorted(out):
        parts.append(text[at:a])
        at = b
    return " ".join([*parts, text[at:]])


def _word_here(text: str, end: int) -> bool:
    """Whether what follows, without notes and hesitation, shows a word rather than a name."""
    from palaver.llm.turns import NOTE, SOUND

    return NOT_AFTER.match(SOUND.sub("", NOTE.sub("", text[end : end + 80]))) is not None


def _names(text: str, taken: bytearray, out: list, given: frozenset) -> None:
    """Names in running text: behind titles, initials before a family name, known given names, and unknown ones by context."""

    def add(a: int, b: int) -> None:
        if not any(taken[a:b]):
            out.append((a, b, "name"))
            taken[a:b] = b"\x01" * (b - a)

    for m in TITLE.finditer(text):
        a, b = m.span(1)
        words = m.group(1).split()
        if words[0] in STOP or (text[m.start()] == "M" and text[m.start() + 1] in ". " and not _french(text[max(0, a - 40) : b + 60])):
            continue
        add(a, a + len(words[0]) if len(words) > 1 and words[-1] in STOP else b)
    low: set[str] | None = None
    for run in (RUN if OTHER_CASED.search(text) else LATIN_RUN).finditer(text):
        g = run.group()
        if g not in given and (g in STOP or g in NO_PERSON):
            continue
        if low is None:
            low = set(LOW.findall(_free(text, out)))
        if g.isalpha() and g not in given and g.lower() in low:
            continue
        units = [(g, *run.span())] if g.isalpha() else [(m.group(), *m.span()) for m in UNIT.finditer(text, *run.span())]
        i = 0
        while i < len(units):
            w, a, b = units[i]
            rest = units[i + 1 :]
            # the family name behind: directly or after initials
            k = next((j for j, (x, *_) in enumerate(rest) if x[-1] != "."), len(rest))
            family = rest[k] if k < len(rest) and k < 3 and rest[k][0] not in STOP else None
            if w[-1] == ".":
                if family and family[0] not in NO_FAMILY and k < 2 and family[0] not in NO_PERSON:
                    add(a, family[2])
                    i += k + 2
                    continue
                i += 1
                continue
            if w in given:
                if family and k < 2:
                    end, step = family[2], k + 2
                elif rest and k and not text[rest[0][2] : rest[0][2] + 1].isalpha():
                    end, step = rest[0][2], 2
                else:
                    end, step = b, 1
                if step > 1 or not (w in ALSO_WORDS and _word_here(text, b)) and len(w) > 2:
                    add(a, end)
                i += step
                continue
            if w in STOP or w in NO_PERSON or w.casefold() in ORG:
                i += 1
                continue
            group = [units[i]]
            for x in rest:
                if x[0] in given or x[0] in STOP or x[0] in NO_PERSON or x[0].casefold() in ORG or len(group) == 4:
                    break
                group.append(x)
            words = [x[0] for x in group if x[0][-1] != "."]
            follows = rest[len(group) - 1][0] if len(group) <= len(rest) else ""
            plain = any(x.lower() in low for x in words)
            firm = follows.casefold() in ORG or follows in NO_PERSON or (i and units[i - 1][0] in NO_PERSON)
            if not plain and not firm:
                before = text[max(0, a - 24) : a]
                cue = bool(BEFORE.search(before) or AFTER.match(text, group[-1][2]))
                if not cue and (glue := AND.search(before)):
                    # a list goes on: the one before is a name
                    at = a - len(glue.group())
                    cue = at > 0 and any(y == at and kind == "name" for _, y, kind in out[-1:])
                if 2 <= len(words) <= 3 and not _noun_language(low) or cue:
                    add(a, group[-1][2])
                    i += len(group)
                    continue
            i += 1
    for m in HONORIFIC.finditer(text):
        g = 1 if m.group(1) else 2
        if m.group(g) not in NO_HONORED:
            add(*m.span(g))


def _noun_language(low: set[str]) -> bool:
    """Whether the text is in a language that capitalises nouns: two capitals in a row prove little there."""
    return len(low & GERMAN) >= 3


# Frequent words that tell German.
GERMAN = set("der die das und ist nicht wir ich sie für mit auf den dem ein eine von noch wird haben".split())


MARKED = regex.compile(r"[:：>|\t\])=~]|\s[-–—]")
PRESENT = regex.compile(r"\s*(?:participants|attendees|present)\s*:\s*", regex.I)


def _label_names(text: str, given: frozenset) -> list[tuple[int, int]]:
    """Offsets of the names in speaker labels and lists of participants."""
    from palaver.llm.turns import HEADINGS, VOICE, fold, is_heading, looks_like_name, options

    spots, at, names = [], 0, set()
    lower: list[tuple[int, str]] = []
    for line in text.split("\n"):
        bare = line.rstrip("\r")
        if "-->" in bare or not MARKED.search(bare):
            at += len(line) + 1
            continue
        v = VOICE.match(bare)
        h = PRESENT.match(bare)
        found: list[tuple[int, str]] = []
        if h:
            for m in pat(r"[^;|]+").finditer(bare[h.end() :]):
                found.append((h.end() + m.start(), m.group()))
        elif v:
            found.append((v.start(1), v.group(1)))
        else:
            # of the places where a label may end, the first whose label is no heading
            hits = [(x, bare[x:y]) for (head, sep, _), (x, y), t, _, only in options(bare) if (t or not only or ":" in sep) and (head.strip("-") or sep[:1] == ":" or t)]
            found += [h for h in hits if not is_heading(h[1])][:1]
        for off, raw in found:
            lead_ws = pat(r"[\s\-–—\[(<>]*").match(raw).end()
            body = raw[lead_ws:].rstrip()
            body = body[:-1].rstrip() if raw.lstrip(" -–—")[:1] == "[" and body.endswith("]") else body
            body = pat(r"\s*[(\[][^()\[\]]*[)\]]\s*$").sub("", body).rstrip(" ])>")
            if not body:
                continue
            t = pat(r"(?:Dr|Mr|Mrs|Ms|Prof)\.?\s").match(body)
            if t:
                lead_ws += t.end()
                body = body[t.end() :]
            if looks_like_name(body) and body.casefold() not in HEADINGS:
                spots.append((at + off + lead_ws, at + off + lead_ws + len(body)))
                names.add(fold(body))
            elif body == body.lower():
                lower.append((at + off + lead_ws, body))
        at += len(line) + 1
    for a, body in lower:
        if fold(body) in names or body.split()[0].capitalize() in given or body.split()[0].title() in given or len(body.split()) > 1:
            if all(pat(r"[\p{L}\p{M}'’.\-]+").fullmatch(w) for w in body.split()) and len(body.split()) <= 3:
                spots.append((a, a + len(body)))
    return spots


def find(text: str | None, is_name_field: bool = False, given: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """(begin, end, kind), offsets of code points, in order. given: words known as given names from elsewhere."""
    if not text or not text.strip():
        return []
    taken, out = bytearray(len(text)), []
    low = text.lower()
    digits = pat(r"\d").search(text) is not None
    spelled = SPELLED.search(low) is not None
    # each detector runs where what it cannot do without is there
    for rx, needs in zip(EMAIL, ("@" in text, pat(r"[\[({]\s?at\s?[\])}]").search(low), " dot " in low), strict=True):
        if needs:
            _take(rx, text, taken, out, "email")
    if digits:
        for rx, needs in zip(ADDRESS, ("box" in low, True, FRENCH_STREET.search(low), STREET.search(low), True, "." in low or "ул" in low), strict=True):
            if needs:
                _take(rx, text, taken, out, "address", given, is_name_field)
        for rx in ID:
            _take(rx, text, taken, out, "id_number")
    for rx, needs in zip(PHONE, (*[digits] * (len(PHONE) - 1), spelled), strict=True):
        if needs:
            _take(rx, text, taken, out, "phone")
    if is_name_field:
        _name_field(text, taken, out)
        return sorted(out)
    for a, b in _label_names(text, given):
        if not any(taken[a:b]):
            out.append((a, b, "name"))
            taken[a:b] = b"\x01" * (b - a)
    # given names of labels ("Last, First" gives the part behind the comma)
    labels = (text[a:b] for a, b, k in out if k == "name")
    own = {w for n in labels for w in n.split(",")[-1].split()[:1] if w[0].isupper() and len(w) > 2 and not w.isupper() and w not in STOP}
    _names(text, taken, out, given | own)
    _again(text, taken, out, given | own)
    return sorted(out)


def _again(text: str, taken: bytearray, out: list, given: frozenset) -> None:
    """Family names of the people found so far where they stand alone, and their full names in capitals."""
    families, full = set(), set()
    for a, b, k in out:
        if k == "name":
            words = pat(r"[\p{L}\p{M}'’\-]+").findall(text[a:b])
            if len(words) > 1 and text[a].isupper():
                families |= {w for w in words if len(w) > 3 and w not in given and w[0].isupper() and not w.isupper()}
                full.add(" ".join(words).upper())
    if not families:
        return
    bad_before, bad_after = "_@.'’-", "_@"
    for w in sorted(full | families | {f.upper() for f in families}, key=len, reverse=True):
        a = text.find(w)
        while a >= 0:
            b = a + len(w)
            before, after = text[a - 1 : a], text[b : b + 1]
            whole = not (before.isalnum() and not _no_case(before)) and before not in tuple(bad_before) and not (after.isalnum() and not _no_case(after)) and after not in tuple(bad_after)
            if whole and not any(taken[a:b]):
                out.append((a, b, "name"))
                taken[a:b] = b"\x01" * (b - a)
            a = text.find(w, b)


def _no_case(c: str) -> bool:
    """A letter of a script without case: it may touch a Latin name."""
    return c.isalpha() and c.lower() == c.upper()


# Words and endings of organisations, and what stands in a name field for nobody.
ORG = set("""ltd limited inc incorporated corp corporation co company gmbh ag sa plc llc llp kg bv nv oy ab spa srl group holding holdings freight frt
logistics log technologies tech consulting research res laboratories labs lab foods fds insurance ins engineering eng manufacturing mfg international
intl int trading trdg trd cons cnsltg consult hldgs hldg svcs sys ptnrs assoc technology food brothers bros partners associates services solutions systems bank foundation institute university""".split())
NOBODY = {
    "", "unknown", "unknown speaker", "unassigned", "tbd", "tba", "n/a", "na", "none", "null", "everyone", "everybody", "the team", "team", "all", "anyone",
    "someone", "nobody", "no one", "guest", "guests", "participant", "attendee", "speaker", "user", "me", "us", "unnamed", "anonymous", "test", "?", "-", "--", "...", "various",
    "to be decided", "to be determined", "whoever", "the group", "host", "moderator", "not assigned", "open", "pending", "all hands",
}
PLACEHOLDER = regex.compile(r"(?:speaker|spk|participant|guest|user|person|caller|attendee|voice)[\s_\-#]*(?:\d+|[a-z])?$", regex.I)


def is_nobody(name: str | None) -> bool:
    s = pat(r"\s+").sub(" ", (name or "").strip()).casefold()
    return s in NOBODY or bool(PLACEHOLDER.match(s)) or not pat(r"\p{L}").search(s)


def is_org(name: str) -> bool:
    words = pat(r"[\p{L}\p{M}]+").findall(name.replace(".", "").casefold())
    return any(w in ORG for w in words[1:])


def _name_field(text: str, taken: bytearray, out: list) -> None:
    """What remains of a name field besides mail, phone, number and address is one name, unless it is an organisation."""
    rest = "".join(" " if t else c for c, t in zip(text, taken, strict=True))
    rest_core = pat(r"\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]").sub(lambda m: " " * len(m.group()), rest)
    m = pat(r"[\p{L}\p{N}].*[\p{L}\p{N}.]|\p{L}").search(rest_core)
    if not m:
        return
    a, body = m.start(), m.group().rstrip(" ,;/|-–")
    t = pat(r"(?:(?:Dr|Mr|Mrs|Ms|Miss|Prof|Hr|Fr|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Dra|Sig|sig|Dott|dott|dott\.ssa|Sir|Rev|Eng|Ing)\.?\s+)+(?=\p{L}{2}|\p{Lu}\.)").match(body)
    if t:
        a, body = a + t.end(), body[t.end() :]
    body = pat(r"(?:,?\s(?:Jr|Sr|PhD|MD|Esq|II|III)\.?)$|['’]s$").sub("", body)
    if body.endswith(".") and not pat(r"(?<!\p{L})\p{Lu}\.$").search(body):
        body = body[:-1]
    if is_nobody(body) or is_org(body) or pat(r"\d{3,}").search(body):
        return
    out.append((a, a + len(body), "name"))


# --- replacing -----------------------------------------------------------------------------------------------------


def redact(text: str | None, is_name_field: bool = False, given: frozenset = frozenset()) -> str | None:
    """Typed placeholders, numbered by entity within the record: [NAME_1], [EMAIL_1] ..."""
    if text is None:
        return None
    seen: dict[tuple[str, str], int] = {}
    out, at = [], 0
    for a, b, kind in find(text, is_name_field, given):
        key = (kind, _entity(kind, text[a:b]))
        n = seen.setdefault(key, 1 + sum(k == kind for k, _ in seen))
        out += [text[at:a], f"[{kind.upper()}_{n}]"]
        at = b
    return "".join([*out, text[at:]])


def _entity(kind: str, value: str) -> str:
    if kind == "name":
        from palaver.llm.turns import fold

        return fold(value)
    if kind in ("phone", "id_number"):
        return pat(r"\W").sub("", value).upper()
    v = value.casefold()
    if kind == "email":
        v = pat(r"\s?[\[({]?\s?\bat\b\s?[\])}]?\s?(?=[\w\-]+(?:\.|\sdot\s|\s?[\[({]))").sub("@", v, count=1)
        v = pat(r"\s?[\[({]?\s?\bdot\b\s?[\])}]?\s?").sub(".", v)
    return v


def _draw(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x00".join(parts).encode(), hashlib.sha256).digest()[:8], "big")


# Syllables that family names are made of, by script.
SYLLABLES = {
    "Latin": "bal cor den fal gri hol jas kel lom mar nor pel quin ros sel tan ul ver wen yar zab".split(),
    "Cyrillic": "бал вер гор дан зор кал лом мир нов пол рос сел тар чер яр".split(),
    "Greek": "βαλ γορ δεν καλ λομ μαρ νορ πελ ροσ σελ ταν".split(),
    "Katakana": "アサ イナ ウエ オダ カワ キタ サト ナカ マツ ヤマ".split(),
    "Hangul": "강 권 노 류 문 배 서 송 안 윤 조 한".split(),
    "Han": "安 白 程 方 高 何 江 林 沈 田 吴 叶".split(),
}
_SCRIPT = {k: regex.compile(rf"\p{{{k}}}") for k in SYLLABLES}


def _script(word: str) -> str:
    return next((k for k, rx in _SCRIPT.items() if rx.match(word)), "Latin")


def _surname(n: int, script: str = "Latin", parts: int = 3) -> str:
    s = SYLLABLES[script]
    return "".join(s[n // len(s) ** i % len(s)] for i in range(parts)).capitalize()


def _given(n: int, word: str) -> str:
    """A given name of the same script and, by its ending, gender."""
    script, female = _script(word), _strip_accents(word).casefold()[-1:] in "aeiyая"
    pools = {"Latin": (MALE, FEMALE), "Cyrillic": (MALE_CYRILLIC, FEMALE_CYRILLIC)}
    if script not in pools:
        return _surname(n, script, 2)
    pool = pools[script][female]
    return pool[n % len(pool)] + (_surname(n // len(pool), script, 1).lower() if n % 97 == 0 else "")


def surrogate(text: str | None, key: bytes, is_name_field: bool = False, given: frozenset = frozenset()) -> str | None:
    """The text with keyed surrogates in place of every value."""
    if text is None:
        return None
    spots = find(text, is_name_field, given)
    real = {_entity(k, text[a:b]) for a, b, k in spots}
    parts_real = {w for a, b, k in spots if k == "name" for w in _entity("name", text[a:b]).replace(".", "").split()}
    chosen: dict[tuple[str, str], str] = {}
    used: set[tuple[str, str]] = set()

    def pick(kind: str, entity: str, make) -> str:
        if (kind, entity) not in chosen:
            n = 0
            while True:
                s = make(_draw(key, kind, entity, str(n)))
                n += 1
                if (kind, s) not in used and s.casefold() not in real and s.casefold() not in parts_real:
                    break
            used.add((kind, s))
            chosen[kind, entity] = s
        return chosen[kind, entity]

    names = [pat(r"[\p{L}\p{M}]+").findall(text[a:b]) if "," not in text[a:b] else pat(r"[\p{L}\p{M}]+").findall(text[a:b])[::-1] for a, b, k in spots if k == "name"]
    low = lambda w: _strip_accents(w).casefold()
    families = {low(w[-1]) for w in names if len(w) > 1 and len(w[-1]) > 1}
    givens = sorted({low(w[0]) for w in names if len(w[0]) > 1} - families)
    out, at = [], 0
    for a, b, kind in spots:
        out += [text[at:a], _replace(kind, text[a:b], pick, families, givens)]
        at = b
    return "".join([*out, text[at:]])


def _replace(kind: str, value: str, pick, families: set[str], givens: list[str]) -> str:
    if kind == "name":

        def one(m) -> str:
            w = m.group()
            low = _strip_accents(w).casefold()
            if len(w) == 1 and w.isupper():  # an initial is that of the surrogate of the given name it may stand for
                full = next((g for g in givens if g[0] == low), None)
                if full:
                    return pick("word", full, lambda n: _given(n, full))[0].upper()
                return pick("initial", low, lambda n: _given(n, w)[0])
            make = _surname if low in families else _given
            s = pick("word", low, (lambda n: _surname(n, _script(w), 3 if _script(w) in ("Latin", "Cyrillic", "Greek") else 2)) if make is _surname else (lambda n: _given(n, w)))
            return s.upper() if w.isupper() and len(w) > 1 else s.lower() if w.islower() else s

        return pat(r"[\p{L}\p{M}]+").sub(one, value)
    if kind in ("phone", "id_number"):
        # the same figures in the same places, whatever the separators of this mention
        plain = _entity(kind, value)

        def draw(n: int) -> str:
            return "".join(str((n >> (3 * (i % 20))) % 10) if c.isdigit() else c for i, c in enumerate(plain))

        fresh = iter(pick(kind, plain, draw))
        return "".join(next(fresh) if pat(r"\w").match(c) else c for c in value)
    if kind == "email":
        local = pick(kind, _entity(kind, value), lambda n: f"{_surname(n)}{n // 9261 % 1000}".lower())
        dom = pat(r"(?i)(@|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)").search(value)
        s = f"{local}{dom.group(1) if dom else '@'}mail.example" if " dot " not in value.casefold() else f"{local} at mail dot example"
        return s.upper() if value.isupper() else s
    # street addresses: the numbers and the capitalised words are replaced, the pattern of the country stays
    fresh = pick(kind, value.casefold(), lambda n: str(n))
    n = int(fresh)
    s = pat(r"\d").sub(lambda m: str((n >> (m.start() % 50)) % 10), value)
    return pat(r"(?<=\d[A-Za-z]?,?\s)\p{Lu}[\p{L}\-]+(?=\s\p{Lu})").sub(lambda m: _surname(n), s, count=1)


# --- queries -------------------------------------------------------------------------------------------------------


# Forms of address that may stand before a name in a name field; a name as two capitalised words.
PERSON_FIELD = r"^\s*(?:(?:Dr|Mr|Mrs|Ms|Miss|Prof|Hr|Fr|Herr|Frau|Mme|Mlle|Sr|Sra|Dra)\.?\s+)*(\p{Lu}[\p{L}\p{M}'’\-]*\p{Ll}[\p{L}\p{M}'’\-]*)[ _]+(?:\p{Lu}\.\s+)?(\p{Lu}[\p{L}\p{M}'’\-]*\p{Ll}[\p{L}\p{M}]*)"
ORG_FIELD = rf"(?i)(?<!\p{{L}})(?:{'|'.join(sorted(ORG, key=len, reverse=True))}|the|speaker|unknown)(?!\p{{L}})"
#: A word is a given name if it stands before so many different family names.
FAMILIES = 2


def given_of(name: str) -> tuple[str, str] | None:
    """(given name, family name) of a value typed as both."""
    m = pat(PERSON_FIELD).search(name)
    return None if m is None or pat(ORG_FIELD).search(name) else (m.group(1), m.group(2))


def given_names(names: DataFrame) -> DataFrame:
    """names(name) -> word: given names by the evidence of a whole name column; a hot name costs one row per map task."""
    two = names.where(F.col("name").rlike(PERSON_FIELD) & ~F.col("name").rlike(ORG_FIELD)).select(
        F.regexp_extract("name", PERSON_FIELD, 1).alias("word"), F.regexp_extract("name", PERSON_FIELD, 2).alias("family")
    )
    return two.distinct().groupBy("word").agg(F.count("*").alias("k")).where(F.col("k") >= FAMILIES).select("word")


def with_known(texts: DataFrame, key: str, text_col: str, names: DataFrame) -> DataFrame:
    """texts(key, text_col) plus known: those words of the text that are given names of the column names.name.

    The words of a text are joined with the evidence, not the evidence sent to every task, so both may grow.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"(\p{Lu}[\p{Lu}\p{Ll}\p{M}]+(?:-\p{Lu}[\p{Lu}\p{Ll}\p{M}]+)*)")))).alias("word"))
    found = words.join(given_names(names), "word").groupBy(key).agg(F.collect_list("word").alias("known"))  # words of one text
    return texts.join(found, key, "left")


def find_values(df: DataFrame, text_col: str, is_name_field: bool, keys: list[str]) -> DataFrame:
    """df(keys, text_col[, known]) -> keys, kind, found_text (one row per mention), begin_at, end_at."""
    known = F.col("known") if "known" in df.columns else F.lit(None).cast("array<string>")

    @F.pandas_udf("array<struct<kind:string,found_text:string,begin_at:int,end_at:int>>")
    def detect(texts: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, ws in zip(texts, words, strict=True):
            spots = find(t, is_name_field, frozenset() if ws is None else frozenset(ws))
            out.append([{"kind": k, "found_text": t[a:b], "begin_at": a + 1, "end_at": b} for a, b, k in spots])
        return pd.Series(out)

    return df.select(*keys, F.inline(detect(text_col, known)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_once(spark, sf_dir, "meeting", ["meeting_id", "raw_text"]).where("raw_text is not null")
    people = read_once(spark, sf_dir, "person", ["person_id", "name"]).where("name is not null")
    a = find_values(with_known(texts, "meeting_id", "raw_text", people), "raw_text", False, ["meeting_id"])
    b = find_values(with_known(people, "person_id", "name", people), "name", True, ["person_id"])
    both = a.select(F.lit("meeting.raw_text").alias("field_name"), F.col("meeting_id").alias("rec_key"), "kind", "found_text").unionByName(
        b.select(F.lit("person.name").alias("field_name"), F.col("person_id").cast("string").alias("rec_key"), "kind", "found_text")
    )
    return both.distinct()


def _rewrite(spark: SparkSession, sf_dir: str, f, out: str) -> DataFrame:

    @F.pandas_udf("string")
    def texts_udf(t: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([f(x, False, frozenset() if ws is None else frozenset(ws)) for x, ws in zip(t, words, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def names_udf(t: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([f(x, True, frozenset() if ws is None else frozenset(ws)) for x, ws in zip(t, words, strict=True)], dtype=object)

    people = read_once(spark, sf_dir, "person", ["person_id", "name"])
    texts = with_known(read_once(spark, sf_dir, "meeting", ["meeting_id", "raw_text"]), "meeting_id", "raw_text", people)
    return texts.select(
        F.lit("meeting.raw_text").alias("field_name"), F.col("meeting_id").alias("rec_key"), texts_udf("raw_text", "known").alias(out)
    ).unionByName(
        with_known(people, "person_id", "name", people).select(
            F.lit("person.name").alias("field_name"), F.col("person_id").cast("string").alias("rec_key"), names_udf("name", "known").alias(out)
        )
    )


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return _rewrite(spark, sf_dir, redact, "masked_text")


def p1_surrogates(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Every text with keyed surrogates. The key is the caller's secret; without one a key is drawn for this call."""
    secret = key or secrets.token_bytes(32)
    return _rewrite(spark, sf_dir, lambda t, n, g: surrogate(t, secret, n, g), "surrogate_text")
