"""Speaker turns from transcript lines and caption cues.

The layouts of a text are mined from its own lines by a tree of fixed depth: every line is put under the marks before
and around its first time (level 1), the marks between its first words and what follows them (level 2, one branch for
each place where marks stand within the first SLOT_WORDS words) and whether a time ends it (level 3). Words and times are
wildcards, so a leaf is a template such as ``{TIME} NAME ~``; no list of layouts is kept. The slots of a leaf are
inferred from their values: a time slot holds times, a speaker slot mostly names. The best leaf's slots are read from
every line that fits. Cues carry the label in a column or in the text. All spellings of one participant of a meeting
are resolved to one speaker; then runs of one speaker are folded into turns.

Nulls: a null text or cue text has no words and is skipped; a cue without any time sorts behind the timed ones by pos.
Repeated rows of a key count once. Ties in time are ordered by pos. Empty tables give no turns.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.patterns import pat
from palaver.sources.checkpoints import cut
from palaver.sources.tables import read_once

# Hesitation sounds, alone or as a whole line.
HESITATIONS = {
    "um", "umm", "uh", "uhh", "er", "err", "erm", "eh", "ah", "hm", "hmm", "hmmm", "mm", "mmm", "mhm", "uhm", "ähm", "äh",
    "öh", "hum", "euh", "ehm", "em", "este", "эм", "ээ", "э", "ну", "えっと", "えー", "あの", "あのー", "嗯", "呃", "啊", "음", "어", "그",
    "uhuh", "uh-huh", "mm-hmm", "huh", "oh", "ahem", "ум", "हम्म", "उम", "اممم", "امم",
}
# Words that head a line without being a participant.
HEADINGS = {
    "meeting", "date", "time", "participants", "attendees", "present", "subject", "topic", "agenda", "location", "attachment", "attachments",
    "reminder", "note", "notes", "action item", "action", "action items", "next topic", "next step", "next steps", "decision", "question", "answer",
    "summary", "update", "todo", "to do", "follow-up", "follow up", "status", "warning", "info", "ps", "p.s.", "re", "link", "source", "file", "title",
    "transcript", "recording", "duration", "host", "organizer", "open point", "open points", "point", "item", "issue", "risk", "deadline", "important",
    "fyi", "nb", "small print", "aside", "correction", "example", "quote", "background", "context", "minutes", "next meeting", "recap", "conclusion",
}
NOTE = regex.compile(r"\[[^\]\n]*\]|\([^)\n]*\)|<[^>\n]*>|\*[^*\n]*\*|[♪♫♬#]+[^♪♫♬\n]*[♪♫♬]+|[♪♫♬]+|\{[^}\n]*\}")
TIME = r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d{1,3})?"
WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’\-]*")
ROLE = regex.compile(r"\s*[(\[][^()\[\]]*[)\]]\s*$")
NAME_TOKEN = regex.compile(r"[\p{L}][\p{L}\p{M}'’.\-]*$")


BRACKETED = regex.compile(rf"\[?\(?(?<!\d){TIME}(?!\d)\)?\]?")
SPECIAL = regex.compile(r"[\[(<*♪♫♬#{]|\d:\d")


def has_speech(text: str | None) -> bool:
    """Whether something remains besides notes, times and hesitation sounds."""
    if not text:
        return False
    rest = NOTE.sub(" ", BRACKETED.sub(" ", text)) if SPECIAL.search(text) else text
    return any(m.group().casefold().strip("'’-") not in HESITATIONS for m in WORD.finditer(rest))


def fold(name: str) -> str:
    """Lower case, without accents, roles, brackets, dashes before it and doubled spaces."""
    s = pat(r"^[\s\-–—>•*]+|[\s:>\-–—]+$").sub("", name)
    for open_, close in ("[]", "<>", "()"):
        if s[:1] == open_ and close in s:
            j = s.rfind(close) if s[-1] == close else s.find(close)
            s = (s[1:j] + s[j + 1 :]).strip()
    s = s.strip("<>[] ")
    s = ROLE.sub("", s)
    if s.count(",") == 1:
        last, first = s.split(",")
        s = f"{first.strip()} {last.strip()}"
    s = s.replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("Æ", "Ae").replace("ß", "ss").replace("ł", "l").replace("Ł", "L")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = pat(r"[_\s]+").sub(" ", s).casefold().strip()
    return pat(r"^(?:dr|mr|mrs|ms|prof|hr|fr|mme|sr|sra|dra)\.?\s+(?=\S{2})").sub("", s)


def is_heading(label: str) -> bool:
    low = pat(r"\s+").sub(" ", label.strip().strip("*_#").casefold())
    return low in HEADINGS or bool(pat(r"\d").search(low))


def looks_like_name(label: str) -> bool:
    s = pat(r"^[\s\-–—>•]+").sub("", label).strip()
    s = ROLE.sub("", s[1:-1] if s[:1] == "[" and s[-1:] == "]" else s).strip("[] ")
    tokens = s.replace(",", " ").split()
    if not 1 <= len(tokens) <= 4 or is_heading(s) or not all(NAME_TOKEN.match(t) for t in tokens):
        return False
    return all(t[0].isupper() or t.lower() in ("de", "van", "von", "da", "di", "del", "la", "le", "bin", "al") for t in tokens)


def lower_name(label: str, words: set[str] | None = None) -> bool:
    """A label typed in lower case throughout: one to three words that only hold letters; words: those it may be made of."""
    s = ROLE.sub("", label.strip().strip("[]-–> ")).strip()
    parts = s.replace(",", " ").split()
    if not (s == s.lower() and 1 <= len(parts) <= 3 and not is_heading(s) and all(NAME_TOKEN.match(w) for w in parts)):
        return False
    return words is None or all(len(w.strip(".")) == 1 or w in words for w in fold(s).split())


def typed_low(label: str, rest: str) -> bool:
    """Several words in lower case before a sentence that begins with a capital: a name typed carelessly, not a part of speech."""
    begin = pat(r"^[^\p{L}]*").sub("", rest)
    return lower_name(label) and len(fold(label).split()) > 1 and begin[:1].isupper()


def words_of(names) -> set[str]:
    return {w for n in names for w in n.split()}


def same_speakers(labels: list[str]) -> dict[str, str]:
    """Spelling -> speaker key, for the labels of one meeting (those that are names)."""
    folded = {x: fold(x) for x in labels}
    count = Counter(folded.values())
    full = sorted({f for f in count if len(f.split()) >= 2 and not any(len(t.strip(".")) == 1 for t in f.split())})
    target: dict[str, str] = {}
    # misspelt full names join the more frequent one at distance one; both share a token at its place
    by_place: dict[tuple[int, str], list[str]] = defaultdict(list)
    for f in sorted(full, key=lambda x: (-count[x], x)):
        words = f.split()
        rev = " ".join(reversed(words))
        near = [g for at in enumerate(words) for g in by_place[at] if _close(f, g)] if rev not in target else [rev]
        target[f] = near[0] if near else f
        if not near:
            for at in enumerate(words):
                by_place[at].append(f)
    bases = sorted(set(target.values()))
    by_word: dict[str, list[str]] = defaultdict(list)
    for b in bases:
        first, last = b.split()[0], b.split()[-1]
        for w in dict.fromkeys([*b.split(), first[0] + last, b.replace(" ", "."), b.replace(" ", "")]):
            by_word[w].append(b)
    for f in count:
        if f in target:
            continue
        t = [x.strip(".") for x in f.split()]
        if len(t) == 1:
            hits = [b for b in by_word[t[0]] if t[0] in b.split()] or by_word[t[0]]
            hits = [b for b in hits if b.split()[0] == t[0]] or hits
        else:
            long = [x for x in t if len(x) > 1]
            hits = [b for b in (by_word[long[0]] if long else bases) if _initials(t, b.split())]
        target[f] = hits[0] if hits else f
    # given names alone, beside initials of the same: "Linh" and "Linh C." without any full form
    loose = [f for f in count if target[f] == f and f not in full]
    longer: dict[str, str] = {}
    for g in loose:
        if len(g.split()) > 1:
            longer[g.split()[0]] = g
    for f in loose:
        if len(f.split()) == 1 and f in longer:
            target[f] = longer[f]
    return {x: target[f] for x, f in folded.items()}


def display(labels: list[str], speaker: dict[str, str]) -> dict[str, str]:
    """Speaker key -> its best spelling: most words, mixed case, without comma or role, then the smallest."""
    best: dict[str, tuple] = {}
    for x in labels:
        s = x.strip("-–—>•*: \t")
        s = (s[1:-1] if s[:1] + s[-1:] in ("[]", "()", "<>") else ROLE.sub("", s)).strip("[]<> \t")
        rank = (-min(len(s.split()), 3), s.islower() or s.isupper(), "," in s or "." in s or "_" in s, s)
        if speaker[x] not in best or rank < best[speaker[x]]:
            best[speaker[x]] = rank
    return {k: r[-1] for k, r in best.items()}


def _initials(short: list[str], name: list[str]) -> bool:
    """"c ashgrovetti", "cornelius a", "linh b casp": every token equals or starts a token of the name, in order."""
    if len(short) == 3 and len(name) == 2 and len(short[1]) == 1:
        short = [short[0], short[2]]
    if len(short) != len(name):
        return False
    return any(
        all(a == b or (len(a) == 1 and b.startswith(a)) for a, b in zip(short, n, strict=True)) for n in (name, name[::-1])
    )


def _close(a: str, b: str) -> bool:
    """Same given name and a surname within one edit or one swap of neighbours (or the other way round)."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return False
    diff = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return len(diff) == 1 and min(map(len, diff[0])) >= 5 and _one_edit(*diff[0])


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i:] == b[i + 1 :]


# --- texts ---------------------------------------------------------------------------------------------------------

#: A speaker slot holds at most so many words (a name of four, a role, a title).
SLOT_WORDS = 8
HEAD = regex.compile(rf"(?P<lead>[^\p{{L}}\p{{N}}\n]*+)(?:(?P<time>(?<!\d){TIME}(?![\d:]))(?P<close>[^\p{{L}}\p{{N}}\n]*+))?")
GAP = regex.compile(rf"(?:[^\p{{L}}\p{{M}}\p{{N}}\n]|(?<!\d){TIME}(?!\d))+")
OWN = regex.compile(rf"\s*(?:.*{TIME})?[^\s]*\s*")
#: Marks that stand inside names, and openers of a role behind a name.
ANY_TIME = regex.compile(TIME)
INSIDE = regex.compile(r"[  ]?|['’\-.·_]|[.,] |, ?|[ ]?[(\[]")
TAIL = regex.compile(rf"\s*[\[(]\s*({TIME})\s*[\])]\s*$")
CLOSERS = {")": "(", "]": "["}


def _marks(s: str) -> str:
    """A run of marks as a token of the tree: times are one wildcard, white space and kinds of dashes and colons are one."""
    if s.isascii() and not ANY_TIME.search(s):
        return "\t" if s.strip(" ") == "\t" else "".join(s.split())
    s = ANY_TIME.sub("§", s).replace("–", "-").replace("—", "-").replace("：", ":")
    return "".join(s.split())


def options(line: str) -> list[tuple[tuple[str, str, bool], tuple[int, int], str, int, bool]]:
    """Paths of the tree a line lies under: (path, offsets of the label, time, begin of the rest, label only)."""
    h = HEAD.match(line)
    at = h.end()
    if at >= len(line) or not line[at].isalpha():
        return []
    t = h["time"] or ""
    head = _marks(h["lead"]) + ("§" + _marks(h["close"]) if t else "")
    tail, found, words = TAIL.search(line, at) if line.rstrip()[-1:] in ")]" else None, [], 1
    for g in GAP.finditer(line, at):
        if words > SLOT_WORDS:
            break
        words += 1
        a, gap = g.start(), g.group()
        if gap == " ":
            continue
        # a bracket opened behind the name belongs to the label, and so does the period of an initial
        while gap and (gap[0] in CLOSERS and line.count(CLOSERS[gap[0]], at, a) > line.count(gap[0], at, a) or gap[0] == "." and gap[1:].strip()):
            a, gap = a + 1, gap[1:]
        # marks behind the white space that follows the separator open the rest (quotes, notes), unless they hold a time
        gap = OWN.match(gap).group()
        end = a + len(gap)
        ends = end == len(line)
        own = ANY_TIME.search(gap)
        if INSIDE.fullmatch(gap) and not ends or not (ends or gap[-1:].isspace() or gap[-1:] == "：") or (gap.lstrip()[:1] in "-–—" and gap[:1] not in " \t"):
            continue
        sep = _marks(gap)
        if not sep:
            continue
        if own and ends:
            found.append(((head, sep, False), (at, a), own.group(), end, True))
        elif own:
            found.append(((head, sep, bool(tail)), (at, a), t or own.group(), end, ends))
        else:
            last = tail.group(1) if tail and tail.start() >= a else ""
            rest = line[end : tail.start()] if last else line[end:]
            found.append(((head, sep, bool(last)), (at, a), t or last, end, not rest.strip()))
    return found


def _timed(path: tuple[str, str, bool]) -> bool:
    return "§" in path[0] or "§" in path[1]


def layouts_of(lines: list[list], known: set[str], n_lines: int) -> tuple[dict, tuple | None]:
    """Leaves whose speaker slot holds names, with their number, and the leaf that decides where one is marked."""
    tree: dict[str, dict[str, dict[bool, list[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for found in lines:
        for (head, sep, tail), label in found:
            tree[head][sep][tail].append(label)
    out = {}
    for head, seps in tree.items():
        for sep, tails in seps.items():
            for tail, labels in tails.items():
                path = (head, sep, tail)
                marked = _timed(path) or head == ">>"
                names = [x for x in labels if looks_like_name(x) or fold(x) in known]
                words = None if marked else words_of(known | {fold(x) for x in names})
                names += [x for x in labels if not (looks_like_name(x) or fold(x) in known) and lower_name(x, words)]
                if len(names) * 2 > len(labels):
                    known |= {fold(x) for x in names}
                if not names or len(names) * (2 if _timed(path) else 5) < len(labels):
                    continue
                # marks that are neither a colon nor come with a time divide a name only where they do so throughout
                if marked or sep == ":" or (2 * len(names) >= n_lines and 2 * len({fold(x) for x in names}) <= len(names) and 10 * len(names) >= 9 * len(labels)):
                    out[path] = (marked or tail, len(names))
    sure = [k for k, (s, _) in out.items() if s]
    return out, (max(sure, key=lambda k: out[k][1]) if sure else None)


def spoken_lines(text: str | None) -> tuple[list[tuple[float, int, str | None, str]], list[str]]:
    """((time, line number, label or None, speech as written) in order of time, labels of the text)."""
    if not text:
        return [], []
    lines = [x.rstrip("\r") for x in text.split("\n")]
    parsed = [options(x) if x.strip() else [] for x in lines]
    present: list[str] = []
    for x in lines:
        h = pat(r"(?i)\s*(?:participants|attendees|present)\s*:\s*(.+)").match(x)
        if h:
            present += [p.strip() for p in pat(r"[;|]|,(?=\s*\p{Lu}\S+\s+\p{Lu})").split(h.group(1)) if p.strip()]
    known = {fold(p) for p in present}
    layouts, best = layouts_of([[(o[0], x[slice(*o[1])]) for o in found] for x, found in zip(lines, parsed, strict=True)], known, sum(1 for x in lines if x.strip()))
    if best:
        # one capture tool writes one head and one separator; a plain "Heading: text" among timed lines is speech
        layouts = {k: v for k, v in layouts.items() if k[:2] == best[:2]}

    rows, labels, pending, clock = [], list(present), None, 0.0
    words = None if best else words_of(known)
    for no, (line, found) in enumerate(zip(lines, parsed, strict=True), 1):
        if not line.strip():
            continue
        hit = next((o for o in sorted(found, key=lambda o: -layouts.get(o[0], (0, 0))[1]) if o[0] in layouts), None)
        label = line[slice(*hit[1])] if hit else ""
        whole = False
        if hit and not looks_like_name(label) and fold(label) not in known and not lower_name(label, words) and not typed_low(label, line[hit[3] :]):
            if best and hit[2]:
                label, whole = "", True  # a line with a time, but without a name
            else:
                hit = None
        if hit:
            _, _, t, begin, only = hit
            clock = _seconds(t) if t else clock
            if label:
                labels.append(label)
            if only and label:
                pending = label
                continue
            rest = line[hit[1][0] :] if whole else line[begin:]
            tail = TAIL.search(rest) if hit[0][2] else None
            rows.append((clock, no, label or None, rest[: tail.start()] if tail else rest))
            pending = None
        else:
            rows.append((clock, no, pending, line))
            pending = None
    if best:
        rows.sort(key=lambda r: r[0])  # stable: lines without a time stay behind the line they follow
    return rows, labels


def read_turns(text: str | None) -> list[tuple[int, int, str, float, str]]:
    """(first line, last line, speaker, time, speech without notes and hesitation) of every turn, in order of time."""
    rows, labels = spoken_lines(text)
    spellings = sorted(set(labels))
    speaker = same_speakers(spellings)
    shown = display(spellings, speaker)
    turns: list[list] = []
    current = None
    for clock, no, label, said in rows:
        if not has_speech(said):
            continue
        who = speaker.get(label) if label else current
        if who is None:
            continue
        if turns and who == current:
            turns[-1][1] = no
            turns[-1][4].append(said)
        else:
            turns.append([no, no, shown.get(who, who), clock, [said]])
        current = who
    return [(a, b, who, clock, clean_speech(" ".join(parts))) for a, b, who, clock, parts in turns]


def text_turns(text: str | None) -> list[tuple[int, int]]:
    """(first line, last line) of every turn of a transcript text, in order of time."""
    return [t[:2] for t in read_turns(text)]


_SOUNDS = "|".join(regex.escape(x) for x in sorted(HESITATIONS, key=len, reverse=True))
SOUND = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’\-])(?:{_SOUNDS})(?![\p{{L}}\p{{M}}\p{{N}}'’\-])[,.…]*", regex.I)


def clean_speech(text: str) -> str:
    """Speech without sound notes, marks of voices, times in brackets and hesitation sounds; white space is single."""
    s = NOTE.sub(" ", pat(rf"[\[(]\s*{TIME}\s*[\])]").sub(" ", text))
    s = pat(r"\s+").sub(" ", SOUND.sub(" ", s))
    return pat(r"\s+(?=[,.;:!?])").sub("", s).strip(" ,")


def _seconds(t: str) -> float:
    out = 0.0
    for part in t.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


# --- cues ----------------------------------------------------------------------------------------------------------

VOICE = regex.compile(r"\s*<v(?:\.[\w.]+)?\s+([^>\n]{1,60})>")
LABEL = regex.compile(r"\s*(?:[-–—]\s+|>>+\s*)?(\[[^\]\n]{1,60}\]|[^:：\n]{1,60}?)\s?[:：](?:\s+|$)")


def cue_label(speaker: str | None, text: str | None) -> tuple[str | None, bool, bool, str]:
    """(label as written or None, whether it is a name only if others of the meeting are alike, whether the cue has
    speech, the speech as written)."""
    text = text or ""
    found, weak, rest = None, False, text
    v = VOICE.match(text)
    if v:
        found, rest = v.group(1), text[v.end() :]
    else:
        m = LABEL.match(text)
        if m and (looks_like_name(m.group(1)) or lower_name(m.group(1))):
            found, rest = m.group(1), text[m.end() :]
            weak = not looks_like_name(found) and not typed_low(found, rest)
    if speaker and speaker.strip() and (looks_like_name(speaker) or lower_name(speaker)):
        if found is None or not looks_like_name(found):
            rest = text
        found, weak = found if found and looks_like_name(found) and fold(found) == fold(speaker) else speaker, False
    return found, weak, has_speech(rest), rest


def label_cues(cues: DataFrame, with_text: bool = False) -> DataFrame:
    """cues(meeting_id, pos, start_time, start_seconds, speaker, text) -> (meeting_id, at, pos, label, weak[, said]), spoken ones only."""

    @F.pandas_udf("label string, weak boolean, speech boolean" + ", said string" * with_text)
    def read(speaker: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [cue_label(s, t) for s, t in zip(speaker, text, strict=True)]
        columns = ["label", "weak", "speech", "said"]
        if with_text:
            return pd.DataFrame([(*r[:3], clean_speech(r[3])) for r in rows], columns=columns)
        return pd.DataFrame([r[:3] for r in rows], columns=columns[:3])

    parts = F.split(F.regexp_replace("start_time", ",", "."), ":")
    parsed = F.aggregate(parts, F.lit(0.0).cast("double"), lambda a, x: a * 60 + x.try_cast("double"))
    return (
        cues.withColumn("_r", read("speaker", "text"))
        .where("_r.speech")
        .select(
            "meeting_id",
            F.coalesce("start_seconds", parsed, F.lit(float("inf"))).alias("at"),
            "pos",
            F.col("_r.label").alias("label"),
            F.col("_r.weak").alias("weak"),
            *([F.col("_r.said").alias("said")] if with_text else []),
        )
    )


def speaker_map(labelled: DataFrame) -> DataFrame:
    """(meeting_id, label, who, name): the distinct spellings per meeting are few, whatever the number of cues."""

    @F.pandas_udf("map<string,struct<who:string,name:string>>")
    def resolve(labels: pd.Series) -> pd.Series:
        out = []
        for x in labels:
            sure = {s["label"] for s in x if not s["weak"]}
            words = words_of(fold(s) for s in sure)
            spellings = sorted(sure | {s["label"] for s in x if s["weak"] and lower_name(s["label"], words)})
            who = same_speakers(spellings)
            shown = display(spellings, who)
            out.append({k: {"who": w, "name": shown[w]} for k, w in who.items()})
        return pd.Series(out)

    return (
        labelled.where("label is not null")
        .groupBy("meeting_id")
        .agg(F.collect_set(F.struct("label", "weak")).alias("labels"))
        .select("meeting_id", F.explode(resolve("labels")).alias("label", "w"))
        .select("meeting_id", "label", "w.who", "w.name")
    )


def fold_turns(rows: DataFrame) -> DataFrame:
    """rows(meeting_id, at, pos, who[, said]) -> turns(meeting_id, first_no, last_no), with said also who, begins and said.

    Rows are spread by ranges of (meeting_id, at, pos), so that a meeting with any share of the rows lies in several
    partitions. Each partition folds its rows into runs; only its first and last run can join a neighbour's, and the
    second where the first names nobody and so takes the speaker before it. Those rows are joined by one small window.
    """
    from pyspark import TaskContext
    from pyspark.sql import Window as W

    texts = "said" in rows.columns

    def runs(batches):
        part, n, cur, open_ = TaskContext.get().partitionId(), 0, None, True
        for b in batches:
            out = []
            for m, p, w, at, t in zip(b["meeting_id"], b["pos"], b["who"], b["at"], b["said"] if texts else b["pos"], strict=True):
                w = w if isinstance(w, str) else None
                if cur and cur[0] == m and (w is None or w == cur[1]):
                    cur[3] = p
                    if texts:
                        cur[5].append(t)
                else:
                    if cur:
                        out.append((part, n, *cur, open_, False))
                        n += 1
                        # a first run that names nobody leaves the one behind it open to the partition before
                        open_ = n == 1 and cur[1] is None and cur[0] == m
                    cur = [m, w, p, p, *([at, [t]] if texts else [])]
            yield frame(out)
        if cur:
            yield frame([(part, n, *cur, open_, True)])

    columns = ["part", "no", "meeting_id", "who", "first_no", "last_no", *(["begins", "said"] if texts else []), "open", "last"]
    schema = "part int, no long, meeting_id string, who string, first_no int, last_no int, " + "begins double, said string, " * texts + "open boolean, last boolean"

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame([(*r[:7], " ".join(r[7]), *r[8:]) for r in out] if texts else out, columns=columns)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, "meeting_id", "at", "pos").sortWithinPartitions("meeting_id", "at", "pos")
    folded = cut(spread.mapInPandas(runs, schema))
    edge = folded.where("open or last")
    w = W.orderBy("part", "no")
    # at most three rows per partition: one task is enough
    spoken = F.last(F.col("who"), True).over(W.partitionBy("meeting_id").orderBy("part", "no").rowsBetween(W.unboundedPreceding, 0))
    e = edge.withColumn("who", spoken).withColumn(
        "new",
        F.when(
            (F.lag("meeting_id").over(w) == F.col("meeting_id"))
            & F.lag("who").over(w).eqNullSafe(F.col("who"))
            & F.col("open"),
            0,
        ).otherwise(1),
    )
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    more = [
        F.min_by("begins", F.struct("part", "no")).alias("begins"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "said"))), lambda x: x.said), " ").alias("said"),
    ]
    ends = e.groupBy("run").agg(
        F.first("meeting_id").alias("meeting_id"),
        F.first("who").alias("who"),
        F.min_by("first_no", F.struct("part", "no")).alias("first_no"),
        F.max_by("last_no", F.struct("part", "no")).alias("last_no"),
        *(more if texts else []),
    )
    keep = ["meeting_id", *(["who"] if texts else []), "first_no", "last_no", *(["begins", "said"] if texts else [])]
    inner = folded.where("not (open or last)").drop("part", "no", "open", "last")
    return inner.unionByName(ends.drop("run")).where("who is not null").select(*keep)


def cue_turns(cues: DataFrame) -> DataFrame:
    labelled = cut(label_cues(cues))  # read for the spellings and for the turns
    who = speaker_map(labelled).drop("name")
    return fold_turns(labelled.join(who, ["meeting_id", "label"], "left").select("meeting_id", "at", "pos", "who"))


def spoken_cue_turns(cues: DataFrame) -> DataFrame:
    """cues -> turns(meeting_id, first_no, last_no, begins, speaker, said)."""
    labelled = cut(label_cues(cues, True))
    who = cut(speaker_map(labelled))
    turns = fold_turns(labelled.join(who.drop("name"), ["meeting_id", "label"], "left").select("meeting_id", "at", "pos", "who", "said"))
    names = who.select("meeting_id", "who", F.col("name").alias("speaker")).distinct()
    return turns.join(names, ["meeting_id", "who"]).select("meeting_id", "first_no", "last_no", "begins", "speaker", "said")


def meeting_turns(meetings: DataFrame) -> DataFrame:
    """meetings(meeting_id, raw_text) -> turns(meeting_id, first_no, last_no) by line numbers."""

    @F.pandas_udf("array<struct<first_no:int,last_no:int>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"first_no": a, "last_no": b} for a, b in text_turns(t)] for t in texts])

    return meetings.select("meeting_id", F.inline(read("raw_text")))


def spoken_meeting_turns(meetings: DataFrame) -> DataFrame:
    """meetings(meeting_id, raw_text) -> turns(meeting_id, first_no, last_no, begins, speaker, said)."""
    keys = ("first_no", "last_no", "speaker", "begins", "said")

    @F.pandas_udf("array<struct<first_no:int,last_no:int,begins:double,speaker:string,said:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(keys, r, strict=True)) for r in read_turns(t)] for t in texts])

    return meetings.select("meeting_id", F.inline(read("raw_text")))


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, meeting_id, first_no, last_no, begins (seconds; infinite where no time is given), speaker, said: the turns themselves."""
    cues = read_once(spark, sf_dir, "subtitle_cue", ["meeting_id", "pos", "start_time", "start_seconds", "speaker", "text"])
    texts = read_once(spark, sf_dir, "meeting", ["meeting_id", "ext", "raw_text"]).where("ext = 'txt' and raw_text is not null")
    return spoken_cue_turns(cues).select(F.lit("subtitle_cue").alias("field_name"), "*").unionByName(
        spoken_meeting_turns(texts).select(F.lit("meeting.raw_text").alias("field_name"), "*")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = read_once(spark, sf_dir, "subtitle_cue", ["meeting_id", "pos", "start_time", "start_seconds", "speaker", "text"])
    texts = read_once(spark, sf_dir, "meeting", ["meeting_id", "ext", "raw_text"]).where("ext = 'txt' and raw_text is not null")
    both = cue_turns(cues).select(F.lit("subtitle_cue").alias("field_name"), "*").unionByName(
        meeting_turns(texts).select(F.lit("meeting.raw_text").alias("field_name"), "*")
    )
    return both.select("field_name", "meeting_id", F.col("first_no").cast("int"), F.col("last_no").cast("int"))
