"""Languages of texts and of the stretches of mixed ones, by a string kernel.

Sentences are compared by which n-grams of 1 to 5 characters they contain (presence, not counts; a blended spectrum) and
by the scripts of their letters, each script that holds a fifth of them counting as SCRIPT_MARKS n-grams,
k(a, b) = |A & B| / sqrt(|A| |B|). Nystroem landmarks turn the kernel into a finite feature map, one-versus-rest
kernel ridge regression is solved in it, and whole batches are scored by matrix products: the map and the ridge weights
are multiplied once into one weight per (n-gram, language), so a batch is one sparse presence matrix times that table.
N-grams are hashed to HASH_BITS bits, all of a batch at once.

The classifier is fitted on at most SEED sentences written below plus SAMPLE_PER_LABEL labelled rows per language (both
documented bounds). Labels are noisy, therefore fitted repeatedly: texts whose sentences the last fit assigns mostly to
another language are left out, as are sentences it places elsewhere with a wide margin. Every row is scored.

Null or blank texts get no stretches. A text of names and digits only has language None and confidence 0. Nulls in the
label count as "missing". The languages of a text's sentences are the best path through their scores, where each change
of language costs SWITCH, so that a sentence of names and figures follows its neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.sentences import spans
from palaver.sources.tables import read_once

CODES = ["en", "es", "fr", "de", "it", "pt", "ru", "ja", "ko", "zh", "ar", "hi"]
SAMPLE_PER_LABEL = 120
SENTENCES_PER_ROW = 8
LANDMARKS = 480
RIDGE = 0.1
SWITCH = 0.3
GRAMS = (1, 2, 3, 4, 5)
SCRIPT_MARKS = 8
HASH_BITS = 40

#: Own sentences, a few per language, so that the model exists where a table has few labelled rows.
SEED = {
    "en": "Where did they put the keys for the small room?|She has been waiting for more than an hour.|I do not think that this will work, but we can try it.|There was nothing left on the table after lunch.|Would you like another cup of tea with that?|The children were playing in the garden when it started to rain.|You should have told him about the change.|This is what we know so far about the other plan.|It was better than the last one, and cheaper too.|Please wait until he has finished with his report.",
    "es": "¿Dónde han puesto las llaves de la habitación pequeña?|Ella lleva más de una hora esperando.|No creo que esto funcione, pero podemos probarlo.|No quedaba nada en la mesa después de comer.|¿Quieres otra taza de té con eso?|Los niños jugaban en el jardín cuando empezó a llover.|Deberías haberle dicho lo del cambio.|Esto es lo que sabemos hasta ahora del otro plan.|Era mejor que el último y también más barato.|Por favor, espera hasta que haya terminado su informe.",
    "fr": "Où ont-ils mis les clés de la petite chambre ?|Elle attend depuis plus d'une heure.|Je ne crois pas que ça marche, mais on peut essayer.|Il ne restait rien sur la table après le repas.|Voulez-vous une autre tasse de thé avec cela ?|Les enfants jouaient dans le jardin quand il a commencé à pleuvoir.|Tu aurais dû lui parler du changement.|Voilà ce que nous savons pour l'instant de l'autre plan.|C'était mieux que le dernier et moins cher aussi.|Attendez s'il vous plaît qu'il ait fini son rapport.",
    "de": "Wo haben sie die Schlüssel für das kleine Zimmer hingelegt?|Sie wartet schon seit über einer Stunde.|Ich glaube nicht, dass das klappt, aber wir können es versuchen.|Nach dem Essen war nichts mehr auf dem Tisch.|Möchten Sie noch eine Tasse Tee dazu?|Die Kinder spielten im Garten, als es zu regnen begann.|Du hättest ihm von der Änderung erzählen sollen.|Das wissen wir bisher über den anderen Plan.|Es war besser als das letzte und auch billiger.|Bitte warten Sie, bis er mit seinem Bericht fertig ist.",
    "it": "Dove hanno messo le chiavi della stanza piccola?|Lei sta aspettando da più di un'ora.|Non credo che questo funzioni, ma possiamo provare.|Dopo pranzo non era rimasto niente sul tavolo.|Vuole un'altra tazza di tè con questo?|I bambini giocavano nel giardino quando ha cominciato a piovere.|Avresti dovuto dirgli del cambiamento.|Questo è quello che sappiamo finora dell'altro piano.|Era meglio dell'ultimo e anche meno caro.|Per favore aspetti finché non ha finito la sua relazione.",
    "pt": "Onde puseram as chaves do quarto pequeno?|Ela está à espera há mais de uma hora.|Não creio que isto funcione, mas podemos tentar.|Não sobrou nada na mesa depois do almoço.|Quer mais uma chávena de chá com isso?|As crianças brincavam no jardim quando começou a chover.|Devias ter-lhe falado da alteração.|Isto é o que sabemos até agora sobre o outro plano.|Era melhor do que o último e também mais barato.|Por favor espere até que ele acabe o relatório dele.",
    "ru": "Куда они положили ключи от маленькой комнаты?|Она ждёт уже больше часа.|Не думаю, что это сработает, но можно попробовать.|После обеда на столе ничего не осталось.|Хотите ещё чашку чая?|Дети играли в саду, когда начался дождь.|Тебе надо было рассказать ему об этом.|Вот что мы пока знаем о другом плане.",
    "ja": "小さい部屋の鍵はどこに置きましたか。|彼女はもう一時間以上待っています。|うまくいくとは思いませんが、試してみましょう。|昼食のあと、テーブルには何も残っていませんでした。|お茶をもう一杯いかがですか。|雨が降り始めたとき、子どもたちは庭で遊んでいました。",
    "ko": "작은 방 열쇠를 어디에 두었습니까?|그녀는 한 시간 넘게 기다리고 있어요.|잘될 것 같지는 않지만 해 볼 수는 있습니다.|점심을 먹고 나니 식탁에 아무것도 없었어요.|차 한 잔 더 드시겠어요?|비가 오기 시작했을 때 아이들은 마당에서 놀고 있었다.",
    "zh": "他们把小房间的钥匙放在哪里了？|她已经等了一个多小时。|我不认为这样行得通，不过可以试一试。|午饭以后桌子上什么都没剩下。|您要不要再来一杯茶？|开始下雨的时候孩子们正在花园里玩。",
    "ar": "أين وضعوا مفاتيح الغرفة الصغيرة؟|هي تنتظر منذ أكثر من ساعة.|لا أظن أن هذا سينجح ولكن يمكننا أن نحاول.|لم يبق شيء على الطاولة بعد الغداء.|هل تريد فنجانا آخر من الشاي؟|كان الأطفال يلعبون في الحديقة عندما بدأ المطر.",
    "hi": "उन्होंने छोटे कमरे की चाबियाँ कहाँ रखीं?|वह एक घंटे से ज़्यादा समय से इंतज़ार कर रही है।|मुझे नहीं लगता कि यह चलेगा, लेकिन हम कोशिश कर सकते हैं।|खाने के बाद मेज़ पर कुछ नहीं बचा।|क्या आप एक और प्याली चाय लेंगे?|जब बारिश शुरू हुई तब बच्चे बाग़ में खेल रहे थे।",
}

NAMES = regex.compile(r"(?<!^)(?<![.!?]\s)\b\p{Lu}[\p{Ll}\p{M}]+(?:\s\p{Lu}[\p{Ll}\p{M}]+)+|[\p{Latin}\d@._/+%:\-]*[@/\d][\p{Latin}\d@._/+%:\-]*")
LATIN = regex.compile(r"\p{Latin}")
OTHER = regex.compile(r"[\p{Cyrillic}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Han}\p{Arabic}\p{Devanagari}]")
NO_LETTER = regex.compile(r"[^\p{L}\p{M}'’]+")

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "cyrillic": [(0x400, 0x52F)], "kana": [(0x3040, 0x30FF)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF)], "arabic": [(0x600, 0x77F)], "devanagari": [(0x900, 0x97F)],
}
U = np.uint64


def normal(text: str) -> str:
    """Lower case without mail addresses, numbers and names of several words; letters of one's own script stay."""
    t = NAMES.sub(" ", text)
    if OTHER.search(t):  # Latin words in a text of another script are names or borrowed
        t = LATIN.sub("", t)
    t = NO_LETTER.sub(" ", t).strip().lower()
    return f" {t} " if t else ""


class Grams:
    """The different n-grams of each of some texts as hashes: those of text i are ids[at[i]:at[i + 1]], sorted."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.ids, self.at = ids, at
        self.size = np.diff(at)

    @staticmethod
    def of(texts: list[str]) -> Grams:
        low = [normal(t) for t in texts]
        rows = np.repeat(np.arange(len(low)), [len(t) for t in low])
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mixed, parts, roll = code.astype(U) * U(0x9E3779B97F4A7C15), [], np.zeros(0, U)
        for n in range(1, max(GRAMS) + 1):
            roll = mixed if n == 1 else roll[:-1] * U(0xD1342543DE82EF95) + mixed[n - 1 :]
            if n in GRAMS:
                inside = rows[: len(roll)] == rows[n - 1 :]
                parts.append((rows[: len(roll)][inside], roll[inside] + U(n)))
        letters = np.maximum(np.bincount(rows[code != 32], minlength=len(low)), 1)
        for k, blocks in enumerate(SCRIPTS.values()):
            hit = np.zeros(len(code), bool)
            for lo, hi in blocks:
                hit |= (code >= lo) & (code <= hi)
            own = np.flatnonzero(np.bincount(rows[hit], minlength=len(low)) * 5 >= letters)
            parts += [(own, np.full(len(own), U(0xA5A5A5A5 + 977 * (k * SCRIPT_MARKS + j)))) for j in range(SCRIPT_MARKS)]
        row = np.concatenate([p[0] for p in parts]).astype(U)
        h = np.concatenate([p[1] for p in parts])
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(32))) >> U(64 - HASH_BITS)
        both = np.sort((row << U(HASH_BITS)) | h)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        at = np.searchsorted(both, np.arange(len(low) + 1, dtype=U) << U(HASH_BITS))
        return Grams(both & U((1 << HASH_BITS) - 1), at)

    def some(self, pick: np.ndarray) -> Grams:
        n = self.size[pick]
        at = np.concatenate([[0], np.cumsum(n)])
        return Grams(self.ids[np.arange(at[-1]) - np.repeat(at[:-1] - self.at[pick], n)], at)

    def times(self, index: np.ndarray, table: np.ndarray) -> np.ndarray:
        """(presence matrix / sqrt(size)) @ table, table having one row per hash of the sorted index."""
        out = np.zeros((len(self.size), table.shape[1]))
        step = max(1, (1 << 22) // table.shape[1])  # rows of the table gathered at once
        begin = 0
        while begin < len(self.size):
            end = max(begin + 1, int(np.searchsorted(self.at, self.at[begin] + step, "right")) - 1)
            ids = self.ids[self.at[begin] : self.at[end]]
            at = np.minimum(np.searchsorted(index, ids), len(index) - 1)
            known = index[at] == ids
            row = np.repeat(np.arange(end - begin), self.size[begin:end])[known]
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[begin + row[first]] = np.add.reduceat(table[at[known]], first, axis=0)
            begin = end
        return out / np.sqrt(np.maximum(self.size, 1))[:, None]


class Model:
    """One weight per (n-gram, language); picklable and small (the n-grams of the landmarks)."""

    def __init__(self, index: np.ndarray, table: np.ndarray):
        self.index, self.table = index, table

    def scores(self, texts: list[str] | Grams) -> np.ndarray:
        return (texts if isinstance(texts, Grams) else Grams.of(texts)).times(self.index, self.table)


def fit(texts: list[str] | Grams, labels: list[str]) -> Model:
    """Nystroem map on evenly spread landmarks, then ridge regression against +1 / -1 per language."""
    g = texts if isinstance(texts, Grams) else Grams.of(texts)
    keep = np.flatnonzero(g.size > 0)
    g, labels = g.some(keep), [labels[i] for i in keep]
    by = {c: [i for i, x in enumerate(labels) if x == c] for c in CODES}
    per = max(1, LANDMARKS // len(CODES))
    marks = np.asarray([i for c in CODES for i in by[c][:: max(1, len(by[c]) // per)][:per]])
    land = g.some(marks)
    index = np.sort(land.ids)
    index = index[np.concatenate([[True], index[1:] != index[:-1]])]
    table = np.zeros((len(index), len(marks)), np.float32)
    table[np.searchsorted(index, land.ids), np.repeat(np.arange(len(marks)), land.size)] = np.repeat(1 / np.sqrt(land.size), land.size)
    val, vec = np.linalg.eigh(land.times(index, table))
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])  # landmarks -> features
    phi = g.times(index, table) @ root
    y = np.full((len(labels), len(CODES)), -1.0)
    y[np.arange(len(labels)), [CODES.index(x) for x in labels]] = 1.0
    weight = np.asarray([1.0 / max(1, len(by[x])) for x in labels])
    weight /= weight.mean()
    a = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    alpha = np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return Model(index, table.astype(np.float64) @ (root @ alpha))


def seed_rows() -> tuple[list[str], list[str]]:
    rows = [(s, c) for c, joined in SEED.items() for s in joined.split("|")]
    return [r[0] for r in rows], [r[1] for r in rows]


def train(labelled: list[tuple[list[str], str]]) -> Model:
    """labelled: (sentences, code as given), wrong for a part. Texts that the last fit gives mostly to another language are
    left out of the next, as are sentences it places elsewhere with a wide margin."""
    texts, labels = seed_rows()
    n0, doc = len(texts), []
    for d, (sents, c) in enumerate(labelled):
        texts += sents
        labels += [c] * len(sents)
        doc += [d] * len(sents)
    grams = Grams.of(texts)
    model = fit(grams.some(np.arange(n0)), labels[:n0])
    for _ in range(3 if doc else 0):
        s = model.scores(grams)
        given = np.asarray([CODES.index(x) for x in labels])
        whole = np.zeros((len(labelled), len(CODES)))
        np.add.at(whole, np.asarray(doc), s[n0:])
        agree = whole.argmax(1)[np.asarray(doc)] == given[n0:]
        near = s[n0:].max(1) - s[np.arange(n0, len(texts)), given[n0:]] < 0.4
        ok = np.concatenate([np.arange(n0), n0 + np.flatnonzero(agree & near)])
        model = fit(grams.some(ok), [labels[i] for i in ok])
    return model


def some_sentences(text: str | None) -> list[str]:
    """At most SENTENCES_PER_ROW sentences, evenly spread over the whole text."""
    cut = spans(text)
    return [text[a - 1 : b] for a, b in cut[:: max(1, len(cut) // SENTENCES_PER_ROW)][:SENTENCES_PER_ROW]]


def sample(df: DataFrame) -> list[tuple[list[str], str]]:
    """Sentences of at most SAMPLE_PER_LABEL rows of each exact code, chosen by the hash of the key (the same on every run)."""

    @F.pandas_udf("array<string>")
    def pick(texts: pd.Series) -> pd.Series:
        return pd.Series([some_sentences(t) for t in texts])

    r = df.where(F.col("language").isin(CODES) & F.col("text").isNotNull()).select(
        "language", pick("text").alias("sents"), F.xxhash64("transcription_id").alias("h")
    )
    # one row for each of SAMPLE_PER_LABEL residues of the hash: a bounded aggregate, combined before the shuffle
    slots = r.withColumn("slot", F.pmod("h", F.lit(SAMPLE_PER_LABEL)))
    rows = slots.groupBy("language", "slot").agg(F.min_by("sents", "h").alias("sents")).collect()
    return sorted((x.sents, x.language) for x in rows)


def stretches(text: str | None, model: Model) -> list[tuple[int, int, str | None, float]]:
    """(first, last, language, confidence) of the longest runs of whole sentences of one language."""
    return stretches_batch([text], model)[0]


def stretches_batch(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str | None, float]]]:
    cuts = [spans(t) for t in texts]
    flat = [t[a - 1 : b] for t, c in zip(texts, cuts, strict=True) for a, b in c]
    scores = model.scores(flat) if flat else np.zeros((0, len(CODES)))
    out, at = [], 0
    for c in cuts:
        out.append(_runs(c, scores[at : at + len(c)]))
        at += len(c)
    return out


def _runs(cut: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, str | None, float]]:
    if not cut:
        return []
    # best path: score of each sentence in its language, minus SWITCH per change
    n = len(CODES)
    cost = SWITCH * (1 - np.eye(n))
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[:, None] - cost
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    lang: list[int | None] = list(reversed(path))
    if not np.any(scores):
        lang = [None] * len(cut)
    runs: list[list] = []
    for (a, b), c, row in zip(cut, lang, scores, strict=True):
        p = np.exp(4 * (row - row.max()))
        conf = float(p[c] / p.sum()) if c is not None else 0.0
        if runs and runs[-1][2] == c:
            runs[-1][1] = b
            runs[-1][3].append((conf, b - a + 1))
        else:
            runs.append([a, b, c, [(conf, b - a + 1)]])
    return [
        (a, b, None if c is None else CODES[c], round(sum(x * n for x, n in cs) / sum(n for _, n in cs), 4)) for a, b, c, cs in runs
    ]


def language_stretches(df: DataFrame, model: Model) -> DataFrame:
    """df(transcription_id, text, language) -> one row per stretch with lang, confidence and the label's state."""

    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<begin_at:int,end_at:int,lang:string,confidence:double>>")
    def classify(texts: pd.Series) -> pd.Series:
        keys = ("begin_at", "end_at", "lang", "confidence")
        return pd.Series([[dict(zip(keys, r, strict=True)) for r in x] for x in stretches_batch(list(texts), shared.value)])

    return (
        df.withColumn("_s", classify("text"))
        .withColumn("n_langs", F.size(F.array_distinct(F.transform("_s", lambda x: x.lang))))
        .select("transcription_id", "language", "n_langs", F.inline("_s"))
    )


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_once(spark, sf_dir, "transcription", ["transcription_id", "text", "language"])
    return language_stretches(df, train(sample(df)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # more than one language, or a label that is not exactly the code of the only one
    found = _stretches(spark, sf_dir).where((F.col("n_langs") > 1) | ~F.col("language").eqNullSafe(F.col("lang")))
    return found.select("transcription_id", "begin_at", "lang")


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcription_id, language (the label), n_langs, begin_at, end_at, lang, confidence: every stretch of every text."""
    return _stretches(spark, sf_dir)
