"""Spellings of one person or organisation, linked across three fields.

Every distinct value is read as a form of two tokens whose order does not matter (given name and family name, or kind of
business and head; case, accents, titles, roles, contact data are removed first). Forms are the records of a similarity
join:

1. Tokens one edit or one swap of neighbours apart are found by a prefix-filtered set-similarity join on 4-grams: such an
   edit changes at most five 4-grams, so the six rarest of both sides share one. Length and place of the shared gram
   differ by one at most and are part of the join key, so that a frequent gram is split into small groups.
2. Two forms are candidates if one token is equal or near and the other is equal, near, a short form or an initial.
3. A candidate is verified by a soft weighted token similarity: the tokens' similarities, averaged with the weights
   ln(1 + N / df), df the number of forms with the token. Rare tokens count more: an initial beside a rare family name
   passes THRESHOLD, one beside a frequent family name or a near token beside a rare different one does not.
4. Verified near forms are linked, and every short form with the best of the full names it fits; connected components of
   these links are the classes. Initials join the one component they fit; if they fit several, they only stand with their
   own spellings.

Nulls, empty and placeholder values, bare given names and values without letters belong to no class. Repeated rows do
not matter, since values are made distinct first; a hot name costs one row per map task. Empty tables give no rows.
Pairs are made last, within classes, as the result demands them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.patterns import pat
from palaver.llm.pii import find, is_nobody, is_org
from palaver.llm.turns import fold
from palaver.sources.checkpoints import cut
from palaver.sources.tables import table

Q = 4
PREFIX = Q + 2
THRESHOLD = 0.72
#: Similarity of a short form in the table, of one by rule, and of an initial, to the full given name.
SHORT_SIM, RULE_SIM, INITIAL_SIM = 0.8, 0.7, 0.55

# Short forms that no rule derives from the full given name.
IRREGULAR = {
    "abigail": "gail", "adelaide": "heidi", "agnes": "nessie", "albert": "bert bertie", "alexander": "sandy sasha xander lex", "alexandra": "sandra sasha", "amelia": "millie",
    "anastasia": "nastya stasia anya", "andrew": "drew", "anneliese": "liesel lies", "anthony": "tony", "antonio": "tonio toni", "augustin": "gus", "barbara": "babs", "beatrice": "trixie", "benedict": "dixie",
    "bogdan": "dan", "catherine": "kate katie kathy kitty kit", "charles": "chuck", "charlotte": "lottie", "christina": "tina", "christopher": "kit topher", "cornelius": "neil nils con",
    "daniel": "danny", "dmitri": "dima mitya", "dorothy": "dot dolly", "edward": "ted teddy ned", "eleanor": "nell nora ellie", "elizabeth": "beth betty liz lizzie liza lisa bess",
    "ernest": "ernie", "eugene": "gene", "evgeny": "zhenya", "ferdinand": "nando", "florence": "flo", "francis": "frank", "francisco": "paco pancho cisco frank", "frances": "fran fanny",
    "friedrich": "fritz", "gabriela": "gaby", "georgina": "gina", "gerald": "jerry", "giovanni": "gianni vanni nino", "giuseppe": "beppe peppe", "guadalupe": "lupe lupita", "harold": "hal harry",
    "harriet": "hattie", "helen": "nell", "henrietta": "etta hattie hettie", "henry": "harry hank hal", "ignacio": "nacho", "isabella": "bella", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie",
    "jacqueline": "jackie", "joachim": "jochen achim", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "josef": "sepp", "josephine": "fina", "katherine": "kate katie kathy kitty kit kat",
    "lawrence": "larry", "leopold": "poldi", "luis": "lucho", "margaret": "maggie meg peggy greta marge rita daisy", "maria": "masha mia", "martha": "patty", "mary": "polly molly", "matilda": "tilda tilly",
    "michael": "mick micky mike mikey", "mikhail": "misha", "natalia": "natasha talia", "nathaniel": "nate nat", "nicholas": "nick klaus", "olga": "olya", "oliver": "noll", "patricia": "trish patsy", "pavel": "pasha",
    "peter": "pete", "philippa": "pip pippa", "rafael": "rafa", "rebecca": "becky becca", "richard": "dick rick ricky", "robert": "bob bobby bert", "roberto": "beto", "ronald": "ronnie", "rosalind": "roz",
    "sarah": "sally sadie", "sebastian": "basti", "sergei": "seryozha", "sophia": "sonya", "stephen": "steve", "susan": "suzy", "tatiana": "tanya", "teresa": "tess", "thaddeus": "tad", "theodore": "ted teddy",
    "thomas": "tom tommy", "tomasz": "tomek", "victoria": "tori vicky", "vladimir": "vova", "wilhelmina": "mina minnie billie willa", "william": "bill billy liam", "zachary": "zack zak",
}

# Abbreviated kinds of business and legal forms.
BUSINESS = {
    "frt": "freight", "fds": "foods", "res": "research", "ins": "insurance", "mfg": "manufacturing", "log": "logistics", "tech": "technologies", "trdg": "trading",
    "trd": "trading", "eng": "engineering", "labs": "laboratories", "lab": "laboratories", "bros": "brothers", "intl": "international", "int": "international", "cons": "consulting",
    "cnsltg": "consulting", "consult": "consulting", "hldgs": "holdings", "hldg": "holdings", "svcs": "services", "sys": "systems", "ptnrs": "partners", "assoc": "associates", "technology": "technologies", "food": "foods",
}
KINDS = set(BUSINESS.values()) | {"bank", "institute", "foundation", "university", "group", "solutions"}
LEGAL = set("ltd limited inc incorporated corp corporation co company gmbh ag sa plc llc llp kg bv nv oy ab spa srl".split())


def parse(value: str | None) -> tuple[str, str, str, bool] | None:
    """(kind, token, token, glued): 'p' with given name (or one letter) and family as typed, 'o' with business and head."""
    if value is None or is_nobody(value):
        return None
    if is_org(value):
        s = fold(pat(r"[.,&]").sub(lambda m: "" if m.group() == "." else " ", value))
        words = [w for w in pat(r"[\p{L}\p{N}]+").findall(s) if w != "the"]
        words = [BUSINESS.get(w, w) for w in words if w not in LEGAL]
        head = [w for w in words if w not in KINDS]
        return ("o", " ".join(w for w in words if w in KINDS), " ".join(head), False) if head else None
    spot = next(((a, b) for a, b, k in find(value, True) if k == "name"), None)
    if spot is None:
        return None
    f = fold(value[spot[0] : spot[1]])
    words = [w for w in pat(r"[\s._]+").split(f.replace("'", "")) if pat(r"\p{L}").search(w)]
    if len(words) > 2:
        words = [w for w in (words[0], *[x for x in words[1:-1] if len(x) > 1], words[-1])]
    if len(words) == 1:
        # a login such as "avane": letter and family
        w = words[0]
        return ("p", w[0], w[1:], True) if len(w) >= 6 and value.strip() == value.strip().lower() else None
    return ("p", words[0], " ".join(words[1:]), False)


def stem(short: str) -> str:
    """What a short form has in common with the full name: no diminutive ending, no doubled last consonant."""
    s = pat(r"(?:chen|lein|ita|ito|ie|ey|[iyeoa])$").sub("", short) if len(short) > 3 else short
    return s[:-1] if len(s) > 2 and s[-1] == s[-2] else s


def parsed_values(values: DataFrame) -> DataFrame:
    """values(value, ...) -> the same plus kind, t1 <= t2, glued (rows of nobody are left out)."""

    @F.pandas_udf("kind string, t1 string, t2 string, glued boolean")
    def read(v: pd.Series) -> pd.DataFrame:
        out = []
        for x in v:
            p = parse(x)
            out.append((p[0], *sorted(p[1:3]), p[3]) if p else (None, None, None, None))
        return pd.DataFrame(out, columns=["kind", "t1", "t2", "glued"])

    return values.withColumn("_p", read("value")).where("_p.kind is not null").select(*values.columns, "_p.kind", "_p.t1", "_p.t2", "_p.glued")


def near_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(kind, token, df), distinct -> (kind, token, near, sim) for tokens one edit or swap apart, near in more forms (ties: smaller).

    So a frequent token has few near ones, whatever the number of its misspellings.
    """
    padded = F.concat(F.lit("##"), F.col("token"), F.lit("$$"))
    grams = tokens.where(F.length("token") >= 4).select(
        "kind", "token", F.col("df").alias("k"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.substring(padded, i, F.lit(Q)))).alias("at", "gram")
    )
    rarity = grams.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    prefix = cut(
        grams.join(rarity, ["kind", "gram"])
        .groupBy("kind", "token", "k")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram", "at"))), 1, PREFIX).alias("g"))  # as many as the token has letters
        .select("kind", "token", "k", F.length("token").alias("n"), F.explode("g").alias("g"))
        .select("kind", "token", "k", "n", "g.gram", "g.at")
    )
    around = lambda c: F.sequence(F.col(c) - 1, F.col(c) + 1)
    b = prefix.select("kind", F.col("token").alias("near"), F.col("k").alias("kb"), "gram", F.explode(around("n")).alias("n"), "at")
    b = b.select("kind", "near", "kb", "gram", "n", F.explode(around("at")).alias("at"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    lev = F.levenshtein("token", "near", 2)
    swap = (lev == 2) & (F.length("token") == F.length("near")) & (letters("token") == letters("near"))
    return (
        prefix.join(b, ["kind", "gram", "n", "at"])
        .where("kb > k or (kb = k and near < token)")
        .where((lev == 1) | swap)
        .select("kind", "token", "near", (1 - 1 / F.greatest(F.length("token"), F.length("near"))).alias("sim"))
        .distinct()
    )


def _halves(forms: DataFrame) -> DataFrame:
    """Both ways of reading a form: anchor token and the other one."""
    two = F.array(F.struct(F.col("t1").alias("anchor"), F.col("t2").alias("other")), F.struct(F.col("t2").alias("anchor"), F.col("t1").alias("other")))
    return forms.select("id", "kind", "n", F.explode(two).alias("h")).select("id", "kind", "n", "h.anchor", "h.other")


def _table() -> Column:
    return F.create_map(*[x for s, fs in SHORT_OF.items() for x in (F.lit(s), F.array(*map(F.lit, fs)))])


SHORT_OF: dict[str, list[str]] = {}
for _full, _shorts in IRREGULAR.items():
    for _s in _shorts.split():
        SHORT_OF.setdefault(_s, []).append(_full)


def candidates(forms: DataFrame, near: DataFrame) -> DataFrame:
    """forms(id, kind, t1, t2, n), near(kind, token, near, sim) -> (a, b, how, ...): pairs whose tokens fit, not yet verified.

    how: edit (a has the rarer spelling), short or initial (b full). Every key of a side holds one form on the asking
    side, so no group is squared.
    """
    h = _halves(forms)

    @F.pandas_udf("string")
    def stems(t: pd.Series) -> pd.Series:
        return t.map(stem)

    lasts = h.withColumn("at", F.col("anchor")).withColumn("sa", F.lit(1.0)).unionByName(
        h.join(near.select("kind", F.col("token").alias("anchor"), F.col("near").alias("at"), F.col("sim").alias("sa")), ["kind", "anchor"])
    )
    one = F.length("other") == 1
    ask = lambda key, how, s: F.struct(F.lit(how).alias("how"), key.alias("key"), F.lit(float(s)).alias("so"))
    asks = F.when(one, F.array(ask(F.concat(F.lit("i"), "other"), "initial", INITIAL_SIM), ask(F.concat(F.lit("="), "other"), "edit", 1))).otherwise(
        F.concat(
            F.array(ask(F.concat(F.lit("="), "other"), "edit", 1)),
            F.when(F.col("kind") == "p", F.array(ask(F.concat(F.lit("<"), stems("other")), "short", RULE_SIM))).otherwise(F.array()),
            F.transform(F.coalesce(F.try_element_at(_table(), F.col("other")), F.array()), lambda f: ask(F.concat(F.lit("="), f), "short", SHORT_SIM)),
        )
    )
    a = lasts.select("kind", F.col("id").alias("a"), "anchor", "other", "at", "sa", F.inline(asks))
    offers = F.when(one, F.array(F.concat(F.lit("="), "other"))).otherwise(
        F.when(
            F.col("kind") == "p",
            F.concat(
                F.array(F.concat(F.lit("="), "other"), F.concat(F.lit("i"), F.substring("other", 1, 1))),
                F.transform(F.sequence(F.lit(2), F.length("other") - 1), lambda k: F.concat(F.lit("<"), F.substring(F.col("other"), 1, k))),
            ),
        ).otherwise(F.array(F.concat(F.lit("="), "other")))
    )
    b = h.where("length(anchor) > 1").select("kind", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("anchor").alias("at"), F.col("other").alias("to"), F.explode(offers).alias("key"))
    fits = F.when(F.col("how") == "edit", F.col("sa") < 1).when(F.col("how") == "short", F.length("to") > F.length("other")).otherwise(True)
    return a.join(b, ["kind", "at", "key"]).where((F.col("a") != F.col("b")) & fits).select("kind", "a", "b", "nb", "how", "at", "to", "sa", "so")


def verified(cand: DataFrame, forms: DataFrame) -> DataFrame:
    """Candidates with their score, those below THRESHOLD rejected."""
    df = _halves(forms).groupBy("kind", F.col("anchor").alias("token")).agg(F.count(F.when(F.length("other") != 1, 1)).alias("df"))
    n = float(forms.count())
    weight = lambda c: F.log1p(F.lit(n) / F.greatest(F.col(c), F.lit(1)))
    w = (
        cand.join(df.select("kind", F.col("token").alias("at"), weight("df").alias("wa")), ["kind", "at"])
        .join(df.select("kind", F.col("token").alias("to"), weight("df").alias("wo")), ["kind", "to"])
    )
    return w.withColumn("score", (F.col("wa") * F.col("sa") + F.col("wo") * F.col("so")) / (F.col("wa") + F.col("wo"))).where(F.col("score") >= THRESHOLD)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (id, root): the smallest id reachable, for every id of an edge. Label propagation until nothing changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        step = (
            both.join(label.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("root").alias("other"))
            .join(label, "id")
            .select("id", F.least("root", "other").alias("root"), (F.col("other") < F.col("root")).alias("moved"))
        )
        step = cut(step)
        if step.where("moved").isEmpty():
            return step.select("id", "root")
        label = step.select("id", "root")


def classes(values: DataFrame) -> DataFrame:
    """values(value[, n]), distinct, n how often -> value, class (the first of its forms)."""
    if "n" not in values.columns:
        values = values.withColumn("n", F.lit(1))
    v = cut(parsed_values(values.select("value", "n")).withColumn("id", F.concat_ws("\u0001", "kind", "t1", "t2")))
    forms = cut(v.groupBy("id", "kind", "t1", "t2").agg(F.sum("n").alias("n"), F.min("glued").alias("glued")))
    tokens = _halves(forms).where("length(anchor) > 1").groupBy("kind", F.col("anchor").alias("token")).agg(F.count("*").alias("df"))
    ok = cut(verified(candidates(forms, near_tokens(tokens)), forms))
    best = Window.partitionBy("a").orderBy(F.desc("score"), F.desc(F.length("to")), F.desc("nb"), "b")
    short = ok.where("how = 'short'").withColumn("r", F.row_number().over(best)).where("r = 1")
    links = ok.where("how = 'edit'").select("a", "b").unionByName(short.select("a", "b"))
    root = components(links)
    named = forms.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"), (F.col("root").isNull() & F.col("glued")).alias("alone"))
    # initials: the one component they fit
    fit = (
        ok.where("how = 'initial'").select(F.col("a"), F.col("b").alias("id"))
        .join(root, "id", "left")
        .groupBy("a")
        .agg(F.min(F.coalesce("root", "id")).alias("lo"), F.max(F.coalesce("root", "id")).alias("hi"))
        .where("lo = hi")
        .select(F.col("a").alias("id"), F.col("lo").alias("of"))
    )
    of = named.join(fit, "id", "left").where("not alone or of is not null").select("id", F.coalesce("of", "root").alias("class"))
    return v.select("value", "id").join(of, "id").select("value", "class")


def all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, n: every spelling of the three fields and in how many meetings it stands."""
    cols = [("person", "name"), ("action_item", "assignee"), ("speaker_stats", "speaker_id")]
    out = None
    for t, c in cols:
        one = table(spark, sf_dir, t).select(F.col(c).alias("value"), "meeting_id").where(F.col("value").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.distinct().groupBy("value").agg(F.count("*").alias("n"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, class_id: the identity of every value that means somebody."""
    return classes(all_values(spark, sf_dir)).select("value", F.col("class").alias("class_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(classes(all_values(spark, sf_dir)))
    a, b = c.select("class", F.col("value").alias("name_a")), c.select("class", F.col("value").alias("name_b"))
    return a.join(b, "class").where("name_a < name_b").select("name_a", "name_b")
