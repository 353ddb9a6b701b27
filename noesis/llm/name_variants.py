"""Variant spellings of names typed by people, linked to the person or organisation they mean.

A name is read into a canonical form: case, accents, underscores and hyphens levelled; titles, middle initials, articles
and legal forms dropped; "Family, Given" turned round; nicknames and mistyped known given names led back to the given
name; words for kinds of organisation led back from their abbreviations. Names of the same canonical form are one class,
found by a hash aggregate, so a spelling that fills a third of the table costs one row and makes no pairs.

The lists of common nicknames and kind words are only a start. What else is a kind word (of organisations, or of things that
are neither persons nor organisations) is learned from the collection: a word in many names is what most of these names are
declared to be, so a wrong declared type of a name does not matter. Two spellings of a kind ("laboratories" and "labs") are
one where many organisations of the same own words occur with both, and letters behind an organisation's own words stand for
the kind words that begin with them.

Classes are blocked by phonetic codes of their sorted tokens: the code of the distinctive token, and all codes with one
sound left out (two codes one edit apart share one of these), each with the other token's sound. A block of more than
``ROWS_PER_BLOCK`` classes is dealt over tasks. Pairs under a block are compared with Jaro-Winkler on the distinctive token
and on the given name, each different pair of tokens of a batch once; accepted pairs are clustered by connected components.
Names with an initial or a cut given name ("K. Petrova", "Que. Marsh") join a cluster only if it is the only one in their
block with that family name and a fitting given name; else they stand alone, as merging would join persons who share only a
family name.

Result: all pairs inside a cluster of any size, smaller id first. Only of more than ``COPY_LIMIT`` rows with one and the same
written name the smallest id stands for the others, which come as their pairs with it. Defined cases: null, empty and wordless names link to nothing; very long
names are read whole; repeated rows of one id are one; an empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis.operators.components import connected_components
from noesis.session import cut, slots

COPY_LIMIT = 64
ROWS_PER_PART = 64
ROWS_PER_BLOCK = 1_024
WORD_SHARE = 5e-4
SAME_KIND = 3
FAMILY_LEAST = 0.90
GIVEN_LEAST = 0.86
KNOWN_LEAST = 0.92

#: Given names and the short forms people use for them, of several languages (fixed values).
NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe bram", "adelaide": "addie heidi", "agnes": "aggie nessa", "albert": "al bert bertie", "alejandro": "ale jandro", "alexander": "alex sasha xander alec", "alfred": "alf alfie", "alice": "ally", "amanda": "mandy",
    "anastasia": "nastya stacy ana", "andrew": "andy drew", "angela": "angie", "anna": "annie anya anja", "anthony": "tony", "antonio": "toni tonio", "arthur": "art artie", "augustus": "gus august", "barbara": "barb babs", "beatrice": "bea trixie", "benjamin": "ben benny benji",
    "bernard": "bernie", "bertha": "bertie", "bridget": "bridie biddy", "caroline": "carrie caro", "catherine": "cathy cat", "charles": "charlie chuck", "charlotte": "lottie charly", "christina": "tina chris chrissy", "christopher": "kit topher", "clarence": "clare", "clement": "clem",
    "concepcion": "concha conchita", "cornelius": "neil connie", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "delores": "lola", "desmond": "des", "dietrich": "dieter", "dmitri": "dima mitya", "dolores": "lolita", "donald": "don donny",
    "dorothy": "dot dottie", "douglas": "doug", "eduardo": "edu lalo", "edward": "ed ned eddie", "ekaterina": "katya katyusha", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lizzie", "emily": "em millie", "emmanuel": "manny manu", "ernest": "ernie", "eugene": "gene",
    "evgeny": "zhenechka", "ferdinand": "ferdi", "fernando": "nando", "florence": "flo flossie", "frances": "fran fanny", "francesco": "cecco franco", "francisco": "paco pancho", "franklin": "frankie", "frederick": "fred freddy fritz", "gabriel": "gabe", "gabriela": "gabi gaby", "geoffrey": "geoff jeff",
    "george": "georgie", "gerald": "gerry", "gertrude": "trudy gertie", "gilbert": "gil", "giovanni": "gianni vanni", "giuseppe": "beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "gustav": "gusti", "hannelore": "hanne lore", "harold": "harry hal", "harriet": "hattie", "heinrich": "heinz heini",
    "helen": "nellie lena", "henry": "hank", "herbert": "herb", "howard": "howie", "ignacio": "nacho iggy", "ingrid": "inga", "irina": "ira irisha", "isabella": "izzy bella", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jeremiah": "jerry", "jessica": "jess jessie",
    "joachim": "jochen achim", "johannes": "hannes hans", "jonathan": "jon johnny", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken kenny", "konstantin": "kostya kostik", "lawrence": "larry", "leonard": "leo lenny len", "lillian": "lil lily",
    "louis": "lou louie", "lucille": "lucy", "ludmila": "luda lyuda", "magdalena": "magda leni", "malcolm": "mal", "margaret": "maggie peggy meg", "maria": "masha marusya", "martha": "marty patsy", "matthew": "matt matty", "maximilian": "max", "melissa": "mel missy", "michael": "mike mick mickey", "mikhail": "misha mishka", "mildred": "midge",
    "montgomery": "monty", "nadezhda": "nadya", "natalia": "natasha natalie", "nathaniel": "nathan nat", "nicholas": "nick nicky", "nikolai": "kolya", "olga": "olya", "oliver": "ollie", "olivia": "liv livvy", "oskar": "ossi", "pamela": "pam", "patricia": "pat trish patty", "patrick": "paddy", "peter": "pete",
    "philip": "phil pip", "priscilla": "cilla prissy", "quentin": "quin", "rafael": "rafa", "randolph": "randy", "raymond": "ray", "rebecca": "becky", "renata": "rena", "richard": "rick dick rich", "robert": "rob bob bobby", "roberto": "beto", "roderick": "rod", "ronald": "ron ronnie", "rosemary": "rosie", "rudolf": "rudi rolf",
    "samantha": "sam sammy", "samuel": "sammie", "sandra": "sandy", "sebastian": "seb basti bastian", "sergei": "seryozha", "sofia": "sofie sonya", "stanley": "stan", "stephen": "steve", "susan": "sue susie", "svetlana": "sveta lana", "sylvester": "sly", "tatiana": "tanya", "terence": "terry", "theodore": "ted theo teddy",
    "theresa": "tess terri", "thelma": "thel", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ulli", "ursula": "uschi", "valentina": "valya", "vasily": "vasya", "veronica": "ronnie vera", "victor": "vic", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "vladimir": "vova volodya",
    "walter": "walt wally", "wilhelmina": "mina willa", "william": "bill will billy willy", "winifred": "winnie", "yevgenia": "zhenya", "yuri": "yura", "zachary": "zach", "zoltan": "zoli",
}
#: Words that say what kind of organisation a name is, with their other forms (fixed values).
ORGANISATION_WORDS = {
    "academy": "acad", "administration": "admin", "agency": "", "alliance": "", "associates": "", "association": "assoc assn", "authority": "auth", "bank": "", "board": "", "brothers": "bros", "bureau": "", "center": "centre ctr", "chamber": "",
    "charity": "", "church": "", "clinic": "", "club": "", "college": "coll", "commission": "comm", "committee": "cttee", "communications": "comms", "company": "co", "consulting": "consultants", "cooperative": "coop", "council": "", "data": "", "department": "dept",
    "development": "dev", "distribution": "", "electric": "", "energy": "", "engineering": "eng", "enterprises": "enterprise", "federation": "fed", "finance": "financial", "foundation": "fdn found", "fund": "", "group": "grp", "guild": "", "holdings": "holding", "hospital": "hosp",
    "industries": "industry", "institute": "inst", "insurance": "ins", "international": "intl", "investments": "", "labs": "lab laboratory laboratories", "league": "", "library": "lib", "logistics": "", "management": "mgmt", "manufacturing": "mfg", "media": "", "ministry": "min", "motors": "",
    "museum": "mus", "office": "", "organization": "org organisation", "partners": "partner", "pharmaceuticals": "pharma", "press": "", "productions": "", "publishing": "publ publisher publishers", "railway": "rail", "research": "", "resources": "", "restaurant": "", "school": "sch", "services": "svcs service",
    "society": "soc", "software": "softwares sw", "solutions": "", "studio": "studios", "systems": "sys system", "technologies": "tech technology", "telecom": "", "trading": "", "transport": "", "trust": "", "union": "", "university": "univ uni", "ventures": "", "works": "",
}
#: Legal forms, articles and joining words that say nothing (fixed values).
EMPTY_WORDS = set("inc ltd llc plc gmbh ag kg ev sa srl corp corporation limited incorporated the of and und et y e a de for".split())
TITLES = set("dr prof mr mrs ms miss mx sir herr frau sr sra señor señora mme mlle phd md jr ing".split()) - {"ing"}

_GIVEN = {short: full for full, shorts in NICKNAMES.items() for short in [full, *shorts.split()]}
_KINDS = {form: word for word, forms in ORGANISATION_WORDS.items() for form in [word, *forms.split()]}
_LEGAL = re.compile(r",\s*(?:inc|ltd|gmbh|llc|plc|ag|kg|sa|srl|corp)\b\.?")
_SOUNDS = {**dict.fromkeys("bp", "b"), **dict.fromkeys("fvw", "f"), **dict.fromkeys("cgkqx", "k"), **dict.fromkeys("dt", "t"), **dict.fromkeys("jsz", "s"), "l": "l", "m": "m", "n": "n", "r": "r"}


def phonetic(word: str) -> str:
    """Consonant sounds of a word in order: vowels, h and y are silent, b/p, c/g/k/q/x, d/t, f/v/w, j/s/z alike, doubles
    one. Letters of other scripts stand for themselves."""
    out: list[str] = []
    for c in word:
        s = _SOUNDS.get(c, "" if c.isascii() else c)
        if s and (not out or out[-1] != s):
            out.append(s)
    return "".join(out)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1 over at most four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m, other = len(hits), [b[j] for j in range(len(b)) if taken[j]]
    moved = sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _level(name: str) -> str:
    text = unicodedata.normalize("NFKD", name)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def _closest(word: str, known: Iterable[str], least: float) -> str | None:
    """The most similar known word, among those that begin or end alike and differ little in length: with one slip of
    the fingers a word keeps its first letter, has it moved by one, or keeps its last three."""
    near = [k for k in known if abs(len(k) - len(word)) <= 2 and (word[0] == k[0] or word[1] == k[0] or word[0] == k[1] or word[-3:] == k[-3:])]
    best = max(((jaro_winkler(word, k), k) for k in near), default=(0.0, ""))
    return best[1] if best[0] >= least else None


@lru_cache(maxsize=100_000)
def _known_given(word: str) -> str | None:
    """The given name a word stands for, mistyped or short."""
    found = _GIVEN.get(word)
    return found if found or len(word) < 4 else _closest(word, NICKNAMES, KNOWN_LEAST)


@lru_cache(maxsize=100_000)
def _known_kind(word: str) -> str | None:
    found = _KINDS.get(word)
    return found if found or len(word) < 5 else _closest(word, ORGANISATION_WORDS, 0.93)


@dataclass(frozen=True)
class Learned:
    """Kind words of organisations and words of things in a collection, and for kinds the spelling that stands for them."""

    kinds: frozenset[str] = frozenset()
    things: frozenset[str] = frozenset()
    same: tuple[tuple[str, str], ...] = ()


def read_name(name: str | None, learned: Learned = Learned()) -> tuple[str, str, str, bool] | None:
    """(kind, main, other, cut): for a person the family name, the given name and whether that is only its beginning; for
    an organisation its own words and its kind words, or ``?`` and letters that may stand for these. None where there is
    nothing to link."""
    level = _level(name or "").replace("_", " ")
    level = re.sub(r"\be\.\s?v\b\.?", " ev ", level).replace("co-op", "coop")
    plain = re.findall(r"[^\W_]+", level)
    if not plain:
        return None
    kind_of = lambda w: _known_kind(w) or (w if w in learned.kinds else None)
    kinds = [k for w in plain if (k := kind_of(w))]
    bare = _LEGAL.sub(" ", level)
    if kinds and "," not in bare:
        own = sorted(w for w in plain if w not in EMPTY_WORDS and not kind_of(w))
        said = " ".join(sorted(set(kinds)))
        return ("organisation", " ".join(own), dict(learned.same).get(said, said), False) if own else None
    if any(w in learned.things for w in plain):
        return None
    short = re.search(r"(?<=\w )([A-Z]{2,4})$", name or "")
    if short and "," not in bare and len(plain) > 1 and not (name or "").isupper() and short[1].casefold() not in _GIVEN | dict.fromkeys(EMPTY_WORDS | TITLES):
        own = sorted(w for w in plain[:-1] if w not in EMPTY_WORDS)
        return ("organisation", " ".join(own), f"?{short[1].casefold()}", False) if own else None
    raw = re.findall(r"[^\W_]+", (name or "").replace("_", " "))
    if len(raw) >= 2 and raw[-1].islower() and not raw[0].islower() and "_" not in (name or "") and not _known_given(raw[0].casefold()):
        return None  # a thing: a proper word and a common noun
    parts = [re.findall(r"[^\W_]+", x) for x in level.split(",", 1)]
    words = [w for w in plain if w not in TITLES]
    if len(words) < 2:
        return None
    if len(parts) == 2 and parts[0] and parts[1]:
        family = " ".join(w for w in parts[0] if w not in TITLES)
        rest = [w for w in parts[1] if w not in TITLES]
        given = next((w for w in rest if len(w) > 1), rest[0] if rest else "")
    else:
        long = [w for w in words if len(w) > 1]
        if len(long) >= 2:
            # who is who: a known given name, else the last word is the family name
            g = next((w for w in long if w in _GIVEN), None) or next((w for w in (long[0], long[-1]) if _known_given(w)), long[0])
            given = g
            family = " ".join(w for w in long if w is not g)
        elif long:
            family, given = long[0], next(w for w in words if len(w) == 1)
        else:
            return None
    if not family or not given:
        return None
    dotted = re.search(rf"\b{re.escape(given)}\.", level) is not None
    full = None if (dotted and given not in _GIVEN) or len(given) == 1 or (dotted and len(given) <= 3) else _known_given(given)
    cut_given = len(given) == 1 or (dotted and full is None)
    return "person", family, full or given, cut_given


def declared_kind(kind: str | None) -> str | None:
    """person, organisation or thing, as a declared type says; null says nothing."""
    k = (kind or "").strip().casefold()
    return None if not k else "person" if k.startswith(("per", "human", "people")) else "organisation" if k.startswith(("org", "company", "firm", "institution")) else "thing"


def learn(df: DataFrame) -> Learned:
    """Kind words and words of things of a collection (id, name, kind): words in at least ``WORD_SHARE`` of the names (so at most
    that many are kept) of which most names with a declared type say organisation, or neither person nor organisation; and
    kinds that share ``SAME_KIND`` own words or more, at least a tenth of those of the rarer."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, k) for n, d in zip(f["name"], f["kind"]) if (k := declared_kind(d)) for w in set(re.findall(r"[^\W\d_]{2,}", _level(n or "").replace("_", " ")))]
            yield pd.DataFrame(rows, columns=["word", "said"])

    counted = cut(df.mapInPandas(words, "word string, said string").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "organisation").alias("o"), F.count_if(F.col("said") == "thing").alias("x")), "name-words")
    least = max(4.0, df.count() * WORD_SHARE)
    usual = counted.filter(F.col("n") >= least).collect()
    known = {w for w in (r.word for r in usual) if w in _GIVEN or w in EMPTY_WORDS or w in TITLES}
    kinds = frozenset(r.word for r in usual if r.o * 2 > r.n and r.word not in known)
    things = frozenset(r.word for r in usual if r.x * 2 > r.n and r.word not in known | set(_KINDS))
    first = Learned(kinds, things)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [x for n in f["name"] if (x := read_name(n, first)) and x[0] == "organisation" and not x[2].startswith("?")]
            yield pd.DataFrame([(x[1], x[2]) for x in found], columns=["own", "said"])

    told = cut(df.select("name").mapInPandas(parts, "own string, said string").distinct(), "name-kinds")
    often = told.groupBy("said").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    k = told.join(often, "said")
    met = k.select("own", F.col("said").alias("a"), F.col("n").alias("na")).join(k.select("own", F.col("said").alias("b"), F.col("n").alias("nb")), "own").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    rows = met.filter((F.col("shared") >= SAME_KIND) & (F.col("shared") * 10 >= F.least("na", "nb"))).orderBy("a", "b").collect()
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        x, y = top(r.a), top(r.b)
        root[max(x, y)] = min(x, y)
    return Learned(kinds, things, tuple(sorted((x, top(x)) for x in {*(r.a for r in rows), *(r.b for r in rows)} if top(x) != x)))


def _reader(learned: Learned):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [read_name(n, learned) for n in f["name"]]
            keep = np.array([x is not None for x in found], bool)
            some = [x for x in found if x]
            text = {c: np.array([x[k] for x in some], object) for k, c in enumerate(("kind", "main", "other"))}
            yield pd.DataFrame({"id": f["id"].to_numpy()[keep], **text, "cut": np.array([x[3] for x in some], bool)})

    return run


def initials(other: str) -> list[str]:
    """Letters that stand for two to four kind words, in any order of two."""
    own = other.split()
    if not 2 <= len(own) <= 4:
        return []
    letters = "".join(w[0] for w in own)
    return [letters, letters[::-1]] if len(own) == 2 else [letters]


def block_keys(kind: str, main: str, other: str) -> list[str]:
    """Phonetic codes of the sorted tokens: whole, and with one sound left out beside the other token's first letter."""
    code = phonetic("".join(sorted(main.split()))) or main[:3]
    near = {code} | {code[:k] + code[k + 1 :] for k in range(len(code))}
    if kind == "organisation":
        # letters meet the kinds they may stand for
        tails = [other[1:] + "?"] if other.startswith("?") else [other, *(f"{x}?" for x in initials(other))]
        return [f"o-{c}:{t}" for t in tails for c in sorted(near)]
    tail = other[:1]
    return [f"p:{code}", *(f"p-{c}:{tail}" for c in sorted(near))]


def letter_bits(word: str) -> int:
    """A bit for each letter a word has, a second one if it has it twice; characters but a to z share eleven bits."""
    bits = 0
    for c in word:
        one = 1 << 2 * (ord(c) - 97) if "a" <= c <= "z" else 1 << 52 + ord(c) % 11
        bits |= one << 1 if bits & one and one < 1 << 52 else one
    return bits


def may_be_alike(least: float) -> Column:
    """False only where ``jaro_winkler(main, main_b) < least``: letters that the other word lacks match nothing, so their
    number bounds the similarity from above."""
    a, b = F.length("main"), F.length("main_b")
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    hits = F.least(a - lacks("bits", "bits_b"), b - lacks("bits_b", "bits"))
    jaro = (hits / a + hits / b + 1) / 3
    prefix = F.lit(0.0)
    for k in range(1, 5):
        prefix = F.when(F.substring("main", 1, k) == F.substring("main_b", 1, k), k / 10).otherwise(prefix)
    return jaro + prefix * (1 - jaro) >= least - 1e-9


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keys = [block_keys(k, m, o) for k, m, o in zip(f["kind"], f["main"], f["other"])]
        row = np.repeat(np.arange(len(f)), [len(k) for k in keys])
        f = f[["rep", "kind", "main", "other", "cut"]].assign(bits=np.array([letter_bits(m) for m in f["main"]], np.int64))
        yield f.iloc[row].assign(block=np.array([x for k in keys for x in k], object))


def _alike(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler similarities of two columns, each different pair once."""
    if not len(a):  # of no pair pandas cannot tell the levels
        return np.zeros(0)
    both = pd.MultiIndex.from_arrays([a, b])
    code, pairs = pd.factorize(both)
    return np.array([jaro_winkler(x, y) for x, y in pairs], float)[code]


def _accept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f[_alike(f["main"], f["main_b"]) >= FAMILY_LEAST]
        same = (f["other"] == f["other_b"]).to_numpy(bool)
        org = (f["kind"] == "organisation").to_numpy(bool)
        # letters met a kind they stand for in the block itself
        yield f[["a", "b"]].loc[same | org | (_alike(f["other"], f["other_b"]) >= GIVEN_LEAST)]


def _fits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [jaro_winkler(ma, mb) >= FAMILY_LEAST for ma, mb in zip(f["main"], f["main_b"])]
        yield f[["a", "b"]].assign(same=(f["main"] == f["main_b"]).astype(bool)).loc[np.array(keep, bool)]


def name_clusters(df: DataFrame, key: str, name: str, kind: str | None = None) -> DataFrame:
    """``id, cluster``: rows whose name could be read, and the smallest id of those that mean the same."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"), (F.col(kind) if kind else F.lit(None)).cast("string").alias("kind"))
    learned = learn(rows)
    n = slots(df.sparkSession)  # few bytes and much work per row: the number of tasks is set, not left to the size
    read = cut(rows.repartition(n, "id").dropDuplicates(["id"]).mapInPandas(_reader(learned), "id long, kind string, main string, other string, cut boolean"), "names")
    classes = read.groupBy("kind", "main", "other", "cut").agg(F.min("id").alias("rep"))
    blocks = cut(classes.mapInPandas(_blocks, "rep long, kind string, main string, other string, cut boolean, bits long, block string"), "name-blocks")
    # a big block is dealt over tasks: one side by hash, the other to every part
    large = cut(blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_BLOCK)).cast("int").alias("parts")).filter("parts > 1"), "large-blocks")
    sized = blocks.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sized = sized.withColumn("known", F.col("other").isin(*NICKNAMES))
    left = sized.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumnRenamed("rep", "a")
    right = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("rep").alias("b"), F.col("main").alias("main_b"), F.col("other").alias("other_b"), F.col("cut").alias("cut_b"), F.col("known").alias("known_b"), F.col("bits").alias("bits_b"), "block", "part")
    cols = ["a", "b", "kind", "main", "main_b", "other", "other_b"]
    # pairs that meet grow with the square of a block: what needs no comparison in full is left out before they move
    letters = F.col("other").startswith("?") != F.col("other_b").startswith("?")
    able = (F.col("other") == F.col("other_b")) | F.when(F.col("kind") == "organisation", letters).otherwise(~(F.col("known") & F.col("known_b")))
    met = left.filter("not cut").join(right.filter("not cut_b"), ["block", "part"]).filter("a < b").filter(able & may_be_alike(FAMILY_LEAST)).select(*cols).dropDuplicates(["a", "b"])
    linked = cut(met.repartition(n, "a", "b").mapInPandas(_accept, "a long, b long"), "name-links")
    full = connected_components(linked)
    # cut given names: the clusters with that family name and a fitting given name, exact family names first
    part = left.filter("cut").join(right.filter("not cut_b"), ["block", "part"]).filter(F.col("other_b").startswith(F.col("other")) & may_be_alike(FAMILY_LEAST)).select(*cols).dropDuplicates(["a", "b"]).mapInPandas(_fits, "a long, b long, same boolean")
    part = part.join(full.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    part = part.withColumn("best", F.max("same").over(Window.partitionBy("a"))).filter("same = best").groupBy("a").agg(F.countDistinct("component").alias("n"), F.min("component").alias("b")).filter("n = 1")
    every = connected_components(linked.unionByName(part.select("a", "b")))
    of = read.join(classes, ["kind", "main", "other", "cut"]).select("id", "rep").join(every.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return of.select("id", F.min("id").over(Window.partitionBy("component")).alias("cluster"))


def name_variants(df: DataFrame, key: str, name: str, kind: str | None = None) -> DataFrame:
    """``a, b``: pairs of rows that mean the same person or organisation, smaller id first."""
    of = cut(name_clusters(df, key, name, kind), "name-clusters")
    sizes = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("cluster")
    written = df.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name")).groupBy("id").agg(F.min("name").alias("name"))
    many = cut(of.join(sizes, "cluster").join(written, "id"), "name-rows")
    copies = many.groupBy("cluster", "name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > COPY_LIMIT)
    marked = many.join(copies, ["cluster", "name"], "left")
    star = marked.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    units = cut(marked.filter("rep is null or id = rep").select("cluster", "id"), "name-units")
    # a big cluster is dealt over tasks: one side by hash, the other to every part
    parts = units.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_PART)).cast("long").alias("parts"))
    dealt = units.join(parts, "cluster")
    left = dealt.select("cluster", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    right = dealt.select("cluster", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["cluster", "part"]).filter("a < b").select("a", "b")
    return pairs.unionByName(star)
