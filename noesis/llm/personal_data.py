"""Personal data in free text: e-mail addresses, phone numbers, identity numbers, street addresses and names of persons,
found and replaced by typed placeholders.

Wide patterns propose spans; four labelers vote on each (yes, no or nothing): the strict form of the type, a gazetteer,
the words around, and a sceptic that knows what else looks alike. What the last two know is learned from the corpus: a word
that is mostly written small is no part of a name, and the words beside spans on which form and gazetteer agree speak for
the type as far as they stand less often beside spans that form or sceptic deny. No vote is trusted by itself. Votes of the
whole corpus are counted per type and pattern of votes (a table of at most 5 x 81 rows), expectation-maximisation over these
counts estimates how reliable each labeler is and how likely a span with given votes is real, and a logistic classifier
over votes and features of the span is trained on a bounded sample of spans with those probabilities as targets. The
classifier decides; of overlapping accepted spans the more certain, then the longer one stays.

The texts are read once: proposed spans, without the texts, and counts of words written small and large go to the shared
folder, and everything else reads these. Tables that are sent to all tasks have bounds: words with at least 1 / 100,000 of
all words, neighbours with at least 1 / 10,000 of all neighbours. Counts cover every span and word and do not depend on how
rows are dealt to tasks; the classifier's sample is at most ``SAMPLE`` distinct kinds of span, by hash of votes and features.

Defined cases: null texts stay null and have no spans; empty and blank texts stay as they are; very long texts are taken
whole; several places of one text in one document are one row of ``found`` and are all replaced; repeated rows give
repeated results; an empty table gives no row.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.operators.sampling import bounded_sample
from noesis.session import cut

TYPES = ["email", "phone", "id_number", "address", "name"]
SAMPLE = 20_000
LABELERS = 4
YES, NO = 1, 2

#: Given names, beside those of the nickname table, as gazetteer (fixed values).
GIVEN_NAMES = """
alexander anastasia andrea andrew anna anthony antonio barbara benjamin bernard carla carlos carmen catherine charles christina christopher
claire daniel david deborah diego dmitri edward ekaterina elena elizabeth emma eva fernando francisco frank frederick gabriela george
guadalupe hannah hannelore hans harold heinrich helen henry hugo ignacio ingrid isabel ivan jack james jan jane jean joan john jonathan jose
joseph josephine juan julia karl katherine klaus konstantin laura leonard lucas luis margaret maria mark martin mary matthew maximilian
michael miguel natalia nicholas nina olga oliver olivia oskar pablo patricia paul paula pedro peter pierre quentin rachel renata richard
robert rosa ruth samantha samuel sara sebastian sergei simon sofia stephen susan svetlana teresa theodore thelma thomas tatiana ulrich
ursula victor victoria vladimir walter wilhelmina william yevgenia zoltan
александр алексей анастасия андрей анна борис валентина вера виктор владимир галина дарья дмитрий евгений евгения екатерина елена иван игорь
ирина константин ксения людмила максим маргарита мария михаил надежда наталья никита николай оксана олег ольга павел петр полина роман
светлана сергей софия степан тамара татьяна федор юлия юрий яков
""".split()
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΫЀ-Я"
_CAP = rf"(?:[{_UPPER}][^\W\d_]+(?:['’-][^\W\d_]+)*)"
_PARTICLE = r"(?:(?:van|von|der|den|de|del|la|da|di|du|dos|le|ten|zu|el|bin|al)[  ])*"
_SP = "[  ]"
_STREET_NAME = rf"{_CAP}(?:{_SP}{_CAP}){{0,2}}"
_EN_STREET = r"(?:Street|Avenue|Lane|Drive|Crescent|Road|Court|Place|Square|Terrace|Close|Way|Boulevard|Rd\.?|St\.|Ave\.|Dr\.|Ln\.|Blvd\.)"

PROPOSE = {
    "email": re.compile(
        r"(?<![\w.+@-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"
        r"|(?<![\w.+@-])[\w.+%-]+\s?[\[({<]\s?(?:at|arroba|собака)\s?[\])}>]\s?[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|punto|ponto|point|punkt|точка)\s?[\])}>]\s?|\s(?:dot|punto|ponto|point|punkt|точка)\s)[\w-]+)+"
        r"|(?<![\w.+@-])[\w.+%-]+\s(?:at|arroba|собака)\s[\w-]+(?:\s(?:dot|punto|ponto|point|punkt|точка)\s[\w-]+)+",
        re.I,
    ),
    "phone": re.compile(r"(?<![\w.,/:=#+-])(?:\+\d{1,3}|00\d{2}|\(\d{2,4}\)|\d{2,5})(?:[   ./-]?\(?\d{1,4}\)?|[  /]?\d{5,9}){1,6}(?![\w/:=]|[.,-]\d)"),
    "id_number": re.compile(r"(?<![\w.,/:=#+-])(?:[A-Z]{2}\d{2}(?: \d{4}){2,5}|\d{4} \d{6}|\d{2} \d{3} \d{3} [A-Z]|\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{7,9}-?[A-Z]|[A-Z]{1,2}-?\d{6,9}[A-Z]?|\d{9,12})(?![\w/:=]|[.,-]\d)"),
    "address": re.compile(
        rf"(?<![\w.,/-])(?:(?:Unit|Flat|Apt|Suite)\.? \d+\w?, )?\d{{1,5}}[A-Za-z]? {_STREET_NAME} {_EN_STREET}(?:, (?:Flat|Apt|Unit|Suite|No)\.? \d+\w?)?"
        rf"|(?<!\w)(?:(?:Lange|Kurze|Alte|Neue|Obere|Untere|Große|Kleine|Am|An der|Im|Zum|Zur|Auf dem) )?(?:(?:Old|New|Alt|Neu|Sankt|St\.) )?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d{{1,4}}[a-z]?(?:, (?:Whg\.|Wohnung|Apt\.) ?\d+)?"
        rf"|(?<![\w.,/-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route|cours)(?: (?:des|de la|de l['’]|de|du|d['’]))? ?{_STREET_NAME}"
        rf"|(?<!\w)(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Paseo|Camino|Ronda|Rua|Travessa|Praça|Largo|Estrada|Alameda)(?: (?:de la|de los|de|del|da|do|das|dos))? {_STREET_NAME},? (?:n\.?[ºo]\.? )?\d{{1,4}}(?:, \d{{1,2}}\.?[ºª](?: ?[A-Z](?!\w))?)?"
        rf"|(?<!\w)(?:улица|ул\.|проспект|пр\.|переулок|пер\.|площадь|пл\.|шоссе) [А-ЯЁ][\wа-яё-]+(?: [А-ЯЁ][а-яё-]+)?, (?:дом |д\. ?)?\d{{1,4}}[а-я]?(?:, (?:корп\.|к\.|кв\.|квартира) ?\d+)*"
        rf"|(?<!\w)[А-ЯЁ][\wа-яё-]+ (?:улица|ул\.|проспект|пр\.|переулок|пер\.|площадь|пл\.|шоссе),? (?:дом |д\. ?)?\d{{1,4}}[а-я]?(?:, (?:корп\.|к\.|кв\.|квартира) ?\d+)*"
    ),
}
#: What a text must hold for a pattern to match at all; most texts are done with these.
_SPELLED = re.compile(r"[\[({<]\s?(?:at|arroba|собака)\s?[\])}>]|\s(?:dot|punto|ponto|point|punkt|точка)\s", re.I)
_PLAIN_MAIL = re.compile(r"(?<![\w.+@-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
_STREET_WORDS = tuple(f" {w}" for w in "Street Avenue Lane Drive Crescent Road Court Place Square Terrace Close Way Boulevard Rd St. Ave. Dr. Ln. Blvd. rue avenue chemin boulevard place impasse allée quai route cours".split())
_STREET_WORDS += tuple(f"{w} " for w in "straße strasse str. weg platz allee gasse ring damm ufer Calle C/ Avda. Avenida Av. Plaza Paseo Camino Ronda Rua Travessa Praça Largo Estrada Alameda".split())
_STREET_WORDS += ("улица", "ул.", "проспект", "пр.", "переулок", "пер.", "площадь", "пл.", "шоссе")
_STRICT_PHONE = re.compile(
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,5}|00\d{2}(?:[ .-]?\d{1,4}){4,6}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3}-\d{4}|0\d{1,4}/\d{5,9}|0\d{4} \d{6}|0\d{3} \d{7}|0\d{3} \d{3} \d{3}|0\d(?:[. ]\d{2}){4}|\d{3} \d{3} \d{4}"
)
_STRICT_ID = re.compile(r"[A-Z]{2}\d{2}(?: \d{4}){2,5}|\d{4} \d{6}|\d{2} \d{3} \d{3} [A-Z]|\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}-?[A-Z]|[A-Z]\d{8}")
_LOOKS_ELSE = re.compile(r"(?:19|20)\d{2}[-./]\d{1,2}(?:[-./]\d{1,2})?|\d{1,2}[./]\d{1,2}[./](?:19|20)?\d{2}|\d{1,3}(?:\.\d{1,3}){3}|\d{1,3}(?:[,   ]\d{3})+(?:\.\d+)?|\d+\.\d+|\d{1,6}|\d{3}-\d{3}")
_DOMAIN_ENDS = set("com org net edu gov info biz io eu de fr es pt ru uk us br mx at ch ca example test invalid local".split())

_NAME_TOKEN = re.compile(rf"(?<!\w)(?:[{_UPPER}]\.(?!\w)|{_CAP})|(?<!\w)(?:van|von|der|den|de|del|la|da|di|du|dos|le|ten)(?= )")
_SURE_GIVEN: set[str] = set(GIVEN_NAMES)


def _given_names() -> set[str]:
    from noesis.llm.name_variants import NICKNAMES

    return _SURE_GIVEN | set(NICKNAMES) | {s for x in NICKNAMES.values() for s in x.split() if len(s) > 3}


_GIVEN = _given_names()
_PARTICLES = set("van von der den de del la da di du dos le ten".split())


@dataclass
class Span:
    """A proposed span: its form, gazetteer and sceptic votes, features, a name's words, and the words and signs around."""

    kind: int
    begin: int
    end: int
    form: int
    gazetteer: int
    sceptic: int
    extra: tuple[float, ...]
    words: tuple[str, ...]
    near: tuple[str, ...]


@dataclass
class Model:
    """What is learned: words that are no names, how much a neighbour speaks for a type, and the classifier's weights."""

    common: frozenset[str]
    context: dict[tuple[int, str], float]
    weights: np.ndarray | None = None


def _name_spans(text: str) -> Iterator[tuple[int, int, list[str], bool]]:
    """(begin, end, tokens, comma form) of all sequences that could be a person's name."""
    found = [(m.start(), m.end(), m.group()) for m in _NAME_TOKEN.finditer(text)]
    n = len(found)
    for i in range(n):
        b, e, w = found[i]
        initial = len(w) == 2 and w[1] == "."
        if w in _PARTICLES:
            continue
        # "Family, Given [I.]"
        if not initial and i + 1 < n and text[e : found[i + 1][0]] == ", ":
            g = found[i + 1]
            if g[2].rstrip(".").casefold() in _GIVEN or len(g[2]) == 2 and g[2][1] == ".":
                end = g[1]
                tokens = [g[2], w]
                if i + 2 < n and text[end : found[i + 2][0]] == " " and len(found[i + 2][2]) == 2 and found[i + 2][2][1] == ".":
                    end = found[i + 2][1]
                begin = b
                yield begin, end, tokens, True
        # "Given [I.] [particles] Family" or "I. [I.] Family"
        k, tokens, last_full = i, [w], 0 if initial else 1
        while k + 1 < n and text[found[k][1] : found[k + 1][0]] in (" ", " ") and k - i < 5:
            k += 1
            t = found[k][2]
            tokens.append(t)
            if t in _PARTICLES or len(t) == 2 and t[1] == ".":
                continue
            last_full += 1
            yield b, found[k][1], list(tokens), False
            if last_full >= 3:
                break


def _vote(flag: bool | None) -> int:
    return 0 if flag is None else YES if flag else NO


_AROUND = re.compile(r"\w+|[^\w\s]|\n")


def spans(text: str) -> list[Span]:
    """All proposed spans of a text."""
    out: list[Span] = []

    def add(kind: str, b: int, e: int, form: bool | None, gazetteer: bool | None, sceptic: bool | None, *extra: float, words: tuple[str, ...] = ()) -> None:
        ahead = [x.lower() for x in _AROUND.findall(text[max(0, b - 40) : b])][-3:]
        behind = [x.lower() for x in _AROUND.findall(text[e : e + 24])][:2]
        near = (*(f"<{x}" for x in (ahead or ["^"])), *(f">{x}" for x in (behind or ["$"])))
        out.append(Span(TYPES.index(kind), b, e, _vote(form), _vote(gazetteer), _vote(sceptic), extra, words, near))

    if _SPELLED.search(text):
        mails = PROPOSE["email"].finditer(text)
    else:
        mails = _PLAIN_MAIL.finditer(text) if "@" in text else ()
    for m in mails:
        s = m.group().rstrip(".-")
        spelled = "@" not in s
        tail = re.split(r"[^\w]+", s.casefold())[-1]
        add("email", m.start(), m.start() + len(s), bool(re.fullmatch(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", s, re.I)) or (None if spelled else False), tail in _DOMAIN_ENDS or None, None if len(tail) >= 2 else False, float(spelled), len(s) / 40)
    at = 0
    while m := PROPOSE["phone"].search(text, at):
        s = m.group()
        strict = _STRICT_PHONE.fullmatch(s)
        if not strict and (head := _STRICT_PHONE.match(s)) and not s[head.end() : head.end() + 1].isdigit():
            s, strict = head.group(), head  # two numbers in a row
        at = m.start() + len(s)
        digits = sum(c.isdigit() for c in s)
        if 7 <= digits <= 15:
            add("phone", m.start(), at, bool(strict), s.startswith(("+", "00", "(", "0")) or None, False if _LOOKS_ELSE.fullmatch(s) or _STRICT_ID.fullmatch(s) else None, digits / 15, float(s[0] == "0"))
    for m in PROPOSE["id_number"].finditer(text):
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        strict = bool(_STRICT_ID.fullmatch(s))
        add("id_number", m.start(), m.end(), strict, any(c.isalpha() for c in s) or None, False if _STRICT_PHONE.fullmatch(s) and not strict or _LOOKS_ELSE.fullmatch(s) else None, digits / 15, float(s[0].isalpha()))
    for m in PROPOSE["address"].finditer(text) if any(w in text for w in _STREET_WORDS) else ():
        s = m.group()
        add("address", m.start(), m.end(), bool(re.search(r"\d", s)), True, False if re.search(r"\d{4,}", s) and not re.search(r",", s) else None, len(s) / 40, float("," in s))
    for b, e, tokens, comma in _name_spans(text):
        full = [t for t in tokens if len(t) > 2 and t not in _PARTICLES]
        first = tokens[0].rstrip(".").casefold()
        known = first in _GIVEN
        initial = len(tokens[0]) == 2 and tokens[0][1] == "."
        if not (known or initial or len(full) == 2):
            continue
        others = [t.casefold() for t in full if t.casefold() != first]
        odd = any(t in _GIVEN for t in others) and not known or len(full) > (2 if known else 1 if initial else 2)
        upper = sum(t.isupper() for t in full)
        mixed = 0 < upper < len(full)
        words = tuple(t.casefold() for t in full if not known or t.casefold() != first)
        add("name", b, e, (known or initial) and not mixed and len(full) == (1 if initial else 2), True if known else None if initial else False, False if odd or mixed else None, float(initial), float(comma), len(full) / 4, words=words)
    return out


def sceptic(s: Span, common: frozenset[str]) -> int:
    """The sceptic's vote, with what it knows of words that are no names."""
    return NO if s.words and any(w in common for w in s.words) else s.sceptic


def agreed(s: Span, doubt: int) -> bool | None:
    """Whether form and gazetteer agree on a span that the sceptic leaves alone (true), or form or sceptic deny it (false)."""
    if doubt == NO or s.form == NO:
        return False
    return True if s.form == YES and s.gazetteer == YES else None


def around(s: Span, context: dict[tuple[int, str], float]) -> tuple[int, float]:
    """The vote of the words around a span and their evidence."""
    e = sum(context.get((s.kind, w), 0.0) for w in s.near)
    return (YES if e >= 1.0 else NO if e <= -1.0 else 0), float(np.clip(e, -6, 6))


def judged(s: Span, m: Model) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(votes, features) of a span."""
    doubt = sceptic(s, m.common)
    vote, evidence = around(s, m.context)
    return (s.form, s.gazetteer, vote, doubt), (round(evidence / 6, 1), *s.extra)


def pattern_of(votes: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def votes_of(pattern: int) -> np.ndarray:
    return np.array([pattern // 3**k % 3 for k in range(LABELERS)])


def reliabilities(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns of one type: probability that a span with each pattern is real, the
    votes' probabilities [real?, labeler, vote], and the share of real spans. Starts from votes that are right four times in
    five; counts carry a prior of three spans of that kind."""
    votes = np.stack([votes_of(p) for p in pattern])
    prior = 3 * np.array([[0.3, 0.1, 0.6], [0.2, 0.7, 0.1]])  # nothing, yes, no; of false and of real spans
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    real = 1 / (1 + np.exp(-1.4 * (yes - 1.5 * no - 0.5)))
    table = np.zeros((2, LABELERS, 3))
    share = 0.5
    for _ in range(rounds):
        for y, w in enumerate((1 - real, real)):
            for k in range(LABELERS):
                got = np.bincount(votes[:, k], count * w, 3) + prior[y]
                table[y, k] = got / got.sum()
        share = float(np.clip((count * real).sum() / count.sum(), 0.01, 0.99))
        score = [np.log(s) + np.log(table[y][np.arange(LABELERS), votes]).sum(1) for y, s in enumerate((1 - share, share))]
        real = 1 / (1 + np.exp(np.clip(score[0] - score[1], -40, 40)))
    return real, table, share


def features(kind: int, votes: tuple[int, ...], extra: tuple[float, ...]) -> np.ndarray:
    """Votes and span features, in the type's own block."""
    x = np.zeros(len(TYPES) * 16)
    at = kind * 16
    for k, v in enumerate(votes):
        if v:
            x[at + 2 * k + v - 1] = 1
    x[at + 8 : at + 8 + len(extra)] = extra
    x[at + 15] = 1
    return x


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * w
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-4))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def accepted(found: list[Span], m: Model) -> list[tuple[int, int, int, float]]:
    """(begin, end, type, probability) of the spans of one text that the classifier takes, without overlaps, in order."""
    if not found:
        return []
    both = [judged(s, m) for s in found]
    x = np.stack([features(s.kind, v, e) for s, (v, e) in zip(found, both)])
    p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
    taken_from = [(s.begin, s.end, s.kind, float(q)) for s, q in zip(found, p) if q >= 0.5]
    taken_from.sort(key=lambda f: (f[2] == TYPES.index("name"), -(f[1] - f[0]) if f[3] > 0.9 else 0, -f[3], f[0]))
    taken: list[tuple[int, int, int, float]] = []
    for f in taken_from:
        if all(f[1] <= t[0] or f[0] >= t[1] for t in taken):
            taken.append(f)
    return sorted(taken)


_WORD = re.compile(r"[^\W\d_]{2,}")
_PROPOSED = "id long, t long, spans binary, texts array<string>, words array<string>, small array<long>, large array<long>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with spans, and rows of word counts."""
    names = ["id", "t", "spans", "texts", "words", "small", "large"]
    none = lambda n, kind: pa.nulls(n, kind)
    for b in batches:
        ids, hashes, found, said = [], [], [], []
        small: Counter[str] = Counter()
        large: Counter[str] = Counter()
        for key, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not text:
                continue
            own = spans(text)
            if own:
                ids.append(key), hashes.append(t), found.append(pickle.dumps([(s.kind, s.begin, s.end, s.form, s.gazetteer, s.sceptic, s.extra, s.words, s.near) for s in own])), said.append([text[s.begin : s.end] for s in own])
            every = _WORD.findall(text)
            small.update(w for w in every if w[0].islower())
            large.update(w.casefold() for w in every if not w[0].islower())
        n = len(ids)
        kind, count = pa.list_(pa.string()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary()), pa.array(said, kind), none(n, kind), none(n, count), none(n, count)], names=names)
        words = sorted(small.keys() | large.keys())
        if words:
            yield pa.RecordBatch.from_arrays(
                [none(1, pa.int64()), none(1, pa.int64()), none(1, pa.binary()), none(1, kind), pa.array([words], kind), pa.array([[small[w] for w in words]], count), pa.array([[large[w] for w in words]], count)], names=names
            )


def _read(raw: bytes) -> list[Span]:
    return [Span(*x) for x in pickle.loads(raw)]


def proposed(df: DataFrame) -> DataFrame:
    """The proposed spans of all texts of ``df`` (id, text), and the corpus' word counts; written once."""
    rows = df.select("id", F.xxhash64("text").alias("t"), "text").filter(F.col("text").isNotNull())
    return cut(rows.mapInArrow(_propose, _PROPOSED), "pii-spans")


def _neighbours(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[int, str], list[int]] = {}
            for raw in b.column(0).to_pylist():
                for s in _read(raw):
                    a = agreed(s, sceptic(s, common))
                    if a is not None:
                        for w in {*s.near, ""}:
                            counts.setdefault((s.kind, w), [0, 0])[0 if a else 1] += 1
            rows = [(k, w, y, n) for (k, w), (y, n) in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "near", "yes", "no"])

    return run


def _patterns(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for raw in b.column(0).to_pylist():
                for s in _read(raw):
                    v, e = judged(s, m)
                    counts[s.kind, pattern_of(v), e] += 1
            rows = [(k, p, list(e), n) for (k, p, e), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64()))], names=["kind", "pattern", "extra", "n"])

    return run


def learn(found: DataFrame) -> Model:
    """Words, neighbours, reliabilities and classifier from the proposed spans of a corpus."""
    words = found.filter("words is not null").select(F.explode(F.arrays_zip("words", "small", "large")).alias("w")).groupBy("w.words").agg(F.sum("w.small").alias("small"), F.sum("w.large").alias("large"))
    words = cut(words, "pii-words")
    total = words.agg(F.coalesce(F.sum(F.col("small") + F.col("large")), F.lit(0))).first()[0]
    # at most 100,000 words have that share
    usual = words.filter((F.col("small") >= F.col("large")) & (F.col("small") + F.col("large") >= max(2.0, total * 1e-5))).select("words").collect()
    common = frozenset(r[0] for r in usual)
    held = found.filter("spans is not null").select("spans")
    near = cut(held.mapInArrow(_neighbours(common), "kind int, near string, yes long, no long").groupBy("kind", "near").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "pii-near")
    # what stands beside a type's agreed spans is held against what stands beside its denied ones and all other types'
    whole = near.groupBy("near").agg(F.sum("yes").alias("all_yes"))
    per = near.join(whole, "near").withColumn("no", F.col("no") + F.col("all_yes") - F.col("yes")).drop("all_yes")
    kinds = near.select("kind").distinct()
    others = whole.crossJoin(F.broadcast(kinds)).join(near.select("kind", "near"), ["kind", "near"], "left_anti").select("kind", "near", F.lit(0).cast("long").alias("yes"), F.col("all_yes").alias("no"))
    per = cut(per.select("kind", "near", "yes", "no").unionByName(others.select("kind", "near", "yes", "no")), "pii-beside")
    sums = {r.kind: (r.yes, r.no) for r in per.filter("near = ''").collect()}
    every = near.filter("near <> ''").agg(F.coalesce(F.sum(F.col("yes") + F.col("no")), F.lit(0))).first()[0]
    context: dict[tuple[int, str], float] = {}
    for r in per.filter((F.col("near") != "") & (F.col("yes") + F.col("no") >= max(3.0, every * 1e-4))).collect():  # at most 10,000 a type
        y, n = sums[r.kind]
        context[r.kind, r.near] = float(np.log((r.yes + 1) / (y + 2)) - np.log((r.no + 1) / (n + 2)))
    m = Model(common, context)
    votes = cut(held.mapInArrow(_patterns(m), "kind int, pattern int, extra array<double>, n long").groupBy("kind", "pattern", "extra").agg(F.sum("n").alias("n")), "pii-votes")
    table = votes.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).orderBy("kind", "pattern").toPandas()  # at most 5 x 81 rows
    real: dict[tuple[int, int], float] = {}
    for kind, part in table.groupby("kind"):
        p, _, _ = reliabilities(part["pattern"].to_numpy(), part["n"].to_numpy(float))
        real.update({(int(kind), int(q)): float(v) for q, v in zip(part["pattern"], p)})
    few = bounded_sample(votes, ["kind", "pattern", "extra"], SAMPLE).toPandas()
    m.weights = np.zeros(len(TYPES) * 16)
    if len(few):
        x = np.stack([features(int(k), tuple(votes_of(int(p))), tuple(e)) for k, p, e in zip(few["kind"], few["pattern"], few["extra"])])
        target = np.array([real[int(k), int(p)] for k, p in zip(few["kind"], few["pattern"])])
        m.weights = fit_classifier(x, target, few["n"].to_numpy(float))
    return m


def train(df: DataFrame) -> Model:
    """The model of all texts of ``df`` (id, text)."""
    return learn(proposed(df))


_FOUND = pa.list_(pa.struct([("pii_type", pa.string()), ("pii_text", pa.string()), ("begin", pa.int32()), ("behind", pa.int32()), ("confidence", pa.float64())]))
_FOUND_SQL = "array<struct<pii_type:string,pii_text:string,begin:int,behind:int,confidence:double>>"


def _decide(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for raw, said in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = _read(raw)
                text = {(s.begin, s.end): t for s, t in zip(own, said)}
                lists.append([{"pii_type": TYPES[k], "pii_text": text[x, y], "begin": x, "behind": y, "confidence": p} for x, y, k, p in accepted(own, m)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, _FOUND)], names=["id", "t", "found"])

    return run


def decisions(df: DataFrame, model: Model | None = None) -> DataFrame:
    """``id, t, found``: what was found in every text of ``df`` (id, text) with a proposed span, by a hash of the text."""
    found = proposed(df)
    m = model or learn(found)
    return found.filter("spans is not null").select("id", "t", "spans", "texts").mapInArrow(_decide(m), f"id long, t long, found {_FOUND_SQL}")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clean = []
        for text, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            out, at = [], 0
            for r in rows or ():
                out += [text[at : r["begin"]], f"<{r['pii_type'].upper()}>"]
                at = r["behind"]
            clean.append(text if text is None else "".join([*out, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), b.column(2)], names=["id", "clean", "found"])


def redact(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """``id, clean, found``: every text with placeholders such as <EMAIL>, and what was found where. Finds meet their texts by
    id and hash."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = decisions(own, model).groupBy("id", "t").agg(F.any_value("found").alias("found"))
    both = own.withColumn("t", F.xxhash64("text")).join(found, ["id", "t"], "left")
    none = F.array().cast(_FOUND_SQL)
    return both.select("id", "text", F.coalesce("found", none).alias("found")).mapInArrow(_replace, f"id long, clean string, found {_FOUND_SQL}")


def personal_data(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """``id, pii_type, pii_text``: distinct finds of every text. Finds of one row are made distinct before they are
    exploded; rows of one id meet in a last aggregate."""
    found = decisions(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), model)
    pairs = F.array_distinct(F.transform("found", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["pii_text"].alias("pii_text"))))
    return found.select("id", F.explode(pairs).alias("p")).select("id", "p.pii_type", "p.pii_text").distinct()
