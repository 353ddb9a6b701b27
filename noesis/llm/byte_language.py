"""Language of texts and of each stretch of a mixed text, by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a sentence in both directions and gives every position the probabilities of the
languages and of "no language". It is trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled texts; labels may be wrong: a first round fits them as they are, and a second round drops the sentences whose
label the network then denies. A document's sentences pool the log-probabilities of their positions, the best path over
the sentences (changing language has a price) gives the stretches, and a stretch's confidence is the pooled probability
of its language. Every text is read whole; the same sentence in a batch is read once.

The sample bound is ``SAMPLE`` texts, chosen by hash of their id; everything else covers all rows and is narrow: no text
is shuffled, and the network's weights (a few tens of kB) are all that is sent.

Defined cases: null, empty and blank texts and texts without natural language (numbers, codes, hexadecimal keys) have no
stretch; sentences too poor in words to tell, such as a lone name or number, go with the stretch before them (at the start:
the one behind); very long sentences are read in pieces; repeated rows give repeated results; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noesis.operators.sampling import bounded_sample

LANGUAGES = ["de", "en", "es", "fr", "pt", "ru"]
NONE = "zz"
SAMPLE = 4_000
HIDDEN = 16
PIECE = 96
SWITCH = 8.0
WHOLE_EVIDENCE = 128
#: Codes and names of the languages, lower-case, without region (fixed values).
LABELS = {
    "de": "de deu ger german deutsch allemand alemán alemão немецкий",
    "en": "en eng english englisch anglais inglés inglês английский",
    "es": "es spa spanish español espanol spanisch espagnol espanhol castellano испанский",
    "fr": "fr fra fre french français francais französisch francés francês французский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués португальский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}
_BY_LABEL = {form: code for code, forms in LABELS.items() for form in forms.split()}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s*[\r\n]+\s*")
_TELLING = re.compile(r"(?<![\w=#~:@/.\-])[^\W\d_]{2,}(?![\w=#~@/])")
_DIGITS = re.compile(r"\d+")


def label_code(label: Column) -> Column:
    """The language a label names in any form (code, regional code, name), else null."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_](?:[a-z]{2}|[0-9]{3})$", "")
    table = F.create_map(*[F.lit(x) for pair in _BY_LABEL.items() for x in pair])
    return F.when(plain.isNotNull(), F.element_at(table, plain))


def sentences(text: str | None) -> list[str]:
    """Whole sentences of a text, in order."""
    return [s for x in _SENTENCE.split(text) if (s := x.strip())] if text else []


def telling_words(sentence: str) -> int:
    """Words of letters alone, of two letters or more, that are not parts of codes or keys."""
    return len(_TELLING.findall(sentence))


class ByteGru:
    """Two gated recurrent layers, one each way, over byte embeddings folded into their input weights."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"E{d}"] = f(256, 3 * hidden)  # byte -> gates: update, reset, candidate
            self.p[f"U{d}"] = (r.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        self.p["V"] = f(2 * hidden, classes)
        self.p["a"] = np.zeros(classes, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States of one direction for bytes x [rows, time]."""
        p, h_n = self.p, self.hidden
        n, t_n = x.shape
        h = np.zeros((n, h_n), np.float32)
        out = np.empty((t_n, n, h_n), np.float32)
        held = []
        table, u_zr, u_c = p[f"E{d}"] + p[f"c{d}"], np.ascontiguousarray(p[f"U{d}"][:, : 2 * h_n]), np.ascontiguousarray(p[f"U{d}"][:, 2 * h_n :])
        for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
            g = table[x[:, t]]
            zr = np.tanh((g[:, : 2 * h_n] + h @ u_zr) * np.float32(0.5))
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:, :h_n], zr[:, h_n:]
            c = np.tanh(g[:, 2 * h_n :] + (r * h) @ u_c)
            new = h + z * (c - h)
            if keep:
                held.append((t, h, z, r, c))
            h = out[t] = new
        return out, held

    def logits(self, x: np.ndarray) -> np.ndarray:
        """[time, rows, classes]."""
        f, _ = self._run(x, "f")
        b, _ = self._run(x, "b")
        v = self.p["V"]
        return f @ v[: self.hidden] + b @ v[self.hidden :] + self.p["a"]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        y = self.logits(x)
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient by backpropagation through time, both ways."""
        p, n_h = self.p, self.hidden
        f, held_f = self._run(x, "f", True)
        b, held_b = self._run(x, "b", True)
        hidden = np.concatenate([f, b], 2)
        y = hidden @ p["V"] + p["a"]
        y -= y.max(2, keepdims=True)
        prob = np.exp(y)
        prob /= prob.sum(2, keepdims=True)
        w = (mask.T / max(mask.sum(), 1)).astype(np.float32)
        rows = np.arange(x.shape[0])
        loss = -float((np.log(prob[:, rows, target] + 1e-9) * w).sum())
        dy = prob
        dy[:, rows, target] -= 1
        dy *= w[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = np.einsum("tnh,tnc->hc", hidden, dy, optimize=True)
        g["a"] = dy.sum((0, 1))
        dh_all = dy @ p["V"].T
        for d, held, part in (("f", held_f, slice(0, n_h)), ("b", held_b, slice(n_h, None))):
            u, carry = p[f"U{d}"], np.zeros((x.shape[0], n_h), np.float32)
            for t, h, z, r, c in reversed(held):
                dh = dh_all[t][:, part] + carry
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * n_h :].T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                carry = dh * (1 - z) + drh * r + dg[:, : 2 * n_h] @ u[:, : 2 * n_h].T
                g[f"U{d}"][:, : 2 * n_h] += h.T @ dg[:, : 2 * n_h]
                g[f"U{d}"][:, 2 * n_h :] += (r * h).T @ dc
                g[f"c{d}"] += dg.sum(0)
                np.add.at(g[f"E{d}"], x[:, t], dg)
        return loss, g


def _bytes_of(sentence: str) -> bytes:
    return _DIGITS.sub("0", sentence).encode("utf-8", "replace")


def _pieces(raw: bytes) -> list[bytes]:
    n = -(-len(raw) // PIECE)
    size = -(-len(raw) // n) if n else 0
    return [raw[k * size : (k + 1) * size] for k in range(n)]


def _codes(rng: np.random.Generator, rows: int) -> list[bytes]:
    """Texts without language for training: keys, numbers and signs."""
    marks = ["0x", "#", "~", "id:", "k=", "", "v", "n=", "ref-", "["]
    out = []
    for _ in range(rows):
        words = ["%s%x" % (marks[rng.integers(len(marks))], rng.integers(1 << 24)) for _ in range(rng.integers(4, 16))]
        out.append(_bytes_of(" ".join(words))[:PIECE])
    return out


def _pad(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    return x, np.arange(width)[None, :] < np.array([len(r) for r in rows])[:, None]


def _with_names(raw: bytes, rng: np.random.Generator) -> bytes:
    """A sentence with one word replaced by an invented name, in any case, or set in capitals: what a name looks like must
    not tell the language."""
    draw = rng.random()
    if draw < 0.05:
        return raw.decode("utf-8", "ignore").upper().encode()
    words = raw.split(b" ")
    if draw < 0.4 and len(words) > 3:
        name = "".join("bcdfghjklmnprstvwz"[rng.integers(18)] + "aeiou"[rng.integers(5)] for _ in range(rng.integers(3, 6)))
        words[rng.integers(len(words))] = (name, name.title(), name.upper())[rng.integers(3)].encode()
        return b" ".join(words)
    return raw


def train(texts: list[str], labels: list[str], *, rounds: int = 700, batch: int = 200, rate: float = 0.015, seed: int = 11) -> ByteGru:
    """A network fitted to labelled texts (Adam); from half way on without sentences whose label it denies."""
    rng = np.random.default_rng(seed)
    names = [*LANGUAGES, NONE]
    # a sentence counts once, under the label most of its texts have: copies, however many, must not teach a wrong label
    votes: dict[bytes, np.ndarray] = {}
    for t, lang in zip(texts, labels):
        for s in set(sentences(t)):
            if telling_words(s) >= 3:
                votes.setdefault(_bytes_of(s), np.zeros(len(names)))[names.index(lang)] += 1
    rows, y = [], []
    for raw, n in votes.items():
        for piece in _pieces(raw):
            rows.append(piece)
            y.append(int(n.argmax()))
    net = ByteGru(len(names))
    if not rows:
        return net
    extra = _codes(rng, max(50, len(rows) // 12))
    rows, y = rows + extra, np.array(y + [len(names) - 1] * len(extra))
    live = np.arange(len(rows))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    per_class = [live[y == c] for c in range(len(names))]
    for step in range(1, rounds + 1):
        if step == rounds // 2:
            guess = pooled(net, rows).argmax(1)
            per_class = [live[(y == c) & (guess == c)] for c in range(len(names))]
        share = [k for k in per_class if len(k)]
        pick = np.concatenate([rng.choice(k, max(1, batch // len(share))) for k in share])
        # cut at a random place, so beginnings and ends of sentences weigh no more than their middles
        cut_at = rng.integers(24, 65)
        some = [r[(o := int(rng.integers(max(1, len(r) - cut_at + 1)))) : o + cut_at] for r in (_with_names(rows[i], rng) for i in pick)]
        x, mask = _pad(some, max(map(len, some)))
        _, g = net.gradients(x, mask, y[pick])
        size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        lr = rate * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / rounds)) * 0.95 + 0.05)
        for k, q in g.items():
            q = q * np.float32(min(1.0, 1.0 / (size + 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def pooled(net: ByteGru, rows: list[bytes], block: int = 4096) -> np.ndarray:
    """Log-probabilities of every row of bytes, added over its positions: [rows, classes]. Rows longer than a piece are
    read in pieces; rows of like length are read together."""
    parts = [p for r in rows for p in (_pieces(r) or [b" "])]
    owner = np.repeat(np.arange(len(rows)), [max(1, -(-len(r) // PIECE)) for r in rows])
    out = np.zeros((len(rows), net.classes), np.float64)
    order = np.argsort([len(p) for p in parts], kind="stable")
    for at in range(0, len(order), block):
        some = order[at : at + block]
        x, mask = _pad([parts[i] for i in some], max(len(parts[i]) for i in some) or 1)
        score = (net.log_probabilities(x) * mask.T[:, :, None]).sum(0)
        np.add.at(out, owner[some], score)
    return out


def stretches(score: np.ndarray, telling: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int, float]]:
    """(first sentence, behind the last, language, confidence) along the best path. ``score`` [sentences, classes] is the
    pooled evidence, the last class "no language"; sentences that do not tell carry none."""
    langs = score.shape[1] - 1
    use = np.flatnonzero(telling & (score.argmax(1) < langs))
    if not len(use):
        return []
    s = score[use, :langs]
    best, back = s[0].copy(), []
    for row in s[1:]:
        top = best.argmax()
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(langs), top))
        best = np.where(stay, best, best[top] - switch) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out, first = [], 0
    for k in range(1, len(path) + 1):
        if k == len(path) or path[k] != path[first]:
            total = s[first:k].sum(0)
            # sentences of one stretch are no independent witnesses: their evidence counts as their root
            e = np.exp((total - total.max()) / (k - first) ** 0.5)
            begin = 0 if not out else int(use[first])
            end = len(score) if k == len(path) else int(use[k])
            out.append((begin, end, path[first], float(e[path[first]] / e.sum())))
            first = k
    return out


def _label_rows(net: ByteGru):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 5000):
                f = whole.iloc[at : at + 5000]
                docs = [sentences(t) for t in f["text"]]
                known: dict[bytes, int] = {}
                codes = [[known.setdefault(_bytes_of(s), len(known)) for s in d] for d in docs]
                score = pooled(net, list(known)) if known else np.zeros((0, net.classes))
                out = []
                for key, d, c in zip(f["id"], docs, codes):
                    if d:
                        # positions of one sentence are not independent, so its evidence is their mean; a sentence shorter
                        # than WHOLE_EVIDENCE bytes, in which a name or number weighs much, has its share of it
                        size = np.array([max(WHOLE_EVIDENCE, len(_bytes_of(s))) for s in d])
                        e = score[c] * (12.0 / size)[:, None]
                        telling = np.array([telling_words(s) >= 2 for s in d])
                        spans = stretches(e, telling)
                        out += [(key, k, LANGUAGES[lang], conf, a, b, " ".join(d[a:b])) for k, (a, b, lang, conf) in enumerate(spans)]
                yield pd.DataFrame(out, columns=["id", "segment_no", "lang", "confidence", "first_sentence", "behind", "segment"])

    return run


def fit(df: DataFrame, key: str, text: str, label: str, *, sample: int = SAMPLE) -> ByteGru:
    """Train on at most ``sample`` rows with a label that names a language, in the order of a hash of the key."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), label_code(F.col(label)).alias("lang")).filter("lang is not null and length(text) >= 20")
    few = bounded_sample(rows, ["id"], sample).toPandas()
    return train(few["text"].tolist(), few["lang"].tolist())


def language_segments(df: DataFrame, key: str, text: str, net: ByteGru, *, with_text: bool = False) -> DataFrame:
    """``id, segment_no, lang, confidence, first_sentence, behind`` (and the segment's text): the stretches of whole sentences
    of one language of every text, in order."""
    out = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(
        _label_rows(net), "id long, segment_no int, lang string, confidence double, first_sentence int, behind int, segment string"
    )
    return out if with_text else out.drop("segment")


def label_repairs(notes: DataFrame, labels: DataFrame, *, key: str = "id", text: str = "content", label_key: str = "node_id", label: str = "lang_label", sample: int = SAMPLE) -> DataFrame:
    """``node_id, segment_no, lang, confidence, given``: all segments of the texts whose label is absent, useless or names
    another language than their first segment, and of all texts with several languages."""
    one = labels.groupBy(F.col(label_key).alias("id")).agg(F.min(label).alias("label"))
    own = notes.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    net = fit(own.join(one, "id"), "id", "text", "label", sample=sample)
    found = language_segments(own, "id", "text", net)
    per = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("segment_no", "lang", "confidence"))).alias("segments"))
    per = per.join(one, "id", "left").withColumn("given", label_code(F.col("label")))
    wrong = F.col("given").isNull() | (F.col("given") != F.col("segments")[0]["lang"]) | (F.size("segments") > 1)
    return per.filter(wrong).select(F.col("id").alias("node_id"), F.explode("segments").alias("s"), "given").select("node_id", "s.segment_no", "s.lang", "s.confidence", "given")
