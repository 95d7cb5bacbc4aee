"""Abusive, hateful or sexual passages: restored text, scored by a trained classifier.

Texts are restored by the noisy-channel decoder and cut into passages. A
logistic model over the words, pairs and triples of a passage scores it; the
score of a document is that of its worst passage. The model is trained on
documents that people labelled as a whole: a labelled document says only that
one of its passages is of the kind, so the passages that count as positive are
chosen anew in each round, as those the model finds worst.

A short list of common words is the model's prior knowledge: they enter as
pseudo-counts of a few features, which labels outweigh as they grow in number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.deobfuscate import Restorer, fit_model, fold

KINDS = ("abusive", "hateful", "sexual")

#: Length and distance of the windows by which longer passages are scored as well.
WINDOWS = ((10, 3), (6, 2))
#: Score from which a document is a case.
CASE = 0.4

#: Common words of insult, sex, harm and address in English, Spanish, French, German and Hindi.
LEXICON = {
    "insult": """
        idiot moron imbecile cretin halfwit scumbag lowlife bastard asshole bitch slut whore scum vermin subhuman brainless worthless fuck fucking shit cunt
        idiota imbécil estúpido estúpida mierda puta cabrón gilipollas pendejo escoria zorra rata basura
        connard connasse salope pute merde crétin abruti ordure bâtard enculé vermine
        arschloch wichser schlampe hure hurensohn schwein dreckskerl missgeburt ungeziefer abschaum scheiße trottel
        कुत्ते कमीने हरामी हरामखोर साले गधे उल्लू निकम्मे रंडी चूतिया सूअर कीड़े""",
    "sexual": """
        nude naked horny sex sexy xxx porn tit cock dick pussy hardcore
        desnuda desnudo follar polla teta porno
        nue baiser bite sein sexe
        nackt nacktbilder ficken titten geil geile
        नंगी नंगा सेक्स चुदाई""",
    "harm": """
        kill burn choke slap punch stab strangle rot beat knife die
        matar muérete romper
        crever tuer égorger casser
        umbringen totschlagen verrecke erschlagen
        मार मर""",
    "you": """
        you your yours yourself
        tu tus te ti usted ustedes eres
        toi ton ta tes vous votre vos
        du dich dir dein deine euch
        तू तुम तेरी तेरा तेरे तुझे आप""",
}
_CLASS = {fold(w): f"<{kind}>" for kind in reversed(LEXICON) for w in LEXICON[kind].split()}
YOU = "<you>"
HITS = tuple(f"<{kind}>" for kind in LEXICON if kind != "you")
SEVERAL = "<any> & <any>"
#: Score of a passage without any known feature towards which the bias is drawn.
BARE = 0.005
#: Pseudo-counts of positive passages, the prior knowledge of the model.
PRIOR = {
    "<insult>": 4.0, "<sexual>": 4.0, "<harm>": 1.2, "<insult> & <you>": 8.0, "<sexual> & <you>": 8.0, "<harm> & <you>": 4.0,
    SEVERAL: 8.0, "<insult> <insult>": 8.0, "<you> <insult>": 8.0,
}


def kind_of(word: str) -> str | None:
    """The class of a word in the list, also of its plural with s; none for others."""
    return _CLASS.get(word) or (_CLASS.get(word[:-1]) if word.endswith("s") else None)


def features(words: list[str]) -> list[str]:
    """Words, neighbours, pairs with one word between, triples and the first word, each as often as it occurs.

    Words of the list count a second time under their class, alone, with their
    neighbours, and together with an address or another one.
    """
    out = list(words)
    out += map(" ".join, zip(words, words[1:]))
    out += (f"{a} _ {b}" for a, b in zip(words, words[2:]))
    out += map(" ".join, zip(words, words[1:], words[2:]))
    out += [f"^ {w}" for w in words[:1]]
    kinds = [kind_of(w) for w in words]
    hit = [k in HITS for k in kinds]
    if any(hit):
        out += [k for k, h in zip(kinds, hit) if h]
        named = [k or w for k, w in zip(kinds, words)]
        out += [f"{a} {b}" for a, b, x, y in zip(named, named[1:], hit, hit[1:]) if x or y]
        out += [f"^ {named[0]}"] if hit[0] else []
        out += [f"{k} & {YOU}" for k in HITS if k in kinds and YOU in kinds]
        out += [SEVERAL] if sum(hit) > 1 else []
    return out


@dataclass
class PassageModel:
    """Weights of features; a passage's features share its weight, so long passages are no worse for being long."""

    weights: dict[str, float]
    bias: float

    def score(self, words: list[str]) -> float:
        w = self.weights
        found = [w[f] for f in features(words) if f in w]
        z = self.bias + sum(found) / max(1.0, len(found)) ** 0.5
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


_MULT = np.uint64(0x9E3779B97F4A7C15)
WORD, PAIR, APART, TRIPLE, FIRST = range(5)


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """64-bit keys of features of one kind from the numbers of their words."""
    h = np.full(len(parts[0]), np.uint64((kind + 1) * int(_MULT) % 2**64))
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


@dataclass
class BatchModel:
    """A ``PassageModel`` that scores many passages and all their windows at once, by sums up to each word."""

    model: PassageModel
    numbers: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        number = lambda w: self.numbers.setdefault(w, len(self.numbers) + 1)
        rows: dict[int, list] = {}
        self.pairs: dict[str, float] = {}
        for f, w in self.model.weights.items():
            p = f.split(" ")
            if "&" in p:
                self.pairs[f] = w
            elif len(p) == 3:
                kind, p = (APART, [p[0], p[2]]) if p[1] == "_" else (TRIPLE, p)
                rows.setdefault(kind, []).append((*map(number, p), w))
            elif len(p) == 2:
                kind, p = (FIRST, p[1:]) if p[0] == "^" else (PAIR, p)
                rows.setdefault(kind, []).append((*map(number, p), w))
            else:
                rows.setdefault(WORD, []).append((number(f), w))
        for k in (*HITS, YOU):
            number(k)
        keys, values = [np.empty(0, np.uint64)], [np.empty(0)]
        for kind, of in rows.items():
            cols = list(zip(*of, strict=True))
            keys.append(_mixed(kind, *(np.array(c, np.int64) for c in cols[:-1])))
            values.append(np.array(cols[-1], float))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.codes: dict[str, tuple[int, int]] = {}

    def code(self, word: str) -> tuple[int, int]:
        """The number of a word, and of its class or else of itself."""
        if (c := self.codes.get(word)) is None:
            n, kind = self.numbers.get(word, 0), kind_of(word)
            c = (n, self.numbers[kind] if kind else n)
            if len(self.codes) < 1_000_000:
                self.codes[word] = c
        return c

    def _look(self, kind: int, *parts: np.ndarray) -> np.ndarray:
        """Weights of the features, NaN where the model has none."""
        if not len(self.keys) or not len(parts[0]):
            return np.full(len(parts[0]), np.nan)
        h = _mixed(kind, *parts)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], np.nan)

    def scores(self, docs: list[list[list[str]]]) -> np.ndarray:
        """The score of each document: that of its worst passage or window; 0 without words."""
        out = np.zeros(len(docs))
        flat = [w for d in docs for p in d for w in p]
        if not flat:
            return out
        code = self.code
        w, k = np.array([code(x) for x in flat], np.int64).T
        sizes = np.array([len(p) for d in docs for p in d], np.int64)
        of_doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        end_at = np.cumsum(sizes)
        # passages, then the windows of the longer ones
        starts, ends, owner = [end_at - sizes], [end_at], [of_doc]
        for size, step in WINDOWS:
            long = np.flatnonzero(sizes > size)
            n = -(-(sizes[long] - size + step) // step)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(end_at[long] - sizes[long], n) + nth * step
            starts.append(s)
            ends.append(np.minimum(s + size, np.repeat(end_at[long], n)))
            owner.append(np.repeat(of_doc[long], n))
        s, e, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        total, count = np.zeros(len(s)), np.zeros(len(s))
        classes = np.array([self.numbers[h] for h in HITS])
        hit = np.isin(k, classes)
        kinds = np.where(hit, k, -1)

        def add(values: np.ndarray, short: int) -> None:
            """Features that begin at each word and reach ``short`` words further."""
            ok = ~np.isnan(values)
            sums = np.concatenate([[0.0], np.cumsum(np.where(ok, values, 0.0))])
            seen = np.concatenate([[0], np.cumsum(ok)])
            stop = np.maximum(e - short, s)
            nonlocal total, count
            total += sums[np.minimum(stop, len(values))] - sums[np.minimum(s, len(values))]
            count += seen[np.minimum(stop, len(values))] - seen[np.minimum(s, len(values))]

        add(self._look(WORD, w), 0)
        add(self._look(PAIR, w[:-1], w[1:]), 1)
        add(self._look(APART, w[:-2], w[2:]), 2)
        add(self._look(TRIPLE, w[:-2], w[1:-1], w[2:]), 2)
        first = self._look(FIRST, w[s])
        add(np.where(hit, self._look(WORD, np.maximum(kinds, 0)), np.nan), 0)
        beside = hit[:-1] | hit[1:]
        add(np.where(beside, self._look(PAIR, k[:-1], k[1:]), np.nan), 1)
        first_kind = np.where(hit[s], self._look(FIRST, k[s]), np.nan)
        for extra in (first, first_kind):
            total += np.nan_to_num(extra)
            count += ~np.isnan(extra)
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        within = lambda c: c[e] - c[s]
        you = within(upto(k == self.numbers[YOU])) > 0
        together = [(f"{name} & {YOU}", (within(upto(k == self.numbers[name])) > 0) & you) for name in HITS]
        for name, holds in (*together, (SEVERAL, within(upto(hit)) > 1)):
            if name in self.pairs:
                total += np.where(holds, self.pairs[name], 0.0)
                count += holds
        z = self.model.bias + total / np.sqrt(np.maximum(count, 1.0))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        np.maximum.at(out, owner, np.where(e > s, score, 0.0))
        return out


class _Sets:
    """Features of passages as flat arrays, and the pseudo-counts of each feature."""

    def __init__(self, rows: list[np.ndarray], known: np.ndarray):
        self.known, self.size, self.n = known, len(known), len(rows)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), self.lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the chosen rows, and for each the place of its row among them."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.owner] >= 0
        return self.flat[keep], place[self.owner[keep]]


def _log_odds(sets: _Sets, pos: np.ndarray, neg: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of each feature against the prior; what is seen once says little."""
    p = np.bincount(sets.flat, pos[sets.owner], sets.size) + sets.known
    n = np.bincount(sets.flat, neg[sets.owner], sets.size)
    r = np.log((p + 2 * prior) / (n + 2 * (1 - prior))) - np.log(prior / (1 - prior))
    r[np.abs(r) < 0.1] = 0.0
    return r


def _model(sets: _Sets, pos: np.ndarray, neg: np.ndarray, prior: float, steps: int, l2: float) -> tuple[np.ndarray, float]:
    """Logistic weights of features scaled by their log-odds; ``pos`` and ``neg`` weigh each passage."""
    r = _log_odds(sets, pos, neg, prior)
    rows = np.flatnonzero(pos + neg > 0)
    flat, owner = sets.take(rows)
    keep = r[flat] != 0
    flat, owner = flat[keep], owner[keep]
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1))
    share = pos[rows] / (pos[rows] + neg[rows])
    y = (share > 0.5).astype(float)
    weight = np.sqrt(pos[rows] + neg[rows]) * np.where(y > 0, 2.0, 1.0)
    weight /= max(weight.sum(), 1e-12)
    values = r[flat] * scale[owner]
    w, b = np.full(sets.size, 0.5), -2.0
    m, v, mb, vb = np.zeros(sets.size), np.zeros(sets.size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat] * values, len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw, gb = np.bincount(flat, g[owner] * values, sets.size) + l2 * (w - 0.5), g.sum() + 0.002 * (1 / (1 + np.exp(-b)) - BARE)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.03 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * r, b


def _scores(sets: _Sets, w: np.ndarray, b: float) -> np.ndarray:
    used = w[sets.flat] != 0
    owner = sets.owner[used]
    z = np.bincount(owner, w[sets.flat[used]], sets.n) / np.sqrt(np.maximum(np.bincount(owner, minlength=sets.n), 1)) + b
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: list[list[list[str]]], labels: list[float], raters: list[int] | None = None, rounds: int = 3, folds: int = 3, steps: int = 80, l2: float = 1e-4) -> PassageModel:
    """Train on documents (lists of passages) with the share of raters who found them of the kind, and their number.

    In each round every document is judged by a model of the other folds: of a
    positive document the passages found bad are the positive ones. Where none
    is, its worst passage counts half if two raters more found the document of
    the kind than not, or if the passage holds a word of the list; else the
    document is left out as a rater's mistake. Without any positive document
    every passage has the score of a bare one: the list alone accuses nobody.
    """
    share = np.array(labels, float)
    positive = share > 0.5
    if not positive.any():
        return PassageModel({}, float(np.log(BARE / (1 - BARE))))
    n_raters = np.ones(len(share)) if raters is None else np.array(raters, float)
    sure = n_raters * (2 * share - 1) >= 2 - 1e-9
    unique: dict[tuple[str, ...], int] = {}
    members = [sorted({unique.setdefault(tuple(p), len(unique)) for p in doc}) for doc in docs]
    named = [features(list(p)) for p in unique]
    listed = np.array([any(f in HITS for f in s) for s in named], bool)
    # what stands in a single document says nothing about others, unless that is a positive one
    in_docs: dict[str, int] = {}
    for ids, bad in zip(members, positive, strict=True):
        for f in set().union(*(named[i] for i in ids)):
            in_docs[f] = in_docs.get(f, 0) + (2 if bad else 1)
    index = {f: i for i, f in enumerate(PRIOR)}
    rows = [np.array([index.setdefault(f, len(index)) for f in s if in_docs[f] > 1 or f in PRIOR], np.int64) for s in named]
    known = np.zeros(len(index))
    known[: len(PRIOR)] = list(PRIOR.values())
    sets = _Sets(rows, known)
    prior = float(np.clip(positive.mean(), 0.01, 0.5)) if len(share) else 0.05
    # copies of a document stand in one fold, so that none is judged by its own copy
    fold_of = np.array([ids[0] % folds if ids else 0 for ids in members])
    by_fold = np.zeros((folds, len(rows)))  # each fold's view of a passage
    bar = np.zeros(folds)

    def weigh(docs_of: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        pos, neg = np.zeros(len(rows)), np.zeros(len(rows))
        for d in docs_of:
            ids = np.array(members[d], np.int64)
            if not len(ids):
                continue
            if first or not positive[d]:
                (pos if positive[d] else neg)[ids] += 1.0
                continue
            seen = by_fold[fold_of[d]][ids]
            bad = seen >= bar[fold_of[d]]
            worst = ids[np.argmax(seen)]
            if bad.any():
                pos[ids[bad]] += 1.0
                neg[ids[~bad]] += 0.5
            elif sure[d] or listed[worst]:
                pos[worst] += 0.5
        return pos, neg

    everyone = np.arange(len(members))
    for k in range(rounds):
        fresh, fresh_bar = by_fold.copy(), bar.copy()
        for f in range(folds):
            pos, neg = weigh(everyone[fold_of != f], k == 0)
            if k == 0:
                # all passages of positive documents count: no model yet, but features more at home there;
                # the bar is what hardly any passage of a negative document reaches
                fresh[f] = _scores(sets, _log_odds(sets, pos, neg, prior), 0.0)
                seen = np.flatnonzero(neg > 0)
                fresh_bar[f] = max(0.8, np.quantile(fresh[f][seen], 0.995)) if len(seen) else 0.8
            else:
                w, b = _model(sets, pos, neg, prior, steps, l2)
                fresh[f], fresh_bar[f] = _scores(sets, w, b), 0.5
        by_fold, bar = fresh, fresh_bar
    pos, neg = weigh(everyone, False)
    w, b = _model(sets, pos, neg, prior, 2 * steps, l2)
    return PassageModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(b))


class Scorer:
    """Scores of texts: restore, cut into passages, take the worst passage or window."""

    def __init__(self, counts: dict[str, int], common: dict[str, int], model: PassageModel):
        self.restorer, self.model = Restorer(counts, common), BatchModel(model)

    def texts(self, texts: list[str | None], words: int = 200_000) -> np.ndarray:
        """Scores of many texts, about ``words`` words at a time, which bounds the memory whatever their length."""
        parts, docs, size = [], [], 0
        for t in texts:
            docs.append(self.restorer.passages(t))
            size += sum(map(len, docs[-1]))
            if size >= words:
                parts.append(self.model.scores(docs))
                docs, size = [], 0
        return np.concatenate([*parts, self.model.scores(docs)])

    def text(self, text: str | None) -> float:
        return float(self.texts([text])[0])


def judged_documents(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, share, raters): of at most ``most`` documents the share of raters that named a kind, and their number.

    Null and unknown categories are no judgement. Beyond the bound the
    documents of the smallest hashes are taken.
    """
    named = labels.where(F.col("category").isin("none", *KINDS) & F.col("doc_id").isNotNull())
    share = named.groupBy("doc_id").agg(F.avg(F.col("category").isin(*KINDS).cast("double")).alias("share"), F.count(F.lit(1)).alias("raters"))
    return share.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_documents(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, share) of ``judged_documents``."""
    return judged_documents(labels, most).select("doc_id", "share")


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000) -> Scorer:
    """Language model from all texts, classifier from at most ``most`` labelled documents."""
    counts, common = fit_model(docs)
    sample = docs.select("doc_id", "text").join(judged_documents(labels, most), "doc_id").orderBy("doc_id")
    restorer = Restorer(counts, common)
    rows = [(restorer.passages(r.text), r.share, r.raters) for r in sample.toLocalIterator()]
    return Scorer(counts, common, train([p for p, _, _ in rows], [s for _, s, _ in rows], [n for _, _, n in rows]))


def score_documents(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``, from 0 to 1, one row per document. Texts without words score 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer)  # bounded by the numbers of n-grams, words and labelled documents
    out = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches):
        s = shared.value
        for batch in batches:
            scores = pa.array(s.texts(batch.column("text").to_pylist()), pa.float64())
            yield pa.record_batch([*(batch.column(k) for k in keep), scores], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, out)
