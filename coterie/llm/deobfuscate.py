"""Restoring disguised words: Viterbi decoding of character lattices.

A disguised word (a letter replaced by a look-alike, hidden by a mask, spaced
out, repeated or cut by invisible characters) is seen as the output of a noisy
channel. Each written character may stand for several letters or for none, at
a cost; a character language model of the corpus scores what the letters
spell. The restored word is the cheapest path. Words that are plain letters
have one path only and stand for themselves.
"""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.runtime import discard, materialise

ORDER = 4

#: Letters that a written character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¢": "c", "&": "a",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
}
#: Characters that may hide any letter.
MASKED = "*#•·"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: How many times rarer than the whole a part of a cut word is.
RARER = 4
#: Costs of the channel, in natural logarithms.
COST_LOOK_ALIKE, COST_MASK, COST_REPEAT, COST_KEEP_ODD, COST_DROP = 0.7, 3.3, 0.3, 6.0, 1.0

_ACCENT = regex.compile(r"[̀-ͯ]+")
_INVISIBLE = regex.compile(r"[\p{Cf}︀-️]+")
_L = r"[\p{L}\p{M}]"
_ODD = regex.escape("@$!|+€£(<¡¢&*#•·", special_only=False)
#: a spaced-out word, or a string of letters, digits and odd characters, or the end of a passage; all in linear time;
#: stars in a row are masks of a string and space nothing out
_TOKEN = regex.compile(
    r"(?P<spaced>(?<![\p{L}\p{M}\p{N}])(?:[\p{L}@$0134578]|\*(?!\*))\p{M}*+([ .\-_*/|~])(?:(?:[\p{L}@$0134578]|\*(?!\*))\p{M}*+\2)+(?:[\p{L}@$0134578]|\*(?!\*))\p{M}*+(?!\**+[\p{L}\p{N}]))"
    rf"|(?P<string>[\p{{L}}\p{{M}}\p{{N}}{_ODD}'’\-._]++)"
    r"|(?P<end>[?।;…\x1e]+)"
)
#: the last two characters of a word that is spaced out by spaces; begins with a space, which is found fast
_SPACED = regex.compile(r" [\p{L}@$0134578*]\p{M}*+ [\p{L}@$0134578*]\p{M}*+(?!\**+[\p{L}\p{N}])")
#: more than one character between two tokens
FAR = 9
_PLAIN = regex.compile(rf"{_L}++(?:['’]{_L}++)*+")
_LETTER = regex.compile(r"\p{L}")
_APART = regex.compile(r"[-._'’]+")
#: Latin letters beside look-alikes of other scripts
_MIXED = regex.compile(r"[a-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][a-z]")
_REPEAT = regex.compile(r"(\p{L})\1\1+")


def fold(text: str) -> str:
    """Compatibility forms, case and Latin accents folded; invisible characters taken out."""
    if text.isascii():
        return text.lower()
    text = _ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    return unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFKD", text.casefold())))


class CharModel:
    """Character n-grams with back-off: the log-probability of a letter after up to three others.

    ``^`` begins and ``$`` ends a word. ``counts`` holds n-grams of 1 to
    ``ORDER`` characters.
    """

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = max(1, sum(n for g, n in counts.items() if len(g) == 1))
        self.letters = max(1, sum(1 for g in counts if len(g) == 1))
        self.seen: dict[str, float] = {}

    def cost(self, context: str, char: str) -> float:
        key = context + char
        if (c := self.seen.get(key)) is None:
            c = self.seen[key] = -math.log(self._p(context, char))
        return c

    def _p(self, context: str, char: str) -> float:
        if not context:
            return (self.counts.get(char, 0) + 0.1) / (self.total + 0.1 * self.letters + 1)
        before, n = self.counts.get(context, 0), self.counts.get(context + char, 0)
        # interpolated with the shorter context, by how often this one was seen
        weight = before / (before + 5.0)
        return weight * min(n / before, 1.0) + (1 - weight) * self._p(context[1:], char) if before else self._p(context[1:], char)

    def word_cost(self, word: str) -> float:
        context, total = "^", 0.0
        for c in word + "$":
            total += self.cost(context, c)
            context = (context + c)[-(ORDER - 1) :]
        return total


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """Of each written character the letters it may stand for ('' for none), with costs."""
    out = []
    for i, c in enumerate(written):
        if c in MASKED:
            options = [(x, COST_MASK) for x in LETTERS] + [("", COST_MASK)]
        elif c in LOOK_ALIKES:
            options = [(x, COST_LOOK_ALIKE) for x in LOOK_ALIKES[c]]
            options.append((c, COST_KEEP_ODD if not c.isalpha() else 2.0))
        elif c.isalpha() or unicodedata.category(c)[0] == "M":
            options = [(c, 0.0)]
        elif c.isdigit():
            options = [(c, COST_KEEP_ODD)]
        else:
            options = [("", COST_DROP)]
        if i and c == written[i - 1] and (c.isalpha() or c in LOOK_ALIKES):
            options.append(("", COST_REPEAT))
        out.append(options)
    return out


def viterbi(written: str, model: CharModel, beam: int = 64) -> str:
    """The cheapest reading of a written word. Ties go to the reading that sorts first.

    With several masks there are very many states. A first pass over the
    ``beam`` best ones finds some reading; in the second pass states go that
    cannot get below its cost, which changes no result.
    """
    steps = lattice(written)
    left = [0.0]
    for options in reversed(steps):
        left.append(left[-1] + min(extra for _, extra in options))
    left = left[-2::-1]
    limit = math.inf
    if sum(c in MASKED for c in written) > 1:
        limit = _cheapest(steps, left, model, math.inf, beam)[0] + 1e-9
    return _cheapest(steps, left, model, limit, None)[1]


def _cheapest(steps: list[list[tuple[str, float]]], left: list[float], model: CharModel, limit: float, beam: int | None) -> tuple[float, str]:
    """Cost and text of the best path that costs no more than ``limit``; ``left`` is the least cost after each step."""
    states: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for options, rest in zip(steps, left, strict=True):
        nxt: dict[str, tuple[float, str]] = {}
        for context, (cost, text) in states.items():
            for letter, extra in options:
                if letter:
                    into, entry = (context + letter)[-(ORDER - 1) :], (cost + extra + model.cost(context, letter), text + letter)
                else:
                    into, entry = context, (cost + extra, text)
                if entry[0] + rest <= limit and (into not in nxt or entry < nxt[into]):
                    nxt[into] = entry
        states = nxt if beam is None else dict(sorted(nxt.items(), key=lambda x: x[1])[:beam])
    return min((cost + model.cost(context, "$"), text) for context, (cost, text) in states.items())


def _hidden(c: str) -> bool:
    """Whether a written character that is no letter may stand for one."""
    return c in MASKED or (c in LOOK_ALIKES and not c.isalpha())


class Restorer:
    """Restored passages of texts, as lists of words."""

    def __init__(self, counts: dict[str, int], common: dict[str, int], remember: int = 50_000, longest: int = 48):
        self.model, self.common, self.remember, self.longest = CharModel(counts), common, remember, longest
        self.known: dict[str, str] = {}
        self.strings: dict[str, tuple[list[str], bool]] = {}
        self.chunks: dict[str, tuple[list[tuple[list[str], bool, int]], int]] = {}
        self.alike: dict[tuple[int, str], list[str]] = {}
        for w in common:
            self.alike.setdefault((len(w), w[0]), []).append(w)

    def same_length(self, written: str) -> str | None:
        """The likeliest common word that has a letter for each written character, if some are masks or look-alikes."""
        if len(written) > self.longest or not any(_hidden(c) for c in written):
            return None
        options = [LETTERS if c in MASKED else LOOK_ALIKES.get(c, "") + (c if c.isalpha() else "") for c in written]
        if not all(options):
            return None
        fits = regex.compile("".join(f"[{o}]" for o in options)).fullmatch
        found = [w for first in options[0] for w in self.alike.get((len(written), first), ()) if fits(w)]
        return min(found, key=lambda w: (self.model.word_cost(w), w), default=None)

    def word(self, written: str) -> str:
        out = self.known.get(written)
        if out is None:
            out = self.same_length(written)
        if out is None:
            # a disguised word is short; longer strings are numbers, addresses or noise and are read in parts
            parts = [written[i : i + self.longest] for i in range(0, len(written), self.longest)]
            each = {p: viterbi(p, self.model) for p in set(parts)}
            out = "".join(each[p] for p in parts)
        if written not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[written] = out
        return out

    def joined(self, a: str, b: str) -> bool:
        """Whether two neighbours read better as one word: the space between them has the cost of a dropped character.

        The whole must be a known word, far more frequent than the rarer part
        (cut words recur, too), and cheaper under the character model.
        """
        whole = self.common.get(a + b, 0)
        if not whole or len(a) + len(b) > self.longest or RARER * min(self.common.get(a, 0), self.common.get(b, 0)) >= whole:
            return False
        return self.model.word_cost(a + b) + COST_DROP < self.model.word_cost(a) + self.model.word_cost(b)

    def spelled(self, letters: str) -> list[str]:
        """Words of spaced-out letters; a one-letter word before them may have come along."""
        whole = self.word(letters)
        if whole not in self.common and (rest := self.word(letters[1:])) in self.common:
            return [letters[0], rest]
        return [whole]

    def signs(self, string: str) -> list[str]:
        """A common word written without any letter. Numbers, prices and mere punctuation or masks are none."""
        if sum(c in LOOK_ALIKES and not c.isdigit() for c in string) < 2 or len(set(string)) < 2:
            return []
        word = self.word(string)
        return [word] if len(word) > 1 and word in self.common else []

    def read(self, string: str) -> list[str]:
        """Words of a string without white space inside."""
        if _PLAIN.fullmatch(string):
            mixed = not string.isascii() and _MIXED.search(string)
            return [self.word(string) if mixed or _REPEAT.search(string) else string]
        letters, hidden = len(_LETTER.findall(string)), sum(map(_hidden, string))
        if not letters:
            return self.signs(string)
        if letters + hidden < 2 or (letters + hidden) * 3 < len(string):
            return []
        parts = [p for p in _APART.split(string) if p]
        if all(_PLAIN.fullmatch(p) for p in parts):
            whole = "".join(parts)
            if whole in self.common and not all(p in self.common and len(p) > 1 for p in parts):
                return [whole]
            return [self.word(p) if _REPEAT.search(p) else p for p in parts]
        return [self.word(string)]

    def string(self, written: str) -> tuple[list[str], bool]:
        """Words of a string, and whether it ends a passage. Short ones are remembered: few are ever new."""
        if (got := self.strings.get(written)) is None:
            core = written.rstrip(".!-_'’")
            got = self.read(core.lstrip(".-_'’")), len(core) < len(written) and written[-1] in ".!"
            if len(written) <= self.longest:
                if len(self.strings) >= self.remember:
                    self.strings.clear()
                self.strings[written] = got
        return got

    def tokens(self, text: str):
        """(words, whether the passage ends, start, end) of each token."""
        strings = self.strings
        for m in _TOKEN.finditer(text):
            kind, s = m.lastgroup, m.group()
            if kind == "string":
                words, ends = strings.get(s) or self.string(s)
            elif kind == "end":
                words, ends = [], True
            else:
                run = regex.sub(r"[ .\-_/|~]", "", s)
                letters, hidden = len(_LETTER.findall(run)), sum(map(_hidden, run))
                words, ends = (self.signs(run) if not letters else self.spelled(run) if letters + hidden > 2 else []), False
            yield words, ends, m.start(), m.end()

    def chunk(self, written: str) -> tuple[list[tuple[list[str], bool, int]], int]:
        """The tokens of a string without spaces, each with what lies between it and the one before, and what lies behind the last."""
        if (got := self.chunks.get(written)) is None:
            found, last = [], 0
            for words, ends, start, end in self.tokens(written):
                found.append((words, ends, start - last))
                last = end
            got = found, len(written) - last
            if len(written) <= self.longest:
                if len(self.chunks) >= self.remember:
                    self.chunks.clear()
                self.chunks[written] = got
        return got

    def passages(self, text: str | None) -> list[list[str]]:
        """Passages of a text as restored words. Null, empty and blank texts have none.

        Texts are read chunk by chunk between spaces, most of which were seen
        before. Only words that are spaced out go across spaces.
        """
        common, chunks = self.common, self.chunks
        out: list[list[str]] = []
        for part in fold(_lines(text)).split("\x1e") if text else ():
            now: list[str] = []
            gap = FAR  # what lies between this token and the one before, if that may be the first half of a word
            pieces = [part] if _SPACED.search(part) else part.split(" ")
            for piece in pieces:
                tokens, behind = chunks.get(piece) or self.chunk(piece)
                for words, ends, before in tokens:
                    if gap + before == 1 and len(words) == 1 and now and now[-1] + words[0] in common and self.joined(now[-1], words[0]):
                        now[-1] += words[0]
                    else:
                        now += words
                    gap = 0
                    if ends:
                        gap = FAR
                        if now:
                            out.append(now)
                            now = []
                gap += behind + 1
            if now:
                out.append(now)
        return out


def _lines(text: str) -> str:
    """Line ends become ends of passages, but for those inside a sentence."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.strip()
        if out:
            out.append(" " if line and line[0].islower() and out[-1][-1:].isalpha() else "\x1e")
        out.append(line)
    return "".join(out)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the plain words of all texts, counted in each batch before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()
        plain = regex.compile(rf"(?<![\p{{N}}{_ODD}\-.]){_L}+(?![\p{{N}}{_ODD}\-])")
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(w for w in plain.findall(fold(text)) if len(w) <= 40)
            if len(counts) > 200_000:  # what was counted so far goes on; the shuffle adds it up
                yield pa.record_batch([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=schema)
                counts.clear()
        if counts:
            yield pa.record_batch([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_model(docs: DataFrame, grams: int = 300_000, words: int = 300_000, least: int = 3) -> tuple[dict[str, int], dict[str, int]]:
    """The n-gram counts and the counts of the common words of all texts.

    Counting covers all texts. Of the result the model keeps the ``grams``
    most frequent n-grams and ``words`` most frequent words seen ``least``
    times or more, a size bound for what is sent to the tasks; rarer n-grams
    are smoothed from shorter ones.
    """
    spark = docs.sparkSession
    counted, path = materialise(word_counts(docs).where(F.col("n") >= least), "words")
    common = {r.word: r.n for r in counted.where(F.length("word") > 1).orderBy(F.desc("n"), "word").limit(words).collect()}
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    spans = F.filter(F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i, k=k: F.when(i + (k - 1) <= F.length("w"), F.substring("w", i, F.lit(k)))) for k in range(1, ORDER + 1)))), lambda g: g.isNotNull())
    each = counted.select(marked.alias("w"), "n").select(F.explode(spans).alias("gram"), "n")
    kept = each.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(grams)
    counts = {r.gram: r.n for r in kept.collect()}
    discard(spark, path)
    return counts, common
