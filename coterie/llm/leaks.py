"""Test passages inside training texts, by spaced seeds.

A spaced seed is a mask over consecutive words that ignores the words at its
zeros. The hashes of all windows of the test items under a few fixed masks are
looked up for all windows of the corpus; around each hit the two word
sequences are compared position by position, substitutions allowed. Any run of
as many equal words as the masks are long is a hit under every mask, and
passages with a substituted word at a mask's zero are hits as well.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.runtime import materialise

#: Masks of 8 words; each asks for five, at distances the other does not repeat.
MASKS = ("10011101", "11010011")

FOUND = "doc_id bigint, item_id bigint, longest int, overlap int, matched int"
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters or digits without case, accents, width forms and invisible format characters."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        # folding can bring back marks, as for a capital I with a dot
        return _WORD.findall(_INVISIBLE.sub("", unicodedata.normalize("NFKD", text.casefold())))
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """Test items as word numbers, with the seeds of all their windows."""

    ids: list[int]
    sequences: list[np.ndarray]
    numbers: dict[str, int]
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per mask: sorted hashes, their items, their positions


def _hashes(numbers: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of the mask's length; 0 where a word it needs is in no item."""
    n = len(numbers) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.full(n, 1469598103934665603, np.uint64), np.ones(n, bool)
    for i, bit in enumerate(mask):
        if bit == "1":
            part = numbers[i : i + n]
            known &= part > 0
            h = (h ^ part.astype(np.uint64)) * _MULT
            h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def index_items(rows: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS) -> Items:
    numbers: dict[str, int] = {}
    ids, sequences = [], []
    for item, text in rows:
        ids.append(item)
        sequences.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words(text)], np.int64))
    seeds = []
    for mask in masks:
        h = [_hashes(s, mask) for s in sequences]
        item, pos = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h] or [np.empty(0, np.int64)])
        all_h = np.concatenate(h or [np.empty(0, np.uint64)])
        order = np.argsort(all_h, kind="stable")
        seeds.append((all_h[order], item[order], pos[order]))
    return Items(ids, sequences, numbers, seeds)


def _overlap(doc: np.ndarray, item: np.ndarray, at: int, pos: int, span: int, misses: int) -> tuple[tuple[int, int, int], int]:
    """Around a hit: longest run of equal words, words of the overlap and equal words in it; then its end in the document.

    The overlap is extended to both sides until more than ``misses``
    substitutions follow each other without an equal word between.
    """
    shift = at - pos
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    left, gap = pos - lo, 0
    for i in range(pos - lo - 1, -1, -1):
        gap = 0 if same[i] else gap + 1
        if gap > misses:
            break
        left = i if same[i] else left
    right, gap = pos - lo + span, 0
    for i in range(pos - lo + span, len(same)):
        gap = 0 if same[i] else gap + 1
        if gap > misses:
            break
        right = i + 1 if same[i] else right
    part = same[left:right]
    breaks = np.flatnonzero(np.concatenate([[True], ~part, [True]]))
    return (int(np.diff(breaks).max()) - 1, len(part), int(part.sum())), right + lo + shift


def matches(text: str | None, items: Items, masks: tuple[str, ...], misses: int) -> dict[int, tuple[int, int, int]]:
    """Best overlap of each item with hits in the text."""
    number = items.numbers
    doc = np.array([number.get(w, 0) for w in words(text)], np.int64)
    best: dict[int, tuple[int, int, int]] = {}
    covered: dict[tuple[int, int], int] = {}  # of an item and diagonal: where its last overlap ends
    for mask, (hashes, item, pos) in zip(masks, items.seeds, strict=True):
        covered.clear()
        h = _hashes(doc, mask)
        if not len(h) or not len(hashes):
            continue
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        for at in np.flatnonzero((hi > lo) & (h > 0)):
            for k in range(lo[at], hi[at]):
                it, p = int(item[k]), int(pos[k])
                seq = items.sequences[it]
                window, other = doc[at : at + len(mask)], seq[p : p + len(mask)]
                if any(bit == "1" and a != b for bit, a, b in zip(mask, window, other, strict=True)):
                    continue
                diagonal = (it, int(at) - p)
                if at + len(mask) <= covered.get(diagonal, 0):
                    continue  # inside an overlap that is already known
                found, covered[diagonal] = _overlap(doc, seq, int(at), p, len(mask), misses)
                if it not in best or found > best[it]:
                    best[it] = found
    out: dict[int, tuple[int, int, int]] = {}
    for it, v in best.items():
        out[items.ids[it]] = max(v, out.get(items.ids[it], v))
    return out


def _word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64)


def _seeds(text: str | None, masks: tuple[str, ...]) -> np.ndarray:
    """The distinct seeds of a text: hashes of the words that each mask asks for, in all its windows."""
    h = _word_hashes(text)
    out = []
    for k, mask in enumerate(masks):
        n = len(h) - len(mask) + 1
        if n > 0:
            seed = np.full(n, (k + 1) * 1469598103934665603 % 2**64, np.uint64)
            for i, bit in enumerate(mask):
                if bit == "1":
                    seed = (seed ^ h[i : i + n]) * _MULT
                    seed ^= seed >> np.uint64(29)
            out.append(seed)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _seed_rows(rows: DataFrame, key: str, masks: tuple[str, ...], keep: Broadcast | None = None) -> DataFrame:
    """(key, seed) of every text's distinct seeds; with ``keep``, a bit field by the low bits of a seed, of those that may be wanted."""

    def run(batches):
        schema = pa.schema([(key, pa.int64()), ("seed", pa.int64())])
        bits = None if keep is None else keep.value
        for batch in batches:
            for i, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
                seeds = _seeds(text, masks)
                if bits is not None and len(seeds):
                    at = seeds & np.uint64(len(bits) * 8 - 1)
                    seeds = seeds[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if len(seeds):
                    yield pa.record_batch([pa.array(np.full(len(seeds), i, np.int64)), pa.array(seeds.view(np.int64))], schema=schema)

    return rows.select(key, "text").mapInArrow(run, f"{key} bigint, seed bigint")


def _wanted(seeds: DataFrame, size: int = 1 << 27) -> np.ndarray:
    """The seeds as a bit field of ``size`` bits, united from those of the partitions, block by block of 1 MB."""
    block = 1 << 23

    def run(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(size - 1)
            for b in np.unique(at // np.uint64(block)).tolist():
                field = bits.setdefault(b, np.zeros(block // 8, np.uint8))
                inside = at[at // np.uint64(block) == b] % np.uint64(block)
                np.bitwise_or.at(field, (inside >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (inside & np.uint64(7)).astype(np.uint8)))
        for b, field in bits.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([field.tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in seeds.select("seed").mapInArrow(run, "block int, bits binary").toLocalIterator():
        part = slice(r.block * block // 8, (r.block + 1) * block // 8)
        out[part] |= np.frombuffer(r.bits, np.uint8)
    return out


def _by_join(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], misses: int) -> DataFrame:
    """(doc_id, item_id, longest, overlap, matched) by a join of seeds, for items that no task could hold.

    Seeds of documents that no item can have are dropped by a bit field of
    fixed size before the shuffle. Each document and item that share a seed are
    brought together once and compared as in ``matches``.
    """
    spark = docs.sparkSession
    of_items, _ = materialise(_seed_rows(items, "item_id", masks), "seeds")
    keep = spark.sparkContext.broadcast(_wanted(of_items))  # 16 MB
    pairs, _ = materialise(_seed_rows(docs, "doc_id", masks, keep).join(of_items, "seed").select("doc_id", "item_id").distinct(), "pairs")
    met = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("overlap", pa.int32()), ("matched", pa.int32())])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")]
            found = [(d, i, *v) for d, i, text, item in zip(*cols, strict=True) for v in matches(text, index_items([(i, item)], masks), masks, misses).values()]
            if found:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return met.mapInArrow(run, FOUND)


def leaked_items(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, misses: int = 1, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, longest, overlap, matched) of every document and item with a seed hit.

    ``longest`` is the longest run of equal words of the best overlap,
    ``overlap`` its length with substitutions and ``matched`` the equal words
    in it. Items of at most ``block_words`` words go to the tasks, and the
    corpus is read once; more items meet the corpus in a join of seeds. Both
    ways compare every item with every document and give the same rows. Items
    shorter than a mask have no window and no case; null and empty texts match
    nothing. Of repeated documents and of items with one id the best overlap
    is kept.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    # a word has a character and a gap at least
    size = items.agg(F.sum(F.length("text").cast("bigint"))).head()[0] or 0
    if size // 2 > block_words:
        parts = _by_join(docs, items, masks, misses)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(index_items([tuple(r) for r in items.orderBy("item_id", "text").collect()], masks))  # bounded by ``block_words``
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("overlap", pa.int32()), ("matched", pa.int32())])

        def run(batches):
            index = shared.value
            for batch in batches:
                found = [(d, i, *v) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, v in matches(text, index, masks, misses).items()]
                if found:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        parts = docs.select("doc_id", "text").mapInArrow(run, FOUND)
    # a document or an item may come more than once
    best = F.max(F.struct("longest", "overlap", "matched")).alias("best")
    return parts.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
