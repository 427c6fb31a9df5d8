"""Held-out passages inside a corpus, by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a q-gram: eight make one machine word. Letters beyond ASCII are two or three bytes each.
Q = 8
#: Words that must stand together, and words among them that may be changed, dropped or added.
WORDS, EDITS = 15, 2
#: Longest word an edit can put in, in bytes; with EDITS it bounds how far an alignment leaves its diagonal.
LONGEST = 20
#: A run of matching words after an edit counts from so many bytes on.
_RUN = 6
#: Characters of text that are searched at once, and hits of grams that are held at once.
AT_ONCE, HITS = 200_000, 1_000_000
#: A gram of more passages than this is left out of those whose bound is met without it.
COMMON = 32
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_OTHER = re.compile(r"[^a-z0-9]+")
_OTHER_ANY = re.compile(r"[\W_]+")
#: Scripts that don't part words by spaces: each of these letters is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str) -> str:
    """A text without markup, in one character form; accents are separate marks."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


def squeezed(text: str) -> str:
    """The letters and digits of a text, of any script, in lower case, without markup, accents, spaces and line breaks."""
    text = _plain(text).casefold()
    return (_OTHER if text.isascii() else _OTHER_ANY).sub("", text)


def words_of(text: str) -> list[str]:
    """The words of a text, each squeezed."""
    text = _plain(text)
    return [w for w in map(squeezed, (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()) if w]


@dataclass
class Passage:
    numbers: list[int]
    words: list[bytes]
    starts: list[int]
    text: bytes
    needed: int


def _least(words: list[bytes], starts: list[int], window: int, edits: int, left_out: np.ndarray | None = None) -> int:
    """The q-gram lemma: an edited word of length l destroys at most l + q - 1 of a window's grams. The least number that stays in any window, without those left out."""
    least = None
    for i in range(len(words) - window + 1):
        lengths = [len(w) for w in words[i : i + window]]
        stay = sum(lengths) - Q + 1 - sum(n + Q - 1 for n in sorted(lengths)[-edits:]) if edits else sum(lengths) - Q + 1
        if left_out is not None:
            stay -= int(left_out[starts[i] : max(starts[i], starts[i] + sum(lengths) - Q + 1)].sum())
        least = stay if least is None else min(least, stay)
    return least


def _passage(words: list[str], numbers: list[int], window: int, edits: int) -> Passage:
    parts = [w.encode() for w in words]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in parts])))[:-1].tolist()
    return Passage(numbers, parts, starts, b"".join(parts), max(1, _least(parts, starts, min(window, len(parts)), edits)))


class PassageIndex:
    """Sorted q-grams of a block of passages with their places. Passages of equal words are one entry with several numbers."""

    def __init__(self, passages: Sequence[tuple[int, str | None]], words: int = WORDS, edits: int = EDITS) -> None:
        self.words, self.edits = words, edits
        equal: dict[tuple[str, ...], list[int]] = {}
        for n, t in passages:
            if t is not None and (w := tuple(words_of(t))):
                equal.setdefault(w, []).append(n)
        self.passages = [_passage(list(w), n, words, edits) for w, n in equal.items()]
        # A passage shorter than a q-gram is looked for as a whole, between the bounds of words.
        self.short = [(b" " + b" ".join(p.words) + b" ", p) for p in self.passages if len(p.text) < Q]
        grams, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, p in enumerate(self.passages):
            g = _grams(p.text)
            grams.append(g)
            owner.append(np.full(len(g), k, np.int64))
            place.append(np.arange(len(g), dtype=np.int64))
        flat, owners, places = map(np.concatenate, (grams, owner, place))
        keep = self._without_common(flat, owners)
        flat, owners, places = flat[keep], owners[keep], places[keep]
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owners[order], places[order]
        self.gram, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.gram)] = True
        self.needed = np.array([p.needed for p in self.passages], np.int64)

    def _without_common(self, flat: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Which grams to keep: a gram of many passages is left out wherever the lemma still asks for another gram of each window, which loses nothing."""
        keep = np.ones(len(flat), bool)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        common = count[inverse] > COMMON
        for k in np.unique(owners[common]).tolist():
            p, (low, high) = self.passages[k], np.searchsorted(owners, [k, k + 1])
            needed = _least(p.words, p.starts, min(self.words, len(p.words)), self.edits, common[low:high])
            if needed >= 1:
                keep[low:high] = ~common[low:high]
                p.needed = needed
        return keep

    def search(self, texts: Sequence[str | None]) -> list[tuple[int, int]]:
        """Pairs (position of the text, passage number). Texts are taken some at a time, so that hits of few are held at once."""
        found: list[tuple[int, int]] = []
        begin = length = 0
        for k, t in enumerate(texts):
            length += len(t or "")
            if length >= AT_ONCE or k == len(texts) - 1:
                found += [(begin + d, n) for d, n in self._some(texts[begin : k + 1])]
                begin, length = k + 1, 0
        return found

    def _some(self, texts: Sequence[str | None]) -> list[tuple[int, int]]:
        clean = [squeezed(t).encode() if t else b"" for t in texts]
        found = []
        if self.short:
            spaced = [b" " + " ".join(words_of(t)).encode() + b" " if t else b"" for t in texts]
            found = [(d, n) for form, p in self.short for d, t in enumerate(spaced) if form in t for n in p.numbers]
        if not len(self.gram):
            return found
        joined = (b"\0" * Q).join(clean)
        begins = np.cumsum([0] + [len(t) + Q for t in clean])
        codes = _grams(joined)
        at = np.flatnonzero(self.seen[_slot(codes)])
        where = np.searchsorted(self.gram, codes[at])
        where[where == len(self.gram)] = 0
        hit = self.gram[where] == codes[at]
        at, where = at[hit], where[hit]
        if not len(at):
            return found
        n = self.first[where + 1] - self.first[where]
        width, many = self.edits * LONGEST, len(self.passages)
        # Bands are numbered from one that no hit of the texts lies before.
        shift = -(int(self.place.max(initial=0)) // width) - 2
        bands = int(begins[-1]) // width - shift + 3
        doc = np.searchsorted(begins, at, side="right") - 1

        def chunk(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Text, passage and diagonal of each hit of some places."""
            source = np.repeat(np.arange(low, high), n[low:high])
            entry = np.repeat(self.first[where[low:high]], n[low:high]) + np.arange(len(source)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
            return doc[source], self.owner[entry], at[source] - begins[doc[source]] - self.place[entry]

        cuts = [0]
        for stop in np.flatnonzero(np.diff(np.cumsum(n) // HITS)).tolist():
            cuts.append(stop + 1)
        spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(at)]) if a < b]
        # Each hit lies in two overlapping bands of twice the width, so an alignment that drifts by one width is in one of them.
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low, high in spans:
            d, owner, diagonal = chunk(low, high)
            key = (d * many + owner) * bands + diagonal // width - shift
            new, times = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, times])).astype(np.int64)
        keys = keys[counts >= self.needed[keys // bands % many]]
        if not len(keys):
            return found
        lines: dict[int, set[int]] = {}
        for low, high in spans:
            d, owner, diagonal = chunk(low, high)
            pair = d * many + owner
            key = pair * bands + diagonal // width - shift
            for k in (key, key - 1):
                at_ = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                chosen = keys[at_] == k
                both = np.unique(np.stack([pair[chosen], diagonal[chosen]], 1), axis=0)
                for x, line in both.tolist():
                    lines.setdefault(x, set()).add(line)
        for x, diagonals in lines.items():
            d, k = divmod(x, many)
            if self._stands(self.passages[k], clean[d], diagonals):
                found += [(d, number) for number in self.passages[k].numbers]
        return found

    def _stands(self, p: Passage, text: bytes, diagonals: set[int]) -> bool:
        """Whether a window of the passage is aligned with at most ``edits`` word edits, beginning from each run of equal words on the diagonals."""
        wanted = min(self.words, len(p.words))
        begun: set[tuple[int, int]] = set()
        for line in diagonals:
            before = False
            for i, w in enumerate(p.words):
                now = line + p.starts[i] >= 0 and text.startswith(w, line + p.starts[i])
                if now and not before:
                    begun.add((i, line + p.starts[i]))
                before = now
        return any(self._reach(p, text, i, at, wanted) for i, at in begun)

    def _reach(self, p: Passage, text: bytes, start: int, at: int, wanted: int) -> bool:
        words, m = p.words, len(p.words)
        stack, tried = [(start, at, self.edits)], set()
        while stack:
            i, place, left = stack.pop()
            run = 0
            while i < m and text.startswith(words[i], place):
                place += len(words[i])
                run += len(words[i])
                i += 1
            # A whole short passage may also lose words at its ends.
            spare = left if m <= self.words else 0
            if i - start + min(spare, start + m - i) >= wanted and (run >= _RUN or left == self.edits or i == m):
                return True
            if not left or i >= m:
                continue
            for skipped in range(min(left, m - i) + 1):
                if i + skipped >= m:
                    continue
                follow = words[i + skipped]
                for gap in range(left * LONGEST + 1):
                    cost = max(skipped, -(-gap // LONGEST))
                    if 0 < cost <= left and text.startswith(follow, place + gap):
                        state = (i + skipped, place + gap, left - cost)
                        if state not in tried:
                            tried.add(state)
                            stack.append(state)
        return False


def _grams(data: bytes) -> np.ndarray:
    """The q-gram at each place as one number, without copying."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,))


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


def leaks(documents: DataFrame, passages: DataFrame, words: int = WORDS, edits: int = EDITS, block: int = 20_000) -> DataFrame:
    """Pairs (doc_id, passage_id): the document contains the whole passage or ``words`` consecutive words of it with up to ``edits`` words changed, dropped or added.

    Case, punctuation, markup, accents, spaces and line breaks, also inside words, don't count; letters and digits of
    any script are compared, and where a script doesn't part words by spaces each letter is a word. The run's first and
    last word must be equal ones, so shorter runs don't count as longer ones with edits. A passage of fewer than eight
    bytes must stand between the bounds of words. Null and empty texts, on either side, are in no pair; a repeated
    document or passage row gives each pair once; texts are taken whole.

    The passages are a stated query set, read in blocks of at most ``block``: the index of a block is built once, sent
    to the executors and searched against all documents, so neither the number of passages nor the corpus is limited.
    The corpus is read once for each block and never shuffled. A gram of very many passages is left out where the lemma
    allows it, equal passages are one entry, and hits are counted some at a time, so that what a task holds is bounded
    by its text and the pairs of texts and passages that share grams.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, passage_id bigint"
    queries = passages.select("passage_id", "text").where("passage_id is not null and text is not null").distinct().orderBy("passage_id")
    results = documents.select("doc_id", F.lit(None).cast("bigint").alias("passage_id")).limit(0)
    part: list[tuple[int, str]] = []

    def searched(part: list[tuple[int, str]]) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(PassageIndex(part, words, edits))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                pairs = sorted(set(index.search(b.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([n for _, n in pairs], pa.int64())], ["doc_id", "passage_id"])

        return documents.select("doc_id", "text").mapInArrow(scan, schema)

    for row in queries.toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == block:
            results, part = results.unionByName(searched(part)), []
    if part:
        results = results.unionByName(searched(part))
    return results.distinct()
