"""Held-out passages that leaked into a corpus: who holds what, and the corpus without it.

The word n-grams of the items make a hash set that every task gets; training token windows are
scanned against it; hits are verified by aligning the item's own words with the text around the
hit. What is a turn of phrase and what a passage is decided over all items at once; then they
go in blocks of bounded size, which changes no result. Documents are scanned where they lie,
without a shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.session import spread

#: Words of a seed window.
SEED = 5
#: Words of an item that a document must hold, matched words that must stand against each edit, and an edit's cost in words.
LEAST_WORDS, WORDS_AN_EDIT, EDIT = 25, 5, 1.5
#: What an alignment of that many words scores with that many edits.
LEAST_SCORE = LEAST_WORDS * (1 - EDIT / WORDS_AN_EDIT)
#: Words on either side that are aligned besides what the item can fill.
MARGIN = 16
#: Words of all items in a block; bounds what is shipped to a task.
BLOCK_WORDS = 2_000_000

_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>|!?\]\([^()\s]*\)")
_TOKEN = re.compile(r"\S+")
#: Characters of scripts that put no spaces between words: each counts as a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_STOP = re.compile(r"(?<=[.!?。！？])\s+")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтвнјѕԁԛԝһАЕОРСУХІКМТВНαορνικτ", "aeopcyxikmtbhjsdqwhaeopcyxikmtbhaopvikt")


class WordReader:
    """Normalised words of a text, and the spans of their tokens; tokens are cached."""

    def __init__(self, cache: int = 500_000, longest: int = 64) -> None:
        self.cache, self.longest, self.seen = cache, longest, {}

    def token(self, token: str) -> tuple[str, ...]:
        got = self.seen.get(token)
        if got is None:
            text = html.unescape(token) if "&" in token else token
            got = tuple(_WORD.findall(_plain(text)))
            if len(token) <= self.longest:
                if len(self.seen) >= self.cache:
                    self.seen.clear()
                self.seen[token] = got
        return got

    @staticmethod
    def _bare(text: str) -> str:
        """Markup blanked out, every other character in its place."""
        return _TAG.sub(lambda m: " " * len(m[0]), text) if "<" in text or "](" in text else text

    def words(self, text: str) -> list[str]:
        """Normalised words. Markup is skipped."""
        text = self._bare(text)
        if text.isascii() and "&" not in text:
            return _ASCII_WORD.findall(text.lower().replace("'", ""))
        token = self.token
        return [w for t in text.split() for w in token(t)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """For each word of ``words`` its span in the text: that of its token, of its own characters where a token holds many words."""
        out = []
        for m in _TOKEN.finditer(self._bare(text)):
            n = len(self.token(m[0]))
            fine = _word_spans(m[0]) if n > 1 and "&" not in m[0] else []
            out += [(m.start() + a, m.start() + b) for a, b in fine] if len(fine) == n else [m.span()] * n
        return out


def _plain(text: str) -> str:
    """Letters without accents, case and look-alikes; apostrophes dropped."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        like = text.translate(LOOKALIKES)
        # A word wholly of look-alikes is Latin only if no other letter is in it.
        if re.search("[A-Za-z]", text) or like.isascii():
            text = like
    return text.casefold().replace("'", "").replace("\u2019", "")


def _word_spans(token: str) -> list[tuple[int, int]]:
    """Spans of a token's words in it, by what each character becomes."""
    parts = [_plain(c) for c in token]
    at = [i for i, p in enumerate(parts) for _ in p]
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(parts))]


def own_words(items: list[tuple[int, list[list[str]]]]) -> list[tuple[tuple[int, ...], list[str]]]:
    """``(item ids, words)`` of each distinct text of ``(item id, sentences of words)`` without its stock sentences.

    Items of equal words are one entry, and an id with several texts stands in several. A
    sentence is stock for a text if another one holds it that is no copy of it: that shares less
    than half of the longer one's words in whole sentences, and is not contained in it or the
    other way round. Sentences on end that are stock but make up ``LEAST_WORDS`` together are a
    passage, which is each holder's own.
    """
    ids: dict[tuple, set[int]] = {}
    for i, sentences in items:
        ids.setdefault(tuple(tuple(w) for w in sentences if len(w)), set()).add(i)
    texts = sorted(ids, key=lambda p: (min(ids[p]), p))
    whole, size = [set(p) for p in texts], [sum(map(len, set(p))) for p in texts]
    holders: dict[tuple, list[int]] = {}
    for k, sentences in enumerate(whole):
        for s in sentences:
            holders.setdefault(s, []).append(k)
    known: dict[tuple[int, int], bool] = {}

    def copies(a: int, b: int) -> bool:
        pair = (min(a, b), max(a, b))
        if pair not in known:
            shared = sum(len(s) for s in whole[a] & whole[b])
            known[pair] = 2 * shared >= max(size[a], size[b]) or shared == min(size[a], size[b])
        return known[pair]

    own: dict[tuple[str, ...], set[int]] = {}
    for k, p in enumerate(texts):
        stock = {s for s in whole[k] if not all(h == k or copies(k, h) for h in holders[s])}
        kept: list[str] = []
        for is_stock, run in groupby(p, key=stock.__contains__):
            words = [w for s in run for w in s]
            if not is_stock or len(words) >= LEAST_WORDS:
                kept += words
        own.setdefault(tuple(kept), set()).update(ids[p])
    return [(tuple(sorted(who)), list(words)) for words, who in own.items() if len(words) >= LEAST_WORDS]


def align(item: np.ndarray, text: np.ndarray, edit: float = EDIT) -> tuple[float, int, int, int]:
    """Best local alignment of word ids: ``(score, matched words, start, end)`` in the text.

    A matched word scores 1, a changed, missing or added one costs ``edit``.
    """
    n, m = len(item), len(text)
    h = np.zeros((n + 1, m + 1))
    slope = edit * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1] - edit, 0)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + np.where(text == item[i - 1], 1.0, -edit))
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = (int(x) for x in np.unravel_index(np.argmax(h), h.shape))
    score, end, matched, start = float(h[i, j]), j, 0, j
    while i and j and h[i, j] > 1e-9:
        same = item[i - 1] == text[j - 1]
        if abs(h[i, j] - (h[i - 1, j - 1] + (1.0 if same else -edit))) < 1e-6:
            matched += bool(same)
            i, j = i - 1, j - 1
            start = j
        elif abs(h[i, j] - (h[i - 1, j] - edit)) < 1e-6:
            i -= 1
        else:
            j -= 1
            start = j
    return score, matched, start, end


def passages(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """``(matched words, start, end)`` of every passage of the item in the text, none over another.

    A passage has ``LEAST_WORDS`` matched words and at most an edit for every ``WORDS_AN_EDIT``
    of them. The best alignment is taken out and the text on either side searched again; one
    that has more edits is a passage in its densest part, if that has the words.
    """
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST_WORDS:
            continue
        score, matched, s, e = align(item, text[a:b])
        if score < LEAST_SCORE - 1e-9:
            continue
        if matched >= LEAST_WORDS and (matched - score) / EDIT * WORDS_AN_EDIT > matched + 1e-6:
            _, matched, x, y = align(item, text[a + s : a + e], WORDS_AN_EDIT)
            s, e = s + x, s + y
        if matched >= LEAST_WORDS:
            out.append((matched, a + s, a + e))
        todo += [(a, a + s), (a + e, b)]
    return sorted(out, key=lambda x: x[1])


def window_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key of each window of ``SEED`` word hashes."""
    if len(ids) < SEED:
        return np.array([], dtype=np.int64)
    key = np.zeros(len(ids) - SEED + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            key = (key ^ ids[k : len(ids) - SEED + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def seed_keys(own: list[tuple[tuple[int, ...], list[str]]]) -> list[np.ndarray]:
    """The window keys that point to each text, decided over all texts.

    A window that texts hold that are no copies of each other is a turn of phrase and points to
    none, unless it lies in a run of such windows that is a passage of ``LEAST_WORDS`` words.
    Copies share half of the shorter one's windows.
    """
    keys = [window_keys(word_hashes(words)) for _, words in own]
    grams = [np.unique(k) for k in keys]
    every = np.concatenate([np.array([], dtype=np.int64), *grams])
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    order = np.argsort(every, kind="stable")
    uniq, first, n = np.unique(every[order], return_index=True, return_counts=True)
    known: dict[tuple[int, int], bool] = {}

    def copies(a: int, b: int) -> bool:
        if (a, b) not in known:
            known[a, b] = 2 * len(np.intersect1d(grams[a], grams[b], assume_unique=True)) >= min(len(grams[a]), len(grams[b]))
        return known[a, b]

    # Each holder is held against the first one only, so a phrase of many texts takes no pairs of them.
    shared = [k for k in np.flatnonzero(n > 1).tolist() if not all(copies(int(owner[order[first[k]]]), int(o)) for o in owner[order[first[k] + 1 : first[k] + n[k]]])]
    phrases = uniq[shared]
    out = []
    for k in keys:
        turn = np.isin(k, phrases)
        for is_turn, run in groupby(range(len(k)), key=turn.__getitem__):
            places = list(run)
            if is_turn and len(places) > LEAST_WORDS - SEED:
                turn[places] = False
        out.append(np.unique(k[~turn]))
    return out


class Scanner:
    """The hash set of one block of items, and the search of one text against it."""

    def __init__(self, own: list[tuple[tuple[int, ...], list[str]]], seeds: list[np.ndarray]) -> None:
        self.read = WordReader()
        vocabulary = sorted({w for _, ws in own for w in ws})
        self.id = {w: k for k, w in enumerate(vocabulary)}
        self.hash = word_hashes(vocabulary)
        self.members = [who for who, _ in own]
        self.items = [np.array([self.id[w] for w in ws], dtype=np.int64) for _, ws in own]
        #: Which words an item holds, filled for one item at a time; the last place is the unknown word -1.
        self.mark = np.zeros(len(vocabulary) + 1, dtype=bool)
        every = np.concatenate([np.array([], dtype=np.int64), *seeds])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])[order]
        # Owners of the k-th key stand from first[k] to first[k + 1].
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        #: Per item its window keys in order and where they stand, for items that were hit.
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, matched words, first char, char after the last)`` of each leak in the text."""
        words = self.read.words(text)
        if len(words) < LEAST_WORDS or not len(self.keys):
            return []
        get = self.id.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        full = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED)
        if not len(full):
            return []
        key = window_keys(self.hash[ids])[full]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        if not hit.any():
            return []
        out, spans = set(), None
        places, found = full[hit], at[hit]
        n = self.first[found + 1] - self.first[found]
        where = np.repeat(places, n)
        who = self.owner[np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(who, kind="stable")
        cuts = np.flatnonzero(np.diff(who[order])) + 1
        for part in np.split(order, cuts):
            k = int(who[part[0]])
            own = self.items[k]
            for a, b in self._windows(k, where[part], key[hit][np.searchsorted(places, where[part])], len(ids)):
                if self._bound(own, ids[a:b]) < LEAST_SCORE - 1e-9:
                    continue
                for matched, s, e in passages(own, ids[a:b]):
                    spans = self.read.spans(text) if spans is None else spans
                    out |= {(item, matched, spans[a + s][0], spans[a + e - 1][1]) for item in self.members[k]}
        return sorted(out)

    def _windows(self, k: int, seeds: np.ndarray, keys: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Stretches of the text that a passage of the item may fill through these seeds, merged where they meet.

        A seed stands at a known place of the item (or at several), so a passage reaches as far
        as the item does on either side, and further by as many words as may be added to it.
        """
        if k not in self.places:
            mine = window_keys(self.hash[self.items[k]])
            order = np.argsort(mine, kind="stable")
            self.places[k] = mine[order], order
        mine, order = self.places[k]
        first, last = order[np.searchsorted(mine, keys, "left")], order[np.searchsorted(mine, keys, "right") - 1]
        rest = len(self.items[k]) - first
        start = np.maximum(seeds - last - last // WORDS_AN_EDIT - MARGIN, 0)
        end = np.minimum(seeds + rest + rest // WORDS_AN_EDIT + MARGIN, n)
        out: list[list[int]] = []
        for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _bound(self, item: np.ndarray, text: np.ndarray) -> float:
        """The most an alignment can score: words the item lacks cost ``EDIT`` each."""
        self.mark[item] = True
        total = np.concatenate([[0.0], np.cumsum(np.where(self.mark[text], 1.0, -EDIT))])
        self.mark[item] = False
        return float((total - np.minimum.accumulate(total)).max())


def _sentences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = WordReader()
    for frame in frames:
        words = [[w for w in (read.words(s) for s in _STOP.split(t or "")) if w] for t in frame["text"]]
        yield pd.DataFrame({"item_id": frame["item_id"], "sentences": words})


def _blocks(items: DataFrame) -> list[tuple[list[tuple[tuple[int, ...], list[str]]], list[np.ndarray]]]:
    """The held-out items, a stated query set, in blocks of at most ``BLOCK_WORDS`` words, with their seeds."""
    rows = items.where("item_id IS NOT NULL").select("item_id", "text").distinct().mapInPandas(_sentences, "item_id bigint, sentences array<array<string>>").toLocalIterator()
    own = sorted(own_words([(r[0], r[1]) for r in rows]))
    out: list[tuple[list, list]] = [([], [])]
    size = 0
    for entry, seeds in zip(own, seed_keys(own), strict=True):
        if out[-1][0] and size + len(entry[1]) > BLOCK_WORDS:
            out.append(([], []))
            size = 0
        out[-1][0].append(entry)
        out[-1][1].append(seeds)
        size += len(entry[1])
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, words, first_char, end_char)`` of every leaked passage.

    A passage is at least 25 of the item's own words in its order, at most an edit for every five
    of them apart; case, accents, punctuation, markup, layout and look-alike letters do not
    count. In scripts without spaces each character is a word. Short stock sentences shared by
    items that are no copies of each other are not own words; a passage of several items is
    reported for each. Null and short texts hold nothing, rows without a doc_id are left out.
    An item of fewer own words cannot leak.
    """
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")

    def search(block: tuple) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scan = Scanner(*shared.value)
            for frame in frames:
                out = [(d, *hit) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for hit in scan(t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "first_char", "end_char"])

        return spread(texts).mapInPandas(run, "doc_id bigint, item_id bigint, words int, first_char int, end_char int")

    return reduce(DataFrame.unionByName, [search(b) for b in _blocks(items)])


def remove_leaks(documents: DataFrame, found: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """Documents with their leaked passages cut out; one whose passages fill ``drop_share`` goes whole.

    Columns of ``documents`` with the new text, and ``cut_chars``; documents without a leak pass
    unchanged.
    """
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set(F.struct("first_char", "end_char"))).alias("__spans"))

    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, ss in zip(text, spans, strict=True):
            kept, at = [], 0
            for s in ss:
                a, b = max(s["first_char"], at), s["end_char"]
                if b > at:
                    kept.append(t[at:a])
                    at = b
            new = "".join([*kept, t[at:]])
            out.append((new, len(t) - len(new)))
        return pd.DataFrame(out, columns=["text", "cut_chars"])

    joined = documents.drop("cut_chars").join(spans, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    clean = joined.where("__spans IS NULL").drop("__spans").withColumn("cut_chars", F.lit(0))
    cutter = F.pandas_udf(cut, "text string, cut_chars int")
    hit = joined.where("__spans IS NOT NULL").withColumn("__cut", cutter("text", "__spans")).where(F.col("__cut.cut_chars") < drop_share * F.length("text"))
    return clean.unionByName(hit.withColumns({"text": F.col("__cut.text"), "cut_chars": F.col("__cut.cut_chars")}).select(*clean.columns))
