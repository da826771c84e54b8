"""Texts decoded with the wrong character encoding: found, and restored where possible.

Adjacent character pairs are scored by their corpus mutual information, counted over distinct
texts. The maximum-scoring segments of improbable pairs are the suspect runs, and inverse
mappings (encode with the charset that was wrongly used, decode with the one that was meant) are
tried only there; what lies outside is neither tested nor touched. A mapping is accepted when
the restored text's pairs are far more probable in the corpus, or when the run's own signs prove
it to be UTF-8 bytes. A suspect run that holds replacement characters or an unfinished UTF-8
sequence has no inverse: its text is a case that cannot be restored.

The pair table is bounded by construction: characters no supported charset holds share one
symbol, so it has at most ``len(ALPHABET) ** 2`` entries and is safe to collect and ship.
Detection is map-only; names may repeat or be skewed at will.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.session import spread

#: Charsets a file may truly have used, and ones it may have been read with.
TRUE_CHARSETS = ("cp1250", "cp1251", "cp1252", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman")
READ_CHARSETS = ("cp1252", "cp1250", "cp1251", "latin_1", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman")

_HELD = sorted({bytes([b]).decode(c, "ignore") for c in (*TRUE_CHARSETS, *READ_CHARSETS) for b in range(128, 256)} - {"", "\ufffd"})
#: Symbols of the pair table: the edge of a text, any other character, the replacement character, then ASCII and the charsets' characters.
ALPHABET = ["edge", "other", "\ufffd", *map(chr, range(128)), *_HELD]
_EDGE, _OTHER, _GONE = 0, 1, 2
_N = len(ALPHABET)
_CODE = np.full(0x110000, _OTHER, dtype=np.int32)
for _i, _c in enumerate(ALPHABET[_GONE:], _GONE):
    _CODE[ord(_c)] = _i

#: A symbol counts as standing in at least this share of all pairs. Garbled symbols are rare and attract
#: each other; with the floor under their frequency a pair of them is associated only if it is common itself.
FLOOR = 5e-3
#: Bits of mutual information below which a pair is improbable.
NATURAL_BITS = -1.5
#: Mean natural-log gain a pair that a single-byte mapping must bring, and the share of pairs that must win.
GAIN, WINS = 1.5, 0.5


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _own_codes(text: str) -> np.ndarray:
    """Codes of a text with -1 for what says nothing about its language.

    These are replacement characters, runs that their own signs prove to be UTF-8 bytes, and
    plausible ones in texts that hold no other non-ASCII run: beside one, the text was rather
    read as it was meant.
    """
    codes = _codes(text)
    if text.isascii():
        return codes
    runs = [(m.start(), m.end(), *_utf8_readings(text, *m.span())) for m in _HIGH.finditer(text)]
    alone = all(own or plausible for _, _, own, plausible in runs)
    for s, e, own, _ in runs:
        if own or alone:
            codes[s:e] = -1
    codes[codes == _GONE] = -1
    return codes


def _count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_N * _N)
    edge = np.zeros(1, dtype=np.int32)
    for frame in frames:
        body = [_own_codes(t) for t in frame["text"]]
        if not body:
            continue
        line = np.concatenate([edge, *(x for c in body for x in (c, edge))]).astype(np.int64)
        text = np.repeat(np.arange(len(body)), [len(c) + 1 for c in body])
        a, b = line[:-1], line[1:]
        seen = (a >= 0) & (b >= 0)
        # A text counts once for each pair it holds.
        once = np.unique(text[seen] * (_N * _N) + a[seen] * _N + b[seen])
        total += np.bincount(once % (_N * _N), weights=frame["weight"].to_numpy()[once // (_N * _N)], minlength=_N * _N)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(pair, n)``: the weight of the ``texts(text)`` that hold each pair of neighbouring symbols.

    A text of c copies weighs log2(1 + c): names in use again and again are better evidence
    than single ones, yet one garbled name that fills a third of the rows does not become
    natural by it. Summed per task and added up, over all texts; texts' edges are a symbol of
    their own. Pairs that touch a run of UTF-8 bytes are left out, see ``_own_codes``.
    """
    some = texts.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.log2(F.count("*") + F.lit(1)).alias("weight"))
    return some.mapInPandas(_count_pairs, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Pair probabilities and mutual information of a corpus."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        n = np.zeros(_N * _N, dtype=np.float64)
        n[pairs] = counts
        self.n = n.reshape(_N, _N)
        total = max(self.n.sum(), 1.0)
        row, col = self.n.sum(1, keepdims=True) + FLOOR * total, self.n.sum(0, keepdims=True) + FLOOR * total
        # A text is no evidence for its own pairs: one text is taken off each count.
        self.info = np.log2(np.maximum(self.n - 1, 0.01) * total / (row * col))
        # Additive smoothing: an unseen pair is as likely as half an occurrence.
        self.log_p = np.log((self.n + 0.5) / (self.n.sum(1, keepdims=True) + 0.5 * _N))

    def suspect(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Character spans of the maximum-scoring segments of improbable pairs."""
        line = np.concatenate([[_EDGE], codes, [_EDGE]])
        score = NATURAL_BITS - self.info[line[:-1], line[1:]]
        return [(max(s - 1, 0), min(e, len(codes))) for s, e in maximal_segments(score.tolist())]

    def logp(self, text: str) -> float:
        line = np.concatenate([[_EDGE], _codes(text), [_EDGE]])
        return float(self.log_p[line[:-1], line[1:]].sum())


def maximal_segments(score: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments ``[start, end)`` in linear time (Ruzzo and Tompa 1999)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, x in enumerate(score):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e) for s, e, _, _ in found]


def _encode(text: str, charset: str) -> bytes | None:
    """Bytes of a text in a charset; C1 controls stand for the bytes a charset leaves undefined."""
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(charset)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) <= 0x9F:
                    return None
                out.append(ord(c))
        return bytes(out)


_UTF8_RUN = re.compile(
    rb"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
_HIGH = re.compile(r"[^\x00-\x7f]+")

@lru_cache(maxsize=100_000)
def _from_utf8(run: str) -> tuple[frozenset[str], frozenset[str]]:
    """What a run says if its bytes, by any charset, are UTF-8: wholly, and only in valid stretches."""
    whole, part = set(), set()
    for charset in READ_CHARSETS:
        data = _encode(run, charset)
        if data is None or len(data) != len(run):
            continue
        try:
            whole.add(data.decode("utf-8"))
        except UnicodeDecodeError:
            # Bytes outside valid stretches keep the character they were read as.
            out, at = [], 0
            for m in _UTF8_RUN.finditer(data):
                # Letters of one script that would be a character of no supported charset are a word.
                if _CODE[ord(m[0].decode("utf-8"))] == _OTHER and len({_script(c) for c in run[m.start() : m.end()]} | {""}) == 2 and run[m.start() : m.end()].isalpha():
                    continue
                out += [run[at : m.start()], m[0].decode("utf-8")]
                at = m.end()
            part.add("".join([*out, run[at:]]))
    return frozenset(x for x in whole if len(x) < len(run)), frozenset(part - {run})


#: Punctuation that may well follow a letter.
_AFTER_LETTER = frozenset("‘’“”–—…•«»\xa0")


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    """The script of a letter, "" for any other character."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() and c not in "ªºµ" and unicodedata.category(c) != "Lm" else ""


def _odd(chars: str, before: str, after: str) -> bool:
    """Whether no writing forms this sequence: a letter run into a sign, a sign into a letter, or against case."""
    lead, rest = chars[0], chars[1:]
    if not lead.isalpha():
        # Only signs that are no punctuation: a dash or quote before a letter is common.
        return lead not in _AFTER_LETTER and unicodedata.category(lead) in ("So", "Sm", "Sk") and any(c.isalpha() or not c.isprintable() for c in rest)
    if lead.isupper() and before.islower():
        return True
    if any(not (c.isalpha() or c in _AFTER_LETTER) or (c.isalpha() and _script(c) != _script(lead)) for c in rest):
        return True
    return any(c in "‘“”" for c in rest) and after.isalpha()


@lru_cache(maxsize=100_000)
def _readings(run: str, before: str, after: str) -> tuple[frozenset[str], frozenset[str]]:
    own, plausible = set(), set()
    for charset in READ_CHARSETS:
        data = _encode(run, charset)
        if data is None or len(data) != len(run):
            continue
        try:
            new = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(new) == len(run):
            continue
        parts = [m.span() for m in _UTF8_RUN.finditer(data)]
        signs = [run[a:b] for a, b in parts]
        odd = any(_odd(run[a:b], run[a - 1] if a else before, run[b] if b < len(run) else after) for a, b in parts)
        scripts = {_script(c) for c in new} | {_script(before), _script(after)}
        # Control characters are no text, but bytes where wrong readings are stacked.
        controls = any(unicodedata.category(c) == "Cc" for c in new)
        stacked = len(parts) > 2 or not controls or bool(_from_utf8(new)[0])
        held = stacked and all(_CODE[ord(c)] > _GONE for c in new)
        # Further scripts take three bytes or more, whose signs no single-byte writing puts side by side.
        wide = odd and all(len(x) > 2 or _CODE[ord(c)] > _GONE for x, c in zip(signs, new, strict=True)) and all(unicodedata.category(c)[0] not in "C" for c in new)
        if (held or wide) and (len(parts) > 2 or len(scripts - {""}) <= 1):
            (own if odd or len(parts) > 2 else plausible).add(new)
    return frozenset(own), frozenset(plausible)


def _utf8_readings(text: str, s: int, e: int) -> tuple[frozenset[str], frozenset[str]]:
    """Readings of a run as UTF-8 bytes that its signs prove, and those that are merely possible.

    Both hold only characters of the supported charsets (or such as take three bytes), in one
    script with the letters beside the run.
    """
    if e - s < 2:
        return frozenset(), frozenset()
    return _readings(text[s:e], text[max(s - 1, 0) : s], text[e : e + 1])


def _is_lost(text: str, s: int, e: int) -> bool:
    """Whether a run shows that bytes are gone: replacement characters, or a UTF-8 sequence that a ? breaks off.

    A letter before a question mark is also what a sentence ends with; it counts only if the
    word goes on after the ? or the run itself is against all writing.
    """
    run = text[s:e]
    if "\ufffd" in run:
        return True
    if text[e : e + 1] != "?" or not any(_unfinished(run[-k:], c) for c in READ_CHARSETS for k in (1, 2, 3)):
        return False
    return text[e + 1 : e + 2].isalpha() or _odd(run, text[max(s - 1, 0) : s], "")


def _unfinished(run: str, charset: str) -> bool:
    """Whether the run's bytes are the beginning of a UTF-8 sequence."""
    data = _encode(run, charset)
    if data is None or len(data) != len(run):
        return False
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as x:
        return x.reason == "unexpected end of data"
    return False


@lru_cache(maxsize=100_000)
def _variants(run: str) -> dict[tuple[str, str], str]:
    """What a run becomes under each (read, true) pair of single-byte charsets that holds it."""
    out = {}
    for read in READ_CHARSETS:
        data = _encode(run, read)
        if data is None or len(data) != len(run):
            continue
        for true in TRUE_CHARSETS:
            try:
                new = data.decode(true)
            except UnicodeDecodeError:
                continue
            if true != read:
                out[read, true] = new
    return out


class Restorer:
    """Finds and restores garbled texts with one corpus's pair model; caches repeated texts."""

    def __init__(self, model: PairModel, cache: int = 200_000) -> None:
        self.model, self.cache = model, cache
        self.seen: dict[str, tuple[bool, str | None]] = {}
        self.bounds: dict[tuple[str, str, str], float] = {}

    def __call__(self, text: str) -> tuple[bool, str | None]:
        """Whether the text is garbled, and what it was: None if that can't be had in full."""
        if text not in self.seen:
            if len(self.seen) >= self.cache:
                self.seen.clear()
            self.seen[text] = self.restore(text)
        return self.seen[text]

    def restore(self, text: str) -> tuple[bool, str | None]:
        now, garbled = text, False
        # Wrong readings may be stacked. Each step shortens the text or makes it likelier, so this ends.
        while (better := self._once(now)) is not None:
            now, garbled = better, True
        if any(_is_lost(now, s, e) for s, e in self._runs(now)):
            return True, None
        return garbled, now if garbled else None

    def _once(self, text: str) -> str | None:
        spans = self._runs(text)
        if not spans:
            return None
        if any(_utf8_readings(text, s, e)[0] for s, e in spans):
            return self._utf8(text, spans, 0)
        found = [x for x in (self._utf8(text, spans, 0), self._single_byte(text, spans)) if x is not None]
        if found:
            return max(found, key=self.model.logp)
        return self._utf8(text, spans, 1)

    def _runs(self, text: str) -> list[tuple[int, int]]:
        """Non-ASCII stretches that a suspect segment touches."""
        marks = [m.span() for m in _HIGH.finditer(text)]
        if not marks:
            return []
        segments = self.model.suspect(_codes(text))
        return [(s, e) for s, e in marks if any(a < e and s < b for a, b in segments)]

    def _utf8(self, text: str, spans: list[tuple[int, int]], kind: int) -> str | None:
        """Runs read as UTF-8 (kind 0: wholly, 1: in stretches), each as the likeliest of its readings.

        A reading must make the text likelier, unless the run's own signs prove it.
        """
        out, at, hit = [], 0, False
        for s, e in spans:
            own = _utf8_readings(text, s, e)[0] if kind == 0 else frozenset()
            options = [(self._gain(text, s, e, x), x) for x in own or _from_utf8(text[s:e])[kind]] if e - s > 1 else []
            gain, better = max(options, default=(0.0, ""))
            if own or gain > 0:
                out += [text[at:s], better]
                at, hit = e, True
        return "".join([*out, text[at:]]) if hit else None

    def _gain(self, text: str, s: int, e: int, better: str) -> float:
        """Log-probability gained by putting ``better`` for a run, in its context."""
        a, b = max(s - 1, 0), min(e + 1, len(text))
        return self.model.logp(text[a:s] + better + text[e:b]) - self.model.logp(text[a:b])

    def _bound(self, before: str, run: str, after: str) -> float:
        """The most any single-byte mapping gains a pair on a run between two characters."""
        key = (before, run, after)
        if key not in self.bounds:
            if len(self.bounds) >= self.cache:
                self.bounds.clear()
            old = self._around(before, run, after)
            gains = [float((self._around(before, new, after) - old).mean()) for new in set(_variants(run).values()) - {run}]
            self.bounds[key] = max(gains, default=-np.inf)
        return self.bounds[key]

    def _around(self, before: str, run: str, after: str) -> np.ndarray:
        line = np.concatenate([_codes(before) if before else [_EDGE], _codes(run), _codes(after) if after else [_EDGE]])
        return self.model.log_p[line[:-1], line[1:]]

    def _single_byte(self, text: str, spans: list[tuple[int, int]]) -> str | None:
        """The reading, one pair of charsets for the whole text, whose pairs gain most."""
        runs = [text[s:e] for s, e in spans]
        if max(self._bound(text[max(s - 1, 0) : s], r, text[e : e + 1]) for (s, e), r in zip(spans, runs, strict=True)) <= GAIN:
            return None
        line = np.concatenate([[_EDGE], _codes(text), [_EDGE]])
        old = self.model.log_p[line[:-1], line[1:]]
        best, gain = None, GAIN
        options = [_variants(r) for r in runs]
        for mapping in set(options[0]).intersection(*options[1:]):
            chars, touched = list(text), np.zeros(len(text) + 1, dtype=bool)
            for (s, e), run, o in zip(spans, runs, options, strict=True):
                chars[s:e] = o[mapping]
                touched[s : e + 1] |= o[mapping] != run
            if not touched.any():
                continue
            fixed = "".join(chars)
            at = np.concatenate([[_EDGE], _codes(fixed), [_EDGE]])
            diff = (self.model.log_p[at[:-1], at[1:]] - old)[touched]
            mean = float(diff.mean())
            if (mean, fixed) > (gain, best or "") and mean > GAIN and (diff > 0).mean() >= WINS:
                best, gain = fixed, mean
        return best


def detect(records: DataFrame, model: PairModel) -> DataFrame:
    """Garbled rows of ``records`` with ``restored`` (null where the text can't be had back).

    ``records`` has a column text; all its columns are kept, but one named restored is
    replaced. Null, empty and pure ASCII texts are never garbled and never reach Python.
    """
    records = records.drop("restored")
    shared = records.sparkSession.sparkContext.broadcast((model.n.nonzero()[0], model.n.nonzero()[1], model.n[model.n.nonzero()]))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in records.dtypes), "restored string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = shared.value
        fix = Restorer(PairModel(a * _N + b, n))
        for frame in frames:
            got = [fix(t) for t in frame["text"]]
            keep = np.array([g for g, _ in got], dtype=bool)
            yield frame[keep].assign(restored=pd.Series([r for g, r in got if g], dtype=object, index=frame.index[keep]))

    return spread(records.where(F.col("text").rlike(r"[^\x00-\x7f]"))).mapInPandas(run, schema)


def fit(texts: DataFrame) -> PairModel:
    """The pair model of all ``texts(text)``; collects at most ``len(ALPHABET) ** 2`` rows."""
    rows = pair_counts(texts).toPandas()
    return PairModel(rows["pair"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64))


def restore_names(records: DataFrame) -> DataFrame:
    """Fit on all texts of ``records`` and return its garbled rows with ``restored``."""
    return detect(records, fit(records.select("text")))
