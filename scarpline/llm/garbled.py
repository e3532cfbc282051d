"""Text that was read in another encoding than it was written in.

The corpus says how often characters stand next to each other. Adjacent characters are scored by their mutual information: how much
more often they stand together than their own counts would have it, smoothed by the kinds of both (small Latin letters with an accent,
Cyrillic capitals, box drawings and so on). In a word the maximum-scoring segments of pairs with little mutual information are isolated.
Only inside them inverse mappings are tried: the characters back to bytes by a code page, the bytes to text by UTF-8 or by another code
page, as often as it helps. A mapping holds if it leads to characters that the corpus knows and to pairs that are more probable by a
margin. Words that are built as only damage builds them (suspect()) are left out of the counts, so that a source damaged as a whole does
not vouch for itself. One letter for another is too little for that margin: there the corpus's words decide. A word is damaged, too, that
a pair of code pages turns into one that stands in many more texts.

Only characters of the code pages at hand can come from damage, so pairs of these (a fixed alphabet of some hundreds) are counted one by
one, all of them; pairs with any other character are counted by the kinds of both and by the character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.encode import some
from scarpline.session import materialize

#: Code pages by which UTF-8 gets misread, likeliest first, and pairs (read as, written in) of single-byte ones.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "iso8859-2", "cp1254", "iso8859-15", "cp866", "cp852", "iso8859-5", "mac_cyrillic", "cp1257", "cp1253")
_LATIN, _CYRILLIC = ("cp1252", "cp1250", "mac_roman", "cp437", "cp850", "iso8859-2", "cp852"), ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
SWAPPED = tuple((r, w) for r in (*_LATIN, *_CYRILLIC, "latin-1") for w in (*_LATIN, *_CYRILLIC) if r != w and not (r == "latin-1" and w == "cp1252"))
#: Bits of mutual information below which a pair is improbable.
INFORMATION = 4.0
#: Bits: from where on a pair is rare (twice as many), by how much a mapping to UTF-8 or to a code page must improve a word, and what all improved words of a text must reach with one pair of code pages.
IMPROBABLE, GAIN_UTF8, GAIN_SWAP, GAIN_TEXT = 9.0, 6.0, 8.0, 18.0
#: Code pages whose letters stand where UTF-8 has its second bytes: two sequences in a run and this gain are asked for.
LETTERED, GAIN_LETTERED = {"cp866", "iso8859-5", "mac_cyrillic"}, 20.0
#: Code pages in which a sequence that ends in a no-break space counts by itself.
_WITH_BLANK = {"cp1252", "latin-1", "cp1250", "iso8859-2", "cp1254", "iso8859-15", "cp1257"}
#: Bits that a word with capitals costs more than the same in small letters, at most.
CAPITALS = 4.0
#: Bits that a word must gain once the text's pair of code pages is known.
GAIN_SURE = 3.0
#: Where one word outside ASCII in so many is suspect, none of the text's words outside ASCII counts.
SUSPECT_SHARE = 4
#: A character is known that stands in the corpus so often.
KNOWN = 3
#: A word tells of another by standing in so many texts, and in so many times as many; up to so many told words are sent to every task, more are joined.
TEXTS, TIMES, SENT_WORDS = 5, 4, 100_000
_SMOOTH = 30.0

_WORD = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
_SOLID = re.compile("[^\x00-\x20\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]*[^\x00-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff][^\x00-\x20\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]*")
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026"
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")

#: Fixed: kinds of characters, as the first code point of each range.
_RANGES = (
    (0x0, "control"), (0x20, "blank"), (0x21, "sign"), (0x30, "digit"), (0x3A, "sign"), (0x41, "A"), (0x5B, "sign"), (0x61, "a"), (0x7B, "sign"),
    (0x80, "C1"), (0xA0, "nbsp"), (0xA1, "latin1 sign"), (0xC0, "latin"), (0xD7, "latin1 sign"), (0xD8, "latin"), (0xF7, "latin1 sign"), (0xF8, "latin"),
    (0x250, "modifier"), (0x300, "combining"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x900, "devanagari"), (0x980, "other"),
    (0x2000, "blank"), (0x2010, "quote"), (0x2020, "print sign"), (0x2070, "print sign"), (0x20A0, "print sign"), (0x2190, "math"), (0x2500, "box"), (0x25A0, "picture"),
    (0x2E80, "other"), (0xFE00, "other"), (0x1F000, "picture"),
)
_STARTS = np.array([a for a, _ in _RANGES])
_KINDS = sorted({k for _, k in _RANGES} | {"LATIN", "CYRILLIC"})
_KIND_OF_RANGE = np.array([_KINDS.index(k) for _, k in _RANGES])


def kinds(points: np.ndarray) -> np.ndarray:
    """The kind of each code point, capitals of Latin and Cyrillic apart."""
    k = _KIND_OF_RANGE[np.searchsorted(_STARTS, points, "right") - 1]
    for name, capital in (("latin", "LATIN"), ("cyrillic", "CYRILLIC")):
        own = np.flatnonzero(k == _KINDS.index(name))
        if len(own):
            u, back = np.unique(points[own], return_inverse=True)
            k[own] = np.where(np.array([chr(c).isupper() for c in u]), _KINDS.index(capital), _KINDS.index(name))[back]
    return k


#: Rows of pair_counts: a pair of the alphabet is its first code point times 2^21 plus its second; kinds of other pairs and their second characters have a mark.
_OF_KINDS, _OF_SECOND = 1 << 42, 2 << 42


def corpus_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(pair, word, n) over all texts: how often two characters stand next to each other, but for suspect words (pair), and in how many texts a word outside ASCII stands (word).

    There are at most as many rows of pairs as the alphabet has pairs, kinds have pairs and Unicode has characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in some(b.column(0)):
                words: Counter[str] = Counter()
                pair, n = count_pairs([t for t in texts if t], words)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pair), pa.nulls(len(words), pa.int64())]), pa.concat_arrays([pa.nulls(len(pair), pa.string()), pa.array(list(words), pa.string())]), pa.array(np.r_[n, list(words.values())].astype(np.int64))], names=["pair", "word", "n"])

    return documents.select(text).where(f"`{text}` is not null").mapInArrow(count, "pair long, word string, n long").groupBy("pair", "word").agg(F.sum("n").alias("n")).where("n > 0")


def core(word: str) -> str:
    """A word without the signs around it."""
    return word.strip(_AROUND)


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) of pairs of characters."""
    known = _IN_ALPHABET[np.minimum(a, len(_IN_ALPHABET) - 1)] & _IN_ALPHABET[np.minimum(b, len(_IN_ALPHABET) - 1)]
    x, y = a[~known], b[~known]
    return np.unique(np.r_[a[known] << 21 | b[known], _OF_KINDS | kinds(x) * 64 + kinds(y), _OF_SECOND | y], return_counts=True)


def count_pairs(texts: list[str], seen: Counter[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) of texts as one; a row may come twice, with a negative count for what suspect words take away. seen counts the texts of each word outside ASCII."""
    whole = "\n" + "\n".join(texts) + "\n"
    x = _points(whole)
    a, c = x[:-1], x[1:]
    plain = (a < 128) & (c < 128)
    ascii_ = np.bincount(a[plain] * 128 + c[plain], minlength=1 << 14)
    k = np.flatnonzero(ascii_)
    pair, n = _coded(a[~plain], c[~plain])
    out = [np.r_[(k // 128) << 21 | k % 128, pair]], [np.r_[ascii_[k], n]]
    spans, first = [], 1
    for t in texts:
        if not t.isascii():
            found = list(_SOLID.finditer(t))
            words = [(first + m.start(), first + m.end(), suspect(m[0])) for m in found]
            if seen is not None:
                seen.update({core(m[0]) for m in found})
            damaged = SUSPECT_SHARE * sum(w[2] for w in words) >= len(words)
            spans += [w[:2] for w in words if damaged or w[2]]
        first += len(t) + 1
    if spans:  # each pair inside such a word and at its ends
        begin, end = np.array(spans).T
        size = end - begin + 1
        at = np.repeat(begin - 1 - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        pair, n = _coded(x[at], x[at + 1])
        out[0].append(pair)
        out[1].append(-n)
    return np.concatenate(out[0]), np.concatenate(out[1]).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


class PairModel:
    """Probabilities of character pairs, as negative logarithms to base 2, and their mutual information."""

    def __init__(self, rows: np.ndarray, n: np.ndarray) -> None:
        of_kinds, of_second = rows >> 42 == 1, rows >> 42 == 2
        pairs, own, size = rows[rows < _OF_KINDS], n[rows < _OF_KINDS], len(_KINDS)
        self.total = float(own.sum() + n[of_kinds].sum()) or 1.0
        #: From so many bits on a pair is rare: in a small corpus, from where it stands there a few times.
        self.rare = min(2 * IMPROBABLE, log2(self.total) - 1.5)
        self.count = dict(zip(pairs.tolist(), own.tolist()))
        a = pairs >> 21
        b, m = np.r_[pairs & ((1 << 21) - 1), rows[of_second] & ((1 << 21) - 1)], np.r_[own, n[of_second]]
        points, back = np.unique(b, return_inverse=True)
        self.seen = dict(zip(points.tolist(), np.bincount(back, m).astype(np.int64).tolist())) if len(points) else {}
        of_pairs = np.bincount(kinds(a) * size + kinds(b[: len(a)]), own, size * size) if len(pairs) else np.zeros(size * size)
        other = rows[of_kinds] & 0xFFFF
        np.add.at(of_pairs, (other >> 6) * size + (other & 63), n[of_kinds])
        self.of_kinds = ((of_pairs + 0.02) / (self.total + 1)).tolist()
        self.in_kind = (np.bincount(kinds(b), m, size) + 50.0).tolist() if len(b) else [50.0] * size
        self.kind: dict[int, int] = {}
        self.bits: dict[int, float] = {}
        self.shared: dict[int, float] = {}

    def kind_of(self, c: int) -> int:
        k = self.kind.get(c)
        if k is None:
            k = self.kind[c] = int(kinds(np.array([c]))[0])
        return k

    def cost(self, a: int, b: int) -> float:
        """Bits of the pair: its own count plus a share by the kinds of both; outside the alphabet the share alone."""
        key = a << 21 | b
        v = self.bits.get(key)
        if v is None:
            ka, kb = self.kind_of(a), self.kind_of(b)
            share = self.of_kinds[ka * len(_KINDS) + kb] * (self.seen.get(a, 0) + 0.5) / self.in_kind[ka] * (self.seen.get(b, 0) + 0.5) / self.in_kind[kb]
            if in_alphabet(a) and in_alphabet(b):
                v = -log2((self.count.get(key, 0) + _SMOOTH * min(share * self.total, 1.0) / 10 + 0.01) / self.total)
            else:
                v = -log2(share + 0.01 / self.total)
            self.bits[key] = v
        return v

    def information(self, a: int, b: int) -> float:
        """Mutual information of two adjacent characters, in bits; of two that no damage makes, more than enough."""
        key = a << 21 | b
        v = self.shared.get(key)
        if v is None:
            if in_alphabet(a) or in_alphabet(b):
                alone = -log2((self.seen.get(a, 0) + 0.5) / self.total) - log2((self.seen.get(b, 0) + 0.5) / self.total)
                v = alone - self.cost(a, b)
            else:
                v = 2 * INFORMATION
            self.shared[key] = v
        return v

    def costs(self, word: str) -> list[float]:
        x = [32, *map(ord, word), 32]
        cost = self.cost
        return [cost(a, b) for a, b in zip(x, x[1:])]

    def cost_of(self, word: str) -> float:
        """Bits of a whole word; one in capitals costs little more than in small letters."""
        low = word.lower()
        plain = sum(self.costs(word))
        return plain if low == word else min(plain, sum(self.costs(low)) + CAPITALS)

    def known(self, c: str) -> bool:
        return self.seen.get(ord(c), 0) >= KNOWN


def breaks(word: str) -> int:
    """Places inside a word where letters change script, go from small to capital or from several capitals to small, or are parted by a sign."""
    n, last, capitals, sign = 0, "", 0, False
    for c in word:
        if c < "\x80":
            k = "latin" if c.isalpha() else ""
        else:
            p = ord(c)
            k = "latin" if (0xC0 <= p < 0x250 and p not in (0xD7, 0xF7)) else "greek" if 0x370 <= p < 0x400 else "cyrillic" if 0x400 <= p < 0x530 else "devanagari" if 0x900 <= p < 0x980 else ""
        if not k:
            sign = sign or (c > "\x7f" and bool(last))
            if c < "\x80":
                last, capitals, sign = "", 0, False
            continue
        up = c.isupper()
        if last:
            n += last != k or sign or (up and not capitals) or (not up and capitals > 1)
        last, capitals, sign = k, (capitals + 1 if up else 0), False
    return n


def turned(word: str, new: str) -> bool:
    """Whether a Cyrillic word in capitals would become one in small letters: then it counts by its small letters, as damage of whole texts fills the counts of capitals."""
    return word.isupper() and new.islower() and all("\u0400" <= c < "\u0530" for c in word + new if c.isalpha())


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """The maximal scoring segments (begin, end), all of them, in one pass (Ruzzo and Tompa)."""
    out: list[tuple[int, int, float, float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        begin, end, left, right = k, k + 1, total, total + s
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                out.append((begin, end, left, right))
                break
            begin, left = out[j][0], out[j][2]
            del out[j:]
    return [(b, e) for b, e, _, _ in out]


def _page(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # bytes that the code page leaves open mostly pass through
    return out


_PAGES = {c: _page(c) for c in {*MISREAD, *(r for r, _ in SWAPPED)}}
_IN_ALPHABET = np.zeros(0x10000, bool)
_IN_ALPHABET[[*range(128), *(ord(c) for page in _PAGES.values() for c in page), 0xFFFD]] = True


def in_alphabet(c: int) -> bool:
    """Whether damage can make a character: ASCII and what stands in a code page."""
    return c < 0x10000 and bool(_IN_ALPHABET[c])


_BACK = {w: {b: c for c, b in _page(w).items()} for w in {w for _, w in SWAPPED}}
#: Letters and signs that a word must invert into to be suspect.
_PLAUSIBLE = re.compile("[\x00-\x7f\xa0-\u024f\u0401\u0410-\u044f\u0451\u0900-\u097f\u2010-\u2044\u20ac\u2122]+")
_LETTERS = re.compile("[\xc0-\xd6\xd8-\xf6\xf8-\u024fA-Za-z\u0401\u0410-\u044f\u0451]+")
_RUSSIAN = re.compile("[^A-Za-z\x80-\u0400\u0402-\u040f\u0450\u0452-\u2000]*")
_HIGH = re.compile("[^\x00-\x7f]+")
#: So many letters, all outside ASCII, make a word in Latin letters suspect.
ACCENTED = 5


def _inverse(word: str, pair: tuple[str, str]) -> str | None:
    """word read back by one pair of code pages, if all of it can be."""
    page, back = _PAGES[pair[0]], _BACK[pair[1]]
    try:
        return word.translate({ord(c): back[page[c]] for c in word if c > "\x7f"})
    except KeyError:
        return None


@lru_cache(100_000)
def suspect(word: str) -> bool:
    """Whether a word is built as only damage builds it, whatever the corpus says: runs that are UTF-8 as a whole, led by a letter and with
    a sign among them; ACCENTED letters without an ASCII one that a code page maps into Russian; letters that change script or case, or
    are parted by a sign, where a pair of code pages gives a word with fewer such places.
    """
    runs = [r for r in _HIGH.findall(word) if len(r) > 1 and r[0].isalpha() and not r.isalpha()]
    for r in runs:
        for codec in MISREAD:
            if codec not in LETTERED:
                try:
                    new = bytes(_PAGES[codec][c] for c in r).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if _PLAUSIBLE.fullmatch(new):
                    return True
    n = breaks(word.replace("’", "'"))  # the apostrophe of print parts letters in clean text
    letters = [c for c in word if c.isalpha()]
    foreign = len(letters) >= ACCENTED and all("\xc0" <= c < "\u0250" for c in letters)
    if not n and not foreign:
        return False
    for pair in SWAPPED:
        new = _inverse(word, pair)
        if new is None or new == word:
            continue
        if foreign and pair[1] in _CYRILLIC and _RUSSIAN.fullmatch(new) and breaks(new) <= n:
            return True
        if n and breaks(new) < n and all(_LETTERS.fullmatch(new[k]) for k, c in enumerate(word) if c > "\x7f" and c.isalpha()) and _PLAUSIBLE.fullmatch(new):
            return True
    return False


class Mender:
    """Finds and undoes damage in words; remembers the words it saw."""

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self.pages = _PAGES
        prefix = {}
        for c, n in model.seen.items():
            if c > 127 and n >= KNOWN and not 0xD800 <= c < 0xE000:
                u = chr(c).encode()
                if len(u) == 3:
                    prefix[u[:2]] = True
        self.prefixes = prefix
        self.words: dict[str, tuple] = {}
        self.gains: dict[str, list] = {}

    def _utf8(self, word: str, begin: int, end: int) -> tuple[float, str, int, int] | None:
        """The best (gain, replacement, begin, end) of reading word[begin:end] by one code page and UTF-8."""
        best, before = None, self.model.cost_of(word)
        run = word[begin:end]
        for codec in MISREAD:
            page = self.pages[codec]
            got = [page.get(c, -1) for c in run]
            if sum(g >= 0 for g in got) < 2:
                continue
            at = 0
            text, hits, solid = [], 0, 0
            raw = bytes(g if g >= 0 else 0 for g in got)
            for m in _SEQUENCE.finditer(raw):
                try:
                    c = m[0].decode()
                except UnicodeDecodeError:
                    continue
                if not (self.model.known(c) or "�" == c):
                    continue
                text.append(run[at : m.start()])
                text.append(c)
                at, hits = m.end(), hits + 1
                solid += codec in _WITH_BLANK or run[m.end() - 1] != "\xa0"
            if not solid or (codec in LETTERED and hits < 2):
                continue
            text.append(run[at:])
            new = word[:begin] + "".join(text) + word[end:]
            gain = before - self.model.cost_of(new)
            if gain < (GAIN_LETTERED if codec in LETTERED else GAIN_UTF8) or breaks(new) > breaks(word):
                continue
            if best is None or gain > best[0] + 1e-9:
                best = (gain, "".join(text), begin, end)
        return best

    def _again(self, word: str, begin: int, end: int) -> tuple[float, str, int, int] | None:
        """The same for a run that was misread twice, when what lies between is in itself unknown."""
        before, best = self.model.cost_of(word), None
        for first in MISREAD:
            once = self._whole(word[begin:end], first)
            if once is None or once.isascii():
                continue
            for second in MISREAD[:2]:
                twice = self._whole(once, second)
                if twice is None or not all(c < "\x80" or self.model.known(c) for c in twice):
                    continue
                new = word[:begin] + twice + word[end:]
                gain = before - self.model.cost_of(new)
                if gain >= GAIN_UTF8 and breaks(new) <= breaks(word) and (best is None or gain > best[0] + 1e-9):
                    best = (gain, twice, begin, end)
        return best

    def _whole(self, run: str, codec: str) -> str | None:
        """run read by one code page and UTF-8, if all of it can be."""
        page = self.pages[codec]
        got = [ord(c) if c < "\x80" else page.get(c, -1) for c in run]
        if min(got, default=-1) < 0:
            return None
        try:
            return bytes(got).decode()
        except UnicodeDecodeError:
            return None

    def _cut_off(self, word: str, begin: int, end: int) -> bool:
        """Whether a sequence of three stands there of which the last is lost."""
        for codec in ("cp1252", "latin-1"):
            page = self.pages[codec]
            for k in range(begin, end - 1):
                a, b = page.get(word[k], 0), page.get(word[k + 1], 0)
                if 0xE0 <= a <= 0xEF and 0x80 <= b <= 0xBF and bytes([a, b]) in self.prefixes and (k + 2 >= end or page.get(word[k + 2], 0) not in range(0x80, 0xC0)):
                    kinds_ = {_KINDS[self.model.kind_of(ord(word[k + 1]))]}
                    if not kinds_ & {"latin", "LATIN", "quote"}:
                        return True
        return False

    def _runs(self, word: str) -> list[tuple[int, int]]:
        """Segments of little mutual information, widened to whole runs of characters outside ASCII."""
        x = [32, *map(ord, word), 32]
        out: list[tuple[int, int]] = []
        for b, e in segments([INFORMATION - self.model.information(a, c) for a, c in zip(x, x[1:])]):
            b, e = max(b - 1, 0), min(e, len(word))
            while b > 0 and word[b - 1] > "\x7f":
                b -= 1
            while e < len(word) and word[e] > "\x7f":
                e += 1
            for m in re.finditer(r"[^\x00-\x7f]+", word[b:e]):
                r = (b + m.start(), b + m.end())
                if r not in out:
                    out.append(r)
        return out

    def word(self, w: str) -> tuple[str, bool, bool]:
        """(word as it was, whether it was damaged, whether nothing is lost)."""
        got = self.words.get(w)
        if got is not None:
            return got
        if len(self.words) > 300_000:
            self.words.clear()
        now, bad, whole = w, False, True
        if "�" in w:
            bad, whole = True, False
        if _CONTROL.search(w):
            bad = True
        while True:  # each turn makes the word shorter
            parts, at, changed = [], 0, False
            for b, e in self._runs(now):
                if b < at:
                    continue
                hit = max(filter(None, (self._utf8(now, b, e), self._again(now, b, e))), default=None)
                if hit:
                    parts += [now[at:b], hit[1]]
                    at, changed = e, True
                elif self._cut_off(now, b, e):
                    bad, whole = True, False
            if not changed:
                break
            now, bad = "".join(parts) + now[at:], True
        if _CONTROL.search(now):
            whole = False
        got = self.words[w] = (now, bad, whole)
        return got

    def _swap(self, w: str, pair: tuple[str, str]) -> tuple[float, str] | None:
        """(gain, word) of undoing one pair of code pages in a word, if that gives known characters."""
        new = _inverse(w, pair)
        if new is None or new == w or not all(c < "\x80" or self.model.known(c) for c in new) or breaks(new) > breaks(w):
            return None
        before = sum(self.model.costs(w.lower())) + CAPITALS if turned(w, new) else self.model.cost_of(w)
        gain = before - self.model.cost_of(new)
        kind = self.model.kind_of
        if all(kind(ord(c)) == kind(ord(d)) for c, d in zip(w, new) if c > "\x7f"):
            gain /= 2  # one accent for another: rare names do that too
        return gain, new

    def swaps(self, w: str) -> list[tuple[tuple[str, str], float, str]]:
        """The pairs of code pages that make an improbable word more probable: (pair, gain, word)."""
        got = self.gains.get(w)
        if got is not None:
            return got
        if len(self.gains) > 300_000:
            self.gains.clear()
        out, tried = [], set()
        high = [c for c, (a, b) in zip(self.model.costs(w), zip(" " + w, w + " ")) if a > "\x7f" or b > "\x7f"]
        if max(high) >= self.model.rare or suspect(w) or (w.isupper() and "\u0400" <= min(c for c in w if c.isalpha()) and len(w) >= 4):
            for pair in SWAPPED:
                hit = self._swap(w, pair)
                if hit and hit[0] >= GAIN_SWAP and (hit[1], pair[1]) not in tried:
                    tried.add((hit[1], pair[1]))
                    out.append((pair, *hit))
        self.gains[w] = out
        return out

    def readings(self, w: str) -> list[str]:
        """What a word may have been, if one letter stands for another in it: what pairs of code pages make of it, in letters that the corpus knows."""
        out = set()
        if len(w) >= 3 and sum(c.isalpha() for c in w) >= 2:
            n = breaks(w)
            for pair in SWAPPED:
                v = _inverse(w, pair)
                if v and v != w and v not in out and all(c == d or (d.isalpha() and self.model.known(d)) for c, d in zip(w, v)) and breaks(v) <= n:
                    out.add(v)
        return sorted(out)

    def text(self, t: str | None, told: dict[str, str] | None = None) -> tuple[str, int, bool] | None:
        """(restored text, damaged words, whether all is restored) of a damaged text, else None. told: words that are known to be damaged, and what they were."""
        if not t or t.isascii():
            return None
        mended: dict[str, str] = {}
        by_words: dict[str, str] = {}
        whole = True
        rest: dict[str, list] = {}
        for w in set(_WORD.findall(t)):
            now, bad, complete = self.word(w)
            if bad:
                mended[w] = now
                whole &= complete
            else:
                for v in _SOLID.findall(w):
                    c = core(v)
                    if told and c in told:
                        by_words[v] = v.replace(c, told[c], 1)
                        continue
                    s = self.swaps(v)
                    if s:
                        rest[v] = s
        swapped: dict[str, str] = {}
        if rest:
            sums: dict[tuple[str, str], float] = {}
            for s in rest.values():
                for pair, gain, _ in s:
                    sums[pair] = sums.get(pair, 0.0) + gain
            pair = max(sums, key=lambda p: (sums[p], -SWAPPED.index(p)))
            if sums[pair] >= GAIN_TEXT:
                for w in set(_SOLID.findall(t)):  # with the code pages known, less is asked of the other words
                    hit = None if w in mended else self._swap(w, pair)
                    if hit and hit[0] >= GAIN_SURE:
                        swapped[w] = hit[1]
        swapped |= by_words
        if not mended and not swapped:
            return None
        one = lambda m: mended.get(m[0]) or (_SOLID.sub(lambda v: swapped.get(v[0], v[0]), m[0]) if swapped else m[0])
        return _WORD.sub(one, t), len(mended) + len(swapped), whole


def told_words(vocabulary: DataFrame, pairs: np.ndarray, n: np.ndarray) -> DataFrame:
    """(word, was) of the words of vocabulary (word, n) that stand for another one, which is in at least TEXTS texts and TIMES as many as the word; pairs and n as for PairModel."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(PairModel(pairs, n))
        for b in batches:
            at, out = [], []
            for k, w in enumerate(b.column(0).to_pylist()):
                v = mender.readings(w)
                at += [k] * len(v)
                out += v
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.string())], names=["word", "n", "was"])

    may = vocabulary.select("word", "n").mapInArrow(read, "word string, n long, was string")
    often = vocabulary.where(F.col("n") >= TEXTS).select(F.col("word").alias("was"), F.col("n").alias("texts"))
    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without readings that are damaged themselves."""
        mender = Mender(PairModel(pairs, n))
        for b in batches:
            yield b.filter(pa.array([not suspect(v) and not mender.word(v)[1] for v in b.column(1).to_pylist()], pa.bool_()))

    near = may.join(often, "was").where(F.col("texts") >= TIMES * F.col("n")).select("word", "was", "texts")
    best = near.mapInArrow(sound, "word string, was string, texts long").groupBy("word").agg(F.max(F.struct("texts", "was")).alias("b"))
    return best.select("word", F.col("b.was").alias("was"))


def _with_told(documents: DataFrame, key: str, text: str, told: DataFrame) -> DataFrame:
    """(key, text, told MAP) with each text's own told words; for more of them than go to every task."""
    kind = documents.schema[key].dataType.simpleString()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted({core(v) for v in _SOLID.findall(t)}) if t and not t.isascii() else [] for t in b.column(1).to_pylist()]
            at = pa.array([k for k, w in enumerate(own) for _ in w], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([x for w in own for x in w], pa.string())], names=[key, "word"])

    each = documents.select(key, text).where(f"`{text}` is not null").mapInArrow(words, f"`{key}` {kind}, word string").distinct()
    own = each.join(told, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "was"))).alias("told"))  # at most a text's words
    return documents.select(key, text).join(own, key, "left")


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, words, complete) of each row whose text is damaged somewhere.

    restored is the text with what could be undone undone, words the number of its different damaged words, complete whether no
    character is lost. NULL, empty and plain ASCII texts are never damaged. Repeated texts are told for each key; texts may be of
    any length. Pair and word counts cover all texts; the pairs' number is bounded by the alphabet of the code pages and by Unicode.
    """
    counts = materialize(corpus_counts(documents, text))
    rows = counts.where("pair is not null").select("pair", "n").toArrow()  # bounded, see corpus_counts
    pairs, n = (rows.column(k).to_numpy() for k in (0, 1))
    kind = documents.schema[key].dataType.simpleString()
    told = materialize(told_words(counts.where("word is not null").select("word", "n"), pairs, n))
    if told.limit(SENT_WORDS + 1).count() <= SENT_WORDS:
        sent = {r["word"]: r["was"] for r in told.collect()}  # at most SENT_WORDS rows
        source = documents.select(key, text, F.lit(None).cast("map<string,string>").alias("told"))
    else:
        sent, source = {}, _with_told(documents, key, text, told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(PairModel(pairs, n))
        for b in batches:
            for first, texts in some(b.column(1)):
                own = b.column(2).slice(first, len(texts)).to_pylist()
                found = [(first + k, m) for k, (t, w) in enumerate(zip(texts, own)) if (m := mender.text(t, dict(w) if w else sent))]
                if found:
                    at = pa.array([k for k, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), pa.array([m[0] for _, m in found], pa.string()), pa.array([m[1] for _, m in found], pa.int32()), pa.array([m[2] for _, m in found], pa.bool_())],
                        names=[key, "restored", "words", "complete"],
                    )

    return source.where(f"`{text}` is not null").mapInArrow(run, f"`{key}` {kind}, restored string, words int, complete boolean")
