"""Features of whole texts, triple by triple: no token leaves the task that reads its text.

The features are those of :mod:`features` without a bound on the tokens or bytes of a text.  There a token is a row, so
a table of long answers is written and shuffled several times over; here a text is an array of codes of its words, whose
attributes (those of :mod:`answerscore.functions.text`) are found once for each different word of a task.  Nothing is
shuffled or written, and a triple costs what its texts are long.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from answerscore import lexicon
from answerscore.functions.text import GAP

from .tokens import CONTENT

#: ``text.WORD`` with what follows up to the next token, in a form that takes runs of letters at once.
_BYTE = r"0-9A-Za-z\x80-\U0010FFFF"
TOKEN = re.compile(rf"[{_BYTE}]+(?:(?<=[0-9])[.,](?=[0-9])[{_BYTE}]+)*{GAP}")
STARTS, GAPS = re.compile(f"[{_BYTE}]"), "".join(c for c in map(chr, range(128)) if not c.isalnum())
FIGURE, HEAD, BOUND = re.compile(r"[0-9][0-9,]*(?:\.[0-9][0-9,]*)?"), re.compile(r"(?:[0-9][0-9.,]*)?"), re.compile("[.,;!?:]")
ALPHA, DIGIT, LETTERS, ACRONYM = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[A-Za-z]{0,4}"), re.compile("[A-Z]{2,4}")
STOP, NEG = frozenset(lexicon.STOP), frozenset(lexicon.NEG)
NUMERALS = {k: str(v) for k, v in lexicon.NUMERALS.items()}
ENDINGS = frozenset("gdys")  # the last letters of what a stem or an alternative is without
SCALES = lexicon.SCALES
LAST = {k: v for k, v in SCALES.items() if len(k) == 1}

PIECE = 1 << 20  # characters that are split at once
WORDS = 400_000  # different words with their gaps, and
WORD_CHARS = 16 << 20  # characters in them, after which a worker forgets its words
SLICE = 8 << 20  # characters of texts that are held as codes at once
NOWHERE = np.iinfo(np.int64).max
MASK32 = np.uint64(0xFFFFFFFF)
SLOTS = 131_072
TEN = np.array([10.0**i for i in range(max(SCALES.values()) + 1)])

LEXICAL = ("p_hit", "p_tot", "an_content", "an_novel", "r_hit", "r_tot", "k_hit", "k_tot", "contra_w")
COUNTS = ("content_gt", "content_a", "adjacency_gt", "adjacency_a", "entity_gt", "entity_a", "gt_nums", "gt_nums_hit", "wrong_nums", "gt_fig", "gt_fig_hit", "foreign_fig", "agree", "contra", "silent", "two_faced")
ALL = {c: "double" for c in (*LEXICAL, "gram3", "gram2", "adjacency", "entity")} | {c: "long" for c in COUNTS} | {"negation_differs": "boolean"}


def _letters(s: str) -> int:
    """Lower-case letters as one number; different for strings of different length."""
    code = 0
    for c in s:
        code = code * 27 + ord(c) - 96
    return code


def _forms(tok: str, low: str, n: int) -> tuple[bool, str, str, str]:
    """(numeric, key, stem, alternative) of a token with its lower case and its number of bytes."""
    if low[-1] not in ENDINGS and low not in NUMERALS and tok.isalpha():
        return False, low, low, low  # most words
    wk = low.replace(",", "")
    if wk in NUMERALS or (not tok.isalpha() and DIGIT.search(tok) and not ALPHA.search(tok)):
        key = NUMERALS.get(wk, wk)
        return True, key, key, key
    cut = 3 if n >= 7 and low.endswith("ing") else 2 if n >= 6 and low.endswith(("ed", "ly", "es")) else 1 if n >= 5 and low.endswith("s") else 0
    stem = low[:-cut].replace(",", "") if cut else wk
    if n >= 5 and low.endswith("ed"):
        return False, wk, stem, low[:-1].replace(",", "")
    head = HEAD.match(low)[0]
    return False, wk, stem, head.replace(",", "") if head and len(head) < len(low) else wk


#: Bits of a word's flags; from bit 8 on stands the number of its first letter.
NUMERIC, CAP, NEGATION, NO, POLAR, BONUS = (1 << i for i in range(6))
RARE = dict(acro="i4", pre2="i4", pre3="i4", pre4="i4", scale="i1", wscale="i1", lead="f8", figure="i4", verdict="i1", authenticity="i1", direction="i1")
AXES = {w: [1 if w in pos else -1 if w in neg else 0 for _, pos, neg in lexicon.AXES] for _, p, m in lexicon.AXES for w in (*p, *m)}
#: Flags of the keys that have a meaning of their own, and of stop words.
MEANT = {k: (k in NEG) * NEGATION | (k == "no") * NO | (k in AXES) * POLAR for k in (*STOP, *NEG, *AXES, "no")}


def fnv1a(forms: list[str]) -> np.ndarray:
    """32-bit FNV-1a of each form; long ones take turns of their own, so that one of them does not widen all."""
    raw = [f.encode() for f in forms]
    out = np.empty(len(raw), "u8")
    size = np.fromiter(map(len, raw), "i8", len(raw))
    for low, high in ((0, 16), (16, 64)):
        at = np.flatnonzero((size >= low) & (size < high))
        if len(at):
            codes = np.array([raw[i] for i in at.tolist()], f"S{high}").view("u1").reshape(len(at), high)
            h = np.full(len(at), 2166136261, "u8")
            for j in range(int(size[at].max())):
                h = np.where(size[at] > j, ((h ^ codes[:, j]) * np.uint64(16777619)) & MASK32, h)
            out[at] = h
    for i in np.flatnonzero(size >= 64).tolist():
        h = 2166136261
        for b in raw[i]:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        out[i] = h
    return out


class Words(dict):
    """Codes of the tokens that a Python worker has met, each with the gap behind it: twice the number of the word, and 1
    if the gap ends a clause; attributes of words as arrays, and tables over their forms.

    Words are looked up while texts are split; :meth:`settle` then makes their attributes available.
    """

    def __init__(self):
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.forms: dict[str, int] = {}
        self.chars, self.fresh, self.rare = 0, array("i"), []  # fresh: five numbers for each new word
        self.hashed = np.empty(0, "u8")
        self.slots = np.zeros(SLOTS, "?")
        for c in ("key", "stem", "alt", "w", "flags"):
            setattr(self, c, np.empty(0, "i4"))
        for c, kind in RARE.items():
            setattr(self, c, np.empty(0, kind))
        self.settle()

    def __missing__(self, token: str) -> int:
        tok = token.rstrip(GAPS)
        number = self.numbers.get(tok)
        if number is None:
            number = self.numbers[tok] = len(self.numbers)
            self._learn(tok, number)
        self.chars += len(token)
        gap = token[len(tok) :]
        code = self[token] = 2 * number + (gap != " " and BOUND.search(gap) is not None)
        return code

    def _learn(self, tok: str, number: int) -> None:
        forms = self.forms
        if tok.isascii():
            low, n = tok.lower(), len(tok)
        else:
            raw = tok.encode()
            low, n = raw.lower().decode(), len(raw)  # bytes fold ASCII letters only
        numeric, key, stem, alt = _forms(tok, low, n)
        k = forms.setdefault(key, len(forms))
        s = k if stem == key else forms.setdefault(stem, len(forms))
        a = k if alt == key else forms.setdefault(alt, len(forms))
        cap, flags = "A" <= tok[0] <= "Z", MEANT.get(key, 0)
        if numeric:
            w, flags = 30000, flags | NUMERIC
        elif key in MEANT and key in STOP:
            w = 1200
        elif n > len(tok):
            w = 5000
        else:
            w = 10000 + 600 * min(n, 12)
            if cap:
                flags |= BONUS
        if cap:
            flags |= CAP
        if "a" <= low[0] <= "z":
            flags |= (ord(low[0]) - 96) << 8
        self.fresh.extend((k, s, a, w, flags))
        scale, lead = SCALES.get(key, 0), None
        wscale = scale if key == low else SCALES.get(low.replace(",", ""), 0)
        if "0" <= tok[0] <= "9":
            lead, last = FIGURE.match(tok), LAST.get(low[-1], 0) if n >= 2 else 0
            scale, wscale = scale or last, wscale or last
        if cap or numeric or scale or lead or wscale or flags & POLAR:
            starts = [0, 0, 0]
            if cap:
                pre = LETTERS.match(low)[0]
                code = 0
                for i, c in enumerate(pre):
                    code = code * 27 + ord(c) - 96
                    if i:
                        starts[i - 1] = code
            figure = k if numeric else a if a != k and scale else -1
            acronym = _letters(low) if cap and n <= 4 and ACRONYM.fullmatch(tok) else 0
            self.rare.append((number, acronym, *starts, scale, wscale, float(lead[0].replace(",", "")) if lead else 0.0, figure, *AXES.get(key, (0, 0, 0))))

    def settle(self) -> None:
        if self.fresh:
            fresh = np.array(self.fresh, "i4").reshape(-1, 5)
            for c, values in zip(("key", "stem", "alt", "w", "flags"), fresh.T):
                setattr(self, c, np.concatenate((getattr(self, c), values)))
            rows = list(zip(*self.rare)) or [()] * (len(RARE) + 1)
            at = np.array(rows[0], "i8")
            for (c, kind), values in zip(RARE.items(), rows[1:]):
                column = np.concatenate((getattr(self, c), np.full(len(fresh), -1 if c == "figure" else 0, kind)))
                column[at] = values
                setattr(self, c, column)
            self.fresh, self.rare = array("i"), []
        self.marks = np.zeros(len(self.forms), "?")
        self.firsts = np.full(len(self.forms), NOWHERE)

    def hashes(self) -> np.ndarray:
        """FNV-1a of all forms; those of new ones are found here."""
        if len(self.hashed) < len(self.forms):
            self.hashed = np.concatenate((self.hashed, fnv1a(list(islice(self.forms, len(self.hashed), None)))))
        return self.hashed

    @property
    def full(self) -> bool:
        return len(self) > WORDS or self.chars > WORD_CHARS

    def split(self, text: str) -> np.ndarray:
        """The codes of all tokens of a text."""
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (m := TOKEN.search(text, at + PIECE)):
                end = m.end()  # a token that begins before the search ends where this match ends
            found = TOKEN.findall(text, at, end)
            parts.append(np.fromiter(map(self.__getitem__, found), "i4", len(found)))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, "i4")


_of_worker: list = []


def worker_memory(fresh: bool = False) -> tuple[Words, dict]:
    """The words this Python worker has met and the questions and ground truths split with them: kept from task to task."""
    if fresh or not _of_worker:
        _of_worker[:] = [Words(), {}]
    return tuple(_of_worker)


class Text:
    """The tokens of one text as arrays, by position; what only some features need is made when it is asked for."""

    def __init__(self, words: Words, codes: np.ndarray, text: str):
        self.words, self.n = words, len(codes)
        self.bnd, self.codes = (codes & 1).astype("?"), codes >> 1
        codes, self.flags = self.codes, words.flags[self.codes]
        self.key, self.stem, self.alt = words.key[codes], words.stem[codes], words.alt[codes]
        self.w = words.w[codes].astype("i8")
        self.content = self.w > CONTENT
        bonus = (self.flags & BONUS) != 0
        if self.n and STARTS.match(text):
            bonus[0] = False  # the capital at the head of a text makes no name
        self.w[bonus] += 13000
        self.neg_word, self.numeric = (self.flags & NEGATION) != 0, (self.flags & NUMERIC) != 0
        self.scale, self.acro = words.scale[codes], words.acro[codes]
        self._neg = self._val = self._grams = self._ranked = None

    @property
    def neg(self) -> np.ndarray:
        """A negation among the four tokens before, and no clause end since."""
        if self._neg is None:
            self._neg = np.zeros(self.n, "?")
            if self.neg_word.any():
                at = np.arange(self.n)
                before = lambda mask: np.concatenate(([-1], np.maximum.accumulate(np.where(mask, at, -1))[:-1]))
                last = before(self.neg_word)
                self._neg = (last >= 0) & (last >= at - 4) & (last > before(self.bnd))
        return self._neg

    @property
    def val(self) -> np.ndarray:
        """Figures with the magnitude of their own or the next token."""
        if self._val is None:
            lead, power = self.words.lead[self.codes], self.words.wscale[self.codes]
            ten = TEN[power]
            own = np.where((lead > 0) & (power > 0), lead * ten, lead)
            following = np.ones(self.n)
            following[:-1] = np.where((lead[1:] == 0) & (power[1:] > 0), ten[1:], 1.0)
            self._val = own * following
        return self._val

    @property
    def ranked(self) -> np.ndarray:
        """Positions of the content tokens."""
        if self._ranked is None:
            self._ranked = np.flatnonzero(self.content)
        return self._ranked

    def mark(self, into: np.ndarray, value) -> None:
        for forms in (self.key, self.stem, self.alt):
            into[forms] = value


def in_set(words: Words, text: Text, *others: Text) -> list[np.ndarray]:
    """For each of the others: which of its tokens some form of ``text`` matches."""
    if not text.n:
        return [np.zeros(o.n, "?") for o in others]
    text.mark(words.marks, True)
    found = [words.marks[o.key] | words.marks[o.stem] | words.marks[o.alt] for o in others]
    text.mark(words.marks, False)
    return found


def first_places(words: Words, text: Text, keys: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of forms: the first position in ``text`` that has the form as key, stem or alternative, or NOWHERE."""
    if not text.n:
        return [np.full(len(k), NOWHERE) for k in keys]
    forms = np.stack((text.key, text.stem, text.alt), axis=1).ravel()[::-1]
    words.firsts[forms] = np.repeat(np.arange(text.n)[::-1], 3)  # of equal forms the last one written stays: the first position
    found = [words.firsts[k] for k in keys]
    words.firsts[forms] = NOWHERE
    return found


def bridge(words: Words, side: Text, other: Text, hit_side: np.ndarray, hit_other: np.ndarray) -> None:
    """Mark acronyms of ``side`` and the content tokens of ``other`` they stand for; see ``matching.acronym_bridges``."""
    if not side.acro.any() or not len(other.ranked):
        return
    codes = other.codes[other.ranked]
    initial = (words.flags[codes] >> 8).astype("i8")
    for n, low, high in ((2, 28, 729), (3, 757, 19683), (4, 20440, 531441)):
        mine = (side.acro >= low) & (side.acro < high)
        if not mine.any():
            continue
        wanted = np.unique(side.acro[mine])
        run, whole = np.zeros(len(codes), "i8"), np.zeros(len(codes), "?")
        if len(codes) >= n:
            parts = [initial[i : len(codes) - n + 1 + i] for i in range(n)]
            whole[: len(parts[0])] = np.logical_and.reduce([p > 0 for p in parts])
            for p in parts:
                run[: len(p)] = run[: len(p)] * 27 + p
        prefix = getattr(words, f"pre{n}")[codes].astype("i8")
        by_prefix, by_run = np.isin(prefix, wanted), np.isin(run, wanted) & whole
        first: dict[int, tuple[int, int]] = {}
        for rank in np.flatnonzero(by_prefix | by_run).tolist():
            if by_prefix[rank]:
                first.setdefault(int(prefix[rank]), (rank, rank))
            if by_run[rank]:
                first.setdefault(int(run[rank]), (rank, rank + n - 1))
        for rank, last in first.values():
            hit_other[other.ranked[rank : last + 1]] = True
        hit_side[mine & np.isin(side.acro, list(first))] = True


def hits(words: Words, gt: Text, a: Text) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of ground truth and answer that an acronym or a common magnitude matches."""
    hit_gt, hit_a = np.zeros(gt.n, "?"), np.zeros(a.n, "?")
    bridge(words, a, gt, hit_a, hit_gt)
    bridge(words, gt, a, hit_gt, hit_a)
    if gt.scale.any() and a.scale.any():
        for mine, theirs, hit in ((gt, a, hit_gt), (a, gt, hit_a)):
            hit |= (mine.scale > 0) & np.isin(mine.scale, theirs.scale)
    return hit_gt, hit_a


def lexical(words: Words, q: Text, gt: Text, a: Text) -> tuple[dict, np.ndarray]:
    """The sums of precision and recall (see ``features``), and where the answer has each token of the ground truth by its key."""
    hit_gt, hit_a = hits(words, gt, a)
    (a_found,) = in_set(words, gt, a)
    gt_in_q, a_in_q = in_set(words, q, gt, a)
    total = lambda t, mask: int(t.w[mask].sum())
    found = a_found | hit_a
    asked = a_in_q & ~found
    all_a, in_q_a = int(a.w.sum()), total(a, asked)
    by_key, by_stem, by_alt = first_places(words, a, [gt.key, gt.stem, gt.alt])
    spot = np.where(by_key < NOWHERE, by_key, np.where(by_stem < NOWHERE, by_stem, by_alt))
    matched = spot < NOWHERE
    against = ~hit_gt & matched & ~gt.neg & gt.content
    against[against] = a.neg[spot[against]]
    hard, beyond = hit_gt | (matched & ~against), ~gt_in_q
    return {
        "p_hit": total(a, found) / 1e4, "p_tot": (100 * (all_a - in_q_a) + 35 * in_q_a) / 1e6, "an_content": total(a, a.content) / 1e4, "an_novel": total(a, a.content & ~a_in_q) / 1e4,
        "r_hit": total(gt, hard) / 1e4, "r_tot": int(gt.w.sum()) / 1e4, "k_hit": total(gt, hard & beyond) / 1e4, "k_tot": total(gt, beyond) / 1e4, "contra_w": total(gt, against) / 1e4,
    }, by_key


def _mul32(x: np.ndarray, factor: int) -> np.ndarray:
    return x * np.uint32(factor)  # of 32-bit numbers: modulo 2**32


def _place(gram: np.ndarray) -> np.ndarray:
    """The slots of 32-bit grams."""
    return (_mul32(gram, 0x9E3779B1) >> np.uint32(13)) & np.uint32(SLOTS - 1)


def overlap(words: Words, grams: list[np.ndarray], others: np.ndarray) -> tuple[int, int]:
    """How many different slots the grams have, and how many of them are among ``others``."""
    places = [_place(g) for g in grams]
    for p in places:
        words.slots[p] = True
    found = int(np.count_nonzero(words.slots)), int(np.count_nonzero(words.slots[others]))
    for p in places:
        words.slots[p] = False
    return found


def different(grams: list[np.ndarray]) -> np.ndarray:
    """The different slots of grams."""
    return np.unique(np.concatenate([_place(g) for g in grams])) if grams else np.empty(0, "u4")


def dice(g: int, a: int, inter: int) -> float:
    return min(1.0, 2.0 * inter / (g + a)) if g and a else 0.0


def likeness(g: int, a: int, inter: int) -> float:
    return min(1.0, max(2.0 * inter / (g + a), inter / g)) if g and a else 0.0


_CODES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], "u4")


def byte_grams(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The byte trigrams and bigrams of a text, piece by piece; see ``text.with_gram_slots``."""
    raw, threes, twos = text.encode(), [], []
    tail, spaced = np.empty(0, "u4"), True  # the last two bytes kept, for the grams across pieces; leading spaces go
    for at in range(0, len(raw), PIECE):
        codes = _CODES[np.frombuffer(raw, "u1", min(PIECE, len(raw) - at), at)]
        letter = codes != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= not spaced
        spaced = not letter[-1]
        kept = np.concatenate((tail, codes[keep]))
        pairs = (kept[:-1] << np.uint32(8)) | kept[1:]
        twos.append(pairs)
        threes.append((pairs[:-1] << np.uint32(8)) | kept[2:])
        tail = kept[-2:]
    return threes, twos


def adjacency(words: Words, t: Text) -> np.ndarray:
    """Grams of neighbouring content stems."""
    h = words.hashes()[t.stem[t.ranked]].astype("u4")
    return h[:-1] ^ _mul32(h[1:], 0x85EBCA6B)


def entities(words: Words, t: Text) -> np.ndarray:
    """Grams of figures paired with the nearest capitalised content token within four tokens, the left one at equal distance."""
    figure = words.figure[t.codes]
    at = np.flatnonzero(figure >= 0)
    names = np.flatnonzero(t.content & ((t.flags & CAP) != 0)) if len(at) else at
    if not len(at) or not len(names):
        return np.empty(0, "u4")
    far = np.iinfo(np.int64).max // 4
    bounded = np.concatenate(([-far], names, [far]))
    left, right = bounded[np.searchsorted(names, at, "left")], bounded[np.searchsorted(names, at, "right") + 1]
    name = np.where(at - left <= right - at, left, right)
    near = np.abs(name - at) <= 4
    h = words.hashes()
    return h[t.stem[name[near]]].astype("u4") ^ _mul32(h[figure[at[near]]].astype("u4"), 0xC2B2AE35)


def close_to_any(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which figures of ``x`` some figure of ``y`` is within 0.5 % of: the nearest one below or above, if any."""
    if not len(y):
        return np.zeros(len(x), "?")
    y = np.sort(y)
    spot = np.searchsorted(y, x)
    out = np.zeros(len(x), "?")
    with np.errstate(invalid="ignore"):
        for there in (np.maximum(spot - 1, 0), np.minimum(spot, len(y) - 1)):
            most = np.maximum(np.abs(x), np.abs(y[there]))
            out |= np.abs(x - y[there]) / np.where(most > 1e-6, most, 1.0) <= 0.005
    return out


def numbers(words: Words, q: Text, gt: Text, a: Text, by_key: np.ndarray) -> dict:
    """Numeric tokens and figures; all 0 if the ground truth has no numeric token."""
    n = int(gt.numeric.sum())
    if not n:
        return dict.fromkeys(("gt_nums", "gt_nums_hit", "wrong_nums", "gt_fig", "gt_fig_hit", "foreign_fig"), 0)
    gt.mark(words.marks, True)
    q.mark(words.marks, True)
    wrong = int((~words.marks[a.key[a.numeric]]).sum())
    gt.mark(words.marks, False)
    q.mark(words.marks, False)
    g, x, asked = gt.val[gt.val > 0], a.val[a.val > 0], q.val[q.val > 0]
    foreign = np.abs(x - 1) >= 1e-6
    return {
        "gt_nums": n, "gt_nums_hit": int((by_key[gt.numeric] < NOWHERE).sum()), "wrong_nums": wrong, "gt_fig": len(g), "gt_fig_hit": int(close_to_any(g, x).sum()),
        "foreign_fig": int((foreign & ~close_to_any(x, np.concatenate((g, asked)))).sum()),
    }


def stance(words: Words, t: Text) -> list[tuple[int, bool]]:
    """(sign, mixed) for each axis; see ``polarity.stances``."""
    at = np.flatnonzero(t.flags & POLAR)
    if not len(at):
        return [(0, False)] * len(lexicon.AXES)
    codes = t.codes[at]
    turned = np.where(t.neg[at], -1, 1)
    turned[((t.flags[at] & NO) != 0) & ~t.bnd[at] & (t.n != 1)] = 0
    out = []
    for name, _, _ in lexicon.AXES:
        signs = getattr(words, name)[codes] * turned
        signs = signs[signs != 0]
        out.append((int(signs[0]), bool(signs.min() != signs.max())) if len(signs) else (0, False))
    return out


def tally(words: Words, gt: Text, a: Text, gram3: float) -> dict:
    out = dict.fromkeys(("agree", "contra", "silent", "two_faced"), 0)
    for (mine, _), (theirs, mixed) in zip(stance(words, gt), stance(words, a)):
        if mine:
            out["silent" if not theirs else "contra" if theirs != mine else "two_faced" if mixed and gram3 > 0.6 else "agree"] += 1
    return out | {"negation_differs": bool(gt.neg_word.any() != a.neg_word.any())}


def triple_features(words: Words, q: Text, gt: Text, a: Text, gt_text: str, a_text: str, only_lexical: bool) -> dict:
    out, by_key = lexical(words, q, gt, a)
    if only_lexical:
        return out
    if gt._grams is None:
        gt._grams = [different(g) for g in (*byte_grams(gt_text), [adjacency(words, gt)], [entities(words, gt)])]
    for kind, grams, theirs in zip(("gram3", "gram2", "adjacency", "entity"), (*byte_grams(a_text), [adjacency(words, a)], [entities(words, a)]), gt._grams):
        n, inter = overlap(words, grams, theirs)
        if kind in ("gram3", "gram2"):
            out[kind] = likeness(len(theirs), n, inter)
        else:
            out |= {kind: dice(len(theirs), n, inter), kind + "_gt": len(theirs), kind + "_a": n}
    out |= {"content_gt": len(gt.ranked), "content_a": len(a.ranked)}
    return out | numbers(words, q, gt, a, by_key) | tally(words, gt, a, out["gram3"])


def _slices(rows: list[tuple[str, str, str]]) -> Iterator[list[int]]:
    """Numbers of consecutive rows with ``SLICE`` characters at most, or one row."""
    part, size = [], 0
    for i, row in enumerate(rows):
        n = sum(map(len, row))
        if part and size + n > SLICE:
            yield part
            part, size = [], 0
        part.append(i)
        size += n
    if part:
        yield part


def whole_features(triples: DataFrame, only_lexical: bool = False) -> DataFrame:
    """The columns of (id, q, gt, a, ...) but the texts, and the features of the triple over its whole texts.

    Features are null where ground truth or answer has no token, or where a column ``guard`` is set.
    """
    columns = {c: ALL[c] for c in LEXICAL} if only_lexical else ALL
    kept = [f for f in triples.schema.fields if f.name not in ("q", "gt", "a")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} {kind}" for c, kind in columns.items()])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, memo = worker_memory()
        kinds = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
        for batch in batches:
            texts = [[s or "" for s in batch.column(c).to_pylist()] for c in ("q", "gt", "a")]
            rows = list(zip(*texts))
            set_already = batch.column("guard").is_valid().to_pylist() if "guard" in names else [False] * len(rows)
            for part in _slices(rows):
                if words.full:
                    words, memo = worker_memory(fresh=True)
                for i in part:
                    if not set_already[i]:
                        for s in rows[i][:2]:  # questions and ground truths come again and again
                            if s not in memo:
                                memo[s] = words.split(s)
                                words.chars += 64 + len(s)
                split = {i: words.split(rows[i][2]) for i in part if not set_already[i]}
                words.settle()
                found = []
                for i in part:
                    if i not in split or not len(split[i]):
                        found.append({})
                        continue
                    q, gt, a = rows[i]
                    for s in (q, gt):
                        if not isinstance(memo[s], Text):
                            memo[s] = Text(words, memo[s], s)
                    found.append(triple_features(words, memo[q], memo[gt], Text(words, split.pop(i), a), gt, a, only_lexical) if memo[gt].n else {})
                own = [batch.column(c).slice(part[0], len(part)) for c in names]
                made = [pa.array([f.get(c) for f in found], kinds[kind]) for c, kind in columns.items()]
                yield pa.RecordBatch.from_arrays(own + made, names=[*names, *columns])

    return triples.mapInArrow(run, schema)
