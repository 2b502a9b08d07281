"""Token ids of whole texts, as a tokenizers file gives them, at the price of the distinct words.

A tokenizers pipeline first cuts a text into pre-tokens and never merges across a cut. Two kinds of
cut are known without running it, so texts are cut there, each distinct piece is encoded once by the
tokenizers library and remembered, and a document's ids are its pieces' ids joined:

* spaced (byte-level patterns that glue one space to the word behind it): before white space, behind a line feed that has
  none on either side, and between a letter or digit and the punctuation behind it;
* words (white space dropped): at every space and line feed; in Latin-1 texts also between a letter or digit and the
  punctuation behind it.

Texts with other white space keep it inside their pieces, where the library treats it.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd

from quarrylight.llm.common import held

_ODD, _TAIL = re.compile(r"[\s\x01]"), ",.!?;:#*$%&|"
#: What a spaced piece must not hold, nor such pieces with line feeds between them, to stand between line feeds.
_ODD_SPACED = re.compile(r"[^\S \n]|\s[^\S ]| \s|\s\Z|\A\n")
_LETTERS, _TAILS = frozenset(string.ascii_letters), frozenset(_TAIL)
#: Latin-1 letters that lower-casing and normalisation leave alone; words of these, and the points that never join one.
_LOWER = string.ascii_lowercase + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_WORD, _POINTS = re.compile(f"[{_LOWER}]+"), ",.!?;:"
#: Of Latin-1 bytes: folded, in lower case and with spaces for line feeds; of these: 0 space, 1 letter or digit, 2 point, 3 other.
_FOLD = "".join(map(chr, range(256))).lower().replace("\n", " ").encode("latin-1")
_KIND = bytes(0 if c == " " else 1 if c in _LOWER + string.digits else 2 if c in _POINTS else 3 for c in map(chr, range(256)))
_MASK = np.array([256**k - 1 for k in range(9)], np.uint64)
#: Of UTF-8 bytes: 0 white space, 1 letter or digit, 2 point, 3 the first byte of wide white space, 4 other.
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_WHITE = "\t\n\v\f\r "
_SORT = bytes(
    0 if c in _WHITE else 1 if c.isalnum() else 2 if c in _TAIL else 4 for c in map(chr, range(128))
) + bytes(3 if any(w[0] == b for w in _WIDE) else 4 for b in range(128, 256))
_WIDE_KEYS = np.array([int.from_bytes(w.ljust(3, b"\0"), "big") for w in _WIDE])
#: What stands before a space that always begins a pre-token.
_APART = re.compile(rb"[!-~](?= [!-~])")
#: Letters behind which points stand apart: ASCII ones, and the two-byte ones of Latin-1.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_SPACED_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of text that are cut at once.
_RUN = 4 << 20


def latin_pieces(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The distinct pieces of folded Latin-1 texts, the number of each piece in that list, and the first piece of each
    text (and of what would follow).

    None if hashes of two clash.
    """
    raw = b" ".join(texts) + bytes(16)
    kind = np.frombuffer(raw[:-16].translate(_KIND), np.uint8)
    solid = kind > 0
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | ((kind[1:] == 2) & (kind[:-1] == 1))
    last[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    begin = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    cut = distinct(raw, start, end, 2)
    return cut and ([x.decode("latin-1") for x in cut[0]], cut[1], begin)


def spaced_pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray] | None:
    """The distinct pieces of texts in UTF-8, where white space belongs to what follows it; otherwise as latin_pieces, and
    behind that which pieces are only what stands between texts.
    """
    raw = b"\n".join([*texts, bytes(24)])
    octets = np.frombuffer(raw, np.uint8)
    sort = np.frombuffer(raw.translate(_SORT), np.uint8)
    edges = np.cumsum([len(t) + 1 for t in texts]) - 1
    white = sort == 0
    if len(wide := np.flatnonzero(sort == 3)):
        key = (octets[wide].astype(np.int64) << 16) + (octets[wide + 1].astype(np.int64) << 8)
        key += np.where(octets[wide] == 0xC2, 0, octets[wide + 2])
        wide = wide[np.isin(key, _WIDE_KEYS)]
        for k in range(3):
            white[wide[octets[wide] != 0xC2] + k if k == 2 else wide + k] = True
    white[edges] = False
    white, octets, sort = white[: edges[-1] + 1], octets[: edges[-1] + 1], sort[: edges[-1] + 1]
    first = white.copy()
    first[1:] &= ~white[:-1]
    # a line feed alone is a piece of its own
    feed = np.flatnonzero(first & (octets == 10))
    feed = feed[~white[feed + 1]]
    first[feed + 1] = True
    point = np.flatnonzero(sort == 2)
    point = point[point > 1]
    before = octets[point - 1]
    accented = (octets[point - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)
    first[point[(sort[point - 1] == 1) | accented]] = True
    first[edges] = first[0] = first[edges[:-1] + 1] = True
    start = np.flatnonzero(first)
    cut = distinct(raw, start, np.append(start[1:], len(first)), 3)
    return cut and (*cut, np.searchsorted(start, np.concatenate([[0], edges + 1])), np.searchsorted(start, edges))


def distinct(raw: bytes, start: np.ndarray, end: np.ndarray, words: int) -> tuple[list[bytes], np.ndarray] | None:
    """The distinct pieces among raw[start:end] and the number of each piece in that list; raw ends in 8 * words bytes of padding.

    Pieces of up to 8 * words bytes are told apart by these bytes as integers, longer ones by a dictionary. Equal numbers are
    checked to be equal pieces; None if hashes of two clash.
    """
    size = end - start
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the eight bytes from each place on
    held = [eight[start + np.minimum(size, 8 * k)] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(words)]
    far, seen = np.flatnonzero(size > 8 * words), {}
    held[0][far] = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start[far].tolist(), end[far].tolist())]
    for more in held[1:]:
        more[far] = 0
    held.append(np.minimum(size, 8 * words + 1).astype(np.uint64))
    mixed = (held[0] ^ (held[0] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + held[-1]
    for k, more in enumerate(held[1:-1]):
        mixed += more * np.uint64((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k])
    number, each = pd.factorize(mixed)
    one = np.empty(len(each), np.int64)
    one[number] = np.arange(len(number))  # a piece of each number
    if any((x[one][number] != x).any() for x in held):
        return None
    return [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())], number


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers. Null texts count as empty.

    Pieces are remembered in two generations of remember / 2 each: one that is met again moves to the younger, and when that
    is full it becomes the elder. So frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str, end_id: int, spaced: bool, remember: int = 300_000, longest: int = 80):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end = np.array([end_id], "<u4").tobytes()
        self.spaced, self.remember, self.longest = spaced, remember, longest
        self.known: dict[str | bytes, bytes] = {}  # spaced pieces are in UTF-8
        self.elder: dict[str | bytes, bytes] = {}
        rules = json.loads(self.tokenizer.to_str()).get("normalizer") or {}
        # where the normaliser lower-cases, a Latin-1 text may be lower-cased first: fewer pieces differ
        self.lower = any(x.get("type") == "Lowercase" for x in [rules, *rules.get("normalizers", [])])
        self.mark = "\n" if spaced else " \x01 "
        self.mark_ids = np.frombuffer(self._each([self.mark])[0], "<u4")
        self.words = None if spaced else self._for_words()
        self.points = (self._space_stands_apart() if spaced else self.lower) and self._points_stand_apart()
        self.model, self.letters = self.tokenizer.model, self._for_spaced_words() if spaced and self.points else None

    def _for_words(self):
        """The same model for texts of nothing but lower-case words, each of which is one pre-token. None if they may not be, or
        if ids do not tell where a word ends."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix, one = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.pre_tokenizer
        if not suffix or one is None or len(one.pre_tokenize_str(_LOWER)) != 1:
            return None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        words = Tokenizer(self.tokenizer.model)
        words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        pairs = " ".join(a + b for a in _LOWER for b in _LOWER)
        alike = [t.encode(pairs, add_special_tokens=False).ids for t in (words, self.tokenizer)]
        return words if alike[0] == alike[1] else None

    def _for_spaced_words(self) -> np.ndarray | None:
        """The model's character for each byte of a word of letters, with or without a space in front. None if such a word is
        not one pre-token with a character for each byte."""
        word = " " + string.ascii_letters + _ACCENTED
        (cut, _), *more = self.tokenizer.pre_tokenizer.pre_tokenize_str(word)
        if more or len(cut) != len(word.encode()):
            return None
        out = np.arange(256, dtype="<u4")
        out[list(word.encode())] = list(map(ord, cut))
        return out

    def _space_stands_apart(self) -> bool:
        """Whether a text as it stands may be cut in front of all white space (other control characters are none)."""
        one, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        return one is not None and self.tokenizer.normalizer is None and all(t.special for t in added) and all(
            (len(one.pre_tokenize_str("!" + c)) > 1) == (c > "\x1f" or c in _WHITE)
            for c in [*map(chr, range(33)), *(w.decode() for w in _WIDE)]
        )

    def _points_stand_apart(self) -> bool:
        one, letters = self.tokenizer.pre_tokenizer, string.ascii_letters + _ACCENTED if self.spaced else _LOWER
        return one is not None and all(
            one.pre_tokenize_str(c + p + c)[0][1] == (0, 1)
            for c in letters + string.digits
            for p in (_TAIL if self.spaced else _POINTS)
        )

    def _each(self, units: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        ]

    def _learn_words(self, words: list[str]) -> None:
        """Lower-case words go many to a text without a mark, as an id tells that it ends one."""
        texts = [words[i : i + 500] for i in range(0, len(words), 500)]
        for some, e in zip(texts, self.words.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                self.known.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _library(self, units: list[str], lead: str) -> dict[str, bytes]:
        """The ids of each unit. Units without white space go many to a text, a mark of one id between them."""
        out: dict[str, bytes] = {}
        texts = [units[i : i + 500] for i in range(0, len(units), 500)] if len(self.mark_ids) == 1 else []
        odd = (_ODD_SPACED if self.spaced else _ODD).search
        glue = "\n" if self.spaced else ""
        texts = [x if odd(glue.join(x)) is None else [u for u in x if odd(u) is None and "\n" not in u] for x in texts]
        for some, e in zip(
            texts,
            self.tokenizer.encode_batch_fast(
                [self.mark.join([lead + u for u in x]) for x in texts], add_special_tokens=False
            ),
        ):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_ids[0])
            if len(cuts) == len(some) - 1:
                raw, ends = ids.tobytes(), (cuts * 4).tolist()
                out.update(zip(some, map(raw.__getitem__, map(slice, [0, *(x + 4 for x in ends)], [*ends, len(raw)]))))
        rest = [u for u in units if u not in out] if len(out) < len(units) else []
        out.update(zip(rest, self._each([lead + u for u in rest])))
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encodes unseen pieces, where white space is dropped.

        An ASCII letter and the punctuation behind it never share a pre-token, so these are learnt apart. Other letters may
        end in a combining mark once they are normalised, and a mark does share one with punctuation.
        """
        known, elder = self.known, self.elder
        old = pieces & elder.keys()
        known.update(zip(old, map(elder.__getitem__, old)))
        fresh = pieces - old
        if self.words is not None:
            self._learn_words([p for p in fresh if _WORD.fullmatch(p)])
            fresh = fresh.difference(known)
        units = {p for p in fresh if p[-1:] not in _TAILS}
        joined: list[tuple[str, str, str]] = []  # piece, its head and its tail
        for p in fresh - units:
            head = p.rstrip(_TAIL)
            if head and head[-1] in _LETTERS:
                tail = p[len(head) :]
                units |= {head, tail}
                joined.append((p, head, tail))
            else:
                units.add(p)
        wanted = units.difference(known)
        old = wanted & elder.keys()
        known.update(zip(old, map(elder.__getitem__, old)))
        known.update(self._library(list(wanted - old), ""))
        for p, head, tail in joined:
            known[p] = known[head] + known[tail]

    def _recall(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct spaced pieces, remembered or learnt."""
        self._turn()
        each = list(map(self.known.get, pieces))
        gone = [i for i, x in enumerate(each) if x is None]
        names = [pieces[i] for i in gone]
        old = dict(zip(names, map(self.elder.get, names)))
        fresh = [p for p, x in old.items() if x is None]
        words = list(filter(_SPACED_WORD.fullmatch, fresh)) if self.letters is not None else []
        for lo in range(0, len(words), 2000):
            old.update(zip(some := words[lo : lo + 2000], self._spaced_words(some)))
        if len(words) < len(fresh):
            units = [p.decode() for p in fresh if old[p] is None]
            old.update((u.encode(), ids) for u, ids in self._library(units, "").items())
        self.known.update(old)
        for i, p in zip(gone, names):
            each[i] = old[p]
        self._forget_long(names)
        return each

    def _spaced_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are one pre-token each: the library's model takes them without looking for pre-tokens."""
        chars = self.letters[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le")
        tokens = list(map(self.model.tokenize, chars.split("\n")))
        raw = np.array([t.id for x in tokens for t in x], "<u4").tobytes()
        ends = (np.cumsum(list(map(len, tokens))) * 4).tolist()
        return list(map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def _pieces(self, text: str) -> list[str]:
        if self.lower and text.isascii():
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        parts, encoded = (_spaced_parts, self._encode_spaced) if self.spaced else (_latin_parts, self._encode_latin)
        for lo in range(0, len(texts), 1024):
            some = texts[lo : lo + 1024]
            flat = [parts(t) if t and self.points else None for t in some]
            quick = chain.from_iterable(map(encoded, _runs(chain.from_iterable(filter(None, flat)))))
            rest = iter(self._encode([t for t, x in zip(some, flat) if x is None]))
            out += [(next(rest) if x is None else b"".join(islice(quick, len(x)))) + self.end for x in flat]
        return out

    def _turn(self) -> None:
        if len(self.known) > self.remember // 2:
            self.elder, self.known = self.known, {}

    def _know(self, distinct: set[str]) -> None:
        self._turn()
        self._learn(distinct.difference(self.known))

    def _forget_long(self, distinct: Iterable[str | bytes]) -> None:
        """Long ones are rare and large."""
        for p in [p for p in distinct if len(p) > self.longest]:
            self.known.pop(p, None)

    def _encode_latin(self, texts: list[bytes]) -> list[bytes]:
        """As _encode, for texts in Latin-1: a piece is looked up once for all its places, and ids are gathered by these."""
        if (cut := latin_pieces(texts)) is None:
            return self._encode([t.decode("latin-1") for t in texts])
        pieces, number, begin = cut
        self._know(set(pieces))
        each = list(map(self.known.__getitem__, pieces))
        self._forget_long(pieces)
        return _gathered(each, number, begin)

    def _encode_spaced(self, texts: list[bytes]) -> list[bytes]:
        """Likewise, for spaced texts of all characters in UTF-8."""
        if (cut := spaced_pieces(texts)) is None:
            return self._each([t.decode() for t in texts])
        pieces, number, begin, between = cut
        return _gathered(self._recall(pieces), number, begin, between)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if self.spaced:
            return [self._whole(t) for t in texts]
        cut = [self._pieces(t) if t else None for t in texts]
        distinct = set(chain.from_iterable(filter(None, cut)))
        self._know(distinct)
        out = [b"".join(map(self.known.__getitem__, pieces)) if pieces else b"" for pieces in cut]
        self._forget_long(distinct)
        return out

    def _whole(self, text: str | None) -> bytes:
        return self._each([text])[0] if text else b""


def _gathered(each: list[bytes], number: np.ndarray, begin: np.ndarray, between: np.ndarray | None = None) -> list[bytes]:
    """The ids of each text, from those of each distinct piece; pieces between texts give none."""
    held = np.frombuffer(b"".join(each), "<u4")
    n = np.fromiter(map(len, each), np.int64, len(each)) // 4
    at, n = (np.cumsum(n) - n)[number], n[number]
    if between is not None:
        n[between] = 0
    ends = np.cumsum(n)
    ids = held[np.repeat(at - (ends - n), n) + np.arange(n.sum())].tobytes()
    bounds = (np.concatenate([[0], ends])[begin] * 4).tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def _spaced_parts(text: str) -> list[bytes]:
    """A text in UTF-8, cut at spaces between visible ASCII characters if it is longer than a run."""
    raw, out, lo = text.encode(), [], 0
    while len(raw) - lo > _RUN:
        near = [m.end() for m in _APART.finditer(raw, lo + max(1, _RUN - 65536), lo + _RUN)]
        if not near and (far := _APART.search(raw, lo + _RUN)) is None:
            break
        at = near[-1] if near else far.end()
        out.append(raw[lo:at])
        lo = at
    return [*out, raw[lo:]]


def _latin_parts(text: str) -> list[bytes] | None:
    """A text in Latin-1, folded, and cut at spaces if it is longer than a run; None if it has other characters."""
    try:
        raw = text.encode("latin-1").translate(_FOLD)
    except UnicodeEncodeError:
        return None
    out, lo = [], 0
    while len(raw) - lo > _RUN:
        if (at := raw.rfind(b" ", lo, lo + _RUN)) < 0 and (at := raw.find(b" ", lo + _RUN)) < 0:
            break
        out.append(raw[lo:at])
        lo = at + 1
    return [*out, raw[lo:]]


def _runs(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > _RUN:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encoder(path: str, end_id: int, spaced: bool, remember: int = 300_000) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    return held(f"{path} {end_id} {spaced} {remember}", lambda: Encoder(path, end_id, spaced, remember))
