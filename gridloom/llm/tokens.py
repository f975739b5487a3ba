"""Tokenizing with the public ``tokenizers`` library, cached by word.

No pre-token of either vocabulary reaches across the gap before a word, so that the ids of a text are those of its
words behind one another, and a word that a worker has seen needs no second encoding. Whole texts go to the
library where the gaps aren't single spaces.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker, the first that come, some 200 bytes each. Others are encoded anew each time.
CACHE_WORDS = 400_000
#: Marks that are told from the letter or digit before them when the two together are new.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer words aren't kept.
CACHE_LENGTH = 64
#: Words whose ids are laid out together, and ids of a word above which words are joined one by one.
WORDS_AT_ONCE, LONG_WORD = 1 << 17, 1 << 10

_letters = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Letters whose lower case depends on who lowers it.
_odd_case = ("\u03a3", "\u0130")
#: What Python splits at and the library doesn't.
_odd_split = ("\x1c", "\x1d", "\x1e", "\x1f")
#: White space of ASCII other than blank and line feed; of all of Unicode, as any of the libraries involved defines it.
_ascii_space = ("\t", "\x0b", "\x0c", "\r", *_odd_split)
_other_space = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _holds(text: str, marks: tuple[str, ...]) -> bool:
    for m in marks:  # a scan of memory each, far quicker than a pattern
        if m in text:
            return True
    return False


def _plain(text: str) -> bool:
    """Whether every gap between words is one blank or one line feed."""
    if text[:1] in " \n" or text[-1:] in " \n" or _holds(text, ("  ", "\n ", " \n", "\n\n")):
        return False
    return not (_holds(text, _ascii_space) if text.isascii() else _other_space.search(text))


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` behind one another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


_held: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool, cache_words: int = CACHE_WORDS) -> "Encoder":
    """This process's encoder of a vocabulary file. ``spaced``: a word's ids depend on the space before it."""
    if (path, spaced) not in _held:
        _held[path, spaced] = Encoder(path, spaced, cache_words)
    return _held[path, spaced]


class Encoder:
    def __init__(self, path: str, spaced: bool, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library makes a token of wherever they stand in a text.
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        start = os.path.commonprefix(sorted(added))  # one scan finds them all where they begin alike
        self.added = (start,) if len(start) > 1 else tuple(sorted(added))
        self.spaced, self.room = spaced, cache_words
        self.lower = self.whole(["Aa Bb"]) == self.whole(["aa bb"])  # the vocabulary has no upper case
        self.cache: dict[str, bytes] = {"": b""}
        pieces = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(pieces.values()) + 1, bool)  # ids that begin a unit, or end a pre-token
        self.edge[[i for w, i in pieces.items() if (w.startswith("\u0120") if spaced else w.endswith("</w>"))]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_breaks(self, words: list[str]) -> list[bytes]:
        """The ids of words that have no blank before them: as lines of one text, told apart by the ids of its breaks."""
        raw = self.whole(["".join(["\n" + w[1:] for w in words])])[0]
        mark = self.whole(["\n"])[0]
        at = np.flatnonzero(np.frombuffer(raw, np.uint32) == np.frombuffer(mark, np.uint32)[0]) * 4 if len(mark) == 4 else ()
        if len(at) != len(words):  # not a vocabulary of the kind expected
            return self.whole([w[1:] if w[0] == "\t" else w for w in words])
        bounds = [*at.tolist(), len(raw)]
        return [raw[a + 4 if w[0] == "\t" else a : b] for w, a, b in zip(words, bounds, bounds[1:])]

    def units(self, words: list[str]) -> list[bytes]:
        """The ids of each word; most go to the library as one text, whose ids are told apart by their edges."""
        if self.spaced:
            plain = [w[0] != "\n" and w[0] != "\t" for w in words]
        else:
            plain = [_letters.fullmatch(w) is not None for w in words]
        some = [w for w, p in zip(words, plain) if p]
        rest = [w for w, p in zip(words, plain) if not p]
        found = iter(self.after_breaks(rest) if self.spaced and rest else self.whole(rest))
        if not some:
            return list(found)
        ids = np.frombuffer(self.whole([" " + " ".join(some)])[0], np.uint32)
        at = np.flatnonzero(self.edge[ids])
        cuts = at[1:] if self.spaced else at[:-1] + 1
        if len(at) != len(some):  # not a vocabulary of the kind expected
            joined = iter(self.whole([" " + w for w in some] if self.spaced else some))
        else:
            bounds = [0, *(cuts * 4).tolist(), len(ids) * 4]
            raw = ids.tobytes()
            joined = (raw[a:b] for a, b in zip(bounds, bounds[1:]))
        return [next(joined) if p else next(found) for p in plain]

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from the cache or from the library."""
        held = self.cache
        ids = list(map(held.get, words))
        if None not in ids:
            return ids
        at = [i for i, x in enumerate(ids) if x is None]
        asked = [words[i] for i in at]
        marked = {}
        for w in asked:
            if w[-1:] in MARKS:  # marks after a letter or digit are a pre-token by themselves
                stem = w.rstrip(MARKS)
                if stem[-1:] < "\u0530" and stem[-1:].isalnum():  # letters that all versions of Unicode know
                    marked[w] = stem, ("\t" if self.spaced else "") + w[len(stem) :]
        need = dict.fromkeys(chain((w for w in asked if w not in marked), chain.from_iterable(marked.values())))
        need = [w for w in need if w not in held]
        new = dict(zip(need, self.units(need)))
        for w, (stem, tail) in marked.items():
            new[w] = (new[stem] if stem in new else held[stem]) + (new[tail] if tail in new else held[tail])
        for i, w in zip(at, asked):
            ids[i] = new[w]
        if len(held) < self.room:
            held.update({w: x for w, x in new.items() if len(w) <= CACHE_LENGTH})
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each whole text's ids, as unsigned 32-bit integers. Texts are split, and their words numbered, by Arrow."""
        plain, lines, odd = [], [], []
        for no, text in enumerate(texts):
            low = text.lower() if self.lower and not _holds(text, _odd_case) else text
            if _holds(low, self.added) or (not _plain(text) if self.spaced else _holds(text, _odd_split)):
                odd.append(no)
                continue
            plain.append(no)
            if self.spaced:  # a word stands for itself with a blank before it; the first has none
                lines.append("\t" + text.replace("\n", " \n"))
            else:
                lines.append(low if low.isascii() or not _other_space.search(low) else " ".join(low.split()))
        out: dict[int, np.ndarray] = {}
        if lines:
            rows = pa.array(lines, pa.large_string())
            rows = pc.split_pattern(rows, " ") if self.spaced else pc.ascii_split_whitespace(rows)
            numbered = rows.flatten().dictionary_encode()
            every = numbered.dictionary
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
            ids = self.known(words)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            code, flat = numbered.indices.to_numpy(), np.frombuffer(b"".join(ids), np.uint32)
            starts = np.cumsum(lengths) - lengths
            if lengths.max() > LONG_WORD:
                found = np.frombuffer(b"".join([ids[c] for c in code.tolist()]), np.uint32)
            else:
                blocks = (code[k : k + WORDS_AT_ONCE] for k in range(0, len(code), WORDS_AT_ONCE))
                found = np.concatenate([spread(flat, starts[c], lengths[c]) for c in blocks])
            ends = np.append(0, np.cumsum(lengths[code]))[rows.offsets.to_numpy()].tolist()
            out = {no: found[a:b] for no, a, b in zip(plain, ends, ends[1:])}
        for no, ids in zip(odd, self.whole([texts[no] for no in odd])):
            out[no] = np.frombuffer(ids, np.uint32)
        return [out[no] for no in range(len(texts))]
