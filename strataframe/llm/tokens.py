"""Token ids of whole texts by the tokenizers library, inside tasks.

Most words come again and again, so a text is cut where no token can cross and
the ids of each distinct piece are kept.  Cuts where that isn't certain are not
made.  Where a space belongs to the word after it, all texts of a slice are cut at
once into words with their spaces, marks and numbers, so that a word is one piece
whatever stands behind it.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept

#: Bytes of kept pieces in a Python worker, over all caches of an encoder.
CACHE_BYTES = 128 << 20
#: Bytes that an entry takes besides its letters and ids, as measured over 360,000.
_ENTRY_BYTES = 140
#: Bytes of text whose pieces are looked up at once.
SLICE_BYTES = 1 << 20
#: Unknown pieces that go to the tokenizer as one text.
_TOGETHER = 64

#: White space to Python but not to the tokenizer.
_CONTROL_SPACE = "\x1c\x1d\x1e\x1f"
#: How byte-level vocabularies write a space.
_BYTE_SPACE = "\u0120"
#: How they write each byte: printable ones of Latin-1 as they are, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_BYTE_LETTERS = [chr(b if b in _PRINTED else 256 + _HIDDEN.index(b)) for b in range(256)]
_INNER_SPACE = re.compile(r"\S\s|\s\s")
#: Between pieces when they are cut; a text that holds it isn't.
_CUT = "\0"
#: Letters from here on may be newer than the tokenizer's tables; no white space stands beyond the second.
_LETTERS_END, _SPACE_END = 0x530, 0x3001
_UNSURE, _LETTER, _DIGIT, _MARK, _OTHER, _SPACE, _BREAK = range(7)
_encoders: dict[str, "Encoder"] = kept()


def _kind(c: str) -> int:
    if c in " \t\n\v\f\r":
        return _SPACE if c == " " else _BREAK
    if c == _CUT or c.isspace() or c > "\x7f" and unicodedata.category(c)[0] in "ZC":
        return _UNSURE
    if c.isalpha() and ord(c) < _LETTERS_END:
        return _LETTER
    if c.isascii() and c.isprintable() and c != "'":  # an apostrophe may begin a token of letters
        return _DIGIT if c.isdigit() else _MARK
    return _OTHER


def _of_letters(piece: str) -> bool:
    """Whether a piece, which may have a space before it, is of letters that every table knows."""
    bare = piece[1:] if piece[:1] == " " else piece
    return bare.isalpha() and (bare.isascii() or ord(max(bare)) < _LETTERS_END)


_KINDS = np.array([_kind(chr(c)) for c in range(_SPACE_END)] + [_OTHER], np.uint8)


def cut_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of all texts one after another, and where each text ends among them.

    Letters, digits and marks are apart, with a space before them.  Of white space before
    something else the last character is apart from the rest, as the tokenizer has it.
    At the end of each text stands ``_CUT``, which none of them may hold.
    """
    joined = "".join([part for text in texts for part in (text, _CUT)])
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = _KINDS.take(codes, mode="clip")
    solid, blank = (kinds >= _LETTER) & (kinds <= _OTHER), kinds >= _SPACE
    known = solid & (kinds < _OTHER)
    cut = np.ones(len(codes), bool)
    cut[1:] = known[:-1] & known[1:] & (kinds[:-1] != kinds[1:])
    cut[1:] |= solid[:-1] & blank[1:]
    cut[1:-1] |= blank[1:-1] & solid[2:]
    cut[1:] |= (kinds[:-1] == _BREAK) & solid[1:]
    ends = np.cumsum([len(text) + 1 for text in texts])
    cut[ends - 1] = True
    cut[ends[:-1]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(codes))
    if not joined.isascii():
        widths = np.ones(len(codes), np.int8)
        for least in (0x80, 0x800, 0x10000):
            widths += codes >= least
        offsets = np.append(0, np.cumsum(np.add.reduceat(widths, starts, dtype=np.int64)))
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined.encode()))
    return pieces, np.searchsorted(starts, ends - 1)


class _Pieces:
    """Ids of pieces in two generations; what isn't asked for in one of them goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def find(self, pieces: Iterable[str]) -> tuple[dict[str, bytes | None], list[str]]:
        """Ids of each piece or None, and the pieces whose ids aren't kept."""
        found = dict(zip(pieces, map(self.young.get, pieces), strict=True))
        missing = [x for x, ids in found.items() if ids is None]
        if self.old and missing:
            again = {x: ids for x, ids in zip(missing, map(self.old.get, missing), strict=True) if ids is not None}
            found.update(again)
            self.keep(again)
            missing = [x for x in missing if x not in again]
        return found, missing

    def keep(self, learned: dict[str, bytes]) -> None:
        """Keeps pieces that aren't in the young generation."""
        self.young.update(learned)
        self.size += sum(map(len, learned)) + sum(map(len, learned.values())) + _ENTRY_BYTES * len(learned)

    def grow_old(self) -> None:
        self.old, self.young, self.size = self.young, {}, 0


class Encoder:
    """Ids as little-endian unsigned numbers of 2 bytes, or 4 if ids need them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype(f"<u{self.width}")
        # A normaliser that drops white space: words are alone.  Otherwise a
        # space before a word belongs to it.
        sample = [x.ids for x in self.tokenizer.encode_batch(["a b", "a", "b"], add_special_tokens=False)]
        self.drops_space = sample[0] == sample[1] + sample[2]
        # Between pieces that go together stands a mark that is a token of its own.
        self.mark, self.between = ("|", " | ") if self.drops_space else ("\n", "\n")
        mark_ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark_ids[0] if len(mark_ids) == 1 else None
        self.takes_letters = self._takes_letters()
        self.ends = dict(zip(",.", self._encode([",", "."]), strict=True))
        self.pieces = _Pieces()
        self.first = self.later = self.pieces

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _split_at_marks(self, ids: bytes, pieces: list[str]) -> list[bytes]:
        marks = (np.flatnonzero(np.frombuffer(ids, self.dtype) == self.mark_id) * self.width).tolist()
        if len(marks) != len(pieces) - 1:  # a piece that holds the mark's id in some other way
            return self._encode(pieces)
        starts = [0, *(mark + self.width for mark in marks)]
        return [ids[lo:hi] for lo, hi in zip(starts, [*marks, len(ids)], strict=True)]

    def _encode_together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but at the beginning, and without the mark."""
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._encode([self.between.join(g) for g in groups]), strict=True):
            out += self._split_at_marks(ids, group)
        return out

    def _encode_letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters, which the model takes without its other steps."""
        code, tokenize = self.code, self.tokenizer.model.tokenize
        if self.drops_space:
            return [array(code, [t.id for t in tokenize(x.lower())]).tobytes() for x in pieces]
        shown = [x.replace(" ", _BYTE_SPACE) if x.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, x.encode())) for x in pieces]
        return [array(code, [t.id for t in tokenize(x)]).tobytes() for x in shown]

    def _takes_letters(self) -> bool:
        """Whether the model alone gives what the whole tokenizer gives, for sample words."""
        words = ["a", "the", "The", "hello", "OUTSIDE", "retitioning", "zqxj", "internationalization", "Mixed"]
        if not self.drops_space:
            words += ["déjà", "ŒUVRE", "ÿßµªº", "слово", "ΣΑΣ"]
            words += [" " + x for x in words]
        try:
            return self._encode_letters(words) == self._encode(words)
        except Exception:  # a model of another kind
            return False

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't kept; some that they are made of may be among them."""
        learned: dict[str, bytes] = {}
        other = set(missing)
        # A comma or full stop after a letter is a token of its own in any case.
        ended = [x for x in missing if len(x) > 1 and x[-1] in ",." and x[-2].isalpha()]
        if ended:
            other.difference_update(ended)
            known, unknown = self.pieces.find({x[:-1] for x in ended})
            learned.update((x, ids) for x, ids in known.items() if ids is not None)
            other.update(unknown)
        if self.takes_letters:
            letters = [x for x in other if (x.isascii() and x.isalpha() if self.drops_space else _of_letters(x))]
            learned.update(zip(letters, self._encode_letters(letters), strict=True))
            other.difference_update(letters)
        if self.mark_id is None:
            alone, together = list(other), []
        else:
            alone = [x for x in other if self.mark in x or _INNER_SPACE.search(x) or not x.strip()]
            together = list(other.difference(alone))
        learned.update(zip(alone, self._encode(alone), strict=True))
        learned.update(zip(together, self._encode_together(together), strict=True))
        learned.update((x, learned[x[:-1]] + self.ends[x[-1]]) for x in ended)
        return learned

    def _look_up(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each of distinct pieces, in their order."""
        found, missing = self.pieces.find(pieces)
        if missing:
            learned = self._learn(missing)
            found.update(learned)
            self.pieces.keep(learned)
            if self.pieces.size > CACHE_BYTES // 2:
                self.pieces.grow_old()
        return found

    def _cut(self, text: str) -> list[str] | None:
        """Words of a text; None where the cuts aren't certain."""
        if any(c in text for c in _CONTROL_SPACE):
            return None
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()  # the same as the tokenizer's own for these letters
            except UnicodeEncodeError:
                pass
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, one bytes object per text."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and looking for them costs a tenth of the time
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        if self.drops_space:
            cuts = [self._cut(text) for text in texts]
            whole = [i for i, cut in enumerate(cuts) if cut is None]
            out = self._encode_words([cut or [] for cut in cuts])
        else:
            whole = [i for i, text in enumerate(texts) if "<|" in text or _CUT in text]
            out = self._encode_cut(["" if "<|" in text or _CUT in text else text for text in texts] if whole else texts)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        return out

    def _encode_words(self, cuts: list[list[str]]) -> list[bytes]:
        """Ids of texts by their words."""
        words = [word for cut in cuts for word in cut]
        ids = list(map(self.pieces.young.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        found = self._look_up({words[i] for i in gaps})
        for i in gaps:
            ids[i] = found[words[i]]
        ends = np.cumsum([len(cut) for cut in cuts], dtype=np.int64).tolist()
        return [b"".join(ids[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose pieces are told apart as a column, before they become strings."""
        if not texts:
            return []
        pieces, ends = cut_pieces(texts)
        coded = pieces.dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        found[_CUT] = b""
        ids = pa.array(found.values(), pa.large_binary()).take(coded.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ends].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip([0, *offsets], offsets, strict=False)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(batch: pa.RecordBatch, text: str, slice_bytes: int = SLICE_BYTES):
    """Row ranges of a batch with their texts, of limited bytes; null is empty."""
    column = pc.fill_null(batch.column(text), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + slice_bytes, side="right")))
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist()
        lo = hi
