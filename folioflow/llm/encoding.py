"""Encoding whole texts with a public vocabulary, each distinct chunk of text about once per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, begin

#: encodes chunks into packed token ids
Encode = Callable[[list[str]], list[bytes]]

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: a Latin letter before an ASCII sign (no quote): a match of the split pattern ends there
_WORD_SIGN = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~])"
#: begins a chunk that had no blank before it
APART = "\x01"
_LATIN_WORD = re.compile(rf" ?[{_LETTERS}]{{1,64}}")
#: a lone space between characters that are no white space: a match of the split pattern begins there
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: bytes of chunks a worker remembers, and the longest chunk that is worth it
MEMO_BYTES, LONG_CHUNK = 96 << 20, 256


class ChunkMemo(dict):
    """Chunks with their ids up to about ``limit`` bytes; a full memo drops the half it has held longest."""

    #: bytes of an entry besides its texts: two objects and their places in the dict
    ENTRY = 200

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0

    def of(self, chunks: list[str], encode: Callable[[list[str]], list]) -> list:
        """Ids of the chunks; what the memo lacks is encoded, and kept if it is short."""
        out = list(map(self.get, chunks))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        new = [chunks[i] for i in missing]
        found = encode(new)
        for i, ids in zip(missing, found):
            out[i] = ids
        kept = {chunk: ids for chunk, ids in zip(new, found) if len(chunk) <= LONG_CHUNK}
        size = self.ENTRY * len(kept) + sum(map(len, kept)) + sum(map(len, filter(None, kept.values())))
        if self.held + size > self.limit:
            for chunk in list(islice(self, len(self) // 2)):
                del self[chunk]
            self.held //= 2
        if size <= self.limit:
            self.update(kept)
            self.held += size
        return out


class _Split:
    """Texts split at blanks, all chunks of a batch as numbers of distinct ones."""

    def __init__(self, texts: list[str]):
        cut = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _WORD_SIGN, rf"\1 {APART}\2")
        parts = pc.split_pattern(cut, " ")
        coded = parts.flatten().dictionary_encode()
        self.chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.index = coded.indices.to_numpy()
        sizes = parts.value_lengths().to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def joined(self, ids: list) -> tuple[memoryview, np.ndarray]:
        """The ids of all chunks in their order, and where each begins."""
        taken = pa.array([i or b"" for i in ids], pa.large_binary()).take(pa.array(self.index))
        _, places, data = taken.buffers()
        at = np.frombuffer(places, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        return memoryview(data) if data is not None else memoryview(b""), at


class WordEncoder:
    """Token ids of texts, as packed integers, for tokenizers that drop white space.

    Every blank separates chunks, and a word of letters encodes apart from the ASCII signs behind it, so
    words are known with whatever sign follows them. ``lower`` says that the tokenizer lower-cases, so
    that words of any case are one. Texts with one of the strings ``specials`` are encoded whole.
    """

    def __init__(self, encode: Encode, lower: bool = False, specials: Sequence[str] = ()):
        self.encode, self.lower, self.specials = encode, lower, list(specials)
        self.memo = ChunkMemo()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.specials)]
        if not special:
            return self._texts(texts) if texts else []
        plain = list(texts)
        for i in special:
            plain[i] = ""
        out = self._texts(plain)
        for i in special:
            out[i] = self.encode([texts[i]])[0]
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes | bool]:
        return self.encode([c.removeprefix(APART) for c in chunks])

    def _lowered(self, text: str) -> str:
        """A text of Latin-1 letters in lower case; in others, case can depend on neighbours."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        # a text that only lower case gives a special token's string stays as it is
        return text if any(x in low for x in self.specials) else low

    def _texts(self, texts: list[str]) -> list[bytes]:
        texts = [self._lowered(t) if self.lower else t for t in texts]
        # the sign that begins chunks is no part of a word wherever it stands in a text
        blank = str.maketrans(dict.fromkeys("\n\t\r", " "))
        split = _Split([t.replace(APART, f" {APART}{APART}").translate(blank) if APART in t else
                        t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts])
        data, at = split.joined(self.memo.of(split.chunks, self._chunks))
        return [bytes(data[at[a] : at[b]]) for a, b in zip(split.starts, split.ends)]


class ChunkEncoder(WordEncoder):
    """For byte-level tokenizers, where white space has ids: a text is cut before lone blanks.

    A space or line end between two characters that are not white space always begins a new match of the
    split pattern, so what is before and after it encodes independently. The memo knows chunks by the
    text behind their space, or with their line end; False marks one that touches other white space, and
    a text that holds such a chunk is cut before lone spaces only.
    """

    def __init__(self, encode: Encode, specials: Sequence[str] = ()):
        super().__init__(encode, specials=specials)
        self.whole, self.line_end = ChunkMemo(MEMO_BYTES // 5), encode(["\n"])[0]

    def _chunks(self, chunks: list[str]) -> list[bytes | bool]:
        plain, ends, safe = [], [], []
        for chunk in chunks:
            first = chunk[:1]
            inner = chunk[1:] if first == "\n" or first == APART else chunk
            good = bool(inner) and not inner[0].isspace() and not inner[-1].isspace()
            safe.append(good)
            if good:
                plain.append(inner if inner is not chunk else " " + inner)
                ends.append(first == "\n")
        found = iter([self.line_end + ids if end else ids for ids, end in zip(self.encode(plain), ends)])
        return [next(found) if good else False for good in safe]

    def _texts(self, texts: list[str]) -> list[bytes]:
        split = _Split([t.replace("\n", " \n") for t in texts])
        ids = self.memo.of(split.chunks, self._chunks)
        data, at = split.joined(ids)
        firsts = [split.chunks[i] for i in split.index[split.starts]]
        # a chunk that touches other white space counts behind the first only
        touching = np.fromiter((i is False for i in ids), bool, len(ids))[split.index]
        touching[split.starts] = [not f or f[-1].isspace() or APART in t for f, t in zip(firsts, texts)]
        odd = np.logical_or.reduceat(touching, split.starts)
        plain = np.nonzero(~odd)[0].tolist()
        begun = self.whole.of([firsts[i] for i in plain], self.encode)
        out = [b""] * len(texts)
        for i, first in zip(plain, begun):
            out[i] = first + data[at[split.starts[i] + 1] : at[split.ends[i]]]
        rest = np.nonzero(odd)[0].tolist()
        cut = [_LONE_SPACE.split(texts[i]) for i in rest]
        chunks = list({c for p in cut for c in p})
        known = dict(zip(chunks, self.whole.of(chunks, self.encode)))
        for i, p in zip(rest, cut):
            out[i] = b"".join(map(known.__getitem__, p))
        return out


def held(operator: str, key: tuple, make: Callable[[], object]):
    """The worker's encoder for an operator, kept between tasks until another operator begins."""
    begin(operator)
    if key not in KEPT:
        KEPT[key] = make()
    return KEPT[key]


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def tokenizer_encode(path: str, dtype: str, lower: bool = False) -> Encode:
    """The tokenizers library over a byte-level vocabulary file, as it is loaded: no special tokens are added.

    The string of a special token in a text has that token's id, as the library has it by default.
    A chunk that is one Latin word is what the split pattern would make of it, so it goes to the
    library's model at once; ``lower`` says that the vocabulary's own normaliser lower-cases. All other
    chunks go through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()
    code, spaced = {"<u2": "H", "<u4": "I"}[dtype], chr(letters[32])

    def whole(chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            found = tokenizer.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)
            out.extend(array(code, e.ids).tobytes() for e in found)
        return out

    def encode(chunks: list[str]) -> list[bytes]:
        out, rest = [b""] * len(chunks), []
        match = _LATIN_WORD.fullmatch
        for i, chunk in enumerate(chunks):
            if not match(chunk):
                rest.append(i)
                continue
            word = chunk.lower() if lower else chunk
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            elif word[0] == " ":
                word = spaced + word[1:]
            out[i] = array(code, [t.id for t in tokenize(word)]).tobytes()
        for i, ids in zip(rest, whole([chunks[i] for i in rest])):
            out[i] = ids
        return out

    return encode


def id_type(largest_id: int) -> str:
    """The narrowest packed type for ids: two bytes do for ids below 65536."""
    return "<u2" if largest_id < 1 << 16 else "<u4"


def special_tokens(path: str) -> list[str]:
    """The strings that a vocabulary file gives ids of their own."""
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
