"""Encoding of whole texts by way of their distinct chunks.

A text is cut where no token can cross, the chunks of many texts are made distinct by Arrow, and each distinct one is encoded.
Texts that cannot be cut safely are encoded whole.  What the cut may be depends on the tokenizer's pre-tokenization, so each of
the two kinds of vocabulary has its own ``Cutter``.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind, for the regular expressions of Arrow.
_ANY_WS = r"[\s\x0b\x85\p{Z}]"


@dataclass(frozen=True)
class Cutter:
    """``cut`` gives lists of chunks of an array of texts; texts that match ``unsafe`` must be encoded whole."""

    cut: Callable[[pa.Array], pa.ListArray]
    unsafe: str


def _spaces(texts: pa.Array) -> pa.ListArray:
    texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])", "\\1\x00\\2")
    texts = pc.replace_substring_regex(texts, r"\n([A-Za-z])", "\x00\n\x00\\1")
    return pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")


def _words(texts: pa.Array) -> pa.ListArray:
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])", r"\1 \2"))


#: The tokenizer lowers and drops white space: words between ASCII white space are independent, and punctuation after a letter is too.
#: Special tokens are found before letters are lowered, so what may hold one is left whole.
WORDS = Cutter(_words, r"<\|")
#: A space or line end begins a token if white space doesn't stand on both its sides; a full stop or comma after a letter does always.
SPACES = Cutter(_spaces, r"\x00|" + _ANY_WS + r"[ \n](" + _ANY_WS + r"|\z)")


class ChunkEncoder:
    """``encode``: list of chunks or whole texts -> little-endian 32-bit ids of each.

    Chunks met lately are kept in two generations: when the younger holds ``most`` bytes, the older goes.  Long chunks aren't kept.
    It pays where ``encode`` takes several times as long as looking a chunk up and keeping it; with 0 nothing is kept.
    """

    #: Bytes that an entry takes beside its text and ids, and the longest chunk that is kept.
    _ENTRY, _LONGEST = 250, 200

    def __init__(self, cutter: Cutter, encode: Callable[[list[str]], list[bytes]], most: int = 0):
        self.cutter, self.encode, self.most = cutter, encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        if not self.most:
            return self.encode(chunks)
        found = list(map(self.young.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            new = []
            for i in part:
                if (x := self.old.get(chunks[i])) is None:
                    new.append(i)
                else:
                    found[i] = x
            for i, ids in zip(new, self.encode([chunks[i] for i in new])):
                found[i] = ids
            if self.held > self.most:
                self.old, self.young, self.held = self.young, {}, 0
            kept = {chunks[i]: found[i] for i in part if len(chunks[i]) <= self._LONGEST}
            self.young.update(kept)
            self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + self._ENTRY * len(kept)
        return found

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, none of them null."""
        if not len(texts):
            return []
        unsafe = pc.match_substring_regex(texts, self.cutter.unsafe)
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        for keep, whole in ((pc.invert(unsafe), False), (unsafe, True)):
            rows = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            if whole:
                for i in rows.tolist():
                    out[i] = np.frombuffer(self.encode([texts[i].as_py()])[0], "<u4")
                continue
            lists = self.cutter.cut(texts.filter(keep))
            flat = lists.flatten().dictionary_encode()
            ids = self._look_up(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start = np.cumsum(size) - size
            table, codes = np.frombuffer(b"".join(ids), "<u4"), flat.indices.to_numpy()
            n = size[codes]
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[codes] - (ends - n), n)
            got = table[at] if len(table) else np.empty(0, "<u4")
            cut = np.concatenate([[0], ends])[np.diff(lists.offsets.to_numpy(), prepend=lists.offsets[0].as_py()).cumsum()]
            for i, a, b in zip(rows.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                out[i] = got[a:b]
        return out


def by_library(path: str, lowered: bool) -> Callable[[list[str]], list[bytes]]:
    """Encoding with the tokenizers library: each string as a text of its own, without special tokens being added.

    Strings that normalization leaves as they are and that are one word go straight to the library's model: in a byte-level
    vocabulary letters, maybe after one space; in one of ``lowered`` words lower-case letters in composed form.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    model = whole.model
    model._resize_cache(0)  # distinct words find nothing in it
    letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
    one_word = r"^\p{L}+\z" if lowered else r"^ ?\p{L}+\z"

    def symbols(word: str) -> str:
        if word.isascii():
            return word.replace(" ", letters[32])
        return word.encode().decode("latin-1").translate(letters)

    def by_whole(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            e = whole.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            cut = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * 4).tolist()
            out += [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return out

    def encode(words: list[str]) -> list[bytes]:
        alone = pc.match_substring_regex(pa.array(words, pa.large_string()), one_word).to_numpy(zero_copy_only=False).tolist()
        if lowered:
            alone = [x and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)) for x, w in zip(alone, words)]
        rest = iter(by_whole([w for w, x in zip(words, alone) if not x]))
        return [array("I", [t.id for t in model.tokenize(symbols(w))]).tobytes() if x else next(rest) for w, x in zip(words, alone)]

    return encode


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
