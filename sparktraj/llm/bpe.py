"""Byte-pair encoding by backtracking, and decoding by an offset table.

A text's pre-tokens are encoded one by one.  An Aho-Corasick automaton over all tokens finds, for each place, the longest token
that begins there.  Tokens are laid from the left, longest first; two neighbours are allowed only if merging their joined bytes
gives just these two, which a memoised table of pairs tells.  A place from which no way leads to the end is marked and not
entered again, so the work is linear in the text.  As only exact merges are allowed, the result is that of merging by rank.

Decoding: the bytes of all tokens lie in one array, with an offset table; ids are replaced by their bytes in one gather.

Defined results: a null text is empty and has no ids; ids, null or repeated, are carried through; an empty table gives an empty
result; only the id and text columns are read.  A special token's string in a text becomes its id, as in the library.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparktraj.llm.chunks import SPACES, ChunkEncoder, byte_letters
from sparktraj.llm.common import CHUNKED_BYTES, arrow_map, docs_of, id_type, read, slices

#: Pairs whose compatibility a worker remembers.
PAIRS = 400_000


class Bpe:
    """A byte-level vocabulary with its merges, from a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = {c: b for b, c in byte_letters().items()}
        to_bytes = lambda s: bytes(map(letter.__getitem__, s))
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: to_bytes(s) for s, i in vocab.items() if s not in self.special}
        id_of = {b: i for i, b in self.bytes_of.items()}
        #: (left, right) -> rank of their merge; id -> its parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            self.rank[x, y] = rank
            self.parts.setdefault(vocab[a + b], (x, y))
        self._spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        reached: set[int] = set()  # tokens that merging their own bytes gives
        automaton = ahocorasick.Automaton()
        for i, b in sorted(self.bytes_of.items(), key=lambda x: len(x[1])):
            x, y = self.parts.get(i, (None, None))
            if x is None and len(b) == 1 or x in reached and y in reached and self._joins(x, y, i):
                reached.add(i)
                automaton.add_word(b.decode("latin-1"), (len(b), i))
        automaton.make_automaton()
        self.automaton, self.reached = automaton, reached
        #: The longest token that is a proper prefix of a token.
        self.shorter = {i: next((id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if id_of.get(b[:n]) in reached), None) for i, b in ((i, self.bytes_of[i]) for i in reached)}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self._split = regex.compile(public_tokenizers.PATTERN)
        self._at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        size = max([*self.bytes_of, *self.special.values()]) + 1
        table = [b""] * size
        for i, b in [*self.bytes_of.items(), *((i, s.encode()) for s, i in self.special.items())]:
            table[i] = b
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in table])]).astype(np.int64)

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The symbols at one edge of a token while it grows, from its byte to itself, each with the rank of the merge that ends it."""
        if (got := self._spines.get((token, right))) is None:
            got, up = [], float("inf")
            while True:
                got.append((token, up))
                if token not in self.parts:
                    break
                x, y = self.parts[token]
                up, token = self.rank[x, y], y if right else x
            got.reverse()
            self._spines[got[-1][0], right] = got
        return got

    def _first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge over the border of two tokens when their joined bytes are merged."""
        left, right = self._spine(a, True), self._spine(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:  # of equal ranks, the one further left is first
                return x, y
            if x_ends == y_ends == float("inf"):
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _joins(self, a: int, b: int, whole: int) -> bool:
        return self._first_crossing(a, b) == (a, b) and self.parts[whole] == (a, b)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            got = self._fits[a, b] = self._first_crossing(a, b) is None
        return got

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(word.decode("latin-1")):
            longest[end - size + 1] = i  # longer ones end later
        length, fits, shorter = self.length, self.fits, self.shorter
        laid: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not closed[end] and (not laid or fits(laid[-1], token)):
                laid.append(token)
                if end == n:
                    return laid
                at, token = end, longest[end]
                continue
            less = shorter[token]
            while less is None:
                closed[at] = 1
                token = laid.pop()
                at -= length[token]
                less = shorter[token]
            token = less

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        words: dict[str, list[int]] = {}
        for text in texts:
            ids: list[int] = []
            for k, part in enumerate(self._at_special.split(text) if self._at_special and any(s in text for s in self.special) else [text]):
                if k % 2:
                    ids.append(self.special[part])
                    continue
                for w in self._split.findall(part):
                    if (got := words.get(w)) is None:
                        got = words[w] = self.encode_word(w.encode())
                    ids += got
            out.append(array.array("I", ids).tobytes())
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are not UTF-8 become U+FFFD."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        raw = self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@functools.cache
def _bpe(path: str) -> tuple[Bpe, ChunkEncoder]:
    bpe = Bpe(path)
    return bpe, ChunkEncoder(SPACES, bpe.encode, most=24_000_000)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _bpe(tokenizer)[1]
        for b in slices(batches, most=CHUNKED_BYTES):
            yield pa.record_batch([b.column("doc_id"), pa.array([x.tobytes() for x in encode(b.column("text"))], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(docs_of(docs, id_col, text_col), run, f"doc_id {id_type(docs, id_col)}, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)[0]
        for b in batches:
            ids = pc.fill_null(b.column("ids"), b"")
            for at in range(0, len(b), 500):
                part = ids.slice(at, 500)
                text = [bpe.decode(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)).decode() for x in part]
                yield pa.record_batch([b.column("doc_id").slice(at, 500), part, pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {id_type(encoded)}, ids binary, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = _bpe(tokenizer)
        for b in slices(batches, most=CHUNKED_BYTES):
            ids = encode(b.column("text"))
            hexed = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hexed(x.tobytes()) for x in ids], pa.string()), pa.array([hexed(bpe.decode(x.astype(np.int64))) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs_of(docs, id_col, text_col), run, f"doc_id {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES = {}
