"""Language identification by hyperdimensional profiles.

Every symbol (a letter in lower case, or a gap between words) has a random vector of +1 and -1.  A trigram's vector binds its
symbols' vectors, each permuted by its place, by multiplication; a text's vector is the bundle, the sum over its trigrams.
A language's prototype is the bundle of its training texts, less the mean direction of all languages.  The prediction is the
prototype of greatest cosine.

Defined results: a text that is null or has no letters is ``und`` with score 0, as is every text if nothing was learnt; equal cosines
go to the first language by name; ids, null or repeated, are carried through; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, crc_fold, docs_of, id_type, read, slices

#: Dimensions, and symbols: the gap, a to z, and 37 shared by all other letters.
DIMS, SYMBOLS = 1024, 64
CODES = SYMBOLS**3
#: Characters that are worked on at a time.
PIECE = 1_000_000


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 // 2**12 % 37
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMS))


def bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: symbols' vectors, rolled by 2, 1 and 0 places, multiplied."""
    v = _letters()
    twice, once = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return twice[codes >> 12] * once[codes >> 6 & 63] * v[codes & 63]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, code) of every trigram of all texts; each text stands between gaps, and gaps count once."""
    cp = np.frombuffer("".join(f"\n{t}\n\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    s = _symbols()[cp].astype(np.int32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    ok = (doc[2:] == doc[:-2]) & ((s[1:-1] != 0) | (s[:-2] != 0) & (s[2:] != 0))
    return doc[2:][ok], (s[:-2] << 12 | s[1:-1] << 6 | s[2:])[ok]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, code, count) in order, each pair once.  A text of over ``PIECE`` characters is counted by pieces."""
    short = [t if len(t) <= PIECE else "" for t in texts]
    doc, code = trigrams(short)
    pair, n = np.unique(doc.astype(np.int64) * CODES + code, return_counts=True)
    parts = [(pair, n)]
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            total = _counts_of_long(t)
            codes = np.flatnonzero(total)
            parts.append((i * CODES + codes, total[codes]))
    if len(parts) > 1:
        pair, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
    return pair // CODES, pair % CODES, n


def _counts_of_long(text: str) -> np.ndarray:
    """Count of each code; the last two symbols of a piece are carried to the next."""
    total, before = np.zeros(CODES, np.int64), np.zeros(1, np.int32)
    for at in range(0, len(text) + 1, PIECE):
        piece = text[at : at + PIECE] + ("\n" if at + PIECE > len(text) else "")
        s = np.concatenate([before, _symbols()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=CODES)
        before = s[-2:]
    return total


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    #: Unit vectors, one row a language.
    prototypes: np.ndarray


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Each task bundles its texts by language; the bundles' components are summed on the executors, and languages times ``DIMS`` sums come back."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            lang = b.column("lang").dictionary_encode()
            names = lang.dictionary.to_pylist()
            doc, code, n = counted(b.column("text").to_pylist())
            which, at = np.unique(lang.indices.to_numpy()[doc].astype(np.int64) * CODES + code, return_inverse=True)
            n = np.bincount(at, weights=n, minlength=len(which))
            for k, name in enumerate(names):
                lo, hi = np.searchsorted(which, [k * CODES, (k + 1) * CODES])
                mine = sums.setdefault(name, np.zeros(DIMS + 1))
                for c in range(lo, hi, 4096):
                    mine[:DIMS] += n[c : min(hi, c + 4096)] @ bound(which[c : min(hi, c + 4096)] - k * CODES).astype(np.float64)
                mine[DIMS] += n[lo:hi].sum()
        for name, x in sums.items():
            yield pa.record_batch([pa.array([name] * (DIMS + 1), pa.string()), pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.rint(x).astype(np.int64))], names=["lang", "at", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    table = arrow_map(rows, bundle, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    if not languages:
        return Profiles((), np.zeros((0, DIMS), np.float32))
    number = {x: k for k, x in enumerate(languages)}
    bundles = np.zeros((len(languages), DIMS + 1))
    bundles[[number[x] for x in table["lang"].to_pylist()], table["at"].to_numpy()] = table["n"].to_numpy()
    bundles = bundles[:, :DIMS] / np.maximum(bundles[:, DIMS:], 1)
    if len(languages) > 1:
        bundles -= bundles.mean(axis=0)
    norm = np.linalg.norm(bundles, axis=1, keepdims=True)
    return Profiles(tuple(languages), (bundles / np.where(norm > 0, norm, 1)).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score ((1 + cosine) / 2), n_letters, and the columns ``keep`` as _keep_0 and so on."""
    names = ["doc_id", "lang_pred", "score", "n_letters", *(f"_keep_{k}" for k in range(len(keep)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            doc, code, n = counted(texts)
            seen, code = np.unique(code, return_inverse=True)
            bundle, any_trigram = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
            any_trigram[doc] = True
            # In parts of codes and texts, so that vectors and dense counts stay small.
            for c in range(0, len(seen), 4096):
                vectors, mine = bound(seen[c : c + 4096]).astype(np.float32), (code >= c) & (code < c + 4096)
                d, k, m = doc[mine], code[mine] - c, n[mine]
                for at in range(0, len(texts), 256):
                    lo, hi = np.searchsorted(d, [at, at + 256])
                    counts = np.zeros((min(256, len(texts) - at), len(vectors)), np.float32)
                    counts[d[lo:hi] - at, k[lo:hi]] = m[lo:hi]
                    bundle[at : at + 256] += counts @ vectors
            size = np.linalg.norm(bundle, axis=1)
            cosine = bundle @ profiles.prototypes.T / np.where(size > 0, size, 1)[:, None]
            known = any_trigram if len(profiles.languages) else np.zeros(len(texts), bool)
            top = cosine.argmax(axis=1) if len(profiles.languages) else np.zeros(len(texts), int)
            best = [profiles.languages[k] if ok else "und" for k, ok in zip(top, known)]
            score = [float(min(1, max(0, (1 + c[k]) / 2))) if ok else 0.0 for c, k, ok in zip(cosine, top, known)]
            letters = [sum(int(np.count_nonzero(_symbols()[np.frombuffer(t[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")])) for at in range(0, len(t), PIECE)) for t in texts]
            yield pa.record_batch([b.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64()), *(b.column(f"_keep_{k}") for k in range(len(keep)))], names=names)

    d = docs_of(docs, id_col, text_col, **{f"_keep_{k}": c for k, c in enumerate(keep)})
    kept = "".join(f", _keep_{k} {docs.select(c).schema[0].dataType.simpleString()}" for k, c in enumerate(keep))
    return arrow_map(d, run, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double, n_letters long{kept}")


def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    profiles = fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    return predict(docs, profiles).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES = {}
