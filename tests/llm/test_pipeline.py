"""run() against a plain version of its five stages."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparktraj.llm import language_id, quality_rules
from tests.llm import brute
from tests.llm.conftest import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
GERMAN = ["der", "die", "und", "das", "ist", *(a + b for a in ("schla", "gew", "burg", "trei", "strom") for b in ("en", "ung", "heit", "lich", "schaft"))]


def documents():
    rng = random.Random(11)
    texts = [(prose(rng, rng.randint(60, 900)), "en") for _ in range(18)] + [(prose(rng, rng.randint(60, 300), GERMAN), "de") for _ in range(12)]
    first = texts[0][0].split(" ")
    texts += [(" ".join(first[:k] + ["changed"] + first[k + 1 :]), "en") for k in (9, 20, 30)]  # near copies
    texts += [texts[3], texts[3], texts[20]]  # exact ones
    texts += [(None, "en"), ("", None), ("12 345 . 6 " * 30, "en"), (prose(rng, 20), "en"), ("the same few words of it " * 40, "en"), ("zqxj vkwq xzjq qqvx " * 60, None), ("ЖЩЪЫЭ ЮЯФЦЧ " * 60, None)]
    for data in ("mail to a.b@host-name.org now", "from 10.1.2.3 it came", "call +49 30 1234567 or x@y.de soon", "pay 4111 1111 1111 1111 then", "no 999.1.2.3 and @ sign"):
        words = prose(rng, 120).split(" ")
        texts.append((" ".join(words[:40] + [data] + words[40:]), "en"))
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in zip(ids, texts)]


def in_a_language(docs):
    letters = language_id._letters().astype(int)
    bound = lambda a, b, c: np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]

    def bundle(text):
        symbols, out = [0], collections.Counter()
        for c in text + "\n\n":
            k = int(language_id._symbols()[ord(c)])
            if k or symbols[-1]:
                symbols.append(k)
        for t in zip(symbols, symbols[1:], symbols[2:]):
            if t[1] or (t[0] and t[2]):
                out[t] += 1
        return sum((n * bound(*t) for t, n in out.items()), np.zeros(language_id.DIMS, int)), sum(out.values())

    sums = {}
    for _, text, lang, *_ in docs:
        if text is not None and lang:
            v, n = bundle(text)
            was, m = sums.get(lang, (0, 0))
            sums[lang] = (was + v, m + n)
    profiles = [v / n for v, n in sums.values()]
    mean = sum(profiles) / len(profiles)
    profiles = [(p - mean) / np.linalg.norm(p - mean) for p in profiles]
    out = []
    for d in docs:
        v, n = bundle(d[1] or "")
        if n:
            cosine = max(p @ v / np.linalg.norm(v) for p in profiles)
            assert abs(cosine - 0.2) > 1e-3, "the fixture lies at the limit"
            if cosine >= 0.2 or sum(map(str.isalpha, d[1])) < 200:
                out.append(d)
    return out


def of_quality(docs):
    import pandas as pd

    db = duckdb.connect()
    db.register("frame", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    db.execute("CREATE TABLE documents AS SELECT * FROM frame")
    kept = {i for i, k in db.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall() if k}
    return [d for d in docs if d[0] in kept]


def without_copies(docs):
    sets = {}
    for i, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return [d for d in docs if root[d[0]] == d[0]]


def without_pii(docs):
    out = []
    for i, text, *rest in docs:
        for kind, s, e in sorted(brute.personal(text), key=lambda x: -x[1]):
            text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
        out.append((i, text, *rest[:2], len(text)))
    return out


def test_run_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    docs = documents()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sizes, kept = [len(docs)], docs
    for step in (in_a_language, of_quality, without_copies, without_pii):
        kept = step(kept)
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 25, sizes
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, text, *_ in kept:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r.length for r in got) // 2048) + 1
