"""URL filters, the filter audit and the divergence audit against plain versions, on hard texts and on empty tables."""

import collections
import itertools
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from sparktraj.llm import divergence_audit, filter_audit, url_filter
from tests.llm.conftest import prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# URL filters


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host):])[0]


def canonical(url):
    if not url or "://" not in url:
        return None
    host, path = host_path(url)
    host = re.sub(r"^(www|m)\.", "", re.sub("^.*@|:(80|443)?$", "", host))
    path = re.sub("/$", "", re.sub("/+", "/", path))
    rest = url.split("://", 1)[1].split("#", 1)[0]
    query = rest.split("?", 1)[1] if "?" in rest else ""
    params = sorted(x for x in query.split("&") if x and not re.search(url_filter.TRACKING, x))
    return host + path + ("?" + "&".join(params) if params else "")


def judged(url, rules, listed):
    host, path = host_path(url)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    known = canonical(url) in listed
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "block" if known else "allow", known


URLS = [
    None, "", "no scheme", "http://", "http:///path", "http://com", "http://com/", "http://a.com/x?y=1#z", "HTTP://WWW.Example.COM/en/1", "http://www.example.com/en/", "https://sub.www.example.com/en/9", "http://example.com/EN/", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://net/es/", "http://x.net/es", "http://x.net/fr/?q", "http://x.org?://y", "a#b://c.com/d", "http://x.com:80/", "http://user:pw@x.org:443//a///b/", "http://x.org/a/b", "http://x.org/a/b/?utm_source=q&b=2&a=1", "http://m.x.org/a/b?a=1&b=2#f",
    "http://bad.org/p?ref=x&page=2", "http://bad.org/p?page=2", "http://bad.org/p?page=3", "http://Äx.COM/Ä/", "http://x.com/\n/y", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://x.org/" + "q" * 100_000,
]


@pytest.mark.parametrize("most_blocks", [1, 2**18])
def test_url_filter(spark, most_blocks):
    rng = random.Random(4)
    parts = ["a", "b", "com", "net", "org", "www", "example"]
    made = [f"http://{'.'.join(rng.choices(parts, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(['en', 'es', 'fr', 'x'], k=rng.randint(0, 3)))}{rng.choice(['', '/', '?p=1', '#f'])}" for _ in range(3000)]
    urls = URLS + made
    rules = [*url_filter.RULES, ("block", "a.com", "/en/x"), ("allow", "b.a.com", "/en"), ("block", "b.a.com", "/en"), ("allow", "org", ""), ("block", "B.org", "/e")]
    listed = ["http://www.bad.org/p?page=2", "https://x.org/a/b/", None, "none", *made[:2000:2]]
    rows = [(k if k % 7 else None, u, "mine", "mine", "mine") for k, u in enumerate(urls)] + [(1, URLS[9], "", "", "")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, key string")
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame([(u,) for u in listed], "url string"), most_blocks=most_blocks)
    known = {canonical(u) for u in listed} - {None}
    want = collections.Counter((r[0], *judged(r[1], [(v, h.translate(LOWER), p) for v, h, p in rules], known)) for r in rows)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert len({r[4] for r in want}) == 2 and any(r[5] for r in want)


def test_url_filter_on_empty_tables(spark):
    pages, rules, listed = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string"), spark.createDataFrame([], "verdict string, host string, path string"), spark.createDataFrame([], "url string")
    assert [tuple(r) for r in url_filter.url_filter(pages, rules, listed).collect()] == [(1, "a.com", "/b", None, "allow", False)]
    assert url_filter.url_filter(pages.where("false"), rules, listed).count() == 0


def test_bloom_passes_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("key"))
    n = 20_000 * url_filter.BITS // 512
    bloom = url_filter.blocked_bloom(keys, n)
    assert url_filter.passing(keys, bloom, n).count() == 20_000
    assert url_filter.passing(spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("key")), bloom, n).count() < 200


# filter audit


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(k for k, hit in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum(c in string.ascii_uppercase for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), copy)) if hit)


def audited(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    least, parts = {}, collections.defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for i, text, source in rows:
        parts[source or ""].append((fails(text or "", i is not None and least[text or ""] < i), i in good, i in toxic))
    out, total = {}, collections.Counter()
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                hit = [d for d in docs if f in d[0]]
                out[part, order, step] = [len(left), len(gone), len(hit) - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                total[part, f] += len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check_audit(spark, rows, labels, partitions):
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, source string, part string, mask string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(r) for r in filter_audit.filter_audit(docs, table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == audited(rows, labels)


@pytest.mark.parametrize("partitions", [1, 37])
def test_filter_audit(spark, hard, partitions):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text, r.source) for r in hard.collect()]
    pool = [prose(rng, n) for n in (3, 49, 50, 51, 200)] + ["UPPER CASE " * 30, "a | b " * 20, "word " * 60]
    # A large group of copies whose ids spread over many tasks, one with a single id, null ids and repeated rows.
    rows += [(100 + k, pool[4], f"s{k % 4}") for k in rng.sample(range(400), 400)] + [(50, "once", "s1")] * 40 + [(None, pool[4], "s1"), (None, "once", None), (100, pool[4], "s1")]
    rows += [(600 + k, rng.choice(pool) + rng.choice(["", "", " & more", " X"]), rng.choice(["s0", "s1", "", None])) for k in range(300)]
    labels = [(rng.choice([None, rng.randrange(900)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(600)]
    check_audit(spark, rows, labels, partitions)


def test_filter_audit_when_fingerprints_collide(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.length(c[0]) % 2)
    texts = ["a", "b", "cc", "dd", "ee"]
    check_audit(spark, [(k, rng.choice(texts), "p") for k in rng.sample(range(500), 500)], [], 23)


def test_filter_audit_on_long_texts_and_empty_tables(spark, empty):
    long = "word " * 2_000_000 + "é" * 3_000_000
    assert filter_audit.failed(long.encode()) == 2
    assert filter_audit.failed("".join(f"w{k}\t" for k in range(1_000_000)).encode()) == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).count() == 0
    check_audit(spark, [(1, long, "a"), (2, long, "b"), (3, "", "a")], [(1, 1, 1)], 3)


# divergence audit


def diverged(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups.add((lang, source))
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {a for a, _ in groups}:
        kept = [t for (a, t), n in docs.items() if a == lang and n >= least]
        sources = [s for a, s in groups if a == lang]
        n = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(x.values()) + 2 * len(kept)) for t, c in x.items()} for s, x in n.items()}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize("first", [1, 4])
def test_divergence_audit(spark, hard, monkeypatch, first):
    rng = random.Random(6)
    monkeypatch.setattr(divergence_audit.top_terms, "__defaults__", (divergence_audit.TOP, first))
    rows = [(r.text, r.lang, r.source) for r in hard.collect()]
    words = ["the", "The", "été", "ÉTÉ", "漢字", "x1y", *(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr")]
    for k in range(600):
        lang = rng.choice(["en", "en", "fr", None])
        source = rng.choice(["hot", "hot", "s1", "s2", "", None, "ü"])
        own = words[: 30 if source == "hot" else len(words)]
        rows.append((" ".join(rng.choice(own) + rng.choice([" ", ".", "-9 "]) for _ in range(rng.randint(0, 80))), lang, source))
    rows += [(None, "en", "none"), ("rare words", "xx", "a"), ("", "xx", "b")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n long, docs long, term string")
    got = [tuple(r) for r in divergence_audit.divergence_audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == diverged(rows)
    assert any(r[2] == "term" and r[5] == 10 for r in got)


def test_divergence_audit_sums_in_parts_and_has_room(spark, monkeypatch, empty):
    # Tasks that hand on often, texts in small pieces, and counts whose product with 10**9 passes 2**63.
    monkeypatch.setattr(divergence_audit, "MOST_TERMS", 5)
    monkeypatch.setattr(divergence_audit, "PIECE", 7)
    rows = [("aa bb Cc " * (k + 1), "en", f"s{k % 3}") for k in range(30)]
    texts = [t.encode() for t, _, _ in rows]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([t.decode() for t in texts]), pa.array(["en"] * 30), pa.array([r[2] for r in rows])], names=["text", "lang", "source"])
    total = collections.Counter()
    for b in divergence_audit._counted(iter([batch])):
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert total["s0", "cc"] == sum(k + 1 for k in range(0, 30, 3)) and total["s0", "\0s0"] == 0
    big = spark.range(1).select(F.lit(10**12).alias("n"), F.lit(3 * 10**12).alias("total"), F.lit(1000).cast("long").alias("terms"))
    assert big.select(divergence_audit._share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first().p == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 2000)
    assert divergence_audit.divergence_audit(empty).count() == 0
