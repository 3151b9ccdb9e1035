"""Personal data by weak supervision.

Base kinds are found by pattern and always kept.  Further candidates, of shapes that are often something else, get votes from
labelers: 1 personal, -1 not, 0 no opinion.  ``shape`` looks at the form, ``valid`` at check digits and ranges, ``gazetteer`` at
tables of given names, places, streets and organisations, ``context`` at the words before, ``setting`` at the sign or letter just
before, ``placeholder`` at values that stand for none.  The votes of the whole corpus are counted by kind and pattern of votes;
on that table expectation-maximisation estimates each labeler's reliability for each kind and each pattern's probability.  A
logistic span classifier is then trained, with these probabilities as soft labels and again on counts, on all votes, by kind and over
all kinds, and on the form of the span, and compiled into a Spark expression.

Only built-in SQL functions touch the rows; loops over the small table of counts run on the driver.  Texts are scanned once: candidates
with their votes are staged.

Defined results: a null text is empty and has no spans; ids, null or repeated, are carried through; without candidates the classifier
accepts none; spans of two kinds may overlap; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import LARGEST, parts_of, read, running, spans_of, stage
from sparktraj.llm.secret_scan import BASE as SECRETS

#: Base kinds: (prefix, match, gate, condition on the value x.v).  Fixed values.
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(sequence(1, length({_DIGITS})), i -> CAST(substring(reverse({_DIGITS}), i, 1) AS int) * (2 - i % 2)), "
    "0, (acc, d) -> acc + d - CASE WHEN d > 9 THEN 9 ELSE 0 END) % 10 = 0"
)
BASE = {
    "email": (
        r"(?:[^A-Za-z0-9._%+-]++|[A-Za-z0-9._%+-]++(?!@[A-Za-z0-9-]+\.[A-Za-z0-9-]))*+",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "instr(_t, '@') > 0", "true",
    ),
    "ip": (
        r"(?:[^0-9]++|[0-9]++(?!\.[0-9]+\.[0-9]+\.[0-9]))*+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"_t RLIKE '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
        "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 18) AS bigint), 0) <= 255)",
    ),
    "card": (
        r"(?:[^0-9]++|[0-9](?![\x20-]?[0-9]))*+", r"[0-9](?:[\x20-]?[0-9])++", "_t RLIKE '[0-9](?:[ -]?[0-9]){11}'",
        f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    ),
    "phone": (r"(?:[^+]++|\+(?![0-9][\x20().0-9-]+[0-9]))*+", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(_t, '+') > 0", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señor|Señora|Madame|Monsieur"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Court|Way"
#: Further candidates: (prefix, match, gate, condition on x.v).
EXTRA = {
    "local_phone": (r"(?s:.*?)", r"(?<![0-9+(./-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "_t RLIKE '[0-9]{3}[.-][0-9]{4}'", "true"),
    "ssn": (r"(?s:.*?)", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "_t RLIKE '[0-9]-[0-9]{2}-[0-9]{4}'", "true"),
    "iban": (r"(?s:.*?)", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "_t RLIKE '[A-Z]{2}[0-9]{2}[A-Z0-9]{11}'", "true"),
    "birth_date": (r"(?s:.*?)", r"(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9])", "_t RLIKE '(?:19|20)[0-9]{2}'", "true"),
    "person": (r"(?s:.*?)", rf"(?<!\p{{L}})(?:(?:{_TITLES})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?|\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+){{1,2}})(?!\p{{L}})", r"_t RLIKE '\\p{Ll}[.]? \\p{Lu}\\p{Ll}'", "true"),
    "address": (
        r"(?s:.*?)",
        rf"(?<![0-9\p{{L}}])(?:[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}+\x20){{1,3}}(?:{_STREETS})|\p{{Lu}}\p{{Ll}}*(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}"
        r"|(?:rue|avenue|boulevard|calle|avenida|plaza)\x20(?:de\x20)?(?:la\x20)?\p{Lu}\p{Ll}+(?:,?\x20[0-9]{1,4})?)(?![\p{L}0-9])",
        rf"_t RLIKE ' (?:{_STREETS})|straße|strasse|weg|platz|allee|gasse|rue |avenue |boulevard |calle |avenida |plaza '", "true",
    ),
    "account": (*BASE["card"][:3], f"length({_DIGITS}) BETWEEN 12 AND 19 AND NOT ({_LUHN})"),
    "credential": SECRETS["assign"],
}
KINDS = (*BASE, *EXTRA)

#: Tables of words.  What stands before personal data of a kind, and before other things of like shape.
CUES = {
    "local_phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone",
    "ssn": "ssn social security sozialversicherung seguridad",
    "iban": "iban account konto compte cuenta bank",
    "birth_date": "born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento",
    "person": "name contact dear patient by from signed sincerely regards author von par por mrs mr dr herr frau",
    "address": "address live lives living resides residence home adresse wohnhaft wohnt anschrift habite domicile dirección vive",
    "account": "account card customer member passport licence konto karte kunde compte carte client cuenta tarjeta",
    "credential": "my your his her login user account mein mon mi",
}
OTHERWISE = "version isbn issn order invoice ticket serial part model item no nr figure table page chapter section rfc doi"
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Emma Peter Paul George Alice "
    "Hans Klaus Jürgen Stefan Andreas Wolfgang Ursula Sabine Monika Petra Heike Lukas Jonas Lena Leonie Greta "
    "Jean Pierre Michel Philippe Alain Marie Nathalie Isabelle Sylvie Camille Chloé Louis Hugo Léa Manon Antoine "
    "José Juan Carlos Luis Miguel Javier Antonio María Carmen Ana Isabel Lucía Pilar Diego Pablo Sofía"
).split()
#: Words that make a run of capitalised words something else than a person.
OTHER_NAMES = (
    "The This That These Those There Then When Where While And But For With From After Before Our Your Their New North South East West United National "
    "University College School Institute Museum Street Road Avenue Park River Lake Mount City County State Bank Company Group Corporation Inc Ltd Press House "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "London Paris Berlin Madrid York America Europe Germany France Spain England Die Der Das Und Les Las Los El La Le"
).split()
LABELERS = ("shape", "valid", "gazetteer", "context", "setting", "placeholder")
FORMS = ("length", "lead")
CONTEXT = 40


def _any_of(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _votes(kind: str) -> str:
    """Votes on x as an array in the order of LABELERS."""
    before = "lower(x.c)"
    after_word = lambda words: f"{before} RLIKE '(^|[^\\\\p{{L}}])({'|'.join(words.split())})[^\\\\p{{L}}]'"
    digits = _DIGITS
    shape = {
        "local_phone": "CASE WHEN x.v RLIKE '^[(]?[0-9]{3}[)]?([ .-])' THEN CASE WHEN x.v RLIKE '^[0-9]{3}([.-])[0-9]{3}\\\\1[0-9]{4}$' OR x.v RLIKE '^[(]' THEN 1 ELSE 0 END ELSE -1 END",
        "ssn": "1",
        "iban": "CASE WHEN x.v RLIKE '[0-9]{8}' THEN 1 WHEN x.v RLIKE '[0-9]{4}' THEN 0 ELSE -1 END",
        "birth_date": "0",
        "person": f"CASE WHEN x.v RLIKE '^({_TITLES})[. ]' THEN 1 ELSE 0 END",
        "address": "CASE WHEN x.v RLIKE '[0-9]' THEN 1 ELSE 0 END",
        "account": "CASE WHEN x.v RLIKE '^([0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\\\\2[0-9]{4}\\\\2[0-9]{2,4})$' THEN 1 WHEN x.v RLIKE '^[0-9]+$' THEN 0 ELSE -1 END",
        "credential": "CASE WHEN regexp_extract(x.v, '[:=](.*)$', 1) RLIKE '[0-9]' AND regexp_extract(x.v, '[:=](.*)$', 1) RLIKE '[A-Za-z]' THEN 1 ELSE -1 END",
    }[kind]
    valid = {
        "local_phone": f"CASE WHEN substring({digits}, 1, 1) NOT IN ('0', '1') AND substring({digits}, 4, 1) NOT IN ('0', '1') THEN 1 ELSE -1 END",
        "ssn": "CASE WHEN x.v RLIKE '^(000|666|9..)|-00-|-0000$' THEN -1 ELSE 1 END",
        # The remainder of the number, letters as 10 to 35, by 97 is 1.
        "iban": """CASE WHEN aggregate(transform(split(concat(substring(x.v, 5), left(x.v, 4)), ''), d -> CASE WHEN d = '' THEN 0 WHEN d <= '9' THEN ascii(d) - 48 ELSE ascii(d) - 55 END), 0,
            (acc, d) -> CASE WHEN d > 9 THEN (acc * 100 + d) % 97 ELSE (acc * 10 + d) % 97 END) = 1 THEN 1 ELSE -1 END""",
        "birth_date": "CASE WHEN x.v RLIKE '(^|[^0-9])0?0[./-]|[./-]0?0[./-]|-00$' THEN -1 WHEN x.v RLIKE '(19[2-9][0-9]|20[01][0-9])' THEN 0 ELSE -1 END",
        "person": "CASE WHEN length(x.v) > 40 THEN -1 ELSE 0 END",
        "address": "0",
        "account": "CASE WHEN x.v RLIKE '^[3-6]' THEN 1 ELSE 0 END",
        "credential": "CASE WHEN length(regexp_extract(x.v, '[:=](.*)$', 1)) >= 12 THEN 1 ELSE 0 END",
    }[kind]
    words = "split(regexp_replace(x.v, '[^\\\\p{L} ]', ''), ' ')"
    gazetteer = {
        "person": f"""CASE WHEN exists({words}, w -> w IN ({_any_of(OTHER_NAMES)})) THEN -1 WHEN exists({words}, w -> w IN ({_any_of(GIVEN_NAMES)})) THEN 1 ELSE 0 END""",
        "address": f"CASE WHEN x.v RLIKE '({_STREETS}|[Ss]tra(ß|ss)e|rue|calle|avenida)' THEN 1 ELSE 0 END",
    }.get(kind, f"CASE WHEN exists(split({before}, '[^\\\\p{{L}}]+'), w -> w IN ({_any_of([n.lower() for n in GIVEN_NAMES])})) THEN 1 ELSE 0 END")
    context = f"CASE WHEN {after_word(CUES[kind])} THEN 1 WHEN {after_word(OTHERWISE)} THEN -1 ELSE 0 END"
    if kind == "person":
        context = f"CASE WHEN {after_word(CUES[kind])} THEN 1 WHEN x.c = '' OR x.c RLIKE '([.!?:]|\\\\n) *$' OR {before} RLIKE '(^| )(the|of|in|at|der|die|das|la|le|el|des) $' THEN -1 ELSE 0 END"
    placeholder = "CASE WHEN x.v RLIKE '([0-9])(?:[^0-9]?\\\\1){5}|12345678|(?i:example|changeme|placeholder|your_|xxxx|john doe|jane doe|mustermann)' THEN -1 ELSE 0 END"
    return f"""array({shape}, {valid}, {gazetteer}, {context},
        CASE WHEN x.c RLIKE '[:=<(]\\\\s*$' THEN 1 WHEN x.c RLIKE '[\\\\p{{L}}0-9_/#]$' THEN -1 ELSE 0 END, {placeholder})"""


#: Form of the span x, in the order of FORMS.
_FORM = """array(CASE WHEN length(x.v) > 16 THEN 'long' ELSE 'short' END,
    CASE WHEN x.c = '' OR x.c RLIKE '\\\\n$' THEN 'start' WHEN x.c RLIKE '[:=]\\\\s*$' THEN 'sign' WHEN x.c RLIKE '[.!?]\\\\s*$' THEN 'sentence' ELSE 'other' END)"""


def with_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` as _keep_0 and so on, base (s, rank, e, kind) and extra (s, rank, e, kind, votes, form), each an array in order; staged."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)))
    for kind, (prefix, match, gate, _) in (BASE | EXTRA).items():
        if kind != "account":
            d = d.withColumn(f"_{kind}", F.expr(spans_of("_t", prefix, match, gate, CONTEXT if kind in EXTRA or kind == "card" else 0)))
    found = lambda k: f"filter(_{'card' if k == 'account' else k}, x -> {(BASE | EXTRA)[k][3]})"
    base = [f"transform({found(k)}, x -> named_struct('s', x.s, 'rank', {KINDS.index(k)}, 'e', x.e, 'kind', '{k}'))" for k in BASE]
    extra = [f"transform({found(k)}, x -> named_struct('s', x.s, 'rank', {KINDS.index(k)}, 'e', x.e, 'kind', '{k}', 'votes', {_votes(k)}, 'form', {_FORM}))" for k in EXTRA]
    d = d.select("doc_id", *(f"_keep_{k}" for k in range(len(keep))), F.expr(f"array_sort(concat({', '.join(base)}))").alias("base"), F.expr(f"array_sort(concat({', '.join(extra)}))").alias("extra"))
    return stage(d, "pii-candidates")


@dataclass(frozen=True)
class SpanModel:
    #: Weight of each feature (by kind or '' for all kinds, name, value), the bias, and each labeler's estimated reliability by kind.
    weights: dict[tuple[str, str, str], float]
    bias: float
    reliability: dict[tuple[str, str], float]

    def accepts(self) -> str:
        """SQL condition on a candidate x."""
        if not self.weights:
            return "false"
        kinds = sorted({k for k, _, _ in self.weights if k})

        def sum_of(name: str, kind: str) -> str:
            at = f"x.votes[{LABELERS.index(name)}]" if name in LABELERS else f"x.form[{FORMS.index(name)}]"
            seen = sorted({v for k, n, v in self.weights if n == name})
            cases = " ".join(f"WHEN {v if name in LABELERS else repr(v)} THEN {self.weights.get((kind, name, v), 0.0) + self.weights.get(('', name, v), 0.0)!r}D" for v in seen)
            return f"CASE {at} {cases} ELSE 0D END"

        by_kind = " ".join(f"WHEN '{k}' THEN {self.weights.get((k, 'kind', k), 0.0)!r}D + {' + '.join(sum_of(n, k) for n in (*LABELERS, *FORMS))}" for k in kinds)
        return f"{self.bias!r}D + (CASE x.kind {by_kind} ELSE 0D END) >= 0D"


def features_of(kind: str, votes: tuple[int, ...], form: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """The kind; each vote, by kind and over all kinds; the form of the span."""
    out = [(kind, "kind", kind)]
    for name, v in (*zip(LABELERS, map(str, votes)), *zip(FORMS, form)):
        out += [(kind, name, v), ("", name, v)]
    return out


def expectation_maximisation(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple[str, tuple[int, ...]], float], dict[tuple[str, str], float]]:
    """(kind, votes, count) -> probability of each pattern of votes of a kind, and each labeler's reliability by kind.

    Naive Bayes with one accuracy for each labeler and kind, drawn towards the labeler's accuracy over all kinds, and one prior for each kind.
    """
    kinds = sorted({k for k, _, _ in counts})
    right = {(k, name): 0.7 for k in kinds for name in LABELERS}
    prior = dict.fromkeys(kinds, 0.5)
    prob: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes, _n in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(right[kind, name] / (1 - right[kind, name])) for name, v in zip(LABELERS, votes))
            prob[kind, votes] = 1 / (1 + math.exp(-odds))
        for k, name in enumerate(LABELERS):
            tally = {kind: [0.0, 0.0] for kind in kinds}
            for kind, votes, n in counts:
                if votes[k]:
                    p = prob[kind, votes]
                    tally[kind][0] += n
                    tally[kind][1] += n * (p if votes[k] > 0 else 1 - p)
            overall = (sum(a for _, a in tally.values()) + 7) / (sum(v for v, _ in tally.values()) + 10)
            for kind, (voted, agreed) in tally.items():
                right[kind, name] = min(0.95, max(0.55, (agreed + 10 * overall) / (voted + 10)))
        for kind in kinds:
            mine = [(n, prob[kind, votes]) for k, votes, n in counts if k == kind]
            prior[kind] = min(0.95, max(0.05, (sum(n * p for n, p in mine) + 5) / (sum(n for n, _ in mine) + 10)))
    return prob, right


def train_spans(rows: list[tuple[list[tuple[str, str, str]], float, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[dict[tuple[str, str, str], float], float]:
    """Logistic regression by gradient steps on features that hold or not, with soft labels; a row weighs as the logarithm of its count grows."""
    weights: dict[tuple[str, str, str], float] = {f: 0.0 for features, _, _ in rows for f in features}
    weigh = [1 + math.log(n) for *_, n in rows]
    bias, total = 0.0, sum(weigh)
    for _ in range(steps):
        slope = {f: decay * w for f, w in weights.items()}
        push = 0.0
        for (features, p, _), n in zip(rows, weigh):
            z = bias + sum(weights[f] for f in features)
            d = (1 / (1 + math.exp(-z)) - p) * n / total
            push += d
            for f in features:
                slope[f] += d
        bias -= rate * push
        for f in weights:
            weights[f] -= rate * slope[f]
    return {f: round(w, 9) for f, w in weights.items()}, round(bias, 9)


def fit(candidates: DataFrame) -> SpanModel:
    """From ``with_candidates``: what comes to the driver is a row per combination of kind, votes and form, a number that doesn't grow with the input."""
    table = candidates.select(F.explode("extra").alias("x")).groupBy("x.kind", "x.votes", "x.form").count().collect()
    rows = sorted((r.kind, tuple(r.votes), tuple(r.form), r["count"]) for r in table)
    if not rows:
        return SpanModel({}, 0.0, {})
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in rows:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    prob, right = expectation_maximisation([(*k, n) for k, n in sorted(by_votes.items())])
    weights, bias = train_spans([(features_of(kind, votes, form), prob[kind, votes], n) for kind, votes, form, n in rows])
    return SpanModel(weights, bias, right)


def all_spans(model: SpanModel) -> Column:
    """Base spans and accepted candidates, in order."""
    return F.expr(f"array_sort(concat(base, transform(filter(extra, x -> {model.accepts()}), x -> named_struct('s', x.s, 'rank', x.rank, 'e', x.e, 'kind', x.kind))))")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and n_spans, the number of all spans."""
    found = with_candidates(docs, id_col, text_col)
    found = found.withColumn("all", all_spans(fit(found)))
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    return found.select("doc_id", *(F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE), F.expr(f"sha2({text.format('base')}, 256)").alias("base_sha256"), F.expr(text.format("all")).alias("spans"), F.expr("CAST(size(all) AS bigint)").alias("n_spans"))


def replaced(text: str, spans: str) -> str:
    """SQL: ``text`` with each of the ordered ``spans`` replaced by its kind in capitals and brackets; overlapping spans are one, named by the first.

    Texts with many spans are cut in parts first, as taking a substring passes over all that stands before it.
    """
    part = """array_join(transform(p, y -> CASE WHEN y.x.s >= y.at
        THEN concat(substring(t, y.at - p[0].at + 1, y.x.s - y.at), '[', upper(y.x.kind), ']') ELSE '' END), '')"""
    return f"""concat(transform(array(zip_with({spans}, {running(f'transform({spans}, w -> w.e)', LARGEST)}, (x, at) -> named_struct('x', x, 'at', at))), found ->
        array_join(transform({parts_of('found')}, p -> transform(array(substring({text}, p[0].at + 1, p[size(p) - 1].x.s - p[0].at)), t -> {part})[0]), ''))[0],
        substring({text}, array_max(transform({spans}, w -> w.e)) + 1))"""


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in capitals and brackets; overlapping spans are one, named by the first.  A null text stays null."""
    names = docs.columns
    found = with_candidates(docs, names[0], text_col, tuple(names))
    found = found.withColumn("all", all_spans(fit(found)))
    k = names.index(text_col)
    kept = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names)]
    kept[k] = F.expr(f"CASE WHEN size(all) > 0 THEN {replaced(f'_keep_{k}', 'all')} ELSE _keep_{k} END").alias(text_col)
    return found.select(*kept)


def op6_pii(spark, sf_dir):
    return pii_spans(read(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLES = {}
