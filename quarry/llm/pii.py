"""Personal data (operator 7): weak supervision over pattern, gazetteer and context labelers.

Base spans follow the fixed patterns and are certain.  Wider patterns propose further candidates; three
labelers vote on each of these: a pattern of the well-formed wider form (a checksum, for cards), a
gazetteer (of mail domains, issuer and calling codes, networks) and the words before it.  The counts of
vote combinations over all documents go to an expectation-maximisation of the labelers' reliabilities,
for each kind by itself, a table whose size does not depend on the input.  Base spans take no part in
it: they differ from the wider forms, so a labeler's rates among them say nothing about those.  The
probabilities it gives train a span classifier over votes and binned form features, a log-linear
model, which decides about the candidates.  All work on documents is done by DataFrame functions.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.spans import apart, literal, matches
from quarry.llm.common import by_column, materialize

# The kinds in their order, and the patterns of base spans.  The patterns are written
# with possessive quantifiers and look-behinds, which match the same spans without backtracking or
# recursion on long texts.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: written-out signs, IPv6, digit groups of any checksum, numbers without country code.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+(?:@|\[at\]|\(at\))\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20./-]{0,2}[0-9]{4}[\x20./-]{0,2}[0-9]{4}[\x20./-]{0,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9][.:]|[0-9A-Fa-f]:", "card": r"[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]|[0-9][)\x20.-]"}
# Gazetteers, which a candidate's text in lower case is searched for: mail domains and top
# levels, private and documentation networks, issuers' ranges, calling codes.
GAZETTEER = {
    "email": r"(?:gmail|googlemail|yahoo|hotmail|outlook|live|icloud|proton(?:mail)?|gmx|web|orange|wanadoo|free|laposte|terra|telefonica|mail)[0-9]*\.|\.(?:com|org|net|edu|gov|mil|info|biz|io|dev|app|eu|de|at|ch|fr|be|es|mx|ar|co|it|nl|pl|pt|br|uk|ie|us|ca|au|in|jp)$",
    "ip": r"^(?:0?10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.(?:168|0\.2)|198\.51\.100|203\.0\.113)\.|^(?:fe80|2001|2a0[0-9a-f]|2[46]0[0-9a-f]|fd[0-9a-f]{2}|ff0[0-9a-f]|::1)",
    "card": r"^(?:4|5[0-8]|2[2-7]|3[47]|3[0568]|6011|6[2-5]|81)",
    "phone": r"^\+(?:1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])[^0-9]|555",
}
# Words (English, German, French, Spanish) that announce a kind, looked for in the
# characters before a candidate.
CONTEXT = {
    "email": r"e-?mail|mailto|contact|write to|reach|kontakt|schreib|erreich|courriel|m[ée]l\b|[ée]cri[vst]|joindre|correo|escrib",
    "ip": r"\bip\b|address|adress|direcci[óo]n|host|server|serveur|servidor|login|from|von|anmeld|connexion|conexi[óo]n|netz|r[ée]seau|\bred\b",
    "card": r"card|karte|carte|tarjeta|visa|master|amex|credit|kredit|cr[ée]dit|payment|zahlung|paiement|pago|\bpan\b",
    "phone": r"phone|telefon|t[ée]l[ée]phon|tel[ée]fono|\btel\b|tel[.:]|t[ée]l[.:]|call|ruf|appel|llam|mobil|m[óo]vil|portable|handy|fax|cell|contact|kontakt",
}
BEFORE = 30
#: SQL of a candidate's text with written-out signs in place, which gazetteer and pattern look at.
_PLAIN = r"regexp_replace(regexp_replace(m.s, r'\x20?(?:@|[\[(]at[\])])\x20?', '@'), r'\x20?[\[(]dot[\])]\x20?', '.')"
EMPTY = "cast(array() as array<struct<start:int,end:int,s:string,before:string,after:string>>)"


def _matches(pattern: str, needs: str) -> str:
    """SQL: the matches in column text, if it holds what the pattern needs."""
    return f"case when rlike(text, {literal(needs)}) then {matches('text', pattern, BEFORE)} else {EMPTY} end"


_DIGITS = r"regexp_replace(m.s, r'[^0-9]', '')"
#: Which matches of a base pattern stand.
VALID = {
    "email": "true",
    "ip": "forall(split(m.s, r'\\.'), q -> length(regexp_replace(q, '^0+', '')) <= 3 and coalesce(try_cast(right(q, 3) as int), 0) <= 255)",
    "card": f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


#: Which candidates have the well-formed wider form of their kind: the vote of the pattern labeler.
FORMED = {
    "email": f"rlike({_PLAIN}, r'^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}$')",
    "ip": "rlike(m.s, '^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$') or (size(split(m.s, '::', -1)) = 2 and not contains(m.s, ':::') and rlike(m.s, '[0-9A-Fa-f]$'))",
    "card": f"length({_DIGITS}) between 13 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 12 and rlike(m.s, r'^(\\([0-9]+\\).*|[0-9]+([\x20.-])[0-9]+\\2[0-9]+)$')",
}


def _tagged(source: str, kind: str) -> str:
    return f"transform({source}, m -> named_struct('start', m.start, 'rank', {KINDS.index(kind)}, 'end', m.end, 'kind', '{kind}', 's', m.s, 'before', m.before, 'after', m.after))"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, votes): base spans, and further candidates with their votes and features.

    None of the candidates is ``strict``, which only base spans are.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(F.expr(_matches(BASE[k], NEEDS[k])).alias(f"b_{k}") for k in KINDS), *(F.expr(_matches(WIDE[k], NEEDS[k])).alias(f"w_{k}") for k in KINDS))
    rows = rows.select("doc_id", "text", *(F.expr(_tagged(f"filter(b_{k}, m -> {VALID[k]})", k)).alias(f"b_{k}") for k in KINDS), *(F.expr(_tagged(f"w_{k}", k)).alias(f"w_{k}") for k in KINDS))
    rows = rows.select("doc_id", F.expr("array_sort(concat(" + ", ".join(f"b_{k}" for k in KINDS) + "))").alias("base"), F.expr("concat(" + ", ".join(f"w_{k}" for k in KINDS) + ")").alias("wide"))
    vote = lambda table: "case m.kind " + " ".join(f"when '{k}' then {table(k)}" for k in KINDS) + " end"
    facts = {
        "pattern": vote(lambda k: FORMED[k]),
        "gazetteer": vote(lambda k: f"rlike(lower({_PLAIN if k == 'email' else 'm.s'}), {literal(GAZETTEER[k])})"),
        "context": vote(lambda k: f"rlike(lower(m.before), {literal(CONTEXT[k])})"),
        "size": f"cast(least(9, length({_DIGITS}) div 2) as string)",
        "form": "case when rlike(m.s, r'[\\[(]') then 'bracket' when rlike(m.s, r'[0-9][ -][0-9]') then 'grouped' when rlike(m.s, ' ') then 'spaced' else 'solid' end",
        "before": "case when m.start = 0 then 'none' when m.before = '' then 'match' when rlike(m.before, r'\\s$') then 'space' when rlike(m.before, '[A-Za-z0-9]$') then 'word' else 'mark' end",
        "after": "case when m.after = '' then 'none' when rlike(m.after, r'\\s') then 'space' when rlike(m.after, '[A-Za-z0-9]') then 'word' else 'mark' end",
    }
    place = "'start', m.start, 'rank', m.rank, 'end', m.end, 'kind', m.kind"
    rows = rows.select("doc_id", "base", F.expr(apart("wide", "base")).alias("more"))
    return rows.select("doc_id", F.expr(f"transform(base, m -> named_struct({place}))").alias("base"), F.expr(f"transform(more, m -> named_struct({place}, 'strict', false, " + ", ".join(f"'{k}', {v}" for k, v in facts.items()) + "))").alias("votes"))


#: The labelers, whose votes come first among the features of the classifier.
LABELERS = ("pattern", "gazetteer", "context")
FEATURES = (*LABELERS, "size", "form", "before", "after")
#: What is taken for granted of a wider form before any is seen: the share of personal data, and how often
#: each labeler votes for it and for anything else; and how much that weighs, in candidates and as a share
#: of those found.
PRIOR, RATES = 0.3, ((0.9, 0.3), (0.7, 0.2), (0.6, 0.1))
WEIGHT, SHARE = 50.0, 0.1


def reliabilities(counts: list[tuple[tuple, int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[tuple, float]]:
    """Expectation-maximisation for one kind: prior, (hit, false) rates of each labeler, and the
    probability of each vote combination.  counts: (votes, number).

    PRIOR and RATES count as WEIGHT candidates or SHARE of those found, so the two classes keep their
    meaning however the votes are spread, and few candidates move the rates little.
    """
    prior, rates = PRIOR, list(RATES)
    total = sum(n for _, n in counts)
    weight = max(WEIGHT, SHARE * total)
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for votes, _n in counts:
            yes, no = prior, 1 - prior
            for v, (hit, false) in zip(votes, rates, strict=True):
                yes, no = yes * (hit if v else 1 - hit), no * (false if v else 1 - false)
            belief[votes] = yes / (yes + no)
        positive = sum(n * belief[v] for v, n in counts)
        prior = (positive + weight * PRIOR) / (total + weight)
        for k, (at_first, else_) in enumerate(RATES):
            hit = sum(n * belief[v] for v, n in counts if v[k])
            false = sum(n * (1 - belief[v]) for v, n in counts if v[k])
            hit, false = (hit + weight * at_first) / (positive + weight), (false + weight * else_) / (total - positive + weight)
            rates[k] = (hit, min(false, hit))  # a labeler votes for its kind rather than against it
    return prior, rates, belief


def train(counts: list) -> dict[str, dict]:
    """The span classifier of each kind: an intercept and a weight for each feature value.

    counts: rows of kind, the features (the three votes among them) and n.  The soft labels come from the
    votes; the classifier sees the form too, and is fitted by gradient steps.
    """
    models = {}
    for kind in KINDS:
        rows = [r for r in counts if r["kind"] == kind]
        votes: dict[tuple, int] = defaultdict(int)
        for r in rows:
            votes[tuple(bool(r[name]) for name in LABELERS)] += r["n"]
        if not votes:
            models[kind] = {"intercept": -1.0, "weights": {}}
            continue
        _, _, belief = reliabilities(sorted(votes.items()))
        total = sum(r["n"] for r in rows)
        data = [([(f, str(r[f]).lower() if f in LABELERS else str(r[f])) for f in FEATURES], belief[tuple(bool(r[name]) for name in LABELERS)], r["n"] / total) for r in rows]
        intercept, weights = 0.0, defaultdict(float)
        for _ in range(300):
            grad0, grad = 0.0, defaultdict(float)
            for fs, y, w in data:
                z = intercept + sum(weights[f] for f in fs)
                d = w * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
                grad0 += d
                for f in fs:
                    grad[f] += d
            intercept -= 1.0 * grad0
            for f, g in grad.items():
                weights[f] -= 1.0 * (g + 1e-4 * weights[f])
        models[kind] = {"intercept": intercept, "weights": dict(weights)}
    return models


def _logit(models: dict[str, dict]) -> str:
    """SQL: the classifier's logit of candidate m."""
    def of(kind: str) -> str:
        model = models[kind]
        terms = [f"{model['intercept']!r}D"]
        for f in FEATURES:
            values = sorted((v, w) for (name, v), w in model["weights"].items() if name == f)
            if values:
                terms.append(f"case cast(m.{f} as string) " + " ".join(f"when '{v}' then {w!r}D" for v, w in values) + " else 0D end")
        return " + ".join(terms)

    return "case m.kind " + " ".join(f"when '{k}' then {of(k)}" for k in KINDS) + " end"


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, end, kind), in order of start and kind.

    Offsets are code points, the end exclusive.  A null text is empty; repeated ids are separate rows.
    """
    found = materialize(candidates(docs), "candidates")
    votes = found.select(F.explode("votes").alias("m")).select("m.*")
    counts = votes.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", *FEATURES).collect()  # a few thousand combinations at most
    logit = math.log(threshold / (1 - threshold))
    added = f"filter(votes, m -> {_logit(train(counts))} >= {logit!r}D)"
    plain = f"transform({added}, m -> named_struct('start', m.start, 'rank', m.rank, 'end', m.end, 'kind', m.kind))"
    return found.select("doc_id", "base", F.expr(f"array_sort(concat(base, {plain}))").alias("spans"))


def op7_pii(spark, sf_dir) -> DataFrame:
    """Counts and digests of the spans in every document."""
    found = find(by_column(spark, sf_dir, "documents"))
    joined = lambda c: f"array_join(transform({c}, m -> concat(m.kind, ':', m.start, ':', m.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, m -> m.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
