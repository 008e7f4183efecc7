"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides; DataFrame and SQL functions only.

1. Spans. Four base kinds (email, ip, card, phone) are found by exact patterns with a check each, and
   always stay. Candidate kinds (secret, local_phone, hidden_email) are found by looser patterns.
   Positions are code points: a pattern's matches and the pieces between them give all starts.
2. Labelers vote 1, -1 or 0 (abstain) on every candidate: its shape (regex), a gazetteer of prefixes, area codes, domains and
   known harmless formats, context words before it, contrary words before it, and how its characters vary. None repeats the
   check that admitted the candidate, so they can disagree.
3. EM over the table of vote patterns (at most 3**5 rows a kind) estimates the prior and each labeler's reliability, kind by kind:
   how likely it votes 1, abstains or votes -1 on personal data and on other text. These begin, and are held by ``TRUST``
   pseudo-votes, at better than chance, a vote never counts against what it says, and abstaining counts little; so the class
   of personal data is the one the labelers speak for, at every size of the table.
   An iteration is one aggregate, of which one row a kind returns.
4. The posteriors train a naive Bayes span classifier for each kind, on hashed features of the span and its surroundings and not
   on the votes (``FEATURES`` weights a kind at most, hence broadcast); candidates it accepts, that overlap no base span and no
   candidate of an earlier kind, are added.

The base patterns below have the meaning of the plain ones, written so that Java's matcher neither
backtracks over long runs nor recurses.

Defined cases: a null text is empty and has no spans; a very long text, or span, is searched whole; repeated rows each get their
spans, and teach once; null ids are kept; a score of exactly ``ACCEPT`` is accepted; without any span the result has zero counts; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm.common import materialise

BASE = ("email", "ip", "card", "phone")
CANDIDATES = ("secret", "local_phone", "hidden_email")
PATTERNS = {
    # a run of address characters is tried once, at its start or where the last match ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single blanks or hyphens, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # a run of 16 characters or more, or a shorter one that something names a secret
    "secret": r"(?<![A-Za-z0-9_/+-])(?:[A-Za-z0-9_/+-]{16,}+|(?<=[=:\"'])(?<=(?i:password|passwd|pwd|token|secret|api_?key)[\"']?[=:][\"']?)[A-Za-z0-9_/+-]{8,15}+)",
    "local_phone": r"(?<![0-9+().-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|(?<= )at ) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|(?<= )dot ) ?[A-Za-z]{2,24}(?![A-Za-z])",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"^(?:{BYTE}\.){{3}}{BYTE}$"
#: Each labeler's pattern for a vote of 1 and for one of -1, by kind; neither: it abstains.
SHAPE = {
    "secret": (r"^(?:[A-Z]{4}[A-Z0-9]{16}|[A-Za-z]{2,5}[_-][A-Za-z0-9_-]{16,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,}|[0-9a-f]{16,28})$", r"^(?![A-Z]{4}[A-Z0-9]{16}$)(?:[A-Za-z]+[0-9]+|(?:[A-Za-z]+[_/-])+[A-Za-z0-9]+|[0-9]+[A-Za-z]+)$"),
    "local_phone": (r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})$", r"^(?:\([0-9]{3}[ .-]|[0-9]{3}\))"),
    "hidden_email": (r"[\[(]at[\])].*[\[(]dot[\])]", r"^[^\[(]* at [^\[(]* dot [^\[(]*$"),
}
GAZETTEER = {
    "secret": (r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abprs]-|AIza|eyJ)", r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|(?:/?[A-Za-z]+/)+[A-Za-z0-9_-]*|sha(?:1|256|512)-.*|[0-9_/+-]+[A-Za-z]?)$"),
    "local_phone": (r"^\(?[2-9][0-9]{2}", r"^\(?[01]"),
    "hidden_email": (r"(?i)dot[\])]? ?(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", r"(?i)\b(?:the|a|an|of|in|on|and|is|was|that) at | dot (?:the|a|an|of|in|on|and|is|was)$"),
}
CONTEXT = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|\bkey|auth|bearer|credential)s?[\"']?\s*[=:]?\s*[\"']?$",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|telefon|teléfono|téléphone)\b", "hidden_email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
}
CONTRARY = r"(?i)(?:\b(?:version|release|isbn|issn|doi|uuid|build|commit|rev(?:ision)?|sha-?(?:1|256)?|md5|checksum|digest|hash|figure|section|page|part|model|serial|order|invoice)\b[^.]{0,12}|(?:https?|ftp|file):/?/?\S*)$"
#: How characters vary: changes between letters and digits (which say nothing about a digest's hex digits), or in phone numbers and addresses how few of them are repeated.
VARIETY = {
    "secret": (r"^(?!(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$)(?:[^0-9]*[0-9]+[A-Za-z]+){3,}", r"^(?![A-Z]{4}[A-Z0-9]{16}$)[A-Za-z_/+-]+[0-9]{1,4}$"),
    "local_phone": (r"^(?!.*([0-9])(?:[^0-9]*\1){4}).*$", r"([0-9])(?:[^0-9]*\1){5}"),
    "hidden_email": (r"^[A-Za-z0-9]+[._-]?[A-Za-z0-9]+ ?[\[( ]", r"^[^a-z]*[\[(]"),
}
LABELERS = ("shape", "gazetteer", "context", "contrary", "variety")
BEFORE, FEATURES, ROUNDS, ACCEPT = 40, 4096, 12, 0.5
#: Pseudo-votes of each labeler that are right, abstain and are wrong; pseudo-candidates of each class; the most that abstaining says, as log odds.
TRUST, CLASSES, SILENCE = (8.0, 10.0, 2.0), 2.0, 1.0
_SPANS = "array<struct<kind:string,s:int,e:int,t:string>>"


def _quote(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _found(kind: str) -> str:
    """SQL for all matches of a kind as (kind, s, e, t), from columns ``text`` and m_kind."""
    return f"""aggregate(
      zip_with(m_{kind}, if(size(m_{kind}) > 0, slice(split(text, {_quote(PATTERNS[kind])}, -1), 1, size(m_{kind})), cast(array() as array<string>)), (x, y) -> struct(x as t, char_length(x) as lx, char_length(y) as ly)),
      struct(0 as at, cast(array() as {_SPANS}) as spans),
      (a, z) -> struct(a.at + z.ly + z.lx as at, concat(a.spans, array(struct('{kind}' as kind, a.at + z.ly as s, a.at + z.ly + z.lx as e, z.t as t))) as spans),
      a -> a.spans)"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    return f"""aggregate(sequence(1, char_length({d})), 0L, (a, i) -> a + (case when i % 2 = 1 then cast(substring({d}, -i, 1) as bigint)
      else (2 * cast(substring({d}, -i, 1) as int)) div 10 + (2 * cast(substring({d}, -i, 1) as int)) % 10 end)) % 10 = 0"""


CHECKS = {
    "email": "true",
    "ip": f"x.t rlike {_quote(IP)}",
    "card": _luhn(_digits("x.t")),
    "phone": f"char_length({_digits('x.t')}) between 9 and 15",
    "secret": f"x.t rlike '[0-9]' and x.t rlike '[A-Za-z]' or x.t rlike {_quote(GAZETTEER['secret'][0])}",
    "local_phone": "true",
    "hidden_email": "true",
}


def _listed(spans: str) -> str:
    """SQL: spans as kind:start:end by kind as listed, then start."""
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate((*BASE, *CANDIDATES)))
    return f"concat_ws(',', transform(sort_array(transform({spans}, x -> struct(case x.kind {order} end as rank, x.s as s, x.e as e, x.kind as kind))), x -> concat_ws(':', x.kind, x.s, x.e)))"


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, loose, before): checked base spans, candidates that overlap none, and the text before each candidate."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    kinds = (*BASE, *CANDIDATES)
    for kind in kinds:
        rows = rows.withColumn(f"m_{kind}", F.expr(f"regexp_extract_all(text, {_quote(PATTERNS[kind])}, 0)"))
    rows = rows.select("doc_id", "th", "text", *(F.expr(f"filter({_found(k)}, x -> {CHECKS[k]})").alias(f"s_{k}") for k in kinds))
    base = F.concat(*(f"s_{k}" for k in BASE))
    rows = rows.select("doc_id", "th", "text", base.alias("base"), *(f"s_{k}" for k in CANDIDATES))
    for i, kind in enumerate(CANDIDATES):
        others = ["base", *(f"s_{k}" for k in CANDIDATES[:i])]
        rows = rows.withColumn(f"s_{kind}", F.expr(f"filter(s_{kind}, x -> not exists(concat({', '.join(others)}), b -> b.s < x.e and x.s < b.e))"))
    rows = rows.select("doc_id", "th", "text", "base", F.concat(*(f"s_{k}" for k in CANDIDATES)).alias("loose"))
    before = F.expr(f"transform(loose, x -> substring(text, greatest(1, x.s + 1 - {BEFORE}), least(x.s, {BEFORE})))")
    return rows.withColumn("before", before).drop("text")


def _by_kind(table: dict[str, tuple[str, str]]) -> str:
    """SQL: the vote of a labeler with a pattern for and one against, by kind."""
    return "case " + " ".join(f"when kind = '{k}' and t rlike {_quote(no)} then -1 when kind = '{k}' and t rlike {_quote(yes)} then 1" for k, (yes, no) in table.items()) + " else 0 end"


def vote(found: DataFrame) -> DataFrame:
    """One row a candidate: (doc_id, th, kind, s, e, t, left, five votes)."""
    spans = found.select("doc_id", "th", F.posexplode("loose").alias("i", "x"), "before").select("doc_id", "th", "x.*", F.expr("before[i]").alias("left")).distinct()
    context = "case " + " ".join(f"when kind = '{k}' and left rlike {_quote(p)} then 1" for k, p in CONTEXT.items()) + " else 0 end"
    return spans.select(
        "doc_id", "th", "kind", "s", "e", "t", "left", F.expr(_by_kind(SHAPE)).alias("shape"), F.expr(_by_kind(GAZETTEER)).alias("gazetteer"), F.expr(context).alias("context"),
        F.expr(f"if(left rlike {_quote(CONTRARY)}, -1, 0)").alias("contrary"), F.expr(_by_kind(VARIETY)).alias("variety"),
    )


def reliabilities(spans: DataFrame, rounds: int = ROUNDS) -> dict[str, dict]:
    """EM for two classes and independent labelers, by kind: {'prior': share of personal data, (labeler, vote, class): probability}."""
    patterns = materialise(spans.groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n")), "pii-votes")  # at most 3**5 rows a kind
    votes = [(j, v, y) for j in LABELERS for v in (-1, 0, 1) for y in (0, 1)]
    trust = {(v, y): TRUST[1] if not v else TRUST[0] if (v > 0) == bool(y) else TRUST[2] for v in (-1, 0, 1) for y in (0, 1)}
    params = {r["kind"]: {"prior": 0.5} | {(j, v, y): trust[v, y] / sum(TRUST) for j, v, y in votes} for r in patterns.select("kind").distinct().collect()}
    for _ in range(rounds if params else 0):
        of = {1: F.col("n") * F.col("q"), 0: F.col("n") * (1 - F.col("q"))}
        sums = [F.sum("n").alias("n"), F.sum(of[1]).alias("yes"), *(F.sum(F.when(F.col(j) == v, of[y]).otherwise(0.0)).alias(f"{j}|{v}|{y}") for j, v, y in votes)]
        for r in patterns.withColumn("q", probability(params)).groupBy("kind").agg(*sums).collect():
            total = {1: r["yes"], 0: r["n"] - r["yes"]}
            params[r["kind"]] = {"prior": (r["yes"] + CLASSES) / (r["n"] + 2 * CLASSES)} | {(j, v, y): (r[f"{j}|{v}|{y}"] + trust[v, y]) / (total[y] + sum(TRUST)) for j, v, y in votes}
    return params


def says(p: dict, labeler: str, vote: int) -> float:
    """Log odds that a vote adds."""
    odds = math.log(p[labeler, vote, 1] / p[labeler, vote, 0])
    return max(odds, 0.0) if vote > 0 else min(odds, 0.0) if vote < 0 else min(max(odds, -SILENCE), SILENCE)


def probability(params: dict[str, dict]) -> F.Column:
    """P(personal data | votes) under the estimated reliabilities of the row's kind."""
    odds = F.lit(0.0)
    for kind, p in params.items():
        own = F.lit(math.log(p["prior"] / (1 - p["prior"])))
        for j in LABELERS:
            own = own + F.when(F.col(j) == 1, F.lit(says(p, j, 1))).when(F.col(j) == -1, F.lit(says(p, j, -1))).otherwise(F.lit(says(p, j, 0)))
        odds = F.when(F.col("kind") == kind, own).otherwise(odds)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def classify(spans: DataFrame, params: dict[str, dict], features: int = FEATURES) -> DataFrame:
    """(doc_id, th, kind, s, e, score): naive Bayes by kind on hashed features of the span and what precedes it, trained on the posteriors of all candidates."""
    letters, digits = F.regexp_replace("t", "[^A-Za-z]", ""), F.regexp_replace("t", "[^0-9]", "")
    share = F.floor(F.lit(8) * F.length(digits) / F.length("t"))
    case = F.concat(F.when(letters.rlike("[a-z]"), "a").otherwise(""), F.when(letters.rlike("[A-Z]"), "A").otherwise(""), F.when(letters.rlike("[g-zG-Z]"), "z").otherwise(""))
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring("t", 1, 4), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    word = F.lower(F.regexp_extract("left", r"([^\s\"'=:]+)[\s\"'=:]*$", 1))
    gap = F.regexp_extract("left", r"([\s\"'=:]*)$", 1)
    parts = [("case", case), ("share", share), ("size", F.floor(2 * F.log2(F.length("t")))), ("head", head), ("marks", F.regexp_replace("t", "[A-Za-z0-9]+", "x").substr(1, 16)), ("word", word), ("gap", gap)]
    hashed = F.array_distinct(F.transform(F.array(*(F.concat_ws("|", F.lit(name), x.cast("string")) for name, x in parts)), lambda x: F.pmod(F.xxhash64(x), F.lit(features)).cast("int")))
    rows = materialise(spans.select("doc_id", "th", "kind", "s", "e", probability(params).alias("q"), hashed.alias("features")), "pii-spans")
    totals = rows.groupBy("kind").agg((F.sum("q") + 1).alias("one"), (F.sum(1 - F.col("q")) + 1).alias("zero"))  # a row a kind
    long = rows.select("*", F.explode("features").alias("feature")).drop("features")
    weight = F.log(((F.col("yes") + 0.5) / (F.col("one") + 1)) / ((F.col("no") + 0.5) / (F.col("zero") + 1)))
    weights = long.groupBy("kind", "feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).join(F.broadcast(totals), "kind").select("kind", "feature", weight.alias("weight"))
    scored = long.join(F.broadcast(weights), ["kind", "feature"]).groupBy("doc_id", "th", "kind", "s", "e").agg(F.sum("weight").alias("odds"))
    odds = F.col("odds") + F.log(F.col("one") / F.col("zero"))
    return scored.join(F.broadcast(totals), "kind").select("doc_id", "th", "kind", "s", "e", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("score"))


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each whole text."""
    found = materialise(find_spans(docs), "pii-found")
    spans = vote(found.where(F.size("before") > 0))
    scored = classify(spans, reliabilities(spans))
    added = scored.where(F.col("score") >= accept).groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))
    added = materialise(added, "pii-added")
    joined = found.join(added, found["doc_id"].eqNullSafe(added["doc_id"]) & (found["th"] == added["th"]), "left").select(
        found["doc_id"], F.expr("transform(base, x -> struct(x.kind as kind, x.s as s, x.e as e))").alias("base"), F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")).alias("added")
    )
    return joined.select(
        "doc_id", *(F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(_listed("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_listed("concat(base, added)")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
