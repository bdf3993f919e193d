"""Personal data by weak supervision: regex, gazetteer and context labelers vote, expectation-maximisation weighs them.

Method.  Candidate spans come from patterns: four base kinds, whose valid matches always stay, and wider kinds.  Each
candidate gets four votes (for, none, against): the strict pattern of its kind, gazetteers, words around it, and its
shape.  Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and gives
each pattern a probability.  With these as soft labels a naive Bayes classifier over features of the span is trained;
it decides which candidates of the wider kinds are added.

Native.  Everything on executors is DataFrame functions.  Only the counts of vote patterns (at most ``9 * 81`` rows)
and of features (a few hundred) reach the driver, whatever the input; a few sums over these small tables run there.

Positions.  A pattern is applied twice, as ``split`` and ``regexp_extract_all``; lengths of gaps and matches, added
up, give start and end in code points.  Repetitions are possessive and a match may only start where its run of
characters starts (or where the last match ended), so no text makes the patterns slow or deep.

Scale.  One pass over the texts without a shuffle; spans (no texts) are kept in the checkpoint folder and read again
for the counts and for the result.  Texts without digits, marks or titles skip the patterns that need them.

Edge cases.  Null text counts as empty: no spans, the digest of the empty string.  Repeated rows get a row each.  With
no candidates at all the labelers keep their first guesses.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Base kinds in their order, and the wider kinds after them.
BASE = ("email", "ip", "card", "phone")
WIDER = ("email_hidden", "iban", "name", "phone_local", "ssn")

#: The patterns.  Where a run of characters must not be entered in its middle, see the module's text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_hidden": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
    "phone_local": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be worth trying.
GUARDS = {
    "email": "contains(text, '@')",
    "email_hidden": "(contains(text, '[at') OR contains(text, '(at'))",
    "phone": "contains(text, '+')",
    "name": r"text RLIKE '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\\.?\\x20\\p{Lu}'",
}
#: Conditions that matches of base kinds must meet.
VALID = {
    "email": "true",
    "ip": r"x.txt RLIKE '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.|$)){4}$'",
    "card": "length(regexp_replace(x.txt, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(x.txt, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.txt, '[^0-9]', '')) BETWEEN 9 AND 15",
}
#: Words around a span that speak for or against personal data, by what they may stand before.
CUES_FOR = "mail|e-mail|contact|write|phone|tel|call|fax|mobile|cell|card|visa|mastercard|amex|credit|ip|address|host|ssn|social|iban|account|name|dear|telefon|karte|konto|courriel|carte|correo|tarjeta|nombre"
CUES_AGAINST = "version|ver|release|isbn|issn|order|invoice|page|chapter|section|figure|table|id|serial|model|sku|price|total|hash|commit|sha|build"
#: Gazetteers of last labels of domains, given names, and countries of account numbers.
DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|blog|cloud|tech|store|agency|email|io|ai|co|me|tv|eu|de|fr|es|uk|it|nl|at|ch|be|us|ca|au|nz|jp|cn|in|kr|tw|hk|sg|my|th|"
    "vn|id|ph|br|mx|ar|cl|pe|ru|ua|by|kz|pl|cz|sk|hu|ro|bg|hr|si|rs|gr|tr|il|ae|sa|eg|ma|za|ng|ke|se|no|dk|fi|is|ee|lv|lt|ie|pt|lu"
)
GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Christopher|Lisa|Daniel|Nancy|Matthew|Betty|Anthony|"
    "Margaret|Mark|Sandra|Paul|Ashley|Steven|Emily|Andrew|Kimberly|George|Emma|Edward|Olivia|Henry|Sophia|Anna|Maria|Peter|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Matthias|Ursula|Monika|Petra|Sabine|"
    "Ingrid|Heike|Greta|Lukas|Jonas|Felix|Jean|Marie|Pierre|Michel|Philippe|Nicolas|François|Jacques|Camille|Claire|Sophie|Nathalie|Isabelle|Juliette|Chloé|Léa|Carlos|Ana|Luis|Carmen|José|Juan|Antonio|"
    "Manuel|Francisco|Javier|Miguel|Alejandro|Pedro|Isabel|Lucía|Elena|Pilar|Teresa|Rosa|Ahmed|Mohammed|Fatima|Aisha|Ali|Omar|Wei|Li|Hiroshi|Yuki|Raj|Priya|Ivan|Olga|Dmitri|Natasha|Giovanni|Giulia|Marco"
)
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"

_SPAN = "struct<start:int,stop:int,txt:string,before:string,after:string>"
#: Matches that are added up together; only sums of such groups are added up again.
_TOGETHER = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positioned(kind: str) -> str:
    """Spans of the arrays ``m_kind`` (matches) and ``g_kind`` (gaps, one more)."""
    m, g = f"s.m_{kind}", f"s.g_{kind}"
    entry = f"struct(length({g}[i]) AS gap, length({m}[i]) AS n, {m}[i] AS txt, right({g}[i], 24) AS before, left({g}[i + 1], 12) AS after)"
    chunk = f"transform(sequence(c * {_TOGETHER}, least((c + 1) * {_TOGETHER}, size({m})) - 1), i -> {entry})"
    shifted = "struct(a.at + e.gap AS start, a.at + e.gap + e.n AS stop, e.txt AS txt, e.before AS before, e.after AS after)"
    local = f"aggregate({chunk}, struct(0 AS at, CAST(array() AS array<{_SPAN}>) AS done), (a, e) -> struct(a.at + e.gap + e.n AS at, concat(a.done, array({shifted})) AS done))"
    moved = "transform(e.done, x -> struct(a.at + x.start AS start, a.at + x.stop AS stop, x.txt AS txt, x.before AS before, x.after AS after))"
    chunks = f"transform(sequence(0, (size({m}) - 1) div {_TOGETHER}), c -> {local})"
    whole = f"aggregate({chunks}, struct(0 AS at, CAST(array() AS array<array<{_SPAN}>>) AS done), (a, e) -> struct(a.at + e.at AS at, concat(a.done, array({moved})) AS done), a -> flatten(a.done))"
    return f"CASE WHEN size({m}) > 0 THEN {whole} ELSE CAST(array() AS array<{_SPAN}>) END"


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and an array of spans for each kind; matches of base kinds that fail their condition are gone."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("digits", F.expr("text RLIKE '[0-9]'"))
    parts = []
    for kind, pattern in PATTERNS.items():
        guard = GUARDS.get(kind, "digits")
        parts.append(f"CASE WHEN {guard} THEN regexp_extract_all(text, {_quoted(pattern)}, 0) ELSE CAST(array() AS array<string>) END AS m_{kind}")
    # each generator below is computed once a row: Spark would otherwise repeat these functions wherever they are used
    matched = text.select("doc_id", "text", F.explode(F.array(F.expr(f"struct({', '.join(parts)})"))).alias("m"))
    both = [f"m.m_{kind} AS m_{kind}, CASE WHEN size(m.m_{kind}) > 0 THEN split(text, {_quoted(pattern)}, -1) ELSE CAST(array() AS array<string>) END AS g_{kind}" for kind, pattern in PATTERNS.items()]
    gaps = matched.select("doc_id", F.explode(F.array(F.expr(f"struct({', '.join(both)})"))).alias("s"))
    placed = gaps.select("doc_id", *[F.expr(f"filter({_positioned(k)}, x -> {VALID.get(k, 'true')})").alias(k) for k in PATTERNS])
    # a wider span that touches a base span says nothing new
    base = " OR ".join(f"exists({k}, b -> b.start < x.stop AND x.start < b.stop)" for k in BASE)
    return placed.select("doc_id", *BASE, *[F.expr(f"filter({k}, x -> NOT ({base}))").alias(k) for k in WIDER])


#: Digits of a candidate.
_D = "regexp_replace(x.txt, '[^0-9]', '')"
#: The strict pattern of a kind.
STRICT = {
    "email": r"x.txt RLIKE '^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'",
    "ip": "true",
    "card": "true",
    "phone": "true",
    "email_hidden": r"x.txt RLIKE '[\\[(]dot[\\])]\\x20?[A-Za-z]{2,}$'",
    "iban": "length(replace(x.txt, ' ', '')) BETWEEN 15 AND 34",
    "name": "true",
    "phone_local": r"x.txt RLIKE '^(?:\\([2-9][0-9]{2}\\)|[2-9][0-9]{2})[\\x20.-][2-9][0-9]{2}[\\x20.-][0-9]{4}$'",
    "ssn": "x.txt NOT RLIKE '^(?:000|666|9)' AND x.txt NOT RLIKE '-00-' AND x.txt NOT RLIKE '0000$'",
}
#: What gazetteers say: for, against.
GAZETTEER = {
    "email": (rf"x.txt RLIKE '(?i)\\.(?:{DOMAINS})$'", r"x.txt RLIKE '(?i)\\.(?:png|jpg|gif|js|css|local|invalid)$'"),
    "ip": ("false", r"x.txt RLIKE '^(?:0|127|255)\\.'"),
    "card": ("x.txt RLIKE '^[3-6]'", "x.txt NOT RLIKE '^[2-6]'"),
    "phone": (r"x.txt RLIKE '^\\+[1-9]'", r"x.txt RLIKE '^\\+0'"),
    "email_hidden": (rf"x.txt RLIKE '(?i)\\x20?(?:{DOMAINS})$'", "false"),
    "iban": (f"x.txt RLIKE '^(?:{COUNTRIES})'", f"x.txt NOT RLIKE '^(?:{COUNTRIES})'"),
    "name": (rf"x.txt RLIKE '\\x20(?:{GIVEN})(?:$|\\x20)'", "false"),
    "phone_local": ("false", "x.txt RLIKE '^.?(?:000|111|123|999)'"),
    "ssn": ("false", "x.txt RLIKE '^(?:123-45-6789|078-05-1120|219-09-9999)$'"),
}


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {no} THEN '-' WHEN {yes} THEN '+' ELSE '0' END"


def _candidate(kind: str) -> str:
    """Kind, place, votes and features of one span ``x``."""
    around = r"x.before RLIKE '(?i)(?<!\\p{L})(?:CUES)[\\p{Punct}\\x20]{0,4}(?:\\p{L}{0,4}[\\p{Punct}\\x20]{1,3})?$'"
    inside = r"(x.before RLIKE '[\\p{L}0-9_/=.-]$' OR x.after RLIKE '^[\\p{L}0-9_/=]')"
    votes = [
        _vote(STRICT[kind], "false"),
        _vote(*GAZETTEER[kind]),
        _vote(around.replace("CUES", CUES_FOR), around.replace("CUES", CUES_AGAINST)),
        _vote(f"NOT {inside}", rf"({inside} OR {_D} RLIKE '^([0-9])\\1+$')" if kind not in ("email", "email_hidden", "name") else inside),
    ]
    shape = "pmod(xxhash64(regexp_replace(regexp_replace(x.txt, '[0-9]+', '9'), '\\\\p{L}+', 'a')), 16)"
    features = [
        f"'{kind}'",
        f"concat('{kind} length ', CAST(floor(log2(length(x.txt))) AS string))",
        f"concat('{kind} digits ', CAST(least(length({_D}), 24) AS string))",
        f"concat('{kind} shape ', CAST({shape} AS string))",
        f"concat('{kind} left ', CASE WHEN x.before = '' THEN 'start' WHEN x.before RLIKE '\\\\s$' THEN 'blank' WHEN x.before RLIKE '[\\\\p{{L}}0-9]$' THEN 'word' ELSE 'mark' END)",
        f"concat('{kind} right ', CASE WHEN x.after = '' THEN 'end' WHEN x.after RLIKE '^\\\\s' THEN 'blank' WHEN x.after RLIKE '^[\\\\p{{L}}0-9]' THEN 'word' ELSE 'mark' END)",
        *(f"concat('{name} ', {vote})" for name, vote in zip(("strict", "gazetteer", "context", "outline"), votes, strict=True)),
    ]
    return f"struct('{kind}' AS kind, x.start AS start, x.stop AS stop, concat('{kind} ', {', '.join(votes)}) AS pattern, array({', '.join(features)}) AS features)"


def candidates(found: DataFrame) -> DataFrame:
    """``doc_id, cands``: every span of every kind, in the order of kinds and then of start."""
    each = [f"transform({k}, x -> {_candidate(k)})" for k in (*BASE, *WIDER)]
    return found.select("doc_id", F.expr(f"concat({', '.join(each)})").alias("cands"))


def reliabilities(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The probability of each vote pattern, by expectation-maximisation with a prior for each kind."""
    outcomes = "+0-"
    like = [({"+": 0.75, "0": 0.2, "-": 0.05}, {"+": 0.1, "0": 0.5, "-": 0.4}) for _ in range(4)]
    kinds = {p.split(" ")[0] for p in counts}
    prior = dict.fromkeys(kinds, 0.5)
    out: dict[str, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            kind, votes = pattern.split(" ")
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for labeler, vote in zip(like, votes, strict=True):
                yes, no = yes + math.log(labeler[0][vote]), no + math.log(labeler[1][vote])
            out[pattern] = 1 / (1 + math.exp(min(700.0, no - yes)))
        for kind in kinds:
            own = [(out[p], n) for p, n in counts.items() if p.split(" ")[0] == kind]
            prior[kind] = min(0.99, max(0.01, (sum(p * n for p, n in own) + 2) / (sum(n for _, n in own) + 4)))
        total = sum(counts.values())
        for j in range(4):
            # pseudo-counts keep a labeler that never votes from deciding, and keep for and against apart
            grown = [{v: 2.0 + 0.02 * total * like[j][s][v] for v in outcomes} for s in (0, 1)]
            for pattern, n in counts.items():
                vote = pattern.split(" ")[1][j]
                grown[0][vote] += out[pattern] * n
                grown[1][vote] += (1 - out[pattern]) * n
            like[j] = tuple({v: g[v] / sum(g.values()) for v in outcomes} for g in grown)
    return out


def _lookup(values: dict[str, float], key) -> F.Column:
    """The value of a key in a small table, 0 if it is not there."""
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
    return F.coalesce(table[key], F.lit(0.0))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base kinds, the digest of the base spans, and all spans."""
    kept = cut(candidates(spans(docs)))
    flat = kept.select(F.explode("cands").alias("c")).select("c.pattern", "c.features")
    counts = {r.pattern: r.n for r in flat.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    believed = reliabilities(counts)
    soft = flat.select(_lookup(believed, F.col("pattern")).alias("p"), "features").select("p", F.explode("features").alias("feature"))
    rows = soft.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    of_kind = [r for r in rows if r.feature in PATTERNS]
    yes, no = sum(r.yes for r in of_kind) + 1, sum(r.no for r in of_kind) + 1
    odds = {r.feature: math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1)) for r in rows}
    score = lambda c: F.aggregate(c["features"], F.lit(math.log(yes / no)), lambda total, f: total + _lookup(odds, f))
    listed = lambda column, test: F.concat_ws(",", F.transform(F.filter(column, test), lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))))
    is_base = lambda c: c["kind"].isin(*BASE)
    count = lambda kind: F.size(F.filter("cands", lambda c: c["kind"] == kind)).cast("long")
    return kept.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed("cands", is_base), 256).alias("base_sha256"),
        listed("cands", lambda c: is_base(c) | (score(c) > 0)).alias("spans"),
    )
