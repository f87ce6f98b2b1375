"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Candidates are the matches of a few patterns. Labelers vote on each (for,
against, or no vote): the strict pattern with its checks, its usual shape,
gazetteers (top-level domains, calling codes, card issuers), and the words and
characters around it. Expectation-maximisation over the vote patterns estimates
how reliable each labeler is, without labels; its posteriors train the final
span classifier, a naive Bayes model on features that are not votes. Candidates
that are no base match are added where the classifier is sure enough.

Votes and features have few values, so all candidates of a corpus boil down to
one aggregate: the number of candidates by kind, votes and features, at most
``kinds * 3**labelers * features`` rows (under 80,000). EM and training run on
that table on the driver; the classifier goes back as a SQL expression.

Base spans (email, ip, card, phone) are exactly the patterns' matches: leftmost,
non-overlapping per kind, failing ones dropped without a retry. The patterns
are written with possessive quantifiers and with starts at a run's first
character or at the end of the match before (``\\G``): same matches, linear time
on long runs and no recursion.

Defined results: null text counts as empty; repeated rows get one result each;
an empty table gives no rows; without candidates nothing is added.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, prepare, table, written

BASE = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: patterns of the candidates, and a cheap test that a text may have one. The first four are the base patterns
PATTERNS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "text like '%@%'"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "text rlike '[0-9][ -]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "text like '%+%'"),
    "email_at": (rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
                 "text like '%at]%' or text like '%at)%' or text like '%AT]%' or text like '%AT)%'"),
    "local_phone": (r"(?<![0-9+()./-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
                    "text rlike '[0-9][ .)-]'"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]'"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "text rlike '[A-Z][0-9]'"),
}
KINDS = tuple(PATTERNS)
#: gazetteers
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
CALLING = ("1", "7", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CUES = {"email": "mail|contact|write|kontakt|correo|courriel", "email_at": "mail|contact|write|kontakt|correo|courriel",
        "ip": "ip|host|server|address|adress|adresse|dirección", "card": "card|visa|master|karte|carte|tarjeta|pay",
        "phone": "tel|phone|call|mobile|fax|anruf|appel", "local_phone": "tel|phone|call|mobile|fax|anruf|appel",
        "national_id": "ssn|social|id|passport|ausweis", "iban": "iban|account|konto|compte|cuenta"}
AGAINST = "version|section|isbn|order|page|chapter|kapitel|serial|hash|sha|commit|="
CONTEXT = 24
LABELERS = ("strict", "shape", "gazetteer", "cue", "around")
FEATURES = ("size", "marks", "edge")
ROUNDS = 40
SURE = 0.95
_CAND = "struct<start: int, end: int, kind: string, base: boolean, votes: string, features: string>"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    d = "coalesce(try_cast(c as int), 0)"
    each = f"transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 1, {d} * 2 - if({d} > 4, 9, 0), {d}))"
    return f"aggregate({each}, 0, (a, x) -> a + x) % 10 = 0"


def _strict(kind: str) -> str:
    """The check a match must pass to be a base span (or a strict candidate of another kind)."""
    n = f"length({_digits('s')})"
    if kind == "ip":
        part = "regexp_replace(p, '^0+(?=.)', '')"
        return f"forall(split(s, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int) <= 255, false))"
    if kind == "card":
        return f"({n} between 12 and 19 and {_luhn(_digits('s'))})"
    if kind == "phone":
        return f"{n} between 9 and 15"
    if kind == "national_id":
        return "not (s like '000%' or s like '666%' or s like '9%' or s like '%-00-%' or s like '%-0000')"
    return "true"


def _votes(kind: str) -> list[str]:
    """One SQL expression for each labeler, giving '+', '-' or '0'."""
    def vote(yes: str, no: str = "false") -> str:
        return f"case when {yes} then '+' when {no} then '-' else '0' end"

    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    n = f"length({_digits('s')})"
    shape = {"email": vote("length(s) between 6 and 64", "length(s) > 100"), "email_at": vote("length(s) between 8 and 64", "length(s) > 100"),
             "ip": vote("length(s) <= 15", "length(s) > 15"), "card": vote(f"{n} in (13, 14, 15, 16)", f"{n} < 12 or {n} > 19"),
             "phone": vote(f"{n} between 9 and 13", f"{n} < 7 or {n} > 15"), "local_phone": vote(f"{n} between 9 and 11", f"{n} < 8"),
             "national_id": vote("true"), "iban": vote("length(s) between 15 and 34")}[kind]
    top = f"lower(regexp_extract(s, '[.]([A-Za-z0-9-]+)$', 1))"
    known = {"email": vote(f"{top} in ({quoted(TOP_LEVEL)})", f"{top} rlike '^[0-9]'"), "email_at": vote(f"{top} in ({quoted(TOP_LEVEL)})", f"{top} rlike '^[0-9]'"),
             "ip": vote("s rlike '^(10|127|172|192)[.]'", "s rlike '^0'"),
             "card": vote(f"{_digits('s')} rlike '^(4|5[1-5]|2[2-7]|3[47]|6(011|5))'", f"{_digits('s')} rlike '^[0789]'"),
             "phone": vote(" or ".join(f"s like '+{c}%'" for c in CALLING), "s like '+0%'"), "local_phone": vote("s rlike '^[(]?0[1-9]'"),
             "national_id": "'0'", "iban": vote("s rlike '^(DE|FR|ES|GB|IT|NL|CH|AT|BE|PT)'")}[kind]
    cue = vote(f"before rlike '(?i)({CUES[kind]})[^0-9]{{0,12}}$'", f"before rlike '(?i)({AGAINST})[^a-z0-9]{{0,3}}$'")
    around = vote("before rlike '(^|[ (<:,;\\n\\t])$' and after rlike '^([ )>,;:.!?\\n\\t]|$)'", "before rlike '[A-Za-z0-9_/=]$' or after rlike '^[A-Za-z0-9_/=]'")
    return [vote(_strict(kind), f"not ({_strict(kind)})"), shape, known, cue, around]


def _features(kind: str) -> list[str]:
    """Feature values of a candidate: how many digits or characters, which marks, what it touches."""
    size = f"case when length(s) < 10 then 'a' when length(s) < 14 then 'b' when length(s) < 18 then 'c' when length(s) < 30 then 'd' else 'e' end"
    marks = "case when s rlike '[ ]' then 's' when s rlike '[-.()]' then 'm' else 'n' end"
    edge = "case when before rlike '[A-Za-z0-9]$' or after rlike '^[A-Za-z0-9]' then 'w' when before rlike '[\"=]$' then 'q' else 'o' end"
    return [size, marks, edge]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: the candidates of every row, all kinds, as an
    array of (start, end, kind, base, votes, features)."""
    df = docs
    none = F.expr("cast(array() as array<struct<at: int, s: string, before: string, after: string>>)")
    for kind in KINDS:
        pattern, test = PATTERNS[kind]
        df = df.withColumn(f"h_{kind}", F.when(F.expr(test), F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)))
                           .otherwise(F.expr("cast(array() as array<string>)")))
    for kind in KINDS:
        pattern, hits = PATTERNS[kind][0], F.col(f"h_{kind}")
        df = df.withColumn(f"g_{kind}", F.when(F.size(hits) > 0, F.split(F.col("text"), pattern, -1)).otherwise(F.expr("cast(array() as array<string>)")))
    for kind in KINDS:
        hits, gaps = F.col(f"h_{kind}"), F.col(f"g_{kind}")
        # the text is gap, match, gap, ..., match, gap; places are running sums of their lengths
        parts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, s: F.struct(g.alias("gap"), s.alias("s")))
        parts = F.zip_with(parts, F.transform(F.slice(gaps, 2, F.size(hits)), lambda g: F.left(g, F.lit(1))),
                           lambda x, a: F.struct(x["gap"].alias("gap"), x["s"].alias("s"), a.alias("after")))
        placed = F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["s"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["gap"])).alias("at"), x["s"].alias("s"),
                                                    F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["after"].alias("after"))).alias("out")),
            lambda acc: acc["out"])
        df = df.withColumn(f"m_{kind}", F.when(F.size(hits) > 0, placed).otherwise(none))
    for kind in KINDS:
        one = (f"named_struct('start', at, 'end', at + length(s), 'kind', '{kind}', 'base', {_strict(kind) if kind in BASE else 'false'}, "
               f"'votes', concat({', '.join(_votes(kind))}), 'features', concat({', '.join(_features(kind))}))")
        for name in ("at", "before", "after", "s"):
            one = _rename(one, name)
        df = df.withColumn(f"c_{kind}", F.expr(f"cast(transform(m_{kind}, m -> {one}) as array<{_CAND}>)"))
    return df.select("doc_id", F.concat(*[F.col(f"c_{k}") for k in KINDS]).alias("found"))


def _rename(sql: str, name: str) -> str:
    """``name`` as a field of the lambda's ``m``, outside of string literals."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)
    return "".join(p if k % 2 else re.sub(rf"(?<![\w.]){name}(?![\w(])", f"m.{name}", p) for k, p in enumerate(parts))


# ------------------------------------------------------- labelers' reliability

def em(rows: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Posterior that a candidate is real, by kind and votes, from counts
    ``(kind, votes, n)``. Each labeler has a table p(vote | real or not), shared by
    all kinds; each kind has its own share of real candidates. Starts from the
    majority of votes; counts are smoothed by one."""
    post = {(k, v): 0.5 + 0.4 * max(-1, min(1, v.count("+") - v.count("-"))) for k, v, _ in rows}
    for _ in range(rounds):
        table_ = [[{x: 1.0 for x in "+-0"} for _ in LABELERS] for _ in (0, 1)]
        share: dict[str, list[float]] = {}
        for k, v, n in rows:
            p = post[k, v]
            s = share.setdefault(k, [1.0, 1.0])
            for real, w in ((1, p * n), (0, (1 - p) * n)):
                s[real] += w
                for j, x in enumerate(v):
                    table_[real][j][x] += w
        for side in table_:
            for t in side:
                total = sum(t.values())
                for x in t:
                    t[x] /= total
        for k, v, _ in rows:
            odds = math.log(share[k][1] / share[k][0]) + sum(math.log(table_[1][j][x] / table_[0][j][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classifier(rows: list[tuple[str, str, str, int]]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Naive Bayes log-odds from ``(kind, votes, features, n)``: bias by kind (from
    the posteriors of its candidates) and a weight for each feature's values."""
    merged: dict[tuple[str, str], int] = {}
    for k, v, _, n in rows:
        merged[k, v] = merged.get((k, v), 0) + n
    post = em([(k, v, n) for (k, v), n in merged.items()])
    kinds: dict[str, list[float]] = {}
    seen = [{} for _ in FEATURES]
    for k, v, f, n in rows:
        p = post[k, v]
        kinds.setdefault(k, [1.0, 1.0])
        for real, w in ((1, p * n), (0, (1 - p) * n)):
            kinds[k][real] += w
            for j, x in enumerate(f):
                seen[j].setdefault(x, [1.0, 1.0])[real] += w
    all_ = [sum(s[r] for s in kinds.values()) for r in (0, 1)]
    bias = {k: math.log(s[1] / s[0]) for k, s in kinds.items()}
    return bias, [{x: math.log(s[1] / all_[1]) - math.log(s[0] / all_[0]) for x, s in f.items()} for f in seen]


def _sure(bias: dict[str, float], weights: list[dict[str, float]], m: Column) -> Column:
    """Whether the classifier is sure of a candidate."""
    def of(value: Column, known: dict[str, float]) -> Column:
        if not known:
            return F.lit(0.0)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), value), F.lit(0.0))

    odds = of(m["kind"], bias)
    for j, w in enumerate(weights):
        odds = odds + of(F.substring(m["features"], j + 1, 1), w)
    return odds >= math.log(SURE / (1 - SURE))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and digest of the base spans, and all spans, of every row."""
    found = written(candidates(docs), "pii-candidates")
    each = found.select(F.explode("found").alias("m"))
    rows = [(r.kind, r.votes, r.features, r.n) for r in
            each.groupBy("m.kind", "m.votes", "m.features").agg(F.count(F.lit(1)).alias("n")).collect()]
    bias, weights = classifier(rows)
    order = F.create_map(*[F.lit(x) for k, kind in enumerate([*BASE, *(f"{b}_loose" for b in BASE), *KINDS[len(BASE):]]) for x in (kind, k)])

    def named(m: Column) -> Column:
        loose = F.when(m["base"] | ~m["kind"].isin(*BASE), m["kind"]).otherwise(F.concat(m["kind"], F.lit("_loose")))
        return F.struct(m["start"].alias("start"), F.element_at(order, loose).alias("k"), m["end"].alias("end"), loose.alias("kind"))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")

    base = F.filter("found", lambda m: m["base"])
    more = F.filter("found", lambda m: ~m["base"] & _sure(bias, weights, m) & ~F.exists(
        F.col("bases"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    out = found.withColumn("bases", base).withColumn("more", more)
    counts = [F.expr(f"cast(size(filter(bases, m -> m.kind = '{k}')) as long) n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(text(F.transform("bases", named)), 256).alias("base_sha256"),
                      text(F.transform(F.concat("bases", "more"), named)).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    prepare(spark)
    return detect(doc_text(table(spark, sf_dir, "documents")))
