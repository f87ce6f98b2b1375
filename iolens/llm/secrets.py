"""Secret scans by grammar inference.

Three patterns (``BASE``) find secrets whose format or context is plain. Their
values are labelled credentials, from which a format is learned for each kind:
a prefix tree of the values' character classes, whose states are merged where
their statistics agree (the ALERGIA test), gives a probabilistic automaton. A
fourth automaton is learned the same way from ordinary strings. Every other
candidate of a text, a run of credential characters with both a digit and a
letter, is scored by its log-likelihood per character under each credential
automaton against the ordinary one, and added as a span of kind ``format`` if
the ratio passes a threshold set on ordinary strings that were not learned from.

What covers what: the automata are classifiers and are fitted on bounded,
documented samples, at most ``SAMPLE`` different strings of each kind, taken by
the least hashes among all labelled strings of the corpus; every candidate of
every text is scored.

Base spans are exactly the patterns' matches (leftmost, non-overlapping per
kind, failing matches dropped); the method only adds spans, never touching them.

Defined results: null text counts as empty; repeated rows get one result each;
kinds without labelled strings have no automaton, and without any the method
adds nothing; very long strings are scored whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, map_text, prepare, table

KINDS = ("assign", "access", "hex")
#: the patterns (fixed values); the keyword's letters match in either case, ASCII only
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are taken whole, so dropping shorter ones is the same
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
SAMPLE = 3_000
#: ALERGIA's confidence parameter; fewest strings through a state that is compared
ALPHA = 0.01
LEAST_SEEN = 20
#: longest prefix the tree keeps; beyond it a string goes on in the state it has reached
DEPTH = 48
#: part of the held-out ordinary strings that may pass the threshold, and its margin in nats per character
FALSE_RATE = 0.001
MARGIN = 0.2
_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
PLAIN = "plain"
_STOP = "$"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base matches, in the result's order."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def mixed(s: str) -> bool:
    """Long enough for a credential, with a digit and a letter."""
    return len(s) >= 12 and any(map(str.isdigit, s)) and any(map(str.isalpha, s))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Other strings that could be credentials."""
    for m in CANDIDATE.finditer(text):
        s = m.group().rstrip("=-_/+") or m.group()
        if mixed(s):
            yield m.start(), m.start() + len(s)


def symbols(s: str) -> str:
    """Character classes: hex letters and other letters by case, digits, and each mark as itself."""
    return "".join("a" if "a" <= c <= "f" else "z" if "a" <= c <= "z" else "A" if "A" <= c <= "F" else
                   "Z" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c for c in s)


#: how many characters a class stands for
_WIDTH = {"a": 6, "z": 20, "A": 6, "Z": 20, "9": 10}


# ------------------------------------------------------------------- automaton

@dataclass
class Automaton:
    """Probabilistic automaton over character classes: log-probabilities by state
    and class (``_STOP`` ends a string), and the next state."""
    log: list[dict[str, float]] = field(default_factory=list)
    step: list[dict[str, int]] = field(default_factory=list)
    other: list[float] = field(default_factory=list)

    def score(self, s: str) -> float:
        """Log-likelihood per character."""
        state, total = 0, 0.0
        for c in s:
            total += self.log[state].get(c, self.other[state])
            state = self.step[state].get(c, state)
        return (total + self.log[state].get(_STOP, self.other[state])) / (len(s) + 1)


def _differ(n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
    """Hoeffding test of two relative frequencies."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """ALERGIA: merge the compatible states of the strings' prefix tree, in
    breadth-first order, and smooth the automaton's frequencies."""
    kids: list[dict[str, int]] = [{}]
    freq: list[dict[str, int]] = [{}]
    for s in strings:
        state = 0
        for k, c in enumerate([*s, _STOP]):
            freq[state][c] = freq[state].get(c, 0) + 1
            if c == _STOP or k >= DEPTH:
                break
            if c not in kids[state]:
                kids[state][c] = len(kids)
                kids.append({})
                freq.append({})
            state = kids[state][c]
    seen = lambda q: sum(freq[q].values())

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n1, n2 = seen(p), seen(q)
            if n1 < LEAST_SEEN or n2 < LEAST_SEEN:
                continue
            for c in freq[p].keys() | freq[q].keys():
                if _differ(n1, freq[p].get(c, 0), n2, freq[q].get(c, 0), alpha):
                    return False
            todo += [(kids[p][c], kids[q][c]) for c in kids[p].keys() & kids[q].keys()]
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            for c, n in freq[q].items():
                freq[p][c] = freq[p].get(c, 0) + n
            for c, child in kids[q].items():
                if c in kids[p]:
                    todo.append((kids[p][c], child))
                else:
                    kids[p][c] = child

    red, blue = [0], [(0, c) for c in sorted(kids[0])]
    while blue:
        parent, c = blue.pop(0)
        q = kids[parent][c]
        if q in red:
            continue
        into = next((r for r in red if compatible(r, q)), None)
        if into is None:
            red.append(q)
            blue += [(q, x) for x in sorted(kids[q])]
        else:
            kids[parent][c] = into
            known = set(red)
            fold(into, q)
            blue += [(r, x) for r in known for x in sorted(kids[r]) if kids[r][x] not in known and (r, x) not in blue]
    place = {q: k for k, q in enumerate(red)}
    out = Automaton()
    for q in red:
        total = seen(q) + 1.0
        log = {c: math.log(n / total) - math.log(_WIDTH.get(c, 1)) for c, n in freq[q].items()}
        out.log.append(log)
        out.other.append(math.log(1 / total / 72))
        out.step.append({c: place[t] for c, t in kids[q].items() if t in place})
    return out


@dataclass
class Model:
    """Automata by kind (``plain`` among them) and the least ratio of a credential."""
    automata: dict[str, Automaton]
    least: float

    def ratio(self, s: str) -> float:
        own = [a.score(s) for k, a in self.automata.items() if k != PLAIN]
        return max(own) - self.automata[PLAIN].score(s) if own and PLAIN in self.automata else -math.inf

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind) in the result's order, base ones first at a place."""
        base = base_spans(text)
        out = [(a, k, b) for a, k, b in base]
        if len(self.automata) > 1 and PLAIN in self.automata:
            ends = [(a, b) for a, _, b in base]
            for a, b in candidates(text):
                if not any(x < b and a < y for x, y in ends) and self.ratio(symbols(text[a:b])) >= self.least:
                    out.append((a, len(KINDS), b))
        return [(a, b, (*KINDS, "format")[k]) for a, k, b in sorted(out)]


# ------------------------------------------------------------------ Spark side

def labelled(docs: DataFrame) -> DataFrame:
    """``kind, value``: values of base matches, and as ``plain`` words, numbers and
    names from texts without one. Candidates themselves are nobody's examples:
    unlabelled credentials are among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, str]] = set()
            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                for a, k, e in spans:
                    value = ASSIGN.match(text, a).group(2) if k == 0 else text[a:e]
                    found.add((KINDS[k], value))
                if not spans:
                    words = [w for w in re.findall(r"[A-Za-z0-9+/_=-]{8,}", text) if not mixed(w)]
                    found.update((PLAIN, w) for w in words[:: max(1, len(words) // 4)])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return docs.mapInArrow(run, "kind string, value string")


def sampled(values: DataFrame, sample: int) -> list:
    """At most ``sample`` different values of each kind, by the least hashes. The
    part of the hash range that is looked at follows the kind's size."""
    h = values.withColumn("h", F.xxhash64("value"))
    size = {r.kind: r.n for r in h.groupBy("kind").agg(F.approx_count_distinct("h").alias("n")).collect()}  # four kinds at most
    if not size:
        return []
    top = (1 << 63) - 1
    part = F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, 4 * sample * top // n - top if 2 * sample < n else top)])
    h = h.filter(F.col("h") <= F.element_at(part, F.col("kind"))).dropDuplicates(["kind", "h"])
    k = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    return h.withColumn("k", k).filter(F.col("k") <= sample).select("kind", "value").collect()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the formats from the base matches of all documents (``doc_id, text``)."""
    by: dict[str, list[str]] = {}
    for r in sampled(labelled(docs), sample):
        by.setdefault(r.kind, []).append(symbols(r.value))
    held = [s for k, s in enumerate(sorted(by.get(PLAIN, []))) if k % 4 == 0]
    if PLAIN in by:
        by[PLAIN] = [s for k, s in enumerate(sorted(by[PLAIN])) if k % 4]
    model = Model({k: infer(sorted(v)) for k, v in by.items() if v}, 0.0)
    if len(model.automata) > 1 and PLAIN in model.automata:
        ratios = sorted(map(model.ratio, held)) or [0.0]
        model.least = max(0.0, ratios[min(len(ratios) - 1, int(len(ratios) * (1 - FALSE_RATE)))]) + MARGIN
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every row."""
    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in b.column("text").to_pylist():
            spans = model.spans(text)
            base = [f"{k}:{a}:{e}" for a, e, k in spans if k in KINDS]
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in spans))
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{a}:{e}" for a, e, k in spans))
        return out | {"doc_id": b.column("doc_id")}

    return map_text(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", batch)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for a, e, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; ``n_chars``, if there is one,
    follows. Other columns, and rows without secrets, stay as they are."""
    prepare(docs.sparkSession)
    model = fit(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), sample)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, model.spans(t)) if isinstance(t, str) else None for t in texts], dtype=object)

    new = {"text": clean(F.col("text"))}
    out = docs.withColumns(new)
    if "n_chars" in docs.columns:
        changed: Column = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: base matches and strings of a learned format."""
    prepare(spark)
    docs = doc_text(table(spark, sf_dir, "documents"))
    return scan(docs, fit(docs))
