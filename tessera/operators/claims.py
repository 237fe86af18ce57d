"""Claims that a report makes, and what its cited sources say of them.

A report is read once, in Arrow batches: lines outside of fences, headings, tables and images are cut into clauses, each with
the markers right behind it; a clause of a known form gives claims (subject, field, value, polarity), any other is a statement
of its own. What reports and their sources say is then dealt by document once, in one sorted order: claims meet facts in windows
over (document, subject, field), statements meet the sentences of their sources in windows over equal texts, and those left over
in windows over shared phrases. Claims and statements count once for each document. Nothing is written, joined or broadcast.

Nulls: a null report or text has no clauses; a null base counts as 0; evidence without an http URL is no source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import flat_map
from tessera.functions.shared import tasks

#: The forms of a claim, tried in this order on a whole clause; the first that fits gives all its claims.
IMAGE = r"(?:image|图像|图)\s+(?P<subject>[\w.-]+)"
QUOTED = r'[“「"](?P<value>[^”」"]+)[”」"]'
EXCLUDED = r'[“「"](?P<other>[^”」"]+)[”」"]'
FIELDS = ("mass|weight|height|length|width|diameter|area|population|orbital inclination", "重量|质量|高度|长度|宽度|直径|面积|人口|轨道倾角")
FORMS = (
    r'(?P<subject>[^:：]+)[:：]\s*(?P<field>.+?)\s*(?P<op>!=|=)\s*[“「"](?P<value>[^”」"]+)[”」"]',
    rf"(?i){IMAGE}\s+gives\s+{QUOTED}\s+for\s+the\s+(?P<field>.+?)\s+and\s+rules out\s+{EXCLUDED}",
    rf"(?i)for\s+the\s+(?P<field>.+?),\s*{IMAGE}\s+rules out\s+{EXCLUDED}\s+and\s+lists\s+{QUOTED}",
    rf"(?i){IMAGE}\s*显示[，,]\s*(?P<field>.+?)为{QUOTED}[，,]\s*可排除{EXCLUDED}",
    rf"(?i)以{IMAGE}\s*为依据[，,]\s*可以排除{EXCLUDED}[，,]\s*并确认{QUOTED}是(?P<field>.+?)的记录",
    rf"(?i)(?P<subject>[^,:;]{{2,90}}?)\s+(?:(?P<negation>does not have|did not have)|has|had)\s+(?:an?\s+)?(?P<field>{FIELDS[0]})\s+of\s+(?P<value>[+-]?\d[\d,.]*(?:\s*[a-z%]+)?)",
    rf"(?P<subject>[^，、；：。]{{2,45}}?)(?:的)?(?P<field>{FIELDS[1]})(?P<negation>不)?(?:为|是)\s*(?P<value>[+-]?\d[\d,.]*(?:\s*[%a-zA-Z一-鿿]{{1,4}})?)",
)
#: What ends a clause, words that deny, numbers, dates, weights of the outcomes.
ENDS = ".。!?！？"
NEGATIVE = r"\b(?:no|not|never|without|false|neither|cannot)\b|并非|没有|不是|不能|不曾|从未|未能"
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNIT = r"\s*[%a-z一-鿿/][%a-z0-9一-鿿/]*"
DATE = r"(\d{4})(?:年|[-/])(\d{1,2})(?:月|[-/])(\d{1,2})日?"
REFERENCE = r"\s*(?:[-*+]\s*)?\[(\d+)\]\s*(?::|\s)\s*(.*)"
URL = r"https?://[^\s)\]}>\"'。，；：！？]+"
SCORES = {"supported": 1.0, "contradicted": 0.0, "wrong_source": 0.0}
LEXICAL = 0.25
LEAST_PHRASES, OF_STATEMENT, OF_SNIPPET = 5, 0.55, 0.45
OUTCOMES = ("supported", "contradicted", "wrong_source", "conflicting_evidence", "insufficient_evidence", "source_not_indexed", "no_citation", "lexical_match", "unverified")

_FORMS = [re.compile(f) for f in FORMS]
_BREAK = re.compile(rf"(?P<cite>[{ENDS}]*\s*(?:[ \t]*\[\d+\])+)|(?<=[{ENDS}])\s+|[。！？]|\n+")
_NUMBER, _DATE, _NEGATIVE = re.compile(rf"({NUMBER})({UNIT})?"), re.compile(DATE), re.compile(NEGATIVE)
_CLOSED, _OF, _IS = re.compile("[”」\"]"), re.compile(r"(?i)of\s+[+-]?\d"), re.compile("[为是]")
_NEEDS = (*(_CLOSED,) * 5, _OF, _IS)  # what a clause of each form holds: without it the form isn't tried
_REFERENCE, _URL, _HTTP, _SENTENCE = re.compile(REFERENCE), re.compile(URL, re.I), re.compile(r"https?://\S+"), re.compile(rf"(?<=[{ENDS}])\s+|[。！？]|\n+")
_MARK, _THE, _DIGITS, _SCHEME = re.compile(r"^(?:[-*+]\s+|\d+[.)]\s+)"), re.compile(r"(?i)^the\s+"), re.compile(r"\d+"), re.compile(r"([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)", re.S)
_WORD, _CHINESE, _LATIN, _AMOUNT = re.compile(r"[a-z0-9]+|[一-鿿]"), re.compile("[一-鿿]"), re.compile("[a-z0-9]+"), re.compile(rf"{NUMBER}%?")

CLAIM = "subject string, field string, value string, polarity boolean, s string, f string, v string, n string"
FREE = "statement string, substantive boolean, phrases array<string>, numbers string, negative boolean"
PART = "kind: string, s: string, f: string, v: string, n: string, yes: boolean, whole: boolean, sources: array<string>, phrases: array<string>"


def plain(text: str) -> str:
    """One form for equal names and values: compatible characters, letter case and white space folded."""
    return " ".join((text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()).split())


def value_key(value: str) -> str:
    """Dates by their parts, numbers by amount and unit, else text."""
    v = plain(value).replace("−", "-")
    if m := _DATE.fullmatch(v):
        return "date:" + "-".join(str(int(p)) for p in m.groups())
    if m := _NUMBER.fullmatch(v):
        amount = Decimal(m[1].replace(",", "")).normalize()
        return f"number:{amount + 0:f}:{(m[2] or '').strip()}"
    return "text:" + v


def clauses(line: str) -> Iterator[tuple[str, list[str]]]:
    """A line's clauses with the numbers of the markers that follow each."""
    at = 0
    for m in _BREAK.finditer(line):
        yield line[at : m.start()], _DIGITS.findall(m["cite"]) if m["cite"] else []
        at = m.end()
    yield line[at:], []


def claims_in(clause: str) -> list[tuple[str, str, str, bool]]:
    """(subject, field, value, polarity) of a clause, by the first form that fits all of it."""
    for need, form in zip(_NEEDS, _FORMS, strict=True):
        if need.search(clause) and (m := form.fullmatch(clause)):
            got = m.groupdict()
            subject, yes = got["subject"], got.get("op", "=") == "=" and not got.get("negation")
            if got.get("op") is None and "other" not in got:
                subject = _THE.sub("", subject)
            out = [(subject, got["field"], got["value"], yes)]
            return [*out, (subject, got["field"], got["other"], False)] if "other" in got else out
    return []


def statement_of(text: str) -> str:
    return plain(text.strip(f" \t{ENDS}“”\"")).rstrip(ENDS)


def features(statement: str) -> tuple[list[str], str, bool]:
    """Distinct phrases (pairs of words, or triples where there is Chinese), its numbers in order, whether it denies."""
    words = _WORD.findall(statement)
    k = 3 if _CHINESE.search(statement) else 2
    phrases = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    numbers = sorted(value_key(n) for n in _AMOUNT.findall(statement.replace("−", "-")))
    return sorted(phrases), "|".join(numbers), bool(_NEGATIVE.search(statement))


def _keyed(claim: tuple[str, str, str, bool]) -> tuple:
    s, f, v, yes = claim
    return s, f, v, yes, plain(s), plain(f), value_key(v), plain(v)


def _free(text: str) -> tuple:
    st = statement_of(text)
    long_ = len(_LATIN.findall(st)) >= 6 or len(_CHINESE.findall(st)) >= 12
    return st, long_, *features(st)


def normal_url(url: str) -> str:
    u = url.strip().rstrip(".,;:!?，。；：！？")
    m = _SCHEME.match(u)
    return m[1].lower() + m[2] if m else u


def _read_report(doc_id: object, report: str | None, statements: bool = True) -> list[tuple]:
    """(doc_id, pos, clause, sources, claim or nulls, statement or nulls) of all clauses that hold a letter or digit."""
    fenced, body, refs = False, [], {}
    for line in map(str.strip, (report or "").splitlines()):
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif line and not fenced and not line.startswith(("#", "|", "![")):
            m = _REFERENCE.fullmatch(line) if line[0] in "-*+[" else None
            urls = _URL.findall(m[2]) if m else []
            if urls:
                refs.setdefault(m[1], set()).update(map(normal_url, urls))
            else:
                body.append(line)
    out, pos = [], 0
    for line in body:
        for raw, cites in clauses(line):
            if not raw:
                continue
            text = _MARK.sub("", raw.strip()).strip(f" {ENDS}")
            if any(map(str.isalnum, text)):
                sets = [refs.get(c, set()) for c in cites]
                sources = sorted(set().union(*sets)) if all(len(s) == 1 for s in sets) else []
                found = claims_in(text)
                if found or statements:
                    out += [(doc_id, pos, text, sources, *_keyed(c), *(None,) * 5) for c in found] or [(doc_id, pos, text, sources, *(None,) * 8, *_free(text))]
                pos += 1
    return out


def report_claims(reports: DataFrame, statements: bool = True) -> DataFrame:
    """A row for each claim or statement of reports (doc_id, report): its clause's place and text, the sources that its
    markers name (none, if one of them names no or several URLs), and the claim with its comparison keys s, f, v, n."""
    x = reports.select("doc_id", "report").repartition(tasks(reports.sparkSession), F.xxhash64("doc_id"))
    kind = reports.schema["doc_id"].dataType.simpleString()
    return flat_map(x, partial(_read_report, statements=statements), f"doc_id {kind}, pos long, clause string, sources array<string>, {CLAIM}, {FREE}")


def _report_parts(doc_id: object, report: str | None, base: float | None) -> list[tuple]:
    """A row with the claims (kind c) and statements (kind t) of a report as parts."""
    parts = []
    for _, _, _, sources, _, _, _, yes, s, f, v, n, statement, long_, phrases, numbers, negative in _read_report(doc_id, report) if doc_id is not None else ():
        parts.append(("c", s, f, v, n, yes, None, sources, None) if statement is None else ("t", None, None, statement, numbers, negative, long_, sources, phrases))
    return [(doc_id, base or 0.0, None, [("r", *(None,) * 8), *parts])]


def _evidence_parts(doc_id: object, url: str | None, text: str | None, complete: bool | None, facts: list | None) -> list[tuple]:
    """A row with the sentences (kind s) and facts (kind f: checked ones, and those that a sentence states as its only claim) of a source."""
    u = normal_url(url or "")
    if doc_id is None or not _HTTP.fullmatch(u):
        return []
    out = []
    for sentence in _SENTENCE.split(text) if text else ():
        st = statement_of(sentence)
        if st:
            phrases, numbers, negative = features(st)
            out.append(("s", None, None, st, numbers, negative, None, None, phrases))
            got = claims_in(sentence.strip().rstrip(ENDS))
            if len(got) == 1 and got[0][3]:
                s, f, v = got[0][:3]
                out.append(("f", plain(s), plain(f), value_key(v), None, False, False, None, None))
    for x in facts or ():
        if x and (x["subject"] or "").strip() and (x["field"] or "").strip() and (x["value"] or "").strip():
            out.append(("f", plain(x["subject"]), plain(x["field"]), value_key(x["value"]), None, bool(x["exclusive"]), complete is True, None, None))
    return [(doc_id, None, u, out)] if out else []


def parts(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """What reports (doc_id, report, base) and evidence (doc_id, url, text, complete, facts array<struct<subject, field, value,
    exclusive>>) say, distinct by document, in one order: a report (kind r, with its base), its claims (c: s, f, v, n, yes the polarity)
    and statements (t: v the text, n its numbers, yes whether it denies, whole whether it is substantive), each with its sources; a
    source's facts (f: yes whether exclusive, whole whether complete) and sentences (s: as statements).

    Rows are dealt by document once, as they were read; all comparisons are windows over that order, so nothing is shuffled again."""
    row = lambda df: f"doc_id {df.schema['doc_id'].dataType.simpleString()}, base double, source string, parts array<struct<{PART}>>"
    said = flat_map(evidence.select("doc_id", "url", "text", "complete", "facts"), _evidence_parts, row(evidence))
    read = flat_map(reports.select("doc_id", "report", F.col("base").cast("double")), _report_parts, row(reports), held=500)
    x = read.unionAll(said).repartition(tasks(reports.sparkSession), "doc_id").select("doc_id", "base", "source", F.inline("parts"))
    same = Window.partitionBy("doc_id", "s", "f", "v", "n", "yes", "whole", "source", "sources").orderBy("kind")
    return x.withColumn("copy", F.row_number().over(same))


def compared(x: DataFrame) -> DataFrame:
    """J11 by document, with C16's second look, and statements that are a sentence of a cited source: reports, claims, statements and
    sentences of ``parts`` with their outcome (a statement's is null where no sentence equals it).

    A claim of a wrong source stays one only if all its sources are complete and the sources it doesn't cite bear it out."""
    c, is_ = F.col, lambda k: F.col("kind") == k
    told = lambda what, k, *by: F.collect_set(F.when(k, what)).over(Window.partitionBy("doc_id", *by))
    x = x.withColumn("equals", told(c("source"), is_("s"), "s", "f", "v"))
    x = x.withColumn("facts", told(F.struct("source", c("v").alias("w"), c("yes").alias("exclusive")), is_("f"), "s", "f"))
    x = x.withColumns({"known": told(c("source"), is_("f")), "complete": told(c("source"), is_("f") & c("whole"))})
    x = x.where((c("kind") == "r") | (c("copy") == 1) & (c("kind") != "f"))
    own = F.filter("facts", lambda t: F.array_contains("sources", t["source"]))
    others = F.filter("facts", lambda t: ~F.array_contains("sources", t["source"]))
    says = lambda t, yes: F.when(t["w"] == c("v"), c("yes") == yes).otherwise(t["exclusive"] & (c("yes") != yes))
    any_ = lambda facts, yes: F.exists(facts, lambda t: says(t, F.lit(yes)))
    whole = F.size(F.array_except("sources", "complete")) == 0
    out = F.when(F.size("sources") == 0, "no_citation").when((F.size(own) == 0) & ~F.arrays_overlap("sources", "known"), "source_not_indexed")
    out = out.when((F.size(own) == 0) & (F.size(others) > 0) & whole & any_(others, True) & ~any_(others, False), "wrong_source").when(F.size(own) == 0, "insufficient_evidence")
    out = out.when(any_(own, True) & any_(own, False), "conflicting_evidence").when(any_(own, False), "contradicted").when(any_(own, True), "supported").otherwise("insufficient_evidence")
    equal = F.when(c("whole") & F.arrays_overlap("sources", "equals"), "supported")
    return x.select("doc_id", "base", "kind", "source", "sources", "n", "yes", "phrases", F.when(is_("c"), out).when(is_("t"), equal).alias("outcome"))


def matched(x: DataFrame) -> DataFrame:
    """(doc_id, base, kind, outcome) of the reports, claims and statements of ``compared``: a statement that equals no sentence is
    a lexical match if it shares phrases, numbers and polarity with a sentence of a cited source, else unverified."""
    c, none = F.col, F.lit(None).cast("string")
    x = x.withColumns({"id": F.monotonically_increasing_id(), "size": F.size("phrases")})
    seeks = (c("kind") == "t") & c("outcome").isNull() & (c("size") >= LEAST_PHRASES)
    phrases = F.when(c("kind") == "s", c("phrases")).when(seeks, F.concat(F.array(none), "phrases")).otherwise(F.array(none))  # a row without a phrase stands for all but sentences
    x = x.select("doc_id", "base", "kind", "outcome", "id", "size", "source", "sources", "n", "yes", F.explode(phrases).alias("phrase"))
    those = F.collect_list(F.when(c("kind") == "s", F.struct("source", c("id").alias("with"), c("size").alias("of")))).over(Window.partitionBy("doc_id", "n", "yes", "phrase"))
    x = x.withColumn("those", those).where("kind <> 's'")
    x = x.withColumn("those", F.when(c("phrase").isNotNull(), F.filter("those", lambda t: F.array_contains("sources", t["source"]))))
    x = x.where("phrase is null or size(those) > 0").select("doc_id", "base", "kind", "outcome", "id", "size", F.explode_outer("those").alias("t"))
    x = x.groupBy("doc_id", "id", "kind", "base", "outcome", "size", c("t.with").alias("with"), c("t.of").alias("of")).agg(F.count(F.lit(1)).alias("c"))
    near = F.expr(f"with is not null and c >= {LEAST_PHRASES} and c / size >= {OF_STATEMENT} and c / of >= {OF_SNIPPET}")
    x = x.groupBy("doc_id", "id", "kind", "base", "outcome").agg(F.max(near).alias("near"))
    return x.select("doc_id", "base", "kind", F.when(c("kind") == "t", F.coalesce("outcome", F.when(c("near"), "lexical_match").otherwise("unverified"))).otherwise(c("outcome")).alias("outcome"))


def combined_evidence(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, combined, decided, total, and a count of each outcome) of reports (doc_id, report, base) against
    evidence: the base score, moved by what decided claims and lexical matches say, over all claims and statements."""
    found = matched(compared(parts(reports, evidence)))
    n = found.groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == "r", F.col("base"))).alias("bases"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("outcome").alias("total"))
    x = n.withColumn("base", F.explode("bases"))
    moved = sum((F.col(o) * (F.lit(w) - F.col("base")) for o, w in SCORES.items()), F.lit(0.0)) + LEXICAL * F.col("lexical_match") * (1 - F.col("base"))
    return x.select("doc_id", (F.col("base") + moved / F.greatest(F.lit(1), "total")).alias("combined"), sum((F.col(o) for o in SCORES), F.lit(0)).cast("long").alias("decided"), "total", *OUTCOMES)
