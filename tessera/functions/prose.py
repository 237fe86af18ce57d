"""One lexer for prose in Markdown, and the repetition of a report by it.

The lexer reads a text once, left to right, and gives the words that count: runs of ASCII letters, digits, ``%`` and Chinese
characters, in NFKC and lower case, and one ``<url>`` for each link or bare address. What else stands in Markdown (images,
citation marks, tags, list numbers at the start of a line) is stepped over. A text's normal form is its words with single spaces.
The whole text, its sentences and its paragraphs all go through this lexer, in one call a report, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: What a link, an address, a citation, a list number and a table's divider look like; least lengths.
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
ADDRESS = r"https?://[^\s)\]}>\"'。，；：！？]+"
CITATION = r"\[\s*(?:\d+|[ivxlcdm]+)(?:\s*(?:,|;|-|--|–|—)\s*(?:\d+|[ivxlcdm]+))*\s*\]"
TAG = r"<[^>\n]+>"
NUMBERED = r"(?:\d+[.)、]|[a-z][.)])"
BULLET = r"(?:[-*+]|\d+[.)、])"
DIVIDER = r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*"
SENTENCE = r"[^.!?。！？]+[.!?。！？]?"
LEAST_SENTENCE, LEAST_PARAGRAPH, GRAM = 30, 40, 24

_SKIP = rf"(?:[ \t`*_~]|{CITATION}|{TAG})"
_LEX = re.compile(
    rf"{IMAGE}|\[(?P<label>(?:{IMAGE}|[^\]\n])+)\]\((?:https?://|file://)[^)]+\)|(?P<address>{ADDRESS})|(?:{CITATION})+|{TAG}"
    rf"|(?m:^){_SKIP}*(?:\#{{1,6}}{_SKIP}*)?(?:>{_SKIP}*)?{NUMBERED}(?=[\s`*_~]|{CITATION}|{TAG})|(?P<word>[0-9a-z%一-鿿]+)"
)
_WORD, _CITED = re.compile(r"[0-9a-z%一-鿿]+"), re.compile(CITATION)
_PLAIN = re.compile(rf"[\[<]|://|(?m:^)[`*_~\#> \t]*{NUMBERED}[\s`*_~]").search  # without any of these, words are all there is
_TOKEN = re.compile("[0-9a-z%]+|[一-鿿]")
_SENTENCE, _BLOCKS, _ITEMS = re.compile(SENTENCE), re.compile(r"\n\s*\n+"), re.compile(rf"(?m)^\s*(?={BULLET}\s+)")
_HEADING, _DIVIDER = re.compile(r"\s{0,3}#{1,6}\s"), re.compile(DIVIDER)
_LINE_MARKS = re.compile(r"(?:\s{0,3}>\s?)?(?:\s{0,6}(?:[-*+]|\d+[.)、]|[A-Za-z][.)])\s+)?")


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def words(text: str) -> list[str]:
    """The words of a text in order; an address is ``<url>``."""
    return _lexed("\n".join(map(str.strip, folded(text).split("\n"))))


def _lexed(low: str) -> list[str]:
    if not _PLAIN(low):
        return _WORD.findall(low)
    if "](" in low:
        return _marked(low)
    bare = _CITED.sub(" ", low)
    if not _PLAIN(bare):  # citations are all that was marked
        return _WORD.findall(bare)
    if "\n" not in low or bare.count("\n") < low.count("\n"):
        return _marked(low)
    *lines, last = low.split("\n")  # without links and citations over line ends, nothing spans lines
    return [w for line in (*(x + "\n" for x in lines), *([last] if last else ())) for w in _line(line)]


def _line(low: str) -> list[str]:
    if not _PLAIN(low):
        return _WORD.findall(low)
    bare = _CITED.sub(" ", low)
    return _marked(low) if _PLAIN(bare) else _WORD.findall(bare)


def _marked(low: str) -> list[str]:
    out: list[str] = []
    for m in _LEX.finditer(low):
        kind = m.lastgroup
        if kind == "word":
            out.append(m[0])
        elif kind == "address":
            out.append("<url>")
        elif kind == "label":
            out += [*_lexed(m["label"]), "<url>"]
    return out


def normal(text: str) -> str:
    return " ".join(words(text))


def sentences(text: str) -> Iterator[str]:
    """Normal sentences of 30 characters or more."""
    for s in _SENTENCE.findall(re.sub(r"\s+", " ", text)):
        if len(n := normal(s)) >= LEAST_SENTENCE:
            yield n


def paragraphs(text: str) -> Iterator[str]:
    """Normal paragraphs of 40 characters or more. List items stand alone; headings, rules, dividers of tables and blocks
    that open with a fence don't count, nor do lines between fences."""
    for block in _BLOCKS.split(text):
        bare = block.strip()
        if not bare.strip("|-: ") or bare.startswith(("```", "---", "***")) or _HEADING.match(bare) or _DIVIDER.fullmatch(bare):
            continue
        for item in _ITEMS.split(block):
            kept, code = [], False
            for line in item.splitlines():
                if line.strip().startswith("```"):
                    code = not code
                elif not (code or _HEADING.match(line) or _DIVIDER.fullmatch(line)):
                    kept.append(line[_LINE_MARKS.match(line).end() :].strip())
            if len(n := normal(" ".join(filter(None, kept)))) >= LEAST_PARAGRAPH:
                yield n


def grams(tokens: list[str], n: int = GRAM) -> Counter:
    """How often each n-gram occurs; equal grams are equal stretches of the tokens' numbers."""
    number: dict[str, int] = {}
    raw = np.array([number.setdefault(t, len(number)) for t in tokens], np.int32).tobytes()
    return Counter(raw[i : i + 4 * n] for i in range(0, len(raw) - 4 * n + 1, 4))


def _extra(c: Counter, above: int = 1) -> float:
    return sum(k - 1 for k in c.values() if k > above) / max(1, c.total())


REPEATS = StructType([StructField(n, DoubleType() if n.startswith("dup") else IntegerType()) for n in ("n_paragraphs", "dup_paragraphs", "most_paragraph", "n_sentences", "dup_sentences", "most_sentence", "dup_ngrams", "most_ngram")])


def repeats_of(text: str) -> tuple:
    p, s = Counter(paragraphs(text)), Counter(sentences(text))
    g = grams(_TOKEN.findall(normal(text)))
    most = lambda c: max(c.values(), default=0)
    return p.total(), _extra(p), most(p), s.total(), _extra(s), most(s), _extra(g, 3), most(g)


@F.pandas_udf(REPEATS)
def repeats(text: pd.Series) -> pd.DataFrame:
    """C1's counts (A7, A8) of a report, from its text alone."""
    return pd.DataFrame([repeats_of(t or "") for t in text], columns=REPEATS.names)


repeats = repeats.asNondeterministic()  # so that filters on what is made of it aren't moved below it and worked out several times


@F.pandas_udf(ArrayType(StringType()))
def normal_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(sentences(t or "")))


@F.pandas_udf(ArrayType(StringType()))
def normal_paragraphs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(paragraphs(t or "")))


@F.pandas_udf(StringType())
def normal_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: normal(t or ""))
