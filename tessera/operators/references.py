"""Web references of texts with titles, and files that written paths mean."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import flat_map

#: What a link is, what names a source on a line or before it, what is no title.
LINK = r"\[([^\]\n]{2,200})\]\((https?://[^)\s]+)\)"
MENTION = r"https?://[^\s<>\]\)\"'，。；、]+"
LABELLED = r"(?:来源|出处|参考|Source|Sources|Reference|Link|URL)\s*[:：-]\s*([^\n]{2,200})"
BEFORE_LINE = (r"^\s*[-*+\d.\])、]+\s*", r"\b(url|link|source|sources)\b\s*[:：-]?\s*", r"(来源|链接|网址)\s*[:：-]?\s*")
IN_WINDOW = (r"['\"]title['\"]\s*:\s*['\"]([^'\"]{2,200})['\"]", r"标题\s*[:：]\s*([^\n]{2,200})", r"Title\s*[:：]\s*([^\n]{2,200})")
WINDOW, LONGEST = 500, 200
NO_TITLE = ("url", "link", "source", "sources")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js")
URL_ENDS, TITLE_ENDS = ".,;:!?，。；：！？)]）}\"'", " -:：|[]()（）"
MARKERS = ("work_space", "data/images")


def clean_title(text: str) -> str:
    """A title without addresses, marks and line breaks; '' if nothing that names anything is left."""
    if m := re.fullmatch(r"```(?:markdown|md)?\s*([\s\S]*?)\s*```", text.strip(), re.I):
        text = m[1]
    text = " ".join(re.sub(r"[*_`#>]+", " ", re.sub(r"https?://\S+", "", text)).split()).strip(TITLE_ENDS)
    named = text.lower() not in NO_TITLE and not re.fullmatch(r"\d+", text) and re.search(r"[A-Za-z0-9一-鿿]", text)
    return text[:LONGEST] if named else ""


def _titles(content: str, start: int, end: int, url: str) -> Iterator[tuple[str, str]]:
    """(tier, title) of a mention, best first; a title may be empty."""
    line = content[content.rfind("\n", 0, start) + 1 : content.find("\n", end) if "\n" in content[end:] else None].replace(url, " ")
    if m := re.search(LABELLED, line, re.I):
        yield "label", clean_title(m[1])
    for pattern in BEFORE_LINE:
        line = re.sub(pattern, "", line, flags=re.I).strip()
    yield "line", clean_title(line)
    for pattern in IN_WINDOW:
        if found := re.findall(pattern, content[max(0, start - WINDOW) : end], re.I):
            yield "window", clean_title(found[-1])
    yield "host", urlsplit(url).netloc or url


def _mentions(grp: object, ord_: object, name: str | None, content: str | None) -> list[tuple]:
    """A file's references: each distinct URL at its first place."""
    text, out, seen = content or "", [], set()
    links = {m[2].strip().rstrip(URL_ENDS): clean_title(m[1]) for m in re.finditer(LINK, text)}
    for m in re.finditer(MENTION, text, re.I):
        url = m[0].strip().rstrip(URL_ENDS)
        if url in seen or not re.match(r"(?i)https?://[^/?#]", url) or url.lower().endswith(ASSETS):
            continue
        seen.add(url)
        tier, title = ("link", links[url]) if links.get(url) else next((t, x) for t, x in _titles(text, *m.span(), url) if x)
        out.append((grp, ord_, m.start(), url, title, tier, name))
    return out


def web_references(files: DataFrame) -> DataFrame:
    """(grp, number, url, title, tier, source_file) of files (grp, ord, name, text): a group's distinct reference URLs
    in order of first mention, each with the title that stands there: a link's text, a label or the rest on its line, a title in
    the 500 characters before, or its host."""
    kinds = {c: files.schema[c].dataType.simpleString() for c in ("grp", "ord")}
    x = flat_map(files.select("grp", "ord", "name", "text"), _mentions, f"grp {kinds['grp']}, ord {kinds['ord']}, pos int, url string, title string, tier string, name string")
    first = x.groupBy("grp", "url").agg(F.min(F.struct("ord", "pos", "title", "tier", "name")).alias("m"))
    number = F.row_number().over(Window.partitionBy("grp").orderBy("m.ord", "m.pos"))  # a group's own list
    return first.select("grp", number.alias("number"), "url", F.col("m.title").alias("title"), F.col("m.tier").alias("tier"), F.col("m.name").alias("source_file"))


# --- paths --------------------------------------------------------------------------------------------------------


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def path_candidates(raw: Column, maps: list[tuple[str, str]], root: str) -> Column:
    """P20: where a written path may be, in order: as it is, by FROM=TO maps, from a marker on under the project, and under the
    project if it is relative."""
    path = F.trim(raw)
    out = [path]
    for source, target in maps:
        source, target = source.rstrip("/\\"), target.rstrip("/\\")
        if source:
            out.append(F.when(path.startswith(source), F.concat(F.lit(target), path.substr(F.lit(len(source) + 1), F.length(path)))))
    parts = path_parts(path)

    def first_at(marker: list[str]) -> Column:
        there = lambda i: F.slice(parts, i, len(marker)) == F.array(*[F.lit(p) for p in marker])
        return F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), there))

    for marker in MARKERS:
        at = first_at(marker.split("/"))
        out.append(F.when(at.isNotNull(), F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, at, F.size(parts)), "/"))))
    out.append(F.when(~path.startswith("/"), F.concat(F.lit(root + "/"), path)))
    return F.filter(F.array(*out), lambda c: c.isNotNull() & (c != ""))


def suffixes(path: Column) -> Column:
    """All ends of a path, by whole parts: structs k, suffix."""
    parts = path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, -F.least(k, F.greatest(F.size(parts), F.lit(1))), k), "/").alias("suffix")))


def resolved_paths(refs: DataFrame, index: DataFrame, maps: list[tuple[str, str]] | None = None, root: str = "") -> DataFrame:
    """P20: (ref_id, path, how) of references (ref_id, raw) in an index of files (path): the first candidate that exists, else
    the file that shares the longest end of two parts or more (the least of several), else the only file of that name.

    The index becomes one row for each end of its paths, so a reference meets one row for each of its own ends."""
    c = refs.select("ref_id", F.posexplode(path_candidates(F.col("raw"), maps or [], root)).alias("at", "path"))
    exact = c.join(index.select("path").distinct(), "path", "left_semi").groupBy("ref_id").agg(F.min_by("path", "at").alias("exact"))
    ends = index.select("path").distinct().select("path", F.explode(suffixes(F.col("path"))).alias("e")).groupBy("e.suffix").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    mine = refs.where(F.size(path_parts(F.col("raw"))) > 0).select("ref_id", F.explode(suffixes(F.col("raw"))).alias("e")).select("ref_id", "e.*")
    near = mine.join(ends, "suffix").where("k > 1 or n = 1").groupBy("ref_id").agg(F.max(F.struct("k", "path")).alias("near"))
    x = refs.select("ref_id").join(exact, "ref_id", "left").join(near, "ref_id", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near.k") > 1, "suffix").when(F.col("near").isNotNull(), "name")
    return x.select("ref_id", F.coalesce("exact", "near.path").alias("path"), how.alias("how"))
