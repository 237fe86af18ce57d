"""Phrase collocations by hierarchical pair naming.

Level 1 gives every frequent word of a language an id. Level k looks at two neighbouring ids of level k-1, which share all but
their outer words: pairs are counted over the whole corpus, and a frequent pair gets an id of its own, under which it stands in
the sequences of the next level. A phrase of k words is thus a row (id, left, right, f) whose parents are its first and its last
k-1 words; cuts and subsumption are read by following parents, and texts aren't looked at again.

Names reach the sequences in one of two ways, with equal results: tables of at most ``most`` names (a size checked before they
are sent) go to the tasks, which look up pairs in Arrow batches; if a level has more, positions are rows and are joined with the
names, frequent names apart from the others. Counts are summed within tasks before the shuffle. Parents are joined in the same
two ways: broadcast up to ``MOST_PARENTS`` rows, else by shuffles.

Defined results: null texts count as empty, a null language as ``und``; repeated rows and ids count each time; ties go by score,
then frequency, then phrase in byte order; an empty table gives no rows; other columns are ignored. Counts up to 2**63-1;
products are decimals of 38 digits.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import attach, lean, sent, small_batches, written

#: Texts as bytes: A-Z lower, what ends a piece as 0xFF (in no UTF-8), tab as space.
PLAIN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
HELD = 2_000_000
MOST_NAMES = 1 << 22
MOST_WORDS = 1 << 20
MOST_PARENTS = 1 << 19
DISTINCT = 300_000


def tokens(text: str | None) -> list[bytes]:
    """A text's words, with 0xFF between pieces."""
    return (text or "").encode().translate(PLAIN).replace(b"\xff", b" \xff ").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of a task's texts, and a row with a null word for all of a language."""
    seen: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            c.pop(b"\xff", 0)
            words, n = [None, *c], [c.total(), *c.values()]
            for i in range(0, len(words), 50_000):
                w = pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(w), pa.string()), w, pa.array(n[i : i + 50_000], pa.int64())], names=["lang", "word", "f"])
        seen.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            seen.setdefault(lang, Counter()).update(tokens(text.as_py()))
        if sum(map(len, seen.values())) > DISTINCT:
            yield from rows()
    yield from rows()


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The rows, written, with a dense ``id`` from 1, and how many they are. One number a partition reaches the driver."""
    t = written(df.withColumn("m__", F.monotonically_increasing_id()), tag)
    at, offsets = 1, []
    for part, n in sorted(map(tuple, t.groupBy(F.shiftright("m__", 33)).count().collect())):
        offsets.append((part, at))
        at += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "p__ long, b__ long"))
    out = t.join(base, F.shiftright("m__", 33) == F.col("p__")).withColumn("id", F.col("b__") + F.col("m__").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("m__", "p__", "b__"), at - 1


def _packed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours that both have a name, and where they start."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    return (seq[at] << 32) | seq[at + 1], at


def _next_level(seq: np.ndarray, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.zeros(len(seq), np.int64)
    pairs, at = _packed(seq)
    if len(keys) and len(pairs):
        k = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        hit = keys[k] == pairs
        out[at[hit]] = names[k[hit]]
    return out


def _sequences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Each text as a row: ids of its words (32 bits), 0 for infrequent words, between pieces and at the end."""
    t = words.select("lang", "word", "id").toArrow()
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for lang, word, i in zip(*(t.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
        by_lang.setdefault(lang, ([], []))[0].append(word)
        by_lang[lang][1].append(i)
    get = sent(docs.sparkSession, {lang: ("\n".join(w).encode(), np.array(i, np.int32)) for lang, (w, i) in by_lang.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: dict(zip(w.split(b"\n"), i.tolist(), strict=True)) for lang, (w, i) in get().items()}
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = known.get(lang, {}).get
                out.append(array("i", [*[name(w, 0) for w in tokens(text.as_py())], 0]).tobytes())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["seq"])

    return written(docs.mapInArrow(lean(run), "seq binary"), "sequences")


def _joined(rows: pa.BinaryArray) -> np.ndarray:
    """A batch's sequences, one after another."""
    if not len(rows):
        return np.zeros(0, np.int64)
    off = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[off[0] : off[-1]].view("<i4").astype(np.int64)


def _count_pairs(seqs: DataFrame, levels: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(left, right, f) of a level's pairs: names of the levels before it are looked up one after another. Names that are sent are
    so few that two fit a long."""
    get = sent(seqs.sparkSession, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = get(), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(pairs), 100_000):
                p = pairs[i : i + 100_000]
                yield pa.record_batch([pa.array(p), pa.array(n[i : i + 100_000])], names=["pair", "f"])
            held.clear()

        for b in batches:
            seq = _joined(b.column(0))
            for keys, names in known:
                seq = _next_level(seq, keys, names)
            held.append(_packed(seq)[0])
            size += len(held[-1])
            if size > HELD:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    x = seqs.mapInArrow(lean(run), "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))
    return x.select(F.shiftright("pair", 32).alias("left"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right"), "f")


def _sent_levels(docs: DataFrame, words: DataFrame, longest: int, least: int, most: int) -> list[DataFrame]:
    seqs, levels, sent_names = _sequences(docs, words), [], []
    for k in range(2, longest + 1):
        t, n = numbered(_count_pairs(seqs, sent_names).where(F.col("f") >= least), f"phrases{k}")
        levels.append(t)
        if k == longest:
            break
        if n > most:
            return []
        a = t.select("left", "right", "id").toArrow()
        left, right, names = (a.column(c).to_numpy() for c in ("left", "right", "id"))
        keys = (left << 32) | right
        order = np.argsort(keys)
        sent_names.append((keys[order], names[order].astype(np.int32)))
    return levels


def _joined_levels(docs: DataFrame, words: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """The same with a row for each position, for names of any number."""
    rows = written(docs.withColumn("r", F.monotonically_increasing_id()), "rows")
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = rows.select("r", "lang", F.posexplode(F.split(low, "[.,;:!?\n-\r]", -1)).alias("p", "piece"))
    at = pieces.select("r", "lang", "p", F.posexplode(F.filter(F.split("piece", "[ \t]+", -1), lambda w: w != "")).alias("q", "word"))
    at = at.select("r", "lang", "word", (F.shiftleft(F.col("p").cast("long"), 31) + F.col("q")).alias("pos"))
    spread = F.struct("r", "pos")
    cur = written(attach(at, words.select("lang", "word", "id", "f"), ["lang", "word"], "f", spread).where("id is not null").select("r", "pos", "id"), "names")
    levels = []
    for k in range(2, longest + 1):
        after = cur.select("r", (F.col("pos") - 1).alias("pos"), F.col("id").alias("right"))
        pairs = written(cur.withColumnRenamed("id", "left").join(after, ["r", "pos"]), "pairs")
        t, _ = numbered(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least), f"phrases{k}")
        levels.append(t)
        if k < longest:
            cur = written(attach(pairs, t, ["left", "right"], "f", spread).where("id is not null").select("r", "pos", "id"), "names")
    return levels


def phrases(docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """All frequent phrases by level, each a table (id, lang, phrase, last, f, pre, suf) with its parents left and right; and
    the number n of words per language. ``pre`` holds f of the first 1, 2, ... words, ``suf`` of the last 1, 2, ...;
    ``most``: the most names that are sent to tasks (0: always joins)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = docs.mapInArrow(lean(_count_words), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = written(counted.where(f"word is null or f >= {least}"), "words")
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    words, n = numbered(counted.where("word is not null"), "names1")
    levels = _sent_levels(docs, words, longest, least, MOST_NAMES if most is None else most) if n <= (MOST_WORDS if most is None else most) else []
    levels = levels or _joined_levels(docs, words, longest, least)
    none = F.expr("cast(array() as array<bigint>)")
    out = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf"))]
    for t in levels:
        up, few = out[-1], n <= (MOST_PARENTS if most is None else most)
        a = up.select(F.col("id").alias("left"), F.col("f").alias("n_l"), "lang", F.col("phrase").alias("first"), F.array_append("pre", F.col("f")).alias("pre"))
        b = up.select(F.col("id").alias("right"), F.col("f").alias("n_r"), "last", F.array_append("suf", F.col("f")).alias("suf"))
        if few:
            x = t.join(F.broadcast(a.drop("n_l")), "left").join(F.broadcast(b.drop("n_r")), "right")
        else:
            x = attach(attach(t, a, ["left"], "n_l", F.col("id")), b, ["right"], "n_r", F.col("id"))
        out.append(written(x.select("id", "left", "right", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "last", "f", "pre", "suf"), "parents"))
        n = out[-1].count()
    return totals, out[1:]


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80, text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by their worst cut, floor(2000000 a / (l + r)).

    A phrase that a longer one holds, with at least ``cover`` % of its frequency, is dropped. Any such longer phrase has a
    one-word-longer one within it that holds the phrase as a parent and is at least as frequent, so only children count."""
    totals, levels = phrases(docs, longest, least, text_col, lang_col, most)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = []
    for k, t in enumerate(levels, 2):
        x = t.withColumnRenamed("f", "a")
        if k < longest:
            child = levels[k - 1]
            held = child.select(F.col("left").alias("id"), "f").union(child.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("held"))
            x = x.join(held, "id", "left").where((F.col("held").isNull()) | (F.lit(100).cast("decimal(10,0)") * big("held") < F.lit(cover).cast("decimal(10,0)") * big("a")))
        cut = [F.struct(F.expr(f"cast(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(pre[{j - 1}] as decimal(20,0)) + cast(suf[{k - j - 1}] as decimal(20,0))) as bigint)").alias("score"), F.lit(j).alias("k"), F.col("pre")[j - 1].alias("l"), F.col("suf")[k - j - 1].alias("r")) for j in range(1, k)]
        kept.append(x.select("lang", "phrase", "a", F.array_min(F.array(*cut)).alias("cut")))
    x = kept[0]
    for y in kept[1:]:
        x = x.unionAll(y)
    x = x.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return x.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ws, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 30),
j AS (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k > 1),
c AS (SELECT j.lang, j.ws, j.k, j.a, l.a AS l, r.a AS r, j.j, CAST(2000000::HUGEINT * j.a // (l.a + r.a) AS BIGINT) AS score
  FROM j JOIN g l ON l.lang = j.lang AND l.ws = j.ws[1:j.j] JOIN g r ON r.lang = j.lang AND r.ws = j.ws[j.j + 1:j.k]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) AS best FROM c),
s AS (SELECT g.lang, g.k, g.a, unnest(range(2, g.k)) AS m, g.ws FROM g WHERE k > 2),
q AS (SELECT lang, a, m, ws, unnest(range(1, k - m + 2)) AS i FROM s),
h AS (SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS held FROM q GROUP BY ALL),
f AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.ws = b.ws WHERE best = 1 AND (h.held IS NULL OR 100::HUGEINT * h.held < 80::HUGEINT * b.a))
SELECT f.lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM f) f JOIN n ON n.lang = f.lang WHERE rank <= 2000
"""
