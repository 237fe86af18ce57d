"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts each text into chunks wherever the last 32 bytes say so, so copies have the same chunks whatever
stands before them. A chunk's tokens are worked out once and kept; where two chunks meet, the text between the last point
that the left chunk and the first point that the right chunk settle is encoded anew, and reaches further until both sides
agree. A point is settled where a non-space is followed by a space: no pre-token spans it and nothing left of it bears on
what is right of it, so tokens up to and from there are those of the whole text. Rows are range-partitioned by their least
line hash, so copies stand next to one another and find their chunks already encoded; a hot key is split by the id.

Defined results: null or empty text has no tokens and decodes to ''; rows are never dropped or merged, so repeated rows and
null ids give rows of their own; other columns are not carried; strings of special tokens within a text count as the
library counts them (one special id); ids outside the vocabulary are left out when decoding.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, lean, slices, small_batches

#: Letters, numbers and white space of which every version of Unicode says the same; other texts go to the library whole.
LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яЁёぁ-ゖァ-ヺ一-龥가-힣"
NUMBER = r"0-9²³¹¼-¾"
PLAIN = rf"\n\t\r\x20-\x7e¡-ɏ‐-‧‰-⁞€{LETTER}"
WINDOW = 32
BLOCK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next free point from 256."""
    seen = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(path: str) -> tuple[list[bytes], dict[int, str]]:
    """Bytes of each id (b'' where there is none) and the special ids of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    special = {t["id"]: t["content"] for t in j["added_tokens"]}
    known = byte_alphabet()
    out = [b""] * (1 + max([*j["model"]["vocab"].values(), *special]))
    for t, i in j["model"]["vocab"].items():
        if i not in special:
            out[i] = bytes(known[c] for c in t)
    for i, t in special.items():
        out[i] = t.encode()
    return out, special


class ChunkEncoder:
    """Encodes whole texts; chunks, pre-tokens and joins seen before are taken from bounded memories."""

    def __init__(self, path: str, chunk_bits: int = 9, most: int = 120_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        table, special = token_bytes(path)
        ranks = {b: i for i, b in enumerate(table) if b and i not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.special = [s for s in special.values()]
        self.pre = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^ \n\t\r{LETTER}{NUMBER}]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
        self.odd = re.compile(f"[^{PLAIN}]")
        self.first = re.compile(r"\S(?=[ \n\t\r])")
        self.last = re.compile(r".*\S(?=[ \n\t\r])", re.S)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple[str, bytes, str] | str] = {}
        self.most, self.bits = most, chunk_bits
        self.gear = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.encoded = self.reused = self.held = 0

    def exact(self, text: str) -> bytes:
        """Ids (little-endian, 32 bits) of a text that starts and ends at settled points."""
        if self.odd.search(text) or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, parts = self.words, self.pre.findall(text)
        try:
            return b"".join([words[p] for p in parts])
        except KeyError:
            if len(words) > self.most:
                words.clear()
            for p in parts:
                if p not in words:
                    words[p] = array("I", self.bpe.encode_ordinary(p)).tobytes()
            return b"".join([words[p] for p in parts])

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Places where a chunk may start, from the bytes before them alone."""
        out = []
        for lo in range(0, max(len(raw) - 1, 0), BLOCK):  # block by block, so that long texts need little
            part = raw[max(0, lo - WINDOW + 1) : lo + BLOCK]
            h = self.gear[part]
            k = 1
            while k < WINDOW:
                h[k:] += h[:-k] << np.uint32(k)
                k *= 2
            at = np.flatnonzero((h >> np.uint32(32 - self.bits)) == 0) + max(0, lo - WINDOW + 1) + 1
            out.append(at[(at > lo) & (at < len(raw))])
        at = np.concatenate(out) if out else np.zeros(0, np.int64)
        return at[(raw[at] & 0xC0) != 0x80]

    def chunk(self, raw: bytes) -> tuple[str, bytes, str] | str:
        """A chunk's text up to its first settled point, the ids up to its last, and the rest; or the text, if it has none."""
        got = self.chunks.get(raw)
        if got is not None:
            self.reused += 1
            return got
        self.encoded += 1
        text = raw.decode()
        a = self.first.search(text)
        if not a:
            got = text
        else:
            b = self.last.match(text).end()
            got = (text[: a.end()], self.exact(text[a.end() : b]), text[b:])
        cost = 4 * len(raw) + 500  # the chunk, its text, its ids and their objects
        self.held += cost
        if self.held > 256 * self.most:
            self.chunks.clear()
            self.held = cost
        self.chunks[raw] = got
        return got

    def encode(self, raw: bytes, cuts: list[int]) -> bytes:
        out, open_ = [], ""
        for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True):
            got = self.chunk(raw[a:b])
            if isinstance(got, str):
                open_ += got
                continue
            out += (self.exact(open_ + got[0]), got[1])
            open_ = got[2]
        out.append(self.exact(open_))
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        out = []
        for i, j in slices(texts):
            raw, off = bytes_of(texts.slice(i, j - i))
            if not len(raw):
                out += [b""] * (j - i)
                continue
            data = raw.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                out.append(self.encode(data[a:b], self.cuts(raw[a:b]).tolist()) if b > a else b"")
        return out


def _held(path: str) -> ChunkEncoder:
    """One encoder per Python worker, so its memories serve all tasks of that worker."""
    keep = sys.modules.setdefault("_tessera_held", types.ModuleType("_tessera_held")).__dict__
    if path not in keep:
        keep[path] = ChunkEncoder(path)
    return keep[path]


class Decoder:
    """Bytes of all tokens, special ones too, one after another; broken UTF-8 becomes U+FFFD."""

    def __init__(self, path: str):
        table, _ = token_bytes(path)
        self.size = np.array([len(x) for x in table] + [0], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def text(self, ids: bytes | None) -> str:
        t = np.minimum(np.frombuffer(ids or b"", "<u4").astype(np.int64), len(self.size) - 1)
        n = self.size[t]
        ends = np.cumsum(n)
        where = np.repeat(self.at[t] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[where].tobytes().decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids binary): ids as little-endian unsigned 32-bit integers, as the tokenizers library has them without added
    special tokens. With ``decoded`` also text, which the ids decode to, by the same process."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = _held(tokenizer), Decoder(tokenizer) if decoded else None
        for b in batches:
            for i in range(0, b.num_rows, 200):
                ids = e.encode_all(b.column(1).slice(i, 200))
                cols = [b.column(0).slice(i, 200), pa.array(ids, pa.binary())]
                yield pa.record_batch([*cols, pa.array(map(d.text, ids), pa.string())], names=[id_col, "ids", "text"]) if d else pa.record_batch(cols, names=[id_col, "ids"])

    near = F.array_min(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.xxhash64(x)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = docs.select(id_col, text_col, near.alias("near__")).repartitionByRange(n, "near__", id_col)
    return dealt.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind.simpleString()}, ids binary" + ", text string" * decoded)


def decode(ids: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, text) of a table (id_col, ids)."""
    small_batches(ids.sparkSession, 1000)
    kind = ids.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.column(1).slice(i, 200)
                yield pa.record_batch([b.column(0).slice(i, 200), part, pa.array(map(d.text, part.to_pylist()), pa.string())], names=[id_col, "ids", "text"])

    return ids.select(id_col, "ids").mapInArrow(lean(run), f"{id_col} {kind.simpleString()}, ids binary, text string")


def token_ids(ids: DataFrame) -> DataFrame:
    """ids as array<bigint> instead of bytes, by built-in functions."""
    n = (F.octet_length("ids") / 4).cast("int")
    byte = "conv(hex(concat(substring(ids, 4*i+4, 1), substring(ids, 4*i+3, 1), substring(ids, 4*i+2, 1), substring(ids, 4*i+1, 1))), 16, 10)"
    return ids.withColumn("token_ids", F.when(n == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.expr(f"transform(sequence(0, cast(octet_length(ids)/4 as int) - 1), i -> cast({byte} as bigint))")))
