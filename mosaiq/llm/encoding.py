"""Problem 6: encoding of the whole corpus with a public tokenizer, by content-defined chunk reuse."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import ship

TOKENIZERS = "/opt/tokenizers"
#: The published split pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Positions between two characters at which PATTERN ends one piece and begins the next whatever stands around them: after
# a letter run, a number run or a run of other signs, but not after an apostrophe, which may begin a contraction.
CERTAIN = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])"

WINDOW = 16
#: A cut where 9 bits of the rolling hash are zero: chunks of about half a kilobyte.
CUT_BITS = 9
LEAST_BYTES = 64
#: A task's first uses of a chunk go where those of all tasks go; further ones to copies of the task's own, of so many uses.
SHARED_USES, PER_COPY = 4, 256


class Codec:
    """A byte-level BPE of a vocabulary file, and what is known of its tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        letter = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.array([bool(b) and b[-1] in letter for b in self.bytes])
        self.begins_word = np.array([len(b) > 1 and b[0] == 32 and b[1] in letter for b in self.bytes])
        self.certain = regex.compile(CERTAIN)

    def text(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def _tail(self, ids: np.ndarray) -> int:
        """Where in ids the text after its last certain split begins; 0 if there is none."""
        k = 16
        while True:
            part = ids[max(0, len(ids) - k) :]
            raw = [self.bytes[i] for i in part]
            text = b"".join(raw).decode("utf-8", "replace")
            whole = k >= len(ids)
            # the first characters of a part may be incomplete, and their left neighbour isn't seen
            at = [m.start() for m in self.certain.finditer(text) if whole or m.start() >= 4]
            ends = np.cumsum([len(b) for b in raw])
            for char in reversed(at):
                place = ends[-1] - len(text[char:].encode())
                token = int(np.searchsorted(ends, place))
                if ends[token] == place:
                    return len(ids) - len(part) + token + 1
            if whole:
                return 0
            k *= 4

    def join(self, chunks: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from those of its chunks, each encoded by itself.

        At a joint between a letter and a space with a letter the ids can't change. At any other joint the text from the
        last certain split before to the first one after is encoded again; outside of that stretch the ids agree with
        those of the chunks. Chunks without a certain split are added to the stretch until there is one, so that no text
        is encoded more than twice.
        """
        chunks = [c for c in chunks if len(c)]
        if len(chunks) < 2:
            return chunks[0] if chunks else np.empty(0, self.kind)
        last, first = np.array([c[-1] for c in chunks[:-1]]), np.array([c[0] for c in chunks[1:]])
        safe = self.ends_word[last] & self.begins_word[first]
        if safe.all():
            return np.concatenate(chunks)
        done, held = [], chunks[0]
        i = 1
        while i < len(chunks):
            if safe[i - 1]:
                done.append(held)
                held = chunks[i]
                i += 1
                continue
            start = self._tail(held)
            stretch, rest = [self.text(held[start:])], np.empty(0, self.kind)
            while i < len(chunks):
                raw = [self.bytes[t] for t in chunks[i]]
                text = b"".join(raw).decode("utf-8", "replace")
                found = self.certain.search(text)
                if found:
                    cut = len(text[: found.start()].encode())
                    ends = np.cumsum([len(b) for b in raw])
                    token = int(np.searchsorted(ends, cut)) + 1
                    assert ends[token - 1] == cut, "a certain split is between tokens"
                    stretch.append(b"".join(raw[:token]))
                    rest = chunks[i][token:]
                    i += 1
                    break
                stretch.append(b"".join(raw))
                i += 1
                if i < len(chunks) and safe[i - 1]:
                    break
            again = np.array(self.encode(b"".join(stretch).decode("utf-8", "replace")), self.kind)
            held = np.concatenate([held[:start], again, rest])
        done.append(held)
        return np.concatenate(done)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One to a Python worker."""
    return Codec(path)


def cut_points(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each text data[starts[i]:starts[i+1]], the offsets in data at which it is cut, with both its ends.

    The polynomial rolling hash of the WINDOW bytes before a position decides: its upper CUT_BITS are zero. Hashes of
    all windows are made at once, each doubling of the window by one multiplication and addition. A cut is moved to the
    next space between two words within LEAST_BYTES, else to the next character; both depend on near bytes only, so equal
    passages are cut alike wherever they stand.
    """
    h, mult, width = data.astype(np.uint32), 0x9E3779B1, 1
    while width < WINDOW and len(h) > width:
        h = h[:-width] * np.uint32(mult) + h[width:]
        mult = mult * mult & 0xFFFFFFFF
        width *= 2
    hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + width if width == WINDOW else np.empty(0, np.int64)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    word = np.flatnonzero((data[1:-1] == 32) & letter[:-2] & letter[2:]) + 1 if len(data) > 2 else np.empty(0, np.int64)
    char = (data & 0xC0) != 0x80
    nearest = np.searchsorted(word, hits)
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        cuts, last = [lo], lo
        for k in range(*np.searchsorted(hits, (lo + WINDOW, hi)).tolist()):
            at = int(hits[k])
            if at < last + LEAST_BYTES:
                continue
            if nearest[k] < len(word) and word[nearest[k]] < min(at + LEAST_BYTES, hi):
                at = int(word[nearest[k]])
            else:
                while at < hi and not char[at]:
                    at += 1
            if at >= hi:
                break
            cuts.append(at)
            last = at
        cuts.append(hi)
        out.append(cuts)
    return out


def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each text (id, text as binary); its text only for the task's first use and for each copy's."""
    seen: dict[bytes, int] = {}
    context = TaskContext.get()
    task = (context.partitionId() if context else 0) << 32
    for batch in batches:
        column = batch.column(1)
        data, starts = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw, base = data[starts[0] : starts[-1]], int(starts[0])
        all_bytes = raw.tobytes()
        keys, copies, source, revisions, places, texts = [], [], [], [], [], []
        for row, cuts in enumerate(cut_points(raw, starts.astype(np.int64) - base)):
            revision = hashlib.blake2b(all_bytes[cuts[0] : cuts[-1]], digest_size=8).digest()
            for i in range(len(cuts) - 1):
                text = all_bytes[cuts[i] : cuts[i + 1]]
                key = hashlib.blake2b(text, digest_size=16).digest()
                n = seen.get(key, 0)
                seen[key] = n + 1
                keys.append(key)
                own = n - SHARED_USES
                copies.append(0 if own < 0 else task + 1 + own // PER_COPY)
                source.append(row)
                revisions.append(revision)
                places.append(i)
                texts.append(text if n == 0 or own >= 0 and own % PER_COPY == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), batch.column(0).take(pa.array(source, pa.int64())), pa.array(revisions, pa.binary()), pa.array(places, pa.int32()), pa.array(texts, pa.binary())],
            names=["key", "copy", "id", "revision", "place", "text"],
        )


def encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk, one with its text first: each chunk is encoded once, its ids go to all rows."""
        c, last, ids = codec(path), None, b""
        for batch in batches:
            out = []
            for key, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5), strict=True):
                if (key, copy) != last:
                    last = (key, copy)
                    ids = np.array(c.encode(text.as_py().decode("utf-8", "replace")), c.kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (2, 3, 4)), pa.array(out, pa.binary())], names=["id", "revision", "place", "ids"])

    return encode


def assembler(path: str, count_only: bool):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by document and place: the ids (or their number) of each document."""
        c, now, parts, place = codec(path), None, [], -1
        names, arrays, held, kind = [], [], 0, None

        def flush():
            lengths = [len(a) for a in arrays]
            if count_only:
                values = pa.array(lengths, pa.int64())
            else:
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(arrays) if arrays else np.empty(0)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(names, kind), values], names=["id", "n_tokens" if count_only else "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (row[0], row[1]) != now:
                    if now is not None:
                        names.append(now[0])
                        arrays.append(c.join(parts))
                        held += len(arrays[-1])
                        if held > 1 << 20:
                            yield flush()
                            names, arrays, held = [], [], 0
                    now, parts, place = (row[0], row[1]), [], -1
                if row[2] != place:  # a repeated row brings its chunks twice
                    place = row[2]
                    parts.append(np.frombuffer(row[3], c.kind))
        if now is not None:
            names.append(now[0])
            arrays.append(c.join(parts))
            yield flush()

    return assemble


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, count_only: bool = False) -> DataFrame:
    """(id_col, ids) for each document: its text by a byte-level BPE, without special tokens; or (id_col, n_tokens).

    Null and empty texts give an empty list (or 0). White space is encoded like any other text, and the strings of
    special tokens are ordinary text. Equal rows come out once; an id with several texts once for each; rows without an
    id are dropped; other columns are ignored.

    Texts are cut where a rolling hash of their content says so; chunks are known by a 128-bit digest. Each task sends a
    chunk's text once, and a number of references; sorted by chunk, the first row of each brings the text, which is
    encoded once and its ids handed to all references. A chunk that a task uses more than SHARED_USES times is sent again
    for every PER_COPY further uses, under a number of the task's own, so that however many tasks there are no key
    gathers more than SHARED_USES rows of each. References come together by document, and
    the joints of chunks are repaired until the ids are those of the whole text. Ids are shuffled as two bytes each where
    the vocabulary allows.
    """
    ship(documents.sparkSession)
    path = f"{folder}/{tokenizer}.tiktoken"
    kind, lists = documents.schema[id_col].dataType.simpleString(), "n_tokens bigint" if count_only else "ids array<int>"
    rows = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    full = F.coalesce(F.octet_length("text"), F.lit(0)) > 0
    chunks = rows.filter(full).mapInArrow(to_chunks, f"key binary, copy bigint, id {kind}, revision binary, place int, text binary")
    chunks = chunks.repartition("key", "copy").sortWithinPartitions("key", "copy", F.col("text").isNull())
    parts = chunks.mapInArrow(encoder(path), f"id {kind}, revision binary, place int, ids binary")
    parts = parts.repartition("id", "revision").sortWithinPartitions("id", "revision", "place")
    out = parts.mapInArrow(assembler(path, count_only), f"id {kind}, {lists}")
    nothing = F.lit(0).cast("bigint") if count_only else F.array().cast("array<int>")
    out = out.unionByName(rows.filter(~full).select("id").distinct().select("id", nothing.alias(out.columns[1])))
    return out.withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, ids_col: str = "ids", *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The rows with `text`, the bytes that the ids stand for, instead of ids; no bytes for an empty list, null for null."""
    ship(ids.sparkSession)
    path = f"{folder}/{tokenizer}.tiktoken"

    @F.pandas_udf("binary")
    def join(lists: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if x is None else b"".join(map(c.bytes.__getitem__, x)) for x in lists], dtype=object)

    return ids.withColumn("text", join.asNondeterministic()(ids_col)).drop(ids_col)
