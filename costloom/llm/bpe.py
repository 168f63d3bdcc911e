"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, offsets, and decoding.

A rank file gives every token's bytes and its rank. Bytes are written as printable characters, one per byte
(the byte table), so that the tokens become strings; the merge that makes a token is the last pair left when
its bytes are merged by the lower ranks. Texts are cut by the pattern first; each distinct piece is encoded
once per task (bounded cache), long pieces every time.
"""

import base64
import codecs
import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from costloom.llm.wordhash import released
from costloom.session import bound_batches

# The vocabulary is sent to every executor; a rank file above this many bytes is refused.
MAX_RANK_BYTES = 64_000_000
CACHE_PIECES = 150_000
CACHE_LENGTH = 64
# Bytes of text that are cut into pieces at a time: the pieces and ids of a whole Arrow batch would not be small.
CHUNK_BYTES = 1_000_000
REPLACEMENT = "�".encode()


def byte_table() -> list[str]:
    """One printable character per byte: visible Latin-1 characters stand for themselves, the other bytes in
    ascending order for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes the token, or None for a token that no merge makes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(itertools.pairwise(parts))]
        rank, i = min(found)
        if rank >= ranks[token]:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers model of a rank file; pieces come in already cut."""
    chars = byte_table()

    def name(token: bytes) -> str:
        return "".join(chars[b] for b in token)

    pairs = [last_pair(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)]
    tok = Tokenizer(
        models.BPE(
            vocab={name(t): r for t, r in ranks.items()},
            merges=[(name(a), name(b)) for a, b in filter(None, pairs)],
            # A piece that is a token is that token, whatever the merges.
            ignore_merges=True,
        )
    )
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok.to_str()


@functools.cache
def new_letters():
    """Search for characters that the regex library takes for letters or numbers and Python does not know yet."""
    unknown = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    runs = []
    for c in map(ord, "".join(regex.findall(r"[\p{L}\p{N}]+", unknown))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)").search


class Encoder:
    """Pieces to ids and offsets inside a task."""

    def __init__(self, model: str, pattern: str, offsets: bool = False):
        self.tok = Tokenizer.from_str(model)
        self.fast = regex.compile(pattern).findall
        self.exact = pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str
        self.new_letter = new_letters()
        self.passing: list[str] = []
        self.ids: dict[str, tuple[int, ...]] = {}
        self.spans: dict[str, list[tuple[int, int]]] | None = {} if offsets else None

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        """Matches of the pattern in each text, all of them known to the cache afterwards.

        The fast engine may know newer letters and numbers than the tokenizers library. Such pieces never enter the
        cache unchecked: a text with one of them is cut by that library.
        """
        if len(self.ids) > CACHE_PIECES:
            self.ids.clear()
            if self.spans:
                self.spans.clear()
        cut = [self.fast(t) if t else [] for t in texts]
        new = {p for p in set(itertools.chain.from_iterable(cut)) if p not in self.ids}
        odd = {p for p in new if not p.isascii() and self.new_letter(p)}
        if odd:
            for i, parts in enumerate(cut):
                if not odd.isdisjoint(parts):
                    cut[i] = [piece for piece, _ in self.exact(texts[i])]
            new = {p for p in set(itertools.chain.from_iterable(cut)) if p not in self.ids}
        self.passing += [p for p in new if len(p) > CACHE_LENGTH or odd and self.new_letter(p)]
        self.learn(list(new))
        return cut

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            # One call for many pieces; word_ids tells which piece a token belongs to.
            e = self.tok.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = e.ids
            ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))).tolist()
            first = 0
            spans = e.offsets if self.spans is not None else None
            for piece, end in zip(some, ends, strict=True):
                self.ids[piece] = tuple(ids[first:end])
                if spans is not None:
                    self.spans[piece] = spans[first:end]
                first = end

    def forget(self) -> None:
        """Long pieces are not worth keeping, and pieces with new letters must be met again."""
        for piece in self.passing:
            self.ids.pop(piece, None)
            if self.spans is not None:
                self.spans.pop(piece, None)
        self.passing.clear()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.ids.__getitem__
        out = [np.fromiter(itertools.chain.from_iterable(map(known, p)), np.int32) for p in self.pieces(texts)]
        self.forget()
        return out

    def encode_with_offsets(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for pieces in self.pieces(texts):
            ids, starts, ends, at = [], [], [], 0
            for p in pieces:
                ids.extend(self.ids[p])
                for a, b in self.spans[p]:
                    starts.append(at + a)
                    ends.append(at + b)
                at += len(p)
            out.append((np.array(ids, np.int32), np.array(starts, np.int32), np.array(ends, np.int32)))
        self.forget()
        return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, about CHUNK_BYTES at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(sizes[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES)))
        yield texts.slice(at, upto - at).to_pylist()
        at = upto


def _model(spark: SparkSession, ranks_path: str):
    """The vocabulary as a broadcast: the driver reads the file, executors need not have it."""
    ranks = read_ranks(ranks_path)
    bound_batches(spark)
    return spark.sparkContext.broadcast(tokenizer_json(ranks))


def encode(spark: SparkSession, text: Column, ranks_path: str, pattern: str, offsets: bool = False) -> Column:
    """array<int> of token ids, or struct(ids, starts, ends) with code-point offsets (end exclusive; a token
    inside a character covers the whole character). Null and empty texts give no ids."""
    model = _model(spark, ranks_path)

    def ids_only(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(model.value, pattern)
        for part in itertools.chain.from_iterable(map(_parts, batches)):
            yield _lists(enc.encode(part))

    def with_offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(model.value, pattern, offsets=True)
        for part in itertools.chain.from_iterable(map(_parts, batches)):
            rows = enc.encode_with_offsets(part)
            yield pa.StructArray.from_arrays([_lists([r[i] for r in rows]) for i in range(3)], ["ids", "starts", "ends"])

    if offsets:
        return arrow_udf(with_offsets, "struct<ids:array<int>,starts:array<int>,ends:array<int>>")(text)
    return arrow_udf(ids_only, "array<int>")(text)


def token_bytes(model: str) -> dict[int, bytes]:
    """Id -> bytes by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_table())}
    return {i: bytes(back[c] for c in name) for name, i in json.loads(model)["model"]["vocab"].items()}


def _joined(ids: list[int | None], table: dict[int, bytes]) -> bytes:
    try:
        return b"".join(map(table.__getitem__, ids))
    except KeyError:
        return b"".join(table.get(i, REPLACEMENT) for i in ids)


def decode(spark: SparkSession, ids: Column, ranks_path: str) -> Column:
    """binary: the bytes of the ids in order. Ids outside the vocabulary and nulls give the bytes of U+FFFD; a null
    list gives none. Bytes are joined before any character is read, so characters split over tokens are whole."""
    model = _model(spark, ranks_path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_bytes(model.value)
        for lists in batches:
            values, at = lists.values, np.asarray(lists.offsets).tolist()
            # Row by row: the ids of a batch as Python numbers would be many times its size.
            rows = (values.slice(a, b - a).to_pylist() for a, b in itertools.pairwise(at))
            yield pa.array([_joined(row, table) for row in rows], pa.binary())

    return arrow_udf(run, "binary")(ids)


def round_trip(spark: SparkSession, text: Column, ranks_path: str, pattern: str, ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256, same[, ids]): encoding and decoding in one pass inside one worker.

    The digests are those of `ids_digest` and of the decoded bytes; `same` tells whether these are the text's.
    """
    model = _model(spark, ranks_path)
    fields = ["n_tokens", "ids_sha256", "decoded_sha256", "same", *["ids"] * ids]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, table = Encoder(model.value, pattern), token_bytes(model.value)
        for part in itertools.chain.from_iterable(map(_parts, batches)):
            rows = enc.encode(part)
            back = [_joined(r.tolist(), table) for r in rows]
            cols = [
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                pa.array([b == (t or "").encode() for b, t in zip(back, part, strict=True)], pa.bool_()),
            ]
            yield pa.StructArray.from_arrays([*cols, *[_lists(rows)] * ids], fields)

    kinds = ["bigint", "string", "string", "boolean", "array<int>"]
    return arrow_udf(released(run), f"struct<{','.join(f'{n}:{k}' for n, k in zip(fields, kinds, strict=False))}>")(text)


def stream_texts(ids: list[int], table: dict[int, bytes]) -> list[str]:
    """Text that each token completes: a character split over tokens appears with its last one, bytes that can
    no longer become a character as U+FFFD."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(table.get(i, REPLACEMENT)) for i in ids]
    if out:
        out[-1] += reader.decode(b"", final=True)
    return out


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values, at = np.asarray(lists.values, dtype="<u4"), np.asarray(lists.offsets)
            yield pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in itertools.pairwise(at)], pa.string())

    return arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of `docs` and the ids of every whole text; a column named like `ids_col` is replaced.

    Null and empty texts: an empty list. Repeated rows, nulls in other columns and very long texts pass as they
    are; an empty table gives no rows.
    """
    return docs.withColumn(ids_col, encode(docs.sparkSession, F.col(text_col), ranks_path, pattern))
