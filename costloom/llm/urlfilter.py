"""URL filters by a sorted digest array: memory-mapped 64-bit keys, vectorised binary search, full strings to confirm.

An entry is a host and a path prefix. A URL is covered by the entries whose host is its host or a parent domain and
whose path is a prefix of its path, so its candidates are all suffixes of the host times the distinct prefix lengths
of the list. Candidates are hashed, looked up in the sorted keys and compared with the stored strings.
"""

import mmap
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm.wordhash import as_bytes

# A list whose array is larger is joined instead of broadcast.
MAX_BYTES = 256_000_000

# The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def list_text(line: str) -> str | None:
    """A line of a block list as host/path-prefix: the host lower-cased, / behind a bare host; None for blanks and # notes."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    host, slash, path = line.partition("/")
    return f"{host.translate(_LOWER)}/{path if slash else ''}"


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Hosts blocked where no rule decides: the default list, a file beside this module.
BLOCKED_HOSTS = [t for t in map(list_text, (Path(__file__).parent / "lists" / "blocked_hosts.txt").read_text("utf-8").splitlines()) if t]


@dataclass(frozen=True)
class Entry:
    verdict: str
    text: str  # host/path-prefix
    is_rule: bool


def entries_of(rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] = BLOCKED_HOSTS) -> list[Entry]:
    return [Entry(v, t, True) for v, t in rules] + [Entry("block", t, False) for t in blocked]


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a block list as `judge_pages` takes them: a text file or folder (a host or host/path-prefix a line, # notes) or
    a table in Parquet (column `text`). Read by Spark, so any size and any store."""
    lines = spark.read.parquet(path).select("text") if path.rstrip("/").endswith(".parquet") else spark.read.text(path).toDF("text")
    host = F.translate(F.substring_index("_line", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.when(F.instr("_line", "/") > 0, F.expr("substring(_line, instr(_line, '/'))")).otherwise(F.lit("/"))
    listed = lines.withColumn("_line", F.regexp_replace("text", r"^\s+|\s+$", "")).where("_line <> '' and not startswith(_line, '#')")
    return listed.select(F.lit("block").alias("verdict"), F.concat(host, rest).alias("text"), F.lit(False).alias("is_rule")).distinct()


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host on up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit keys, and for each the place of its string; all in one buffer that can be memory-mapped.

    Layout: count, then keys, then offsets (count + 1), then strings. A string is verdict, kind and text.
    """

    def __init__(self, buffer: bytes | mmap.mmap):
        n = int(np.frombuffer(buffer, "<u8", 1)[0])
        self.keys = np.frombuffer(buffer, "<u8", n, 8)
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, 8 + 8 * n)
        self.strings = memoryview(buffer)[8 + 8 * n + 8 * (n + 1) :]
        self.lengths = sorted({len(t) - t.index(b"/") for _, t, _ in map(self.entry, range(n))})

    @staticmethod
    def pack(entries: Iterable[Entry], key=xxhash.xxh64_intdigest) -> bytes:
        rows = sorted((key(e.text.encode()), f"{'ab'[e.verdict == 'block']}{int(e.is_rule)}{e.text}".encode()) for e in entries)
        keys = np.array([k for k, _ in rows], "<u8")
        offsets = np.cumsum([0, *(len(s) for _, s in rows)]).astype("<u8")
        return np.array([len(rows)], "<u8").tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(s for _, s in rows)

    def entry(self, i: int) -> tuple[str, bytes, bool]:
        s = bytes(self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])])
        return ("allow", "block")[s[:1] == b"b"], s[2:], s[1:2] == b"1"

    def probe(self, hosts: list[bytes], paths: list[bytes], key=xxhash.xxh64_intdigest) -> list[tuple[str, str, bool] | None]:
        """The longest covering entry of each URL as (verdict, text, is_rule); rules go before list entries, then longer
        texts, then longer hosts."""
        owner, texts = [], []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            prefixes = [path[:n] for n in self.lengths if n <= len(path)] if host else []
            at = 0
            while prefixes:
                suffix = host[at:]
                texts += [suffix + p for p in prefixes]
                owner += [row] * len(prefixes)
                dot = host.find(b".", at)
                if dot < 0:
                    break
                at = dot + 1
        out: list[tuple[str, str, bool] | None] = [None] * len(hosts)
        best: list[tuple] = [()] * len(hosts)
        if not texts or not len(self.keys):
            return out
        found = np.fromiter(map(key, texts), np.uint64, len(texts))
        place = np.searchsorted(self.keys, found)
        for c in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == found):
            i = int(place[c])
            while i < len(self.keys) and self.keys[i] == found[c]:
                verdict, text, is_rule = self.entry(i)
                if text == texts[c]:
                    rank = (is_rule, len(text), text.index(b"/"), verdict == "block")
                    if rank > best[owner[c]]:
                        best[owner[c]], out[owner[c]] = rank, (verdict, text.decode(), is_rule)
                i += 1
        return out


def _mapped(data: bytes) -> DigestArray:
    """The array memory-mapped from a file of the task's own, which has no name any more."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return DigestArray(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def judge(spark: SparkSession, host: Column, path: Column, packed: bytes | Broadcast) -> Column:
    """struct(rule, verdict, listed): rule is the deciding rule or null, listed the deciding list entry or null."""
    if isinstance(packed, bytes):
        if len(packed) > MAX_BYTES:
            raise ValueError(f"the array has {len(packed)} bytes; use judge_by_join")
        packed = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        array = _mapped(packed.value)
        for hosts, paths in batches:
            found = array.probe([h or b"" for h in as_bytes(hosts)], [p or b"" for p in as_bytes(paths)])
            cols = [
                pa.array([f[1] if f and f[2] else None for f in found], pa.string()),
                pa.array([f[0] if f else "allow" for f in found], pa.string()),
                pa.array([f[1] if f and not f[2] else None for f in found], pa.string()),
            ]
            yield pa.StructArray.from_arrays(cols, ["rule", "verdict", "listed"])

    return arrow_udf(run, "struct<rule:string,verdict:string,listed:string>")(host, path)


def judge_by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """As `judge`, for a list above the broadcast limit: `urls` (host, path), `entries` (verdict, text, is_rule); adds rule,
    verdict and listed.

    Distinct candidate strings are joined on their digest and confirmed on the string; the matches come back to the
    distinct (host, path) pairs, so a host with very many URLs is looked up once per distinct path.
    """
    lengths = [r[0] for r in entries.select((F.length("text") - F.instr("text", "/") + 1).alias("n")).distinct().collect()]
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)] or [F.lit(None).cast("string")])
    pairs = urls.select("host", "path").distinct()
    candidates = (
        pairs.where("host <> ''")
        .select("host", "path", F.explode(hosts).alias("h"), prefixes.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .where("p is not null")
        .select("host", "path", F.concat("h", "p").alias("text"))
    )
    rank = F.struct("is_rule", F.length("text").alias("n"), F.instr("text", "/").alias("h"), (F.col("verdict") == "block").alias("b"), "text", "verdict")
    keyed = entries.withColumn("key", F.xxhash64("text"))
    best = (
        candidates.withColumn("key", F.xxhash64("text"))
        .join(keyed, ["key", "text"])
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        *urls.columns,
        F.when(F.col("best.is_rule"), F.col("best.text")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.is_rule"), F.col("best.text")).alias("listed"),
    )


def judge_pages(
    pages: DataFrame, entries: list[Entry] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, listed.

    Rules decide first, the longest that fits; then the block list; else the URL is allowed. `entries` may be a table (verdict,
    text, is_rule; see `read_block_list`): it is measured first and, above `max_bytes`, joined instead of broadcast. Null URLs
    and URLs without :// have an empty host and path and are allowed. Nulls and repeats of ids, long URLs and extra columns are
    harmless; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(entries, DataFrame):
        # A string has two marks besides its text, a key and an offset.
        size = entries.agg(F.coalesce(F.sum(F.octet_length("text") + 18), F.lit(0)) + 16).first()[0]
        if size > max_bytes:
            return judge_by_join(cut, entries)
        entries = [Entry(*r) for r in entries.select("verdict", "text", "is_rule").collect()]
    packed = DigestArray.pack(entries_of() if entries is None else entries)
    return cut.withColumn("j", judge(pages.sparkSession, F.col("host"), F.col("path"), packed)).select("page_id", "host", "path", "j.*")
