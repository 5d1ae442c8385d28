"""Secret scan with corpus-wide ownership frequency.

Three base patterns and a set of wider ones are searched in every whole text. The
values found are hashed and counted over the corpus by distinct repository and owner.
A value that one owner alone has looks live; one that many owners carry is an example
that was copied around. Base spans always stay; wider candidates become spans only
when they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from claimwright.llm.common import salted
from claimwright.session import settle

SALTS = 16

#: The base patterns, in the order in which their kinds are listed.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Wider kinds, kept only where ownership says that they look live. Of ``jwt``
#: the pattern is one part: a token is three parts joined by dots, see ``_jwts``.
WIDE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    ("jwt", r"[A-Za-z0-9_-]+", "eyJ"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY"),
    ("url_login", r"://[^\s/:@]+:[^\s/:@]+@", "://"),
)
MIN_ENTROPY_CHARS, MIN_ENTROPY = 24, 3.5
KINDS = (*BASE_KINDS, *(kind for kind, _, _ in WIDE), "entropy")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_assign_needs = ("passw", "secret", "token", "apikey", "api_key")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # the same runs as [0-9a-f]+ of that length
_wide = tuple((kind, re.compile(pattern), needs) for kind, pattern, needs in WIDE)
_entropy = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_ENTROPY_CHARS)

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end, value)`` of the base patterns; code points, end exclusive."""
    found: list[Span] = []
    folded = text.lower()
    if any(word in folded for word in _assign_needs):
        # Short values are matched first and dropped after, so that they use up their text.
        found += [("assign", m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _access.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    return found


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random_looking(value: str) -> bool:
    classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
    return classes == 3 and entropy(value) >= MIN_ENTROPY


def _jwts(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """``eyJ`` and 8 or more characters, a dot, 8 or more, a dot, 1 or more, leftmost first.

    Goes from run to run of these characters, since a pattern that starts at each ``eyJ``
    would read a long run without a dot once for each of them.
    """
    runs = [m.span() for m in pattern.finditer(text)]
    k = 0
    while k + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[k : k + 3]
        start = text.find("eyJ", a, b)
        if start >= 0 and b - start >= 11 and c == b + 1 and text[b] == "." and d - c >= 8 and e == d + 1 and text[d] == ".":
            yield start, f
            k += 3
        else:
            k += 1


class _Taken:
    """Disjoint intervals in order; a query and an addition are a binary search each."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((s[1], s[2]) for s in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take ``a:b`` if no interval overlaps it."""
        k = bisect_right(self.ends, a)
        if k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def wide_spans(text: str, taken: list[Span]) -> list[Span]:
    """Candidates of the wider kinds outside spans already taken, the first kind first."""
    found: list[Span] = []
    used = _Taken(taken)
    for kind, pattern, needs in _wide:
        if needs in text:
            matches = _jwts(pattern, text) if kind == "jwt" else (m.span() for m in pattern.finditer(text))
            found += [(kind, a, b, text[a:b]) for a, b in matches if used.add(a, b)]
    for m in _entropy.finditer(text):
        if _random_looking(m[0]) and used.add(*m.span()):
            found.append(("entropy", m.start(), m.end(), m[0]))
    return found


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("base", pa.bool_())])
_CANDIDATE_SQL = "array<struct<kind:string,start:bigint,end:bigint,value:binary,base:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        spans, keys = [], []
        for text in batch.column(2):
            whole = text.as_py() or ""
            base = base_spans(whole)
            every = ordered(base + wide_spans(whole, base))
            spans.append(
                [
                    {"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).digest()[:16], "base": k in BASE_KINDS}
                    for k, a, b, v in every
                ]
            )
            keys.append((task << 40) + row)
            row += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), batch.column(0), batch.column(1), pa.array(spans, pa.list_(_CANDIDATE))],
            ["row", "id", "owner", "spans"],
        )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    max_owners: int = 1,
) -> DataFrame:
    """One row per document: ``id_col`` and ``found``, an array of spans in order.

    A span is ``(kind, start, end, base, repos, owners, live)``; ``live`` says that at
    most ``max_owners`` owners have the value. Values themselves are never returned,
    and leave the scan as hashes only. Repositories are counted within their owner;
    without ``repo_col`` each document id is a repository. Null owners count as one
    unnamed owner, null texts as empty; empty texts and empty tables find nothing.
    Repeated rows are scanned each. Extra columns of ``docs`` are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    repo = F.col(repo_col or id_col).cast("string")
    owner = F.concat_ws("\x00", F.coalesce(F.col(owner_col).cast("string"), F.lit("")), F.coalesce(repo, F.lit("")))
    read = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), F.col(text_col).cast("string").alias("text"))
    # Written once: the counts and the result both use it, and row keys stay as they are.
    scanned = settle(read.mapInArrow(_scan, f"row bigint, id {id_type}, owner string, spans {_CANDIDATE_SQL}"))
    each = scanned.where(F.size("spans") > 0).select(
        "row", F.split_part("owner", F.lit("\x00"), F.lit(1)).alias("owner"), F.col("owner").alias("repo"), F.explode("spans").alias("span")
    )
    counts = (
        each.select("span.value", "owner", "repo").distinct()
        .groupBy("value", "owner").agg(F.count("*").alias("repos"))
        .groupBy("value").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    )
    dealt = each.select("row", "span", F.col("span.value").alias("value"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("__salt"))
    judged = dealt.join(salted(counts, SALTS), ["value", "__salt"])
    live = F.col("owners") <= max_owners
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind"))
    kept = judged.where(F.col("span.base") | live).groupBy("row").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("span.start").alias("start"), order.alias("order"), F.col("span.end").alias("end"),
                    F.col("span.kind").alias("kind"), F.col("span.base").alias("base"), "repos", "owners", live.alias("live"),
                )
            )
        ).alias("found")
    )
    empty = F.array().cast(kept.schema["found"].dataType)
    return (
        scanned.select("row", "id").join(kept, "row", "left")
        .select(F.col("id").alias(id_col), F.coalesce("found", empty).alias("found"))
    )


def span_text(spans) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
