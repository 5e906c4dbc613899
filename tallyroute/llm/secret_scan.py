"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once. The value of each candidate is hashed (letter case aside), and the
hashes are counted over the whole corpus: in how many repositories (`n_repositories`) and under
how many sources (`n_owners`; a document's `source` stands for its owner, documents of equal or
near-equal text, as `bktree` links them, for one repository) a value occurs. A value of more than
`MAX_OWNERS` owners or more than `MAX_REPOSITORIES` repositories is a widely copied example, under
one owner too; any other looks live.

Base spans are always reported. The method adds spans of further forms, namely values assigned
to other credential names, tokens with a known issuer's prefix and private key blocks, if their
value looks live and they touch no base span.

Counting is partial aggregations (hash with owner or repository, then hash), so a value that stands
in a third of all documents is summed where it is read. Null texts count as empty, a null source is
one owner; rows are told apart by a row number, so repeated or null ids do no harm.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.bktree import classes, simhash
from tallyroute.llm.common import fresh, stored, with_row

MAX_OWNERS = 1
MAX_REPOSITORIES = 20
MASK = "[SECRET]"
# Forms of secrets and the least length of each.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMED = re.compile(
    r"(pwd|bearer|credentials?|private_?key|access_?key|client_?id|auth)[\"']?\x20*[:=]?\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]{16,})",
    re.ASCII | re.IGNORECASE,
)
ISSUED = re.compile(
    r"(?:gh[pousr]_|github_pat_|sk_live_|rk_live_|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
ISSUED_MARKS = ("gh", "_live_", "xox", "glpat-", "eyJ")
DIGIT = re.compile("[0-9]")
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
PEM_END = "PRIVATE KEY-----"
KINDS = ("assign", "access", "hex", "named", "issued", "pem")
BASE_KINDS = 3
MIN_ENTROPY = 3.0

Span = tuple[int, int, int, int, int]  # kind, start, end, start and end of the value

RESULT = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, fp bigint, "
    "spans array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,hash:bigint>>"
)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base form, ordered by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append((0, m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append((1, *m.span(), *m.span()))
    found += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def entropy(value: str) -> float:
    """Bits a character in the value's own distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def further_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the other forms that touch no base span, ordered by start."""
    found: list[Span] = []
    for m in NAMED.finditer(text) if DIGIT.search(text) else ():
        value = m.group(2)
        if re.search("[0-9]", value) and entropy(value) >= MIN_ENTROPY:
            found.append((3, *m.span(), *m.span(2)))
    if any(mark in text for mark in ISSUED_MARKS):
        found += [(4, *m.span(), *m.span()) for m in ISSUED.finditer(text)]
    at = 0
    while PEM_END in text and (m := PEM_BEGIN.search(text, at)):
        end = text.find(PEM_END, m.end())
        at = m.end() if end < 0 else end + len(PEM_END)
        if end >= 0:
            found.append((5, m.start(), at, m.end(), end))
    found.sort(key=lambda s: (s[1], s[0]))
    kept, last, b = [], 0, 0
    for span in found:
        while b < len(base) and base[b][2] <= span[1]:
            b += 1
        if span[1] >= last and not (b < len(base) and base[b][1] < span[2]):
            kept.append(span)
            last = span[2]
    return kept


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def _scan(text: str) -> tuple:
    base = base_spans(text)
    every = base + further_spans(text, base)
    counts = Counter(s[0] for s in base)
    rows = [
        (*s, xxhash.xxh64_intdigest(text[s[3] : s[4]].lower()) - (1 << 63)) for s in every
    ]
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return counts[0], counts[1], counts[2], digest, simhash(text) if rows else 0, rows


def scanned(text: Column) -> Column:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "fp", "spans"]
        for batch in batches:
            rows = [_scan(t if isinstance(t, str) else "") for t in batch]
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(scan, RESULT)(text)


def ownership(
    candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """(hash, n_repositories, n_owners, live) from rows (owner, repository, hash)."""
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    owners = candidates.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = candidates.select("hash", "repository").distinct()
    repositories = repositories.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    return repositories.join(owners, "hash").withColumn("live", few)


def judged(docs: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """The scan of each row, and each row's spans with the verdict on their values."""
    owner = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    scan = stored(
        docs.select(F.col(row).alias("row"), owner.alias("owner"), "doc_id", scanned(F.col("text")).alias("s"))
        .select("row", "owner", "doc_id", "s.*"),
        "scans",
    )
    once = F.array_distinct(F.transform("spans", lambda s: s["hash"]))
    seen = scan.filter(F.size("spans") > 0)
    linked = classes(seen.select("row", "doc_id", "fp"), "doc_id", "fp")
    linked = stored(linked.select("fp", F.col("component").alias("repository")), "repositories")
    held = seen.select("owner", "fp", F.explode(once).alias("hash")).distinct().join(linked, "fp")
    known = stored(ownership(held), "owners")
    spans = seen.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    return scan, spans.join(known, "hash")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Base counts and digest, all spans, and how many values look live or copied."""
    keyed = docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("row"))
    scan, spans = judged(keyed, "row")
    reported = spans.filter((F.col("kind") < BASE_KINDS) | F.col("live"))
    entry = F.struct("start", "kind", "end")
    per_row = reported.groupBy("row").agg(
        _text_of(F.sort_array(F.collect_list(entry))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    return (
        scan.drop("spans", "fp")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            "base_sha256",
            F.coalesce("spans", F.lit("")).alias("spans"),
            F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
            F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
        )
    )


def _masked(text: str | None, ranges: list) -> str | None:
    """The text with the (disjoint or nested) ranges replaced, left to right."""
    if not isinstance(text, str):
        return None
    out, at = [], 0
    for begin, end in sorted((r["value_start"], r["value_end"]) for r in ranges):
        if begin >= at:
            out += [text[at:begin], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_live(docs: DataFrame) -> DataFrame:
    """The documents with live-looking values replaced by `MASK`; widely copied ones stay.

    `n_chars` follows the text where the table has it; other columns are as given.
    """
    row, found = fresh(docs, "_row"), fresh(docs, "_live")
    keyed = with_row(docs, row)
    _, spans = judged(keyed, row)
    live = (
        spans.filter("live")
        .groupBy("row")
        .agg(F.collect_list(F.struct("value_start", "value_end")).alias(found))
        .withColumnRenamed("row", row)
    )

    def mask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranges in batches:
            yield pd.Series([_masked(t, r) for t, r in zip(texts, ranges)], dtype=object)

    changed = F.when(
        F.col(found).isNotNull(), F.pandas_udf(mask, "string")("text", F.coalesce(found, F.array()))
    ).otherwise(F.col("text"))
    out = keyed.join(live, row, "left").withColumn("text", changed)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)
