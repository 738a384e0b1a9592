"""Secret scans with corpus-wide ownership frequency.

Three kinds of base spans come from fixed patterns. Besides them every long
mixed token is a candidate. The values of all spans and candidates are hashed
and, over the whole corpus, each hash is counted by distinct repositories and
owners. A value that several owners or many repositories hold is a widely copied
example; one that few hold and that looks random is live-looking. Candidates
that look live become spans of kind ``owned``; base spans stay whatever their
frequency says.

Nulls: a null text is empty; a null owner or repository counts as one of its
own; a null ``doc_id`` keeps its row. Repeated rows count once for each distinct
owner and repository. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: The patterns of the base kinds, in the order that ties take.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A candidate beyond the base kinds: one long token.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
#: Needs letters, digits and this much entropy (bits a character) to look random.
MIN_ENTROPY = 3.2
#: Up to so many owners, and repositories, hold a live-looking value.
MAX_OWNERS, MAX_REPOSITORIES = 1, 8


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base spans, by start and kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that no base span touches."""
    out, k, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and looks_random(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _found(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    schema = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base string, spans array<struct<start:int,kind:int,end:int,value:string,random:boolean>>"

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        base, spans = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text or "")
            base.append(own)
            more = candidates(text, own) if text else []
            spans.append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "random": looks_random(v)} for s, k, e, v in own + more])
        count = lambda kind: [sum(x[1] == kind for x in own) for own in base]
        yield {
            "doc_id": batch.column("doc_id"), "owner": batch.column("owner"), "repository": batch.column("repository"),
            "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base": [joined(x) for x in base], "spans": spans,
        }

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    return materialize(map_arrow(slim, work, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories and n_documents of each hashed value; copies meet map-side."""
    each = found.select("doc_id", "owner", "repository", F.explode("spans").alias("s")).select("doc_id", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"), F.col("s.value").alias("value"))
    pairs = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_uses"))


def scan_secrets(docs: DataFrame, owner: str, repository: str, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans (all, joined), n_live and n_copied, a row for each row of ``docs``.

    ``owner`` and ``repository`` are columns; a repository is known by its owner
    and its name: ``repository`` need not be unique.
    """
    found = _found(docs, owner, repository)
    counted = materialize(ownership(found), "owners")
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories) & F.col("random")
    judged = each.join(counted, "value").select("row", "start", "kind", "end", live.alias("live"))
    kept = judged.where((F.col("kind") < 3) | F.col("live"))
    kinds = F.array(*map(F.lit, KINDS))
    by_row = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    listed = by_row.select("row", text.alias("spans"), "n_live", "n_copied")
    return found.drop("spans").join(listed, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))
