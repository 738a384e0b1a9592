"""Personal data by bootstrapped contextual extraction.

Four kinds of base spans come from fixed patterns: they are the seed entities.
The words before an entity are a lexical pattern, those behind it another. Spark
scores the graph of patterns and instances in rounds: a pattern is as good as its
instances are known to be personal data, an instance as likely as its patterns
make it; what one round finds supports further patterns in the next. Unseen
identifier-like tokens whose score passes a threshold become spans of kind
``found``. Base spans stay whatever the scores say.

Nulls: a null text is empty; a null ``doc_id`` keeps its row. Repeated rows
support a pattern once for each distinct instance. An empty table gives an empty
result; extra columns are ignored by the scan and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_names, join_by_size, map_arrow

KINDS = ("email", "ip", "card", "phone", "found")
#: The patterns of the base kinds. Emails are found from their ``@`` outwards, by these two.
EMAIL_LOCAL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: An unseen identifier: one token of 6 to 40 characters, a digit among them.
TOKEN = re.compile(r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z-]{0,40}[0-9])[A-Za-z0-9][A-Za-z0-9-]{5,39}(?![A-Za-z0-9@_-])")
#: Words before and behind an entity that make its patterns, and how far away they may be.
WORDS, REACH = 2, 80
WORD = re.compile(r"[^\W\d_]+")
#: Rounds of scoring; what a pattern and an unseen instance need.
ROUNDS, MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE = 3, 5, 0.4, 0.8


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        if m := EMAIL_DOMAIN.match(text, at + 1):
            head = text[low:at]
            start = low + len(head.rstrip(EMAIL_LOCAL))
            if start < at:
                yield start, m.end()
                low = m.end()
        # what stands before this @ cannot be part of a later address
        low = max(low, at + 1)
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and start."""
    found = [(0, s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans and unseen identifiers, each with its patterns and instance."""
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    fresh = []
    for m in TOKEN.finditer(text):
        near = int(np.searchsorted(starts, m.end()))
        if not any(e > m.start() for _, e in taken[max(0, near - 4) : near]):
            fresh.append((4, *m.span()))
    out = []
    for kind, s, e in base + fresh:
        before, behind = WORD.findall(text[max(0, s - REACH) : s].lower())[-WORDS:], WORD.findall(text[e : e + REACH].lower())[:WORDS]
        patterns = [_key(" ".join(["<", *before]))] if before else []
        patterns += [_key(" ".join([">", *behind]))] if behind else []
        out.append({"kind": kind, "start": s, "end": e, "patterns": patterns, "instance": _key(text[s:e])})
    return out


def _scan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    schema = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, mentions array<struct<kind:int,start:int,end:int,patterns:array<long>,instance:long>>"

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        base = [base_spans(x) for x in texts]
        count = lambda kind: [sum(x[0] == kind for x in own) for own in base]
        mentions = [_mentions(x, own) if own or DIGIT.search(x) else [] for x, own in zip(texts, base, strict=True)]
        yield {
            "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_email": count(0), "n_ip": count(1), "n_card": count(2), "n_phone": count(3),
            "base": [joined(x) for x in base], "mentions": mentions,
        }

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return scratch.table(map_arrow(slim, work, schema).withColumn("row", F.monotonically_increasing_id()), "scan")


def score_instances(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_pattern: float = MIN_PATTERN) -> DataFrame:
    """Unseen instances and their scores. ``edges``: distinct (pattern, instance, seed).

    A pattern's score is the mean of its instances' scores (seeds 1, unseen 0 at
    first), and 0 with too few instances or too low a mean; an instance's is one
    minus the product of its patterns' doubts. Patterns and scores of a round are
    written: joins with them can be split where one pattern has very many instances.
    """
    known = scratch.table(edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0)), "known")
    unseen = scratch.table(edges.where("not seed").join(known.select("instance"), "instance", "left_anti").select("pattern", "instance"), "unseen")
    scores = known
    for _ in range(rounds):
        scored = join_by_size(edges, scores, ["instance"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("trust"), F.count("*").alias("n")).where((F.col("n") >= min_support) & (F.col("trust") >= min_pattern)).select("pattern", "trust")
        doubt = F.log(F.greatest(F.lit(1) - F.col("trust") * F.lit(0.95), F.lit(1e-12)))
        fresh = join_by_size(unseen, scratch.table(patterns, "patterns"), ["pattern"]).groupBy("instance").agg((F.lit(1.0) - F.exp(F.sum(doubt))).alias("score"))
        scores = scratch.table(known.unionByName(fresh), "scores")
    return scores


def find_pii(docs: DataFrame, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans (all, joined) and all (kind, start, end), a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "pii")
    scan = _scan(docs, scratch)
    each = scan.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    pairs = each.select("kind", F.explode("patterns").alias("pattern"), "instance")
    edges = scratch.table(pairs.groupBy("pattern", "instance").agg(F.max(F.col("kind") < 4).alias("seed")), "edges")
    good = scratch.table(score_instances(edges, scratch).where(F.col("score") >= min_instance).select("instance"), "good")
    fresh = join_by_size(each.where("kind = 4"), good, ["instance"], "left_semi").select("row", "kind", "start", "end")
    added = fresh.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    own = F.transform(F.filter("mentions", lambda m: m["kind"] < 4), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    both = scan.join(added, "row", "left").withColumn("all", F.sort_array(F.concat(own, F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return both.select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", text.alias("spans"), "all")


def redact(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with each span of its text replaced by ``<KIND>``; columns as before, n_chars follows the text if it is there.

    Spans that overlap are replaced together, by the first one's kind.
    """
    found = find_pii(docs) if found is None else found
    columns = docs.columns
    own_id, own_key, own_spans = fresh_names("id", "key", "spans")
    spans = found.where(F.size("all") > 0).groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.first("all").alias(own_spans))
    joined_ = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans[own_id]) & (F.xxhash64(docs["text"]) == spans[own_key]), "left")
    schema = docs.schema

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, spans_ = batch.column("text").to_pylist(), batch.column(own_spans).to_pylist()
        done = [x if not s else _replace(x or "", s) for x, s in zip(texts, spans_, strict=True)]
        out = {c: batch.column(c) for c in columns}
        out["text"] = done
        if "n_chars" in out:
            old = batch.column("n_chars").to_pylist()
            out["n_chars"] = [len(t) if s else n for t, s, n in zip(done, spans_, old, strict=True)]
        yield out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_arrow(joined_, work, ddl)


def _replace(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], x["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
