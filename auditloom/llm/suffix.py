"""Removal of repeated passages with suffix arrays sorted in two stages.

A byte goes if it is in a string of ``LENGTH`` bytes that also starts anywhere
else. To bring equal strings together without sending all suffixes, each string
is filed under its anchor: the position, among those it can hold, whose gram of
``GRAM`` bytes hashes lowest. Equal strings have equal anchors, so only anchors
whose gram occurs twice are followed up, each with the bytes around it that its
strings can reach (its context).

Equal contexts are one class, which counts as often as it has members. The
classes of a gram are put into a text, the gram itself as one symbol that sorts
first, and their suffixes are sorted in two stages: those smaller than their
successor directly, all others induced by one scan over the buckets of first
symbols. Neighbours in the suffix array whose common prefix is a whole string
are one run; the strings of a run that counts more than once are repeats, in
all members of its classes.

A gram of very many classes is not sorted in one task: its strings are cut into
two ranges by where they start, each range has a longer common gram, and the
cut contexts are filed anew under it and counted, until the groups are small
enough to be sorted. At most eight such rounds lead to single strings.

Besides, the text is winnowed: of every ``PASSAGE - GRAM + 1`` neighbouring
grams the one that hashes lowest is looked up. Each passage of ``PASSAGE`` bytes
(fifty words or so) that occurs elsewhere holds one that does; a text that
shares no ``GRAM`` bytes holds none. This is counted only, nothing is removed for it.

Nulls: a null text is empty; a null id is an id. Repeated rows repeat each
other. Texts shorter than ``LENGTH`` keep all bytes. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, ByteHash, Scratch, join_by_size, map_arrow, mix64, text_batches

LENGTH, GRAM, PASSAGE = 400, 200, 264
REACH = LENGTH - GRAM
#: Classes that one group may have, and that are sorted at a time.
GROUP, BLOCK = 200, 2000
_AT_BITS = 26
#: Symbols of a context's text: the gram sorts first, the end last; bytes are shifted by one (UTF-8 has none above 0xF4).
_GRAM_SYMBOL, _END_SYMBOL = 0, 255


def lowest(grams: np.ndarray, whole: list[np.ndarray], widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width, ascending: positions, ascending, of the lowest of every so many neighbouring hashes (the first of equal ones), of the windows that start where ``whole`` says."""
    found: list[list[np.ndarray]] = [[] for _ in widths]
    step = (1 << _AT_BITS) - widths[-1]
    for base in range(0, len(grams), step):
        own = grams[base : base + step + widths[-1] - 1]
        low = (own >> np.uint64(_AT_BITS) << np.uint64(_AT_BITS)) | np.arange(len(own), dtype=np.uint64)
        size = 1
        for k, width in enumerate(widths):
            if len(own) < width:
                break
            while 2 * size <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            rest = width - size
            least = np.minimum(low[:-rest], low[rest:]) if rest else low
            least = least[:step][whole[k][base : base + min(step, len(least))]]
            if len(least):
                least = least[np.concatenate([[True], least[1:] != least[:-1]])]
                found[k].append((least & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64) + base)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]


def anchors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of many texts at once: hashes of their winnowed grams and how many each has, (key, context hash, place) of their anchors and how many each has.

    Place packs position, left and right reach.
    """
    sizes = np.array([len(x) for x in raw], np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    data = np.frombuffer(b"".join(raw), np.uint8)
    n, none = len(data), np.zeros(0, np.int64)
    if n < PASSAGE:
        return none, np.zeros(len(raw), np.int64), (none, none, none), np.zeros(len(raw), np.int64)
    hashed = ByteHash(data)
    first = np.arange(n - GRAM + 1)
    grams = hashed.slices(first, first + GRAM)
    whole = []
    for length in (PASSAGE, LENGTH):  # windows of grams that lie in one text
        edge = np.zeros(n + 1, np.int32)
        long = sizes >= length
        np.add.at(edge, start[long], 1)
        np.add.at(edge, end[long] - length + 1, -1)
        whole.append(np.cumsum(edge[:-1]) > 0)
    winnowed, at = lowest(grams, whole, (PASSAGE - GRAM + 1, REACH + 1))
    of = np.searchsorted(end, at, "right")
    left, right = np.minimum(at - start[of], REACH), np.minimum(end[of] - at, LENGTH)
    shape = (left * 1024 + right).astype(np.uint64)
    context = mix64(hashed.slices(at - left, at + right) + shape * np.uint64(0x9E3779B97F4A7C15))
    place = ((at - start[of]) << 17) | (left << 9) | right
    count = lambda x: np.bincount(np.searchsorted(end, x, "right"), minlength=len(raw))
    return grams[winnowed].view(np.int64), count(winnowed), (grams[at].view(np.int64), context.view(np.int64), place), count(at)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _filed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, sha256, winnowed grams and anchors (key, context, place) of each row, and a number of its own (row)."""
    schema = "doc_id long, n_bytes long, sha256 string, grams array<long>, anchors array<struct<key:long,context:long,place:long>>"

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id")
        for begin, texts in text_batches(batch, "text", CHUNK_BYTES):
            raw = [x.encode("utf-8", "surrogatepass") for x in texts]
            grams, n_grams, own, n_own = anchors(raw)
            yield {
                "doc_id": ids.slice(begin, len(texts)),
                "n_bytes": [len(x) for x in raw],
                "sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                "grams": _lists(pa.array(grams), n_grams),
                "anchors": _lists(pa.StructArray.from_arrays([pa.array(x) for x in own], ["key", "context", "place"]), n_own),
            }

    return scratch.table(map_arrow(docs, work, schema).withColumn("row", F.monotonically_increasing_id()), "filed")


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _with_text(rows: DataFrame, filed: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with the text of their row, found by id and SHA-256: texts are shuffled once, if their id is wanted."""
    placed = rows.join(filed.select("row", F.col("doc_id").alias("__id"), F.col("sha256").alias("__sha")), "row")
    texts = docs.withColumnRenamed("doc_id", "__id")
    texts = join_by_size(texts, placed.select("__id").distinct(), ["__id"], "left_semi", null_safe=True)
    texts = texts.select("__id", "text", _sha().alias("__sha")).dropDuplicates(["__id", "__sha"])
    same = placed["__id"].eqNullSafe(texts["__id"]) & (placed["__sha"] == texts["__sha"])
    return placed.join(texts, same).select(*rows.columns, "text")


_CONTEXT = "key long, context long, size int, n long, left binary, right binary"


def _contexts(classes: DataFrame, filed: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes around the first member of each class (key, context, n, row, place): a row of ``_CONTEXT`` each."""
    by_row = classes.groupBy("row").agg(F.collect_list(F.struct("key", "context", "n", "place")).alias("own"))
    rows = _with_text(by_row, filed, docs)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        own = batch.column("own").to_pylist()
        for begin, pieces in text_batches(batch, "text"):
            out: dict[str, list] = {k: [] for k in ("key", "context", "size", "n", "left", "right")}
            for i, text in enumerate(pieces, begin):
                raw = text.encode("utf-8", "surrogatepass")
                for a in own[i]:
                    at, left, right = a["place"] >> 17, (a["place"] >> 9) & 255, a["place"] & 511
                    row = (a["key"], a["context"], REACH, a["n"], raw[at - left : at], raw[at + GRAM : at + right])
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            yield out

    return map_arrow(rows.select("text", "own"), work, _CONTEXT)


# Sorting one block of contexts


def by_words(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` symbols (or up to seven more) that start there: eight at a time, and again only where all so far are equal."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), ">u8", padded.data, strides=(1,))
    order = places[np.argsort(words[places].astype(np.uint64), kind="stable")]
    if not len(order):
        return order
    first = words[order]
    edge = np.concatenate([[True], first[1:] != first[:-1]])
    for k in range(8, depth, 8):
        # equal to the one before or behind
        open_ = np.flatnonzero(~edge | ~np.append(edge[1:], True))
        if not len(open_):
            break
        own = order[open_]
        word, group = words[np.minimum(own + k, len(text))].astype(np.uint64), np.cumsum(edge[open_])
        by = np.lexsort((word, group))
        order[open_], word = own[by], word[by]
        edge[open_[1:]] |= word[1:] != word[:-1]
    return order


def suffix_order(text: np.ndarray, first: np.ndarray, gram: np.ndarray, depth: int) -> np.ndarray:
    """The positions first[i] to gram[i] of every context i, in the order of their suffixes (to ``depth`` symbols at least).

    Stage one sorts the suffixes that are smaller than their successor, each
    gram's among them. Stage two scans the buckets of first symbols upwards: what
    stands before a scanned suffix, if larger, is the next of its own bucket.
    """
    n = len(text)
    change = np.ones(n, np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    decided = np.where(change != 0, np.arange(n), n - 1)
    smaller = change[np.minimum.accumulate(decided[::-1])[::-1]] > 0  # equal symbols: as their successor
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, first, 1)
    np.add.at(mark, gram + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    direct = by_words(text, np.flatnonzero(inside & smaller), depth)
    larger = inside & ~smaller
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for symbol in range(256):
        head = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, np.int64)
        parts = [head]
        while len(head):  # runs of one symbol are induced within their bucket
            before = head - 1
            head = before[(before >= 0) & larger[before] & (text[before] == symbol)]
            parts.append(head)
        parts.append(direct[bounds[symbol] : bounds[symbol + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[(before >= 0) & larger[before]]
        before = before[text[before] > symbol]
        if len(before):
            own = text[before]
            before = before[np.argsort(own, kind="stable")]
            symbols, start = np.unique(text[before], return_index=True)
            for s, piece in zip(symbols.tolist(), np.split(before, start[1:]), strict=True):
                waiting[s].append(piece)
    return np.concatenate(out)


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int, before: np.ndarray | None = None) -> np.ndarray:
    """Whether each neighbour pair of ``order`` has ``depth`` symbols in common, word by word; pairs that differ in ``before`` (where their gram stands) have not."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), np.uint64, padded.data, strides=(1,))
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a)) if before is None else np.flatnonzero(before[1:] == before[:-1])
    for k in [*range(0, depth - 7, 8), depth - 8] if depth >= 8 else []:
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
    for k in range(depth) if depth < 8 else []:
        alive = alive[text[a[alive] + k] == text[b[alive] + k]]
    same = np.zeros(len(a), bool)
    same[alive] = True
    return same


def repeats(keys: np.ndarray, counts: np.ndarray, lefts: list[bytes], rights: list[bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(context, least, most): strings that start least to most symbols before the gram hold all that occur more than once under the context's key."""
    depth = size + 1
    left, right = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    length = left + right + 2
    first = np.cumsum(length) - length
    gram = first + left
    raw = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, y in zip(lefts, rights, strict=True)), np.uint8)
    text = raw + np.uint8(1)
    text[gram], text[first + length - 1] = _GRAM_SYMBOL, _END_SYMBOL
    order = suffix_order(text, first, gram, depth)
    owner = np.searchsorted(first, order, "right") - 1
    before = gram[owner] - order
    whole = size - before <= right[owner]
    order, owner, before = order[whole], owner[whole], before[whole]
    same = common_prefix(text, order, depth, before)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    _, key = np.unique(keys, return_inverse=True)
    _, of = np.unique(run * (len(keys) + 1) + key[owner], return_inverse=True)
    again = np.bincount(of, weights=np.minimum(counts, 2)[owner])[of] > 1 if len(of) else np.zeros(0, bool)
    owner, before = owner[again], before[again]
    least, most = np.full(len(keys), depth), np.full(len(keys), -1)
    np.minimum.at(least, owner, before)
    np.maximum.at(most, owner, before)
    for i in np.flatnonzero(most >= 0).tolist():
        yield i, int(least[i]), int(most[i])


_SPAN = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _found(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(key, context, begin, end) of whole groups, rows (size, key, context, n, left, right) in order."""
    keys, counts = (np.array([x[k] for x in rows], np.int64) for k in (1, 3))
    for i, least, most in repeats(keys, counts, [x[4] for x in rows], [x[5] for x in rows], rows[0][0]):
        yield rows[i][1], rows[i][2], -most, LENGTH - least


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """(key, context, begin, end), from the start of the gram, of what the suffix arrays of small groups find; at most one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, and the last one as far as it has come

        def flush() -> pa.RecordBatch:
            found = list(_found(held))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], schema=_SPAN)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("size", "key", "context", "n", "left", "right")), strict=True):
                if held and row[:2] != held[-1][:2] and (len(held) >= BLOCK or row[0] != held[-1][0]):
                    yield flush()
                    held.clear()
                held.append(row)
        if held:
            yield flush()

    rows = contexts.select("size", "key", "context", "n", "left", "right").repartition("key").sortWithinPartitions("size", "key")
    return rows.mapInArrow(run, "key long, context long, begin long, end long")


_HALF = "key long, context long, of_key long, of_context long, shift long, size int, n long, left binary, right binary"


def _halves(contexts: DataFrame) -> DataFrame:
    """Each context twice, filed under the longer grams that the first and the second half of its strings have in common."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("key", "context", "of_key", "of_context", "shift", "size", "n", "left", "right")}
        for key, context, size, n, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "size", "n", "left", "right")), strict=True):
            low = size // 2
            cut, more = size - low, low + 1
            halves = []
            if len(right) >= cut:
                halves.append((b"r" + right[:cut], 0, low, left[max(0, len(left) - low) :], right[cut:size]))
            if len(left) >= more:
                halves.append((b"l" + left[len(left) - more :], -more, size - more, left[: len(left) - more], right[: size - more]))
            for gained, shift, width, own_left, own_right in halves:
                new = xxhash.xxh3_128_intdigest(gained, seed=key & ((1 << 64) - 1))
                whole = xxhash.xxh3_64_intdigest(own_left + b"\xff" + own_right, seed=new >> 64)
                row = ((new & ((1 << 64) - 1)) - (1 << 63), whole - (1 << 63), key, context, shift, width, n, own_left, own_right)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        yield out

    return map_arrow(contexts, work, _HALF)


_SPANS = "array<struct<begin:bigint,end:bigint>>"


def _shifted(spans: str, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["begin"] + by).alias("begin"), (s["end"] + by).alias("end")))


def _joined(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    none = F.array().cast(_SPANS)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["begin"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def _spans_of_classes(rows: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """(key, context, spans), a row a class, of the classes ``rows`` (``_CONTEXT``): small groups are sorted, large ones cut in halves first."""
    sizes = scratch.table(rows.groupBy("key").agg(F.count("*").alias("classes")).where(F.col("classes") > group).select("key"), "large")
    found = _sorted_spans(join_by_size(rows, sizes, ["key"], "left_anti"))
    spans = scratch.table(found.select("key", "context", F.array(F.struct("begin", "end")).alias("spans")), "sorted")
    if not sizes.limit(1).count():
        return spans
    halves = scratch.table(_halves(join_by_size(rows, sizes, ["key"], "left_semi")), "halves")
    twice = scratch.table(halves.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "twice")
    again = join_by_size(halves, twice, ["key"], "left_semi")
    cut = again.groupBy("key", "context").agg(F.min("size").alias("size"), F.sum("n").alias("n"), F.min("left").alias("left"), F.min("right").alias("right"))
    inner = _spans_of_classes(scratch.table(cut, "cut"), scratch, group)
    of = join_by_size(halves.select("key", "context", "of_key", "of_context", "shift"), inner, ["key", "context"])
    of = of.select(F.col("of_key").alias("key"), F.col("of_context").alias("context"), _shifted("spans", F.col("shift")).alias("spans"))
    outer = of.groupBy("key", "context").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumn("spans", _joined(F.col("spans")))
    return spans.unionByName(scratch.table(outer, "outer"))


def repeated_spans(filed: DataFrame, docs: DataFrame, scratch: Scratch, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(row, spans) that cover exactly the bytes to remove, a row an anchor, and (row, n_passages): a row's winnowed grams that occur elsewhere."""
    grams = filed.select("row", F.explode("grams").alias("key"))
    twice = scratch.table(grams.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    passages = join_by_size(grams, twice, ["key"], "left_semi").groupBy("row").agg(F.count("*").alias("n_passages"))
    each = filed.select("row", F.explode("anchors").alias("a")).select("a.key", "a.context", "row", "a.place")
    again = scratch.table(join_by_size(each, twice, ["key"], "left_semi"), "anchors")
    grouped = again.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("first"))
    classes = scratch.table(grouped.select("key", "context", "n", "first.row", "first.place"), "classes")
    rows = scratch.table(_contexts(classes, filed, docs), "contexts")
    spans = _spans_of_classes(rows, scratch, group)
    return join_by_size(again, spans, ["key", "context"]).select("row", _shifted("spans", F.shiftright("place", 17)).alias("spans")), passages


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["begin"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep_text: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages of each row; with ``keep_text`` also kept, the remaining bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "suffix")
    filed = _filed(texts, scratch)
    spans, passages = repeated_spans(filed, texts, scratch, group)
    by_row = scratch.table(spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "by-row")
    counted = scratch.table(passages, "passages")
    schema = "row long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        own = batch.column("spans").to_pylist()
        for begin, pieces in text_batches(batch, "text"):
            removed, count, kept = [], [], []
            for text, spans_ in zip(pieces, own[begin : begin + len(pieces)], strict=True):
                raw, at, out = text.encode("utf-8", "surrogatepass"), 0, []
                merged = _merged(spans_)
                for a, b in merged:
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join(out) + raw[at:])
                removed.append(len(raw) - len(kept[-1]))
                count.append(len(merged))
            got = {"row": batch.column("row").slice(begin, len(pieces)), "n_removed": removed, "n_spans": count, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
            yield got | ({"kept": kept} if keep_text else {})

    done = scratch.table(map_arrow(_with_text(by_row, filed, texts).select("row", "text", "spans"), work, schema), "done")
    scratch.drop("twice", "anchors", "classes", "contexts", "large", "sorted", "halves", "cut", "outer", "by-row")
    own = filed.select("row", "doc_id", "n_bytes", "sha256")
    if keep_text:
        own = _with_text(own, filed, texts).withColumn("raw", F.coalesce("text", F.lit("")).cast("binary"))
    out = own.join(done, "row", "left").join(counted, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    columns = ["doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), zero("n_passages")]
    return out.select(*columns, *([F.coalesce("kept", "raw").alias("kept")] if keep_text else []))
