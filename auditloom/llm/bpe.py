"""BPE encoding and decoding by speculation: greedy longest match proposes, pair checks verify, exact merging repairs.

A word is cut into the longest tokens from the left. That cut is the BPE
encoding exactly if every two neighbours are compatible: merging their bytes
from scratch gives the same two tokens. All distinct neighbour pairs of a batch
are checked at once by walking the merges back in time with numpy. Only words
with a pair that fails are merged exactly. Words are remembered within a
partition, up to a bound.

The tokenizer file is of the kind with word ends: NFC, lower case, words by a
pattern, one token vocabulary of byte symbols. Special tokens in a text are
single tokens.

Nulls: a null text is empty and has no tokens. An empty table gives an empty
result; repeated rows give equal values; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_batches

#: Words that a worker remembers within a partition, at most.
CACHE_WORDS = 300_000
#: Words of more bytes than this are merged with a heap.
LONG_WORD = 40
_NEVER = np.int64(1) << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b], spare = chr(spare), spare + 1
    return [symbols[b] for b in range(256)]


#: Texts of only Latin-1 characters need no Unicode tables: white space, letters (after lower-casing) and numbers of that range.
_LATIN_SPACE, _LATIN_LETTER, _LATIN_NUMBER = r"\t-\r \x85\xa0", "a-zª\xb5º\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_LETTER}]+|[{_LATIN_NUMBER}]|[^{_LATIN_SPACE}{_LATIN_LETTER}{_LATIN_NUMBER}]+")


class Bpe:
    """One tokenizer file's vocabulary, merges and word cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.inner_base = [vocab[c] for c in symbols]
        self.final_base = [vocab[c + self.end] for c in symbols]
        n = len(self.tokens)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.steps: dict[int, int] = {}  # pair a * n + b: rank * n + the token it makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.steps[a * n + b] = rank * n + made
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        codes = np.array(list(self.steps), np.int64)
        order = np.argsort(codes)
        self.pair_code, self.pair_rank = codes[order], np.arange(len(codes), dtype=np.int64)[order]
        self.pair_step = np.array(list(self.steps.values()), np.int64)[order]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            last = bool(self.end) and token.endswith(self.end)
            raw = bytes(self.byte_of[c] for c in (token[: -len(self.end)] if last else token))
            (self.final if last else self.inner)[raw] = i
        lengths: dict[bytes, set[int]] = {}
        for raw in (*self.inner, *self.final):
            for head in {raw[:3], raw[:2], raw[:1]}:
                lengths.setdefault(head, set()).add(len(raw))
        for head, own in lengths.items():
            for k in range(1, len(head)):
                own |= {x for x in lengths.get(head[:k], ()) if x <= k}
        self.lengths = {head: sorted(own, reverse=True) for head, own in lengths.items()}
        self.cache: dict[str, bytes] = {}

    # words of a text

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, as text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(self.byte_of[c] for c in piece).decode("utf-8") for piece, _ in pieces]
        return _LATIN_WORD.findall(text.lower())

    # propose, verify, repair

    def propose(self, word: bytes) -> list[int]:
        """Longest tokens from the left; the last one carries the word end."""
        out, at, n = [], 0, len(word)
        inner, final, lengths = self.inner.get, self.final.get, self.lengths.get
        while at < n:
            own = lengths(word[at : at + 3]) or lengths(word[at : at + 2]) or (1,)
            for size in own:
                to = at + size
                if to < n:
                    found = inner(word[at:to])
                elif to == n:
                    found = final(word[at:])
                else:
                    continue
                if found is not None:
                    break
            out.append(found)
            at = to
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b together gives a and b again, for many pairs at once.

        The two tokens' merges are undone, the later one first (on a tie the
        right token's, which was made last). A pair that faces each other across
        the border must not have a merge of its own while it does: before the
        inner merge that ends it. Of one rank the leftmost merge goes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        until = np.full(len(a), _NEVER)  # twice the rank that ends the pair, plus one if a merge of that very rank comes before
        live = np.arange(len(a))
        n = len(self.tokens)
        while len(live):
            x, y = a[live], b[live]
            code = x * n + y
            at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
            merged = np.where(self.pair_code[at] == code, 2 * self.pair_rank[at], _NEVER)
            clash = merged < until[live]
            good[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & (np.maximum(rx, ry) >= 0)
            undo_left = go & (rx > ry)
            undo_right = go & ~undo_left
            i, j = live[undo_left], live[undo_right]
            until[i], a[i] = 2 * rx[undo_left], self.right[x[undo_left]]
            until[j], b[j] = 2 * ry[undo_right] + 1, self.left[y[undo_right]]
            live = live[go]
        return good

    def _pair_steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank * n + made of each pair's merge, or a number above all."""
        code = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where((self.pair_code[at] == code) & (a >= 0) & (b >= 0), self.pair_step[at], _NEVER)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words, one merge of each at a time: the lowest rank first, the leftmost of one rank first."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self._merge_long([self.inner_base[c] for c in w[:-1]] + [self.final_base[w[-1]]]), np.int64)
            else:
                by_size.setdefault(len(w), []).append(i)
        n = len(self.tokens)
        inner, final = np.array(self.inner_base, np.int64), np.array(self.final_base, np.int64)
        for size, at in by_size.items():
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, size)
            ids = np.concatenate([inner[raw[:, :-1]], final[raw[:, -1:]], np.full((len(at), 1), -1)], axis=1)
            steps = np.concatenate([self._pair_steps(ids[:, :-1], ids[:, 1:])], axis=1)
            live, column = np.arange(len(at)), np.arange(size)[None, :]
            while len(live):
                own = steps[live]
                k = own.argmin(axis=1)
                best = own[np.arange(len(live)), k]
                go = best < _NEVER
                live, k, best, own = live[go], k[go], best[go], own[go]
                if not len(live):
                    break
                shift = np.minimum(column + (column > k[:, None]), size)  # the column that each one takes over
                row = np.arange(len(live))
                kept = np.take_along_axis(ids[live], shift, axis=1)
                kept[row, k] = best % n
                ids[live, :size], ids[live, size] = kept, -1
                own = np.concatenate([own, np.full((len(live), 1), _NEVER)], axis=1)
                own = np.take_along_axis(own, shift, axis=1)
                own[row, k] = self._pair_steps(kept[row, k], ids[live, k + 1])
                left = np.flatnonzero(k > 0)
                own[left, k[left] - 1] = self._pair_steps(kept[left, k[left] - 1], kept[left, k[left]])
                steps[live] = own
            for i, row_ids, count in zip(at, ids, (ids >= 0).sum(axis=1), strict=True):
                out[i] = row_ids[:count]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, in n log n steps."""
        n, get, size = len(self.tokens), self.steps.get, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(step, i, a * n + b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (step := get(a * n + b)) is not None]
        heapq.heapify(heap)
        while heap:
            step, i, code = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= size or ids[i] * n + ids[j] != code:
                continue
            ids[i], ids[j], after[i] = step % n, -1, after[j]
            if after[i] < size:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < size and (found := get(ids[p] * n + ids[q])) is not None:
                    heapq.heappush(heap, (found, p, ids[p] * n + ids[q]))
        return [x for x in ids if x >= 0]

    def learn(self, words: Iterable[str]) -> tuple[int, int]:
        """Encode words that the cache lacks; (words, words that needed exact merging)."""
        todo = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        cuts = [self.propose(raw) for _, raw in todo]
        sizes = np.array([len(c) for c in cuts], np.int64)
        flat = np.array([t for c in cuts for t in c], np.int64)
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
        a, b = flat[:-1][inside], flat[1:][inside]
        code, back = np.unique(a * len(self.tokens) + b, return_inverse=True)
        good = self.compatible(code // len(self.tokens), code % len(self.tokens))
        bad = np.unique(owner[1:][inside][~good[back]]) if len(code) else np.zeros(0, np.int64)
        if len(self.cache) + len(todo) > CACHE_WORDS:
            self.cache.clear()
        blob, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.cache.update(zip((w for w, _ in todo), (blob[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        for i, ids in zip(bad, self.merge_many([todo[i][1] for i in bad]), strict=True):
            self.cache[todo[i][0]] = ids.astype("<u4").tobytes()
        return len(todo), len(bad)

    # texts

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split: list[list] = []
        for text in texts:
            if self.special_pattern and "<|" in text:
                parts = self.special_pattern.split(text)
                split.append([x if k % 2 else self.words(x) for k, x in enumerate(parts)])
            else:
                split.append([self.words(text)])
        out, missed = self._joined(split)
        if missed:
            if len(self.cache) + len(missed) > CACHE_WORDS:  # the rest of this batch's words must stay
                self.cache.clear()
                missed = set().union(*(x for parts in split for x in parts if isinstance(x, list)))
            self.learn(missed)
            out, _ = self._joined(split)
        return out

    def _joined(self, split: list[list]) -> tuple[list[bytes], set[str]]:
        """The ids of split texts, and the words that the cache lacks."""
        out, missed, get = [], set(), self.cache.__getitem__
        for parts in split:
            try:
                out.append(b"".join([b"".join(map(get, x)) if isinstance(x, list) else self.special[x].to_bytes(4, "little") for x in parts]))
            except KeyError:
                missed.update(w for x in parts if isinstance(x, list) for w in x if w not in self.cache)
        return out, missed

    def decode(self, ids: bytes) -> str:
        """Ids back to text: with no decoder in the file, the tokens as they stand, spaces between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array) and decoded of each text."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = load(path)
        for at, texts in text_batches(batch, "text"):
            ids = bpe.encode_batch(texts)
            decoded = [bpe.decode(x) for x in ids]
            out = {
                "doc_id": batch.column("doc_id").slice(at, len(texts)),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded],
            }
            if keep_ids:
                out |= {"ids": [np.frombuffer(x, "<i4") for x in ids], "decoded": decoded}
            yield out

    # workers outlive their tasks: the words of a partition go with it
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema, lambda: load(path).cache.clear())
