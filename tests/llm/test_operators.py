"""Each operator against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import BASE, LONG

from auditloom.llm import ann, bpe, chat, media, minhash, mixing, pii, quality, secrets, suffix

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 1


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = rows_of(minhash.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and by[1]["kept"] and not by[2]["kept"]
    assert by[6]["component_id"] == by[7]["component_id"] == 6
    assert by[8]["component_id"] == by[9]["component_id"] == 8 and by[8]["n_shingles"] == 1
    assert by[4]["component_id"] == 4 and by[4]["n_shingles"] == 0 and by[10]["kept"]
    assert all(r["component_id"] is None and not r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_min_max_signature_estimates_similarity():
    rng = np.random.RandomState(5)
    pool = rng.randint(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    a, b = pool[:1000], pool[200:1200]  # 800 of 1200 shared
    values = minhash.signature([a, b], 400)
    assert abs((values[0] == values[1]).mean() - 800 / 1200) < 0.06


def test_many_unlike_copies_of_one_text(spark):
    """A group whose members are far from each other but near to one text: links by rare shingles are found, others pruned."""
    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words), "a")]
    for i in range(1, 60):
        own = list(words)
        for k in random.sample(range(200), 4 if i % 2 else 9):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own), "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(df))}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in sets}


def test_texts_of_one_template_meet_in_no_pair(spark, monkeypatch):
    """20,000 texts that differ in one word of 28 share most shingles and are no links: few pairs are looked at, and real links among them are found."""
    words = [f"t{i}" for i in range(28)]
    rows = [(i, " ".join([*words[:14], f"u{i}", *words[15:]])) for i in range(20000)]
    rows += [(30000, rows[5][1] + " tail"), (30001, rows[7][1].replace("t27", "end")), (30002, " ".join([*words[:27], "x"])), (30003, " ".join([*words[:27], "y"]))]
    looked, confirm = [], minhash.confirm

    def counted(pairs, *more):
        looked.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(minhash, "confirm", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(df))}
    assert got[30000] == 5 and got[30001] == 7 and got[30003] == 30002
    assert all(got[i] == i for i in range(20000))
    assert sum(looked) < 200_000


# 2


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rows_of(secrets.scan_secrets(docs, "source", "doc_id")):
        assert r["base"] == brute_secrets(texts[r["doc_id"]])
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    assert secrets.scan_secrets(odd, "source", "doc_id").count() == odd.count()
    assert secrets.scan_secrets(empty, "source", "doc_id").count() == 0


def test_ownership_separates_copied_from_own_values(spark):
    live, copied = "q7Rk2mZx9Lw4Tn8Vb3Yc", "Zx81kQm27Wv93Lp46Tn0"
    rows = [(i, f"see {copied} here", "en", f"owner{i}") for i in range(5)] + [(9, f"mine {live} é", "en", "owner9")]
    got = {r["doc_id"]: r for r in rows_of(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "source", "lang"))}
    assert got[9]["spans"] == f"owned:5:{5 + len(live)}" and got[9]["n_live"] == 1
    assert all(got[i]["spans"] == "" for i in range(5))


def test_both_counts_decide(spark):
    """All counts of planted values against brute force: one owner with many repositories is copied, one with few is live."""
    random.seed(12)
    value = lambda: "".join(random.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24)) + "a1"
    values = [value() for _ in range(40)]
    rows, held = [], {}
    for i in range(400):
        own, owner, repository = random.sample(values, 2) + ["plain"], f"o{random.randrange(3) if i % 2 else 0}", random.choice([None, *(f"r{k}" for k in range(14))])
        own = own if i % 3 else [values[0], "text"] if i % 2 else [f"{i}", "nothing"]
        rows.append((i, " and ".join(own), owner, repository, "x", "y"))
        for v in own:
            if v in values:
                held.setdefault(v, set()).add((owner, repository))
    rows += [(1000 + i, f"here {value()} once", "solo", "r", "x", "y") for i in range(5)] + [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string, value string, owner string")
    live = {v for v, places in held.items() if len({o for o, _ in places}) <= secrets.MAX_OWNERS and len(places) <= secrets.MAX_REPOSITORIES}
    for r in rows_of(secrets.scan_secrets(df, "source", "repo")):
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        want = [f"owned:{m.start()}:{m.end()}" for m in secrets.TOKEN.finditer(text) if (m[0] in live or (r["doc_id"] >= 1000 and m[0] not in held)) and secrets.looks_random(m[0])]
        assert r["spans"] == ",".join(want), text


# 3


def brute_pii(text):
    text, out = text or "", []
    out += [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(out)


def test_pii_against_brute_force(spark, odd, empty):
    random.seed(4)
    tricky = ["".join(random.choice("ab1.@-+% 234()5.") for _ in range(200)) for _ in range(400)]
    for text in tricky:
        assert pii.joined(pii.base_spans(text)) == brute_pii(text), text
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rows_of(pii.find_pii(docs)):
        assert r["base"] == brute_pii(texts[r["doc_id"]])
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(empty).count() == 0
    clean = {r["doc_id"]: r for r in rows_of(pii.redact(odd)) if r["doc_id"]}
    assert clean[11]["text"] == "Mail <EMAIL> or token = abcdefgh12" and clean[11]["component_id"] == "x" and clean[11]["n_chars"] == len(clean[11]["text"])
    assert clean[1]["text"] == BASE and clean[5]["text"] is None


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call number +1 555 010 {1000 + i} today", "a") for i in range(8)] + [(20, "please call number EXT-99812 today", "a"), (21, "item code EXT-99813 here", "a")]
    got = {r["doc_id"]: r["spans"] for r in rows_of(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got[20] == "found:19:28" and got[21] == ""


def test_planted_identifiers_are_found(spark):
    """Identifiers outside the base kinds, planted behind and before the words that seeds have beside them: precision and recall."""
    random.seed(8)
    number = lambda: f"{random.choice('ABCDEF')}{random.randint(10, 99)}-{random.randint(10000, 99999)}"
    rows, want = [], {}
    for i in range(300):
        kind = i % 6
        if kind < 2:
            text = f"filler {random.choice(['alpha', 'beta'])} please reach me on +1 555 010 {1000 + i} before noon today"
        elif kind == 2:
            text = f"his card ends, mail to u{i}@example.org for the account holder record"
        elif kind == 3:
            own = number()
            text = f"some words please reach me on {own} whenever"
            want[i] = (text.index(own), text.index(own) + len(own))
        elif kind == 4:
            own = number()
            text = f"see {own} for the account holder record"
            want[i] = (text.index(own), text.index(own) + len(own))
        else:
            text = f"the part number {number()} fits the pump housing {number()} of model x"
        rows.append((i, text, "a"))
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("found")] for r in rows_of(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    hits = sum(want[i] in got[i] for i in want)
    assert hits / len(want) >= 0.95, hits
    assert hits / sum(map(len, got.values())) >= 0.95


# 4


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "user", "<\\|x <|"), (1, 2, "assistant", "<|im_sep|>ok\n"), (1, 3, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "a\nb", "y"), (3, 5, "assistant", "é" * 3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS formatted", "1 AS turns")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in rows_of(chat.read_chats(made))}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a <|im_end|> b"), ("user", "<\\|x <|"), ("assistant", "<|im_sep|>ok\n"), ("assistant", "")]
    assert got[1]["loss_texts"] == ["<|im_sep|>ok\n", ""]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "x")] * 2
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("a\nb", "y")]
    raw = {r["conv_id"]: r for r in rows_of(made)}
    assert raw[1]["formatted"].count("<|im_start|>") == 2 and raw[1]["formatted"].count("<|im_sep|>") == 2
    assert all(sum(x["chars"] for x in r["loss_mask"]) == len(r["formatted"]) for r in raw.values())
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# 5


def brute_repeats(texts, length=400):
    from collections import Counter

    count = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
def test_repeats_against_brute_force(spark, group):
    random.seed(6)
    letters = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    shared = letters(700)
    texts = [letters(500) + shared[random.randrange(200) : 700 - random.randrange(150)] + letters(random.randrange(400)) for _ in range(25)]
    texts += ["ab" * 900, "ab" * 300 + "c", "\0" * 500, letters(399), "", None, shared, shared, letters(900) * 2]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").selectExpr("*", "1 AS doc", "'k' AS key")
    got = {r["doc_id"]: r for r in rows_of(suffix.remove_repeats(df, group=group))}
    for i, (gone, spans, kept) in enumerate(brute_repeats([(t or "").encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (gone, spans, kept), i


def test_two_stage_order_is_the_suffix_order():
    random.seed(9)
    for _ in range(30):
        lefts = [bytes(random.choice(b"ab") for _ in range(random.randrange(12))) for _ in range(6)]
        text, first, gram, at = [], [], [], 0
        for x in lefts:
            right = bytes(random.choice(b"ab") for _ in range(12))
            first.append(at)
            gram.append(at + len(x))
            text += [*(b + 1 for b in x), 0, *(b + 1 for b in right), 255]
            at = len(text)
        t = np.array(text, np.uint8)
        order = suffix.suffix_order(t, np.array(first), np.array(gram), 64)
        inside = [p for a, g in zip(first, gram, strict=True) for p in range(a, g + 1)]
        assert sorted(order.tolist()) == inside
        cut = [bytes(text[p : p + 13]) for p in order]
        assert cut == sorted(cut)


def test_repeats_of_odd_rows(spark, odd, empty):
    got = rows_of(suffix.remove_repeats(odd, keep_text=True))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == len(BASE) and by[3]["n_removed"] == len(BASE) and by[6]["n_removed"] == len(LONG) and by[8]["n_removed"] == 0
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(empty).count() == 0


def test_suffixes_by_words():
    rng = np.random.default_rng(1)
    for high, depth in ((3, 40), (2, 401), (250, 17)):
        text = rng.integers(1, high, 3000).astype(np.uint8)
        text[1000:1900] = text[0:900]
        places = np.sort(rng.choice(2500, 900, replace=False))
        raw = text.tobytes() + bytes(500)
        got = [raw[p : p + depth] for p in suffix.by_words(text, places, depth).tolist()]
        assert got == sorted(raw[p : p + depth] for p in places.tolist())


def test_a_gram_of_one_class_is_sorted_too(monkeypatch):
    """What a class of several members removes comes from its suffixes' neighbours; without the sort nothing is found."""
    rows = [(suffix.REACH, 5, 9, 2, b"a" * 200, b"b" * 200), (suffix.REACH, 6, 9, 1, b"c" * 200, b"d" * 200)]
    assert list(suffix._found(rows)) == [(5, 9, -200, 400)]
    monkeypatch.setattr(suffix, "suffix_order", lambda text, *_: np.zeros(0, np.int64))
    assert list(suffix._found(rows)) == []


# 6


def test_neighbours_against_brute_force(spark):
    rng = np.random.RandomState(3)
    vectors = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    vectors[100:140] = vectors[7]  # many equal vectors: ties go to the smaller id
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), (2005, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS shard", "'x' AS vector")
    got = {}
    for r in rows_of(ann.search(df, df.where("vec_id % 20 = 0"))):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([x for _, x, _ in rows[:1500]], np.float32).astype(np.float64)
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = (v * v[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        hits += len({i for _, i, _ in found} & set(order))
        assert [r for r, *_ in found] == list(range(1, 21)) and all(s == scores[i] for _, i, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1])) and all(i != q for _, i, _ in found)
    assert hits / (20 * len(got)) >= 0.9
    few = df.where("vec_id IN (0, 1, 2)")
    assert len(ann.search(few, few.where("vec_id = 0")).collect()) == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# 7


def test_quality_on_held_out_labels(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels)
    got = rows_of(quality.score(docs, model).join(labels, "doc_id").select("*", quality.held_out().alias("out")).where("out"))
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in got]) > 0.93
    assert np.mean([g >= 0.3 for g in good]) > 0.98
    scored = rows_of(quality.score(odd, model))
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.keep_good(odd, model, 0.0).count() == odd.count()
    assert quality.score(empty, model).count() == 0
    share = labels.where(~quality.held_out()).where("quality IS NOT NULL").selectExpr("(sum(quality) + 1) / (count(*) + 2)").first()[0]
    assert model.scores([""])[0] == pytest.approx(share, abs=1e-6)
    twice = labels.unionByName(labels).unionByName(labels.limit(50).selectExpr("doc_id", "0 AS quality", "toxic"))
    again = quality.fit(docs.unionByName(docs.limit(200)), twice)
    assert again.scores(["some text", ""])[0] == pytest.approx(model.scores(["some text"])[0], abs=1e-9)
    none = quality.fit(empty, labels.limit(0))
    assert {r["score"] for r in rows_of(quality.score(odd, none))} == {0.5}


# 8


def test_tokens_are_the_librarys(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    random.seed(1)
    texts = ["", "<|endoftext|> a <|STARTOFTEXT|><|startoftext|>", "Σίσυφος ΣΑΣ İstanbul ﬁ", "don't I'LL we've 12½ ²³ x\x1cy\x85z\xa0w", "日本語 テスト", "étude ABC" + "a" * 900, "\0 ​ \U0001f600!!'s", "aaaaaaabbbaaa", LONG]
    texts += ["".join(random.choice("abcdefghijklmnopqrstuvwxyz éüß'’!?0123 ñæøİΣ") for _ in range(300)) for _ in range(100)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids")
    for r in rows_of(bpe.encode(df)):
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False)
        assert r["ids"] == want.ids and r["n_tokens"] == len(want.ids)
        assert r["decoded"] == library.decode(want.ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(odd).count() == odd.count() and bpe.encode(empty).count() == 0


def test_speculation_repairs_only_what_fails():
    b = bpe.load(bpe.default_path())
    words = [x.removesuffix("</w>") for x in b.tokens[512:3000]]
    for w in words:
        raw = w.encode()
        exact = b.merge_many([raw])[0].tolist()
        assert b._merge_long([b.inner_base[c] for c in raw[:-1]] + [b.final_base[raw[-1]]]) == exact
        cut = b.propose(raw)
        a = np.array(cut[:-1], np.int64), np.array(cut[1:], np.int64)
        assert bool(b.compatible(*a).all()) == (cut == exact)


# 9


def brute_wave(codec, payload):
    """Samples one by one, from the codecs' definitions."""
    out = []
    if codec == "mulaw":
        for x in payload:
            x = ~x & 255
            size = ((x & 15) * 8 + 132) * 2 ** (x >> 4 & 7) - 132
            out.append(-size if x & 128 else size)
    elif codec == "alaw":
        for x in payload:
            x ^= 85
            high, low = x >> 4 & 7, x & 15
            size = low * 16 + 8 if high == 0 else (low * 16 + 264) * 2 ** (high - 1)
            out.append(size if x & 128 else -size)
    else:
        for at in range(0, len(payload), 576):
            block = payload[at : at + 576]
            sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            out.append(sample)
            for byte in block[4:]:
                for code in (byte & 15, byte >> 4):
                    step = int(media.STEPS[index])
                    change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                    sample = max(-32768, min(32767, sample + (-change if code & 8 else change)))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                    out.append(sample)
    return out


def brute_resample(wave):
    out = []
    for k in range(2 * len(wave)):
        a, b = wave[k // 2], wave[min(k // 2 + 1, len(wave) - 1)]
        out.append(round(a + (b - a) * (k % 2) / 2))
    return out


def brute_feature(codec, wave):
    rms = (sum(x * x for x in wave) / max(1, len(wave))) ** 0.5
    crossings = sum((a < 0) != (b < 0) for a, b in zip(wave, wave[1:], strict=False))
    return f"{codec}:{len(wave)}:{rms:.3f}:{max(map(abs, wave), default=0)}:{crossings}:{zlib.crc32(np.array(wave, '<i2').tobytes()):08x}"


def test_media_round_trip_and_codecs(spark, odd, empty):
    for r in rows_of(media.media_columns(odd.where("char_length(coalesce(text, '')) < 6000"))):
        codec, payload = media.load(bytes(r["media"]))
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and len(payload) == r["payload_bytes"] and len(payload) % 576 == 0
        assert payload[: r["n_bytes"]] + b"\xff" * (len(payload) - r["n_bytes"]) == payload and codec == media.codec_of(payload)
        assert media.load(bytes(r["pcm"]))[0] == "pcm"
        wave = brute_wave(codec, payload)
        assert r["feature"] == brute_feature(codec, brute_resample(wave)), codec
        assert np.frombuffer(media.load(bytes(r["pcm"]))[1], "<i2").tolist() == brute_resample(wave)
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert r["pcm_bytes"] == len(r["pcm"]) and r["pcm_sha256"] == hashlib.sha256(media.load(bytes(r["pcm"]))[1]).hexdigest()
    got = rows_of(media.media_columns(odd, keep_media=False))
    texts = {(r["doc_id"], r["payload_sha256"]): r["feature"] for r in got}
    assert texts[3, next(r["payload_sha256"] for r in got if r["doc_id"] == 3)] == next(r["feature"] for r in got if r["doc_id"] == 1)
    assert media.media_columns(empty).count() == 0


def test_codecs_against_their_definitions():
    table = media.TABLES["mulaw"]
    assert table[0xFF] == 0 and table[0x00] == -32124 and table[0x80] == 32124 and table[0x7F] == 0
    alaw = media.TABLES["alaw"]
    assert alaw[0xD5] == 8 and alaw[0x55] == -8 and alaw[0xAA] == 32256 and alaw[0x2A] == -32256
    rng = np.random.RandomState(1)
    blocks = rng.randint(0, 256, (5, 36)).astype(np.uint8)
    for block, wave in zip(blocks, media.decode_adpcm(blocks), strict=True):
        sample, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        want = [sample]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
                index = max(0, min(88, index + int(media.INDEX_STEP[code])))
                want.append(sample)
        assert wave.tolist() == want


# 10


def test_mix_meets_its_targets(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = (sorted(map(tuple, mixing.mixture(docs).collect())) for _ in range(2))
    assert first == again
    got = rows_of(mixing.mixture(docs))
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(x[0]["target"] for x in by.values()) - sum(r["size"] for r in got)) < 1e-6
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x) / 2 + 1
        assert x[0]["target"] <= 3 * x[0]["source_size"]
    assert len(mixing.mix(docs).collect()) == sum(r["copies"] for r in got)
    assert mixing.mixture(odd).count() == odd.count() and mixing.mixture(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).where("copies <> 1 OR hash <> 'x'").count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    of = lambda rows: {r["source"]: r["target"] for r in rows_of(mixing.targets(spark.createDataFrame(rows, "source string, size long")))}
    got = of([("a", 1000), ("b", 10), ("c", 1000), (None, 5)])
    assert got["b"] == 30.0 and got[None] == 15.0 and abs(sum(got.values()) - 2015) < 1e-9
    assert abs(got["c"] / got["a"] - 3) < 1e-9
    assert of([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0}


def brute_targets(sizes):
    """Fill by weight, fix what is full, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full, left = {}, dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: 3 * sizes[s] for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over
        left = {s: n for s, n in left.items() if s not in over}


def test_mix_of_many_sources(spark):
    """Hundreds of sources, hot ones and tiny ones, with columns named as the operator's own."""
    random.seed(5)
    rows = [(i, "w " * random.choice([0, 1, 3, 50]), random.choice(["hot"] * 200 + [f"s{k}" for k in range(300)] + [None]), 1, 2, 3, "x", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies int, __threshold int, no int, hash string, __source string")
    got = rows_of(mixing.mixture(df))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
    for s, x in by.items():
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x) / 2 + 1e-6
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == sum(r["copies"] for r in got)


def test_neighbours_with_repeated_ids_and_mixed_dimensions(spark):
    rng = np.random.RandomState(4)
    rows = [(i % 50, [float(x) for x in rng.standard_normal(8)]) for i in range(100)] + [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in rows_of(ann.search(df, df.where("vec_id IN (0, 20, 100, 120)"), k=5)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 100, 120}
    for q, found in got.items():
        assert all(i != q for _, i in found) and all((i < 50) == (q < 50) for _, i in found) and [r for r, _ in sorted(found)] == [1, 2, 3, 4, 5]


def test_passages_are_counted(spark):
    """A passage of PASSAGE bytes in two texts is always seen; texts that share less than GRAM bytes are not."""
    random.seed(13)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    texts, shared = [], []
    for i in range(60):
        passage = letters(suffix.PASSAGE if i % 2 else suffix.GRAM - 1)
        texts += [letters(random.randrange(300)) + passage + letters(random.randrange(300)) for _ in range(2)]
        shared += [bool(i % 2)] * 2
    got = {r["doc_id"]: r for r in rows_of(suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [got[i]["n_passages"] > 0 for i in range(len(texts))] == shared
    assert all(r["n_removed"] == 0 for r in got.values())


def test_texts_of_one_id_are_one_component(spark):
    other = " ".join(f"else{i}" for i in range(50))
    rows = [(3, BASE, "a"), (5, BASE, "a"), (5, other, "a"), (7, other + " more", "b"), (8, "lone text", "b")]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True)}


def test_every_link_between_short_texts(spark):
    """Sets of few shingles are paired exactly: all links of many short texts, against all pairs."""
    random.seed(11)
    texts = []
    for i in range(300):
        base = [f"t{i}w{k}" for k in range(random.randint(7, 20))]
        texts += [" ".join(base), " ".join([*base, f"end{i}"]), " ".join([*base[:-1], f"last{i}"]), " ".join([f"start{i}", *base])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")))}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for first in range(0, len(texts), 4):
        for i in range(first, first + 4):
            for j in range(first, i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in range(len(texts))}


def test_base_spans_of_odd_rows(spark, odd):
    """op2, op3, op8 and op10 on null, empty, very long and repeated texts give what brute force gives."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    for r in rows_of(secrets.scan_secrets(odd, "source", "doc_id")):
        assert r["base"] in {brute_secrets(t) for t in texts[r["doc_id"]]}
    for r in rows_of(pii.find_pii(odd)):
        assert r["base"] in {brute_pii(t) for t in texts[r["doc_id"]]}
    want = {i: {tuple(library.encode(t or "", add_special_tokens=False).ids) for t in own} for i, own in texts.items()}
    for r in rows_of(bpe.encode(odd)):
        assert tuple(r["ids"]) in want[r["doc_id"]]
    for r in rows_of(mixing.mixture(odd)):
        assert r["size"] in {len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts[r["doc_id"]]} and r["taken"] == r["copies"] * r["size"]


def test_very_long_conversation(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", f"<|im_end|>{i} " * 200) for i in range(400)]
    made = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    (got,) = rows_of(chat.read_chats(made))
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t) for _, _, r, t in turns]
    assert got["loss_texts"] == [t for _, _, r, t in turns if r == "assistant"]
