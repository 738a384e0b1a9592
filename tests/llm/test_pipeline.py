"""The pipeline's stages, each judged on its own input, against brute force."""

import re

import corpus_pipeline as pipeline
from conftest import frame
from test_operators import brute_pii, brute_targets, rows_of

from auditloom.llm import bpe, minhash, quality
from auditloom.llm.common import materialize

SF = "/root/testdata/sf0.01"


def components(docs):
    sets = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders, both = {}, {}
    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for e in holders.get(s, ()):
                shared[e] = shared.get(e, 0) + 1
            holders.setdefault(s, []).append(d)
        for e, k in shared.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                both[d, e] = k
    for d, e in both:
        a, b = root(d), root(e)
        parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicates", "personal data", "source weights", "tokens"]
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        kept.append({})
        for r in rows_of(docs):
            kept[-1].setdefault(r["doc_id"], []).append(r)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in rows_of(source)}
    model = quality.fit(source, labels)
    assert set(kept[0]) == {r["doc_id"] for r in rows_of(quality.score(source, model)) if r["score"] >= 0.3}
    good = {r["doc_id"] for r in rows_of(labels) if r["quality"] == 1}
    assert len(good & set(kept[0])) > 0.98 * len(good)
    own = components([x[0] for x in kept[0].values()])
    assert set(kept[1]) == {d for d in own if own[d] == d}
    for d, (r,) in kept[2].items():
        old = before[d]["text"]
        assert brute_pii(r["text"]) == "" or brute_pii(old) != ""
        assert (r["text"] == old) == (r["n_chars"] == before[d]["n_chars"]) or len(r["text"]) == r["n_chars"]
        if not brute_pii(old) and "<FOUND>" not in r["text"]:
            assert r["text"] == old
        for kind in ("email", "ip", "card", "phone"):
            assert r["text"].count(f"<{kind.upper()}>") <= brute_pii(old).count(kind + ":")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    totals = {}
    for (r,) in kept[2].values():
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
    goal = brute_targets(totals)
    taken = {}
    for rows in kept[3].values():
        assert len(rows) <= 3
        for r in rows:
            taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    longest = max(size(r["text"]) for (r,) in kept[2].values())
    assert all(abs(taken.get(s, 0) - g) <= longest / 2 + 1 for s, g in goal.items())
    last = rows_of(pipeline.STAGES[-1][1](spark, docs, SF))
    assert sorted(r["doc_id"] for r in last) == sorted(d for d, rows in kept[3].items() for _ in rows)
    b = bpe.load(bpe.default_path())
    for r in last[::50]:
        assert b.encode_batch([kept[3][r["doc_id"]][0]["text"]])[0] == b"".join(int(i).to_bytes(4, "little") for i in r["ids"])


def test_repeated_rows_and_rows_without_id(spark):
    base = " ".join(f"word{i}" for i in range(50))
    docs = frame(spark, [(1, base, "a"), (1, base, "a"), (2, base, "b"), (None, base, "c"), (None, None, None), (3, None, "a")])
    got = sorted(str(r["doc_id"]) for r in rows_of(pipeline.drop_near_duplicates(spark, docs, SF)))
    assert got == ["1", "3", "None"]
    assert minhash.near_duplicates(docs).count() == 6


def test_stages_on_odd_rows_and_empty_tables(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows, clashing column names: every stage keeps the columns and drops only what it says."""
    for name, stage in pipeline.STAGES:
        nothing = stage(spark, empty, SF)
        assert nothing.count() == 0, name
        out = stage(spark, odd, SF)
        rows = rows_of(out)
        if name == "tokens":
            assert len(rows) == odd.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
            assert [r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)] == [0, 0]
            continue
        assert out.columns == odd.columns, name
        assert all(r["component_id"] == r["size"] == r["key"] == r["hash"] == r["spans"] == "x" and r["copies"] == 1 for r in rows), name
        if name == "near-duplicates":
            assert sorted(str(r["doc_id"]) for r in rows) == ["1", "10", "11", "12", "4", "5", "6", "8", "None"]
        if name == "personal data":
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert len(rows) == odd.count() and texts[11].startswith("Mail <EMAIL>") and texts[5] is None
    assert pipeline.run.__doc__


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_survive(spark):
    names = {"__number": 5, "__mark": 6, "__id": 7, "__key": 8, "__spans": 9}
    text = "Mail me@x.org now, said the clerk to nobody"
    docs = spark.createDataFrame([(1, text, "a", len(text), *names.values())], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
    for stage in (pipeline.drop_near_duplicates, pipeline.mask_personal_data, pipeline.mix_sources):
        (row,) = stage(spark, docs, SF).distinct().collect()
        assert stage(spark, docs, SF).columns == docs.columns and {c: row[c] for c in names} == names
