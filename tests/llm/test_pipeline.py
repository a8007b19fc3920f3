"""The pipeline's stages against plain Python, on tables with planted cases, and that the entry file finds all queries."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stardeck.llm import common, packing, quality_rules, queries, simhash, toxicity

from .conftest import COLUMNS, odd_rows
from .test_documents import PACKER, deduped, fingerprint, plain_score, rates, statistics


def planted():
    """Good documents, bad ones, toxic ones, shared lines, near copies, ids that are null or repeated; some with labels."""
    rnd = random.Random(11)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta") for b in ("ba", "do", "fi", "ge", "shu", "pon", "ter")]
    prose = lambda n=90: " ".join(rnd.choices(vocabulary, k=n))
    rows, marks = [], []
    for i in range(300):
        text = prose(rnd.randrange(60, 130)) + f"\nthe closing line of number {i}"
        bad, toxic = i % 6 == 0, i % 6 == 1
        if bad:
            text = " ".join(w + ("###" if k % 2 else "") for k, w in enumerate(text.split(" ")))
        if toxic:
            words = text.split(" ")
            for k in range(5, 50, 12):
                words[k] = rnd.choice(["zorp", "zorpish", "idiot"])
            text = " ".join(words)
        if i % 5 == 2:
            text += "\nA line that every fifth of them shares " + ("." if i % 2 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        marks.append((i, int(not bad), int(toxic)))
    # the same words in other lines: no line is shared, but the fingerprints are
    broken = lambda t, k: " \n".join(t.replace("\n", " ").split(" ", k))
    rows += [(400, broken(rows[5][1], 3), "en", "s", 1), (401, broken(rows[3][1], 5), "de", "s", 2), (402, broken(rows[4][1].upper(), 8), None, None, None)]
    rows += [rows[8], rows[8], (9, prose(), "en", "again", 3), (10, "too short", "en", "again", 4), (6, prose(), "en", "again", 5)]
    rows += [(None, "too short, too", "en", "s", 6), (None, prose() + " zorp zorp idiot zorpish you zorp", "en", "s", 7), (None, prose(), "en", "s", 8), (None, rows[14][1], "en", "s", 9), (None, None, None, None, None)]
    return rows, marks


def test_stages_against_plain_python(spark, tmp_path):
    rows, marks = planted()
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = ", ".join(COLUMNS.split(", ")[:5])
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda r: spark.createDataFrame(r, schema).repartition(3)
    same = lambda name, r, want: Counter(map(tuple, stages[name](spark, frame(r), str(tmp_path)).collect())) == Counter(want)

    rules = quality_rules.learn(quality_rules.text_statistics(frame(rows)), labels).rules
    rejected = lambda t: any(all((rates(t)[c.rate] > c.at) == c.above for c in rule) for rule in rules)
    failed = lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0]
    good = [r for r in rows if not failed(statistics(r[1])) and not rejected(r[1])]
    assert same("quality_rules", rows, good)
    assert {r[0] for r in good if r[0] is not None and r[0] < 300} == {i for i in range(300) if i % 6} | {6} and sum(r[0] is None for r in good) == 3

    lexicon = toxicity.learn(frame(good), labels, common.bucket_of_id("doc_id", 5) != 0)
    clean = [r for r in good if plain_score(r[1], lexicon) < 0.5]
    assert same("toxicity", good, clean)
    assert {r[0] for r in good} - {r[0] for r in clean} == {i for i in range(300) if i % 6 == 1} and sum(r[0] is None for r in clean) == 2

    kept = [(i, t, r[2], r[3], len(t)) for r, (i, t, *_) in zip(clean, deduped(clean), strict=True)]
    assert same("line_dedup", clean, kept)
    assert sum("every fifth" in r[1] for r in kept) == 2  # with a full stop and without

    label = list(range(len(kept)))
    prints = [fingerprint(r[1]) for r in kept]
    for a, x in enumerate(prints):
        for b, y in enumerate(prints[:a]):
            if (x ^ y).bit_count() <= 2:
                label = [label[b] if k == label[a] else k for k in label]
    groups = {}
    for k, r in zip(label, kept, strict=True):
        groups.setdefault(k, []).append(r)
    place = lambda r: (r[0] is None, r[0] or 0)
    got = stages["simhash_near_dedup"](spark, frame(kept), str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(min(g, key=place)[0] for g in groups.values())
    assert set(map(tuple, got)) <= set(kept)
    assert not {400, 401, 402} & {r["doc_id"] for r in got} and [r["doc_id"] for r in got].count(8) == 1

    ids = packing.word_ids(PACKER)
    want = Counter((r["doc_id"], sum(len(ids[w]) // 4 for w in r["text"].encode().split()) + 1) for r in got)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0) == want
    assert sum(r["length"] for r in packed) == sum(n * c for (_, n), c in want.items())


def test_stages_over_odd_rows(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    ids = {r[0] for r in odd_rows()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert {r["doc_id"] for r in docs.collect()} <= ids
    assert docs.count() > 0


@pytest.mark.parametrize("extra", ["", ", toxic int, half int, fp long, h1 long, row int, w string"])
def test_stages_over_nothing(spark, no_labels, tmp_path, extra):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], COLUMNS.replace(", fp string", "") + extra)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def to_and_from_python(df):
    """Bytes that the plan of df sends to Python's workers, and that it has back."""
    execution, sums = df._jdf.queryExecution(), [0, 0]
    df._jdf.collectToPython()
    todo = [execution.executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        for k, name in enumerate(("pythonDataSent", "pythonDataReceived")):
            if node.metrics().contains(name):
                sums[k] += node.metrics().apply(name).value()
    return sums


def test_texts_go_to_python_once_and_stay_there(spark, tmp_path, monkeypatch):
    """What stages carry along isn't held by Python's workers nor in Arrow's buffers besides."""
    rows = [(i, f"{i} ka lo mi " * 500, "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(COLUMNS.split(", ")[:5]))
    size = sum(len(r[1]) for r in rows)
    found = [toxicity.score(docs, toxicity.Lexicon({"zorp": 2.0}), common.bucket_of_id("doc_id", 5) == 0, corpus_pipeline.CARRIED)]
    monkeypatch.setattr(simhash, "written", lambda df, name: found.append(df) or common.written(df, name))
    assert simhash.first_of_each(docs).columns == corpus_pipeline.COLUMNS
    for df in found[:2]:
        assert "text" in df.columns or "_1" in df.columns
        sent, back = to_and_from_python(df)
        assert size <= sent < 1.5 * size and 0 < back < size / 4


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
