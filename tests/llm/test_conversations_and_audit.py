"""Operators 11 to 13 against plain Python."""

import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stardeck.llm import conversation_repair as C
from stardeck.llm import filter_audit as A
from stardeck.llm import language_id as L

SPACES = " \t\n\x0b\f\r"
ROWS = "conv_id long, turn long, role string, text string, doc_id string, kind string"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_repair(given, rows):
    """One dictionary a conversation, by recursion from the last row back."""
    found = {}
    for conv in {r[0] for r in given}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(SPACES)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

        @functools.cache
        def best(i, state, inserted):
            options = []
            if i == len(own) and state in (0, 3):
                options.append((0, ""))
            if inserted < 4:
                for role in "ua":
                    if (state, role) in after:
                        cost, edits = best(i, after[state, role], inserted + 1)
                        options.append((cost + 3, "I" + edits))
            if i < len(own):
                cost, edits = best(i + 1, state, 0)
                options.append((cost + 4, "D" + edits))
                if faults[i] not in ("b", "d"):
                    for edit, role, price in (("K", initials[i], 0), ("R", "u", 3), ("R", "a", 3)):
                        if (state, role) in after:
                            cost, edits = best(i + 1, after[state, role], 0)
                            options.append((cost + price + 3 * (faults[i] == "t"), edit + edits))
            return min(options, default=(10**9, ""))

        for i in range(len(own), 0, -1):  # from the end on, so that no call goes deep
            for state in range(4):
                best(i, state, 0)
        cost, audit = best(0, 0, 0)
        lines, i, role = [], 0, "user"
        for edit in audit:
            now, text = own[i][2:] if edit != "I" else ("", "")
            i += edit != "I"
            if edit != "D":
                now = now if edit == "K" else role
                role = "assistant" if now[:1] == "u" else "user"
                lines.append(f"{now}:{text}")
        turns = {r[1] for r in own if r[1] is not None}
        found[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{name: faults.count(f) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return found


def conversations():
    r = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "why", "So it goes? ", "", " \t", None, "cut short", "Jä \U0001f600.", "a:b\nc."]
    rows = []
    for conv in [*range(40), None]:
        for k in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            role = roles[k % 2] if r.random() < 0.6 else r.choice(roles)
            turn = r.choice([k, k, k, k, None, k - 1, 2 * k])
            rows.append((conv, turn, role, r.choice(texts) if r.random() < 0.7 else f"{k} words.", "x", "y"))
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}" + "." * (k % 5 != 0), "x", "y") for k in range(700)]
    rows += [(101, 3, "user", "the same.", "x", "y")] * 300
    rows += [(102, k, "other", "o.", "x", "y") for k in range(301)]
    rows += [(103, k, "tool", f"{k}.", "x", "y") for k in range(301)]
    return rows


def compare(found, want):
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.collect()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


@pytest.mark.parametrize("run", [3, C.RUN])
def test_repair_equals_recursion(spark, run):
    rows = conversations()
    given = spark.createDataFrame(rows, ROWS).repartition(5)
    compare(C.repair(C.damaged(given), run), plain_repair(rows, damage(rows)))
    compare(C.repair(given, run), plain_repair(rows, [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d, *_ in rows]))


def test_repaired_rows_are_what_the_hash_is_of(spark):
    rows = spark.createDataFrame(conversations(), ROWS)
    sums = {r["conv_id"]: r for r in C.repair(rows, 5).collect()}
    lines = {c: [] for c in sums}
    for r in sorted((r for r in C.repaired_rows(rows, 7).collect() if r["place"] is not None), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, s in sums.items():
        assert hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == s["repaired_sha256"]
        assert len(s["audit"].replace("D", "")) == len(lines[c])


def test_repair_without_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert C.repair(C.damaged(empty)).count() == 0
    dropped = spark.createDataFrame([(1, 0, "user", "a."), (None, None, None, None)], "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(0))
    for r in C.repair(dropped).collect():
        assert r.asDict() | {"conv_id": 0} == {"conv_id": 0, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_one_conversation_is_spread_over_tasks(spark):
    """Runs of a long conversation come from many tasks; signatures that begin alike share their layers."""
    rows = spark.range(4000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('line ', id, '.') text")
    order = ["conv_id", "turn", "role", "text"]
    dealt = C.marked(rows).withColumn("initial", F.substring("role", 1, 1)).repartitionByRange(4, *order).sortWithinPartitions(*order)
    runs = dealt.select("conv_id", "turn", "initial", "n", "fault").mapInArrow(C._runs(C._arrow(C.RUNS), 100), C.RUNS).toPandas()
    assert set(runs.part) == {0, 1, 2, 3} and max(runs.signature.str.len()) == 101
    row = C.repair(rows, 100).first()
    assert (row["audit"], row["cost"], row["gaps"]) == ("K" * 4000, 0, 0)


def test_trie_shares_prefixes():
    words = sorted("^" + "".join(w) for n in range(5) for w in itertools.product("suxU", repeat=n))
    trie = C.Trie()
    for w in words:
        layer = C.root(w[0])
        for letter in w[1:]:
            layer = C.step(layer, letter)
        assert trie.insert(w) == layer
    assert trie.steps == len({w[:k] for w in words for k in range(1, len(w) + 1)})


# --- filters ----------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels, orders):
    rows = []
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in t.translate({ord(c): " " for c in SPACES}).split(" ") if w]
        failing = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in t for c in "#$%&*|"), i is not None and least[t] < i]
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", {x for x, f in zip("ABCDE", failing, strict=True) if f}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for o in orders:
            for k, x in enumerate(o):
                mine = [r for r in rows if r[0] == part]
                gone = [r for r in mine if r[1] & set(o[:k])]
                now = [r for r in mine if not r[1] & set(o[:k]) and x in r[1]]
                out[part, o, k + 1] = [sum(not r[1] & set(o[: k + 1]) for r in mine), len(now), sum(x in r[1] for r in gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in now), sum(r[3] for r in now)]
                total[part, x] = total.get((part, x), 0) + len(now)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "x", "A B C", "costs 5$", " ".join(words), " ".join(words).upper(), " ".join(["a", "b"] * 150), " ".join(words) + " #", " ".join(words), "\x0b".join(words[:199]), "\x0b".join(words[:200]) + " x", " ".join(r.choices(words, k=3000))]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)]
    return rows + rows[:7] + [(None, texts[5], "en"), (None, None, None), (None, texts[5], "en")]


def test_audit_equals_plain_counts(spark):
    rows, r = audit_rows(), random.Random(6)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "c", 1, 1) for x in rows], "doc_id long, text string, lang string, part string, mask int, good int")
    got = A.audit(A.document_masks(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = plain_audit(rows, labels, A.orders_of("ABCDE"))
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in got} == want
    assert len(got) == len(want) == 600 * 3


def test_audit_of_other_filters(spark, no_labels):
    masks = spark.createDataFrame([("p", 0, True, False), ("p", 3, True, True), ("p", 2, False, True)], "part string, mask int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in A.audit(masks, "XY", ["YX"]).collect()}
    assert got == {("YX", 1): (1, 2, 0, 1, 1, 2, 2), ("YX", 2): (1, 0, 1, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        A.audit(masks, "XY", ["XX"])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(A.document_masks(empty, no_labels)).count() == 0


# --- languages --------------------------------------------------------------------------------------------------------


def small_network(seed=1, languages=("a", "b", "c")):
    net = L.fresh(list(languages), seed, 24, (4, 2, 3), 5, 3)
    net.offsets = [np.random.default_rng(k).normal(0, 0.3, 5) for k in range(3)]
    return net


def test_gradients_are_those_of_the_loss():
    net, r = small_network(), np.random.default_rng(3)
    windows, labels = r.integers(0, 256, (9, 24)).astype(np.uint8), r.integers(0, 3, 9)
    windows[2, 10:] = 0
    _, found = L.gradients(net, windows, labels)
    for p, g in zip(net.parameters(), found, strict=True):
        for _ in range(8):
            at = tuple(r.integers(0, n) for n in p.shape)
            if p is net.vectors:
                at = (int(windows[r.integers(0, 9), r.integers(0, 9)]) or 1, at[1])
            before = p[at]
            p[at] = before + 1e-6
            up = L.gradients(net, windows, labels)[0]
            p[at] = before - 1e-6
            down = L.gradients(net, windows, labels)[0]
            p[at] = before
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_tables_equal_the_definition():
    r = np.random.default_rng(4)
    windows = r.integers(0, 256, (200, 24)).astype(np.uint8)
    windows[:50, 20:] = 0
    windows[50:60, 1:] = 0
    for seed in range(4):
        net = small_network(seed)
        assert abs(L.forward(net, windows)[0] - L.Tables(net).log_probabilities(windows)).max() < 1e-5


def test_windows_hold_every_byte():
    texts = [None, "", "a", "Z" * 24, "é" * 30, "x\0y" * 50]
    windows, owner, filled = L.windows_of(texts, 24)
    for k, t in enumerate(texts):
        own = b"".join(w[:n].tobytes() for w, o, n in zip(windows, owner, filled, strict=True) if o == k)
        assert own == (t or "").encode().lower().replace(b"\0", b" ")


SOUNDS = {"xx": ["kra", "tor", "gul", "mek"], "yy": ["lié", "sou", "êt", "mai"], "zz": ["中文", "日本", "语"]}


def spoken(n=150):
    r = random.Random(8)
    rows = []
    for i in range(n):
        lang = r.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 3))) for _ in range(r.choice([3, 20, 200]))), lang, "s", "c"))
    return rows


def test_languages_of_held_out_texts(spark):
    rows = spoken()
    odd = [(900, None, "xx", "s", "c"), (901, "", None, "s", "c"), (902, "12 $   ́", "yy", "s", "c"), (None, rows[0][1], None, "s", "c"), (903, "中" * 200_000, None, "s", "c"), *rows[:3]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, h string").repartition(4)
    held_out = F.pmod("doc_id", F.lit(4)) == 2
    net = L.train(docs, ~held_out, texts=40)
    got = L.predict(docs, net, held_out, ("lang",)).collect()
    assert len(got) == len(rows) + len(odd) and net.languages == ["xx", "yy", "zz"]
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    by = {r["doc_id"]: r for r in got}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (900, 901, 902))
    assert by[903]["lang_pred"] == "zz" and by[None]["held_out"] and by[None]["lang_pred"] == rows[0][2]
    assert all(0 <= r["score"] <= 1 for r in got)
    again = L.train(docs.repartition(3), ~held_out, texts=40)
    assert all((a == b).all() for a, b in zip(net.parameters(), again.parameters(), strict=True))
    other = L.predict(docs.select("doc_id", "text"), again, held_out).collect()  # language and source are not looked at
    assert sorted(map(str, other)) == sorted(str(r) for r in L.predict(docs, net, held_out).collect())


def test_sample_is_bounded_and_different(spark):
    rows = [(k, "copies of it", "xx") for k in range(500)] + [(k, f"text {k}", "xx") for k in range(400)] + [(k, "both", lang) for k, lang in enumerate(["xx", "yy", None, "yy"])] + [(1, "7", "zz"), (1, "only", "yy")]
    got = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 30).collect()
    by = {lang: [r["text"] for r in got if r["lang"] == lang] for lang in ("xx", "yy", "zz")}
    assert len(by["xx"]) == len(set(by["xx"])) == 30 and by["yy"] == ["only"] and not by["zz"]


def test_languages_without_rows(spark, empty):
    assert L.train(empty, F.lit(True)) is None
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.train(one, F.lit(True)) is None
    assert [tuple(r) for r in L.predict(one, None, F.lit(False)).collect()] == [(1, False, "und", 0.0)]
    only = L.train(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"), F.lit(True))
    assert [tuple(r) for r in L.predict(one, only, F.lit(False)).collect()] == [(1, False, "xx", 1.0)]
    assert L.predict(empty, only, F.lit(False)).count() == 0
