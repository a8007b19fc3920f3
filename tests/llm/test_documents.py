"""The operators on documents against brute force, over odd rows and an empty table."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from stardeck.llm import byte_bpe, common, line_dedup, lm_scoring, packing, perplexity_filter, quality_rules, simhash, toxicity

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PACKER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def statistics(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, labels):
    got = sorted(map(tuple, quality_rules.quality_rules(odd, labels).collect()), key=repr)
    want = []
    for i, text, *_ in odd_rows():
        s = statistics(text)
        want.append((i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert [r[:7] for r in got] == sorted(want, key=repr)
    assert all(not (r[6] and r[7]) for r in got)


def test_quality_rules_learn_what_separates(spark):
    clean = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(90))) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{(i * 5 + k * k) % 89}###" for k in range(90))) for i in range(30)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 100)) for i, _ in clean + junk], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, marks).collect()}
    assert not any(kept[i] for i, _ in junk)
    s = quality_rules.text_statistics(docs)
    assert "symbols" in str(quality_rules.learn(s, marks))


def rates(text):
    words, chars, symbols, dup, repeat = statistics(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    capitals, marks = sum(c.isupper() for c in text or ""), sum(c in "!?" for c in text or "")
    of = lambda a, b: a / max(b, 1)
    return {"words": float(words), "word_length": of(chars, words), "symbols": of(symbols, chars), "dup_lines": of(dup, len(lines)), "repeats": of(repeat, words), "capitals": of(capitals, chars), "marks": of(marks, chars)}


def plain_rules(rows, quantiles=24, max_rules=8, max_conditions=3, least=0.9, least_rows=3):
    """Sequential covering over (grow, bad, rates), in plain Python: [[(rate, above, at), ...], ...]."""
    names = sorted(rows[0][2])
    level = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    cuts = {}
    for r in names:
        values = sorted({level([x[r] for _, b, x in rows if b == bad], k / quantiles) for bad in {b for _, b, _ in rows} for k in range(quantiles + 1)})
        cuts[r] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    holds = lambda rule, x: all((x[r] > at) == above for r, above, at in rule)
    count = lambda rule, of: tuple(sum(1 for _, b, x in of if b == bad and holds(rule, x)) for bad in (1, 0))
    out, left = [], rows
    while len(out) < max_rules:
        rule, now = [], [x for x in left if x[0]]
        while len(rule) < max_conditions:
            p0, n0 = count([], now)
            best = None
            for r in names if p0 else ():
                for at in cuts[r]:
                    for above in (True, False):
                        p, n = count([(r, above, at)], now)
                        worth = (p + 1) / (p + n + 2)
                        if p >= least_rows and n < n0 and worth > (p0 + 1) / (p0 + n0 + 2) + 1e-12 and (best is None or worth > best[0] + 1e-12):
                            best = worth, (r, above, at), n
            if best is None:
                break
            rule.append(best[1])
            now = [x for x in now if holds(rule, x[2])]
            if best[2] == 0:
                break
        prune = [x for x in left if not x[0]]
        parts = [(rule[: k + 1], count(rule[: k + 1], prune)) for k in range(len(rule))]
        best = max(parts, key=lambda part: ((part[1][0] + 1) / (sum(part[1]) + 2), -len(part[0])), default=None)
        if best is None or best[1][0] < least * sum(best[1]):
            break
        out.append(best[0])
        left = [x for x in left if not holds(best[0], x[2])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_rules_are_those_of_plain_covering(spark, seed):
    import random

    rnd = random.Random(seed)
    vocabulary = ["tree", "Sea", "moon", "a", "longerword", "Élan"]
    texts = []
    for i in range(260):
        bad = i % 3 == 0
        words = rnd.choices(vocabulary, k=rnd.randrange(52, 120))
        for _ in range(rnd.randrange(8, 30) if bad else rnd.randrange(0, 9) * (i % 5 == 0)):
            words[rnd.randrange(len(words))] += rnd.choice(["!", "!?", "###", "|"] if i % 2 else ["?", "STOP"])
        for k in range(9, len(words), 10):
            words[k] += "\n"
        texts.append((i, " ".join(words)))
    marks = [(i, int(i % 3 > 0)) for i, _ in texts if i % 13] + [(1, 0), (None, 0), (2, None), (3, 5), (9999, 1)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    label = {}
    for i, q in marks:
        if q in (0, 1):
            label[i] = max(label.get(i, 0), int(q == 0))
    rows = [(hashed_long(i) % 3 > 0, label[i], rates(t)) for i, t in texts if i in label]
    want = plain_rules(rows)
    made = quality_rules.learn(quality_rules.text_statistics(docs), labels)
    assert want and [[(c.rate, c.above, pytest.approx(c.at)) for c in rule] for rule in made.rules] == want
    holds = lambda x: any(all((x[r] > at) == above for r, above, at in rule) for rule in want)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in texts:
        s = statistics(t)
        assert got[i] == (s[0] >= 50 and 100 * s[4] <= 50 * s[0] and not holds(rates(t)))


def test_quality_rules_without_rows_or_labels(odd, empty, labels, no_labels):
    assert quality_rules.quality_rules(empty, labels).count() == 0
    got = quality_rules.quality_rules(odd, no_labels)
    assert got.where("kept = base_failed").count() == 0


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(odd.repartition(3), PACKER, capacity=256).collect()
    tokenizer = Tokenizer.from_file(PACKER)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in odd_rows():
        if i is None or i == 3:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += r["length"]
        assert at == len(ids)
    full = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 256 and n & (n - 1) == 0 for n in full.values())
    # a row that is there three times has each of its ids in three pieces, wherever they were cut
    held = Counter(k for r in by_doc[3] for k in range(r["start"], r["start"] + r["length"]))
    assert held == dict.fromkeys(range(by_doc[3][0]["doc_tokens"]), 3)
    assert packing.pack(empty, PACKER).count() == 0


def test_packing_cuts_seldom(spark):
    import random

    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(["a"] * rnd.randrange(0, 900))) for i in range(2000)], "doc_id long, text string").coalesce(2)
    rows = packing.pack(docs, PACKER, capacity=512).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    filled = [sum(r["length"] for r in rs) for rs in sequences.values()]
    assert sum(f == 512 for f in filled) >= len(filled) - 2 * 9 and all(f & (f - 1) == 0 for f in filled)
    tokens = sum(filled)
    # one piece a document, one more at each full sequence of its own and at each gap that is closed
    assert len(rows) <= 2000 + 2 * tokens // 512 + 200
    # a bin of class k holds k whole rests, so few bins hold a document's middle
    rests = Counter(512 // (r["doc_tokens"] - r["start"]) for r in rows if r["start"] + r["length"] == r["doc_tokens"] and r["start"] == 0 and r["length"] < 512)
    assert len(rests) > 5


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PACKER)
    ids = packing.word_ids(PACKER)
    for text in ("It's <|endoftext|> DÉJÀ vu!!! 12٣ ΣΣ", "é ﬁx 中文。x", "İstanbul don't \x1c a_b"):
        got = b"".join(map(ids.__getitem__, text.encode().split()))
        assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def deduped(rows, least=10, before=()):
    """What stays of each row; lines of batches that came before belong to their documents. Null ids come last, in the order of a hash of their texts."""
    key = lambda x: lower(x).strip(" \t\n\x0b\x0c\r")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    place = lambda i, text: (2**63 - 1, signed(xxhash.xxh64_intdigest((text or "").encode(), 42))) if i is None else (i, 0)
    owner = {}
    for batch in (*before, rows):
        new = {}
        for i, text, *_ in batch:
            for x in (text or "").split("\n"):
                new[key(x)] = min(new.get(key(x), place(i, text)), place(i, text))
        owner = new | owner
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == place(i, text)]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (6, 3)])
def test_line_dedup(odd, batches, fanout):
    got = line_dedup.dedup_lines(odd, batches=batches, fanout=fanout, carry=("lang",))
    assert ordered(got.drop("lang")) == sorted(deduped(odd_rows()), key=repr)


def test_line_dedup_of_null_ids(spark):
    rows = [(None, "only a line of the first\nshared by both of them"), (None, "shared by both of them\nonly a line of the second"), (None, "shared by both of them\nonly a line of the second"), (7, "Only A Line of the second ")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got) == sorted(deduped(rows), key=repr)


def test_line_dedup_of_later_batches(spark, odd):
    """Runs that are kept see the lines of all batches before, also when levels have been merged."""
    batches = [odd_rows()[k::4] for k in range(4)]
    schema = odd.schema
    with line_dedup.LineRuns(spark, buckets=3, fanout=2) as runs:
        for k, rows in enumerate(batches):
            got = line_dedup.dedup_lines(spark.createDataFrame(rows, schema), batches=2, runs=runs)
            assert ordered(got) == sorted(deduped(rows, before=batches[:k]), key=repr)
        assert len(runs.runs()) < 8 and max(map(len, runs.levels)) < 2
        names = list(runs.names)
    assert names and not any(spark.catalog.tableExists(n) for n in names)


def test_line_runs_that_a_later_session_opens(spark, tmp_path):
    """Two objects over one folder, in two sessions, give what one object gives."""
    nights = [[(k, f"a line of night {k % 3}\nfirst {n} {k}\nsaid every night") for k in range(10 * n, 10 * n + 6)] for n in range(4)]
    tables = [spark.createDataFrame(x, "doc_id long, text string") for x in nights]
    folder = f"{tmp_path}/runs"
    with line_dedup.LineRuns(spark, buckets=3, fanout=2) as one:
        want = [sorted(map(tuple, line_dedup.dedup_lines(t, batches=1, runs=one).collect())) for t in tables]
    got = []
    for n, rows in enumerate(nights):
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", "4")
        runs = line_dedup.LineRuns(session, buckets=3, fanout=2, folder=folder) if n == 0 else line_dedup.LineRuns.opened(session, folder)
        with runs:
            got.append(sorted(map(tuple, line_dedup.dedup_lines(session.createDataFrame(rows, "doc_id long, text string"), batches=1, runs=runs).collect())))
        assert runs.version == n + 1 and runs.fanout == 2
    assert got == want and all(r[3] == 2 for r in got[3])


def test_line_dedup_of_the_greatest_id(spark):
    last = 2**63 - 1
    rows = [(last, "a line of some length"), (None, "a line of some length"), (None, "another such line\nx"), (last, "another such line\ny"), (5, "said by five alone")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=1).select("doc_id", "text", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(last, "a line of some length", 0), (None, "", 1), (None, "x", 1), (last, "another such line\ny", 0), (5, "said by five alone", 0)], key=str)


def test_line_dedup_of_a_line_that_many_have(spark):
    rows = [(i, f"a line that all of them have\nline number {i} of its own" + ("\nevery third has this line" if i % 3 == 0 else "")) for i in range(60)]
    hashed = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(line_dedup.dedup_lines(hashed)) == sorted(deduped(rows), key=repr)


def test_merging_of_runs_shuffles_nothing(spark, odd):
    with line_dedup.LineRuns(spark, buckets=3, fanout=9) as runs:
        line_dedup.dedup_lines(odd, batches=3, runs=runs)
        plan = line_dedup._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 3


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def fingerprint(text, k=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows, radius):
    fp = {t: fingerprint(t) for t in {r[1] for r in rows}}
    at = [(2**63 if r[0] is None else r[0], fp[r[1]]) for r in rows]
    parent = list(range(len(at)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(at)):
        for b in range(a):
            if (at[a][1] ^ at[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(at):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((r[0], f"{f:016x}", None if least[find(k)] == 2**63 else least[find(k)]) for k, (r, (_, f)) in enumerate(zip(rows, at, strict=True))), key=repr)


def test_simhash(spark, odd, empty):
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr) == grouped(odd_rows(), 2)
    assert simhash.near_duplicates(empty).count() == 0


def test_first_of_each_group(spark, odd, empty):
    got = simhash.first_of_each(odd)
    assert got.columns == odd.columns
    place = lambda r: (r[0] is None, r[0] or 0, (h := xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) - (2**64 if h >= 2**63 else 0))
    groups = {}
    prints = [(r, fingerprint(r[1])) for r in odd_rows()]
    label = list(range(len(prints)))
    for a, (_, x) in enumerate(prints):
        for b, (_, y) in enumerate(prints[:a]):
            if (x ^ y).bit_count() <= 2:
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
    for k, (r, _) in zip(label, prints, strict=True):
        groups[k] = min(groups.get(k, r), r, key=place)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, groups.values()))
    assert simhash.first_of_each(empty).count() == 0


@pytest.mark.parametrize("tile", [3, 50])
def test_simhash_tiles_join_what_all_pairs_join(spark, tile):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (2**64 - 1) for b in base for _ in range(20)} | {0, 2**64 - 1, 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    made = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, tile=tile, strip=2)
    from stardeck.llm.components import components

    got = {r["node"]: r["component"] for r in components(made).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    size = Counter(map(find, signed))
    assert got == {p: find(p) for p in signed if size[find(p)] > 1}
    # a forest, not all pairs
    assert made.count() < 4 * len(prints)


def hashed_long(i):
    h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
    return h - 2**64 if h >= 2**63 else h


def classified(rows, marks, sample, quantile, order):
    """(id, tokens, log10 probability, threshold, kept) of each row, in plain Python."""
    by_id = {}
    for i, q in marks:
        by_id.setdefault(i, []).append(q)
    trusted = {i for i, qs in by_id.items() if i is not None and all(q == 1 for q in qs if q is not None) and any(q is not None for q in qs)}
    lang = {}
    for i, t, la in rows:
        if i in trusted and hashed_long(i) % 2 == 0:
            lang.setdefault(i, []).append(la)
    lang = {i: min((x for x in v if x is not None), default=None) for i, v in lang.items()}
    chosen = {i for i, la in lang.items() if ((hashed_long(i) % 2**64) >> 33) * list(lang.values()).count(la) < 2**31 * sample}
    log_p = kneser_ney([t for i, t, _ in rows if i in chosen], order)
    scored = [(i, la, len(WORD.findall(lower(t))) + 1, log_p(t)) for i, t, la in rows]
    worth = lambda r: 10 ** (-r[3] / r[2])
    level = lambda xs: sorted(xs)[max(0, math.ceil(quantile * len(xs)) - 1)]
    held = [r for r in scored if r[0] in trusted - chosen]
    of = {la: level([worth(r) for r in held if r[1] == la]) for la in {r[1] for r in held}}
    for r in scored:
        t = of.get(r[1], level(list(map(worth, held))))
        yield r[0], r[2], r[3], t, worth(r) <= t * (1 + 1e-9)


@pytest.mark.parametrize("order,sample,quantile", [(2, 3, 0.8), (3, 100, 0.5)])
def test_perplexity_filter(spark, order, sample, quantile):
    import random

    rnd = random.Random(order)
    words = ["tree", "sea", "Road", "ROAD", "sun", "moon", "élan", "ÉLAN", "star"]
    rows = [(i, " ".join(rnd.choices(words[: 3 + i % 7], k=rnd.randrange(0, 40))), ["en", "de", None, "fr"][i % 4 if i % 20 else 3]) for i in range(120)]
    rows += [rows[5], rows[5], (None, "tree sea", "en"), (500, None, "it"), (501, "", None)]
    marks = [(i, int(i % 3 > 0)) for i in range(0, 110) if i % 4 != 3] + [(1, 0), (2, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, l string, row int")
    got = perplexity_filter.classify(docs.repartition(3), spark.createDataFrame(marks, "doc_id long, quality int"), sample=sample, quantile=quantile, order=order)
    near = lambda r: (r[0], r[1], round(r[2], 6), round(r[3], 6), r[4])
    assert sorted((near((r["doc_id"], r["n_tokens"], r["log10_prob"], r["threshold"], r["kept"])) for r in got.collect()), key=repr) == sorted(map(near, classified(rows, marks, sample, quantile, order)), key=repr)


def test_perplexity_filter_without_rows_or_labels(odd, empty, labels, no_labels):
    got = perplexity_filter.classify(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(r["perplexity"] > 0 and r["kept"] is not None for r in got)
    assert perplexity_filter.classify(odd, no_labels).where("NOT kept").count() == 0
    assert perplexity_filter.classify(empty, labels).count() == 0


def test_perplexity_filter_learns_from_half_of_the_trusted_texts(spark):
    """Without a sample no trusted text is left out, however many there are: half of them make the model, the others the threshold."""
    import random

    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(["tree", "sea", "Road", "sun", "moon", "star", f"w{i}"], k=12)), "en") for i in range(2400)]
    marks = [(i, 1) for i in range(2400)]
    got = perplexity_filter.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    want = {r[0]: (r[1], round(r[2], 6), round(r[3], 6)) for r in classified(rows, marks, 10**6, 0.99, 2)}
    assert {r["doc_id"]: (r["n_tokens"], round(r["log10_prob"], 6), round(r["threshold"], 6)) for r in got.collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_perplexity_matches_the_formula(spark, order):
    """However few keys are hot, however the shards are cut, whatever a task sends in vain."""
    texts = ["a b c a b d", "a b b c", "c a b", "d d a", "a", "", "a b c a b d", "b c a b"]
    more = [(9, "en", "a b z c"), (10, "en", "z z z"), (11, "en", "d a b c a b b c a b d " * 30)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + more, "doc_id long, lang string, text string").repartition(3)
    table, unknown = perplexity_filter.model(docs.where("doc_id < 9"), order)
    want = kneser_ney(texts, order)
    for how in ({}, {"hot_keys": 0, "shard_rows": 3, "division": 50}, {"hot_keys": 5, "shard_rows": 2}):
        got = {r["doc_id"]: r["log10_prob"] for r in perplexity_filter.perplexity(docs, table, unknown, order, **how).collect()}
        for i, t in [*enumerate(texts), *((i, t) for i, _, t in more)]:
            assert got[i] == pytest.approx(want(t), rel=1e-9)


def test_perplexity_asks_in_shares_of_a_model_that_is_not_shuffled_again(spark, monkeypatch):
    """Neither what all documents ask nor a second copy of the model is on disk at once."""
    import random

    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, "en", " ".join(rnd.choices([f"w{k}" for k in range(500)], k=30))) for i in range(400)], "doc_id long, lang string, text string").coalesce(2)
    table, unknown = perplexity_filter.model(docs, 2)
    given, rows, plans, write, drop = [], [], [], perplexity_filter.written, perplexity_filter.Shards.drop

    def seen(df, name):
        given.extend(df if name == "scored" else [])
        return write(df, name)

    def kept(self):
        plans.extend(str(s._jdf.queryExecution().executedPlan()) for s in given)
        rows.extend(s.count() for s in given)
        drop(self)

    monkeypatch.setattr(perplexity_filter, "written", seen)
    monkeypatch.setattr(perplexity_filter.Shards, "drop", kept)
    assert perplexity_filter.perplexity(docs, table, unknown, 2, hot_keys=10, shard_rows=500).count() == 400
    assert len(rows) == perplexity_filter.ROUNDS > 1 and sum(rows) == 400 and max(rows) < 200
    assert all("Bucketed: true" in p for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shards")]


def test_shuffle_files_go_when_a_table_is_written(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(k).getName()) for k in range(files.size())}

    before = held()
    counts = common.written(spark.range(10_000).groupBy(F.expr("id % 5000").alias("k")).count(), "counts")
    assert not {f for f in held() - before if f.startswith("shuffle")}
    assert counts.count() == 5000
    assert spark.conf.get(common.CLEANED) == "false"


def test_chained_hashes_are_those_of_spark(spark):
    import numpy as np

    a, b = np.array([1, 2**63 + 5, 0], np.uint64), np.array([7, 3, 2**64 - 1], np.uint64)
    rows = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(a.view(np.int64), b.view(np.int64), strict=True))], "k int, a long, b long")
    want = [r[0] for r in rows.orderBy("k").select(F.xxhash64("a", "b")).collect()]
    assert common.chained(b, common.chained(a)).view(np.int64).tolist() == want


def kneser_ney(texts, order=2):
    """log10 P of a text under an interpolated modified Kneser-Ney model of texts."""
    stream = lambda t: [*["<s>"] * (order - 1), *WORD.findall(lower(t)), "</s>"]
    grams = lambda t: list(zip(*[stream(t)[k:] for k in range(order)], strict=False))
    count = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    d = {n: lm_scoring.discounts(*[sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]) for n, c in count.items()}
    total, left = Counter(), Counter()
    for n, c in count.items():
        for g, x in c.items():
            total[n, g[:-1]] += x
            left[n, g[:-1]] += d[n][min(x, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(count[1]) + 1)
        if not total[n, g[:-1]]:
            return p(g[1:])
        return (max(count[n][g] - d[n][min(count[n][g], 3)], 0) + left[n, g[:-1]] * p(g[1:])) / total[n, g[:-1]]

    assert sum(p((*["<s>"] * (order - 1), w)) for (w,) in count[1]) + p((*["<s>"] * (order - 1), "?")) == pytest.approx(1)
    return lambda t: sum(math.log10(p(g)) for g in grams(t))


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scoring(odd, empty, order):
    held = common.bucket_of_id("doc_id", 10) == 0
    model = lm_scoring.train(odd.where(~held).select("text"), shard_bytes=20_000, order=order)
    got = lm_scoring.score(odd, model, held).collect()
    taught = [(i, t) for i, t, *_ in odd_rows() if i is not None and zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for _, t in taught for w in [*WORD.findall(lower(t)), "</s>"])
    N, V = sum(count.values()), len(count)
    want = kneser_ney([t for _, t in taught], order)
    rows = Counter()
    for i, t, *_ in odd_rows():
        words = [*WORD.findall(lower(t)), "</s>"]
        base = sum(math.log10((count[w] + 0.1) / (N + 0.1 * (V + 1))) for w in words)
        rows[i, i is None or not zlib.crc32(str(i).encode()) % 10, len(words), sum(count[w] > 0 for w in words), N, round(base, 5), round(want(t), 5)] += 1
    assert Counter((*r[:5], round(r[5], 5), round(r[6], 5)) for r in got) == rows
    assert lm_scoring.score(empty, model, held).count() == 0
    nothing = lm_scoring.train(empty.select("text"), order=order)
    assert lm_scoring.score(odd, nothing, held).where("abs(score) > 1e-9").count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scoring_counts_beyond_a_byte(spark, order):
    """Counts, and numbers of different neighbours, that don't fit a byte; a hot word's pairs lie in several shards."""
    texts = [" ".join(f"a{k} x b{k * 7 % 300} x y" for k in range(i, 300)) for i in range(0, 300, 60)] + ["x y " * 400] * 4 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm_scoring.train(docs.select("text"), shard_bytes=2_000, order=order)
    assert model.hot
    want = kneser_ney(texts, order)("x y x")
    assert lm_scoring.score(spark.createDataFrame([(1, "x y x")], "doc_id long, text string"), model, F.lit(False)).first()["score"] == pytest.approx(want)


def test_a_model_file_that_is_missing_is_an_error(spark, odd):
    """Never an empty shard, whichever file it is."""
    import os
    import shutil

    model = lm_scoring.train(odd.where("doc_id < 12").select("text"), shard_bytes=2_000)
    files = sorted(x for x in os.listdir(model.folder) if not x.startswith("."))
    shards = len(model.offsets) - 1
    assert {x.split("-")[0] for x in files} == {"seen", "words", "pairs", "statistics", "contexts"} and len(files) >= 4 * shards + 1
    texts = [r["text"] for r in odd.where("doc_id < 12").collect()]
    want = model.score(texts)
    for kind in ("words", "pairs", "statistics", "contexts"):
        for k in range(shards):
            lm_scoring._mapped.cache_clear()
            shutil.move(f"{model.folder}/{kind}-{k}", f"{model.folder}/.away")
            try:
                got = model.score(texts)
            except FileNotFoundError as e:
                assert f"{kind}-{k}" in str(e)
            else:  # no word of these texts has anything in the shard
                assert all((a == b).all() for a, b in zip(got, want, strict=True))
                assert kind == "pairs" or not lm_scoring.Words(model.folder, model.offsets).offsets[k + 1] > model.offsets[k]
            shutil.move(f"{model.folder}/.away", f"{model.folder}/{kind}-{k}")
    lm_scoring._mapped.cache_clear()
    with open(f"{model.folder}/words-0", "r+b") as f:
        f.truncate(os.path.getsize(f"{model.folder}/words-0") - 1)
    with pytest.raises(ValueError, match="cut short"):
        lm_scoring._mapped(model.folder, "words-0")


def test_shards_grow_with_the_text():
    assert [lm_scoring.shards_for(n, 16_000_000) for n in (0, 10**9, 10**14)] == [4, 63, lm_scoring.shards_for(10**14, 16_000_000)]
    assert lm_scoring.shards_for(10**14, 16_000_000) < 400_000


def test_toxicity(spark, odd, empty, labels, no_labels):
    held = common.bucket_of_id("doc_id", 5) == 0
    lexicon = toxicity.learn(odd, labels, ~held)
    got = toxicity.score(odd, lexicon, held).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    want = Counter((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, round(plain_score(t, lexicon), 9)) for i, t, *_ in odd_rows())
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 9)) for r in got) == want
    assert toxicity.score(empty, toxicity.learn(empty, no_labels, ~held), held).count() == 0


def toxic_rows():
    words = [f"w{k}" for k in range(60)]
    import random

    rnd = random.Random(2)
    for i in range(400):
        text = rnd.choices(words, k=30)
        if i % 4 == 0:
            text[7] = "zorp" if i % 8 else "zorpish"
        yield i, " ".join(text) + (" you zorp fool." if i % 4 == 0 else "."), int(i % 4 == 0)


def test_toxicity_learns_insults(spark):
    rows = list(toxic_rows())
    marks = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, "clash", 3, 1.0, True) for i, t, _ in rows], "doc_id long, text string, toxic string, half int, s0 double, _y boolean")
    lexicon = toxicity.learn(docs, marks, F.lit(True))
    assert lexicon.weight("zorp") > 2
    score = toxicity.Scorer(lexicon).score
    assert score("you zorp") > 0.5 > score("the road is long")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon, F.lit(False)).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    # neither the order of rows nor which of several equal texts is read changes what is learned
    again = [(1000 + i, t) for i, t, _ in rows[::3]] + [(i, t) for i, t, _ in rows[::-1]]
    other = spark.createDataFrame(again, "doc_id long, text string").repartition(7)
    more = marks.unionByName(marks.where("doc_id % 3 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), "toxic"))
    assert toxicity.learn(other, more.repartition(5), F.lit(True)) == lexicon


def test_threats_are_learned(spark):
    rows = [(i, ("they burn wood here " if i % 2 else "i will kill you ") + f"on day {i}", int(i % 2 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks, F.lit(True))
    assert lexicon.threats["kill"] > 2 and lexicon.threats["burn"] == 0.0 and lexicon.threats["murder"] == toxicity.GIVEN_WEIGHT
    score = toxicity.Scorer(lexicon).score
    assert score("i will kill you") > 0.5 > score("we burn wood")


def test_logistic_of_nearly_parted_labels():
    """Steps of a plain Newton's method run away here and leave a slope of nothing."""
    rows = [(0.0, 0, 4600), (7.5, 0, 2), (9.0, 1, 3), (11.25, 1, 60), (22.5, 1, 900), (33.75, 1, 900), (40.0, 1, 4100)]
    for times in (1, 10, 1000):
        a, b = toxicity.logistic([((s, 0.0, 0.0, 0.0), y, n * times) for s, y, n in rows])
        assert b[0] > 0.5 and a + b[0] * 7.5 < 0 < a + b[0] * 11.25
        assert b[1:] == toxicity.GIVEN_FACTORS[1:]
    assert toxicity.logistic([]) == toxicity.logistic([((1.0, 0.0, 0.0, 0.0), 1, 5)]) == (toxicity.GIVEN_BIAS, toxicity.GIVEN_FACTORS)


def test_toxicity_clauses():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 2.0}))
    sums = lambda t: [round(x, 6) for x in scorer.sums(t)]
    assert sums("what an idiot") == [2.0, 0, 0, 0] and sums("not an idiot") == [0.5, 0, 0, 0] and sums("it said what an idiot") == [1.0, 0, 0, 0]
    assert sums("you idiot") == sums("idiot, you") == [0, 2.0, 0, 0]
    assert sums("i will kill you") == [0, 0, 0, 2.5] and sums("you i will kill") == [0, 0, 2.5, 0]
    assert sums("not. an idiot") == sums("an idiot") and sums("a fine day") == [0, 0, 0, 0] and scorer.clauses("a fine day") == []
    for elided in ("l'idiot", "d’idiot", "idiot's", "L'IDIOT"):
        assert sums(elided) == [2.0, 0, 0, 0]
    scores = [scorer.score(t) for t in ("not an idiot", "they said what an idiot".replace("they ", ""), "what an idiot", "you idiot")]
    assert scores == sorted(set(scores))


@pytest.mark.parametrize("seed", range(4))
def test_the_composed_grammar_is_the_machines_in_series(seed):
    import random

    rnd = random.Random(seed)
    whole, parts = toxicity.grammar(), toxicity.machines()
    state, states = whole.start, [m.start for m in parts]
    for _ in range(3000):
        symbol = rnd.randrange(7)
        state, out, weight = whole.step(state, symbol)
        product = 1.0
        for k, m in enumerate(parts):
            states[k], symbol, f = m.step(states[k], symbol)
            product *= f
        assert (out, weight) == (symbol, product)


def plain_sums(text, lexicon):
    """The four sums by looking around in each clause, without machines."""
    fixed = {w: kind for kind in (toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT) for w in toxicity.WORDS[kind].split()}

    def kind(word):
        found = []
        for x in [word, *re.findall(r"[^\W\d_]+", word)]:
            if x in fixed:
                found.append((fixed[x], 0.0))
            elif x in lexicon.threats:
                found.append((toxicity.THREAT, lexicon.threats[x]))
            else:
                w = max([lexicon.words.get(x, 0.0)] + [v for b, v in lexicon.beginnings.items() if x.startswith(b)])
                found.append((toxicity.INSULT if w > 0 else toxicity.OTHER, w))
            if x == word and found[0] != (toxicity.OTHER, 0.0):
                return found[0]
        return max(found[1:], key=lambda f: f[1])

    total = [0.0] * 4
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = [kind(w) for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)]
        kinds = [k for k, _ in words]
        for i, (k, w) in enumerate(words):
            if k not in (toxicity.INSULT, toxicity.THREAT):
                continue
            w *= (0.25 if toxicity.NEGATION in kinds[max(0, i - 3) : i] else 1) * (0.5 if toxicity.REPORT in kinds[:i] else 1)
            aimed = k == toxicity.INSULT and toxicity.TARGET in kinds[:i]
            if not aimed:
                for x in kinds[i + 1 : i + 4]:
                    if x == toxicity.TARGET:
                        aimed = True
                    if x in (toxicity.TARGET, toxicity.INSULT, toxicity.THREAT):
                        break
            total[(k == toxicity.THREAT) * 2 + aimed] += w
    return total


def plain_score(text, lexicon):
    return 1 / (1 + math.exp(-max(-30, min(30, lexicon.a + sum(b * x for b, x in zip(lexicon.b, plain_sums(text, lexicon), strict=True))))))


@pytest.mark.parametrize("seed", range(3))
def test_toxicity_scores_are_those_of_a_plain_evaluator(seed):
    import random

    rnd = random.Random(seed)
    lexicon = toxicity.Lexicon({"idiot": 2.0, "fool": 1.5}, {"zor": 3.0})
    lexicon.threats["burn"] = 0.0
    scorer = toxicity.Scorer(lexicon)
    words = ["idiot", "fool", "zorp", "l'idiot", "kill", "burn", "you", "he", "not", "said", "said", "the", "day", "tree", ".", "!", "\n", "you're", "NEVER", "d’été"]
    for _ in range(400):
        text = " ".join(rnd.choices(words, k=rnd.randrange(0, 40)))
        assert scorer.sums(text) == pytest.approx(plain_sums(text, lexicon)), text
        assert scorer.score(text) == pytest.approx(plain_score(text, lexicon))


def test_byte_bpe(odd, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(tuple, byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t, *_ in odd_rows():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    both = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted((bytes(r["bytes"]) for r in both.collect())) == sorted((t or "").encode() for _, t, *_ in odd_rows())
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
