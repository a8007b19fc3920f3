"""Repair of conversations whose rows are missing, blank, repeated, cut short or out of turn, by the cheapest edits.

Rows are marked with their first fault by expressions; a row repeats an earlier one if the least turn of its role and text in
the conversation is another. Rows are then dealt by ranges of (conversation, turn, role, text), so that a conversation of any
size is spread over tasks, and each task writes its runs as signatures: one letter a row for role and fault.

Signatures are dealt anew by their own order. A task inserts them, sorted, into a prefix trie: the layer of least costs at a
node is computed from its parent's, once for all signatures with that prefix, and a signature's answer is read at its terminal
node. Sorted insertion only ever extends the last path, so that path is all of the trie that is held. A layer has the cheapest
edits between any two states of the role grammar, so the runs of one conversation compose: each conversation folds its few runs
and then streams its rows once, to apply the edits.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\f\r"
#: States of the roles `(s?(ua)+)?`: nothing yet, after s, after u, after a pair. Which state a role leads to from each.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: Rows of a run at most. A layer holds the edits of its prefix, so a path takes the square of this.
RUN = 256
#: The letter before a signature: it begins a conversation, or it may be the middle of one.
BEGINS, ANYWHERE = "^", "~"

Best = tuple[int, str] | None
Layer = tuple[tuple[Best, ...], ...]


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `copies`, each row damaged by crc32("conv_id:turn") % 20.

    0: copies is 0, the row is dropped; 1: the text is emptied; 2: it loses its .!?; 3: copies is 2; 4: the role is user.
    Nulls in the key, the role and the text count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    d = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault) for the distinct rows of (conv_id, turn, role, text[, copies]), n times each.

    fault: the first of b (blank: only 0x20 and 0x09-0x0D), d (repeats an earlier row's role and text) and t (truncated: the
    last character that isn't such white space is none of .!?), else empty. It is that of the first of the n rows; the others are
    repeats. A conversation of which no row is left has one row with n 0. Written, so both readers see the same rows.
    """
    copies: Column = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    there = copies > 0
    space = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    d = rows.select(F.col("conv_id").cast("long"), F.when(there, F.col("turn").cast("long")).alias("turn"), space("role").alias("role"), space("text").alias("text"), F.greatest(copies, F.lit(0).cast("long")).alias("n"))
    d = d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    own = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)
    d = written(d.select("*", own.alias("own"), said.alias("said")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    firsts = d.where("own <> 'b' AND n > 0").groupBy("said").agg(F.min(when).alias("first"), F.count("*").alias("c")).where("c > 1")
    d = d.join(firsts.select("said", F.col("first.turn").alias("first"), F.lit(True).alias("again")), "said", "left")
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    return d.select("conv_id", "turn", "role", "text", "n", F.when(later & (F.col("own") != "b"), "d").otherwise(F.col("own")).alias("fault"))


# --- signatures -------------------------------------------------------------------------------------------------------

STATS = "blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, opens string, closes string"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
RUNS = f"conv_id long, part int, seq long, signature string, {STATS}"
LEGAL = {"su", "ua", "au"}


class _Run:
    """The rows of one conversation that a run holds so far."""

    def __init__(self, conv: int | None, part: int, seq: int, mark: str):
        self.conv, self.part, self.seq = conv, part, seq
        self.letters = [mark]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.opens = self.closes = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        role = initial if initial in ("s", "u", "a") else "o"
        self.letters.append({"": role, "t": role.upper()}.get(fault, "x"))
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        if self.closes is None:
            self.opens = initial
        else:
            self.illegal += self.closes + initial not in LEGAL
        self.closes = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.most = turn
            self.least = turn if self.least is None else self.least

    def row(self) -> tuple:
        return (self.conv, self.part, self.seq, "".join(self.letters), *[getattr(self, k) for k in STAT_NAMES])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(schema: pa.Schema, most: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for conv, turn, role, n, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "fault")], strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        done.append(run.row())
                    run = _Run(conv, part, 0, ANYWHERE if run is None else BEGINS)
                for k in range(n):
                    if len(run.letters) > most:
                        done.append(run.row())
                        run = _Run(conv, part, run.seq + 1, ANYWHERE)
                    run.add(turn, role, fault if k == 0 or fault == "b" else "d")
                    if len(done) >= 4096:
                        yield _table(done, schema)
                        done = []
        if run is not None:
            done.append(run.row())
        if done:
            yield _table(done, schema)

    return make


# --- the trie ---------------------------------------------------------------------------------------------------------


def _better(a: Best, b: Best) -> Best:
    """The cheaper, of equal ones the least text. No text begins another of equal cost: what follows would cost something."""
    return b if a is None or (b is not None and b < a) else a


def _then(best: Best, cost: int, edit: str) -> Best:
    return None if best is None else (best[0] + cost, best[1] + edit)


def _inserting(states: list[Best]) -> tuple[Best, ...]:
    """With rows inserted behind: one leads to the middle of a pair, two to its end; a third and a fourth lead nowhere new."""
    for p in (0, 1, 3):
        states[2] = _better(states[2], _then(states[p], INSERT, "I"))
    states[3] = _better(states[3], _then(states[2], INSERT, "I"))
    return tuple(states)


def root(mark: str) -> Layer:
    """The layer before any row: from the state of each index, the cheapest edits to each state. Only state 0 begins a conversation."""
    return tuple(_inserting([(0, "") if p == q and (p == 0 or mark == ANYWHERE) else None for q in range(4)]) for p in range(4))


def step(layer: Layer, letter: str) -> Layer:
    """The layer behind one more row: x must go, capitals are cut short, o is none of the three roles."""
    out = []
    role, extra = letter.lower(), CUT if letter.isupper() else 0
    for states in layer:
        new: list[Best] = [_then(b, DELETE, "D") for b in states]
        if letter != "x":
            for p, best in enumerate(states):
                if best is None:
                    continue
                if role in NEXT[p]:
                    q = NEXT[p][role]
                    new[q] = _better(new[q], _then(best, KEEP + extra, "K"))
                q = NEXT[p].get("u", 3)  # where u can't stand, a can
                new[q] = _better(new[q], _then(best, REROLE + extra, "R"))
        out.append(_inserting(new))
    return tuple(out)


class Trie:
    """A prefix trie of which sorted insertion needs the last path alone: a node a letter, each with its layer."""

    def __init__(self) -> None:
        self.word = ""
        self.layers: list[Layer] = []
        self.steps = 0

    def insert(self, word: str) -> Layer:
        """The layer at the word's terminal node. Nodes that it shares with the word before it are there already."""
        shared = len(os.path.commonprefix((self.word, word)))
        del self.layers[shared:]
        for letter in word[shared:]:
            self.layers.append(step(self.layers[-1], letter) if self.layers else root(letter))
            self.steps += 1
        self.word = word
        return self.layers[-1]


ANSWER = "answer array<struct<p: int, q: int, cost: long, edits: string>>"


def _answers(schema: pa.Schema):
    kept = [k for k, name in enumerate(schema.names) if name != "answer"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece, answers, before, said = batch.slice(at, 512), [], None, None
                for word in piece.column("signature").to_pylist():
                    if word != before:
                        before, layer = word, trie.insert(word)
                        said = [{"p": p, "q": q, "cost": b[0], "edits": b[1]} for p, states in enumerate(layer) for q, b in enumerate(states) if b is not None]
                    answers.append(said)
                columns = {schema.names[k]: piece.column(schema.names[k]) for k in kept} | {"answer": pa.array(answers, schema.field("answer").type)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema=schema)

    return make


# --- a conversation's runs, folded, and its rows, streamed ------------------------------------------------------------


def _apart(a: str, b: str) -> tuple[str, str]:
    """What follows the common beginning: a letter of each where they differ, else the rest of the longer one."""
    n = len(os.path.commonprefix((a, b)))
    a, b = a[n:], b[n:]
    return (a[0], b[0]) if a and b else (a, b)


class Fold:
    """The cheapest edits of the runs so far to each state, kept as chains of pieces: as long as the conversation, never copied.

    To compare two chains, what sets each pair of them apart is kept: a letter of each, or, where one begins the other, the
    few inserted rows by which it is longer.
    """

    def __init__(self) -> None:
        self.ends: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        self.apart: dict[tuple[int, int], tuple[str, str]] = {(0, 0): ("", "")}

    def _set_apart(self, p: int, x: str, r: int, y: str) -> tuple[str, str]:
        a, b = self.apart[p, r]
        return (a, b) if a and b else _apart(a + x, b + y)

    def add(self, answer: list[dict]) -> None:
        chosen: dict[int, tuple[int, int, str]] = {}
        for m in answer:
            if m["p"] in self.ends:
                new, old = (self.ends[m["p"]][0] + m["cost"], m["p"], m["edits"]), chosen.get(m["q"])
                if old is None or new[0] < old[0]:
                    chosen[m["q"]] = new
                elif new[0] == old[0]:
                    a, b = self._set_apart(*new[1:], *old[1:])
                    if a < b:
                        chosen[m["q"]] = new
        self.apart = {(q, t): self._set_apart(*chosen[q][1:], *chosen[t][1:]) for q in chosen for t in chosen}
        self.ends = {q: (cost, (self.ends[p][1], edits)) for q, (cost, p, edits) in chosen.items()}

    def best(self) -> tuple[int, str]:
        least = min(self.ends[q][0] for q in ACCEPTED if q in self.ends)
        end, *others = [q for q in ACCEPTED if q in self.ends and self.ends[q][0] == least]
        for q in others:
            a, b = self.apart[q, end]
            end = q if a < b else end
        parts, link = [], self.ends[end][1]
        while link is not None:
            link, piece = link
            parts.append(piece)
        return least, "".join(reversed(parts))


class _Conversation:
    def __init__(self, conv: int | None):
        self.conv = conv
        self.fold = Fold()
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.closes = None
        self.cost = self.at = self.made = 0
        self.audit: str | None = None
        self.role = "user"

    def run(self, stats: tuple, answer: list[dict]) -> None:
        s = dict(zip(STAT_NAMES, stats, strict=True))
        for k in self.sums:
            self.sums[k] += s[k]
        if s["closes"] is not None:
            self.sums["illegal"] += self.closes is not None and self.closes + s["opens"] not in LEGAL
            self.closes = s["closes"]
        if s["most"] is not None:
            self.sums["turns"] -= s["least"] == self.most
            self.least = s["least"] if self.least is None else self.least
            self.most = s["most"]
        self.fold.add(answer)

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.fold.best()

    def _place(self, edit: str, role: str) -> str:
        out = role if edit == "K" else self.role
        self.role = "user" if out[:1] in ("s", "a") else "assistant"
        return out

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The rows inserted before the next given one, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._place("I", ""), ""

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) for what comes of the next row, given n times; deleted rows come as such."""
        self.settle()
        for _ in range(n):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            yield (edit, role, text) if edit == "D" else (edit, self._place(edit, role), text)

    def summary(self) -> dict:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.sums["turns"]
        return {"conv_id": self.conv, "gaps": gaps, **{k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost, "audit": self.audit}


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
BATCH_BYTES = 4_000_000


def _stream(rows: bool, schema: pa.Schema):
    """Conversations one after another: their runs, then their rows in order."""
    names = ["conv_id", "kind", *STAT_NAMES, "answer", "role", "text", "n"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, digest = None, [], 0, hashlib.sha256()

        def take(edits: Iterator[tuple[str, str, str]]) -> None:
            nonlocal size
            for edit, role, text in edits:
                if rows:
                    place = None if edit == "D" else now.made
                    out.append((now.conv, place, edit, role, text))
                    size += 100 + len(text)
                elif edit != "D":
                    digest.update(("\n" * (now.made > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                now.made += edit != "D"

        def close() -> None:
            nonlocal digest, size
            now.settle()
            take(now.inserted())
            if not rows:
                out.append((*now.summary().values(), digest.hexdigest()))
                size += 200 + len(now.audit)
            digest = hashlib.sha256()

        for batch in batches:
            for conv, kind, *stats, answer, role, text, n in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        close()
                    now = _Conversation(conv)
                if kind == 0:
                    now.run(tuple(stats), answer)
                else:
                    take(now.row(role, text, n))
                if size >= BATCH_BYTES:
                    yield _table(out, schema)
                    out, size = [], 0
        if now is not None:
            close()
        if out:
            yield _table(out, schema)

    return make


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _streamed(rows: DataFrame, run: int, of_rows: bool) -> DataFrame:
    """The marked rows, dealt by ranges into runs, the runs answered by tries, and both brought together by conversation."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order, F.substring("role", 1, 1).alias("initial"), "n", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = dealt.select("conv_id", "turn", "initial", "n", "fault").mapInArrow(_runs(_arrow(RUNS), run), RUNS)
    by = ["signature", "conv_id", "part", "seq"]
    answered = f"conv_id long, part int, seq long, {STATS}, {ANSWER}"
    answers = runs.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_answers(_arrow(answered)), answered)
    met = answers.withColumn("kind", F.lit(0)).unionByName(rows.where("n > 0").select(*order, "n").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", "turn", "role", "text")
    schema = REPAIRED if of_rows else SUMMARY
    return met.select("conv_id", "kind", *STAT_NAMES, "answer", "role", "text", "n").mapInArrow(_stream(of_rows, _arrow(schema)), schema)


def repaired_rows(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations' rows, placed from 0, and the deleted ones, without a place.

    rows: (conv_id, turn, role, text[, copies]), as of `repair`. edit: K keep, R new role, I inserted, D deleted.
    """
    return _streamed(marked(rows), run, True)


def repair(rows: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text[, copies]); null is a conversation, too.

    gaps: turns missing between the least and the greatest, nulls ignored. blank, duplicate, truncated: rows by first fault, as
    `marked` has them. illegal: neighbours whose roles' initials are not su, ua or au. cost and audit: the cheapest edits that
    give role initials `(s?(ua)+)?`, the ASCII-least of equal cost: K keeps a row, R makes it a user's or an assistant's (3), D
    deletes it (4; blank and repeated rows must go), I inserts an empty one (3), and truncated rows that stay cost 3 more.
    repaired_sha256: of the repaired "role:text" lines.

    Rows are taken by turn, nulls first, then by role and text; null roles and texts are one space; equal rows all count. copies
    0 drops a row, but its conv_id stays: without rows all numbers are zero and the hash that of an empty text. Other columns
    are ignored. A conversation of any length is split into runs of at most `run` rows; its audit is one string, as asked, and so
    has to fit one task, where its rows are only streamed.
    """
    return _streamed(marked(rows), run, False)
