"""Conversation structure repair by dynamic programming over a grammar.

Turns of a conversation, in order, are letters: what the role's initial is (s, u, a or other) and
whether the row must go (blank or seen before), is cut short, or is sound. A repair keeps, reroles
or deletes rows and inserts empty ones so that the role initials read ``(s?(ua)+)?``, an automaton
of four states. A stretch of rows is then a 4 x 4 matrix over (min, +): the cost of the cheapest
edits that lead from one state to another, and which of these edit strings comes first in ASCII.

Equal stretches recur in all conversations, so their letters are compressed by Re-Pair: the most
frequent neighbours become rules, round by round, counted over all distinct stretches in Spark.
Every rule gets one matrix, made bottom-up from those of its two parts, and all conversations share
it. The edit strings are ropes: an entry only knows the state between its parts and its rank in
ASCII order among the entries of its matrix, which is all that products need; letters are read off
the rope once, for the entries that the best repair uses. Ranks order whole products because insertions
stand before the row they precede, so of two edit strings of one stretch none begins the other.

At scale: rows are ordered by one range-partitioned sort, so a conversation may lie in many
partitions; letters are grouped in stretches of at most ``BLOCK`` rows, each multiplied out on
its own. Per conversation only a few numbers a stretch meet in one task, and, since a digest is
bound to order, its texts pass through one task as a stream that holds one row at a time. Repeated rows are found
by a mergeable minimum over (conversation, role, text hash), joined back.

Defined results: rows of one turn follow by role, then text. A null role or text counts as one
space, a null turn comes first and opens no gap, a null conversation is one of its own. Whole rows
that repeat are duplicates. A table without rows has no conversations. Texts are read whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotamera.llm.common import written

BLOCK = 4096             # rows of a stretch
ROUNDS, PAIRS = 8, 48    # rounds of Re-Pair, new rules in each; letters left over stay letters
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
SPACE = r"\x20\x09-\x0D"
# letters: A-D sound rows of initial s, u, a, other; E-H the same cut short; X rows that must go
LETTERS = "ABCDEFGHX"
STEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT,
        ("u", ASSISTANT): USER}
COUNTS = ("cost", "gaps", "illegal", "blank", "duplicate", "truncated")
CLOSE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}     # insertions that end a repair


class Matrices:
    """The matrix of every letter and rule: cost, rank of the edit string, and for a rule the
    state in the middle."""

    def __init__(self, rules=()):
        self.rules = {chr(0x100 + n): pair for n, pair in enumerate(rules)}
        self.strings: dict = {}
        self.entries: dict = {}
        for x in LETTERS:
            self.entries[x] = self._letter(x)
        for name, (left, right) in self.rules.items():
            self.entries[name] = product(self.entries[left], self.entries[right])

    def _letter(self, x: str):
        """Insertions, then the row itself kept, rerolled or deleted."""
        at = LETTERS.index(x)
        best: dict = {}

        def offer(i, j, cost, edits):
            best[i, j] = min(best.get((i, j), (NEVER, "")), (cost, edits))
        for i in range(4):
            mid, state = [(i, "")], i
            for _ in range(2):      # a third insertion would come back to a state met before
                state = next(STEP[r, state] for r in "ua" if (r, state) in STEP)
                mid.append((state, mid[-1][1] + "I"))
            for m, edits in mid:
                cost = INSERT * len(edits)
                offer(i, m, cost + DELETE, edits + "D")
                if x == "X":
                    continue
                cost += CUT if at >= 4 else 0
                for r in "sua":
                    if (r, m) not in STEP:
                        continue
                    if r == "suao"[at % 4]:
                        offer(i, STEP[r, m], cost + KEEP, edits + "K")
                    if r != "s":
                        offer(i, STEP[r, m], cost + REROLE, edits + "R")
        order = {s: n for n, s in enumerate(sorted({s for _, s in best.values()}))}
        cost, rank = np.full((4, 4), NEVER, np.int64), np.zeros((4, 4), np.int64)
        for (i, j), (c, s) in best.items():
            cost[i, j], rank[i, j] = c, order[s]
            self.strings[x, i, j] = s
        return cost, rank, None

    def edits(self, name: str, i: int, j: int) -> str:
        """The edit string of an entry, read off its rope."""
        if (name, i, j) not in self.strings:
            k = int(self.entries[name][2][i, j])
            left, right = self.rules[name]
            self.strings[name, i, j] = self.edits(left, i, k) + self.edits(right, k, j)
        return self.strings[name, i, j]

    def compressed(self, letters: str) -> str:
        for name, (left, right) in self.rules.items():
            letters = letters.replace(left + right, name)
        return letters


def product(a, b):
    """Of two neighbouring stretches, the matrix of both: smallest cost, then first in ASCII."""
    cost = a[0][:, :, None] + b[0][None, :, :]
    key = cost * 256 + a[1][:, :, None] * 16 + b[1][None, :, :]
    mid = key.argmin(1)
    least = np.take_along_axis(key, mid[:, None, :], 1)[:, 0, :]
    cost = np.minimum(least >> 8, NEVER)
    rank = np.unique(np.where(cost < NEVER, least & 255, 256), return_inverse=True)[1]
    return cost, rank.reshape(4, 4), mid


class Stretch:
    """Product over a stretch of letters, with what its ropes need."""

    def __init__(self, matrices: Matrices, letters: str):
        self.m, self.names = matrices, matrices.compressed(letters)
        self.mids, total = [], None
        for x in self.names:
            entry = matrices.entries[x]
            total = entry if total is None else product(total, entry)
            self.mids.append(total[2])
        self.cost, self.rank = total[:2]

    def edits(self, i: int, j: int) -> str:
        out = []
        for x, mid in zip(self.names[:0:-1], self.mids[:0:-1]):
            k = int(mid[i, j])
            out.append(self.m.edits(x, k, j))
            j = k
        return self.m.edits(self.names[0], i, j) + "".join(reversed(out))


def _pairs(batches, rules):
    """Neighbours in compressed stretches, how often each stands without overlap."""
    m = Matrices(rules)
    total: dict = {}
    for b in batches:
        for letters, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = m.compressed(letters)
            for pair in set(map("".join, zip(s, s[1:]))):
                total[pair] = total.get(pair, 0) + n * s.count(pair)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())],
                                         ["pair", "n"])


def grammar(stretches: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[tuple[str, str]]:
    """Rules of Re-Pair over the distinct values of column ``letters``, parts before wholes. A round
    takes the most frequent pairs at once; what reaches the driver is ``pairs`` rows a round."""
    distinct = written(stretches.groupBy("letters").agg(F.count(F.lit(1)).alias("n")), "stretches")
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        top = (distinct.mapInArrow(lambda it, r=tuple(rules): _pairs(it, r), "pair string, n long")
               .groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
               .orderBy(F.desc("n"), "pair").limit(pairs).collect())
        if not top:
            break
        rules += [(r.pair[0], r.pair[1]) for r in top]
    return rules


def _stretches(batches, rules):
    """Matrices of stretches as lists of 16, with what neighbours need to know."""
    m = Matrices(rules)
    known = lru_cache(1 << 14)(lambda letters: Stretch(m, letters))
    for b in batches:
        out: list = [[] for _ in range(2)]
        for letters in b.column("letters").to_pylist():
            s = known(letters)
            out[0].append(s.cost.ravel().tolist())
            out[1].append(s.rank.ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.int64()))],
            [*b.schema.names, "cost", "rank"])


def best_path(stretches) -> tuple[int, list[tuple[int, int]]]:
    """From (cost, rank) of a conversation's stretches in order: the least cost, and the states
    before and after each stretch on the way that comes first in ASCII."""
    cost = np.array([0, NEVER, NEVER, NEVER], np.int64)
    rank = np.zeros(4, np.int64)
    back = []
    for c, r in stretches:
        key = (cost[:, None] + c) * 256 + rank[:, None] * 16 + r
        mid = key.argmin(0)
        least = key[mid, np.arange(4)]
        back.append(mid.astype(np.int8))
        cost = np.minimum(least >> 8, NEVER)
        rank = np.unique(np.where(cost < NEVER, least & 255, 256), return_inverse=True)[1]
    total, _, j = min((int(cost[j]) + INSERT * len(CLOSE[j]), int(rank[j]), j) for j in range(4))
    path = []
    for mid in reversed(back):
        i = int(mid[j])
        path.append((i, j))
        j = i
    return total, path[::-1]


def _runs(batches, key: str):
    """Rows of equal ``key``, which stand together, one run at a time."""
    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and r[key] != at:
                yield held
                held = []
            at = r[key]
            held.append(r)
    if held:
        yield held


def _chains(batches, rules):
    m = Matrices(rules)
    known = lru_cache(1 << 14)(lambda letters: Stretch(m, letters))
    names = ["conv", "block", "edits", "close", *COUNTS]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6)
    for rows in _runs(batches, "conv"):
        total, path = best_path((np.array(r["cost"]).reshape(4, 4), np.array(r["rank"]).reshape(4, 4))
                                for r in rows)
        turns = sum(r["turns"] for r in rows)
        ends = [(r["first_turn"], r["last_turn"]) for r in rows if r["turns"]]
        turns -= sum(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        illegal = sum(r["illegal"] for r in rows) + sum(
            a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        told = (total, ends[-1][1] - ends[0][0] + 1 - turns if ends else 0, illegal,
                *[sum(r[c] for r in rows) for c in COUNTS[3:]])
        for lo in range(0, len(rows), 256):
            part = zip(range(lo, lo + 256), rows[lo:lo + 256], path[lo:lo + 256])
            out = [(r["conv"], r["block"], known(r["letters"]).edits(i, j),
                    *((CLOSE[j], *told) if n == len(rows) - 1 else ("", *[0] * 6))) for n, r, (i, j) in part]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)


def _digests(batches):
    """Per conversation the whole audit and the digest of the repaired rows, which pass by once."""
    names = ["conv", "audit", "repaired_sha256", *COUNTS]
    done: list = []
    conv = object()
    audit, sha, state, edits, at, rows_end, first, ends = [], None, START, "", 0, 0, True, None

    def put(role, text):
        nonlocal first
        sha.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
        first = False

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = ASSISTANT if state == USER else USER
            put("assistant" if state == ASSISTANT else "user", "")
            at += 1

    def ended():
        if sha is not None:
            done.append((conv, "".join(audit), sha.hexdigest(), *ends))

    for b in batches:
        for r in b.to_pylist():
            if sha is None or r["conv"] != conv:
                ended()
                conv, audit, sha = r["conv"], [], hashlib.sha256()
                state, first, ends = START, True, (0,) * 6
            if r["edits"] is not None:      # comes before the rows of its stretch
                edits, at, rows_end = r["edits"] + r["close"], 0, len(r["edits"])
                audit.append(edits)
                ends = tuple(x + r[c] for x, c in zip(ends, COUNTS))
                continue
            inserted()
            edit = edits[at]
            at += 1
            if edit != "D":
                if edit == "K":
                    role = r["role"]
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                else:
                    state = ASSISTANT if state == USER else USER
                    role = "assistant" if state == ASSISTANT else "user"
                put(role, r["text"])
            if at >= rows_end:
                inserted()                  # what closes the repair
        if len(done) > 2000:
            yield _batch(done, names)
            done = []
    ended()
    if done:
        yield _batch(done, names)


def _batch(rows, names):
    kinds = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, at, blank, cut, h1, h2), written in order of ``at``."""
    role_, text_ = (F.coalesce(c, F.lit(" ")) for c in (role, text))
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                        role_.alias("role"), text_.alias("text"))
    # the last key deals out rows that are equal in all others
    keys = ["conv", "turn", "role", "text", "tie"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.withColumn("tie", F.monotonically_increasing_id())
            .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("tie")
            .withColumn("at", F.monotonically_increasing_id()))
    last = F.regexp_extract("text", f"(?s)([^{SPACE}])[{SPACE}]*\\z", 1)
    return written(rows.select(
        "*", last.alias("last"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")), "turns")


def letters(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, initial, fault, letter) of ordered rows."""
    full = F.col("last") != ""
    again = (rows.where(full).groupBy("conv", "h1", "h2")
             .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
             .select(F.col("conv").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first"))
    met = rows.select("conv", "at", "turn", "role", "last", "h1", "h2").join(
        again, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1"))
        & (F.col("h2") == F.col("_h2")), "left")
    fault = (F.when(~full, "blank").when(full & (F.col("at") > F.col("first")), "duplicate")
             .when(~F.col("last").isin(*".!?"), "truncated"))
    initial = F.substring("role", 1, 1)
    place = F.coalesce(F.nullif(F.instr(F.lit("sua"), initial), F.lit(0)), F.lit(4))
    place = F.when(initial == "", F.lit(4)).otherwise(place)
    letter = (F.when(F.col("fault").isin("blank", "duplicate"), "X")
              .otherwise(F.substr(F.lit(LETTERS), place + F.when(F.col("fault") == "truncated", 4).otherwise(0),
                                  F.lit(1))))
    return (met.withColumn("fault", fault)
            .select("conv", "at", "turn", initial.alias("initial"), "fault", letter.alias("letter")))


def stretches(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per stretch: its letters, and counts and ends that neighbours are joined by."""
    one = F.struct("at", "letter", "turn", "initial", "fault")
    got = (marked.groupBy("conv", F.expr(f"at div {block}").alias("block"))
           .agg(F.array_sort(F.collect_list(one)).alias("r")))
    turns = F.filter(F.col("r.turn"), lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r")),
                       lambda a, b: F.concat(a["initial"], b["initial"]).isin("su", "ua", "au"))

    def count(values, test):
        return F.size(F.filter(values, test)).cast("long")

    def fault_is(kind):
        return lambda x: x == kind
    return got.select(
        "conv", "block", F.array_join("r.letter", "").alias("letters"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
        F.try_element_at(turns, F.lit(1)).alias("first_turn"),
        F.try_element_at(turns, F.lit(-1)).alias("last_turn"),
        F.element_at("r.initial", 1).alias("first_role"), F.element_at("r.initial", -1).alias("last_role"),
        count(pairs, lambda legal: ~legal).alias("illegal"),
        *[count(F.col("r.fault"), fault_is(k)).alias(k) for k in COUNTS[3:]])


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row
    per conversation that has rows."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ordered(turns, conv, turn, role, text)
    marked = written(letters(rows), "letters")
    parts = written(stretches(marked, block), "blocks")
    rules = tuple(grammar(parts))
    kind = parts.schema.simpleString()[7:-1]
    known = parts.mapInArrow(lambda it: _stretches(it, rules), f"{kind},cost:array<bigint>,rank:array<bigint>")
    counts = ",".join(f"{c} long" for c in COUNTS)
    plans = (known.repartition(n, "conv").sortWithinPartitions("conv", "block")
             .mapInArrow(lambda it: _chains(it, rules), f"conv long,block long,edits string,close string,{counts}"))
    texts = rows.select("conv", F.expr(f"at div {block}").alias("block"), "at", "role", "text")
    both = plans.withColumn("at", F.lit(-1).cast("long")).unionByName(texts, allowMissingColumns=True)
    told = (both.repartition(n, "conv").sortWithinPartitions("conv", "block", "at")
            .select("conv", "role", "text", "edits", "close", *COUNTS)
            .mapInArrow(_digests, f"conv long,audit string,repaired_sha256 string,{counts}"))
    return told.select(F.col("conv").alias(conv), *COUNTS, "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """Rows with faults set by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes away its ``.!?``, 3 repeats it, 4 makes its role ``user``. Nulls are one space,
    but for the turn, which only counts as one in the key."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(key.cast("binary")) % 20
    role_, text_ = (F.coalesce(c, F.lit(" ")) for c in (role, text))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(text_, ".!?", "")).otherwise(text_)
    return turns.select(
        F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(role_).alias(role),
        new_text.alias(text), F.explode(F.array_repeat(F.lit(0), times))).select(conv, turn, role, text)
