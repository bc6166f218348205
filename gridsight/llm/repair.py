"""Repair of conversation structure: the cheapest edits that give the role pattern (s?(ua)+)?, by grammar-compressed DP.

Every row becomes one of nine symbols: the initial of its role (system, user, assistant, other), in capitals if it is
truncated, or x if it must go (blank, or a duplicate). A conversation is then a short text, and equal texts are solved once.
Re-Pair replaces the most frequent pair of neighbouring symbols by a rule, again and again, across all sequences of a
task's share. A rule has one min-plus transfer matrix over the four states of the role pattern: the cost of the cheapest
edits from state to state, with their audit, a rope that shares its parts with those of other rules. Matrices are made
bottom-up, once per rule; a sequence is a product of the few matrices that are left of it.

Among edits of one cost the ASCII-least audit wins. No audit is the beginning of another of the same cost and states (what
is more would be insertions, which cost), so the order of two audits stays when both are continued, and rules can be
solved on their own.

Rows are put in order by Spark's sort (turn, nulls first; then role, then the digest of role and text), which spills, and read as
a stream: a conversation of any length keeps one byte per row in memory, which its audit has anyway. Duplicates are found
by a partial aggregate and a join on (conversation, digest). Texts are shuffled once, for the digest of the repaired
conversation, which only a stream in order can give.

Null roles and texts count as one space. A null conversation id is a conversation. Rows that repeat (same turn, role and text)
are duplicates of each other. Ids without any row left give zeros, an empty audit and the digest of the empty text.
An empty table gives an empty result. Other columns are ignored.
"""
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.common import col
from .common import in_batches, join_counted, stored

# States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a user or assistant row that a repair puts there.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
SYMBOLS = b"suaoSUAOx"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MOST_RULES = 1024
CHUNK_SYMBOLS = 1 << 20


class Rope:
    """A text made of two others, which it does not copy."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self):
        return self.size

    def __str__(self):
        return "".join(leaves([self]))


def leaves(stack):
    """The plain texts of ropes, from the last of ``stack`` to the first."""
    while stack:
        rope = stack.pop()
        while isinstance(rope, Rope):
            stack.append(rope.right)
            rope = rope.left
        yield rope


def join(a, b):
    """a + b; short texts are joined outright."""
    if not len(a) or not len(b):
        return a if len(a) else b
    return str(a) + str(b) if len(a) + len(b) <= 32 else Rope(a, b)


def less(a, b):
    """Whether text ``a`` comes before ``b``; parts that both share at the same place are not read."""
    left, right = [a], [b]
    while left and right:
        if left[-1] is right[-1]:
            left.pop()
            right.pop()
            continue
        x, y = left.pop(), right.pop()
        if isinstance(x, Rope) and (not isinstance(y, Rope) or len(x) >= len(y)):
            left += [x.right, x.left]
            right.append(y)
        elif isinstance(y, Rope):
            right += [y.right, y.left]
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] if len(x) > n else []
            right += [y[n:]] if len(y) > n else []
    return not any(map(len, left)) and any(map(len, right))


def better(new, old):
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def times(a, b):
    """The min-plus product of two matrices of (cost, audit) or None."""
    out = [[None] * len(b[0]) for _ in a]
    for p, row in enumerate(a):
        for r, cell in enumerate(row):
            if cell is None:
                continue
            for q, more in enumerate(b[r]):
                if more is not None and (out[p][q] is None or cell[0] + more[0] <= out[p][q][0]):
                    new = (cell[0] + more[0], join(cell[1], more[1]))
                    if better(new, out[p][q]):
                        out[p][q] = new
    return out


def insertions():
    """The cheapest insertions from state to state; going round the pattern once is enough."""
    out = [[None] * 4 for _ in STATES]
    for p in STATES:
        q, cost, audit = p, 0, ""
        for _ in range(4):
            if out[p][q] is None:
                out[p][q] = (cost, audit)
            q, cost, audit = NEXT[q], cost + INSERT, audit + "I"
    return out


def row_matrix(symbol):
    """What may be done with one row."""
    out = [[None] * 4 for _ in STATES]

    def offer(p, q, cost, audit):
        if better((cost, audit), out[p][q]):
            out[p][q] = (cost, audit)

    initial, fault = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for p in STATES:
        offer(p, p, DELETE, "D")
        if symbol != "x":
            offer(p, NEXT[p], REROLE + fault, "R")
            if initial == "s" and p == START:
                offer(p, SYSTEM, KEEP + fault, "K")
            if initial == "ua"[p == USER]:
                offer(p, NEXT[p], KEEP + fault, "K")
    return out


def base_matrices():
    before = insertions()
    return [times(before, row_matrix(chr(s))) for s in SYMBOLS]


def re_pair(sequences, most_rules=MOST_RULES):
    """(rules, sequences): each rule is a pair of symbols, later ones may use earlier ones; symbol 9 + i is rule i."""
    sizes = [len(s) for s in sequences]
    data = np.full(sum(sizes) + len(sizes), -1, dtype=np.int64)
    at = np.cumsum([0] + [n + 1 for n in sizes])[:-1]
    table = np.full(256, -1, dtype=np.int64)
    table[list(SYMBOLS)] = np.arange(len(SYMBOLS))
    for a, s in zip(at, sequences):
        data[a:a + len(s)] = table[np.frombuffer(s, dtype=np.uint8)]
    rules = []
    while len(rules) < most_rules:
        width = len(SYMBOLS) + len(rules)
        joined = np.where((data[:-1] >= 0) & (data[1:] >= 0), data[:-1] * width + data[1:], -1)
        counts = np.bincount(joined[joined >= 0], minlength=1)
        best = int(counts.argmax())
        if counts[best] < 2:
            break
        place = np.nonzero(joined == best)[0]
        if best // width == best % width:
            # In a run of one symbol every other place is a pair of its own.
            run = np.concatenate(([0], np.cumsum(np.diff(place) != 1)))
            first = place[np.concatenate(([True], np.diff(run) != 0))][run] if len(place) else place
            place = place[(place - first) % 2 == 0]
        rules.append((best // width, best % width))
        data[place] = width
        data = np.delete(data, place + 1)
    ends = np.nonzero(data == -1)[0]
    return rules, [data[a:b] for a, b in zip(np.concatenate(([0], ends[:-1] + 1)), ends)]


def solve(sequences, most_rules=MOST_RULES):
    """The cost and audit of the best repair of each sequence (bytes of SYMBOLS)."""
    rules, short = re_pair(sequences, most_rules)
    matrices = base_matrices()
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    last = insertions()
    out = []
    for sequence in short:
        state = [[(0, ""), None, None, None]]
        for symbol in sequence.tolist():
            state = times(state, matrices[symbol])
        state = times(state, last)[0]
        best = None
        for q in ENDS:
            if state[q] is not None and better(state[q], best):
                best = state[q]
        out.append((best[0], str(best[1])))
    return out


def repaired(audit, rows):
    """The texts ``role:text`` after the edits of ``audit`` on ``rows`` (role, text), one at a time."""
    state, rows = START, iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{'user' if state == USER else 'assistant'}:"
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = SYSTEM if role[:1] == "s" else NEXT[state]
        else:
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        yield f"{role}:{text}"


WHITE = "\\x20\\x09-\\x0D"
ORDER = ["conv_null", "conv", "turn_null", "turn", "role", "digest", "copy"]


def _rows(turns, names, copy=None):
    """(conv, turn, role, text, copy, digest, ...) in the columns that the jobs below sort and compare."""
    conv, turn, role, text = (col(n) for n in names)
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(conv.alias("conv"), turn.alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), (col(copy) if copy else F.lit(0)).alias("copy"))
    digest = F.unhex(F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    return rows.withColumn("digest", digest).withColumn("conv_null", F.col("conv").isNotNull()).withColumn("turn_null", F.col("turn").isNotNull())


def symbols(rows):
    """A stored table (conv, turn..., symbol parts) without texts: role initial, fault by itself, first row of its digest."""
    last = F.regexp_extract("text", f"([^{WHITE}])[{WHITE}]*$", 1)
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    narrow = rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), F.when(blank, "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))
    narrow = stored(narrow, "repair-rows")
    first = narrow.groupBy("conv", "digest").agg(F.min(F.struct("turn_null", "turn", "role", "copy")).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    joined = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    own = F.struct("turn_null", "turn", "role", "copy")
    return joined.select(*ORDER, "initial", "fault", (own.eqNullSafe(F.col("first"))).alias("is_first"))


def _streams(batches, names):
    """The rows of sorted batches as tuples."""
    return chain.from_iterable(zip(*(b.column(n).to_pylist() for n in names)) for b in batches)


def sequences(marked):
    """(conv, rows, gaps, blank, duplicate, truncated, illegal, sequence) of each conversation with rows."""
    kind = dict(marked.dtypes)["conv"]
    dealt = marked.repartition("conv").sortWithinPartitions(*ORDER)

    def run(batches):
        ready, conv_type = [], None

        def flush():
            made = [pa.array([r[0] for r in ready], conv_type), *(pa.array([r[i] for r in ready], pa.int64()) for i in range(1, 7)), pa.array([r[7] for r in ready], pa.binary())]
            ready.clear()
            return pa.RecordBatch.from_arrays(made, names=["conv", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "sequence"])

        one = None
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, turn, digest, initial, fault, is_first in _streams([batch], ["conv", "turn", "digest", "initial", "fault", "is_first"]):
                if one is None or one["conv"] != conv:
                    if one is not None:
                        ready.append(_summary(one))
                    one = {"conv": conv, "rows": 0, "least": None, "most": None, "turns": 0, "last": None, "digest": None, "initial": "", "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "sequence": bytearray()}
                _add(one, turn, digest, initial, fault, is_first)
            if ready:
                yield flush()
        if one is not None:
            ready.append(_summary(one))
            yield flush()

    return in_batches(dealt).mapInArrow(run, f"conv {kind}, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, sequence binary")


def _add(one, turn, digest, initial, fault, is_first):
    """One more row of a conversation."""
    if turn is not None:
        one["least"] = turn if one["least"] is None else one["least"]
        one["turns"] += one["last"] != turn
        one["most"] = turn
    if fault != "blank" and (not is_first or (digest == one["digest"] and turn == one["last"])):
        fault = "duplicate"
    if fault:
        one[fault] += 1
    if one["rows"]:
        one["illegal"] += one["initial"] + initial not in ("su", "ua", "au")
    one["last"], one["digest"], one["initial"], one["rows"] = turn, digest, initial, one["rows"] + 1
    mark = initial if initial in ("s", "u", "a") else "o"
    one["sequence"] += ("x" if fault in ("blank", "duplicate") else mark.upper() if fault else mark).encode()


def _summary(one):
    gaps = 0 if one["most"] is None else one["most"] - one["least"] + 1 - one["turns"]
    return one["conv"], one["rows"], gaps, one["blank"], one["duplicate"], one["truncated"], one["illegal"], bytes(one["sequence"])


def solved(found, chunk_symbols=CHUNK_SYMBOLS):
    """(sequence, times, cost, audit) of each distinct sequence: a grammar for every ``chunk_symbols`` of a task's share."""
    distinct = stored(found.groupBy("sequence").agg(F.count(F.lit(1)).alias("times")), "repair-sequences")

    def run(batches):
        for some in _chunks(batches, chunk_symbols):
            answers = solve([s for s, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64()), pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())], names=["sequence", "times", "cost", "audit"])

    return stored(in_batches(distinct.repartition("sequence")).mapInArrow(run, "sequence binary, times long, cost long, audit string"), "repair-solved")


def _chunks(batches, most):
    held, size = [], 0
    for row in _streams(batches, ["sequence", "times"]):
        held.append(row)
        size += len(row[0])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def digest_of_repairs(rows, answers):
    """(conv, sha): the digest of each repaired conversation. The audit leads the sorted rows of its conversation."""
    kind = dict(rows.dtypes)["conv"]
    turn_kind = dict(rows.dtypes)["turn"]
    body = rows.select(*ORDER, F.col("text"), F.lit(None).cast("string").alias("audit"))
    lead = answers.select(
        F.col("conv").isNotNull().alias("conv_null"), "conv", F.lit(False).alias("turn_null"), F.lit(None).cast(turn_kind).alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(-1).alias("copy"), F.lit(None).cast("string").alias("text"), "audit")
    both = lead.unionByName(body).withColumn("own", F.col("audit").isNull())
    dealt = both.repartition("conv").sortWithinPartitions("conv_null", "conv", "own", *ORDER[2:])

    def conversations(batches):
        """(conv, audit, rows) one after the other; the rows are a stream."""
        stream = _streams(batches, ["conv", "role", "text", "audit"])
        lead = next(stream, None)
        while lead is not None:
            following = [None]

            def mine():
                for row in stream:
                    if row[3] is not None:
                        following[0] = row
                        return
                    yield row[1], row[2]

            rows = mine()
            yield lead[0], lead[3], rows
            for _ in rows:
                pass
            lead = following[0]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        conv_type = first.schema.field("conv").type
        ready = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], conv_type), pa.array([r[1] for r in ready], pa.string())], names=["conv", "sha"])
        for conv, audit, mine in conversations(chain([first], batches)):
            sha = hashlib.sha256()
            for i, line in enumerate(repaired(audit, mine)):
                sha.update((b"\n" if i else b"") + line.encode())
            ready.append((conv, sha.hexdigest()))
            if len(ready) >= 4096:
                yield pack()
                ready = []
        if ready:
            yield pack()

    return in_batches(dealt).mapInArrow(run, f"conv {kind}, sha string")


def repair(turns, names=("conv_id", "turn", "role", "text"), copy=None):
    """(conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of each conversation that has rows.

    ``copy`` may name a column of numbers that puts repeats of a row after it."""
    rows = _rows(turns, names, copy)
    found = stored(sequences(symbols(rows)), "repair-conversations")
    answers = stored(join_counted(found, solved(found), "sequence", "times", F.length("audit") <= 4096).drop("sequence", "times"), "repair-answers")
    shas = digest_of_repairs(rows, answers.select("conv", "audit")).withColumnRenamed("conv", "c")
    return answers.join(shas, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def damage(turns, names=("conv_id", "turn", "role", "text")):
    """The rows after the task's damage, chosen by crc32 of ``conv:turn``: dropped, emptied, without closing marks, repeated, or given to the user."""
    conv, turn, role, text = (col(n) for n in names)
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = turns.select(conv.alias("conv"), turn.alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(F.col("conv").alias(names[0]), F.col("turn").alias(names[1]), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias(names[2]), text.alias(names[3]), copies.alias("copy"))


def repair_all(turns, damaged, names=("conv_id", "turn", "role", "text")):
    """``repair`` of the damaged rows (see ``damage``) for every conversation of ``turns``, with zeros for those that have no row left."""
    ids = turns.select(col(names[0]).alias("conv")).distinct()
    found = repair(damaged, names, "copy").withColumnRenamed("conv", "c")
    counts = ["rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col("conv").eqNullSafe(F.col("c")), "left").select(
        "conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("sha"))
