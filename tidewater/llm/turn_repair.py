"""Conversation structure repair: cheapest edits by a parallel Viterbi search whose chunks converge in rank.

Rows are dealt in the order of their conversation, so a long conversation lies
in chunks on many tasks.  A chunk works backwards from a guessed vector of
costs to go, one entry per state of the role pattern.  In fix-up passes it
takes the vector with which the next chunk begins and steps back with the new
and the old one side by side, until they differ by a constant only: from there
on the old work holds.  Passes end when no chunk's vector moves otherwise.
The stitched vectors then drive the trace of the least audit, for each state a
chunk can be entered in; the states themselves follow by composing those maps.

A conversation that ends within its task and fits one chunk needs no guess and
is finished where it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.staging import write_stage

CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 20
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5

# States: nothing yet, after s, after u, after a.  FED[state] is the state after the user or assistant turn that may follow, KEPT[role][state] after a kept row.
FED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NOWHERE = (None, None, None, None)
SPOKEN = {2: "user", 3: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)

# Kinds of a row: sound, blank, duplicate, truncated.
SOUND, BLANK, DUPLICATE, TRUNCATED = b"-bdt"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with one row in twenty each dropped, emptied, stripped of full stops, repeated, given to the user.

    A null role or text counts as one space, also a null identifier or turn
    where the rows are drawn.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20)).alias("__fault"))
    d = d.where("__fault != 0").withColumns({
        "role": F.when(F.col("__fault") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "__copy": F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return d.select("conv_id", "turn", "role", "text")


def back(vector: tuple, role: str, kind: int) -> tuple:
    """Costs to go before a row, from those after it."""
    gone = [c + DELETE for c in vector]
    if kind not in (BLANK, DUPLICATE):
        more = CUT_OFF if kind == TRUNCATED else 0
        for q, to in enumerate(KEPT.get(role, NOWHERE)):
            gone[q] = min(gone[q], vector[FED[q]] + REROLE + more, *([] if to is None else [vector[to] + more]))
    for _ in range(2):
        gone = [min(c, gone[FED[q]] + INSERT) for q, c in enumerate(gone)]
    return tuple(gone)


def alike(a: tuple, b: tuple) -> bool:
    """Equal but for a constant."""
    return len({x - y for x, y in zip(a, b)}) == 1


def backwards(roles: str, kinds: bytes, end: tuple) -> list[tuple]:
    vectors = [end]
    for role, kind in zip(reversed(roles), reversed(kinds)):
        vectors.append(back(vectors[-1], role, kind))
    return vectors[::-1]


def fixed_up(roles: str, kinds: bytes, old_end: tuple, old_start: tuple, end: tuple) -> tuple:
    """The vector at the start of a chunk for a new vector at its end; stops where old and new differ by a constant."""
    for i in range(len(roles) - 1, -1, -1):
        if alike(end, old_end):
            return tuple(c + end[0] - old_end[0] for c in old_start)
        end, old_end = back(end, roles[i], kinds[i]), back(old_end, roles[i], kinds[i])
    return end


def trace(roles: str, kinds: bytes, vectors: list[tuple], state: int, last: bool) -> tuple[str, int, int]:
    """(audit, cost, state after): the ASCII-least of the cheapest edits from ``state`` on."""
    audit, cost, i, n = [], 0, 0, len(roles)
    while i < n:
        here, after, more = vectors[i][state], vectors[i + 1], CUT_OFF if kinds[i] == TRUNCATED else 0
        to = KEPT.get(roles[i], NOWHERE)[state]
        if here == after[state] + DELETE:
            audit.append("D")
            cost, i = cost + DELETE, i + 1
        elif here == vectors[i][FED[state]] + INSERT:
            audit.append("I")
            cost, state = cost + INSERT, FED[state]
        elif to is not None and here == after[to] + more:
            audit.append("K")
            cost, i, state = cost + more, i + 1, to
        else:
            audit.append("R")
            cost, i, state = cost + REROLE + more, i + 1, FED[state]
    while last and state in (1, 2):
        audit.append("I")
        cost, state = cost + INSERT, FED[state]
    return "".join(audit), cost, state


def spoken(audit: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit leaves."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = FED[state]
            out.append((SPOKEN[state], ""))
            continue
        if edit == "K":
            state = KEPT[rows[i][0][0]][state]
            out.append(rows[i])
        elif edit == "R":
            state = FED[state]
            out.append((SPOKEN[state], rows[i][1]))
        i += 1
    return out


def kind_of(text: str) -> int:
    body = text.rstrip(WHITE)
    return BLANK if not body else SOUND if body[-1] in ".!?" else TRUNCATED


# What one piece of a conversation shows: the rows of one task, up to a bound. ``rows`` are the repaired ones of a closed piece, else those found.
PIECE = (
    "conv string, closed boolean, place long, low long, high long, turns long, roles string, kinds string, illegal long, keys array<binary>,"
    " cost long, audit string, rows array<struct<role: string, text: string>>"
)
FIELDS = [c.split()[0] for c in PIECE.split("<struct")[0].split(",")]


def piece(found: list[tuple], place: int, closed: bool) -> tuple:
    """``found`` rows of one conversation in order, as (conv, turn or None, role, text, key)."""
    kinds, seen, keys = bytearray(), set(), []
    for _, _, _, text, key in found:
        kind = kind_of(text)
        if kind != BLANK and key in seen:
            kind = DUPLICATE
        kinds.append(kind)
        keys.append(None if kind in (BLANK, DUPLICATE) else key)
        if kind != BLANK:
            seen.add(key)
    rows = [(r[2], r[3]) for r in found]
    roles = "".join(role[:1] or " " for role, _ in rows)
    turns = {r[1] for r in found if r[1] is not None}
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))
    head = (found[0][0], closed, place, min(turns, default=None), max(turns, default=None), len(turns), roles, kinds.decode(), illegal)
    if not closed:
        return *head, keys, None, None, rows
    audit, cost, _ = trace(roles, kinds, backwards(roles, kinds, END), 0, True)
    return *head, None, cost, audit, spoken(audit, rows, 0)


def pieces(ordered: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """One row per conversation that lies whole in its task and fits one chunk, else one per chunk of it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        inner, whole = False, True  # inner: another conversation came before; whole: held begins with its own
        size, place = 0, TaskContext.get().partitionId() << 33  # ranges ascend with the partition, so places follow the order of rows

        def out(closed: bool) -> tuple:
            nonlocal held, size, place
            made, held, size, place = piece(held, place, closed), [], 0, place + 1
            return made

        for batch in batches:
            done = []
            turns = [t if known else None for t, known in zip(batch["turn"].tolist(), batch["known"])]
            for row in zip(batch["conv"], turns, batch["role"], batch["text"], map(bytes, batch["key"])):
                if held and held[-1][0] != row[0]:
                    done.append(out(inner and whole))
                    inner, whole = True, True
                elif held and (len(held) >= chunk_rows or size >= chunk_chars):
                    done.append(out(False))
                    whole = False
                held.append(row)
                size += len(row[3])
            if done:
                yield pd.DataFrame(done, columns=FIELDS, dtype=object)
        if held:
            yield pd.DataFrame([out(False)], columns=FIELDS, dtype=object)

    return ordered.mapInPandas(cut, PIECE)


def repeated(chunks: DataFrame) -> DataFrame:
    """conv, ord, at: rows whose role and text an earlier chunk of the conversation has. A chunk sends each of its pairs once."""
    seen = chunks.select("conv", "ord", F.posexplode("keys").alias("at", "key")).where("key is not null")
    again = F.row_number().over(Window.partitionBy("conv", "key").orderBy("ord")) > 1
    return seen.withColumn("__again", again).where("__again").groupBy("conv", "ord").agg(F.collect_list("at").alias("at"))


def converged(chunks: DataFrame) -> DataFrame:
    """The chunks (conv, ord, last, roles, kinds) with ``used``, the costs to go at their end, right but for a constant.

    Only vectors and row kinds move; every pass is written, so a lost executor
    costs a task and not the passes before it.
    """
    light = chunks.select("conv", "ord", "last", "roles", "kinds", F.lit(list(END)).cast("array<bigint>").alias("used"))
    shape, schema = light.columns, ", ".join(f"{k} {v}" for k, v in light.dtypes) + ", start array<bigint>"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["start"] = [list(backwards(r, k.encode(), tuple(u))[0]) for r, k, u in zip(d["roles"], d["kinds"], d["used"])]
            yield d

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            each = zip(d["roles"], d["kinds"], *(map(tuple, d[c]) for c in ("used", "start", "end")))
            d["start"] = [list(fixed_up(r, k.encode(), u, s, e)) for r, k, u, s, e in each]
            d["used"] = d["end"]
            yield d[[*shape, "start"]]

    state = write_stage(light.mapInPandas(begin, schema), "vectors")
    order = Window.partitionBy("conv").orderBy("ord")
    while True:
        met = state.select("conv", "ord", "used", F.when(F.col("last"), F.col("used")).otherwise(F.lead("start").over(order)).alias("end"))
        moved = F.size(F.array_distinct(F.zip_with("end", "used", lambda x, y: x - y))) > 1
        met = write_stage(met.where(moved).select("conv", "ord", "end"), "moved")
        if met.isEmpty():
            return state.drop("start")
        both = state.join(met, ["conv", "ord"], "left")
        still = both.where("end is null").drop("end").select(*shape, "start")
        state = write_stage(still.unionByName(both.where("end is not null").mapInPandas(again, schema)), "vectors")


def entered(chunks: DataFrame) -> DataFrame:
    """conv, ord, state: where the least audit enters each chunk, by composing the chunks' maps of four states in order."""

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            worked = [(r, k.encode(), backwards(r, k.encode(), tuple(u)), last) for r, k, u, last in zip(d["roles"], d["kinds"], d["used"], d["last"])]
            yield d[["conv", "ord"]].assign(exits=[[trace(r, k, v, q, last)[2] for q in range(4)] for r, k, v, last in worked])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = 0
        for d in batches:
            states = []
            for n, to in zip(d["ord"], d["exits"]):
                states.append(0 if n == 1 else state)
                state = int(to[states[-1]])
            yield d[["conv", "ord"]].assign(state=states)

    exits = chunks.mapInPandas(maps, "conv string, ord int, exits array<int>")
    return exits.repartition("conv").sortWithinPartitions("conv", "ord").mapInPandas(walk, "conv string, ord int, state int")


def traced(chunks: DataFrame) -> DataFrame:
    """Chunks with their states entered -> conv, ord, last, cost, audit, rows as repaired."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            done = []
            for r, k, u, last, q, rows in zip(*(d[c] for c in ("roles", "kinds", "used", "last", "state", "rows"))):
                audit, cost, _ = trace(r, k.encode(), backwards(r, k.encode(), tuple(u)), int(q), last)
                done.append((cost, audit, spoken(audit, [(x["role"], x["text"]) for x in rows], int(q))))
            yield pd.concat([d[["conv", "ord", "last"]], pd.DataFrame(done, columns=["cost", "audit", "rows"])], axis=1)

    return chunks.mapInPandas(read, "conv string, ord int, last boolean, cost long, audit string, rows array<struct<role: string, text: string>>")


def repair(rows: DataFrame, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) repaired at least cost so that their role initials give (s?(ua)+)?.

    One row per conversation, or per chunk of a long one: conv_id, ord (from 1),
    last (its last chunk), gaps, blank, duplicate, truncated, illegal and cost
    (of the chunk; sums are those of the conversation), audit (the chunk's part)
    and rows, the repaired turns as (role, text).

    Rows are taken by turn (a long, null first), then role, then the text's
    digest, so the order of ``rows`` doesn't matter; a null role or text counts
    as one space, and rows of a null conv_id are one conversation.  Repeated
    rows are duplicates, an empty or white text is blank, an empty table gives
    no rows, other columns are left out.  A task holds one chunk, whatever the
    length of a conversation; rows equal in all four columns meet in one task,
    where they stream.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), shown("role").alias("role"), shown("text").alias("text"))
    d = d.withColumn("key", F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)), 1, 16))
    order = ("conv", "known", "turn", "role", "key")
    n = partitions or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = write_stage(pieces(d.repartitionByRange(n, *order).sortWithinPartitions(*order), chunk_rows, chunk_chars), "pieces")

    whole = found.where("closed").withColumns({"ord": F.lit(1), "last": F.lit(True)})
    open_ = found.where("not closed")
    inside = Window.partitionBy("conv").orderBy("place")
    before = lambda c: F.lag(c).over(inside)
    seam, again = F.concat(before("final"), F.left("roles", F.lit(1))), F.coalesce(before("high") == F.col("low"), F.lit(False))
    # One small row a chunk goes through the window.
    met = open_.select("conv", "place", "low", "high", "turns", "illegal", F.left("roles", F.lit(1)).alias("roles"), F.right("roles", F.lit(1)).alias("final"))
    met = met.select(
        "conv", "place", F.row_number().over(inside).alias("ord"), F.lead("place").over(inside).isNull().alias("last"),
        (F.col("illegal") + F.coalesce(~seam.isin("su", "ua", "au"), F.lit(False)).cast("long")).alias("illegal"),
        # Gaps of a later chunk run from the turn before it.
        F.coalesce(before("high") + 1, F.col("low")).alias("low"), "high", (F.col("turns") - again.cast("long")).alias("turns"))
    light = write_stage(met.join(open_.select("place", "roles", "kinds", "keys"), "place"), "chunks")
    kinds = F.array_join(F.transform(F.split("kinds", ""), lambda k, i: F.when(F.array_contains("at", i), "d").otherwise(k)), "")
    kinds = F.when(F.col("at").isNull(), F.col("kinds")).otherwise(kinds)
    light = write_stage(light.join(repeated(light), ["conv", "ord"], "left").withColumn("kinds", kinds).drop("at", "keys"), "chunks")
    ready = write_stage(light.join(converged(light).select("conv", "ord", "used"), ["conv", "ord"]), "chunks")
    told = traced(ready.join(entered(ready), ["conv", "ord"]).join(open_.select("place", "rows"), "place"))
    parts = ready.select("conv", "ord", "low", "high", "turns", "kinds", "illegal").join(told, ["conv", "ord"])

    count = lambda k: F.length(F.translate("kinds", "".join({"-", "b", "d", "t"} - {k}), "")).cast("long")
    return whole.select(*parts.columns).unionByName(parts).select(
        F.substring("conv", 2, 2**31 - 1).alias("conv_text"), "conv", "ord", "last",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), "illegal", "cost", "audit", "rows",
    ).withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv_text")).cast(dict(rows.dtypes)["conv_id"])).drop("conv", "conv_text")


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: sums, the whole audit and the hash of the repaired rows as role:text lines.

    Conversations of one chunk are hashed where they are; the texts of longer
    ones run through the hash in order, one chunk in memory.
    """
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    lines = F.array_join(F.transform("rows", line), "\n")
    sums = [F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    alone = (F.col("ord") == 1) & F.col("last")
    one = repaired.where(alone).withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).select(*names)
    more = repaired.where(~alone)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha, audit, begun = hashlib.sha256(), [], False
        for d in batches:
            done = []
            for conv, last, part, n, text in zip(d["conv"], d["last"], d["audit"], d["n"], d["text"]):
                if n:
                    sha.update(("\n" + text if begun else text).encode())
                    begun = True
                audit.append(part)
                if last:
                    done.append((conv, "".join(audit), sha.hexdigest()))
                    sha, audit, begun = hashlib.sha256(), [], False
            yield pd.DataFrame(done, columns=["conv", "audit", "repaired_sha256"])

    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    flat = more.select(conv, "ord", "last", "audit", F.size("rows").alias("n"), lines.alias("text"))
    told = flat.repartition("conv").sortWithinPartitions("conv", "ord").mapInPandas(hashed, "conv string, audit string, repaired_sha256 string")
    long_ = more.groupBy(conv).agg(F.first("conv_id").alias("conv_id"), *sums).join(told, "conv").select(*names)
    return one.unionByName(long_)
