"""Conversation structure repair: faults of every turn, and the cheapest edits to a well-formed conversation.

A well-formed conversation is empty, or a system turn if any and then user and assistant by turns, the
assistant last. Edits: keep a turn (0), give it the role user or assistant (3), delete it (4; blank and duplicate
turns have to go), insert an empty user or assistant turn (3); a turn cut short that stays costs 3 more. Of
equally cheap edits those whose letters (D, I, K, R) come first are taken.

Turns are put in order by one range partitioning, so a conversation that holds a third of all turns lies in
many tasks, as one run in each. A run tells its costs between states (``turn_lattice``), the runs of
a conversation, at most one per task, are joined to prices behind each run, and with them each run finds its
edits. Only the hash of a whole conversation is sequential by its nature: its repaired turns stream, sorted
by Spark, through one task that holds one batch.

* Null roles, texts, conversations and turns: a null role or text counts as one space (so such a text is blank), a
  null conversation is one of its own, null turns come first and don't count for gaps.
* Turns with one number are in the order of role and then of the md5 of role and text; equal turns are adjacent, and
  all but the first are duplicates. Turns are equal if their md5 is.
* An empty role has no initial, so its turn can't be kept as it is.
* Empty texts are blank; texts of any length are whole. Gaps beyond a long count as the largest long.
* Further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import turn_lattice as lattice
from quarrylight.llm.common import short_batches
from quarrylight.session import settle

BLANKS = " \t\n\v\f\r"
LEGAL_PAIRS = ((0, 1), (1, 2), (2, 1))
LONGEST = (1 << 63) - 1
#: Bits of a row's place that number it within its task (as Spark numbers rows).
TASK_SHIFT = 33


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one fault in five turns or so, by crc32 of ``conv_id:turn`` modulo 20."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(written("text"), "[.!?]", "")).otherwise(written("text"))
    role = F.when(case == 4, "user").otherwise(written("role"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies")).where("_copies > 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def placed_turns(turns: DataFrame) -> DataFrame:
    """Every turn with its fault, its code for the lattice and ``_at``, its place: a stored table.

    Equal turns are counted before they are dealt out, and the first of each text is found by an aggregation
    and joined by keys that are unique on either side, so no repeated turn gathers in a task.
    """
    short_batches(turns.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    bare = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), space("role").alias("_role"), space("text").alias("_text"))
    counted = bare.groupBy("_conv", "_turn", "_role", "_text").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_key", F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text")))
    first = F.min(F.struct(F.col("_turn").isNotNull().alias("numbered"), F.col("_turn").alias("turn")))
    firsts = counted.groupBy(F.col("_conv").alias("c"), F.col("_key").alias("k")).agg(first.alias("f"))
    same = F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_key") == F.col("k")) & F.col("_turn").eqNullSafe(F.col("f.turn"))
    marked = counted.join(firsts, same, "left").withColumn("_first", F.col("k").isNotNull()).drop("c", "k", "f")
    rows = marked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))

    end = F.right(F.rtrim("_text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(~F.col("_first") | (F.col("_copy") > 1), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("_fault", fault)
    initial = F.substring("_role", 1, 1)
    role = F.lit(lattice.OTHER)
    for letter, n in lattice.INITIALS.items():
        role = F.when(initial == letter, n).otherwise(role)
    flags = F.when(F.col("_fault") == "truncated", lattice.CUT_SHORT).when(F.col("_fault").isNotNull(), lattice.HAS_TO_GO).otherwise(0)
    order = ("_conv", "_turn", "_role", "_key", "_copy")
    rows = rows.select(*order, "_text", "_fault", (role + flags).cast("int").alias("_code"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return settle(rows.select("_conv", "_turn", "_role", "_text", "_fault", "_code", "_at"), "placed-turns")


def with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a run's neighbours have to know of it: costs between states, pairs out of order, roles at its ends."""
    for batch in batches:
        codes, costs, illegal = [], [], []
        for row in batch.column("_codes"):
            run = bytes(row.as_py())
            roles = [c & 3 for c in run]
            codes.append(run)
            costs.append(lattice.run_costs(run))
            illegal.append(sum(pair not in LEGAL_PAIRS for pair in zip(roles, roles[1:])))
        ends = [pa.array([run[place] & 3 for run in codes], pa.int32()) for place in (0, -1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_conv"), batch.column("_part"), batch.column("_from"), pa.array(codes, pa.binary()), pa.array(costs, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), *ends],
            ["_conv", "_part", "_from", "_codes", "_costs", "_illegal", "_head", "_last"],
        )


def with_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its cost, pairs out of order, and the prices behind each of its runs."""
    for batch in batches:
        cost, illegal, prices = [], [], []
        for row in batch.column("_runs"):
            runs = row.as_py()
            costs = [tuple(r["_costs"]) for r in runs]
            whole = lattice.tree(costs)[-1][0]
            cost.append(min(whole[s] + lattice.AT_END[s] for s in lattice.STATES))
            illegal.append(sum(r["_illegal"] for r in runs) + sum((a["_last"], b["_head"]) not in LEGAL_PAIRS for a, b in zip(runs, runs[1:])))
            behind = lattice.exit_prices(costs, lattice.AT_END)
            prices.append([{"part": r["_part"], "exits": list(e)} for r, e in zip(runs, behind)])
        kind = pa.list_(pa.struct([("part", pa.int64()), ("exits", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([batch.column("_conv"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(prices, kind)], ["_conv", "_cost", "_illegal", "_prices"])


def with_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run's letters and the state behind it, for each state before it."""
    for batch in batches:
        letters, states = [], []
        for codes, exits in zip(batch.column("_codes"), batch.column("_exits")):
            moves = lattice.run_moves(codes.as_py(), tuple(exits.as_py()))
            letters.append([m[0] if m else None for m in moves])
            states.append([m[1] if m else -1 for m in moves])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_conv"), batch.column("_part"), batch.column("_from"), pa.array(letters, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))],
            ["_conv", "_part", "_from", "_letters", "_states"],
        )


def with_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each run of a conversation, and the letters behind the last."""
    for batch in batches:
        entries, tails = [], []
        for row in batch.column("_runs"):
            state, found = lattice.START, []
            for run in row.as_py():
                found.append({"part": run["_part"], "entry": state})
                state = run["_states"][state]
            entries.append(found)
            tails.append(lattice.TAIL[state])
        kind = pa.list_(pa.struct([("part", pa.int64()), ("entry", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("_conv"), pa.array(entries, kind), pa.array(tails, pa.string())], ["_conv", "_entries", "_tail"])


def runs_in_order(runs: DataFrame, *columns: str) -> DataFrame:
    """One row per conversation with its runs, of which there is at most one per task that sorted turns."""
    return runs.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_part", *columns))).alias("_runs"))


def on_run(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joined by conversation, null ones included, and part."""
    keys = right.select(F.col("_conv").alias("c"), F.col("_part").alias("p"), *(c for c in right.columns if c not in ("_conv", "_part")))
    return left.join(keys, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_part") == F.col("p"))).drop("c", "p")


def solved(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_conv, _cost, _illegal, _tail`` per conversation and ``_conv, _part, _from, _letters`` per run, both stored."""
    kind = placed.schema["_conv"].dataType.simpleString()
    part = F.shiftright("_at", TASK_SHIFT)
    runs = placed.groupBy("_conv", part.alias("_part")).agg(F.min("_at").alias("_from"), F.sort_array(F.collect_list(F.struct("_at", "_code"))).alias("_rows"))
    runs = runs.select("_conv", "_part", "_from", F.col("_rows._code").alias("_codes"))
    runs = settle(runs.mapInArrow(with_costs, f"_conv {kind}, _part long, _from long, _codes binary, _costs array<long>, _illegal long, _head int, _last int"), "turn-runs")
    whole = runs_in_order(runs, "_costs", "_illegal", "_head", "_last")
    whole = settle(whole.mapInArrow(with_prices, f"_conv {kind}, _cost long, _illegal long, _prices array<struct<part:long,exits:array<long>>>"), "turn-costs")
    prices = whole.select("_conv", F.explode("_prices").alias("p")).select("_conv", F.col("p.part").alias("_part"), F.col("p.exits").alias("_exits"))
    moves = on_run(runs.select("_conv", "_part", "_from", "_codes"), prices).select("_conv", "_part", "_from", "_codes", "_exits")
    moves = settle(moves.mapInArrow(with_moves, f"_conv {kind}, _part long, _from long, _letters array<string>, _states array<int>"), "turn-moves")
    entered = settle(runs_in_order(moves, "_states").mapInArrow(with_entries, f"_conv {kind}, _entries array<struct<part:long,entry:int>>, _tail string"), "turn-entries")
    entries = entered.select("_conv", F.explode("_entries").alias("e")).select("_conv", F.col("e.part").alias("_part"), F.col("e.entry").alias("_entry"))
    chosen = on_run(moves, entries).select("_conv", "_part", "_from", F.get("_letters", F.col("_entry")).alias("_letters"))
    ends = entered.select(F.col("_conv").alias("c"), "_tail")
    return whole.join(ends, F.col("_conv").eqNullSafe(F.col("c"))).select("_conv", "_cost", "_illegal", "_tail"), settle(chosen, "turn-letters")


def edits(placed: DataFrame, conversations: DataFrame, runs: DataFrame) -> DataFrame:
    """Every turn with the letters of the inserts before it and its own, and what is inserted behind the last."""
    steps = runs.select("_conv", "_from", F.posexplode(F.regexp_extract_all("_letters", F.lit("[IJ]*[DKRS]"), 0)).alias("_nth", "_edit"))
    steps = steps.select((F.col("_from") + F.col("_nth")).alias("_at"), "_edit")
    own = placed.select("_at", "_conv", "_role", "_text").join(steps, "_at").select("_conv", "_at", "_role", "_text", "_edit")
    nothing = F.lit(None).cast("string")
    behind = conversations.where("_tail <> ''").select("_conv", F.lit(LONGEST).alias("_at"), nothing.alias("_role"), nothing.alias("_text"), F.col("_tail").alias("_edit"))
    return own.unionByName(behind)


def written(edit: Column, role: Column, text: Column) -> Column:
    """The repaired turns of one edit as ``role:text``, a newline before each."""
    inserted = F.replace(F.replace(F.regexp_extract(edit, "^[IJ]*", 0), F.lit("I"), F.lit("\nuser:")), F.lit("J"), F.lit("\nassistant:"))
    last = F.right(edit, F.lit(1))
    own = F.when(last == "K", F.concat(F.lit("\n"), role, F.lit(":"), text)).when(last == "R", F.concat(F.lit("\nuser:"), text)).when(last == "S", F.concat(F.lit("\nassistant:"), text))
    return F.concat(inserted, F.coalesce(own, F.lit("")))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, turn, role, text``, turns numbered from 0 without gaps.

    A running count by conversation numbers the turns, so Spark sorts each conversation's turns by place.
    """
    from pyspark.sql import Window

    placed = placed_turns(turns)
    rows = edits(placed, *solved(placed))
    role = F.when(F.col("x").isin("I", "R"), "user").when(F.col("x").isin("J", "S"), "assistant").otherwise(F.col("_role"))
    text = F.when(F.col("x").isin("I", "J"), "").otherwise(F.col("_text"))
    each = rows.select("_conv", "_at", "_role", "_text", F.posexplode(F.split("_edit", "")).alias("_nth", "x")).where("x <> 'D' AND x <> ''")
    number = F.row_number().over(Window.partitionBy("_conv").orderBy("_at", "_nth")) - 1
    return each.select(F.col("_conv").alias("conv_id"), number.alias("turn"), role.alias("role"), text.alias("text"))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the pieces of each conversation, which come in order; the newline before the first doesn't count."""
    key, open_hash, kind = None, None, None
    for batch in batches:
        kind = batch.column("_conv").type
        done: list[tuple[object, str]] = []
        for conv, piece in zip(batch.column("_conv").to_pylist(), batch.column("_piece").to_pylist()):
            data = piece.encode()
            if open_hash is None or conv != key:
                if open_hash is not None:
                    done.append((key, open_hash.hexdigest()))
                key, open_hash, data = conv, hashlib.sha256(), data[1:]
            open_hash.update(data)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done], pa.string())], ["_conv", "_sha"])
    if open_hash is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([open_hash.hexdigest()], pa.string())], ["_conv", "_sha"])


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    placed = placed_turns(turns)
    kind = placed.schema["_conv"].dataType.simpleString()
    conversations, runs = solved(placed)
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("_turn")) - wide(F.min("_turn")) + 1 - wide(F.countDistinct("_turn"))
    faults = [F.count_if(F.coalesce(F.col("_fault") == name, F.lit(False))).alias(name) for name in ("blank", "duplicate", "truncated")]
    counted = placed.groupBy("_conv").agg(F.least(F.coalesce(gaps, F.lit(0)), F.lit(LONGEST)).cast("long").alias("gaps"), *faults)

    pieces = edits(placed, conversations, runs).select("_conv", "_at", written(F.col("_edit"), F.col("_role"), F.col("_text")).alias("_piece")).where("_piece <> ''")
    pieces = pieces.repartition("_conv").sortWithinPartitions("_conv", "_at")
    shas = pieces.select("_conv", "_piece").mapInArrow(hashed, f"_conv {kind}, _sha string").select(F.col("_conv").alias("s"), "_sha")
    audits = runs_in_order(runs, "_letters").select(F.col("_conv").alias("a"), F.array_join("_runs._letters", "").alias("_letters"))
    costs = conversations.withColumnRenamed("_conv", "c")
    told = counted.join(costs, F.col("_conv").eqNullSafe(F.col("c"))).join(audits, F.col("_conv").eqNullSafe(F.col("a"))).join(shas, F.col("_conv").eqNullSafe(F.col("s")), "left")
    return told.select(
        F.col("_conv").alias("conv_id"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        F.col("_illegal").alias("illegal"),
        F.col("_cost").alias("cost"),
        F.translate(F.concat("_letters", "_tail"), "JS", "IR").alias("audit"),
        F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged turns, with a row for every conversation that was there before the damage."""
    mended = repair(damaged(turns)).withColumnRenamed("conv_id", "_m")
    every = turns.select("conv_id").distinct()
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    joined = every.join(mended, F.col("conv_id").eqNullSafe(F.col("_m")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *(zero(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
