"""Repair of conversations: the cheapest edits that give their turns a legal order, by block tables (Four Russians).

A conversation is a string of row symbols, and a state after each row says what the roles so far allow next. The cost to
the end from every state is a vector; up to its least entry only few vectors exist. So a table holds, for each vector
after a block of four symbols and each such block, the vector before it. Blocks are looked up from the end to the start; a
block is expanded, backward, only where its edits are written down, and there the least letter that still reaches the
least cost wins.

Rows are numbered by one range sort and cut into chunks, so that a conversation of any length spreads over tasks: a chunk
gives its cost from state to state, a scan over these gives the vector behind each chunk and the state before it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import drop_staged, partitions, returning, staged

#: Costs of the edits, and of a truncated row that stays.
RETELL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system's row, after the user's, after the assistant's. It may end in the first and the last.
STATES, START, ENDS = 4, 0, (0, 3)
#: The state that a user's or an assistant's row leads to; after a user's row the assistant is due, else the user.
TOLD = (2, 2, 3, 2)
#: Of a row kept, by the class of its role (s, u, a, any other): the states it may follow and the state it leads to.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Symbols: the class of the role, 4 more if truncated; a row that must go; the filling of the last block.
GONE, FILLING, SYMBOLS = 8, 9, 10
BLOCK = 4
FAR = 1 << 24
#: Bits of a row's number within its chunk.
CHUNK_BITS = 12


def closed(costs: list[int]) -> list[int]:
    """Costs to the end where rows may be inserted first."""
    costs = list(costs)
    for _ in range(STATES):
        costs = [min(costs[q], INSERT + costs[TOLD[q]]) for q in range(STATES)]
    return costs


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in ascending order of their letter: letter (and role told), cost, state after it."""
    yield "D", DELETE, state
    if symbol < GONE:
        more = TRUNCATED if symbol >= 4 else 0
        if state in KEPT[symbol % 4]:
            yield "K", more, KEPT[symbol % 4][state]
        yield "R" + "ua"[TOLD[state] == 3], RETELL + more, TOLD[state]


def before(costs: list[int], symbol: int) -> list[int]:
    """Costs to the end before a row, from those behind it."""
    if symbol == FILLING:
        return list(costs)
    return closed([min(cost + costs[to] for _, cost, to in choices(symbol, q)) for q in range(STATES)])


class Tables:
    """Every normalised cost vector that can occur, and what each block of symbols makes of it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        unit = [[0 if q == end else FAR for q in range(STATES)] for end in range(STATES)]
        self.units = [self.number(closed(x))[0] for x in unit]
        self.end, _ = self.number(closed([0 if q in ENDS else FAR for q in range(STATES)]))
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):  # new ones are appended meanwhile
            costs = list(self.vectors[len(steps)])
            steps.append([self.number(before(costs, symbol)) for symbol in range(SYMBOLS)])
        self.step = np.array(steps, np.int32)
        blocks = np.array(list(itertools.product(range(SYMBOLS), repeat=BLOCK)))
        self.block = np.repeat(np.arange(len(steps), dtype=np.int32)[:, None], len(blocks), 1)
        self.cost = np.zeros_like(self.block)
        for k in reversed(range(BLOCK)):
            found = self.step[self.block, blocks[:, k]]
            self.block, self.cost = found[..., 0], self.cost + found[..., 1]
        self.traced: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    def number(self, costs: list[int]) -> tuple[int, int]:
        """Number of the normalised vector, and what was taken off."""
        least = min(costs)
        vector = tuple(x - least if x < FAR else FAR for x in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    def codes(self, symbols: str) -> list[int]:
        full = symbols + str(FILLING) * (-len(symbols) % BLOCK)
        return [int(full[k : k + BLOCK]) for k in range(0, len(full), BLOCK)]

    def costs(self, strings: list[str]) -> np.ndarray:
        """Least cost of each string from every state to every state (far where there is no way)."""
        codes = [self.codes(x) for x in strings]
        number = np.array([len(x) for x in codes], np.int64)
        begin = np.cumsum(number) - number
        flat = np.array(list(itertools.chain.from_iterable(codes)), np.int64)
        now = np.tile(np.array(self.units, np.int32), (len(strings), 1))
        spent = np.zeros(now.shape, np.int64)
        for k in reversed(range(int(number.max(initial=0)))):
            own = np.nonzero(number > k)[0]
            code = flat[begin[own] + k][:, None]
            spent[own] += self.cost[now[own], code]
            now[own] = self.block[now[own], code]
        vectors = np.array(self.vectors, np.int64)[now]  # string, end, start
        return np.where(vectors >= FAR, FAR, vectors + spent[:, :, None]).transpose(0, 2, 1)

    def edits(self, behind: int, code: int, state: int) -> tuple[tuple[str, ...], int]:
        """Edits of each row of a block before the vector `behind`, ASCII-least among the cheapest, and the state after it."""
        key = behind, code, state
        if key not in self.traced:
            symbols = [int(x) for x in str(code).zfill(BLOCK)]
            costs = [list(self.vectors[behind])]
            for symbol in reversed(symbols):
                costs.append(before(costs[-1], symbol))
            costs.reverse()
            out = []
            for k, symbol in enumerate(symbols):
                if symbol == FILLING:
                    continue
                letters = ""
                while True:
                    now = costs[k][state]
                    options = {edit: to for edit, cost, to in choices(symbol, state) if cost + costs[k + 1][to] == now}
                    if "D" not in options and INSERT + costs[k][TOLD[state]] == now:
                        letters += "I" + "ua"[TOLD[state] == 3]
                        state = TOLD[state]
                        continue
                    edit = min(options)
                    letters, state = letters + edit, options[edit]
                    break
                out.append(letters)
            self.traced[key] = tuple(out), state
        return self.traced[key]

    def trace(self, symbols: str, behind: int, start: int) -> tuple[list[str], int]:
        """Edits of all rows of a string before the vector `behind` (number), and the state after it."""
        codes = self.codes(symbols)
        vectors = [behind]
        for code in reversed(codes):
            vectors.append(int(self.block[vectors[-1], code]))
        vectors.reverse()
        out, state = [], start
        for k, code in enumerate(codes):
            found, state = self.edits(vectors[k + 1], code, state)
            out += found
        return out, state

    def tail(self, state: int) -> str:
        """Insertions behind the last row."""
        out = ""
        while state not in ENDS:
            out += "I" + "ua"[TOLD[state] == 3]
            state = TOLD[state]
        return out


@functools.cache
def tables() -> Tables:
    return Tables()


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` deals; nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    own = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, numbered by `at`; staged, so that the numbers stay.

    Null turns come first; rows of one turn go by role, then by a hash of the text. Equal rows differ in nothing, so any
    order of them is right: the number of the input row splits even these over tasks.
    """
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h"), F.asc("n")]
    placed = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return staged(placed.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text"), "numbered")


def faults(placed: DataFrame) -> DataFrame:
    """at, conv_id, turn, the first fault of each row (blank, duplicate, truncated or null) and its role's class."""
    first = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    small = placed.select("at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return small.join(first, "at", "left").select("at", "conv_id", "turn", fault.alias("fault"), kind.alias("kind"))


def chunked(marked: DataFrame) -> DataFrame:
    """conv_id, chunk, number of its first row, symbols and role classes as strings: at most 2^12 rows each."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.col("kind") + 4).otherwise(F.col("kind"))
    rows = marked.select("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk"), "at", symbol.cast("string").alias("symbol"), F.col("kind").cast("string").alias("kind"))
    sorted_rows = F.array_sort(F.collect_list(F.struct("at", "symbol", "kind")))
    joined = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    return rows.groupBy("conv_id", "chunk").agg(F.min("at").alias("at"), sorted_rows.alias("rows")).select("conv_id", "chunk", "at", joined("symbol").alias("symbols"), joined("kind").alias("kinds"))


def _behind(chunks: DataFrame) -> DataFrame:
    """Each chunk with the number of the cost vector behind it, and whether it is its conversation's first and last.

    A scan over chunk costs, last chunk first; a task holds one vector.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = tables().costs(batch.column("symbols").to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(costs), pa.list_(pa.int64()))], names=[*batch.schema.names, "costs"])

    kind = dict(chunks.dtypes)["conv_id"]
    columns = f"conv_id {kind}, chunk long, at long, symbols string, kinds string"
    costs = chunks.mapInArrow(returning(summed), f"{columns}, costs array<long>")
    order = [F.asc_nulls_first("conv_id"), F.desc("chunk")]
    placed = costs.repartition(partitions(chunks.sparkSession), "conv_id").sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vector, held = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last = own != (row["conv_id"],)
                if last:
                    own, vector = (row["conv_id"],), closed([0 if q in ENDS else FAR for q in range(STATES)])
                number, _ = tables().number(vector)
                vector = [min(row["costs"][q * STATES + to] + vector[to] for to in range(STATES)) for q in range(STATES)]
                row |= {"behind": number, "last": last, "first": False}
                del row["costs"]
                if held:
                    held["first"] = last
                    out.append(held)
                held = row
            yield pa.RecordBatch.from_pylist(out, schema=schema_of(batch))
        if held:
            held["first"] = True
            yield pa.RecordBatch.from_pylist([held], schema=schema_of(batch))

    def schema_of(batch: pa.RecordBatch) -> pa.Schema:
        fields = [batch.schema.field(c) for c in ("conv_id", "chunk", "at", "symbols", "kinds")]
        return pa.schema([*fields, ("behind", pa.int32()), ("last", pa.bool_()), ("first", pa.bool_())])

    return placed.mapInArrow(scan, f"{columns}, behind int, last boolean, first boolean")


def _edits(chunks: DataFrame) -> DataFrame:
    """conv_id, at, the edits of the row there, and pairs of roles in illegal order up to it (at the chunk's first row).

    Every chunk is traced from each state it may start in; a scan in order picks the one.
    """
    kind = dict(chunks.dtypes)["conv_id"]
    fine = {"01", "12", "21"}

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, illegal = [], []
            for row in batch.to_pylist():
                ways.append([way for start in ([START] if row["first"] else range(STATES)) if (way := trace(row, start))])
                illegal.append(sum(a + b not in fine for a, b in itertools.pairwise(row["kinds"])))
            arrays = [*(batch.column(c) for c in ("conv_id", "chunk", "at", "kinds", "first")), pa.array(ways, WAYS), pa.array(illegal, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "chunk", "at", "kinds", "first", "ways", "illegal"])

    def trace(row: dict, start: int) -> dict | None:
        t = tables()
        number = row["behind"]
        for code in reversed(t.codes(row["symbols"])):
            number = int(t.block[number, code])
        if t.vectors[number][start] >= FAR:
            return None
        edits, end = t.trace(row["symbols"], row["behind"], start)
        if row["last"]:
            edits[-1] += t.tail(end)
        return {"start": start, "end": end, "edits": edits}

    ways = "array<struct<start: int, end: int, edits: array<string>>>"
    found = chunks.mapInArrow(returning(traced), f"conv_id {kind}, chunk long, at long, kinds string, first boolean, ways {ways}, illegal long")
    placed = found.repartition(partitions(chunks.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, role = START, ""
        for batch in batches:
            conv, at, edits, illegal = [], [], [], []
            for row in batch.to_pylist():
                if row["first"]:
                    state, role = START, ""
                way = next(w for w in row["ways"] if w["start"] == state)
                conv += [row["conv_id"]] * len(way["edits"])
                at += range(row["at"], row["at"] + len(way["edits"]))
                edits += way["edits"]
                across = bool(role) and role + row["kinds"][0] not in fine
                illegal += [row["illegal"] + across] + [0] * (len(way["edits"]) - 1)
                state, role = way["end"], row["kinds"][-1]
            arrays = [pa.array(conv, batch.schema.field("conv_id").type), pa.array(at, pa.int64()), pa.array(edits, pa.string()), pa.array(illegal, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "at", "edits", "illegal"])

    return placed.mapInArrow(scan, f"conv_id {kind}, at long, edits string, illegal long")


WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("edits", pa.list_(pa.string()))]))


def repaired(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of the repaired conversations and those deleted: conv_id, at, step, edit (D, I, K, R), role, text.

    `at`, `step` order the rows of a conversation; `edit` D marks rows that are gone, inserted rows have an empty text.
    """
    tokens = edits.select("at", F.posexplode(F.regexp_extract_all("edits", F.lit("[DK]|[RI][ua]"), 0)).alias("step", "token"))
    told = F.when(F.col("token").endswith("u"), "user").when(F.col("token").endswith("a"), "assistant").otherwise(F.col("role"))
    edit = F.substring("token", 1, 1)
    return placed.join(tokens, "at").select("conv_id", "at", "step", edit.alias("edit"), told.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, audit (edits in order) and SHA-256 of the repaired `role:text` lines. Texts stream; one hash state is held."""
    kind = dict(rows.dtypes)["conv_id"]
    placed = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letters, state, lines = None, [], hashlib.sha256(), 0
        for batch in batches:
            out = []
            for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if own != (conv,):
                    if own:
                        out.append((own[0], "".join(letters), state.hexdigest()))
                    own, letters, state, lines = (conv,), [], hashlib.sha256(), 0
                letters.append(edit)
                if edit != "D":
                    state.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                    lines += 1
            yield made(out, batch)
        if own:
            yield made([(own[0], "".join(letters), state.hexdigest())], batch)

    def made(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.schema.field("conv_id").type, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], names=["conv_id", "audit", "repaired_sha256"])

    return placed.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def solved(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of conversation rows (conv_id, turn, role, text): numbered rows, their faults and their edits, all staged."""
    placed = numbered(rows)
    marked = staged(faults(placed), "faults")
    behind = staged(_behind(chunked(marked)), "chunks")
    edits = staged(_edits(behind), "edits")
    drop_staged(behind)
    return placed, marked, edits


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of any rows with conv_id, turn, role and text (see `repaired`); nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed, _, edits = solved(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text")))
    return repaired(placed, edits)


def repair_report(convs: DataFrame) -> DataFrame:
    """One row for each conv_id of `convs`, whose rows are damaged first (see `damaged`) and then repaired.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is one
    conversation; null turns come first and leave no gap; an empty role, as any that begins otherwise than s, u or a, can't
    be kept. Conversations that lose all rows have zeros, an empty audit and the hash of nothing. Rows that repeat a row
    are duplicates. Further columns are ignored; an empty table gives no rows.
    """
    placed, marked, edits = solved(damaged(convs))
    count = lambda c: F.count_if(F.col("fault") == c).alias(c)
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    seen = marked.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    letters = lambda x: F.length("edits") - F.length(F.translate("edits", x, ""))
    stays = F.when((F.col("fault") == "truncated") & ~F.col("edits").contains("D"), TRUNCATED).otherwise(0)
    spent = RETELL * letters("R") + DELETE * letters("D") + INSERT * letters("I") + stays
    priced = edits.join(marked.select("at", "fault"), "at").groupBy("conv_id").agg(F.sum(spent).cast("long").alias("cost"), F.sum("illegal").alias("illegal"))
    written = digests(repaired(placed, edits))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = convs.select("conv_id").distinct()
    for part in (seen, priced, written):
        parts = parts.unionByName(part, allowMissingColumns=True)
    whole = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return whole
