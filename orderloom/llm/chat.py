"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then one canonical rendering for each turn.

Method. A transcript is a run of lines; nothing tells where its turns begin. The states are the roles, each beginning a turn,
going on with it, or at a blank line in it; a line emits a speaker marker and line features. The model is counted from labelled
turns, with add-one smoothing, for each way of parting turns apart, as a transcript keeps to one way. Viterbi finds the best states of a whole transcript exactly, of many transcripts at once; where
one is longer than a block of lines, each block becomes a max-plus matrix from the state before it to its last state, the
matrices are chained, and then each block is traced back between its two known states.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, key_of, materialise, range_running, table

#: Lines in a block, and lines that one task call works on at once (as many blocks as that takes).
BLOCK = 1024
LINES = 50_000
#: States of a role: at the first line of a turn, at a later one, at a later one that is blank.
BEGIN, INSIDE, GAP = range(3)
#: Speaker markers: fixed words that open a turn in common transcript styles.
MARKERS = {
    "system": ("system", "context", "setup"),
    "user": ("user", "human", "q", "question", "customer", "instruction", "prompt"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "model"),
}
_MARKER = re.compile(r"\s*(?:#{1,6}\s*|\*{1,2}|\[|<\|?)?(%s)(?:\|?>|\]|\*{1,2})?(?:\s*:\*{0,2}|(?<=[>\]*]))\s*" % "|".join(w for ws in MARKERS.values() for w in sorted(ws, key=len, reverse=True)), re.IGNORECASE)
_HEADING = re.compile(r"\s*#{1,6}\s*(%s)\s*$" % "|".join(w for ws in MARKERS.values() for w in ws), re.IGNORECASE)
_CLASS = {w: i + 1 for i, ws in enumerate(MARKERS.values()) for w in ws}
#: Lengths from which a line falls into the next class.
LENGTHS = (1, 15, 25, 40, 60, 90, 140, 200, 300, 450, 700)
#: Values that each feature of a line can have: marker class, question, length, list or code.
FEATURES = (len(MARKERS) + 1, 2, len(LENGTHS) + 1, 2)
#: Ways in which a transcript parts its turns, each with states of its own: by markers, by blank lines, or not at all.
WAYS = 3


def marker(line: str) -> tuple[int, str]:
    """(class of the speaker marker, 0 for none; the line without it)."""
    m = _MARKER.match(line) or _HEADING.match(line)
    return (_CLASS[m[1].lower()], line[m.end() :]) if m else (0, line)


def features(line: str) -> tuple[int, ...]:
    kind, rest = marker(line)
    return kind, int(rest.rstrip().endswith("?")), bisect_right(LENGTHS, len(rest)), int(rest.lstrip()[:2] in ("- ", "* ", "``", "1."))


@dataclass
class RoleModel:
    """roles (of each way of parting turns); start (3 * roles), step (3 * roles, 3 * roles) and, by feature, emit (3 * roles, values): log probabilities. State 3 * r + BEGIN, INSIDE or GAP is of role r."""

    roles: list[str]
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """(lines, states) of the lines' features (lines, len(FEATURES))."""
        return sum(e[:, rows[:, i]].T for i, e in enumerate(self.emit))


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _count_lines(t: pa.Table, n: int) -> np.ndarray:
    """Counts by state and feature value, by state and next state of the same turn, and by last state, flat, of labelled turns (columns slot, the number of their way and role, and raw)."""
    counts = [np.zeros((n, k)) for k in FEATURES]
    step, last = np.zeros((n, n)), np.zeros(n)
    for r, raw in zip(t["slot"].to_pylist(), t["raw"].to_pylist(), strict=True):
        before = None
        for i, line in enumerate(_lines(raw)):
            state = 3 * r + (BEGIN if i == 0 else INSIDE if line.strip() else GAP)
            for c, v in zip(counts, features(line), strict=True):
                c[state, v] += 1
            if before is not None:
                step[before, state] += 1
            before = state
        last[before] += 1
    return np.concatenate([c.ravel() for c in [*counts, step, last]])


def _marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(x)[0] > 0 for x in texts])


def ways(rows: DataFrame) -> DataFrame:
    """conv_id, way of the labelled turns' transcripts: 0 if half of their turns or more begin with a marker, else 1 if half or more end in a blank line, else 2."""
    text = F.coalesce("raw", F.lit(""))
    marked = F.pandas_udf(_marked, "boolean")(F.substring_index(text, "\n", 1))
    blank = F.regexp_like(F.substring_index(text, "\n", -1), F.lit(r"^\s*$"))
    shares = rows.select("conv_id", marked.cast("int").alias("_marked"), blank.cast("int").alias("_blank")).groupBy("conv_id").agg(F.avg("_marked").alias("m"), F.avg("_blank").alias("b"))
    return shares.select("conv_id", F.when(F.col("m") >= 0.5, 0).when(F.col("b") >= 0.5, 1).otherwise(2).alias("way"))


def fit_roles(turns: DataFrame) -> RoleModel | None:
    """The model of labelled turns (conv_id, turn, role, raw), counted over all of them; None without any.

    Rows of null role, conversation or turn are passed over. Repeated rows count as often as they come. A transcript keeps to
    one way of parting its turns, so each way that the labelled transcripts have gets states, transitions and emissions of its own,
    and no step leads from one to another. The model has three states for each way and distinct role, so roles must be a
    small vocabulary: its size goes with their number squared.
    """
    rows = turns.filter("role IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    roles = sorted(r[0] for r in rows.select("role").distinct().collect())  # the states of the model
    if not roles:
        return None
    index = {r: i for i, r in enumerate(roles)}
    found = materialise(ways(rows), "ways")
    # a turn that several rows repeat is one place in the order of roles
    places = rows.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("last"))
    pairs = places.join(before, ["conv_id", "turn"], "left").join(found, "conv_id").groupBy("way", "last", "role").agg(F.count(F.lit(1)).alias("n")).collect()  # at most WAYS * (roles + 1) * roles
    n = 3 * len(roles) * WAYS

    def count(batches):
        total = 0
        for b in batches:
            total = total + _count_lines(pa.Table.from_batches([b]), n)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    sizes = [*[n * k for k in FEATURES], n * n, n]
    flat = np.zeros(sum(sizes))
    number = F.create_map(*[F.lit(x) for r, i in index.items() for x in (r, i)])
    slots = rows.join(found, "conv_id").select((F.col("way") * len(roles) + number[F.col("role")]).alias("slot"), "raw")
    for r in slots.mapInArrow(count, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row a state and value
        flat[r["k"]] = r["n"]
    *emit, inner, last = np.split(flat, np.cumsum(sizes)[:-1])
    emit = [np.log((p.reshape(n, -1) + 1) / (p.reshape(n, -1) + 1).sum(axis=1, keepdims=True)) for p in emit]
    inner = inner.reshape(n, n)
    known = {r["way"]: r["n"] for r in found.groupBy("way").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, step = np.zeros(n), np.zeros((n, n))
    for way, share in known.items():
        own = slice(3 * len(roles) * way, 3 * len(roles) * (way + 1))
        turn = np.ones((len(roles) + 1, len(roles)))
        for r in pairs:
            if r["way"] == way:
                turn[len(roles) if r["last"] is None else index[r["last"]], index[r["role"]]] += r["n"]
        turn /= turn.sum(axis=1, keepdims=True)
        for k in range(own.start, own.stop):
            r = k // 3
            goes_on = inner[k, 3 * r + 1 : 3 * r + 3] + 1
            total = goes_on.sum() + last[k] + 1
            step[k, 3 * r + 1 : 3 * r + 3] = goes_on / total
            step[k, own][::3] = (last[k] + 1) / total * turn[r % len(roles)]
        start[own][::3] = turn[-1] * share / sum(known.values())
    discard(found)
    with np.errstate(divide="ignore"):
        return RoleModel(roles * WAYS, np.log(start), np.log(step), emit)


def _by_length(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first lines, lengths) of units, longest first."""
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    return order, starts[:-1][order], size[order]


def block_matrices(model: RoleModel, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each unit (rows starts[i] to starts[i + 1] of the scores e): best scores from each state before it (the last row: from the start) to each state of its last line."""
    order, first, size = _by_length(starts)
    v = np.vstack([model.step, model.start])[None] + e[first][:, None, :]
    for t in range(1, size[0] if len(size) else 0):
        k = np.searchsorted(-size, -t)  # units longer than t
        v[:k] = (v[:k, :, :, None] + model.step).max(axis=2) + e[first[:k] + t][:, None, :]
    out = np.empty_like(v)
    out[order] = v
    return out


def best_paths(model: RoleModel, e: np.ndarray, starts: np.ndarray, entry: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best states of all lines of all units; entry: the state before a unit (-1: its transcript begins there); last: that of its last line (-1: the best)."""
    order, first, size = _by_length(starts)
    entry, last = entry[order], last[order]
    v = np.where((entry < 0)[:, None], model.start, model.step[np.maximum(entry, 0)]) + e[first]
    back = np.zeros(e.shape, "i2")
    for t in range(1, size[0] if len(size) else 0):
        k = np.searchsorted(-size, -t)
        w = v[:k, :, None] + model.step
        back[first[:k] + t] = w.argmax(axis=1)
        v[:k] = w.max(axis=1) + e[first[:k] + t]
    states = np.zeros(len(e), "i8")
    now = np.where(last < 0, v.argmax(axis=1), last) if len(v) else last
    for t in range((size[0] if len(size) else 0) - 1, -1, -1):
        k = np.searchsorted(-size, -t)
        states[first[:k] + t] = now[:k]
        now[:k] = back[first[:k] + t, now[:k]]
    return states


def render(role: str, lines: list[str], goes_on: bool) -> str:
    """The canonical turn: a role line, then the content without markers; a part that goes on with a turn has no role line."""
    text = "\n".join(marker(x)[1] if i == 0 and not goes_on else x for i, x in enumerate(lines)).strip()
    return text if goes_on else f"<|{role}|>\n{text}"


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lines in batches:
        yield pd.Series([features(x) for x in lines], dtype=object)


def _units(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(lines in order, starts of the blocks, features) of a bucket of blocks."""
    t = t.sort_by([("_conv", "ascending"), ("_at", "ascending")]).combine_chunks()
    conv, block = t["_conv"].to_numpy(), t["_block"].to_numpy()
    starts = np.concatenate([np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])), [len(t)]])
    return t, starts, np.array(t["_f"].to_pylist(), "i8").reshape(len(t), len(FEATURES))


def parse_transcripts(turns: DataFrame, model: RoleModel | None) -> DataFrame:
    """A row for each turn found in the transcripts that the rows of turns (conv_id, turn, raw) make up in order of turn.

    The rows are pieces of one text, joined by line ends; where a piece begins tells the model nothing. Columns: conv_id,
    start_turn and start_line (the piece and its line where the turn begins), role, goes_on (the turn began before a block's
    edge), n_lines, text (canonical). Null raw: an empty line. Null turn: before all others. Null conv_id: one transcript of
    its own. Ties in turn go by a hash of the text; repeated rows are lines again. A table without rows, or no model (nothing
    labelled), gives no rows. Roles come from the model alone. Other columns of turns are left out.
    """
    schema = f"conv_id {dict(turns.dtypes)['conv_id']}, start_turn long, start_line int, role string, goes_on boolean, n_lines int, text string"
    if model is None:
        return turns.sparkSession.createDataFrame([], schema)
    split = F.split(F.coalesce("raw", F.lit("")), "\n")
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "raw").withColumns({"_conv": key_of(F.col("conv_id")), "_order": F.coalesce(F.col("turn").cast("long"), F.lit(-1)), "_tie": F.xxhash64("raw"), "_n": F.size(split).cast("long")})
    # line numbers of a transcript; one may hold a third of all rows, so they come from sums over parts
    numbered, parts = range_running(own, ["_conv"], ["_order", "_tie"], "_n", "_end")
    lines = numbered.select("conv_id", "_conv", "turn", (F.col("_end") - F.col("_n")).alias("_from"), F.posexplode(split).alias("_i", "_line"))
    lines = lines.select("conv_id", "_conv", "turn", "_i", "_line", (F.col("_from") + F.col("_i")).alias("_at"), F.pandas_udf(_features, "array<int>").asNondeterministic()("_line").alias("_f"))
    lines = materialise(lines.withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("long")), "lines")
    discard(numbered, parts)

    def matrices(t: pa.Table) -> pa.Table:
        t, starts, f = _units(t)
        m = block_matrices(model, model.scores(f), starts)
        return pa.table({"_conv": t["_conv"].take(pa.array(starts[:-1])), "_block": t["_block"].take(pa.array(starts[:-1])), "_m": pa.array([x.ravel().tolist() for x in m], pa.list_(pa.float64()))})

    def chained(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        n = len(model.start)
        v, back = None, []
        for m in t["_m"].to_pylist():
            m = np.array(m).reshape(n + 1, n)
            if v is None:
                v = m[n]
            else:
                w = v[:, None] + m[:n]
                back.append(w.argmax(axis=0))
                v = w.max(axis=0)
        ends = [int(v.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pa.table({"_conv": t["_conv"], "_block": t["_block"], "_entry": pa.array([-1, *ends[:-1]], pa.int32()), "_last": pa.array(ends, pa.int32())})

    def traced(t: pa.Table) -> pa.Table:
        t, starts, f = _units(t)
        entry, last = (t[c].to_numpy()[starts[:-1]] for c in ("_entry", "_last"))
        states = best_paths(model, model.scores(f), starts, entry, last)
        opens = states % 3 == BEGIN
        cut = opens.copy()
        cut[starts[:-1]] = True
        cuts = np.append(np.flatnonzero(cut), len(t))
        text = t["_line"].to_pylist()
        roles = [model.roles[s // 3] for s in states[cuts[:-1]]]
        goes_on = ~opens[cuts[:-1]]
        at = pa.array(cuts[:-1])
        return pa.table({
            "conv_id": t["conv_id"].take(at), "start_turn": t["turn"].take(at), "start_line": t["_i"].take(at), "role": pa.array(roles, pa.string()), "goes_on": pa.array(goes_on), "n_lines": pa.array(np.diff(cuts), pa.int32()),
            "text": pa.array([render(r, text[a:z], bool(g)) for r, a, z, g in zip(roles, cuts, cuts[1:], goes_on, strict=False)], pa.string()),
        })

    buckets = lines.count() // LINES + 1
    bucket = F.pmod(F.xxhash64("_conv", "_block"), F.lit(buckets)).alias("_bucket")
    # transcripts of more than one block
    long = materialise(lines.filter("_block > 0").select("_conv").distinct(), "long")
    if long.isEmpty():
        ended = lines.withColumns({"_entry": F.lit(-1), "_last": F.lit(-1)})
    else:
        parts = lines.join(long, "_conv", "left_semi").withColumn("_bucket", bucket)
        ends = materialise(parts.groupBy("_bucket").applyInArrow(matrices, "_conv string, _block long, _m array<double>"), "matrices")
        ends = materialise(ends.groupBy("_conv").applyInArrow(chained, "_conv string, _block long, _entry int, _last int"), "ends")
        ended = lines.join(ends, ["_conv", "_block"], "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("_entry", "_last")})
    return ended.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(traced, schema)


#: Styles of the transcripts that the registered query parses: markers of (user, assistant, system); BLANK: none, turns apart by a blank line; None: none at all.
BLANK = "blank"
STYLES = (("User: ", "Assistant: ", "System: "), ("### Instruction:\n", "### Response:\n", "### System:\n"), ("Human: ", "AI: ", "Context: "), ("**Q:** ", "**A:** ", "[system] "), BLANK, None)


def style_of(conv_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), conv_id), F.lit(len(STYLES)))


def raw_turn(conv_id: Column, role: Column, text: Column) -> Column:
    """The turn as a transcript has it: its text behind its role's marker, in a style that goes by the conversation."""
    style, out = style_of(conv_id), text
    for k, s in enumerate(STYLES):
        if s == BLANK:
            out = F.when(style == k, F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))).otherwise(out)
        elif s:
            mark = F.when(role == "user", s[0]).when(role == "assistant", s[1]).when(role == "system", s[2]).otherwise("")
            out = F.when(style == k, F.concat(mark, F.coalesce(text, F.lit("")))).otherwise(out)
    return out


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts made of the conversations, in six styles, parsed by a model of three quarters of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", raw_turn(F.col("conv_id"), F.col("role"), F.col("text")).alias("raw"))
    known = turns.filter(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)) != 2)
    return parse_transcripts(turns, fit_roles(known))
