"""Taste profiles: a fold over each user's rated events, in batch and as a stream.

What an event does is told by expressions, as a list of moves; the fold only applies them. A move changes one slot of a
profile: a preference (an attribute's name, 1 to 5) or a category (``~`` and its name, -1 to 1).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Steps of what a note says outright, the reach of a dislike, the least change that is reported, the start.
SIGNAL, FLAVOR_SIGNAL, REACH, REPORTED = 0.5, 0.3, 2.0, 0.05
START = 3.0

HISTORY = "n long, wants map<string,double>, likes map<string,double>, changes array<string>"
MOVES = "array<struct<slot: string, target: double, step: double, paced: boolean>>"


def moves(attributes: list[str], rating: Column, values: Column, shares: Column, signals: Column, liked: Column, disliked: Column) -> Column:
    """The moves of a rated event, in the order in which they are made.

    The rating's distance from the middle, as -1 to 1, is the event's pull; a pull of zero moves nothing. A preference moves
    between itself and the item's value (target), a category by its share. These are paced: the later the event, the
    smaller the step. What a note says outright is not: signals ("lower" or "higher" by attribute) and the categories
    that it likes and dislikes.
    """
    pull = (rating.cast("double") - 3) / 2
    move = lambda slot, target, step, paced: F.struct(
        slot.alias("slot"), target.cast("double").alias("target"), step.cast("double").alias("step"), F.lit(paced).alias("paced")
    )
    none, empty = F.lit(None), F.from_json(F.lit("[]"), MOVES)
    value = lambda a: F.try_element_at(values, F.lit(a))
    drawn = F.filter(F.array(*[move(F.lit(a), value(a), pull, True) for a in attributes]), lambda m: m["target"].isNotNull() & ~F.isnan(m["target"]))
    shared = F.transform(F.map_entries(shares), lambda e: move(F.concat(F.lit("~"), e["key"]), none, pull * e["value"], True))
    step = lambda a: F.when(F.try_element_at(signals, F.lit(a)) == "lower", -SIGNAL).when(F.try_element_at(signals, F.lit(a)) == "higher", SIGNAL)
    said = F.filter(F.array(*[move(F.lit(a), none, step(a), False) for a in attributes]), lambda m: m["step"].isNotNull())
    named = lambda which, by: F.transform(which, lambda c: move(F.concat(F.lit("~"), c), none, F.lit(by), False))
    parts = [F.when(pull != 0, drawn), F.when(pull != 0, shared), said, named(liked, FLAVOR_SIGNAL), named(disliked, -FLAVOR_SIGNAL)]
    return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))


def start_of(attributes: list[str]) -> dict[str, float]:
    return dict.fromkeys(attributes, START)


def moved(state: dict[str, float], n: int, event: Iterator[tuple]) -> list[str]:
    """Apply an event's (slot, target, step, paced) to a profile that has seen ``n`` events; the names of what changed noticeably."""
    before: dict[str, float] = {}
    for slot, target, step, paced in event:
        x = state.get(slot, 0.0)
        before.setdefault(slot, x)
        by = step
        if target is not None:
            gap = target - x
            # a liked item draws; a disliked one drives off, the more the nearer it is
            by *= gap if by > 0 else ((gap > 0) - (gap < 0)) * max(0.0, 1 - abs(gap) / REACH)
        if paced:
            by /= n + 2
        low, high = (-1.0, 1.0) if slot[0] == "~" else (1.0, 5.0)
        state[slot] = min(high, max(low, x + by))
    return [s.removeprefix("~") for s in state if s in before and abs(state[s] - before[s]) >= REPORTED]


def _rows(events: DataFrame, user: str, order: list[str], attributes: list[str]) -> DataFrame:
    """user, o0, o1, ... and moves of every event; columns that ``events`` lacks are NULL."""
    have = set(events.columns)
    own = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    told = moves(
        attributes, own("rating", "double"), own("values", "map<string,double>"), own("shares", "map<string,double>"), own("signals", "map<string,string>"),
        own("liked", "array<string>"), own("disliked", "array<string>"),
    )
    return events.select(F.col(user).alias("user"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], told.alias("moves"))


def _split(state: dict[str, float]) -> tuple[list, list]:
    """A profile's preferences and categories, as pairs."""
    return [x for x in state.items() if x[0][0] != "~"], [(k[1:], v) for k, v in state.items() if k[0] == "~"]


def history(events: DataFrame, user: str, order: list[str], attributes: list[str]) -> DataFrame:
    """(user, order, n, wants, likes, changes): the profile after each of a user's events, in order.

    ``events`` has rating and any of values, shares, signals, liked, disliked. Users are dealt to tasks and events sorted
    there; a task holds one profile and one batch of events at a time, however many events a user has.
    """
    rows = _rows(events, user, order, attributes)
    keys = ["user", *[f"o{i}" for i in range(len(order))]]
    kinds = {"n": pa.int64(), "wants": pa.map_(pa.string(), pa.float64()), "likes": pa.map_(pa.string(), pa.float64()), "changes": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, n = object(), {}, 0
        for batch in batches:
            lists = batch.column("moves")
            every = list(zip(*[c.to_pylist() for c in lists.flatten().flatten()], strict=True))  # all events' moves, column by column
            ends = [x - lists.offsets[0].as_py() for x in lists.offsets.to_pylist()]
            out = []
            for i, who in enumerate(batch.column("user").to_pylist()):
                if who != held:
                    held, state, n = who, start_of(attributes), 0
                changes = moved(state, n, every[ends[i] : ends[i + 1]])
                n += 1
                out.append((n, *_split(state), changes))
            columns = zip(*out, strict=True) if out else [()] * 4
            told = [pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *told], [*keys, *kinds])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    told = rows.repartition("user").sortWithinPartitions(*keys).mapInArrow(run, f"{fields}, {HISTORY}")
    return told.toDF(user, *order, "n", "wants", "likes", "changes")


def final(events: DataFrame, user: str, order: list[str], attributes: list[str]) -> DataFrame:
    """(user, n, wants, likes): each user's profile after all events."""
    rows = history(events, user, order, attributes)
    return rows.groupBy(user).agg(F.max_by(F.struct("n", "wants", "likes"), "n").alias("p")).select(user, "p.*")


class _Folded(StatefulProcessor):
    """Keeps a user's profile, and the events that may still be overtaken by earlier ones."""

    def __init__(self, attributes: list[str], idle_ms: int):
        self.attributes, self.idle_ms = attributes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", "n long, last long, slots string")
        self.waiting = handle.getListState("waiting", "us long, id long, moves string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            events = list(zip(batch["us"].tolist(), batch["o1"].tolist(), batch["moves"].tolist(), strict=True))
            self.waiting.appendList(events)
            latest = max(latest, max(us for us, *_ in events))
        # when the watermark is there, no earlier event can come any more
        self.handle.registerTimer(latest // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        n, last, slots = self.profile.get() if self.profile.exists() else (0, 0, "")
        state = json.loads(slots) if slots else start_of(self.attributes)
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(e) for e in waiting if e[0] // 1000 < now), key=lambda e: e[:2])
        if not due:
            if now >= last + self.idle_ms:
                self.profile.clear()  # what waits is later than this
            return
        out = []
        for us, event_id, told in due:
            if n and us // 1000 - last >= self.idle_ms:
                n, state = 0, start_of(self.attributes)
            last = us // 1000
            changes = moved(state, n, [(m["slot"], m.get("target"), m["step"], m["paced"]) for m in json.loads(told)])
            n += 1
            wants, likes = _split(state)
            out.append((key[0], pd.Timestamp(us, unit="us"), event_id, n, json.dumps(dict(wants)), json.dumps(dict(likes)), changes))
        rest = [tuple(e) for e in waiting if e[0] // 1000 >= now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.profile.update((n, last, json.dumps(state)))
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=["user", "o0", "o1", "n", "wants", "likes", "changes"])

    def close(self) -> None:
        pass


def history_stream(
    events: DataFrame, attributes: list[str], user: str = "user_id", order: tuple[str, str] = ("ts", "event_id"), late: str = "1 hour", idle: str = "90 days"
) -> DataFrame:
    """``history`` of a stream whose events may come out of order.

    Events wait until the watermark (``late`` behind the latest event time) has passed them and are then applied in the order of
    time and id; so the answer is that of the batch, whatever micro-batches they came in. An event that comes behind the
    watermark is dropped. A user's state is the profile and the waiting events; a profile that no event came to for ``idle``
    of event time is let go, and the next event starts afresh. Needs the RocksDB state store.
    """
    wait = pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)
    told = _rows(events.withWatermark(order[0], late), user, list(order), attributes)
    kind = told.schema["user"].dataType.simpleString()
    rows = told.select("user", "o0", F.unix_micros(F.col("o0").cast("timestamp")).alias("us"), F.col("o1").cast("long").alias("o1"), F.to_json("moves").alias("moves"))
    out = rows.groupBy("user").transformWithStateInPandas(
        _Folded(attributes, wait), f"user {kind}, o0 timestamp, o1 long, n long, wants string, likes string, changes array<string>", "Append", "EventTime"
    )
    read = lambda c: F.from_json(c, "map<string,double>").alias(c)
    return out.select(F.col("user").alias(user), F.col("o0").alias(order[0]), F.col("o1").alias(order[1]), "n", read("wants"), read("likes"), "changes")
