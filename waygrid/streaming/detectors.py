"""Stateful detectors: plain state machines, run over streams or over stored samples.

Each detector is a function ``(state, row) -> (state, outputs)``.  ``over_stream`` runs it with Spark's keyed state,
so state survives restarts in the checkpoint; ``over_table`` replays stored rows through windows of one key in
time order.  Rows of one key must come in time order within a batch; late rows of older batches are taken as
they come, as a watermark drops what is too late before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, tuple], tuple[tuple, list[tuple]]]


def _plain(row) -> tuple:
    """A row of pandas with None for what is absent."""
    return tuple(None if x is None or x != x else x for x in row)


def over_stream(stream: DataFrame, key: str, columns: list[str], step: Step, start: tuple, state_schema: str, out_schema: str, order: list[str], idle_ms: int = 0) -> DataFrame:
    """Outputs of ``step`` for each key of a stream; a key that is idle for ``idle_ms`` loses its state."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else start
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        found: list[tuple] = []
        for row in rows[columns].itertuples(index=False, name=None):
            now, out = step(now, _plain(row))
            found += [(*keys, *x) for x in out]
        state.update(now)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=names)

    names = [part.split()[0] for part in out_schema.split(", ")]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", timeout)


def debounce(least_seconds: float, least_change: float) -> Step:
    """Lets a sample ``(time, value)`` through if both enough time and enough change lie since the last one let through."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        time, value = row
        last_time, last_value = state
        if last_time is None or (time - last_time >= least_seconds and abs(value - last_value) >= least_change):
            return (time, value), [(time, value)]
        return state, []

    return step


def rides(boarding: str, departing: str, arriving: str, most_seconds: float) -> Step:
    """Departure and arrival of rides from samples ``(time, kind)``.

    Only a departure after boarding counts, so passing another dock is no departure; a boarding or a ride that
    takes too long is forgotten.  Gives ``(departed, arrived, seconds)``.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        time, kind = row
        phase, since = state
        if phase and time - since > most_seconds:
            phase, since = "", 0.0
        if kind == boarding:
            return ("boarded", time), []
        if kind == departing and phase == "boarded":
            return ("away", time), []
        if kind == arriving and phase == "away":
            return ("", 0.0), [(since, time, time - since)]
        return (phase, since), []

    return step


def spaced(least: float) -> Step:
    """Lets a sample ``(id, x, y)`` through if it lies ``least`` or more from the last one let through; the first always."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        name, x, y = row
        if state[0] is None or (x - state[0]) ** 2 + (y - state[1]) ** 2 >= least * least:
            return (x, y), [(name,)]
        return state, []

    return step


def arriving(stops: list[tuple[float, float]], reach: float) -> Step:
    """Arrivals ``(id, stop)`` of samples ``(id, x, y)`` at the stops of a loop, in turn."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (stop,), (name, x, y) = state, row
        if (x - stops[stop][0]) ** 2 + (y - stops[stop][1]) ** 2 <= reach * reach:
            return ((stop + 1) % len(stops),), [(name, stop)]
        return state, []

    return step


#: When it was last looked, and where the body is that comes first.
NO_BODY = (None, None, None)


def bodies(pause: float) -> Step:
    """Changes of the stop at a ghost's body from samples ``(id, time, ghost, x, y)``: gives ``(id, placed, x, y)``.

    A sample counts if the last one that did is ``pause`` or longer ago.  A ghost whose body has a place makes for it first; a body
    less than a yard off on both axes is the same; one that is gone, or of no known place, is taken off.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        checked, *body = state
        name, time, ghost, x, y = row
        if checked is not None and time - checked < pause:
            return state, []
        seen = [x, y] if ghost and x is not None else [None, None]
        before, now = body[0] is not None, seen[0] is not None
        if before and now and all(abs(a - b) < 1 for a, b in zip(body, seen)):
            return (time, *body), []
        return (time, *seen), [(name, now, seen[0] or 0.0, seen[1] or 0.0)] if before or now else []

    return step


#: Phases of a player on a line between two docks.
ELSEWHERE, WAITING, BOARDING, ABOARD, UNDER_WAY = range(5)

#: Phase, dock of the phase, when it was boarded, samples at rest at the far dock, last place.
NO_RIDE = (ELSEWHERE, 0, 0.0, 0, None, None)


def next_phase(phase: int, dock: int, place: int, carried: bool, walking: bool) -> tuple[int, int]:
    """Phase and dock after a sample taken at dock ``place`` (0: at none).

    Being carried leads from waiting over boarding on board, and changes nothing otherwise: who is carried to a dock doesn't
    wait there.  Who stands on board stays there, and so does everyone under way.  Anyone else waits at the dock where
    they are.
    """
    if carried:
        return {WAITING: BOARDING, BOARDING: ABOARD}.get(phase, phase), dock
    if phase == UNDER_WAY or phase == ABOARD and not walking:
        return phase, dock
    return (WAITING, place) if place else (ELSEWHERE, 0)


def transport(docks: tuple[tuple[float, float], tuple[float, float]], reach: float, carry: float, away: float, idle: float, checks: int) -> Step:
    """Rides between two docks from samples ``(id, time, x, y, walking)``: gives ``(id, what, side, time)``.

    A ride departs only from the dock where its player waited: when carried (``carry`` or more without walking) at two
    samples in a row and ``away`` from that dock; the time is that of the first of them.  Being at rest at the other dock
    for ``checks`` samples is its arrival and never a departure.  What was boarded ``idle`` seconds ago is forgotten.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        phase, dock, boarded, rests, last_x, last_y = state
        name, time, x, y, walking = row
        from_dock = [(x - a) ** 2 + (y - b) ** 2 for a, b in docks]
        place = next((i for i, d in enumerate(from_dock, 1) if d <= reach * reach), 0)
        carried = not walking and last_x is not None and (x - last_x) ** 2 + (y - last_y) ** 2 >= carry * carry
        if phase >= BOARDING and time - boarded > idle:
            phase, dock = ELSEWHERE, 0
        phase, dock = next_phase(phase, dock, place, carried, walking)
        found = []
        if phase == BOARDING:
            boarded = time
        elif phase == ABOARD and from_dock[dock - 1] >= away * away:
            phase, rests = UNDER_WAY, 0
            found.append((name, "departed", dock, boarded))
        if phase == UNDER_WAY:
            rests = rests + 1 if place == 3 - dock and not carried else 0
            if rests >= checks:
                phase, dock = WAITING, place
                found.append((name, "arrived", place, time))
        return (phase, dock, boarded, rests, x, y), found

    return step


#: Last place outside, when, and whether the last sample was inside.
NOT_OUTSIDE = (None, None, 0.0, False)


def entering(fresh: float) -> Step:
    """Ways in from samples ``(id, time, x, y, inside)``: gives ``(id, inside, x, y)``, the last place outside, ``fresh`` seconds old at most."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        last_x, last_y, at, was_in = state
        name, time, x, y, inside = row
        if inside is None:
            return (x, y, time, False), []
        fits = not was_in and last_x is not None and time - at <= fresh
        return (last_x, last_y, at, True), [(name, inside, last_x, last_y)] if fits else []

    return step


#: Target, beginning, level, estimate, points, last point, time of the last sample.
NO_TRIP = (None, 0.0, 0, 0.0, 0, None, None, 0.0)


def trip_session(step_length: float, most_points: int, least_seconds: float, faster: float, least_points: int, idle: float) -> Step:
    """Trips worth keeping from samples ``(id, time, x, y, level, target, away, arrived, estimate)``: gives ``(id, target, began, actual, points)``.

    A trip is traced to one target: another one begins another trip, and no target, being away (carried or dead), another
    level, or ``idle`` seconds without a sample end it for nothing.  A point is added ``step_length`` or more from the last, up to ``most_points``.
    Arriving at its target ends a trip for good; it is kept if it took ``least_seconds`` or more, at most ``faster`` times the estimate
    it began with, and has ``least_points`` points or more.  The place of arrival is one point more.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        to, began, floor, estimated, points, px, py, last = state
        name, time, x, y, level, target, away, arrived, estimate = row
        if to is not None and time - last > idle:
            to = None
        if arrived:
            worth = to is not None and to == target and least_seconds <= time - began <= faster * estimated and points >= least_points
            return NO_TRIP, [(name, target, began, time - began, points + 1)] if worth else []
        if away or target is None:
            return NO_TRIP, []
        if to != target:
            return (target, time, level, estimate, 1, x, y, time), []
        if level != floor:
            return NO_TRIP, []
        if points < most_points and (x - px) ** 2 + (y - py) ** 2 >= step_length * step_length:
            points, px, py = points + 1, x, y
        return (to, began, floor, estimated, points, px, py, time), []

    return step


def reassembly(idle_seconds: float) -> Step:
    """Messages from parts ``(time, message, number, of, text)`` of one sender.

    Another message or another count of parts starts anew, as does a pause; a part that comes again changes
    nothing.  State is ``(message, of, last time, parts joined by bars)``.  Gives ``(message, text)``.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        time, message, number, of, text = row
        if not 1 <= number <= of <= 8:
            return state, []
        held, count, last, parts = state
        if held != message or count != of or time - last > idle_seconds:
            parts = "\x1e" * (of - 1)
        slots = parts.split("\x1e")
        slots[number - 1] = slots[number - 1] or text
        if all(slots):
            return ("", 0, 0.0, ""), [(message, "".join(slots))]
        return (message, of, time, "\x1e".join(slots)), []

    return step


def over_table(rows: DataFrame, key: str, columns: list[str], step: Step, start: tuple, out_schema: str, order: list[str]) -> DataFrame:
    """The same detector over stored rows: keys are dealt out, and each is read in order as it streams by.

    A task holds one Arrow batch and one state, whatever the number of rows of a key.
    """
    names = [part.split()[0] for part in out_schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now = None, start
        for batch in batches:
            found: list[tuple] = []
            for k, *row in batch.itertuples(index=False, name=None):
                if k != current:
                    current, now = k, start
                now, out = step(now, _plain(row))
                found += [(k, *x) for x in out]
            yield pd.DataFrame(found, columns=names)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    return dealt.mapInPandas(run, out_schema)
