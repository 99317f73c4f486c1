"""What flows are put together from: steps with conditions, in parallel, switched and timed; subjects and observers; a bus
with retries; events kept until a write has succeeded; state reduced from events; layers around a step."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recallgrid.streaming.flows import Operator

log = logging.getLogger(__name__)
Frames = dict[str, DataFrame]


# ------------------------------------------------------------------ steps
def conditional(test: Callable[[Frames], bool], then: Operator, otherwise: Operator | None = None) -> Operator:
    """One step or the other, as the test on the frames says; without another, nothing."""

    def run(frames: Frames) -> Frames:
        return then(frames) if test(frames) else otherwise(frames) if otherwise else {}

    return run


def parallel(*steps: Operator, at_once: int = 4) -> Operator:
    """Steps that don't depend on each other, a few at once, each with its own copy of the frames; of frames that several
    give, the last step's stays."""

    def run(frames: Frames) -> Frames:
        with ThreadPoolExecutor(at_once) as pool:
            return reduce(lambda a, b: a | b, pool.map(lambda step: step(dict(frames)), steps), {})

    return run


@dataclass
class Stage:
    """A step that can be switched off, whose failure can be kept from the others, and that is timed."""

    name: str
    step: Operator
    enabled: bool = True
    isolated: bool = True
    seconds: float = 0.0
    problem: Exception | None = None

    def __call__(self, frames: Frames) -> Frames:
        if not self.enabled:
            return {}
        began = time.monotonic()
        try:
            return self.step(frames)
        except Exception as problem:  # noqa: BLE001
            self.problem = problem
            if not self.isolated:
                raise
            return {}
        finally:
            self.seconds = time.monotonic() - began


Layer = Callable[[Operator], Operator]


def layered(step: Operator, *layers: Layer) -> Operator:
    """The step within its layers, the first one outermost."""
    return reduce(lambda inner, layer: layer(inner), reversed(layers), step)


def logged(name: str) -> Layer:
    def layer(step: Operator) -> Operator:
        def run(frames: Frames) -> Frames:
            log.info("%s begins with %s", name, sorted(frames))
            out = step(frames)
            log.info("%s gives %s", name, sorted(out))
            return out

        return run

    return layer


def audited(trail: list[tuple[str, tuple[str, ...], tuple[str, ...]]], name: str) -> Layer:
    """Keeps what went in and out, by name."""

    def layer(step: Operator) -> Operator:
        def run(frames: Frames) -> Frames:
            out = step(frames)
            trail.append((name, tuple(sorted(frames)), tuple(sorted(out))))
            return out

        return run

    return layer


def throttled(seconds: float, clock: Callable[[], float] = time.monotonic) -> Layer:
    """A step that runs once in so many seconds at most; in between it gives nothing."""

    def layer(step: Operator) -> Operator:
        last = [float("-inf")]

        def run(frames: Frames) -> Frames:
            if clock() - last[0] < seconds:
                return {}
            last[0] = clock()
            return step(frames)

        return run

    return layer


def guarded(otherwise: Callable[[Exception], Frames]) -> Layer:
    def layer(step: Operator) -> Operator:
        def run(frames: Frames) -> Frames:
            try:
                return step(frames)
            except Exception as problem:  # noqa: BLE001
                return otherwise(problem)

        return run

    return layer


# ------------------------------------------------------------------ observers
class Observer(Protocol):
    def next(self, value: Any) -> None: ...


@dataclass
class Subscription:
    cancel: Callable[[], None]


class Subject:
    """Passes what it is given on to all who have subscribed, until it is completed."""

    def __init__(self) -> None:
        self._to: dict[int, Callable[[Any], None]] = {}
        self._count, self.completed = 0, False

    def subscribe(self, handler: Callable[[Any], None]) -> Subscription:
        key, self._count = self._count, self._count + 1
        self._to[key] = handler
        return Subscription(lambda: self._to.pop(key, None) and None)

    def next(self, value: Any) -> None:
        if not self.completed:
            for handler in list(self._to.values()):
                handler(value)

    def complete(self) -> None:
        self.completed = True
        self._to.clear()


def observe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls the handler with each batch of a stream, at least once each; the handle stops it."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Bus:
    """Topics and their handlers. publish() calls each handler once and keeps failures; reliably() calls a handler that fails
    again, a few times, and hands on what still fails."""

    def __init__(self, pause: Callable[[float], None] = time.sleep) -> None:
        self.handlers: dict[str, list[Callable[[dict], None]]] = defaultdict(list)
        self.failures: list[tuple[str, Exception]] = []
        self.pause = pause

    def on(self, topic: str, handler: Callable[[dict], None]) -> None:
        self.handlers[topic].append(handler)

    def publish(self, topic: str, data: dict) -> int:
        done = 0
        for handler in self.handlers[topic]:
            try:
                handler(data)
                done += 1
            except Exception as problem:  # noqa: BLE001
                self.failures.append((topic, problem))
        return done

    def reliably(self, topic: str, data: dict, tries: int = 3) -> None:
        for handler in self.handlers[topic]:
            for n in range(tries):
                try:
                    handler(data)
                    break
                except Exception as problem:  # noqa: BLE001
                    if n + 1 == tries:
                        self.failures.append((topic, problem))
                        raise
                    self.pause(0.1 * 2**n)


@dataclass
class Outbox:
    """Events of a write, published only once the write has succeeded."""

    bus: Bus
    waiting: list[tuple[str, dict]] = field(default_factory=list)

    def add(self, topic: str, data: dict) -> None:
        self.waiting.append((topic, data))

    def committed(self, write: Callable[[], None]) -> None:
        try:
            write()
        except Exception:
            self.waiting.clear()
            raise
        waiting, self.waiting = self.waiting, []
        for topic, data in waiting:
            self.bus.publish(topic, data)


# ------------------------------------------------------------------ state from events
class Store:
    """State reduced from events by pure functions. The last `window` states can be gone back to; replay() gives the state
    after the first n events of the window. Values derived from the state are kept until it changes."""

    def __init__(self, state: Any, reducers: dict[str, Callable[[Any, Any], Any]], window: int = 20) -> None:
        self.state, self.reducers, self.window = state, reducers, window
        self.past: list[tuple[Any, str, Any]] = []
        self._derived: dict[Callable, tuple[Any, Any]] = {}

    def dispatch(self, kind: str, value: Any = None) -> Any:
        self.past = [*self.past, (self.state, kind, value)][-self.window :]
        self.state = self.reducers[kind](self.state, value) if kind in self.reducers else self.state
        return self.state

    def undo(self) -> Any:
        if self.past:
            self.state = self.past.pop()[0]
        return self.state

    def replay(self, n: int) -> Any:
        state = self.past[0][0] if self.past else self.state
        for _, kind, value in self.past[:n]:
            state = self.reducers[kind](state, value) if kind in self.reducers else state
        return state

    def select(self, of: Callable[[Any], Any]) -> Any:
        known = self._derived.get(of)
        if known is None or known[0] is not self.state:
            known = self._derived[of] = (self.state, of(self.state))
        return known[1]
