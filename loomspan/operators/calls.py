"""Asking an outside model many questions at a time, inside a task.

A task has at most `workers` requests under way. Each try has a deadline, after which it counts as failed and its thread is
left behind; a failed try is repeated after a pause that doubles each time. When `most_failures` prompts of a batch of
rows have failed for good, the task stops asking, as the model is likely gone: what is left is told as not asked and stays
for a later run (see shards.py).
"""

from __future__ import annotations

import heapq
import itertools
import queue
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOME = "struct<reply:string,attempts:int,error:string,seconds:double>"
NOT_ASKED = "not asked"


@dataclass
class Outcome:
    """attempts: tries made; error: the last try's, null after a reply; seconds: from the first try to the end of the last."""

    reply: str | None = None
    attempts: int = 0
    error: str | None = None
    seconds: float = 0.0


def call_all(fn: Callable[[str], str], prompts: list[str | None], workers: int = 8, timeout: float = 60.0, tries: int = 3, pause: float = 0.5, most_failures: int | None = None) -> list[Outcome]:
    """One outcome for each prompt, in their order; null prompts aren't asked."""
    out = [Outcome() for _ in prompts]
    began = [0.0] * len(prompts)
    ready = deque((k, 1) for k, p in enumerate(prompts) if p is not None)
    later: list[tuple[float, int, int]] = []
    running: dict[int, tuple[int, int, float]] = {}
    done: queue.SimpleQueue = queue.SimpleQueue()
    tickets = itertools.count()
    failures = 0

    def ask(ticket: int, prompt: str) -> None:
        try:
            done.put((ticket, str(fn(prompt)), None))
        except Exception as e:  # noqa: BLE001 - the outside model's errors of any kind end a try
            done.put((ticket, None, f"{type(e).__name__}: {e}"))

    def ended(k: int, attempt: int, reply: str | None, error: str | None, now: float) -> None:
        nonlocal failures
        out[k] = Outcome(reply, attempt, error, now - began[k])
        if error is None:
            return
        if attempt < tries:
            heapq.heappush(later, (now + pause * 2 ** (attempt - 1), k, attempt + 1))
        else:
            failures += 1

    while ready or later or running:
        now = time.monotonic()
        while later and later[0][0] <= now:
            ready.append(heapq.heappop(later)[1:])
        while ready and len(running) < workers:
            k, attempt = ready.popleft()
            if attempt == 1:
                began[k] = now
            ticket = next(tickets)
            running[ticket] = (k, attempt, now + timeout)
            threading.Thread(target=ask, args=(ticket, prompts[k]), daemon=True).start()
        until = min([t for _, _, t in running.values()] + [x[0] for x in later[:1]])
        try:
            ticket, reply, error = done.get(timeout=max(0.0, until - now))
            if ticket in running:  # else it came after its deadline
                k, attempt, _ = running.pop(ticket)
                ended(k, attempt, reply, error, time.monotonic())
        except queue.Empty:
            now = time.monotonic()
            for ticket in [t for t, (_, _, end) in running.items() if end <= now]:
                k, attempt, _ = running.pop(ticket)
                ended(k, attempt, None, f"no reply within {timeout:g} s", now)
        if most_failures is not None and failures >= most_failures:
            for k in {k for k, _ in ready} | {x[1] for x in later} | {k for k, _, _ in running.values()}:
                out[k] = Outcome(None, out[k].attempts, NOT_ASKED, 0.0)
            break
    return out


def concurrent_calls(fn: Callable[[str], str], **limits) -> Callable[[Column], Column]:
    """A column of prompts as structs of reply, attempts, error and seconds. limits: those of call_all(), for each batch of rows."""

    @F.pandas_udf(OUTCOME)
    def run(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(o) for o in call_all(fn, prompts.tolist(), **limits)], columns=["reply", "attempts", "error", "seconds"])

    return run


def concurrent_replies(fn: Callable[[str], str], **limits) -> Callable[[Column], Column]:
    """The replies alone, null where none came: a labeler or judge for labeling.py."""
    calls = concurrent_calls(fn, **limits)
    return lambda prompt: calls(prompt)["reply"]
