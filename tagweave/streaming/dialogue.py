"""Questionnaire progress over a stream of answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagweave import wording as w
from tagweave.operators.dialogue import Blocks, _steps, describe_steps

DAY_MS = 24 * 60 * 60 * 1000


def steps_after(start: int, valid: np.ndarray, end: int) -> np.ndarray:
    """The step after each answer, from the step before the first.

    Every answer maps each step to the next one; the maps of all answers so far are composed by
    doubling, so there is no loop over answers.
    """
    steps = np.arange(end + 1)
    maps = np.where(valid[:, None], steps + 1, steps)
    maps[:, end] = 0
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps[:, start]


def stream_progress(
    answers: DataFrame, blocks: Blocks = w.QUESTION_BLOCKS, forget_after_ms: int | None = None
) -> DataFrame:
    """Streaming twin of ``dialogue_progress`` for ``answers(conv_id, turn, valid)``.

    The state of a conversation is its step. Turns of one micro-batch are put in order; a turn that
    arrives after a later one was handled is taken as it comes, as in a live chat.

    A stream that never ends should say when a finished questionnaire may go, for instance
    ``30 * DAY_MS`` after its last turn; a message that comes later still is the first answer of a new
    one. Spark looks for such by the clock, in batches without data, so a stream that is to end when all
    is read (``availableNow``) would run on for ever: it passes None and forgets nothing.
    """
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    end = len(_steps(blocks)) - 1

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step = state.get[0] if state.exists else 0
        # two narrow columns of one conversation in one micro-batch
        parts = [(b["turn"].to_numpy(), b["valid"].to_numpy(dtype=bool)) for b in batches]
        turn, valid = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(turn, kind="stable")
        after = steps_after(step, valid[order], end)
        before = np.concatenate([[step], after[:-1]])
        state.update((int(after[-1]),))
        if after[-1] == end and forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(
            {
                "conv_id": [key[0]] * len(turn),
                "turn": turn[order],
                "valid": valid[order],
                "step": before.astype("int32"),
                "next": after.astype("int32"),
            }
        )

    key_type = answers.schema["conv_id"].dataType.simpleString()
    moves = (
        answers.select("conv_id", "turn", "valid")
        .groupBy("conv_id")
        .applyInPandasWithState(
            advance,
            f"conv_id {key_type}, turn bigint, valid boolean, step int, next int",
            "step int",
            "append",
            timeout,
        )
    )
    return describe_steps(moves, blocks)
