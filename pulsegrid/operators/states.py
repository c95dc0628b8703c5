"""States carried along a session: rates from spectra, beliefs over bins and the most probable path, by scans over chunks.

What a chunk of steps does to the state before it is an operator of bounded size, whatever that state is: a map of
rates, a matrix of products and sums, or one of sums and maxima. Operators are made of all chunks at once, put together
by session in one row a chunk, and every chunk is gone through again from the state that it begins with. So no task
holds a session. Steps are numbers; a chunk is a range of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import next_belief


def _chunks(df: DataFrame, session: str, step: str, value: str, size: int) -> DataFrame:
    return df.select(session, step, F.col(value).alias("__seen"), F.floor(F.col(step) / F.lit(size)).alias("__chunk"))


def _each(rows: DataFrame, session: str, step: str, make: Callable[[pd.DataFrame], dict], columns: str) -> DataFrame:
    """One row a chunk, of what `make` gives for its rows in order."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(step)
        return pd.DataFrame([{session: part[session].iloc[0], "__chunk": part["__chunk"].iloc[0]} | make(part)])

    kind = rows.schema[session].dataType.simpleString()
    return rows.groupBy(session, "__chunk").applyInPandas(run, f"{session} {kind}, __chunk long, {columns}")


def _along(chunks: DataFrame, session: str, carry: Callable[[pd.DataFrame], list], kind: str, name: str) -> DataFrame:
    """(session, __chunk, name): what `carry` gives for a session's chunks in order, one row each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__chunk")
        return part[[session, "__chunk"]].assign(**{name: pd.Series(carry(part), index=part.index, dtype=object)})

    own = chunks.schema[session].dataType.simpleString()
    return chunks.groupBy(session).applyInPandas(run, f"{session} {own}, __chunk long, {name} {kind}")


def _again(rows: DataFrame, session: str, step: str, states: DataFrame, follow: Callable[[pd.DataFrame], list], kind: str, name: str) -> DataFrame:
    """(session, step, name) of every row, from its chunk's states."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(step)
        return part[[session, step]].assign(**{name: pd.Series(follow(part), index=part.index, dtype=object)})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (session, step)}
    joined = rows.join(states, [session, "__chunk"])
    return joined.groupBy(session, "__chunk").applyInPandas(run, f"{session} {kinds[session]}, {step} {kinds[step]}, {name} {kind}")


class Rates:
    """The rate of a spectrum, given the rate before: the strongest line between 0.5 and 1.4 times that rate, or between
    slow and fast where it is none or outside of these. A state is 0 for none, or 1 more than a rate's place among all
    that can be found."""

    def __init__(self, slow: int, fast: int):
        self.slow, self.fast, self.least = slow, fast, slow // 2
        self.states = int(1.4 * fast) - self.least + 2

    def state(self, bpm: int) -> int:
        return bpm - self.least + 1

    def bpm(self, state: int) -> int | None:
        return state + self.least - 1 if state else None

    def line(self, power: np.ndarray, bpm: np.ndarray, state: int) -> int | None:
        before = self.bpm(state)
        low, high = (0.5 * before, 1.4 * before) if before and self.slow <= before <= self.fast else (self.slow, self.fast)
        a, b = np.searchsorted(bpm, low), np.searchsorted(bpm, high, "right")
        return int(bpm[a + int(power[a:b].argmax())] + 1e-9) if b > a else None

    def follow(self, spectra: list[tuple[np.ndarray, np.ndarray] | None], state: int) -> list[int | None]:
        """The rates of successive spectra; one without a line leaves the state as it is."""
        found = []
        for s in spectra:
            found.append(None if s is None else self.line(*s, state))
            state = state if found[-1] is None else self.state(found[-1])
        return found

    def map(self, spectra: list[tuple[np.ndarray, np.ndarray] | None]) -> list[int]:
        """The state after the spectra, for each state before them. Only the different ones are followed, soon one."""
        at = np.arange(self.states)
        for s in spectra:
            if s is not None:
                different, which = np.unique(at, return_inverse=True)
                found = [self.line(*s, int(k)) for k in different]
                at = np.array([k if f is None else self.state(f) for k, f in zip(different, found, strict=True)])[which]
        return at.tolist()

    @staticmethod
    def starts(chunks: pd.DataFrame) -> list[int]:
        """The state that each chunk of a session begins with, by the chunks' maps in order."""
        out, state = [], 0
        for m in chunks["map"]:
            out.append(state)
            state = int(m[state]) if len(m) else 0  # a last chunk needs none
        return out


def spectrum(values, fs: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The one-sided Blackman periodogram of a frame, and its frequencies a minute."""
    if values is None or not len(values):
        return None
    x = np.asarray(values, float)
    power = np.abs(np.fft.rfft((x - x.mean()) * np.blackman(len(x)))) ** 2
    power[1 : (len(x) + 1) // 2] *= 2
    return power, np.fft.rfftfreq(len(x), 1 / fs) * 60


def spectral_rate(df: DataFrame, session: str, step: str, frame: str, fs: float, slow_bpm: int = 30, fast_bpm: int = 200, size: int = 4096) -> DataFrame:
    """session, step, bpm (int): the strongest line of each frame's Blackman periodogram, see Rates.

    Frames that are null, empty or have no line in the range have a null rate and leave the one before as it is. The
    operator of a chunk of `size` steps is the map of the rate before it to the rate after it.
    """
    rates, rows = Rates(slow_bpm, fast_bpm), _chunks(df, session, step, frame, size)
    maps = _each(rows, session, step, lambda part: {"map": rates.map([spectrum(v, fs) for v in part["__seen"]])}, "map array<int>")
    starts = _along(maps, session, Rates.starts, "int", "__start")
    return _again(rows, session, step, starts, lambda part: rates.follow([spectrum(v, fs) for v in part["__seen"]], int(part["__start"].iloc[0])), "int", "bpm")


def _products(seen: list[np.ndarray], move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Belief after all rows from none before, and the matrix that a belief before is multiplied by (up to a factor)."""
    now, whole = None, np.eye(len(move))
    for s in seen:
        now = next_belief(now, s, move)
        whole = (whole @ move) * (s if s.any() else 1.0)
        whole /= whole.max()
    return now, whole


def beliefs(df: DataFrame, session: str, step: str, observed: str, move: np.ndarray, size: int = 4096) -> DataFrame:
    """session, step, belief: the filtered distribution over bins after each step. An observation of zeros only leaves
    the prediction as it is.

    `move` must have no zeros, so that every observation with a value above 0 is possible; a chunk's operator is a
    matrix of bins times bins.
    """
    if not (move > 0).all():
        raise ValueError("every move between bins must be possible, if only with a small probability")
    rows, bins = _chunks(df, session, step, observed, size), len(move)
    arrays = lambda part: [np.asarray(v, float) for v in part["__seen"]]

    def make(part: pd.DataFrame) -> dict:
        now, whole = _products(arrays(part), move)
        return {"alone": now, "whole": whole.ravel()}

    def carry(chunks: pd.DataFrame) -> list:
        out, now = [], None
        for alone, whole in zip(chunks["alone"], chunks["whole"], strict=True):
            out.append(now)
            now = np.asarray(alone) if now is None else now @ np.asarray(whole).reshape(bins, bins)
            now = now / now.sum()
        return out

    def follow(part: pd.DataFrame) -> list:
        now, out = part["__start"].iloc[0], []
        for seen in arrays(part):
            now = next_belief(now, seen, move)
            out.append(now)
        return out

    chunks = _each(rows, session, step, make, "alone array<double>, whole array<double>")
    return _again(rows, session, step, _along(chunks, session, carry, "array<double>", "__start"), follow, "array<double>", "belief")


def _logs(values) -> np.ndarray:
    seen = np.asarray(values, float)
    with np.errstate(divide="ignore"):
        return np.log(seen) if seen.any() else np.zeros(len(seen))


def _level(score: np.ndarray) -> np.ndarray:
    top = score.max()
    return score - top if np.isfinite(top) else score


def _forward(start: np.ndarray | None, seen: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The scores after all rows, and for each row and bin the best bin before it (none for a session's first row)."""
    score, back = start, []
    for e in seen:
        if score is None:
            score = _level(e)
            continue
        reached = score[:, None] + logs
        back.append(reached.argmax(0).astype(np.int16))
        score = _level(reached.max(0) + e)
    return score, back


def best_path(df: DataFrame, session: str, step: str, observed: str, move: np.ndarray, size: int = 4096) -> DataFrame:
    """session, step, bin: the most probable path of bins (Viterbi, in logarithms; the lowest bin of equals). An
    observation of zeros only counts as none.

    A chunk's operator forward is a matrix of sums and maxima, bins times bins. Backward it is the map of the bin at its
    end to the bin before it.
    """
    rows, bins = _chunks(df, session, step, observed, size), len(move)
    with np.errstate(divide="ignore"):
        logs = np.log(move)

    def make(part: pd.DataFrame) -> dict:
        seen = [_logs(v) for v in part["__seen"]]
        whole = np.where(np.eye(bins) > 0, 0.0, -np.inf)
        for e in seen:
            whole = _level((whole[:, :, None] + logs[None]).max(1) + e)
        return {"alone": _forward(None, seen, logs)[0], "whole": whole.ravel()}

    def carry(chunks: pd.DataFrame) -> list:
        out, score = [], None
        for alone, whole in zip(chunks["alone"], chunks["whole"], strict=True):
            out.append(score)
            score = np.asarray(alone) if score is None else _level((score[:, None] + np.asarray(whole).reshape(bins, bins)).max(0))
        return out

    def turn(part: pd.DataFrame) -> dict:
        score, back = _forward(part["__start"].iloc[0], [_logs(v) for v in part["__seen"]], logs)
        before = np.arange(bins)
        for b in reversed(back):
            before = b[before]
        return {"before": before.astype(np.int32), "best": int(score.argmax())}

    def ends(chunks: pd.DataFrame) -> list:
        out = [int(chunks["best"].iloc[-1])]
        for before in reversed(chunks["before"].tolist()[1:]):
            out.append(int(before[out[-1]]))
        return out[::-1]

    def trace(part: pd.DataFrame) -> list:
        _, back = _forward(part["__start"].iloc[0], [_logs(v) for v in part["__seen"]], logs)
        path = [int(part["__end"].iloc[0])]
        for b in reversed(back[-(len(part) - 1) :] if len(part) > 1 else []):
            path.append(int(b[path[-1]]))
        return path[::-1]

    starts = _along(_each(rows, session, step, make, "alone array<double>, whole array<double>"), session, carry, "array<double>", "__start")
    turned = _each(rows.join(starts, [session, "__chunk"]), session, step, turn, "before array<int>, best int")
    states = starts.join(_along(turned, session, ends, "int", "__end"), [session, "__chunk"])
    return _again(rows, session, step, states, trace, "int", "bin")
